"""Codecs of spectra: packed sorted whole numbers, m/z and intensity arrays, arrays as text.

Sorted numbers are held as differences. Blocks of 32 share a bit width; four blocks at a time have
their widths in one word, left-over blocks one word each; fewer than 32 numbers at the end take one to
five bytes of seven bits each, the last one marked by its high bit, filled up to a whole word. All
words have 32 bits; the first one is the count. Blocks of one width are decoded together.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np

BLOCK = 32


def _widths(deltas: np.ndarray) -> np.ndarray:
    """Bits that the largest of each block needs."""
    most = deltas.reshape(-1, BLOCK).max(axis=1)
    return np.array([int(m).bit_length() for m in most], np.int64)


def _packed(blocks: np.ndarray, width: int) -> np.ndarray:
    """Blocks (k, 32) as (k, width) words, lowest bits first."""
    bits = (blocks[:, :, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(blocks), -1), axis=1, bitorder="little").view("<u4")


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").reshape(len(words), BLOCK, width)
    return bits @ (np.uint64(1) << np.arange(width, dtype=np.uint64)) if width else np.zeros((len(words), BLOCK), np.uint64)


def pack_sorted(values: np.ndarray) -> np.ndarray:
    """Words of ascending whole numbers from 0 to 2^32 - 1."""
    values = np.asarray(values, np.int64)
    deltas = np.diff(values, prepend=0)
    if len(values) and (deltas.min() < 0 or values[-1] >= 1 << 32):
        raise ValueError("numbers must ascend from 0 to 2^32 - 1")
    deltas, whole = deltas.astype(np.uint64), len(values) // BLOCK
    widths = _widths(deltas[: whole * BLOCK]) if whole else np.zeros(0, np.int64)
    blocks, body = deltas[: whole * BLOCK].reshape(-1, BLOCK), [np.zeros(0, "<u4")] * whole
    for w in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == w)
        for i, words in zip(at.tolist(), _packed(blocks[at], w), strict=True):
            body[i] = words
    out = [np.array([len(values)], "<u4")]
    for i in range(0, whole, 4):
        if i + 4 <= whole:
            out += [np.array([(widths[i] << 24) | (widths[i + 1] << 16) | (widths[i + 2] << 8) | widths[i + 3]], "<u4"), *body[i : i + 4]]
        else:
            for k in range(i, whole):
                out += [np.array([widths[k]], "<u4"), body[k]]
    tail = bytearray()
    for d in deltas[whole * BLOCK :].tolist():
        while d > 127:
            tail.append(d & 127)
            d >>= 7
        tail.append(d | 128)
    tail += bytes(-len(tail) % 4)
    return np.concatenate([*out, np.frombuffer(bytes(tail), "<u4")]).astype("<u4")


def unpack_sorted(words: np.ndarray) -> np.ndarray:
    """The numbers of ``pack_sorted``; words that end too early or hold too wide blocks are refused."""
    words = np.ascontiguousarray(words, "<u4")
    if not len(words):
        raise ValueError("no count")
    n = int(words[0])
    whole, at, starts, widths = n // BLOCK, 1, [], []
    while len(widths) < whole:
        if at >= len(words):
            raise ValueError("packed numbers are cut off")
        head = int(words[at])
        own = [head >> 24, head >> 16 & 255, head >> 8 & 255, head & 255] if whole - len(widths) >= 4 else [head]
        at += 1
        for w in own:
            if w > 32:
                raise ValueError(f"a block of {w} bits")
            starts.append(at)
            widths.append(w)
            at += w
    if at > len(words):
        raise ValueError("packed numbers are cut off")
    deltas = np.zeros(n, np.uint64)
    blocks, start, width = deltas[: whole * BLOCK].reshape(-1, BLOCK), np.array(starts, np.int64), np.array(widths, np.int64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        blocks[own] = _unpacked(words[start[own][:, None] + np.arange(w)], w)
    left = n - whole * BLOCK
    if left:
        tail = words[at:].view(np.uint8)
        ends = np.flatnonzero(tail & 128)[:left]
        if len(ends) < left:
            raise ValueError("packed numbers are cut off")
        begins = np.concatenate([[0], ends[:-1] + 1])
        part = tail[: ends[-1] + 1].astype(np.uint64) & np.uint64(127)
        place = np.arange(len(part)) - np.repeat(begins, ends - begins + 1)
        deltas[whole * BLOCK :] = np.add.reduceat(part << (7 * place).astype(np.uint64), begins)
    return np.cumsum(deltas).astype(np.int64)


def decode_mz(data: bytes, codec: str = "delta", precision: int = 1000) -> np.ndarray:
    """Sorted m/z values: compressed words of whole thousandths, as plain 32-bit differences (delta) or packed ones (packed)."""
    raw = zlib.decompress(data)
    if codec == "packed":
        values = unpack_sorted(np.frombuffer(raw, "<u4"))
    elif codec == "delta":
        values = np.cumsum(np.frombuffer(raw, "<i4"), dtype=np.int64)
    else:
        raise ValueError(codec)
    return (values / precision).astype(np.float32)


def encode_mz(values: np.ndarray, codec: str = "delta", precision: int = 1000) -> bytes:
    ints = np.round(np.asarray(values, float) * precision).astype(np.int64)
    return zlib.compress((pack_sorted(ints) if codec == "packed" else np.diff(ints, prepend=0).astype("<i4")).tobytes())


def decode_intensity(data: bytes, log10: bool = False) -> np.ndarray:
    values = np.frombuffer(zlib.decompress(data), "<f4")
    return np.power(np.float32(10), values) if log10 else values


def encode_intensity(values: np.ndarray, log10: bool = False) -> bytes:
    y = np.asarray(values, np.float32)
    return zlib.compress((np.log10(y) if log10 else y).astype("<f4").tobytes())


def to_text(values: np.ndarray) -> str:
    """An array of 32-bit numbers, whole or not, as base64 of its compressed big-endian bytes."""
    values = np.asarray(values)
    return base64.b64encode(zlib.compress(values.astype(">f4" if values.dtype.kind == "f" else ">i4").tobytes())).decode()


def from_text(text: str, kind: str = "f4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(base64.b64decode(text)), f">{kind}").astype(kind)
