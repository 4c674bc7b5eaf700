"""BPE encoding and decoding with tree concatenation for long unsplit text.

A run is what normalisation and splitting leave in one piece; the merges never reach across runs. A
run over ``leaf`` characters is encoded as a tree: it is cut into leaves, the leaves are encoded
each by itself, and neighbours are joined pairwise. A join encodes a window of tokens around it
anew and doubles the window until its first token is the left side's and its last token is the
right side's. From there on the pairs of adjacent tokens left and right of the window are unchanged,
and since a token sequence is the BPE of its text exactly if each adjacent pair is, the result is
that of the whole run. Interior pieces use the same merges without the end-of-word suffix. Leaves
of a run are encoded in one batch; those of texts with a run over ``spread`` characters become rows
of their own, which other tasks encode.

Tokenizers that lower-case, mark word ends and drop white space are looked up chunk by chunk: no
merge, normalisation or added token reaches across ASCII white space there, so only unseen chunks
go to the tokenizers library, or to a tree if they are long. Others, byte-level ones for instance,
are looked up run by run.

Defined results: null and empty texts have no ids and decode to the empty string; special tokens
written in a text become their ids, as the library does by default; repeated rows each keep their
row; an empty table gives an empty result; columns of the input are kept unless they clash with
the output columns, which then win.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ionflow.llm.common import slices

LEAF = 4096
SPREAD = 1 << 16
CACHE_ENTRIES = 500_000  # half as many where decoded texts are kept too
REST_ENTRIES, REST_LENGTH = 50_000, 64  # of the cache, what ``rest`` keeps
_BYTE_LEVEL = {c: "".join(chr(b if b > 0xA0 and b != 0xAD else b + 0xA2 if b < 0xA1 else 0x143) for b in chr(c).encode()) for c in range(0xDF, 0x100)}
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_WORD = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)""")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """One tokenizer file: cached chunk encodings, leaves and joins."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.path = path
        spec = self._spec()
        self.leaf, self.tok = leaf, Tokenizer.from_str(json.dumps(spec))
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.by_chunk = bool(self.suffix) and "Lowercase" in json.dumps(spec["normalizer"])
        if spec["model"]["type"] != "BPE" or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: not a BPE whose added tokens stand for themselves alone")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.words = self._bare({"pre_tokenizer": {"type": "WhitespaceSplit"}})
        self.names = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.ends = np.zeros(max(self.names) + 1, bool)
        if self.suffix:
            self.ends[[i for i, t in self.names.items() if t.endswith(self.suffix)]] = True
        self.gaps = (b"", " ")  # between the ids and the decoded texts of two parts
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.trees: dict[str, int] = {}  # of known chunks and runs that were encoded as trees: how many trees

    def _spec(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f) | {"truncation": None, "padding": None}

    def _bare(self, changes: dict, **model) -> Tokenizer:
        """The model alone, without normalisation, splitting and added tokens."""
        spec = self._spec()
        parts = {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
        return Tokenizer.from_str(json.dumps(spec | parts | changes | {"model": spec["model"] | model}))

    @cached_property
    def last(self) -> Tokenizer:
        """For the last piece of a run."""
        return self._bare({})

    @cached_property
    def inner(self) -> Tokenizer:
        """For pieces that do not end their run."""
        return self._bare({}, end_of_word_suffix=None)

    # Chunks -------------------------------------------------------------------------------
    def _encode_new(self, chunks: set[str], decode: bool) -> tuple[dict[str, bytes], dict[str, str]]:
        """Encodings of unseen chunks.

        Words of plain lower-case letters are what normalisation and splitting leave of them, so they
        go to the model many at a time and are told apart by their last tokens.
        """
        ids: dict[str, bytes] = {}
        words = sorted((c for c in chunks if len(c) <= self.leaf and _LETTERS.fullmatch(c)), key=str.isascii)
        long = [c for c in chunks if len(c) > self.leaf]
        others = list(chunks.difference(words, long))
        batches = [" ".join(words[at : at + 64]) for at in range(0, len(words), 64)]
        spelled = [x if x.isascii() else x.translate(_BYTE_LEVEL) for x in batches]
        flat = np.array([i for e in self.words.encode_batch_fast(spelled, add_special_tokens=False) for i in e.ids], "<i4")
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) == len(words):
            raw, bounds = flat.tobytes(), [0, *(ends * 4).tolist()]
            ids.update(zip(words, [raw[s:e] for s, e in zip(bounds, bounds[1:], strict=False)], strict=True))
        else:
            others += words
        for c, e in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False), strict=True):
            ids[c] = np.array(e.ids, "<i4").tobytes()
        for c in long:
            ids[c], trees = self.encode_text(c)
            if trees and len(self.trees) < CACHE_ENTRIES:
                self.trees[c] = trees
        names = self.names
        return ids, {c: " ".join([names[i] for i in np.frombuffer(x, "<i4").tolist()]) for c, x in ids.items()} if decode else {}

    def _find(self, chunks: list[str], decode: bool) -> tuple[list[bytes], list[str] | None]:
        """Ids and decoded texts of distinct chunks. A word with ASCII punctuation after it is its two parts."""
        kept = (self.ids, self.texts)[: 1 + decode]
        values = [list(map(known.get, chunks)) for known in kept]
        split, need = {}, set()
        for c in [c for c, v in zip(chunks, values[-1], strict=True) if v is None]:
            m = _WORD.fullmatch(c)
            split[c] = parts = (m[1].lower(), m[2]) if m and len(c) <= self.leaf else (c, "")
            need.update(parts)
        need.discard("")
        known_parts = {c for c in need if c in kept[-1]}
        room = max(0, CACHE_ENTRIES // (1 + decode) - len(kept[-1]))
        for k, (known, fresh) in enumerate(zip(kept, self._encode_new(need - known_parts, decode), strict=False)):
            fresh.update((c, known[c]) for c in known_parts)
            fresh[""] = self.gaps[k][:0]
            found = {c: fresh[a] + self.gaps[k] + fresh[b] if b else fresh[a] for c, (a, b) in split.items()}
            values[k] = [found[c] if v is None or c in found else v for c, v in zip(chunks, values[k], strict=True)] if found else values[k]
            known.update(islice(chain(fresh.items(), found.items()), room))
        return values[0], values[1] if decode else None

    def encode_all(self, texts: pa.Array, decode: bool) -> tuple[np.ndarray, np.ndarray, pa.Array | None, np.ndarray]:
        """Ids of all texts in a row, where each text's begin and the last's end, on demand the decoded texts, and the trees of each text.

        Splitting, finding the distinct chunks and gathering run on Arrow and NumPy arrays; only
        distinct chunks become Python strings.
        """
        if not self.by_chunk:
            each = [self.encode_text(t or "") for t in texts.to_pylist()]
            flat = np.frombuffer(b"".join(x for x, _ in each), "<i4")
            ends = np.cumsum([0, *(len(x) // 4 for x, _ in each)])
            out = pa.array([self.decode(flat[s:e].tolist()) for s, e in zip(ends, ends[1:], strict=False)], pa.string()) if decode else None
            return flat, ends, out, np.array([n for _, n in each], np.int64)
        lists = pc.ascii_split_whitespace(texts.fill_null("").combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids, decoded = self._find(coded.dictionary.to_pylist(), decode)
        flat = np.frombuffer(b"".join(ids), "<i4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        here = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(here)])
        at = np.repeat((starts[codes] - ends[:-1]).astype(np.int32), here)  # less than 2^31 bytes of text, so 32 bits do
        at += np.arange(len(at), dtype=np.int32)
        out = None
        if decode:
            some = here > 0
            offsets = np.concatenate([[0], np.cumsum(some)])[bounds]
            pieces = pa.array(decoded, pa.string()).take(pa.array(codes[some]))
            out = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), " ")
        trees = np.zeros(len(ids) + 1, np.int64)
        if self.trees:
            trees[:-1] = [self.trees.get(c, 0) if len(c) > self.leaf else 0 for c in coded.dictionary.to_pylist()]
        return flat[at], ends[bounds], out, np.diff(np.concatenate([[0], np.cumsum(trees[codes])])[bounds])

    def rest(self) -> None:
        """At a task's end, since Spark keeps the worker: of the caches only the first short chunks stay, the common words among them."""
        size = min(REST_LENGTH, self.leaf)
        chunks = dict.fromkeys(islice((c for c in chain(self.texts, self.ids) if len(c) <= size), REST_ENTRIES))
        self.texts = {c: self.texts[c] for c in chunks if c in self.texts}
        self.ids = {c: self.ids[c] for c in chunks}
        self.trees = {}

    # Long runs ------------------------------------------------------------------------------
    def runs(self, text: str) -> Iterator[tuple[int, str]]:
        """(id, "") of the added tokens and (-1, run) of the runs between them, in order."""
        for part in self.added_re.split(text) if self.added_re else [text]:
            if part in self.added:
                yield self.added[part], ""
            elif part:
                part = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for mapped, _ in self.tok.pre_tokenizer.pre_tokenize_str(part) if self.tok.pre_tokenizer else [(part, None)]:
                    yield -1, mapped

    def encode_text(self, text: str) -> tuple[bytes, int]:
        """Ids of a text by its runs, and how many of them were encoded as trees."""
        out, trees = [], 0
        for token, run in self.runs(text):
            if token >= 0:
                out.append(np.array([token], "<i4").tobytes())
                continue
            found = None if self.by_chunk else self.ids.get(run)
            if found is None:
                found = self.tree(run) if len(run) > self.leaf else np.array(self.last.encode(run, add_special_tokens=False).ids, "<i4").tobytes()
                if not self.by_chunk and len(self.ids) < CACHE_ENTRIES:
                    self.ids[run] = found
            trees += len(run) > self.leaf
            out.append(found)
        return b"".join(out), trees

    def tree(self, run: str) -> bytes:
        """Ids of one run: leaves in one batch, then joins."""
        cuts = [run[at : at + self.leaf] for at in range(0, len(run), self.leaf)]
        leaves = [*self.inner.encode_batch(cuts[:-1], add_special_tokens=False), self.last.encode(cuts[-1], add_special_tokens=False)]
        return np.array(self.concatenate([list(x.ids) for x in leaves]), "<i4").tobytes()

    def pieces(self, text: str, size: int) -> Iterator[tuple[int, bool, str | None, bytes | None]]:
        """(run, is the run's last leaf, leaf, None) of the runs over ``size`` characters, cut at that, and (-1, True, None, ids) of what lies between, in order."""
        held: list[bytes] = []
        n = 0
        for token, run in self.runs(text):
            if len(run) <= size:
                held.append(np.array([token] if token >= 0 else self.last.encode(run, add_special_tokens=False).ids, "<i4").tobytes())
                if len(held) < 4096:
                    continue
            if held:
                yield -1, True, None, b"".join(held)
                held = []
            if len(run) > size:
                for at in range(0, len(run), size):
                    yield n, at + size >= len(run), run[at : at + size], None
                n += 1
        if held:
            yield -1, True, None, b"".join(held)

    def encode_piece(self, is_last: bool, piece: str) -> bytes:
        return np.array((self.last if is_last else self.inner).encode(piece, add_special_tokens=False).ids, "<i4").tobytes()

    def _spell(self, ids: list[int]) -> str:
        out = "".join([self.names[i] for i in ids])
        return out[: -len(self.suffix)] if self.suffix and out.endswith(self.suffix) else out

    def join(self, left: list[int], right: list[int], is_last: bool) -> list[int]:
        """Encoding of two neighbouring stretches of one run; ``is_last``: the right one ends it."""
        size = 4
        while left and right:
            i, j = min(size, len(left)), min(size, len(right))
            ends = is_last and j == len(right)
            window = (self.last if ends else self.inner).encode(self._spell(left[-i:]) + (self._spell(right[:j]) if ends else "".join([self.names[x] for x in right[:j]])), add_special_tokens=False).ids
            if (i == len(left) or window[0] == left[-i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:-i] + window + right[j:]
            size *= 2
        return left + right

    def concatenate(self, leaves: list[list[int]]) -> list[int]:
        """Join the leaves of one run pairwise, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[i], leaves[i + 1], i + 2 >= len(leaves)) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def assemble(self, rows: list[tuple[int, int, bytes]]) -> list[int]:
        """Ids of a text from its (piece number, run, ids)."""
        out: list[int] = []
        held: list[list[int]] = []
        before = -1
        for _, run, ids in [*sorted(rows), (0, -2, b"")]:
            if run != before and held:
                out += self.concatenate(held)
                held = []
            (held.append if run >= 0 else out.extend)(np.frombuffer(ids, "<i4").tolist())
            before = run
        return out

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=4)
def load(name: str, leaf: int = LEAF) -> Bpe:
    """The tokenizer of this process; ``name`` is a public file's name or a path."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
    return Bpe(name if "/" in name else tokenizer_path(name), leaf)


def round_trip(docs: DataFrame, tokenizer: str, leaf: int = LEAF, spread: int = SPREAD, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int>, ``decoded`` string and ``trees`` int (runs encoded as trees) in place of the text."""
    keep = [c for c in docs.columns if c.lower() not in (text_col.lower(), "ids", "decoded", "trees")]
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("decoded"))
    # The length is looked at first: hardly any text is searched.
    long_run = (F.coalesce(F.length("decoded"), F.lit(0)) > spread) & F.coalesce(F.col("decoded"), F.lit("")).rlike(rf"\S{{{spread + 1},}}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "ids array<int>, decoded string, trees int"])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer, leaf)
        for b in batches:
            for at, end in slices(b.column(b.num_columns - 1)):
                part = b.slice(at, end - at)
                ids, bounds, decoded, trees = bpe.encode_all(part.column(part.num_columns - 1), True)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, decoded, pa.array(trees, pa.int32())], [*keep, "ids", "decoded", "trees"])

    size = max(leaf, spread // 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer, leaf)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = enumerate(bpe.pieces(text, size))
                while part := list(islice(p, 256)):
                    no, found = zip(*part, strict=True)
                    columns = [pa.array([key] * len(part)), pa.array(no, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.bool_(), pa.string(), pa.binary()), strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "no", "run", "is_last", "piece", "ids"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer, leaf)
        for b in batches:
            ids = [x if x is not None else bpe.encode_piece(last, piece) for last, piece, x in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())], ["key", "no", "run", "ids"])

    def assemble(t: pa.Table) -> pa.Table:
        bpe = load(tokenizer, leaf)
        ids = bpe.assemble(list(zip(*(t.column(c).to_pylist() for c in ("no", "run", "ids")), strict=True)))
        trees = len({r for r in t.column("run").to_pylist() if r >= 0})
        return pa.table({"key": [t.column("key")[0].as_py()], "ids": pa.array([ids], pa.list_(pa.int32())), "decoded": [bpe.decode(ids)], "trees": pa.array([trees], pa.int32())})

    whole = rows.where(~long_run).mapInArrow(direct, schema)
    long_rows = rows.where(long_run).withColumn("ids", F.sha2("decoded", 256))
    leaves = long_rows.select(F.col("ids").alias("key"), "decoded").dropDuplicates(["key"]).mapInArrow(cut, "key string, no long, run long, is_last boolean, piece string, ids binary")
    done = leaves.repartition("key", "no").mapInArrow(encode, "key string, no long, run long, ids binary").groupBy("key").applyInArrow(assemble, "key string, ids array<int>, decoded string, trees int")
    joined = long_rows.alias("l").join(done.alias("r"), F.col("l.ids") == F.col("r.key")).select(*[F.col(f"l.`{c}`") for c in keep], "r.ids", "r.decoded", "r.trees")
    return whole.union(joined)
