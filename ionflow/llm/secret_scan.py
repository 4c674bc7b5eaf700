"""Secret scan: base patterns, and values in credential contexts weighed by their guess cost.

The cost of a value is the least number of guesses over all ways to cut it into words, dates,
repeats, keyboard walks and brute-force spans (dynamic programming over end positions; the cost of
a cut is the product of its parts' costs times the factorial of their number). Words are a fixed
list of common passwords and the frequent words of the corpus itself, by rank. A repeat is a unit
of any length that follows itself, as often as it does, and costs what its unit costs times the
count; a walk goes as far as the keyboard does. Values that an attacker would find within
``min_log10`` decimal orders of guesses are placeholders or trivia and add no span; dearer ones do,
as kind ``guess``. Base spans always stay.

After "is" or "bearer" the text may just go on: there, bare lower-case letters are a value from
``PROSE_LOG10`` orders on only. After ``:`` and ``=`` the cost alone decides.

Values of any length are costed as a whole. Partial cuts dearer than 10^``CEILING`` guesses are
given up, so a long random value is settled by its first characters; all costs from there on are
reported as ``CEILING``, and no verdict depends on it since ``min_log10`` must be lower.

Spans are code point positions, end exclusive; their kinds are ordered assign, access, hex, guess.

Defined results: null and empty texts have no spans; whole texts of any length are scanned;
repeated rows each get their row; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionflow.llm.common import materialise, slices

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 8.0
PROSE_LOG10 = 16.0
CEILING = 40.0
WORD_SHARE = 20_000  # a corpus word ranks if it is at least one in so many; hence there are no more than that

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_LONG = re.compile(r"[0-9a-f]{32}")
#: A credential word, then a separator or (group 1) "is", then the value up to white space or a quote (groups 2 to 4).
_CONTEXT = re.compile(
    r"""(?i:(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|auth|login|pin|(?:api|access|private|secret|auth)[_-]?key|bearer))["']?(?:[ \t]{0,3}(?:[:=]|=>)[ \t]{0,3}|([ \t]{1,3}(?i:is)[ \t]{1,3}|(?<=(?i:bearer))[ \t]{1,3}))(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"',;]{6,}))""",
    re.ASCII,
)

# What Arrow looks for in a whole batch of texts at once. Each pattern covers all that those above find, so the texts
# it doesn't match need no look of their own: base spans, and credential contexts.
BASE_CUE = r"""AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
CONTEXT_CUE = r"""(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|auth|login|pin|key|bearer)["']?[ \t]{0,3}(?:[:=]|(?i:is)[ \t])|(?i:bearer)[ \t]"""

# The commonest passwords and words in them, most common first.
COMMON = """password 123456 qwerty secret letmein welcome admin login master dragon monkey shadow sunshine
princess football baseball iloveyou trustno abc pass test guest root user hello freedom whatever
computer internet love money summer winter spring autumn flower pepper orange banana cookie
changeme default example sample dummy placeholder token key value string null none true false
company server database production staging development access account email phone name world
correct horse battery staple apple google house water light green black white blue red
january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday""".split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "azertyuiop", "yxcvbnm")
LEET = str.maketrans("@4301$57!", "aaeoissti")


def _neighbours() -> set[str]:
    """Pairs of characters that follow each other on a key row or in a column, both ways."""
    pairs = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:], strict=False)}
    pairs |= {a + b for up, down in zip(KEY_ROWS, KEY_ROWS[1:4], strict=False) for a, b in zip(up, down, strict=False)}
    return pairs | {p[::-1] for p in pairs}


NEXT = _neighbours()
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(s: str) -> int:
    size = 10 * any(c.isdigit() for c in s) + 26 * any("a" <= c <= "z" for c in s) + 26 * any("A" <= c <= "Z" for c in s)
    return size + 33 * any(not c.isalnum() for c in s) + 100 * any(c.isalnum() and ord(c) > 127 for c in s)


def repeats(v: str, i: int) -> Iterator[tuple[int, int]]:
    """(unit's length, end) of the repeats that start at ``i``: as many whole units as follow, of every unit that is none itself."""
    n, p = len(v), 1
    while i + 2 * p <= n:
        at = v.find(v[i : i + min(p, 16)], i + p)
        p = at - i
        if at < 0 or i + 2 * p > n:
            return
        unit = v[i:at]
        if v.startswith(unit, at):
            end = at + p
            while v.startswith(unit, end):
                end += p
            yield p, end
            # Up to here the text has period p: shorter units that start here would be repeats themselves.
            p = max(p + 1, end + len(os.path.commonprefix([unit, v[end : end + p]])) - i - p + 1)
        else:
            p += 1


def _log_factorial(m: int) -> float:
    return math.lgamma(m + 1) / math.log(10)


def _cheapest(states: dict[int, float]) -> dict[int, float]:
    """Of (number of parts -> cost) those that can still win: whatever follows, more parts must pay for their factorial now."""
    low, kept = CEILING, {}
    for m in sorted(states):
        total = states[m] + _log_factorial(m)
        if total < low - 1e-12:
            low, kept[m] = total, states[m]
    return kept


class Guesser:
    """Guess costs, with the fixed words and ``words`` after them by rank."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        self.rank: dict[str, int] = {}
        for w in [*COMMON, *words]:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self._short = lru_cache(maxsize=4096)(self._whole)

    def parts(self, v: str, i: int, memo: dict[str, float]) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses) of the parts at ``i`` that an attacker would try before brute force."""
        n = len(v)
        low = v[i : i + self.longest].lower()
        plain = low.translate(LEET)
        if len(low) == min(n - i, self.longest):  # lower-casing kept all positions
            for k in range(3, len(low) + 1):
                rank = self.rank.get(low[:k]) or 2 * self.rank.get(plain[:k], 0)
                if rank:
                    upper = sum(c.isupper() for c in v[i : i + k])
                    yield i + k, math.log10(rank * (1 if not upper else 2 if upper in (1, k) else 2 ** min(upper, k - upper) + 1))
        m = _DATE.match(v, i)
        if m:
            yield m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120)
        k = i + 1
        while k < n and v[k - 1 : k + 1].lower() in NEXT:
            k += 1
        if k - i >= 3:
            yield k, math.log10(80 * (k - i))
        for p, end in repeats(v, i):
            if end - i >= 3:
                yield end, self.cost(v[i : i + p], memo) + math.log10((end - i) // p)

    def cost(self, v: str, memo: dict[str, float]) -> float:
        if v not in memo:
            memo[v] = self._search(v, memo)
        return memo[v]

    def _search(self, v: str, memo: dict[str, float]) -> float:
        """States are numbers of parts with their least cost; ``opened`` are those inside a brute-force span, which is counted already."""
        n, size = len(v), math.log10(max(10, _alphabet(v)))
        closed: dict[int, dict[int, float]] = {0: {0: 0.0}}
        opened: dict[int, float] = {}
        j = 0
        while True:
            here = closed.pop(j, {})
            for m, c in opened.items():
                here[m] = min(c, here.get(m, math.inf))
            here = _cheapest(here)
            if j == n:
                return min((c + _log_factorial(m) for m, c in here.items()), default=CEILING)
            if here:
                for end, c in self.parts(v, j, memo):
                    states = closed.setdefault(end, {})
                    for m, b in here.items():
                        if b + c + _log_factorial(m + 1) < CEILING:
                            states[m + 1] = min(b + c, states.get(m + 1, math.inf))
            longer = {m: c + size for m, c in opened.items()}
            for m, c in here.items():
                longer[m + 1] = min(c + size, longer.get(m + 1, math.inf))
            opened = _cheapest(longer)
            if not opened and not closed:
                return CEILING
            j = j + 1 if opened else min(closed)

    def _whole(self, value: str) -> float:
        return self.cost(value, {}) if value else 0.0

    def __call__(self, value: str) -> float:
        """log10 of the least number of guesses for ``value``, ``CEILING`` at most."""
        return self._short(value) if len(value) <= 64 else self._whole(value)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns."""
    out = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    at = _HEX_LONG.search(text)
    if at:
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, at.start()) if len(m[0]) >= 32]
    return out


def guess_spans(text: str, guess: Guesser, min_log10: float = MIN_LOG10) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of the values in credential contexts that are dear to guess."""
    out = []
    for m in _CONTEXT.finditer(text):
        g = m.lastindex
        value = m[g].rstrip(".,;:!?)]}>") if g == 4 else m[g]
        prose = m[1] and g == 4 and value.isalpha() and value == value.lower()
        if len(value) >= 6:
            cost = guess(value)
            if cost >= (max(min_log10, PROSE_LOG10) if prose else min_log10):
                out.append((m.start(g), m.start(g) + len(value), "guess", cost))
    return out


def frequent_words(docs: DataFrame, text_col: str = "text", share: int = WORD_SHARE) -> list[str]:
    """Words of 3 to 24 letters, most frequent first, each at least one in ``share`` of all such words of the texts.

    Hence there are at most ``share`` of them, however many rows there are. Values in credential
    contexts are not counted: a secret that is copied often doesn't become a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in slices(b.column(0)):
                texts = b.column(0).slice(at, end - at).drop_null()
                cue = pc.match_substring_regex(texts, CONTEXT_CUE)
                cut = pa.array([_CONTEXT.sub(" ", t) for t in texts.filter(cue).to_pylist()], texts.type)
                texts = pa.concat_arrays([texts.filter(pc.invert(cue)), cut])
                counted = pc.ascii_split_whitespace(pc.utf8_lower(texts)).flatten().value_counts()
                words = pc.utf8_trim(counted.field("values"), characters=".,;:!?\"'()")
                letters = pc.utf8_length(words)
                good = pc.and_(pc.and_(pc.greater_equal(letters, 3), pc.less_equal(letters, 24)), pc.invert(pc.match_substring_regex(words, r"\P{L}")))
                yield pa.RecordBatch.from_arrays([words.filter(good), counted.field("counts").filter(good)], ["word", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    counts = materialise(found.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") * share >= total).collect()  # at most ``share`` rows
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"]))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = MIN_LOG10, words: list[str] | None = None) -> DataFrame:
    """(doc_id, spans): per document its spans in order, with kind, start, end, the text there and log10 guesses (null for base kinds).

    ``words`` are ranked after the fixed ones; by default those that are frequent in ``docs``.
    """
    if min_log10 >= CEILING:
        raise ValueError(f"min_log10 must be less than {CEILING}")
    kind = "array<struct<kind:string,start:int,end:int,value:string,guesses:double>>"
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("guesses", pa.float64())]))
    words = frequent_words(docs, text_col) if words is None else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Guesser(words)
        for b in batches:
            found = []
            cues = [pc.match_substring_regex(b.column(1), cue).to_pylist() for cue in (BASE_CUE, CONTEXT_CUE)]
            for text, base, context in zip(b.column(1), *cues, strict=True):
                if not (base or context):
                    found.append([])
                    continue
                text = text.as_py()
                spans = [(s, e, k, None) for s, e, k in base_spans(text)] if base else []
                spans += guess_spans(text, guess, min_log10) if context else []
                spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                found.append([{"kind": k, "start": s, "end": e, "value": text[s:e], "guesses": g} for s, e, k, g in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {kind}")


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end, comma-joined, by start and then kind."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(joined(base_spans(text or "")).encode()).hexdigest()
