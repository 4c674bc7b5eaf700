"""Host-level quality rules, with DataFrame functions only.

Each document is measured once (words, symbols, repeated lines, repeated word windows). Rule
failures are summed per host; the host's failure rate of each rule is shrunk towards the corpus
with a beta prior whose mean and strength are estimated from all hosts (method of moments):

    mean m = F / N,  s = sum(f^2 / n) / N - m^2,  v = max(s - m (1 - m) (K - 1) / N, 1e-9)
    strength = max(m (1 - m) / v - 1, 1),  shrunk rate = (f + m * strength) / (n + strength)

Verdicts go back to the documents: a host whose shrunk rate of base failures exceeds ``block_rate``
is blocked; a document that fails a soft rule (symbols, repeated lines) is dropped unless its
host's shrunk rate of that rule stays under ``trust_rate``, where a single failure is noise.

Defined results: null text has no words (and so fails the length rule); null hosts form one host
of their own; a source that is a URL counts under its lower-cased authority; repeated rows count
as often as they occur and get the same verdict; an empty table gives an empty result; columns
of the input that clash with a computed name keep their place in ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionflow.llm.common import free_name, let, materialise

SALT = 16


#: Bits of a marked hash that hold the position of a window; longer texts have every window compared as words.
PLACE = 24


def _again(windows: Column) -> Column:
    """Places of an array of (words, place) that is sorted whose words an entry next to it has too."""
    m = F.size(windows)
    return F.transform(F.filter(windows, lambda x, j: ((j > 0) & (x["g"] == windows[F.greatest(j - 1, F.lit(0))]["g"])) | ((j < m - 1) & (x["g"] == windows[F.least(j + 1, m - 1)]["g"]))), lambda x: x["p"])


def repeated_words(words: Column) -> Column:
    """Positions of an array of words, bound before, that lie in a three-word window found twice or more.

    Windows are told apart by hashes, as longs; texts without two equal ones end there. Else hashes
    are sorted with their place in the lowest bits, and only windows whose upper bits meet others are
    compared as words.
    """
    n = F.size(words)
    all_places = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    hashes = F.transform(all_places, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    upper = lambda x: F.shiftright(x, PLACE)

    def meeting(marked: Column) -> Column:
        """Places whose upper bits an entry next to them shares."""
        m = F.size(marked)
        near = F.filter(marked, lambda x, j: ((j > 0) & (upper(x) == upper(marked[F.greatest(j - 1, F.lit(0))]))) | ((j < m - 1) & (upper(x) == upper(marked[F.least(j + 1, m - 1)]))))
        return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))

    def counted(places: Column) -> Column:
        grams = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("g"), i.alias("p"))))
        starts = let(grams, _again)
        return let(starts, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

    def of(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("long"))))
        places = F.when(n - 2 > (1 << PLACE), all_places).otherwise(let(marked, meeting))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, counted))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, of))


def measures(text: Column) -> Column:
    """Struct of the counts of one text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words,
        lambda w: let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
            ),
        ),
    )


def host_of(source: Column) -> Column:
    s = source.cast("string")
    authority = F.lower(F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(s.isNull(), F.lit("null")).when(authority != "", F.concat(F.lit("="), authority)).otherwise(F.concat(F.lit("="), s))


#: Rule name: whether a document with the measures ``c`` fails it.
RULES = {
    "base": lambda c: (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")),
    "symbols": lambda c: 10 * c("n_symbols") > c("n_words"),
    "lines": lambda c: 10 * c("n_dup_lines") > 9 * c("n_lines"),
}


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    m = docs.select(F.col(id_col).alias("doc_id"), host_of(F.col(source_col)).alias("host"), measures(F.col(text_col)).alias("m"))
    m = m.select("doc_id", "host", "m.*")
    return m.select("*", *[fails(F.col).alias(f"{rule}_failed") for rule, fails in RULES.items()])


def host_verdicts(marks: DataFrame, block_rate: float = 0.5, trust_rate: float = 0.01) -> DataFrame:
    """One row per host: documents, failures and shrunk rate per rule, and the verdicts."""
    hosts = marks.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_failures") for r in RULES])
    hosts = materialise(hosts, "hosts")
    prior = hosts.agg(
        F.sum("host_docs").alias("N"),
        F.count(F.lit(1)).alias("K"),
        *[F.sum(f"{r}_failures").alias(f"F_{r}") for r in RULES],
        *[F.sum(F.col(f"{r}_failures") * F.col(f"{r}_failures") / F.col("host_docs")).alias(f"Q_{r}") for r in RULES],
    ).first()
    total, count = prior["N"] or 1, prior["K"]
    for r in RULES:
        mean = (prior[f"F_{r}"] or 0) / total
        spread = (prior[f"Q_{r}"] or 0.0) / total - mean * mean
        between = max(spread - mean * (1 - mean) * (count - 1) / total, 1e-9)
        strength = max(mean * (1 - mean) / between - 1, 1.0)
        hosts = hosts.withColumn(f"{r}_rate", (F.col(f"{r}_failures") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength)))
    return hosts.select("*", (F.col("base_rate") > block_rate).alias("host_blocked"), *[(F.col(f"{r}_rate") >= trust_rate).alias(f"{r}_counts") for r in RULES if r != "base"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rate: float = 0.5, trust_rate: float = 0.01) -> DataFrame:
    """Per document: its measures, the failures and verdict of its host, and ``kept``."""
    marks = materialise(measured(docs, id_col, text_col, source_col), "quality")
    verdicts = host_verdicts(marks, block_rate, trust_rate)
    salted = verdicts.select("host", "host_docs", "base_failures", "host_blocked", "symbols_counts", "lines_counts", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    out = marks.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"])
    soft = (F.col("symbols_failed") & F.col("symbols_counts")) | (F.col("lines_failed") & F.col("lines_counts"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_blocked") & ~soft).alias("kept"),
        "host_docs", "base_failures", "host_blocked",
    )


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rate: float = 0.5, trust_rate: float = 0.01, held: list[str] | None = None) -> DataFrame:
    """The documents that pass, with exactly their own columns.

    Each text is measured once: the documents are written with their host and their failures, as a
    set of bits, and what each host holds against its documents, another set, is joined by host.
    The path of what was written is added to ``held``; it may be dropped once the result is stored.
    """
    host, salt, failed, counts = (free_name(docs, k) for k in ("host", "salt", "failed", "counts"))
    bit = lambda c, n: F.when(c, 1 << n).otherwise(0)
    order = {"base": 0, "symbols": 1, "lines": 2}

    def bits(m: Column) -> Column:
        fails = {r: test(lambda name: m[name]) for r, test in RULES.items()}
        return F.lit(1 << 3) + bit(fails["base"], 0) + bit(fails["symbols"], 1) + bit(fails["lines"], 2)

    spread = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SALT)).cast("int")
    rows = materialise(docs.withColumns({host: host_of(F.col(source_col)), salt: spread, failed: F.coalesce(let(measures(F.col(text_col)), bits), F.lit(0))}), "quality", held)
    marks = rows.select(F.col(host).alias("host"), *[(F.col(failed).bitwiseAND(F.lit(1 << order[r])) > 0).alias(f"{r}_failed") for r in RULES])
    verdicts = host_verdicts(marks, block_rate, trust_rate)
    against = F.lit(1) + bit(F.col("symbols_counts"), 1) + bit(F.col("lines_counts"), 2) + bit(F.col("host_blocked"), 3)
    hosts = verdicts.select(F.col("host").alias(host), against.alias(counts), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(salt))
    return rows.join(hosts, [host, salt]).where(F.col(failed).bitwiseAND(F.col(counts)) == 0).select(docs.columns)
