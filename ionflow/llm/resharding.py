"""Minimum-cost-flow resharding.

The rows of a Parquet dataset lie in files, the old shards; each stays in one new shard at no cost
for what fits there. Which one is chosen from the largest file on, where most room is left, and
then by single moves and exchanges of files for as long as fewer bytes are over (``homes``). From the
bytes that each new shard holds so and the new capacities a minimum-cost flow gives the transfers that
move the fewest bytes: a byte that stays is free and one that moves costs one, or what a cost matrix says.
It is solved by successive shortest paths; over ``FLOW`` shards without a cost matrix, where any way for
surpluses to meet deficits is as cheap, in linear time.

Transfers are cut from the ends of a shard's files as blocks of consecutive rows, so the whole
plan is a short list of slices (file, first row, last row, new shard): one per file and two per
transfer. A row's place follows from its file and row number alone: no row is shuffled to learn
its shard or its slot. Row sizes are summed per block of ``block_rows`` rows; single rows are
looked at only in the blocks that a cut falls into. ``rewrite`` writes the shards anew that gain
or lose rows and leaves the files of the others alone; ``read_back`` reads both.

Law: ``bytes`` - shard sizes are equal to within one row at each cut.

Defined results: a null text has size 1 (its bytes, none, plus 1); repeated rows, null ids and
ties are rows like others; an empty table gives an empty plan and result; files without rows are
skipped; a column of the input that is called ``shard`` is rejected by ``rewrite``, since the
output is partitioned by that name; others that clash are kept.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionflow.llm.common import materialise

SLICE = "file string, lo long, hi long, shard int, base long, home int"


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]] | None = None) -> dict[tuple[int, int], int]:
    """Amounts (source, sink) -> bytes that meet ``demand`` from ``supply`` at the least cost; sums must agree.

    Successive shortest augmenting paths over the residual network, whole-number amounts.
    """
    m, n = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    cost = cost or [[0 if i == j else 1 for j in range(n)] for i in range(m)]
    flow: dict[tuple[int, int], int] = {}
    left, need = list(supply), list(demand)
    far = float("inf")
    while any(left):
        # Nodes: sources 0..m-1, sinks m..m+n-1.
        dist = [0 if x else far for x in left] + [far] * n
        back: list[int | None] = [None] * (m + n)
        queue, queued = deque(i for i in range(m) if left[i]), [bool(x) for x in left] + [False] * n
        while queue:
            u = queue.popleft()
            queued[u] = False
            steps = ((m + j, cost[u][j]) for j in range(n)) if u < m else ((i, -cost[i][u - m]) for i in range(m) if flow.get((i, u - m)))
            for v, c in steps:
                if dist[u] + c < dist[v]:
                    dist[v], back[v] = dist[u] + c, u
                    if not queued[v]:
                        queue.append(v)
                        queued[v] = True
        sink = min((m + j for j in range(n) if need[j]), key=lambda v: dist[v])
        path, v = [], sink
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        amount = min(left[v], need[sink - m], *(flow[b, a - m] for a, b in path if a >= m))
        for a, b in path:
            if a < m:
                flow[a, b - m] = flow.get((a, b - m), 0) + amount
            else:
                flow[b, a - m] -= amount
        left[v] -= amount
        need[sink - m] -= amount
    return {k: x for k, x in flow.items() if x}


def fewest_bytes(held: list[int], wanted: list[int]) -> dict[tuple[int, int], int]:
    """The minimum-cost flow where staying is free and every move costs one: what can stays, and surpluses meet deficits in order."""
    if sum(held) != sum(wanted):
        raise ValueError("supply and demand differ")
    flow = {(s, s): min(a, b) for s, (a, b) in enumerate(zip(held, wanted, strict=True)) if min(a, b)}
    over, under = (deque((s, x) for s, x in enumerate(d) if x > 0) for d in ([a - b for a, b in zip(held, wanted, strict=True)], [b - a for a, b in zip(held, wanted, strict=True)]))
    while over:
        (s, x), (t, y) = over.popleft(), under.popleft()
        flow[s, t] = min(x, y)
        if x > y:
            over.appendleft((s, x - y))
        elif y > x:
            under.appendleft((t, y - x))
    return flow


#: Most shards for which plain costs go through the flow's shortest paths.
FLOW = 64


def moved_bytes(held: list[int], wanted: list[int]) -> int:
    """Bytes that have to leave their shard."""
    return sum(max(0, a - b) for a, b in zip(held, wanted, strict=True))


def homes(sizes: list[int], wanted: list[int], rounds: int = 20, search: int = 256) -> list[int]:
    """The shard that each file stays in, so that few bytes are over: the largest file first, each to the shard with most room; then moves and exchanges that leave fewer over.

    Files are compared with one another up to ``search`` of them, the largest ones; beyond that
    small files fill the gaps well enough by themselves.
    """
    shards, held, home = len(wanted), [0] * len(wanted), [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for i in order:
        home[i] = max(range(shards), key=lambda s: (wanted[s] - held[s], -s))
        held[home[i]] += sizes[i]
    over = lambda s, x: max(0, x - wanted[s])
    head = order[:search]
    for _ in range(rounds):
        better = False
        for i in head:
            a = home[i]
            if held[a] <= wanted[a]:
                continue
            steps = [(over(a, held[a] - sizes[i]) + over(b, held[b] + sizes[i]) - over(a, held[a]) - over(b, held[b]), b, None) for b in range(shards) if b != a]
            steps += [(over(a, held[a] - sizes[i] + sizes[j]) + over(home[j], held[home[j]] + sizes[i] - sizes[j]) - over(a, held[a]) - over(home[j], held[home[j]]), home[j], j) for j in head if home[j] != a and sizes[j] < sizes[i]]
            gain, b, j = min(steps, key=lambda x: (x[0], x[1]), default=(0, 0, None))
            if gain < 0:
                home[i], better = b, True
                held[a], held[b] = held[a] - sizes[i], held[b] + sizes[i]
                if j is not None:
                    home[j] = a
                    held[a], held[b] = held[a] + sizes[j], held[b] - sizes[j]
        if not better:
            break
    return home


def place() -> list[Column]:
    """A row's file and its number in it."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def _wanted(total: int, shards: int, capacities: list[float] | None) -> list[int]:
    weights = capacities or [1.0] * shards
    bounds = [round(total * sum(weights[: s + 1]) / sum(weights)) for s in range(shards)]
    return [b - a for a, b in zip([0, *bounds], bounds, strict=False)]


def _cuts(files: list[tuple[str, int]], home: dict[str, int], flow: dict[tuple[int, int], int], shards: int) -> list[tuple[str, int, int]]:
    """(file, byte in it, shard): from that byte on the file's rows go to the shard, up to the next cut.

    The files of a shard follow one another; the share that stays comes first, then the transfers.
    """
    out, of = [], [[] for _ in range(shards)]
    for name, size in files:
        of[home[name]].append((name, size))
    for s in range(shards):
        edges, at = [], 0
        for t in [s, *(t for t in range(shards) if t != s)]:
            if flow.get((s, t)):
                edges.append((at, at + flow[s, t], t))
                at += flow[s, t]
        offset = 0
        for name, size in of[s]:
            out += [(name, max(0, a - offset), t) for a, b, t in edges if a < offset + size and b > offset]
            offset += size
    return out


def plan(spark: SparkSession, path: str, shards: int = 16, capacities: list[float] | None = None, cost: list[list[int]] | None = None, text_col: str = "text", block_rows: int = 1024) -> DataFrame:
    """Slices: rows ``lo`` to ``hi`` (exclusive) of ``file`` go to ``shard``, row ``lo`` to its slot ``base``; ``home`` is where they were."""
    rows = spark.read.parquet(path).select(*place(), size_of(F.col(text_col)).alias("size")).withColumn("block", F.floor(F.col("row") / F.lit(block_rows)).cast("long"))
    blocks = materialise(rows.groupBy("file", "block").agg(F.sum("size").alias("bytes"), (F.max("row") + 1).alias("end")), "blocks")
    listed = [tuple(r) for r in blocks.groupBy("file").agg(F.sum("bytes"), F.max("end")).orderBy("file").toLocalIterator()]  # one row per file
    files, ends = [(f, b) for f, b, _ in listed], {f: n for f, _, n in listed}
    wanted = _wanted(sum(b for _, b in files), shards, capacities)
    home = dict(zip((f for f, _ in files), homes([b for _, b in files], wanted), strict=True))
    held = [0] * shards
    for f, b in files:
        held[home[f]] += b
    flow = min_cost_flow(held, wanted, cost) if cost or shards <= FLOW else fewest_bytes(held, wanted)
    cuts = _cuts(files, home, flow, shards)

    # Bytes to row numbers: of the row that a cut falls into, the nearer end.
    asked = F.broadcast(spark.createDataFrame([(f, a) for f, a, _ in cuts if a], "file string, at long"))  # fewer than files and transfers
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    hit = begun.join(asked, "file").where("at >= before AND at < before + bytes").select("file", "block", "before", "at")
    reached = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("file", "at").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = rows.join(F.broadcast(hit), ["file", "block"]).withColumn("reached", reached).where("reached <= at AND at < reached + size")
    row_of = {(r["file"], r["at"]): r["row"] + (2 * (r["at"] - r["reached"]) > r["size"]) for r in inner.toLocalIterator()}

    begins: dict[str, list[tuple[int, int]]] = {}
    for f, a, t in cuts:
        begins.setdefault(f, []).append((row_of[f, a] if a else 0, t))
    out, base = [], [0] * shards
    for f, parts in begins.items():
        for (lo, t), (hi, _) in zip(parts, [*parts[1:], (ends[f], -1)], strict=True):
            if hi > lo:
                out.append((f, lo, hi, t, base[t], home[f]))
                base[t] += hi - lo
    return spark.createDataFrame(out, SLICE)


def _placed(spark: SparkSession, path: str, slices: DataFrame, *columns: Column | str) -> DataFrame:
    rows = spark.read.parquet(path).select(*columns, *place())
    return rows.join(slices, "file").where("row >= lo AND row < hi")


def assign(spark: SparkSession, path: str, slices: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = _placed(spark, path, slices, F.col(id_col).cast("long").alias("doc_id"), size_of(F.col(text_col)).alias("size"), F.crc32(text).alias("text_crc32"))
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("row") - F.col("lo")).alias("slot"))


def rewrite(spark: SparkSession, path: str, slices: DataFrame, out: str) -> set[int]:
    """Write the shards that gain or lose rows to ``out``/shard=k, with the columns of the input; return them.

    Rows go straight from their file to their shard, without a shuffle. The files of all other
    shards stay as they are.
    """
    moved = slices.where("shard <> home").select(F.explode(F.array("shard", "home")).alias("s")).distinct()
    affected = {r["s"] for r in moved.toLocalIterator()}  # at most as many as shards
    own = spark.read.parquet(path).columns
    packed = F.struct(*[F.col(f"`{c}`") for c in own]).alias("own")
    rows = _placed(spark, path, slices, packed).where(F.col("shard").isin(sorted(affected)))
    if "shard" in own:
        raise ValueError("the input has a column shard; the output is partitioned by that name")
    rows.select("own.*", "shard").write.partitionBy("shard").parquet(out)
    return affected


def read_back(spark: SparkSession, path: str, slices: DataFrame, out: str, affected: set[int], columns: list[str]) -> DataFrame:
    """``columns``, shard and slot of every row, from the rewritten shards and the files that were left alone.

    A row's slot is the rows of its shard's earlier files and its own number in its file.
    """
    slices = slices.where(~F.col("shard").isin(sorted(affected)))
    kept = _placed(spark, path, slices, *columns).select(*columns, "shard", (F.col("base") + F.col("row") - F.col("lo")).alias("slot"))
    if not affected:
        return kept
    rows = spark.read.parquet(out).select(*columns, "shard", *place())
    counts = rows.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # A row per written file; written, so that its size is known to the planner.
    bases = materialise(counts.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    return rows.join(bases, ["shard", "file"]).select(*columns, "shard", (F.col("base") + F.col("row")).alias("slot")).union(kept)
