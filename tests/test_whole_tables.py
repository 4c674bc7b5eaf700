"""Queries over whole tables against brute force."""

import datetime
import random
from collections import defaultdict

from ionflow import catalog


def brute_nearest(events, marks):
    return {(m, t, min((abs(at - m), at, i) for i, u, at in events if u == t)[2]) for m in marks for t in {u for _, u, _ in events}}


def test_eic_and_collisions_of_all_parts(spark, tmp_path):
    rng = random.Random(3)
    parts = [(i, rng.randrange(1, 4), round(rng.uniform(900, 1100), 2)) for i in [*range(190, 230), *range(1980, 2040)]]
    lines = [(round(q * rng.uniform(800, 1200), 2), float(q), datetime.date(1995, rng.randrange(1, 13), 3) if rng.random() > 0.05 else None) for q in (rng.randrange(1, 50) for _ in range(400))]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_extendedprice double, l_quantity double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = defaultdict(int)
    for key, _, price in parts:
        for total, q, day in lines:
            if price * (1 - 0.05) <= total / q <= price * (1 + 0.05):
                want[key, day and day.month] += int(q)
    assert {(r.p_partkey, r.rt): r.intensity for r in catalog.QUERIES["eic_sum"](spark, str(tmp_path)).collect()} == want
    near = defaultdict(lambda: [0, 0])
    for a, size, x in parts:
        for b, other, y in parts:
            if a < b and size == other and abs(x - y) <= 10.0:
                near[size][0] += abs(x - y) <= 5.0
                near[size][1] += 1
    assert {r.p_size: [r.within_5, r.within_10] for r in catalog.QUERIES["collision_band"](spark, str(tmp_path)).collect()} == near


def test_nearest_of_all_hours(spark, tmp_path):
    rng = random.Random(4)
    start, days = datetime.datetime(2024, 1, 1, 5, 20), 14
    rows = [(i, rng.choice(["dense", "dense", "dense", "sparse"][: 3 + (i % 9 == 0)]), start + datetime.timedelta(seconds=rng.randrange(0, days * 86400, 1800))) for i in range(150)]
    rows += [(150 + i, t, at) for i, (_, t, at) in enumerate(rows[:20])]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    events = [(i, t, int(at.replace(tzinfo=datetime.UTC).timestamp())) for i, t, at in rows]
    first, last = (f(at for _, _, at in events) // 3600 * 3600 for f in (min, max))
    marks = range(first, last + 1, 3600)
    found = catalog.QUERIES["nearest_asof"](spark, str(tmp_path)).collect()
    assert len(marks) > 240 and len(found) == 2 * len(marks)
    assert {(r.mark, r.event_type, r.event_id) for r in found} == brute_nearest(events, marks)


def test_collisions_of_crowded_sizes(spark, tmp_path):
    """Shared keys, missing and odd values, differences that round to the band; 3.2 billion pairs of one size are counted, none is formed."""
    rng = random.Random(7)
    rows = [(rng.randrange(120), rng.choice([1, 2, None]), rng.choice([900 + rng.randrange(300) / 10, 905.0, None, float("nan"), float("inf")])) for _ in range(400)]
    rows += [(200, 4, -1e-17), (201, 4, 10.0), (202, 5, 0.0), (203, 5, 10.000000000000002), (204, 6, 900.1), (204, 6, 900.1), (None, 6, 900.1), (205, 7, -10.0), (206, 7, 4e-16), (207, 7, -0.0)]
    near = defaultdict(lambda: [0, 0])
    for a, size, x in rows:
        for b, other, y in rows:
            if None not in (a, b, size, x, y) and a < b and size == other and abs(x - y) <= 10.0:
                near[size][0] += abs(x - y) <= 5.0
                near[size][1] += 1
    assert near[4] == [0, 1] and not {5, 6} & set(near) and near[7] == [1, 3]
    crowd = spark.range(1000, 81_000).selectExpr("id AS p_partkey", "3 AS p_size", "950.0D AS p_retailprice")
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").union(crowd).write.parquet(f"{tmp_path}/part.parquet")
    near[3] = [80_000 * 79_999 // 2] * 2
    assert {r.p_size: [r.within_5, r.within_10] for r in catalog.QUERIES["collision_band"](spark, str(tmp_path)).collect()} == near
