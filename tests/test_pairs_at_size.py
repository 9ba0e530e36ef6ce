import random

import pytest
from pyspark.sql import functions as F

from rimefield.operators import noise, spatial


@pytest.mark.parametrize("place", [True, False])
@pytest.mark.parametrize("least", [0, 1])
def test_crossover_pairs_brute_force(spark, monkeypatch, place, least):
    """All pairs once, at the edges of tiles too, of negative days and places, of equal ids, and where a tile is cut in parts."""
    monkeypatch.setattr(noise, "CANDIDATES", 50)
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice("ab"), rng.randrange(1500), rng.randrange(-60, 60), rng.random(), rng.choice([rng.uniform(-40, 40), float(rng.randrange(-40, 40, 2))]), float(rng.randrange(-4, 4))) for _ in range(2000)]
    rows += [(None, "a", 1901, 0, 1.0, 0.0, 0.0), (0, "a", None, 0, 1.0, 0.0, 0.0), (0, "a", 1903, None, 1.0, 0.0, 0.0), (0, "a", 1904, 1, None, 0.0, 0.0), (0, "a", 1905, 0, 1.0, 0.0, float("nan")), (0, "a", 1906, 0, 1.0, 1e300, 0.0), (0, "a", 1907, 1, 1.0, 1e300, 1.0)]
    df = spark.createDataFrame(rows, "k int, s string, id long, day int, v double, x double, y double")
    got = noise.crossover_pairs(df, ["k", "s"], "id", "day", "v", least, 3, *(("x", "y", 2.0) if place else ()))
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.id") < F.col("b.id")) & F.abs(F.col("a.day") - F.col("b.day")).between(least, 3))
    if place:
        want = want.where(F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), F.lit(2.0)) + F.pow(F.col("a.y") - F.col("b.y"), F.lit(2.0))) <= 2.0)
    want = want.select("a.id", "b.id", F.abs(F.col("a.v") - F.col("b.v")), (F.col("a.v") + F.col("b.v")) / 2)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    found = sorted(map(key, got.collect()))
    assert found == sorted(map(key, want.collect())) and len(found) > 100


def test_crossover_pairs_move_rows_once(spark):
    """Few rows are copied, and one exchange moves them: sending each to 27 neighbours took more than 4 x input of disk."""
    df = spark.range(20_000).selectExpr("id % 7 k", "id", "cast(rand(1) * 2500 as int) day", "rand(2) v", "rand(3) * 50000 x", "rand(4) * 50 y")
    plan = noise.crossover_pairs(df, ["k"], "id", "day", "v", x="x", y="y", radius=100.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    assert 20_000 <= noise.tiled(df, ["k"], "id", "day", "v", 30, "x", "y", 100.0).count() < 1.25 * 20_000


def test_radius_pairs_of_copies_brute_force(spark, monkeypatch):
    """Places of many ids, more than a block, ids that stand twice, edges of cells, nulls and NaN."""
    monkeypatch.setattr(spatial, "BLOCK", 4)
    rng = random.Random(6)
    rows = [(rng.randrange(2), rng.randrange(500), float(rng.randrange(-12, 12)), rng.choice([-0.0, 0.0, 5.0, -5.0, 2.5])) for _ in range(500)] + [(0, i, 40.0, 40.0) for i in range(23)]
    rows += [(None, 601, 0.0, 0.0), (0, None, 0.0, 0.0), (0, 603, None, 0.0), (0, 604, 0.0, float("nan")), (0, 605, 1e300, 0.0), (0, 606, 1e300, 1.0)]
    df = spark.createDataFrame(rows, "k int, id long, x double, y double")
    a, b = df.alias("a"), df.alias("b")
    dist = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), F.lit(2.0)) + F.pow(F.col("a.y") - F.col("b.y"), F.lit(2.0)))
    want = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")) & (dist <= 5.0)).select("a.k", "a.id", "b.id", F.round(dist, 6))
    found = sorted(map(tuple, spatial.radius_pairs(df, ["k"], "id", "x", "y", 5.0, digits=6).collect()))
    assert found == sorted(map(tuple, want.collect())) and len(found) > 5000


def test_radius_pairs_send_nothing_through_the_driver(spark):
    """Small tables were broadcast after they were copied to 9 cells: at 60 times sf0.1 that took more memory than the driver has."""
    df = spark.range(2000).selectExpr("id", "rand(1) * 100 x", "rand(2) * 50 y")
    plan = spatial.radius_pairs(df, [], "id", "x", "y", 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
