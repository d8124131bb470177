import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from groundmark.functions import values
from groundmark.operators import matching, ordered

START = dt.datetime(2026, 1, 1)


def hot_rows(seed=1, n=3000):
    """(key, at, id, value): one key has a third of all rows, one is null; instants tie, values are often null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", None, "a", "b", "c", "hot"]), START + dt.timedelta(hours=rng.randrange(2000)), i, rng.choice([None, None, rng.randrange(50)])) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, at timestamp, id long, value long").repartition(5)


def day():
    return F.floor(F.unix_micros("at") / 86_400e6).cast("long")


def test_last_known_and_places_of_hot_and_null_keys(spark):
    rows = hot_rows()
    known = {r["id"]: r["seen"] for r in ordered.last_known(table(spark, rows), ["key"], ["at", "id"], day(), "value", "seen").collect()}
    found = {r["id"]: (r["place"], r["total"]) for r in ordered.places(table(spark, rows), ["key"], ["at", "id"], day()).collect()}
    assert len(known) == len(found) == len(rows)
    for key in {r[0] for r in rows}:
        last, own = None, sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for place, (_, _, i, value) in enumerate(own, 1):
            assert known[i] == last and found[i] == (place, len(own))
            last = value if value is not None else last
    assert ordered.last_known(table(spark, []), ["key"], ["at", "id"], day(), "value", "seen").collect() == []
    assert ordered.places(table(spark, []), ["key"], ["at", "id"], day()).collect() == []


@pytest.mark.parametrize("held", [5, 100, 10_000])
def test_quantiles_equal_percentile_to_the_bit(spark, held):
    rng = random.Random(held)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(900)] + [("equal", 3.25)] * 400 + [("copies", rng.choice([1.0, 1.0, 2.0, 7.5])) for _ in range(300)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 308)) for _ in range(200)] + [(None, float(i)) for i in range(7)] + [("one", 4.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "key string, value double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["key"]: (r["n"], r["quantiles"]) for r in ordered.quantiles(df, ["key"], "value", shares, held).collect()}
    good = df.filter("value is not null and not isnan(value)")
    want = {r["key"]: (r["n"], r["q"]) for r in good.groupBy("key").agg(F.count("*").alias("n"), F.percentile("value", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got == want
    assert ordered.quantiles(df.limit(0), ["key"], "value", shares, held).collect() == []


def test_best_two_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 20}", rng.randrange(40) / 4, i) for i in range(3000)] + [("alone", 1.0, 9000)]
    df = spark.createDataFrame(rows, "key string, score double, id long").repartition(6)
    found = matching.best_two(df, ["key"], [F.col("score"), F.col("id")], "score")
    got = {r["key"]: (r["id"], r["score"], r["runner_up"], r["candidates"]) for r in found.collect()}
    for key in {r[0] for r in rows}:
        own = sorted((s, i) for k, s, i in rows if k == key)
        assert got[key] == (own[0][1], own[0][0], own[1][0] if len(own) > 1 else None, len(own))
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_of_the_double_itself(spark):
    rng = random.Random(4)
    numbers = [0.15, 0.35, 2.675, 1.005, -0.15, -2.675, 0.25, 0.125, 0.5, 1.5, 2.5, -0.5, 0.0, -0.0, 1e15, 123456789.5, 1e300, 0.045, 1.115, 8.345, None]
    numbers += [round(rng.uniform(-100, 100), 3) for _ in range(500)] + [k / 8 for k in range(-80, 80)] + [k / 1000 + 0.0005 for k in range(200)] + [rng.uniform(-1e6, 1e6) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for decimals in (0, 1, 2, 3):
        got = [r["y"] for r in df.select(values.rounded("x", decimals).alias("y")).collect()]
        assert got == [None if x is None else float(round(x, decimals)) for x in numbers], decimals
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(values.rounded("x", 2).alias("y")).collect()
    assert [str(r["y"]) for r in odd] == ["nan", "inf", "-inf"]


def test_texts_round_the_double(spark):
    df = spark.createDataFrame([(0.15, 0.35), (-0.04, 2.675), (-2.5, 0.0)], "a double, b double")
    got = df.select(values.signed("a", 1).alias("a"), values.signed("b", 2).alias("b"), values.signed("a", 0).alias("c")).collect()
    assert [tuple(r) for r in got] == [(f"{0.15:+.1f}", f"{0.35:+.2f}", f"{0.15:+.0f}"), (f"{-0.04:+.1f}", f"{2.675:+.2f}", f"{-0.04:+.0f}"), (f"{-2.5:+.1f}", f"{0.0:+.2f}", f"{-2.5:+.0f}")]
