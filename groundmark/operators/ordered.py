"""Ordered computations that stay whole for a hot key: neighbours, running sums, last known values, places, quantiles and
global row numbers, by buckets.

A plain window over a key sorts all rows of the key in one task. Here rows are windowed by key and bucket of the order
column, and only one row per bucket crosses the borders, so a key with a third of all rows is dealt over its buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import stored


def _keys(by: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by]


def neighbours(df: DataFrame, by: list[str], row: Column, bucket: Column, following: bool = True, name: str = "next") -> DataFrame:
    """`df` with column `name`: the next (or previous) `row` of the same key, null at the end.

    `row` is a struct whose order is that of the rows; its first field should decide, and `bucket` must not fall as it
    rises. Ties beyond the whole struct are of no account: their neighbours are equal.
    """
    df = df.withColumn("_row", row).withColumn("_bucket", bucket)
    inner = Window.partitionBy(*_keys(by), "_bucket").orderBy("_row")
    near = F.lead("_row").over(inner) if following else F.lag("_row").over(inner)
    edge = df.groupBy(*by, "_bucket").agg((F.min("_row") if following else F.max("_row")).alias("_edge"))
    outer = Window.partitionBy(*_keys(by)).orderBy("_bucket")  # one row a bucket
    beyond = edge.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_at"), (F.lead("_edge") if following else F.lag("_edge")).over(outer).alias("_beyond"))
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = df.withColumn(name, near).join(beyond, same, "left")
    return joined.withColumn(name, F.coalesce(name, "_beyond")).drop("_row", "_bucket", "_at", "_beyond", *(f"_by_{c}" for c in by))


def running_sum(df: DataFrame, by: list[str], order: list[Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows of its key up to and including each, in `order`."""
    df = df.withColumn("_value", value).withColumn("_bucket", bucket)
    inner = Window.partitionBy(*_keys(by), "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    outer = Window.partitionBy(*_keys(by)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_at"), F.sum("_sum").over(outer).alias("_before"))
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = df.withColumn(name, F.sum("_value").over(inner)).join(before, same, "left")
    total = F.col(name) + F.coalesce("_before", F.lit(0))
    return joined.withColumn(name, total).drop("_value", "_bucket", "_at", "_before", *(f"_by_{c}" for c in by))


def _by_bucket(df: DataFrame, by: list[str], bucket: Column, each: dict[str, Column], beyond: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """`df` with `_bucket` and what `beyond` makes, over the buckets of a key in order, of the aggregates `each` of a bucket."""
    df = df.withColumn("_bucket", bucket)
    buckets = df.groupBy(*by, "_bucket").agg(*(c.alias(n) for n, c in each.items()))
    outer = Window.partitionBy(*_keys(by)).orderBy("_bucket")  # one row a bucket
    found = buckets.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_bucket").alias("_of_bucket"), *(c.alias(n) for n, c in beyond(outer).items()))
    same = F.col("_bucket").eqNullSafe(F.col("_of_bucket"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return df.join(found, same, "left").drop("_of_bucket", *(f"_by_{c}" for c in by))


def last_known(df: DataFrame, by: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """`df` with the last value that is not null of the rows of the key before each row, in `order`.

    `bucket` must not fall along the order. What a bucket hands on is its own last value, or that of the buckets before.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    carry = lambda w: {"_carried": F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))}
    rows = _by_bucket(df, by, bucket, {"_last": F.max_by(value, known)}, carry)
    inner = Window.partitionBy(*_keys(by), "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inner), "_carried")).drop("_bucket", "_carried")


def places(df: DataFrame, by: list[str], order: list[str], bucket: Column, place: str = "place", total: str = "total") -> DataFrame:
    """`df` with each row's place in its key from 1, in `order`, and how many rows the key has.

    `bucket` must not fall along the order, nulls first.
    """
    def beyond(w: WindowSpec) -> dict[str, Column]:
        return {"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), total: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}

    rows = _by_bucket(df, by, bucket, {"_n": F.count("*")}, beyond)
    inner = Window.partitionBy(*_keys(by), "_bucket").orderBy(*order)
    return rows.withColumn(place, F.row_number().over(inner) + F.col("_before")).drop("_bucket", "_before")


#: Values of a key that an aggregate may hold, and parts that a range is cut into where there are more.
HELD, PARTS = 10_000, 1024


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], held: int = HELD) -> DataFrame:
    """(by, n, quantiles): exact quantiles of a key's finite values, interpolated as `percentile` does.

    No aggregate holds over `held` values. A key that has more is cut: the range that a wanted rank lies in is divided into
    equal parts, whose counts combine before the shuffle, until the part that has it holds few enough values, or equal ones.
    A key of equal values, or of many copies of a few, takes no more than the others.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    counts = stored(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "quantile-keys")

    def meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in right.columns if c not in by))
        same = F.lit(True)
        for c in by:
            same = same & left[c].eqNullSafe(right[f"_by_{c}"])
        return left.join(right, same, how).drop(*(f"_by_{c}" for c in by))

    few = meet(rows, counts.filter(F.col("n") <= held).select(*by, "n"))
    small = few.groupBy(*by, "n").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("quantiles"))
    big = counts.filter(F.col("n") > held)
    if big.isEmpty():
        return small
    at = F.array(*(F.struct(F.lit(k).alias("k"), f((F.col("n") - 1) * F.lit(q)).cast("long").alias("rank")) for k, q in enumerate(shares) for f in (F.floor, F.ceil)))
    wanted = big.select(*by, "n", "lo", "hi", F.explode(F.array_distinct(at)).alias("w")).select(*by, "n", "lo", "hi", "w.*")
    state = stored(wanted.select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")).distinct(), "quantile-ranges")
    wide = (F.col("inside") > held) & (F.col("lo") < F.col("hi"))
    while not state.filter(wide).isEmpty():
        inside = meet(rows, state.filter(wide)).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        # halves, so that no difference of two values is infinite
        part = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))
        parts = inside.groupBy(*by, "rank", "before", part.alias("part")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        so_far = F.sum("c").over(Window.partitionBy(*_keys(by), "rank").orderBy("part"))  # PARTS rows at most
        found = parts.withColumn("until", F.col("before") + so_far).filter((F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("c")))
        narrower = found.select(*by, "rank", "lo", "hi", (F.col("until") - F.col("c")).alias("before"), F.col("c").alias("inside"))
        state = stored(narrower.unionByName(state.filter(~wide)), "quantile-ranges")
    several = meet(rows, state.filter("lo < hi")).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
    picked = several.groupBy(*by, "rank", "before").agg(F.sort_array(F.collect_list("_v")).alias("l")).select(*by, "rank", F.get("l", (F.col("rank") - F.col("before")).cast("int")).alias("x"))
    values = picked.unionByName(state.filter("lo = hi").select(*by, "rank", F.col("lo").alias("x")))
    pairs = wanted.select(*by, "n", "k", "rank").join(values.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("rank").alias("_rank"), "x"), _same(by) & (F.col("rank") == F.col("_rank")))
    each = pairs.groupBy(*by, "n", "k").agg(F.min(F.struct("rank", "x")).alias("a"), F.max(F.struct("rank", "x")).alias("b"))
    position = (F.col("n") - 1) * F.get(F.array(*map(F.lit, shares)), F.col("k"))
    value_at = F.when(F.col("a.rank") == F.col("b.rank"), F.col("a.x")).otherwise((F.col("b.rank") - position) * F.col("a.x") + (position - F.col("a.rank")) * F.col("b.x"))
    large = each.select(*by, "n", F.struct("k", value_at.alias("x")).alias("q")).groupBy(*by, "n").agg(F.transform(F.sort_array(F.collect_list("q")), lambda q: q["x"]).alias("quantiles"))
    return small.unionByName(large)


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return same


def runs(df: DataFrame, by: list[str], order: str, tie: str, value: str, bucket: Column) -> DataFrame:
    """(by, run, value, first, last, n): maximal runs of equal `value` of a key in order, numbered from 1."""
    seen = neighbours(df, by, F.struct(order, tie, value), bucket, following=False, name="_prev")
    change = F.when(F.col("_prev").isNotNull() & F.col("_prev")[value].eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered_ = running_sum(seen, by, [F.col(order), F.col(tie)], bucket, change, "run")
    return numbered_.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def numbered(df: DataFrame, lead: Column, order: list[Column], name: str = "position", buckets: int = 64) -> DataFrame:
    """`df` with row numbers from 1 in `order`, without one task for all rows.

    `lead` is a number that rises along `order` (or is equal). Quantiles of it cut the rows into buckets, which are
    numbered each by itself; a bucket starts behind the rows of those before it.
    """
    df = df.withColumn("_lead", lead.cast("double"))
    cuts = sorted(set(df.stat.approxQuantile("_lead", [i / buckets for i in range(1, buckets)], 0.001)))
    place = sum((F.when(F.col("_lead") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    df = df.withColumn("_bucket", F.when(F.col("_lead").isNull(), -1).otherwise(place))
    counts = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    before = F.broadcast(counts.select("_bucket", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.withColumn(name, within).join(before, "_bucket").withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_lead", "_before")
