"""Queries on tracks whose truth is known: each customer's flight is drawn by a rule, and the operators must find it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import landings
from .catalogue import _table, query

#: A plane whose pixels are easily computed: x = 0.02 u - 20, y = 20 - 0.03 v.
PLANE = ((0.02, 0.0, -20.0), (0.0, -0.03, 20.0), (0.0, 0.0, 1.0))
FRAMES, FPS = 60, 60.0


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty frames for each customer: a landing, a departure, a roll or a descent, by the key's remainder of 4.

    Contact is at 0.4 to 0.6 s. Depth and the gap under the tyre have a corner there, with noise from a hash. Every seventh
    frame hides the tyre, every eleventh has its widest candidate far off, all have a decoy, and a key's remainder of 5 at
    0 has no tyres at all.
    """
    k = F.col("c_custkey")
    # A small file is one task, and a customer is sixty long rows: they are dealt out before they are drawn.
    customers = _table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    rows = customers.select(k.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))
    noise = lambda seed: F.pmod(F.xxhash64("id", "frame", F.lit(seed)), F.lit(2001)) / 1000.0 - 1.0
    rows = rows.withColumns({"t": F.col("frame") / FPS, "tc": F.lit(0.4) + F.col("id") % 5 * 0.05, "shape": F.col("id") % 4})
    zero = F.lit(0.0)
    height = (
        F.when(F.col("shape") == 0, F.greatest(zero, F.col("tc") - F.col("t"))).when(F.col("shape") == 1, F.greatest(zero, F.col("t") - F.col("tc")))
        .when(F.col("shape") == 2, zero).otherwise(2.0 - F.col("t"))
    )
    x, y = -12.0 + 24.0 * F.col("t") + 0.02 * noise(1), 3.0 + 3.0 * height + 0.02 * noise(2)
    rows = rows.withColumns({"u": (x + 20) / 0.02, "v": (20 - y) / 0.03, "gap": 5.0 + 60.0 * height + 0.2 * noise(3)})
    tyre = lambda du, dv: F.struct((F.col("u") + du).alias("u"), (F.col("v") + dv).alias("v"), F.lit(40.0).alias("area"))
    hidden, bare = F.col("frame") % 7 == 3, F.col("id") % 5 == 0
    tyres = F.when(hidden | bare, F.array(tyre(70.0, -12.0))).otherwise(F.array(tyre(70.0, -12.0), tyre(0.0, 0.0)))
    columns = F.transform(F.sequence(F.lit(-6), F.lit(6)), lambda i: F.struct((F.col("u") + i * 4.0).alias("u"), F.when(bare, F.col("v")).otherwise(F.col("v") - 6.0).alias("belly"), F.col("gap").alias("gap"), F.lit(None).cast("double").alias("reach")))
    widest = F.when(hidden, F.lit(None)).when(F.col("frame") % 11 == 5, F.col("u") + 150.0).otherwise(F.col("u") + noise(4))
    return rows.select(
        F.col("id").cast("string").alias("track"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("segment"), F.col("frame").cast("int").alias("frame"), "t",
        (F.col("frame") < 2).alias("clipped"), widest.alias("wheel_u"), F.col("u").alias("lowest_u"), tyres.alias("tyres"), columns.alias("columns"),
    )


@query("""select c_custkey as id, ['measured', 'departure', 'unseen', 'long'][c_custkey % 4 + 1] as outcome, ['landing', 'departure', 'landing', 'landing'][c_custkey % 4 + 1] as kind,
 case when c_custkey % 4 < 2 then true end as contact_found, case when c_custkey % 4 = 0 then true end as place_found, 60 as points, case when c_custkey % 5 = 0 then 0 else 49 end as tyres,
 case c_custkey % 4 when 3 then 59 end as bound_frame from customer""")
def track_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether contact was found within 0.03 s and place within 0.5 m of the truth, and how many tyres were seen."""
    out = landings.track_landings(profiles(spark, sf_dir), PLANE, fps=FPS)
    k = F.col("track").cast("long")
    tc = F.lit(0.4) + k % 5 * 0.05
    near = F.when(k % 4 < 2, F.coalesce(F.abs(F.col("contact_t") - tc) <= 0.03, F.lit(False)))
    place = F.when(k % 4 == 0, F.coalesce(F.abs(F.col("longitudinal_m") - (24 * tc - 12)) <= 0.5, F.lit(False)) & (F.col("uncertainty_m") < 1))
    return out.select(k.alias("id"), "outcome", "kind", near.alias("contact_found"), place.alias("place_found"), F.col("points").cast("int").alias("points"), F.col("tyres").cast("int").alias("tyres"), F.when(F.col("outcome") == "long", F.col("frame")).alias("bound_frame"))
