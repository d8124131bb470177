"""Where sources diverge: per language, how far the smoothed shares of terms differ between sources, in exact integers.

Terms are counted inside tasks and added up by (language, term, source). The counts of a term over the sources of its
language are its sparse vector; terms with one vector are one class. Every pair of sources is evaluated once for each
class and multiplied by the number of its terms; the terms themselves are only ranked, by the shares of their class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Documents of a language that a kept term is in, what is added to each count, parts of a whole share, ranks of terms.
LEAST_DOCUMENTS, ADDED, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Distinct (language, source, term) that a task holds before it writes them.
HELD = 300_000

#: A term is a run of the bytes of ASCII letters and of all other characters than ASCII; the rest of ASCII parts terms.
#: As UTF-8 keeps ASCII bytes for ASCII characters alone, texts are cut as bytes: the table lowers letters and blanks the rest.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(documents: DataFrame) -> DataFrame:
    """(lang, source, term, count, documents) in parts still to be added up; each (lang, source) also has a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                terms = [None, *(t.decode() for t in n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                    names=["lang", "source", "term", "count", "documents"],
                )

        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                terms = text.translate(TERM_BYTES).split()
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
                if held > HELD:
                    yield from out()
                    counts, held = {}, 0
        yield from out()

    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    return documents.select(text, lang, source).mapInArrow(run, "lang string, source string, term string, count long, documents long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / total), without rounding."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.lit(1) + F.call_function("div", wide(count + ADDED) * F.lit(WHOLE).cast("decimal(10,0)"), wide(total))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same of whole arrays: three decimals of the quotient at a time, so that no product leaves 64 bits."""
    left, out = counts + ADDED, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // totals, left % totals
    return out + 1


def pair_sums(classes: DataFrame) -> DataFrame:
    """(lang, a, b, value): the sum over all terms of the classes of the difference of shares of each two sources.

    `classes` has lang, sources (all of the language, in order), totals (N + 5 V of each), counts (of the class, one a
    source) and terms (how many the class has). The work is linear in the classes; a task gives a row a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                rows = batch.filter(pa.array(langs == lang))
                sources, totals = rows.column(1)[0].as_py(), np.array(rows.column(2)[0].as_py(), np.int64)
                counts = rows.column(3).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, len(sources))
                terms = rows.column(4).to_numpy()
                p = shares(counts, totals[None, :])
                _, total = sums.setdefault(lang, (sources, np.zeros((len(sources), len(sources)), np.int64)))
                for a in range(len(sources)):
                    total[a] += terms @ np.abs(p - p[:, a : a + 1])
        for lang, (sources, total) in sums.items():
            a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
            names = np.array(sources, dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(total[a, b])], names=["lang", "a", "b", "value"])

    found = classes.select("lang", "sources", "totals", "counts", "terms").mapInArrow(run, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the other sources and its own terms.

    Part `pair` ranks the language's other sources by the summed difference of shares of all kept terms (0 without any);
    part `term` the kept terms whose share in the source is above the language's, by the difference, up to `ranks`.
    Values fall; equal ones are in order of the item's bytes. Null texts, languages and sources are read as empty; every
    row is a document, repeated ones too; other columns are ignored. An empty table gives no rows, a language of one
    source no pairs. A row holds the counts of a term over its language's sources, and the result a row for each two
    of these, so sources are taken to be few enough for that.
    """
    added = counted(documents).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    groups_and_terms = materialise(added, "divergence-counts")
    groups = groups_and_terms.filter("term is null").select("lang", "source")
    vector = F.sort_array(F.collect_list(F.struct("source", "count"))).alias("vector")
    terms = groups_and_terms.filter("term is not null").groupBy("lang", "term").agg(vector, F.sum("documents").alias("documents"))
    terms = materialise(terms.filter(F.col("documents") >= least_documents).select("lang", "term", "vector"), "divergence-terms")
    classes = materialise(terms.groupBy("lang", "vector").agg(F.count("*").alias("terms")), "divergence-classes")

    # N of each source and language, V of each language: a row a group
    each = classes.select("lang", "terms", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum(F.col("terms") * F.col("x.count")).alias("n"))
    kept = classes.groupBy("lang").agg(F.sum("terms").alias("v"))
    of_group = groups.join(each, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    of_group = materialise(of_group, "divergence-groups")
    entry = F.struct("source", (F.col("n") + ADDED * F.col("v")).alias("total"))
    of_lang = of_group.groupBy("lang").agg(F.sort_array(F.collect_list(entry)).alias("all"), (F.sum("n") + ADDED * F.first("v")).alias("lang_total"))

    joined = classes.join(F.broadcast(of_lang), "lang")
    at = F.map_from_entries("vector")
    wide = joined.select("lang", F.col("all.source").alias("sources"), F.col("all.total").alias("totals"), F.transform("all", lambda s: F.coalesce(F.try_element_at(at, s["source"]), F.lit(0))).alias("counts"), "terms")
    every = of_group.select("lang", F.col("source").alias("a")).join(of_group.select("lang", F.col("source").alias("b")), "lang").filter("a <> b")
    pairs = every.join(pair_sums(wide), ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))

    # a class's excess in each of its sources, then the class's terms
    totals = F.map_from_entries("all")
    in_all = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    excess = F.transform("vector", lambda x: F.struct(x["source"].alias("source"), (share(x["count"], totals[x["source"]]) - share(F.col("in_all"), F.col("lang_total"))).alias("value")))
    above = joined.withColumn("in_all", in_all).select("lang", "vector", F.filter(excess, lambda x: x["value"] > 0).alias("above")).filter(F.size("above") > 0)
    # the vectors are many times larger than their file, which Spark would take for small enough to be broadcast by the driver
    ranked = terms.hint("merge").join(above, ["lang", "vector"]).select("lang", F.explode("above").alias("x"), "term")
    own = ranked.select("lang", F.col("x.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.col("x.value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all `documents`; see `audit`."""
    return audit(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
 w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
 kept as (select lang, term from w group by 1, 2 having count(distinct r) >= 30),
 c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
 g as (select distinct lang, source from d), v as (select lang, count(term) as v from (select distinct lang from d) left join kept using (lang) group by 1),
 gn as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by 1, 2), ln as (select lang, sum(total) as total from gn group by 1),
 p as (select gn.lang, gn.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (gn.total + 5 * v.v)::hugeint as p from gn join v using (lang) join kept using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
 q as (select c.lang, c.term, 1 + (1000000000::hugeint * (sum(c.n) + 5)::hugeint) // (any_value(ln.total) + 5 * any_value(v.v))::hugeint as q from c join ln using (lang) join v using (lang) group by 1, 2),
 f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
 left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3, 4
 union all select p.lang, p.source, 'term', p.term, (p.p - q.q)::bigint from p join q using (lang, term) where p.n > 0 and p.p > q.q),
 k as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from f) select lang, source, part, item, value, rank::integer as rank from k where part = 'pair' or rank <= 50"""
