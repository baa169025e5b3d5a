"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. Sources, by code point with null last, weigh 1, 2, 3, repeating; together they
share the words of the whole input, none beyond ``most_epochs`` times its own, the excess going to
the others by weight until none is above. A source's target is met by complete epochs of all its
documents first; the rest is a weighted sample without replacement: each document draws the key
-ln(u) / w, u from a hash of its id and text and w from the quality of its text, documents are taken by
ascending key until the words run out, and the one on the border gives only the words still missing.

The order within a source is never sorted in one task. Keys fall in buckets of a fixed expected
size; bucket totals are summed first, and only the documents of one bucket meet in a window. A
bucket is a range of the keys' distribution function in its source, which is the mixture of the
exponential distributions of the weights found there (a histogram of ``BINS`` classes), so buckets are
alike in size whatever the weights.

A null or blank text has size 0 and takes 0 words. Documents of one source that tie in key are
ordered by id, then by text hash; fully equal rows may swap, which changes nothing. A source without
words has target 0. An empty table gives an empty result. Only the id, text and source columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Classes of quality weights, of equal width in their logarithm.
BINS = 32


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of a text's non-blank characters that are no symbols."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    size = F.greatest(F.length(text), F.lit(1))
    return F.lit(0.1) + 0.9 * F.greatest(F.lit(0.0), 1 - 8.0 * symbols / size)


def source_targets(totals: DataFrame, most_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of each source; the table has one row for each source, not each document."""
    rows = sorted(((r.source, int(r.source_size)) for r in totals.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    target, free, left = [0.0] * len(rows), set(range(len(rows))), float(sum(s for _, s in rows))
    while free:
        unit = left / sum(weight[i] for i in free)
        above = [i for i in sorted(free) if weight[i] * unit > most_epochs * rows[i][1]]
        if not above:
            for i in free:
                target[i] = weight[i] * unit
            break
        for i in above:
            target[i] = float(most_epochs * rows[i][1])
            left -= target[i]
            free.discard(i)
    return [(name, size, t) for (name, size), t in zip(rows, target)]


def draw(seed: int, doc_id: Column, digest: Column) -> Column:
    """A number in (0, 1) that the id and the text's digest fix: 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest)), 1, 13), 16, 10)
    return (bits.cast("long") + 0.5) / float(1 << 52)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_epochs: int = 3, seed: int = 17, bucket_rows: int = 2000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, epochs) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(text.cast("binary")).alias("tie"),
        quality_weight(text).alias("weight"),
    ).withColumn("key", -F.ln(draw(seed, F.col("doc_id"), F.col("tie"))) / F.col("weight"))
    light = scratch.save(light.withColumn("bin", F.floor(-F.ln("weight") * (BINS / 2.4))), "light")
    bins = scratch.save(light.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.avg("weight").alias("weight")), "bins")
    totals = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source, with the classes of weights found there; the join is planned by that size.
    plan = spark.createDataFrame(source_targets(totals, most_epochs), "src string, source_size long, target double")
    shape = bins.groupBy("source").agg(F.sum("rows").alias("rows"), F.collect_list(F.struct("rows", "weight")).alias("classes")).withColumnRenamed("source", "name")
    plan = plan.join(shape, F.col("src").eqNullSafe(F.col("name"))).select("src", "source_size", "target", F.greatest(F.lit(1), F.floor(F.col("rows") / bucket_rows)).alias("buckets"), F.transform("classes", lambda c: F.struct((c["rows"] / F.col("rows")).alias("share"), c["weight"].alias("weight"))).alias("classes"))
    plan = scratch.save(plan, "plan")
    rows = light.drop("bin", "weight").join(plan, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs.cast("long")).withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
    below = F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + c["share"] * (1 - F.exp(-F.col("key") * c["weight"])))
    rows = rows.withColumn("bucket", F.when(F.col("buckets") == 1, F.lit(0)).otherwise(F.least(F.floor(below * F.col("buckets")), F.col("buckets") - 1))).drop("classes")
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return rows.withColumn("part", part).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "source", "epochs")


#: The mix of ``documents`` with the default parameters: all documents of a source sorted by key in one window.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(t) AS tie,
    0.1 + CAST(0.9 AS DOUBLE) * greatest(0.0::DOUBLE, 1 - 8.0::DOUBLE * len(regexp_extract_all(t, '[#*$%&|<>!]')) / greatest(length(t), 1)) AS weight
  FROM d
), k AS (
  SELECT doc_id, source, size, tie,
    -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || tie), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS key
  FROM l
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM k GROUP BY source
), w AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size / ((place - 1) % 3 + 1)::DOUBLE AS full_at FROM s
), u AS (  -- the unit if all sources that fill up earlier are capped
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS unit
  FROM w WINDOW before AS (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT unit FROM u WHERE unit <= full_at ORDER BY full_at, place LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN coalesce(weight * (SELECT unit FROM v) > 3 * source_size, true) THEN 3.0::DOUBLE * source_size
    ELSE weight * (SELECT unit FROM v) END AS target FROM u
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t
)
SELECT k.doc_id, k.size, e.source_size, e.target, k.source, e.epochs,
  e.epochs * k.size + greatest(0, least(k.size, floor(e.target)::BIGINT - e.epochs * e.source_size
    - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
