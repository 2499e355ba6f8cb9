"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is what brings its expected size to its target share of the total. Each
document gets a number of copies by inverting the Poisson distribution of that mean at a uniform number
that a hash of the seed and its id gives, so a rerun gives the same copies and no state is shared. The
copies are then dealt out and ordered by a hash, which is a global shuffle without sampling.

A document's size is its characters and one more for its end, so empty documents count too. Means over
STEP are split into equal parts that are drawn apart and added, which keeps exp(-mean) above zero.

Rates, one row for each source, are broadcast while there are at most MOST_BROADCAST of them; beyond
that they are joined by a shuffle whose hot keys Spark's skew join splits.

Defined results: null is a source of its own; a null id hashes as an empty string; rows of equal id get
equal copies; columns named copy_no, mix_key or
mix_rate are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope.llm.common import materialise, shuffle_partitions, table

SEED = "twinscope-mix-1"
STEP = 256
MOST_BROADCAST = 100_000
#: Weight of a source: the root of its size, which lifts small sources.
EXPONENT = 0.5


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """mix_source, parts, and cdf of one part, for each source.

    `weights` has columns source and weight (any positive scale; sources it lacks get none, nor do those of a
    weight that isn't a positive number; weights of a source that is named twice add up). `total` is the wanted
    size, that of `docs` if None; a size that isn't positive, or weights without a sum, give no rows.
    """
    size = F.sum(F.coalesce(F.char_length("text"), F.lit(0)) + 1).cast("double")
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(size.alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt("size") if EXPONENT == 0.5 else F.pow("size", F.lit(EXPONENT)))
    else:
        usable = F.col("weight").cast("double")
        usable = F.when((usable > 0) & (usable < float("inf")), usable).otherwise(0.0)
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(usable).alias("weight"))
        sizes = sizes.join(w, F.col("mix_source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    sums = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    wanted = F.col("all_size") if total is None else F.lit(max(0.0, float(total)))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.nullif("all_weight", F.lit(0.0)) * wanted / F.col("size")).otherwise(0.0)
    rates = sizes.join(F.broadcast(sums)).select("mix_source", rate.alias("rate"))  # sums: one row
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    first = F.exp(-F.col("mean"))
    most = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct(
            (acc.p * F.col("mean") / k).alias("p"), (acc.c + acc.p * F.col("mean") / k).alias("c"), F.concat(acc.cdf, F.array(acc.c + acc.p * F.col("mean") / k)).alias("cdf")
        ),
        lambda acc: acc.cdf,
    )
    return rates.select("mix_source", "parts", steps.alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as drawn, globally shuffled, with copy_no (from 1) and mix_key."""
    spark = docs.sparkSession
    rates = materialise(source_rates(docs, weights, total), "rates")
    if rates.count() <= MOST_BROADCAST:
        rates = F.broadcast(rates)
    rates = rates.select(F.struct("mix_source", "parts", "cdf").alias("mix_rate"))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def drawn(j: Column) -> Column:
        u = uniform(F.lit(seed), doc_id, j.cast("string"))
        return F.size(F.filter(F.col("mix_rate.cdf"), lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("mix_rate.parts")), F.lit(0), lambda acc, j: acc + drawn(j))
    rows = docs.drop("copy_no", "mix_key", "mix_rate").join(rates, F.col("source").eqNullSafe(F.col("mix_rate.mix_source")))
    rows = rows.withColumn("mix_rate", copies)
    # no copies: explode drops the row, without a filter that would draw again
    rows = rows.withColumn("copy_no", F.explode(F.expr("IF(mix_rate > 0, sequence(1, mix_rate), array())"))).drop("mix_rate")
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), doc_id, F.col("copy_no").cast("string"))))
    # rows without an id share their keys; their texts deal them out
    return rows.repartition(shuffle_partitions(spark), "mix_key", F.xxhash64("text")).sortWithinPartitions("mix_key", "copy_no")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: A SELECT of the mixed rows of {docs}; {columns} are those it carries.
MIX_SQL = """
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS mix_row, * FROM {docs}),
sizes AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM docs GROUP BY source),
sums AS (SELECT sum(sqrt(size)) AS all_weight, sum(size) AS all_size FROM sizes),
rates AS (SELECT source, sqrt(size) / all_weight * all_size / size AS rate FROM sizes, sums),
means AS (SELECT source, greatest(1, ceil(rate / 256))::INTEGER AS parts, rate / greatest(1, ceil(rate / 256))::INTEGER AS mean FROM rates),
cdf(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM means
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 40)),
draws AS (
  SELECT mix_row, source, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT mix_row, doc_id, d.source, unnest(generate_series(1, parts)) AS j FROM docs d JOIN means m ON d.source IS NOT DISTINCT FROM m.source)),
copies AS (SELECT mix_row, count(*) AS n FROM draws w JOIN cdf f ON w.source IS NOT DISTINCT FROM f.source AND f.c <= w.u GROUP BY mix_row),
mixed AS (SELECT d.*, unnest(generate_series(1, n))::INTEGER AS copy_no FROM docs d JOIN copies USING (mix_row))
SELECT {columns}, copy_no, md5('{seed}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no) AS mix_key FROM mixed
"""

OP8_SQL = MIX_SQL.format(docs="documents", seed=SEED, columns="doc_id, text, lang, source, n_chars")
