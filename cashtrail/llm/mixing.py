"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its share of the budget over its own size. A document's count is the Poisson quantile
(mean: its source's rate) of a uniform number hashed from seed and document, so every run and every
executor draws the same. Documents explode by count, and a second hash deals the copies over all partitions and orders them
within each: a global shuffle without a sort of the whole. Sizes are summed map-side first; the table of rates has a row per
source and is broadcast only while its counted size is below a bound, otherwise joined with the hot sources split.

Defined results: a null source is a source of its own; a null text has size 0; a source of size 0 keeps each document once
(rate 1); equal ids draw equal counts (a null id draws by its text), repeated rows each yield their copies; an empty
table gives no rows; columns may have any names. A source without a given weight gets rate 0 if weights are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of

SEED = 17
ALPHA = 0.7                     # target share of a source: its size to this power
MAX_BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... until far beyond the rate, summed from logarithms so that large rates keep their digits."""
    start = F.struct((-rate).alias("logp"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s, k):
        logp = s["logp"] + F.log(rate) - F.log(k.cast("double"))
        total = s["sum"] + F.exp(logp)
        return F.struct(logp.alias("logp"), total.alias("sum"), F.concat(s["cdf"], F.array(total)).alias("cdf"))

    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    table = F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def rates(rows: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float = 1.0) -> DataFrame:
    """(source, size, rate): rate = budget x all sizes x weight / size, weights normalised over the sources present."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(alpha))).otherwise(0.0)
        weighed = sizes.withColumn("weight", weight)
    else:
        pairs = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = sizes.join(F.broadcast(pairs), "source", "left").fillna(0.0, ["weight"])
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))      # one row
    rate = F.when(F.col("size") > 0, F.lit(float(budget)) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")).otherwise(1.0)
    return weighed.join(F.broadcast(total), F.lit(True)).select("source", "size", F.coalesce(rate, F.lit(1.0)).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """``row`` once per copy, with rate, copies, copy (from 0) and place (the copy's hash order), dealt over all partitions."""
    source = F.col("row.source").cast("string")
    rows = packed(docs).withColumn("source", source).withColumn("size", F.length(text_of()).cast("long"))
    table = rates(rows.select("source", "size"), weights, alpha, budget).withColumn("cdf", poisson_cdf(F.col("rate"))).drop("size")
    if rows.select("source").distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    same = rows["source"].eqNullSafe(table["source"])
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(text_of().cast("binary")))
    u = uniform(F.lit(str(seed)), key)
    drawn = rows.drop("size").join(table, same).select(
        "row", "rate", F.size(F.filter("cdf", lambda c: c <= u)).alias("copies"), key.alias("key"))
    copies = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    place = F.md5(F.concat_ws("|", F.lit(f"place{seed}"), "key", F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("place", place).drop("key").repartition("place").sortWithinPartitions("place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The replicated documents, columns as they came."""
    return replicate(docs, **options).select("row.*")


SQL = f"""WITH s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN size > 0 THEN pow(CAST(size AS DOUBLE), {ALPHA}) ELSE 0 END AS weight FROM s),
t AS (SELECT sum(size) AS all_size, sum(weight) AS all_weight FROM w),
r AS (SELECT source, CASE WHEN size > 0 THEN all_size * weight / all_weight / size ELSE 1.0 END AS rate FROM w, t),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (SELECT *, CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), md5(text))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.source, d.text, rate, count(*) FILTER (cdf <= u) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, text, round(rate, 9) AS rate, CAST(copies AS INTEGER) AS copies, CAST(copy AS INTEGER) AS copy,
 md5('place{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), md5(text)) || '|' || copy) AS place
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM n)"""
