"""Importance resampling towards a target distribution, by hashed word n-grams.

Features of a text are its runs of one to ``GRAMS`` words, dealt to ``BUCKETS`` buckets by checksum. A bucket's gain is the scaled logarithm
of its share in the target over its share in the documents; a document's weight is the mean gain of its features. With
Gumbel noise hashed from seed and id added, the highest scores are a draw without replacement in proportion to the weights.

Texts are worked on in batches: they are joined with a sentinel between them, one regex pass finds all words, a sorted search of
the words' places among the documents' offsets says whose they are, and runs that cross a border are masked out before the
buckets are counted. A task returns one count per bucket, so the corpus counts shuffle as a few numbers a task. The texts
are read twice, for counts and for weights; nothing but ids and numbers is shuffled. The order of all scores is dealt by ranges, numbered within
each range and put on by the counts of the ranges before it: no task sees the whole table. The buckets' gains go to every
executor: ``BUCKETS`` whole numbers, whatever the input.

Defined results: a null text has no words; a text without words has weight 0; a null id draws its noise as an empty one and
comes last among equal scores; repeated rows are counted, scored and ranked each; without documents or target the smoothed
counts still give finite gains; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.storage import written
from .common import packed, row_ids, text_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")       # bytes of lowered text: digits, letters and everything beyond ASCII
SENTINEL = b"\0"                                # belongs to no word
GRAMS, BUCKETS, SEED = 2, 10_000, 7
MIN_WORDS, PERCENT = 20, 25                     # documents that may be drawn, and how many of them are
BATCH_BYTES = 1 << 22                           # text joined at once; a longer text is a batch of its own


def joined(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Slices of a batch with their lowered texts as one string, and the offsets at which the texts begin."""
    texts, at, held, size = batch.column(column), 0, [], 0
    for i in range(len(texts)):
        held.append((texts[i].as_py() or "").encode().lower())         # bytes: A-Z only
        size += len(held[-1]) + 1
        if size >= most or i == len(texts) - 1:
            starts = np.cumsum([0] + [len(t) + 1 for t in held[:-1]])
            yield batch.slice(at, i + 1 - at), SENTINEL.join(held), starts
            at, held, size = i + 1, [], 0


def buckets_of(data: bytes, starts: np.ndarray, grams: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words a document, for each run length the buckets of its runs and their documents)."""
    places, words = [], []
    for m in WORD.finditer(data):
        places.append(m.start())
        words.append(m[0])
    doc = np.searchsorted(starts, np.array(places, np.int64), "right") - 1
    sums = list(map(crc32, words))
    out = []
    for k in range(1, grams + 1):
        if k > 1:
            sums = [crc32(w, crc32(b" ", c)) for c, w in zip(sums, words[k - 1:])]      # the run so far, a space and the next word
        whole = doc[:len(sums)] == doc[k - 1:]
        out.append((np.array(sums, np.int64)[whole] % buckets, doc[:len(sums)][whole]))
    return np.bincount(doc, minlength=len(starts)), out


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``texts`` (text string); buckets without a feature are left out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, starts in joined(batch):
                for found, _ in buckets_of(data, starts, grams, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket; ``docs`` and ``target``: text."""
    s, t = (bucket_counts(x, grams, buckets).withColumnRenamed("n", c) for x, c in ((docs, "s"), (target, "t")))
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    both = written(both, "buckets")
    totals = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))      # one row
    share = ((F.col("t").cast("double") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s").cast("double") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(totals), F.lit(True)).select("bucket", F.floor(1000.0 * F.log(share)).alias("gain"))


def weighted(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", keep: list[str] | None = None,
             grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``row`` (the columns ``keep``, all by default), n_words, n_features and weight of every document."""
    rows = packed(docs).select(F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row") if keep else "row", text_of(text).alias("text"))
    table = gains(rows, packed(target).select(text_of(target_text).alias("text")), grams, buckets)
    gain = np.zeros(buckets, np.int64)
    for bucket, value in table.collect():                   # ``buckets`` rows
        gain[bucket] = value

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts in joined(batch):
                n_words, runs = buckets_of(data, starts, grams, buckets)
                n, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
                for found, doc in runs:
                    n += np.bincount(doc, minlength=len(starts))
                    sums = np.concatenate([[0], np.cumsum(gain[found])])
                    ends = np.searchsorted(doc, np.arange(len(starts) + 1))
                    total += sums[ends[1:]] - sums[ends[:-1]]
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, pa.int64()) for c in (n_words, n, weight)]],
                                                 ["row", "n_words", "n_features", "weight"])

    numbers = [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]
    return rows.mapInArrow(weigh, StructType([rows.schema["row"], *numbers]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, hashed from seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(-1000.0 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def ranked(scores: DataFrame, order: list[Column]) -> DataFrame:
    """``scores`` with ``rank`` (1, 2, ..) in the total order ``order``, numbered range by range."""
    ranged = written(scores.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))   # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn(
        "rank", (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_before", "_place")


def draw(weights: DataFrame, id_column: str = "doc_id", percent: int = PERCENT, least: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``weights`` with ``score`` and ``rank``: the draw of ``percent`` of the documents of at least ``least`` words; null if not drawn."""
    doc_id = F.col(f"row.`{id_column}`")
    scored = written(row_ids(weights.withColumn("score", F.col("weight") + noise(doc_id, seed))), "scores")
    open_ = scored.filter(F.col("n_words") >= least).select("uid", "score", doc_id.alias("id"))
    drawn = open_.count() * percent // 100
    places = ranked(open_, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("uid")]).filter(F.col("rank") <= drawn)
    return scored.join(places.select("uid", "rank"), "uid", "left").drop("uid")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The drawn documents, columns as they came."""
    return draw(weighted(docs, target, **options), percent=percent).filter("rank IS NOT NULL").select("row.*")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: features, weight, score, rank."""
    got = draw(weighted(docs, target, keep=["doc_id"]))
    return got.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
# the checksum byte by byte, from a table made by its rule; each distinct feature once
SQL = f"""WITH t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
 FROM (SELECT unnest(range(0, 256)) AS i))),
d AS (SELECT rid, doc_id, len(w) AS n_words, {_RUNS} AS f FROM (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT {_RUNS} AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
df AS (SELECT rid, unnest(f) AS f FROM d), bf AS (SELECT unnest(f) AS f FROM b),
k AS (SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), t),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket), o AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
c AS (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(range(0, {BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN o USING (bucket)),
a AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM c),
g AS (SELECT bucket, CAST(floor(1000.0E0 * ln(((CAST(t AS DOUBLE) + 1) * (all_s + {BUCKETS})) / ((CAST(s AS DOUBLE) + 1) * (all_t + {BUCKETS})))) AS BIGINT) AS gain FROM c, a),
m AS (SELECT rid, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, n_words, CAST(len(f) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
 FROM d LEFT JOIN m USING (rid)),
y AS (SELECT *, weight + CAST(floor(-1000.0E0 * ln(-ln((h + 0.5E0) / 4294967296.0E0))) AS BIGINT) AS score FROM x),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM y WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * {PERCENT} // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (rid)"""
