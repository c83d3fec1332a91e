"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts: one of words that toxic texts use far more often than ordinary ones
(by likelihood ratio), one of the commonest words of ordinary texts. A window is one word of the text, four times
over, so that the fixed costs of a frame weigh little. It counts as a hit where the toxic dictionary compresses it to at most
``short`` bytes and at least ``margin`` bytes shorter than the ordinary one does; both thresholds and the number of hits that
makes a text toxic are calibrated on the training texts. A text's score is the training share of toxic texts with as many hits.

Bounds (documented parameters): the fit uses at most ``SAMPLE`` labelled texts of each class, chosen by a hash of the id, and
dictionaries of at most ``TOXIC_WORDS`` and ``PLAIN_WORDS`` words. Scoring covers every window of every whole text. Labels are
learnt only where crc32 of the id modulo 5 is not 0; labels, language, source and id are no inputs of a score.

Defined results: a null or empty text has no window and scores as a text without hits; null labels are ignored; a label row without
a document, or a second one, changes nothing but its weight in the fit; without toxic labels every score is 0; equal texts
score equally; repeated rows stay; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_slices, held, holdout, packed, text_of

SAMPLE = 4_000
TOXIC_WORDS, PLAIN_WORDS = 2_000, 4_000
LEAST_RATIO = 20.0                  # likelihood ratio (chi-square scale) of a word in the toxic dictionary
LEVEL = 19
MOST_HITS = 8
REMEMBERED = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str) -> set[str]:
    """Distinct runs of letters, in lower case."""
    return set(_WORD.findall(text.lower()))


def payload(word: str) -> bytes:
    return ((" " + word) * 4 + " ").encode()


class Gauge:
    """Compressed lengths of windows under both dictionaries."""

    def __init__(self, toxic: list[str], plain: list[str]):
        def compressor(words: list[str]):
            content = b"".join(payload(w) for w in reversed(words))     # the most telling words last: nearest to the window
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)
        self.toxic, self.plain = compressor(toxic), compressor(plain)
        self.known: dict[tuple[int, str], int] = {}

    def margin(self, word: str, short: int) -> int:
        """How much longer the ordinary dictionary leaves the window; 0 unless the toxic one gets it to ``short`` bytes."""
        got = self.known.get((short, word))
        if got is None:
            data = payload(word)
            length = len(self.toxic.compress(data))
            got = len(self.plain.compress(data)) - length if length <= short else 0
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[(short, word)] = got
        return got

    def lengths(self, word: str) -> tuple[int, int]:
        data = payload(word)
        return len(self.toxic.compress(data)), len(self.plain.compress(data))


def gauge(toxic: tuple[str, ...], plain: tuple[str, ...]) -> Gauge:
    """One per Python worker and fit, so that its memory of words outlives a task."""
    return held((Gauge, toxic, plain), lambda: Gauge(list(toxic), list(plain)))


@dataclass(frozen=True)
class Model:
    toxic: tuple[str, ...]
    plain: tuple[str, ...]
    short: int
    margin: int
    shares: tuple[float, ...]       # score by number of hits, the last for that many or more

    def hits(self, text: str) -> int:
        if not self.toxic:
            return 0
        g = gauge(self.toxic, self.plain)
        return sum(g.margin(w, self.short) >= self.margin for w in windows(text))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``size`` training texts of each class."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & (holdout(F.col("id")) != 0))
    order = F.md5(F.col("id").cast("string").cast("binary"))
    picked = known.filter("toxic = 1").orderBy(order).limit(size).unionByName(known.filter("toxic = 0").orderBy(order).limit(size))
    rows = packed(docs).select(F.col("row.doc_id").cast("long").alias("id"), text_of().alias("text"))
    return rows.join(F.broadcast(picked), "id").select("text", "toxic")     # 2 x size rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Dictionaries, thresholds and shares from the training sample."""
    chosen = sample(docs, labels, size).persist()

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(windows(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    try:
        n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
        bad, fine = n.get(1, 0), n.get(0, 0)
        if not bad:
            return Model((), (), 0, 0, (0.0,))
        words = chosen.select("toxic", F.explode(split("text")).alias("word")).groupBy("word").agg(
            F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        expected = lambda share: (F.col("a") + F.col("b")) * F.lit(share / (bad + fine))
        term = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / expected(share))).otherwise(0.0)
        ratio = words.withColumn("g", 2 * (term("a", bad) + term("b", fine))).withColumn("more", F.col("a") * fine > F.col("b") * bad)
        telling = ratio.filter(F.col("more") & (F.col("g") >= LEAST_RATIO)).orderBy(F.desc("g"), "word").limit(TOXIC_WORDS).collect()
        toxic = tuple(r["word"] for r in telling)
        if not toxic:
            return Model((), (), 0, 0, (bad / (bad + fine),))
        common = ratio.filter(~F.col("word").isin(*toxic) if len(toxic) < 200 else ~(F.col("more") & (F.col("g") >= LEAST_RATIO)))
        plain = tuple(r["word"] for r in common.orderBy(F.desc("b"), "word").limit(PLAIN_WORDS).collect())

        @F.arrow_udf("array<struct<a:int,d:int>>")
        def measured(texts: pa.Array) -> pa.Array:
            g, out = gauge(toxic, plain), []
            for t in texts.to_pylist():
                both = [g.lengths(w) for w in windows(t)]
                out.append([{"a": a, "d": b - a} for a, b in both if b - a > 0])
            return pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("d", pa.int32())])))

        rows = chosen.select("toxic", measured("text").alias("m")).collect()      # of the bounded sample, numbers only
    finally:
        chosen.unpersist()
    return calibrate(toxic, plain, np.array([r["toxic"] for r in rows]), [[(x["a"], x["d"]) for x in r["m"]] for r in rows])


def calibrate(toxic: tuple[str, ...], plain: tuple[str, ...], labels: np.ndarray, measured: list[list[tuple[int, int]]]) -> Model:
    """The thresholds of the best F1 over the training texts, and the shares of toxic texts by hits."""
    best = (-1.0, 0, 0, 1)
    doc = np.repeat(np.arange(len(measured)), [len(m) for m in measured])
    a = np.array([x for m in measured for x, _ in m], int)
    d = np.array([x for m in measured for _, x in m], int)
    for short in range(9, 25):
        for margin in range(1, 9):
            hits = np.bincount(doc[(a <= short) & (d >= margin)], minlength=len(labels))
            for least in (1, 2, 3):
                said = hits >= least
                f1 = 2 * (said & (labels == 1)).sum() / max(1, said.sum() + (labels == 1).sum())
                if f1 > best[0]:
                    best = (f1, short, margin, least)
    _, short, margin, least = best
    hits = np.minimum(np.bincount(doc[(a <= short) & (d >= margin)], minlength=len(labels)), MOST_HITS)
    shares = []
    for h in range(MOST_HITS + 1):
        n, t = (hits == h).sum(), ((hits == h) & (labels == 1)).sum()
        share = (t + 0.5) / (n + 1.0)
        share = min(share, 0.49) if h < least else max(share, 0.51)       # the threshold decides
        shares.append(max(share, shares[-1] if shares else 0.0))
    return Model(toxic, plain, short, margin, tuple(float(s) for s in shares))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the whole input row) and ``score``."""
    rows = packed(docs).select("row", text_of().alias("text"))
    shares = np.array(model.shares)

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.hits(t.as_py()) for t in part.column("text")]
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(shares[np.minimum(np.array(found, np.int64), len(shares) - 1)])], ["row", "score"])
    return by_slices(rows, score, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    doc_id = F.col("row.doc_id").cast("long")
    rows = scored(docs.select("doc_id", "text"), model).select(doc_id.alias("doc_id"), (holdout(doc_id) == 0).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not found toxic, columns as they came."""
    model = fit(docs, labels)
    return scored(docs, model).filter("score < 0.5").select("row.*")
