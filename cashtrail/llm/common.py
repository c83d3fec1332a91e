"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 21       # text that a Python worker works on at once; a longer text is a slice of its own
BATCH_ROWS = 1_000          # texts that travel to a Python worker at once
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

T = TypeVar("T")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(rows: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``: work columns beside it can never clash with the caller's names."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def text_of(column: str = "text") -> Column:
    """The text inside ``row``; null counts as empty."""
    return F.coalesce(F.col(f"row.`{column}`").cast("string"), F.lit(""))


def holdout(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def words(text: Column) -> Column:
    """Words between ASCII white space, A-Z lowered; empty pieces at the ends may occur."""
    return F.split(F.translate(text, UPPER, LOWER), "[\\x20\\x09-\\x0D]+")


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, one thing at a time: workers outlive a stage, and the next one needs the memory."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def row_ids(rows: DataFrame, name: str = "uid") -> DataFrame:
    """A row id, fixed once the result is written: repeated rows stay apart."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def by_slices(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """``work`` over slices of the Arrow batches, cut by the bytes of ``text``: neither a batch's results nor its arrays are held together.

    Whole texts are long rows, so the session's batches are brought down to ``BATCH_ROWS`` if they are longer; results do not depend on it.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                yield work(batch.slice(at, end - at))
                at = end
            pa.default_memory_pool().release_unused()
    return rows.mapInArrow(sliced, schema)
