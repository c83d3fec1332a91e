"""Near-duplicate vectors by sorted projection passes.

Every pass hashes each vector with ``KEY_BITS`` random hyperplanes, strings the signs together and sorts the table by them; a vector is compared
with the ``WINDOW`` next ones in that order, in double precision on the original components. Verified pairs of all passes are united. The
number of passes follows from the row count: two vectors at the wanted cosine lie in one window of a pass if they agree in the
bits that part the table into windows, and as many passes are made as leave at most ``MISS`` of such pairs unseen. Nearer pairs are
missed far more rarely, and a group is found whole if any chain of its pairs is.

Sorting is by ranges of (pass, key, row). A range is read as a stream, so that no task holds it; its first and last ``WINDOW`` rows are written, and
windows that cross a border are compared there. A piece of a range returns a spanning forest of its links, so that a
tight group costs a row a vector and pass and not its pairs. Windows bound only the search: within every component all links are counted. Vectors
closer to the component's mean direction than half the wanted angle are linked with each other for sure; the others
are compared with the whole component in blocks of ``BLOCK`` rows, and blocks return counts. So a group of copies costs time in proportion,
and only what lies between half the angle and the angle, time that grows with its number times the group's.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; shorter vectors count as padded with
zeros; repeated rows are vectors of their own (equal ones are linked); a null id is never the smallest unless alone, and ``kept`` of rows
with equal ids is equal; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .ann import valid
from .common import packed, row_ids
from .components import components

THRESHOLD = 0.95        # cosine of linked vectors
WINDOW = 256            # following rows that a row is compared with
MISS = 0.003            # share of pairs just at the threshold that all passes may leave unseen
KEY_BITS, SEED = 64, 23
BLOCK = 1024            # rows of a component that are compared at once
SURE = 1e-9             # margin, in cosine, of links that are taken for sure
LINK, HEAD, TAIL = 0, 1, 2


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold is unseen with at most the chance ``miss``."""
    bits = max(0.0, math.log2(max(rows, 1) / window))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if together >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first so that no square under- or overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keys(vectors: np.ndarray, pass_: int, seed: int = SEED) -> np.ndarray:
    """Signs of random projections, strung together; sorted as numbers they are sorted lexicographically."""
    planes = np.random.default_rng([seed, pass_, vectors.shape[1]]).standard_normal((vectors.shape[1], KEY_BITS))
    return np.packbits(vectors @ planes >= 0, axis=1).view(">i8")[:, 0].astype(np.int64)


def window_links(x: np.ndarray, group: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, at most ``window`` apart, whose unit vectors reach the threshold."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(x), window):
        i, j = np.nonzero(x[a:a + window] @ x[a:a + 2 * window].T >= threshold)
        ok = (j > i) & (j - i <= window)
        i, j = i[ok] + a, j[ok] + a
        ok = group[i] == group[j]
        left.append(i[ok])
        right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


def forest(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked row's name and the smallest name it is linked to over any path, itself left out."""
    least = names.copy()
    while True:
        low = np.minimum(least[i], least[j])
        before = least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if np.array_equal(before, least):
            break
    some = np.flatnonzero(least != names)
    return names[some], least[some]


def _found(a, b, side: int, place=None, pass_=None, v=None) -> pa.RecordBatch:
    n = len(a)
    none = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), none(pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(np.full(n, side), pa.int32()),
         pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()), none(pa.int64()) if place is None else pa.array(place, pa.int64()),
         none(pa.int32()) if pass_ is None else pa.array(pass_, pa.int32()), none(pa.binary()) if v is None else pa.array(v, pa.binary())],
        ["a", "b", "side", "chunk", "place", "pass", "v"])


def pair_up(rows: DataFrame, kind: str, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """Links (a, b) of ``rows`` (uid, v: binary of numbers ``kind``) that join whatever the passes found linked."""
    passes = passes_for(rows.count(), threshold, window, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.frombuffer(v, kind) for v in batch.column("v").to_pylist()]) if len(batch) else np.zeros((0, 1))
            for p in range(passes if len(batch) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p), pa.int32()), pa.array(keys(x, p, seed), pa.int64()), *batch.columns],
                                                 ["pass", "key", *batch.schema.names])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, group, held, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            if not len(batch):
                continue
            vs = batch.column("v").to_pylist()
            uid, of = batch.column("uid").to_numpy(), batch.column("pass").to_numpy()
            if seen < window:
                few = window - seen
                yield _found(uid[:few], None, HEAD, np.arange(seen, seen + len(uid[:few])), of[:few], vs[:few])
            names, group, held = np.concatenate([names, uid]), np.concatenate([group, of]), held + vs
            x = units(np.stack([np.frombuffer(v, kind) for v in held]))
            yield _found(*forest(names, *window_links(x, group, window, threshold)), LINK)
            seen += len(uid)
            names, group, held = names[-window:], group[-window:], held[-window:]
        if seen:
            yield _found(names, None, TAIL, np.arange(seen - len(names), seen), group, held)

    order = ["pass", "key", "uid"]
    ordered = rows.mapInArrow(hashed, "pass int, key long, uid long, v binary").repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(compared, "a long, b long, side int, chunk int, place long, pass int, v binary"), "windows")

    chunks = found.filter(F.col("side") == HEAD).select("chunk").distinct()                      # a row a range
    chunks = chunks.withColumn("border", F.row_number().over(Window.orderBy("chunk")))
    ends = found.filter(F.col("side") != LINK).join(F.broadcast(chunks), "chunk")
    ends = ends.withColumn("border", F.when(F.col("side") == TAIL, F.col("border")).otherwise(F.col("border") - 1))

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "place"], ascending=[False, True])                 # the end of one range, then the head of the next
        x = units(np.stack([np.frombuffer(v, kind) for v in rows["v"]]))
        a, b = forest(rows["a"].to_numpy(), *window_links(x, rows["pass"].to_numpy(), window, threshold))
        return pd.DataFrame({"a": a, "b": b})

    crossing = ends.groupBy("border").applyInPandas(across, "a long, b long")
    return found.filter(F.col("side") == LINK).select("a", "b").unionByName(crossing).distinct()


def link_counts(members: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(uid, n_links) over all pairs within each component of ``members`` (component, uid, v: array of doubles of one length)."""
    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = units(np.array(batch.column("v").to_pylist(), np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("uid"), lists], ["component", "uid", "v"])

    members = members.mapInArrow(scaled, "component long, uid long, v array<double>")       # here, so that only linked vectors are scaled
    mean = members.groupBy("component").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean"))
    off = F.aggregate(F.zip_with("v", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.sqrt(
        F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    core = F.coalesce(off >= math.sqrt((1 + threshold) / 2) + SURE, F.lit(False))
    placed = written(members.join(mean, "component").select("component", "uid", "v", core.alias("core")), "members")
    sizes = written(placed.groupBy("component").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest")), "sizes")
    sure = placed.filter("core").join(sizes, "component").select("uid", (F.col("n_core") - 1).alias("n"))

    parts = sizes.filter("n_rest > 0").select("component", F.ceil(F.col("n_rest") / block).cast("int").alias("na"),
                                              F.ceil((F.col("n_core") + F.col("n_rest")) / block).cast("int").alias("nb"))
    part = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    open_ = placed.join(parts, "component")
    rest = open_.filter("NOT core").withColumn("pa", part("na")).withColumn("pb", every("nb")).select("component", "pa", "pb", "uid", "v")
    whole = open_.withColumn("pb", part("nb")).withColumn("pa", every("na")).select(
        F.col("component").alias("of"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("uid").alias("other"), F.col("v").alias("w"), F.col("core").alias("sure"))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"uid": [], "n": []})
        linked = np.stack(list(left["v"])) @ np.stack(list(right["w"])).T >= threshold
        linked &= left["uid"].to_numpy()[:, None] != right["other"].to_numpy()
        core = right["sure"].to_numpy(bool)
        return pd.DataFrame({"uid": np.concatenate([left["uid"], right["other"][core]]), "n": np.concatenate([linked.sum(1), linked[:, core].sum(0)])})

    checked = rest.groupBy("component", "pa", "pb").cogroup(whole.groupBy("of", "qa", "qb")).applyInPandas(count, "uid long, n long")
    return sure.unionByName(checked).groupBy("uid").agg(F.sum("n").alias("n_links"))


def deduplicate(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``row`` (the whole input row) with n_links, component_id and kept."""
    kind = vectors.schema[vector].dataType.simpleString()
    kind = "<f4" if kind == "array<float>" else "<f8"
    v = F.col(f"row.`{vector}`")
    rows = written(row_ids(packed(vectors).withColumn("ok", valid(v)).withColumn("id", F.col(f"row.`{id_column}`").cast("long"))), "vectors")
    size = rows.filter("ok").agg(F.max(F.size(v)).alias("n")).first()["n"] or 1

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v").to_pylist():
                padded = np.zeros(size, kind)
                padded[:len(x)] = x
                out.append(padded.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(out, pa.binary())], ["uid", "v"])

    numbers = rows.filter("ok").select("uid", v.cast("array<double>").alias("v"))
    found = written(components(pair_up(numbers.mapInArrow(raw, "uid long, v binary"), kind, threshold, **options)), "components")
    wide = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))
    members = numbers.join(found, F.col("uid") == F.col("node")).select("component", "uid", wide.alias("v"))
    counts = link_counts(members, threshold)
    named = rows.select("uid", "id").join(found, F.col("uid") == F.col("node")).select("component", "uid", "id")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = named.join(least, "component").join(counts, "uid").select("uid", "n_links", "component_id", F.lit(True).alias("_linked"))
    component = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("id"))
    return rows.join(linked, "uid", "left").select("row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                                                   component.eqNullSafe(F.col("id")).alias("kept"))


def report(vectors: DataFrame) -> DataFrame:
    """One row per vector."""
    found = deduplicate(vectors.select("vec_id", "embedding"))
    return found.select(F.col("row.vec_id").cast("long").alias("vec_id"), "n_links", "component_id", "kept")
