"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (three rounds of sign flips and fast Hadamard transforms) and hashed to the
nearest signed axis; two such axes are a code, and there are ``TABLES`` independent tables. A query probes its ``PROBES`` best
codes of every table, ranked by the sum of its two coordinates. All vectors of a probed code are candidates and are reranked
by their exact Euclidean distance in double precision.

Equal vectors are one index entry with its smallest ids, so a vector that a third of all rows share is compared once.
Entries and probes meet by (table, first axis); buckets above ``BLOCK`` entries are split by a hash, their probes go to each
part, and a part returns the best few of each query only. No candidate is left out.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; ties
go to the smaller vec_id; a candidate with the query's own id counts as its own row; repeated rows of an id are one
candidate each distance, the nearest; shorter vectors count as padded with zeros; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .common import packed

TABLES, PROBES, ROUNDS, SEED = 32, 128, 3, 11
BLOCK = 20_000
NEAREST = 10


def rotated(vectors: np.ndarray, table: int, axis: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-rotation of rows whose length is a power of two."""
    size = vectors.shape[1]
    signs = np.random.default_rng([seed, table, axis, size]).choice([-1.0, 1.0], (ROUNDS, size))
    out = vectors
    for r in range(ROUNDS):
        out, width = out * signs[r], 1
        while width < size:
            out = out.reshape(len(out), -1, 2, width)
            out = np.stack([out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]], 2).reshape(len(out), size)
            width *= 2
        out = out / np.sqrt(size)
    return out


def unit(vectors: list, size: int) -> np.ndarray:
    """Rows of length one, padded with zeros to the power of two ``size``."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        v = v / np.abs(v).max()                             # so that no square under- or overflows
        out[i, :len(v)] = v / np.sqrt(v @ v)
    return out


def axes(turned: np.ndarray) -> np.ndarray:
    """Nearest signed axis: 2 x axis, plus one if negative."""
    at = np.abs(turned).argmax(1)
    return 2 * at + (turned[np.arange(len(turned)), at] < 0)


def codes(units: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """rows x tables x 2."""
    return np.stack([np.stack([axes(rotated(units, t, k)) for k in (0, 1)], 1) for t in range(tables)], 1) if len(units) else np.zeros((0, tables, 2), int)


def probes(units: np.ndarray, table: int, most: int = PROBES) -> np.ndarray:
    """The best codes of each row in one table, as first axis x 2 size + second axis."""
    both = []
    for k in (0, 1):
        r = rotated(units, table, k)
        both.append(np.stack([r, -r], 2).reshape(len(r), -1))
    total = (both[0][:, :, None] + both[1][:, None, :]).reshape(len(units), -1)
    most = min(most, total.shape[1])
    return np.argpartition(-total, most - 1, axis=1)[:, :most]


def valid(v: Column) -> Column:
    """Usable components, not all of them zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest(index: pd.DataFrame, asked: pd.DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` nearest entries of one part of a bucket for each query whose probes hit them."""
    out = []
    if len(index) and len(asked):
        size = max(max(map(len, index["v"])), max(map(len, asked["q"])))
        pad = lambda rows: np.stack([np.pad(np.asarray(r, np.float64), (0, size - len(r))) for r in rows])
        entries, second, first_id = pad(index["v"]), index["y"].to_numpy(), np.array([m[0] for m in index["members"]])
        for query_id, q, ys in zip(asked["query_id"], pad(asked["q"]), asked["ys"], strict=True):
            at = np.flatnonzero(np.isin(second, ys))
            if len(at):
                distance = np.sqrt(((entries[at] - q) ** 2).sum(1))
                best = np.lexsort((first_id[at], distance))[:most]
                out += [(query_id, index["members"].iloc[i], d) for i, d in zip(at[best], distance[best], strict=True)]
    return pd.DataFrame(out, columns=["query_id", "members", "score"])


def search(vectors: DataFrame, every: int, k: int = NEAREST, tables: int = TABLES, most: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by ``every``."""
    rows = packed(vectors).select(F.col("row.vec_id").cast("long").alias("vec_id"), F.col("row.embedding").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    size = 1 << max(0, (longest - 1).bit_length())

    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))

    @F.arrow_udf("array<struct<t:int,x:int,y:int>>")
    def coded(vs: pa.Array) -> pa.Array:
        found = codes(unit(vs.to_pylist(), size), tables)
        flat = found.reshape(-1, 2)
        t = np.tile(np.arange(tables), len(found))
        kind = pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32())], ["t", "x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * tables, pa.int32()), kind)

    @F.arrow_udf("array<struct<t:int,x:int,ys:array<int>>>")
    def probed(vs: pa.Array) -> pa.Array:
        out = [[] for _ in range(len(vs))]
        units = unit(vs.to_pylist(), size)
        for t in range(tables):
            for i, found in enumerate(probes(units, t, most)):
                x, y = found // (2 * size), found % (2 * size)
                out[i] += [{"t": t, "x": int(a), "ys": y[x == a].tolist()} for a in np.unique(x)]
        return pa.array(out, pa.list_(pa.struct([("t", pa.int32()), ("x", pa.int32()), ("ys", pa.list_(pa.int32()))])))

    index = entries.select("v", "members", F.inline(coded("v")))
    asked = queries.select("query_id", "q", F.inline(probed("q")))
    buckets = written(index.groupBy("t", "x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "buckets")   # at most tables x 2 size rows
    spread = index.join(F.broadcast(buckets), ["t", "x"]).select(
        "t", "x", "y", "v", "members", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    sent = asked.join(F.broadcast(buckets), ["t", "x"]).select(
        "t", "x", "ys", "query_id", "q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    best = spread.groupBy("t", "x", "part").cogroup(sent.groupBy("t", "x", "part")).applyInPandas(
        lambda left, right: nearest(left, right, k + 1), "query_id long, members array<long>, score double")
    pairs = best.select("query_id", F.explode("members").alias("vec_id"), "score").filter("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, every: int, k: int = NEAREST) -> dict[int, list[int]]:
    """Exact neighbours, for measuring recall on small tables."""
    rows = vectors.filter(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in rows["embedding"]])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = ids[order].tolist()
    return out
