"""Best-fit packing by minimum bin slack.

Every document becomes token ids plus an end id; documents longer than a sequence are cut into full pieces and a rest.
Pieces are dealt by a random row id into groups of bounded size. A group fills one bin at a time: the longest piece left is
fixed, then a bitset subset-sum over the lengths left, longest first, finds the fullest feasible combination,
which is removed. Sequences that keep slack are broken up and packed once more across groups, so what a group leaves
open is not lost. Ids never travel: a row carries place, length and checksum of its piece.

Defined results: a null text is empty and gives one piece of the end id alone; repeated rows (also equal ids) are packed
each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .common import held, packed, row_ids, text_of
from .word_ids import Encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAX_TOKENS = 4096
GROUP_PIECES = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_lists(found: Iterable[np.ndarray], most: int) -> pa.Array:
    """Place, length and checksum of every piece of each text, by its ids."""
    lengths, sums = [], []
    for ids in found:
        data = memoryview(ids.astype("<u4", copy=False)).cast("B")
        lengths.append(len(ids))
        sums += [zlib.crc32(data[4 * i:4 * (i + most)]) for i in range(0, len(ids), most)]
    length = np.array(lengths, np.int64)
    count = -(-length // most)
    at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    piece = (np.arange(at[-1]) - np.repeat(at[:-1], count)).astype(np.int32)
    start = piece.astype(np.int64) * most
    size = np.minimum(most, np.repeat(length, count) - start)
    rows = pa.StructArray.from_arrays([pa.array(piece), pa.array(start), pa.array(size), pa.array(sums, pa.int64())], ["piece", "start", "length", "ids_crc32"])
    return pa.ListArray.from_arrays(pa.array(at), rows)


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its memory of words outlives a task."""
    return held((Encoder, path), lambda: Encoder(path, END_ID))


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = MAX_TOKENS) -> DataFrame:
    """One row per piece of every document."""
    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(texts: pa.Array) -> pa.Array:
        return piece_lists(encoder(public_tokenizers.path(vocabulary))(texts), most)

    rows = packed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), cut(text_of()).alias("found"))
    return rows.select("doc_id", F.inline("found"))


def fill_bins(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Minimum bin slack: lists of positions, one per bin.

    The bitset of reachable sums grows by one length at a time; it is kept after each step, so the combination is read
    back by walking the steps in reverse. It ends early once the bin can be filled exactly.
    """
    stock: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        stock.setdefault(int(lengths[i]), []).append(i)
    order = sorted(stock, reverse=True)
    bins = []
    while order:
        first = order[0]
        bin_, room = [stock[first].pop()], most - first
        steps, reach, full = [], 1, 1 << room
        mask = (full << 1) - 1
        if room:
            for length in order:
                if length > room:
                    continue
                for _ in range(min(len(stock[length]), room // length)):
                    grown = (reach | reach << length) & mask
                    if grown == reach:
                        break
                    steps.append((length, reach))
                    reach = grown
                    if reach & full:
                        break
                if reach & full:
                    break
        left = reach.bit_length() - 1
        for length, before in reversed(steps):
            if not before >> left & 1:                      # this sum needs the length of this step
                bin_.append(stock[length].pop())
                left -= length
        bins.append(bin_)
        if any(not stock[x] for x in {first, *(s[0] for s in steps)}):
            order = [x for x in order if stock[x]]
    return bins


def _pack_group(most: int, round_: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = g["length"].to_numpy()
        sequence, offset, slack = (np.zeros(len(g), "int64") for _ in range(3))
        base = ((int(g["part"].iloc[0]) * 2 + round_) << 32)
        for k, members in enumerate(fill_bins(lengths, most)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
            slack[members] = most - at
        return g.assign(sequence_id=sequence, offset=offset, slack=slack)
    return pack


def pack(found: DataFrame, most: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id, offset and the sequence's slack."""
    shape = "uid long, part long, " + PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long, slack long"

    def dealt(rows: DataFrame, count: int, round_: int) -> DataFrame:
        parts = max(1, -(-count // group_pieces))
        keyed = rows.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(parts)))
        columns = ["uid", "part", *[c.split()[0] for c in PIECES.split(", ")]]
        keyed = keyed.select(*columns).withColumn("doc_id", F.col("doc_id").cast("string"))   # pandas has no null integers
        return keyed.groupBy("part").applyInPandas(_pack_group(most, round_), shape)

    stored = written(row_ids(found), "pieces")
    first = written(dealt(stored, stored.count(), 0), "packed")
    open_ = first.filter("slack > 0")
    second = dealt(open_, open_.count(), 1)
    return first.filter("slack = 0").unionByName(second).drop("uid", "part").withColumn("doc_id", F.col("doc_id").cast("long"))
