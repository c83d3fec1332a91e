"""Periodic runs of words by an enhanced suffix array.

Words are numbered, and the suffixes of the numbers are sorted by prefix doubling; the ranks of every doubling round are kept.
They give the common prefix of neighbouring suffixes, and with the nearest smaller common prefixes on both sides every LCP
interval as two bounds and a depth: no tree nodes are built. Two suffixes of different children of an interval of depth d agree in exactly
d words, so where they start d words apart they begin a square that cannot be rotated to the right. For each interval the suffixes of all children but the
largest are tested, i by whether the inverse array puts i + d or i - d into the interval; that is n log n tests in
all. A square found is rotated to the left as far as it goes, by the kept ranks, and gives the run it belongs to; of equal stretches the
smallest period stays. All steps are array operations over a piece of many documents; a document is never cut.

Defined results: a null or blank text has no words and no runs; a document whose id is null is analysed as it is, like one whose
checksum asks for no repetition; repeated rows are reported each; an empty table gives no rows; columns may have any names. A document is
held whole by one task, as a run may span all of it: some 200 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import packed, text_of

MIN_WORDS = 12          # shortest run
PIECE = 1 << 17         # words that are sorted together; a longer document is a piece of its own
RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "runs array<struct<start:bigint,length:bigint,period:bigint>>")
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def suffix_ranks(symbols: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, .. symbols, until all differ; ``left[i]``: symbols from i to its document's end.

    No symbol occurs in two documents, so that suffixes of different documents differ at once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    ranks, k = [rank.astype(np.int32)], 1
    sizes = np.diff(np.append(np.flatnonzero(first), n))
    open_ = order[np.repeat(sizes > 1, sizes)]
    while len(open_):
        after = np.where(left[open_] > k, rank[np.minimum(open_ + k, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], key[1:] // (n + 1) != key[:-1] // (n + 1)])
        at = np.flatnonzero(first)
        base = np.flatnonzero(group)[np.cumsum(group)[at] - 1]              # where the old group of each new one begins
        sizes = np.diff(np.append(at, len(open_)))
        rank[open_] = np.repeat(rank[open_[base]] + at - base, sizes)
        ranks.append(rank.astype(np.int32))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        k *= 2
    return ranks


def common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes i and j share (i <> j, same document)."""
    length, last = np.zeros(len(i), np.int64), len(ranks[0]) - 1
    for level in range(len(ranks) - 1, -1, -1):
        a, b = i + length, j + length
        ok = np.minimum(left[i], left[j]) > length
        same = ok & (ranks[level][np.minimum(a, last)] == ranks[level][np.minimum(b, last)])
        length += np.where(same, 1 << level, 0)
    return np.minimum(length, np.minimum(left[i], left[j]))


def backward(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Symbols before i that equal those before j > i; ``begin``: first place of the document."""
    length = np.zeros(len(i), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        a, b = i - length - (1 << level), j - length - (1 << level)
        same = (a >= begin) & (ranks[level][np.maximum(a, 0)] == ranks[level][np.maximum(b, 0)])
        length += np.where(same, 1 << level, 0)
    return length


def _reach(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last places before and first places after ``at`` with a smaller value, by minima over blocks of 1, 2, 4, .. places.

    ``lcp`` begins and ends with -1.
    """
    n, levels = len(lcp), [lcp]
    while len(levels[-1]) > (1 << (len(levels) - 1)) and np.any(levels[-1] > 0):        # a block of zeros stops every walk
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    value = lcp[at]
    low, high = at.copy(), at.copy()                        # everything in low..high is known to be at least value
    for k in range(len(levels) - 1, -1, -1):
        step, table = 1 << k, levels[k]
        a = low - step
        low = np.where((a >= 0) & (table[np.maximum(a, 0)] >= value), a, low)
        b = high + 1
        high = np.where((b + step <= n) & (table[np.minimum(b, len(table) - 1)] >= value), high + step, high)
    return low - 1, high + 1


def squares(ranks: list[np.ndarray], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that cannot be rotated to the right."""
    isa = ranks[-1].astype(np.int64)
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    same = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]])
    lcp = np.full(n + 1, 0, np.int64)
    lcp[0] = lcp[n] = -1
    lcp[same + 1] = common(ranks, sa[same], sa[same + 1], left)
    split = np.flatnonzero(lcp > 0)                         # a split p parts the suffixes p - 1 and p
    low, high = _reach(lcp, split)                          # interval: suffixes low .. high - 1
    depth = lcp[split]
    order = np.lexsort((split, low, depth))
    split, low, high, depth = split[order], low[order], high[order], depth[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])]) if len(split) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(split) else new
    # each split closes the child on its left; the last one of an interval has a child on its right as well
    begin = np.concatenate([np.where(new, low, np.roll(split, 1)), split[last]])
    end = np.concatenate([split, high[last]])
    node = np.concatenate([np.cumsum(new) - 1, np.arange(new.sum())]).astype(np.int64)
    low, high, depth = low[new], high[new], depth[new]
    size = end - begin
    order = np.lexsort((-size, node))
    begin, size, node = begin[order], size[order], node[order]
    small = np.concatenate([[False], node[1:] == node[:-1]]) if len(node) else np.zeros(0, bool)     # all but the largest child
    begin, size, node = begin[small], size[small], node[small]
    found_i, found_d = [], []
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 4 * n, 4 * n)[1:])
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(size)]])):      # tests in bounded slices
        if a == b:
            continue
        s, d = size[a:b], depth[node[a:b]]
        place = np.repeat(begin[a:b] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
        of = np.repeat(np.arange(a, b), s)
        i, d = sa[place], np.repeat(d, s)
        for sign in (1, -1):
            j = i + sign * d
            ok = (j >= 0) & (j < n)
            to = isa[np.clip(j, 0, n - 1)]
            ok &= (to >= low[node[of]]) & (to < high[node[of]]) & ((to < begin[of]) | (to >= begin[of] + size[of]))
            found_i.append(np.minimum(i, j)[ok])
            found_d.append(d[ok])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(found_i), np.concatenate(found_d)], 1), axis=0)
    return both[:, 0], both[:, 1]


def runs_of(numbers: list[np.ndarray], least: int = MIN_WORDS) -> list[np.ndarray]:
    """Per document (array of word numbers from 0) its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(w) for w in numbers], np.int64)
    n, ends = int(sizes.sum()), np.cumsum(sizes)
    none = np.zeros((0, 3), np.int64)
    if not n:
        return [none] * len(numbers)
    shift = np.concatenate([[0], np.cumsum([int(w.max()) + 1 if len(w) else 0 for w in numbers])[:-1]])
    symbols = np.concatenate(numbers).astype(np.int64) + np.repeat(shift, sizes)
    end = np.repeat(ends, sizes)
    left = end - np.arange(n)
    ranks = suffix_ranks(symbols, left)
    start, period = squares(ranks, left)
    stop = start + 2 * period
    first = start - backward(ranks, start, start + period, (end - np.repeat(sizes, sizes))[start])
    order = np.lexsort((period, stop, first))
    first, stop, period = first[order], stop[order], period[order]
    keep = np.concatenate([[True], (first[1:] != first[:-1]) | (stop[1:] != stop[:-1])])[:len(first)]
    keep &= stop - first >= np.maximum(least, 2 * period)
    first, stop, period = first[keep], stop[keep], period[keep]
    doc = np.searchsorted(ends, first, "right")
    rows = np.stack([first - (ends - sizes)[doc], stop - first, period], 1) if len(first) else none
    order = np.lexsort((rows[:, 2], rows[:, 0], doc))
    return np.split(rows[order], np.searchsorted(doc[order], np.arange(1, len(numbers))))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay when every run is cut down to its first period."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, runs[:, 0] + runs[:, 2], 1)
    np.add.at(delta, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(delta[:n]) == 0


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's edit: where the checksum of the id ends in 0, the words from some place on repeat with some period."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def _answer(words: list[bytes], runs: np.ndarray) -> tuple:
    text = b" ".join(words)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs.tolist())
    digest = hashlib.sha256(listed.encode()).hexdigest()
    if not len(runs):
        return (0, None, None, None, None, digest, hashlib.sha256(text).hexdigest(), [])
    s, length, q = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
    kept = kept_words(len(words), runs)
    text = b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])
    rows = [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()]
    return (len(runs), s, length, q, 1000 * length // q, digest, hashlib.sha256(text).hexdigest(), rows)


def _numbers(words: list[bytes]) -> np.ndarray:
    seen = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def pieces(batches: Iterable[pa.RecordBatch], words: str = "text") -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with the words of their texts, about ``PIECE`` words each; a longer document is a slice of its own."""
    for batch in batches:
        column, at, held, size = batch.column(words), 0, [], 0
        for i in range(len(column)):
            held.append((column[i].as_py() or "").encode().split())
            size += len(held[-1])
            if size >= PIECE or i == len(column) - 1:
                yield batch.slice(at, i + 1 - at), held
                at, held, size = i + 1, [], 0


def find(docs: DataFrame, edit_by: str | None = None) -> DataFrame:
    """``row`` (the whole input row) and its runs: count, the longest one, digests, all runs.

    ``edit_by``: id column by whose checksum texts are edited first (the query's planted repetitions).
    """
    key = F.col(f"row.`{edit_by}`").cast("long") if edit_by else F.lit(None).cast("long")
    rows = packed(docs).select("row", text_of().alias("text"), key.alias("key"))
    listed = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [listed]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in pieces(batches):
            words = [repeated(w, i) for w, i in zip(held, part.column("key").to_pylist(), strict=True)]
            answers = [_answer(*a) for a in zip(words, runs_of([_numbers(w) for w in words]), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*answers, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], ["row", *NAMES])

    return rows.mapInArrow(found, StructType([rows.schema["row"], *StructType.fromDDL(RESULT).fields]))


def report(docs: DataFrame) -> DataFrame:
    """One row per document of the edited texts."""
    found = find(docs.select("doc_id", "text"), edit_by="doc_id")
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), *NAMES[:-1])
