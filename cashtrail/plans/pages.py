"""A page of an ordered table without numbering the table.

A histogram of the leading order key, counted map-side, tells which values hold the page's borders; it is refined inside those values
until few rows are left, and only they are put in order and numbered. Rows equal in the leading key that no histogram can part are
numbered by :class:`Ordered`, whatever their number. Each refinement is one scan whose filter reaches the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import Ordered

BINS = 1_024
FEW = 10_000            # rows that are numbered at once without refining further


def _value(rows: DataFrame, key: str) -> Column:
    """The key as a double in the order of the sort: nulls first, not-a-number last."""
    v = F.col(f"`{key}`").cast("double")
    return F.when(v.isNull(), -math.inf).when(F.isnan(v), math.inf).otherwise(v)


def numbered_slice(rows: DataFrame, order: list[str], offset: int, limit: int, name: str = "pos", few: int = FEW) -> tuple[DataFrame, int]:
    """(rows offset + 1 .. offset + limit in order with their 1-based position, number of all rows).

    ``order`` begins with a number and ends in a unique column.
    """
    v = _value(rows, order[0])
    finite = F.when((v > -math.inf) & (v < math.inf), v)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    total, before, size, now = int(whole.n), 0, int(whole.n), rows
    lo, hi = (0.0, 0.0) if whole.lo is None else (whole.lo, whole.hi)
    first, last = offset + 1, min(offset + limit, total)
    while size > max(few, 2 * limit) and first <= last:
        place = F.least(F.lit(BINS - 1), F.floor((v - lo) / (hi - lo) * BINS)) if hi > lo else F.lit(0)
        bin_ = F.when(v == -math.inf, -1).when(v == math.inf, BINS).otherwise(place.cast("int"))
        found = now.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()      # at most BINS + 2 rows
        upto, kept = before, []
        for r in sorted(found, key=lambda r: r.bin):
            if upto < last and upto + r.n >= first:
                kept.append((upto, r))
            upto += r.n
        left = sum(r.n for _, r in kept)
        if left == size:
            break                                           # one value, or the page spans them all
        before, size, lo, hi = kept[0][0], left, kept[0][1].lo, kept[-1][1].hi
        now = now.filter((v >= lo) & (v <= hi))
        lo, hi = max(lo, -1.7e308), min(hi, 1.7e308)
    placed = Ordered(now, [], order, (size, size)).numbered(name).plain().withColumn(name, F.col(name) + before)
    return placed.filter((F.col(name) >= first) & (F.col(name) <= last)), total
