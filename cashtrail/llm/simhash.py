"""Document fingerprints by SimHash, in DataFrame functions only.

A term is a word with its successor; it weighs as often as it occurs. Each of its 128 hash bits votes for or against
that bit of the fingerprint. Eight bits are counted in one 64-bit sum, so 16 plain sums a term do the whole vote inside
hash aggregates. ``near_pairs`` finds all fingerprints within a Hamming radius by permuted block tables: the
128 bits fall into radius + 2 blocks, two fingerprints within the radius agree on at least two blocks, so each pair of blocks
is the key of one table, and the pair is reported only by the first table both share.

``with_next`` gives each document its successor in id order without a global sort in one task: chunk bounds are
quantiles of the ids, each chunk gets a copy of the first document of the chunk after it, and a window runs per chunk.

Defined results: a null text is empty; an empty text has an all-zero fingerprint; equal texts have equal fingerprints;
a null id sorts first; equal ids are ordered by a hash of their text, and repeated rows stay apart; a single document is
its own successor; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, text_of

BITS = 128
RADIUS = 6
CHUNKS_PER_PARTITION = 4


def with_next(rows: DataFrame, chunks: int | None = None) -> DataFrame:
    """``rows`` (doc_id long, text) with chunk, place (in the chunk), ghost, and the next document's text.

    A ghost is the copy of a chunk's successor: keep it while neighbours are compared, then drop it.
    """
    spark = rows.sparkSession
    n = chunks or CHUNKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    wide = max(1, round(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[::wide]]).cast("array<bigint>")
    every = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    above = lambda a: F.size(F.filter(a, lambda b: b < F.col("doc_id")))
    chunk = F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(
        F.lit(0), (above(coarse) - 1) * wide) + above(F.slice(every, F.greatest(F.lit(0), (above(coarse) - 1) * wide) + 1, wide)))
    keyed = rows.withColumn("chunk", chunk.cast("int")).withColumn("tie", F.xxhash64("text"))
    # the first row of each chunk becomes the ghost of the chunk before it (the first chunk's: of the last); one row a chunk
    first = keyed.groupBy("chunk").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "tie")).alias("first"))
    heads = sorted(first.collect(), key=lambda r: r["chunk"])
    homes = [(h["chunk"], h["first"]["id"], h["first"]["tie"], heads[i - 1]["chunk"]) for i, h in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(homes, "chunk int, first_id long, first_tie long, home int"))
    ghosts = keyed.join(table, "chunk").filter((F.coalesce("doc_id", F.lit(-(2**63))) == F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    ghosts = ghosts.dropDuplicates(["chunk"]).select("doc_id", "text", F.col("home").alias("chunk"), "tie", F.lit(True).alias("ghost"))
    both = keyed.select("doc_id", "text", "chunk", "tie", F.lit(False).alias("ghost")).unionByName(ghosts)
    order = Window.partitionBy("chunk").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tie")
    return both.select("doc_id", "text", "chunk", "ghost", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def votes(keys: list[str], text: Column, rows: DataFrame) -> DataFrame:
    """``keys`` with the two halves of the fingerprint of ``text``, a = bits 0-63 and b = bits 64-127.

    Runs of 127 terms are counted in 8 lanes of 8 bits a sum (the sign bit stays free), then runs are added up in 2 lanes of 32 bits.
    Where ``rows`` are already dealt by one of the keys nothing moves.
    """
    w = F.filter(F.split(text, "\\s+"), lambda x: x != "")
    split = rows.select(*keys, w.alias("x")).withColumn("y", F.slice("x", 2, F.size("x")))
    terms = split.select(*keys, F.posexplode_outer(F.arrays_zip("x", "y")).alias("at", "t"))
    there = F.when(F.col("t").isNull(), 0).otherwise(1)
    hashed = terms.select(*keys, F.floor(F.coalesce("at", F.lit(0)) / 127).alias("run"), there.cast("long").alias("there"),
                          F.xxhash64("t.x", "t.y").alias("h"), F.xxhash64(F.lit(7), F.col("t.x"), F.col("t.y")).alias("g"))
    mask = lambda m: F.lit(m).cast("long")
    fine = [F.sum(F.shiftrightunsigned(c, i).bitwiseAND(mask(0x0101010101010101))).alias(f"{c}{i}") for c in ("h", "g") for i in range(8)]
    runs = hashed.groupBy(*keys, "run").agg(F.sum("there").alias("n"), *fine)
    wide = [F.sum(F.shiftrightunsigned(f"{c}{i}", 8 * j).bitwiseAND(mask(0xFF000000FF))).alias(f"{c}{i}_{j}")
            for c in ("h", "g") for i in range(8) for j in range(4)]
    counted = runs.groupBy(*keys).agg(F.sum("n").alias("n"), *wide)

    def half(c: str) -> Column:
        bits = []
        for i in range(8):
            for j in range(4):                              # the lane of bit i + 8 j, and above it that of bit i + 8 j + 32
                low, high = F.col(f"{c}{i}_{j}").bitwiseAND(mask(0xFFFFFFFF)), F.shiftrightunsigned(f"{c}{i}_{j}", 32)
                for value, at in ((low, i + 8 * j), (high, i + 8 * j + 32)):
                    bits.append(F.when(2 * value > F.col("n"), mask(1 << at if at < 63 else -(2**63))).otherwise(mask(0)))
        return reduce(Column.bitwiseOR, bits)

    return counted.select(*keys, F.when(F.col("n") > 0, half("h")).otherwise(mask(0)).alias("a"), F.when(F.col("n") > 0, half("g")).otherwise(mask(0)).alias("b"))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Share of the 128 bits on which (a, b) and (c, d) agree."""
    return 1.0 - (F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))) / F.lit(float(BITS))


def spelled(a: Column, b: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(b)), 16, "0"), F.lpad(F.lower(F.hex(a)), 16, "0"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a, b of every document (row by row; repeated rows stay apart)."""
    rows = packed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("uid"))
    return votes(["uid", "doc_id"], F.col("text"), rows).drop("uid")


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b, c, d, distance) of distinct fingerprints at most ``radius`` bits apart, (a, b) < (c, d).

    The bits fall into radius + 2 blocks; two of them agree for every such pair. A table's key is two blocks.
    """
    n = radius + 2
    edges = [round(i * BITS / n) for i in range(n + 1)]

    def block(i: int) -> Column:
        """Bits edges[i] to edges[i+1] of the 128, from the two longs."""
        lo, hi = edges[i], edges[i + 1]
        parts = []
        for name, base in (("a", 0), ("b", 64)):
            s, e = max(lo, base), min(hi, base + 64)
            if s < e:
                bits = F.shiftrightunsigned(name, s - base).bitwiseAND(F.lit((1 << (e - s)) - 1 if e - s < 64 else -1).cast("long"))
                parts.append(F.shiftleft(bits, s - lo))
        return reduce(Column.bitwiseOR, parts)

    distinct = prints.select("a", "b").distinct().select("a", "b", F.array(*[block(i) for i in range(n)]).alias("blocks"))
    pairs = list(combinations(range(n), 2))
    keys = F.array(*[F.struct(F.lit(k).alias("table"), F.col("blocks")[i].alias("x"), F.col("blocks")[j].alias("y")) for k, (i, j) in enumerate(pairs)])
    tables = distinct.select("a", "b", "blocks", F.inline(keys))
    left, right = tables.alias("l"), tables.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("blocks").alias("others"), "table", "x", "y").alias("r")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("c"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("d")))
    same = [F.col("blocks")[i] == F.col("others")[i] for i in range(n)]
    first = F.array_position(F.array(*[same[i] & same[j] for i, j in pairs]), True) - 1
    lower = (F.col("a") < F.col("c")) | ((F.col("a") == F.col("c")) & (F.col("b") < F.col("d")))
    hit = left.join(right, ["table", "x", "y"]).filter(lower & (apart <= radius) & (first == F.col("table")))
    return hit.select("a", "b", "c", "d", apart.alias("distance"))


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its text with the second half replaced by the start of the next document."""
    rows = packed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    linked = with_next(rows).select("chunk", "place", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), "text",
                                    F.coalesce(edited, F.col("text")).alias("edited"))
    linked = linked.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["chunk", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    two = linked.select(*keys, F.expr("stack(2, 0, text, 1, edited) as (kind, body)"))
    counted = votes([*keys, "kind"], F.col("body"), two)
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    wide = counted.groupBy(*keys).agg(pick("a", 0).alias("a"), pick("b", 0).alias("b"), pick("a", 1).alias("ea"), pick("b", 1).alias("eb"))
    order = Window.partitionBy("chunk").orderBy("place")
    done = wide.withColumn("na", F.lead("a").over(order)).withColumn("nb", F.lead("b").over(order)).filter(~F.col("ghost"))
    c = F.col
    return done.select("doc_id", "n_chars", "edited_sha256", spelled(c("a"), c("b")).alias("fingerprint"), spelled(c("ea"), c("eb")).alias("edited_fingerprint"),
                       likeness(c("a"), c("b"), c("ea"), c("eb")).alias("near_edited"),
                       likeness(c("a"), c("b"), F.coalesce(c("na"), c("a")), F.coalesce(c("nb"), c("b"))).alias("near_next"), "a", "b")
