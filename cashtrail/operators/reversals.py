"""First-in-first-out pairing of opposite transactions of equal amount within 48 hours.

The waiting rows of an (account, amount) group are always its newest rows of one direction, so the whole state is the signed queue
length ``s`` (waiting debits above 0). A row first forgets what is too old, ``s <- clamp(s, -recent credits, +recent
debits)``, then adds its own sign; it closes a pair if the queue it meets is of the other direction. Such clamp-and-shift steps
compose into one of the same form, (shift, low, high), so pairing is a segmented scan: every group is cut into chunks of
bounded size, chunks are folded by ``aggregate`` inside the JVM, and a chunk's starting state follows from the summaries of the
chunks before it, which are chunked and folded in the same way, level by level. A group that fits one chunk starts at 0 and takes no part in the
levels; that is decided group by group, and any chunk size gives the same pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import Ordered, row_limit
from ..plans.storage import written

PAIR_SECONDS = 172_800
FOLD_ROWS = 256            # rows of a group that are folded as one array
FOLD_ROWS_CONF = "cashtrail.maxRowsPerFold"
KEYS = ["account_id", "amount"]
FREE = 1 << 60             # a bound that never binds

_COMPOSE = """named_struct('shift', a.shift + e.shift, 'low', greatest(e.low, least(e.high, a.low + e.shift)), 'high', greatest(e.low, least(e.high, a.high + e.shift)))"""
SUMMARY = f"aggregate(h, named_struct('shift', 0L, 'low', -{FREE}L, 'high', {FREE}L), (a, e) -> {_COMPOSE})"
NEXT = "greatest(e.low, least(e.high, a.s + e.shift))"       # state behind a step


def reversal_pairs(ledger: DataFrame, within_seconds: int = PAIR_SECONDS, chunk_rows: int | None = None) -> DataFrame:
    """One row per pair: account_id, amount, id_1, dt_1, id_2, dt_2 (leg 2 closes the pair).

    Rows of one (account, amount) are read in (dt, id) order. A row closes the oldest waiting
    row of the other direction that is at most 48 h old; otherwise it waits itself.
    """
    chunk_rows = chunk_rows or int(ledger.sparkSession.conf.get(FOLD_ROWS_CONF, str(FOLD_ROWS)))
    rows = ledger.select("account_id", F.round("amount", 2).alias("amount"), F.unix_micros("dt").alias("us"), "id", "dt",
                         F.when(F.col("direction") == "debit", 1).otherwise(-1).cast("long").alias("sign"))
    both = rows.groupBy(*KEYS).agg(F.count_if(F.col("sign") > 0).alias("d"), F.count(F.lit(1)).alias("n")).filter("d > 0 AND d < n")
    both = written(both, "two-sided")
    size = both.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    largest, total = int(size.largest or 0), int(size.total or 0)
    if largest > row_limit(ledger):
        rows = rows.join(both.select(*KEYS, (F.col("n") > chunk_rows).alias("long")), KEYS)     # a group of one direction pairs nothing
        chunks = _chunks(rows, KEYS, within_seconds, chunk_rows, (largest, total))
    else:                                                   # dealt by a hash that windows and folds take as it is: one shuffle for all
        rows = rows.dropna(subset=KEYS).withColumn("place", F.xxhash64(*KEYS)).repartition("place")
        chunks = _chunks(rows, [*KEYS, "place"], within_seconds, chunk_rows, (largest, total))
    if largest > chunk_rows:                                # else there is no chunk with one before it
        chunks = written(chunks, "chunks")
        steps = chunks.filter("long").select(*KEYS, "chunk", F.expr(SUMMARY).alias("s")).select(*KEYS, "chunk", "s.*")
        starts = _starts(steps, chunk_rows, -(-largest // chunk_rows))
        chunks = chunks.join(starts, [*KEYS, "chunk"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    else:
        chunks = chunks.withColumn("start", F.lit(0).cast("long"))
    closing = chunks.select(*KEYS, "long", "h", F.explode(F.expr(_CLOSERS)).alias("c"))
    near = closing.select(*KEYS, "long", "c.*", F.expr("get(filter(h, x -> x.shift = c.sign AND x.ordinal = c.ordinal), 0)").alias("o"))
    pair = [*KEYS, F.col("o.id").alias("id_1"), F.col("o.dt").alias("dt_1"), "id_2", "dt_2"]
    if largest <= chunk_rows:
        return near.select(*pair)
    near = written(near, "closing")
    openers = chunks.filter("long").select(*KEYS, F.explode("h").alias("o")).select(*KEYS, F.col("o.shift").alias("sign"), F.col("o.ordinal").alias("ordinal"), "o")
    far = near.filter("o IS NULL").drop("o").join(openers, [*KEYS, "sign", "ordinal"])           # partner in an earlier chunk
    return near.filter("o IS NOT NULL").select(*pair).unionByName(far.select(*pair))


_CLOSERS = f"""aggregate(h,
  named_struct('s', start, 'c', transform(slice(h, 1, 0), e -> named_struct('id_2', e.id, 'dt_2', e.dt, 'sign', e.shift, 'ordinal', e.ordinal))),
  (a, e) -> named_struct('s', {NEXT}, 'c', CASE WHEN ({NEXT} - e.shift) * e.shift < 0
     THEN array_append(a.c, named_struct('id_2', e.id, 'dt_2', e.dt, 'sign', -e.shift, 'ordinal', e.others - abs({NEXT} - e.shift) + 1))
     ELSE a.c END),
  a -> a.c)"""


def _chunks(rows: DataFrame, keys: list[str], within: int, chunk_rows: int, sizes: tuple[int, int]) -> DataFrame:
    """KEYS, long, chunk, h: up to ``chunk_rows`` rows in order, as steps with the row's place among its direction (``ordinal``) and
    the number of rows of the other direction before it (``others``). Rows without ``long`` get it here, and groups of one direction go."""
    debit = (F.col("sign") > 0).cast("long")
    credit = (F.col("sign") < 0).cast("long")
    seq = (Ordered(rows, keys, ["us", "id"], sizes).trailing("us", within * 1_000_000, near_d=debit, near_c=credit)
           .running(all_d=debit, all_c=credit).plain())
    if "long" not in rows.columns:
        whole = Window.partitionBy(*keys)
        seq = seq.withColumns({"n": F.count(F.lit(1)).over(whole), "d": F.sum(debit).over(whole)}).filter("d > 0 AND d < n").withColumn("long", F.col("n") > chunk_rows)
    own = F.col("sign") > 0
    step = F.struct("us", "id", "dt", F.col("sign").alias("shift"), (F.col("sign") - (F.col("near_c") - credit)).alias("low"),
                    (F.col("sign") + F.col("near_d") - debit).alias("high"), F.when(own, F.col("all_d")).otherwise(F.col("all_c")).alias("ordinal"),
                    F.when(own, F.col("all_c")).otherwise(F.col("all_d")).alias("others"))
    place = F.col("all_d") + F.col("all_c") - 1
    return seq.select(*keys, "long", F.floor(place / chunk_rows).alias("chunk"), step.alias("step")).groupBy(*keys, "long", "chunk").agg(
        F.array_sort(F.collect_list("step")).alias("h")).select(*KEYS, "long", "chunk", "h")


def _starts(steps: DataFrame, chunk_rows: int, most: int) -> DataFrame:
    """KEYS, chunk, start for steps (KEYS, chunk, shift, low, high); ``most``: chunks of the longest group."""
    over = steps.select(*KEYS, F.floor(F.col("chunk") / chunk_rows).alias("up"), F.struct("chunk", "shift", "low", "high").alias("step")).groupBy(
        *KEYS, "up").agg(F.array_sort(F.collect_list("step")).alias("h"))
    if most > chunk_rows:
        over = written(over, "level")
        above = over.select(*KEYS, F.col("up").alias("chunk"), F.expr(SUMMARY).alias("s")).select(*KEYS, "chunk", "s.*")
        over = over.join(_starts(above, chunk_rows, -(-most // chunk_rows)).withColumnRenamed("chunk", "up"), [*KEYS, "up"])
    else:
        over = over.withColumn("start", F.lit(0).cast("long"))
    scan = f"""aggregate(h, named_struct('s', start, 'c', transform(slice(h, 1, 0), e -> named_struct('chunk', e.chunk, 'start', e.shift))),
      (a, e) -> named_struct('s', {NEXT}, 'c', array_append(a.c, named_struct('chunk', e.chunk, 'start', a.s))), a -> a.c)"""
    return over.select(*KEYS, F.inline(F.expr(scan)))


def pair_weeks(pairs: DataFrame, min_pairs: int = 3, evidence_pairs: int = 4,
               max_evidence: int = 6) -> DataFrame:
    """Account-weeks (Monday start) with at least ``min_pairs`` closed pairs."""
    pairs = pairs.withColumn("week", F.date_trunc("week", "dt_2"))
    weeks = (pairs.groupBy("account_id", "week")
             .agg(F.count(F.lit(1)).alias("pairs"), F.min("dt_1").alias("window_start"),
                  F.max("dt_2").alias("window_end"))
             .filter(F.col("pairs") >= min_pairs))
    w = Window.partitionBy("account_id", "week").orderBy("dt_2", "id_2")
    first = (pairs.join(weeks.select("account_id", "week"), ["account_id", "week"], "left_semi")
             .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= evidence_pairs)
             .groupBy("account_id", "week")
             .agg(F.array_sort(F.collect_list(F.struct("rn", F.array("id_1", "id_2").alias("ids")))).alias("l"))
             .select("account_id", "week",
                     F.slice(F.array_distinct(F.flatten(F.col("l.ids"))), 1, max_evidence).alias("evidence")))
    return weeks.join(first, ["account_id", "week"])
