"""Transfer-network detectors: fan-in structuring, round trips, rapid layering, walks.

Paths grow by joins on (account, time bucket): a bucket is as long as the allowed wait, so a hop
looks into its own bucket and the next one, and a busy account is split over its buckets. Each hop
is written to shared storage, so a lost executor never replays the whole chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import Ordered
from ..plans.storage import written

HOUR_US = 3_600_000_000
# Reference texts and confidences of the three typologies.
TYPOLOGY = {
    "structuring": ("FATF 40 Recommendations - Recommendation 10 & Criteria 10.1 / Sub-threshold Smurfing Patterns", 0.95),
    "round_tripping": ("FATF Guidance on Concealment of Beneficial Ownership (Oct 2018) - Circular Fund Routing", 0.94),
    "rapid_layering": ("FATF Money Laundering Typologies - High-Velocity Pass-Through Transfers", 0.92),
}
COLLECTOR = ["net", "to_account"]
ORDER = ["us", "id"]


def _scope(edges: DataFrame) -> DataFrame:
    """The columns every detector uses; ``net`` keeps separate networks apart."""
    if "net" not in edges.columns:
        edges = edges.withColumn("net", F.lit("all"))
    return edges.select("net", "id", "from_account", "to_account", "amount", "dt", F.unix_micros("dt").alias("us"))


# -- fan-in structuring ------------------------------------------------------------------
def sub_threshold_edges(edges: DataFrame, threshold: float = 10_000.0, lower: float = 7_500.0) -> DataFrame:
    return edges.filter((F.col("amount") >= lower) & (F.col("amount") < threshold))


CHUNK_ROWS = 256        # rows of a collector that are folded as one array


def _first_senders(k: int, near: str, far: str) -> str:
    """The first ``k`` distinct senders of two stretches of rows in order, each given by its own first ones."""
    return f"slice(concat({near}, filter({far}, v -> NOT exists({near}, u -> u.a <=> v.a))), 1, {k})"


def _senders_behind(steps: DataFrame, k: int, chunk_rows: int, most: int) -> DataFrame:
    """COLLECTOR, chunk, after: the first ``k`` senders behind each chunk, for steps (COLLECTOR, chunk, s: those within it).

    Chunks are chunked and folded again, level by level, until every collector has one; ``most``: chunks of the longest.
    """
    over = steps.select(*COLLECTOR, F.floor(F.col("chunk") / chunk_rows).alias("up"), F.struct("chunk", "s").alias("step")).groupBy(*COLLECTOR, "up").agg(
        F.reverse(F.array_sort(F.collect_list("step"))).alias("h"))
    both = _first_senders(k, "e.s", "a.s")
    if most > chunk_rows:
        over = written(over, "level")
        above = over.select(*COLLECTOR, F.col("up").alias("chunk"), F.expr(f"aggregate(h, named_struct('s', slice(h[0].s, 1, 0)), (a, e) -> named_struct('s', {both}))").alias("x"))
        above = _senders_behind(above.select(*COLLECTOR, "chunk", "x.s"), k, chunk_rows, -(-most // chunk_rows))
        over = over.join(above.withColumnRenamed("chunk", "up"), [*COLLECTOR, "up"])
    else:
        over = over.withColumn("after", F.expr("slice(h[0].s, 1, 0)"))
    scan = f"""aggregate(h, named_struct('s', after, 'c', transform(slice(h, 1, 0), e -> named_struct('chunk', e.chunk, 'after', e.s))),
      (a, e) -> named_struct('s', {both}, 'c', array_append(a.c, named_struct('chunk', e.chunk, 'after', a.s))), a -> a.c)"""
    return over.select(*COLLECTOR, F.inline(F.expr(scan)))


def fan_in_structuring(edges: DataFrame, threshold: float = 10_000.0, lower: float = 7_500.0,
                       window_hours: float = 24, factor: float = 1.8, min_senders: int = 3,
                       min_edges: int = 3, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One flag per collector: its first window with enough senders and volume.

    A row's window reaches ``window_hours`` ahead of it. It holds ``min_senders`` different senders if the last one of the next
    ``min_senders`` distinct ones pays in time. These lists are as long as ``min_senders`` and compose, so they are read backwards over chunks of
    ``chunk_rows`` rows, and a chunk gets the list behind it from the chunks after it: no window keeps a set of its senders.
    """
    if min_senders < 1:
        raise ValueError("min_senders must be 1 or more")
    span, k = int(window_hours * HOUR_US), int(min_senders)
    band = sub_threshold_edges(_scope(edges), threshold, lower)
    rows = Ordered(band, COLLECTOR, ORDER)
    most = -(-max(1, rows.sizes[0]) // chunk_rows)
    seq = rows.numbered("rn").leading("us", span, volume=F.col("amount").cast("decimal(28,6)"), n_edges=F.lit(1).cast("long")).plain()
    row = F.struct("us", "id", "dt", "volume", "n_edges", F.array(F.struct(F.col("from_account").alias("a"), F.col("us").alias("us"))).alias("s"))
    chunks = seq.select(*COLLECTOR, F.floor((F.col("rn") - 1) / chunk_rows).alias("chunk"), row.alias("row")).groupBy(*COLLECTOR, "chunk").agg(
        F.reverse(F.array_sort(F.collect_list("row"))).alias("h"))
    both = _first_senders(k, "e.s", "a.s")
    if most > 1:
        chunks = written(chunks, "chunks")
        steps = chunks.select(*COLLECTOR, "chunk", F.expr(f"aggregate(h, named_struct('s', slice(h[0].s, 1, 0)), (a, e) -> named_struct('s', {both}))").alias("x"))
        chunks = chunks.join(_senders_behind(steps.select(*COLLECTOR, "chunk", "x.s"), k, chunk_rows, most), [*COLLECTOR, "chunk"])
    else:
        chunks = chunks.withColumn("after", F.expr("slice(h[0].s, 1, 0)"))
    hit = f"get({both}, {k - 1}).us <= e.us + {span} AND e.n_edges >= {min_edges} AND e.volume >= {threshold * factor!r}"
    found = f"""aggregate(h, named_struct('s', after, 'f', CAST(NULL AS STRUCT<us: BIGINT, id: {band.schema['id'].dataType.simpleString()}, dt: TIMESTAMP, volume: DECIMAL(38,6), n_edges: BIGINT>)),
      (a, e) -> named_struct('s', {both}, 'f', CASE WHEN {hit} THEN struct(e.us AS us, e.id AS id, e.dt AS dt, CAST(e.volume AS DECIMAL(38,6)) AS volume, e.n_edges AS n_edges) ELSE a.f END), a -> a.f)"""
    first = chunks.select(*COLLECTOR, F.expr(found).alias("f")).filter("f IS NOT NULL").groupBy(*COLLECTOR).agg(F.min("f").alias("f"))
    return first.select(
        "net", F.col("to_account").alias("collector"), F.col("f.us").alias("start_us"), F.col("f.id").alias("start_id"),
        F.col("f.dt").alias("window_start"), (F.col("f.us") + span).alias("end_us"),
        F.col("f.n_edges").alias("n_edges"), F.col("f.volume").cast("double").alias("total_amount"))


def suppress_involved(flags: DataFrame, members: DataFrame) -> DataFrame:
    """The flags a pass in order of (start_us, start_id, collector) keeps: one whose collector is a sender of a kept flag before it goes.

    ``members``: rows of :func:`fan_in_members`. The pass runs in rounds: a flag is kept once no earlier one that names its collector is open, and goes once
    one of them is kept. A round decides at least the first open flag of every chain, and each is a join of the open flags with the namings.
    """
    order = F.struct("start_us", "start_id", "collector")
    ranked = flags.select("net", "collector", order.alias("at"))
    naming = (members.select("net", F.col("collector").alias("by"), F.col("from_account").alias("collector")).filter("by <> collector").distinct()
              .join(ranked, ["net", "collector"]).join(ranked.select("net", F.col("collector").alias("by"), F.col("at").alias("by_at")), ["net", "by"])
              .filter(F.col("by_at") < F.col("at")).select("net", "collector", "by"))
    naming = written(naming, "naming")
    state = written(ranked.select("net", "collector", F.lit("open").alias("state")), "state")
    while state.filter("state = 'open'").limit(1).count():
        seen = naming.join(state.select("net", F.col("collector").alias("by"), F.col("state").alias("by_state")), ["net", "by"])
        seen = seen.groupBy("net", "collector").agg(F.max(F.col("by_state") == "kept").alias("named"), F.max(F.col("by_state") == "open").alias("waits"))
        now = (F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("named", F.lit(False)), "gone")
               .when(F.coalesce("waits", F.lit(False)), "open").otherwise("kept"))
        state = written(state.join(seen, ["net", "collector"], "left").select("net", "collector", now.alias("state")), "state")
    return flags.join(state.filter("state = 'kept'").select("net", "collector"), ["net", "collector"], "left_semi")


def fan_in_members(edges: DataFrame, flags: DataFrame, threshold: float = 10_000.0,
                   lower: float = 7_500.0) -> DataFrame:
    """Every edge of every flagged window, one row each."""
    band = sub_threshold_edges(_scope(edges), threshold, lower)
    f = flags.select("net", F.col("collector").alias("to_account"), "start_us", "start_id", "end_us")
    inside = ((F.col("us") > F.col("start_us")) | ((F.col("us") == F.col("start_us")) & (F.col("id") >= F.col("start_id"))))
    return (band.join(f, COLLECTOR).filter(inside & (F.col("us") <= F.col("end_us")))
            .select("net", F.col("to_account").alias("collector"), "from_account", "id", "us", "dt", "amount"))


# -- paths -------------------------------------------------------------------------------
def _bucketed(edges: DataFrame, span: int) -> DataFrame:
    return edges.select("net", F.col("from_account").alias("at"), F.expr(f"us div {span}").alias("bucket"),
                        F.col("to_account").alias("next"), F.col("id").alias("e_id"), F.col("us").alias("e_us"),
                        F.col("amount").alias("e_amount"), F.col("dt").alias("e_dt"))


def _in_buckets(paths: DataFrame, span: int) -> DataFrame:
    b = F.expr(f"last_us div {span}")
    return paths.withColumn("bucket", F.explode(F.array(b, b + 1)))


def _first_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("from_account <> to_account").select(
        "net", F.col("to_account").alias("at"), F.array("from_account", "to_account").alias("nodes"),
        F.array("id").alias("edge_ids"), F.col("us").alias("first_us"), F.col("amount").alias("first_amount"),
        F.col("us").alias("last_us"), F.col("amount").alias("last_amount"), F.col("dt").alias("first_dt"),
        F.col("dt").alias("last_dt"))


def trimmed(edges: DataFrame, span: int, rounds: int = 4) -> DataFrame:
    """Edges that may lie on a cycle: others leave their target and enter their source in the same span of time.

    One round is two semi-joins on (account, time bucket) against distinct buckets. It only saves work, so the number of
    rounds is free; they end early once a round, which moves every edge twice, takes less than a tenth of them away.
    """
    bucket = F.expr(f"us div {span}")
    near = F.explode(F.array(bucket - 1, bucket, bucket + 1))
    now = written(edges.filter("from_account <> to_account"), "trimmed")
    left = now.count()
    for _ in range(rounds):
        out_of = now.select("net", F.col("from_account").alias("to_account"), near.alias("bucket")).distinct()
        into = now.select("net", F.col("to_account").alias("from_account"), near.alias("bucket")).distinct()
        got = now.withColumn("bucket", bucket).join(out_of, ["net", "to_account", "bucket"], "left_semi").join(into, ["net", "from_account", "bucket"], "left_semi")
        now = written(got.select(edges.columns), "trimmed")
        before, left = left, now.count()
        if 10 * left > 9 * before:
            break
    return now


def round_trips(edges: DataFrame, max_nodes: int = 5, retention: float = 0.85, hours: float = 72) -> DataFrame:
    """Time-ordered cycles over 3..max_nodes accounts; one per set of accounts.

    Among cycles of one account set the one with the smallest (start, edge ids) stays.

    A cycle is put together at its busiest account (the pivot) from a half that leaves it and a half that returns to it, and both halves
    run over less busy accounts only. So no path ever leads through a hub: a hub is where halves begin and end, and
    their number is bounded by the edges times the degrees of the accounts between. The cycle's first edge in time may lie
    anywhere; a half that holds it past its own first edge is marked with its place (``mark``). Times are then rising from the mark to the
    end of the cycle and on from the pivot to the mark. Halves meet on (pivot, middle account, time bucket). A half is copied to the
    buckets of two spans that its own times leave open: two at most before the mark, mostly one after it.
    """
    span = int(hours * HOUR_US)
    e = trimmed(_scope(edges).drop("dt"), span)
    degree = e.select("net", F.explode(F.array("from_account", "to_account")).alias("account")).groupBy("net", "account").agg(F.count(F.lit(1)).alias("d"))
    rank = F.struct("d", "account").alias("rank")
    ranks = written(degree.select("net", "account", rank), "ranks")
    e = (e.join(ranks.select("net", F.col("account").alias("from_account"), F.col("rank").alias("r_from")), ["net", "from_account"])
         .join(ranks.select("net", F.col("account").alias("to_account"), F.col("rank").alias("r_to")), ["net", "to_account"]))
    e = written(e.select("net", "from_account", "to_account", "id", "us", "amount", "r_from", "r_to"), "ranked")
    kept = lambda last, first: last / F.greatest(F.lit(1.0), first) >= retention
    within = lambda us: F.expr(f"({us}) div {2 * span}")
    # a further time lies a span around unmarked times, between the last and the first one after the mark
    open_buckets = F.explode(F.when(F.col("mark") == 0, F.sequence(within(f"element_at(times, -1) - {span}"), within(f"times[0] + {span}")))
                             .otherwise(F.sequence(within("element_at(times, -1)"), within("times[0]"))))
    one = [F.array("id").alias("ids"), F.array("us").alias("times"), F.array("amount").alias("amounts"), F.lit(0).alias("mark")]

    def grown(halves: DataFrame, leaving: bool) -> DataFrame:
        """One edge more at the far end; ``nodes`` are in path order, so a returning half grows at its front."""
        here, there, r = ("from_account", "to_account", "r_to") if leaving else ("to_account", "from_account", "r_from")
        hop = e.select("net", F.col(here).alias("at"), within("us").alias("bucket"), F.col(there).alias("next"), F.col(r).alias("r_next"), "id", "us", "amount")
        got = (halves.withColumn("bucket", open_buckets).join(hop, ["net", "at", "bucket"])
               .filter((F.col("r_next") < F.col("r_pivot")) & ~F.array_contains("nodes", F.col("next"))))
        first, last, us = F.col("times")[0], F.element_at("times", -1), F.col("us")
        if leaving:
            rises = F.when(F.col("mark") == 0, (us >= last) & (us <= first + span)).otherwise((us >= last) & (us <= first))
            starts = (F.col("mark") == 0) & (us <= first) & (us >= last - span) & kept(F.element_at("amounts", -1), F.col("amount"))
            marks = (F.col("mark"), F.size("times"))
        else:
            rises = F.when(F.col("mark") == 0, (us <= first) & (us >= last - span)).otherwise((us <= first) & (us >= last))
            starts = (F.col("mark") == 0) & (us >= last) & (us <= first + span) & kept(F.col("amount"), F.col("amounts")[0])
            marks = (F.when(F.col("mark") > 0, F.col("mark") + 1).otherwise(0), F.lit(1))
        add = (lambda c, x: F.array_append(c, F.col(x))) if leaving else (lambda c, x: F.array_prepend(c, F.col(x)))
        got = got.withColumn("mark", F.explode(F.array_compact(F.array(F.when(rises, marks[0]), F.when(starts, marks[1])))))
        return got.select("net", "pivot", "r_pivot", F.col("next").alias("at"), add("nodes", "next").alias("nodes"), add("ids", "id").alias("ids"),
                          add("times", "us").alias("times"), add("amounts", "amount").alias("amounts"), "mark")

    halves = {}
    for leaving in (True, False):
        pivot, other, r, r_other = ("from_account", "to_account", "r_from", "r_to") if leaving else ("to_account", "from_account", "r_to", "r_from")
        now = e.filter(F.col(r_other) < F.col(r)).select("net", F.col(pivot).alias("pivot"), F.col(r).alias("r_pivot"), F.col(other).alias("at"),
                                                         F.array("from_account", "to_account").alias("nodes"), *one)
        halves[leaving, 1] = now
        for n in range(2, (max_nodes + leaving) // 2 + 1):
            now = grown(now, leaving)
            if (n + 1 - leaving) * 2 <= max_nodes:          # read more than once
                now = written(now, "half")
            halves[leaving, n] = now

    def met(k: int, j: int) -> DataFrame:
        a = halves[True, k].withColumn("bucket", within("times[0]"))
        b = halves[False, j].withColumn("bucket", open_buckets)
        # both ends of a half are keys: accounts between them travel, and values one by one
        flat = lambda side, n: [*[F.col("nodes")[i].alias(f"{side}nodes{i}") for i in range(1, n)], F.col("mark").alias(f"{side}mark"),
                                *[F.col(c)[i].alias(f"{side}{c}{i}") for c in ("ids", "times", "amounts") for i in range(n)]]
        whole = lambda side, n, c: F.array(*[F.col(f"{side}{c}{i}") for i in range(n)]).alias(f"{side}{c}")
        inner = lambda side, n: [F.col(f"{side}nodes{i}") for i in range(1, n)]
        apart = reduce(lambda x, y: x & y, [x != y for x in inner("", k) for y in inner("b_", j)], F.lit(True))
        got = (a.select("net", "pivot", "at", "bucket", *flat("", k)).join(b.select("net", "pivot", "at", "bucket", *flat("b_", j)), ["net", "pivot", "at", "bucket"])
               .filter(apart))
        got = got.select("net", F.array("pivot", *inner("", k)).alias("nodes"), F.array("at", *inner("b_", j)).alias("b_nodes"), "mark", "b_mark",
                         *[whole(side, n, c) for side, n in (("", k), ("b_", j)) for c in ("ids", "times", "amounts")])
        first, last, b_first, b_last = F.col("times")[0], F.element_at("times", -1), F.col("b_times")[0], F.element_at("b_times", -1)
        plain = (F.col("mark") == 0) & (F.col("b_mark") == 0)
        on, back = last <= b_first, b_last <= first
        at_pivot = plain & on & (b_last - first <= span) & kept(F.element_at("b_amounts", -1), F.col("amounts")[0])
        at_middle = plain & back & (last - b_first <= span) & kept(F.element_at("amounts", -1), F.col("b_amounts")[0])
        inside = on & back & (F.col("mark") + F.col("b_mark") > 0) & (F.least("mark", "b_mark") == 0)
        place = F.when(F.col("mark") > 0, F.col("mark")).otherwise(F.col("b_mark") + k)
        start = F.explode(F.array_compact(F.array(F.when(at_pivot, F.lit(0)), F.when(at_middle, F.lit(k)), F.when(inside, place))))
        turned = lambda x: F.concat(F.slice(x, F.col("start") + 1, F.lit(k + j) - F.col("start")), F.slice(x, F.lit(1), F.col("start")))
        got = got.withColumn("start", start).select(
            "net", turned(F.concat("nodes", "b_nodes")).alias("nodes"), turned(F.concat("ids", "b_ids")).alias("edge_ids"),
            turned(F.concat("times", "b_times")).alias("times"), turned(F.concat("amounts", "b_amounts")).alias("amounts"))
        return got.select("net", "nodes", "edge_ids", F.col("times")[0].alias("first_us"), F.element_at("times", -1).alias("last_us"),
                          F.col("amounts")[0].alias("first_amount"), F.element_at("amounts", -1).alias("last_amount"))

    cycles = reduce(DataFrame.unionByName, [met((n + 1) // 2, n // 2) for n in range(3, max_nodes + 1)])
    best = F.min(F.struct("first_us", "edge_ids", "nodes", "last_us", "first_amount", "last_amount")).alias("b")
    return (cycles.groupBy("net", F.array_sort("nodes").alias("node_set")).agg(best)
            .select("net", F.col("b.nodes").alias("nodes"), F.col("b.edge_ids").alias("edge_ids"),
                    F.timestamp_micros("b.first_us").alias("window_start"), F.timestamp_micros("b.last_us").alias("window_end"),
                    (F.col("b.last_amount") / F.greatest(F.lit(1.0), F.col("b.first_amount"))).alias("retention")))


def _one_per(paths: DataFrame, keys: list) -> DataFrame:
    """The path with the smallest (start, edge ids) of each key."""
    rest = [c for c in paths.columns if c not in ("first_us", "edge_ids")]
    best = paths.groupBy(*keys).agg(F.min(F.struct("first_us", "edge_ids", *rest)).alias("b"))
    return best.select(*[F.col(f"b.{c}").alias(c) for c in paths.columns])


def rapid_layering(edges: DataFrame, min_hops: int = 3, max_hop_hours: float = 3.0, min_ratio: float = 0.85,
                   max_ratio: float = 1.05, min_amount: float = 1_000.0, max_hops: int = 6) -> DataFrame:
    """Simple paths of 3..6 quick pass-through hops; one per node path, each prefix counts.

    Later hops only look at the nodes and the last edge, so one path per (nodes, last edge) goes on.
    """
    span = int(max_hop_hours * HOUR_US)
    e = _scope(edges)
    hop = _bucketed(e, span)
    # a self-transfer cannot be part of a simple path; its first edge would repeat its node
    paths, found = _first_edges(e.filter(F.col("amount") >= min_amount)), []
    for n in range(2, max_hops + 1):
        ratio = F.col("e_amount") / F.greatest(F.lit(1.0), F.col("last_amount"))
        got = (_in_buckets(paths, span).join(hop, ["net", "at", "bucket"])
               .filter((F.col("e_us") >= F.col("last_us")) & (F.col("e_us") - F.col("last_us") <= span)
                       & (ratio >= min_ratio) & (ratio <= max_ratio) & ~F.array_contains("nodes", F.col("next"))))
        step = got.select(
            "net", F.col("next").alias("at"), F.array_append("nodes", F.col("next")).alias("nodes"),
            F.array_append("edge_ids", F.col("e_id")).alias("edge_ids"), "first_us", "first_amount",
            F.col("e_us").alias("last_us"), F.col("e_amount").alias("last_amount"), "first_dt", F.col("e_dt").alias("last_dt"))
        paths = written(_one_per(step, ["net", "nodes", F.element_at("edge_ids", -1).alias("e1")]), "layering")
        if n >= min_hops:
            found.append(paths)
    chains = found[0]
    for part in found[1:]:
        chains = chains.unionByName(part)
    best = F.min(F.struct("first_us", "edge_ids", "first_dt", "last_dt")).alias("b")
    return (chains.groupBy("net", "nodes").agg(best)
            .select("net", "nodes", F.col("b.edge_ids").alias("edge_ids"), F.col("b.first_dt").alias("window_start"),
                    F.col("b.last_dt").alias("window_end")))


# -- union of flags ----------------------------------------------------------------------
def _tail(c):
    return F.right(c.cast("string"), F.lit(4))


def typology_flags(edges: DataFrame, fan_in: dict | None = None, trips: dict | None = None,
                   layering: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(flags, members). Members hold the involved accounts and evidence edges, one row each, so a
    fan-in window of any size stays whole without one huge array. ``fan_in`` may hold ``suppress=True``: a collector that already
    stands in an earlier fan-in flag gets none (off by default)."""
    fan_in = dict(fan_in or {})
    suppress = fan_in.pop("suppress", False)
    band = {k: fan_in[k] for k in ("threshold", "lower") if k in fan_in}
    f = written(fan_in_structuring(edges, **fan_in), "fan-in")
    m = fan_in_members(edges, f, **band)
    if suppress:
        f = written(suppress_involved(f, m), "fan-in")
        m = m.join(f.select("net", "collector"), ["net", "collector"], "left_semi")
    tag = lambda kind: [F.lit(kind).alias("typology"), F.lit(TYPOLOGY[kind][0]).alias("fatf_reference"),
                        F.lit(TYPOLOGY[kind][1]).alias("confidence")]
    key = F.concat(F.lit("structuring:"), F.col("collector").cast("string"))
    flags = f.select("net", key.alias("flag_key"), F.concat(F.lit("FLAG-STRUCTURING-"), _tail(F.col("collector"))).alias("flag_id"),
                     *tag("structuring"), "window_start")
    senders = (m.groupBy("net", "collector", "from_account").agg(F.min(F.struct("us", "id")).alias("pos"))
               .select("net", key.alias("flag_key"), F.lit("sender").alias("role"), F.col("from_account").cast("string").alias("member"),
                       F.col("pos.us").alias("pos"), F.col("pos.id").cast("string").alias("tie")))
    members = (senders
               .unionByName(f.select("net", key.alias("flag_key"), F.lit("collector").alias("role"), F.col("collector").cast("string").alias("member"),
                                     F.col("end_us").alias("pos"), F.lit("").alias("tie")))
               .unionByName(m.select("net", key.alias("flag_key"), F.lit("edge").alias("role"), F.col("id").cast("string").alias("member"),
                                     F.col("us").alias("pos"), F.col("id").cast("string").alias("tie"))))
    for kind, paths, prefix in (("round_tripping", round_trips(edges, **(trips or {})), "FLAG-ROUNDTRIP-"),
                                ("rapid_layering", rapid_layering(edges, **(layering or {})), "FLAG-LAYERING-")):
        paths = written(paths, kind)            # flags, their order and the members read them again
        paths = paths.withColumn("flag_key", F.concat(F.lit(kind + ":"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">")))
        ends = _tail(F.col("nodes")[0])
        if kind == "rapid_layering":
            ends = F.concat(ends, F.lit("-"), _tail(F.element_at("nodes", -1)))
        flags = flags.unionByName(paths.select("net", "flag_key", F.concat(F.lit(prefix), ends).alias("flag_id"), *tag(kind), "window_start"))
        for role, col in (("account", "nodes"), ("edge", "edge_ids")):
            members = members.unionByName(paths.select("net", "flag_key", F.lit(role).alias("role"), F.posexplode(col).alias("pos", "member"))
                                          .select("net", "flag_key", "role", F.col("member").cast("string").alias("member"),
                                                  F.col("pos").cast("long").alias("pos"), F.lit("").alias("tie")))
    return flags.orderBy(F.desc("confidence"), "net", "flag_key"), members


def flag_documents(flags: DataFrame, members: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """Flags with nested account and evidence lists. A list longer than ``part_rows`` continues in
    further rows of the same flag (``part`` 1, 2, ...)."""
    ids = members.withColumn("side", F.when(F.col("role") == "edge", "evidence").otherwise("involved"))
    rows = Ordered(ids, ["net", "flag_key", "side"], ["pos", "tie", "role", "member"]).numbered("n").plain()
    rows = rows.withColumn("part", F.floor((F.col("n") - 1) / part_rows))
    lists = rows.groupBy("net", "flag_key", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "involved", F.struct("n", "member")))).alias("i"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "evidence", F.struct("n", "member")))).alias("e"))
    return flags.join(lists.select("net", "flag_key", "part", F.col("i.member").alias("involved_accounts"),
                                   F.col("e.member").alias("evidence")), ["net", "flag_key"])


# -- walks -------------------------------------------------------------------------------
def _seeds(seeds: DataFrame) -> DataFrame:
    return seeds if "net" in seeds.columns else seeds.withColumn("net", F.lit("all"))


WALK = ["net", "walk_id"]


def _next_level(walks: DataFrame, hops: DataFrame, visited: DataFrame) -> DataFrame:
    """net, walk_id, from_account, rank: accounts first met on this level, in the order of their first mention."""
    met = (walks.join(hops, ["net", "from_account"]).groupBy(*WALK, "to_account").agg(F.min(F.struct("rank", "us", "id")).alias("first"))
           .join(visited, [*WALK, "to_account"], "left_anti")
           .select(*WALK, "to_account", F.col("first.rank").alias("r"), F.col("first.us").alias("us"), F.col("first.id").alias("id")))
    ranked = Ordered(met, WALK, ["r", "us", "id"]).numbered("rank").plain()
    return written(ranked.select(*WALK, F.col("to_account").alias("from_account"), "rank"), "frontier")


def network_walk(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Breadth-first walk from every seed (net, walk_id, account): one row per edge seen, in order.

    Each level is a join of the newly met accounts with the edges of their network; an account is entered once per
    walk, at its first mention. Seeds without ``net`` walk the one network there is.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1..5")
    e = _scope(edges).select("net", "id", "from_account", "to_account", "amount", "dt", "us")
    frontier = _seeds(seeds).select(*WALK, F.col("account").alias("from_account"), F.lit(1).cast("long").alias("rank"))
    visited = frontier.select(*WALK, F.col("from_account").alias("to_account"))
    steps = None
    for level in range(depth):
        got = written(frontier.join(e, ["net", "from_account"]).withColumn("depth", F.lit(level)), "walk")
        steps = got if steps is None else steps.unionByName(got)
        if level + 1 == depth:
            break
        frontier = _next_level(frontier, e, visited)
        visited = visited.unionByName(frontier.select(*WALK, F.col("from_account").alias("to_account")))
    rows = Ordered(steps, WALK, ["depth", "rank", "us", "id"]).numbered("step_index").plain()
    return rows.select(*WALK, "step_index", "depth", "from_account", "to_account", "amount", "dt", "id",
                       F.format_string("TOOL-CALL-SYN-%03d", "step_index").alias("tool_call_id"))


def walk_summary(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Per walk: hop_count, first and last step (account, amount), without its steps; a walk without steps has a row of none.

    A walk is a row of accounts, and an account always adds all its outgoing edges in their own order. So per account the number of
    edges, the first and the last one are enough; they are added up over the accounts of each level. Accounts met are found over one edge per pair
    of accounts, and the last level, the largest by far, is never walked.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1..5")
    e = _scope(edges)
    at = F.struct("us", "id")
    out = written(e.groupBy("net", "from_account").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("from_account", "amount"), at).alias("head"), F.max_by(F.struct("to_account", "amount"), at).alias("tail")), "out")
    hops = e.groupBy("net", "from_account", "to_account").agg(F.min(at).alias("first")).select("net", "from_account", "to_account", "first.us", "first.id")
    hops = written(hops, "hops") if depth > 1 else hops
    walks = _seeds(seeds).select(*WALK, F.col("account").alias("from_account"), F.lit(1).cast("long").alias("rank"))
    frontier, visited, levels = walks, walks.select(*WALK, F.col("from_account").alias("to_account")), None
    for level in range(depth):
        got = (frontier.join(out, ["net", "from_account"]).groupBy(*WALK)
               .agg(F.sum("n").alias("n"), F.min_by("head", "rank").alias("head"), F.max_by("tail", "rank").alias("tail")).withColumn("level", F.lit(level)))
        levels = got if levels is None else levels.unionByName(got)
        if level + 1 < depth:
            frontier = _next_level(frontier, hops, visited)
            visited = visited.unionByName(frontier.select(*WALK, F.col("from_account").alias("to_account")))
    whole = levels.groupBy(*WALK).agg(F.sum("n").alias("hop_count"), F.min_by("head", "level").alias("head"), F.max_by("tail", "level").alias("tail"))
    return walks.select(*WALK).distinct().join(whole, WALK, "left").withColumn("hop_count", F.coalesce("hop_count", F.lit(0)))


def network_walk_risk(summary: DataFrame) -> DataFrame:
    """Cycle / layering / plain score per walk, from its first and last step; 0.50 for a walk without steps."""
    first, last = F.col("head.amount"), F.col("tail.amount")
    ratio = F.when(F.col("hop_count") > 0, F.when(first > 0, last / first).otherwise(0.0))
    cycle = (F.col("head.from_account") == F.col("tail.to_account")) & (ratio >= 0.85)
    none = F.col("hop_count") == 0
    return summary.select(
        *WALK, "hop_count", F.col("head.from_account").alias("start_account"), F.col("tail.to_account").alias("end_account"),
        F.round(ratio, 6).alias("retention_ratio"),
        F.when(none, 0.50).when(cycle, 0.94).when(F.col("hop_count") >= 3, 0.88).otherwise(0.60).alias("risk_score"),
        F.when(none, "none").when(cycle, "round_tripping").when(F.col("hop_count") >= 3, "rapid_layering").otherwise("none").alias("typology"))


# -- labelled cases ----------------------------------------------------------------------
def evaluate_cases(expected: DataFrame, edges: DataFrame, **params) -> DataFrame:
    """Per case: expected and actual verdict. ``edges.net`` is the test id; one job covers all cases."""
    flags, _ = typology_flags(edges, **params)
    kinds = flags.groupBy("net").agg(F.sort_array(F.collect_set("typology")).alias("typologies"), F.count(F.lit(1)).alias("n_flags"))
    got = expected.join(kinds, expected.test_id == kinds.net, "left").drop("net")
    actual = F.when(F.col("n_flags") > 0, "flagged").otherwise("benign")
    return got.withColumns({"n_flags": F.coalesce("n_flags", F.lit(0)), "actual_verdict": actual,
                            "passed": actual == F.col("expected_verdict")})


def confusion(cases: DataFrame) -> DataFrame:
    """Counts and rates over evaluated cases."""
    pos, hit = F.col("expected_verdict") == "flagged", F.col("actual_verdict") == "flagged"
    c = cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"),
                  F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"))
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    return c.select("total", "tp", "fp", "tn", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
                    F.round(2 * p * r / F.greatest(F.lit(1e-10), p + r), 4).alias("f1"),
                    F.round(F.col("tn") / F.greatest(F.lit(1), F.col("tn") + F.col("fp")), 4).alias("specificity"),
                    F.round((F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("total")), 4).alias("accuracy"))
