"""Text evidence queries over conversations: N1-N8.

Claims are the assistant's sentences. Evidence is what the user said and the first reply.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as V
from ..plans.storage import written
from ..sources import tables as T
from .base import joined, query, with_

# dots inside numbers and abbreviations are masked, sentence ends are marked, then the text is cut at the marks
_masked = "text"
for _pattern, _to in V.PROTECTED:
    _flags = "'gi'" if _pattern.startswith("(?i)") else "'g'"
    _masked = f"regexp_replace({_masked}, '{_pattern.replace('(?i)', '')}', '{_to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', {_flags})"
SENT = f"""sent AS (SELECT conv_id, turn, role, s, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS k FROM (
  SELECT conv_id, turn, role, trim(replace(x, '<DOT>', '.'), chr(9) || chr(10) || chr(13) || ' ') AS s, k FROM (
   SELECT conv_id, turn, role, unnest(string_split(regexp_replace({_masked}, '([.!?])\\s+', '\\1<CUT>', 'g'), '<CUT>')) AS x,
     generate_subscripts(string_split(regexp_replace({_masked}, '([.!?])\\s+', '\\1<CUT>', 'g'), '<CUT>'), 1) AS k FROM conversations)) WHERE s <> '')"""
CLAIMS = "claims AS (SELECT conv_id AS case_id, turn * 1000000 + k AS pos, s AS sentence FROM sent WHERE role = 'assistant')"
EVENTS = """events_ AS (SELECT conv_id AS case_id, turn * 1000000 + k AS event_pos, 'EVT-' || conv_id || '-' || turn || '-' || k AS event_id, s AS narration FROM sent WHERE role <> 'assistant' OR turn <= 1)"""
NORM = lambda c: f"regexp_replace(trim(lower({c})), '[.!?;:]+$', '')"
WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-zA-Z0-9_\\-]+'))"
STOP = "[" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + "]"
SPEC = "[" + ", ".join(f"'{w}'" for w in V.SPECULATIVE) + "]"
CHECK = f"""corpus AS (SELECT case_id, string_agg(narration || ' ' || event_id, ' ' ORDER BY event_pos) AS text FROM events_ GROUP BY ALL),
evw AS (SELECT case_id, lower(text) AS low, replace(text, ',', '') AS bare, {WORDS('text')} AS words FROM corpus),
f AS (SELECT c.*, coalesce(low, '') AS low, coalesce(bare, '') AS bare, coalesce(e.words, []) AS ew, {WORDS('sentence')} AS cw,
  regexp_extract_all(lower(sentence), '\\b((?:tx|acc|evt|case|flag)-[a-zA-Z0-9_\\-]+)\\b') AS ids, regexp_extract_all(sentence, '\\b(\\d+(?:,\\d+)*(?:\\.\\d+)?)\\b') AS nums,
  EXISTS (SELECT 1 FROM events_ v WHERE v.case_id = c.case_id AND {NORM('v.narration')} = {NORM('c.sentence')}) AS exact FROM claims c LEFT JOIN evw e USING (case_id)),
g AS (SELECT *, list_filter(ids, lambda x: NOT contains(low, x))[1] AS bad_id, list_filter(nums, lambda x: length(replace(x, ',', '')) > 1 AND NOT contains(bare, replace(x, ',', '')))[1] AS bad_num,
  list_filter(cw, lambda x: list_contains({SPEC}, x) AND NOT list_contains(ew, x))[1] AS bad_spec, list_filter(cw, lambda x: NOT list_contains({STOP}, x)) AS said FROM f),
checked AS (SELECT case_id, pos, sentence, reason IS NULL AS grounded, reason FROM (SELECT *, CASE WHEN exact THEN NULL WHEN bad_id IS NOT NULL THEN 'Unsupported entity ID: ''' || bad_id || ''''
  WHEN bad_num IS NOT NULL THEN 'Unsupported numeric value: ''' || bad_num || '''' WHEN bad_spec IS NOT NULL THEN 'Unsupported speculative claim: ''' || bad_spec || ''''
  WHEN len(said) = 0 THEN 'Sentence contains no verifiable informative content'
  WHEN len(list_filter(said, lambda x: NOT list_contains(ew, x))) > 1 THEN 'Unsupported factual terms: ' || array_to_string(list_sort(list_filter(said, lambda x: NOT list_contains(ew, x))), ', ') END AS reason FROM g))"""
BASE = with_(SENT, CLAIMS, EVENTS, CHECK)


def _sentences(spark, sf):
    turns = T.table(spark, sf, "conversations")
    s = V.split_claims(turns, keep=("conv_id", "turn", "role"))
    return s.withColumns({"case_id": F.col("conv_id"), "at": F.col("turn") * 1_000_000 + F.col("pos")})


def claims(spark, sf):
    return _sentences(spark, sf).filter("role = 'assistant'").select("case_id", F.col("at").alias("pos"), "sentence")


def events(spark, sf):
    s = _sentences(spark, sf).filter("role <> 'assistant' OR turn <= 1")
    return s.select("case_id", F.col("at").alias("event_pos"), F.concat(F.lit("EVT-"), "conv_id", F.lit("-"), "turn", F.lit("-"), "pos").alias("event_id"),
                    F.col("sentence").alias("narration"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("tool_input"))


def checked(spark, sf):
    return V.check_claims(claims(spark, sf), events(spark, sf))


@query("N1", with_(SENT) + "SELECT conv_id, turn, k AS pos, s AS sentence FROM sent")
def n1(spark, sf):
    return _sentences(spark, sf).select("conv_id", "turn", "pos", "sentence")


@query("N2", with_(SENT, CLAIMS) + f"""SELECT case_id, pos, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(sentence), '\\b((?:tx|acc|evt|case|flag)-[a-zA-Z0-9_\\-]+)\\b'))), ',') AS ids,
 array_to_string(list_sort(list_distinct(regexp_extract_all(sentence, '\\b(\\d+(?:,\\d+)*(?:\\.\\d+)?)\\b'))), ',') AS numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(sentence), '\\b(\\d{{1,2}}:\\d{{2}}(?:\\s*[ap]m)?)\\b'))), ',') AS times,
 array_to_string(list_sort({WORDS('sentence')}), ',') AS words FROM claims""")
def n2(spark, sf):
    f = V.facts(claims(spark, sf))
    return f.select("case_id", "pos", *[F.array_join(F.sort_array(c), ",").alias(c) for c in ("ids", "numbers", "times", "words")])


@query("N3", BASE + "SELECT * FROM checked")
def n3(spark, sf):
    return checked(spark, sf)


@query("N4", BASE + """SELECT case_id, count(*) AS total_claims, count(*) FILTER (grounded) AS grounded_claims, count(*) FILTER (NOT grounded) AS ungrounded_claims,
 round(100.0E0 * count(*) FILTER (grounded) / count(*), 1) AS grounded_pct FROM checked GROUP BY ALL""")
def n4(spark, sf):
    return V.trust_scores(checked(spark, sf))


@query("N4_running", BASE + """SELECT case_id, pos, count(*) OVER w AS total_claims, count(*) FILTER (grounded) OVER w AS grounded_claims,
 round(100.0E0 * count(*) FILTER (grounded) OVER w / count(*) OVER w, 1) AS grounded_pct FROM checked WINDOW w AS (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def n4_running(spark, sf):
    return V.running_trust(checked(spark, sf)).select("case_id", "pos", "total_claims", "grounded_claims", "grounded_pct")


@query("N4_tags", BASE + """SELECT c.case_id, c.pos, c.grounded, CASE WHEN c.grounded THEN (SELECT arg_min(e.event_id, e.event_pos) FROM events_ e WHERE e.case_id = c.case_id AND lower(trim(e.narration)) = lower(trim(c.sentence))) END AS supporting_event_id FROM checked c""")
def n4_tags(spark, sf):
    return V.claim_tags(checked(spark, sf), events(spark, sf)).select("case_id", "pos", "grounded", "supporting_event_id")


RX = lambda words: "\\b(" + "|".join(words) + ")\\b"
PARTS = lambda words: " OR ".join(f"contains(low, '{w}')" for w in words)


@query("N5", f"""SELECT conv_id, turn, CASE WHEN low = '' THEN false WHEN turn % 2 = 0 THEN regexp_matches(low, '{RX(V.FLAGGED_WORDS)}') OR NOT regexp_matches(low, '{RX(V.CLEAR_WORDS)}')
 ELSE regexp_matches(low, '{RX(V.CLEAR_WORDS)}') OR {PARTS(V.LOWER_WORDS)} END AS verdict_ok,
 low <> '' AND ({PARTS(V.FEATURE_WORDS['amount'])} OR regexp_matches(low, '\\bthe\\b') OR {PARTS(V.ANONYMOUS_WORDS)}) AS drivers_ok FROM (SELECT *, lower(text) AS low FROM conversations)""")
def n5(spark, sf):
    t = T.table(spark, sf, "conversations")
    expected = F.when(F.col("turn") % 2 == 0, "flagged").otherwise("clear")
    return t.select("conv_id", "turn", V.verdict_consistent(F.col("text"), expected).alias("verdict_ok"),
                    V.drivers_named(F.col("text"), F.array(F.lit("Amount"), F.lit("The"), F.lit("Time"))).alias("drivers_ok"))


# patterns: three openings of every benchmark item; queries: every document
PATTERNS = """pats AS (SELECT item_id AS question_id, item_id * 10 + n AS item, lower(trim(p)) AS pattern FROM (
  SELECT item_id, unnest([array_to_string((string_split(text, ' '))[1:2], ' '), substr(text, 1, 6), array_to_string((string_split(text, ' '))[2:5], ' ')]) AS p, unnest([0, 1, 2]) AS n FROM benchmark) WHERE trim(p) <> ''),
qs AS (SELECT doc_id AS query_id, lower(trim(text)) AS q FROM documents)"""


@query("N6", with_(PATTERNS) + """, one AS (SELECT query_id, question_id, pattern, 1 AS match_pass FROM qs JOIN pats ON contains(q, pattern)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(pattern) DESC, item) = 1),
pw AS (SELECT *, list_distinct(regexp_extract_all(pattern, '[a-zA-Z0-9]+')) AS w, len(regexp_extract_all(pattern, '[a-zA-Z0-9]+')) AS nw FROM pats),
qw AS (SELECT query_id, list_distinct(regexp_extract_all(q, '[a-zA-Z0-9]+')) AS w FROM qs WHERE query_id NOT IN (SELECT query_id FROM one)),
two AS (SELECT query_id, question_id, pattern, 2 AS match_pass FROM qw JOIN pw ON len(pw.w) >= 2 AND list_has_all(qw.w, pw.w) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY nw DESC, length(pattern) DESC, item) = 1)
SELECT * FROM one UNION ALL SELECT * FROM two""")
def n6(spark, sf):
    words = F.split("text", " ")
    openings = F.array(F.array_join(F.slice(words, 1, 2), " "), F.substring("text", 1, 6), F.array_join(F.slice(words, 2, 4), " "))
    pats = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.posexplode(openings).alias("n", "pattern"))
    pats = pats.withColumn("item", F.col("question_id") * 10 + F.col("n"))
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return V.match_answers(docs, pats)


SUPPORT = f"""ev AS (SELECT *, {NORM('narration')} AS norm, {WORDS('narration')} AS words FROM events_),
kept AS (SELECT *, {NORM('sentence')} AS norm, {WORDS(NORM('sentence'))} AS words FROM checked WHERE grounded),
sup AS (SELECT k.case_id, k.pos, e.event_id AS supporting_event_id FROM kept k JOIN ev e ON e.case_id = k.case_id
  QUALIFY row_number() OVER (PARTITION BY k.case_id, k.pos ORDER BY (e.norm = k.norm) DESC, len(list_intersect(e.words, k.words)) DESC, e.event_pos) = 1)"""


@query("N7", BASE + f", {SUPPORT} SELECT case_id, pos, grounded, reason, supporting_event_id FROM checked LEFT JOIN sup USING (case_id, pos)")
def n7(spark, sf):
    return V.audit(claims(spark, sf), events(spark, sf)).select("case_id", "pos", "grounded", "reason", "supporting_event_id")


@query("N7_counts", BASE + """SELECT case_id, count(*) AS total_candidate_sentences, count(*) FILTER (grounded) AS retained_count, count(*) FILTER (NOT grounded) AS pruned_count FROM checked GROUP BY ALL""")
def n7_counts(spark, sf):
    return V.audit_counts(V.audit(claims(spark, sf), events(spark, sf)))


@query("N8", BASE + """SELECT case_id, CAST(0 AS BIGINT) AS part, string_agg(sentence, ' ' ORDER BY pos) AS narrative FROM (SELECT case_id, pos, sentence FROM checked WHERE grounded
 UNION ALL SELECT case_id, event_pos, trim(narration) FROM events_ WHERE case_id IN (SELECT case_id FROM claims) AND case_id NOT IN (SELECT case_id FROM checked WHERE grounded)) GROUP BY case_id""")
def n8(spark, sf):
    return V.narrative(written(checked(spark, sf), "checked"), events(spark, sf))


@query("G9", BASE + f"""SELECT case_id, pos, array_to_string(list_sort(list_filter(cw, lambda x: NOT list_contains({STOP}, x))), ',') AS informative,
 array_to_string(list_sort(list_filter(cw, lambda x: list_contains({STOP}, x))), ',') AS stopwords FROM f""")
def g9(spark, sf):
    stop = F.array(*[F.lit(w) for w in V.STOPWORDS])
    f = V.facts(claims(spark, sf))
    text = lambda c: F.array_join(F.sort_array(c), ",")
    return f.select("case_id", "pos", text(F.array_except("words", stop)).alias("informative"), text(F.array_intersect("words", stop)).alias("stopwords"))
