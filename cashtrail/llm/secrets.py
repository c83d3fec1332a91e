"""Secret scans with corpus-wide ownership frequency.

Every whole text is scanned for candidates: assignments, access keys, long hex runs and, beyond these, bare mixed
tokens. Candidate hashes are counted over distinct repositories and owners of the whole corpus: a value that many owners
or many repositories carry, be they all of one owner, is a copied ``example``; one that few carry and that looks random is
``live``; the rest is ``plain``. Repositories count by distinct texts, so copies of one file do not make an example.
Base spans stay whatever their class; bare tokens become spans only where the corpus shows them to be live.
Counts are pre-aggregated by distinct (value, owner, repository), so a value that a third of all rows repeat stays cheap.

Defined results: a null text is empty (no spans); a null owner or repository counts as one unknown one; repeated rows are
reported each, but count once as a repository, as do repositories with the same text; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .common import packed, row_ids, text_of

# fixed values: the three base kinds, in the order they are listed
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "bare")
PLACEHOLDER = re.compile(r"example|changeme|placeholder|dummy|sample|xxxx|0000", re.I)

MAX_OWNERS = 2          # a value with more distinct owners is an example
MAX_REPOS = 20          # so is one in more distinct repositories, counted over distinct texts, even of one owner
MIN_ENTROPY = 3.0       # bits a character of a value that looks random
SPANS = "array<struct<kind:string,start:int,end:int,hash:string,random:boolean>>"


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds, by start, then kind as listed."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def bare_spans(text: str, taken: list[tuple]) -> list[tuple[str, int, int, str]]:
    """Mixed tokens (upper, lower, digits) outside the base spans."""
    found = []
    for m in BARE.finditer(text):
        v = m[0]
        if not v.isalpha() and not v.islower() and not v.isupper() and any(c.isdigit() for c in v):
            if all(m.end() <= a or b <= m.start() for _, a, b, _ in taken):
                found.append(("bare", m.start(), m.end(), v))
    return found


def spans_of(text: str) -> list[dict]:
    base = base_spans(text)
    return [{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()[:32],
             "random": entropy(v) >= MIN_ENTROPY and not PLACEHOLDER.search(v)}
            for k, a, b, v in base + bare_spans(text, base)]


def scan(text: Column) -> Column:
    """The candidates of a text column."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("hash", pa.string()), ("random", pa.bool_())]))

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([spans_of(t) for t in texts.to_pylist()], kind)
    return spans(text)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos, n_texts over rows (hash, owner, repo, text_key).

    ``n_texts``: distinct repositories, those that carry the value in the same text counted as one. Each text stands for its
    smallest repository, so that neither many copies of a text nor many texts of a repository add to the count.
    """
    repos = found.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("r"))
    texts = found.groupBy("hash", "text_key").agg(F.min(F.struct("owner", "repo")).alias("at")).select("hash", "at").distinct()
    return repos.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos")).join(
        texts.groupBy("hash").agg(F.count("*").alias("n_texts")), "hash")


def find(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS,
         max_repos: int = MAX_REPOS) -> tuple[DataFrame, DataFrame]:
    """(rows without a candidate, rows with candidates and their classes).

    Both have ``row``, the whole input row; the second has ``spans`` by start, then kind:
    array of (start, rank, kind, end, class, n_owners, n_repos).
    """
    scanned = packed(docs).withColumn("spans", scan(text_of()))
    hits = written(row_ids(scanned.filter(F.size("spans") > 0)), "secrets")
    each = hits.select("uid", F.coalesce(F.col(f"row.`{owner}`").cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(F.col(f"row.`{repo}`").cast("string"), F.lit("")).alias("repo"),
                       F.xxhash64(text_of()).alias("text_key"), F.inline("spans"))
    judged = each.join(ownership(each), "hash").withColumn(
        "class", F.when((F.col("n_owners") > max_owners) | (F.col("n_texts") > max_repos), "example").when(F.col("random"), "live").otherwise("plain"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kept = judged.filter((F.col("kind") != "bare") | (F.col("class") == "live")).groupBy("uid").agg(F.sort_array(F.collect_list(
        F.struct("start", rank.alias("rank"), "kind", "end", "class", "n_owners", "n_repos"))).alias("spans"))
    return scanned.filter(F.size("spans") == 0).select("row"), hits.drop("spans").join(kept, "uid", "left").drop("uid")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans, classes."""
    none, some = find(docs)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:bigint,kind:string,end:int,class:string,n_owners:bigint,n_repos:bigint>>"))
    rows = none.withColumn("spans", F.lit(None).cast(some.schema["spans"].dataType)).unionByName(some.select("row", "spans")).withColumn("spans", spans)
    count = lambda c, v: F.size(F.filter("spans", lambda s: s[c] == v)).cast("long")
    return rows.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "bare")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), count("kind", "bare").alias("n_bare"),
        *[count("class", c).alias(f"n_{c}") for c in ("live", "example")])


def _cut_out(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["class"] != "live":
            continue
        if s["start"] >= at:
            out += [text[at:s["start"]], mark]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with live spans replaced; examples stay. Columns as they came; a changed text's n_chars is updated."""
    none, some = find(docs)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_cut_out(t, s or [], mark) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    live = F.exists(F.coalesce("spans", F.array().cast(some.schema["spans"].dataType)), lambda s: s["class"] == "live")
    some = some.withColumn("text", F.when(live, cut(text_of(), F.col("spans"))).otherwise(F.col("row.text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(live, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    row = F.col("row")
    for name, value in changed.items():
        row = row.withField(f"`{name}`", value)
    return none.unionByName(some.select(row.alias("row"))).select("row.*")
