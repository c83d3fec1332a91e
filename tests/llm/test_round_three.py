"""Sorted passes, resampling and periodic runs against brute force, and on the odd rows they must define."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from cashtrail.llm import catalog, near_vectors, resampling, runs

RNG = random.Random(8)
EXTRA = "`row` string, v string, uid long, rank string, text2 string, `found` int, weight string, score string, `key` int"
TAIL = ("r", "v", 3, "k", "t", 1, "w", "s", 9)


# -- 11 near vectors --------------------------------------------------------------------------------
def vectors():
    r = np.random.default_rng(2)
    base = r.normal(size=(140, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i] + 0.05 * r.normal(size=16)).tolist()) for i in range(40)]                    # near copies
    centre = r.normal(size=16)
    rows += [(2000 + i, (centre + 0.06 * r.normal(size=16)).tolist()) for i in range(120)]                    # a tight group
    chain, a, b = [], r.normal(size=16), r.normal(size=16)
    a, b = a / np.linalg.norm(a), b - (b @ a) * a / (a @ a)
    b = b / np.linalg.norm(b)
    chain = [(3000 + i, (math.cos(0.25 * i) * a + math.sin(0.25 * i) * b).tolist()) for i in range(6)]         # linked to the next one only
    rows += chain + [(5, base[5].tolist()), (5, base[5].tolist()), (4000, (3e200 * base[7]).tolist()), (None, base[9].tolist()), (None, base[9].tolist())]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0] * 15 + [None]), (5004, [1.0] * 15 + [float("nan")]), (5005, [float("inf")] * 16), (5006, [1.0, 2.0])]
    return rows


def brute_links(rows, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.zeros((len(rows), 16))
    for i in ok:
        v = np.array(rows[i][1])
        x[i, :len(v)] = v / abs(v).max()
        x[i] /= np.linalg.norm(x[i])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = [0] * len(rows)
    for a, i in enumerate(ok):
        for j in ok[a + 1:]:
            if x[i] @ x[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return [(name, links[i], least.get(root(i)), least.get(root(i)) == name) for i, (name, _) in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"window": 12}])
def test_near_vectors_equal_brute_force(spark, options):
    rows = vectors()
    df = spark.createDataFrame([(*r, *TAIL) for r in rows], "vec_id long, embedding array<double>, " + EXTRA)
    got = near_vectors.deduplicate(df, **options)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    have = sorted(((r["row"].vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=key)
    want = sorted(brute_links(rows), key=key)
    assert len(have) == len(want)
    assert have == want
    assert got.select("row.*").columns == df.columns
    assert max(w[1] for w in want) >= 119 and sum(w[3] for w in want) > 100


def test_near_vectors_blocks_of_a_component(spark):
    """Members beyond the sure half angle are compared block by block, whatever the block."""
    r = np.random.default_rng(5)
    c = r.normal(size=8)
    x = c + np.concatenate([0.2 * r.normal(size=(60, 8)), 0.6 * r.normal(size=(40, 8))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: int((u[i] @ u.T >= 0.9).sum()) - 1 for i in range(100)}
    members = spark.createDataFrame([(7, i, v.tolist()) for i, v in enumerate(x)], "component long, uid long, v array<double>")
    for block in (7, 1024):
        assert {r.uid: r.n_links for r in near_vectors.link_counts(members, 0.9, block).collect()} == want


def test_near_vectors_passes_grow_with_rows():
    few, many = near_vectors.passes_for(10_000), near_vectors.passes_for(10**9)
    assert near_vectors.passes_for(1) == near_vectors.passes_for(256) == 1 and 1 < few < many < 100


def test_near_vectors_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = near_vectors.report(empty)
    assert got.count() == 0 and got.columns == ["vec_id", "n_links", "component_id", "kept"]
    nothing = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in near_vectors.report(nothing).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


# -- 12 resampling ----------------------------------------------------------------------------------
def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "Beta", "gamma", "delta9", "Éta", "漢字", "x", "the", "of", "e-mail", "ünder_score"]) for _ in range(n))


def documents():
    rows = [(i, prose(RNG.randrange(5, 60), i)) for i in range(120)]
    return rows + [(3, prose(40, 3)), (3, prose(40, 3)), (None, prose(30, 500)), (None, None), (200, None), (201, ""), (202, " \t..!"), (203, "one"), (204, prose(30_000, 9)),
                   (205, "ends with alpha"), (206, "Beta starts this")]


def brute_resample(docs, target, percent=25, least=20):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    runs_ = lambda w: [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
    s, t = [0] * 10_000, [0] * 10_000
    for _, x in docs:
        for f in runs_(words(x)):
            s[f] += 1
    for x in target:
        for f in runs_(words(x)):
            t[f] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + 10_000) / ((s[i] + 1) * (sum(t) + 10_000)))) for i in range(10_000)] if docs else []
    out = []
    for i, x in docs:
        w = words(x)
        f = runs_(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    open_ = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(open_[:percent * len(open_) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_brute_force(spark):
    docs, target = documents(), [prose(50, 900 + i).replace("alpha", "omega") for i in range(12)] + [None, ""]
    d = spark.createDataFrame([(*r, *TAIL) for r in docs], "doc_id long, text string, " + EXTRA)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    want = brute_resample(docs, target)
    got = resampling.report(d, t)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == want
    drawn = resampling.resample(d, t)
    assert drawn.columns == d.columns and drawn.count() == sum(r[4] is not None for r in want)


def test_batches_never_join_documents():
    data = b"\0".join([b"a b", b"", b"c", b"d e f"])
    n, found = resampling.buckets_of(data, np.array([0, 4, 5, 7]), 2, 10_000)
    assert n.tolist() == [2, 0, 1, 3] and found[1][1].tolist() == [0, 3, 3]
    assert found[1][0].tolist() == [zlib.crc32(x) % 10_000 for x in (b"a b", b"d e", b"e f")]


def test_resampling_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.report(empty, empty).count() == 0
    one = spark.createDataFrame([(1, prose(30, 1))], "doc_id long, text string")
    assert [tuple(r) for r in resampling.report(one, empty).collect()] == brute_resample([(1, prose(30, 1))], [])


# -- 13 periodic runs -------------------------------------------------------------------------------
def brute_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                out.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(r.randrange(1, 4)):
            k, n = r.choice([1, 2, 3, 6]), r.randrange(0, 50)
            w = [r.randrange(k) for _ in range(n)]
            if r.random() < 0.5:
                w = ([r.randrange(4) for _ in range(r.randrange(1, 9))] * 20)[:n] + w[:r.randrange(4)]
            docs.append(w)
        got = runs.runs_of([np.array(w, np.int64) for w in docs], least)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute_runs(w, least) for w in docs]


def test_runs_report(spark):
    line = "all work and no play makes one dull "
    texts = [(i, prose(RNG.randrange(1, 150), i)) for i in range(60)] + [(70, line * 6), (71, "so " + line * 2 + "end"), (71, "so " + line * 2 + "end"), (None, "ha " * 30), (72, None), (73, ""),
             (74, " \t "), (75, "ha " * 11), (76, "ha " * 12), (77, "a b " * 40), (78, prose(4_000, 4) + " " + "x y z " * 50), (79, ("α β " * 9 + "γ ") * 4)]
    df = spark.createDataFrame([(*t, *TAIL) for t in texts], "doc_id long, text string, " + EXTRA)
    got = sorted((tuple(r) for r in runs.report(df).collect()), key=str)
    assert got == sorted((brute_report(*t) for t in texts), key=str)
    whole = runs.find(df)
    assert whole.select("row.*").columns == df.columns
    assert whole.filter("row.doc_id = 76").first().runs[0].asDict() == {"start": 0, "length": 12, "period": 1}
    assert runs.report(df.limit(0)).count() == 0


def test_long_document_is_one_piece():
    w = np.tile(np.arange(1000), 300)
    assert runs.runs_of([w, np.arange(5)])[0].tolist() == [[0, 300_000, 1000]]


def test_registered():
    assert [k for k in catalog.QUERIES if k.split("_")[0] in ("op11", "op12", "op13")] == ["op11_sorted_passes", "op12_resampling", "op13_periodic_runs"]
