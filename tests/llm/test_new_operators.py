"""Mixing, clustering and spelling variants: against plain versions, and on null, empty, long, repeated and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowengine.llm import hamerly, mixing, spelling

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = "doc_id long, text string, source string, no int, block long, taken long, _a int"
ROWS = [
    (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, " \n\t", "y"), (5, LONG, "y"), (5, LONG, "y"), (None, "one two", None), (None, "one two", None), (None, "three", ""),
    (6, "b c 　 d\x0be", "x"), *[(100 + i, "w " * (i % 50), "hot") for i in range(200)], (7, "", "none"),
]


def sizes_of(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def water(words, budget=1.5):
    """Targets by the rule as it is told: share, cut at twice the size, share what is over among the others, again."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), budget * sum(words.values()), set(names)
    while open_ and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s, more in share.items():
            out[s] += more
            if out[s] >= 2 * words[s]:
                left += out[s] - 2 * words[s]
                out[s] = 2.0 * words[s]
                open_.discard(s)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in ROWS], DOCS)


def test_mixture(spark, docs):
    got = mixing.taken(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, sizes_of(t)) for d, t, _ in ROWS)
    words = Counter()
    for _, t, s in ROWS:
        words[s] += sizes_of(t)
    want = water(words)
    by = {}
    for d, t, s in ROWS:
        by.setdefault((d, sizes_of(t)), set()).add(s)
    taken = Counter()
    for r in got:
        s = next(iter(by[r.doc_id, r.size]))
        assert r.source_size == words[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1.5 * mixing.BLOCK for s in words)
    again = mixing.taken(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.taken(docs.limit(0)).collect() == []
    assert [r.taken for r in mixing.taken(docs.where("text = ''")).collect()] == [0] * 6


def test_mixed_blocks_hold_the_words_of_their_texts(spark, docs):
    for block, shard in ((64, 4096), (7, 10)):
        rows = mixing.mixed(docs, block=block, shard=shard).collect()
        assert len({(r.shard, r.slot) for r in rows}) == len(rows) and all(0 <= r.slot < shard for r in rows)
        drawn, held = Counter(), {}
        for r in rows:
            drawn[r.source, r.block] += 1
            assert held.setdefault((r.source, r.block), r.words) == r.words and 0 < len(r.words) <= block
        assert max(drawn.values()) <= 2
        full = {s for s in {r.source for r in rows} if mixing.MOST * len([b for x, b in held if x == s]) == sum(n for (x, _), n in drawn.items() if x == s)}
        # a source that is taken twice is there whole: its blocks in order are its texts one after another
        for s in full:
            line = [w for b in range(len([1 for x, _ in held if x == s])) for w in held[s, b]]
            assert Counter(line) == Counter(w for _, t, x in ROWS if x == s for w in re.findall(r"[^\x20\x09-\x0d]+", t or ""))
        assert sum(len(r.words) for r in rows) == sum(r.taken for r in mixing.taken(docs, block=block, shard=shard).collect())


def test_permutations_take_every_index_once(spark):
    for n in (1, 2, 3, 10, 97, 1000, 4099):
        rows = mixing.permuted(spark.range(n).selectExpr("id", f"{n}L AS n"), "id", "n", "12345", "y").orderBy("id").collect()
        y = np.array([r.y for r in rows])
        assert sorted(y) == list(range(n))
        if n >= 1000:
            assert abs(np.corrcoef(np.arange(n), y)[0, 1]) < 0.1 and np.mean(np.abs(np.diff(y)) < n // 20) < 0.3


def test_shards_draw_what_their_sources_have(spark, docs):
    plan = mixing.targets(mixing.sized(docs), block=8)
    drawn = {r.no: r.n for r in mixing.counts(plan, shard=100).groupBy("no").agg(F.sum("n").alias("n")).collect()}
    assert drawn == {r.no: r.draws for r in plan.collect() if r.draws}
    assert {r.n for r in mixing.counts(plan, shard=100).groupBy("shard").agg(F.sum("n").alias("n")).collect()} >= {100}


def test_running_sums_in_buckets_of_any_size(spark):
    rows = [(g, b, o, v) for g in range(2) for b in (0, 1, 5, 5000) for o, v in enumerate([3, 0, 7, 1])]
    got = mixing.running(spark.createDataFrame(rows, "g int, b long, o int, v long"), "g", "b", ["o"], "v", "s").collect()
    for r in got:
        assert r.s == sum(v for g, b, o, v in rows if g == r.g and (b, o) < (r.b, r.o))


def broadcast_rows(df) -> list[int]:
    """Rows of each table that the plan of df, once run, sent whole through the driver."""
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("run", [mixing.taken, mixing.mixed])
def test_only_sources_are_broadcast(spark, run):
    """Blocks and slots follow the size of all texts: none goes through the driver, however small Spark takes them for."""
    rows = [(i, "w " * 1_000, f"s{i % 2}") for i in range(4_000)]
    df = run(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = df.collect()
    assert sum(r.taken if run is mixing.taken else len(r.words) for r in got) > 4_000 * 1_000
    sent = broadcast_rows(df)
    assert sent and max(sent) <= 2


VECS = "vec_id long, embedding array<float>, cluster int, label int"


def plain_kmeans(rows, k, rounds, dim, scale, salt):
    """By the rule, with Python's integers: every distance, every round."""
    kept = [(i, [math.floor(scale * np.float64(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    c = [v for _, v in start[:k]]
    dist = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    for t in range(rounds + 1):
        of = [min(range(len(c)), key=lambda j, v=v: (dist(v, c[j]), j)) for _, v in kept]
        if t < rounds:
            for j in range(len(c)):
                if mine := [v for (_, v), o in zip(kept, of) if o == j]:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [dist(v, c[o]) for (_, v), o in zip(kept, of)]
    inertia = Counter()
    for o, x in zip(of, d):
        inertia[o] += x
    return Counter((i, o, x, inertia[o], sum(d), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, of, d))


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 3 * (i % 5)).tolist()) for i in range(300)] + [(7, [0.5] * 4)] * 3 + [(900 + i, [0.25, -0.25, 1.0, 0.0]) for i in range(60)]
    rows += [(500, None), (501, []), (502, [1.0, 2.0, None, 3.0]), (503, [1.0, float("nan"), 0.0, 0.0]), (504, [float("inf")] * 4), (505, [1.0] * 5), (None, [2.0] * 4)]
    for r in (2, 0):
        got = hamerly.clusters(spark.createDataFrame([(*x, 1, 2) for x in rows], VECS).repartition(3), k=6, rounds=r, dim=4)
        assert Counter(map(tuple, got.collect())) == plain_kmeans(rows, 6, r, 4, 256.0, "2:")
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = hamerly.clusters(spark.createDataFrame([(1, [1.0] * 4, 1, 2), (2, [1.0] * 4, 1, 2)], VECS), k=6, rounds=2, dim=4)
    assert Counter(map(tuple, few.collect())) == plain_kmeans([(1, [1.0] * 4), (2, [1.0] * 4)], 6, 2, 4, 256.0, "2:")
    assert hamerly.clusters(spark.createDataFrame([], VECS), dim=4).collect() == []
    huge = hamerly.clusters(spark.createDataFrame([(i, [3e38 * (-1) ** i, 0.0, 0.0, 0.0], 1, 2) for i in range(9)], VECS), k=1, rounds=1, dim=4).collect()
    assert len(huge) == 9 and all(0 < r.distance < 1 << 63 for r in huge)


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 8)) * 40 + 600 * (np.arange(4000) % 10)[:, None]).astype(np.int64)
    c = x[:12].copy()
    of, up, low = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
    drift, scans = None, []
    for _ in range(6):
        of, up, low, n = hamerly.assigned(x, c, of, up, low, drift)
        scans.append(n)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (of == d.argmin(1)).all() and (up >= np.sqrt(d[np.arange(len(x)), of])).all()
        d[np.arange(len(x)), of] = 1 << 60
        assert (low <= np.sqrt(d.min(1))).all()
        new = np.array([x[of == j].sum(0) // max(1, (of == j).sum()) if (of == j).any() else c[j] for j in range(len(c))])
        drift, c = np.sqrt(((new - c) ** 2).sum(1)), new
    assert scans[0] == len(x) and scans[-1] < len(x) // 2
    big = np.array([[1 << 27, -(1 << 27)], [0, 1]])
    assert hamerly.squared(big, big).tolist() == [[0, (1 << 54) + ((1 << 27) + 1) ** 2], [(1 << 54) + ((1 << 27) + 1) ** 2, 0]]


def plain_variants(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, Counter()
    some = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in some.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n[w], len(some[w]), form[w] and n[form[w]]] += 1
    return out


@pytest.mark.parametrize("limit", [2, 256])
def test_spelling_variants(spark, limit):
    rng = np.random.default_rng(8)
    base = ["hello", "aaaaa", "aaaaaa", "straße", "Éclairs", "banana", "ab" * 40]
    text = []
    for _ in range(700):
        w = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(3)):
            i = rng.integers(len(w))
            w[i : i + int(rng.integers(2))] = list("abé"[rng.integers(3)])[: int(rng.integers(2))]
        text.append("".join(w).upper() if rng.integers(4) == 0 else "".join(w))
    rows = [(i, " ".join(text[i * 50 : i * 50 + 50])) for i in range(14)] + [(None, "hello, hello; hella hella hellA x÷×y"), (3, None), (4, ""), (5, "hello hello"), (5, "hello hello"), (6, "123 _ Ābcdefg")]
    rows += [(20, " ".join(["words"] * 400 + [c + "words" for c in "abcdefgh"] * 3 + ["w" + c + "rds" for c in "abcdefgh"] * 3)), (21, " ".join(["lemons"] * 40 + ["lemonz"] * 12 + ["lemozz"] * 3))]
    df = spark.createDataFrame([(*r, 1, "m", 2) for r in rows], "doc_id long, text string, n int, w string, m int")
    got = Counter(map(tuple, spelling.variants(df, limit=limit).collect()))
    want = plain_variants(rows)
    assert got == want and any(k[1] for k in want) and any(k[2] != k[1] for k in want if k[1])
    assert spelling.variants(df.limit(0)).collect() == []


def test_blocks_are_small_and_hold_every_pair(spark):
    words = [a + b + c + "xyz" + d for a in "abc" for b in "abc" for c in "abc" for d in "abcd"] + [a + "bcxyz" for a in "abcd"]
    df = spark.createDataFrame([(w, 3) for w in words], "w string, n long")
    rows = spelling.blocks(df, limit=8).collect()
    size = Counter((r.m, r.p, r.e, r.head, r.tail) for r in rows)
    assert all(n <= 8 or e - p <= 1 for (_, p, e, _, _), n in size.items())
    assert all(r.w.startswith(r.head) and r.w.endswith(r.tail) and len(r.w) in (r.m, r.m + 1) for r in rows)
    plain = plain_variants([(1, " ".join(words * 3))])
    got = {r.w: r.near for r in spelling.near(spelling.blocks(df, limit=8)).collect()}
    near = Counter()
    for i, a in enumerate(words):
        for b in words[:i]:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(8)):
                near[a] += 1
                near[b] += 1
    assert got == dict(near) and len(plain)


def test_very_long_texts_and_words_are_read_whole(monkeypatch):
    monkeypatch.setattr(spelling, "_PART", 100)
    text = "Abcde " * 500 + "z" * 1000 + " é" * 50 + "éAbcde" + "9" * 300 + "fghij"
    assert spelling.runs(text, 5) == Counter({"abcde": 500, "z" * 1000: 1, "ééabcde": 1, "fghij": 1})
    words = sorted([b"a" * 3000 + bytes([c]) + b"b" * 2000 for c in b"xyz"])
    size = len(words[0])
    m = np.full(3, size)
    rows, near, best = spelling.compared(words, np.array([5, 9, 9]), m, np.zeros(3, np.int64), m, np.full(3, 3))
    assert rows.tolist() == [0, 1, 2] and near.tolist() == [2, 2, 2] and best.tolist() == [1, 2, 1]
