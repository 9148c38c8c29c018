"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from flowengine.llm import chat_format, decontaminate, html_linetext, license_scan, ngram_score, quality_crf, sentencepiece_viterbi, simhash_vptree, topk_maxscore, toxicity_cnn
from flowengine.llm.shared import labelled_sample
from flowengine.llm.elias_fano import EliasFano, NgramTrie, prob_of
from flowengine.llm.tokens import Words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [
    (1, "The MIT License. mit license, General Public\nLicense", "en", "a", 1), (2, None, None, None, None), (3, "", "de", "a", 0), (4, "x", "en", "a", 1), (4, "x", "en", "a", 1),
    (None, "the quick brown fox jumps over the lazy dog", "en", "a", 2), (5, LONG, "en", "a", 3), (6, " \n\t ", "fr", "b", 4), (7, "the quick brown fox jumps over the lazy dog", "en", "a", 2),
    (8, "日本語 テキスト ▁ é\u0000", "xx", "b", 5), (9, "word", "en", "b", 1),
]
ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns called as the operators' own."""
    names = "score flagged _same _keep _bad _label ids n_tokens k same w h fp part component_id held_out spans template label decoded _text".split()
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(ASCII))


def test_simhash_matches_brute_force(spark, docs):
    def brute(text):
        w = words(text)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [r[1] if r[1] != LONG else LONG[:3000] for r in ROWS]
    assert simhash_vptree.simhashes(pa.array(texts)).tolist() == [brute(t) for t in texts]
    got = Counter((r.doc_id, r.component_id) for r in simhash_vptree.near_duplicates(docs).collect())
    assert got == Counter({(1, 1): 1, (2, 2): 1, (3, 2): 1, (6, 2): 1, (4, 4): 2, (None, 7): 1, (7, 7): 1, (5, 5): 1, (8, 8): 1, (9, 9): 1})


def test_one_row_of_each_group_stays(spark):
    a, b, c = "alpha beta gamma delta epsilon", "one two three four five", "red green blue black white"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, c), (None, c), (None, None), (None, ""), (9, "x"), (9, "x")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _same int")
    kept = simhash_vptree.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [x for x in got if x[1]] == sorted([(3, a), (5, b), (7, c), (9, "x")], key=str) and len(got) == 5
    near = simhash_vptree.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in near) == Counter({(3, 3): 1, (5, 3): 1, (5, 5): 1, (7, 5): 1, (7, 7): 1, (None, 7): 1, (None, None): 2, (9, 9): 2})


def test_vantage_point_links_are_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = base[:300].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # a ball: all within two bits of each other
    fps = np.unique(np.concatenate([base, near, dense]))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3

    def groups(label):
        return {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label.tolist())}

    want = np.arange(len(fps))
    while (new := np.array([want[close[i]].min() for i in range(len(fps))])).tolist() != want.tolist():
        want = new
    tree = simhash_vptree.VantageTree(fps[::3], 40, 3)
    seen = defaultdict(lambda: ([], []))
    for shard, rows, home in tree.route(fps):
        seen[shard][0].extend(rows[home])
        seen[shard][1].extend(rows)
    assert sorted(i for p, _ in seen.values() for i in p) == list(range(len(fps)))
    got = np.arange(len(fps))
    for p, q in seen.values():
        a, b = simhash_vptree.linked(fps[p], fps[q], 3)
        got = simhash_vptree._merge(got, np.searchsorted(fps, a), np.searchsorted(fps, b))
        assert len(a) < len(set(p) | set(q))
    assert groups(got) == groups(want)


def test_lm_scores(spark, docs):
    held = {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in ROWS}
    train = [words(r[1]) + [None] for r in ROWS if not held[r[0]]]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for w in train:
        c1.update(w), c2.update(zip(w, w[1:])), c3.update(zip(w, w[1:], w[2:]))
    n, v = sum(c1.values()), len(c1)
    got = ngram_score.lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert len(got) == len(ROWS)
    t1, t2 = Counter(a for a, _ in c2), Counter((a, b) for a, b, _ in c3)

    def model(w):
        total = 0.0
        for i, x in enumerate(w):
            p = (c1[x] + 1) / (n + v + 1)
            if i and c1[w[i - 1]]:
                p = (c2[w[i - 1], x] + t1[w[i - 1]] * p) / (c1[w[i - 1]] + t1[w[i - 1]])
            if i > 1 and t2[w[i - 2], w[i - 1]]:
                k = c2[w[i - 2], w[i - 1]] + t2[w[i - 2], w[i - 1]]
                p = c3[w[i - 2], w[i - 1], x] / k + t2[w[i - 2], w[i - 1]] / k * p
            total += math.log10(p)
        return total

    by_id = {}
    for r in ROWS:
        by_id[r[0]] = words(r[1]) + [None]
    for r in got:
        w = by_id[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c1[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert abs(r.score - model(w)) <= 0.02 * len(w) + 0.02  # eight-bit probabilities


def test_lm_scores_count_repeated_rows_and_take_any_table(spark, docs, clashing):
    rows = [(1, "a b c a b")] * 300 + [(2, "a b c"), (None, "b")] + [(None, None)] * 50 + [(3, "c c d")] * 2
    held = lambda df: F.col("doc_id") == 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_score.lm_scores(df, held(df)).collect()
    train = [(t or "").split() + ["\n"] for d, t in rows if d != 2]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows) and {r.train_tokens for r in got} == {n}
    base = {d: sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*(t or "").split(), "\n"]) for d, t in rows if d}
    assert all(math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9) for r in got if r.doc_id)
    p2 = (300 * 2 + 0 + 1 * (c["b"] + 1) / (n + v + 1)) / (c["a"] + 1)  # after a stands b alone
    p3 = (300 + 2 * (300 + 3 * (c["c"] + 1) / (n + v + 1)) / (c["b"] + 3)) / (600 + 2)  # after a b: c or an end
    end = 1 / (300 + 1) * 3 * (c["\n"] + 1) / (n + v + 1) / (c["c"] + 3)  # after b c stands a alone, after c: a, c or d
    two = next(r for r in got if r.doc_id == 2)
    assert two.held_out and abs(two.score - math.log10((c["a"] + 1) / (n + v + 1) * p2 * p3 * end)) < 0.1
    assert len(ngram_score.lm_scores(clashing).collect()) == len(ROWS)
    assert ngram_score.lm_scores(docs.limit(0)).collect() == []


def test_smoothed_probabilities_of_a_context_sum_to_about_one():
    rng, u = np.random.default_rng(6), np.uint64
    counts = rng.integers(1, 40, 30)
    trie = NgramTrie(np.array([7], u), np.array([3], u), np.array([counts.sum()]), np.arange(30).astype(u), counts)
    total = prob_of(trie.triple_codes, trie.step).sum() + prob_of(trie.weight_codes, trie.step)[0]
    assert abs(total - 1) < 0.03


def test_rare_continuations_of_a_large_context_keep_their_probability():
    rare, u = 25_000_000, np.uint64
    trie = NgramTrie(np.array([7], u), np.array([3], u), np.array([rare]), np.array([5, 9], u), np.array([1, rare - 1]))
    p = prob_of(trie.triple_codes, trie.step)
    assert p == pytest.approx([1 / (rare + 2), (rare - 1) / (rare + 2)], rel=0.05)
    assert prob_of(trie.weight_codes, trie.step) == pytest.approx([2 / (rare + 2)], rel=0.05)


def test_third_words_take_32_bits(spark):
    names = np.array([f"w{i}" for i in range(20_000)])
    h = Words(pa.array(names)).hashes() >> np.uint64(40)
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.diff(h[order]) == 0)[0]
    known, other = names[order[at]], names[order[at + 1]]  # equal in 24 bits
    df = spark.createDataFrame([(i, f"a b {known}") for i in range(50)] + [(99, f"a b {other}")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram_score.lm_scores(df, F.col("doc_id") == 99).collect()}
    assert got[99] < got[0] - 1


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1 << 60), (1000, 5000), (3000, 1 << 63), (2000, 2001)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        head, parts = EliasFano.encode(x)
        e = EliasFano(*head, *parts)
        assert e.find(x).tolist() == list(range(len(x))) and e.access(np.arange(len(x))).tolist() == x.tolist()
        q = rng.integers(0, top, 400, dtype=np.uint64)
        assert (e.find(q) >= 0).tolist() == np.isin(q, x).tolist()


def test_elias_fano_selects_over_packed_bits():
    rng, u = np.random.default_rng(4), np.uint64
    x = np.unique(np.concatenate([rng.integers(0, 1 << 50, 150_000, dtype=u), np.arange(1 << 40, (1 << 40) + 90_000, dtype=u)]))  # spread, and one run
    head, parts = EliasFano.encode(x)
    e = EliasFano(*head, *parts)
    assert (e.find(x) == np.arange(len(x))).all() and (e.access(np.arange(len(x))) == x).all()
    assert (e.find(x + u(1)) >= 0).tolist() == np.isin(x + u(1), x).tolist()
    # what a level searches is what the file maps
    trie = NgramTrie(np.arange(3, 1_003, dtype=u), np.arange(0, 1_000, dtype=u) << u(32), np.ones(1_000, np.int64), np.arange(0, 1_000, dtype=u) << u(32), np.ones(1_000, np.int64))
    levels = (trie.words, trie.pair_start, trie.pairs, trie.triple_start, trie.triples)
    held = [a for level in levels for a in vars(level).values() if isinstance(a, np.ndarray)]
    assert sum(a.nbytes for a in held) < trie.size and all(not a.flags.owndata and not a.flags.writeable for a in held)


def test_license(spark, docs):
    got = sorted((r.doc_id or 0, r.n_words, r.labels) for r in license_scan.op3_license_scan(spark, _saved(spark, docs)).collect())
    assert got[0] == (0, 9, "") and (2, 0, "") in got and got.count((4, 1, "")) == 2 and len(got) == len(ROWS)
    row = license_scan.op3_license_scan(spark, _saved(spark, docs)).where("doc_id = 1").first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels, row.labels, row.score) == (3, 1, 5, "gpl,mit", "gpl,mit", 1.0)
    # a notice with a word put in and one left out is still found, over neighbouring diagonals
    text = "foo this program is entirely free software you can redistribute it and or modify it under terms of the gnu general public license bar"
    spans = license_scan.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert {(s.label, s.base) for s in spans} == {("gpl", True), ("gpl", False)}
    # its pieces in another order are no copy, and neither are pieces that chance hits chain over far diagonals
    head, tail = "it under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify"
    w = license_scan.NOTICES[6][0].split()
    apart = " ".join(x for i in range(0, len(w), 2) for x in [*w[i : i + 3], "pad", "pad"])
    texts = [f"{head} {tail}", apart, license_scan.NOTICES[10][0], "released under the MIT lice\u212ase", "creative WOR\u212a is licensed under a creative commons"]
    found = license_scan.license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [sorted({(s.template, s.label) for s in r.spans if not s.base}) for r in found] == [[], [], [(4, "mit"), (13, "mit")], [], []]
    assert license_scan.license_spans(docs.limit(0)).count() == 0
    clash = docs.select("*", *[F.lit(1).alias(n) for n in "k same w p n t a b h template label votes words run spans n_words copies".split()])
    assert license_scan.license_spans(clash).count() == len(ROWS)


_FOLDERS = {}


def _saved(spark, df, name="documents"):
    import tempfile

    folder = _FOLDERS.setdefault(id(df), tempfile.mkdtemp(prefix="flowengine-test-"))
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder


def test_decontamination(spark, docs):
    long_item = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, "word"), (3, None), (4, ""), (5, long_item), (6, "QUICK, brown")], "item_id long, text string")
    extra = [(20, "a " + " ".join(f"w{i}" for i in range(36)) + " b", "en", "", 0), (21, "a " + " ".join(f"w{i}" for i in range(30)) + " b", "en", "", 0)]
    rows = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = {(r.doc_id, r.item_id): round(r.containment, 3) for r in decontaminate.contained_items(rows, items).collect()}
    assert got == {(None, 1): 1.0, (7, 1): 1.0, (9, 2): 1.0, (None, 6): 1.0, (7, 6): 1.0, (20, 5): round(32 / 36, 3)}
    assert sorted(r.doc_id for r in decontaminate.decontaminated(rows, items).collect()) == [1, 2, 3, 4, 4, 5, 6, 8, 21]
    none = items.limit(0)
    assert decontaminate.contained_items(rows, none).count() == 0 and decontaminate.decontaminated(rows, none).count() == rows.count()


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab, rng.choice([1, 2, 3, 4, 5, 6, 9, 17, 40])))) for i in range(40)] + [(50, "wor\u212a one two"), (51, "ÄB c")]
    rows = [(i, " ".join(x for part in rng.choice(len(items), 3) for x in [items[part][1], *rng.choice(vocab, 2)])) for i in range(120)] + [(200, "work one two"), (201, "äb c"), (202, "Äb C")]
    for i in range(0, 120, 3):  # some with a word changed
        w = rows[i][1].split()
        w[rng.integers(len(w))] = "zzz"
        rows[i] = (i, " ".join(w))

    def shingles_(t, m):
        w = re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
        return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}

    want = set()
    for i, t in items:
        m = min(5, len(t.split()))
        q = shingles_(t, m)
        want |= {(d, i, len(q & shingles_(x, m)), len(q)) for d, x in rows if len(q & shingles_(x, m)) >= math.ceil(0.8 * len(q))}
    extra = "k same w n p s0 h part item q n_shared m need sketch".split()
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in extra])
    items_ = spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit(1).alias(c) for c in extra])
    got = {tuple(r)[:4] for r in decontaminate.contained_items(docs_, items_).collect()}
    assert got == want
    assert {r.doc_id for r in decontaminate.decontaminated(docs_, items_).collect()} == {d for d, _ in rows} - {d for d, *_ in want}


def test_items_that_share_an_id_are_looked_up_apart(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    items = spark.createDataFrame([(1, one), (1, two), (None, one + " end"), (None, two + " stop here")], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"x {one} y"), (2, "nothing of it"), (3, f"{two} stop here")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in decontaminate.contained_items(rows, items).collect()}
    assert got == {(1, 1): (16, 16), (1, None): (16, 17), (3, 1): (16, 16), (3, None): (18, 18)}
    assert [r.doc_id for r in decontaminate.decontaminated(rows, items).collect()] == [2]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(0, 0.2, (400, 12)), 2)
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (None, None), (500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, []), (550, [0.5]), (100, v[100].tolist())]
    df = spark.createDataFrame([(i, x, 9) for i, x in rows], "vec_id long, embedding array<float>, score int")
    f = {i: np.pad(np.floor(256 * np.float32(x).astype(float)), (0, 12 - len(x))) for i, x in rows if i is not None and x and None not in x and not np.isnan(x).any()}
    want = set()
    for q in (i for i in f if i % 50 == 0):
        best = sorted(((-int(f[q] @ y), i) for i, y in f.items() if i != q))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk_maxscore.top_k(df).collect()} == want
    assert topk_maxscore.top_k(df.limit(0)).count() == 0 and topk_maxscore.top_k(df.where("vec_id = 100")).count() == 0


def test_max_score_splits_move_and_sums_are_exact(spark):
    rng = np.random.default_rng(4)
    for scale, kind in ((30, np.float64), (1 << 24, np.int64), (1 << 40, object)):
        n, d = 20_000 if kind is np.float64 else 300, 24
        rows = np.floor(rng.normal(0, 1, (n, d)) * np.linspace(2, 0.1, d) * scale).astype(np.int64)
        rows[n // 2] = rows[3]
        ids, m = np.arange(n) * 2, np.ascontiguousarray(rows.T)
        assert topk_maxscore.exact_type(rows[:2], rows) is kind
        m, splits = m.astype(kind), []
        for i in (3, 5):
            at, score = topk_maxscore.best_in_block(ids, m, 2 * i, m[:, i].copy(), m.max(axis=1), m.min(axis=1), 5, splits)
            full = [int(x) for x in rows.astype(object) @ rows[i].astype(object)]
            want = sorted((-x, j) for j, x in enumerate(full) if j != i)[:5]
            assert [(-int(s), int(a)) for a, s in zip(at, score)] == want
        if kind is np.float64:
            assert splits[0] == d and splits[1] < d and all(a >= b for a, b in zip(splits[:5], splits[1:5]))
    df = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.id, r.score) for r in topk_maxscore.top_k(df).orderBy("rank").collect()] == [(2, 65536 * (10**12 + 2)), (1, 65536 * (10**12 + 1))]


def test_chat_format(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\|x"
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 5, None, "é\n<|"), (3, None, "system", "s"), (None, 1, "assistant", "lost"), (4, 0, "a\\n\nb<|im_end|>", "\n\nx"), (4, 1, "assistant", LONG), (4, 2, "assistant", "日本 \U0001f600 \\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(df)).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        x = got[conv]
        assert x.n_turns == len(turns) and x.loss_chars == len(loss) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
    spliced = chat_format.formatted(df).collect()
    assert all(r.ids.count(chat_format.START) == 1 and r.ids.count(chat_format.END) == 1 and len(r.ids) == len(r["mask"]) for r in spliced)
    assert chat_format.digests(chat_format.formatted(df.limit(0))).count() == 0
    t = chat_format._tokenizer(chat_format.TOKENIZER)
    for r in spliced:
        plain = [chat_format.START, *t.encode(chat_format.escape_role(r.role or "") + "\n").ids]
        body = t.encode(chat_format.escape(r.text or "")).ids
        assert r.ids == [*plain, *body, chat_format.END, *t.encode("\n").ids]
        assert r["mask"] == [r.role == "assistant" and len(plain) <= i < len(plain) + len(body) for i in range(len(r.ids))]
    for role in ("a", "", "\n", "\\n", "a\\\n<|x", "<\\|"):
        assert chat_format.unescape_role(chat_format.escape_role(role)) == role and "\n" not in chat_format.escape_role(role)
    for s in ("<|", "<\\|x", "<\\\\|", "a<|b<|", "<<|", "|<", "<||", "<\\"):
        assert chat_format.unescape(chat_format.escape(s)) == s and "<|" not in chat_format.escape(s)


def test_sentencepiece(spark, docs, clashing):
    p = sentencepiece_viterbi.Pieces(sentencepiece_viterbi.read_pieces(sentencepiece_viterbi.MODEL))
    scores = {x: (s, i) for i, (x, s, kind) in enumerate(sentencepiece_viterbi.read_pieces(sentencepiece_viterbi.MODEL)) if kind == "n"}

    def brute(text):
        best = [(0.0, ())]
        for e in range(1, len(text) + 1):
            found = [(best[s][0] + scores[text[s:e]][0], s) for s in range(e) if text[s:e] in scores]
            top = max(found, key=lambda x: (x[0], -x[1]), default=(-math.inf, 0))
            spelled = best[e - 1][0] + p.spelled
            best.append((spelled, best[e - 1][1] + tuple(p.bytes[b] for b in text[e - 1].encode())) if spelled > top[0] else (top[0], best[top[1]][1] + (scores[text[top[1] : e]][1],)))
        return list(best[-1][1])

    for text in ("a", "  hello   world", "naïve 日本\n\nx", "tttttttt", "The MIT License,  ünder"):
        assert p.encode(text) == brute(("▁" + text).replace(" ", "▁"))
    for r in sentencepiece_viterbi.tokenised(clashing).collect():
        assert r.exact and r.n_tokens == len(r.ids)
    mixed = ["", "a▁▁ b▁", None, " ", "▁", "\n", " \n a", LONG, "▁x " * 50]
    ids, ends = p.encode_all(pa.array(mixed))
    data, at = sentencepiece_viterbi.Spelling(sentencepiece_viterbi.read_pieces(sentencepiece_viterbi.MODEL)).decode(ids, ends)
    assert [data.tobytes()[i:j].decode() for i, j in zip(at, at[1:])] == [t or "" for t in mixed] and ends[1] == 0
    rows = spark.createDataFrame([(1, p.encode("ein Wort\n")), (2, None), (3, [-1, None, 10**6]), (4, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in sentencepiece_viterbi.decoded(rows).orderBy("doc_id").collect()] == ["ein Wort\n", "", "", ""]
    assert [r.decoded for r in sentencepiece_viterbi.decoded(sentencepiece_viterbi.encoded(docs)).collect()] == [r[1] or "" for r in ROWS]
    assert sentencepiece_viterbi.tokenised(docs.limit(0)).count() == 0


def test_main_text(spark):
    par = "A long paragraph of the article with many words in it. " * 4
    page = f"<body><header><h1>Site</h1></header><div id=nav><a href=x>Home</a></div><div class=content><h1>Title</h1><p>{par}<p>Short.<p>{par}</div><div class='cookie-notice'>{par}</div><div id=comments><p>{par}</div><form>{par}</form><footer>(c)</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<article><p>a &lt;b&gt; &amp;amp; c\n d<script>x<p>y</script></article><aside>no</aside>"), (5, "u", "<nav><a>x</a><article><p>kept though the menu never ends"), (6, "u", "plain"), (6, "u", "plain")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = [(r.page_id, r.text) for r in html_linetext.main_texts(df).collect()]
    long_text = " ".join(par.split())
    assert sorted(got) == [(1, f"Title {long_text} Short. {long_text}"), (2, ""), (3, ""), (4, "a <b> &amp; c d"), (5, "kept though the menu never ends"), (6, "plain"), (6, "plain")]
    assert html_linetext.main_texts(df.limit(0)).count() == 0


def test_main_text_is_weighed_inside_and_outside_articles():
    body = ["The river rose over night and the road along the bank was closed to all. " * 3 + str(i) for i in range(6)]
    card = "<article><h3>More news</h3><p>A short teaser of another story that ran here.</p><a href=x>Read on</a></article>"
    page = "<body>" + "".join(f"<div>{x}</div>" for x in body) + "<hr>" * 4 + card * 3 + "</body>"
    assert html_linetext.main_text(page) == " ".join(body)
    links = "".join(f"<p><a href=x>Link to another page of this site {i}</a></p>" for i in range(5))
    read = " ".join(f"Link to another page of this site {i}" for i in range(5))
    assert html_linetext.main_text("<article>" + "".join(f"<p>{x}</p>" for x in body) + links + "</article>") == " ".join([*body, read])
    lines = [("x", 1, 1, False, 0, True)] * 5
    assert max(html_linetext.distribution(lines, 3, 120)[1]) < 123


PAR = "A paragraph of the article, with many words that tell of the river, the road and the bank, so that it runs on for long. " * 4


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "side-by-side", "share-prices", "no-ads with-nav", "sidebar", "content"])
def test_a_class_of_the_wrapper_never_drops_the_article(wrapper):
    page = f"<body><nav><a href=x>Home</a></nav><div class='{wrapper}'><h1>Title</h1><p>{PAR}</p><p>{PAR}</p></div><div class='left-sidebar'>Other stories of the week</div></body>"
    assert html_linetext.main_text(page) == " ".join(f"Title {PAR} {PAR}".split())


def test_short_linked_and_small_parts_of_the_article_stay():
    text = lambda page: html_linetext.main_text(page)
    flat = lambda *x: " ".join(" ".join(x).split())
    for open_, close in (("<body>", "</body>"), ("<body><article>", "</article></body>"), ("<body><div id=x>", "</div></body>")):
        assert text(f"{open_}<p>{PAR}</p><div class=ad>Buy</div><p>Short closing line.</p>{close}") == flat(PAR, "Short closing line.")
        assert text(f"{open_}<p><a href=x>First linked.</a></p><p>{PAR}</p><p><a href=x>Last linked.</a></p>{close}") == flat("First linked.", PAR, "Last linked.")
        assert text(f"{open_}<p>{PAR * 6}</p><aside>Buy</aside><h2>More</h2><p>{PAR}</p>{close}") == flat(PAR * 6, "More", PAR)
    assert text(f"<body><div>{PAR * 6}</div><nav><a>Home</a></nav><section><p>{PAR}</p></section></body>") == flat(PAR * 6, PAR)
    assert text(f"<article><div class='article-header'><h1>Title</h1><p>The lead.</p></div><p>{PAR}</p></article>") == flat("Title The lead.", PAR)
    gap = "<p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p><ul><li><a href=x>see</a></ul>"
    assert text(f"<div><p>{PAR}</p>{gap}<p>{PAR}</p></div>") == flat(PAR, "One. Two. Three. Four. see", PAR)


def test_what_is_not_the_article_goes_whatever_its_size():
    remark = "<p>" + PAR + "</p>"
    for name in ("comments", "post-comments", "comment-list", "disqus"):
        assert html_linetext.main_text(f"<body><div class=text><p>{PAR}</p></div><div id={name}>{remark * 9}</div></body>") == " ".join(PAR.split())
    for name in ("cookie-banner", "top-nav-bar", "site-footer", "ad-slot", "related-posts", "newsletter-signup", "main-menu", "page_header", "social-links"):
        assert html_linetext.marked(name), name
        assert html_linetext.main_text(f"<body><div class='x {name}'>{PAR}</div><div><p>{PAR}</p><p>{PAR}</p></div></body>") == " ".join(f"{PAR} {PAR}".split()), name
    assert not any(map(html_linetext.marked, ["article-header", "has-sidebar", "side-by-side", "share-prices", "content", "add", "navy", "sidewalk", "postcomments"]))


def test_main_text_reads_broken_and_long_pages_in_one_scan():
    import time

    for x in ("<script ", '<a "', "<a '\"", '<a href="', "<!--", "<a '<b \"", "</script ", '"<a ', "<p class='x", "&#x"):
        began = time.process_time()
        html_linetext.main_text(x * 200_000)  # 2 MB: hours, if the time grew with the square
        assert time.process_time() - began < 60, x
    words_ = "An unlinked sentence that goes on for a good while, as those of articles do. " * 3
    assert html_linetext.main_text(f"<div><p title='a > b' data-x=\"<p>no</p>\">{words_}<svg/><p>{words_}") == " ".join((words_ * 2).split())
    long_page = "<article>" + f"<p>{words_}</p>" * 5_000 + "</article>"
    assert html_linetext.main_text(long_page) == " ".join((words_ * 5_000).split())


def test_main_text_needs_no_article_mark():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    plain = [re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p) for p in pages]
    same = [html_linetext.main_text(a) == html_linetext.main_text(b) for a, b in zip(pages, plain)]
    assert np.mean(same) > 0.95


def test_classifiers_score_every_row(spark, docs, clashing):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    train = []
    for i in range(240):
        bad, toxic = i % 2 == 0, i % 3 == 0
        w = list(rng.choice(vocab, 40)) + (["idiot"] * 2 if toxic else [])
        rng.shuffle(w)
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."
        train.append((1000 + i, text + "\n" + text, "en", "a", 1))
    labels = spark.createDataFrame([(1000 + i, int(i % 2 == 1), int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    every = docs.unionByName(spark.createDataFrame(train, DOCS))
    q = {r.doc_id: r.score for r in quality_crf.quality_scores(every, labels).collect()}
    t = {r.doc_id: r.score for r in toxicity_cnn.toxicity_scores(every, labels).collect()}
    held_q = [i for i in range(240) if zlib.crc32(str(1000 + i).encode()) % 4 == 2]
    held_t = [i for i in range(240) if zlib.crc32(str(1000 + i).encode()) % 5 == 0]
    assert np.mean([(q[1000 + i] >= 0.7) == (i % 2 == 1) for i in held_q]) > 0.95
    assert np.mean([(t[1000 + i] >= 0.5) == (i % 3 == 0) for i in held_t]) > 0.9
    assert all(0 <= x <= 1 for x in [*q.values(), *t.values()])
    assert [r.score for r in quality_crf.quality_scores(docs, labels.limit(0)).collect()] == [1.0] * len(ROWS)
    assert {r.score for r in toxicity_cnn.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert quality_crf.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_score_against_a_plain_field():
    """Features, forward-backward by all labellings, length weights and calibration, line by line."""
    import itertools

    texts = ["Good line here.\nanother one, of words\n\nBAD BAD BAD!!", "", None, "x\n", "12 34 ab ab"]
    f, size, first = quality_crf.line_features(pa.array(texts))
    lines = [(t or "").split("\n") for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in lines]
    classes = [set(map(chr, range(65, 91))), set(map(chr, range(97, 123))), set("0123456789"), set(".,;:?'\"-"), set("!#$%&*|<>{}[]()/\\@^~_=+`")]
    for row, n, text in zip(f, size, (x for t in lines for x in t)):
        w, raw = text.split(), len(text) + (0 if text is None else 0)
        chars = int(n)
        assert chars - raw in (0, 1)  # a line has its break
        lower = [x.lower() for x in w]
        shares = [sum(c in k for c in text) / max(chars, 1) for k in classes]
        want = [math.log1p(chars), math.log1p(len(w)), *shares, 0.0, sum(c in classes[0] for c in text) / max(sum(c in classes[0] | classes[1] for c in text), 1), len(set(lower)) / max(len(w), 1), sum(a == b for a, b in zip(lower, lower[1:])) / max(len(w), 1), min(chars / max(len(w), 1), 30) / 10, not w]
        assert np.allclose(row, want), (text, row, want)
    rng = np.random.default_rng(9)
    m = quality_crf.Field(rng.normal(0, 1, quality_crf.OWN), rng.uniform(0.5, 2, quality_crf.OWN), rng.normal(0, 0.5, 3 * quality_crf.OWN + 1), rng.normal(0, 1, (2, 2)), 1.3, -0.2)
    got = m.scores(pa.array(texts))
    for d in range(len(texts)):
        z = np.clip((f[first[d] : first[d + 1]] - m.mean) / m.scale, -4, 4)
        zero = np.zeros(quality_crf.OWN)
        u = [np.concatenate([z[i], z[i - 1] if i else zero, z[i + 1] if i + 1 < len(z) else zero, [1.0]]) @ m.weights for i in range(len(z))]
        total, good = 0.0, np.zeros(len(z))
        for y in itertools.product((0, 1), repeat=len(z)):
            e = math.exp(sum(a * b for a, b in zip(u, y)) + sum(m.trans[a, b] for a, b in zip(y, y[1:])))
            total, good = total + e, good + e * np.array(y)
        w = size[first[d] : first[d + 1]] + 1
        q = min(max(float((good / total) @ w / w.sum()), 1e-4), 1 - 1e-4)
        assert math.isclose(got[d], 1 / (1 + math.exp(-(1.3 * math.log(q / (1 - q)) - 0.2))), rel_tol=1e-6)


def test_texts_of_many_lines_score_as_by_one_chain(monkeypatch):
    rng = np.random.default_rng(4)
    m = quality_crf.Field(rng.normal(0, 1, quality_crf.OWN), rng.uniform(0.5, 2, quality_crf.OWN), rng.normal(0, 0.5, 3 * quality_crf.OWN + 1), rng.normal(0, 1, (2, 2)), 1.3, -0.2)
    some = ["Good line here.", "", "BAD BAD BAD!!", "12 34 ab ab", "a"]
    texts = ["\n".join(some[i] for i in rng.integers(5, size=n)) for n in (1, 2, 3, 255, 256, 257, 258, 700, 1, 2049, 5000)] + ["\n" * 3000, None, "", "x\n"]
    f, size, first = quality_crf.line_features(pa.array(texts))
    want = 1 / (1 + np.exp(-(1.3 * m.raw(f, size, first) - 0.2)))  # all lines in memory, one step a line
    for lines, many in ((1 << 16, 2048), (512, 1), (1024, 300), (700, 0)):
        monkeypatch.setattr(quality_crf, "LINES", lines)
        monkeypatch.setattr(quality_crf, "MANY", many)
        assert np.allclose(m.scores(pa.array(texts)), want, rtol=1e-9)
    u, s, _ = m.unary(pa.array(texts))
    assert np.allclose(u, m.inputs(f, first) @ m.weights) and (s == size).all()


def test_a_long_text_of_line_breaks_is_scored_in_bounded_time_and_memory():
    import subprocess
    import sys
    import time

    rng = np.random.default_rng(4)
    m = quality_crf.Field(np.zeros(quality_crf.OWN), np.ones(quality_crf.OWN), rng.normal(0, 0.5, 3 * quality_crf.OWN + 1), rng.normal(0, 1, (2, 2)))
    began = time.process_time()
    assert 0 < m.scores(pa.array(["\n" * (1 << 20)]))[0] < 1
    assert time.process_time() - began < 20
    code = "import numpy as np, pyarrow as pa, resource, sys\nfrom flowengine.llm import quality_crf as q\nm = q.Field(np.zeros(q.OWN), np.ones(q.OWN), np.ones(3 * q.OWN + 1) / 9, np.eye(2))\nt = pa.array(['\\n' * (4 << 20)])\nm.scores(pa.array(['x']))\na = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nm.scores(t)\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    more = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=".").stdout)
    assert more < 400, more


def test_toxicity_score_against_a_plain_convolution():
    texts = ["you are a total idiot, really", "one", "", None, "a b", "word " * 70]
    ids, first = toxicity_cnn.word_ids(pa.array(texts))
    net = toxicity_cnn.Network(3)
    rng = np.random.default_rng(1)
    net.table = rng.normal(0, 1, net.table.shape).astype(np.float32)
    net.out, net.a, net.b = rng.normal(0, 1, net.out.shape).astype(np.float32), 1.2, 0.3
    got = net.score(ids, first)
    block, toxicity_cnn.BLOCK = toxicity_cnn.BLOCK, 7  # windows that cross blocks
    assert np.allclose(net.score(ids, first), got, rtol=1e-4)
    toxicity_cnn.BLOCK = block
    for d in range(len(texts)):
        e = [sum(net.table[i] for i in row) for row in ids[first[d] : first[d + 1]]]
        best = []
        for w, width in enumerate(toxicity_cnn.WIDTHS):
            answers = [sum(e[i + k] @ net.filters[w][k] for k in range(width)) for i in range(len(e) - width + 1)]
            best += np.max([np.zeros(toxicity_cnn.FILTERS), *answers], axis=0).tolist()
        z = 1.2 * (float(np.dot(best, net.out)) + net.bias) + 0.3
        assert math.isclose(got[d], 1 / (1 + math.exp(-z)), rel_tol=1e-3, abs_tol=1e-6)


def test_samples_of_labelled_rows_are_bounded(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c" * 40_000), (3, None), (None, "x")] + [(i, "t") for i in range(10, 60)]
    docs_ = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1)] + [(i, i % 2) for i in range(10, 60)], "doc_id long, quality int")
    got = labelled_sample(docs_, labels, "quality", F.lit(True), 10).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 20 and 2 not in {r.doc_id for r in got}
    every = labelled_sample(docs_, labels, "quality", F.lit(True), 1000)
    assert sorted(r.doc_id for r in every.collect()) == [1, 3, *range(10, 60)] and every.columns == ["doc_id", "text", "_row", "_label"]


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(5)
    m = quality_crf.Field(np.zeros(1), np.ones(1), np.zeros(1), rng.normal(0, 1, (2, 2)))
    u, first = rng.normal(0, 1, 7), np.array([0, 4, 5, 7])
    p, _ = m.marginals(u, first)
    for a, b in zip(first, first[1:]):
        total, good = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            s = math.exp(sum(u[a + i] * v for i, v in enumerate(y)) + sum(m.trans[x, z] for x, z in zip(y, y[1:])))
            total, good = total + s, good + s * np.array(y)
        assert np.allclose(p[a:b], good / total)


def test_stages_take_any_rows(spark, docs, clashing):
    folder = _saved(spark, docs)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    for rows in (docs, clashing, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, rows, folder)
            assert out.columns == rows.columns, name
            assert out.count() <= rows.count()
        assert corpus_pipeline.STAGES[4][1](spark, rows, folder).count() == rows.count()
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect())
    assert kept == [1, 2, 4, 5, 7, 8, 9]
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "ids", "n_tokens", "n_spelled", "exact"]


def test_one_word_of_several_megabytes(spark):
    """Op 8 scores it like any other text, op 10 takes it apart and puts it together again."""
    long = "idiot" * 1_200_000
    rows = [(1, long, "en", "a", len(long)), (2, "you idiot", "en", "a", 9), (3, "a fine day", "en", "a", 10), (4, f"{long} fine", None, "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity_cnn.toxicity_scores(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4] and all(0 <= r.score <= 1 for r in got)
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", f"{long}<|im_end|>")], "conv_id long, turn long, role string, text string")
    x = chat_format.digests(chat_format.formatted(turns)).first()
    loss = f"{long}<|im_end|>"
    assert x.n_turns == 2 and x.loss_chars == len(loss) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_pipeline_runs_on_empty_tables(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    for empty in (("documents",), ("labels",), ("benchmark",), ("documents", "labels", "benchmark")):
        folder = tmp_path / "-".join(empty)
        for name in ("documents", "labels", "benchmark"):
            rows = spark.read.parquet(f"{data}/{name}.parquet")
            (rows.limit(0) if name in empty else rows).write.parquet(f"{folder}/{name}.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == ["doc_id", "ids", "n_tokens", "n_spelled", "exact"]
        assert (out.count() == 0) == ("documents" in empty), empty  # classifiers without labels reject nothing
