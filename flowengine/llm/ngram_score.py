"""Language-model scores of whole texts by a trigram model of the corpus, kept in sharded Elias-Fano tries.

1. vocabulary(): counts of the training tokens (one pass, counts added before the shuffle); from them N, V and the
   words with more than a shard's share of all tokens, of which there are fewer than shards.
2. Texts are dealt into parts of some MB, as compressed pieces. Each part sorts its different trigrams and sends them, with their training
   counts, to the shard that owns their first word; its words go to the shard that owns the word. The pairs of a
   frequent word spread over as many shards as its share of the tokens asks for, and a part asks each of them.
3. Each shard adds up the counts, builds its trie (see elias_fano), and answers every part: training counts of words,
   numbers of successors, quantised pair counts, weights and smoothed trigram probabilities.
4. Each part puts its answers to its tokens: p1 = (c + 1) / (N + V + 1); p2 = (c2 + T p1) / (C + T);
   p3 = c3 / (C + T) + T / (C + T) p2 (Witten-Bell interpolation), from the start of the text with what context it has.

All counts cover all training texts; nothing is pruned or capped. Words are 64-bit hashes, successors in a context 32-bit
ones: in a context of k successors a new word meets a known one with the chance k / 2 ** 32. A score is the log10 probability of the whole text, so it falls with the text's length, and it is higher for what the corpus says
often: a document that occurs twice is part of what its own score learnt from, held-out rows are not. Parts and shards are
as many as the input has part_bytes, and each part has a message for each shard: 14 million small ones at 30 GB; larger
inputs want larger parts, and executors to hold them. Defined results: a null or empty text has one token, the end; a null doc_id is a
training row; repeated rows count each and score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import STEP, NgramTrie, count_of, prob_of
from .shared import cut, release, table, tidy
from .tokens import Words, chunks, mix

PART_BYTES = 8 << 20
END = np.uint64(0x51ED270B7A14C9D3)
_U = np.uint64


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included, and where each text begins."""
    w = Words(column)
    return np.insert(w.hashes(), w.first[1:], END), w.first + np.arange(len(w.first))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(h, c): count of every different token of the rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 32 << 20):
            h, c = np.unique(_tokens(b.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return rows.where(~F.col("held_out")).select("text").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Part:
    """The different words, pairs and trigrams of one part, in the order of their hashes, and which shard owns each."""

    def __init__(self, group: pa.Table, shards: int, spread: tuple[np.ndarray, np.ndarray]):
        self.tokens, self.first = _tokens(group.column("text").chunk(0))
        n = len(self.tokens)
        times = np.where(group.column("held_out").to_numpy(), 0, group.column("copies").to_numpy())  # how often a text was learnt from
        times = np.repeat(times.astype(np.int32 if n * int(times.max(initial=0)) < 1 << 31 else np.int64), np.diff(self.first))
        self.words, w = np.unique(self.tokens, return_inverse=True)
        end = np.searchsorted(self.words, END)
        del self.tokens
        w = w.astype(np.int32)
        one = (w + 1).astype(np.uint32)  # 0: nothing stands there
        two, three = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        two[:-1], three[:-2] = one[1:], one[2:]
        ends = np.flatnonzero(w == end)
        two[ends], three[ends], three[ends[ends > 0] - 1] = 0, 0, 0
        bits = _U(len(self.words).bit_length())
        if 3 * int(bits) <= 64:
            key = one.astype(_U)
            for more in (two, three):
                key <<= bits
                key |= more
            order = np.argsort(key).astype(np.int32)
            key = key[order]
            new = np.ones(n, bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            del key
        else:
            order = np.lexsort((three, two, one))
            new = np.ones(n, bool)
            new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0) | (np.diff(three[order]) != 0)
        self.of_token = np.empty(n, np.int32)  # the trigram that begins at each token
        self.of_token[order] = np.cumsum(new, dtype=np.int32) - 1
        at = np.flatnonzero(new)
        pick = order[at]
        a, b, c = one[pick], two[pick], three[pick]
        del one, two, three, new, pick
        self.count = np.add.reduceat(times[order], at)
        del order
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.pair_of = np.cumsum(fresh, dtype=np.int32) - 1  # of each trigram
        pairs = np.flatnonzero(fresh)
        hashes = np.concatenate([np.zeros(1, _U), self.words])
        self.a, self.b2, self.c3 = (a[pairs] - 1).astype(np.int32), (hashes >> _U(32)).astype(np.uint32)[b[pairs]], (hashes >> _U(32)).astype(np.uint32)[c]
        self.word_count = np.bincount(w, times, len(self.words)).astype(np.int64)
        self.word_of_token, self.shards = w, shards
        # pairs lie where their first word does; those of a frequent word go to several shards in a row
        home = (mix(self.words) % _U(shards)).astype(np.int64)
        over = np.ones(len(self.words), np.int64)
        _, mine, known = np.intersect1d(self.words, spread[0], assume_unique=True, return_indices=True)
        over[mine] = spread[1][known]
        self.word_shard, self.pair_shard = home, ((home[self.a] + (mix(hashes)[b[pairs]] % over[self.a].astype(_U)).astype(np.int64)) % shards).astype(np.int32)
        self.ask: dict[int, list[int]] = {}  # shards that hold successors of a frequent word, whether this part has such pairs or not
        for w in mine.tolist():
            for j in range(int(over[w])):
                self.ask.setdefault((int(home[w]) + j) % shards, []).append(w)

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, words, count of each that it owns, pairs of each word, pairs, trigrams): indices into this part."""
        tri_shard = self.pair_shard[self.pair_of]
        orders = [np.argsort(x, kind="stable").astype(np.int32) for x in (self.word_shard, self.pair_shard, tri_shard)]
        bounds = [np.searchsorted(x[o], np.arange(self.shards + 1)) for x, o in zip((self.word_shard, self.pair_shard, tri_shard), orders)]
        del tri_shard
        for s in range(self.shards):
            own, pairs, tris = (o[b[s] : b[s + 1]] for o, b in zip(orders, bounds))
            words = np.unique(np.concatenate([own, self.a[pairs], np.array(self.ask.get(s, []), np.int32)]))
            if len(words):
                yield s, words, np.where(self.word_shard[words] == s, self.word_count[words], 0), np.bincount(np.searchsorted(words, self.a[pairs]), minlength=len(words)), pairs, tris


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays one after another, each compressed where that makes it shorter, behind (type, size, bytes kept) of each."""
    kept = [min(raw := x.tobytes(), pa.compress(raw, "zstd", asbytes=True), key=len) if x.size else b"" for x in arrays]
    head = np.array([len(arrays)] + [v for x, k in zip(arrays, kept) for v in (ord(x.dtype.char), x.nbytes, len(k))], np.int64)
    return head.tobytes() + b"".join(kept)


def unpack(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for kind, size, kept in head.tolist():
        part = memoryview(raw)[at : at + kept]
        out.append(np.frombuffer(part if kept == size else pa.decompress(part, size, "zstd"), np.dtype(chr(kind))))
        at += kept
    return out


def deal(rows: DataFrame) -> DataFrame:
    """(part, data): the rows of each part as compressed pieces, one for each slice of the input that holds some.

    Equal rows of a slice become one, with their number, so a row that is repeated all over the table does not fill the
    part that it belongs to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in chunks(batches, 16 << 20):
            part, row = b.column("part").to_numpy(), b.column("row").to_numpy()
            order = np.lexsort((row, part))
            b, part, row = b.select(["k", "text", "held_out"]).take(pa.array(order)), part[order], row[order]
            new = np.ones(len(part), bool)
            maybe = np.flatnonzero((row[1:] == row[:-1]) & (part[1:] == part[:-1]))  # equal hashes; now the rows themselves
            one, other = b.take(pa.array(maybe + 1)), b.take(pa.array(maybe))
            same = np.ones(len(maybe), bool)
            for x, y in zip(one.columns, other.columns):
                both_null = pc.and_(pc.is_null(x), pc.is_null(y))
                same &= pc.or_(pc.fill_null(pc.equal(x, y), False), both_null).to_numpy(zero_copy_only=False)
            new[maybe[same] + 1] = False
            at = np.flatnonzero(new)
            b, part = b.take(pa.array(at)).append_column("copies", pa.array(np.diff(at, append=len(new)))), part[at]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            data = []
            for i, j in zip(cuts, [*cuts[1:], len(part)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.slice(i, j - i))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(data, pa.binary())], ["part", "data"])

    return rows.select("k", "text", "held_out", "part", "row").mapInArrow(tidy(run), "part long, data binary")


def dealt_rows(group: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in group.column("data")]).combine_chunks()


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint32 if x.max() < 1 << 32 else _U)


def _rows(rows: list[tuple[int, int, bytes]], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.table({names[0]: pa.array(cols[0], pa.int64()), names[1]: pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary())})


def answer(group: pa.Table) -> pa.Table:
    """Build the trie of one shard and answer its parts."""
    parts = group.column("part").to_pylist()
    sent = [unpack(x) for x in group.column("data").to_pylist()]
    words, inverse = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([s[1] for s in sent]), len(words)).astype(np.int64)
    del inverse
    key2 = np.concatenate([(np.repeat(np.searchsorted(words, s[0]), s[2]).astype(_U) << _U(32)) | s[3].astype(_U) for s in sent])
    pairs, of2 = np.unique(key2, return_inverse=True)
    del key2
    sizes = np.concatenate([s[4] for s in sent])
    key3 = (np.repeat(of2.astype(_U), sizes) << _U(32)) | np.concatenate([s[5] for s in sent]).astype(_U)
    del of2, sizes
    order = np.argsort(key3).astype(np.int32)
    key3 = key3[order]
    new = np.ones(len(key3), bool)
    np.not_equal(key3[1:], key3[:-1], out=new[1:])
    at = np.flatnonzero(new)
    triples, count3 = key3[at], np.add.reduceat(np.concatenate([s[6] for s in sent]).astype(np.int64)[order], at) if len(at) else np.zeros(0, np.int64)
    del key3, order, new, at
    # only what training texts hold goes into the trie; indices close up
    triples, count3 = triples[count3 > 0], count3[count3 > 0]
    of = (triples >> _U(32)).astype(np.int64)
    count2 = np.bincount(of, count3, len(pairs)).astype(np.int64)
    kept2 = count2 > 0
    triples = ((np.cumsum(kept2) - 1)[of].astype(_U) << _U(32)) | (triples & _U(0xFFFFFFFF))
    pairs = pairs[kept2]
    of = (pairs >> _U(32)).astype(np.int64)
    kept1 = np.bincount(of, minlength=len(words)) > 0
    pairs = ((np.cumsum(kept1) - 1)[of].astype(_U) << _U(32)) | (pairs & _U(0xFFFFFFFF))
    trie = NgramTrie(words[kept1], pairs, count2[kept2], triples, count3)
    del triples, count3, pairs, count2, kept2, of
    out = []
    shard = group.column("shard")[0].as_py()
    for part, s in zip(parts, sent):
        i = trie.words.find(s[0])
        j = trie.pair(np.repeat(i, s[2]), s[3])
        k = trie.triple(np.repeat(j, s[4]), s[5])
        out.append((part, shard, pack(_small(counts[np.searchsorted(words, s[0])]), _small(trie.successors(s[0])), trie.take(trie.pair_codes, j), trie.take(trie.weight_codes, j), trie.take(trie.triple_codes, k), np.array([trie.step]))))
    del trie, sent
    release()
    return _rows(out, ["part", "shard"])


def lm_scores(docs: DataFrame, held_out: DataFrame | None = None, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; `held_out` is a Column of docs."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    counts = cut(vocabulary(rows))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    parts = max(math.ceil(size / part_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("row", F.xxhash64("k", "text", "held_out")).withColumn("part", F.pmod(F.xxhash64("k", "text"), F.lit(parts)))
    key_type = docs.schema[key].dataType.simpleString()
    z = float(n + v + 1)
    # words with more than a shard's share of all tokens: at most `parts` of them
    often = sorted((r.h % (1 << 64), -(-r.c * parts // n)) for r in counts.where(F.col("c") * parts > n).collect())
    spread = np.array([h for h, _ in often], _U), np.array([min(k, parts) for _, k in often], np.int64)

    def send(group: pa.Table) -> pa.Table:
        p, part, out = Part(dealt_rows(group), parts, spread), group.column("part")[0].as_py(), []
        sizes3 = np.bincount(p.pair_of)
        for s, words, counts, sizes, pairs, tris in p.slices():
            out.append((s, part, pack(p.words[words], _small(counts), _small(sizes), p.b2[pairs], _small(sizes3[pairs]), p.c3[tris], _small(p.count[tris]))))
        return _rows(out, ["shard", "part"])

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = dealt_rows(group)
        p = Part(group, parts, spread)
        got = {s: unpack(x) for s, x in zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist())}
        c1, t1 = np.zeros(len(p.words)), np.zeros(len(p.words))
        c2, weight, p3 = np.zeros(len(p.a), np.uint8), np.zeros(len(p.a), np.uint8), np.zeros(len(p.pair_of), np.uint8)
        steps = np.full(parts, STEP)  # of each shard
        for s, words, _, _, pairs, tris in p.slices():
            total, follow, code2, code_w, code3, (steps[s],) = got[s]
            c1[words] += total  # only the owner counts
            t1[words] += follow
            c2[pairs], weight[pairs], p3[tris] = code2, code_w, code3
        w, first = p.word_of_token, p.first
        at = np.arange(len(w)) - np.repeat(first[:-1], np.diff(first))  # place in the text
        uni = (c1[w] + 1) / z
        base = np.log10(uni)
        prob = uni.copy()
        x = np.flatnonzero(at >= 1)
        total, follow = c1[w[x - 1]], t1[w[x - 1]]
        prob[x] = np.where(total > 0, (count_of(c2[p.pair_of[p.of_token[x - 1]]]) + follow * uni[x]) / np.maximum(total + follow, 1), uni[x])
        x = np.flatnonzero(at >= 2)
        tri = p.of_token[x - 2]
        pair = p.pair_of[tri]
        step = steps[p.pair_shard[pair]]
        lam = prob_of(weight[pair], step)
        prob[x] = np.where(lam > 0, prob_of(p3[tri], step) + lam * prob[x], prob[x])
        total = lambda v: np.add.reduceat(v, first[:-1])
        columns = [group.column("k"), group.column("held_out"), group.column("copies"), np.diff(first), total((c1[w] > 0).astype(np.int64)), np.full(len(first) - 1, n), total(base), total(np.log10(np.minimum(prob, 1.0)))]
        return pa.table(columns, names=["k", "held_out", "copies", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    dealt = deal(dealt)
    answers = dealt.groupBy("part").applyInArrow(send, "shard long, part long, data binary").groupBy("shard").applyInArrow(answer, "part long, shard long, data binary")
    out = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, f"k {key_type}, held_out boolean, copies long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    # a row's copies are those of one slice of the input
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies").withColumnRenamed("k", key)


def op1_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
