"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of three rows of one hashed embedding table: those of the word and of its first 4 and first 5 bytes,
so a word not seen in training shares what its stem has learned. Filters of widths 1, 2 and 3 run over the words, max
pooling over the whole text keeps each filter's strongest answer, and a logistic layer joins them. Scores are calibrated
on a part of the sample kept from training, and a decision threshold is chosen there for every language.

The fit uses a bounded sample of labelled documents (`PER_CLASS` of each class, whole texts). Only the text enters a
score; the language picks the threshold of the decision `flagged`. For scoring, filters are multiplied into the table
once, so a word costs three look-ups. Defined results: a null or empty text scores as one without words; repeated rows
score alike; without labels of both classes every score is the share of label 1 (0 without labels); an unknown or null
language has the threshold 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_crf import platt
from .shared import bucket, extended, labelled_sample, table, tidy
from .tokens import BY_SPACE, Words, chunks

PER_CLASS = 1_500
ROWS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
THRESHOLD = 0.5
#: Words end at ASCII marks too, so a word before a comma is the word itself.
MEMBER = BY_SPACE.copy()
MEMBER[:128] &= np.array([chr(i).isalnum() for i in range(128)])
#: Words convolved at a time.
BLOCK = 1 << 15
_SLOTS = [(w, k) for w in range(len(WIDTHS)) for k in range(WIDTHS[w])]


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) table rows of every word, and where each text's words begin."""
    w = Words(column, MEMBER)
    return np.stack([(w.hashes(n, seed) >> np.uint64(20)) % np.uint64(ROWS) for seed, n in enumerate((0, 4, 5))], 1).astype(np.int32), w.first


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (ROWS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32)
        self.bias, self.a, self.b = -1.0, 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def tables(self) -> np.ndarray:
        """Every table row times every filter row: (ROWS, slots * FILTERS)."""
        return np.hstack([self.table @ self.filters[w][k] for w, k in _SLOTS])

    def pooled(self, ids: np.ndarray, first: np.ndarray, tables: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Strongest answer of every filter (at least 0), and the word it begins at (-1: none), for each text."""
        docs, size = len(first) - 1, np.diff(first)
        best = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        where = np.full(best.shape, -1, np.int64)
        tables = self.tables() if tables is None else tables
        doc = np.repeat(np.arange(docs), size)
        for i in range(0, len(ids), BLOCK):
            j = min(len(ids), i + BLOCK)
            part = ids[i : min(len(ids), j + max(WIDTHS) - 1)]
            x = tables[part[:, 0]]
            x += tables[part[:, 1]]
            x += tables[part[:, 2]]
            slot = 0
            for w, width in enumerate(WIDTHS):
                n = min(j - i, len(part) - width + 1)
                if n > 0:
                    y = x[:n, slot * FILTERS : (slot + 1) * FILTERS].copy()
                    for k in range(1, width):
                        y += x[k : n + k, (slot + k) * FILTERS : (slot + k + 1) * FILTERS]
                    d = doc[i : i + n]
                    y[first[d + 1] - np.arange(i, i + n) < width] = 0  # a window ends with its text
                    cuts = np.flatnonzero(np.diff(d, prepend=-1))
                    top = np.maximum.reduceat(y, cuts, axis=0)
                    at, cols = d[cuts], slice(w * FILTERS, (w + 1) * FILTERS)
                    if self.learning:
                        for c, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], n])):
                            arg = y[lo:hi].argmax(0)
                            up = top[c] > best[at[c], cols]
                            where[at[c], cols] = np.where(up, i + lo + arg, where[at[c], cols])
                    best[at, cols] = np.maximum(best[at, cols], top)
                slot += width
        return best, where

    learning = False

    def raw(self, ids: np.ndarray, first: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        return self.pooled(ids, first, tables)[0] @ self.out + self.bias

    def score(self, ids: np.ndarray, first: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(ids, first, tables) + self.b, -40, 40)))


def fit(texts: list[np.ndarray], label: np.ndarray, lang: list[str], epochs: int = 8, least_steps: int = 300, rate: float = 0.08, batch: int = 64, seed: int = 7) -> Network:
    """Adagrad on the logistic loss, both classes weighing the same; gradients reach only the words that won the pooling."""
    net, rng = Network(seed), np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept = order[: max(1, len(texts) // 5)]  # for calibration
    train = order[len(kept) :]
    if len(set(label[train])) < 2 or len(set(label[kept])) < 2:
        kept = train = order
    sums = [np.full_like(x, 1e-2) for x in (net.table, *net.filters, net.out)]
    net.learning = True

    def step(x: np.ndarray, g: np.ndarray, s: np.ndarray, at=slice(None)) -> None:
        s[at] += g * g
        x[at] -= rate * g / np.sqrt(s[at])

    weight = np.where(label == 1, 0.5 / max(label[train].mean(), 1e-9), 0.5 / max(1 - label[train].mean(), 1e-9)).astype(np.float32)
    for _ in range(max(epochs, -(-least_steps * batch // len(train)))):  # small samples take more rounds
        rng.shuffle(train)
        for i in range(0, len(train), batch):
            some = train[i : i + batch]
            ids = np.concatenate([texts[d] for d in some])
            first = np.concatenate([[0], np.cumsum([len(texts[d]) for d in some])])
            rows, flat = np.unique(ids, return_inverse=True)
            flat = flat.reshape(ids.shape)
            local = np.hstack([net.table[rows] @ net.filters[w][k] for w, k in _SLOTS])  # only the rows in use
            best, where = net.pooled(flat, first, local)
            p = 1 / (1 + np.exp(-np.clip(best @ net.out + net.bias, -30, 30)))
            g = ((p - label[some]) * weight[some] / len(some)).astype(np.float32)
            back = g[:, None] * net.out  # on the pooled answers
            grow = np.zeros((len(rows), DIM), np.float32)
            turn = [np.zeros_like(x) for x in net.filters]
            d, c = np.nonzero(where >= 0)
            for w, width in enumerate(WIDTHS):
                mine = c // FILTERS == w
                dd, cc, f = d[mine], c[mine], c[mine] % FILTERS
                b = back[dd, cc]
                for k in range(width):
                    words = flat[where[dd, cc] + k]
                    e = net.table[rows[words]].sum(1)
                    np.add.at(turn[w][k].T, f, b[:, None] * e)
                    for q in range(3):
                        np.add.at(grow, words[:, q], b[:, None] * net.filters[w][k][:, f].T)
            used = np.flatnonzero(grow.any(1))
            step(net.table, grow[used] + 1e-5 * net.table[rows[used]], sums[0], rows[used])
            for x, t, s in zip(net.filters, turn, sums[1:4]):
                step(x, t + 1e-4 * x, s)
            step(net.out, best.T @ g + 1e-4 * net.out, sums[4])
            net.bias -= 0.5 * rate * float(g.sum())
    net.learning = False
    ids, first = np.concatenate([texts[d] for d in kept]), np.concatenate([[0], np.cumsum([len(texts[d]) for d in kept])])
    net.a, net.b = platt(net.raw(ids, first), label[kept])
    score = net.score(ids, first)
    for name in sorted({lang[d] for d in kept}):
        mine = np.array([lang[d] == name for d in kept])
        net.thresholds[name] = _threshold(score[mine], label[kept][mine])
    return net


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """Of 0.3 to 0.7 the threshold with the fewest errors, the nearest to 0.5 of equal ones."""
    grid = np.round(np.arange(0.3, 0.701, 0.02), 2)
    errors = [np.count_nonzero((score >= t) != label) for t in grid]
    return float(min(zip(errors, np.abs(grid - THRESHOLD), grid))[2])


def trained(docs: DataFrame, labels: DataFrame, label: str, learn, key: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = PER_CLASS):
    """A Network, or a constant where the labels have one class at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            ids, first = word_ids(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("lang"), pa.array([ids[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], ["label", "lang", "ids"])

    some = labelled_sample(docs.select(key, F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang")), labels, label, learn, per_class, key)
    rows = some.select("text", "lang", F.col("_label").cast("int").alias("label")).mapInArrow(tidy(run), "label int, lang string, ids binary").collect()
    rows.sort(key=lambda r: (r.label, r.lang, bytes(r.ids)))  # the same fit whatever the order of arrival
    y = np.array([r.label for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    return fit([np.frombuffer(r.ids, np.int32).reshape(-1, 3) for r in rows], y, [r.lang for r in rows])


def scored(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """docs, all columns, with the score of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one table of ROWS x DIM numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = None if isinstance(net, float) else net.tables()
        for b in chunks(batches, name=text):
            s = np.full(b.num_rows, net) if tables is None else net.score(*word_ids(b.column(text)), tables)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype(np.float64))], [*b.schema.names, out])

    return docs.mapInArrow(tidy(run), extended(docs, **{out: T.DoubleType()}))


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", out: str = "score", flag: str = "flagged") -> DataFrame:
    """docs, all columns, with the score in `out` and the decision in `flag` (names that docs does not have); learns from labelled rows whose bucket of 5 is not 0."""
    model = trained(docs, labels, label, bucket(key, 5) != 0, key, text, lang)
    limit = F.lit(THRESHOLD)
    for name, t in sorted([] if isinstance(model, float) else model.thresholds.items()):
        limit = F.when(F.col(lang) == name, t).otherwise(limit)
    return scored(docs, model, text, out).withColumn(flag, F.col(out) >= limit)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "flagged")
