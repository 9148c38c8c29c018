"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its own characters and words, and those of the lines before and after it. The field labels
each line good or bad; forward-backward gives each line's marginal, and the marginals, weighted by the lines' lengths,
make the document's quality, calibrated on the training documents. Features are made for a bounded number of lines at a
time. A text of many lines is a chain of blocks: the blocks' 2 x 2 products advance together, carry the states from block
to block, and give the marginals of a stretch of lines at a time, so its memory is a few numbers a line.

Trained in numpy on the driver from the line features of a bounded sample of labelled documents (`PER_CLASS` of each
class), whose lines take the label of the document. Only the text enters a score. Defined results: a null or empty text
is one empty line and gets the score of that; repeated rows score alike; without labels of both classes every score is
the share of label 1 (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bucket, extended, labelled_sample, table, tidy
from .tokens import Words, chunks, gathered, mix, text_bytes

PER_CLASS = 1_500
THRESHOLD = 0.7
_LF, _U = 10, np.uint64
#: Bytes of text whose lines a task holds at a time.
_CHUNK = 2 << 20
#: Lines whose features are held at a time, lines from which a text is read by blocks, and lines of a block.
LINES, MANY, BLOCK = 1 << 16, 2_048, 256
#: Character classes: upper case, lower case, digits, marks that end sentences, other marks, bytes beyond ASCII.
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b".,;:?'\"-", b"!#$%&*|<>{}[]()/\\@^~_=+`", range(128, 256)]
_TABLE = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _TABLE[list(_c)] = _k
OWN = 13


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes, first[d] .. first[d + 1]: the lines of text d)."""
    data, offsets = text_bytes(column)
    n, docs = len(data), len(column)
    breaks = np.flatnonzero(data == _LF) + 1
    # a line begins where a text begins and after each line break; an empty text is one empty line
    starts = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    first = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(breaks, offsets, "right")))]).astype(np.int64) if docs else np.zeros(1, np.int64)
    # breaks right at a text's end open an empty last line of that text, not of the next
    ends = np.concatenate([starts[1:], [n]]) if len(starts) else starts
    size = (ends - starts).astype(np.float64)
    kinds = _TABLE[data]
    counts = np.empty((len(starts), len(_CLASSES)))
    for k in range(len(_CLASSES)):
        at = np.flatnonzero(kinds == k)
        counts[:, k] = np.searchsorted(at, ends) - np.searchsorted(at, starts)
    w = Words(column)
    h = w.hashes()
    line = np.searchsorted(starts, w.start, "right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    different = np.bincount(line[np.unique(mix(h ^ (line.astype(_U) * _U(0xD1B54A32D192ED03))), return_index=True)[1]], minlength=len(starts))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[again], minlength=len(starts))
    chars, some = np.maximum(size, 1), np.maximum(words, 1)
    f = np.empty((len(starts), OWN))
    f[:, 0] = np.log1p(size)
    f[:, 1] = np.log1p(words)
    f[:, 2:8] = counts / chars[:, None]
    f[:, 8] = counts[:, 0] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    f[:, 9] = different / some
    f[:, 10] = again / some
    f[:, 11] = np.minimum(size / some, 30) / 10
    f[:, 12] = words == 0
    return f, size, first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before, those of the line after (zeros at a text's edge), and a constant."""
    n = len(f)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first[:-1][first[:-1] < n]], after[first[1:] - 1] = 0, 0
    return np.hstack([f, before, after, np.ones((n, 1))])


class Field:
    """weights: score of label good per line; trans[i, j]: score of label j after label i."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, trans: np.ndarray, a: float = 1.0, b: float = 0.0):
        self.mean, self.scale, self.weights, self.trans, self.a, self.b = mean, scale, weights, trans, a, b

    def inputs(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours(np.clip((f - self.mean) / self.scale, -4, 4), first)

    def marginals(self, unary: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the summed pair marginals; all texts advance together, line by line."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # texts with more than t lines
        e = np.exp(self.trans - self.trans.max())
        u = np.clip(unary, -30, 30)
        node = np.stack([np.exp(np.minimum(-u, 0)), np.exp(np.minimum(u, 0))], 1)  # the two labels, up to a factor
        fwd, bwd = np.empty((len(unary), 2)), np.ones((len(unary), 2))
        a = None
        for t in range(steps):
            at = begin[: active[t]] + t
            a = node[at] if t == 0 else (a[: active[t]] @ e) * node[at]
            a = a / a.sum(1, keepdims=True)
            fwd[at] = a
        pairs = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            k = active[t + 1]
            at = begin[:k] + t
            m = node[at + 1] * bwd[at + 1]
            joint = fwd[at][:, :, None] * e[None] * m[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            x = m @ e.T
            bwd[at] = x / x.sum(1, keepdims=True)
        p = fwd * bwd
        return p[:, 1] / p.sum(1), pairs

    def raw(self, f: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted marginals of each text, as log odds."""
        p, _ = self.marginals(self.inputs(f, first) @ self.weights, first)
        w = size + 1
        q = np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def unary(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of label good of every line, its length, first line of every text), from the features of LINES lines at a time."""
        data, offsets = text_bytes(column)
        breaks = np.flatnonzero(data == _LF) + 1
        lines = 1 + np.diff(np.searchsorted(breaks, offsets, "right"))
        out, sizes, d = [], [], 0
        while d < len(lines):
            k = max(1, int(np.searchsorted(np.cumsum(lines[d:]), LINES, "right")))
            if lines[d] <= LINES:
                f, size, first = line_features(column.slice(d, k))
                out.append(self.inputs(f, first) @ self.weights)
                sizes.append(size)
            else:
                k, text = 1, data[offsets[d] : offsets[d + 1]]
                starts = np.concatenate([[0], breaks[(breaks > offsets[d]) & (breaks <= offsets[d + 1])] - offsets[d]])
                for i in range(0, len(starts), LINES):
                    a, b = max(i - 1, 0), min(i + LINES + 1, len(starts))  # a neighbour at both sides
                    end = starts[b] if b < len(starts) else len(text)
                    f, size, _ = line_features(pa.array([text[starts[a] : end].tobytes()], pa.binary()))
                    f, size = f[: b - a], size[: b - a]  # without the empty line that the last break opens
                    own = slice(i - a, i - a + min(LINES, len(starts) - i))
                    out.append(self.inputs(f, np.array([0, len(f)]))[own] @ self.weights)
                    sizes.append(size[own])
            d += k
        return np.concatenate([np.zeros(0), *out]), np.concatenate([np.zeros(0), *sizes]), np.concatenate([[0], np.cumsum(lines)]).astype(np.int64)

    def share(self, unary: np.ndarray, weight: np.ndarray) -> float:
        """Weighted mean of the marginals of one text, by blocks of lines."""
        e = np.exp(self.trans - self.trans.max())

        def nodes(i: int, j: int) -> np.ndarray:
            u = np.clip(unary[i:j], -30, 30)
            return np.stack([np.exp(np.minimum(-u, 0)), np.exp(np.minimum(u, 0))], -1)

        # stretches of whole blocks of the lines after the first, and what is left as a block of its own
        n, cuts = len(unary), [1]
        while n - cuts[-1] >= BLOCK:
            cuts.append(cuts[-1] + min(LINES, (n - cuts[-1]) // BLOCK * BLOCK))
        cuts += [n] if cuts[-1] < n else []
        a = nodes(0, 1)[0]
        a = first = a / a.sum()
        grids = []
        for i, j in zip(cuts, cuts[1:]):
            product = np.broadcast_to(np.eye(2), (max(1, (j - i) // BLOCK), 2, 2))
            grid = nodes(i, j).reshape(len(product), -1, 2)
            for t in range(grid.shape[1]):
                product = (product @ e) * grid[:, t, None, :]
                product = product / product.sum((1, 2), keepdims=True)
            starts = np.empty((len(product), 2))
            for k, p in enumerate(product):
                starts[k], a = a, a @ p
                a = a / a.sum()
            grids.append((i, j, product, starts))
        total, b = 0.0, np.ones(2)
        for i, j, product, x in reversed(grids):
            grid, ends = nodes(i, j).reshape(len(product), -1, 2), np.empty((len(product), 2))
            for k in range(len(product) - 1, -1, -1):
                ends[k], b = b, product[k] @ b
                b = b / b.sum()
            p = np.empty_like(grid)
            for t in range(grid.shape[1]):
                x = (x @ e) * grid[:, t]
                p[:, t] = x = x / x.sum(1, keepdims=True)
            x = ends
            for t in range(grid.shape[1] - 1, -1, -1):
                p[:, t] *= x
                x = (grid[:, t] * x) @ e.T
                x = x / x.sum(1, keepdims=True)
            p = p.reshape(-1, 2)
            total += float((p[:, 1] / p.sum(1) * weight[i:j]).sum())
        p = first * b
        return (total + float(p[1] / p.sum() * weight[0])) / float(weight.sum())

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of every text of a column."""
        unary, size, first = self.unary(column)
        lines, q = np.diff(first), np.empty(len(first) - 1)
        w = size + 1
        short = np.flatnonzero(lines <= MANY)
        if len(short):
            rows = gathered(np.arange(len(unary)), first[:-1][short], lines[short])
            at = np.concatenate([[0], np.cumsum(lines[short])])
            p, _ = self.marginals(unary[rows], at)
            q[short] = np.add.reduceat(p * w[rows], at[:-1]) / np.add.reduceat(w[rows], at[:-1])
        for d in np.flatnonzero(lines > MANY):
            q[d] = self.share(unary[first[d] : first[d + 1]], w[first[d] : first[d + 1]])
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(q / (1 - q)) + self.b, -40, 40)))


def fit(f: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, good: float | None = None, steps: int = 80, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood of the line labels by Adam, each document weighing the same whatever its number of lines.

    `good` is the share of label 1 among all labelled documents, for the calibration.
    """
    mean, scale = f.mean(0), f.std(0) + 1e-3
    model = Field(mean, scale, np.zeros(3 * OWN + 1), np.zeros((2, 2)))
    x, lines = model.inputs(f, first), np.diff(first)
    y = np.repeat(label, lines).astype(np.float64)
    weight = np.repeat(1.0 / lines, lines)
    same = np.array([[np.sum((lines - 1)[label == 0]), 0], [0, np.sum((lines - 1)[label == 1])]], float)
    m = v = np.zeros(x.shape[1] + 4)
    theta = np.zeros(x.shape[1] + 4)
    for t in range(1, steps + 1):
        model.weights, model.trans = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs = model.marginals(x @ model.weights, first)
        g = np.concatenate([x.T @ ((y - p) * weight) / len(label), (same - pairs).ravel() / max(len(y), 1)]) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights, model.trans = theta[:-4].copy(), theta[-4:].reshape(2, 2).copy()
    mine = label.mean()
    weight = None if good is None else np.where(label == 1, good / mine, (1 - good) / (1 - mine))
    model.a, model.b = platt(model.raw(f, size, first), label, weight)
    return model


def platt(z: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """a, b of sigmoid(a z + b), by Newton steps on the weighted rows; the slope stays positive."""
    x, w = np.stack([z, np.ones(len(z))], 1), np.zeros(2)
    share = np.full(len(z), 1 / len(z)) if weight is None else weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((label - p) * share) - ridge * w
        h = (x.T * (p * (1 - p) * share)) @ x + ridge * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def trained(docs: DataFrame, labels: DataFrame, label: str, learn, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS):
    """A Field, or where all labels are alike that label, and without labels 1: nothing speaks against any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, _CHUNK):
            f, size, first = line_features(b.column("text"))
            rows = [(f[i:j].astype("<f4").tobytes(), size[i:j].astype("<f4").tobytes()) for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "f", "size"])

    some = labelled_sample(docs.select(key, F.col(text).alias("text")), labels, label, learn, per_class, key)
    rows = some.select("text", F.col("_label").cast("int").alias("label")).mapInArrow(tidy(run), "label int, f binary, size binary").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.size), bytes(r.f)))  # the same fit whatever the order of arrival
    y = np.array([r.label for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 1.0
    good = labels.where(F.col(label).isin(0, 1) & F.coalesce(learn, F.lit(False))).agg(F.avg(label)).first()[0]
    sizes = [np.frombuffer(r.size, "<f4") for r in rows]
    f = np.concatenate([np.frombuffer(r.f, "<f4").reshape(-1, OWN) for r in rows]).astype(np.float64)
    return fit(f, np.concatenate(sizes).astype(np.float64), np.concatenate([[0], np.cumsum([len(s) for s in sizes])]), y, good)


def scored(docs: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """docs, all columns, with the score of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, _CHUNK, text):
            s = np.full(b.num_rows, model) if isinstance(model, float) else model.scores(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, out])

    return docs.mapInArrow(tidy(run), extended(docs, **{out: T.DoubleType()}))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", out: str = "score") -> DataFrame:
    """docs, all columns, with the score in `out` (a name that docs does not have); learns from labelled rows whose bucket of 4 is not 2."""
    return scored(docs, trained(docs, labels, label, bucket(key, 4) != 2, key, text), text, out)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_scores(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
