"""SentencePiece encoding and decoding with the pieces and scores of a given model file; nothing is trained here.

An Aho-Corasick automaton over the pieces reads a word once. At each position it follows the output links, so it names
every piece that ends there, longest first, and each relaxes the best score of the position (Viterbi): the best
segmentation is the one with the largest sum of piece scores, ties going to the longer last piece. A character that no
piece covers is spelled in byte pieces, at a score below that of any piece.

No piece of such a model crosses from another character into a space mark, and none holds a line break, so the best
segmentation of a text is that of its words side by side: a chunk of texts is cut into words, its different words are
segmented once, and the ids of all its words are put side by side. (Where a model has such a piece, whole texts take the
place of words.) Spaces become U+2581, and one is put in front; a U+2581 in the text itself is spelled in bytes, so
decoding gives back every text exactly.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows give repeated results;
null ids, and ids that the model does not have, decode to nothing; an empty table gives an empty result; other columns
stay as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import extended, table, tidy
from .tokens import chunks, gathered, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of words and ids that a task remembers before it starts anew.
REMEMBERED = 8 << 20
_CHUNK = 2 << 20
_SPACE, _BREAK = 0x20, 0x0A


class Spelling:
    """What each id spells, for decoding: id i is data[start[i] : start[i] + length[i]]."""

    def __init__(self, rows: list[tuple[str, float, str]]):
        text = [bytes([int(p[3:5], 16)]) if kind == "b" else p.replace(MARK, " ").encode() if kind == "n" else b"" for p, _, kind in rows]
        self.length = np.array([*map(len, text), 0])  # one more: spells nothing
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(text) + b"\0", np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts whose ids are ids[ends[d] : ends[d + 1]]; the space in front of a text is gone."""
        ids = np.where((ids >= 0) & (ids < len(self.length) - 1), ids, len(self.length) - 1)
        size = self.length[ids]
        data = gathered(self.data, self.start[ids], size)
        offsets = np.concatenate([[0], np.cumsum(size)])[ends]
        front = offsets[:-1][offsets[:-1] < offsets[1:]]
        front = front[data[front] == _SPACE]
        keep = np.ones(len(data), bool)
        keep[front] = False
        return data[keep], offsets - np.searchsorted(front, offsets)


class Pieces:
    """Automaton and tables of one model: (piece, score, kind) by id; kind is 'n' normal, 'b' byte or 'c' control."""

    def __init__(self, rows: list[tuple[str, float, str]]):
        self.auto = ahocorasick.Automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(rows) if kind == "b"}
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(rows) if kind == "n"]
        for p, s, i in normal:
            self.auto.add_word(p, (len(p), s, i))
        self.auto.make_automaton()
        self.single = {p for p, _, _ in normal if len(p) == 1}
        self.spelled = min(s for _, s, _ in normal) - 10
        self.crossing = any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p, re.S) for p, _, _ in normal)
        self.mark = [self.bytes[b] for b in MARK.encode()]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def viterbi(self, word: str) -> list[int]:
        n = len(word)
        best, sizes, pieces = [0.0] + [-np.inf] * n, [1] * (n + 1), [-1] * (n + 1)
        gaps = [] if self.single.issuperset(word) else [i for i, c in enumerate(word) if c not in self.single]
        gaps.append(n)
        gap = gaps[k := 0]
        for end, (size, score, piece) in self.auto.iter(word):
            while gap < end:  # all that ends before is settled
                if (s := best[gap] + self.spelled) > best[gap + 1]:
                    best[gap + 1], sizes[gap + 1], pieces[gap + 1] = s, 1, -1
                gap = gaps[k := k + 1]
            end += 1
            s = best[end - size] + score
            if s > best[end]:
                best[end], sizes[end], pieces[end] = s, size, piece
        for gap in gaps[k:-1]:
            if (s := best[gap] + self.spelled) > best[gap + 1]:
                best[gap + 1], sizes[gap + 1], pieces[gap + 1] = s, 1, -1
        out: list[int] = []
        while n:
            out += [pieces[n]] if pieces[n] >= 0 else [self.bytes[b] for b in reversed(word[n - 1].encode())]
            n -= sizes[n]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """Ids of one word, four bytes each; short words are remembered."""
        ids = self.known.get(word)
        if ids is None:
            ids = array("i", self.mark if word == MARK else self.viterbi(word.replace(" ", MARK))).tobytes()
            if len(word) < 64:
                self.held += 150 + 2 * len(word) + len(ids)
                if self.held > REMEMBERED:
                    self.known.clear()
                    self.held = 0
                self.known[word] = ids
        return ids

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of text d are ids[ends[d] : ends[d + 1]]."""
        data, offsets = text_bytes(column)
        some = offsets[1:] > offsets[:-1]
        data = np.insert(data, offsets[:-1][some], _SPACE)
        offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1]] = True
        if not self.crossing:
            space, line = data == _SPACE, np.flatnonzero(data == _BREAK)
            begins[1:-1] |= space[1:] & ~space[:-1]
            begins[line] = begins[line + 1] = True
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        begins[marks] = begins[marks + 3] = True
        starts = np.flatnonzero(begins[:-1])
        bounds = np.append(starts, len(data))
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = words.indices.to_numpy()
        ids = [self.word(w) for w in words.dictionary.to_pylist()]
        size = np.array([len(x) for x in ids]) >> 2
        at = np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[which])])[np.searchsorted(starts, offsets)]
        return gathered(np.frombuffer(b"".join(ids), np.int32), at[which], size[which]), ends

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()


def read_pieces(model: str) -> list[tuple[str, float, str]]:
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "b" if p.is_byte(i) else "c" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "n"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL, out: str = "ids") -> DataFrame:
    """docs with a column `out` (a name that docs does not have): the ids of the whole text."""
    rows = read_pieces(model)  # the size of a vocabulary, read once on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(rows)
        for b in chunks(batches, _CHUNK, text):
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(*pieces.encode_all(b.column(text)))], [*b.schema.names, out])

    return docs.mapInArrow(tidy(run), extended(docs, **{out: T.ArrayType(T.IntegerType())}))


def decoded(rows: DataFrame, ids: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """rows with a column `out` (a name that rows does not have): the text that the ids spell."""
    pieces = read_pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, step = Spelling(pieces), 256
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                col = part.column(ids)
                ends = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                data, at = p.decode(col.flatten().fill_null(-1).to_numpy(zero_copy_only=False), ends)
                raw = data.tobytes()
                texts = pa.array([raw[a:z].decode("utf-8", "replace") for a, z in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out])

    return rows.mapInArrow(tidy(run), extended(rows, **{out: T.StringType()}))


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, ids, n_tokens, n_spelled, exact): ids of the whole text, how many of them spell a byte, and whether decoding
    all of them gives the text back. Encoding and decoding share one pass."""
    rows = read_pieces(model)
    spells = np.array([kind == "b" for _, _, kind in rows])
    names = ["k", "ids", "n_tokens", "n_spelled", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, back = Pieces(rows), Spelling(rows)
        for b in chunks(batches, _CHUNK):
            ids, ends = pieces.encode_all(b.column("text"))
            given, wanted = text_bytes(b.column("text"))
            data, at = back.decode(ids, ends)
            exact = np.diff(at) == np.diff(wanted)
            if exact.all():  # then the bytes lie at the same places
                exact[np.searchsorted(wanted, np.flatnonzero(data != given), "right") - 1] = False
            else:
                exact = np.array([np.array_equal(data[at[d] : at[d + 1]], given[wanted[d] : wanted[d + 1]]) for d in range(b.num_rows)])
            byte = np.concatenate([[0], np.cumsum(spells[ids])])[ends]
            yield pa.RecordBatch.from_arrays([b.column("k"), _lists(ids, ends), pa.array(np.diff(ends)), pa.array(np.diff(byte)), pa.array(exact)], names)

    source = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return source.mapInArrow(tidy(run), f"k {docs.schema[key].dataType.simpleString()}, ids array<int>, n_tokens long, n_spelled long, exact boolean").withColumnRenamed("k", key)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))
