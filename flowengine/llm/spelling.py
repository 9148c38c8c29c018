"""Spelling variants: words one edit apart, from forward and reversed sorted dictionaries.

counted()  the words of all texts with their counts. Tasks count in memory and hand on what they have when it grows.
blocks()   an edit leaves one half of a word intact. For words of m letters, and of m + 1 that an insertion makes of them,
           the forward dictionary has a block for every first half and the reversed one for every last half. A block of
           more than `limit` words is subdivided: the edit lies in one half of the part that is still open, so the other
           half joins what the block's words share. This goes on until blocks are small or one letter is open,
           and a block with one open letter has no more words than the alphabet allows.
near()     blocks are ranges of sorted partitions. Words of a block differ in the open part only, which is compared letter
           by letter. A pair counts in the one block whose open part holds its first differing letter, so it
           is seen once, and a block returns for each word the number of its near words and the best of them, not pairs.
variants() every word with its form (its most frequent near word, if that is `times` as frequent), and the root that
           forms lead to, by pointer doubling.

Defined results: null texts have no words; a null key counts as an empty text where letters are dropped; a word without near
words has n_near 0, no form, and is its own root; ties go to the word that is smaller by code point; repeated rows count
again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, table, tidy
from .tokens import LOWER, chunks

#: Fixed by the task: one run in DROP loses a letter; letters and occurrences of a word at least; how much more frequent a form is.
DROP, LETTERS, SEEN, TIMES = 97, 5, 3, 2
#: Words of a block before it is subdivided.
LIMIT = 256
#: Different words that a task counts before it hands them on, characters it searches at a time, and letters it compares at a time.
_HELD, _PART, _CELLS = 200_000, 1 << 20, 1 << 22
_LETTER = "A-Za-zÀ-ÿ"
_BREAK = re.compile(f"[^{_LETTER}]")
_TABLE = bytes(LOWER)
KEY = ["m", "p", "e", "head", "tail"]


def runs(text: str, letters: int) -> Counter:
    """The lower-cased (A-Z only) runs of at least `letters` letters, and how often each occurs."""
    some, found, at = re.compile(f"[{_LETTER}]{{{letters},}}"), Counter(), 0
    while at < len(text):
        stop = _BREAK.search(text, at + _PART)
        end = stop.start() if stop else len(text)
        part = text[at:end] if at or end < len(text) else text
        found.update(some.findall(part.lower() if part.isascii() else part.encode().translate(_TABLE).decode()))
        at = end
    return found


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = DROP, letters: int = LETTERS, seen: int = SEEN) -> DataFrame:
    """(w, n): the words with at least `letters` letters and `seen` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        for b in chunks(batches):
            for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist()):
                if not t:
                    continue
                base = zlib.crc32(f"{'' if k is None else k}:".encode())
                for w, n in runs(t, letters).items():
                    h = zlib.crc32(w.encode(), base)
                    if h % drop == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1 :]
                        if len(w) < letters:
                            continue
                    words[w] = words.get(w, 0) + n
                if len(words) >= _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["w", "n"])
                    words = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["w", "n"])

    found = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text")).mapInArrow(tidy(run), "w string, n long")
    return found.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def _entries(df: DataFrame, choices: list[tuple]) -> DataFrame:
    """df (w, n, ..) once for each choice (m, p, e): letters [p, e) of m are open, what stands before and after is the block's."""
    made = F.explode(F.array(*[F.struct(m.cast("int").alias("m"), p.cast("int").alias("p"), e.cast("int").alias("e")) for m, p, e in choices]))
    rows = df.withColumn("_x", made).select("w", "n", "_x.*")
    return rows.withColumns({"head": F.expr("substring(w, 1, p)"), "tail": F.expr("right(w, m - e)")})


def blocks(words: DataFrame, letters: int = LETTERS, limit: int = LIMIT) -> DataFrame:
    """(w, n, m, p, e, head, tail): the words in all their blocks; no block is larger than `limit` unless one letter is open."""
    size, zero = F.char_length("w"), F.lit(0)
    half = lambda m: F.floor(m / 2)
    todo = _entries(words, [c for m in (size, size - 1) for c in ((m, half(m), m), (m, zero, half(m)))]).where(F.col("m") >= letters)
    done = None
    while True:
        todo = cut(todo)
        large = cut(todo.groupBy(*KEY).count().where((F.col("count") > limit) & (F.col("e") - F.col("p") > 1)).select(*KEY))
        if large.isEmpty():
            return todo if done is None else done.unionByName(todo)
        small = todo.join(large, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        m, p, e = F.col("m"), F.col("p"), F.col("e")
        middle = p + F.floor((e - p) / 2)
        todo = _entries(todo.join(large, KEY, "left_semi"), [(m, middle, e), (m, p, middle)])


def _letters(words: list[bytes], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """words[i][at : at + size] as rows of a matrix, filled up with zeros."""
    width = int(size.max(initial=0)) + 1
    return np.frombuffer(b"".join(w[a : a + s].ljust(width, b"\0") for w, a, s in zip(words, at.tolist(), size.tolist())), np.uint8).reshape(len(words), width)


def compared(words: list[bytes], n: np.ndarray, m: np.ndarray, p: np.ndarray, e: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of near words, row of the best one) over whole blocks; last[i] ends row i's block, whose shorter words come first."""
    size = np.array([len(w) for w in words], np.int64)
    count = np.where(size == m, last - np.arange(len(words)) - 1, 0)
    open_, rank = size - (m - e) - p, np.unique(np.array(words, object), return_inverse=True)[1]
    near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    ends = np.cumsum(count)
    first = 0
    while first < len(words):
        # as many rows as make _CELLS letters to compare; their open parts have the width of the widest
        stop, width, cells = first, 0, 0
        while stop < len(words) and (stop == first or cells <= _CELLS):
            width = max(width, int(open_[stop]) + 2)
            stop += 1
            cells = int(ends[stop - 1] - (ends[first - 1] if first else 0)) * width
        reach = int(last[first:stop].max())
        letters = _letters(words[first:reach], p[first:reach], open_[first:reach])
        a = np.repeat(np.arange(first, stop), count[first:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count[first:stop]) - count[first:stop], count[first:stop])
        step = max(1, _CELLS // letters.shape[1])
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            s, t = letters[x - first], letters[y - first]
            differ = s != t
            same = size[x] == size[y]
            where = np.argmax(differ, 1)
            good = same & (np.count_nonzero(differ, 1) == 1)
            longer = np.flatnonzero(~same & ((where < open_[x]) | (e[x] == m[x])))
            shifted = s[longer, :-1] != t[longer, 1:]
            good[longer] = ~(shifted & (np.arange(shifted.shape[1]) >= where[longer, None])).any(1)
            x, y = x[good], y[good]
            one, two = np.concatenate([x, y]), np.concatenate([y, x])
            near += np.bincount(one, minlength=len(words))
            has = best[one] >= 0
            # the best so far competes with the new ones
            one, two = np.concatenate([one, one[has]]), np.concatenate([two, best[one[has]]])
            order = np.lexsort((rank[two], -n[two], one))
            one, two = one[order], two[order]
            lead = np.flatnonzero(np.diff(one, prepend=-1))
            best[one[lead]] = two[lead]
        first = stop
    rows = np.flatnonzero(near)
    return rows, near[rows], best[rows]


def near(entries: DataFrame) -> DataFrame:
    """(w, near, form, form_n): how many words are one edit from w, and the most frequent of them."""
    names = ["w", "n", *KEY]

    def whole(t: pa.Table, last: np.ndarray) -> pa.RecordBatch:
        words = t.column("w").to_pylist()
        n, m, p, e = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "m", "p", "e"))
        rows, some, best = compared([w.encode("latin-1") for w in words], n, m, p, e, last)
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in rows], pa.string()), pa.array(some), pa.array([words[i] for i in best], pa.string()), pa.array(n[best])], ["w", "near", "form", "form_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b.select(names)])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            edge = np.zeros(max(t.num_rows - 1, 0), bool)
            for c in KEY:
                x = t.column(c).combine_chunks()
                edge |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(edge) + 1
            if not len(cuts):
                held = t
                continue
            held = t.slice(cuts[-1])
            yield whole(t.slice(0, cuts[-1]), np.repeat(cuts, np.diff(cuts, prepend=0)))
        if held is not None and held.num_rows:
            yield whole(held, np.full(held.num_rows, held.num_rows))

    # the partitions of a range are pieces of the two dictionaries, and none cuts a block
    ranges = entries.repartitionByRange(*KEY).sortWithinPartitions(*KEY, F.char_length("w"), "w")
    found = ranges.select(*names).mapInArrow(tidy(run), "w string, near long, form string, form_n long")
    one = found.groupBy("w").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("_best"))
    return one.select("w", "near", "_best.form", (-F.col("_best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(w, root): where the links w -> form end. Forms are more frequent than their words, so links make no circle."""
    at = cut(forms.select("w", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        on = at.select(F.col("w").alias("root"), F.col("root").alias("_next"))
        at = cut(at.join(on, "root", "left").select("w", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
    return at.select("w", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: int = DROP, letters: int = LETTERS, seen: int = SEEN, times: int = TIMES, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs."""
    words = cut(counted(docs, key, text, drop, letters, seen))
    known = words.join(near(blocks(words, letters, limit)), "w", "left")
    good = F.col("form_n") >= times * F.col("n")
    known = cut(known.select("w", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    ends = known.join(roots(known.where("form IS NOT NULL")), "w", "left")
    return ends.select(F.col("w").alias("word"), "form", F.coalesce("root", "w").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The checksum bit by bit and byte by byte; near words by what is left when one letter is taken out.
ORACLE_SQL = rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents) GROUP BY ALL),
x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM r WHERE length(run) >= {LETTERS}),
h AS (SELECT doc_id, run, n, xor(list_reduce(list_transform(range(1, length(bytes), 2), lambda i: ('0x' || substr(bytes, i, 2))::BIGINT), lambda c, v: xor(tab[(xor(c, v) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM x, bits),
v AS (SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, n FROM h),
words AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM v WHERE length(w) >= {LETTERS} GROUP BY w HAVING sum(n) >= {SEEN}),
gone AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i) AS a, substr(w, i + 2) AS b FROM (SELECT w, n, unnest(range(length(w))) AS i FROM words)),
pairs AS (SELECT g.w, o.w AS o, o.n FROM gone g JOIN gone o USING (i, a, b) WHERE g.w <> o.w
  UNION SELECT g.w, s.w, s.n FROM gone g JOIN words s ON s.w = g.a || g.b UNION SELECT s.w, g.w, g.n FROM gone g JOIN words s ON s.w = g.a || g.b),
best AS (SELECT w, count(*) AS n_near, arg_min(o, (-n, o)) AS o, max(n) AS o_n FROM pairs GROUP BY w),
f AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= {TIMES} * words.n THEN o END AS form, CASE WHEN o_n >= {TIMES} * words.n THEN o_n END AS form_n FROM words LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS root, form AS next FROM f UNION ALL SELECT walk.w, f.w, f.form FROM walk JOIN f ON f.w = walk.next)
SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN walk ON walk.w = f.w AND walk.next IS NULL"""
