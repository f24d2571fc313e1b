"""Line dedup by pairwise alignment: blocks of lines that an earlier document holds leave the later one.

A block is a run of lines, adjacent in both documents, of at least LEAST_WORDS words. Anchors are the hashes
of the shortest such runs that start, or end, at each line: they cover every block, and who holds one holds a
block. Each anchor of a document leads to the earliest document (smallest id) that holds it; pairs of documents
are thus as many as a document's repeated anchors at most, however many others share them. A pair is aligned by
patience diff over line hashes: lines that occur once on both sides, their longest increasing run, and the same
again between its members. Of that, blocks are kept. A diff finds no block that stands in another order or is
repeated, and may tear one apart; the shortest runs with a line that is left are therefore looked up among those
of the earlier document. So a line goes if, and only if, it lies in a block that an earlier document holds as a
block; lines that an earlier document holds apart or in another order, or that several hold in parts, stay.
Blank lines stay and do not part a run.

Defined cases: a null text stays null; rows with a null id are left as they are; rows that repeat an id
and a text are one document (never each other's partner) and get the same result, rows that repeat an id
with another text are never partners either; a document of repeated lines only becomes an empty text; an
empty table gives no rows. Only doc_id and text are read; :func:`clean` keeps all columns.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import slices, small, written

#: Words of the shortest block that is deleted.
LEAST_WORDS = 30
#: Documents, or pairs of them, that a task holds as Python lists at once.
SLICE = 256


def split_lines(text: str) -> tuple[list[int], list[int], list[int]]:
    """Place, hash and words of each line with a word; blanks at a line's ends do not count."""
    places, hashes, words = [], [], []
    for at, line in enumerate(text.encode().split(b"\n")):
        n = len(line.split())
        if n:
            places.append(at)
            hashes.append(xxhash.xxh64_intdigest(line.strip()))
            words.append(n)
    return places, hashes, words


def _run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that rises on both sides, of pairs that rise on the first."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of equal lines."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        once = {x: k for k, x in enumerate(b[j:n], j) if in_b[x] == 1 and in_a.get(x) == 1}
        if once:
            pairs = [(k, once[x]) for k, x in enumerate(a[i:m], i) if x in once]
        else:  # no line is unique: number the occurrences
            place = {}
            seen: Counter = Counter()
            for k, x in enumerate(b[j:n], j):
                place[x, seen[x]] = k
                seen[x] += 1
            seen, pairs = Counter(), []
            for k, x in enumerate(a[i:m], i):
                if (x, seen[x]) in place:
                    pairs.append((k, place[x, seen[x]]))
                seen[x] += 1
        chain = _run(pairs)
        if not chain:
            continue
        out.extend(chain)
        for (p, q), (r, s) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)]):
            if r - p > 1 and s - q > 1:
                todo.append((p + 1, r, q + 1, s))
    return out


def shortest_runs(words: list[int], least_words: int) -> list[tuple[int, int]]:
    """(from, to) of the shortest runs of at least so many words that start, or that end, at each line."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    to = np.searchsorted(total, total[:-1] + least_words)
    since = np.searchsorted(total, total[1:] - least_words, side="right") - 1
    out = {(i, n) for i, n in enumerate(to.tolist()) if n < len(total)}
    return sorted(out | {(i, n) for n, i in enumerate(since.tolist(), 1) if i >= 0})


def aligned(earlier: list[int], later: list[int], words: list[int] | None = None, least_words: int = LEAST_WORDS) -> list[int]:
    """Places in later of the blocks, adjacent on both sides, of at least so many words that earlier holds.

    ``words`` are those of each line of later; without them one line is enough for a block.
    """
    words = [least_words] * len(later) if words is None else words
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    gone = np.zeros(len(later), bool)
    pairs = sorted(patience(earlier, later))
    start = 0
    for k, (i, j) in enumerate(pairs, 1):
        if k == len(pairs) or pairs[k] != (i + 1, j + 1):
            first = pairs[start][1]
            if total[j + 1] - total[first] >= least_words:
                gone[first : j + 1] = True
            start = k
    # Moved and repeated blocks, and those the diff has torn: a run of later with a line that is left is looked up.
    left = [(i, n) for i, n in shortest_runs(words, least_words) if not gone[i:n].all()]
    if left:
        known = dict(zip(later, words))
        runs = shortest_runs([known.get(x, least_words) for x in earlier], least_words)
        held = {tuple(earlier[i:n]) for i, n in runs}
        for i, n in left:
            if tuple(later[i:n]) in held:
                gone[i:n] = True
    return np.nonzero(gone)[0].tolist()


def line_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_key, places, hashes and words of each document that has an id and a line, and its anchors."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string")
    )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            found = [split_lines(t) for t in batch.column(2).to_pylist()]
            hashes = [np.array(f[1], np.uint64).view(np.int64) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array(hashes, pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.int32())),
                 pa.array([anchors(h, f[2], least_words) for h, f in zip(hashes, found)], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "places", "hashes", "words", "anchors"],
            )

    schema = "doc_id long, text_key long, places array<int>, hashes array<long>, words array<int>, anchors array<long>"
    return rows.mapInArrow(lines, schema).filter("size(hashes) > 0")


def anchors(hashes: np.ndarray, words: list[int], least_words: int) -> np.ndarray:
    """The distinct hashes of a document's shortest runs."""
    data, size = hashes.tobytes(), hashes.itemsize
    found = {xxhash.xxh64_intdigest(data[i * size : n * size]) for i, n in shortest_runs(words, least_words)}
    return np.array(sorted(found), np.uint64).view(np.int64)


def partners(lines: DataFrame) -> DataFrame:
    """Distinct pairs: a document and an earliest holder of one of its anchors."""
    held = lines.select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    first = held.groupBy("anchor").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.max("doc_id").alias("last_id")
    ).filter("first.doc_id < last_id")
    return held.join(first, "anchor").filter("first.doc_id < doc_id").select(
        F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "doc_id", "text_key"
    ).distinct()


def removals(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_key and the sorted places of the lines to delete, for documents that lose any."""
    lines = written(line_table(docs, least_words).dropDuplicates(["doc_id", "text_key"]), "line-table")
    pairs = written(partners(lines), "line-pairs")
    earlier = lines.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), F.col("hashes").alias("earlier"))
    later = lines.select("doc_id", "text_key", "hashes", "words", "places")
    both = pairs.join(earlier, ["first_id", "first_key"]).join(later, ["doc_id", "text_key"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            out = []
            for a, b, words, at in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4, 5)]):
                out.append([at[k] for k in aligned(a, b, words, least_words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "text_key", "cut"]
            )

    cut = both.select("doc_id", "text_key", "earlier", "hashes", "words", "places").mapInArrow(
        align, "doc_id long, text_key long, cut array<int>"
    ).select("doc_id", "text_key", F.explode("cut").alias("at")).distinct()
    return cut.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("at")).alias("cut"))


def cleaned(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc (each row of the input as a struct), text (without the deleted lines) and cut (places deleted, null if none)."""
    gone = small(written(removals(docs, least_words), "line-removals"), "cut")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("own"))
    joined = rows.join(gone, (F.col("doc.doc_id") == gone["doc_id"]) & (F.col("own") == F.col("text_key")), "left").withColumn(
        "lines", F.when(F.col("cut").isNotNull(), F.split("doc.text", "\n"))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cut")
    rest = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return joined.select("doc", F.when(F.col("cut").isNull(), F.col("doc.text")).otherwise(rest).alias("text"), "cut")


def _columns(names: list[str]) -> list[Column]:
    return [(F.col("text") if c == "text" else F.col("doc").getField(c)).alias(c) for c in names]


def clean(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The input, its texts without the deleted lines, and a column ``_cut`` (places deleted, null if none)."""
    rows = cleaned(docs, least_words)
    return rows.select(*_columns(docs.columns), F.col("cut").alias("_cut"))


def report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, the text that is left, how many lines went and which (places from 0, as "3,4,5")."""
    cut = F.coalesce("cut", F.array().cast("array<int>"))
    return cleaned(docs.select("doc_id", "text"), least_words).select(
        "doc.doc_id", "text", F.size(cut).cast("long").alias("n_removed"), F.array_join(cut.cast("array<string>"), ",").alias("removed"),
    )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, all columns, whatever their names, with their cleaned texts; those of which no word is left go."""
    rows = cleaned(docs, least_words).filter(F.col("cut").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*_columns(docs.columns))
