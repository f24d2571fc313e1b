"""Collocations: phrases that are frequent, and more frequent than their parts let one expect.

Texts are lower-cased (A-Z), cut into pieces at stops, commas, semicolons, colons, exclamation and question marks and
line breaks, and pieces into words at spaces and tabs. A null lang is ``und``; everything is counted per lang.

1. Words are counted per lang, exactly. The count bounds the number of n-grams and so gives the number of hash
   partitions: as many as keep a partition's summary at about CAPACITY counters.
2. Each task counts the n-grams of a stretch of text exactly, hashes them with their lang, and sends each hash
   partition's part of them (32 further bits of the hash, and counts) and its mass.
3. A partition's parts are merged into one Misra-Gries summary. Its capacity is FACTOR times the partition's mass
   divided by the least frequency, plus one; whenever more counters are held, the first that is too many, by size,
   is subtracted from all. What is subtracted in all stays below the least frequency over FACTOR, so every frequent
   n-gram keeps a counter. Counters that cannot be frequent, even with all that was subtracted, go. Hashes
   that coincide only add up, so they lose nothing either.
4. The partitions' survivors become one bit field of FILTER_BITS bits, whatever their number: the only thing that all
   tasks get. The second pass counts the n-grams whose bit is set exactly, as strings, with map-side combine; what the
   field lets through in error is counted as well and falls below the least frequency. So nothing rests on hashes.
5. Cuts, containment and ranks are joins and aggregations of frequent phrases only. Products are decimals of 38 digits
   (frequencies up to 10**16).

Defined cases: null, empty and blank texts have no words; a lang without a phrase has no rows; repeated rows count each;
a text longer than a stretch is counted in overlapping stretches; an empty table gives no rows. Only text and lang
are read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import small, text_of, written

LONGEST_PHRASE, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Tokens of a stretch that is counted at once; codes of its words take CODE_BITS bits.
STRETCH, CODE_BITS = 1_000_000, 21
#: Counters of one summary, about, and how far a capacity exceeds mass divided by the least frequency.
CAPACITY, FACTOR = 500_000, 2
#: Bits of the field of survivors, at most 16 MB.
FILTER_BITS = 27
UNKNOWN_LANG = "und"
WORDS = r"[^\x20\x09.,;:!?\x0A-\x0D]+"

#: A-Z to lower case, tabs to spaces, everything that ends a piece to a stop.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ........." )
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Codes(dict):
    """A lang's words to codes of one stretch; 0 ends a piece."""

    def __init__(self, words: list[tuple[str, bytes]], lang: str):
        super().__init__({b".": 0})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        code = self[word] = len(self.words) - 1
        return code


class Stretch:
    """The tokens of some texts, and their distinct n-grams with counts."""

    def __init__(self, longest: int):
        self.longest = longest
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.codes: dict[str, Codes] = {}
        self.tokens = array("i")
        self.repeated: list[int] = []

    def add(self, lang: str, tokens: list[bytes], again: int) -> None:
        """Tokens of a text; n-grams that start among the last ``again`` ones belong to the next stretch."""
        if lang not in self.codes:
            self.codes[lang] = Codes(self.words, lang)
        self.tokens.extend(map(self.codes[lang].__getitem__, tokens))
        self.repeated.extend(range(len(self.tokens) - again, len(self.tokens)))
        self.tokens.append(0)

    def counted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size: the distinct n-grams as rows of codes, and their counts."""
        codes = np.array(self.tokens, np.int64)
        starts = codes > 0
        starts[self.repeated] = False
        keys = codes
        for size in range(1, self.longest + 1):
            if size > 1:
                starts = starts[:-1] & (codes[size - 1 :] > 0)
                keys = keys[:-1] << CODE_BITS | codes[size - 1 :]
            found, counts = np.unique(keys[starts], return_counts=True)
            yield np.stack([found >> CODE_BITS * k & (1 << CODE_BITS) - 1 for k in range(size - 1, -1, -1)], axis=1), counts

    def hashes(self) -> np.ndarray:
        """A hash of each code's word and lang."""
        return np.array([xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang)) for lang, word in self.words], np.uint64)


def hashed(grams: np.ndarray, of_words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their words."""
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        out = _mixed(out + of_words[grams[:, k]] * _FACTORS[k])
    return out


def stretches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Stretch]:
    """The texts of batches (lang, text) in stretches of about STRETCH tokens."""
    held = Stretch(longest)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            tokens = text.as_py().encode().translate(_PLAIN).replace(b".", b" . ").split()
            for at in range(0, len(tokens), STRETCH):
                part = tokens[at : at + STRETCH + longest - 1]
                held.add(lang.as_py(), part, max(0, len(part) - STRETCH))
                if len(held.tokens) >= STRETCH:
                    yield held
                    held = Stretch(longest)
    if held.tokens:
        yield held


def parts_of(rows: DataFrame, longest: int, bits: int) -> DataFrame:
    """part, kind, mass, prints and counts: for each of 2**bits hash partitions its mass (kind 0) and n-grams (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(1 << bits, np.int64)
        for stretch in stretches(batches, longest):
            of_words = stretch.hashes()
            found = [(hashed(grams, of_words), counts) for grams, counts in stretch.counted()]
            hashes, counts = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            mass += np.bincount(part, counts, 1 << bits).astype(np.int64)
            prints = (hashes >> np.uint64(32 - bits)).astype("<u4")
            counts = counts.astype("<u4")
            present, starts = np.unique(part, return_index=True)
            ends = [*starts[1:].tolist(), len(part)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(present, pa.int32()), "kind": pa.array(np.ones(len(present)), pa.int32()),
                "mass": pa.array(np.zeros(len(present)), pa.int64()),
                "prints": pa.array([prints[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], pa.binary()),
            })
        present = np.flatnonzero(mass)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(present, pa.int32()), "kind": pa.array(np.zeros(len(present)), pa.int32()), "mass": pa.array(mass[present]),
            "prints": pa.nulls(len(present), pa.binary()), "counts": pa.nulls(len(present), pa.binary()),
        })

    return rows.mapInArrow(run, "part int, kind int, mass long, prints binary, counts binary")


class Summary:
    """A Misra-Gries summary; summaries and exact counts merge into it."""

    def __init__(self, capacity: int):
        self.capacity, self.subtracted = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            at = len(keys) - self.capacity - 1
            extra = int(np.partition(counts, at)[at])
            self.subtracted += extra
            counts = counts - extra
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def survivors(self, least: int) -> np.ndarray:
        return self.keys[self.counts + self.subtracted >= least]


def survivors(parts: DataFrame, least: int, bits: int, filter_bits: int) -> DataFrame:
    """part, field (its bits of the field of survivors), kept and subtracted: one summary for each hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary, waiting, size = None, 0, None, [], 0

        def merged() -> None:
            nonlocal waiting, size
            if waiting:
                summary.merge(*(np.concatenate(x) for x in zip(*waiting)))
            waiting, size = [], 0

        def finished() -> pa.RecordBatch:
            merged()
            kept = summary.survivors(least)
            field = np.zeros(1 << filter_bits - bits, np.uint8)
            field[(kept >> np.uint32(32 - (filter_bits - bits))).astype(np.int64)] = 1
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "field": pa.array([np.packbits(field).tobytes()], pa.binary()),
                "kept": pa.array([len(kept)], pa.int64()), "subtracted": pa.array([summary.subtracted], pa.int64()),
            })

        for batch in batches:
            for row in range(batch.num_rows):
                of, kind, own = (batch.column(k)[row].as_py() for k in range(3))
                if of != part:
                    if summary is not None:
                        yield finished()
                    part, mass, summary = of, 0, None
                if kind == 0:
                    mass += own
                    continue
                if summary is None:  # all of the partition's masses came before
                    summary = Summary(FACTOR * mass // least + 1)
                prints = np.frombuffer(batch.column(3)[row].as_py(), "<u4")
                waiting.append((prints, np.frombuffer(batch.column(4)[row].as_py(), "<u4").astype(np.int64)))
                size += len(prints)
                if size >= max(summary.capacity, STRETCH):
                    merged()
        if summary is not None:
            yield finished()

    key = ["part", "kind"]
    dealt = parts.repartition("part").sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "part int, field binary, kept long, subtracted long")


def frequent(docs: DataFrame, words: int, longest: int = LONGEST_PHRASE, least: int = LEAST, capacity: int = CAPACITY, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, size and a of every n-gram of 1 to ``longest`` words that occurs ``least`` times or more in its lang.

    words: the number of word occurrences of docs (lang, text without nulls), or a bound of it.
    """
    if not 1 <= longest <= len(_FACTORS):
        raise ValueError("phrases have one to three words")
    spark = docs.sparkSession
    bits = min(max(6, (longest * words * FACTOR // least // capacity).bit_length()), filter_bits - 3)
    fields = written(survivors(parts_of(docs, longest, bits), least, bits, filter_bits), "phrases-survivors")
    step = 1 << filter_bits - bits - 3
    field = bytearray(step << bits)
    for row in fields.select("part", "field").collect():  # 2**filter_bits bits in all
        field[row.part * step : (row.part + 1) * step] = row.field
    shared = spark.sparkContext.broadcast(bytes(field))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit_field = np.frombuffer(shared.value, np.uint8)
        for stretch in stretches(batches, longest):
            of_words = stretch.hashes()
            for grams, counts in stretch.counted():
                at = (hashed(grams, of_words) >> np.uint64(64 - filter_bits)).astype(np.int64)
                keep = bit_field[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
                rows = grams[keep].tolist()
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([stretch.words[row[0]][0] for row in rows], pa.string()),
                    "phrase": pa.array([b" ".join([stretch.words[k][1] for k in row]).decode() for row in rows], pa.string()),
                    "size": pa.array([grams.shape[1]] * len(rows), pa.int32()), "times": pa.array(counts[keep], pa.int64()),
                })

    found = docs.mapInArrow(run, "lang string, phrase string, size int, times long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("times").alias("a")).filter(F.col("a") >= least)


def collocations(docs: DataFrame, longest: int = LONGEST_PHRASE, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each lang's first ``top`` phrases of two words or more.

    A candidate that stands inside a longer one of at least ``share`` percent of its frequency is dropped.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), text_of().alias("text"))
    words = written(rows.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORDS)).cast("long")).alias("n")), "phrases-words")
    total = words.agg(F.sum("n").alias("n")).first().n or 0
    grams = written(frequent(rows, total, longest, least), "phrases-frequent")
    parts = small(written(grams.filter(F.col("size") < longest).select("lang", "phrase", "a"), "phrases-parts"))

    word = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    joined = lambda start, size: F.array_join(F.slice(F.col("words"), start, size), " ")
    cuts = grams.filter("size >= 2").select("lang", "phrase", "a", "size", word.alias("words"), cut.alias("k")).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(
        parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]
    )
    exact = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumns({"over": F.lit(1_000_000).cast("decimal(38,0)") * exact["a"] * exact["a"], "under": exact["l"] * exact["r"]})
    scored = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    inside = grams.filter("size >= 3").select("lang", "a", "size", word.alias("words")).withColumn(
        "length", F.explode(F.sequence(F.lit(2), F.col("size") - 1))
    ).withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    inside = inside.groupBy("lang", joined(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {int(share)} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(small(words), "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, size, phrase, count(*) AS a FROM (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (
      SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS size)
      WHERE len(w) >= size))
  GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT lang, size, phrase, a, k, string_split(phrase, ' ') AS w FROM (
    SELECT *, unnest(generate_series(1, size - 1)) AS k FROM grams WHERE size >= 2)
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, c.k, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
    JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM cuts c WHERE c.size = 3 AND c.k = 1 AND c.lang = s.lang AND 100 * c.a >= 50 * s.a AND s.phrase <> c.phrase
      AND s.phrase IN (array_to_string(c.w[1 : 2], ' '), array_to_string(c.w[2 : 3], ' ')))
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a,
  l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN words ON words.lang = kept.lang
QUALIFY rank <= 2000
"""
