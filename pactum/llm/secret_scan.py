"""Secret scan: candidates of a wide pattern, false positives removed by a random forest.

A candidate is a long run of letters, digits and ``+ / = _ -`` that has a digit or is very long, such runs joined by
dots, or, at any length and of any characters, the quoted or unbroken value after a key's name and the password in
an address's user part. Its features are
its length, its changes between kinds of characters and how likely its letters follow one another in ordinary
words, how much of it words of a dictionary cover, whether it looks like a path or an address, and the words
beside it. The dictionary, and the letter pairs drawn from it, are the commonest words of the whole corpus,
counted with partial sums; DICTIONARY bounds its size, so it may travel to every task.

The forest learns from labelled findings: a table (doc_id, at, secret), or, without one, the findings that plain
rules decide, known key formats and values assigned to a key's name as secrets, numbers, addresses, runs that
words cover and runs after words such as ``sha`` or ``commit`` as none; what no rule decides teaches nothing.
At most MAX_FINDINGS findings of documents with crc32(doc_id) mod 5 not 0 are used, chosen by a hash; the rest is
for measuring.

Defined cases: null and empty texts have no candidates; a null doc_id is carried; repeated rows give their
findings each time; labels of one kind only (or none) give no forest and every undecided candidate is kept as a
secret; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import text_of, written

#: Shortest candidate; shortest one without a digit; characters looked at on either side.
SHORTEST, SHORTEST_PLAIN, NEAR = 12, 28, 40
DICTIONARY, MAX_FINDINGS = 5_000, 50_000
TREES, DEPTH = 30, 6

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{%d,}={0,2}(?![A-Za-z0-9+/_\-])" % SHORTEST)
DOTTED = re.compile(r"(?<![A-Za-z0-9+/_\-.])[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,})+={0,2}(?![A-Za-z0-9+/_\-])")
WORD = re.compile(r"[a-z]{3,10}")
#: Names that keys and passwords are assigned to, formats of known keys, and words beside harmless runs.
KEY_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential")
KEY_FORMATS = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_\-]{35}"
)
HARMLESS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "isbn", "version", "id", "page", "example")
ASSIGNED = re.compile(r"(?i)(?:%s)[\w\-]{0,12}[\"']?\s{0,3}[:=]\s{0,3}[\"']?$" % "|".join(map(re.escape, KEY_NAMES)))
VALUE = re.compile(
    r"(?i)(?!author)(?:%s)[\w\-]{0,12}[\"']?\s{0,3}[:=]\s{0,3}(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"']+))" % "|".join(map(re.escape, KEY_NAMES))
)
USER_PART = re.compile(r"://[^\s/:@]*:([^\s/]+)@")
USER_BEFORE = re.compile(r"://[^\s/:@]*:$")
NUMBER = re.compile(r"[\d\-]+")

FEATURES = (
    "size", "changes", "letter_likelihood", "entropy", "digits", "uppers", "symbols", "hex", "coverage", "path", "extension",
    "key_name", "assigned", "quoted", "harmless", "address", "known_format", "user_part",
)
KINDS = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """The commonest lower-case words of 3 to 10 letters in all texts, and their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                counts.update(WORD.findall(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

    words = docs.select(text_of().alias("_text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in words.filter("n > 1").orderBy(F.col("n").desc(), "word").limit(size).collect()}


def letter_pairs(words: dict[str, int]) -> dict[str, float]:
    """Log-probability of each second letter after a first one, with one count for every pair."""
    counts: Counter = Counter()
    for word, n in words.items():
        for k in range(len(word) - 1):
            counts[word[k : k + 2]] += n
    firsts: Counter = Counter()
    for pair, n in counts.items():
        firsts[pair[0]] += n
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {a + b: math.log((counts[a + b] + 1) / (firsts[a] + 26)) for a in letters for b in letters}


def covered(run: str, words: dict[str, int]) -> float:
    """Share of a run's characters in dictionary words of 4 letters or more, longest first from the left."""
    lower, at, got = run.lower(), 0, 0
    while at < len(lower):
        step = next((k for k in range(min(10, len(lower) - at), 3, -1) if lower[at : at + k] in words), 0)
        got += step
        at += step or 1
    return got / len(lower)


def describe(run: str, before: str, after: str, words: dict[str, int], pairs: dict[str, float]) -> list[float]:
    """The features of a candidate, in the order of FEATURES."""
    n, lower, kinds = len(run), run.lower(), run.translate(KINDS)
    counts = Counter(run)
    near = before.lower().split()[-3:] + after.lower().split()[:3]
    plain = [w.strip("\"'=:;,.()") for w in near]
    likelihood = [pairs[lower[k : k + 2]] for k in range(n - 1) if lower[k : k + 2] in pairs]
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), float(np.mean(likelihood)) if likelihood else -5.0,
        -sum(c / n * math.log2(c / n) for c in counts.values()), kinds.count("0") / n, kinds.count("A") / n,
        sum(k not in "aA0" for k in kinds) / n, float(all(c in "0123456789abcdef" for c in lower)), covered(run, words),
        float(run.count("/")), float(bool(re.match(r"\.\w{1,4}\b", after))), float(any(k in w for w in near for k in KEY_NAMES)),
        float(bool(ASSIGNED.search(before))), float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]),
        float(any(w in HARMLESS for w in plain)), float(after[:1] == "@" or before[-1:] in ("@", ".") or "://" in before[-12:]),
        float(bool(KEY_FORMATS.fullmatch(run))), float(after[:1] == "@" and bool(USER_BEFORE.search(before))),
    ]


def runs(text: str) -> list[tuple[int, int]]:
    """(from, to) of each candidate, in order; one that lies in, or laps over, an earlier kind's is left to that."""
    values = [m.span(m.lastindex) for pattern in (USER_PART, VALUE) for m in pattern.finditer(text)]
    values = [(a, b - (0 if text[b : b + 1] in ("'", '"', "@") else len(text[a:b]) - len(text[a:b].rstrip(",;)]}>")))) for a, b in values]
    wide = [
        m.span() for pattern in (DOTTED, CANDIDATE) for m in pattern.finditer(text)
        if len(m[0]) >= SHORTEST_PLAIN or any(c.isdigit() for c in m[0])
    ]
    out: list[tuple[int, int]] = []
    for a, b in [*values, *wide]:
        at = bisect_left(out, (a, b))
        if a < b and (at == 0 or out[at - 1][1] <= a) and (at == len(out) or out[at][0] >= b):
            out.insert(at, (a, b))
    return out


def candidates(docs: DataFrame, words: dict[str, int]) -> DataFrame:
    """doc_id, at (place in code points), length, digest of the run and its features."""
    rows = docs.select("doc_id", text_of().alias("_text"))
    pairs = letter_pairs(words)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, digest, table = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                for start, end in runs(text):
                    run = text[start:end]
                    row.append(k)
                    at.append(start)
                    digest.append(hashlib.sha256(run.encode()).hexdigest())
                    table.append(describe(run, text[max(0, start - NEAR) : start], text[end : end + NEAR], words, pairs))
            values = np.array(table, float).reshape(len(table), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(digest, pa.string()),
                 *[pa.array(values[:, k]) for k in range(len(FEATURES))]],
                names=["doc_id", "at", "digest", *FEATURES],
            )

    return rows.mapInArrow(found, f"doc_id {kind}, at long, digest string, " + ", ".join(f"{f} double" for f in FEATURES))


def by_rule():
    """True, false or null (undecided) for a candidate's features."""
    return (
        F.when((F.col("known_format") == 1) | (F.col("user_part") == 1) | ((F.col("assigned") == 1) & (F.col("digits") > 0) & (F.col("coverage") < 0.5)), True)
        .when((F.col("digits") == 1) | (F.col("address") == 1) | (F.col("coverage") >= 0.5) | (F.col("harmless") == 1), False)
    )


def scan(docs: DataFrame, findings: DataFrame | None = None, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """doc_id, at, length, digest, score and secret of every candidate; findings: labelled (doc_id, at, secret)."""
    found = written(candidates(docs, dictionary(docs)), "secret-candidates")
    label = by_rule()
    if findings is not None:
        said = findings.groupBy("doc_id", "at").agg(F.max("secret").alias("_said"))
        found, label = found.join(said, ["doc_id", "at"], "left"), F.col("_said")
    found = found.withColumns({
        "_label": label.cast("double"), "_fold": F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    })
    known = found.filter("_label IS NOT NULL AND _fold <> 0")
    share = min(1.0, max_findings / max(1, known.count()))
    known = written(
        known.filter(F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("at").cast("string")).cast("binary")) < int(share * 2**32)),
        "secret-labelled",
    )
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    if known.select("_label").distinct().count() < 2:
        scored = found.withColumn("score", F.coalesce("_label", F.lit(1.0)))
    else:
        forest = RandomForestClassifier(
            featuresCol="_features", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, seed=11, predictionCol="_predicted",
            probabilityCol="_probability", rawPredictionCol="_votes",
        ).fit(assembled.transform(known))
        scored = forest.transform(assembled.transform(found)).withColumn("score", vector_to_array("_probability")[1])
    return scored.select(
        "doc_id", "at", F.col("size").cast("long").alias("length"), "digest", F.round("score", 6).alias("score"),
        (F.col("score") >= 0.5).alias("secret"), F.col("_label").cast("boolean").alias("labelled"), (F.col("_fold") == 0).alias("held_out"),
    )


def secrets(docs: DataFrame) -> DataFrame:
    """Documents' secrets after the removal of false positives."""
    return scan(docs).filter("secret").select("doc_id", "at", "length", "digest", "score")
