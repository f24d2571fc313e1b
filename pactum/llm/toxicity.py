"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of lexicon words, their nearness to the second person, capitals,
punctuation and obfuscation. The lexicon has a fixed part, a few plain English insults, and a learned
part: words, and beginnings of words, that toxic training texts have far more often than others. It is
counted over the training texts with map-side sums; the best MAX_TERMS terms are kept, a size of the
model, so it may travel to every task.

Labels are read only of the training rows, those with crc32(doc_id) mod 5 not 0, and of about MAX_ROWS
of them at most, chosen by a hash of the id: remainders 1 to 3 give the lexicon and the trees, remainder 4 the
calibration of the trees' output to a probability (fitted where the trees have not been). A score depends on the
text alone.

Defined cases: a null or empty text has features of 0 and the score that belongs to them; a document
with several labels is toxic if one says so; rows without training labels of both kinds get a score of 0
and, in the texts with a fixed lexicon word, 1; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pactum.llm.shared import give_back, slices, small, text_of, written

#: Plain insults and the pronouns of the second person in four languages.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes",
)
#: What stands for a letter in disguised words.
DISGUISES = str.maketrans("013457@$!", "oieastasi")

#: Terms of the learned lexicon, most training rows of each fit, and how far apart two words are near.
MAX_TERMS, MAX_ROWS, NEAR = 2000, 40_000, 5
#: A term is learned if so many toxic texts have it, and so many times the share of the other texts that do.
LEAST_TEXTS, LEAST_LIFT = 3, 20.0
BEGINNINGS = (4, 5, 6)
WINDOW = 50
#: Texts that a task works on at a time.
SLICE = 500

WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
MARKS = re.compile(r"[!?.,;:\"'()\-]")
RUNS = re.compile(r"[!?]{2,}")
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
CAPITAL_WORDS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
#: Digits or signs between letters, and what belongs to the same word.
DISGUISED = re.compile(r"(?<=[^\W\d_])[\d@$*]+(?=[^\W\d_])")
DISGUISED_WORD = re.compile(r"[\w@$*]+")
#: Words whose value in the lexicon a worker remembers.
REMEMBERED = 100_000

FEATURES = (
    "fixed_density", "word_density", "beginning_density", "hits", "window_hits", "weight_density", "near_second_person",
    "second_person_density", "capital_rate", "capital_words", "mark_rate", "mark_runs", "disguised_rate", "disguised_hits",
    "log_words",
)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def terms(words: list[str]) -> set[str]:
    """Whole words marked by '=' and beginnings of longer words marked by their length."""
    out = set()
    for w in words:
        out.add("=" + w)
        out.update(f"{k}{w[:k]}" for k in BEGINNINGS if len(w) > k)
    return out


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Term to the logarithm of its lift, from all rows (text, toxic)."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, is_toxic in zip(batch.column(0), batch.column(1)):
                counts[is_toxic.as_py()].update(terms(list(set(WORDS.findall((text.as_py() or "").lower())))))
            found = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), *[pa.array([c[t] for t in found], pa.int64()) for c in counts[::-1]]],
                names=["term", "bad", "good"],
            )

    totals = labelled.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).first()
    if not totals.bad or not totals.good:
        return {}
    counted = labelled.select("text", "toxic").mapInArrow(exploded, "term string, bad long, good long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    lift = (F.col("bad") / totals.bad) / ((F.col("good") + 1) / totals.good)
    best = (
        counted.filter((F.col("bad") >= LEAST_TEXTS) & (lift >= min(LEAST_LIFT, totals.good / 4)))
        .select("term", F.log(lift).alias("weight"), (F.col("bad") * F.log(lift)).alias("worth"))
        .orderBy(F.col("worth").desc(), "term").limit(MAX_TERMS)
    )
    return {r.term: float(r.weight) for r in best.collect()}


class Lexicon:
    """The value of a word: FIXED for a fixed one, its weight for a learned one, minus the best weight of its beginnings."""

    FIXED = 10.0

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[str, float] = {}

    def values(self, words: list[str]) -> list[float]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.value(w)
        return [known[w] for w in words]

    def value(self, word: str) -> float:
        if word in INSULTS:
            return self.FIXED
        get = self.weights.get
        return get("=" + word, 0.0) or -max((get(f"{k}{word[:k]}", 0.0) for k in BEGINNINGS if len(word) > k), default=0.0)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of FEATURES."""
    lower = text.lower()
    words = WORDS.findall(lower)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    values = np.array(lexicon.values(words))
    places = np.flatnonzero(values)
    window = near = 0
    second = [i for i, w in enumerate(words) if w in _SECOND]
    if len(places):
        window = int((np.searchsorted(places, places + WINDOW) - np.arange(len(places))).max())
        if second:
            you = np.array(second)
            at = np.searchsorted(you, places)
            gap = np.minimum(abs(places - you[np.maximum(at - 1, 0)]), abs(you[np.minimum(at, len(you) - 1)] - places))
            near = int((gap <= NEAR).sum())
    chars = len(text)
    inside = [m.start() for m in DISGUISED.finditer(lower)]
    plain = [w.translate(DISGUISES) for w in DISGUISED_WORD.findall(lower)] if inside else []
    return [
        float((values == Lexicon.FIXED).sum()) / n, float(((values > 0) & (values < Lexicon.FIXED)).sum()) / n,
        float((values < 0).sum()) / n, float(min(len(places), 50)), float(window), float(abs(values).sum()) / n, near / n,
        len(second) / n, len(CAPITALS.findall(text)) / chars, len(CAPITAL_WORDS.findall(text)) / n,
        len(MARKS.findall(text)) / chars, len(RUNS.findall(text)) / n, len(inside) / n,
        max(0, sum(w in INSULTS for w in plain) - sum(w in INSULTS for w in words)) / n if inside else 0.0, float(np.log1p(n)),
    ]


_SECOND = frozenset(SECOND_PERSON)


def with_features(docs: DataFrame, lexicon: dict[str, float], *keys: str) -> DataFrame:
    """The keys and a column for each feature; texts are read whole, some at a time."""
    rows = docs.select(*keys) if "text" in keys else docs.select(*keys, text_of().alias("text"))
    at = rows.columns.index("text")
    schema = StructType([*rows.schema.fields[: len(keys)], *[StructField(f"_{f}", DoubleType()) for f in FEATURES]])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(lexicon)
        for batch in slices(batches, SLICE):
            table = np.array([features(t.as_py() or "", known) for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], *[pa.array(table[:, k]) for k in range(len(FEATURES))]],
                names=[*keys, *[f"_{f}" for f in FEATURES]],
            )
        give_back()

    return rows.mapInArrow(dense, schema)


def text_features(lexicon: dict[str, float]):
    """A column function from a text to the struct of its features, for rows that are too wide to travel with it."""

    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Lexicon(lexicon)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                table = np.array([features(t.as_py() or "", known) for t in part])
                yield pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(len(FEATURES))], [f"_{f}" for f in FEATURES])
        give_back()

    return F.arrow_udf(dense, StructType([StructField(f"_{f}", DoubleType()) for f in FEATURES]), F.ArrowUDFType.SCALAR_ITER)


class Scorer:
    """The lexicon, the trees and the calibration."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, docs: DataFrame, *keys: str) -> DataFrame:
        """The keys and ``_score`` (0 to 1, higher: toxic likelier) of each row's text."""
        return self.scored(with_features(docs, self.lexicon, *keys), *keys)

    def scored(self, dense: DataFrame, *keys: str) -> DataFrame:
        """The same from the features."""
        if self.trees is None:
            return dense.select(*keys, F.least(F.ceil("_fixed_density"), F.lit(1)).cast("double").alias("_score"))
        raw = _raw(self.trees.transform(_assembled(dense)))
        if self.calibration is None:
            return raw.select(*keys, F.col("_raw").alias("_score"))
        return self.calibration.transform(raw).select(*keys, F.least(F.greatest("_calibrated", F.lit(0.0)), F.lit(1.0)).alias("_score"))


def _assembled(dense: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"_{f}" for f in FEATURES], outputCol="_features").transform(dense)


def _raw(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("_raw", vector_to_array("_probability")[1])


def labelled_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, toxic and fold of the training labels: at most about max_rows by a hash of the id, so few that they are broadcast."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy(
        "doc_id"
    ).agg((F.max("toxic") > 0).alias("toxic"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary")) < F.lit(int(share * 2**32))
    return written(known.filter(chosen).withColumn("fold", fold(F.col("doc_id"))), "toxicity-labels")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Scorer:
    """Learns from the labels of rows whose fold is not 0; texts meet the bounded sample of labels without a shuffle."""
    sample = labelled_sample(labels, max_rows)
    rows = written(docs.select("doc_id", "text").join(small(sample), "doc_id"), "toxicity-labelled")
    lexicon = learn_lexicon(rows.filter("fold < 4"))
    dense = written(
        with_features(rows, lexicon, "fold", "toxic").withColumn("_label", F.col("toxic").cast("double")), "toxicity-features"
    )
    fit = _assembled(dense.filter("fold < 4"))
    if fit.select("_label").distinct().count() < 2:
        return Scorer(lexicon)
    trees = GBTClassifier(
        featuresCol="_features", labelCol="_label", predictionCol="_predicted", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32, minInstancesPerNode=2, seed=7, cacheNodeIds=False,
    ).setProbabilityCol("_probability").setRawPredictionCol("_margin").fit(fit)
    held = _raw(trees.transform(_assembled(dense.filter("fold = 4")))).select("_raw", "_label")
    if held.select("_label").distinct().count() < 2:
        return Scorer(lexicon, trees)
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="_label", predictionCol="_calibrated").fit(held)
    return Scorer(lexicon, trees, calibration)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = train(docs, labels).score(docs, "doc_id")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that score below 0.5: scored as they pass, without a join.

    Only the text goes to Python and only its features come back; the row waits for them as one struct, so its columns
    may have any names.
    """
    scorer = train(docs, labels)
    found = text_features(scorer.lexicon)(text_of())
    dense = docs.select(F.struct("*").alias("doc"), found.alias("_found")).select("doc", "_found.*")
    return scorer.scored(dense, "doc").filter("_score < 0.5").select("doc.*")
