"""Quality rules: a decision list learned from labelled statistics, as ordered Spark conditions.

Sequential covering: a rule is a conjunction of thresholds on statistics of a text. It is grown one
condition at a time by information gain on two thirds of the labelled rows, pruned on the last third,
kept if it is precise enough there, and the rows that it covers leave before the next rule is grown.
The list says ``reject`` for what a rule covers and ``keep`` otherwise.

Every step is an aggregation over all labelled rows: each row gives its bin of each statistic, and the
counts by statistic and bin (a table of at most len(GRIDS) * (longest grid + 1) rows, whatever the
input) are read by the driver, which chooses the condition. The thresholds are fixed grids, so reruns
learn the same rules.

Defined cases: a null or empty text has no words and fails the base rules, as every text of under
LEAST_WORDS words; rows without a label or with a null text teach nothing; without labelled rows of both
kinds no rule is learned and the base rules decide alone; repeated rows are judged one by one. Only
doc_id, text and the labels' doc_id and quality are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import SPACE, SPACE_CHARS, text_of, written

LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"

#: Fixed thresholds by statistic; all are whole numbers.
GRIDS: dict[str, tuple[int, ...]] = {
    "symbols_per_1000": (1, 2, 5, 10, 20, 35, 50, 75, 100, 150, 200, 300, 500),
    "upper_per_1000": (10, 25, 50, 75, 100, 150, 200, 300, 400, 500, 600, 750),
    "bangs_per_1000": (1, 2, 5, 10, 20, 35, 50, 75, 100, 150, 200, 300),
    "digits_per_1000": (1, 2, 5, 10, 20, 35, 50, 75, 100, 150, 200, 300),
    "word_length_10": (20, 30, 35, 40, 45, 50, 55, 60, 65, 70, 80, 100, 150),
    "repeats_per_1000": (1, 5, 10, 20, 50, 100, 150, 200, 300, 400, 500),
    "dup_lines_per_1000": (1, 2, 5, 10, 20, 30, 50, 75, 100),
    "words": (75, 100, 150, 200, 300, 500, 1000, 2000, 5000, 10000),
}
#: Most rules and conditions of the list, least precision on the pruning rows, least rows there.
MAX_RULES, MAX_CONDITIONS, LEAST_PRECISION, LEAST_COVERED = 12, 4, 0.9, 2


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold}"


Rule = tuple[Condition, ...]


def _without(text: Column, chars: str) -> Column:
    """How many characters of a text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _windows(hashes: Column) -> Column:
    """Hashes of the three-word windows of an array of word hashes; the array must be a column."""
    return F.when(F.size(hashes) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(hashes) - 2),
        lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i), F.get(hashes, i + 1)),
    ))


def _repeat_words(windows: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the same text.

    Windows are compared by 64-bit hashes of 64-bit word hashes. Texts without a repeated window, the
    most, stop at a distinct count; in the others windows are sorted with their places, and the places of
    equal neighbours, in order, cover three words each less what the next one covers as well.
    """
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeats, _covered(windows)).otherwise(0).cast("long")


def _covered(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        same = F.transform(p, lambda x, k: F.when(
            (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    return F.aggregate(
        F.aggregate(F.array(placed), F.array().cast("array<int>"), lambda _, p: repeated(p)),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the learner's statistics."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)
    with_text = (
        docs.withColumn("_text", text_of())
        .withColumns({"_words": F.filter(F.split("_text", SPACE + "+"), lambda w: w != ""), "_lines": lines})
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", _windows(F.col("_hashes")))
    )
    counted = with_text.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": _without(text, SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_windows")),
        "_upper": _without(text, UPPER),
        "_bangs": _without(text, "!"),
        "_digits": _without(text, DIGITS),
    })

    def rate(part: str, whole: str, times: int) -> Column:
        return F.floor(F.col(part) * times / F.greatest(F.col(whole), F.lit(1))).cast("long")

    return counted.withColumns({
        "symbols_per_1000": rate("n_symbols", "word_chars", 1000),
        "upper_per_1000": rate("_upper", "word_chars", 1000),
        "bangs_per_1000": rate("_bangs", "word_chars", 1000),
        "digits_per_1000": rate("_digits", "word_chars", 1000),
        "word_length_10": rate("word_chars", "n_words", 10),
        "repeats_per_1000": rate("n_repeat_words", "n_words", 1000),
        "dup_lines_per_1000": rate("n_dup_lines", "n_words", 1000),
        "words": F.col("n_words"),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }).drop("_text", "_words", "_lines", "_hashes", "_windows", "_upper", "_bangs", "_digits")


def _all(rule: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _histogram(rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
    """(rejects, keeps) by statistic and bin; bin i holds the values with i grid points at or below them."""
    bins = F.array(*[
        F.struct(F.lit(name).alias("statistic"), sum((F.col(name) >= t).cast("int") for t in grid).alias("bin"))
        for name, grid in GRIDS.items()
    ])
    counts = rows.select("bad", F.inline(bins)).groupBy("statistic", "bin").agg(
        F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")
    )
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts.collect():
        out.setdefault(r.statistic, {})[r.bin] = (r.bad, r.n - r.bad)
    return out


def _best(histogram: dict, used: Rule) -> tuple[Condition | None, int]:
    """The condition of most information gain, and how many growing rows to keep it covers.

    Neighbouring thresholds often cover the same rows; the middle one of them leaves most room to both sides.
    """
    found: list[tuple[float, Condition, int]] = []
    for name, grid in GRIDS.items():
        bins = histogram.get(name, {})
        bad = sum(b for b, _ in bins.values())
        good = sum(g for _, g in bins.values())
        if not bad:
            continue
        now = math.log2(bad / (bad + good))
        for at_least in (True, False):
            for i, threshold in enumerate(grid, 1):
                covered = [v for b, v in bins.items() if (b >= i) == at_least]
                p, n = sum(v[0] for v in covered), sum(v[1] for v in covered)
                condition = Condition(name, at_least, threshold)
                if p and (p, n) != (bad, good) and condition not in used:
                    found.append((round(p * (math.log2(p / (p + n)) - now), 9), condition, n))
    most = max((gain for gain, _, _ in found), default=0.0)
    if most <= 0:
        return None, 0
    _, first, good = next(x for x in found if x[0] == most)
    ties = [c for gain, c, n in found if (gain, n, c.statistic, c.at_least) == (most, good, first.statistic, first.at_least)]
    return ties[len(ties) // 2], good


def learn(labelled: DataFrame) -> list[Rule]:
    """Ordered rules from rows with the statistics, ``bad`` (boolean) and ``fold`` (0 to 2; 2 prunes)."""
    rules: list[Rule] = []
    rest = labelled
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            condition, good = _best(_histogram(rest.filter(_all(rule) & (F.col("fold") < 2))), rule)
            if condition is None:
                break
            rule += (condition,)
            if not good:
                break
        if not rule:
            break
        cuts = [rule[: i + 1] for i in range(len(rule))]
        pruned = rest.filter(F.col("fold") == 2).agg(*[
            F.struct(
                F.count_if(_all(cut) & F.col("bad")).alias("bad"), F.count_if(_all(cut) & ~F.col("bad")).alias("good")
            ).alias(f"cut_{i}")
            for i, cut in enumerate(cuts)
        ]).first()
        found = [(pruned[i].bad, pruned[i].good, cut) for i, cut in enumerate(cuts) if pruned[i].bad + pruned[i].good]
        if not found:
            break
        bad, good, cut = max(found, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1]), x[0], -len(x[2])))
        if bad < LEAST_COVERED or bad / (bad + good) < LEAST_PRECISION:
            break
        rules.append(cut)
        rest = rest.filter(~_all(cut))
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """True to keep: the base rules, then the learned list, as one ordered conditional expression."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        out = out.when(_all(rule), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the text of the rule that rejected."""
    statistics = written(base_statistics(docs.select("doc_id", "text")).drop("text"), "quality-statistics")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.min("quality") == 0).alias("bad")
    )
    labelled = written(
        statistics.filter("NOT base_failed").join(known, "doc_id").select(
            "bad", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3).alias("fold"), *GRIDS
        ),
        "quality-labelled",
    )
    rules = learn(labelled)
    said = F.when(F.col("base_failed"), "base")
    for rule in rules:
        said = said.when(_all(rule), " and ".join(map(str, rule)))
    return statistics.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        verdict(rules).alias("kept"), said.alias("rejected_by"),
    )
