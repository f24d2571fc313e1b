"""Text, quantities, redaction, hashing, search and plug-ins against plain Python."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactum.functions import text as tx
from pactum.functions.numbers import round_half_up, thousands
from pactum.functions.quantities import quantities
from pactum.functions.redaction import redact_text, redaction_context
from pactum.operators import clause_analysis, clause_detectors, law, ops
from pactum.operators.rule_table import default_rules


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_numbers(spark):
    row = spark.sql("SELECT -2.5D AS a, 1234567.125D AS b").select(round_half_up(F.col("a"), 0), thousands(F.col("b"))).first()
    assert tuple(row) == (-2.0, "1,234,567.13")


def test_sentences_keep_abbreviations(spark):
    got = one(spark, tx.split_sentences(F.col("t")), t="see art. 57 of the law. version 3. next; no. 4!")
    assert got == ["see art. 57 of the law", "version 3", "next", "no. 4"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("one hundred and eighty (180) days", [(180.0, "day")]),
        ("for a year and 8 hours a day", [(1.0, "year"), (8.0, "hour")]),
        ("two and a half months, 15 working days", [(2.5, "month"), (15.0, "day")]),
        ("15 days a year", [(15.0, "day")]),
        ("seventeen weeks", [(17.0, "week")]),
    ],
)
def test_quantities(spark, text, expected):
    got = one(spark, quantities(F.col("t")), t=text)
    assert [(q.value, q.unit) for q in got] == expected
    for q in got:
        assert text.startswith(q.before) and text.endswith(q.after)


def test_arabic_forms(spark):
    assert one(spark, tx.normalise_arabic(F.col("t")), t="ﻻ  العـقد‏ ") == "لا العقد"
    assert one(spark, tx.normalise_search(F.col("t")), t="الإِجازة ١٢") == "الاجازه 12"
    assert one(spark, F.col("t").rlike(tx.arabic_phrase("عقد العمل الموحد")), t="دحوملا لمعلا دقع") is True


def test_redaction(spark):
    text = "Mail a.b@c.sa, SA0380000000608010167519, +966 55 000 0101, 0550000101, 1000000011 and NOUR  al-harbi; نورة الحربي"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = spark.createDataFrame(
        [(1, 0, "Nour Al-Harbi", "[EMPLOYEE]"), (1, 1, "نورة الحربي", "[EMPLOYEE]"), (1, 2, "Al", "[NAME]")],
        "doc_id long, order int, text string, placeholder string",
    )
    joined = docs.join(redaction_context(names), "doc_id", "left")
    once = joined.select(redact_text(F.col("text"), F.col("names")).alias("t"), "names")
    got = once.select("t", redact_text(F.col("t"), F.col("names")).alias("again")).first()
    assert got.t == "Mail [EMAIL], [IBAN], [PHONE], [PHONE], [ID] and [EMPLOYEE]; [EMPLOYEE]"
    assert got.again == got.t


def _fnv(text):
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def test_embedding_matches_plain_python(spark):
    words = ["w:years", "c:<ab", "w:عقد", "a😀b"]
    got = [one(spark, law.fnv1a(F.col("t")), t=w) for w in words]
    assert got == [_fnv(w) for w in words]
    assert got[-1] == 2412414209
    docs = spark.createDataFrame([(1, "The parties' annual leaves, annual leaves"), (2, "the of")], "id long, text string")
    vectors = {r.id: r.vector for r in law.hash_embed(docs, "id").collect()}
    assert math.isclose(sum(x * x for x in vectors[1]), 1.0) and not any(vectors[2])
    tokens = one(spark, law.tokens(F.col("t")), t="The parties' annual leaves, والإجازة 7")
    assert tokens == ["party", "annual", "leave", "اجازه", "7"]


def _embedding(tokens):
    weights = {}
    for word in tokens:
        common = word in law.COMMON_WORDS
        weights[f"w:{word}"] = weights.get(f"w:{word}", 0) + (0.25 if common else 1)
        padded = f"<{word}>"
        for k in range(0 if common else len(padded) - 2):
            name = "c:" + padded[k : k + 3]
            weights[name] = weights.get(name, 0) + 0.4
    vector = [0.0] * 256
    for name, weight in weights.items():
        h = _fnv(name)
        vector[h % 256] += (-1 if h >> 31 else 1) * (weight if weight <= 1 else 1 + math.log(weight))
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else vector


def test_texts_are_embedded_in_bulk_as_one_by_one(spark):
    """Whatever the words: long and short, common, repeated, of two scripts, beyond the first plane; and features are never rows."""
    import random

    rng = random.Random(3)
    odd = ["a1", "7", "employer", "عقد", "اجازه", "\U00010330\U00010331x", "x\U00010330", "aaaa", "z" * 64, "y" * 65, "q1" * 300, "bus"]
    words = odd + ["".join(rng.choices("abcde", k=rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 40, 900]))) for _ in range(60)] + ["", "the of", None, "aaaa " * 50]
    rows = [(i, i % 3, t) for i, t in enumerate(texts)] + [(1, 1, "bus aaaa"), (None, 0, "pay")]
    docs = spark.createDataFrame(rows, "id int, part int, text string")
    tokens = {}
    for r in docs.select("id", "part", law.tokens(F.col("text")).alias("t")).collect():
        tokens.setdefault((r.id, r.part), []).extend(r.t or [])
    embedded = law.hash_embed(docs, "id", "part")
    assert "Generate" not in embedded._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.part): r.vector for r in embedded.collect()}
    assert set(got) == set(tokens) and len(got) == len(rows) - 1
    for key, vector in got.items():
        assert all(abs(x - y) < 1e-12 for x, y in zip(vector, _embedding(tokens[key]), strict=True)), key
    whole = law._vectors(pa.array([tokens[k] for k in got]), law.DIM)
    dealt = law.hash_embed(docs.repartition(5, "id"), "id", "part")._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("Exchange hashpartitioning") == 1
    # The same to the last bit with other texts beside them.
    assert (whole == np.array(list(got.values()))).all()


def test_search_parts_agree(spark):
    rows = [(i, i, [math.sin(i * 3 + j) for j in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, corpus_order long, vector array<double>").withColumn("vector", law.unit(F.col("vector")))
    queries = df.where("id % 7 = 0").select(F.col("id").alias("query_id"), "vector")
    key = lambda r: (r.query_id, r.rank, r.id, round(r.score, 9))
    whole = sorted(key(r) for r in law.search(queries, df, 4).collect())
    assert sorted(key(r) for r in law.search(queries, df, 4, query_blocks=3, corpus_blocks=5).collect()) == whole
    unit = {r.id: r.vector for r in df.collect()}
    scores = sorted(((-sum(a * b for a, b in zip(unit[7], v)), i) for i, v in unit.items()))[:4]
    assert [(i, round(-s, 9)) for s, i in scores if s < 0] == [(r[2], r[3]) for r in whole if r[0] == 7]


def test_quota_acceptance_matches_brute_force(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=(i * 37) % 200), 1 + (i % 3 == 0), "upload") for i in range(120)]
    events = spark.createDataFrame(rows, "event_id long, at timestamp, user_id long, action string")
    got = {r.event_id: r.accepted for r in ops.accept_uploads(events, 2).collect()}
    taken, want = {}, {}
    for event, at, user, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        recent = [t for t in taken.get(user, []) if t > at - dt.timedelta(hours=24)]
        want[event] = len(recent) < 2
        taken[user] = [*recent, at] if want[event] else recent
    assert got == want


def test_plugin_analyser_with_retry(spark):
    def analyser(batches):
        for batch in batches:
            good = '{"clause":"15.1","matches":[]}'
            bad = '{"clause":"15.1","matches":[{"ruleId":"X","verdict":"unclear","severity":"low","confidence":"low","articles":[],"explanation":"e"}]}'
            second = batch["previous_error"].notna()
            reply = [good if (s or "fine" in t) and "never" not in t else bad for s, t in zip(second, batch["text_en"])]
            yield pd.DataFrame({"cache_key": batch["cache_key"], "reply": reply})

    misses = spark.createDataFrame(
        [("a", "fine"), ("b", "later"), ("c", "never")], "cache_key string, text_en string"
    )
    accepted, rejected = clause_analysis.run_analyser(misses, analyser, default_rules())
    assert sorted(r.cache_key for r in accepted.collect()) == ["a", "b"]
    assert [(r.cache_key, r.error) for r in rejected.collect()] == [("c", 'Rule "X" is not one of the candidate rules.')]


def test_plugin_that_is_silent_or_throws(spark):
    def analyser(batches):
        for batch in batches:
            if (batch["text_en"] == "boom").any():
                raise ValueError("boom")
            answered = batch[batch["text_en"] != "silent"]
            yield pd.DataFrame({"cache_key": answered["cache_key"], "reply": ['{"clause":"15.1","matches":[]}'] * len(answered)})

    misses = spark.createDataFrame([("a", "fine"), ("b", "silent"), ("c", "boom")], "cache_key string, text_en string").coalesce(1)
    accepted, rejected = clause_analysis.run_analyser(misses, analyser, default_rules())
    assert [r.cache_key for r in accepted.collect()] == ["a"]
    assert sorted(r.cache_key for r in rejected.collect()) == ["b", "c"]


def test_json_in_prose():
    find = clause_analysis.json_object
    assert find('{"a":1} and }') == '{"a":1}'
    assert find('{"a":1} then ```json\n{"b":2}\n```') == '{"b":2}'
    assert find('see {x} or {"s":"}\\"{","n":{"m":[1]}} end') == '{"s":"}\\"{","n":{"m":[1]}}'
    assert find("[1]") is None and find('{"a":NaN}') is None and find(None) is None and find("{" * 50) is None


def test_entities_are_decoded_once(spark):
    from pactum.sources.layouts import decode_entities

    cases = {"&#38;lt;": "&lt;", "&AMP;amp;": "&amp;", "a&nbsp;b &#x2019;&#X41; &copy; & &;": "a b \u2019A &copy; & &;", "&#128512;": "😀", "": ""}
    for text, want in cases.items():
        assert one(spark, decode_entities(F.col("t")), t=text) == want


def test_custom_detector(spark):
    mine = {"TRANSFER-KSA-01": lambda: F.when(clause_detectors.has("moon"), clause_detectors.detection("unclear", "low", "high", "Moon base."))}
    clauses = spark.createDataFrame([("To the Moon.", None), ("Stay.", None)], "text_en string, text_ar string")
    rows = clause_detectors.analyse_clauses(clauses, default_rules(), mine).collect()
    assert [[m.rule_id for m in r.matches] for r in rows] == [["TRANSFER-KSA-01"], []]


def test_acceptance_and_windows_are_cut_at_pauses(spark):
    """A busy user's rows become many segments; folds equal one pass over all of a user's rows."""
    import random

    rng = random.Random(3)
    at, rows = 0, []
    for k in range(400):
        at += rng.choice([1, 50, 3600, 40_000, 86_399, 86_400, 200_000]) * 1_000_000
        rows.append((k, at, 1 + k % 2))
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long").selectExpr(
        "event_id", "user_id", "timestamp_micros(us) AS at", "'upload' AS action"
    )
    segments = ops.cut_at_gaps(ops._uploads(events), ops.DAY_US).select("user_id", "segment").distinct().count()
    assert segments > 50
    want, taken, waits, window = {}, {1: [], 2: []}, {}, {1: None, 2: None}
    for k, us, user in rows:
        taken[user] = [t for t in taken[user] if t > us - ops.DAY_US]
        want[k] = len(taken[user]) < 2
        taken[user] += [us] if want[k] else []
        if window[user] is None or us - window[user][0] >= 60_000_000:
            window[user] = [us, 0]
        waits[k] = 0 if window[user][1] < 2 else -(-(window[user][0] + 60_000_000 - us) // 1_000_000)
        window[user][1] += window[user][1] < 2
    assert {r.event_id: r.accepted for r in ops.accept_uploads(events, 2).collect()} == want
    assert {r.event_id: r.retry_after_seconds for r in ops.request_windows(events, 2, 60_000_000).collect()} == waits
