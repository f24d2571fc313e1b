"""The analyser flow asks once for equal requests, asks again with the error, and nothing that the cache holds."""

from pyspark.sql import functions as F

from pactum.operators import analyser
from pactum.operators import clause_analysis as ca
from pactum.operators.rule_table import default_rules

RULES = default_rules()
GOOD = '{"clause":"x","matches":[{"ruleId":"EOS-BASE-01","verdict":"likely_void","severity":"none","confidence":"high","articles":[%s],"explanation":"e"}]}'


def clauses(spark):
    texts = ["award on basic salary", "award on basic salary", "wrong once", "wrong always", "throws", "silent"]
    rows = [(k // 3 + 1, f"15.{k}", t, None, f"h-{t}", "s") for k, t in enumerate(texts)] + [(9, "15.9", " ", "", "h", "s")]
    return spark.createDataFrame(rows, "contract_id long, clause string, text_en string, text_ar string, text_hash string, summary string")


def make_plugin():
    good = GOOD % '"Art. 999"'

    def plugin(batches):
        for batch in batches:
            if len(batch) > 1 and "throws" in set(batch["text_en"]):
                raise RuntimeError("a whole batch")
            batch = batch[batch["text_en"] != "silent"]
            replies = []
            for row in batch.itertuples():
                if row.text_en == "throws":
                    raise RuntimeError("one row")
                wrong = row.text_en == "wrong always" or (row.text_en == "wrong once" and not row.previous_error)
                replies.append("no" if wrong else good)
            yield batch[["cache_key"]].assign(reply=replies, input_tokens=100, output_tokens=1)

    return plugin


def test_flow(spark):
    plugin = make_plugin()

    def never(batches):
        raise AssertionError("asked again")
        yield

    empty = spark.createDataFrame([], "cache_key string, result string")
    articles = spark.createDataFrame([("Art. 999",)], "citation string")
    run = analyser.analyse(clauses(spark), empty, RULES, plugin, None, "p", "m", articles)
    got = {(r.contract_id, r.clause, r.rule_id, r.needs_review) for r in run.findings.collect()}
    assert got == {
        (1, "15.0", "EOS-BASE-01", False), (1, "15.1", "EOS-BASE-01", False), (1, "15.2", "EOS-BASE-01", False),
        (2, "15.3", "REVIEW-00", True), (2, "15.4", "REVIEW-00", True), (2, "15.5", "REVIEW-00", True),
    }
    assert {tuple(r) for r in run.usage.collect()} == {(1, 300, 3), (2, 200, 2)}
    # Articles that are not provided make every reply invalid.
    strict = analyser.analyse(clauses(spark), empty, RULES, plugin, None, "p", "m")
    assert {r.rule_id for r in strict.findings.collect()} == {"REVIEW-00"}
    # What was answered is in the cache: only the rejected requests are asked again.
    held = analyser.remembered(empty.withColumn("created_at", F.current_timestamp()), run.entries)
    assert held.count() == 2
    known = clauses(spark).where("text_en IN ('award on basic salary', 'wrong once')")
    again = analyser.analyse(known, held.drop("created_at"), RULES, never, None, "p", "m", articles)
    assert {(r.clause, r.rule_id) for r in again.findings.collect()} == {(f"15.{k}", "EOS-BASE-01") for k in range(3)}
    assert again.usage.count() == 0 and again.entries.count() == 0


def test_cross_check(spark):
    plugin = make_plugin()

    def cross(batches):
        for batch in batches:
            bad = batch["previous_error"].isna()
            named = [i[0]["clause"] if len(i) > 1 else "no" for i in batch["items"]]
            replies = [
                '{"conflicts":[' + ",".join(
                    ['{"ruleId":"TYPE-CONFLICT-01","clause":"%s","templateClause":"1","severity":"low","confidence":"high","articles":[],"explanation":"x"}' % c] * 2
                ) + "]}" for c in named
            ]
            yield batch[["cache_key"]].assign(reply=[None if b else r for b, r in zip(bad, replies)], input_tokens=7)

    rows = clauses(spark).unionByName(clauses(spark).where("contract_id = 1").withColumn("contract_id", F.lit(5).cast("long")))
    rows = rows.unionByName(clauses(spark).where("clause = '15.3'").withColumn("contract_id", F.lit(7).cast("long")))
    empty = spark.createDataFrame([], "cache_key string, result string")
    run = analyser.analyse(rows, empty, RULES, plugin, cross, "p", "m")
    found = {(r.contract_id, r.clause, r.rule_id, r.severity) for r in run.findings.where("source = 'cross_check'").collect()}
    assert found == {
        (1, "15.0", "TYPE-CONFLICT-01", "low"), (5, "15.0", "TYPE-CONFLICT-01", "low"), (2, "15.3", "TYPE-CONFLICT-01", "low"),
        (7, None, "REVIEW-00", "low"),
    }
    # Contracts 1 and 5 ask the same: two attempts, charged to the first.
    assert {r.contract_id: r.input_tokens % 100 for r in run.usage.collect()} == {1: 14, 2: 14, 7: 14}
    assert analyser.analyse(rows.limit(0), empty, RULES, plugin, cross, "p", "m").findings.count() == 0
