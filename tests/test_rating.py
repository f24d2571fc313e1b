"""The thirteen rated example contracts and the calibration contract, end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pactum.operators.rule_table import default_rules
from pactum.operators.verdicts import PROBLEM_VERDICTS
from pactum.plans.rate import rate

CASES = json.load(
    open(os.path.join(os.path.dirname(__file__), "fixtures", "rating_cases.json"), encoding="utf-8")
)
FIELDS = (
    "contract_id long, contract_type string, commencement_date date, end_date date, term_months int, "
    "auto_renew boolean, renewal_notice_days int, probation_days int, probation_excluded_days array<string>, "
    "work_days_per_week double, daily_hours double, weekly_hours double, rest_days_per_week double, "
    "annual_leave_days int, wage struct<basic:double,housing:double,transport:double,other:double,total:double>, "
    "overtime_premium_pct double, nationality string, needs_review boolean"
)
EXCLUDED = ["eid_al_fitr", "eid_al_adha", "national_day", "foundation_day", "sick_leave"]
CALIBRATION = {
    "id": "90", "today": "2026-10-04", "status": "done",
    "fields": {
        "contractType": "fixed_term", "commencementDate": "2026-01-11", "endDate": "2027-01-10", "termMonths": 12,
        "autoRenew": True, "renewalNoticeDays": 30, "probationDays": 180, "workDaysPerWeek": 5, "dailyHours": 8,
        "weeklyHours": 40, "annualLeaveDays": 22, "overtimePremiumPct": 50, "nationality": "saudi",
        "wage": {"basic": 10000, "housing": 2500, "transport": 1000, "other": 0, "total": 13500},
    },
    "clauses": [
        ["This contract is for an unlimited period and ends upon completion of the project in accordance with Article 57 of the Labor Law.", None],
        ["The employee shall not disclose any information about the employer's business at any time, during or after employment.", None],
        ["The employer may transfer the employee to any of its branches or projects anywhere in the Kingdom.", None],
        ["If either party terminates this contract before its expiry without a valid reason, it shall pay the other party compensation equal to two months of basic wage.", None],
        ["Annual leave must be taken within the same calendar year and may not be carried forward.", None],
        ["The end-of-service award shall be calculated on the basis of the basic salary only.", None],
        ["This contract supersedes all prior agreements between the parties.", None],
    ],
}


def _row(case):
    f = case["fields"]
    num = lambda k: None if f.get(k) is None else float(f[k])
    day = lambda k: None if f.get(k) is None else __import__("datetime").date.fromisoformat(f[k])
    w = f.get("wage")
    wage = None if w is None else tuple(float(w[k]) for k in ("basic", "housing", "transport", "other", "total"))
    return (
        int(case["id"]), f.get("contractType", "unknown"), day("commencementDate"), day("endDate"), f.get("termMonths"),
        f.get("autoRenew"), f.get("renewalNoticeDays"), f.get("probationDays"), f.get("probationExcludedDays", EXCLUDED),
        num("workDaysPerWeek"), num("dailyHours"), num("weeklyHours"), None, f.get("annualLeaveDays"), wage,
        num("overtimePremiumPct"), f.get("nationality"), case["status"] == "needs_review",
    )


@pytest.fixture(scope="module")
def rated(spark):
    cases = [*CASES, CALIBRATION]
    assert len({c["today"] for c in cases}) == 1
    fields = spark.createDataFrame([_row(c) for c in cases], FIELDS)
    clauses = spark.createDataFrame(
        [(int(c["id"]), f"15.{i + 1}", en, ar) for c in cases for i, (en, ar) in enumerate(c["clauses"])],
        "contract_id long, clause string, text_en string, text_ar string",
    )
    r = rate(fields, clauses, default_rules(), cases[0]["today"])
    rows = lambda df: [x.asDict(recursive=True) for x in df.collect()]
    return {
        "findings": rows(r.findings.orderBy("contract_id", "position")), "deadlines": rows(r.deadlines),
        "scores": rows(r.scores), "status": rows(r.status),
    }


def _of(rows, case):
    return [r for r in rows if r["contract_id"] == int(case["id"])]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c["id"])
def test_example_contract(rated, case):
    key = lambda r: (r["rule_id"], r["clause"], r["verdict"], r["severity"])
    found = _of(rated["findings"], case)
    wanted = {tuple(x) for x in case["findings"]}
    assert wanted <= {key(r) for r in found}
    problems = {key(r) for r in found if r["source"] != "info" and r["verdict"] in PROBLEM_VERDICTS}
    assert problems <= wanted
    assert [r["status"] for r in _of(rated["status"], case)] == [case["status"]]
    if case["deadlines"] is not None:
        got = sorted((r["rule_id"], str(r["date"])) for r in _of(rated["deadlines"], case))
        assert got == sorted(tuple(x) for x in case["deadlines"])
    if case["score"]:
        for r in _of(rated["scores"], case):
            low, high = case["score"][r["view"]]
            assert low <= r["overall"] <= high, r


def test_calibration(rated):
    found = _of(rated["findings"], CALIBRATION)
    problems = [(r["rule_id"], r["clause"], r["verdict"], r["severity"]) for r in found if r["verdict"] in PROBLEM_VERDICTS]
    assert problems == [
        ("TYPE-ART57-01", "15.1", "unclear", "high"),
        ("CONFIDENTIAL-01", "15.2", "unclear", "low"),
        ("TRANSFER-KSA-01", "15.3", "worse_than_default", "medium"),
        ("COMP-ART77-01", "15.4", "worse_than_default", "high"),
        ("LEAVE-FORFEIT-01", "15.5", "unclear", "low"),
        ("EOS-BASE-01", "15.6", "likely_void", "high"),
        ("TYPE-CONFLICT-01", "15.1", "conflict", "high"),
    ]
    impact = {r["rule_id"]: r["impact"]["sar"] for r in found if r["impact"]}
    assert impact["EOS-BASE-01"] == {"1y": 1750, "5y": 8750, "10y": 26250}
    assert impact["COMP-ART77-01"] == {"contract": 20000, "default": 162000, "gap": 142000}
    scores = {r["view"]: r for r in _of(rated["scores"], CALIBRATION)}
    employee = scores["employee"]
    assert (employee["legal"], employee["market"], employee["clarity"]) == (61, 72, 57)
    assert (employee["overall"], employee["band"]) == (64, "Fair")
    assert (scores["hr"]["overall"], scores["hr"]["band"]) == (61, "Fair")
    assert [str(r["date"]) for r in _of(rated["deadlines"], CALIBRATION) if r["kind"] == "renewal_notice"] == ["2026-12-11"]


def test_layout_to_rating(spark):
    from pactum.plans.rate import rate_layouts
    import pactum.workload.q_layout  # noqa: F401  (defines the layout views)
    from pactum.workload.views import load

    words = load(spark, "/root/testdata/sf0.001", "contract_words").where("doc_id < 5")
    rating, rejected = rate_layouts(words, default_rules(), "2024-06-01")
    clauses = rating.clauses.collect()
    assert rejected.count() == 0
    assert {(r.contract_id, r.clause) for r in clauses} == {(i, f"15.{k}") for i in range(5) for k in (1, 2, 3)}
    assert rating.scores.where(F.col("overall").between(0, 100)).count() == 10


def test_reports_are_dealt_out_by_contract_once(spark):
    from pactum.workload import all_queries

    sf, queries = "/root/testdata/sf0.01", all_queries()
    # Tables are dealt out by key (REPARTITION_BY_NUM); what is built on them stays there.
    for name, dealt, further in (("passages", 3, 0), ("report_assemble", 4, 1), ("contract_numbering", 3, 1)):
        plan = queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        by_num = sum("REPARTITION_BY_NUM" in line for line in exchanges)
        assert (by_num, len(exchanges) - by_num) == (dealt, further), (name, exchanges)


def test_numbers_of_items_stacked_with_their_passages(spark):
    from pactum.operators import report

    items = [("c", 1, "issues", "low"), ("c", 1, "good", "none"), ("c", None, "issues", "high"), ("c", None, "issues", "low"), ("d", 1, "issues", "high")]
    df = spark.createDataFrame(items, "contract_id string, position long, tab string, severity string")
    found = [("c", 1, 0, "6.1", None), ("c", None, 0, "6.1", None), (None, 1, 0, "6.1", None)]
    findings = spark.createDataFrame(found, "contract_id string, position long, n int, clause string, related_clause string")
    box = [("c", "6", 2, 9.0), ("c", "6.1", 3, 5.0), ("d", "6.1", 1, 1.0), (None, "6.1", 1, 1.0)]
    places = spark.createDataFrame(box, "contract_id string, clause string, page int, y_min double").selectExpr(
        "*", "1D AS page_width", "1D AS page_height", "0D AS x_min", "1D AS x_max", "2D AS y_max"
    )
    texts = spark.createDataFrame([("c", "6.1", "t", None), ("c", "7", "u", "v")], "contract_id string, clause string, text_en string, text_ar string")
    passages = report.passages(findings, places, texts)
    assert sorted((r.contract_id, r.position, r.clause, r.page, r.text_en, r.approximate) for r in passages.where("position = 1").collect()) == [
        ("c", 1, "6.1", 3, "t", False)
    ]
    rows = report.contract_numbering(df, passages).collect()
    assert sorted((r.contract_id, r.position or 0, r.tab, r.severity, r.number, r.list_no) for r in rows) == [
        ("c", 0, "issues", "high", None, 1), ("c", 0, "issues", "low", None, 3), ("c", 1, "good", "none", 1, 1),
        ("c", 1, "issues", "low", 1, 2), ("d", 1, "issues", "high", None, 1),
    ]
