"""Rule and corpus files, published tables, OCR tables and layout entities."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from pactum.operators.rule_table import DEFAULT_RULES, RuleSet
from pactum.sources import layouts, wage_files
from pactum.sources.law_files import read_corpus, read_rules


def test_rules_file(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/rules.json"
    json.dump({"rulesetVersion": "9", "lawVersion": "2030", "rules": DEFAULT_RULES}, open(path, "w"))
    rules = read_rules(spark, path)
    assert (rules.ruleset_version, rules.law_version, rules.df(spark).count()) == ("9", "2030", 19)
    assert len(rules.candidates().rules) == 11
    with pytest.raises(ValueError, match="duplicate"):
        RuleSet((DEFAULT_RULES[0], DEFAULT_RULES[0]))


def test_corpus_file(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/articles.json"
    rows = [
        {"lawVersion": "2025-11", "source": "labor_law", "article": "83", "paragraph": "1", "textAr": None, "textEnUnofficial": "x", "note": "n"},
        {"lawVersion": "2025-11", "source": "labor_law", "article": "79 bis", "paragraph": None, "textAr": "y", "textEnUnofficial": None},
    ]
    json.dump(rows, open(path, "w"))
    corpus = read_corpus(spark, path)
    assert "note" not in corpus.columns
    assert sorted(r.id for r in corpus.collect()) == ["law_2025-11_labor_law_79-bis", "law_2025-11_labor_law_83_1"]


def test_layout_entities(spark):
    xml = '<page width="595" height="842"><word xMin="1.5" yMin="2" xMax="3" yMax="4">A&amp;B &#39;&#x627;&lt;</word><word xMin="1" yMin="1" xMax="1" yMax="1"> </word></page>'
    files = spark.createDataFrame([("d", xml)], "doc_id string, content string")
    row = layouts.layout_words(files).collect()
    assert [(r.text, r.x_min, r.page_height) for r in row] == [("A&B 'ا<", 1.5, 842.0)]


def test_ocr_words_take_line_height(spark):
    lines = ["head", "1\t1\t0\t0\t0\t0\t0\t0\t600\t1200\t-1\t", "4\t1\t1\t1\t1\t0\t30\t60\t300\t30\t-1\t", "5\t1\t1\t1\t1\t1\t30\t65\t60\t20\t90\tHello", "5\t1\t1\t1\t1\t2\t90\t65\t60\t20\t90\t "]
    files = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, content string")
    (r,) = layouts.ocr_words(files, 150).select(F.struct("*").alias("r")).collect()
    w = r.r
    assert (w.text, w.page, w.page_height) == ("Hello", 1, 576.0)
    assert [round(x, 3) for x in (w.x_min, w.y_min, w.x_max, w.y_max)] == [14.4, 28.8, 43.2, 43.2]


def test_cells_are_split_as_by_the_expression(spark):
    """One pass over the quotes gives what the lookahead expression gives, for unbalanced quotes as well."""
    import random
    import re

    rng = random.Random(1)
    lines = ["".join(rng.choice('a b,,"" x"') for _ in range(rng.randint(0, 14))) for _ in range(800)] + ['"a, ""b""",c', "", ","]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").select("k", wage_files.cells(F.col("line")).alias("c"))
    for r in got.collect():
        parts = re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*$)', lines[r.k])
        assert r.c == [re.sub(r'^"([\s\S]*)"$', r"\1", p.strip(" ")).replace('""', '"') for p in parts], lines[r.k]


def test_a_header_below_a_long_preamble_is_found(spark):
    lines = [(1, n, f"note {n}") for n in range(14)] + [(1, 14, "EmployeeID,EmployeeName,BasicSalary,HousingAllowance,OtherAllowances,BasicSalary")]
    lines += [(1, 15, '1234567890,"Doe, J",1,2,3,"5,000"')]
    df = spark.createDataFrame(lines, "file int, pos int, line string")
    assert wage_files.read_payroll(df)[2].count() == 1
    paid, rejected, bad = wage_files.read_payroll(df, search_rows=20)
    assert [(r.employee_id, r["name"], r.basic) for r in paid.collect()] == [("1234567890", "Doe, J", 5000.0)]
    assert rejected.count() == 0 and bad.count() == 0


def test_pages_hold_the_texts_of_their_words(spark):
    """Read page by page or word by word, with whatever stands between and inside the words."""
    odd = [
        "<page><word>a\nb</word>x<word >&lt;word&gt; 1 > 2 </word><words>no</words><word/>c</word></page>", None, "", "<page>",
        "<pages><word>no</word></pages>\n<page\nwidth='1'><word a=\"<\">&#32;</word><word>&AMP;&#x1F600;</word><word>open</page><word>out</word><page></page>",
    ]
    files = spark.createDataFrame(list(enumerate(odd)), "doc_id int, content string")
    words = {(r.doc_id, r.page, r.word_no): r.text for r in layouts.layout_words(files).collect()}
    pages = layouts.layout_pages(files).collect()
    assert {(p.doc_id, p.page, w.word_no): w.text for p in pages for w in p.words} == words
    assert words == {(0, 1, 0): "a\nb", (0, 1, 1): "<word> 1 > 2", (0, 1, 2): "c", (4, 1, 1): "&\U0001f600"}
    assert sorted((p.doc_id, p.page) for p in pages) == [(0, 1), (4, 1), (4, 2)]


def test_words_of_a_page_are_not_spread_to_be_gathered(spark):
    from pactum.workload import all_queries

    facts = all_queries()["src_layout_words"](spark, "/root/testdata/sf0.001")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the pages of a file
    assert r"[\s\S]" not in layouts.PAGE + layouts.WORD
