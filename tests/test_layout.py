"""Rows of words, and how the tables of CPU-bound queries are dealt out."""

from __future__ import annotations

import re

from pactum.operators import layout
from pactum.workload import all_queries
from pactum.workload.views import SCAN_PARTITIONS, load

SF = "/root/testdata/sf0.01"


def test_words_of_one_split_are_dealt_out_and_shuffled_once(spark):
    all_queries()  # defines the views
    kept = spark.conf.get(SCAN_PARTITIONS, None)
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        words = load(spark, SF, "contract_words", heavy=True)
        assert words.rdd.getNumPartitions() >= min(2, spark.sparkContext.defaultParallelism)
        plan = layout.documents(layout.page_rows(words))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    finally:
        if kept is not None:
            spark.conf.set(SCAN_PARTITIONS, kept)


def test_rows_of_a_page(spark):
    words = [
        (1, 1, 10.0, 22.0, 5.0, "a"), (1, 1, 12.0, 24.0, 50.0, "b"), (1, 1, 13.5, 20.0, 60.0, "c"), (1, 1, 13.0, 25.0, 70.0, "d"),
        (1, 2, 12.0, 24.0, 5.0, "e"), (1, 2, None, 24.0, 5.0, "f"), (2, 1, 12.0, None, 5.0, "g"), (2, 1, 12.5, 20.0, 6.0, "h"),
    ]
    df = spark.createDataFrame(words, "doc_id long, page int, y_min double, y_max double, x_min double, text string")
    rows = {r.text: r.row_y for r in layout.with_rows(df).collect()}
    # 13.5 is more than a quarter of 12 pt below 10; a height that is not known counts as 1 pt.
    assert rows == {"a": 10.0, "b": 10.0, "d": 10.0, "c": 13.5, "e": 12.0, "g": 12.0, "h": 12.5}


def test_features_shuffle_words_once(spark):
    from pactum.operators import law
    from pyspark.sql import functions as F

    rows = [
        (1, "labor_law", "5", "The policies of classes and buses 7", "نص المادة 5"), (2, "labor_law", "6", None, None),
        (3, "qiwa_template", "7", "", "نص"), (4, "other", "", "the", None),
    ]
    articles = spark.createDataFrame(rows, "id long, source string, article string, text_en string, text_ar string")
    vectors = law.embed_articles(articles)
    texts = articles.select("id", F.col("text_en").alias("text"))
    plan = law.features(texts, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in vectors._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.vector for r in vectors.collect()}
    assert set(got) == {1, 3, 4} and not any(got[4]) and all(len(v) == law.DIM for v in got.values())
    words = spark.createDataFrame([("The policies of classes and buses 7 x \U0001d11e\u0627\u0644\u0639\u0627\u0645\u0644",)], "t string")
    assert words.select(law.tokens(F.col("t"))).first()[0][:4] == ["policy", "classe", "buse", "7"]
    names = spark.createDataFrame([("w:law",), ("c:\U0001d11ea",), ("",), (None,)], "n string")
    assert all(r[0] == r[1] for r in names.select(law.fnv1a(F.col("n")), law._remembered_fnv1a(F.col("n"))).collect())


def test_search_keeps_ties_in_order_whatever_the_slices(spark):
    from pactum.operators import law

    vectors = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(12)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    assert law.SCORES <= 10_000_000  # a bound that does not grow with the table
    found = law.search(df.withColumnRenamed("id", "query_id"), df.selectExpr("id", "id AS corpus_order", "vector"), 3, 2, 2).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: ([1, 2, 4] if i % 3 else [0, 3, 6]) for i in range(12)}


def _largest_method(spark, df):
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max([stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())], default=0)


def test_views_of_words_are_compiled(spark):
    all_queries()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # stages are generated while the plan is made
    try:
        # HotSpot leaves methods of more than 8,000 bytes interpreted.
        assert _largest_method(spark, load(spark, SF, "contract_words", heavy=True)) <= 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_headings_are_cleaned_once_and_found_as_before(spark):
    from pyspark.sql import functions as F

    texts = ["  2.  First Party’s\tInformation", "15. Additional  Terms", "1.2 Probation", "Probation", "6. Probation", None, "123. Probation"]
    cell = "array<struct<text:string>>"
    lines = [(1, [([(t,)] if t else [], 1) for t in texts])]
    df = spark.createDataFrame(lines, f"doc_id long, lines array<struct<en:{cell},page:int>>")
    column = layout._sections(F.col("lines"))
    got = df.select(F.inline(column)).collect()
    assert [tuple(r) for r in got] == [("first_party", "2", 0, 1, 1), ("additional", "15", 1, 4, 1), ("probation", "6", 4, 7, 1)]
    # A title was taken apart again for each of its patterns.
    assert str(column).count("regexp_extract(") == 2


def test_records_of_csv_rows_are_compiled(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _largest_method(spark, all_queries()["src_contract_csv"](spark, SF)) <= 8_000  # 17,466 when cells were read in each reason
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_words_do_not_carry_their_page(spark):
    from pactum.sources import layouts

    words = layouts.layout_words(spark.createDataFrame([(1, "<page></page>")], "doc_id long, content string"))
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    per_word = next(line for line in plan.splitlines() if "Generate posexplode(regexp_extract_all(page_xml" in line)
    assert "page_xml" not in re.sub(r"regexp_extract_all\(page_xml", "", per_word)
    assert "page_xml" not in plan[: plan.index(per_word)]  # above it nothing reads the page any more


def test_chunks_of_a_citation_are_joined_as_by_a_fold():
    import random

    from pactum.operators.law import Joined

    rng = random.Random(5)
    words = ["pay", "wage", "نص", "the", "clause", "of", "term", "law", "x\ny"]
    base = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 200]))) for _ in range(120)]
    chunks = []
    for i in range(600):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randrange(len(a) + 1)
        chunks.append(rng.choice([a, a[cut:], a[:cut], a[cut:] + "\n" + b[: len(b) // 2], b]).encode())
    chunks += [c + b"\n" + d for c, d in zip(chunks, chunks[1:])]
    held, plain = Joined(), None
    searched = 0
    for chunk in chunks:
        held.add(chunk)
        if plain is None:
            plain = chunk
        elif chunk not in plain:
            plain = plain + b"\n" + chunk
    assert held.text() == plain and Joined().text() is None

    class Counted(bytearray):
        def __contains__(self, text):
            nonlocal searched
            searched += 1
            return super().__contains__(text)

    held = Joined()
    held.add(b"first")
    held.held = Counted(held.held)
    for i in range(300):  # long chunks are not searched for in all that is held
        held.add(b" ".join(b"%d" % rng.randrange(10**6) for _ in range(200)))
    assert searched == 0 and len(held.runs) < 12


def test_chunks_of_a_citation_are_not_collected(spark):
    from pactum.operators import law
    from pyspark.sql import functions as F

    rows = [
        ("v", "labor_law", "1", None, 3, "bc", None), ("v", "labor_law", "1", None, 1, "abcd", "x"), ("v", "labor_law", "1", None, 2, "e", None),
        ("v", "labor_law", "2", None, 1, None, None), (None, "other", "3", None, 2, "", "y"), (None, "other", "3", None, 1, "z", "y"),
    ]
    articles = spark.createDataFrame(rows, "law_version string, source string, article string, paragraph string, n int, text_en string, text_ar string")
    merged = law.merge_by_citation(articles, F.col("n"))
    assert "collect_list" not in merged._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.law_version, r.citation): (r.text_ar, r.text_en) for r in merged.collect()}
    assert got == {("v", "Art. 1"): ("x", "abcd\ne"), ("v", "Art. 2"): (None, None), (None, None): ("y", "z")}


def test_text_of_a_cell_is_made_once(spark):
    """What is made of the text, such as its words, filters rows without making the text again below."""
    all_queries()  # defines the views
    words = load(spark, "/root/testdata/sf0.001", "contract_words")
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", {idno},") == 1
    assert words.where("text = ''").count() == 0 and words.where("text LIKE '%{%'").count() == 0


def test_every_section_has_a_text(spark):
    """A heading that is missing gives the whole document, one without a body an empty text; neither is left out."""
    from pyspark.sql import functions as F

    rows = ["5. Contract Period", "6. Probation", "6.1  Sixty days", "of the worker’s time", ""]
    lines = [(1, [([(t,)] if t else [], t, 1) for t in rows]), (2, [])]
    df = spark.createDataFrame(lines, "doc_id long, lines array<struct<en:array<struct<text:string>>,en_text:string,page:int>>")
    docs = df.withColumn("sections", layout._sections(F.col("lines")))
    got = {(r.doc_id, r.key): r.text for r in docs.select("doc_id", F.inline(layout.section_texts())).collect()}
    whole = "5. Contract Period 6. Probation 6.1 Sixty days of the worker's time"
    own = {"period": "", "probation": "6.1 Sixty days of the worker's time"}
    keys = [k for k, _ in layout.SECTION_TITLES]
    assert got == {(1, k): own.get(k, whole) for k in keys} | {(2, k): "" for k in keys}
    each = docs.select("doc_id", *[layout.section_text(k).alias(k) for k in keys]).collect()
    assert got == {(r.doc_id, k): r[k] for r in each for k in keys}
    found = all_queries()["section_text"](spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert {r.n for r in found.select("n").distinct().collect()} == {len(keys)}
