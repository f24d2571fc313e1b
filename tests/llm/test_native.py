"""Operators 1, 5 and 8: against brute force on odd cases, and against their SQL on the smallest tables."""

import collections
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check  # noqa: E402
from pactum.llm import mixing, quality_rules, url_filter  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_url_filter", "op4_warc", "op8_mixing"])
def test_against_sql(spark, name):
    ok, note = check.compare(spark, check.connect(SF), name, SF)
    assert ok, note


def test_url_rules(spark):
    urls = [
        ("http://A.Example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/1#t", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://example.com/fr", "example.com", "/fr", "com/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/fr/x", "a.net", "/fr/x", "net/fr/", "block"),
        ("http://example.com", "example.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
        ("", "", "", None, None), ("http://a.net/fr/x", "a.net", "/fr/x", "net/fr/", "block"), ("x://://y/z", ":", "//y/z", None, None),
    ]
    pages = spark.createDataFrame([(k, u[0], 1.0) for k, u in enumerate(urls)], "page_id long, url string, score double")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_learns(spark):
    rows = [(k, f"http://site{k}.com/good/{k}", None) for k in range(60)] + [(100 + k, f"http://s{k}.net/es/casino-{k}", None) for k in range(60)]
    rows += [(300, "http://other.org/good/1", None), (301, "http://other.org/es/casino-1", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()}
    assert got[300].score > got[301].score
    assert (got[300].verdict, got[301].verdict) == ("allow", "block")


def _base(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if seen[tuple(words[k : k + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_quality_statistics(spark, odd_docs, labels):
    extra = spark.createDataFrame(
        [(50, "a b c a b c a b c x # | < b c x"), (51, "x\n x\nx\n\nx \n#\n#"), (52, "a a a a"), (53, "a b c"), (54, "😀 b 😀 b 😀 b 😀"), (55, "a\x85b\x1cc d")],
        "doc_id long, text string",
    )
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    got = collections.Counter(tuple(r[:6]) for r in quality_rules.judge(docs, labels).collect())
    want = collections.Counter((r.doc_id, *_base(r.text)) for r in docs.collect())
    assert got == want
    assert all(not r.kept for r in quality_rules.judge(docs, labels).filter("n_words < 50").collect())
    assert quality_rules.judge(odd_docs.limit(0), labels).count() == 0
    assert quality_rules.judge(odd_docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_quality_rules_are_learned(spark, words):
    rows, marks = [], []
    for k in range(240):
        text = words(k, 80)
        bad = k % 3 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split()) if k % 2 else text.upper().replace(" ", "!! ")
        rows.append((k, text))
        marks.append((k, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality_rules.judge(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    wrong = out.filter("base_failed OR kept <> (doc_id % 3 <> 0)").count()
    assert wrong == 0


def _targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted((x for x in sizes if x is not None)) + [None] * (None in sizes))}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


def test_mixing(spark, odd_docs, no_docs):
    many = spark.createDataFrame(
        [(1000 + k, "w " * (k % 40), s) for k in range(3000) for s in [None if k % 17 == 0 else f"s{k % 9 if k % 3 else 0}"]],
        "doc_id long, text string, source string",
    )
    for docs in (odd_docs, many):
        rows = docs.select("doc_id", "text", "source").collect()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        want = _targets(dict(sizes))
        got = mixing.report(docs).collect()
        assert len(got) == len(rows)
        by_size = {v: want[k] for k, v in sizes.items()}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(by_size[r.source_size])
        assert sorted(map(str, got)) == sorted(map(str, mixing.report(docs.repartition(5)).collect()))
    taken = collections.Counter()
    for r in mixing.report(many).collect():
        taken[r.source_size] += r.taken
    assert all(abs(taken[v] - want[k]) < 0.12 * want[k] + 200 for k, v in sizes.items())
    mixed = mixing.mix(odd_docs)
    assert mixed.schema == odd_docs.schema
    copies = {str(r.doc_id): r.n for r in mixing.copies(odd_docs).groupBy("doc.doc_id").agg(F.sum("mix.copies").alias("n")).collect()}
    assert {str(r.doc_id): r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: n for k, n in copies.items() if n}
    assert mixing.report(no_docs).count() == 0
