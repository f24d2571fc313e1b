"""Law retrieval queries. The corpus view is derived from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import law
from pactum.workload.registry import query
from pactum.workload.views import load, oracle, view

V = ("corpus_rows",)


@view("corpus_rows", ("documents",))
def _corpus_rows(d: str) -> str:
    s = "STRING" if d == "spark" else "VARCHAR"
    return f"""SELECT doc_id, CASE WHEN doc_id%7=0 THEN '2024-01' ELSE '2025-11' END AS law_version, CASE doc_id%3 WHEN 0 THEN 'labor_law' WHEN 1 THEN 'implementing_regulations' ELSE 'qiwa_template' END AS source,
 concat(CAST(1+doc_id%90 AS {s}), CASE WHEN doc_id%11=0 THEN ' bis' ELSE '' END) AS article,
 CASE doc_id%4 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '1(a)' ELSE '10' END AS paragraph, text AS text_en, CASE WHEN doc_id%2=0 THEN concat('نص المادة ', CAST(doc_id AS {s})) END AS text_ar FROM @documents@"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "corpus_rows", heavy=True)


_STOP = ",".join(f"'{w}'" for w in law.STOPWORDS)
_TOK = f"""tok AS (SELECT doc_id, [x FOR x IN [CASE WHEN regexp_matches(y,'^[a-z]{{4,}}$') AND regexp_matches(y,'[^s]s$') THEN CASE WHEN y LIKE '%ies' THEN y[:-4] || 'y' ELSE y[:-2] END ELSE y END
 FOR y IN regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF y<>'' AND NOT list_contains([{_STOP}], y)] IF length(x)>1 OR regexp_matches(x,'\\d')] t FROM documents)"""


@query("tokens", f"WITH {_TOK} SELECT doc_id, CAST(len(t) AS INTEGER) AS n, sha256(array_to_string(t,' ')) AS joined FROM tok")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", heavy=True).select("doc_id", law.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("joined"))


_COMMON = ",".join(f"'{w}'" for w in law.COMMON_WORDS)


@query(
    "features",
    f"""WITH {_TOK}, w AS (SELECT doc_id, word, count(*) n FROM (SELECT doc_id, unnest(t) word FROM tok) GROUP BY 1,2)
, f AS (SELECT doc_id, 'w:' || word AS name, n*CASE WHEN list_contains([{_COMMON}],word) THEN 0.25 ELSE 1.0 END AS weight FROM w
 UNION ALL SELECT doc_id, 'c:' || substr('<'||word||'>', i, 3), n*0.4 FROM (SELECT *, unnest(range(1, length(word)+1)) i FROM w WHERE NOT list_contains([{_COMMON}],word)))
, g AS (SELECT doc_id, name, sum(weight) weight FROM f GROUP BY 1,2)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(weight),3) AS DOUBLE) AS total, CAST(round(max(weight),3) AS DOUBLE) AS top FROM g GROUP BY 1""",
)
def features(spark: SparkSession, sf: str) -> DataFrame:
    f = law.features(load(spark, sf, "documents", heavy=True).select("doc_id", "text"), "doc_id")
    return f.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("total"),
        F.round(F.max("weight"), 3).alias("top"),
    )


def _vector_facts(vectors: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select(
        key, F.size("vector").alias("dim"), F.round(norm, 9).alias("norm"),
        F.array_position("vector", F.array_max("vector")).alias("top_bucket"),
    )


@query("hash_embed")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", heavy=True).select("doc_id", "text")
    return _vector_facts(law.hash_embed(docs, "doc_id"), "doc_id")


@query("article_embed")
def article_embed(spark: SparkSession, sf: str) -> DataFrame:
    articles = corpus(spark, sf).withColumn("id", F.col("doc_id"))
    return _vector_facts(law.embed_articles(articles), "id")


@query(
    "vector_topk",
    """WITH u AS (SELECT vec_id, label, i, e/sqrt(sum(e*e) OVER (PARTITION BY vec_id)) e FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) e, unnest(range(1,65)) i FROM embeddings))
, c AS (SELECT label, i, a/sqrt(sum(a*a) OVER (PARTITION BY label)) a FROM (SELECT label, i, avg(e) a FROM u GROUP BY 1,2))
, s AS (SELECT vec_id, c.label AS id, sum(e*a) score FROM u JOIN c USING (i) GROUP BY 1,2)
SELECT vec_id AS query_id, CAST(rank AS INTEGER) AS rank, id, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) rank FROM s WHERE score>0) WHERE rank<=3""",
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), "label",
        law.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"),
    )
    # The corpus searched is one mean vector per label.
    cells = vectors.select("label", F.posexplode("vector").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    corpus_vectors = centres.select(
        F.col("label").alias("id"), F.col("label").alias("corpus_order"),
        law.unit(F.transform("v", lambda c: c["x"])).alias("vector"),
    )
    return law.search(vectors.drop("label"), corpus_vectors, 3).withColumn("score", F.round("score", 6))


@query(
    "vector_topk_all",
    """WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y*y)))) v FROM embeddings)
, s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_inner_product(q.v, c.v) score FROM u q, u c)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) rank FROM s WHERE score>0) WHERE rank<=5""",
)
def vector_topk_all(spark: SparkSession, sf: str) -> DataFrame:
    unit = law.unit(F.transform("embedding", lambda x: x.cast("double")))
    vectors = load(spark, sf, "embeddings").select("vec_id", unit.alias("vector"))
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    corpus_vectors = vectors.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("corpus_order"), "vector")
    return law.search(asked, corpus_vectors, 5).withColumn("score", F.round("score", 6))


_REFS = """SELECT CASE o_orderkey%3 WHEN 0 THEN 'labor_law' WHEN 1 THEN 'implementing_regulations' ELSE 'qiwa_template' END AS source, CAST(1+o_custkey%45 AS {s}) AS article,
 CASE WHEN o_custkey%2=0 THEN '1' WHEN o_custkey%5=0 THEN '10' END AS paragraph FROM {t}"""


@query(
    "law_by_refs",
    oracle(V, f""", refs AS ({_REFS.format(s='VARCHAR', t='orders')}) SELECT doc_id, source, article, paragraph FROM corpus_rows a WHERE EXISTS (SELECT 1 FROM refs r WHERE r.source=a.source AND r.article=a.article
 AND (r.paragraph IS NULL OR a.paragraph IS NULL OR (starts_with(a.paragraph, r.paragraph) AND NOT regexp_matches(substr(a.paragraph, length(r.paragraph)+1), '^[0-9]'))))"""),
)
def law_by_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = spark.sql(_REFS.format(s="STRING", t="{orders}"), orders=load(spark, sf, "orders"))
    return law.by_refs(corpus(spark, sf), refs).select("doc_id", "source", "article", "paragraph")


def _key_sql(c: str) -> str:
    return f"array_to_string([CASE WHEN regexp_matches(x,'^[0-9]') THEN lpad(x,12,'0') ELSE x END FOR x IN regexp_extract_all(coalesce({c},''), '[0-9]+|[^0-9]+')], '')"


_RANK = "CASE source WHEN 'labor_law' THEN 0 WHEN 'implementing_regulations' THEN 1 ELSE 2 END"


@query("law_order", oracle(V, f"SELECT doc_id, CAST({_RANK} AS INTEGER) AS source_rank, {_key_sql('article')} AS article_key, {_key_sql('paragraph')} AS paragraph_key FROM corpus_rows"))
def law_order(spark: SparkSession, sf: str) -> DataFrame:
    rank, article, paragraph = law.corpus_order()
    rows = load(spark, sf, "corpus_rows").select(
        "doc_id", rank.alias("source_rank"), article.alias("article_key"), paragraph.alias("paragraph_key")
    )
    return rows.orderBy("source_rank", "article_key", "paragraph_key", "doc_id")


_CITE = "CASE source WHEN 'labor_law' THEN 'Art. ' || article || CASE WHEN coalesce(paragraph,'')<>'' THEN '(' || paragraph || ')' ELSE '' END WHEN 'implementing_regulations' THEN 'Exec. Reg. Art. ' || article ELSE 'Contract cl. ' || article END"


@query("citation", oracle(V, f"SELECT doc_id, {_CITE} AS citation FROM corpus_rows"))
def citation(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "corpus_rows", heavy=True).select("doc_id", law.citation().alias("citation"))


@query(
    "law_merge_citation",
    oracle(V, f""", m AS (SELECT {_CITE} AS citation, list(text_en ORDER BY doc_id) en, list(text_ar ORDER BY doc_id) FILTER (WHERE text_ar IS NOT NULL) ar, law_version FROM corpus_rows GROUP BY citation, law_version)
SELECT law_version, citation, sha256(list_reduce(en, lambda a, b: CASE WHEN contains(a,b) THEN a ELSE a || chr(10) || b END)) AS en_hash, list_reduce(ar, lambda a, b: CASE WHEN contains(a,b) THEN a ELSE a || chr(10) || b END) AS text_ar FROM m"""),
)
def law_merge_citation(spark: SparkSession, sf: str) -> DataFrame:
    merged = law.merge_by_citation(load(spark, sf, "corpus_rows"), F.col("doc_id"))
    return merged.select("law_version", "citation", F.sha2("text_en", 256).alias("en_hash"), "text_ar")


@query("law_row_id", oracle(V, "SELECT doc_id, 'law_' || regexp_replace(concat_ws('_', law_version, source, article, paragraph), '\\s+', '-', 'g') AS id FROM corpus_rows"))
def law_row_id(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "corpus_rows", heavy=True).select("doc_id", law.row_id().alias("id"))


@query("law_version", oracle(V, "SELECT 'a' AS asked, doc_id FROM corpus_rows WHERE law_version='2024-01' UNION ALL SELECT 'b', doc_id FROM corpus_rows WHERE law_version='2025-11'"))
def law_version(spark: SparkSession, sf: str) -> DataFrame:
    stored = load(spark, sf, "corpus_rows")
    bundled = stored.where("law_version = '2025-11'")
    known = law.of_version(stored, "2024-01", bundled)
    unknown = law.of_version(stored, "1999-01", bundled)
    a = known.select(F.lit("a").alias("asked"), "doc_id")
    return a.unionByName(unknown.select(F.lit("b").alias("asked"), "doc_id"))
