"""URL filter: host and path rules, then a ratio of two character language models.

A rule is ``host/path`` with a verdict. It fits its host and all subdomains if the URL's path starts
with the rule's path; the longest fitting rule decides. Every other URL is judged by two smoothed
Markov models of variable order, one counted on accepted and one on rejected URLs (those that rules
decide): the difference of the log-likelihoods, divided by the URL's length, against a threshold
calibrated on a fifth of the labelled URLs that the counts do not use.

Symbols: letters in lower case, one symbol for all digits, ``/ . -``, one for anything else and one for
what stands before the URL: 32 in all, so that the model has at most 32**4 + 32**3 + 32**2 + 32 rows,
however many URLs are counted. That bound is why it may be broadcast. A gram of order k counts if it
was seen often enough, else the next shorter one decides (down to the single symbol). Smoothing is
interpolation with the next shorter context. Differences are kept as whole millionths, so that sums do
not depend on the order of rows.

Defined cases: a URL that is null or has no ``://`` has an empty host and path and fits no rule; a null
or empty URL scores 0; equal URLs are scored once and share the result, rows are returned as often as
given; without labelled URLs every difference is 0 and the threshold 0, so the verdict is ``allow``. Only
page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import written

#: (rule, verdict)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Longest gram, weight of the shorter context in smoothing, least count of a gram of two or more symbols.
ORDER, SMOOTHING, LEAST_SEEN = 4, 4.0, 3
SYMBOLS = 32
BEFORE = "^"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, as ordered conditional expressions.

    ``rules`` is a parameter of the operator, a list a person wrote, not data that grows.
    """
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, below = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + below))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def symbols(url: Column) -> Column:
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER + DIGITS, LOWER + "0" * 10)
    return F.regexp_replace(plain, r"[^a-z0/.\-]", "*")


def grams(urls: DataFrame, *keys: str) -> DataFrame:
    """One row for each symbol of a URL, with the gram of ORDER symbols that ends in it."""
    text = symbols(F.col("url"))
    places = urls.select(*keys, F.concat(F.lit(BEFORE * (ORDER - 1)), text).alias("padded")).filter(
        F.length("padded") >= ORDER
    )
    at = places.select(*keys, "padded", F.explode(F.sequence(F.lit(1), F.length("padded") - (ORDER - 1))).alias("at"))
    return at.select(*keys, F.substr("padded", F.col("at"), F.lit(ORDER)).alias("gram"))


def model(labelled: DataFrame) -> DataFrame:
    """(gram, difference): grams of 1 to ORDER symbols; labelled has (url, accepted, n).

    Counts are taken on the longest grams in one pass with partial sums; everything else is derived
    from that bounded table.
    """
    counted = written(
        grams(labelled, "accepted", "n").groupBy("gram").agg(
            F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"),
            F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no"),
        ),
        "url-grams",
    )
    shorter, parts = None, []
    for k in range(1, ORDER + 1):
        own = counted.groupBy(F.substr("gram", F.lit(ORDER - k + 1), F.lit(k)).alias("gram")).agg(
            F.sum("yes").alias("yes"), F.sum("no").alias("no")
        )
        context = own.groupBy(F.substr("gram", F.lit(1), F.lit(k - 1)).alias("context")).agg(
            F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no")
        )
        own = own.join(context, F.substr("gram", F.lit(1), F.lit(k - 1)) == F.col("context"))
        if shorter is None:
            own = own.withColumns({"low_yes": F.lit(1.0 / SYMBOLS), "low_no": F.lit(1.0 / SYMBOLS)})
        else:
            low = shorter.select(
                F.col("gram").alias("low_gram"), F.col("p_yes").alias("low_yes"), F.col("p_no").alias("low_no")
            )
            own = own.join(low, F.substr("gram", F.lit(2), F.lit(k - 1)) == F.col("low_gram"))
        p = {
            f"p_{s}": (F.col(s) + SMOOTHING * F.col(f"low_{s}")) / (F.col(f"all_{s}") + SMOOTHING)
            for s in ("yes", "no")
        }
        shorter = written(own.withColumns(p).select("gram", "yes", "no", "p_yes", "p_no"), f"url-model-{k}")
        parts.append(
            shorter.filter((F.col("yes") + F.col("no") >= LEAST_SEEN) | F.lit(k == 1)).select(
                "gram", F.round((F.log("p_yes") - F.log("p_no")) * 1e6).cast("long").alias("difference")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scores(urls: DataFrame, differences: DataFrame) -> DataFrame:
    """(url, score) of distinct URLs: mean difference per symbol, in nats.

    Map-side but for one shuffle of partial sums: the model, bounded by the alphabet, is broadcast.
    """
    found = grams(urls, "url")
    best = []
    for k in range(ORDER, 0, -1):
        part = differences.filter(F.length("gram") == k).select(
            F.col("gram").alias(f"gram_{k}"), F.col("difference").alias(f"difference_{k}")
        )
        found = found.join(
            F.broadcast(part), F.substr("gram", F.lit(ORDER - k + 1), F.lit(k)) == F.col(f"gram_{k}"), "left"
        )
        best.append(F.col(f"difference_{k}"))
    total = found.groupBy("url").agg(F.sum(F.coalesce(*best, F.lit(0))).alias("total"), F.count("*").alias("symbols"))
    return total.select("url", (F.col("total") / F.col("symbols") / 1e6).alias("score"))


def _held_out(url: Column) -> Column:
    return F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % 5 == 0


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the least score to allow, which decides most labelled URLs rightly.

    scored has (score, accepted, n). Scores are counted in thousandths, which the alphabet and the
    smoothing bound to some ten thousand values. A threshold lies half-way between two scores that occur;
    on a tie the one next to 0 is taken.
    """
    bins = scored.groupBy(F.round(F.col("score") * 1000).cast("long").alias("bin")).agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no"),
    )
    right = F.sum("yes").over(Window.orderBy(F.col("bin").desc())) + F.sum("no").over(Window.orderBy("bin")) - F.col("no")
    lower = F.lag("bin").over(Window.orderBy("bin"))
    cut = F.ceil((F.col("bin") + F.coalesce(lower, F.col("bin"))) / 2).cast("long")
    return bins.select(right.alias("right"), cut.alias("cut")).agg(
        F.coalesce(F.min_by("cut", F.struct(-F.col("right"), F.abs("cut"), "cut")), F.lit(0).cast("long")).alias("threshold")
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each row of pages."""
    pages = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = pages.filter(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("n"))
    ruled = (
        urls.withColumns({"host": host, "path": path})
        .withColumn("accepted", said == "allow")
        .withColumn("held_out", _held_out(F.col("url")))
        .select("url", "n", "accepted", "held_out")
    )
    ruled = written(ruled, "url-distinct")
    labelled = ruled.filter(F.col("accepted").isNotNull())
    differences = written(model(labelled.filter(~F.col("held_out"))), "url-model")
    scored = written(scores(ruled, differences), "url-scores")
    limit = threshold(
        labelled.filter("held_out").join(scored, "url").select("score", "accepted", "n")
    ).scalar()
    score = F.coalesce(F.col("score"), F.lit(0.0))
    own = F.when(F.round(score * 1000).cast("long") >= limit, "allow").otherwise("block")
    return (
        pages.join(scored.withColumnRenamed("url", "scored_url"), F.col("url") == F.col("scored_url"), "left")
        .withColumns({"host": host, "path": path})
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"),
                F.round(score, 4).alias("score"))
    )


_FITS = "(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{below}')"


def _cases(pick: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    return "CASE " + " ".join(
        f"WHEN {_FITS.format(own=r[0].partition('/')[0], below=r[0].partition('/')[2])} THEN '{r[pick]}'" for r in ordered
    ) + " END"


def _model_sql() -> str:
    parts = []
    for k in range(1, ORDER + 1):
        low = "" if k == 1 else f" JOIN p{k - 1} l ON l.gram = substr(o.gram, 2)"
        ly, ln = ("1.0::DOUBLE / 32", "1.0::DOUBLE / 32") if k == 1 else ("l.py", "l.pn")
        parts.append(
            f"""o{k} AS (SELECT substr(gram, {ORDER - k + 1}) AS gram, sum(yes)::BIGINT AS yes, sum(no)::BIGINT AS no FROM counted GROUP BY 1),
c{k} AS (SELECT substr(gram, 1, {k - 1}) AS context, sum(yes)::BIGINT AS ay, sum(no)::BIGINT AS an FROM o{k} GROUP BY 1),
p{k} AS (SELECT o.gram, o.yes, o.no, (o.yes + 4.0::DOUBLE * {ly}) / (c.ay + 4.0::DOUBLE) AS py,
  (o.no + 4.0::DOUBLE * {ln}) / (c.an + 4.0::DOUBLE) AS pn
  FROM o{k} o JOIN c{k} c ON c.context = substr(o.gram, 1, {k - 1}){low}),
d{k} AS (SELECT gram, round((ln(py) - ln(pn)) * 1000000.0::DOUBLE)::BIGINT AS d FROM p{k}
  WHERE {'true' if k == 1 else f'yes + no >= {LEAST_SEEN}'})"""
        )
    return ",\n".join(parts)


def _gram_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, substr(padded, place, 4) AS gram FROM (
  SELECT {keys}, padded, unnest(generate_series(1, length(padded) - 3)) AS place FROM (
    SELECT {keys}, '^^^' || regexp_replace(translate(url, '{UPPER}{DIGITS}', '{LOWER}0000000000'), '[^a-z0/.\\-]', '*', 'g') AS padded
    FROM {source}) WHERE length(padded) >= 4)"""


SQL = f"""
WITH split AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
ruled AS (SELECT *, {_cases(0)} AS rule, {_cases(1)} AS said FROM parsed),
urls AS (
  SELECT url, count(*) AS n, any_value(said) = 'allow' AS accepted,
    ('0x' || substr(md5(url), 1, 8))::BIGINT % 5 = 0 AS held_out FROM ruled WHERE url IS NOT NULL GROUP BY url),
training AS (SELECT * FROM urls WHERE accepted IS NOT NULL AND NOT held_out),
counted AS (
  SELECT gram, sum(CASE WHEN accepted THEN n ELSE 0 END)::BIGINT AS yes, sum(CASE WHEN accepted THEN 0 ELSE n END)::BIGINT AS no
  FROM ({_gram_sql('training', 'accepted, n')}) GROUP BY gram),
{_model_sql()},
scores AS (
  SELECT url, sum(coalesce(d4.d, d3.d, d2.d, d1.d, 0))::BIGINT::DOUBLE / count(*) / 1000000.0::DOUBLE AS score
  FROM ({_gram_sql('urls', 'url')}) g
  LEFT JOIN d4 ON d4.gram = g.gram LEFT JOIN d3 ON d3.gram = substr(g.gram, 2)
  LEFT JOIN d2 ON d2.gram = substr(g.gram, 3) LEFT JOIN d1 ON d1.gram = substr(g.gram, 4) GROUP BY url),
bins AS (
  SELECT round(score * 1000)::BIGINT AS bin, sum(CASE WHEN accepted THEN n ELSE 0 END) AS yes,
    sum(CASE WHEN accepted THEN 0 ELSE n END) AS no
  FROM urls JOIN scores USING (url) WHERE accepted IS NOT NULL AND held_out GROUP BY 1),
cuts AS (SELECT ceil((bin + coalesce(lag(bin) OVER (ORDER BY bin), bin)) / 2.0::DOUBLE)::BIGINT AS bin, sum(yes) OVER (ORDER BY bin DESC) + sum(no) OVER (ORDER BY bin) - no AS correct
  FROM bins),
cut AS (SELECT coalesce((SELECT bin FROM cuts ORDER BY correct DESC, abs(bin), bin LIMIT 1), 0) AS bin)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN round(coalesce(score, 0) * 1000)::BIGINT >= (SELECT bin FROM cut) THEN 'allow' ELSE 'block' END) AS verdict,
  round(coalesce(score, 0.0::DOUBLE), 4) AS score
FROM ruled LEFT JOIN scores USING (url)
"""
