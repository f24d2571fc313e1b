"""Three-source wage reconciliation.

The sources are stacked and collapsed by employee with one aggregation, so there is one
shuffle, repeated ids are combined before it, and no join can multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.numbers import round_half_up, thousands

# Compared fields, the articles a shortfall touches, source names, messages.
FIELDS = ("basic", "housing", "transport", "total")
ARTICLES = {
    "basic": ["61", "84", "77"],
    "housing": ["61"],
    "transport": ["61"],
    "total": ["61"],
}
SOURCE_NAMES = {
    "contract": "the Qiwa contracts",
    "offer": "the offer letters",
    "payroll": "payroll",
}
EPSILON = 0.005
MSG_DUPLICATE = "Listed more than once in %s. Check which row is right."
MSG_PAID_NO_CONTRACT = "Paid through payroll, but there is no Qiwa contract for this ID."
MSG_OFFER_NO_CONTRACT = "Has an offer letter, but there is no Qiwa contract for this ID."
MSG_NOT_PAID = "Has a Qiwa contract but is missing from this month's payroll."

ISSUE_TYPE = (
    "struct<kind:string,field:string,expected:double,actual:double,gap:double,"
    "articles:array<string>,message:string>"
)


def as_paid(records: DataFrame) -> DataFrame:
    """A payroll row as paid: missing amounts are 0, a missing total is the sum of the parts."""
    zero = F.lit(0.0)
    parts = {c: F.coalesce(F.col(c).cast("double"), zero) for c in FIELDS[:3]}
    total = F.coalesce(
        F.col("total").cast("double"),
        round_half_up(parts["basic"] + parts["housing"] + parts["transport"]),
    )
    return records.withColumns({**parts, "total": total})


def _tagged(records: DataFrame, source: str) -> DataFrame:
    row_no = F.col("row_no") if "row_no" in records.columns else F.lit(0)
    return records.select(
        F.col("employee_id"),
        F.lit(source).alias("source"),
        row_no.cast("bigint").alias("row_no"),
        F.struct("name", *[F.col(f).cast("double").alias(f) for f in FIELDS]).alias("rec"),
    )


def combine_sources(
    contracts: DataFrame, offers: DataFrame, payroll: DataFrame | None = None
) -> DataFrame:
    """One row per employee: the last record and the row count of each source."""
    stacked = _tagged(contracts, "contract").unionByName(_tagged(offers, "offer"))
    if payroll is not None:
        stacked = stacked.unionByName(_tagged(payroll, "payroll"))
    aggs = []
    for source in SOURCE_NAMES:
        here = F.col("source") == source
        # Ordered by input position first: the last listed row speaks for the source.
        aggs.append(
            F.max(F.when(here, F.struct("row_no", "rec")))["rec"].alias(source)
        )
        aggs.append(F.count_if(here).alias(f"{source}_n"))
    return stacked.groupBy("employee_id").agg(*aggs)


def _issue(
    kind: Column,
    message: Column,
    articles: Column | None = None,
    field: Column | None = None,
    expected: Column | None = None,
    actual: Column | None = None,
    gap: Column | None = None,
) -> Column:
    null = F.lit(None)
    empty = F.array().cast("array<string>")
    return F.struct(
        kind.alias("kind"),
        (field if field is not None else null.cast("string")).alias("field"),
        (expected if expected is not None else null.cast("double")).alias("expected"),
        (actual if actual is not None else null.cast("double")).alias("actual"),
        (gap if gap is not None else null.cast("double")).alias("gap"),
        (articles if articles is not None else empty).alias("articles"),
        message.alias("message"),
    )


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _field_issues(other: str) -> list[Column]:
    """One nullable issue per compared field of a source against the contract."""
    usable = (
        F.col("contract").isNotNull()
        & F.col(other).isNotNull()
        & (F.col("contract_n") == 1)
        & (F.col(f"{other}_n") == 1)
    )
    issues = []
    for field in FIELDS:
        expected, actual = F.col(f"contract.{field}"), F.col(f"{other}.{field}")
        gap = round_half_up(actual - expected)
        differs = usable & (F.abs(gap) >= EPSILON)
        if other == "payroll" and field not in ("basic", "housing"):
            differs = differs & (gap < 0)
        side = F.when(gap < 0, " SAR less ").otherwise(" SAR more ")
        diff = F.concat(thousands(F.abs(gap)), side, F.lit(field))
        if other == "offer":
            kind, articles = "offer_differs", F.array().cast("array<string>")
            message = F.concat(F.lit("Offer letter: "), diff, F.lit(" than Qiwa."))
        elif field == "total":
            kind, articles = "underpaid", _strings(["61"])
            message = F.concat(F.lit("Underpaid "), thousands(-gap), F.lit(" SAR this month."))
        else:
            kind = "payroll_differs"
            articles = F.when(gap < 0, _strings(ARTICLES[field])).otherwise(
                F.array().cast("array<string>")
            )
            message = F.concat(F.lit("Payroll: "), diff, F.lit(" than Qiwa."))
        issues.append(
            F.when(
                differs,
                _issue(F.lit(kind), message, articles, F.lit(field), expected, actual, gap),
            )
        )
    return issues


def check_wages(
    contracts: DataFrame, offers: DataFrame, payroll: DataFrame | None = None
) -> DataFrame:
    """One row per employee with the list of issues, in the order they are reported.

    Inputs hold ``employee_id, name, basic, housing, transport, total`` and, when the last
    listed row of a repeated id should give the name, ``row_no``.
    """
    combined = combine_sources(contracts, offers, payroll)
    missing, paid = F.col("contract").isNull(), F.col("payroll").isNotNull()
    issues = [
        F.when(
            F.col(f"{source}_n") > 1,
            _issue(F.lit("duplicate"), F.lit(MSG_DUPLICATE % label)),
        )
        for source, label in SOURCE_NAMES.items()
    ]
    issues += _field_issues("payroll") + _field_issues("offer")
    issues.append(
        F.when(
            missing,
            _issue(
                F.lit("no_contract"),
                F.when(paid, MSG_PAID_NO_CONTRACT).otherwise(MSG_OFFER_NO_CONTRACT),
                _strings(["37"]),
            ),
        )
    )
    if payroll is not None:
        issues.append(
            F.when(
                ~missing & ~paid,
                _issue(F.lit("not_paid"), F.lit(MSG_NOT_PAID), _strings(["61"]), F.lit("total")),
            )
        )
    name = F.coalesce("payroll.name", "contract.name", "offer.name")
    return combined.select(
        "employee_id",
        name.alias("name"),
        F.array_compact(F.array(*issues)).cast(f"array<{ISSUE_TYPE}>").alias("issues"),
    )


def issue_rows(checked: DataFrame) -> DataFrame:
    """One row per issue, numbered within the employee."""
    return checked.select(
        "employee_id", "name", F.posexplode("issues").alias("issue_no", "issue")
    ).select("employee_id", "name", "issue_no", "issue.*")


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("employees"),
        F.count_if(F.size("issues") > 0).alias("flagged"),
    )


def flagged_first(checked: DataFrame) -> DataFrame:
    """Total order for a listing: flagged employees first, then by id."""
    return checked.orderBy((F.size("issues") > 0).desc(), "employee_id")


def wage_from_contract(fields: DataFrame) -> DataFrame:
    """A wage record from contract fields: other allowances count as transport."""
    return fields.where("basic IS NOT NULL AND employee_id IS NOT NULL").select(
        "employee_id",
        F.lit(None).cast("string").alias("name"),
        F.col("basic").cast("double").alias("basic"),
        F.col("housing").cast("double").alias("housing"),
        (F.col("transport") + F.col("other")).cast("double").alias("transport"),
        F.col("total").cast("double").alias("total"),
    )


def offers_from_form(forms: DataFrame) -> DataFrame:
    """Offer rows from typed amounts (text, commas allowed); forms left blank give none."""
    amounts = {
        f: F.nullif(F.regexp_replace(f"offer_{f}", r"[,\s]", ""), F.lit("")).try_cast("double")
        for f in FIELDS
    }
    rows = forms.select("employee_id", "name", *[c.alias(f) for f, c in amounts.items()])
    return rows.where(F.coalesce(*[F.col(f) for f in FIELDS]).isNotNull())
