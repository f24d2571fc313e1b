"""Contract fields, labels, clauses and names read from documents (one row per document)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.quantities import let
from pactum.functions.text import (
    arabic_phrase,
    clause_hash,
    clean_english,
    collapse,
    has_letters,
    is_arabic,
    ocr_digits,
)
from pactum.operators.layout import section, section_lines, section_text

# Fixed values.
REQUIRED_FIELDS = ("contract_type", "commencement_date", "probation_days", "annual_leave_days", "wage")
BLOCKING_FIELDS = (*REQUIRED_FIELDS, "weekly_hours", "section15.missing", "section15.text_en")
ISSUE_TYPE = "struct<field:string,message:string>"
WRAP_STEP_PT, LABEL_INDENT_PT = 18, 12
WAGE_TOLERANCE_SAR = 1
REGION_PAD_PT = 2
FOOTER_BAND_PT = 60
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
EXCLUDED_DAYS = (
    (r"(?i)eid al[\s-]*fitr", "eid_al_fitr"),
    (r"(?i)eid al[\s-]*adha", "eid_al_adha"),
    (r"(?i)national day", "national_day"),
    (r"(?i)foundation day", "foundation_day"),
    (r"(?i)sick leave", "sick_leave"),
)
CLAUSE_MARKER = r"^15\s*\.\s*(\d{1,2}(?:\.\d{1,2})*)\.?(?:\s+(.*))?$"
ARABIC_CLAUSE_MARKER = r"(?:^|\s)(?:15\s*\.\s*(\d{1,2})|(\d{1,2})\s*\.\s*15)$"
FULL_MARKER = r"^\s*15\s*[.,]\s*(\d{1,2})(?!\d)[\s.:)-]*(.*)$"
MIRRORED_MARKER = r"^\s*(\d{1,2})\s*[.,]\s*15(?!\d)[\s.:)-]*(.*)$"
BARE_MARKER = r"^\s*(\d{1,2})(?!\d)\s*[.:)-]?\s+(.*)$"
BY_PHRASE = arabic_phrase("بواسطة")


def issue(when: Column, field: str, message: Column) -> Column:
    return F.when(
        when, F.struct(F.lit(field).alias("field"), message.alias("message"))
    ).cast(ISSUE_TYPE)


def required_issues() -> Column:
    """Missing required fields, as an array of issues."""
    found = []
    for name in REQUIRED_FIELDS:
        missing = F.col(name).isNull()
        if name == "contract_type":
            missing = missing | (F.col(name) == "unknown")
        found.append(issue(missing, name, F.lit(f"Required field {name} was not found.")))
    hours = F.col("daily_hours").isNull() & F.col("weekly_hours").isNull()
    found.append(
        issue(hours, "weekly_hours", F.lit("Neither daily nor weekly working hours were found."))
    )
    return F.array_compact(F.array(*found))


def blocks(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["field"].isin(*BLOCKING_FIELDS))


# --- labels --------------------------------------------------------------------------------


def _first(line: Column) -> Column:
    return F.try_element_at(line["en"], F.lit(1))


def _ends_label(text: Column) -> Column:
    return F.coalesce(F.trim(text).endswith(":"), F.lit(False))


def _wraps(previous: Column, following: Column) -> Column:
    step = following["row_y"] - previous["row_y"]
    return F.coalesce(
        (following["page"] == previous["page"]) & (step > 0) & (step <= WRAP_STEP_PT), F.lit(False)
    )


def _join_lines(lines: Column) -> Column:
    """Lines of a wrapped value; an all-Arabic value (visual order) is joined last line first."""
    texts = F.filter(
        F.transform(lines, lambda cells: collapse(F.array_join(F.transform(cells, lambda c: c["text"]), " "))),
        lambda t: t != "",
    )
    return let(
        texts,
        lambda ts: F.array_join(F.when(F.forall(ts, is_arabic), F.reverse(ts)).otherwise(ts), " "),
    )


def label_values() -> Column:
    """``array<struct<label, value, value_ar, page, line_no>>`` of a document."""
    return let(
        F.col("lines"), lambda lines: let(_wrap_flags(lines), lambda wraps: _labels(lines, wraps))
    )


def _labels(lines: Column, wraps: Column) -> Column:
    def at(i: Column) -> Column:
        return F.try_element_at(lines, i + 1)

    def joined(i: Column) -> Column:
        line, following = at(i), at(i + 1)
        near = F.abs(_first(following)["x_min"] - _first(line)["x_min"]) < 2
        return F.coalesce(
            ~_ends_label(_first(line)["text"]) & _wraps(line, following) & near
            & _ends_label(_first(following)["text"]),
            F.lit(False),
        )

    def candidate(line: Column, i: Column) -> Column:
        wrapped = joined(i)
        skipped = (i > 0) & F.when(i > 0, joined(i - 1)).otherwise(False)
        is_label = ~skipped & (wrapped | _ends_label(_first(line)["text"]))
        text = F.when(
            wrapped, F.concat(_first(line)["text"], F.lit(" "), _first(at(i + 1))["text"])
        ).otherwise(_first(line)["text"])
        return F.when(
            is_label,
            F.struct(i.alias("i"), F.when(wrapped, i + 1).otherwise(i).alias("last"), text.alias("label")),
        )

    starts = F.array_compact(F.transform(lines, candidate))

    def value(start: Column) -> Column:
        line, i, last = at(start["i"]), start["i"], start["last"]
        left = _first(line)["x_min"]
        # Lines that follow without a break, up to the first that starts at the label's edge.
        following = F.slice(wraps, last + 2, F.size(lines))
        stop = F.array_position(following, F.lit(False)).cast("int")
        run = F.slice(lines, last + 2, F.when(stop == 0, F.size(following)).otherwise(stop - 1))
        own = F.transform(
            run, lambda x: F.coalesce(_first(x)["x_min"] < left + LABEL_INDENT_PT, F.lit(False))
        )
        at_edge = F.array_position(own, F.lit(True)).cast("int")
        more = F.slice(run, F.lit(1), F.when(at_edge == 0, F.size(run)).otherwise(at_edge - 1))
        head = F.transform(
            F.slice(lines, i + 1, last - i + 1), lambda x: F.slice(x["en"], F.lit(2), F.greatest(F.size(x["en"]), F.lit(1)))
        )
        rightmost = F.get(line["ar"], F.size(line["ar"]) - 1)
        ar_label = F.when(
            (F.size(line["ar"]) > 0) & ((F.size(line["ar"]) >= 2) | rightmost["text"].contains(":")), rightmost
        )

        def ar_values(x: Column) -> Column:
            return F.filter(
                x["ar"],
                lambda s: ~s["text"].contains(":")
                & ~F.coalesce(F.abs(s["x_max"] - ar_label["x_max"]) < 2, F.lit(False)),
            )

        en_lines = F.concat(head, F.transform(more, lambda x: x["en"]))
        ar_lines = F.transform(F.concat(F.slice(lines, i + 1, last - i + 1), more), ar_values)
        label = clean_english(start["label"])
        label = F.regexp_replace(label, r"^\d+(\.\d+)*\.?\s+", "")
        return F.struct(
            F.lower(F.regexp_replace(label, r"\s*:\s*$", "")).alias("label"),
            _join_lines(en_lines).alias("value"),
            _join_lines(ar_lines).alias("value_ar"),
            line["page"].alias("page"),
            i.alias("line_no"),
        )

    return F.transform(starts, value)


def _wrap_flags(lines: Column) -> Column:
    """Whether each line continues the one before it."""
    return F.transform(
        lines, lambda x, i: F.when(i > 0, _wraps(F.get(lines, i - 1), x)).otherwise(F.lit(False))
    )


def _within(key: str) -> Column:
    return let(
        section(key),
        lambda s: F.filter("labels", lambda v: (v["line_no"] > s["start"]) & (v["line_no"] < s["end"])),
    )


def find_label(pattern: str, key: str | None = None) -> Column:
    """First labelled value, the given section preferred."""
    anywhere = F.try_element_at(F.filter("labels", lambda v: v["label"].rlike(pattern)), F.lit(1))
    if key is None:
        return anywhere
    here = F.try_element_at(F.filter(_within(key), lambda v: v["label"].rlike(pattern)), F.lit(1))
    return F.coalesce(here, anywhere)


# --- parsers -------------------------------------------------------------------------------


def parse_date(text: Column) -> Column:
    """``2025/11/15`` or ``15/11/2025``; null when no such day exists."""
    ymd, dmy = r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    part = lambda p, g: F.regexp_extract(text, p, g)
    day = F.when(
        text.rlike(ymd), F.concat_ws("-", part(ymd, 1), part(ymd, 2), part(ymd, 3))
    ).when(text.rlike(dmy), F.concat_ws("-", part(dmy, 3), part(dmy, 2), part(dmy, 1)))
    return F.try_to_date(day, "yyyy-M-d")


MONEY = r"(\d[\d,]*(?:\.\d+)?)\s*([A-Za-z]+)?"


def parse_money(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, MONEY, 1), ",", "").try_cast("double")


def money_period(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, MONEY, 2)), F.lit(""))


def map_contract_type(raw: Column) -> Column:
    return (
        F.when(raw.rlike(r"(?i)fixed[\s-]*(term|period|duration)"), "fixed_term")
        .when(raw.rlike(r"(?i)indefinite|unlimited|open[\s-]*ended|unspecified (term|period|duration)"), "indefinite")
        .when(raw.rlike(r"(?i)specific (work|task|project)|for a project"), "specific_work")
        .otherwise("unknown")
    )


def parse_term_months(text: Column) -> Column:
    pattern = r"(?i)valid for a period of\s*\(?\s*(\d+|[a-z]+)\s*\)?\s*(year|month)s?\b"
    token = F.lower(F.regexp_extract(text, pattern, 1))
    words = F.expr("map(" + ", ".join(f"'{w}', {i + 1}" for i, w in enumerate(NUMBER_WORDS)) + ")")
    count = F.coalesce(token.try_cast("int"), F.try_element_at(words, token))
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    return F.when(count > 0, F.when(unit == "year", count * 12).otherwise(count)).cast("int")


def parse_excluded_days(text: Column) -> Column:
    pattern = r"(?i)do not count towards (?:this|the probationary) period\s*:?([^.]*)\."
    items = F.filter(
        F.transform(F.split(F.regexp_extract(text, pattern, 1), r",|\band\b"), lambda s: F.trim(s)),
        lambda s: s != "",
    )

    def name(item: Column) -> Column:
        out = F.lit("other")
        for day_pattern, day in reversed(EXCLUDED_DAYS):
            out = F.when(item.rlike(day_pattern), day).otherwise(out)
        return out

    return F.transform(items, name)


def number_in(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


# --- fields --------------------------------------------------------------------------------


def extract_fields(docs: DataFrame) -> DataFrame:
    """Fields of every document with their issues, clauses and names. Map-only."""
    d = docs.withColumn("labels", label_values())
    texts = {k: section_text(k) for k in ("period", "probation", "hours", "leave", "first_obligations")}
    d = d.withColumns({f"t_{k}": v for k, v in texts.items()})
    t = lambda k: F.col(f"t_{k}")
    found = {
        "type": find_label("^contract type$", "contract_info"),
        "executed": find_label("^contract execution date$", "contract_info"),
        "commenced": find_label("^commencement date$", "contract_info"),
        "started": find_label("^starting date$", "contract_info"),
        "ended": find_label("^contract end date$", "contract_info"),
        "nationality": find_label("^nationality$", "second_party"),
        "occupation": find_label("^occupation$", "profession"),
        "location": find_label("^work location$", "profession"),
        "basic": find_label("^basic wage$", "wage"),
        "housing": find_label("^housing allowance$", "wage"),
        "transport": find_label("^transportation allowance$", "wage"),
        "total": find_label("^total wage$", "wage"),
    }
    d = d.withColumns({f"f_{k}": v for k, v in found.items()})
    value = lambda k: F.nullif(F.col(f"f_{k}.value"), F.lit(""))
    raw_type = value("type")
    others = F.filter(
        _within("wage"),
        lambda v: v["label"].rlike("allowances?$") & ~v["label"].rlike("^(housing|transportation) allowance$"),
    )
    other = F.aggregate(
        others, F.lit(0.0), lambda a, v: a + F.coalesce(parse_money(v["value"]), F.lit(0.0))
    )
    basic, total = parse_money(value("basic")), parse_money(value("total"))
    zero = F.lit(0.0)
    wage = F.when(
        basic.isNotNull() & total.isNotNull(),
        F.struct(
            basic.alias("basic"),
            F.coalesce(parse_money(value("housing")), zero).alias("housing"),
            F.coalesce(parse_money(value("transport")), zero).alias("transport"),
            F.coalesce(other, zero).alias("other"),
            total.alias("total"),
        ),
    )
    renews = F.when(
        t("period").rlike("(?i)automatically renewed"),
        ~t("period").rlike("(?i)not be automatically renewed"),
    ).when(t("period").rlike("(?i)shall not be renewed|non-renewable"), False)
    probation = F.coalesce(
        number_in(t("probation"), r"(?i)probationary period of\s*\(?\s*(\d+)\s*\)?\s*days"),
        F.when(t("probation").rlike("(?i)not subject to (a|any) probationary period"), 0.0),
    ).cast("int")
    days = number_in(t("hours"), r"(?i)working days shall be\s*\(?\s*(\d+(?:\.\d+)?)\s*\)?\s*days")
    daily = number_in(t("hours"), r"(?i)working hours shall be daily\s*\(?\s*(\d+(?:\.\d+)?)")
    weekly = number_in(t("hours"), r"(?i)working hours shall be weekly\s*\(?\s*(\d+(?:\.\d+)?)")
    nationality = value("nationality")
    fields = {
        "contract_type": map_contract_type(raw_type),
        "contract_type_raw": raw_type,
        "execution_date": parse_date(value("executed")),
        "commencement_date": F.coalesce(parse_date(value("commenced")), parse_date(value("started"))),
        "end_date": parse_date(value("ended")),
        "term_months": parse_term_months(t("period")),
        "auto_renew": renews,
        "renewal_notice_days": number_in(t("period"), r"(?i)at least\s*\(?\s*(\d+)\s*\)?\s*days before").cast("int"),
        "probation_days": probation,
        "probation_excluded_days": parse_excluded_days(t("probation")),
        "work_days_per_week": days,
        "daily_hours": daily,
        "weekly_hours": F.coalesce(weekly, daily * days),
        "rest_days_per_week": number_in(t("hours"), r"(?i)(\d+(?:\.\d+)?)\s*\)?\s*rest days?"),
        "annual_leave_days": number_in(t("leave"), r"(?i)vacation of\s*\(?\s*(\d+)\s*\)?\s*(?:calendar\s+)?days").cast("int"),
        "wage": wage,
        "overtime_premium_pct": number_in(t("first_obligations"), r"(?i)plus\s*\(\s*(\d+(?:\.\d+)?)\s*%\s*\)\s*of the basic hourly wage"),
        "nationality": F.when(nationality.rlike("(?i)^saudi( arabian?)?$"), "saudi").when(nationality.isNotNull(), "non_saudi"),
        "occupation": value("occupation"),
        "work_location": value("location"),
        "employee_id": F.nullif(
            F.regexp_replace(F.try_element_at(F.filter(_within("second_party"), lambda v: v["label"].rlike("^id no")), F.lit(1))["value"], r"\D", ""),
            F.lit(""),
        ),
    }
    pages = {
        "contract_type": F.col("f_type.page"), "commencement_date": F.col("f_commenced.page"),
        "end_date": F.col("f_ended.page"), "wage": F.col("f_total.page"),
        "probation_days": section("probation")["page"], "annual_leave_days": section("leave")["page"],
    }
    page_map = F.create_map(*[x for n, c in pages.items() for x in (F.lit(n), c.cast("int"))])
    d = d.select(
        "doc_id", "lines", "footers", "sections", "labels",
        *[c.alias(n) for n, c in fields.items()], page_map.alias("pages"),
        F.col("f_basic.value").alias("_basic_text"), F.col("f_ended.value").alias("_end_text"),
    )
    d = d.withColumn("clauses", section15_clauses())
    return d.withColumn("issues", _issues()).withColumn("needs_review", blocks(F.col("issues"))).drop("_basic_text", "_end_text")


def _issues() -> Column:
    # The messages here and in required_issues are fixed values: results are compared by their text.
    w = F.col("wage")
    parts = w["basic"] + w["housing"] + w["transport"] + w["other"]
    period = money_period(F.col("_basic_text"))
    missing15 = section("additional").isNull()
    around = section("general").isNotNull() | section("appendix").isNotNull()
    heading = 'Section "15. Additional Terms" was not found.'
    own = F.array(
        issue((F.col("contract_type") == "unknown") & F.col("contract_type_raw").isNotNull(), "contract_type",
              F.concat(F.lit('Unrecognised contract type "'), F.col("contract_type_raw"), F.lit('".'))),
        issue(F.col("end_date").isNull() & (F.col("_end_text") != "") & ~F.col("_end_text").rlike("^[-–—]+$"), "end_date",
              F.concat(F.lit('Could not read the date "'), F.col("_end_text"), F.lit('".'))),
        issue((F.col("contract_type") == "fixed_term") & F.col("term_months").isNull(), "term_months",
              F.lit("Fixed-term contract without a readable term in clause 5.1.")),
        issue(period.isNotNull() & (period != "monthly"), "wage",
              F.concat(F.lit('Wage is printed per "'), period, F.lit('", expected monthly.'))),
        issue(F.abs(parts - w["total"]) > WAGE_TOLERANCE_SAR, "wage",
              F.format_string("Wage parts add up to %.2f but the total wage is %.2f.", parts, w["total"])),
    )
    section15 = F.array(
        issue(missing15 & around, "section15.missing", F.lit(heading + " Its terms were not analysed.")),
        issue(missing15 & ~around, "section15", F.lit(heading)),
        issue(~missing15 & section("appendix").isNull(), "section15",
              F.lit('Section "16. Appendix" was not found; Section 15 may run long.')),
    )
    empty = F.transform(
        F.filter("clauses", lambda c: c["text_en"] == ""),
        lambda c: F.struct(
            F.lit("section15.text_en").alias("field"),
            F.concat(F.lit("Clause "), c["number"], F.lit(" has Arabic text but no English text; only the Arabic OCR can read it.")).alias("message"),
        ),
    )
    return F.concat(F.array_compact(own), required_issues(), F.array_compact(section15), empty)


# --- section 15 ----------------------------------------------------------------------------

DRAFTS = "array<struct<number:string,parts:array<string>>>"


def section15_clauses() -> Column:
    """``array<struct<number, text_en>>``: a marker starts a clause, later lines belong to it."""
    body = F.when(section("additional").isNotNull(), section_lines("additional")).otherwise(
        F.slice("lines", 1, 0)
    )

    def read(line: Column) -> Column:
        return let(clean_english(line["en_text"]), lambda text: read_text(line, text))

    def read_text(line: Column, text: Column) -> Column:
        def ar_number(ar: Column) -> Column:
            sub = F.coalesce(
                F.nullif(F.regexp_extract(ar, ARABIC_CLAUSE_MARKER, 1), F.lit("")),
                F.nullif(F.regexp_extract(ar, ARABIC_CLAUSE_MARKER, 2), F.lit("")),
            )
            return F.concat(F.lit("15."), sub.cast("int").cast("string"))

        marked = text.rlike(CLAUSE_MARKER)
        return F.struct(
            text.alias("text"),
            F.when(marked, F.concat(F.lit("15."), F.regexp_extract(text, CLAUSE_MARKER, 1))).alias("number"),
            F.when(marked, F.regexp_extract(text, CLAUSE_MARKER, 2)).alias("first"),
            F.when(text == "", let(F.trim(ocr_digits(line["ar_text"])), ar_number)).alias("ar_number"),
            (F.trim(line["ar_text"]) != "").alias("has_ar"),
        )

    def draft(number: Column, parts: Column) -> Column:
        return F.array(F.struct(number.alias("number"), parts.alias("parts")))

    def step(acc: Column, line: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        no_parts = F.array().cast("array<string>")
        known = F.exists(acc, lambda x: x["number"] == line["ar_number"])
        return (
            F.when(
                line["number"].isNotNull() & (last["number"] == line["number"]) & (F.size(last["parts"]) == 0),
                F.concat(before, draft(line["number"], F.array(line["first"]))),
            )
            .when(line["number"].isNotNull(), F.concat(acc, draft(line["number"], F.array(line["first"]))))
            .when(
                (line["text"] != "") & last.isNotNull(),
                F.concat(before, draft(last["number"], F.concat(last["parts"], F.array(line["text"])))),
            )
            .when(line["ar_number"].isNotNull() & ~known, F.concat(acc, draft(line["ar_number"], no_parts)))
            .otherwise(acc)
            .cast(DRAFTS)
        )

    def finish(lines: Column) -> Column:
        drafts = F.aggregate(lines, F.array().cast(DRAFTS), step)
        preamble = F.array_join(F.filter(F.transform(lines, lambda x: x["text"]), lambda x: x != ""), " ")
        whole = F.when(
            F.size(F.split(preamble, " ")) >= 4, draft(F.lit("15.1"), F.array(preamble))
        ).when(
            (preamble == "") & F.exists(lines, lambda x: x["has_ar"]),
            draft(F.lit("15.1"), F.array().cast("array<string>")),
        ).otherwise(F.array().cast(DRAFTS)).cast(DRAFTS)
        return let(drafts, lambda d: F.when(F.size(d) > 0, d).otherwise(whole))

    drafts = let(F.transform(body, read), finish)
    return F.transform(
        drafts,
        lambda d: F.struct(
            d["number"].alias("number"), collapse(F.array_join(d["parts"], " ")).alias("text_en")
        ),
    )


def clause_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode("clauses").alias("clause_no", "c"))
    return rows.select(
        "doc_id", "clause_no", F.lit(15).alias("section"), F.col("c.number").alias("number"),
        F.col("c.text_en").alias("text_en"), clause_hash(F.col("c.text_en")).alias("text_hash"),
    )


def arabic_regions(docs: DataFrame) -> DataFrame:
    """The Arabic half of every page Section 15 touches, between its headings or the footer."""
    d = docs.withColumn("s", section("additional")).where("s IS NOT NULL")
    d = d.withColumns(
        {
            "heading": F.try_element_at("lines", F.col("s.start") + 1),
            "following": F.try_element_at("lines", F.col("s.end") + 1),
            "final": F.get("lines", F.size("lines") - 1),
        }
    )
    last = F.coalesce("following.page", "final.page")
    rows = d.select(
        "doc_id", "lines", "footers", "heading", "following",
        F.explode(F.sequence(F.col("heading.page"), last)).alias("page"),
    )
    here = F.filter("lines", lambda x: x["page"] == F.col("page"))
    feet = F.filter("footers", lambda x: x["page"] == F.col("page"))
    any_line = F.coalesce(F.try_element_at(here, F.lit(1)), F.try_element_at(feet, F.lit(1)))
    height, width = any_line["page_height"], any_line["page_width"]
    top = F.when(
        F.col("page") == F.col("heading.page"), F.col("heading.y_max") + REGION_PAD_PT
    ).otherwise(F.coalesce(F.try_element_at(here, F.lit(1))["y_min"], F.lit(0)) - REGION_PAD_PT)
    footer_top = F.coalesce(
        F.array_min(F.transform(feet, lambda x: x["y_min"])), height - FOOTER_BAND_PT
    ) - REGION_PAD_PT
    bottom = F.when(
        F.col("page") == F.col("following.page"), F.col("following.y_min") - REGION_PAD_PT
    ).otherwise(footer_top)
    out = rows.select(
        "doc_id", "page", (width / 2).alias("x_min"), F.greatest(F.lit(0.0), top).alias("y_min"),
        width.alias("x_max"), bottom.alias("y_max"), (bottom - top).alias("_tall"),
    )
    return out.where("_tall >= 5").drop("_tall")


def attach_ocr(clauses: Column, ocr: Column) -> Column:
    """``array<struct<number, text_ar>>``: OCR lines given to clauses in order.

    A full or mirrored number is taken for any later clause, a bare one only for the next.
    """
    pieces_type = "array<struct<index:int,text:string>>"
    numbers = F.transform(clauses, lambda c: c["number"])
    lines = F.split(ocr_digits(ocr), r"\r?\n")

    def step(acc: Column, line: Column) -> Column:
        full = F.when(line.rlike(FULL_MARKER), FULL_MARKER).when(line.rlike(MIRRORED_MARKER), MIRRORED_MARKER)
        digits = F.when(full == FULL_MARKER, F.regexp_extract(line, FULL_MARKER, 1)).when(
            full.isNotNull(), F.regexp_extract(line, MIRRORED_MARKER, 1)
        )
        rest = F.when(full == FULL_MARKER, F.regexp_extract(line, FULL_MARKER, 2)).when(
            full.isNotNull(), F.regexp_extract(line, MIRRORED_MARKER, 2)
        )
        wanted = F.concat(F.lit("15."), digits.cast("int").cast("string"))
        ahead = F.slice(numbers, acc["next"] + 1, F.size(numbers))
        at = F.array_position(ahead, wanted).cast("int")
        by_full = F.when(at > 0, acc["next"] + at - 1)
        bare = F.concat(F.lit("15."), F.regexp_extract(line, BARE_MARKER, 1).try_cast("int").cast("string"))
        by_bare = F.when(F.try_element_at(numbers, acc["next"] + 1) == bare, acc["next"])
        index = F.coalesce(by_full, by_bare)
        text = F.when(by_full.isNotNull(), rest).otherwise(F.regexp_extract(line, BARE_MARKER, 2))
        entry = F.when(
            index.isNotNull(), F.array(F.struct(index.alias("index"), text.alias("text")))
        ).when(
            acc["current"].isNotNull(), F.array(F.struct(acc["current"].alias("index"), line.alias("text")))
        ).otherwise(F.array()).cast(pieces_type)
        return F.struct(
            F.coalesce(index + 1, acc["next"]).cast("int").alias("next"),
            F.coalesce(index, acc["current"]).cast("int").alias("current"),
            F.concat(acc["pieces"], entry).alias("pieces"),
        )

    start = F.expr(f"named_struct('next', 0, 'current', CAST(NULL AS INT), 'pieces', CAST(array() AS {pieces_type}))")
    pieces = F.aggregate(lines, start, step)["pieces"]
    only = F.when(
        F.size(numbers) == 1,
        F.transform(lines, lambda x: F.struct(F.lit(0).alias("index"), x.alias("text"))),
    ).otherwise(F.array().cast(pieces_type)).cast(pieces_type)

    def attach(found: Column) -> Column:
        used = F.when(F.size(found) > 0, found).otherwise(only)
        return F.transform(
            numbers,
            lambda n, i: F.struct(
                n.alias("number"),
                F.nullif(
                    collapse(F.array_join(F.transform(F.filter(used, lambda p: p["index"] == i), lambda p: p["text"]), " ")),
                    F.lit(""),
                ).alias("text_ar"),
            ),
        )

    return let(pieces, attach)


# --- names ---------------------------------------------------------------------------------


def party_names(docs: DataFrame) -> DataFrame:
    """``doc_id, order, text, placeholder``: identifying strings, the first of equal ones."""

    def entry(order: int, text: Column, placeholder: str) -> Column:
        return F.array(F.struct(F.lit(order).alias("order"), collapse(text).alias("text"), F.lit(placeholder).alias("placeholder")))

    groups = []
    wanted = (
        ("^establishment name", "first_party", "[EMPLOYER]"),
        ("^employee name$", "second_party", "[EMPLOYEE]"),
        ("^signatory representative$", "first_party", "[NAME]"),
    )
    for n, (pattern, key, placeholder) in enumerate(wanted):
        found = find_label(pattern, key)
        groups += [entry(2 * n, found["value"], placeholder), entry(2 * n + 1, found["value_ar"], placeholder)]
    cells = F.filter(
        F.flatten(F.transform("footers", lambda r: F.concat(r["en"], r["ar"]))),
        lambda c: c["text"].rlike(BY_PHRASE),
    )
    names = F.flatten(
        F.transform(cells, lambda c: F.split(F.regexp_replace(c["text"], BY_PHRASE, " "), r"[:|]|\s[-–]\s"))
    )
    as_rows = lambda texts, order: F.transform(
        texts, lambda x: F.struct(F.lit(order).alias("order"), x.alias("text"), F.lit("[NAME]").alias("placeholder"))
    )
    groups.append(as_rows(F.transform(names, lambda x: collapse(F.regexp_replace(x, r"\d+", " "))), 6))
    created = F.transform("lines", lambda x: F.regexp_extract(x["en_text"], r"(?i)created by (.+?) at \d", 1))
    groups.append(as_rows(F.transform(created, lambda x: collapse(x)), 7))
    rows = docs.select("doc_id", F.explode(F.concat(*groups)).alias("n")).select("doc_id", "n.*")
    named = rows.where(F.col("text").isNotNull() & (F.col("text") != "") & has_letters(F.col("text")))
    return named.groupBy("doc_id", "text").agg(
        F.min("order").alias("order"), F.min_by("placeholder", "order").alias("placeholder")
    )
