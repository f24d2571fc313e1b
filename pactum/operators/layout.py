"""Positioned words to rows, cells and documents.

A page's words are gathered in one row, where a fold over their tops finds the rows. After that a document is one row
holding its lines, and everything read from it is map-only. Words that come dealt out by document are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions.quantities import let
from pactum.functions.text import SPACE, arabic_phrase, clean_english

# Fixed values.
ROW_TOLERANCE = 0.25
SEGMENT_GAP = 0.6
FOOTER_BAND_PT = 60
DOWNLOADED_AT = arabic_phrase("تم التحميل بتاريخ")
TITLE_EN = r"(?i)unified\s+employment\s+contract"
TITLE_AR = arabic_phrase("عقد العمل الموحد")
SECTION_TITLES = (
    ("contract_info", r"(?i)^contract information"),
    ("first_party", r"(?i)^first party'?s information"),
    ("second_party", r"(?i)^second party'?s information"),
    ("profession", r"(?i)^profession"),
    ("period", r"(?i)^contract period"),
    ("probation", r"(?i)^probation"),
    ("hours", r"(?i)^work hours"),
    ("leave", r"(?i)^annual leave"),
    ("wage", r"(?i)^wages? (&|and) benefits"),
    ("bank", r"(?i)bank account"),
    ("first_obligations", r"(?i)^first party'?s obligations"),
    ("second_obligations", r"(?i)^second party'?s obligations"),
    ("law", r"(?i)^applicable law"),
    ("general", r"(?i)^general provisions"),
    ("additional", r"(?i)^additional terms"),
    ("appendix", r"(?i)^appendix"),
)
HEADING = r"^(\d{1,2})\.\s+(.+)$"
NUMBERED = rf"^{SPACE}*\d{{1,2}}\."
ITEM_NUMBER = r"^(\d{1,2}(?:\.\d{1,2}){1,3})\.?(?:\s|$)"


def with_rows(words: DataFrame) -> DataFrame:
    """Adds ``row_y``: the top of the word's row on its page. A page's words are gathered once, so nothing is joined.

    Words without a document, page or top have no row and go.
    """
    keys = ("doc_id", "page")
    rest = [c for c in words.columns if c not in keys]
    placed = words.withColumn("y_min", F.col("y_min").cast("double")).dropna(subset=[*keys, "y_min"])
    pages = placed.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_words"))

    def top(w: Column) -> Column:
        height = F.greatest(F.lit(1.0), w["y_max"].cast("double") - w["y_min"])
        return F.struct(w["y_min"].alias("y_min"), w["x_min"].isNull(), w["x_min"], height.alias("h"))

    start = F.expr("named_struct('y', CAST(NULL AS DOUBLE), 'h', CAST(NULL AS DOUBLE), 'out', CAST(array() AS array<double>))")

    def step(acc: Column, word: Column) -> Column:
        joins = acc["y"].isNotNull() & (word["y_min"] - acc["y"] <= acc["h"] * ROW_TOLERANCE)
        opened = F.struct(word["y_min"].alias("y"), word["h"].alias("h"), F.concat(acc["out"], F.array(word["y_min"])).alias("out"))
        return F.when(joins, acc).otherwise(opened)

    tops = F.sort_array(F.transform("_words", top))
    anchored = pages.select(*keys, "_words", F.aggregate(tops, start, step)["out"].alias("_tops"))
    found = anchored.select(*keys, "_tops", F.explode("_words").alias("_w"))
    # A row ends where the next begins, so a word's row is the lowest that does not begin below it.
    row_y = F.array_max(F.filter("_tops", lambda y: y <= F.col("_w.y_min")))
    return found.select(*[c if c in keys else F.col("_w")[c].alias(c) for c in words.columns], row_y.alias("row_y"))


def segments(words: DataFrame) -> DataFrame:
    """Cells: runs of words without a wide gap, left to right. Input of ``with_rows``."""
    row = ("doc_id", "page", "row_y")
    w = Window.partitionBy(*row).orderBy("x_min", "y_min")
    height = F.greatest(F.lit(1.0), F.col("y_max") - F.col("y_min"))
    df = words.withColumn("_h", height)
    limit = F.greatest(F.lag("_h").over(w), F.col("_h")) * SEGMENT_GAP
    starts = F.when(F.col("x_min") - F.lag("x_max").over(w) > limit, 1).otherwise(0)
    df = df.withColumn("_start", starts).withColumn("segment_no", F.sum("_start").over(w))
    ordered = F.sort_array(F.collect_list(F.struct("x_min", "y_min", "text")))
    return df.groupBy(*row, "segment_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"),
        F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
        F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
        F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"),
    ).withColumn("column", F.when(F.col("x_min") < F.col("page_width") / 2, "en").otherwise("ar"))


def rows(cells: DataFrame) -> DataFrame:
    """Text rows with their English and Arabic cells, and whether they are footers."""
    cell = F.struct("x_min", "x_max", "y_min", "y_max", "text")
    collect = lambda c: F.sort_array(F.collect_list(F.when(F.col("column") == c, cell)))
    out = cells.groupBy("doc_id", "page", "row_y").agg(
        collect("en").alias("en"), collect("ar").alias("ar"),
        F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
        F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), " ")
    out = out.withColumns({"en_text": text("en"), "ar_text": text("ar")})
    row_text = F.trim(F.concat_ws(" ", F.nullif("en_text", F.lit("")), F.nullif("ar_text", F.lit(""))))
    out = out.withColumn("row_text", row_text)
    footer = (F.col("y_min") >= F.col("page_height") - FOOTER_BAND_PT) | row_text.rlike(DOWNLOADED_AT)
    return out.withColumn("footer", footer)


def page_rows(words: DataFrame) -> DataFrame:
    return rows(segments(with_rows(words)))


def documents(text_rows: DataFrame) -> DataFrame:
    """One row per document: ``lines`` and ``footers`` in reading order, ``sections``."""
    line = F.struct(
        "page", "row_y", "y_min", "y_max", "en", "ar", "en_text", "ar_text", "page_width", "page_height",
    )
    keep = lambda cond: F.sort_array(F.collect_list(F.when(cond, line)))
    docs = text_rows.groupBy("doc_id").agg(
        keep(~F.col("footer")).alias("lines"), keep(F.col("footer")).alias("footers")
    )
    return docs.withColumn("sections", let(F.col("lines"), _sections))


def _sections(lines: Column) -> Column:
    # A line's first cell is cleaned once and only where a number begins it; its title is taken once for all patterns.
    first = lambda line: F.coalesce(F.try_element_at(line["en"], F.lit(1))["text"], F.lit(""))
    numbered = F.filter(
        F.transform(lines, lambda line, i: F.struct(first(line).alias("text"), i.alias("start"), line["page"].alias("page"))),
        lambda h: h["text"].rlike(NUMBERED),
    )

    def key_of(title: Column) -> Column:
        key = F.lit(None).cast("string")
        for name, pattern in reversed(SECTION_TITLES):
            key = F.when(title.rlike(pattern), name).otherwise(key)
        return key

    def heading(h: Column) -> Column:
        return let(
            clean_english(h["text"]),
            lambda text: F.struct(
                let(F.regexp_extract(text, HEADING, 2), key_of).alias("key"), F.regexp_extract(text, HEADING, 1).alias("number"),
                h["start"].alias("start"), h["page"].alias("page"),
            ),
        )

    found = F.filter(F.transform(numbered, heading), lambda h: h["key"].isNotNull())

    def first_of_key(heads: Column) -> Column:
        keys = F.transform(heads, lambda h: h["key"])
        return F.filter(heads, lambda h, i: F.array_position(keys, h["key"]) == i + 1)

    def bounded(heads: Column) -> Column:
        return F.transform(
            heads,
            lambda h, i: F.struct(
                h["key"].alias("key"), h["number"].alias("number"), h["start"].alias("start"),
                F.coalesce(F.try_element_at(heads, i + 2)["start"], F.size(lines)).alias("end"),
                h["page"].alias("page"),
            ),
        )

    return let(let(found, first_of_key), bounded)


def section(key: str) -> Column:
    return F.try_element_at(F.filter("sections", lambda s: s["key"] == key), F.lit(1))


def section_lines(key: str) -> Column:
    """Body lines; the whole document when the heading is missing."""
    return let(
        section(key),
        lambda s: F.when(s.isNull(), F.col("lines")).otherwise(
            F.slice("lines", s["start"] + 2, s["end"] - s["start"] - 1)
        ),
    )


def _english(lines: Column) -> Column:
    return let(F.array_join(F.transform(lines, lambda x: x["en_text"]), " "), clean_english)


def section_text(key: str) -> Column:
    return _english(section_lines(key))


def section_texts() -> Column:
    """``array<struct<key, text>>``: :func:`section_text` of every key. The document's text, which stands for each heading
    that is missing, is made once."""
    keys = F.array(*[F.lit(k) for k, _ in SECTION_TITLES])

    def texts(whole: Column) -> Column:
        def text(key: Column) -> Column:
            found = F.try_element_at(F.filter("sections", lambda s: s["key"] == key), F.lit(1))
            return let(
                found,
                lambda s: F.when(s.isNull(), whole).otherwise(_english(F.slice("lines", s["start"] + 2, s["end"] - s["start"] - 1))),
            )

        return F.transform(keys, lambda key: F.struct(key.alias("key"), text(key).alias("text")))

    return let(_english(F.col("lines")), texts)


def detect(text_rows: DataFrame) -> DataFrame:
    """Whether page 1 has the title, the first page that has it, and why not."""
    titled = F.col("row_text").rlike(TITLE_EN) | F.col("row_text").rlike(TITLE_AR)
    by_doc = text_rows.groupBy("doc_id").agg(
        F.bool_or(titled & (F.col("page") == 1)).alias("ok"),
        F.min(F.when(titled, F.col("page"))).alias("first_titled_page"),
        F.bool_or(F.col("page") == 1).alias("_page1"),
    )
    reason = F.when(~F.col("_page1"), "Page 1 has no text layer (scanned or image-only PDF).").when(
        ~F.col("ok"), "Page 1 does not have the contract title."
    )
    return by_doc.select("doc_id", "ok", "first_titled_page", reason.alias("reason"))


# --- clause boxes --------------------------------------------------------------------------


def reading_order() -> list[Column]:
    """Order of boxes: page, then from the top, then the section before the items inside it."""
    return [F.col("page"), F.col("y_min"), F.length("clause")]


def clause_boxes(docs: DataFrame) -> DataFrame:
    """One box per clause, section and page. A row belongs to the last number above it."""
    in_sections = F.flatten(
        F.transform(
            "sections",
            lambda s: F.transform(
                F.slice("lines", s["start"] + 1, s["end"] - s["start"]),
                lambda line, i: F.struct(
                    s["number"].alias("section"), i.alias("i"), line["page"].alias("page"),
                    line["page_width"].alias("page_width"), line["page_height"].alias("page_height"),
                    F.trim(F.coalesce(F.try_element_at(line["en"], F.lit(1))["text"], F.lit(""))).alias("first"),
                    F.concat(line["en"], line["ar"]).alias("cells"),
                ),
            ),
        )
    )
    lines = docs.select("doc_id", F.inline(in_sections))
    number = F.regexp_extract("first", ITEM_NUMBER, 1)
    own = F.when(
        (F.col("i") > 0) & number.startswith(F.concat(F.col("section"), F.lit("."))), number
    )
    w = Window.partitionBy("doc_id", "section").orderBy("i")
    item = F.coalesce(F.last(own, ignorenulls=True).over(w), F.col("section"))
    low = lambda f: F.array_min(F.transform("cells", lambda c: c[f]))
    high = lambda f: F.array_max(F.transform("cells", lambda c: c[f]))
    placed = lines.select(
        "doc_id", "page", "page_width", "page_height", item.alias("item"),
        low("x_min").alias("x_min"), low("y_min").alias("y_min"),
        high("x_max").alias("x_max"), high("y_max").alias("y_max"),
    ).where("x_min IS NOT NULL")
    parts = F.split("item", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")
    )
    # Rows of one item and page are united before the ancestors are spread.
    united = placed.groupBy("doc_id", "item", "page").agg(*_unite())
    spread = united.select("*", F.explode(prefixes).alias("clause"))
    return spread.groupBy("doc_id", "clause", "page").agg(*_unite())


def _unite() -> list[Column]:
    return [
        F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"),
        F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"),
        F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"),
    ]
