"""Word boxes from layout XHTML and from OCR tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# Fixed values.
# A dot that matches line ends is one test a character; a class such as [\s\S] is many times slower.
PAGE = r"(?s)<page\b[^>]*>.*?</page>"
WORD = r"(?s)<word\b[^>]*>(.*?)</word>"
NAMED_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
POINTS_PER_INCH = 72


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, content``: one row per file of a folder."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content")
    )


def decode_entities(text: Column) -> Column:
    """XML entities, decimal, hexadecimal and named in any case, each decoded once from left to right."""
    entity = r"&(?:#[xX][0-9a-fA-F]+|#\d+|[a-zA-Z]+);"
    parts = F.regexp_extract_all(text, F.lit(entity + "|[^&]+|&"), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def plain(part: Column) -> Column:
        name = F.substring(part, F.lit(2), F.length(part) - 2)
        hexa = part.rlike("^&#[xX]")
        digits = F.regexp_replace(name, "[#xX]", "")
        code = F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        # A code point as text: its UTF-32 bytes decoded.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~part.rlike("^" + entity + "$"), part).when(part.rlike("^&#"), char).otherwise(
            F.coalesce(F.try_element_at(names, F.lower(name)), part)
        )

    return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(F.transform(parts, plain), ""))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1).try_cast("double")
    return F.coalesce(value, F.lit(0.0))


def _pages(files: DataFrame) -> DataFrame:
    """``doc_id, page, page_width, page_height, page_xml``: pages in order."""
    pages = files.select(
        "doc_id", F.posexplode(F.regexp_extract_all("content", F.lit(PAGE), F.lit(0))).alias("p", "page_xml")
    )
    head = F.regexp_extract("page_xml", r"^<page\b[^>]*>", 0)
    # The page's size is read before its words are spread; else every word carries its whole page.
    return pages.select(
        "doc_id", (F.col("p") + 1).alias("page"), "page_xml",
        _attribute(head, "width").alias("page_width"), _attribute(head, "height").alias("page_height"),
    )


def layout_pages(files: DataFrame) -> DataFrame:
    """Pages in order, each one row with ``words``: ``word_no, text`` of its words, empty ones dropped.

    For what is read of whole pages, without boxes: :func:`layout_words` spreads the words, and they would have to be gathered again.
    """
    texts = F.transform(
        F.regexp_extract_all("page_xml", F.lit(WORD), F.lit(1)),
        lambda body, i: F.struct(i.alias("word_no"), F.trim(decode_entities(body)).alias("text")),
    )
    words = F.filter(texts, lambda w: w["text"] != "")
    return _pages(files).select("doc_id", "page", "page_width", "page_height", words.alias("words"))


def layout_words(files: DataFrame) -> DataFrame:
    """Pages in order, empty words dropped. ``files``: ``doc_id, content``."""
    words = _pages(files).select(
        "doc_id", "page", "page_width", "page_height",
        F.posexplode(F.regexp_extract_all("page_xml", F.lit(WORD), F.lit(0))).alias("word_no", "word_xml"),
    )
    tag = F.regexp_extract("word_xml", r"^<word\b[^>]*>", 0)
    body = F.regexp_extract("word_xml", WORD, 1)
    return words.select(
        "doc_id", "page", "page_width", "page_height", "word_no",
        F.trim(decode_entities(body)).alias("text"),
        *[_attribute(tag, a).alias(n) for a, n in (("xMin", "x_min"), ("yMin", "y_min"), ("xMax", "x_max"), ("yMax", "y_max"))],
    ).where("text <> ''")


def ocr_words(files: DataFrame, dpi: float) -> DataFrame:
    """Words of OCR tables in points; a word takes the height of its line.

    ``files``: ``doc_id, content`` with a header line and 12 tab-separated columns.
    """
    rows = files.select("doc_id", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line")).where("n > 0")
    cell = F.split("line", "\t")
    num = lambda i: F.get(cell, i).try_cast("double") * (POINTS_PER_INCH / dpi)
    df = rows.select(
        "doc_id", "n", F.get(cell, 0).alias("level"), F.get(cell, 1).try_cast("int").alias("page"),
        num(6).alias("left"), num(7).alias("top"), num(8).alias("width"), num(9).alias("height"),
        F.trim(F.coalesce(F.get(cell, 11), F.lit(""))).alias("text"),
    )
    w = Window.partitionBy("doc_id").orderBy("n")
    bottom, right = F.col("top") + F.col("height"), F.col("left") + F.col("width")
    of = lambda level, value: F.last(F.when(F.col("level") == level, value), ignorenulls=True).over(w)
    df = df.withColumns(
        {
            "page_no": of("1", F.col("page")), "page_width": of("1", right), "page_height": of("1", bottom),
            "y_min": of("4", F.col("top")), "y_max": of("4", bottom),
        }
    )
    return df.where("level = '5' AND text <> '' AND page_no IS NOT NULL").select(
        "doc_id", F.col("page_no").alias("page"), "page_width", "page_height", F.col("n").alias("word_no"), "text",
        F.col("left").alias("x_min"), "y_min", (F.col("left") + F.col("width")).alias("x_max"), "y_max",
    )
