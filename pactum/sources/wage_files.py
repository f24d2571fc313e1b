"""Payroll and contract tables as CSV lines, and wage records as JSON.

Lines are rows ``file, pos, line``: a large file is many splits. The header is looked for among
a file's first ten lines only, and each line meets its file's header by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.functions.text import header_key_text, latin_digits, nfkc
from pactum.operators.wages import as_paid

# Column names, Arabic names, how far down a header may stand.
PAYROLL_COLUMNS = {
    "employee_id": "EmployeeID", "name": "EmployeeName", "basic": "BasicSalary",
    "housing": "HousingAllowance", "transport": "OtherAllowances",
}
CONTRACT_COLUMNS = {
    **PAYROLL_COLUMNS, "transport": "TransportAllowance", "total": "TotalWage", "source": "Source",
}
ARABIC_NAMES = {
    "EmployeeID": ["رقم الهوية", "رقم الإقامة", "رقم الهوية / الإقامة", "رقم الهوية/الإقامة"],
    "EmployeeName": ["اسم الموظف", "اسم العامل", "الاسم"],
    "BasicSalary": ["الراتب الأساسي", "الأجر الأساسي"],
    "HousingAllowance": ["بدل السكن"],
    "OtherAllowances": ["البدلات الأخرى", "بدلات أخرى"],
    "TransportAllowance": ["بدل النقل", "بدل المواصلات"],
    "TotalWage": ["إجمالي الأجر", "إجمالي الراتب", "الإجمالي"],
    "Source": ["المصدر"],
}
#: Lines at the top of a file among which its header is looked for, by default.
HEADER_SEARCH_ROWS = 10
RECORD_SCHEMA = (
    "employeeId string, name string, basic string, housing string, transport string, total string"
)


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path`` in file order (``pos`` grows within a file)."""
    lines = spark.read.text(path)
    # Splits of a file are read in offset order; ids grow within a split.
    pos = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
    )
    return lines.select(
        F.col("_metadata.file_path").alias("file"), pos.alias("pos"), F.col("value").alias("line")
    )


#: Stands for a comma inside quotes while a line is split; lines that hold it are split by an expression instead.
_HELD = "\ue000"


def cells(line: Column) -> Column:
    """Cells of a line: commas inside quotes stay, quotes are dropped, doubled ones halved.

    A comma parts cells if an even number of quotes follows it. One pass: the line is cut at its quotes, and every other
    part, counted from the end, is inside.
    """
    def outside(parts: Column) -> Column:
        held = F.transform(
            parts, lambda p, i: F.when((F.size(parts) - i) % 2 == 0, F.replace(p, F.lit(","), F.lit(_HELD))).otherwise(p)
        )
        return F.transform(F.split(F.array_join(held, '"'), ",", -1), lambda c: F.replace(c, F.lit(_HELD), F.lit(",")))

    quoted = F.when(
        F.contains(line, F.lit(_HELD)), F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    ).otherwise(outside(F.split(line, '"', -1)))
    bare = F.transform(
        quoted, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'^"([\s\S]*)"$', "$1"), '""', '"')
    )
    plain = F.transform(F.split(line, ",", -1), lambda c: F.trim(c))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(plain)


def _key(cell: Column) -> Column:
    # As ``header_key``, for cells inside an array: the line was normalised before the split.
    t = F.translate(F.lower(cell), "أإآٱةى", "ااااهي")
    return F.regexp_replace(t, r"[^\p{L}\p{N}]", "")


def column_names(header_cells: Column, names: list[str]) -> Column:
    """Our name of each header cell, by its English or Arabic name; else the cell itself."""
    pairs = {}
    for name in names:
        for alias in [name, *ARABIC_NAMES.get(name, [])]:
            pairs.setdefault(header_key_text(alias), name)
    aliases = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")")
    return F.transform(header_cells, lambda c: F.coalesce(F.try_element_at(aliases, _key(c)), c))


def headers(lines: DataFrame, columns: dict[str, str], search_rows: int = HEADER_SEARCH_ROWS) -> DataFrame:
    """``file, pos, header, missing`` of every file: the first of its ``search_rows`` top lines naming the id."""
    names = list(dict.fromkeys(columns.values()))
    w = Window.partitionBy("file").orderBy("pos")
    # Only the top lines of a file leave a task.
    top = lines.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= search_rows)
    clean = nfkc(F.regexp_replace("line", "﻿", ""))
    # The normal form comes from Python, which the functions over arrays cannot hold: it is generated first.
    top = top.select("file", "pos", F.inline(F.array(F.struct(clean.alias("clean")))))
    top = top.withColumn("header", column_names(cells(F.col("clean")), names))
    named = F.array_contains("header", columns["employee_id"])
    first = F.struct((~named).alias("unnamed"), F.col("pos"), F.col("header"))
    found = top.groupBy("file").agg(F.min(first).alias("h"))
    expected = F.array(*[F.lit(n) for n in names])
    return found.select(
        "file", F.col("h.pos").alias("header_pos"), F.col("h.header").alias("header"),
        F.array_except(expected, "h.header").alias("missing"),
    )


def _places(header: Column) -> Column:
    """Where each name stands in a header. A repeated name keeps its last cell, as a later entry replaces an earlier one."""
    at = F.transform(F.sequence(F.lit(0), F.size(header) - 1), lambda i: F.struct(F.get(header, i).alias("k"), i.alias("i")))
    last = F.filter(at, lambda e: ~F.array_contains(F.slice(header, e["i"] + 2, F.size(header)), e["k"]))
    return F.map_from_entries(last)


def resolve(
    lines: DataFrame, columns: dict[str, str], search_rows: int = HEADER_SEARCH_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Data rows ``file, pos, line, row map<string,string>`` and the files without a column.

    A line is split once, and its fields are taken by the places that the header's names have in the file.
    """
    found = headers(lines, columns, search_rows)
    bad = found.where(F.size("missing") > 0).select("file", "missing")
    good = found.where(F.size("missing") == 0).select("file", "header_pos", _places(F.col("header")).alias("places"))
    # One header row per file; a huge file's lines are split by the adaptive skew join.
    rows = lines.join(good, "file").where(
        (F.col("pos") > F.col("header_pos")) & (F.regexp_replace("line", r"[,\s]", "") != "")
    )
    # A generated row is neither inlined into what reads it nor computed again for a filter.
    once = lambda c, name: F.inline(F.array(F.struct(c.alias(name))))
    split = rows.select("file", "pos", "line", "places", once(cells(F.regexp_replace("line", "\r$", "")), "cells"))
    row = F.transform_values("places", lambda _, i: F.coalesce(F.get("cells", i), F.lit("")))
    return split.select("file", "pos", "line", once(row, "row")), bad


def amount(raw: Column) -> Column:
    """Digits of either script without thousands signs, as text; empty becomes null."""
    plain = F.regexp_replace(latin_digits(raw), "[\\s,٬]", "")
    return F.nullif(plain, F.lit(""))


def records(rows: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Wage records and rejected rows with the reason."""
    cell = lambda n: F.try_element_at("row", F.lit(columns[n]))
    amounts = [n for n in ("basic", "housing", "transport", "total") if n in columns]
    # Generated, so that neither the reasons nor the filter on them read the cells again; written out in each reason, they
    # made a method too large to be compiled.
    read = F.struct(
        F.nullif(F.regexp_replace(latin_digits(cell("employee_id")), r"\D", ""), F.lit("")).alias("employee_id"),
        F.nullif(cell("name"), F.lit("")).alias("name"),
        *[amount(cell(n)).alias(f"_{n}") for n in amounts],
        *([F.lower(cell("source")).alias("source")] if "source" in columns else []),
    )
    df = rows.select("file", "pos", "line", F.inline(F.array(read)))
    reasons = [F.when(F.col("employee_id").isNull(), F.concat(F.lit(f"A row has no {columns['employee_id']}: "), F.col("line")))]
    for n in amounts:
        bad = F.col(f"_{n}").isNotNull() & F.col(f"_{n}").try_cast("double").isNull()
        reasons.append(F.when(bad, F.concat(F.lit(f'{columns[n]} "'), F.col(f"_{n}"), F.lit('" is not a number.'))))
    if "source" in columns:
        wrong = ~F.coalesce(F.col("source").isin("qiwa", "offline"), F.lit(False))
        reasons.append(F.when(wrong, F.concat(F.lit(f"{columns['source']} must be qiwa or offline, not \""), F.coalesce("source", F.lit("")), F.lit('".'))))
    df = df.withColumn("error", F.coalesce(*reasons))
    for n in ("basic", "housing", "transport", "total"):
        value = F.col(f"_{n}").try_cast("double") if n in amounts else F.lit(None).cast("double")
        df = df.withColumn(n, value)
    keep = ["file", "pos", "employee_id", "name", "basic", "housing", "transport", "total"]
    keep += ["source"] if "source" in columns else []
    return df.where("error IS NULL").select(*keep), df.where("error IS NOT NULL").select("file", "pos", "line", "error")


def read_payroll(lines: DataFrame, search_rows: int = HEADER_SEARCH_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payroll as paid, rejected rows, and files with missing columns."""
    rows, bad_files = resolve(lines, PAYROLL_COLUMNS, search_rows)
    good, rejected = records(rows, PAYROLL_COLUMNS)
    return as_paid(good), rejected, bad_files


def read_contracts(
    lines: DataFrame, search_rows: int = HEADER_SEARCH_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Contracts and offers by their Source column, rejected rows, bad files."""
    rows, bad_files = resolve(lines, CONTRACT_COLUMNS, search_rows)
    good, rejected = records(rows, CONTRACT_COLUMNS)
    contracts = good.where("source = 'qiwa'").drop("source")
    offers = good.where("source = 'offline'").drop("source")
    return contracts, offers, rejected, bad_files


def json_records(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wage records from JSON texts (``value``); ids are ten digits, amounts never negative."""
    parsed = F.from_json("value", RECORD_SCHEMA)
    df = texts.withColumn("r", parsed).select("value", "r.*")
    ok = F.coalesce(F.col("employeeId").rlike(r"^\d{10}$"), F.lit(False))
    for n in ("basic", "housing", "transport", "total"):
        ok = ok & (F.col(n).isNull() | F.col(n).rlike(r"^\d+(\.\d+)?([eE]\+?\d+)?$"))
    df = df.withColumn("_ok", ok)
    good = df.where("_ok").select(
        F.col("employeeId").alias("employee_id"), "name",
        *[F.col(n).cast("double").alias(n) for n in ("basic", "housing", "transport", "total")],
    )
    return good, df.where("NOT _ok").select("value")
