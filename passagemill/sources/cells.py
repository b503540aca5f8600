"""Worksheet cells to self-describing lines. [A5 A6]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display_text(value: Column, kind: Column, number_format: Column) -> Column:
    """A cell as it is shown: percent formats times 100, whole floats without decimals, ISO dates. [A6]

    value: the cell as a string; kind: float, date, datetime or anything else.
    """
    number = value.try_cast("double")
    # six significant digits, no trailing zeros
    hundred = number * 100
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.when(hundred == 0, 1.0).otherwise(F.abs(hundred)))).cast("int"))
    rounded = F.round(hundred * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", rounded), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    shown = (
        F.when(value.isNull(), "")
        .when(kind.isin("date", "datetime"), F.substring(value, 1, 10))
        .when((kind == "float") & F.contains(F.coalesce(number_format, F.lit("")), F.lit("%")), F.concat(plain, F.lit("%")))
        .when((kind == "float") & (number == F.floor(number)), F.floor(number).cast("long").cast("string"))
        .otherwise(F.trim(value))
    )
    return shown


def sheet_pages(cells: DataFrame, row_word: str = "row", column_word: str = "column", header_word: str = "header") -> DataFrame:
    """(document_id, page, text): one page for each worksheet, each data row naming its columns. [A5]

    cells(document_id, sheet_no, sheet, row, col, value, value_type, number_format), rows and columns from 1. The
    header is the first row with two filled cells; rows above it stay as they are; a column without a name gets its
    number; a sheet with nothing but a header keeps it. The rows of a sheet are gathered into its page only at the end.
    """
    shown = display_text(F.col("value"), F.col("value_type"), F.col("number_format"))
    key = ["document_id", "sheet_no"]
    d = cells.withColumn("shown", shown).where("shown <> ''").select(*key, "sheet", "row", "col", "shown")
    per_row = d.groupBy(*key, "row").agg(F.count(F.lit(1)).alias("n"))
    head = per_row.where("n >= 2").groupBy(*key).agg(F.min("row").alias("head"))
    d = d.join(head, key, "left")
    names = d.where("row = head").select(*key, "col", F.col("shown").alias("name"))
    d = d.join(names, [*key, "col"], "left")
    name = F.coalesce("name", F.concat(F.lit(f"{column_word} "), F.col("col").cast("string")))
    part = F.when(F.col("row") > F.col("head"), F.concat(name, F.lit(": "), "shown")).otherwise(F.col("shown"))
    lines = d.groupBy(*key, "sheet", "row", "head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", part.alias("t")))), lambda x: x["t"]), " | ").alias("line"))
    last = F.max("row").over(Window.partitionBy(*key))
    first = F.min("row").over(Window.partitionBy(*key))
    lines = lines.withColumn("only", (last == F.col("head")) & (first == F.col("head")))
    text = F.when(F.col("row") > F.col("head"), F.concat("sheet", F.lit(f" {row_word} "), F.col("row").cast("string"), F.lit(" "), "line")).when((F.col("row") == F.col("head")) & F.col("only"), F.concat("sheet", F.lit(f" {header_word} "), "line")).when(F.col("head").isNull() | (F.col("row") < F.col("head")), F.col("line"))
    return lines.withColumn("text", text).groupBy("document_id", F.col("sheet_no").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("row", "text")))), lambda x: x["text"]), "\n").alias("text"))
