"""Sources: separated text, JSON columns, macro series, HTML attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import locale_number


def read_separated(spark: SparkSession, path: str) -> DataFrame:
    """A table with `;` or `,`, whichever its first line has more of; quotes mean nothing.

    Cells are trimmed, blank lines fall away, empty headings become col0, col1, ... Only the
    first line of the first file (by path) is the heading; lines that repeat it are rows.
    """
    text = spark.read.text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")).where(F.trim("value") != "")
    head = lines.agg(F.min(F.struct("_f", "_b", "_i", "value")).alias("h")).first()["h"]
    if head is None:
        return spark.createDataFrame([], "col0 string")
    first = head["value"]
    sep = ";" if first.count(";") > first.count(",") else ","
    names = [c.strip() or f"col{i}" for i, c in enumerate(first.split(sep))]
    cells = F.split(F.regexp_replace("value", r"\r$", ""), F.lit(f"[{sep}]"), -1)
    heading = (F.col("_f") == head["_f"]) & (F.col("_b") == head["_b"]) & (F.col("_i") == head["_i"]) & (F.col("value") == first)
    return lines.where(~heading).select(*(F.trim(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))).alias(c) for i, c in enumerate(names)))


def rows_as_text(df: DataFrame, keys: list[str], order: str, rows: int = 2000, columns: int = 60) -> DataFrame:
    """Each group as lines of ` | ` separated cells under a heading, up to a documented cap.

    The cap is the feature: what is left out is counted in a last line.
    """
    cells = [c for c in df.columns if c not in keys][:columns]
    line = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells))
    # the first rows of each salted part, then of the group: no task gets a whole group
    numbered = df.select(*keys, F.col(order).alias("_o"), line.alias("_l"), F.pmod(F.xxhash64(F.col(order)), F.lit(64)).alias("_salt"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_o", "_l"))
    few = numbered.withColumn("_r", rank(*keys, "_salt")).where(F.col("_r") <= rows)
    few = few.withColumn("_r", rank(*keys)).where(F.col("_r") <= rows)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_l"))), lambda r: r["_l"]), "\n")
    counted = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = few.groupBy(*keys).agg(body.alias("_body")).join(counted, same)
    note = F.when(F.col("_n") > rows, F.format_string("\n... (+%d)", F.col("_n") - rows)).otherwise("")
    return out.select(*keys, F.concat(F.lit(" | ".join(cells) + "\n"), "_body", note).alias("text"))


def json_field(c: Column, name: str, kind: str) -> Column:
    """One field of a JSON object; null where the text or the field is not of that kind."""
    return F.from_json(c, f"`{name}` {kind}", {"mode": "PERMISSIVE"})[name]


def json_lines(c: Column, schema: str) -> Column:
    """The elements of a JSON array, to be exploded with their place."""
    return F.from_json(c, f"array<struct<{schema}>>")


def monthly_series(df: DataFrame, date: str, value: str) -> DataFrame:
    """Observations with dd/mm/yyyy dates and locale numbers; unreadable ones fall away."""
    day = F.when(F.col(date).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(F.col(date), "dd/MM/yyyy"))
    return df.withColumn("date_ref", day).withColumn("value", locale_number(F.col(value))).where("date_ref is not null and value is not null")


def attributes(html: Column, tag: str, name: str) -> Column:
    """The values of an attribute of a tag, in order, quoted by either sign."""
    return F.regexp_extract_all(html, F.lit(rf"""<{tag}\s[^>]*?\b{name}\s*=\s*["']([^"']*)["']"""), F.lit(1))


def is_spreadsheet(mime: Column) -> Column:
    return F.coalesce(mime, F.lit("")).rlike("(?i)spreadsheetml|ms-excel|excel|csv")
