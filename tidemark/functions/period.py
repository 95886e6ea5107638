"""Periods as Columns: canonical form, years, compatibility, months of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# Names of months.
MONTHS = {
    "jan": 1, "janeiro": 1, "fev": 2, "fevereiro": 2, "mar": 3, "marco": 3, "abr": 4, "abril": 4,
    "mai": 5, "maio": 5, "jun": 6, "junho": 6, "jul": 7, "julho": 7, "ago": 8, "agosto": 8,
    "set": 9, "setembro": 9, "out": 10, "outubro": 10, "nov": 11, "novembro": 11, "dez": 12, "dezembro": 12,
}


def four_digit_year(c: Column) -> Column:
    """Two digits up to 79 are of this century, others of the last; the rest stays."""
    short = c.rlike(r"^\d{1,2}$")
    n = c.try_cast("int")
    return F.when(short & (n <= 79), (n + 2000).cast("string")).when(short, (n + 1900).cast("string")).otherwise(c)


def canonical(ref: Column) -> Column:
    """One spelling for the notations of a period; null where it is empty."""
    r = F.replace(F.lower(F.trim(F.coalesce(ref, F.lit("")))), F.lit(" "), F.lit(""))
    part = lambda pattern, k: F.regexp_extract(r, pattern, k)
    day = r"^(\d{2})/(\d{2})/(\d{4})$"
    short_day = r"^(\d{2})/(\d{2})/(\d{2})$"
    months = r"^(\d{1,2})m(\d{2,4})$"
    quarter = r"^(\d)t(\d{2,4})$"
    year = four_digit_year(part(months, 2))
    listed = F.array_sort(F.filter(F.transform(F.split(r, ","), lambda t: four_digit_year(F.trim(t))), lambda t: t != ""))
    return (
        F.when(r == "", F.lit(None).cast("string"))
        .when(r.rlike(r"^\d{4}-\d{2}-\d{2}$"), r)
        .when(r.rlike(day), F.concat_ws("-", part(day, 3), part(day, 2), part(day, 1)))
        .when(r.rlike(short_day), F.concat_ws("-", four_digit_year(part(short_day, 3)), part(short_day, 2), part(short_day, 1)))
        .when(r.rlike(months), F.when(part(months, 1).try_cast("int") == 12, year).otherwise(F.concat(part(months, 1).try_cast("int").cast("string"), F.lit("m"), year)))
        .when(r.rlike(quarter), F.concat(part(quarter, 1), F.lit("t"), four_digit_year(part(quarter, 2))))
        .when(r.contains(","), F.array_join(listed, ","))
        .when(r.rlike(r"^\d{2}$"), four_digit_year(r))
        .otherwise(r)
    )


def _years_in(c: Column) -> Column:
    found = F.filter(F.split(c, "[^0-9]+"), lambda t: t.rlike("^(19|20)[0-9]{2}$"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: t.cast("int"))))


def years(ref: Column) -> Column:
    """The years that a period names, sorted; empty where it names none."""
    return F.coalesce(_years_in(canonical(ref)), F.array().cast("array<int>"))


def years_of_text(c: Column) -> Column:
    """The years of free text, else the two digits at its end as a year of this century."""
    full = _years_in(c)
    tail = F.regexp_extract(c, r"([0-9]{2})[^0-9]*$", 1)
    loose = F.when(tail != "", F.array(F.concat(F.lit("20"), tail).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.when(F.size(full) > 0, full).otherwise(loose), F.array().cast("array<int>"))


def year_of_column(column: Column, ref: Column) -> Column:
    """A column's own year, else the reference's, else its trailing two digits."""
    own = lambda c: F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    tail = F.nullif(F.regexp_extract(ref, r"(\d{2})\s*$", 1), F.lit("")).cast("int") + 2000
    return F.coalesce(own(column), own(ref), tail)


def equivalent(a: Column, b: Column) -> Column:
    """Whether two periods speak of the same time; true where one of them can't tell."""
    x, y = canonical(a), canonical(b)
    return F.when(x.isNull() | y.isNull(), True).when(x == y, True).when((F.size(years(a)) == 0) | (F.size(years(b)) == 0), True).otherwise(years(a) == years(b))


def compatible(a: Column, b: Column) -> Column:
    """Whether two periods share a year; true where one of them names none."""
    return share_a_year(years(a), years(b))


def share_a_year(x: Column, y: Column) -> Column:
    """The same of the periods' years."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), True).otherwise(F.arrays_overlap(x, y))


def target_years(ref: Column) -> Column:
    """The years, or one null where there are none, to be exploded."""
    return F.when(F.size(years(ref)) == 0, F.array(F.lit(None).cast("int"))).otherwise(years(ref))


def month_of_label(c: Column, months: dict[str, int] | None = None) -> Column:
    """The earliest month that a label names; null where it names none."""
    known = F.create_map(*(F.lit(x) for kv in (months or MONTHS).items() for x in kv))
    return F.array_min(F.transform(F.filter(words(c), lambda w: F.map_contains_key(known, w)), lambda w: F.element_at(known, w)))


def chronological_key(label: Column) -> Column:
    """`Out/2024` before `Jan/2025`: year times 100 plus month."""
    year = F.nullif(F.regexp_extract(label, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")
    return year * 100 + F.coalesce(month_of_label(label), F.lit(0))
