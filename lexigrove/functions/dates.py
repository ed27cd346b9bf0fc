"""Dates of queries and documents, as day numbers."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day 0 of day numbers.
EPOCH = "1600-01-01"

_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_number(word: str) -> int:
    """1..12 for a month's name, its first three letters, or its number; 0 for anything else."""
    w = word.lower().strip(".")
    if w.isdigit():
        return int(w) if 1 <= int(w) <= 12 else 0
    return next((i + 1 for i, m in enumerate(_MONTHS) if w == m or w == m[:3]), 0)


def parse_date(text: str) -> datetime.date | None:
    """YYYYMMDD, month/day/year, day-month-year, `day month year` or `month day year`; None if it is no date."""
    t = text.strip().lower().replace(",", " ")
    if re.fullmatch(r"\d{8}", t):
        year, month, day = int(t[:4]), int(t[4:6]), int(t[6:])
    else:
        parts = [p for p in re.split(r"[\s/-]+", t) if p]
        if len(parts) != 3 or not parts[2].isdigit():
            return None
        a, b, year = parts[0], parts[1], int(parts[2])
        if "/" in t:
            month, day = month_number(a), int(b) if b.isdigit() else 0
        elif a.isdigit():
            day, month = int(a), month_number(b)
        else:
            month, day = month_number(a), int(b) if b.isdigit() else 0
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


def day_number(date: datetime.date) -> int:
    """Days since EPOCH in the proleptic Gregorian calendar, without the double leap day of approximate formulas."""
    return (date - datetime.date(1600, 1, 1)).days


def date_column(text: Column) -> Column:
    """The day number of a text column that holds a date in one of the forms of parse_date; NULL otherwise."""
    t = F.trim(text)
    forms = ["yyyyMMdd", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy", "MMM d yyyy", "d MMMM yyyy", "MMMM d yyyy", "d-M-yyyy"]
    return F.datediff(F.coalesce(*[F.try_to_timestamp(F.initcap(t), F.lit(f)) for f in forms]).cast("date"), F.lit(EPOCH).cast("date")).cast("long")
