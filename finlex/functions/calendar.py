"""Calendar operators (D1-D4), re-aimed from the reference's date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def last_weekday(d: str | Column) -> Column:
    """Roll a date back to the previous Friday when it falls on a weekend."""
    x = _c(d)
    return F.date_sub(x, F.greatest(F.weekday(x) - 4, F.lit(0)))


def business_dates(base: str | Column, meeting_offset: str | Column, record_offset: str | Column,
                   payment_offset: str | Column) -> Column:
    """meeting = base + offset, record = base + offset, payment = record + offset,
    each rolled back to a weekday.  Offsets are columns (data), not random draws."""
    b = _c(base)
    record = last_weekday(F.date_add(b, _c(record_offset)))
    return F.struct(last_weekday(F.date_add(b, _c(meeting_offset))).alias("meeting_date"),
                    record.alias("record_date"),
                    last_weekday(F.date_add(record, _c(payment_offset))).alias("payment_date"))


def period_labels(d: str | Column) -> Column:
    """D3: quarter, year, and the labels of quarter, fiscal year and semester (FIXED VALUES: their wording)."""
    x = _c(d)
    q = F.quarter(x)
    y = F.year(x)
    return F.struct(q.alias("quarter"), y.alias("year"),
                    F.format_string("%dº trimestre de %d", q, y).alias("quarter_label"),
                    F.format_string("ano fiscal de %d", y).alias("fiscal_year"),
                    F.format_string("%s semestre de %d", F.when(q <= 2, "primeiro").otherwise("segundo"), y)
                    .alias("semester"))


def br_date(d: str | Column) -> Column:
    """dd/MM/yyyy text."""
    return F.date_format(_c(d), "dd/MM/yyyy")
