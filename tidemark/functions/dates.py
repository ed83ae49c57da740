"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_ending(day: Column) -> Column:
    """Sunday label of the Monday-to-Sunday week that holds ``day``."""
    return F.date_add(F.trunc(day, "WEEK"), 6)


def next_sunday(day: Column) -> Column:
    """First Sunday strictly after ``day`` (a Sunday moves a whole week on)."""
    return F.next_day(day, "SUN")


def from_excel_serial(serial: Column) -> Column:
    """Excel day number (text or number, time part dropped) to date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial.cast("double")).cast("int"))


def period_of(day: Column, freq: str) -> Column:
    return day if freq == "D" else week_ending(day)
