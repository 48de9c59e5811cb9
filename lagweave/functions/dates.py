"""Dates and times from their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compose_datetime(day: Column, time: Column) -> Column:
    """A timestamp from YYYYMMDD and HHMMSS.fff (leading zeros may be gone, the fraction goes, null is midnight); null if invalid."""
    whole = F.coalesce(F.split_part(time, F.lit("."), F.lit(1)), F.lit("0"))
    return F.try_to_timestamp(F.concat(F.lpad(day, 8, "0"), F.lpad(whole, 6, "0")), F.lit("yyyyMMddHHmmss"))
