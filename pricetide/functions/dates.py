"""Date ladders, month arithmetic and snapshot dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_datetime(col: Column) -> Column:
    """ISO text (any precision, zone ignored) or ``dd/MM/yyyy HH:mm:ss`` to a zone-free timestamp."""
    text = F.trim(col.cast("string"))
    iso = F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$2-$1 $4")
    local = F.regexp_replace(iso, r"(Z|[+-]\d{2}:?\d{2})$", "")
    local = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso).otherwise(local)
    return F.when(local.rlike(r"^\d{4}-\d{2}-\d{2}"), local.try_cast("timestamp_ntz"))


def snapshot_date(name: Column) -> Column:
    """Date in a ``..._DD_MM_YYYY`` name; null when there is none or it is not a real day."""
    part = F.regexp_extract(name, r"(\d{2}_\d{2}_\d{4})", 1)
    return F.regexp_replace(part, r"^(\d{2})_(\d{2})_(\d{4})$", "$3-$2-$1").try_cast("date")


def collection_date(name: Column, updated: Column, inserted: Column) -> Column:
    """Snapshot date, else the update date, else the insert date."""
    return F.coalesce(
        snapshot_date(name), parse_datetime(updated).cast("date"), parse_datetime(inserted).cast("date")
    )


def month_start(col: Column) -> Column:
    return F.trunc(col, "month")


def month_number(col: Column) -> Column:
    """Whole months on one axis: year * 12 + month."""
    return (F.year(col) * 12 + F.month(col)).cast("int")


def decimal_year(col: Column) -> Column:
    """Middle of the month as a fraction of the year."""
    return F.year(col) + (F.month(col) - 0.5) / 12.0
