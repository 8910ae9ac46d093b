"""Event times read from titles, epoch strings and ISO-like texts. Results are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

# fixed values: zone of texts without an offset, and the earliest accepted epoch time
ZONE = "Asia/Seoul"
EARLIEST = "2020-01-01 00:00:00"


def _local(text: Column, fmt: str, zone: str) -> Column:
    """Wall time in ``zone`` → UTC wall time; null when the text does not fit the format."""
    wall = F.call_function("try_to_timestamp", text, F.lit(fmt)).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def event_time_title(title: Column, zone: str = ZONE) -> Column:
    """Leading ``20YYMMDD`` of the title as midnight in ``zone``; invalid dates give null."""
    day = F.regexp_extract(strip(title), r"^(20\d{6})", 1)
    return F.when(day != "", _local(day, "yyyyMMdd", zone))


def event_time_epoch(ts: Column) -> Column:
    """Epoch seconds in a string, cut to milliseconds; null before 2020."""
    millis = F.when(ts.rlike(r"^\d+\.?\d*$"), F.floor(ts.cast("double") * 1000).cast("long"))
    at = F.timestamp_add("millisecond", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(at >= F.lit(EARLIEST).cast("timestamp_ntz"), at)


def event_time_iso(text: Column, zone: str = ZONE) -> Column:
    """Date-time with offset, else local date-time (blank or T), else local date, else null."""
    value = strip(text)
    body = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?)(\.\d+)?(Z|[+-]\d{2}:\d{2})?$", 1)
    fraction = F.regexp_extract(value, r":\d{2}\.(\d+)(Z|[+-]\d{2}:\d{2})?$", 1)
    offset = F.regexp_extract(value, r"(Z|[+-]\d{2}:\d{2})$", 1)
    full = F.concat(F.translate(body, "T", " "), F.when(F.length(body) == 16, ":00").otherwise(""))
    wall = F.call_function("try_to_timestamp", full, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    micros = F.coalesce(F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long"), F.lit(0).cast("long"))
    wall = F.timestamp_add("microsecond", micros, wall)
    sign = F.when(offset.startswith("-"), 1).otherwise(-1)
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    # an offset time needs the T between date and time
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}T") & (offset != "")
    utc = F.when(zoned & (offset == "Z"), wall).when(zoned, F.timestamp_add("minute", sign * minutes, wall))
    local = F.when(offset == "", F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), _local(value, "yyyy-MM-dd", zone))
    return F.when(body != "", F.coalesce(utc, local)).otherwise(day)
