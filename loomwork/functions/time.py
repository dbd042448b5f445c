"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWITTER = (
    r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) ((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4})$"
)


def twitter_instant(col: Column | str) -> Column:
    """``Tue Oct 31 22:10:47 +0000 2017`` as a timestamp; null if missing, impossible or of another format."""
    c = F.col(col) if isinstance(col, str) else col
    body = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), _TWITTER, 1)
    return F.when(body != "", F.try_to_timestamp(body, F.lit("MMM dd HH:mm:ss Z yyyy")))


def permissive_instant(col: Column | str) -> Column:
    """As :func:`twitter_instant`; a text of another format counts if it is an ISO date, with or without a time (UTC)."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"), c.try_cast("timestamp"))
    return F.coalesce(twitter_instant(c), iso)
