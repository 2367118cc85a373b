"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepts 2024-01-05 and 2024-1-5; rejects 2024-13-01 and trailing text
# (with ANSI mode on, a malformed value raises instead of becoming null).
DATE_PATTERN = "yyyy-M-d"


def parse_date_strict(x) -> Column:
    col = F.col(x) if isinstance(x, str) else x
    return F.to_date(col, DATE_PATTERN)


def month_start(x) -> Column:
    col = F.col(x) if isinstance(x, str) else x
    return F.trunc(col, "month")
