"""String helpers."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes (str.isspace), derived by rule:
# ASCII blanks and controls plus the Unicode space separators.  Spark's trim()
# alone only removes the space character.
WHITESPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def strip_ws(x) -> Column:
    """Remove leading/trailing whitespace like Python's str.strip()."""
    col = F.col(x) if isinstance(x, str) else x
    return F.btrim(col, F.lit(WHITESPACE))
