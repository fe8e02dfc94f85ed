"""The full-text analyzer: lower-cased runs of letters and digits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """array<string> of the terms in order; NULL text gives NULL."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def terms_of(text: str) -> list[str]:
    """The same for a short query text on the driver."""
    return re.findall(r"[^\W_]+", text.lower())
