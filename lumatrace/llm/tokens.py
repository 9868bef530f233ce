"""Token counts of texts by the public WordPunct pattern, computed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern is \w+|[^\w\s]+ with \w (letters, numbers, underscore) and \s for all of Unicode.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = f"[{WORD}]++|[^{WORD}{SPACE}]++"


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("bigint")
