"""Text helpers shared by keys, packed fields and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One blank, Unicode separators and invisible marks included (Java regular expression class).
BLANK = r"[\s\p{Z}\x85​‌‍⁠﻿]"


def strip_blanks(c: Column) -> Column:
    """``c`` without blanks at either end."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def loose_key(c: Column) -> Column:
    """A key compared without case and without any blanks; empty keys become null."""
    bare = F.lower(F.regexp_replace(c, BLANK, ""))
    return F.when(bare != "", bare)
