"""Stable trip identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the name space of the identifiers.
NAMESPACE_HEX = "c6f6f5c02b8a4b7a9b2a6f5c0c6f6f5c"


def uuid5(key: Column) -> Column:
    """Version 5 UUID of a text in the name space above."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_HEX)), F.encode(key, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), F.lower(F.hex(variant)), F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )
