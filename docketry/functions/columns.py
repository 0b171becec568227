"""Column expressions shared by operators; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 name space for URLs, the bytes that uuid5 hashes first (a fixed value).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column) -> Column:
    """uuid5(NAMESPACE_URL, name) as text, by `sha1` and bit arithmetic."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(version_id: Column, index: Column) -> Column:
    return uuid5_url(F.concat(F.lit("source_version:"), version_id, F.lit(":chunk:"), index.cast("string")))


def estimate_tokens(text: Column) -> Column:
    """A token is about four code points; a text has at least one."""
    return F.greatest(F.lit(1), (F.length(text) / 4).cast("int"))


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)
