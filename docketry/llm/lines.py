"""Lines of texts and sites of addresses, as several operators need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it, without relying on an engine's own \s.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def site_of(url: Column) -> Column:
    """The host of an address in lower case, without user, port and a leading `www.`; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*://|//)?(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def _bare_line(line: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " ")
    return F.regexp_replace(key, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def line_key(line: Column) -> Column:
    """What makes lines the same: no case, digit runs as 0, white space as one blank, bare ends.

    Null for a line in which no letter is left.
    """
    key = _bare_line(line)
    return F.when(key.rlike(r"\p{L}"), key)


def line_hashes(text: Column) -> Column:
    """For each line of a text its key as 128 bits (two longs), null where there is no key.

    Equal keys meet, others do not in any corpus that fits a disk. The keys are
    made in a step of their own: an expression used twice within one lambda
    would be evaluated twice.
    """
    keys = F.transform(F.split(text, "\n"), _bare_line)
    return F.transform(keys, lambda k: F.when(k.rlike(r"\p{L}"), F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k, F.lit("line")).alias("b"))))
