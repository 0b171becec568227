"""Queries of problem 7 (lines repeated across a site)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.lines import SPACE, site_of
from docketry.llm.site_lines import LEAST, SHARE, SiteLines
from docketry.runtime import table


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, SiteLines]:
    chunks = table(spark, d, "chunks").select("id", "chunk_text", "source_url")
    return chunks, SiteLines(chunks, "id", "chunk_text", site_of(F.col("source_url")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)[1].occurrences.select("id", "line_no")


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk without the lines its site repeats."""
    chunks, lines = _lines(spark, d)
    return lines.cleaned(chunks, "id", "chunk_text")


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Per site the number of repeated lines and of the blocks they form."""
    return _lines(spark, d)[1].blocks.groupBy("site").agg(F.count("*").alias("repeated_lines"), F.countDistinct("block").alias("blocks"))


QUERIES = {"p7_found": p7_found, "p7_clean": p7_clean, "p7_blocks": p7_blocks}

_KEY = rf"regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{SPACE}', ' ', 'g'), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"
_FOUND = f"""one AS (SELECT id, min({{'site': nullif(regexp_replace(regexp_extract(lower(source_url), '^\\s*(?:[a-z][a-z0-9+.\\-]*://|//)?(?:[^/?#@\\s]*@)?([^/?#:\\s]+)', 1), '^www\\.', ''), ''), 't': chunk_text}}) AS x
    FROM chunks WHERE id IS NOT NULL GROUP BY id),
  doc AS (SELECT id, x.site AS site, x.t AS t FROM one WHERE x.site IS NOT NULL),
  lines AS (SELECT id, site, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM doc WHERE t IS NOT NULL),
  keyed AS (SELECT id, site, line_no, {_KEY} AS k FROM lines),
  n AS (SELECT site, k, count(DISTINCT id) AS n FROM keyed WHERE regexp_matches(k, '\\p{{L}}') GROUP BY ALL),
  s AS (SELECT site, count(*) AS ids FROM doc GROUP BY site),
  found AS (SELECT id, line_no::INT AS line_no FROM keyed JOIN n USING (site, k) JOIN s USING (site) WHERE n >= {LEAST} AND n >= {SHARE} * ids)"""
ORACLE = {
    "p7_found": f"WITH {_FOUND} SELECT id, line_no FROM found",
    "p7_clean": f"""WITH {_FOUND}, texts AS (SELECT id, min(chunk_text) AS t FROM chunks WHERE id IS NOT NULL GROUP BY id),
  parts AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM texts),
  kept AS (SELECT p.id, string_agg(line, chr(10) ORDER BY p.line_no) AS c FROM parts p ANTI JOIN found f ON p.id = f.id AND p.line_no = f.line_no GROUP BY p.id)
SELECT t.id, CASE WHEN t.t IS NOT NULL THEN coalesce(c, '') END AS clean_text, (SELECT count(*) FROM found f WHERE f.id = t.id)::INT AS lines_removed FROM texts t LEFT JOIN kept USING (id)""",
}
