"""Lines repeated across one site's documents, as blocks of a weighted line graph.

Nodes are a site's lines (by key) with the number of documents that hold them,
edges pairs of consecutive lines with the number of documents in which they
follow each other. Nodes and edges of high support stay; connected components
are the boilerplate blocks, and every occurrence of their lines is taken out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.lines import line_hashes
from docketry.runtime import cut, join_small

SHARE, LEAST = 0.05, 6


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one site's kept edges (rows with y null are the nodes themselves).

    A site's kept nodes are at most 1 / share times the mean number of lines of
    its documents, and its edges likewise: the group is small by construction.
    """
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    support = dict(zip(pdf.x[pdf.y.isna()], pdf.n[pdf.y.isna()]))
    for x in support:
        find(x)
    for x, y in zip(pdf.x[pdf.y.notna()], pdf.y[pdf.y.notna()]):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    return pd.DataFrame({"site": pdf.site.iloc[0], "node": list(support), "n": list(support.values()), "block": [find(x) for x in support]})


def _version(text: Column, site: Column) -> Column:
    """What one of several rows under an id is chosen by."""
    return F.struct(F.when(text.isNotNull(), F.xxhash64(text)).alias("text"), F.when(site.isNotNull(), F.xxhash64(site)).alias("site"))


class SiteLines:
    """The repeated lines of `docs`, found when the object is made.

    `id_col`, `text_col` name columns of docs, `site` is an expression on it; any
    other columns are ignored. A row whose id, text or site is null holds no
    lines. If rows of one id differ, one version counts, the one whose site and text
    have the least hash (a null the least of all); `cleaned` takes the same one.
    A line is repeated if at least `share` of its site's distinct ids and at
    least `least` of them hold it.

    blocks: (site, a, b, n, block); occurrences: (id, line_no, block).
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, site: Column, share: float = SHARE, least: int = LEAST, edge_share: float = 0.5):
        self.site = site
        held = docs.select(F.col(id_col).alias("id"), _version(F.col(text_col), site).alias("version"), site.alias("site"), line_hashes(F.col(text_col)).alias("lines")).where("id IS NOT NULL")
        # only the lines' hashes are shuffled, never the texts; a repeated delivery falls together here
        self.held = cut(held.groupBy("id").agg(F.min(F.struct("version", "site", "lines")).alias("x")).select("id", "x.site", "x.lines").where("site IS NOT NULL"))
        sizes = self.held.groupBy("site").agg(F.count("*").alias("ids"))
        nodes = self.held.select("site", F.explode(F.array_distinct("lines")).alias("k")).where("k IS NOT NULL").groupBy("site", F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
        nodes = cut(nodes.join(sizes, "site").where(F.col("n") >= F.col("ids") * share).select("site", "a", "b", "n"))
        # an edge is kept if it holds in at least edge_share of the documents of its rarer line
        following = self._occurrences(nodes).withColumn("next", F.lead(F.struct("a", "b", "line_no", "n")).over(Window.partitionBy("id").orderBy("line_no"))).where("next.line_no = line_no + 1")
        edges = following.select("id", "site", "a", "b", F.least("n", "next.n").alias("most"), F.col("next.a").alias("b1"), F.col("next.b").alias("b2")).distinct().groupBy("site", "a", "b", "b1", "b2", "most").agg(F.count("*").alias("n"))
        edges = edges.where((F.col("n") >= least) & (F.col("n") >= F.col("most") * edge_share)).select("site", F.concat_ws("/", "a", "b").alias("x"), F.concat_ws("/", "b1", "b2").alias("y"), "n")
        # nodes travel as text: pandas would make floats of numbers beside nulls
        graph = nodes.select("site", F.concat_ws("/", "a", "b").alias("x"), F.lit(None).cast("string").alias("y"), "n").unionByName(edges)
        blocks = graph.groupBy("site").applyInPandas(_components, "site string, node string, n long, block string")
        node = F.split("node", "/")
        self.blocks = cut(blocks.select("site", node[0].cast("long").alias("a"), node[1].cast("long").alias("b"), "n", "block"))

    def _occurrences(self, keys: DataFrame) -> DataFrame:
        lines = self.held.select("id", "site", F.posexplode("lines").alias("line_no", "k")).where("k IS NOT NULL").select("id", "site", "line_no", "k.a", "k.b")
        return join_small(lines, keys, ["site", "a", "b"], spread="id")

    @property
    def occurrences(self) -> DataFrame:
        return self._occurrences(self.blocks).select("id", "line_no", "block")

    def cleaned(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, clean_text, lines_removed) for each distinct id of docs, null texts as they are."""
        gone = self.occurrences.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
        texts = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min_by(text_col, _version(F.col(text_col), self.site)).alias("text"))
        kept = F.filter(F.split("text", "\n"), lambda _, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False)))
        return texts.join(gone, "id", "left").select("id", F.array_join(kept, "\n").alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))
