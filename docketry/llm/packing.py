"""Filling containers of a fixed capacity with texts, best fit under conflicts.

Pieces are spread over tasks at random, sorted by falling size within a task
and put one by one into the fullest bin that still takes them. Bins lie in
buckets by residual capacity; a bitmap of non-empty buckets gives the successor
of a size in a few word operations. Each bin carries a bitmap of the sources
and one of the duplicate clusters it holds; the search goes on from bucket to
bucket until the tightest compatible bin is found.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.bpe import TOKENIZERS, encoder_of, share_ranks
from docketry.runtime import cut

CAPACITY = 2048
#: Pieces that one task packs, about: its open bins must fit in memory.
TASK_PIECES = 20_000
#: Of a source or cluster with more pieces than this share of the containers needed only so many are kept apart.
APART = 0.5
CLUSTER_BITS = 1024


class BestFit:
    """Open bins of one task, by residual capacity.

    A piece is compatible with a bin that holds neither its source nor its
    cluster; if no such bin takes it, with one that lacks its cluster alone.
    """

    def __init__(self, capacity: int):
        self.capacity, self.filled = capacity, 0
        self.buckets: dict[int, list[list[int]]] = {}  # residual -> [residual, bin number, source bits, cluster bits]
        self.there = 0  # bit r: some bin has residual r

    def put(self, size: int, source: int, cluster: int) -> int:
        """The bin that a piece of `size` goes to; source and cluster are single bits or 0."""
        found = self._take(size, source, cluster)
        if not found and source:
            found = self._take(size, 0, cluster)  # a shared source is better than an empty container
        if not found:
            self.filled += 1
            found = [self.capacity, self.filled - 1, 0, 0]
        self._keep(found, size, source, cluster)
        return found[1]

    def _take(self, size: int, source: int, cluster: int) -> list[int] | None:
        """Removes and gives the tightest bin without these bits; successor search over the non-empty buckets."""
        rest, residual = self.there >> size, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            bins = self.buckets[residual]
            for k in range(len(bins) - 1, -1, -1):
                if not bins[k][2] & source and not bins[k][3] & cluster:
                    found, bins[k] = bins[k], bins[-1]
                    bins.pop()
                    if not bins:
                        self.there &= ~(1 << residual)
                    return found
            rest >>= step + 1
            residual += 1
        return None

    def _keep(self, bin_: list[int], size: int, source: int, cluster: int) -> None:
        bin_[0] -= size
        if residual := bin_[0]:  # a full bin is closed and forgotten
            bin_[2] |= source
            bin_[3] |= cluster
            self.buckets.setdefault(residual, []).append(bin_)
            self.there |= 1 << residual


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: dict[str, Column], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, tokens, *keep) with the number of tokens of each text (0 for null and empty)."""
    shared, names = share_ranks(docs.sparkSession, folder, name), ["id", "tokens", *keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            sizes = array("i", (sum(map(len, map(encoder.__getitem__, encoder.words(t)))) if (t := x.as_py()) else 0 for x in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *batch.columns[2:]], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in keep.items()])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(count, ", ".join([f"id {kinds['id']}", "tokens int", *[f"{k} {kinds[k]}" for k in keep]]))


def pack(docs: DataFrame, id_col: str, text_col: str, source_col: str, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, piece, first_token, tokens, container) for each row of docs.

    A text of at most `capacity` tokens is one piece (piece 0); a longer one is
    cut into full containers and a remainder. Texts without tokens (null, empty)
    take no space: their container is null. Repeated rows are packed like any
    others, and a null source never conflicts. The duplicate cluster of a text
    is the hash of its words in lower case. Copies do not share a container,
    unless they are so many that keeping them apart would cost containers: of more
    pieces than APART times the containers needed the excess is free; texts of one source are kept
    apart as long as that opens no further container. An empty table gives no rows.
    """
    words = F.trim(F.regexp_replace(F.lower(text_col), r"(?U)\s+", " "))
    sized = cut(token_counts(docs, id_col, text_col, {"source": F.when(F.col(source_col).isNotNull(), F.xxhash64(source_col)), "cluster": F.xxhash64(words)}, folder, name))
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    starts = F.when(F.col("tokens") <= capacity, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(F.col("tokens") % capacity == 0, whole - 1).otherwise(whole)))
    pieces = sized.where("tokens > 0").withColumn("piece", F.explode(starts)).withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity))
    count, total = pieces.agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, -(-count // task_pieces))
    # Of a source or cluster beyond the share there are at most capacity / (APART * mean size of a piece): a bound to broadcast by.
    often = (total or 0) / capacity * APART
    for k in ("source", "cluster"):
        tied = pieces.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n")).where(F.col("n") > often)
        # as many of its pieces as fit keep their conflict, the excess is free
        freed = F.col("n").isNotNull() & (F.pmod(F.xxhash64("id", "piece", F.lit(k), F.monotonically_increasing_id()), F.col("n")) >= often)
        pieces = pieces.join(F.broadcast(tied), k, "left").withColumn(k, F.when(~freed, F.col(k))).drop("n")
    # spread by row number, which no hot id or text can gather; it is stable, as the rows are read from a checkpoint
    task = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)).cast("int")
    placed = pieces.withColumn("task", task).select("task", "id", "piece", "size", "source", "cluster").repartitionById(tasks, F.col("task")).sortWithinPartitions("task", F.desc("size"), "id", "piece")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, seen = None, BestFit(capacity), {}
        for batch in batches:
            found = []
            for task, size, source, cluster in zip(*(batch.column(c).to_pylist() for c in ("task", "size", "source", "cluster"))):
                if task != now:
                    now, bins, seen = task, BestFit(capacity), {}
                bit = 0 if source is None else 1 << seen.setdefault(source, len(seen))
                found.append(bins.put(size, bit, 0 if cluster is None else 1 << cluster % CLUSTER_BITS))
            labels = [f"{t}-{b}" for t, b in zip(batch.column("task").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("piece"), batch.column("size"), pa.array(labels, pa.string())], names=["id", "piece", "tokens", "container"])

    kind = docs.schema[id_col].dataType.simpleString()
    packed = placed.mapInArrow(fill, f"id {kind}, piece int, tokens int, container string")
    none = sized.where("tokens = 0").select("id", F.lit(0).alias("piece"), "tokens", F.lit(None).cast("string").alias("container"))
    return packed.unionByName(none).select("id", "piece", (F.col("piece") * capacity).alias("first_token"), "tokens", "container")
