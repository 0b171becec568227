"""Most frequent values of columns with very many distinct values, counted exactly.

The values are counted by a hash aggregation that combines map-side and spills
to disk, every task keeps only its own top k of a column, and one ordered limit
ends it. Nothing grows with the number of distinct values but disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_item(value: Column) -> Column:
    """Lower case, white-space runs as one blank, trimmed, rid of `?`, `!`, `.` and blanks at the end."""
    one_line = F.trim(F.regexp_replace(F.lower(value), r"[ \t\r\n]+", " "))
    return F.regexp_replace(one_line, r"[?!. ]+$", "")


def frequent_items(rows: DataFrame, id_col: str, fields: dict[str, Column], share: float | None = None, top: int | None = None) -> DataFrame:
    """Rows (field_name, item, n, ids): the most frequent items of each field.

    n is the number of distinct ids with the item, ids that of all distinct
    ids. A row delivered again counts once; if rows of one id differ, the least
    value of the field counts. A null value counts for no item, a row with null
    id for nothing, an empty text is an item like any other. An item must reach
    `share` of the ids, if given; at most `top` items a field are kept, if given
    (equal counts in the order of the item). As an id has one value of a field,
    1 / share bounds the items that can reach the share, so that the cut to that
    many loses none. An empty table gives no rows.
    """
    assert share or top, "give a share, a top or both"
    values = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *[value.alias(name) for name, value in fields.items()])
    once = values.groupBy("_id").agg(*[F.min(name).alias(name) for name in fields])
    items = F.array(
        F.struct(F.lit(None).cast("string").alias("field_name"), F.lit("").alias("item")),  # counts the ids
        *[F.struct(F.lit(name).alias("field_name"), F.col(name).alias("item")) for name in fields],
    )
    counts = once.select(F.explode(items).alias("v")).select("v.*").where("item IS NOT NULL").groupBy("field_name", "item").agg(F.count("*").alias("n"))
    ids = F.max(F.when(F.col("field_name").isNull(), F.col("n"))).over(Window.partitionBy())  # over at most bound rows a field
    order = Window.partitionBy("field_name").orderBy(F.desc("n"), "item")
    bound = top or int(1 / share + 1e-9)
    kept = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bound)
    out = kept.withColumn("ids", ids).where("field_name IS NOT NULL")
    if share:
        out = out.where(F.col("n") >= F.ceil(F.round(F.lit(share) * F.col("ids"), 9)))
    return out.select("field_name", "item", "n", "ids")
