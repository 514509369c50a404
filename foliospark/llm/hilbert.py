"""Sharding along a Hilbert curve over metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import materialize, row_hash

SHARDS = 16
#: Bits of each dimension: 32 cells a side.
BITS = 5


def curve_index(df: DataFrame, cells: list[str], bits: int, out: str) -> DataFrame:
    """``df`` with ``out``: the place on the Hilbert curve of the integer coordinates in ``cells``, of ``bits`` bits each.

    Every step is a projection over the last, so that no expression is copied into another.
    """
    x = [f"{out}_{i}" for i in range(len(cells))]
    df = df.withColumns({a: F.col(c).cast("int") for a, c in zip(x, cells)})
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i, a in enumerate(x):
            # Where the bit is set, the lower bits of the first axis turn over; else they are exchanged with this axis's.
            turned = F.col(a).bitwiseAND(q) != 0
            change = F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(q - 1)
            df = df.withColumn(f"{out}_t", F.when(turned, F.lit(q - 1)).otherwise(change))
            moved = {x[0]: F.col(x[0]).bitwiseXOR(F.col(f"{out}_t"))}
            if i:
                moved[a] = F.when(turned, F.col(a)).otherwise(F.col(a).bitwiseXOR(F.col(f"{out}_t")))
            df = df.withColumns(moved)
    for before, a in zip(x, x[1:]):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    flip = F.lit(0)
    for level in range(1, bits):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << level) != 0, F.lit((1 << level) - 1)).otherwise(0))
    df = df.withColumn(f"{out}_t", flip)
    df = df.withColumns({a: F.col(a).bitwiseXOR(F.col(f"{out}_t")) for a in x})
    index = F.lit(0)
    for level in range(bits - 1, -1, -1):
        for a in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(F.col(a), level).bitwiseAND(1))
    return df.withColumn(out, index).drop(*x, f"{out}_t")


def _share_cell(df: DataFrame, column: str, bits: int, out: str) -> DataFrame:
    """Quantises a category by the share of rows in categories before its own, in order of code point, null last."""
    counts = df.groupBy(column).count()
    order = Window.partitionBy().orderBy(F.col(column).asc_nulls_last())
    before = F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = F.floor(before * (1 << bits) / F.sum("count").over(Window.partitionBy())).cast("int")
    # The windows above see one row a category.
    cells = materialize(counts.select(F.col(column).alias(f"{out}_key"), cell.alias(out)), "cells")
    return df.join(cells, F.col(column).eqNullSafe(F.col(f"{out}_key"))).drop(f"{out}_key")


#: Bytes of text of a range, about, where whole rows are sorted.
RANGE_BYTES = 64 << 20


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS, bits: int = BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, size, text_crc32, curve, ``shard_``, ``slot_`` and the columns of ``keep`` of every row.

    Categories are quantised by their share of the rows and sizes by half octaves from 16 bytes to 740 kB; rows are sorted by
    their cell's place on the Hilbert curve, then crc32 (equal texts of a cell lie together), id, and a hash of what is kept; runs of
    equal count, at most one apart, are the shards, so that each covers a compact part of the metadata. The sort
    is by ranges of that whole key, of ``RANGE_BYTES`` of text or less where rows are kept, which no hot category or group of copies can pile up in one task; rows get
    their places from their place in the partition and the counts of partitions before. ``slot_`` counts from 0
    in each shard.

    A null text is an empty one: size 1, crc32 0. Null categories and ids sort last. Repeated rows
    get slots of their own. An empty table gives an empty one. Extra columns are ignored unless kept.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.coalesce(text_col, F.lit(""))).alias("text_crc32"), *(F.col(f"`{c}`").alias(f"category_{i}") for i, c in enumerate(categories)), F.struct(*([F.col(f"`{k}`") for k in keep] or [F.lit(0).alias("none")])).alias("kept"), row_hash(docs.select(*(f"`{k}`" for k in keep))).alias("hash") if keep else F.lit(0).alias("hash"))
    rows = rows if keep else materialize(rows, "rows")
    for i in range(len(categories)):
        rows = _share_cell(rows, f"category_{i}", bits, f"cell_{i}")
    octaves = F.least(F.greatest(F.floor(2 * F.log2(F.col("size"))) - 8, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")
    rows = curve_index(rows.withColumn("cell_size", octaves), [*(f"cell_{i}" for i in range(len(categories))), "cell_size"], bits, "curve")
    order = ["curve", "text_crc32", F.col("id").asc_nulls_last(), "hash"]
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if keep:  # whole rows are sorted
        parts = max(parts, -(-(docs.agg(F.sum(size)).first()[0] or 0) // RANGE_BYTES))
    placed = rows.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    placed = placed.withColumns({"part_": F.spark_partition_id(), "nth_": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = materialize(placed.drop(*(f"cell_{i}" for i in range(len(categories))), "cell_size"), "placed")
    counts = placed.groupBy("part_").agg(F.count("*").alias("n"))
    w = Window.partitionBy().orderBy("part_")  # a row for each partition
    offsets = counts.select("part_", (F.sum("n").over(w) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    offsets = materialize(offsets, "offsets")
    at, each, odd = F.col("offset") + F.col("nth_"), F.expr(f"div(total, {shards})"), F.expr(f"total % {shards}")
    placed = placed.join(offsets, "part_").withColumns({"at": at, "each": each, "odd": odd})
    long_runs = F.col("odd") * (F.col("each") + 1)  # the first shards have one row more
    placed = placed.withColumn("shard_", F.when(F.col("at") < long_runs, F.expr("div(at, each + 1)")).otherwise(F.col("odd") + F.expr("div(at - odd * (each + 1), greatest(each, 1L))")).cast("int"))
    slot = F.col("at") - F.col("shard_") * F.col("each") - F.least(F.col("shard_"), F.col("odd"))
    return placed.select("id", "size", "text_crc32", *(f"category_{i}" for i in range(len(categories))), "curve", "shard_", slot.alias("slot_"), *(["kept"] if keep else []))


def op7(docs: DataFrame) -> DataFrame:
    """Shard and slot of every document, under the law of equal counts."""
    out = shard(docs)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard_").alias("shard"), F.col("slot_").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
