"""References in nested values: found with their places, joined to what they should name, and put back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.rows import canonical

#: A reference inside a value that is written as JSON is a member of this name with a whole number.
MEMBER = "ref"


def _pattern(member: str) -> str:
    """What a reference looks like in compact JSON. Inside a string its quotes would be escaped, so none is found there."""
    return r'(?<!\\)"' + re.escape(member) + r'":(-?\d+)(?![\d.eE])'


def references(df: DataFrame, id_col: str, value_col: str, member: str = MEMBER) -> DataFrame:
    """``id_col``, ``nth`` and ``target`` of every reference in nested values (compact JSON, as ``to_json`` writes it), in the order that they stand in."""
    found = F.regexp_extract_all(value_col, F.lit(_pattern(member)), F.lit(1))
    return df.select(id_col, F.posexplode(found).alias("nth", "target")).select(id_col, "nth", F.col("target").cast("bigint").alias("target"))


def rewrite(df: DataFrame, id_col: str, value_col: str, names: DataFrame, old: str, new: str, dangling: str | None = None, member: str = MEMBER) -> DataFrame:
    """``df`` with the references of its values renamed: ``old`` numbers of ``names`` become ``new`` ones; others stay, or, with ``dangling``, those that no row of ``df`` has become that text.

    References leave their values with their places, meet the names by a join, and come back to their value's own list,
    by place; what stands between them is untouched, however deep it is nested. A value has its references in one row, as it
    has its text; a number that half of all references name is split by the adaptive join. Of several names of a number the least counts. ``id_col`` must be unique.
    """
    pattern = _pattern(member)
    found = references(df.where(F.col(value_col).isNotNull()), id_col, value_col, member)
    known = names.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(F.col(old).cast("bigint").alias("target")).agg(F.min(F.col(new).cast("bigint")).alias("new_"))
    named = found.join(known, "target", "left")
    text: Column = F.coalesce(F.col("new_"), F.col("target")).cast("string")
    own: Column = F.concat(F.lit(f'"{member}":'), text)
    if dangling is not None:
        there = df.select(F.col(id_col).cast("bigint").alias("target")).distinct().withColumn("there_", F.lit(True))
        named = named.join(there, "target", "left")
        own = F.when(F.col("there_") | F.col("new_").isNotNull(), own).otherwise(F.lit(f'"{member}":{dangling}'))
    listed = named.groupBy(F.col(id_col).alias("of_")).agg(F.sort_array(F.collect_list(F.struct("nth", own.alias("t")))).alias("refs_"))
    parts = F.split(value_col, pattern, -1)
    back = F.concat_ws("", F.flatten(F.zip_with(parts, F.col("refs_.t"), lambda p, t: F.array(p, F.coalesce(t, F.lit(""))))))
    out = df.join(listed, F.col(id_col) == F.col("of_"), "left")
    return out.select(*(F.when(F.col("refs_").isNotNull(), back).otherwise(F.col(c)).alias(c) if c == value_col else F.col(f"`{c}`") for c in df.columns))


def merge_duplicates(df: DataFrame, id_col: str, value_col: str, signature: Column, member: str = MEMBER) -> DataFrame:
    """``df`` without rows whose ``signature`` a lesser id has, and with all references to them naming the row that is kept."""
    kept = canonical(df.select(id_col, F.xxhash64(signature).alias("h_"), signature.alias("s_")), id_col, F.struct("h_", "s_"))
    twice = kept.where(F.col("keep_id") < F.col(id_col)).select(F.col(id_col).alias("old_"), F.col("keep_id").alias("new_"))
    left = df.join(twice.select(F.col("old_").alias(id_col)), id_col, "left_anti").select(*df.columns)
    return rewrite(left, id_col, value_col, twice, "old_", "new_", member=member)
