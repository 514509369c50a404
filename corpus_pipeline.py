"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, hilbert, mixture, quality, simhash
from foliospark.llm.common import alone, aside, forget, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones outside the held-out fold, keeps.

    A null text scores as an empty one; each text is scored whole, however long; repeated rows score alike and stay as often as they
    came. Without labels all score alike. An empty table stays empty. All columns come back, one of the name ``score`` too.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored, own = aside(docs, "score")
    return quality.score(scored, model).where(F.col("score") >= quality.THRESHOLD).select(*own)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprint or a resemblance of 0.8: that of the least id.

    Null and empty texts are one group, as all texts without a word are. Rows without an id come after all others; of rows with one id, the one whose row
    hashes least stays; whole rows that repeat are one. Resemblance is decided on whole texts. An empty table stays empty; columns may have any name and kind.
    """
    return simhash.keep_one(docs, resembling=0.8)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages.

    Null and empty texts have no words and stay; whole texts are scanned, however long; repeated rows are judged alike. Without
    a benchmark all stay. An empty table stays empty; columns named as the operator's own come back as they were.
    """
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, or up to three times.

    Null and empty texts have no words and are not needed to fill a share. A null source is a source. Ties are drawn by hashed ids and rows, so reruns
    agree; repeated rows are drawn each. No text is moved, however long. An empty table stays empty; columns may have any name.
    """
    taken = mixture.mix(docs, keep=tuple(docs.columns))
    return taken.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("kept.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their ``shard``, their ``slot`` in it, and ``curve``, along the Hilbert curve; these replace columns of their names.

    Null and empty texts are of size 1; long ones are sorted as whole rows. Null categories and ids sort last, ties by a hash of the row; repeated rows have
    slots of their own. An empty table stays empty, with the new columns.
    """
    out = hilbert.shard(docs, keep=tuple(docs.columns))
    own = [F.col(f"kept.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot", "curve")]
    return out.select(*own, F.col("shard_").alias("shard"), F.col("slot_").alias("slot"), "curve")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", unlike),
    ("decontamination", uncontaminated),
    ("mixture", mixed),
    ("shards", sharded),
]

#: The classifier is fitted, and fingerprints are XXH64 bit votes, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again,
    and all that was written for it is deleted.

    Null, empty and very long texts, ties, repeated rows, empty tables and columns of any name are as each stage says; of an empty table
    the result is empty, with all columns.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, alone(lambda: stage(spark, docs, sf_dir), name)
        forget(before)
    return docs
