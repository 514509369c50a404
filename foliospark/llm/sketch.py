"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Places, Shared, small_batches, units, weighted_ranges

#: Hashes that a sketch keeps.
K = 128
#: Words of a shingle.
SHINGLE = 5
#: Bits of a hash.
BITS = 48
#: Words whose hashes a worker remembers at once.
REMEMBERED = 100_000
#: Rows of one range of ids; those of over 6 kB count as several, so this is about 24 MB at most.
RANGE_ROWS = 4096
#: Ranges at most; their bounds are sent to all tasks.
MOST_RANGES = 65_536

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hasher:
    """Hashes a text's shingles; remembers the hashes of words."""

    def __init__(self, shingle: int = SHINGLE, bits: int = BITS):
        self.shingle, self.bits, self.known = shingle, bits, {}

    def _word(self, w: bytes) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        h = self.known[w] = xxhash.xxh64_intdigest(w)
        return h

    def hashes(self, text: str | None) -> np.ndarray:
        """Hashes of ``bits`` bits, one for each shingle, repeats included. A text of fewer words is one shingle."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        get, new = self.known.get, self._word
        h = np.fromiter((get(w) or new(w) for w in words), np.uint64, len(words))
        n = min(self.shingle, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _A
            out ^= out >> np.uint64(31)
        out = (out ^ (out >> np.uint64(30))) * _B  # so that the least hashes are a fair sample
        out = (out ^ (out >> np.uint64(27))) * _C
        return (out ^ (out >> np.uint64(31))) >> np.uint64(64 - self.bits)


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of a set: its ``k`` least distinct hashes, ascending."""
    return np.unique(hashes)[:k]


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the sets sketched."""
    parts = list(sketches)
    return bottom_k(np.concatenate(parts), k) if parts else np.zeros(0, np.uint64)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles in the union; 1 for two empty sets, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    union = both[np.concatenate(([True], ~twice))][:k]
    return float(np.count_nonzero(both[1:][twice] <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set's shingles that the second has; 1 if the first is empty."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge((a, b), k), k) / distinct(a, k))


def encode(sketch: np.ndarray) -> str:
    """Eight base64 characters a hash."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).copy().view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``id_col``, ``fingerprint`` (encoded) and ``n_shingles`` (estimated distinct) of every row, without a shuffle.

    Words are cut at ASCII white space and lower-cased (A-Z). A null text is an empty one, with an empty
    fingerprint. Equal texts have equal fingerprints. Rows may repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for b in batches:
            found = [bottom_k(hasher.hashes(t), k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(s) for s in found]), pa.array([distinct(s, k) for s in found])], names=[id_col, "fingerprint", "n_shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string, n_shingles double")


def merged(prints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The fingerprint of each group's texts together, of ``fingerprint`` strings: partial sketches within the
    partitions, then their union. A hot group comes to the shuffle as a sketch a partition."""
    keys = prints.select(*by)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields), "fingerprint string, n_shingles double"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], keys_arrow[i]) for i in range(len(by))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([encode(s) for s in held.values()], pa.string()), pa.array([distinct(s, k) for s in held.values()], pa.float64())], names=[*by, "fingerprint", "n_shingles"])
            held.clear()
            return out

        for b in batches:
            keys_arrow = [b.column(i).type for i in range(len(by))]
            for *key, text in zip(*(b.column(i).to_pylist() for i in range(len(by) + 1))):
                if text is not None:
                    old = held.get(tuple(key))
                    held[tuple(key)] = decode(text) if old is None else merge((old, decode(text)), k)
            if len(held) > 20_000:  # a task's memory stays bounded; the rest is combined after the shuffle
                yield flush()
        if held:
            yield flush()

    partial = prints.select(*by, "fingerprint").mapInArrow(combine, schema)
    return partial.repartition(*by).sortWithinPartitions(*by).select(*by, "fingerprint").mapInArrow(combine, schema) if by else partial.coalesce(1).select("fingerprint").mapInArrow(combine, schema)


def edited(text: str, following: str) -> str:
    """The text with its last third of code points replaced by as many, or all, of the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, id_col: str, text_col: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (range_, guest_, key_, id, text) so placed and sorted that each document is followed by the next one
    in descending id, null last, equal ids by the hash of their text and then by the text, whatever the ranges.

    Ranges of ids get about ``rows`` rows each, long ones counting as several, or more once there are ``MOST_RANGES``. An
    id that outweighs two ranges, as that of all nulls may, is dealt to several by the hash of the text. The first rows of each range also come, as guests, to the end of the range before, those of the first range to
    the last's. So whole texts are shuffled once, and no window runs over all documents.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    least, total = keyed.select(F.min("id"), F.sum(units(F.col("text")))).first()
    keyed = keyed.withColumn("key_", F.coalesce("id", F.lit((least or 0) - 1)))
    places = Places(spark, weighted_ranges(keyed, "key_", units(F.col("text")), max(rows, (total or 0) // MOST_RANGES)))
    keyed = keyed.withColumn("p_", places.of(F.col("key_")))
    keyed = keyed.withColumn("h_", F.xxhash64("text"))
    part = F.least(F.floor((F.col("h_") / float(2**64) + 0.5) * F.col("p_.parts")), F.col("p_.parts") - 1)  # grows with the hash
    range_ = F.when(F.col("p_.parts") > 1, part).otherwise(0) + F.lit(places.total) - F.col("p_.base") - F.col("p_.parts")
    keyed = keyed.withColumn("range_", range_.cast("int"))

    firsts = keyed.groupBy("range_").agg(F.max(F.struct("key_", F.bitwise_not("h_").alias("h_"))).alias("f_")).orderBy("range_").collect()  # a row a range
    hosts = Shared(spark, {(r["f_"]["key_"], ~r["f_"]["h_"]): firsts[n - 1]["range_"] for n, r in enumerate(firsts)})

    @F.pandas_udf("int")
    def host_of(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([hosts.value.get(k, -1) for k in zip(keys.tolist(), hashes.tolist())], dtype="int32")

    at = F.struct(F.col("range_"), F.lit(False).alias("guest_"))
    guest = F.struct(host_of("key_", "h_").alias("range_"), F.lit(True).alias("guest_"))
    placed = keyed.withColumn("at", F.explode(F.filter(F.array(at, guest), lambda x: x["range_"] >= 0))).select("at.*", "key_", "id", "text", "h_")
    return placed.repartitionById(places.total, "range_").sortWithinPartitions("range_", "guest_", F.col("key_").desc(), "h_", "text")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, rows: int = RANGE_ROWS) -> DataFrame:
    """Each document's fingerprint held against that of its edited text and of the next document.

    The edited text has its last third replaced by the start of the next document's, in descending id; after the
    last comes the first. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every row. A null text is an empty one; null ids come last; repeated rows come back as often,
    equal ids in order of their texts' hashes, however many there are (only whole rows that repeat share a task). Ids are numbers. A document alone is its own next. An empty
    table gives an empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        last, done = None, None  # the row that waits for the next one; the range that is finished
        for b in batches:
            out = []
            for place, guest, doc, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if guest and place == done:
                    continue
                own = bottom_k(hasher.hashes(text), k)
                if last is not None:
                    doc_before, text_before, before = last
                    new = edited(text_before, text)
                    changed = bottom_k(hasher.hashes(new), k)
                    out.append((doc_before, len(text_before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(before), encode(changed), resemblance(before, changed, k), resemblance(before, own, k)))
                last, done = (None, place) if guest else ((doc, text, own), done)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs, id_col, text_col, rows).mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return neighbours(docs).withColumnRenamed("id", "doc_id")
