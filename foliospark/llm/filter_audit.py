"""Filter interaction audit: what each filter removes, in every order that they could be applied in."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import small_batches

#: Filters by bit: few words, few distinct words, many capitals, symbols, copies. Their limits are fixed values.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))
_BEGINS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

#: Bytes of texts that are scanned at once; a longer text is scanned alone.
SCAN_BYTES = 1 << 22
#: An odd multiplier and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of a number modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes, given in order: differences of a prefix sum, brought to a common power.

    Sums are taken over runs of slices of about ``SCAN_BYTES``, so a long text needs no more; a slice's hash is the same in any run.
    """
    h, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, lo + SCAN_BYTES, "right")))
        part = data[lo : ends[upto - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(part)), out=sums[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        h[at:upto] = (sums[e] - sums[s]) * powers(_INVERSE, len(part))[s] ^ (e - s).astype(np.uint64) * _MIX
        at = upto
    return h


def same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of ``size`` bytes that begin at ``left`` and at ``right`` are equal, 8 bytes at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    same = np.ones(len(left), bool)
    long = size > 256
    for k in np.flatnonzero(long):
        same[k] = data[left[k] : left[k] + size[k]].tobytes() == data[right[k] : right[k] + size[k]].tobytes()
    todo, at = np.flatnonzero(~long & (size > 0)), 0
    while len(todo):
        a, b = words[left[todo] + at].view("<u8").ravel(), words[right[todo] + at].view("<u8").ravel()
        kept = np.minimum(size[todo] - at, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - kept) * np.uint64(8))
        same[todo] &= ((a ^ b) & mask) == 0
        at += 8
        todo = todo[(size[todo] > at) & same[todo]]
    return same


def counts(data: np.ndarray, offsets: np.ndarray, hashes=word_hashes) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text of a buffer.

    ``offsets`` bound the texts in ``data``. Classes of bytes are looked up and summed along the buffer, so a text's
    count is a difference. Its words' hashes are sorted, and neighbours with equal hashes are held against each other
    byte by byte; where two unlike words share one, the text's words are counted as such.
    """
    docs = len(offsets) - 1
    
    def between(found: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(found) + 1, np.int32)  # an Arrow text is shorter than that
        np.cumsum(found, out=sums[1:])
        return np.diff(sums[offsets].astype(np.int64))

    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words don't go on from one text to the next
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before |= edge[:-1]
    after |= edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(owner, minlength=docs)
    h = hashes(data, starts, ends)
    order = np.lexsort((ends - starts, h, owner))
    owner, h, starts, size = owner[order], h[order], starts[order], (ends - starts)[order]
    alike = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1])
    pairs = np.flatnonzero(alike)
    equal = size[pairs] == size[pairs + 1]
    equal[equal] = same_bytes(data, starts[pairs[equal]], starts[pairs[equal] + 1], size[pairs[equal]])
    distinct = words - np.bincount(owner[pairs[equal] + 1], minlength=docs)
    for k in np.unique(owner[pairs[~equal]]):  # a hash of several words
        mine = owner == k
        distinct[k] = len({data[a : a + n].tobytes() for a, n in zip(starts[mine], size[mine])})
    return {"words": words, "distinct": distinct, "capitals": between(_CAPITAL[data]), "chars": between(_BEGINS[data]), "symbols": between(_SYMBOL[data])}


def failures(found: dict[str, np.ndarray]) -> np.ndarray:
    """Bits of the filters A to D that texts with such counts fail."""
    few = found["words"] < LEAST_WORDS
    dull = 100 * found["distinct"] < DISTINCT_PERCENT * found["words"]
    loud = 100 * found["capitals"] > CAPITAL_PERCENT * found["chars"]
    return (few * 1 + dull * 2 + loud * 4 + (found["symbols"] > 0) * 8).astype(np.int32)


def masks_of(texts: pa.Array) -> np.ndarray:
    """Bits of A to D for an Arrow array of texts, read from its buffers; a null is an empty text."""
    texts = texts.cast(pa.large_binary())
    out = np.zeros(len(texts), np.int32)
    if not len(texts):
        return out
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(bounds) * ~np.asarray(texts.is_null())
    at = 0
    while at < len(texts):
        size = np.cumsum(lengths[at:])
        upto = at + max(1, int(np.searchsorted(size, SCAN_BYTES, "right")))
        if (lengths[at:upto] == np.diff(bounds[at : upto + 1])).all():
            part, offsets = data[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at]
        else:  # a null over bytes that don't count
            part = np.concatenate([data[bounds[k] : bounds[k] + lengths[k]] for k in range(at, upto)])
            offsets = np.concatenate(([0], np.cumsum(lengths[at:upto])))
        out[at:upto] = failures(counts(part, offsets))
        at = upto
    return out


def with_masks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``mask_``, the bits of the filters A to D that a text fails, instead of the text."""
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name != text_col}
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = [b.column(n) for n in kinds]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(masks_of(b.column(k)), pa.int32())], names=[*kinds, "mask_"])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in kinds.items()), "mask_ int"]))


def failing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of a part fail just the filters of a mask, and how many of them are labelled.

    A document is a copy if a lesser id has its text, by SHA-256. The least id of each text is found with partial
    sums, and is joined on text and id: the join's groups are rows of one id, so no group of copies lies in one task.
    Rows without an id are no copies and have none. A document labelled more than once counts as good, or toxic, if a label says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id_"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good_"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic_"))
    flags = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest_"), text.alias("text_"))
    flags = with_masks(flags, "text_").groupBy("id_", "digest_", "part", "mask_").agg(F.count("*").alias("rows_"))
    least = flags.where("id_ IS NOT NULL").groupBy("digest_").agg(F.min("id_").alias("id_")).withColumn("least_", F.lit(True))
    copy = F.col("id_").isNotNull() & F.col("least_").isNull()
    marked = flags.join(least, ["digest_", "id_"], "left").join(known, "id_", "left")
    marked = marked.select("part", F.col("mask_").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"), "rows_", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good_", "toxic_")))
    return marked.groupBy("part", "mask").agg(F.sum("rows_").alias("n"), F.sum(F.col("rows_") * F.col("good_")).alias("good"), F.sum(F.col("rows_") * F.col("toxic_")).alias("toxic"))


def with_steps(df: DataFrame) -> DataFrame:
    """Every row with each ``filter_order`` and ``step``: 600 rows, with the ``bit`` of the step's filter and the bits of those ``before`` it."""
    every = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    out = df.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda k: F.instr("filter_order", FILTERS[k])
    bits = lambda holds: sum((F.when(holds(k), 1 << k).otherwise(0) for k in range(len(FILTERS))), F.lit(0))
    return out.withColumns({"bit": bits(lambda k: place(k) == F.col("step")), "before": bits(lambda k: place(k) < F.col("step"))})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step: what is kept, removed, redundant, and lost by it.

    Texts are scanned where they lie, in Arrow's buffers; a document becomes a mask of the filters that it fails, and
    masks are counted by part: at most 32 rows a part, from which all 120 orders follow. Of ``k`` filters that a
    document fails, each is the first in 120 / k orders, which is its share of ``shapley``.

    A null text is an empty one; a null part is the empty one. Rows of equal id and text count each, and none is
    a copy of the other; see ``failing`` for null ids and repeated labels. Very long texts are scanned alone.
    An empty table gives no rows, as it has no parts. Further columns are not read, whatever their names.
    """
    has = lambda x: F.col("mask").bitwiseAND(F.col(x)) != 0
    total = lambda what, where: F.sum(F.when(where, F.col(what)).otherwise(0)).cast("bigint")
    found = with_steps(failing(docs, labels, id_col, text_col, part_col))
    removed = has("bit") & ~has("before")
    own: Column = F.when(has("bit"), F.col("n") * F.lit(120) / F.bit_count("mask")).otherwise(0)
    return found.groupBy("part", "filter_order", "step").agg(
        total("n", ~has("bit") & ~has("before")).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", has("bit") & has("before")).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        F.sum(own).cast("bigint").alias("shapley"),
    )


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters by language."""
    return audit(docs, labels)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least_ids AS (SELECT text, min(doc_id) AS least_id FROM w GROUP BY text),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b, 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) AS c,
    regexp_matches(w.text, '[#$%&*|]') AS d, coalesce(w.doc_id > least_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN least_ids l ON w.text = l.text LEFT JOIN known k ON w.doc_id = k.doc_id),
m AS (SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
o AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM x p, x q, x r, x s, x t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before FROM o, range(1, 6) g(i)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
