"""Benchmark decontamination by a broadcast hash set of test n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.llm.common import Shared, aside, forget, materialize, small_batches

#: Words of a window; an item with fewer is one window.
WINDOW = 13
#: Words of benchmark items in one broadcast, of some 40 bytes each and their vocabulary; more items make further passes over the documents.
BROADCAST_WORDS = 2_000_000

#: Bytes outside words become spaces and A-Z becomes a-z; bytes above 0x7F belong to words.
_FOLD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_WORD = bytes(b"x"[0] if b != 32 else 32 for b in _FOLD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Normalised words; none for a null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The windows of benchmark items in a few flat arrays, some 40 bytes a word: for each length, sorted hashes, a place where the window's words stand, for verification, and its items."""

    def __init__(self, items: list[tuple[list, str | None]], window: int = WINDOW):
        """``items`` are texts, each with the ids that have it."""
        self.vocabulary: dict[bytes, int] = {}
        self.names = [names for names, _ in items]
        listed = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)), np.uint32) for _, text in items]
        lengths = np.array([len(x) for x in listed], np.int64)
        self.words = np.concatenate([*listed, np.zeros(0, np.uint32)])
        begins = np.cumsum(lengths) - lengths
        #: By length of window: hashes, places, ends of the lists of items, the lists; and windows whose hash another has.
        self.known: dict[int, tuple] = {}
        sizes = np.minimum(lengths, window)
        for n in sorted({int(x) for x in sizes if x}):
            own = np.flatnonzero(sizes == n)
            counts = lengths[own] - n + 1
            owner = np.repeat(own, counts)
            place = np.repeat(begins[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            h = self._rolled([self.words[place + k].astype(np.uint64) for k in range(n)])
            order = np.lexsort((owner, h))
            h, owner, place = h[order], owner[order], place[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            rep = place[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
            same = np.ones(len(h), bool)
            for k in range(n):
                same &= self.words[place + k] == self.words[rep + k]
            others: dict[tuple, set] = {}
            for j in np.flatnonzero(~same).tolist():
                others.setdefault(tuple(self.words[place[j] : place[j] + n].tolist()), set()).update(self.names[owner[j]])
            keep = same & np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))  # an item once a window
            h, owner, place = h[keep], owner[keep], place[keep]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            self.known[n] = h[starts], place[starts], np.append(starts, len(h)), owner.astype(np.int32), others

    @staticmethod
    def _rolled(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set]:
        """Positions of the words inside occurrences of windows, and the items whose windows occur."""
        lookup = self.vocabulary.get
        ids = np.fromiter((lookup(w, 0) for w in found), np.uint64, len(found))
        hit, items = np.zeros(len(ids) + 1, np.int64), set()
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        seen: set[tuple[int, int]] = set()
        for n, (hashes, places, ends, owners, others) in self.known.items():
            if len(ids) < n:
                break
            at = np.flatnonzero(known[n:] == known[:-n])  # windows of benchmark words only
            if not len(at):
                continue
            h = self._rolled([ids[at + k] for k in range(n)])
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for k, j in zip(at[hashes[near] == h].tolist(), near[hashes[near] == h].tolist()):
                own = ids[k : k + n]
                if (self.words[places[j] : places[j] + n] == own).all():  # a hash alone proves nothing
                    if (n, j) not in seen:
                        seen.add((n, j))
                        for x in owners[ends[j] : ends[j + 1]].tolist():
                            items.update(self.names[x])
                elif tuple(own.tolist()) in others:
                    items |= others[tuple(own.tolist())]
                else:
                    continue
                hit[k] += 1
                hit[k + n] -= 1
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _spans(positions: np.ndarray) -> list[tuple[int, int]]:
    if not len(positions):
        return []
    breaks = np.flatnonzero(np.diff(positions) > 1)
    return list(zip(positions[np.r_[0, breaks + 1]].tolist(), (positions[np.r_[breaks, len(positions) - 1]] + 1).tolist()))


def pieces(benchmark: DataFrame, item_col: str, item_text: str, window: int, most_words: int) -> DataFrame:
    """The benchmark as ``words`` (normalised, space-joined) with the ``items`` that have them, and ``weight``: words and ids.

    Equal texts are one row with all their ids. Long ones are cut into ranges of windows, and long lists of ids into several, of a quarter of ``most_words`` at most,
    so that each window of each item stands in one row.
    """
    most = max(1, most_words // 4)
    kind = benchmark.schema[item_col].dataType.simpleString()

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" ".join(words(t)).decode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()], pa.string())], names=["item", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                found = text.split(" ")
                for at in range(0, max(1, len(found) - window + 1), most):
                    rows.append(k)
                    parts.append(" ".join(found[at : at + most + window - 1]))
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), pa.array(parts, pa.string())], names=["items", "words"])

    known = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("words")).mapInArrow(normal, f"item {kind}, words string").where("words <> ''")
    texts = known.groupBy("words", F.pmod(F.xxhash64("item"), F.lit(64)).alias("nth")).agg(F.collect_set("item").alias("items"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("items") - 1, F.lit(0)), F.lit(most)), lambda k: F.slice("items", k + 1, F.lit(most)))
    merged = texts.groupBy("words").agg(F.flatten(F.collect_list("items")).alias("items")).select(F.explode(chunks).alias("items"), "words")
    out = merged.mapInArrow(cut, f"items array<{kind}>, words string")
    return out.withColumn("weight", F.size(F.split("words", " ")) + F.size("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = BROADCAST_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word positions, end exclusive) and ``hit_items``.

    Windows of ``window`` item words (an item of fewer, but not none, is one window) are broadcast as a hash
    set; documents are scanned where they lie, without a shuffle, and each hit is verified word by word.
    The benchmark's ``pieces`` are weighed first: a broadcast holds about ``most_words`` words and ids, whatever repeats and however long an item is, and a larger
    benchmark is dealt over several passes, one set at a time. Then documents are written once, with a number; each pass writes the numbers and hits of
    those that it hits, and these are joined to the documents in the end, so their texts are written and shuffled once, whatever the passes. The
    result is the same. Item ids may be of any kind.
    A null text has no words, on either side. Items without an id add to spans but not to ``hit_items``;
    repeated items count once. Repeated documents are judged alike; very long texts are scanned whole, each in one task; other columns pass through, but the three
    names above are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = materialize(pieces(benchmark, item_col, item_text, window, most_words), "pieces")
    total = cut.agg(F.sum("weight")).first()[0] or 0
    passes = -(-total // most_words) or 1
    id_kind = benchmark.schema[item_col].dataType.simpleString()
    id_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    span_arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    own, names = aside(docs.drop("n_words", "hit_spans", "hit_items"), "row_", "spans_", "items_")
    out = own
    found_kinds = f"n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<{id_kind}>"

    def columns_of(df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def hits(df: DataFrame, known: Shared, every: bool) -> DataFrame:
        """The columns of ``df`` with what a set finds; not ``every`` row, but those with a hit."""
        left, at_text = df.columns, df.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                count, spans, owners = [], [], []
                for t in b.column(at_text).to_pylist():
                    found = words(t)
                    at, who = known.value.scan(found)
                    count.append(len(found))
                    spans.append([{"start": x, "end": y} for x, y in _spans(at)])
                    owners.append(sorted(who))
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(count, pa.int64()), pa.array(spans, span_arrow), pa.array(owners, pa.list_(id_arrow))], names=[*left, "n_words", "hit_spans", "hit_items"])
                yield out if every else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

        return df.mapInArrow(run, f"{columns_of(df)}, {found_kinds}")

    def windows(k: int) -> Shared | None:
        part = cut.where(F.pmod(F.xxhash64("words", "items"), F.lit(passes)) == k).select("items", "words").collect()  # about most_words
        return Shared(spark, Windows([(r["items"], r["words"]) for r in part], window)) if part or passes == 1 else None

    if passes == 1:
        known = windows(0)
        forget(cut)
        return hits(out, known, True).select(*names, "n_words", "hit_spans", "hit_items")
    numbered = materialize(out.withColumn("row_", F.monotonically_increasing_id()), "numbered")  # fixed once it is written
    parts = []
    for k in range(passes):
        known = windows(k)
        if known:
            parts.append(materialize(hits(numbered.select("row_", text_col), known, False).select("row_", "hit_spans", "hit_items"), "pass"))
    forget(cut)
    all_hits = parts[0]
    for p in parts[1:]:
        all_hits = all_hits.unionByName(p)
    merged = materialize(all_hits.groupBy("row_").agg(F.flatten(F.collect_list("hit_spans")).alias("spans_"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("items_")), "hits")
    forget(*parts)
    both = numbered.join(merged, "row_", "left").select(*out.columns, "spans_", "items_")
    rest, at_text = out.columns, out.columns.index(text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = [len(words(t)) for t in b.column(at_text).to_pylist()]
            spans = [[{"start": x, "end": y} for x, y in _merge([(x["start"], x["end"]) for x in s or []])] for s in b.column(len(rest)).to_pylist()]
            owners = [x or [] for x in b.column(len(rest) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(count, pa.int64()), pa.array(spans, span_arrow), pa.array(owners, pa.list_(id_arrow))], names=[*rest, "n_words", "hit_spans", "hit_items"])

    return both.mapInArrow(whole, f"{columns_of(out)}, {found_kinds}").select(*names, "n_words", "hit_spans", "hit_items")


def n_hit() -> F.Column:
    return F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)")


def is_contaminated(share: int = 20) -> F.Column:
    """A document is contaminated if one word in ``share`` is hit."""
    return (n_hit() > 0) & (share * n_hit() >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, with the columns of ``docs``."""
    moved, own = aside(docs, "n_words", "hit_spans", "hit_items")
    return contamination(moved, benchmark).where(~is_contaminated(share)).select(*own)


def cut_spans(text: str | None, spans: list) -> str | None:
    """The text without the words of ``spans``, from each span's first word through its last."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(raw.translate(_WORD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["start"]]])
        at = ends[s["end"] - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words cut out of their texts."""
    moved, own = aside(docs, "n_words", "hit_spans", "hit_items")
    found = contamination(moved, benchmark, text_col)
    names = moved.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            cut = pa.array([cut_spans(t, s) for t, s in zip(b.column(k).to_pylist(), b.column("hit_spans").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([cut if i == k else b.column(i) for i in range(len(names))], names=names)

    return found.select(*(f"`{c}`" for c in names), "hit_spans").mapInArrow(run, schema).select(*own)


def items_digest() -> F.Column:
    ids = F.array_sort(F.transform(F.array_distinct("hit_items"), lambda x: x.cast("string")))
    return F.sha2(F.array_join(ids, ","), 256)


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination`` that the query returns."""
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"), items_digest().alias("items_sha256"), is_contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), (SELECT DISTINCT n FROM bw) WHERE k + n - 1 <= len(w)),
hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN bw USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
