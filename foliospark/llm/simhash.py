"""SimHash near-duplicates, linked through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Shared, forget, least_hashed, materialize, row_hash, small_batches
from foliospark.llm.components import connected_components
from foliospark.llm.resemblance import BLOCK, JOINED, LIMIT, MARKS, MARKS_SCHEMA, common_shingles, marks, normal_digest, resemblance_links, shingle_set
from foliospark.llm.resemblance import SHINGLE as LIKE_SHINGLE
from foliospark.llm.sketch import Hasher

#: Fingerprints of the sample that shapes the routing tree: 16 a shard, but so many at least and at most.
SAMPLE, MOST_SAMPLE = 8192, 524_288
#: Fingerprints aimed at in a shard (a leaf of the routing tree), visitors included.
SHARD = 32768
#: Fingerprints below which a branch inside a shard is compared pair by pair.
LEAF = 256


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 for a text without words or a null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(p, seed) for p in parts]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 8192):
        ones += np.unpackbits(raw[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, and ``fp``: the fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t, shingle) for t in b.column(0).to_pylist()), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], names=[*names, "fp"])

    names = [id_col, *keep]
    rows = docs.select(F.col(text_col).alias("text_"), *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, fp bigint")


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, radius: int, tries: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a ball about it that leave the least pairs together; None if no ball parts the points.

    To the inside goes what is within the ball or outside it by no more than ``radius``; to the outside, what is outside.
    """
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        within = np.cumsum(np.bincount(_distance(points, v), minlength=65)) / len(points)
        inner, outer = within[np.minimum(np.arange(65) + radius, 64)], 1 - within
        cost = inner**2 + outer**2
        mu = int(cost.argmin())
        if max(inner[mu], outer[mu]) < 0.9 and (best is None or cost[mu] < best[0]):
            best = cost[mu], v, mu
    return best and best[1:]


class RoutingTree:
    """The upper levels of a vantage-point tree, grown from a sample of the fingerprints."""

    def __init__(self, sample: np.ndarray, total: int, shard: int, radius: int):
        self.radius, self.nodes, self.leaves = radius, [], 0
        sample = np.unique(sample)
        self.root = self._grow(sample, shard * len(sample) / max(total, 1))

    def _grow(self, points: np.ndarray, most: float) -> int:
        """The node's number; a leaf, which holds ``most`` points or has too few to go by, has one below 0."""
        found = _split(points, self.radius, 12) if len(points) > max(most, 8) else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        vantage, mu = found
        d, k = _distance(points, vantage), len(self.nodes)
        self.nodes.append(None)
        self.nodes[k] = (vantage, mu, self._grow(points[d <= mu + self.radius], most), self._grow(points[d > mu], most))
        return k

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (position, leaf): the shards that each fingerprint goes to.

        Two within the radius meet in a shard: at a node where a ball parts them, the triangle bound has
        the outer one at most ``radius`` beyond the ball, and so it goes to the inside too.
        """
        out, todo = [], [(self.root, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out.append((at, np.full(len(at), -node - 1)))
                continue
            vantage, mu, left, right = self.nodes[node]
            d = _distance(fps[at], vantage)
            todo += [(left, at[d <= mu + self.radius]), (right, at[d > mu])]
        return tuple(np.concatenate(x) for x in zip(*out))


class _Union:
    """Least label of each connected set of positions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.label[a], self.label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(nxt := self.label[self.label], self.label):
                self.label = nxt


def link_shard(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of distinct fingerprints, the position of the least one that it reaches by links within the radius."""
    order = np.argsort(fps)  # the least label is then the least fingerprint
    fps = fps[order]
    sets, todo = _Union(len(fps)), [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        points = fps[at]
        found = _split(points[:: len(at) // 2048 + 1], radius, 6) if len(at) > LEAF else None
        if found:
            d = _distance(points, found[0])
            todo += [at[d <= found[1] + radius], at[d > found[1]]]
            continue
        step = max(1, 2_000_000 // max(1, len(at)))
        for k in range(0, len(at), step):
            x, y = np.nonzero(_distance(points[k : k + step, None], points[None, k:]) <= radius)
            sets.link(at[k:][x], at[k:][y])
    out = np.empty(len(fps), int)
    out[order] = order[sets.label]
    return out


def fingerprint_links(distinct: DataFrame, radius: int = 3, sample: int = SAMPLE, shard: int = SHARD, most: int = MOST_SAMPLE) -> DataFrame:
    """Links ``(u, v)`` that join what lies within ``radius`` bits, of distinct fingerprints ``fp``.

    Exact for any tree: triangle bounds send each fingerprint to all shards where a pair of its own may be
    met. The tree is grown from 16 fingerprints for each shard to be, ``sample`` at least and ``most`` at most, until about
    ``shard`` of the table meet in a leaf; inside a shard the tree goes on. A leaf that outgrows four shards is dealt to
    blocks of two shards, each pair of which is compared, so that no task's memory grows with the table. A shard
    returns its components as stars, at most a row for each fingerprint that it holds; no list of pairs leaves it.
    """
    total = distinct.count()
    some = least_hashed(distinct, "fp", max(sample, min(most, 16 * total // shard)), total).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = RoutingTree(some, total, shard, radius)
    known = Shared(distinct.sparkSession, tree)  # at most a node for each sampled fingerprint

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            at, leaf = known.value.route(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(fps[at])], names=["leaf", "fp"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        root = link_shard(fps.view(np.uint64), radius)
        apart = root != np.arange(len(fps))
        return pd.DataFrame({"u": fps[apart], "v": fps[root[apart]]})

    routed = materialize(distinct.mapInArrow(route, "leaf int, fp bigint"), "routed")
    sizes = routed.groupBy("leaf").agg(F.count("*").alias("n_"))
    blocks = F.when(F.col("n_") > 4 * shard, F.ceil(F.col("n_") / (2 * shard))).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(i, own).alias("i_"), F.greatest(i, own).alias("j_")))
    # A count for each leaf, of which the tree has no more than sampled fingerprints.
    placed = routed.join(F.broadcast(sizes), "leaf").select("leaf", "fp", F.explode(pairs).alias("p_"))
    return placed.select("leaf", "fp", "p_.*").groupBy("leaf", "i_", "j_").applyInPandas(link, "u bigint, v bigint")


def with_marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, keep: tuple[str, ...], least: float) -> DataFrame:
    """``fingerprints`` and, for links by resemblance, ``key_`` of the text, ``digest_`` of its words and the marks of its five-word shingles."""
    common = common_shingles(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(LIKE_SHINGLE, 64)
        for b in batches:
            texts = b.column(0).to_pylist()
            fps = np.fromiter((simhash(t, shingle) for t in texts), np.uint64, len(b))
            sets = [shingle_set(hasher, t) for t in texts]
            digests = np.fromiter(map(normal_digest, texts), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64)), pa.array(digests.view(np.int64)), *marks(sets, common.value, least)], names=[*names, "key_", "fp", "digest_", *MARKS])

    names = [id_col, *keep]
    rows = docs.select(F.col(text_col).alias("text_"), *names, F.xxhash64(text_col).alias("key_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, fp bigint, digest_ bigint, {MARKS_SCHEMA}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, keep: tuple[str, ...] = (), sample: int = SAMPLE, shard: int = SHARD, resembling: float | None = None, block: int = BLOCK, joined: int = JOINED, limit: int = LIMIT) -> DataFrame:
    """``id_col``, ``keep``, ``fp``, ``component_id`` and ``root`` of every row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles, repeats included; a
    text of fewer words is one shingle; one without words, or a null, has fingerprint 0, which links like
    any other. Fingerprints within ``radius`` bits are linked; with ``resembling``, so are those of texts whose
    five-word shingles resemble each other so far, which three bits seldom reach. ``component_id`` is the least id
    reachable (null if all ids there are null), ``root`` the least fingerprint. Equal fingerprints are joined first,
    so copies cost one comparison. Repeated rows come back as often as they came; an empty table gives an empty one;
    other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, shingle, keep) if resembling is None else with_marks(docs, id_col, text_col, shingle, keep, resembling)
    marked = rows = materialize(rows, "fps")
    if resembling is not None:
        rows = materialize(marked.select(id_col, *keep, "fp"), "fps")
    distinct = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least_")), "distinct")
    near = materialize(fingerprint_links(distinct.select("fp"), radius, sample, shard), "near")
    links = near if resembling is None else resemblance_links(docs, text_col, marked, near, resembling, block, joined, limit)
    roots = materialize(connected_components(links), "roots")
    forget(near)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp").select(id_col, *keep, "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (null last), or of repeated ids the one whose
    row hashes least. Whole rows that repeat count once. Columns of any name and kind, maps too, come through."""
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), row_hash(docs).alias("row_"))
    classes = near_duplicates(rows, "id_", "text_", keep=("row_",), **how)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("id_").isNull().alias("last"), "id_", "row_")).alias("f"))
    first = materialize(first.select(F.col("f.id_").alias("first_id_"), F.col("f.row_").alias("first_row_")), "kept")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_"), F.col(id_col).alias("id_"), row_hash(docs).alias("row_"))
    same = (F.col("row_") == F.col("first_row_")) & F.col("id_").eqNullSafe(F.col("first_id_"))
    kept = own.join(first, same, "left_semi")
    repeated = materialize(kept.groupBy("row_", "id_").agg(F.count("*").alias("n_")).where("n_ > 1").select(F.col("id_").alias("first_id_"), F.col("row_").alias("first_row_")), "repeated")
    if not repeated.isEmpty():  # whole texts are only shuffled of rows that repeat
        twice = kept.join(repeated, same, "left_semi").groupBy("row_", "id_").agg(F.first("doc_").alias("doc_"))
        kept = kept.join(repeated, same, "left_anti").select("doc_").union(twice.select("doc_"))
    return kept.select("doc_.*")


def op6(docs: DataFrame) -> DataFrame:
    """The digest of ``near_duplicates`` that the query returns."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
