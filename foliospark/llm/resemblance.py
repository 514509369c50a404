"""Links between texts whose sets of shingles resemble each other, without a lost pair and without all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Shared, forget, materialize
from foliospark.llm.components import connected_components
from foliospark.llm.sketch import Hasher

#: Words of a shingle.
SHINGLE = 5
#: Texts whose shingles tell which are common, and common shingles told to all tasks. Both shape an order alone.
ORDER_TEXTS, ORDER_SHINGLES = 8192, 262_144
#: Shared shingles of a text's prefix that it is first met by.
FIRST = 3
#: Texts under one shingle from which they are compared in blocks instead of joined.
JOINED = 16
#: Texts of one kind in a block, at least, and blocks that they are dealt to before blocks grow, to ``LARGEST`` times as many texts.
BLOCK, GRID, LARGEST = 2048, 32, 32
#: Nearest ones that a text and block give in the first whole round.
LIMIT = 64
#: Rows of blocks that a task is given, about.
TASK_ROWS = 65_536
#: Bytes of the parities that blocks are compared by, at most, and of those of the pairs that are compared at once.
BRIEF, PAIR_BYTES = 512, 4 << 20


def normal_digest(text: str | None) -> int:
    """A hash of the text's words, so that copies that differ in case (A-Z) or white space alone are one text."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()))


def shingle_set(hasher: Hasher, text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending."""
    return np.unique(hasher.hashes(text))


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each place of a table, a power of two over twice the number of hashes: whether an odd number of them falls there."""
    size = max(128, 1 << (2 * len(hashes)).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def folded(tables: np.ndarray, size: int) -> np.ndarray:
    """Parities (a row each) in tables of ``size`` bytes: those of the same hashes in fewer places."""
    return np.bitwise_xor.reduce(tables.reshape(len(tables), -1, size), axis=1)


def least_apart(x: bytes, y: bytes) -> int:
    """Hashes that only one of two sets has, at least, by their parities; the longer table is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)))
    return int(np.bitwise_count(a ^ b).sum())


def common_shingles(docs: DataFrame, text_col: str) -> Shared:
    """Hashes of the shingles that several texts of a fixed sample have, and their places, the most common last.

    They order the shingles of a text; any order gives the same links, a good one keeps what many texts share out of
    prefixes. At most ``ORDER_SHINGLES`` hashes, of at most about ``ORDER_TEXTS`` texts.
    """
    share = min(1.0, ORDER_TEXTS / max(docs.count(), 1))
    # Copies count once; the part of hashes sampled is that of the rows wanted.
    some = docs.select(F.xxhash64(text_col).alias("digest_"), F.col(text_col).alias("text_")).where(F.col("digest_") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SHINGLE, 64)
        for b in batches:
            sets = [shingle_set(hasher, t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["h_"])

    once = some.groupBy("digest_").agg(F.first("text_").alias("text_"))
    counts = once.mapInArrow(run, "h_ bigint").groupBy("h_").agg(F.count("*").alias("n_")).where("n_ > 1")
    found = np.array([r["h_"] for r in counts.orderBy(F.col("n_").desc(), "h_").limit(ORDER_SHINGLES).collect()], np.int64).view(np.uint64)
    by_hash = np.argsort(found)
    return Shared(docs.sparkSession, (found[by_hash], len(found) - by_hash))


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set in an order with common ones last: so many that fewer than a resembling set has in common are left."""
    if not len(hashes):
        return hashes
    known, place = common
    most = len(hashes) - int(np.ceil(least * len(hashes) - 1e-6)) + 1
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, place[at], 0), kind="stable")]
    return hashes[:most]


def marks(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], least: float) -> list[pa.Array]:
    """``n_``, ``tokens_``, ``bits_`` and ``brief_`` of texts' sets of shingles; those whose ``bits_`` are brief have no others."""
    bits = [parities(s) for s in sets]
    return [
        pa.array([len(s) for s in sets], pa.int32()),
        pa.array([prefix(s, common, least).view(np.int64) for s in sets], pa.list_(pa.int64())),
        pa.array(bits, pa.binary()),
        pa.array([folded(np.frombuffer(x, np.uint8)[None], BRIEF).tobytes() if len(x) > BRIEF else None for x in bits], pa.binary()),
    ]


MARKS = ["n_", "tokens_", "bits_", "brief_"]
MARKS_SCHEMA = "n_ int, tokens_ array<bigint>, bits_ binary, brief_ binary"


def compare(pdf: pd.DataFrame, least: float, limit: int) -> pd.DataFrame:
    """Pairs (a_, b_) of a block that may resemble each other by ``least`` and have different roots, ``limit`` at most for each row: its nearest.

    Sides: rows of side 0 are held against those of side 1, those of side 2 against each other. ``more_`` marks rows that have further pairs.
    """
    digest, n, at, root, side = (pdf[c].to_numpy() for c in ("digest_", "n_", "at_", "root_", "side_"))
    length = pdf["brief_"].map(len).to_numpy()
    bits = np.zeros((len(pdf), length.max(initial=0)), np.uint8)
    for size in np.unique(length):
        bits[length == size, :size] = np.frombuffer(b"".join(pdf["brief_"][length == size]), np.uint8).reshape(-1, size)
    ys = np.flatnonzero(side != 0)
    xs = np.flatnonzero(side != 1)
    if (side == 2).all():  # any pair of different roots has one that isn't of the most frequent
        names, counts = np.unique(root, return_counts=True)
        xs = xs[root[xs] != names[counts.argmax()]]
    a, b, more = [], [], []
    step = max(1, 250_000 // max(1, len(ys)))
    share = (1 - least) / (1 + least)
    for k in range(0, len(xs), step):
        x = xs[k : k + step]
        both = n[x][:, None] + n[ys][None, :]
        fits = (root[x][:, None] != root[ys][None, :]) & (np.minimum(n[x][:, None], n[ys][None, :]) >= least * np.maximum(n[x][:, None], n[ys][None, :]) - 1e-6)
        fits &= at[x][:, None] + at[ys][None, :] <= share * both + 1e-6  # what comes before the first common shingle is apart
        i, j = np.nonzero(fits)
        apart = np.zeros(len(i), np.int64)
        small, large = np.minimum(length[x[i]], length[ys[j]]), np.maximum(length[x[i]], length[ys[j]])
        for size in np.unique(small):  # the longer table of a pair is folded
            for wide in np.unique(large[small == size]):
                of = np.flatnonzero((small == size) & (large == wide))
                few = max(1, PAIR_BYTES // int(wide))
                for start in range(0, len(of), few):
                    some = of[start : start + few]
                    apart[some] = np.bitwise_count(folded(bits[x[i[some]], :wide] ^ bits[ys[j[some]], :wide], size)).sum(axis=1)
        near = apart <= share * both[i, j] + 1e-6
        i, j, apart = i[near], j[near], apart[near]
        order = np.lexsort((digest[ys[j]], apart, i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        a.append(digest[x[i[nth < limit]]])
        b.append(digest[ys[j[nth < limit]]])
        more.append(np.isin(i[nth < limit], i[nth >= limit]))
    a, b, more = (np.concatenate([*p, np.zeros(0, t)]) for p, t in ((a, np.int64), (b, np.int64), (more, bool)))
    return pd.DataFrame({"a_": np.maximum(a, b).astype(np.int64), "b_": np.minimum(a, b).astype(np.int64), "more_": more.astype(bool)})


def blocks(n: Column, block: int) -> Column:
    """Blocks that ``n`` texts are dealt to: each of ``block`` texts, up to ``GRID`` of them, which then grow, to ``LARGEST`` times as many texts."""
    return F.greatest(F.lit(1), F.least(F.ceil(n / block), F.greatest(F.lit(GRID), F.ceil(n / (LARGEST * block))))).cast("int")


def to_blocks(many: DataFrame, whole: bool, block: int = BLOCK) -> DataFrame:
    """Texts under a shingle (token_, digest_, root_, total_, c_, top_root_) with the blocks (i_, j_) that they come to, and their ``side_`` there.

    Texts of the most frequent root are dealt to blocks, and the others to blocks of their own; each block of the others meets each of these, and each
    of its own kind, so that any two texts meet once, and a text comes to no more than all blocks: rows grow with the texts until blocks are of the largest size.
    If not ``whole``, texts meet the first block of either kind alone, and their own.
    """
    nth = lambda n: F.pmod(F.xxhash64("digest_", F.lit(7)), n).cast("int")
    place = lambda i, j, side: F.struct(i.cast("int").alias("i_"), j.cast("int").alias("j_"), side.cast("int").alias("side_"))
    small = F.array(place(F.lit(-1), F.lit(-1), F.lit(2)))
    top, mine, theirs = F.col("root_") == F.col("top_root_"), blocks(F.col("total_") - F.col("c_"), block), blocks(F.col("c_"), block)
    own = nth(mine)
    reach = theirs if whole else F.least(theirs, F.lit(1))
    to_top = F.transform(F.sequence(F.lit(0), reach - 1), lambda j: place(-2 - own, j, F.lit(0)))
    from_top = F.transform(F.sequence(F.lit(0), mine - 1), lambda i: place(-2 - i, nth(theirs), F.lit(1)))
    from_top = from_top if whole else F.when(nth(theirs) == 0, from_top)
    to_own = F.transform(F.filter(F.sequence(F.lit(0), mine - 1), lambda i: F.lit(whole) | (i == own) | (i == 0) | (own == 0)), lambda i: place(F.least(i, own), F.greatest(i, own), F.when(i == own, 2).when(own < i, 0).otherwise(1)))
    places = F.when(F.col("total_") <= block, small).when(top, from_top).otherwise(F.concat(to_top, to_own))
    return many.select("token_", "digest_", "n_", "at_", "root_", "brief_", F.explode(places).alias("p_")).select("token_", "digest_", "n_", "at_", "root_", "brief_", "p_.*")


def candidates(met: DataFrame, least: float, limit: int, whole: bool, hot: bool, block: int = BLOCK, joined: int = JOINED) -> tuple[DataFrame, DataFrame]:
    """Pairs (a_, b_) of texts that meet under a shingle and may resemble each other, of different roots, and the shingles (token_) whose blocks have further pairs.

    Up to ``joined`` texts under a shingle are joined. Of more, blocks are compared inside tasks: the texts of the
    most frequent root are dealt to blocks once, and the others come to each of these and to blocks of pairs of
    their own. If not ``whole``, each of them only comes to its own block and the first ones: enough to find those near
    a group's bulk, not all. If ``hot``, only blocks are compared: joins leave no pair out, so once is enough.
    """
    counts = met.groupBy("token_", "root_").agg(F.count("*").alias("c_"))
    tokens = counts.groupBy("token_").agg(F.sum("c_").alias("total_"), F.count("*").alias("roots_"), F.max(F.struct("c_", "root_")).alias("top_")).where("roots_ > 1")
    tokens = materialize(tokens.select("token_", "total_", F.col("top_.c_").alias("c_"), F.col("top_.root_").alias("top_root_")), "tokens")
    few = met.join(tokens.where((F.col("total_") <= joined) & F.lit(not hot)), "token_").select("token_", "digest_", "n_", "at_", "root_")
    few = materialize(few, "few")
    other = few.toDF("token_", "b_", "bn_", "bat_", "broot_")
    share = (1 - least) / (1 + least)
    both = F.col("n_") + F.col("bn_")
    fits = (F.col("digest_") > F.col("b_")) & (F.col("root_") != F.col("broot_")) & (F.least("n_", "bn_") >= least * F.greatest("n_", "bn_") - 1e-6) & (F.col("at_") + F.col("bat_") <= share * both + 1e-6)
    pairs = few.join(other, "token_").where(fits).select(F.col("digest_").alias("a_"), "b_")
    many = met.join(tokens.where(F.col("total_") > joined), "token_")

    dealt = to_blocks(many, whole, block)
    # Blocks are dealt to tasks by their number of rows, whatever the session's number of shuffle partitions.
    off = F.col("total_") - F.col("c_")
    sent = F.when(F.col("total_") <= block, F.col("total_")).otherwise(F.col("c_") * blocks(off, block) + off * (blocks(off, block) + (blocks(F.col("c_"), block) if whole else 1)))
    total = tokens.where(F.col("total_") > joined).agg(F.sum(sent)).first()[0] or 0
    parts = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // TASK_ROWS) + 1)
    one = lambda key, pdf: compare(pdf, least, limit).assign(token_=key[0])
    found = materialize(dealt.repartition(parts, "token_", "i_", "j_").groupBy("token_", "i_", "j_").applyInPandas(one, "a_ bigint, b_ bigint, more_ boolean, token_ bigint"), "found")
    again = materialize(found.where("more_").select("token_").distinct(), "again")
    out = materialize(pairs.union(found.select("a_", "b_")).distinct(), "pairs")
    forget(tokens, few, found)
    return out, again


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The hashes in each row of a column of lists."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends[:-1])


def bounded(numbers: DataFrame, most: int = 250_000) -> DataFrame:
    """A table of a few numbers a row, broadcast if it has no more than ``most`` rows: some 6 MB."""
    return F.broadcast(numbers) if numbers.count() <= most else numbers


def verified(docs: DataFrame, text_col: str, texts: DataFrame, pairs: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Of the pairs (a_, b_) of digests those whose whole sets of shingles resemble each other by ``least``, as links (u, v) of fingerprints.

    Whole sets are made anew from the texts, and only of pairs that sizes and parities leave possible; with
    ``nearest``, only of each text's nearest one by parities.
    """
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (1 - least) / (1 + least) * b.column(2).to_numpy() + 1e-6
            apart = np.array([least_apart(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(apart)], names=["a_", "b_", "apart_"]).filter(pa.array(apart <= most))

    wanted = materialize(pairs.select(F.col("a_").alias("digest_")).union(pairs.select("b_")).distinct(), "wanted")
    known = texts.select("digest_", "n_", "bits_").join(bounded(wanted), "digest_", "left_semi")
    both = pairs.select("a_", "b_").join(known.toDF("a_", "an_", "x_"), "a_").join(known.toDF("b_", "bn_", "y_"), "b_")
    left = both.select("a_", "b_", F.col("an_") + F.col("bn_"), "x_", "y_").mapInArrow(possible, "a_ bigint, b_ bigint, apart_ bigint")
    if nearest:
        left = left.groupBy("a_").agg(F.min(F.struct("apart_", "b_")).alias("m_")).select("a_", "m_.b_", "m_.apart_")
    left = materialize(left.select("a_", "b_"), "left")
    needed = materialize(left.select(F.col("a_").alias("digest_")).union(left.select("b_")).distinct(), "needed")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SHINGLE, 64)
        for b in batches:
            sets = [shingle_set(hasher, t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64())), b.column(2)], names=["digest_", "hashes_", "fp"])

    keys = materialize(texts.select("digest_", "fp", "key_").join(bounded(needed), "digest_", "left_semi"), "keys")
    own = docs.select(F.xxhash64(text_col).alias("key_"), F.col(text_col).alias("text_")).join(bounded(keys), "key_").select("digest_", "text_", "fp")
    # Copies become one row before they are shuffled, by digest alone.
    sets = materialize(own.mapInArrow(hashed, "digest_ bigint, hashes_ array<bigint>, fp bigint").groupBy("digest_").agg(F.first("hashes_").alias("hashes_"), F.first("fp").alias("fp")), "sets")

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, y in zip(_lists(b.column(2)), _lists(b.column(3))):
                both = np.sort(np.concatenate((x, y)))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                found.append(common >= least * (len(both) - common) if len(both) else True)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(found, pa.bool_()))

    both = left.join(sets.toDF("a_", "own_", "u"), "a_").join(sets.toDF("b_", "other_", "v"), "b_")
    out = materialize(both.select("u", "v", "own_", "other_").mapInArrow(like, "u bigint, v bigint"), "like")
    forget(wanted, left, needed, keys, sets)
    return out


def resemblance_links(docs: DataFrame, text_col: str, rows: DataFrame, near: DataFrame, least: float, block: int = BLOCK, joined: int = JOINED, limit: int = LIMIT) -> DataFrame:
    """Links ``(u, v)`` that, with those of ``near``, join the fingerprints of all texts whose sets of five-word shingles resemble each other by ``least`` or more.

    ``rows``, which is used up, has ``digest_``, ``key_`` (the hash of the text as it is), ``fp`` and the ``marks`` of each row. Two such texts have their first common shingle in
    both prefixes, so they meet. In a first round each text meets others under a few shingles and is held against its
    nearest one; that joins most. Then all texts of different components that meet are compared, ``limit`` nearest
    ones for a text and block, in rounds of a growing limit, until no text has more: then no pair is left
    that resembles and isn't joined. All is decided on whole sets.
    """
    one = [F.first(c).alias(c) for c in ("fp", "key_", *MARKS)]
    whole_texts = materialize(rows.select("digest_", "fp", "key_", *MARKS).groupBy("digest_").agg(*one), "texts")
    forget(rows)
    held = whole_texts.select("digest_", "n_", F.posexplode("tokens_").alias("at_", "token_"))
    # Of two texts, what comes before the first common shingle is apart: together it can't exceed a share of both sizes.
    slack = (1 - least) / (1 + least) * F.col("n_") - F.col("at_") + 1e-6
    again = held.groupBy("token_").agg(F.count("*").alias("c_"), F.max(slack).alias("most_")).where("c_ > 1 AND most_ >= 0").select("token_", "most_")
    met = materialize(held.join(again, "token_").where(slack + F.col("most_") >= 0).drop("most_"), "met")
    texts = whole_texts
    nth = F.struct("at_", "token_")
    least_tokens = F.array_sort(F.collect_list(nth))  # as many as a text's prefix has at most
    first = met.groupBy("digest_", "n_").agg(F.slice(least_tokens, 1, FIRST).alias("t_")).select("digest_", "n_", F.explode("t_").alias("t_")).select("digest_", "n_", "t_.at_", "t_.token_")
    links, whole, hot, stars = near.select("u", "v"), False, False, []
    while True:
        roots = materialize(connected_components(links), "roots")
        named = materialize(texts.select("digest_", "fp", F.coalesce("brief_", "bits_").alias("brief_")).join(roots.toDF("fp", "root_"), "fp", "left").select("digest_", "brief_", F.coalesce("root_", "fp").alias("root_")), "named")
        pairs, again = candidates((met if whole else first).join(named, "digest_"), least, limit, whole, hot, block, joined)
        found = verified(docs, text_col, texts, pairs, least, not whole)
        forget(*stars, named, pairs)
        stars = [roots, found]  # what was joined so far is a link a node
        links = roots.where("node <> root").toDF("u", "v").union(found)
        if whole:
            done, before = again.isEmpty(), met
            if not done:  # shingles without further pairs are settled
                met = materialize(met.join(again, "token_", "left_semi"), "met")
            forget(before)
            if done:
                forget(texts, again)
                return links
        forget(again)
        limit, whole, hot = limit * 8 if whole else limit, True, whole
