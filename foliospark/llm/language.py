"""Language identification: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Shared, aside, small_batches

#: What a model is fitted on at most: documents of each language, those of the least hashes, and windows of each document, evenly spaced.
FIT_DOCS, FIT_WINDOWS = 600, 8
#: Bytes of a window, which the network reads in both directions; hidden units of a direction; windows that are
#: read at once. Products of matrices of these sizes stay on one core.
WINDOW, HIDDEN, LANES = 64, 12, 600
#: The symbol after a text's last byte.
NONE = 256
UNKNOWN = "und"

_PLAIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_PLAIN_LETTER.search(text)) or any(map(str.isalpha, text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


@dataclass
class Direction:
    """The weights of one direction, by gates (update, reset, new): inputs (3H x 257), recurrent (3H x H), the new gate's inner bias (H x 1)."""

    inputs: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray

    def read(self, symbols: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T x H x B) along ``symbols`` (T x B); ``keep`` gets what the gradient needs of each step."""
        steps, lanes = symbols.shape
        n = len(self.bias)
        h, out = np.zeros((n, lanes), self.inputs.dtype), np.empty((steps, n, lanes), self.inputs.dtype)
        for t in range(steps):
            given = np.take(self.inputs, symbols[t], axis=1)
            own = self.recurrent @ h
            gates = _sigmoid(given[: 2 * n] + own[: 2 * n])
            z, r = gates[:n], gates[n:]
            inner = own[2 * n :] + self.bias
            new = np.tanh(given[2 * n :] + r * inner)
            if keep is not None:
                keep.append((h, z, r, inner, new))
            h = new + z * (h - new)
            out[t] = h
        return out

    def gradient(self, symbols: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time: the loss's derivatives by the weights, from those by the states."""
        n, steps = len(self.bias), len(symbols)
        d_given = np.empty((steps, 3 * n, symbols.shape[1]), d_out.dtype)
        d_recurrent, d_bias, d_h = np.zeros_like(self.recurrent), np.zeros_like(self.bias), 0
        for t in reversed(range(steps)):
            before, z, r, inner, new = kept[t]
            d_h = d_h + d_out[t]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z, d_r, d_inner = d_h * (before - new) * z * (1 - z), d_new * inner * r * (1 - r), d_new * r
            d_given[t, :n], d_given[t, n : 2 * n], d_given[t, 2 * n :] = d_z, d_r, d_new
            side = np.concatenate((d_z, d_r, d_inner))
            d_recurrent += side @ before.T
            d_bias += d_inner.sum(axis=1, keepdims=True)
            d_h = d_h * z + self.recurrent.T @ side
        flat = symbols.ravel()
        d_inputs = np.stack([np.bincount(flat, d_given[:, k].ravel(), NONE + 1) for k in range(3 * n)]).astype(d_out.dtype)
        return [d_inputs, d_recurrent, d_bias]


@dataclass
class Network:
    """Two directions, and what makes a position's logits of their states (C x 2H, C x 1)."""

    languages: list[str]
    forth: Direction
    back: Direction
    mix: np.ndarray
    shift: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [w for d in (self.forth, self.back) for w in (d.inputs, d.recurrent, d.bias)] + [self.mix, self.shift]

    def _states(self, symbols: np.ndarray, keep: tuple[list, list] | tuple[None, None] = (None, None)) -> np.ndarray:
        return np.concatenate((self.forth.read(symbols, keep[0]), self.back.read(symbols[::-1], keep[1])[::-1]), axis=1)

    def _odds(self, states: np.ndarray) -> np.ndarray:
        logits = self.mix @ states + self.shift
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def positions(self, symbols: np.ndarray) -> np.ndarray:
        """Each position's probabilities (T x C x B) for windows of symbols (T x B)."""
        return self._odds(self._states(symbols))

    def loss(self, symbols: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy of all positions that hold a byte, and its derivatives in the order of ``weights``."""
        kept: tuple[list, list] = ([], [])
        states = self._states(symbols, kept)
        odds = self._odds(states)
        held = symbols != NONE
        lanes, n = np.arange(symbols.shape[1]), len(self.forth.bias)
        value = float(-(np.log(odds[:, target, lanes] + 1e-30) * held).sum() / held.sum())
        odds[:, target, lanes] -= 1
        odds *= (held / held.sum()).astype(odds.dtype)[:, None, :]
        d_mix = (odds @ states.transpose(0, 2, 1)).sum(axis=0)
        d_states = self.mix.T @ odds
        forth = self.forth.gradient(symbols, kept[0], d_states[:, :n])
        back = self.back.gradient(symbols[::-1], kept[1], d_states[::-1, n:])
        return value, [*forth, *back, d_mix, odds.sum(axis=(0, 2))[:, None]]

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text of a buffer the mean of its positions' probabilities, and the shares of positions labelled with each language.

        ``bounds`` are the texts' limits in ``data``. Every byte is read, in windows from the text's start; windows of all
        texts are read side by side, ``LANES`` at once, so what is held doesn't grow with a text.
        """
        docs, c = len(bounds) - 1, len(self.languages)
        sums, votes = np.zeros((docs, c)), np.zeros((docs, c))
        sizes = np.diff(bounds)
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(docs), windows)
        first = bounds[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
        for at in range(0, len(owner), LANES):
            own, begin = owner[at : at + LANES], first[at : at + LANES]
            places = np.arange(WINDOW)[:, None] + begin
            held = places < bounds[own + 1]
            symbols = np.where(held, data[np.minimum(places, len(data) - 1)].astype(np.intp), NONE)
            odds = self.positions(symbols)
            best = odds.argmax(axis=1)
            np.add.at(sums, own, (odds * held[:, None, :]).sum(axis=0).T)
            np.add.at(votes, own, np.stack([((best == k) & held).sum(axis=0) for k in range(c)], axis=1))
        whole = np.maximum(sizes, 1)[:, None]
        return sums / whole, votes / whole


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 0, kind: type = np.float32) -> Network:
    """A network of small random weights, the same for a seed."""
    r = np.random.default_rng(seed)
    drawn = lambda rows, columns, scale: (r.standard_normal((rows, columns)) * scale).astype(kind)
    way = lambda: Direction(drawn(3 * hidden, NONE + 1, 0.3), drawn(3 * hidden, hidden, hidden**-0.5), np.zeros((hidden, 1), kind))
    return Network(languages, way(), way(), drawn(len(languages), 2 * hidden, (2 * hidden) ** -0.5), np.zeros((len(languages), 1), kind))


def trained(languages: list[str], windows: np.ndarray, target: np.ndarray, batch: int = 256, steps: int = 240, rate: float = 0.01, seed: int = 0) -> Network:
    """A network fitted by Adam on windows of symbols (T x N) and their languages' places.

    Languages are drawn alike often, and some windows are cut short, as short texts are.
    """
    net, r = fresh(languages, seed=seed), np.random.default_rng(seed)
    weights = net.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_language = [np.flatnonzero(target == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        picked = np.concatenate([r.choice(own, -(-batch // len(languages))) for own in by_language])
        length = np.where(r.random(len(picked)) < 0.5, r.integers(4, len(windows) + 1, len(picked)), len(windows))
        _, found = net.loss(np.where(np.arange(len(windows))[:, None] < length, windows[:, picked], NONE), target[picked])
        pace = rate * (1 - 0.9 * step / steps)
        for w, g, m, s in zip(weights, found, mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Rows with crc32 of the id's text 1 modulo 3; those without an id aren't, though nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_each: int = FIT_DOCS, windows_each: int = FIT_WINDOWS) -> pd.DataFrame:
    """``lang`` and ``window`` (bytes) of at most ``docs_each`` documents of each language, and ``windows_each`` windows of each of them.

    Only rows with a language, an id outside the held-out fold and a letter are taken, those of the least hashes: a
    fixed sample, whatever the partitions. A pass counts the languages, a second one passes about twice as many rows as are wanted.
    Languages are few: a row of each goes through the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("hash"))
    counted = known.groupBy("lang").count().collect()
    if not counted:
        return pd.DataFrame({"lang": [], "window": []})
    share = F.create_map(*(F.lit(x) for r in counted for x in (r["lang"], 2.0 * docs_each / r["count"] if r["count"] > 8 * docs_each else 1.0)))
    few = known.where(F.col("hash") <= (F.least(F.element_at(share, F.col("lang")), F.lit(1.0)) * 2.0 - 1.0) * 2.0**63)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))).where(F.col("rank") <= docs_each)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, text, h in zip(b["lang"], b["text"], b["hash"]):
                raw = text.encode("utf-8", "surrogatepass")
                total = -(-len(raw) // WINDOW)
                taken = np.unique(np.linspace(0, total - 1, min(windows_each, total)).astype(int))
                rows += [(lang, h, int(w), raw[w * WINDOW : (w + 1) * WINDOW]) for w in taken]
            yield pd.DataFrame(rows, columns=["lang", "hash", "place", "window"])

    return few.select("lang", "text", "hash").mapInPandas(cut, "lang string, hash bigint, place bigint, window binary").toPandas().sort_values(["lang", "hash", "place", "window"])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_each: int = FIT_DOCS, windows_each: int = FIT_WINDOWS) -> Network:
    """A network for the languages of ``docs`` outside the held-out fold, trained on the driver on a sample of stated bound."""
    small_batches(docs.sparkSession)
    found = sample(docs, lang_col, text_col, id_col, docs_each, windows_each)
    languages = sorted(set(found["lang"]))
    if len(languages) < 2:
        return fresh(languages)
    symbols = np.full((WINDOW, len(found)), NONE)
    for k, raw in enumerate(found["window"]):
        symbols[: len(raw), k] = np.frombuffer(raw, np.uint8)
    return trained(languages, symbols, np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object)))


def predict(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, its ``score`` (the mean of all positions' probabilities for it), and ``lang_share`` (of positions labelled so).

    Whole texts are read where they lie. A null text, one without a letter, and every text if no language is known, is
    ``und`` with a score and a share of 0. Of equal probabilities, the first language by code point is taken. Equal texts are predicted
    alike, whatever else their rows hold; an empty table gives an empty one; other columns pass through, but
    ``lang_pred``, ``score`` and ``lang_share`` are replaced.
    """
    small_batches(docs.sparkSession)
    kept, own = aside(docs.drop("lang_pred", "score", "lang_share"), "found_")
    names = kept.columns
    k = names.index(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    sent = Shared(docs.sparkSession, network)  # some 30 kB and a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        languages = np.array([*net.languages, UNKNOWN], object)
        for b in batches:
            texts = b.column(k).to_pylist()
            told = np.array([bool(net.languages) and has_letter(t) for t in texts], bool)
            raw = [t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, told)]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
            odds, shares = net.pooled(np.frombuffer(b"".join(raw), np.uint8), bounds)
            best = odds.argmax(axis=1) if net.languages else np.zeros(len(raw), int)
            pick = lambda x: np.where(told, x[np.arange(len(raw)), best], 0.0) if net.languages else np.zeros(len(raw))
            found = pa.StructArray.from_arrays([pa.array(languages[np.where(told, best, len(languages) - 1)], pa.string()), pa.array(np.minimum(pick(odds), 1.0)), pa.array(pick(shares))], names=["lang", "score", "share"])
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*names, "found_"])

    out = kept.mapInArrow(run, f"{kinds}, found_ struct<lang:string,score:double,share:double>")
    return out.select(*own, F.col("found_.lang").alias("lang_pred"), F.col("found_.score").alias("score"), F.col("found_.share").alias("lang_share"))


def op11(docs: DataFrame) -> DataFrame:
    """The language of every document, by a network that has seen none of the held-out fold."""
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_share")
