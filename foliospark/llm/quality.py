"""A quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import aside, least_hashed, small_batches

#: Labelled rows that a model is fitted on at most.
FIT_ROWS = 20_000
#: A document is kept from this score on.
THRESHOLD = 0.3

STATISTICS = (
    "n_bytes_log", "n_words_log", "n_lines_log", "word_length", "longest_word", "words_per_line", "words_per_stop",
    "upper_share", "digit_share", "mark_share", "symbol_share", "bang_share", "pipe_share", "high_share", "short_word_share",
    "marked_word_share", "capital_word_share", "distinct_word_share", "distinct_pair_share", "top_word_share", "repeated_line_share", "long_line_share", "letter_entropy",
)

_UPPER, _LOWER, _DIGIT = np.zeros((3, 256), bool)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK = np.isin(np.arange(256), list(b".,;:?!'\"()-"))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~!"))
_HIGH = np.arange(256) > 127
_LAST_SYMBOL = frozenset(int(x) for x in np.flatnonzero(_SYMBOL))


def statistics(text: str | None) -> tuple[float, ...]:
    """The ``STATISTICS`` of a whole text; all 0 for an empty text or a null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = len(words), max(1, len(raw) - int(at[9:14].sum()) - int(at[32]))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = [len(x) for x in words]
    letters = np.concatenate((at[65:91] + at[97:123], [at[128:].sum()]))
    p = letters[letters > 0] / max(1, letters.sum())
    share = lambda mask: int(at[mask].sum()) / m
    return (
        float(np.log1p(len(raw))), float(np.log1p(n)), float(np.log1p(len(lines))), m / n, float(min(max(lengths), 1000)), n / len(lines), n / (1 + int(at[46] + at[63] + at[33])),
        share(_UPPER), share(_DIGIT), share(_MARK), share(_SYMBOL), at[33] / m, at[124] / m, share(_HIGH), sum(x <= 3 for x in lengths) / n,
        sum(x[-1] in _LAST_SYMBOL for x in words) / n, sum(65 <= x[0] <= 90 for x in words) / n, len(counts) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), max(counts.values()) / n, 1 - len(set(lines)) / len(lines), max(map(len, lines)) / len(raw), float(-(p * np.log2(p)).sum()),
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and a struct ``stats_`` of its texts' statistics, computed where the rows lie."""
    small_batches(docs.sparkSession)
    names = docs.columns
    k = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([statistics(t) for t in b.column(k).to_pylist()], float).reshape(len(b), len(STATISTICS))
            stats = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(STATISTICS))], names=list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns, stats], names=[*names, "stats_"])

    return docs.mapInArrow(run, f"{schema}, stats_ struct<{','.join(f'{s}:double' for s in STATISTICS)}>")


#: A condition is (statistic's position, True for above / False for up to, bound); a rule is a set of them.
Rule = frozenset


@dataclass
class RuleModel:
    """Weighted rules; the score is the logistic function of ``bias`` and the weights of the rules that hold."""

    bias: float
    rules: list[tuple[float, Rule]]

    def column(self, stats: str = "stats_") -> Column:
        """The score as a Spark column over a struct of statistics."""
        total = F.lit(float(self.bias))
        for weight, rule in self.rules:
            holds = F.lit(True)
            for k, above, bound in sorted(rule):
                x = F.col(f"{stats}.{STATISTICS[k]}")
                holds = holds & (x > F.lit(bound) if above else x <= F.lit(bound))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, rule in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in rule:
        out &= (x[:, k] > bound) if above else (x[:, k] <= bound)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 48, rate: float = 0.3, least: int = 10) -> list[Rule]:
    """The paths, to inner nodes and leaves, of trees boosted for the logistic loss over binned statistics."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        todo = [(np.arange(len(y)), Rule(), 0)]
        while todo:
            at, rule, level = todo.pop()
            if rule:
                rules[rule] = None
            best = (1e-3, None, None)
            if level < depth and len(at) >= 2 * least:
                gs, hs = g[at].sum(), h[at].sum()
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[at, k]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[at], h[at], None))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < least) | (len(at) - nl < least)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
            if best[1] is None:
                margin[at] += rate * g[at].sum() / (h[at].sum() + 1)
                continue
            k, cut = best[1:]
            low = binned[at, k] <= cut
            bound = float(cuts[k][cut])
            todo.append((at[low], Rule(rule | {(k, False, bound)}), level + 1))
            todo.append((at[~low], Rule(rule | {(k, True, bound)}), level + 1))
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the mean logistic loss plus ``penalty`` times the weights' absolute sum (FISTA)."""
    scale = z.std(axis=0) + 1e-12
    mean = z.mean(axis=0)
    z = ((z - mean) / scale).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue, for the step size
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    lip = 0.25 * (float(np.linalg.norm(z @ v)) ** 2 / len(z) + 1) * 1.05
    w = u = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ u.astype(np.float32) + c))) - y
        step = u - (z.T @ r.astype(np.float32)) / len(z) / lip
        w_next = np.sign(step) * np.maximum(np.abs(step) - penalty / lip, 0)
        b_next = c - r.mean() / lip
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    w = w / scale
    return float(b - w @ mean), w


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleModel:
    """A rule ensemble for labels 0 and 1. Of one class alone, or none, only the bias is learned."""
    if not len(y):
        return RuleModel(0.0, [])
    if y.min() == y.max():
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    rules = tree_rules(x, y)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), [])
    bias, weights = lasso_logistic(np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32), y, penalty)
    return RuleModel(bias, [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: those with crc32 of the id's text divisible by 5, and those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> RuleModel:
    """Fits on the labelled rows outside the held-out fold, at most ``rows`` of them: those of the least hashed ids.

    Labels without an id or a value are ignored. A document labelled twice counts twice, as does a repeated one.
    """
    some = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id_"), F.col(label_col).cast("double").alias("label_"))
    some = least_hashed(some, "id_", rows, None, "label_")
    # At most ``rows`` ids and labels, so a broadcast is bounded.
    known = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")).join(F.broadcast(some), "id_")
    found = with_statistics(known, "text_").select("id_", "label_", "stats_.*").orderBy(F.xxhash64("id_"), "id_", "label_", *STATISTICS).limit(rows).toPandas()
    return fit_rules(found[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), (found["label_"].to_numpy(float) > 0).astype(float))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """``docs`` and its ``score`` between 0 and 1, which replaces a column of that name.

    Every row is scored from the whole of its text alone; a null text scores as an empty one. Repeated rows
    score alike; an empty table gives an empty one; other columns pass through, whatever their names and kinds.
    """
    kept, own = aside(docs.drop("score"), "stats_")
    return with_statistics(kept, text_col).select(*own, model.column().alias("score"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, and the prediction at the threshold."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
