"""Language identification, fill-in-middle and the filter audit: against plain loops, with nulls, empty and very long texts, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import filter_audit, fim, language

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string"
CLASHING = ["fim", "draws_", "found_", "score", "lang_pred", "lang_share", "mask_", "digest_", "id_", "rows_", "part", "window", "hash", "rank", "n", "output", "form"]


def made_texts(seed=3, n=80):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Né", "中文", "#x", "AB", "a|b"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", "\t "]) for _ in range(r.randint(1, 300))) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1], "", " \n\t ", None, "one", "Ⅷ", "١٢ 34 …", "keep <P> plain", "<M>", "a\u0085b c", "UPPER CASE " * 80, " lead", "trail \x0b"]
    return texts + [" ".join(r.choices(words, k=60_000))]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(i, t, r.choice(["en", "de", None, ""]), "s") for i, t in enumerate(made_texts())]
    rows += [rows[3], rows[3], (None, "no id", None, None), (None, rows[0][1], "en", None), (2, rows[5][1], "de", None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *(F.lit("x").alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 11


def test_gradient_is_the_losss_slope():
    r = np.random.default_rng(3)
    net = language.fresh(["a", "b", "c"], 4, 1, np.float64)
    symbols, target = r.integers(97, 103, (7, 5)), r.integers(0, 3, 5)
    symbols[5:, 0] = language.NONE
    for w, g in zip(net.weights(), net.loss(symbols, target)[1]):
        for _ in range(10):
            at = (int(r.integers(0, w.shape[0])), int(r.choice(symbols.ravel())) if w.shape[1] == 257 else int(r.integers(0, w.shape[1])))
            kept = w[at]
            w[at] = kept + 1e-6
            above = net.loss(symbols, target)[0]
            w[at] = kept - 1e-6
            slope = (above - net.loss(symbols, target)[0]) / 2e-6
            w[at] = kept
            assert slope == pytest.approx(g[at], abs=1e-7)


def plain_positions(net, raw):
    """One window after another, one byte after another."""
    out = []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for at in range(0, len(raw), language.WINDOW):
        symbols = list(raw[at : at + language.WINDOW])
        symbols += [language.NONE] * (language.WINDOW - len(symbols))
        ways = []
        for d, order in ((net.forth, symbols), (net.back, symbols[::-1])):
            n, states = len(d.bias), []
            h = np.zeros(n)
            for s in order:
                x, u = d.inputs[:, s], d.recurrent @ h
                z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
                new = np.tanh(x[2 * n :] + r * (u[2 * n :] + d.bias[:, 0]))
                h = z * h + (1 - z) * new
                states.append(h)
            ways.append(states)
        for a, b in zip(ways[0], ways[1][::-1]):
            e = np.exp(net.mix @ np.concatenate((a, b)) + net.shift[:, 0])
            out.append(e / e.sum())
    return np.array(out)[: len(raw)]


def test_pooled_probabilities_against_single_steps():
    r = np.random.default_rng(4)
    net = language.fresh(["a", "b", "c"], 5, 2, np.float64)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (1, 63, 64, 65, 0, 300)]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    odds, shares = net.pooled(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for k, t in enumerate(texts):
        if not t:
            assert not odds[k].any()
            continue
        want = plain_positions(net, t)
        assert odds[k] == pytest.approx(want.mean(axis=0))
        assert shares[k] == pytest.approx(np.bincount(want.argmax(axis=1), minlength=3) / len(t))


@pytest.fixture(scope="module")
def network(spark):
    return language.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_languages(spark, network):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predict(given, network).where(language.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and len(rows) > 300
    right = [r.lang_pred == r.lang for r in rows if r.lang]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 and 0 <= r.lang_share <= 1 for r in rows)


def test_nothing_is_learned_from_the_held_out_fold(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    other = given.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = language.sample(given), language.sample(other.repartition(7))
    assert list(a["window"]) == list(b["window"]) and "xx" not in set(b["lang"])


def test_samples_are_bounded_by_language(spark, none):
    rows = [(i, f"text number {i} of many", "en" if i % 3 else "de", None) for i in range(3000)] + [(None, "no id", "fr", None), (9_001, "12 34", "es", None)]
    got = language.sample(spark.createDataFrame(rows, DOCS), docs_each=50)
    assert Counter(got["lang"]) == {"en": 50, "de": 50}
    assert not len(language.sample(none))


def test_languages_of_odd_texts(docs, clashing, none, network):
    kinds = {r.text: r for r in language.predict(docs, network).collect()}
    for t in ("", " \n\t ", None, "١٢ 34 …"):
        assert (kinds[t].lang_pred, kinds[t].score) == ("und", 0.0)
    assert kinds["Ⅷ"].lang_pred == "und"  # a number of letters' shape is no letter
    assert kinds["one"].lang_pred in network.languages
    out = language.predict(clashing, network)
    assert sorted(out.columns) == sorted(clashing.columns) and out.count() == docs.count()
    assert language.predict(none, network).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}
    one = language.predict(docs.limit(20), language.fit(docs.where("lang = 'en'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} <= {("en", 1.0), ("und", 0.0)}


# 12


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(fim.TOKEN, text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("piece", [1, 50, fim.PIECE])
def test_fim(docs, piece):
    got = fim.rearrange(docs, piece=piece).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == docs.count() and len({r.fim.form for r in got}) == 3
    for r in got:
        assert tuple(r.fim) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_fim_query(docs, none):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = Counter(tuple(r) for r in fim.op12(docs).collect())
    want = Counter()
    for r in docs.collect():
        *rest, output = plain_fim(r.doc_id, r.text)
        want[(r.doc_id, *rest, sha(output), sha(r.text or ""))] += 1
    assert got == want
    assert fim.op12(none).collect() == []


def test_fim_parameters(docs, clashing):
    out = fim.rearrange(clashing)
    assert sorted(out.columns) == sorted(clashing.columns) and all(r["draws_"] == "x" for r in out.collect())
    marks = ("[pre]", "[suf]", "[mid]")
    always = fim.rearrange(docs, rate=100, spm=0, seed=7, marks=marks)
    assert {r.fim.form for r in always.where("length(text) > 0").collect()} == {"psm"}
    assert all(r.back == (r.text or "") for r in always.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"), marks)).collect())
    for bad in (("aa", "b", "c"), ("ab", "bc", "d"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fim.rearrange(docs, marks=bad)


# 13


def plain_mask(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + 8 * bool(re.search("[#$%&*|]", text))


@pytest.mark.parametrize("scan", [100, 5_000, filter_audit.SCAN_BYTES])
def test_masks(monkeypatch, scan):
    monkeypatch.setattr(filter_audit, "SCAN_BYTES", scan)
    texts = made_texts(7, 200)
    for kind in (pa.string(), pa.large_string()):
        assert filter_audit.masks_of(pa.array(texts, kind)).tolist() == [plain_mask(t) for t in texts]
        assert filter_audit.masks_of(pa.array(texts, kind).slice(5, 30)).tolist() == [plain_mask(t) for t in texts[5:35]]
    assert filter_audit.masks_of(pa.array([], pa.string())).tolist() == []


def test_words_that_share_a_hash_are_told_apart():
    r = random.Random(1)
    words = ["a", "b", "ab", "ba", "x" * 300, "x" * 299 + "y", "longer than eight".replace(" ", "_"), "longer_than_nine_"]
    texts = [" ".join(r.choices(words, k=n)).encode() for n in (0, 1, 5, 40, 200)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for hashes in (filter_audit.word_hashes, lambda d, s, e: (e - s).astype(np.uint64) % np.uint64(2)):
        found = filter_audit.counts(data, offsets, hashes)
        assert found["distinct"].tolist() == [len(set(t.split())) for t in texts] and found["words"].tolist() == [len(t.split()) for t in texts]


def plain_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    for d, q, t in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if t == 1 and d is not None else set()
    rows = [(r.lang or "", {f for k, f in enumerate("ABCD") if plain_mask(r.text) >> k & 1} | ({"E"} if r.doc_id is not None and r.doc_id > least[r.text or ""] else set()), r.doc_id in good, r.doc_id in toxic) for r in docs]
    out, removed_by = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = sum(f in r[1] for r in rows if r[0] == part) - len(gone)
                left = [r for r in left if f not in r[1]]
                only = sum(r[1] == {f} for r in rows if r[0] == part)
                removed_by[part, f] += len(gone)
                out[part, order, step] = (len(left), len(gone), before, only, sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, docs, clashing, none):
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, None, 1), (3, 1, None), (None, 1, 1), (80, 1, 0), (81, 0, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain_audit(docs.collect(), labels)
    for given in (docs, clashing.repartition(5)):
        got = filter_audit.op13(given, known)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert {tuple(r) for r in got.collect()} == want
    assert len(want) == 3 * 600
    assert filter_audit.op13(none, known).collect() == []
    assert filter_audit.op13(docs, known.limit(0)).where("good_lost + toxic_lost > 0").isEmpty()


def test_copies_are_found_without_a_task_for_their_group(spark):
    """The join that finds copies is on text and id, so a text of many rows is dealt over many tasks."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    known = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {(r.mask, r.n) for r in filter_audit.failing(rows, known).collect()}
    assert got == {(1, 1), (17, 3999)}
