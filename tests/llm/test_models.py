"""Quality rules and toxicity: base measures against brute force, classifiers on held-out rows, odd inputs."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerstone.llm import linear, quality, toxicity

SF = os.environ.get("LLM_SF", "/root/testdata/sf0.01")
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, cover = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_measures(spark, docs, none):
    model = quality.Model(np.zeros(2 * quality.BUCKETS), 0.0, 1.0, 10.0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.assess(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        m = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and r.kept == (not r.base_failed)
    assert quality.assess(none, model).collect() == []


def test_quality_model(spark, docs, none):
    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    labels = table("labels")
    half = labels.where("doc_id % 2 = 0")
    model = quality.train(table("documents"), half)
    rows = quality.assess(table("documents"), model).join(labels.where("doc_id % 2 = 1").distinct(), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3
    again = quality.train(table("documents").repartition(5), half)
    assert np.allclose(model.weights, again.weights, atol=1e-6)
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns and {r.kept for r in kept.collect()} <= {r.kept for r in docs.collect()}
    assert quality.filter_quality(none, labels).count() == 0
    unlabelled = quality.train(docs, labels.limit(0))
    assert quality.assess(docs, unlabelled).where("not base_failed and not kept").count() == 0


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.fixture(scope="module")
def toxic_rows(spark):
    """Invented prose; toxic rows hold an insult that only labels reveal, or one of the authored lexicon."""
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    rows = []
    for i in range(1500):
        text = list(r.choice(words, 60))
        toxic = i % 8 == 0
        if toxic:
            text[int(r.integers(60))] = "idiot" if i % 16 else f"zvlek{words[i % 50]}"
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity(spark, toxic_rows, docs, none):
    df = spark.createDataFrame(toxic_rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    rows = toxicity.score_toxicity(df, model).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {i: t for i, _, t in toxic_rows}
    y = np.array([truth[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.97
    assert np.mean([r.predicted == t for r, t in zip(held, y, strict=True)]) > 0.97
    odd = toxicity.score_toxicity(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_toxicity(none, model).collect() == []
    bare = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(df.where("text like '%idiot%'"), bare).collect()} == {1}


def test_held_out_labels_change_nothing(spark, toxic_rows):
    df = spark.createDataFrame(toxic_rows, "doc_id long, text string, toxic int")
    held = [i for i, _, _ in toxic_rows if zlib.crc32(str(i).encode()) % 4 == 2]
    flipped = df.selectExpr("doc_id", f"if(doc_id in ({','.join(map(str, held))}), 1 - toxic, toxic) as toxic")
    a, b = (toxicity.train(df.select("doc_id", "text"), x) for x in (df.select("doc_id", "toxic"), flipped))
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope


def test_label_model_discounts_copies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    vote = lambda hit, false: (r.random(4000) < np.where(y, hit, false)).astype(float)
    weak = vote(0.4, 0.1)
    votes = np.stack([vote(0.7, 0.01), vote(0.6, 0.02), weak, weak, weak, weak], 1)
    model = toxicity.label_model(votes, 0.2)
    post = model.posterior(votes)
    assert model.share[2:].max() < 0.8 < model.share[:2].min()
    assert auc(post, y.astype(int)) > 0.85


def thue_morse(flip, size=2048):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(size))


def test_words_with_equal_hashes_are_no_repeats():
    """Two such words have equal polynomial hashes mod 2^64, whatever the base."""
    a, b = thue_morse(0), thue_morse(1)
    for text, want in ((f"{a} x y {b} x y", 0), (f"{a} x y {a} x y", 6), (f"{a} x y z {a} x {b} x y", 0)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert quality.measures(raw, np.array([0, len(raw)]))["n_repeat_words"].tolist() == [want]


def test_code_points():
    texts = ["", "aé", "漢🙂b", "x"]
    raw = [t.encode() for t in texts]
    points, bounds = quality.code_points(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.diff(bounds).tolist() == [len(t) for t in texts]
    assert points.tolist() == [int.from_bytes(c.encode()) for t in texts for c in t]
    words, chars = quality.gram_buckets(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7]))
    assert [len(b) for b, _ in words] == [4, 3, 2] and [len(b) for b, _ in chars] == [5, 3]


def test_label_model_agrees_with_the_posterior_of_true_rates():
    r = np.random.default_rng(1)
    y = r.random(20_000) < 0.1
    hit, false = np.array([0.7, 0.5, 0.6, 0.4, 0.5]), np.array([0.01, 0.02, 0.01, 0.005, 0.03])
    votes = (r.random((20_000, 5)) < np.where(y[:, None], hit, false)).astype(float)
    model = toxicity.label_model(votes, 0.1)
    # A brute-force posterior from the true rates, where abstaining says nothing.
    odds = 0.1 / 0.9 * np.prod(np.where(votes > 0, hit / false, 1), axis=1)
    assert np.mean((model.posterior(votes) > 0.5) == (odds > 1)) > 0.98


def test_patterns_vote():
    said = [b"You are such an imbecile!", b"just get lost now", b"I hate them so", b"STOP THAT NOW YOU ALL, ", b"what the f**k", b"no!!!", b"A calm text about you and me."]
    assert [[k for k, p in enumerate(toxicity.PATTERNS) if p.search(t)] for t in said] == [[0], [1], [2], [4], [5], [6], []]


def test_toxicity_learns_from_every_document(spark):
    """Documents that a sample of 8,000 by a hash of doc_id left out, without labels, change the model."""
    said = lambda i: f"{'idiot zvlek' if i % 9 == 0 else 'calm words'} w{i % 50} w{i % 7}"
    ids = spark.range(8500).selectExpr("id as doc_id", "row_number() over (order by xxhash64('sample', id), id) > 8000 as last").collect()
    last = {r.doc_id for r in ids if r.last}
    rows = lambda text: spark.createDataFrame([(i, text(i)) for i in range(8500)], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(0, 8500, 5) if i not in last], "doc_id long, toxic int")
    a, b = (toxicity.train(rows(t), labels) for t in (said, lambda i: "idiot grumk" if i in last else said(i)))
    assert a.weights[toxicity.word_bucket("grumk")] == 0 < b.weights[toxicity.word_bucket("grumk")]


def test_choose_is_greedy(spark):
    r = np.random.default_rng(3)
    rows = [sorted(r.choice(70, int(r.integers(1, 30)), replace=False, p=np.arange(70, 0, -1) / 2485).tolist()) for _ in range(300)]
    heard, want = np.zeros(300, int), []
    for k in range(70):
        mine = np.array([i for i, v in enumerate(rows) if k in v], int)
        want.append((heard[mine] < toxicity.ENOUGH).sum() >= max(3, len(mine) / 5))
        if want[-1]:
            heard[mine] += 1
    table = spark.createDataFrame([(v, 1) for v in rows], "list array<int>, n long")
    assert 0 < sum(want) < 70 and toxicity.choose(table, 70).tolist() == want


def test_label_model_of_a_table(spark):
    r = np.random.default_rng(2)
    y = r.random(3000) < 0.1
    votes = (r.random((3000, 5)) < np.where(y[:, None], 0.5, 0.02)).astype(float)
    votes[:, 4] = votes[:, 3]
    groups = Counter(tuple(np.flatnonzero(v).tolist()) for v in votes)
    table = spark.createDataFrame([(list(k), n) for k, n in groups.items()], "list array<int>, n long")
    (got, n, post), want = toxicity.label_model_of(table, 5, 0.1), toxicity.label_model(votes, 0.1)
    assert n == 3000 and np.isclose(post, want.posterior(votes).sum(), atol=1e-3)
    assert all(np.allclose(getattr(got, k), getattr(want, k), atol=1e-6) for k in ("p1", "p0", "share"))


def test_patterns_are_found_as_by_re():
    said = ["You are such an imbecile!", "go  away", "GET LOSTé", "éhate you", "Kill yourself", None, "", "ABC. DEFé GHI, JKL MNO!", "a*éb", "no!!!\n"]
    column = pa.array(said)
    for p in toxicity.PATTERNS:
        assert toxicity.found(column, p).tolist() == [bool(p.search((t or "").encode())) for t in said]


def test_minimise_ends_where_nothing_is_gained():
    calls = []

    def loss(x):
        calls.append(x)
        return round(float((x - 1e-4) @ (x - 1e-4)), 9), 2 * (x - 1e-4)

    assert abs(linear.minimise(loss, 1)[0]) < 1e-3 and len(calls) < 40
    assert np.allclose(linear.minimise(lambda x: (float((x - [3, -2]) @ [[2, 1], [1, 4]] @ (x - [3, -2])), 2 * np.array([[2, 1], [1, 4]]) @ (x - [3, -2])), 2), [3, -2], atol=1e-3)
