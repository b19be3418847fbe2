"""Substring dedup, SimHash near copies, embedding links and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from ledgerstone.llm import embedding_dups, simhash, substring
from ledgerstone.llm.components import connected_components


def find(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 6), (6, 7)] + [(500, 501 + i) for i in range(200)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(150)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    want = {k: v for k, v in find([x for x in links], {n for x in links for n in x}).items() if k != v}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_repeats(docs, width=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [200_000, 300, 20])
def test_repeats(spark, docs, none, monkeypatch, most):
    monkeypatch.setattr(substring, "SHARD_WORDS", most)  # smaller: shards dealt by anchors and by windows
    key = lambda r: tuple(str(x) for x in r)
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, substring.remove_repeats(docs).collect()), key=key) == sorted(want, key=key)
    assert substring.remove_repeats(none).collect() == []


def test_automaton_matches_every_window():
    r = random.Random(4)
    runs = [([r.randrange(3) for _ in range(r.randint(13, 60))], d) for d in range(40)]
    auto = substring.Automaton()
    for words, d in runs:
        auto.add(words, d)
    auto.finish()
    for words, _ in runs:
        want = [min(d for w, d in runs if any(w[j : j + 5] == words[i : i + 5] for j in range(len(w) - 4))) for i in range(len(words) - 4)]
        assert auto.windows(words, 5) == want
    stray = auto.windows([9, 9, 9, 9, 9, 9], 5)
    assert stray == [1 << 62] * 2


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies(spark, docs, none):
    rows = docs.collect()
    got = simhash.near_copies(docs).collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    names = sorted({p for _, p in prints})
    roots = find([(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 3], names)
    least = {}
    for d, p in prints:
        if d is not None:
            least[roots[p]] = min(d, least.get(roots[p], d))
    want = sorted((str(d), f"{p:016x}", least.get(roots[p])) for d, p in prints)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_copies(none).collect() == [] and simhash.drop_near_copies(none).collect() == []


def test_components_that_share_a_least_id_or_have_none(spark):
    r = [random.Random(n) for n in range(5)]
    one, two, three, four, five = [" ".join("".join(x.choices("abcdefgh", k=5)) for _ in range(60)) for x in r]
    rows = [(None, one), (None, one), (None, two), (7, three), (8, three), (7, four), (9, four), (None, five), (3, five)]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, one), (None, two), (7, three), (7, four), (3, five)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [2048, 3])
def test_links_of_dense_groups(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "LIST_MOST", most)
    r = random.Random(most)
    seeds = [r.getrandbits(64) for _ in range(30)]
    prints = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for s in seeds for _ in range(12)} | {seeds[0] ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(20)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(x.u % (1 << 64), x.v % (1 << 64)) for x in simhash.fingerprint_links(df).collect()]
    assert find(links, prints) == find([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3], prints)


def test_flips_find_what_pairs_find():
    r = random.Random(8)
    base = r.getrandbits(64)
    fp = np.unique(np.array([base ^ sum(1 << b for b in r.sample(range(10), r.randint(0, 5))) for _ in range(80)], np.uint64))
    a = simhash._flip_links(fp)
    b = simhash._list_links(np.zeros(len(fp)), fp)
    nodes = [int(x) for x in fp]
    pack = lambda uv: [(int(x), int(y)) for x, y in zip(*uv, strict=True)]
    assert find(pack(a), nodes) == find(pack(b), nodes)


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 24))
    rows = [base[i % 60] + r.standard_normal(24) * (0.02 if i % 3 else 0.4) for i in range(150)]
    vectors = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]
    vectors += [(200 + i, vectors[4][1]) for i in range(5)] + [(300, [2 * x for x in vectors[4][1]])]
    odd = [(400, None), (401, []), (402, [0.0] * 24), (403, [float("nan")] * 24), (404, [float("inf")] + [0.0] * 23), (405, [None] + [1.0] * 23), (406, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, n_links string")
    got = {x.vec_id: x for x in embedding_dups.link_embeddings(df).collect()}
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [i for i, _ in vectors]
    linked = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True)]
    want = find(linked, ids)
    for i in ids:
        assert (got[i].n_links, got[i].component_id) == (sum(i in p for p in linked), want[i])
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embedding_dups.link_embeddings(df.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [1, 40, 5000, 10**6])
def test_lines_are_calibrated(rows):
    """Of pairs at the threshold, the share that meets on enough lines reaches the recall, whatever the size."""
    r, lines = np.random.default_rng(rows), embedding_dups.calibrated(rows)
    x, o = r.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o -= (o * x).sum(1)[:, None] * x
    o /= np.linalg.norm(o, axis=1)[:, None]
    (cx, ax), (cy, ay) = lines.place(x), lines.place(0.95 * x + np.sqrt(1 - 0.95**2) * o)
    met = ((cx == cy) & (np.abs(ax - ay) <= lines.reach)).sum(1) >= lines.least
    assert met.mean() > 0.995


def test_recall_of_planted_pairs(spark):
    r, n, m = np.random.default_rng(6), 2000, 600
    x = r.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    o = r.standard_normal((m, 32))
    o -= (o * x[:m]).sum(1)[:, None] * x[:m]
    o /= np.linalg.norm(o, axis=1)[:, None]
    c = r.uniform(0.9502, 0.953, m)[:, None]
    rows = np.concatenate([x, c * x[:m] + np.sqrt(1 - c * c) * o]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {g.vec_id: g for g in embedding_dups.link_embeddings(df).collect()}
    assert sum(got[n + i].component_id == i for i in range(m)) >= 0.98 * m
    assert all(got[i].n_links == 0 for i in range(m, n))
