"""Mixing, sharding and chat rotation against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerstone.llm import chat, mixing, shared, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


def highest_quotients(values, seats):
    won = Counter()
    for _ in range(seats):
        best = max(values, key=lambda k: (values[k] / (2 * won[k] + 1), [-ord(c) for c in k]))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    r = random.Random(seed)
    rows = [(g, f"p{i:02d}", r.choice([0, 1, 3, 50, 1000]) * r.random()) for g in "ab" for i in range(r.randint(1, 30))]
    seats = {"a": 17, "b": 400}
    df = spark.createDataFrame([(g, k, v, seats[g]) for g, k, v in rows], "g string, k string, v double, n long")
    got = {(x.g, x.k): x.won for x in mixing.sainte_lague(df, ["g"], ["k"], "v", "n", "won").collect()}
    for g in "ab":
        values = {k: v for x, k, v in rows if x == g}
        if sum(values.values()):
            assert {k: got[g, k] for k in values} == {k: highest_quotients(values, seats[g])[k] for k in values}


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        per = left / sum(weight[n] for n in free)
        full = [n for n in free if weight[n] * per > 3 * sizes[n]]
        if not full:
            break
        for n in full:
            out[n], left = 3 * sizes[n], left - 3 * sizes[n]
            free.discard(n)
    return out | {n: weight[n] * left / sum(weight[m] for m in free) for n in free}


def test_mix(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 40
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(none).collect() == []


def test_full_sources_repeat_three_times(spark):
    rows = [(i, "w " * 50, "a" if i < 3 else "b") for i in range(400)] + [(900, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.taken for r in got if r.source == "a"} == {150}
    assert sum(r.taken for r in got) == pytest.approx(400 * 50, rel=0.001)


def test_small_sources_stay_in_the_mix(spark):
    rows = [(i, "w " * 500, "abc"[i % 3]) for i in range(300)] + [(1000 + i, "w " * n, f"small{n}") for i, n in enumerate((1, 7, 90, 340))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(df).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, want in target.items():
        assert abs(taken[s] - want) <= 0.01 * want + 1
    assert {r.source for r in mixing.mix_documents(df).select("source").collect()} == set(target)


def test_mix_documents_takes_what_mix_says(spark, docs, none):
    taken, words = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: " ".join(WORD.findall(r.text or "")) for r in docs.collect()}
    for r in out.collect():
        part = WORD.findall(r.text)
        words[r.doc_id] += len(part)
        assert " ".join(part) in texts[r.doc_id] or r.doc_id is None
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert mixing.mix_documents(none).count() == 0


def test_runs_of_blocks_are_drawn_by_seed(spark, monkeypatch):
    """On every shard's line the words taken are whole runs and the head of one, and another seed draws others."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    r = random.Random(4)
    rows = [(i, "ab"[i % 2], r.choice([0, 1, 7, 60, 700])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    drawn = []
    for seed in (17, 18):
        sources, entries = mixing.allocate(df, seed)
        figures = {x["_name"]: x for x in sources.collect()}
        lines = defaultdict(list)
        order = entries.withColumn("h", F.xxhash64(F.lit(seed + 2), "doc_id")).withColumn("s", F.xxhash64(F.lit(seed), "doc_id"))
        for e in order.orderBy("h", "doc_id").collect():
            lines[e["_name"], e.s % figures[e["_name"]]["_shards"]].append(e)
        assert len(lines) > 4
        taken = Counter()
        for (name, shard), line in sorted(lines.items()):
            marks = []
            for e in line:
                own = [0] * e["_size"]
                for a, b in zip(e.pieces, e.pieces[1:], strict=False):
                    assert a.lead + a.n < b.lead
                for p in e.pieces:
                    own[p.lead : p.lead + p.n] = [1] * p.n
                marks += own
                taken[name] += e.passes * e["_size"]
            block = figures[name]["_block"]
            run = -(-(-(-len(marks) // block)) // mixing.RUNS) * block
            cut = [marks[i : i + run] for i in range(0, len(marks), run)]
            assert len(cut) <= mixing.RUNS and all(x == sorted(x, reverse=True) for x in cut)
            assert sum(0 < sum(x) < len(x) for x in cut) <= 1
            taken[name] += sum(marks)
            drawn.append((seed, name, shard, tuple(any(x) for x in cut)))
        for name, f in figures.items():
            assert abs(taken[name] - f.target) <= f["_block"] * f["_shards"]
    assert {x[1:] for x in drawn if x[0] == 17} != {x[1:] for x in drawn if x[0] == 18}
    assert any(0 < sum(x[3]) < len(x[3]) for x in drawn)


def test_hilbert_is_a_curve(spark):
    side, bits = 8, 3
    cells = spark.range(side**3).selectExpr("int(id % 8) x", "int(id div 8 % 8) y", "int(id div 64) z")
    rows = cells.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards(spark, docs, none):
    rows = sharding.shard_documents(docs, shards=10).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" and r.grown_shard is None
    counts = [len(v) for v in by.values()]
    assert len(by) == 10 and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)
    assert sharding.shard_documents(none).collect() == []
    few = sharding.shard_documents(docs.limit(3)).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_shards_are_pruned_by_each_dimension(spark):
    """A predicate on a name or a size meets few files by their least and greatest values; files in random order are all met."""
    r = random.Random(8)
    rows = [(i, "w" * int(2 ** r.uniform(3, 11)), f"site{r.randrange(200):03d}", r.choice(["de", "en", "es", "fr", None])) for i in range(8000)]
    shard = {x.doc_id: x.shard for x in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}

    def met(place, value):
        spans = defaultdict(list)
        for row in rows:
            if value(row) is not None:
                spans[place(row[0])].append(value(row))
        hits = [sum(min(v) <= x <= max(v) for v in spans.values()) for x in sorted({value(row) for row in rows} - {None})]
        return sum(hits) / len(hits)

    for value, most in ((lambda x: x[2], 14), (lambda x: x[3], 26), (lambda x: len(x[1]), 24)):
        assert met(shard.get, value) < most < 32 < met(lambda i: i % 40, value)


def brute_rotation(turns):
    talks = defaultdict(list)
    for c, t, role, text in turns:
        talks[c].append((t is not None, t or 0, role or "unknown", text or "", t))
    out = []
    for c, said in talks.items():
        for side in {s[2] for s in said} - {"system"}:
            at = 0
            for i, (_, _, who, text, t) in enumerate(sorted(said)):
                name = "assistant" if who == side else who if who == "system" else f"user name={who}"
                line = f"<|{name}|>\n{text}\n"
                out.append((c, side, i, t, who, line, who == side, at, at + len(line)))
                at += len(line)
    return out


def test_rotation(spark):
    r = random.Random(3)
    turns = [(r.choice([1, 2, 3, None]), r.choice([0, 1, 2, 3, None]), r.choice(["user", "assistant", "Ann", "system", None]), r.choice(["héllo", "", None, "x" * 50])) for _ in range(120)]
    turns += [(9, 0, "system", "only")] + [(8, 1, "user", "same")] * 4
    df = spark.createDataFrame([(*t, "other") for t in turns], "conv_id long, turn long, role string, text string, position string")
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, chat.rotate_perspectives(df).collect()), key=key) == sorted(brute_rotation(turns), key=key)
    assert chat.rotate_perspectives(df.limit(0)).collect() == []


def test_offsets_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id", "id % 11 as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = shared.offsets(shared.ordered(df, ["g", "id"]), ["g"], {"before": F.col("v")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = Counter()
    for r in sorted(got, key=lambda r: r.id):
        assert r.before == total[r.g]
        total[r.g] += r.v
