"""The pipeline's stages against brute force on the smallest tables, and the queries' oracles."""

import glob
import os

import duckdb
import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from ledgerstone.llm import queries  # noqa: E402
from ledgerstone.llm.queries import WORD_BPE  # noqa: E402
from tests.llm.test_copies import brute_print, find  # noqa: E402
from tests.llm.test_layout import WORD, brute_targets  # noqa: E402
from tests.llm.test_scans import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_columns(stages):
    for name in ("quality", "simhash", "secrets", "mix"):
        assert stages[name].columns == stages[""].columns


def test_quality_stage(spark, stages):
    verdict = {r.doc_id: r.kept for r in queries.op9_quality(spark, SF).collect()}
    assert sorted(r.doc_id for r in stages["quality"].collect()) == sorted(i for i, k in verdict.items() if k)


def test_simhash_stage(stages):
    rows = {r.doc_id: brute_print(r.text) for r in stages["quality"].collect()}
    ids = sorted(rows)
    roots = find([(a, b) for a in ids for b in ids if a < b and (rows[a] ^ rows[b]).bit_count() <= 3], ids)
    assert sorted(r.doc_id for r in stages["simhash"].collect()) == sorted(set(roots.values()))


def test_secret_stage(stages):
    before = {r.doc_id: r.text for r in stages["simhash"].collect()}
    after = {r.doc_id: r.text for r in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert after[i] == t if not brute(t) and "[secret]" not in after[i] else not brute(after[i])


def test_mix_stage(stages):
    sizes, taken = {}, {}
    for r in stages["secrets"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    for r in stages["mix"].collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORD.findall(r.text))
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= 0.01 * want + 10


def test_bpe_stage(spark, stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    want = sorted((r.doc_id, tok.encode(r.text, add_special_tokens=False).ids) for r in stages["mix"].collect())
    assert sorted((r.doc_id, r.ids) for r in stages["bpe"].collect()) == want
    assert np.sum([r.n_tokens for r in stages["bpe"].collect()]) == sum(len(x) for _, x in want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    found = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(found.fetchall())
