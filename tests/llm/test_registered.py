"""Every registered query of this subpackage on the smallest tables: against its SQL
where it has some, against plain versions or for its contract's columns elsewhere."""

import hashlib

import duckdb
import numpy as np
import plain
import pytest

from textloom.llm import language, vocab
from textloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    out = QUERIES[name](spark, SF)
    assert set(out.columns) == set(columns)
    assert sorted(map(str, map(tuple, out.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def test_op2(spark):
    table = texts()
    prints = [plain.fingerprint(t) for _, t in table]
    roots = plain.groups(len(table), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, SF).collect()}
    members = {}
    for (i, _), k in zip(table, roots):
        members.setdefault(k, []).append(i)
    assert got == {i: (f"{f:016x}", min(members[k])) for (i, _), f, k in zip(table, prints, roots)}


def test_op5(spark):
    table = texts()
    got = {r.doc_id: r for r in QUERIES["op5_lm_scoring"](spark, SF).collect()}
    assert len(got) == len(table)
    for (i, t), (held, n, known, total, base) in zip(table, plain.base_scores(table)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert np.isclose(r.base_score, base, rtol=1e-9) and (r.score < 0)


def test_op6_and_op9(spark):
    tokenizer = vocab.load(vocab.vocabulary_path())
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in texts()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    assert got == {i: (len((t or "").encode()), sizes[i], sizes[i] > 2048) for i, t in texts()}
    pieces = QUERIES["op9_best_fit_packing"](spark, SF).toPandas()
    assert (pieces.groupby("doc_id").length.sum() == np.array([n + 1 for _, n in sorted(sizes.items())])).all()
    bins = pieces.groupby("sequence_id").length.sum()
    assert bins.max() <= 2048 and len(bins) <= 1.02 * np.ceil(pieces.length.sum() / 2048) + 1


def test_op7(spark):
    out = QUERIES["op7_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r.text_sha256, r.n_bytes) for r in out) == sorted((i, hashlib.sha256((t or "").encode()).hexdigest(), len((t or "").encode())) for i, t in texts())
    assert len({(r.shard, r.shard_row) for r in out}) == len(out)
    for shard in {r.shard for r in out}:  # rows of a shard are numbered from 0 on
        own = [r.shard_row for r in out if r.shard == shard]
        assert sorted(own) == list(range(len(own)))


def test_op10(spark):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    names, _ = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    out = QUERIES["op10_language_id"](spark, SF).collect()
    assert sorted(r.page_id for r in out) == sorted(i for i, _ in pages)
    assert all(r.lang in names and 0 < r.probability <= 1 + 1e-9 and np.isclose(sum(r.host_prior), 1) for r in out)
