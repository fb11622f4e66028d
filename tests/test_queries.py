"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from textloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    out = registry.queries()[name](spark, SF)
    got = rows(out.columns, [tuple(r) for r in out.collect()])
    found = con.execute(registry.oracle_sql()[name])
    assert got == rows([c[0] for c in found.description], found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc_id", "source", "chars", "turn"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_library_does_not_import_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys, textloom.plans.registry as r; r.queries(); import textloom.sources.files, textloom.sources.sinks, textloom.streaming.dedup; assert not any(m.startswith('textloom.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
