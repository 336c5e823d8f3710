"""Queries against their SQL, and the entry module without the training-data operators."""

import math
import subprocess
import sys
import textwrap

import duckdb
import pytest

import __spark_entry__ as entry
from chunkwell.queries import Q, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v, ".9g")
    return str(v)


@pytest.mark.parametrize("name", list(SQL))
def test_query_is_its_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = Q[name](spark, sf)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda cursor: sorted(tuple(map(plain, r)) for r in cursor)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


def test_queries_without_sql(spark, sf):
    for name in set(Q) - set(SQL):
        assert Q[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert entry.entry(spark).count() == 5


def test_entry_without_the_subpackage():
    code = """
    import sys
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("chunkwell.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
    sys.meta_path.insert(0, Gone())
    import __spark_entry__ as e
    assert len(e.queries()) > 40 and len(e.oracle_sql()) > 40 and not any(n.startswith("op") for n in e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
