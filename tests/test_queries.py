"""Every query that SQL can express against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from leadloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def one(x):
        if x is None or pd.isna(x):
            return "~"
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    columns = sorted(df.columns)
    rows = [tuple(one(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert plain(got) == plain(duck.sql(catalog.ORACLE[name]).df())


def test_imports_alone():
    """The rest works without the operators for training data."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['leadloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'exact_edges' in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
