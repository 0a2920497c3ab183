"""Every catalogue query against its DuckDB oracle on the smallest tables."""

import hashlib
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        if isinstance(x, float):
            return repr(x + 0.0)
        return x.isoformat() if hasattr(x, "isoformat") else str(x)
    return hashlib.sha256("\n".join(sorted("|".join(v(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_queries_match_oracle(spark, duck):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    bad = []
    for name, sql in orc.items():
        df = qs[name](spark, SF)
        srows = [tuple(r) for r in df.collect()]
        res = duck.execute(sql)
        ocols = [d[0] for d in res.description]
        orows = res.fetchall()
        if sorted(df.columns) != sorted(ocols) or _digest(df.columns, srows) != _digest(ocols, orows):
            bad.append(name)
    assert not bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "recommended_order_qty" in df.columns
