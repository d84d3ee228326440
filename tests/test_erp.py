"""The ERP's joins and audits against SQL, and their edges."""

from datetime import date
from decimal import Decimal

import duckdb
import pytest

from pyspark.sql import functions as F

from tallyforge.functions import values
from tallyforge.operators import erp
from tallyforge.plans import erp as plans
from tallyforge.plans import queries

NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == plans.__name__]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in (*plans._GIVEN, "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    df, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


def test_empty_tables(spark, sf):
    t = {n: df.limit(0) for n, df in plans.tables(spark, sf).items()}
    rows = erp.ledger(erp.payments(t, "1996-01-01", "1996-12-31"), erp.transfers(t, "1996-01-01", "1996-12-31"))
    assert rows.count() == 0 and erp.audit_companies(t["empresas"], rows).count() == 0
    assert {(r["qtd"], r["total"]) for r in erp.audit_not_imported(t, "1996-01-01", "1996-12-31").collect()} == {(0, None)}


def test_report_cell(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024-02-30",), ("1.5",), (" a\r\nb ",), ("",), (None,)], "x string")
    got = df.select(values.report_cell("Banco_Data", "x").alias("d"), values.report_cell("score", "x").alias("n"), values.report_cell("metodo", "x").alias("t")).collect()
    assert [r["d"]["day"] for r in got] == [date(2024, 2, 29), None, None, None, None, None]
    assert [r["n"]["number"] for r in got] == [None, None, Decimal("1.5"), None, None, None]
    assert [r["t"]["text"] for r in got] == ["2024-02-29", "2024-02-30", "1.5", "a  b", None, None]
    assert df.where(F.col("x").isNull()).count() == 1
