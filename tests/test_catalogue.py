"""Every registered query of function lists against its SQL, in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from zeilenwerk import catalogue, catalogue_lists, catalogue_tables  # noqa: F401

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations benchmark".split()


def plain(p: pd.DataFrame) -> pd.DataFrame:
    p = p[sorted(p.columns)].astype(object)
    value = lambda x: "" if x is None or x is pd.NA or x != x else f"{float(x):.6f}" if isinstance(x, (int, float, bool)) or hasattr(x, "dtype") else str(x)
    p = p.apply(lambda c: c.map(value))
    return p.sort_values(list(p.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, AT).toPandas()
    if name in catalogue.SQL:
        pd.testing.assert_frame_equal(plain(got), plain(db.sql(catalogue.SQL[name]).df()))
    else:
        assert len(got) > 0


def test_totals_agree(spark):
    """Margins, matrices and summaries are sums of the same facts."""
    total = catalogue.QUERIES["kpi_row"](spark, AT).first()["menge"]
    wide = catalogue.QUERIES["document_matrix"](spark, AT).toPandas()
    assert abs(wide[["A_1_1", "A_1_2", "A_2_1", "A_2_2"]].to_numpy().sum() - total) < 0.01 * 4
    margin = catalogue.QUERIES["pivot_margins"](spark, AT).where("projekt = 'Gesamt'").first()
    assert abs(margin["Gesamt"] - total) < 0.01


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
