"""Every query of the reference's operators against its SQL, or at least run."""

import pytest

from millrace.plans import catalogue
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.SQL:
        same_rows(got, duck.sql(catalogue.SQL[name]).df())
    else:
        assert len(got)


def test_persona_rounds_that_bring_nobody_count(spark, tmp_path):
    """The deterministic backend knows 65,536 personas: so many customers find them all in the first round."""
    import duckdb

    path = str(tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS c_custkey, 'Customer#' || range AS c_name FROM range(500000)) TO '{path}'")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{path}'")
    want = con.sql(catalogue.SQL["persona_expansion_rounds"]).df()
    assert want.sort_values("hop")["n"].tolist() == [500000, 65536, 0]
    same_rows(catalogue.QUERIES["persona_expansion_rounds"](spark, str(tmp_path)).toPandas(), want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
