"""Made-up boards are numbered past 2000: those numbers are no years, as in the SQL."""

import duckdb
import pytest
from test_queries import SF, rows

from firnline.plans.registry import oracle_sql, queries


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Pages and parts whose boards have numbers from 1998 on; a board 2004 with and without its season, and sheets with boards 2000 to 2099."""
    folder = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT * REPLACE (3996 + row_number() OVER () AS page_id) FROM '{SF}/pages.parquet' LIMIT 40) TO '{folder}/pages.parquet'")
    duckdb.sql(f"COPY (SELECT * REPLACE (7990 + row_number() OVER (ORDER BY p_partkey) AS p_partkey) FROM '{SF}/part.parquet' LIMIT 120) TO '{folder}/part.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["shop_products", "shop_corrections"])
def test_numbers_like_years_match_sql(spark, far, name):
    con = duckdb.connect()
    for t in ("pages", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{far}/{t}.parquet'")
    assert rows(queries()[name](spark, far).toPandas()) == rows(con.sql(oracle_sql()[name]).df())
