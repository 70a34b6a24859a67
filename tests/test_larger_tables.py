"""Queries on tables that the smallest scale does not have: long keys, files beyond a list's limits, marked-up titles."""

import duckdb
import pytest
from oracle import SF, same_rows

from recordcheck.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def folder(tmp_path):
    """A scale folder whose tables are those of the smallest scale, unless a SELECT of its own is written in their place."""

    def made(**selects):
        con = duckdb.connect()
        from oracle import TABLES

        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        for t in TABLES:
            con.execute(f"COPY ({selects.get(t, f'SELECT * FROM {t}')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return made


def check(spark, name, sf):
    same_rows(spark, QUERIES[name], ORACLE_SQL[name], sf)


def test_arxiv_numbers_of_long_keys(spark, folder):
    check(spark, "lookup_identifiers", folder(part="SELECT p_partkey + k * 100000 AS p_partkey, * EXCLUDE (p_partkey) FROM (SELECT * FROM part LIMIT 40), (VALUES (0), (1), (2)) AS v(k)"))


def test_titles_with_references(spark, folder):
    html = "replace(html, '<title>', '<title>a &amp;&amp;&amp; b &amp;&amp;&amp; c &amp;&amp;&amp; d &amp;&amp;')"
    check(spark, "page_url_state", folder(pages=f"SELECT page_id, url, {html} AS html FROM pages"))


@pytest.mark.parametrize("name", ["entry_list", "entry_filter", "bibtex_files", "bibtex_file_totals"])
def test_a_file_of_more_than_20000_entries(spark, folder, name):
    part = "SELECT p_partkey + k * 200 AS p_partkey, CASE WHEN k < 120 THEN 'Brand#1' ELSE p_brand END AS p_brand, * EXCLUDE (p_partkey, p_brand) FROM (SELECT * FROM part LIMIT 200), (SELECT unnest(range(122)) AS k)"
    check(spark, name, folder(part=part))
