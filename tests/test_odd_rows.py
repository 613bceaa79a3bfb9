"""Queries against their SQL on rows that the small tables don't have."""

import os

import duckdb
import pytest

from lattica.functions import text as tx
from lattica.plans import registry
from tests.oracle import TABLES, same

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """A function: the small tables with one of them replaced by a SELECT's rows."""

    def made(table, select):
        for t in TABLES:
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        os.remove(tmp_path / f"{table}.parquet")
        duckdb.execute(f"COPY (SELECT * FROM ({select})) TO '{tmp_path}/{table}.parquet'")
        return str(tmp_path)

    return made


PAGES = ("<p>a &&amp</p>p{margin:0} &copy;", "<b>x</b> &am</p> &a &quot &quo; &copy", "&ampamp; &ampcopy; &amp&middot; &amp;copy; &amp;lt;", "<i>&#39 &#39;&lt &lt;</i>&", "<u>none</u>", None)


def test_html_unescape_leaves_cut_entities(spark, folder):
    values = ", ".join(f"({k}, 'http://a', {'NULL' if p is None else chr(39) + p + chr(39)})" for k, p in enumerate(PAGES))
    path = folder("pages", f"VALUES {values}) t(page_id, url, html")
    rows = same(spark, path, registry.queries()["html_unescape"], registry.oracle_sql()["html_unescape"])
    assert ("a &&ampp{margin:0} ©", "0") in rows


def test_html_unescape_reads_old_names_unless_closed(spark):
    row = spark.createDataFrame([("&eacute; &#233; &#xE9; &amp &eacute &none; &amp;",)], "x string").select(tx.html_unescape("x"), tx.html_unescape("x", closed=True)).first()
    assert tuple(row) == ("é é é & é &none; &", "é é é &amp &eacute &none; &")


@pytest.mark.parametrize("name", ["iso_timestamp", "preview_format"])
def test_timestamps_beyond_9999(spark, folder, name):
    path = folder("events", f"SELECT * REPLACE (event_id + 2954000 AS event_id, make_timestamp(253370764799123456 + event_id * 86461000007) AS ts) FROM '{SF}/events.parquet'")
    rows = same(spark, path, registry.queries()[name], registry.oracle_sql()[name])
    assert any("1000" in str(r) for r in rows)
