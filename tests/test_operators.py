import datetime
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import catalog, graph, sinks
from lattica.operators import profile as pf
from lattica.operators import relational as rel
from lattica.plans import models


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (tx.utf16_length, "a😀b", 4), (tx.token_estimate, "a😀b", 1), (tx.token_estimate, "abcdef", 2), (tx.token_estimate, None, 0), (tx.token_estimate, "abcde\U0001f600\U0001f600\U0001f600", 3),
        (tx.html_escape, "<a href=\"x\">'&'</a>", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"), (tx.html_unescape, "<b>a</b> &lt;&amp;lt;", "a <&lt;"), (tx.html_unescape, "<b>no entity</b>", "<b>no entity</b>"),
        (tx.html_unescape, "&eacute;&#233;&amp;", "éé&"), (tx.md_escape, "a|b", "a\\|b"), (tx.md_escape, None, ""), (tx.csv_field, 'a"b', '"a""b"'), (tx.csv_field, "a\nb", '"a\nb"'), (tx.csv_field, "a\rb", '"a\rb"'),
        (tx.csv_field, None, ""), (tx.csv_field, " a ", " a "), (tx.sanitize_filename, 'a<b>:"/\\|?*\x01c', "a_b_________c"), (tx.export_name, "  ", "semantic-model"), (tx.export_name, " a/b ", "a_b"), (tx.export_name, None, "semantic-model"),
        (tx.unquote_ident, "'it''s'", "it's"), (tx.unquote_ident, "plain", "plain"), (tx.unquote_ident, "'", "'"), (tx.line_indent, "\t\t  x", 2), (tx.line_indent, "        x", 2), (tx.line_indent, "x", 0), (tx.line_indent, "\t   x", 1),
        (tx.cardinality_label, "oneToOne", "1:1"), (tx.cardinality_label, "", "*:1"), (tx.cardinality_label, "odd", "odd"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("value, want", [(12345678.0, "1.23e+7"), (1e6, "1.00e+6"), (-2.5e12, "-2.50e+12"), (1234.0, "1,234"), (1234.567, "1,234.57"), (0.5, "0.5"), (999999.0, "999,999"), (1e100, "1.00e+100")])
def test_format_stat(spark, value, want):
    assert one(spark, value, tx.format_stat, "double") == want


def test_numbers_and_dates(spark):
    assert one(spark, -2.5, lambda c: tx.round_half_up(c, 0), "double") == -2.0
    assert one(spark, 45000.5, tx.serial_to_timestamp, "double") == datetime.datetime(2023, 3, 15, 12)
    assert str(one(spark, 12345, tx.scaled_decimal, "long")) == "1.2345"
    assert one(spark, None, tx.format_grouped, "long") == "" and one(spark, 1234567, tx.format_grouped, "long") == "1,234,567"
    assert one(spark, datetime.datetime(2024, 1, 2, 3, 4, 5, 678999), tx.iso_timestamp, "timestamp_ntz") == "2024-01-02T03:04:05.678Z"
    assert one(spark, 9, tx.type_name, "int") == "dateTime" and one(spark, 99, tx.type_name, "int") == "string"


@pytest.mark.parametrize("text, want", [("'a.b'.c", ("a.b", "c")), ("a.'b c'", ("a", "b c")), ("'it''s.x'.'y''z'", ("it's.x", "y'z")), ("alone", ("alone", "")), ("a.b.c", ("a", "b.c"))])
def test_qualified_names(spark, text, want):
    row = spark.createDataFrame([(text,)], "x string").select(*tx.qualified_name("x")).first()
    assert tuple(row) == want


def test_profile_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0, "b", True, None), (2, nan, "a", True, None), (3, -0.0, "a", False, None), (4, 0.0, None, None, None), (5, nan, "b", True, None), (6, inf, "c", False, None)]
    df = spark.createDataFrame(rows, "k long, x double, s string, `odd``name` boolean, n string")
    told = {r["column_name"]: r for r in pf.profile(df, F.col("k")).collect()}
    assert (told["x"]["distinct"], told["x"]["num_min"], told["x"]["num_max"], told["x"]["num_avg"], told["x"]["top"]) == (4, 0.0, 1.0, 0.33, None)
    assert [tuple(t) for t in told["s"]["top"]] == [("b", 2), ("a", 2), ("c", 1)] and told["s"]["nulls"] == 1
    assert [tuple(t) for t in told["odd`name"]["top"]] == [("true", 3), ("false", 2)]
    assert (told["n"]["distinct"], told["n"]["nulls"], told["n"]["top"]) == (0, 6, None)
    none = {r["column_name"]: r for r in pf.profile(df.limit(0)).collect()}
    assert none["x"]["row_count"] == 0 and none["x"]["num_min"] is None
    many = spark.range(2000).select(F.col("id").cast("string").alias("s"))
    assert pf.profile(many).first()["top"] is None


@pytest.mark.parametrize("width", [1, 3, 7, 16, 31, 32, 33, 63])
def test_bits(spark, width):
    values = [(k * 2654435761) % (1 << min(width, 62)) for k in range(100)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    out = df.select(F.slice(rel.bit_unpack(rel.bit_pack(F.col("v"), width), width, 5), 1, 100).alias("v")).first()["v"]
    assert out == [v + 5 for v in values]


def test_bad_width():
    with pytest.raises(ValueError):
        rel.bit_unpack(F.lit(1), 0)


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None), (2, 1, "a")], "g int, k int, v string")
    got = sorted((r["g"], r["run"], r["value"] or "-", r["n"]) for r in rel.runs(df, ["g"], "k", "v").collect())
    assert got == [(1, 1, "-", 2), (1, 2, "a", 2), (1, 3, "-", 1), (2, 1, "a", 1)]


def test_nul_split(spark):
    df = spark.createDataFrame([("a\0b\0",), ("a\0\0",), ("a",), ("",)], "x string")
    assert [r["y"] for r in df.select(rel.nul_split(F.col("x")).alias("y")).collect()] == [["a", "b"], ["a", ""], ["a"], []]


def test_slices(spark):
    df = spark.range(10)
    assert [r["id"] for r in rel.row_slice(df, ["id"], 8, 5).collect()] == [8, 9]
    assert rel.row_slice(df, ["id"], -3, -1).count() == 0


def test_export_names():
    assert sinks.file_names(["a/b", "a:b", "", None, "x"]) == ["a_b", "a_b_2", "table_3", "table_4", "x"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok\nthere', None, datetime.datetime(2024, 1, 1, 12)), (2, None, 0.5, None)], "a long, `b,c` string, d double, t timestamp_ntz")
    names = sinks.export_zip({"One/1": df, "Two": df.limit(0)}, f"{tmp_path}/x.zip")
    assert names == ["One_1.csv", "Two.csv"]
    with zipfile.ZipFile(f"{tmp_path}/x.zip") as z:
        assert z.read("One_1.csv").decode() == 'a,"b,c",d,t\n1,"say ""hi"", ok\nthere",,2024-01-01T12:00:00.000Z\n2,,0.5,\n'
        assert z.read("Two.csv").decode() == 'a,"b,c",d,t\n'
    assert sinks.export_zip({"T": df}, f"{tmp_path}/y.zip", "parquet") == ["T.parquet"]
    import pyarrow.parquet as pq

    with zipfile.ZipFile(f"{tmp_path}/y.zip") as z:
        assert pq.read_table(z.open("T.parquet")).to_pylist() == [r.asDict() for r in df.collect()]
    with pytest.raises(ValueError):
        sinks.export_zip({}, f"{tmp_path}/z.zip", "xml")
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    text = "".join(open(f"{tmp_path}/csv/{f}").read() for f in os.listdir(f"{tmp_path}/csv") if f.endswith(".csv"))
    assert '1,"say ""hi"", ok\nthere",,2024-01-01T12:00:00.000Z\n' in text


def driver_model(spark):
    return models.driver_model(lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet"), spark)


def test_search_and_selection(spark):
    m = driver_model(spark)
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(catalog.search_tables(m, "SUMX")) == ["lineitem"]
    assert names(catalog.search_tables(m, "doc_id", show_hidden=True)) == ["documents", "labels"]
    assert names(catalog.search_measures(m, "blank")) == [] and names(catalog.search_measures(m, "blank", show_hidden=True)) == ["Helper"]
    assert [r["role"] for r in catalog.search_roles(m, "euro").collect()] == ["Europe"]
    assert catalog.keys(m).count() == 12 + 7 + 8 + 2
    assert graph.edges(m).count() == 8 and graph.edges(m, show_hidden=True).count() == 9
    assert catalog.first_m_source(m).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_sessions_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT 45000.5D AS x, TIMESTAMP_NTZ'2024-03-10 02:30:00.1239' AS n, timestamp_micros(1704067200000000) AS t, DATE'2024-01-01' AS d, cast(null AS TIMESTAMP) AS z")
        told = df.select(tx.serial_to_timestamp("x"), tx.iso_timestamp("n"), tx.iso_timestamp("t"), tx.iso_timestamp("d"), tx.preview_timestamp("t"), tx.preview_timestamp("z")).toDF(*"abcdef").first()
        assert tuple(told) == (datetime.datetime(2023, 3, 15, 12), "2024-03-10T02:30:00.123Z", "2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00.000Z", "2024-01-01 00:00:00.000", "null")
        ranged = pf.ranges(df.select("n", "t", "d")).collect()
        assert [r["date_min"] for r in ranged] == [datetime.datetime(2024, 3, 10, 2, 30, 0, 123900), datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1)]
        # an hour that the zone leaves out holds as many times as any other
        gap = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2024-03-10 01:30:00', TIMESTAMP_NTZ'2024-03-10 03:30:00', INTERVAL 30 MINUTES)) AS n")
        assert pf.distinct(gap).first()["distinct"] == 5
        assert sinks.csv_lines(df.select("n", "t", "d")).first()["line"] == "2024-03-10T02:30:00.123Z,2024-01-01T00:00:00.000Z,2024-01-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("value, want", [(0.125, "0.13"), (-0.125, "-0.13"), (1.005, "1.01"), (-0.001, "-0"), (999999.995, "1,000,000"), (-0.0, "-0"), (12345.675, "12,345.68"), (None, None)])
def test_format_stat_halves(spark, value, want):
    assert one(spark, value, tx.format_stat, "double") == want


def test_shortest_numbers(spark):
    cases = {1.0: "1", 1e21: "1e+21", 1e20: "100000000000000000000", 123456789.5: "123456789.5", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 0.000123: "0.000123", 9.36 * 1e22: "9.36e+22", 2e23: "2e+23", -3.5: "-3.5", 0.1 + 0.2: "0.30000000000000004", 2.0**-44: "5.684341886080802e-14", float("-inf"): "-Infinity", 1e7: "10000000", 0.001: "0.001", -0.0: "0"}
    df = spark.createDataFrame(list(cases.items()), "x double, want string")
    assert df.filter(tx.shortest_number("x") != F.col("want")).collect() == []
    row = spark.sql("SELECT 0.1F AS f, 1.50BD AS d, 10BD AS w, 1e21D AS x, cast(2 AS TINYINT) AS b, true AS t")
    assert sinks.csv_lines(row).first()["line"] == "0.1,1.5,10,1e+21,2,true"


def test_markup(spark):
    code = "VAR m = SELECTEDVALUE(&#39;Calendar&#39;[Year 2]) // a \"b\" 1\nRETURN \"x < IF 1\" & m1 -- IN\norder by 1.5 - 2 / \"open"
    got = one(spark, code, tx.token_markup)
    assert got == (
        "<span class=\"dax-kw\">VAR</span> m = SELECTEDVALUE('Calendar'[Year <span class=\"dax-num\">2</span>]) <span class=\"dax-cm\">// a &quot;b&quot; 1</span>\n"
        '<span class="dax-kw">RETURN</span> <span class="dax-str">&quot;x &lt; IF 1&quot;</span> &amp; m1 <span class="dax-cm">-- IN</span>\n'
        '<span class="dax-kw">order by</span> <span class="dax-num">1.5</span> - <span class="dax-num">2</span> / &quot;open'
    )
    assert one(spark, None, tx.token_markup) == "" and one(spark, "", tx.token_markup) == ""


def test_numbering_by_ranges(spark, monkeypatch):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(3000)).alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("s")).repartition(7)
    want = {(r["k"], r["s"], r["data_id"]) for r in rel.dense_ids(df.distinct(), ["k", "s"], 3).collect()}
    words = {tuple(r) for r in rel.dictionary(df, "s", 2).collect()}
    monkeypatch.setattr(rel, "ONE_TASK_BYTES", 0)
    monkeypatch.setattr(rel, "NUMBER_RANGES", 16)
    assert {(r["k"], r["s"], r["data_id"]) for r in rel.dense_ids(df.distinct(), ["k", "s"], 3).collect()} == want
    assert {tuple(r) for r in rel.dictionary(df, "s", 2).collect()} == words == {(k + 2, f"v{k}") for k in range(7)}
    assert rel.dense_ids(df.limit(0), ["k"]).count() == 0
