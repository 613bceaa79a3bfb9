import duckdb

from lattica.llm import contract, decontam

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    items.write.parquet(f"{tmp_path}/i")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/i/*.parquet'")
    got = sorted(tuple(r) for r in decontam.digest(decontam.decontaminate(docs, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == sorted(con.execute(decontam.ORACLE).fetchall())
    return got


def test_random_passages(spark, tmp_path):
    import random

    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "Ab", "é", "x1", "zz"])
    items = [(k, " ".join(word() for _ in range(r.choice([3, 8, 13, 20, 40])))) for k in range(12)] + [(98, ""), (99, None)]
    docs = []
    for k in range(60):
        text = " ".join(word() for _ in range(r.randrange(0, 60)))
        if r.random() < 0.6:
            text += ", " + r.choice(items[:12])[1].upper().replace("É", "é") + ". " + word()
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, " ... ")]
    got = same_as_sql(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), tmp_path)
    assert sum(x[2] > 0 for x in got) > 10


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 3)], "doc_id long, text string, words string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    (row,) = decontam.decontaminate(docs, none, carry=("words",)).collect()
    assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"], row["words"]) == (3, 0, [], False, "x")
    assert decontam.decontaminate(docs.limit(0), none).count() == 0


def test_rows_that_share_an_id_are_judged_alone(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "four five six"), (None, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "One, two; three")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontam.decontaminate(docs, items).collect()) == [(0, 3), (1, 0), (1, 3)]
