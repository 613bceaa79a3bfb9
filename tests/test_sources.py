import dataclasses
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import markdown
from lattica.sources import bim, package, tmdl
from tests import samples


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("models")
    samples.write(path)
    return path


@pytest.fixture(scope="module")
def model(spark, folder):
    return bim.read_bim(spark, [f"{folder}/{n}.bim" for n in ("bookshop", "empty", "wide")])


def rows(df, *columns, model_id="bookshop"):
    """Rows of one model in the order of the source."""
    own = df.filter(F.col("model_id").contains(model_id))
    at = [c for c in ("ord",) if c in df.columns]
    return [tuple(r) for r in own.orderBy(*at, *columns).select(*columns).collect()]


COLUMNS = [
    ("Books", "Isbn", "string", "data", True, None, "", None, ""),
    ("Books", "Title", "string", "data", False, None, "", "Isbn", "Text"),
    ("Books", "Price", "decimal", "data", False, None, "0.00", None, ""),
    ("Books", "Dear", "boolean", "calculated", False, "[Price]\n  > 50", "", None, ""),
    ("Books", samples.HARD, "string", "data", False, None, "", None, ""),
    ("Days", "Day", "dateTime", "data", False, None, "", None, ""),
    ("Helper's", "Key", "int64", "data", False, None, "", None, ""),
    ("Periods", "Name", "string", "data", False, None, "", None, ""),
    ("Sales", "Isbn", "string", "data", False, None, "", None, ""),
    ("Sales", "Day", "dateTime", "data", False, None, "", None, ""),
    ("Sales", "Shop Key", "int64", "data", False, None, "", None, ""),
]
MEASURES = [("Books", "Stock Value", "SUMX(\n  Books, [Price]\n)", "#,0", "Money", "What all books cost", False), ("Books", "Old", "1", "", "", "", True), ("Sales", "Sold", "COUNTROWS(Sales)", "", "", "", False)]
TABLES = [("Books", "import", False), ("Sales", "directQuery", False), ("Days", "calculated", False), ("Helper's", "dual", True), ("Periods", "calculated", False)]
RELATIONSHIPS = [("Sales", "Isbn", "Books", "Isbn", "manyToOne", "single", True), ("Sales", "Day", "Days", "Day", "manyToOne", "both", False), ("Sales", "Shop Key", "Helper's", "Key", "oneToOne", "single", True)]
ROLES = [("Clerk", "Books", "[Price]\n< 9"), ("Clerk", "Sales", ""), ("Owner", None, None)]


def check(m, model_id, levels, last_partition):
    """What both forms of the sample hold."""
    own = lambda df, *cs: rows(df, *cs, model_id=model_id)
    assert own(m.models, "name", "compatibility_level", "culture") == [("Bookshop", 1567, "en-GB")]
    assert own(m.tables, "name", "type", "is_hidden") == TABLES
    columns = own(m.columns, "table", "name", "data_type", "type", "is_hidden", "expression", "format_string", "sort_by_column", "display_folder")
    assert sorted(columns, key=lambda r: r[0]) == COLUMNS
    assert sorted(own(m.measures, "table", "name", "expression", "format_string", "display_folder", "description", "is_hidden"), key=lambda r: r[0]) == MEASURES
    assert own(m.hierarchies, "table", "name", "levels") == [("Books", "Shelves", levels)]
    assert sorted(own(m.partitions, "table", "type", "expression", "mode")) == [("Books", "m", "let\n  x = 1\nin x", "import"), ("Days", "calculated", "CALENDARAUTO()", ""), ("Helper's", "entity", "helper", ""), last_partition, ("Sales", "query", "SELECT 1", "directQuery")]
    assert own(m.calculation_items, "table", "name", "expression", "ordinal") == [("Periods", "Now", "SELECTEDMEASURE()", 0), ("Periods", "YTD", "CALCULATE(\n  SELECTEDMEASURE())", 1)]
    assert own(m.relationships, "from_table", "from_column", "to_table", "to_column", "cardinality", "cross_filter_direction", "is_active") == RELATIONSHIPS
    assert own(m.role_permissions, "role", "table", "filter_expression") == ROLES


def test_json(model):
    check(model, "bookshop", ["Floor", "Title", ""], ("Helper's", "unknown", "", "dual"))
    assert rows(model.tables, "description") == [("All books\nby shelf",), ("",), ("",), ("",), ("",)]
    # the row number is left out, and the others keep their places
    assert rows(model.columns.filter("table = 'Books'"), "ord") == [(k,) for k in range(1, 6)]


def test_other_json(model):
    assert rows(model.models, "name", "compatibility_level", "culture", model_id="empty") == [("Nothing", 1604, "")]
    for df in (model.tables, model.columns, model.measures, model.relationships, model.role_permissions):
        assert df.filter(F.col("model_id").contains("empty")).count() == 0
    assert (len(rows(model.tables, "name", model_id="wide")), len(rows(model.columns, "name", model_id="wide")), len(rows(model.relationships, "to_table", model_id="wide"))) == (30, 150, 29)


def test_documents(spark, folder):
    m = tmdl.read_tmdl(spark, f"{folder}/docs")
    check(m, "docs", ["Floor", "Title"], ("Helper's", "unknown", "", "dual"))


def test_packages_and_folders(spark, folder, tmp_path):
    def packed(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    text = json.dumps(samples.JSON)
    files = {
        "t.pbit": packed({"DataModelSchema": ("\ufeff" + text).encode("utf-16-le"), "Version": b"1"}),
        "u.pbit": packed({"DataModelSchema": text.encode("utf-16-le")}),
        "j.pbip": packed({"x.SemanticModel/MODEL.BIM": text}),
        "d.zip": packed({f"x.SemanticModel/{n}": d for n, d in samples.DOCUMENTS.items()}),
        "p.bim": text.encode(),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "live.pbix").write_bytes(packed({"Connections": b"{}"}))
    (tmp_path / "none.zip").write_bytes(packed({"readme.txt": b""}))
    (tmp_path / "cut.pbit").write_bytes(files["t.pbit"][:100])
    m = package.read_models(spark, [f"{tmp_path}/{n}" for n in files])
    for name in files:
        levels = ["Floor", "Title"] if name == "d.zip" else ["Floor", "Title", ""]
        check(m, name, levels, ("Helper's", "unknown", "", "dual"))
    formats = {os.path.basename(r["model_id"]): r["source_format"] for r in m.models.collect()}
    assert formats == {"t.pbit": "pbit", "u.pbit": "pbit", "j.pbip": "bim", "d.zip": "tmdl", "p.bim": "bim"}
    # one broken file doesn't end the reading of the others, unless it is asked to
    told = package.documents(spark.read.format("binaryFile").load(str(tmp_path)), strict=False)
    reasons = {os.path.basename(r["path"]): r["text"] for r in told.filter("kind = 'broken'").collect()}
    assert set(reasons) == {"live.pbix", "none.zip", "cut.pbit"} and "only a connection" in reasons["live.pbix"]
    assert package.read_models(spark, str(tmp_path), strict=False).models.count() == len(files)
    with pytest.raises(Exception, match="no model inside"):
        package.read_models(spark, [f"{tmp_path}/none.zip"])
    check(package.read_folder(spark, f"{folder}/docs"), "docs", ["Floor", "Title"], ("Helper's", "unknown", "", "dual"))
    # a folder with a JSON model in it is that model
    (tmp_path / "p" / "x").mkdir(parents=True)
    (tmp_path / "p" / "x" / "Model.bim").write_bytes(files["p.bim"])
    (tmp_path / "p" / "t.tmdl").write_text("table T")
    check(package.read_folder(spark, f"{tmp_path}/p"), "Model.bim", ["Floor", "Title", ""], ("Helper's", "unknown", "", "dual"))


REPORT = """# Model: Bookshop
Compatibility Level: 1567 | Tables: 5 | Measures: 3 | Relationships: 3

## Tables

### Books
> All books
by shelf
| Column | Type | Hidden | Calculated | Format |
|--------|------|:------:|:----------:|--------|
| Isbn | string | Yes |  |  |
| Title | string |  |  |  |
| Price | decimal |  |  | 0.00 |
| Dear | boolean |  | Yes |  |
| Odd <name> & "quotes" \\| bar: é | string |  |  |  |

Source (M):
```
let
  x = 1
in x
```

**Books[Dear]** (calculated column)
```dax
[Price]
  > 50
```
"""


def test_report(spark, model):
    one = type(model)(*(getattr(model, f.name).filter(F.col("model_id").contains("bookshop")) for f in dataclasses.fields(model)))
    text = markdown.text(markdown.report(one)).first()["text"]
    assert text.startswith(REPORT)
    lines = text.split("\n")
    order = [lines.index(x) for x in ("## Tables", "## Measures", "## Calculation Groups", "## Relationships", "## Roles")]
    assert order == sorted(order)
    assert [x for x in lines if x.startswith("### ")] == ["### Books", "### Sales [directQuery]", "### Days [calculated]", "### Helper's [dual]", "### Periods [calculated]", "### Table: Books", "### Table: Sales", "### Periods"]
    after = text[text.index("## Relationships") :]
    assert after == """## Relationships
| From | To | Cardinality | Direction | Active |
|------|-----|:-----------:|:---------:|:------:|
| Sales[Isbn] | Books[Isbn] | *:1 | Single | Yes |
| Sales[Day] | Days[Day] | *:1 | Both | No |
| Sales[Shop Key] | Helper's[Key] | 1:1 | Single | Yes |

## Roles

**Clerk**
- Books: `[Price]
< 9`

**Owner**
"""
    chosen = spark.createDataFrame([("table:Days",), ("measure:Books:Stock Value",)], "key string")
    part = markdown.text(markdown.report(one, chosen)).first()["text"].split("\n")
    assert part[1] == lines[1] and "### Days [calculated]" in part and "**Stock Value** | Format: #,0" in part and "## Roles" not in part and "### Books" not in part
    empty = type(model)(*(getattr(model, f.name).filter(F.col("model_id").contains("empty")) for f in dataclasses.fields(model)))
    assert markdown.text(markdown.report(empty)).first()["text"] == "# Model: Nothing\nCompatibility Level: 1604 | Tables: 0 | Measures: 0 | Relationships: 0\n"
    numbered = markdown.numbered(markdown.report(one)).orderBy("n").collect()
    assert "\n".join(r["line"] for r in numbered) == text


def test_broken_json_gives_nothing(spark):
    docs = spark.createDataFrame([("a", "{not json"), ("b", '﻿{"name": "B", "tables": [{"name": "t", "columns": [{"name": "c", "type": "rowNumber"}, {}]}]}'), ("c", None)], "model_id string, text string")
    m = bim.from_json(docs)
    assert [r["name"] for r in m.models.collect()] == ["B"]
    (c,) = m.columns.collect()
    assert (c["name"], c["data_type"], c["type"], c["is_hidden"], c["expression"], c["ord"]) == ("", "string", "data", False, None, 1)
    assert sorted(r["model_id"] for r in bim.broken(docs).collect()) == ["a", "c"]


def test_tmdl_grammar():
    text = """/// dropped
table 'It''s'
\tisHidden

\t/// what it is
\t/// and more
\tmeasure 'A = B' = ```
\t\t\tVAR x = 1

\t\t\tRETURN x
\t\t\t```
\t\tformatString: 0

\tmeasure Block =
\t\t\tSUM(a)

\t\t\t    + 1
\t\tdisplayFolder: F

\t\tkpi
\t\t\ttargetExpression = 5

    column c
        dataType: int64
        isHidden: false

\tcolumn d = [c] + 1

\thierarchy h
\t\tlevel l1
\t\t\tcolumn: c

\tpartition p = m
\t\tmode: import
\t\tsource =
\t\t\t\tlet
\t\t\t\t    x = 1
\t\t\t\tin x
"""
    found = {(o["kind"], o["name"]): o for o in tmdl.objects(text)}
    assert found["table", "It's"]["props"] == {"isHidden": "true"}
    assert found["measure", "A = B"]["expression"] == "VAR x = 1\n\nRETURN x" and found["measure", "A = B"]["description"] == "what it is\nand more"
    assert found["measure", "Block"]["expression"] == "SUM(a)\n\n    + 1" and found["measure", "Block"]["props"] == {"displayFolder": "F"}
    assert found["column", "c"]["props"] == {"dataType": "int64", "isHidden": "false"}
    assert found["column", "d"]["expression"] == "[c] + 1"
    assert found["level", "l1"]["props"] == {"column": "c"}
    assert found["partition", "p"]["props"]["source"] == "let\n    x = 1\nin x"


def test_tmdl_roles(spark):
    docs = spark.createDataFrame(
        [("m", "x/roles/R.tmdl", "role R\n\tmodelPermission: read\n\n\ttablePermission Sales = [a] = 1\n\n\ttablePermission 'T 2' =\n\t\t\t[b] = 2\n"), ("m", "x/roles/Q.tmdl", "role Q\n\tmodelPermission: read\n"), ("m", "x/tables/T.tmdl", "table T\n\n\tpartition T = calculated\n\t\tsource = ROW(1)\n")],
        "model_id string, path string, text string",
    )
    m = tmdl.from_documents(docs)
    assert sorted((r["role"], r["table"] or "", r["filter_expression"] or "") for r in m.role_permissions.collect()) == [("Q", "", ""), ("R", "Sales", "[a] = 1"), ("R", "T 2", "[b] = 2")]
    assert [(r["name"], r["type"]) for r in m.tables.collect()] == [("T", "calculated")]
    assert [r["expression"] for r in m.partitions.collect()] == ["ROW(1)"]
