"""A model of a bookshop, as a JSON document and as a set of indented documents."""

import json

HARD = 'Odd <name> & "quotes" | bar: é'

JSON = {
    "name": "Bookshop",
    "compatibilityLevel": 1567,
    "model": {
        "culture": "en-GB",
        "tables": [
            {
                "name": "Books",
                "description": ["All books", "by shelf"],
                "columns": [
                    {"name": "Row", "type": "rowNumber", "dataType": "int64"},
                    {"name": "Isbn", "dataType": "string", "isHidden": True},
                    {"name": "Title", "dataType": "string", "sortByColumn": "Isbn", "displayFolder": "Text"},
                    {"name": "Price", "dataType": "decimal", "formatString": "0.00"},
                    {"name": "Dear", "type": "calculated", "dataType": "boolean", "expression": ["[Price]", "  > 50"]},
                    {"name": HARD},
                ],
                "measures": [
                    {"name": "Stock Value", "expression": ["SUMX(", "  Books, [Price]", ")"], "formatString": "#,0", "displayFolder": "Money", "description": "What all books cost"},
                    {"name": "Old", "expression": "1", "isHidden": True},
                ],
                "hierarchies": [{"name": "Shelves", "levels": [{"name": "Floor"}, {"column": "Title"}, {}]}],
                "partitions": [{"mode": "import", "source": {"type": "m", "expression": ["let", "  x = 1", "in x"]}}],
            },
            {
                "name": "Sales",
                "columns": [{"name": "Isbn", "dataType": "string"}, {"name": "Day", "dataType": "dateTime"}, {"name": "Shop Key", "dataType": "int64"}],
                "measures": [{"name": "Sold", "expression": "COUNTROWS(Sales)"}],
                "partitions": [{"mode": "directQuery", "source": {"type": "query", "query": "SELECT 1"}}],
            },
            {"name": "Days", "columns": [{"name": "Day", "dataType": "dateTime"}], "partitions": [{"source": {"type": "calculated", "expression": "CALENDARAUTO()"}}]},
            {"name": "Helper's", "isHidden": True, "columns": [{"name": "Key", "dataType": "int64"}], "partitions": [{"source": {"type": "entity", "entityName": "helper"}}, {"mode": "dual", "source": {"type": "other"}}]},
            {"name": "Periods", "calculationGroup": {"calculationItems": [{"name": "Now", "expression": "SELECTEDMEASURE()"}, {"name": "YTD", "expression": ["CALCULATE(", "  SELECTEDMEASURE())"], "ordinal": 1}]}, "columns": [{"name": "Name"}]},
        ],
        "relationships": [
            {"fromTable": "Sales", "fromColumn": "Isbn", "toTable": "Books", "toColumn": "Isbn"},
            {"fromTable": "Sales", "fromColumn": "Day", "toTable": "Days", "toColumn": "Day", "isActive": False, "crossFilteringBehavior": "bothDirections"},
            {"fromTable": "Sales", "fromColumn": "Shop Key", "toTable": "Helper's", "toColumn": "Key", "fromCardinality": "one", "toCardinality": "one"},
        ],
        "roles": [{"name": "Clerk", "tablePermissions": [{"name": "Books", "filterExpression": ["[Price]", "< 9"]}, {"table": "Sales"}]}, {"name": "Owner"}],
    },
}

DOCUMENTS = {
    "definition/database.tmdl": "database Bookshop\n\tcompatibilityLevel: 1567\n",
    "definition/model.tmdl": "model Bookshop\n\tculture: en-GB\n\nref table Books\nref role Clerk\n",
    "definition/relationships.tmdl": """relationship 6f1
\tfromColumn: Sales.Isbn
\ttoColumn: Books.Isbn

relationship 6f2
\tisActive: false
\tcrossFilteringBehavior: bothDirections
\tfromColumn: Sales.Day
\ttoColumn: Days.Day

relationship 6f3
\tfromCardinality: one
\ttoCardinality: one
\tfromColumn: Sales.'Shop Key'
\ttoColumn: 'Helper\'\'s'.Key
""".replace("\\'", "'"),
    "definition/tables/A Books.tmdl": f"""/// All books
table Books
\tlineageTag: 1

\t/// What all books cost
\tmeasure 'Stock Value' = ```
\t\t\tSUMX(
\t\t\t  Books, [Price]
\t\t\t)
\t\t\t```
\t\tformatString: #,0
\t\tdisplayFolder: Money

\tmeasure Old = 1
\t\tisHidden

\tcolumn Isbn
\t\tdataType: string
\t\tisHidden

\tcolumn Title
\t\tdataType: string
\t\tsortByColumn: Isbn
\t\tdisplayFolder: Text

\tcolumn Price
\t\tdataType: decimal
\t\tformatString: 0.00

\tcolumn Dear =
\t\t\t[Price]
\t\t\t  > 50
\t\tdataType: boolean

\tcolumn '{HARD}'

\thierarchy Shelves
\t\tlevel Floor
\t\t\tcolumn: Title

\t\tlevel Title
\t\t\tcolumn: Title

\tpartition Books = m
\t\tmode: import
\t\tsource =
\t\t\t\tlet
\t\t\t\t  x = 1
\t\t\t\tin x
""",
    "definition/tables/B Sales.tmdl": """table Sales

    measure Sold = COUNTROWS(Sales)

    column Isbn
        dataType: string

    column Day
        dataType: dateTime

    column 'Shop Key'
        dataType: int64

    partition Sales = query
        mode: directQuery
        source = SELECT 1
""",
    "definition/tables/C Days.tmdl": "table Days\n\n\tcolumn Day\n\t\tdataType: dateTime\n\n\tpartition Days = calculated\n\t\tsource = CALENDARAUTO()\n",
    "definition/tables/D Helper.tmdl": "table 'Helper''s'\n\tisHidden\n\n\tcolumn Key\n\t\tdataType: int64\n\n\tpartition a = entity\n\t\tsource = helper\n\n\tpartition b = other\n\t\tmode: dual\n",
    "definition/tables/E Periods.tmdl": "table Periods\n\n\tcalculationGroup\n\n\t\tcalculationItem Now = SELECTEDMEASURE()\n\n\t\tcalculationItem YTD =\n\t\t\t\tCALCULATE(\n\t\t\t\t  SELECTEDMEASURE())\n\t\t\tordinal: 1\n\n\tcolumn Name\n",
    "definition/roles/Clerk.tmdl": "role Clerk\n\tmodelPermission: read\n\n\ttablePermission Books =\n\t\t\t[Price]\n\t\t\t< 9\n\n\ttablePermission Sales\n",
    "definition/roles/Owner.tmdl": "role Owner\n\tmodelPermission: administrator\n",
}

EMPTY = {"name": "Nothing", "compatibilityLevel": 1604, "model": {}}
WIDE = {"name": "Wide", "model": {"tables": [{"name": f"T{k}", "columns": [{"name": f"c{j}"} for j in range(5)]} for k in range(30)], "relationships": [{"fromTable": f"T{k}", "fromColumn": "c0", "toTable": f"T{k + 1}", "toColumn": "c0"} for k in range(29)]}}


def write(folder) -> None:
    """bookshop.bim, empty.bim, wide.bim and the documents under docs/."""
    for name, model in (("bookshop", JSON), ("empty", EMPTY), ("wide", WIDE)):
        with open(f"{folder}/{name}.bim", "w", encoding="utf-8") as f:
            f.write(("\ufeff" if name == "wide" else "") + json.dumps(model, ensure_ascii=name == "empty"))
    for name, text in DOCUMENTS.items():
        path = folder / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
