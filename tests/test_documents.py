"""Blocks, tables and traced numbers by hand."""

from tidewell.operators import documents

TEXT = """# Title
under it

| a | b \\| c |
|---|:-:|
| 1 | x |
|  | y |

- one
- two

```
code

more
```
after it
## Last"""


def frame(spark, rows, schema="doc int, text string"):
    return spark.createDataFrame(rows, schema)


def test_blocks_and_tables(spark):
    found = documents.blocks(frame(spark, [(1, TEXT), (2, ""), (3, None), (4, "  \n\t\n"), (5, "1. x\r\ny\r\n\r\n# h"), (6, "```\nopen\n\nend")]), "doc", "text")
    got = sorted((r["doc"], r["block"], r["first_line"], len(r["lines"]), r["kind"]) for r in found.collect())
    assert [x for x in got if x[0] == 1] == [(1, 1, 1, 2, "prose"), (1, 2, 4, 4, "table"), (1, 3, 9, 2, "list"), (1, 4, 12, 5, "code"), (1, 5, 17, 2, "prose")]
    assert [x[0] for x in got if x[0] in (2, 3)] == [] and [x[2:] for x in got if x[0] == 5] == [(1, 2, "list"), (4, 1, "heading")] and [x[2:] for x in got if x[0] == 6] == [(1, 4, "code")]
    rows = sorted((r["row"], r["cells"]) for r in documents.table_rows(found, "doc").collect())
    assert rows == [(0, ["a", "b \\| c"]), (1, ["1", "x"]), (2, ["", "y"])]


def test_numbers_are_traced_to_cited_files(spark):
    texts = frame(spark, [(1, "We got 12.35 of 1,200 and -0.5, v2.0.1 and x3 aside; 7 isn't there, 12.35 again."), (2, "12.35"), (3, None)])
    values = documents.pool(spark.createDataFrame([("f", '{"a": [12.3456, "near 1200 m"], "b": 0.5}'), ("g", "h\n12.35,99\n"), ("n", None)], "file string, text string"), "file", "text")
    cited = spark.createDataFrame([(1, "f"), (1, "g"), (1, "none"), (2, "n")], "doc int, file string")
    got = {(r["doc"], r["number"]): r["files"] for r in documents.trace(texts, "doc", "text", cited, values, "file").collect()}
    assert got == {(1, "12.35"): 2, (1, "1200"): 1, (1, "-0.5"): 1, (1, "7"): 0, (2, "12.35"): 0}
