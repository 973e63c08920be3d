"""Documents held against the files they cite: blocks and tables of Markdown, and numbers traced to where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"(?<![A-Za-z0-9_.])-?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][-+]?\d+)?"


def blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, first_line, lines, kind): runs of lines that aren't blank, from 1, each as an array of lines.

    kind: heading (one line of # and words), table (each line begins with a bar), list (the first begins with - or * or a
    number), code (fenced), else prose. A fence opens a block that ends with the next fence, blank lines in it are its own.
    A null or empty text has no blocks. A text's lines are one window, as it is one row.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    fence = F.col("line").rlike(r"^\s*```")
    marked = lines.withColumn("fences", F.sum(fence.cast("int")).over(before)).withColumn("in_code", fence | (F.col("fences") % 2 == 1))
    # A fence's own lines are one block: the closing fence belongs to the one that it closes.
    code = F.when(F.col("in_code"), F.floor((F.col("fences") + 1) / 2))
    filled = marked.withColumn("code", code).withColumn("full", F.col("in_code") | (F.trim("line") != ""))
    new = F.col("full") & (~F.coalesce(F.lag("full").over(w), F.lit(False)) | ~F.col("code").eqNullSafe(F.lag("code").over(w)))
    numbered = filled.withColumn("block", F.sum(new.cast("int")).over(before)).where("full")
    grouped = numbered.groupBy(key, "block").agg(F.min("line_no").alias("first_line"), F.max("in_code").alias("in_code"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("lines"))
    first = F.col("lines")[0]
    kind = (
        F.when(F.col("in_code"), "code").when((F.size("lines") == 1) & first.rlike(r"^#{1,6} "), "heading").when(F.forall("lines", lambda x: F.ltrim(x).startswith("|")), "table")
        .when(first.rlike(r"^\s*(?:[-*]|\d+\.) "), "list").otherwise("prose")
    )
    return grouped.select(key, "block", "first_line", "lines", kind.alias("kind"))


def table_rows(found: DataFrame, key: str) -> DataFrame:
    """(key, block, row, cells): rows of table blocks from 0, the header; the line of dashes under it is none. found: blocks."""
    t = found.where("kind = 'table'").select(key, "block", F.posexplode("lines").alias("i", "line"))
    body = t.where(~F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    return body.select(key, "block", (F.row_number().over(Window.partitionBy(key, "block").orderBy("i")) - 1).alias("row"), cells.alias("cells"))


def numbers_in(text: Column) -> Column:
    """Numbers in a text as they are written, without the commas between thousands; parts of words and of versions aren't numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def decimals(number: Column) -> Column:
    """Places behind the point of a number as it is written."""
    return F.length(F.regexp_extract(number, r"\.(\d+)", 1))


def pool(files: DataFrame, file: str, text: str) -> DataFrame:
    """(file, value), distinct: sizes of all numbers of JSON, CSV or other text, those inside strings too."""
    return files.select(file, F.explode(numbers_in(F.col(text))).alias("n")).select(file, F.abs(F.col("n").try_cast("double")).alias("value")).where("value is not null").distinct()


def trace(texts: DataFrame, key: str, text: str, cited: DataFrame, values: DataFrame, file: str, most_decimals: int = 6) -> DataFrame:
    """(key, number, files): the distinct numbers of each text, and how many of the files that it cites hold them to its decimals.

    cited: key, file. values: pool. A number is traced where a value of a cited file, rounded to as many places as the number
    has (most_decimals at most), is it; signs don't count. Values are joined once for each of the numbers of places that the
    file is asked for, by file and rounded value, so a file's values never meet all numbers of a text.
    """
    told = texts.select(key, F.explode(F.array_distinct(numbers_in(F.col(text)))).alias("number"))
    told = told.withColumns({"places": F.least(decimals(F.col("number")), F.lit(most_decimals)), "size": F.abs(F.col("number").try_cast("double"))})
    spelt = lambda v, d: F.when(d == 0, F.format_string("%.0f", v))

    def rounded(v: Column, d: Column) -> Column:
        out = spelt(v, d)
        for i in range(1, most_decimals + 1):
            out = out.when(d == i, F.format_string(f"%.{i}f", v))
        return out

    asked = told.join(cited.select(key, file).distinct(), key).withColumn("as", rounded(F.col("size"), F.col("places")))
    used = asked.select(file, "places").distinct()
    held = values.join(used, file).withColumn("as", rounded(F.col("value"), F.col("places"))).select(file, "places", "as").distinct()
    hits = asked.join(held, [file, "places", "as"], "left_semi").groupBy(key, "number").agg(F.count_distinct(file).alias("files"))
    return told.select(key, "number").join(hits, [key, "number"], "left").select(key, "number", F.coalesce("files", F.lit(0)).cast("long").alias("files"))
