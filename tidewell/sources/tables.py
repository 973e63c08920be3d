"""Delimited text with unknown layout: separator, title lines, roles of columns, whole-column date order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header words by role, the most telling first.
ROLES = {
    "date": ["date", "sample date", "collected", "date time", "datetime"], "time": ["time", "sample time", "collection time"], "tap": ["tap", "tap id", "sample point", "site", "location", "station"],
    "reading": ["free chlorine", "chlorine", "residual", "result", "value", "total chlorine"], "units": ["units", "unit"], "notes": ["notes", "comment", "comments", "remarks"],
}


def layout(first_lines: list[str]) -> tuple[str, int]:
    """(separator, header line from 0): the separator whose count is the same, and highest, over most lines; titles above are skipped.

    A `sep=;` line is believed. Looks at a file's first lines only, which the driver reads.
    """
    if first_lines and (m := re.match(r'^"?sep=(.)"?\s*$', first_lines[0].strip("﻿"), re.I)):
        return m[1], 1
    best = (0, ",", 0)
    for sep in ",;\t|":
        counts = [line.count(sep) for line in first_lines]
        for n in sorted({c for c in counts if c}, reverse=True):
            same = sum(c == n for c in counts)
            if (same * n, -len(best[1])) > (best[0], -1):
                best = (same * n, sep, counts.index(n))
    return best[1], best[2]


def guess_roles(headers: list[str]) -> dict[str, str]:
    """Role -> header, each header once, by the roles' words."""
    plain = {h: " ".join(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", h).lower())) for h in headers}
    out: dict[str, str] = {}
    for role, words in ROLES.items():
        for exact in (True, False):
            for w in words:
                hit = next((h for h in headers if h not in out.values() and (plain[h] == w if exact else w in plain[h])), None)
                if hit and role not in out:
                    out[role] = hit
    return out


def split_cells(lines: DataFrame, line: str, separator: str, width: int) -> DataFrame:
    """Adds `cells`, an array of `width` texts: quotes are taken off, short rows padded with nulls."""
    parts = F.from_csv(line, F.lit(", ".join(f"c{i} STRING" for i in range(width))), {"sep": separator, "mode": "PERMISSIVE"})
    return lines.withColumn("cells", F.array(*[parts[f"c{i}"] for i in range(width)]))


def date_order(df: DataFrame, text: str) -> DataFrame:
    """One row: order is DMY, MDY, both (refuse), or either (ask) for a column of numeric dates, decided over all rows."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}", i).try_cast("int")
    tops = df.agg(F.max(part(1)).alias("a"), F.max(part(2)).alias("b"), F.count_if(part(1) != part(2)).alias("differ"))
    order = F.when((F.col("a") > 12) & (F.col("b") > 12), "both").when(F.col("a") > 12, "DMY").when(F.col("b") > 12, "MDY").when(F.col("differ") > 0, "either").otherwise("MDY")
    return tops.select(order.alias("order"))


def date_of(text: Column, order: Column) -> Column:
    """Date of ISO or numeric text; two-digit years are of this century; null where it isn't one."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})", i).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    iso = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    month, day = F.when(order == "DMY", part(2)).otherwise(part(1)), F.when(order == "DMY", part(1)).otherwise(part(2))
    return F.coalesce(iso, F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date"))
