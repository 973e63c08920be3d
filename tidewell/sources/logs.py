"""Logs, tap maps and inlet files of unknown layout to typed rows, all by Spark: each file's encoding, separator, header, columns and date order are found from its own rows, and each data row has a disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators.matching import map_readings
from ..session import keep
from .files import decode_text
from .model_text import lines_of
from .tables import ROLES

SEPARATORS = [",", ";", "\t", "|"]
#: Header words of a tap map and of an inlet file, the most telling first.
TAP_MAP_ROLES = {"tap": ["tap", "tap id", "sample point", "site", "station"], "junction": ["junction", "junction id", "model node", "node", "node id", "model id"]}
INLET_ROLES = {"residual": ["residual mg l", "residual mgl", "residual", "chlorine", "free chlorine"], "inlet": ["inlet node id", "inlet node", "inlet id", "inlet", "node id", "node"]}
#: Fixed value: mg/L, above which a reading is no chlorine residual.
MOST_MGL = 10.0
#: Months by the first three letters of their names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def split_quoted(line: Column, separator: Column) -> Column:
    """Cells of a line; separators inside quotes don't count, quotes around a cell go, doubled ones are one."""
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    cells = F.lit(None).cast("array<string>")
    for s in SEPARATORS:
        cells = F.when(separator == s, F.split(line, ("\\|" if s == "|" else s) + outside, -1)).otherwise(cells)
    plain = lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(cells, plain)


def layouts(lines: DataFrame, key: str, looked_at: int = 50) -> DataFrame:
    """(key, separator, header): of each file, from its first lines that aren't blank.

    The separator that as many of them as possible have equally often, and more often before less; the header is the first
    line that has it so often, titles above are skipped. A `sep=;` line is believed. Files without any separator have no row.
    """
    body = lines.where("trim(line) != ''").withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("at") <= looked_at)
    hint = F.regexp_extract("line", r'(?i)^\x{FEFF}?"?sep=(.)"?\s*$', 1)
    hinted = body.where(F.col("at") == 1).select(key, "line_no", hint.alias("hint")).where("hint != ''").select(key, "hint")
    bare = F.regexp_replace("line", '"[^"]*"', "")
    each = body.select(key, "line_no", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))).alias("n")) for i, s in enumerate(SEPARATORS)])).alias("s")).where("s.n > 0")
    counted = each.groupBy(key, "s.i", "s.n").agg(F.count(F.lit(1)).alias("same"), F.min("line_no").alias("first"))
    best = counted.groupBy(key).agg(F.max(F.struct((F.col("same") * F.col("n")).alias("w"), (-F.col("i")).alias("i"), "n", "first")).alias("b"))
    found = best.select(key, F.element_at(F.array(*map(F.lit, SEPARATORS)), (1 - F.col("b.i")).cast("int")).alias("separator"), F.col("b.first").alias("header"))
    after = body.join(hinted, key).where("at = 2").select(key, F.col("hint").alias("own"), F.col("line_no").alias("own_header"))
    joined = found.join(after, key, "full")
    return joined.select(key, F.coalesce("own", "separator").alias("separator"), F.coalesce("own_header", "header").alias("header"))


def roles_of(headers: DataFrame, key: str, roles: dict[str, list[str]]) -> DataFrame:
    """(key, role, i, name): for each role in turn the header, from 0, that fits its words best and fits no earlier role; exact fits before contained ones.

    headers: key, cells. Ties go to the first column.
    """
    words = F.trim(F.regexp_replace(parsing.header_words(F.col("name")), "[^a-z ]+", ""))
    each = keep(headers.select(key, F.posexplode("cells").alias("i", "name")).withColumn("words", F.trim(F.regexp_replace(words, " +", " "))).where("words != ''"))
    taken: DataFrame | None = None
    for role, named in roles.items():
        fit = F.lit(None).cast("int")
        for rank, w in reversed([*enumerate(named), *((len(named) + n, w) for n, w in enumerate(named))]):
            hit = (F.col("words") == w) if rank < len(named) else F.contains(F.concat(F.lit(" "), "words", F.lit(" ")), F.lit(f" {w} "))
            fit = F.when(hit, rank).otherwise(fit)
        left = each if taken is None else each.join(taken.select(key, "i"), [key, "i"], "left_anti")
        best = left.withColumn("fit", fit).where("fit is not null").groupBy(key).agg(F.min(F.struct("fit", "i", "name")).alias("b")).select(key, F.lit(role).alias("role"), "b.i", "b.name")
        taken = best if taken is None else taken.unionByName(best)
    return keep(taken)


def by_values(rows: DataFrame, roles: DataFrame, key: str) -> DataFrame:
    """(key, role, i, name) of the reading column of files where no header names one: of the columns without a role, the one most of whose cells read as readings, if over half do."""
    lacking = rows.select(key).distinct().join(roles.where("role = 'reading'").select(key), key, "left_anti")
    each = rows.join(lacking, key, "left_semi").select(key, F.posexplode("cells").alias("i", "cell")).join(roles.select(key, "i"), [key, "i"], "left_anti")
    good = parsing.reading(F.col("cell"))["state"].isin("used", "censored_below", "censored_above")
    share = each.groupBy(key, "i").agg(F.avg(good.cast("double")).alias("share")).where("share > 0.5")
    best = share.groupBy(key).agg(F.min(F.struct((-F.col("share")).alias("s"), "i")).alias("b"))
    return best.select(key, F.lit("reading").alias("role"), "b.i", F.lit(None).cast("string").alias("name"))


def data_rows(files: DataFrame, key: str, content: str, roles: dict[str, list[str]], values: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, roles): rows key, line_no and a text column for each role, null where a file has none; roles as roles_of.

    files: key (a file each, distinct), content binary. Blank lines are no rows; short rows have nulls at their end. A file
    without any separator, header or text has one row, of line 0 with nulls throughout, so that it isn't lost.
    """
    texts = files.select(key, decode_text(F.col(content))["text"].alias("text"))
    lines = keep(lines_of(texts.where("text is not null"), key, "text"))
    found = layouts(lines, key)
    cells = keep(lines.join(found, key).where("line_no >= header and trim(line) != ''").select(key, "line_no", "header", split_quoted(F.col("line"), F.col("separator")).alias("cells")))
    named = roles_of(cells.where("line_no = header"), key, roles)
    rows = cells.where("line_no > header")
    if values:
        named = keep(named.unionByName(by_values(rows, named, key)))
    places = named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("role", "i"))).alias("of"))
    at = lambda role: F.get("cells", F.try_element_at("of", F.lit(role)))
    out = rows.join(places, key, "left").select(key, "line_no", *[at(role).alias(role) for role in roles])
    none = files.select(key).join(rows.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("line_no"), *[F.lit(None).cast("string").alias(role) for role in roles])
    return out.unionByName(none), named


def day_of(text: Column, order: Column) -> Column:
    """Date of ISO, numeric or named-month text (3 Mar 2024, March 3, 2024), with a time and a zone mark behind it or not."""
    numeric, first, second = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\b", r"(?i)^(\d{1,2})[ -]?([a-z]{3})[a-z]*\.?,?[ -]?(\d{4})\b", r"(?i)^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})\b"
    date = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")

    def read(t: Column) -> Column:
        part = lambda p, i: F.regexp_extract(t, p, i)
        number = lambda p, i: parsing.to_int(part(p, i))
        month = lambda p, i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(p, i))), F.lit(0).cast("long"))
        year = parsing.bound(number(numeric, 3), lambda y: F.when(y < 100, y + 2000).otherwise(y))
        a, b = number(numeric, 1), number(numeric, 2)
        plain = date(year, F.when(order == "DMY", b).otherwise(a), F.when(order == "DMY", a).otherwise(b))
        named = F.coalesce(date(number(first, 3), month(first, 2), number(first, 1)), date(number(second, 3), month(second, 1), number(second, 2)))
        return F.coalesce(part(r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date"), F.when(t.rlike("[A-Za-z]{3}"), named), plain)

    return parsing.bound(F.trim(F.regexp_replace(text, r"(?i)\s*(z|utc|gmt|[ecmp][sd]t|[+-]\d{2}:?\d{2})$", "")), read)


def date_orders(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, order): DMY, MDY, both (some dates are only one, some only the other) or either (nothing tells), by all rows of each file."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}", i)
    told = rows.select(key, parsing.to_int(part(1)).alias("a"), parsing.to_int(part(2)).alias("b"))
    tops = told.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.count_if(F.col("a") != F.col("b")).alias("differ"))
    order = F.when((F.col("a") > 12) & (F.col("b") > 12), "both").when(F.col("a") > 12, "DMY").when(F.col("b") > 12, "MDY").when(F.col("differ") > 0, "either").otherwise("MDY")
    return tops.select(key, order.alias("order"))


def read_logs(files: DataFrame, key: str, content: str, sites: DataFrame, site_key: str, site: str, order: str | None = None) -> DataFrame:
    """key, line_no, tap, site, date, minute, value (mg/L), disposition (used, censored, dropped) and reason of each data row of all files.

    sites: site_key, site. order: DMY or MDY, where the reader knows; else a file whose dates don't tell is dropped, as a guess
    would misplace its rows. Units come from the row's units cell or else the reading's header (micrograms are divided by
    1,000). Reasons, the first that holds: a missing column, dates in both or either order, an unreadable date, the tap's
    (see map_readings), below or above detection, a blank or unreadable reading, one over 10 mg/L. No row is lost; a file
    without rows has one.
    """
    c = F.col
    rows, roles = data_rows(files, key, content, ROLES, values=True)
    rows = keep(rows)
    has = lambda role: F.max(c("role") == role)
    known = roles.groupBy(key).agg(has("tap").alias("has_tap"), has("date").alias("has_date"), has("reading").alias("has_reading"), F.max(F.when(c("role") == "reading", parsing.header_unit(c("name")))).alias("unit"))
    told = rows.join(known, key, "left").join(date_orders(rows, key, "date"), key, "left")
    parsed = parsing.reading(c("reading"))
    told = told.withColumns({"p": parsed, "order": F.lit(order) if order else c("order"), "factor": F.coalesce(parsing.header_unit(c("units")), "unit", F.lit(1.0))})
    clock = F.coalesce(c("time"), F.regexp_extract("date", r"(?i)[ T](\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]m)?)", 1))
    told = told.withColumns({"date": F.when(c("order").isin("DMY", "MDY") | c("date").rlike(r"^\s*\d{4}-"), day_of(c("date"), c("order"))), "raw_date": c("date"), "minute": parsing.clock_minutes(clock), "value": c("p.value") * c("factor"), "state": c("p.state")})
    mapped = map_readings(told.withColumn("tap", F.nullif(F.trim("tap"), F.lit(""))), sites, "tap", site_key, site).withColumnRenamed("reason", "of_tap")
    missing = F.concat_ws(", ", *[F.when(~F.coalesce(f"has_{r}", F.lit(False)), f"no {r} column") for r in ("tap", "date", "reading")])
    reason = (
        F.when(c("line_no") == 0, "no rows").when(missing != "", missing).when(c("order") == "both", "dates in both orders").when(c("order") == "either", "day and month in either order")
        .when(c("date").isNull(), "unreadable date").when(c("of_tap").isNotNull(), c("of_tap")).when(c("state") == "censored_below", "below detection").when(c("state") == "censored_above", "above range")
        .when(c("state") == "blank", "blank reading").when(c("state") == "refused", "unreadable reading").when(c("value") > MOST_MGL, "over 10 mg/L")
    )
    disposition = F.when(reason.isNull(), "used").when(reason.isin("below detection", "above range"), "censored").otherwise("dropped")
    return mapped.select(key, "line_no", "tap", "site", "date", "minute", "value", disposition.alias("disposition"), reason.alias("reason"))


def read_tap_map(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, line_no, tap, junction, disposition and reason of each row of tap maps: a tap's first row is used, its repeats are dropped, and all rows of a tap that names several junctions."""
    rows, _ = data_rows(files, key, content, TAP_MAP_ROLES)
    clean = rows.withColumns({x: F.nullif(F.trim(x), F.lit("")) for x in TAP_MAP_ROLES})
    return once_each(clean, key, "tap", "junction", F.lit(None).cast("string"))


def read_inlet_residuals(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, line_no, inlet, residual (mg/L), disposition and reason of each row of inlet files. A residual must be measured: below detection, blank, unreadable and over 10 mg/L are dropped; an inlet with two values is dropped with both."""
    rows, roles = data_rows(files, key, content, INLET_ROLES)
    unit = roles.where("role = 'residual'").select(key, F.coalesce(parsing.header_unit(F.col("name")), F.lit(1.0)).alias("factor"))
    p = parsing.reading(F.col("residual"))
    rows = rows.join(unit, key, "left").withColumns({"inlet": F.nullif(F.trim("inlet"), F.lit("")), "p": p})
    value = F.when(F.col("p.state") == "used", F.col("p.value") * F.coalesce("factor", F.lit(1.0)))
    why = F.when(F.col("p.state") != "used", F.lit("no measured residual")).when(F.col("residual") > MOST_MGL, "over 10 mg/L")
    return once_each(rows.withColumn("residual", value), key, "inlet", "residual", why)


def once_each(rows: DataFrame, key: str, name: str, value: str, why: Column) -> DataFrame:
    """Each name's first row is used; later equal ones are repeats, and names with several values in a file are dropped. Per-name counts are aggregated, not windowed, so a hot name is no task's own."""
    good = rows.withColumn("why", F.when(F.col("line_no") == 0, "no rows").when(F.col(name).isNull(), f"no {name}").otherwise(F.coalesce(why, F.when(F.col(value).isNull(), f"no {value}"))))
    told = good.where("why is null").groupBy(key, name).agg(F.count_distinct(value).alias("values"), F.min("line_no").alias("first"))
    reason = F.coalesce("why", F.when(F.col("values") > 1, f"{name} has several values"), F.when(F.col("line_no") > F.col("first"), "repeated"))
    out = good.join(told, [key, name], "left").withColumn("reason", reason)
    return out.select(key, "line_no", name, value, F.when(F.col("reason").isNull(), "used").otherwise("dropped").alias("disposition"), "reason")
