"""Column builders that read messy text cells: readings, clock times, units, pipe sizes, ids and years."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean "not detected".
NOT_DETECTED = ["nd", "n.d.", "n/d", "non-detect", "nondetect", "non detect", "not detected", "bdl", "below detection", "<dl", "<mdl", "<rl", "<lod", "<mrl"]
#: Words and marks of a blank cell.
BLANK = ["", "-", "--", "na", "n/a", "nan", "null", "none"]


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once a row however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def to_double(text: Column) -> Column:
    """text as a double, else null. Empty text isn't given to the cast, which throws and catches an exception for each."""
    return bound(text, lambda x: F.when(x != "", x.try_cast("double")))


def to_int(text: Column) -> Column:
    """text as an int, else null; as to_double."""
    return bound(text, lambda x: F.when(x != "", x.try_cast("int")))


def reading(text: Column) -> Column:
    """struct(value double, state string): used, censored_below, censored_above, blank or refused.

    Accepts a decimal point or comma and a trailing mg/L or ppm. '<x' is below x, '>x' above; negative numbers are refused.
    """
    t = F.lower(F.trim(text))
    body = F.trim(F.regexp_replace(t, r"\s*(mg/l|ppm)$", ""))
    number = lambda b: F.regexp_extract(b, r"^(?:[<>]=?)?\s*([0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)$", 1)
    parts = lambda b: F.struct(t.alias("t"), F.regexp_extract(b, "^([<>])=?", 1).alias("sign"), to_double(F.translate(number(b), ",", ".")).alias("value"))

    def judge(p: Column) -> Column:
        t, sign, value = p["t"], p["sign"], p["value"]
        state = (
            F.when(t.isNull() | t.isin(BLANK), "blank").when(t.isin(NOT_DETECTED) | ((sign == "<") & value.isNotNull()), "censored_below")
            .when((sign == ">") & value.isNotNull(), "censored_above").when(value.isNotNull(), "used").otherwise("refused")
        )
        return bound(state, lambda s: F.struct(F.when(s.isin("used", "censored_below", "censored_above"), value).alias("value"), s.alias("state")))

    return bound(bound(body, parts), judge)


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of 9:15, 09.15, 9:15:30, 9:15 PM or 0915; null where there's none. Seconds are cut."""
    t = F.upper(F.trim(text))
    part = lambda i: F.regexp_extract(t, r"^([0-9]{1,2})[:.]?([0-9]{2})(?::[0-9]{2})?\s*([AP]M)?$", i)
    hour, minute, half = to_int(part(1)), to_int(part(2)), part(3)
    full = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.when((full < 24) & (minute < 60), full * 60 + minute)


def model_hour(minute: Column, start_minute: Column | int) -> Column:
    """Hour of a model day that starts at start_minute."""
    return F.floor(F.pmod(minute - F.lit(start_minute), F.lit(1440)) / 60).cast("int")


def clock_label(hour: Column, start_minute: Column | int) -> Column:
    m = F.pmod(hour * 60 + F.lit(start_minute), F.lit(1440))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def header_words(text: Column) -> Column:
    """Header text in words: camel case split, lower-cased, punctuation as single spaces."""
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(split), "[^a-z0-9µ]+", " "))


def header_unit(text: Column) -> Column:
    """Factor to mg/L that a header names: 0.001 for micrograms or ppb, 1 for milligrams or ppm, else null."""
    t = F.lower(text)
    return F.when(t.rlike(r"[µu]g\s*/\s*l|\bppb\b"), F.lit(0.001)).when(t.rlike(r"mg\s*/\s*l|\bppm\b"), F.lit(1.0))


def clean_id(text: Column) -> Column:
    """An id of letters, digits and _ . - : + / # @, at most 31 bytes in UTF-8; longer ones are cut and end in a digest; of nothing, X."""
    t = F.trim(text)
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_.\-:+/#@]", "_"), "_+", "_"), "^_|_$", "")

    def short(x: Column) -> Column:
        heads = F.filter(F.transform(F.sequence(F.lit(0), F.lit(22)), lambda n: F.substr(x, F.lit(1), n)), lambda h: F.octet_length(h) <= 22)
        head = F.when(F.octet_length(x) == F.length(x), F.substring(x, 1, 22)).otherwise(F.try_element_at(heads, F.lit(-1)))
        return F.when(x == "", "X").when(F.octet_length(x) <= 31, x).otherwise(F.concat(head, F.lit("_"), F.substring(F.sha1(t.cast("binary")), 1, 8)))

    return bound(safe, short)


def year(text: Column) -> Column:
    """A year of 1850-2029 in a date, an epoch in milliseconds, yyyymmdd or a token of text."""
    t = F.trim(text)
    found = (
        F.when(t.rlike("^[0-9]{8}$"), F.substring(t, 1, 4).try_cast("int"))
        .when(t.rlike("^[0-9]{11,13}$"), F.year(F.timestamp_millis(t.try_cast("bigint"))))
        .otherwise(F.regexp_extract(t, r"(?:^|[^0-9])((?:18[5-9]|19[0-9]|20[0-2])[0-9])(?:[^0-9]|$)", 1).try_cast("int"))
    )
    return F.when(found.between(1850, 2029), found)


def bare_unit(least: Column, most: Column) -> Column:
    """Unit of a column of bare pipe sizes by its range: inches, millimetres, metres, or null."""
    return F.when((least >= 2) & (most <= 48), "in").when((least >= 50) & (most <= 1200), "mm").when((least >= 0.05) & (most <= 1.2), "m")


def pipe_size(text: Column) -> Column:
    """struct(value, unit, flag) of a pipe size as drawings and layers write it.

    unit is in, mm, cm, m, or null for a bare number; flag is null, empty, unreadable, reducer or two sizes. A number with a
    unit wins over a bare one. Lengths (350', L=350) and years beside another number are passed over. Two sizes with units
    within five percent of each other are one, its inch value.
    """
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[″“”]|''", '"'), "[’′‘]", "'")))
    t = F.regexp_replace(F.regexp_replace(t, "[ø⌀]", ""), r"(\d),(\d{3})(?!\d)", "$1$2")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"\bl\s*=\s*[0-9.]+\s*'?", " "), r"[0-9.]+\s*'(?!')", " ")
    return bound(t, lambda t: bound(bare(t), lambda b: bound(sizes_in(b), lambda p: judged(t, p))))


def sizes_in(bare: Column) -> Column:
    """struct of the sizes that a cleaned cell names: inches, mm, cm, m, the two of a pair x1 x x2, those of a & b, a bare number."""
    g = lambda p, i=1: F.regexp_extract(bare, p, i)
    number = r"(\d+(?:\.\d+)?)"
    pair = lambda i: to_double(g(rf'{number}\s*"?\s*x\s*{number}', i))
    both = lambda i: to_double(g(rf"{number}\s*(?:&|and)\s*{number}", i))
    inch = r'(?:"|in\b|inch)'
    mixed, part = rf"(\d+)[- ]+(\d+)/(\d+)\s*{inch}", rf"(?<![\d-])(\d+)/(\d+)\s*{inch}"
    inches = F.coalesce(
        to_double(g(mixed, 1)) + to_double(g(mixed, 2)) / to_double(g(mixed, 3)), to_double(g(part, 1)) / to_double(g(part, 2)),
        to_double(g(rf"{number}\s*{inch}")), to_double(g(rf"\bnps\s*{number}")),
    )
    mm = F.coalesce(to_double(g(rf"\bdn\s*{number}")), to_double(g(rf"{number}\s*mm\b")))
    cm, m = to_double(g(rf"{number}\s*cm\b")), to_double(g(rf"(?<![=\d]){number}\s*m\b"))
    alone = F.regexp_extract_all(F.regexp_replace(bare, r"\b(?:18[5-9]\d|19\d\d|20[0-2]\d|2030)\b", " "), F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"), F.lit(1))
    only = bound(alone, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)).try_cast("double")))
    single = F.coalesce(to_double(g(r"^\s*(\d+(?:\.\d+)?)\s*$")), only)
    return F.struct(inches.alias("inches"), mm.alias("mm"), cm.alias("cm"), m.alias("m"), pair(1).alias("x1"), pair(2).alias("x2"), both(1).alias("a"), both(2).alias("b"), single.alias("single"))


def judged(t: Column, p: Column) -> Column:
    """pipe_size's struct of a cell t and the sizes p in it."""
    inches, mm, cm, m, single = (p[k] for k in ("inches", "mm", "cm", "m", "single"))
    named = t.isin("na", "n/a", "unknown", "unk", "?", "-")
    dual = inches.isNotNull() & mm.isNotNull() & (F.abs(inches * 25.4 - mm) <= 0.05 * mm)
    flag = (
        F.when(t.isNull() | t.isin("", "0", "none", "null"), "empty").when(named, "unreadable").when(p["x1"].isNotNull() & (p["x1"] != p["x2"]), "reducer").when(p["a"].isNotNull() & (p["a"] != p["b"]), "two sizes")
        .when(inches.isNotNull() & mm.isNotNull() & ~dual, "two sizes").when(F.coalesce(inches, mm, cm, m, p["x1"], single).isNull(), "unreadable")
    )
    unit = F.when(inches.isNotNull(), "in").when(mm.isNotNull(), "mm").when(cm.isNotNull(), "cm").when(m.isNotNull(), "m")
    out = lambda flag: F.struct(F.when(flag.isNull(), F.coalesce(inches, mm, cm, m, p["x1"], single)).alias("value"), F.when(flag.isNull(), unit).alias("unit"), flag.alias("flag"))
    return bound(flag, out)


def diameter_mm(text: Column) -> Column:
    """Pipe size in millimetres of cells that name a unit; null for bare numbers, lengths, reducers and others."""
    factor = lambda u: F.when(u == "in", 25.4).when(u == "mm", 1.0).when(u == "cm", 10.0).when(u == "m", 1000.0)
    return bound(pipe_size(text), lambda size: size["value"] * factor(size["unit"]))
