"""What a file is, and its text: by content, over `binaryFile` rows or any table with bytes."""

from __future__ import annotations

import codecs
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading bytes, as hexadecimal, of binary kinds.
MAGIC = {
    "sqlite": "53514C69746520666F726D6174203300", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1", "pdf": "255044462D", "png": "89504E47", "dwg": "41433130", "dxf_binary": "4175746F4341442042696E617279", "shp": "0000270A",
    "gzip": "1F8B",
}


def kind_of(content: Column) -> Column:
    """Kind of a file's bytes by its first ones; text kinds by their words. JVM only."""
    out = F.lit("other")
    text = F.decode(content, "ISO-8859-1")
    words = {
        "xml": r"^\s*(?:\xEF\xBB\xBF)?<\?xml", "html": r"(?i)^\s*<(?:!doctype html|html|head|body|div)", "geojson": r'^\s*\{[^\[]*"type"\s*:\s*"(?:FeatureCollection|Feature|Point|LineString|Polygon)"',
        "model": r"(?im)^\s*\[(?:TITLE|JUNCTIONS|PIPES|RESERVOIRS|OPTIONS)\]", "json": r"^\s*[\{\[]", "dxf": r"^\s*0\s*\r?\n\s*SECTION", "table": r"^[^\n]*[,;\t|][^\n]*\n",
    }
    for kind, pattern in reversed(words.items()):
        out = F.when(F.regexp(text, F.lit(pattern)), kind).otherwise(out)
    for kind, magic in reversed(MAGIC.items()):
        out = F.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, kind).otherwise(out)
    return F.when(F.octet_length(content) == 0, "empty").otherwise(out)


def decode_bytes(data: bytes) -> tuple[str, str]:
    """(text, how): a byte order mark, UTF-16 by its zeros, UTF-8, UTF-8 with stray single bytes, or windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    if len(data) >= 4 and len(data) % 2 == 0:
        for zeros, name in ((data[1::2], "utf-16-le"), (data[::2], "utf-16-be")):
            if zeros.count(0) > 0.6 * len(zeros):
                return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    single = lambda b: b.decode("cp1252", "ignore") or b.decode("latin-1")
    out, good, i = [], 0, 0
    while i < len(data):
        try:
            out.append(data[i:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            before = data[i : i + e.start]
            out.append(before.decode("utf-8"))
            good += sum(b >= 0x80 for b in before)
            out.append("".join(single(data[j : j + 1]) for j in range(i + e.start, i + e.end)))
            i += e.end
    if good:
        return "".join(out), "utf-8 with strays"
    return "".join(single(bytes([b])) for b in data), "windows-1252"


def decode_text(content: Column) -> Column:
    """struct(text, how) of bytes that the JVM's decoders don't all read; null stays null."""

    def run(column: pd.Series) -> pd.DataFrame:
        pairs = [(None, None) if c is None else decode_bytes(bytes(c)) for c in column]
        return pd.DataFrame(pairs, columns=["text", "how"])

    run.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "struct<text: string, how: string>")(content)


def zip_members(files: DataFrame, name: str = "path", content: str = "content", most_bytes: int = 256 << 20, most_ratio: int = 200) -> DataFrame:
    """(file, member, bytes, content, refused): one row per member; unsafe paths and bombs are listed with a reason, not read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, data in zip(frame["file"], frame["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(bytes(data)))
                except (zipfile.BadZipFile, TypeError):
                    rows.append((file, None, None, None, "not a zip"))
                    continue
                for m in archive.infolist():
                    reason = (
                        "unsafe path" if m.filename.startswith(("/", "\\")) or ".." in m.filename.replace("\\", "/").split("/")
                        else "too large" if m.file_size > most_bytes else "too dense" if m.file_size > most_ratio * max(m.compress_size, 1) else None
                    )
                    rows.append((file, m.filename, m.file_size, None if reason or m.is_dir() else archive.read(m), reason))
            yield pd.DataFrame(rows, columns=["file", "member", "bytes", "content", "refused"])

    picked = files.select(F.col(name).alias("file"), F.col(content).alias("content"))
    return picked.mapInPandas(run, "file string, member string, bytes long, content binary, refused string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind, content of each file under a path, in any store that Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", kind_of(F.col("content")).alias("kind"), "content")
