"""Substring dedup by sliding sentence spans: runs of several consecutive sentences that also stand earlier go.

Spans are hashed in tasks; hashes that occur in more than one document meet in one aggregation with map-side minima, so a
line that every document has costs a row per task. Texts are shuffled once, to meet the spans found in them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts
from .shared import keep

#: A sentence and the marks and line ends after it; together they are the whole text.
SENTENCE = re.compile(rb"[^.!?\n]+[.!?\n]*|[.!?\n]+")


def split_sentences(text: bytes) -> list[bytes]:
    return SENTENCE.findall(text)


def span_hashes(sentences: list[bytes], width: int) -> list[int]:
    """One hash for each run of `width` sentences, white space at their ends and runs of it inside aside."""
    own = [xxhash.xxh3_64_intdigest(b" ".join(s.split())) for s in sentences]
    packed = [x.to_bytes(8, "little") for x in own]
    return [xxhash.xxh3_64_intdigest(b"".join(packed[i : i + width])) - (1 << 63) for i in range(len(own) - width + 1)]


def remove_repeated_spans(docs: DataFrame, width: int = 2, least_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_sentences, n_removed, kept_text.

    A sentence goes if a run of `width` sentences with at least `least_words` words that covers it also starts earlier: in a
    document of a smaller id, or before in the same one. Sentences end with runs of . ! ? and line ends. Texts with fewer
    sentences have no runs and stay. Null texts count as empty. Null ids come after all others, and between themselves none
    is first. Rows with the same id count as one document where they have the same text; of different texts with one id,
    none is first. Other columns aren't read. An empty table gives no rows.
    """

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def spans(text: bytes) -> tuple[list[bytes], dict[int, list[int]]]:
        sentences = split_sentences(text)
        words = [len(s.split()) for s in sentences]
        found: dict[int, list[int]] = {}
        for i, h in enumerate(span_hashes(sentences, width)):
            if sum(words[i : i + width]) >= least_words:
                found.setdefault(h, []).append(i)
        return sentences, found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                each = [spans(t)[1] for t in texts(part.column(2))]
                row = list(itertools.chain.from_iterable(itertools.repeat(i, len(x)) for i, x in enumerate(each)))
                index = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(index), part.column(1).take(index), pa.array([h for x in each for h in x], pa.int64())], names=["id", "content", "span"]
                )

    keyed = rows.select("id", F.xxhash64("text").alias("content"), "text")
    found = keyed.mapInArrow(scan, f"id {kind}, content long, span long")
    shared = found.groupBy("span").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("span", "first")
    later = found.join(shared, "span").where("id > first or (id is null and first is not null)")
    marked = keep(later.groupBy("id", "content").agg(F.collect_set("span").alias("spans")), "repeated-spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, later in zip(texts(batch.column(1)), batch.column(2), strict=True):
                sentences, own = spans(text)
                later = set(later.as_py() or ())
                gone = {j for h, at in own.items() for i in (at if h in later else at[1:]) for j in range(i, i + width)}
                out.append((len(sentences), len(gone), b"".join(s for i, s in enumerate(sentences) if i not in gone).decode()))
            n, m, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_sentences", "n_removed", "kept_text"])

    m = marked.select(F.col("id").alias("m_id"), F.col("content").alias("m_content"), "spans")
    joined = keyed.join(m, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("content") == F.col("m_content")), "left")
    return joined.select("id", "text", "spans").mapInArrow(strip, f"`{id_col}` {kind}, n_sentences long, n_removed long, kept_text string")
