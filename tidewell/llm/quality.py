"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings over hashed text features.

P(grade > k) = sigmoid(score - cut_k) with one weight vector and ordered cuts. Fitted in the driver on a bounded sample of
labelled documents whose hashed features Spark computes; every document is then scored in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import texts
from .shared import keep

WORD = re.compile(rb"[a-z\x80-\xff]+")


MARKS = b"#$%&*|!<>{}[]_=~^"
HALF, LEAST = 5.0, 2.0  # standard deviations at which a slot counts a quarter, and under which it isn't looked at
STEPS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8)


def features(text: bytes, bits: int) -> np.ndarray:
    """Sorted distinct slots: each lower-cased word and its first five bytes once, and binned shares that describe the text's form."""
    tokens = text.split()
    words = WORD.findall(text.lower())
    once = set(words)
    hash_, mask = xxhash.xxh32_intdigest, (1 << bits) - 1
    slots = {hash_(w) & mask for w in once}
    slots |= {hash_(w, 1) & mask for w in {w[:5] for w in once if len(w) > 5}}
    letters = sum(map(len, words)) or 1
    size, count, lines = max(len(text), 1), max(len(words), 1), [x for x in text.split(b"\n") if x.strip()]
    upper = len(text) - len(text.translate(None, bytes(range(0x41, 0x5B))))
    marks = len(text) - len(text.translate(None, MARKS))
    marked = sum(t[-1] in MARKS for t in tokens)
    shares = {
        "upper": upper / letters, "marks": marks / size, "marked": marked / max(len(tokens), 1), "distinct words": len(once) / count, "distinct lines": len(set(lines)) / max(len(lines), 1),
        "word length": min(letters / count / 20, 1), "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / count,
    }
    slots |= {hash_(f"{name} {'over' if share > step else 'under'} {step}".encode(), 2) & mask for name, share in shares.items() for step in STEPS}
    slots.add(hash_(f"length {len(words).bit_length()}".encode(), 2) & mask)
    return np.fromiter(sorted(slots), np.int32, len(slots))


@dataclass
class OrdinalModel:
    bits: int
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one less than the grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))


def telling(rows: list[tuple[np.ndarray, int]], grades: int, bits: int) -> np.ndarray:
    """Of each slot, how many standard deviations its count in some grade lies off what that grade's share of all rows gives."""
    counts = np.zeros((grades, 1 << bits))
    for x, g in rows:
        counts[g, x] += 1  # a row's slots are distinct
    n, most = counts.sum(axis=0), np.zeros(1 << bits)
    for own, share in zip(counts, np.bincount([g for _, g in rows], minlength=grades) / len(rows), strict=True):
        most = np.maximum(most, np.abs(own - n * share) / np.sqrt(n * share * (1 - share) + 1))
    return most


def fit(rows: list[tuple[np.ndarray, int]], grades: int, bits: int, z: np.ndarray | None = None, rounds: int = 200, decay: float = 1e-5) -> OrdinalModel:
    """rows: distinct slots, and the grade. z: of each slot, as telling() gives it; then rows need no slots with less than LEAST. Adagrad over all rows at once; cuts stay in order as a first cut and positive gaps. Each grade weighs the same.

    A slot z standard deviations off chance counts (z^2 / (z^2 + HALF^2))^2, so that what few rows say moves a score little;
    the model's weights have that in them. Without rows all weights are zero, and every document gets the same grade.
    """
    w, base, gaps, value = np.zeros(1 << bits), -1.0, np.full(max(grades - 2, 0), 0.5), np.zeros(1 << bits)
    if rows:
        z = telling(rows, grades, bits) if z is None else z
        value = np.where(z >= LEAST, (z * z / (z * z + HALF * HALF)) ** 2, 0.0)
        told = value > 0
        told[0] = True  # so that no row is without a slot
        value[0] = 0.0
        y = np.array([g for _, g in rows])
        rows = [(np.append(x[told[x]], 0), g) for x, g in rows]
        size = np.array([len(x) for x, _ in rows])
        slot = np.concatenate([x for x, _ in rows])
        start = np.cumsum(size) - size
        share = 1.0 / np.bincount(y, minlength=grades)[y]
        share /= share.sum()
        sums, tops = np.full(1 << bits, 1e-12), np.full(grades - 1, 1e-12)
        for _ in range(rounds):
            score = np.add.reduceat((w * value)[slot], start)
            cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            above = 1 / (1 + np.exp(np.clip(np.concatenate([[-40.0], cuts, [40.0]])[None, :] - score[:, None], -40, 40)))  # P(grade >= k)
            at, up = above[np.arange(len(y)), y], above[np.arange(len(y)), y + 1]
            # The likelihood of grade k is at - up; its derivative by the score is 1 - at - up.
            by_score = share * (1 - at - up)
            g = np.bincount(slot, by_score.repeat(size), 1 << bits) * value - decay * w
            sums += g * g
            w += 0.3 * g / np.sqrt(sums)
            by_cut = np.zeros(grades - 1)
            likely = np.maximum(at - up, 1e-9)
            for k in range(grades - 1):
                by_cut[k] = (share * ((y == k) * up * (1 - up) - (y == k + 1) * at * (1 - at)) / likely).sum()
            step = np.concatenate([[by_cut.sum()], np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:]])
            tops += step * step
            move = 0.1 * step / np.sqrt(tops)
            base += move[0]
            gaps = gaps + move[1:]
    return OrdinalModel(bits, (w * value).astype(np.float32), base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, sample: int = 20_000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> OrdinalModel:
    """Fit on at most about `sample` rated documents: those whose id hashes lowest. ratings: id_col, grade_col (0 is worst).

    Null grades, or grades out of range, are left out; an id rated more than once takes its lowest grade; ids without a
    document don't count. Of the sample's features only those that tell grades apart reach the driver.
    """
    rated = ratings.where(F.col(grade_col).between(0, grades - 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(grade_col).cast("int").alias("__grade"))
    n = rated.count()
    if n > sample:
        rated = rated.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 50)) < int(sample / n * (1 << 50)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([features(t, bits) for t in texts(batch.column(0))], pa.list_(pa.int32()))], names=["grade", "slots"])

    joined = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(rated), id_col).select("__text", "__grade")
    found = keep(joined.mapInArrow(run, "grade int, slots array<int>"), "rated-features")
    # Spark finds the telling slots; only they, and their places in the sample's rows, come to the driver.
    shares = np.zeros(grades)
    for r in found.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect():
        shares[r["grade"]] = r["n"]
    shares /= max(shares.sum(), 1)
    counts = found.select("grade", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(grades)])
    off = [F.abs(F.col(f"n{g}") - F.col("n") * float(s)) / F.sqrt(F.col("n") * float(s * (1 - s)) + 1) for g, s in enumerate(shares)]
    z = np.zeros(1 << bits)
    for r in counts.select("slot", F.greatest(*off).alias("z")).where(F.col("z") >= LEAST).collect():
        z[r["slot"]] = r["z"]
    told = docs.sparkSession.sparkContext.broadcast(z >= LEAST)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.array(x, np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[told.value[x]].tobytes() for x in slots], pa.binary())], names=["grade", "slots"])

    rows = sorted((bytes(r["slots"]), r["grade"]) for r in found.mapInArrow(pick, "grade int, slots binary").collect())
    return fit([(np.frombuffer(s, np.int32), g) for s, g in rows], grades, bits, z)


def rate(docs: DataFrame, model: OrdinalModel, keep_from: int = 2, least: float = 1 / 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_features, score, expected_grade, p_tail = P(grade >= keep_from), kept = p_tail >= least.

    As grades weigh the same in the fit, a document that nothing speaks for or against has a p_tail of about one over the grades,
    which is the default of `least`: what is rejected has something against it.

    Null texts count as empty and are rated like any other. Repeated rows come back repeated. An empty table gives no rows.
    """
    return rated(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")), model, keep_from, least)


def rated(rows: DataFrame, model: OrdinalModel, keep_from: int, least: float) -> DataFrame:
    """rows: a column to carry and the text; with the columns of rate()."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    first = rows.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [features(t, m.bits) for t in texts(batch.column(1))]
            score = np.array([m.weights[x].sum(dtype=np.float64) for x in found], np.float64)
            tails = m.tails(score)
            n = np.array([len(x) for x in found], np.int64)
            columns = [n, score, tails.sum(axis=1), tails[:, keep_from - 1], tails[:, keep_from - 1] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=[first.name, "n_features", "score", "expected_grade", "p_tail", "kept"])

    return rows.mapInArrow(run, f"`{first.name}` {first.dataType.simpleString()}, n_features long, score double, expected_grade double, p_tail double, kept boolean")


def drop_poor(docs: DataFrame, model: OrdinalModel, keep_from: int = 2, least: float = 1 / 3, text_col: str = "text") -> DataFrame:
    """The rows of docs that rate() keeps, with all their columns under any name."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rated(rows, model, keep_from, least).where("kept").select("row.*")


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good. Rows without a quality have none unless they're toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
