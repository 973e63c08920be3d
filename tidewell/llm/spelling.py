"""Spelling variants: words that one inserted, deleted or replaced letter sets apart, grouped under their most common form.

The relation is the composition A o E o A of the vocabulary's minimised acceptor A with a one-edit transducer E. Its states
are (s, t, e): both sides have read up to s and t with e edits done. Pairs are enumerated per initial state: a cell holds the
words that have one beginning (the state which A is in after it) or, in the mirrored machine, one ending, so that every
accepted pair lies in exactly one cell. A cell's acceptor covers the words' middles, and cells over a size are entered one
half of the middle deeper, until nothing but the edit itself is left; so no cell depends on how many words begin alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of [A-Za-z\\u00C0-\\u00FF] of all texts with A-Z lower-cased, and how often each occurs.

    drop_every: of a run of which the crc32 of `id:run` is divisible by it, the code point at crc32 % length is left out
    (a null id reads as empty). Runs that become empty don't count. Null texts have no runs.
    """
    id_, lowered = F.coalesce(docs[id_col].cast("string"), F.lit("")), F.translate(docs[text_col], UPPER, LOWER)
    runs = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        left_out = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("h") % drop_every == 0, left_out).otherwise(F.col("word")).alias("word")).where("word != ''")
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Acceptor:
    """The minimal deterministic acceptor of a set of words. State 0 has no way on and accepts the empty word or nothing is read there."""

    def __init__(self, words: list[str]):
        """words: sorted, distinct. Finished states are shared with equal ones, as a word's end differs from that of the word before."""
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[tuple[str, int]], list[bool]]] = [([], [False])]  # edges and finality of each open state
        last = ""

        def close(upto: int) -> None:
            while len(path) > upto + 1:
                edges, final = path.pop()
                key = (final[0], *edges)
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.edges)
                    self.edges.append(dict(edges))
                    self.final.append(final[0])
                path[-1][0].append((last[len(path) - 1], state))

        for word in words:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            close(same)
            path.extend(([], [False]) for _ in word[same:])
            path[-1][1][0] = True
            last = word
        close(0)
        self.start = len(self.edges)
        self.edges.append(dict(path[0][0]))
        self.final.append(path[0][1][0])


def one_edit_pairs(acceptor: Acceptor) -> list[tuple[str, str]]:
    """Pairs (u, v) that acceptor o one-edit o acceptor accepts, each once: equally long in order, else the shorter first.

    What is accepted from a state of the composed machine is found once, whatever ways lead there.
    """
    edges, final = acceptor.edges, acceptor.final
    ends: dict[tuple[int, int], list[str]] = {}

    def common(s: int, t: int) -> list[str]:
        """Accepted from (s, t, 1): what both states read to the end."""
        key = (s, t) if s <= t else (t, s)
        found = ends.get(key)
        if found is None:
            found = [""] if final[s] and final[t] else []
            one, two = (edges[s], edges[t]) if len(edges[s]) <= len(edges[t]) else (edges[t], edges[s])
            for x, a in one.items():
                b = two.get(x)
                if b is not None:
                    found += [x + rest for rest in common(a, b)]
            ends[key] = found
        return found

    pairs: dict[int, list[tuple[str, str]]] = {}

    def open_(s: int) -> list[tuple[str, str]]:
        """Accepted from (s, s, 0)."""
        found = pairs.get(s)
        if found is None:
            found = []
            out = list(edges[s].items())
            for i, (x, a) in enumerate(out):
                found += [(x + u, x + v) for u, v in open_(a)]
                for y, b in out[i + 1 :]:
                    found += [(x + rest, y + rest) for rest in common(a, b)]
                # A letter put into a run of its own kind is put at the run's end.
                found += [(rest, x + rest) for rest in common(s, a) if rest[:1] != x]
            pairs[s] = found
        return found

    return open_(acceptor.start)


def cells_of(words: DataFrame) -> DataFrame:
    """(length, x, y, differ, head, tail, word, n): words of `length` or one letter more that have x letters `head` in front and y letters `tail` behind.

    Two near words, of which the shorter has l letters, have the first l // 2 in common, or else the last l - l // 2.
    differ: a pair counts only if it isn't alike in so many letters in front; the others are in a cell of a longer head.
    """
    sized = words.withColumn("length", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)))
    whole = sized.select("length", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("differ"), F.lit("").alias("head"), F.lit("").alias("tail"), "word", "n")
    return halves(whole.where("length > 0"))


def halves(cells: DataFrame) -> DataFrame:
    """Each cell's rows dealt to the two cells of a longer head and of a longer tail."""
    middle = F.col("length") - F.col("x") - F.col("y")
    a = F.floor(middle / 2).cast("int")
    x, y = F.col("x") + a, F.col("y") + middle - a
    front = F.struct(x.alias("x"), F.col("y"), F.col("differ"))
    back = F.struct(F.col("x"), y.alias("y"), x.alias("differ"))
    # A head as long as what has to differ can't hold a pair, and nothing has to differ in no letters.
    kinds = F.filter(F.when(a > 0, F.array(front, back)).otherwise(F.array(front)), lambda k: (k["differ"] == 0) | (k["x"] < k["differ"]))
    return cells.withColumn("kind", F.explode(kinds)).select(
        "length", "kind.x", "kind.y", "kind.differ", F.substring(F.col("word"), F.lit(1), F.col("kind.x")).alias("head"),
        F.when(F.col("kind.y") > 0, F.expr("right(word, kind.y)")).otherwise("").alias("tail"), "word", "n",
    )


KEY = ["length", "x", "y", "differ", "head", "tail"]


def near_words(words: DataFrame, cell_words: int = 2048, longest_middle: int = 64, broadcast_cells: int = 100_000) -> DataFrame:
    """(word, near, near_n) for each ordered pair of words that exactly one inserted, deleted or replaced code point sets apart.

    words: word (distinct, not null), n. Cells of more than cell_words rows, or of middles over longest_middle letters, are
    halved until they are small or their middle is one letter (then a cell has at most the alphabet squared).
    """
    cells = cells_of(words)
    ready: DataFrame | None = None
    while True:
        # A hash stands for the cell in the count only: two cells under one are both halved, which loses nothing.
        cells = cells.withColumn("cell", F.xxhash64(*KEY))
        count = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max(F.expr("length - x - y")).alias("middle"))
        large = keep(count.where(f"rows > 1 and middle > 1 and (rows > {cell_words} or middle > {longest_middle})").select("cell"), "large-cells")
        n = large.count()
        if not n:
            small = cells
        else:
            met = large.withColumn("halve", F.lit(True))
            met = cells.join(F.broadcast(met) if n <= broadcast_cells else met, "cell", "left")
            # A single long middle has no partner.
            small = met.where(f"halve is null and length - x - y <= {longest_middle}").drop("halve")
        ready = small if ready is None else ready.unionByName(small)
        if not n:
            break
        cells = keep(halves(met.where("halve").drop("cell", "halve")), "halved-cells")
    dealt = ready.select("cell", *KEY, "word", "n").repartition("cell").sortWithinPartitions("cell", *KEY, "word")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: dict[str, int] = {}
        out: list[tuple[str, str, int]] = []

        def compose() -> None:
            if len(held) < 2:
                return
            length, x, y, differ, head, tail = at
            middles = [w[x : len(w) - y] for w in held]
            for u, v in one_edit_pairs(Acceptor(sorted(middles))):
                # Of two longer words the cell of their own length has the pair.
                if len(u) == length - x - y and (not differ or u[: differ - x] != v[: differ - x]):
                    one, two = head + u + tail, head + v + tail
                    out.append((one, two, held[two]))
                    out.append((two, one, held[one]))

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "near", "near_n"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            if not len(cell):
                continue
            words, counts = batch.column(7).to_pylist(), batch.column(8).to_pylist()
            key = lambda i: tuple(batch.column(c)[i].as_py() for c in range(1, 7))  # noqa: B023, E731
            # Most cells have one word: only runs of one cell, and the batch's ends, are looked at.
            cuts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            several = np.flatnonzero(np.diff(cuts) > 1)
            for k in np.unique(np.concatenate((several, [0, len(cuts) - 2]))).tolist():
                a, b = int(cuts[k]), int(cuts[k + 1])
                # Two cells under one hash stand one after the other.
                parts = [(a, b)] if key(a) == key(b - 1) else [(i, i + 1) for i in range(a, b)]
                for i, j in parts:
                    if (own := key(i)) != at:
                        if at is not None:
                            compose()
                        at, held = own, {}
                    held.update(zip(words[i:j], counts[i:j], strict=True))
            if len(out) > 50_000:
                yield emit()
        if at is not None:
            compose()
        yield emit()

    return dealt.mapInArrow(search, "word string, near string, near_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last word, which has none itself. The ways double each round; ended ones leave."""
    ways = keep(forms.select("word", F.col("form").alias("at"), F.lit(False).alias("ended")), "forms")
    while True:
        open_ = ways.where("not ended")
        if open_.isEmpty():
            return ways.select("word", F.col("at").alias("root"))
        ends = ways.select(F.col("word").alias("at"), F.col("at").alias("next"), F.col("ended").alias("last"))
        step = open_.drop("ended").join(ends, "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.coalesce("last", F.lit(True)).alias("ended"))
        ways = keep(ways.where("ended").unionByName(step), "forms-followed")


def variant_groups(words: DataFrame, times: int = 2, cell_words: int = 2048) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word distinct, n).

    form: the near word of the greatest n (ties: the least in code-point order) if its n is at least `times` the word's own,
    else null; root: the last word when forms are followed (n grows at each step, so no circle exists), the word itself if it
    has no form; n_near: near words (0 if none). Null words are left out. An empty table gives no rows.
    """
    words = keep(words.where("word is not null").select("word", "n"), "words")
    links = near_words(words, cell_words)
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))
    strong = F.col("near_n") >= times * F.col("n")
    found = keep(found.select("word", "n", "n_near", F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")), "variants")
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, times: int = 2, drop_every: int | None = None, cell_words: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variant_groups of the words of docs with at least so many code points and occurrences.

    Null and empty texts have no words, repeated rows count repeatedly, other columns aren't read, an empty table gives no rows.
    """
    counts = word_counts(docs, drop_every, id_col, text_col).where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))
    return variant_groups(counts, times, cell_words)
