"""Near copies: texts whose sets of five-word shingles are alike by a Jaccard similarity of 0.8 or more.

Candidates come from SimHash, the similarity from the sets. Each set of shingles has a fingerprint of two
64-bit words. The bits of a near copy that differ are those that few shingles decide, so a fingerprint is dealt
out by its most decided bits: every ``TOGETHER`` of the ``DECIDED`` bits with the largest margins are a key.
Under a key the Gray-order index searches the first word within ``NEAR`` differing bits, then both within
the last of ``FAR``, the closest first, and keeps a forest of links. A link counts once the two sets, joined, are found alike enough.

Two sets at a similarity of 0.8 differ in 15 % of the bits on average. By the normal model 99.9 % of such pairs
are within both limits and 98 % share a key; closer pairs miss less. These, not a cap, are what may be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, slices, with_marks, without_marks
from .hashing import MIX, Numbers
from .simhash import GrayIndex, chunks, components, dealt, marked_rows, ones

SHINGLE, SIMILARITY = 5, 0.8
DECIDED, TOGETHER = 9, 3
NEAR, FAR = 20, (8, 12, 16, 20, 24, 28, 32)
#: Links of a text that one task checks; a text with more is copied to several.
MOST_LINKS = 256
_PART = 1 << 21


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes, sorted, of ``size`` words in a row, given the words' hashes; fewer words are one shingle."""
    n = min(size, len(words))
    if not n:
        return words
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sets(part: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingles of each text; a null text has none."""
    known, each = Numbers(), []
    for t in part.to_pylist():
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        each.append(np.fromiter(map(known.__getitem__, w), np.int64, len(w)))
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    for numbers in each:
        yield shingles(hashed[numbers], size)


def sketch(found: np.ndarray) -> tuple[int, int, int, int, int]:
    """Of a set of shingles: its hash, both words of its fingerprint, its most decided bits (7 bits a place), and its size."""
    again = (found ^ (found >> np.uint64(32))) * MIX
    again = (again ^ (again >> np.uint64(32))) * MIX
    margins = np.concatenate([2 * ones(found), 2 * ones(again)]) - len(found)
    one, two = np.packbits(margins > 0, bitorder="little").view(np.int64).tolist()
    top = np.sort(np.argsort(-np.abs(margins), kind="stable")[:DECIDED])
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63), one, two, sum(int(p) << (7 * k) for k, p in enumerate(top)), len(found)


def keys(one: np.ndarray, two: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The keys of each fingerprint, in rows: ``TOGETHER`` of the decided bits, each by place and value."""
    codes = []
    for k in range(DECIDED):
        place = (top >> (7 * k)) & 127
        bit = (np.where(place < 64, one, two) >> (place & 63)) & 1
        codes.append(place << 1 | bit)
    return np.column_stack([sum(codes[i] << (8 * k) for k, i in enumerate(chosen)) for chosen in combinations(range(DECIDED), TOGETHER)])


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """(who, cls, one, two, top, n) of rows (who, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, _PART):
                cols = zip(*map(sketch, sets(part.column(1), size)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["who", "cls", "one", "two", "top", "n"])
        release()

    return rows.mapInArrow(run, f"who {rows.schema['who'].dataType.simpleString()}, cls long, one long, two long, top long, n long")


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, far): links between ``node``s that connect those under each key just as all links within the limits do."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, top = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            found = keys(one, two, top)
            offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))], ["node", "one", "two", "keys"])

    keyed = classes.select("node", "one", "two", "top").mapInArrow(spread, "node long, one long, two long, keys array<long>").select(F.explode("keys").alias("key"), "one", "two", "node")
    keyed = dealt(keyed, "node").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, one, two, node in chunks(batches):
            index = GrayIndex(one.view(np.uint64), key, two.view(np.uint64))
            a, b, far = index.forest(NEAR, FAR)
            yield pa.RecordBatch.from_arrays([*(pa.array(node[index.order[x]]) for x in (a, b)), pa.array(far.astype(np.int32))], ["a", "b", "far"])
        release()

    ends = keyed.mapInArrow(run, "a long, b long, far int")
    return ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "far").distinct()


def alike(edges: DataFrame, marked: DataFrame, mark: str, text_col: str, size: int, least: float) -> DataFrame:
    """Those of the edges (a, b) whose texts' sets of shingles are alike by ``least`` or more."""
    ends = materialise(edges.select(F.col("a").alias(mark)).union(edges.select(F.col("b").alias(mark))).distinct())
    texts = with_marks(marked.select(mark, text_col), ends, mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, _PART):
                found = list(sets(part.column(1), size))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))], ["node", "of"])
        release()

    of = materialise(texts.mapInArrow(run, "node long, of array<long>"))
    copies = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MOST_LINKS).cast("int").alias("parts"))
    split = edges.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    with_a = split.join(of.select(F.col("node").alias("a"), F.col("of").alias("of_a")).hint("merge"), "a")
    wide = of.join(copies, F.col("node") == F.col("b")).select("b", F.col("of").alias("of_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    similarity = both / (F.size("of_a") + F.size("of_b") - both)
    return with_a.join(wide.hint("merge"), ["b", "part"]).where(similarity >= least).select("a", "b")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with one row of each group of near copies: a row with its least id, or with a null id if all are null.

    Texts are linked if their sets of ``size``-word shingles (A-Z in lower case; fewer words are one
    shingle) have a Jaccard similarity of ``least`` or more, and found as told above; groups are what links
    connect. Equal sets are always linked, so texts without words (null, empty, blank) are one group. Rows are told apart
    by a marker: repeated and null ids in different groups all keep theirs. All columns stay.
    """
    marked, rows, mark = marked_rows(docs, id_col, text_col)
    prints = materialise(_sketches(rows, size))
    classes = prints.groupBy("cls", "one", "two").agg(F.min("who").alias("who"), F.first("top").alias("top"), F.first("n").alias("n"))
    classes = materialise(classes.select(F.col("who")["mark"].alias("node"), "who", "one", "two", "top", "n"))
    fewest = int(np.ceil(least / (1.0 - least) - 1e-9)) if least < 1 else 1 << 62  # a smaller set is alike to its equals only
    found = materialise(candidates(classes.where(F.col("n") >= fewest)))
    nearest = materialise(alike(found.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")), marked, mark, text_col, size, least))
    stars = components(nearest)
    # What the nearest links have joined already needs no other link.
    root = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    left = found.join(nearest, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        left = left.join(root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    left = left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = materialise(alike(materialise(left), marked, mark, text_col, size, least))
    stars = components(materialise(nearest.union(more)))
    groups = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    linked = classes.select("node", "who").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = linked.groupBy("root").agg(F.min("who").alias("who")).select(F.col("who")["mark"].alias(mark))
    drop = materialise(prints.select(F.col("who")["mark"].alias(mark)).join(keep, mark, "left_anti"))
    return without_marks(marked, drop, mark).select(*docs.columns)
