"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are compared once per distinct value. Values are dealt out by parts of their bits, and a task
holds its values under an index: sorted by part and Gray rank, so that neighbours share most bits; an upper
node holds the bits that all values below it share and that no node above it has stated. A search adds up
the differences on its way down and leaves a whole group as soon as they exceed the limit, or when the group
already belongs to the searcher's class. A task keeps only a forest of the links, so a group of n values gives
at most n - 1 edges. Edges of all tasks are then joined to components by alternating star contraction.

Two values that differ in at most three bits agree on one of four 16-bit blocks. Beyond ``FINE`` distinct
values they are dealt out by such a block and one of four 12-bit parts of the rest, on one of which they
agree as well; the links are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, release, slices, without_marks

BITS, LIMIT, SHINGLE, SEED = 64, 3, 3, 42
#: Distinct values from which on 28 bits deal them out instead of 16.
FINE = 1 << 24
#: Values of a key that one task takes; more are dealt out to pairs of parts.
MOST = 1 << 18
#: Edges that one task joins; more are contracted round by round.
JOINED = 1 << 20
_FAN = 8
_CHUNK, _STEP = 1 << 20, 1 << 22


def fingerprint(text: str | None) -> int:
    """Bits set in over half the hashes of the text's shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    return int(np.packbits(2 * ones(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    out = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        out += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``fp`` as a signed long) per row; a null, empty or blank text has fingerprint 0."""
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], [id_col, "fp"])
        release()

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Values in Gray order within their groups under a hierarchy of shared bit patterns.

    ``more`` adds a second word to each value. ``order`` tells where the values were; ``compared`` counts
    the nodes that searches looked at.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray | None = None, more: np.ndarray | None = None):
        groups = np.zeros(len(values), np.int64) if groups is None else groups
        self.order = np.lexsort((gray_rank(values), groups))
        self.values, self.more = values[self.order], None if more is None else more[self.order]
        groups = groups[self.order]
        first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(groups)))
        #: The range of places of each place's group.
        self.start, self.stop = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        low = high = self.values
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(low, ~np.zeros(len(low), np.uint64), ~np.zeros(len(low), np.uint64))]
        while len(low) > 1:
            cut = np.arange(0, len(low), _FAN)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            shared = ~(low ^ high)
            below, whole, _ = self.levels[-1]
            self.levels[-1] = (below, whole, whole & ~np.repeat(shared, _FAN)[: len(whole)])
            self.levels.append((low, shared, shared))  # pattern, bits that it states, those that no node above it states
        self.compared = 0

    def search(
        self, queries: np.ndarray, limit: int, more: np.ndarray | None = None, most: int = 0,
        inside: tuple[np.ndarray, np.ndarray] | None = None, own: np.ndarray | None = None, classes: list[np.ndarray] | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, differences) for all values within ``limit``, and with a second word within ``most`` over both.

        ``inside``: the range of places each query looks at. With ``classes`` of the nodes of each level
        (-1: mixed), groups of the query's class ``own`` are left out.
        """
        n = len(self.values)
        start, stop = inside if inside is not None else (np.zeros(len(queries), np.int64), np.full(len(queries), n))
        tops = np.minimum(np.searchsorted(_FAN ** np.arange(len(self.levels)), stop - start), len(self.levels) - 1) if n else np.zeros(0, np.int64)
        found = []
        for level in np.unique(tops).tolist():  # from the lowest level where two nodes span the range
            who = np.flatnonzero(tops == level)
            a, b = start[who] // _FAN**level, (stop[who] - 1) // _FAN**level
            who, node = np.concatenate([who, who[b > a]]), np.concatenate([a, b[b > a]])
            pattern, stated, _ = self.levels[level]
            far = np.bitwise_count((queries[who] ^ pattern[node]) & stated[node]).astype(np.int16)
            while True:
                self.compared += len(who)
                keep = far <= limit
                if classes is not None:
                    keep &= classes[level][node] != own[who]
                who, node, far = who[keep], node[keep], far[keep]
                if not level:
                    break
                level -= 1
                pattern, _, stated = self.levels[level]
                counts = np.minimum(_FAN, len(pattern) - node * _FAN)
                who, far = np.repeat(who, counts), np.repeat(far, counts)
                node = np.repeat(node * _FAN - np.cumsum(counts) + counts, counts) + np.arange(len(who))
                keep = (node * _FAN**level < stop[who]) & ((node + 1) * _FAN**level > start[who])
                who, node, far = who[keep], node[keep], far[keep]
                far += np.bitwise_count((queries[who] ^ pattern[node]) & stated[node])
            if self.more is not None:
                far = far + np.bitwise_count(more[who] ^ self.more[node])
                who, node, far = who[far <= most], node[far <= most], far[far <= most]
            found.append((who, node, far))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def forest(self, limit: int, mosts: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, place, differences): links that connect the values of each group as all its links do, within each of ``mosts`` in turn.

        The first value of every group searches first, then the second, then the next two and so on; what is
        one class by then is not searched again.
        """
        n = len(self.values)
        root, edges = np.arange(n), []
        rank, size = np.arange(n) - self.start, self.stop - self.start
        turn = np.where(size > 1, np.frexp(rank.astype(np.float64))[1], -1)  # 0, 1, 2, 2, 3, 3, 3, 3, ...
        classes = None
        for most, t in ((m, t) for m in mosts for t in range(int(turn.max(initial=-1)) + 1)):
            due = np.flatnonzero(turn == t)
            at = 0
            while at < len(due):
                take = max(1, int(np.searchsorted(np.cumsum(size[due[at : at + _STEP]]), _STEP, "right")))
                q, at = due[at : at + take], at + take
                if classes is None:
                    classes = [root]
                    low = high = root
                    while len(low) > 1:
                        cut = np.arange(0, len(low), _FAN)
                        low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
                        classes.append(np.where(low == high, low, -1))
                who, place, far = self.search(self.values[q], limit if self.more is None else min(limit, most), None if self.more is None else self.more[q], most, (self.start[q], self.stop[q]), root[q], classes)
                if not len(who):
                    continue
                a, b = root[q[who]], root[place]
                low, high = np.minimum(a, b), np.maximum(a, b)
                by = np.lexsort((far, high, low))
                low, high = low[by], high[by]
                nearest = by[np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))]
                nearest = nearest[np.argsort(far[nearest], kind="stable")]
                parent: dict[int, int] = {}

                def find(x: int, parent=parent) -> int:
                    while (up := parent.get(x, x)) != x:
                        parent[x] = parent.get(up, up)
                        x = up
                    return x

                used = []
                for i, x, y in zip(nearest.tolist(), a[nearest].tolist(), b[nearest].tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        used.append(i)
                edges.append((q[who[used]], place[used], far[used]))
                moved = np.arange(n)
                moved[list(parent)] = [find(x) for x in parent]
                root, classes = moved[root], None
        if not edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
        return tuple(np.concatenate(x) for x in zip(*edges, strict=True))


def _keys(fp: Column, fine: bool) -> Column:
    """The keys of a fingerprint: its four 16-bit blocks by number, or each with one of four 12-bit parts of the rest."""
    out = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        if not fine:
            out.append(F.lit(i << 16).bitwiseOR(block))
            continue
        low = fp.bitwiseAND(F.lit((1 << (16 * i)) - 1)) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * i + 16), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            out.append(F.lit((i * 4 + j) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*out).cast("array<long>")


def dealt(keyed: DataFrame, value: str, most: int = MOST) -> DataFrame:
    """``keyed`` with a ``key`` for every task of its rows: a key of more than ``most`` rows is dealt out to parts by ``value``,
    and each row goes to all pairs of its part with another, so that any two rows still meet."""
    coarse = F.pmod(F.xxhash64("key"), F.lit(1 << 16))
    heavy = [r["c"] for r in keyed.groupBy(coarse.alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()]  # 2**16 at most
    if not heavy:
        return keyed
    sizes = materialise(keyed.where(coarse.isin(heavy)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    parts = sizes.select("key", F.ceil(2 * F.col("n") / most).cast("int").alias("_parts"))
    if sizes.count() <= 1_000_000:
        parts = F.broadcast(parts)
    mine = F.pmod(F.xxhash64(value), F.col("_parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.xxhash64("key", F.least(mine, j), F.greatest(mine, j)))
    spread = keyed.join(parts, "key", "left").withColumn("_key", F.when(F.col("_parts").isNull(), F.array(F.col("key").cast("long"))).otherwise(pairs))
    return spread.select(F.explode("_key").alias("key"), *[c for c in keyed.columns if c != "key"])


def chunks(batches: Iterator[pa.RecordBatch], most: int = _CHUNK) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by their first column, cut between groups into about ``most`` rows; a larger group is whole."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(c) for c in batch.columns])
        size += batch.num_rows
        if size >= most:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
            if cut:
                yield [c[:cut] for c in whole]
            held, size = [[c[cut:].copy() for c in whole]], size - cut
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def links(values: DataFrame, limit: int = LIMIT, fine: bool = False) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` just as the links of at most ``limit`` (3 or fewer) bits do."""
    if limit > 3:
        raise ValueError("the keys cover links of up to three bits")
    keyed = dealt(values.select(F.explode(_keys(F.col("fp"), fine)).alias("key"), "fp"), "fp").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in chunks(batches):
            index = GrayIndex(fps.view(np.uint64), keys)
            a, b, _ = index.forest(limit)
            yield pa.RecordBatch.from_arrays([pa.array(index.values[x].view(np.int64)) for x in (a, b)], ["a", "b"])
        release()

    return keyed.mapInArrow(run, "a long, b long").distinct()


def _joined(edges: DataFrame) -> DataFrame:
    """The ``components`` of so few edges that one task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.column_stack([np.asarray(c) for c in batch.columns]) for batch in batches if batch.num_rows]
        if held:
            nodes, places = np.unique(np.concatenate(held), return_inverse=True)
            a, b = places.reshape(-1, 2).T
            root = np.arange(len(nodes))  # of each node the least one found so far
            while (root[a] != root[b]).any():
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
            rest = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[root[rest]])], ["a", "b"])
        release()

    return edges.select("a", "b").repartition(1).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60, together: int = JOINED) -> DataFrame:
    """(a, b) with b the least node of a's component, for all nodes but the least ones themselves.

    Up to ``together`` edges are joined by one task. More alternate large-star and small-star steps; each round is
    written to the shared folder, and they end when a round changes nothing.
    """
    if edges.count() <= together:
        return materialise(_joined(edges))
    state, before = edges, None
    for _ in range(most_rounds):
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
        small = large.join(down, F.col("a") == F.col("of"))
        state = materialise(small.select("a", F.col("m").alias("b")).union(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == now or not now["n"]:
            return state
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _classes(prints: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(fp, n rows, component_id) of every distinct fingerprint, and the number of rows."""
    values = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    distinct, total = values.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    stars = components(materialise(links(values.select("fp"), limit, distinct > FINE)))
    nodes = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    linked = nodes.join(values, "fp")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return values.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, ``fp`` and ``component_id``, the least id that links of ``limit`` bits reach.

    Texts without words have fingerprint 0 and link like any other. Null ids take part but are never
    the least unless a component has no other. Repeated rows stay; other columns are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("id"), "fp"))
    classes, total = _classes(prints, limit)
    classes = materialise(classes)
    often = max(1000, total // 10_000)  # so at most 10,000 fingerprints have more rows than this
    hot = F.broadcast(classes.where(F.col("n") > often).select(F.col("fp").alias("_fp"), F.col("component_id").alias("_hot"), F.lit(True).alias("_is")))
    rows = prints.join(hot, F.col("fp") == F.col("_fp"), "left")
    near = rows.where("_is").select("id", "fp", F.col("_hot").alias("component_id"))
    far = rows.where("_is IS NULL").select("id", "fp").join(classes.where(F.col("n") <= often).drop("n"), "fp").select("id", "fp", "component_id")
    return near.union(far).select(F.col("id").alias(id_col), "fp", "component_id")


def marked_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` written once with a row marker, the marked (``who``, ``text``) of its rows, and the marker's name. ``who`` orders rows: ids first, then nulls, each by marker."""
    mark = fresh(docs, "_mark")
    marked = materialise(docs.withColumn(mark, F.monotonically_increasing_id()))
    who = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(mark).alias("mark"))
    return marked, marked.select(who.alias("who"), F.col(text_col).alias("text")), mark


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with exactly one row of each component: a row with its least id, or with a null id if all are null.

    Rows are told apart by a marker, so repeated and null ids in different components all keep theirs. All columns stay.
    """
    marked, keyed, mark = marked_rows(docs, id_col, text_col)
    prints = materialise(fingerprints(keyed, "who", "text").select(F.col("who").alias("id"), "fp"))
    classes, _ = _classes(prints, limit)
    keep = classes.select(F.col("component_id")["mark"].alias(mark)).distinct()
    drop = materialise(prints.select(F.col("id")["mark"].alias(mark)).join(keep, mark, "left_anti"))
    return without_marks(marked, drop, mark).select(*docs.columns)
