"""Language-model scoring by partial matching over a trie of byte contexts.

Training counts every byte after its five predecessors, over all training documents; counts of shorter
contexts are sums of these, and none is cut. A byte is coded in its longest known context; a byte not
seen there escapes to the next shorter context, in which all bytes seen above are excluded, down to an
even choice among the bytes that no context has. Escapes count the distinct successors (method C).

The trie is a table. Nodes of up to two predecessors are broadcast (256**3 at most); all longer ones that
share their last three predecessors meet in one task, which scores every byte in context that occurs.
The most frequent of these scores, of a fixed number, go to all workers; the others are looked up in a join.

The base is a unigram word model with one added to each count. Its frequent words, of a fixed number,
go to all workers; rarer words of a text are looked up in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, materialise, release, slices
from .hashing import KeyTable, Numbers

ORDER = 5
HEAD_WORDS = 1 << 20
HEAD_CODES = 1 << 21
PART = 1 << 19  # bytes in context that a task scores
_EDGE = b"\xff"  # before, and as the end of, a text; no UTF-8 text holds it
#: The end of a text as a token; no word is a space.
_END = xxhash.xxh64_intdigest(b" ")
_STEP = 1 << 21


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def coded(text: bytes, order: int = ORDER) -> Iterator[np.ndarray]:
    """Each byte of the text and its end, below its ``order`` predecessors, in chunks."""
    data = np.frombuffer(_EDGE * order + text + _EDGE, np.uint8)
    for a in range(0, len(data) - order, _STEP):
        part = data[a : a + _STEP + order].astype(np.uint64)
        n = len(part) - order
        codes = np.zeros(n, np.uint64)
        for k in range(order + 1):
            codes = codes << np.uint64(8) | part[k : k + n]
        yield codes


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _counted(parts: list[np.ndarray], learns: bool) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.unique(np.concatenate(parts), return_counts=True)
    return codes, n if learns else np.zeros(len(codes), np.int64)


def _nodes(codes: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of order ``k`` that counts of longer codes add up to."""
    short, place = np.unique(codes & _mask(k + 1), return_inverse=True)
    return short, np.bincount(place, n, len(short))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def corpus_counts(docs: DataFrame, trained: str, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(kind, key, n): counts over the ``trained`` rows of all words (kind 0, by 64-bit hash; ends of texts included) and of all
    bytes in context (kind 1). What occurs in other rows alone is there with a count of 0, if a byte in context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, _STEP):
                raw, learns = [_raw(t) for t in part.column(0).to_pylist()], part.column(1).to_pylist()
                known, numbers = Numbers(), []
                for r, yes in zip(raw, learns, strict=True):
                    if yes:
                        numbers.extend(map(known.__getitem__, r.lower().split()))
                found = []
                if any(learns):
                    found.append((0, np.append(_word_hashes(list(known)), np.uint64(_END)), np.append(np.bincount(np.array(numbers, np.int64), minlength=len(known)), sum(learns))))
                for kind in (True, False):
                    small: list[np.ndarray] = []
                    size = 0
                    for r, yes in zip(raw, learns, strict=True):
                        for codes in coded(r, order) if yes == kind else ():
                            small.append(codes)
                            size += len(codes)
                            if size > _STEP:
                                found.append((1, *_counted(small, kind)))
                                small, size = [], 0
                    if small:
                        found.append((1, *_counted(small, kind)))
                for kind, keys, n in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    each = docs.select(text_col, trained).mapInArrow(run, "kind int, key long, n long")
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Counts of the kept nodes by order, and per context what a search that escapes needs."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]):
        """``nodes``: for order 0, 1, ... the codes (context and byte) and their counts."""
        self.pairs, self.counts, self.contexts = [], [], []
        self.plain: list[tuple[np.ndarray, np.ndarray]] = []  # by context: sum of counts, escape count
        self.excluded: list[tuple[np.ndarray, np.ndarray]] = []  # the same one order below, without the bytes seen here
        seen_below = total_below = lost_below = None
        for k, (codes, counts) in enumerate(nodes):
            by_code = np.argsort(codes)
            codes, counts = codes[by_code], counts[by_code].astype(np.float64)
            context, first = np.unique(codes >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first) if len(codes) else np.zeros(0)
            seen = np.diff(np.append(first, len(codes))).astype(np.float64)
            if k and len(codes):
                at = self.pairs[k - 1].find(context)
                whole = np.where(at >= 0, self.counts[k - 1][at], 0.0)
                lost = np.maximum(whole - total, 0.0)
                below = self.contexts[k - 1].find(context & _mask(k - 1))
                inner = self.counts[k - 1][self.pairs[k - 1].find(codes & _mask(k))]
                more = seen_below[below] - seen
                left = np.where(more > 0, np.maximum(total_below[below] - np.add.reduceat(inner, first), 0.0), 0.0)
                self.excluded.append((left, more + lost_below[below]))
            else:
                lost = np.zeros(len(context))
                self.excluded.append((np.zeros(len(context)), np.zeros(len(context))))
            self.pairs.append(KeyTable(codes))
            self.counts.append(counts)
            self.contexts.append(KeyTable(context))
            self.plain.append((total, seen + lost))
            seen_below, total_below, lost_below = seen, total, lost
        self.spare = 256 - len(self.counts[0]) if self.counts else 256

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's byte in its context."""
        out = np.zeros(len(codes))
        left, above = np.arange(len(codes)), np.full(len(codes), -1, np.int64)
        for k in range(len(self.pairs) - 1, -1, -1):
            here = codes[left]
            context = self.contexts[k].find((here >> np.uint64(8)) & _mask(k)).astype(np.int64)
            pair = self.pairs[k].find(here & _mask(k + 1))
            known = context >= 0
            sums = np.where(known, self.plain[k][0][context] if len(self.plain[k][0]) else 0.0, 0.0)
            escape = np.where(known, self.plain[k][1][context] if len(self.plain[k][1]) else 0.0, 0.0)
            if k + 1 < len(self.pairs) and (from_above := above >= 0).any():
                sums[from_above] = self.excluded[k + 1][0][above[from_above]]
                escape[from_above] = self.excluded[k + 1][1][above[from_above]]
            whole = sums + escape
            hit = pair >= 0
            out[left[hit]] += np.log10(self.counts[k][pair[hit]] / whole[hit])
            go = ~hit & known & (whole > 0)
            out[left[go]] += np.log10(escape[go] / whole[go])
            left, above = left[~hit], np.where(known, context, -1)[~hit]
        if len(left):
            out[left] -= np.log10(max(self.spare, 1))
        return out


def code_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n, lp): the count and the log10 of the probability of every byte in context that occurs."""
    grams = counts.where("kind = 1").select("key", "n")
    near = min(3, order)  # orders below are broadcast
    low = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * near)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    codes, n = np.asarray(low.column(0).combine_chunks()).view(np.uint64), np.asarray(low.column(1).combine_chunks())
    shared = counts.sparkSession.sparkContext.broadcast([_nodes(codes, n, k) for k in range(near)])
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * near)) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))) for b in batches]
        if got:
            codes, n = (np.concatenate(x) for x in zip(*got, strict=True))
            seen = n > 0
            trie = Trie([*shared.value, *(_nodes(codes[seen], n[seen], k) for k in range(near, order + 1))])
            for a in range(0, len(codes), _STEP):
                part = codes[a : a + _STEP]
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(n[a : a + _STEP]), pa.array(trie.log10(part))], ["key", "n", "lp"])
        release()

    return grams.repartition(-(-grams.count() // PART) or 1, context).mapInArrow(run, "key long, n long, lp double")


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
    order: int = ORDER, head_words: int = HEAD_WORDS, head_codes: int = HEAD_CODES,
) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from rows whose crc32(id) modulo ``folds`` is not ``held``. A null text is an empty one: a
    single end token. A null id counts as the empty text in the split. Repeated rows count and are
    scored as often as they occur. Without training rows both models are uniform. Only the two columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("at"), docs[id_col].alias("id"), docs[text_col].alias("text"), crc_remainder(id_col, folds).alias("fold"))
    counts = materialise(corpus_counts(rows.withColumn("trained", F.col("fold") != held), "trained", order=order))
    words = counts.where("kind = 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = _least_count(words, head_words)
    end_key = int(np.uint64(_END).view(np.int64))  # the end is no word of a text, so it is never looked up in the join
    head = words.where((F.col("n") >= least) | (F.col("key") == end_key)).select("key", "n").toArrow()
    model = materialise(code_scores(counts, order))
    least_code = _least_count(model.where("n > 0"), head_codes)
    near = model.where(F.col("n") >= least_code).select("key", "lp").toArrow()
    shared = spark.sparkContext.broadcast(tuple(np.asarray(x.column(i).combine_chunks()) for x in (near, head) for i in (0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lp, keys, times = shared.value
        known_codes, table = KeyTable(codes.view(np.uint64)), KeyTable(keys.view(np.uint64))
        logs = np.append(np.log10(times + 1.0), 0.0)
        end = int(table.find(np.array([_END], np.uint64))[0])
        for batch in batches:
            for part in slices(batch, 2, _STEP // 2):
                known, numbers, size = Numbers(), [], []
                raw = [_raw(t) for t in part.column(2).to_pylist()]
                for r in raw:
                    w = r.lower().split()
                    size.append(len(w))
                    numbers.extend(map(known.__getitem__, w))
                hashes = _word_hashes(list(known))
                place = table.find(hashes)
                number = np.array(numbers, np.int64)
                n_docs = len(raw)
                doc = np.repeat(np.arange(n_docs), size)
                at = place[number]
                in_head = at >= 0
                sums = np.bincount(doc, np.where(in_head, logs[at], 0.0), n_docs) + (logs[end] if end >= 0 else 0.0)
                n_head = np.bincount(doc, in_head, n_docs).astype(np.int64) + (end >= 0)
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, ~in_head, n_docs))]).astype(np.int32)), pa.array(hashes[number[~in_head]].view(np.int64)))
                scores, rare_codes = _scored(known_codes, lp, raw, order)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(np.array(size, np.int64) + 1), pa.array(n_head), pa.array(sums), tail, pa.array(scores), rare_codes], ["at", "id", "fold", "n_tokens", "n_head", "sums", "tail", "score", "codes"])
        release()

    kind = rows.schema["id"].dataType.simpleString()
    scored = materialise(rows.mapInArrow(run, f"at long, id {kind}, fold long, n_tokens long, n_head long, sums double, tail array<long>, score double, codes array<struct<key:long,times:long>>"))
    far = scored.where(F.size("codes") > 0).select("at", F.inline("codes")).join(model.where(F.col("n") < least_code).select("key", "lp"), "key")
    far = far.groupBy("at").agg(F.sum(F.col("times") * F.col("lp")).alias("far"))
    rare = scored.where(F.size("tail") > 0).select("at", F.explode("tail").alias("key"))
    rare = rare.join(words.where(F.col("n") < least).select("key", "n"), "key")
    rare = rare.groupBy("at").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("rare_sums"), F.count(F.lit(1)).alias("n_rare"))
    base = F.col("sums") + F.coalesce("rare_sums", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.join(rare, "at", "left").join(far, "at", "left").select(
        F.col("id").alias(id_col), (F.col("fold") == held).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )


def _scored(table: KeyTable, lp: np.ndarray, raw: list[bytes], order: int) -> tuple[np.ndarray, pa.Array]:
    """By text: the sum over the codes in the table, and the others as a list of (key, times)."""
    scores = np.zeros(len(raw))
    rare: list[tuple[np.ndarray, np.ndarray]] = []  # number of the text, code
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        doc, codes = np.repeat([i for i, _ in held], [len(c) for _, c in held]), np.concatenate([c for _, c in held])
        at = table.find(codes)
        seen = at >= 0
        np.add(scores, np.bincount(doc[seen], lp[at[seen]], len(raw)), out=scores)
        rare.append((doc[~seen], codes[~seen]))

    for i, r in enumerate(raw):
        for codes in coded(r, order):
            held.append((i, codes))
            size += len(codes)
            if size > _STEP:
                flush()
                held, size = [], 0
    if held:
        flush()
    doc, codes = (np.concatenate([x[k] for x in rare]) for k in (0, 1))
    by = np.lexsort((codes, doc))
    doc, codes = doc[by], codes[by]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1]))) if len(doc) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(doc)))
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(raw)))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(codes[first].view(np.int64)), pa.array(times.astype(np.int64))], ["key", "times"])
    return scores, pa.ListArray.from_arrays(pa.array(starts), pairs)


def _least_count(words: DataFrame, most: int) -> int:
    """The lowest count c such that at most ``most`` words occur c times or more, by powers of two."""
    by_size = {r["s"]: r["n"] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    room, least = most, 64
    for s in range(63, -1, -1):
        room -= by_size.get(s, 0)
        if room < 0:
            break
        least = s
    return 1 << min(least, 62)
