"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text is cut into units (leading spaces and a word, or one line break); no piece of the vocabulary
crosses such a cut, so the piece lattice of the text is the chain of its units' lattices. Forward
filtering runs once for each distinct unit of a block, vectorised over all of them; backward sampling
runs for every occurrence. The random number of a step depends only on the seed, the row key and the
position in the text, so a row's segmentation never depends on its neighbours or its partition.

The vocabulary ranks its pieces instead of giving probabilities; a piece of rank r gets the weight
``(r + 2) ** -alpha``. A large ``alpha`` (4 at most) approaches the best segmentation, 0 is uniform over paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import release, slices
from .hashing import MIX, KeyTable, Numbers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_UNITS = re.compile(r" *[^ \n]+|\n| +")
_BASE = np.uint64(0x2545F4914F6CDD1D)
#: An id above this is a character that the vocabulary spells in bytes.
_SPELLED = 1 << 21


def load_vocabulary(path: str) -> tuple[list[str], list[int]]:
    """Pieces by id, and their kinds: 0 ordinary, 1 byte, 2 control or unknown. Runs on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = [1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)]
    return [model.id_to_piece(i) for i in range(n)], kinds


def uniform(keys: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and position only."""
    with np.errstate(over="ignore"):
        z = keys + (positions.astype(np.uint64) + np.uint64(1)) * MIX
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def row_key(seed: int, key: object) -> int:
    """64 bits from the seed and a row's key; a null key has bits of its own."""
    return xxhash.xxh64_intdigest(b"\x00" if key is None else str(key).encode(), seed)


class _Filtered(NamedTuple):
    """Units' places and lengths, their last nodes, and the edges by the node where they end."""

    inverse: np.ndarray
    sizes: np.ndarray
    last: np.ndarray
    start: np.ndarray
    share: np.ndarray
    piece: np.ndarray
    span: np.ndarray
    prev: np.ndarray


class Lattice:
    """The vocabulary as a hash table of its pieces, and the sampler."""

    def __init__(self, pieces: list[str], kinds: list[int], alpha: float):
        if not 0 <= alpha <= 4:
            raise ValueError("alpha is from 0 to 4")
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 1}
        self.bytes = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace("▁", " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        usable = [(p.replace("▁", " "), i) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == 0]
        self.longest = max(len(p) for p, _ in usable)
        self.table = KeyTable(np.array([self._hash(p) for p, _ in usable], np.uint64))
        self.ids = np.array([i for _, i in usable] + [-1], np.int32)
        rank = np.arange(len(pieces)) - len(self.byte_id) - 3
        self.weight = np.append(np.maximum(rank, 0) + 2.0, len(pieces) + 2.0) ** -alpha  # the last is for spelled characters

    @staticmethod
    def _hash(text: str) -> np.uint64:
        """A polynomial whose lowest term is the last character, so that it grows to the left."""
        h, power = 0, 1
        for c in reversed(text):
            h, power = (h + (ord(c) + 1) * power) % 2**64, power * int(_BASE) % 2**64
        return np.uint64(h)

    def filtered(self, units: list[str]) -> _Filtered:
        """Forward filtering of all units at once.

        The nodes are the positions in the units, longest unit first; all units' nodes of one position
        are neighbours, so each step works on slices. Edges are kept by the node where they end, by
        length, with cumulative probabilities. A character without a piece is spelled in bytes.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-sizes, kind="stable")
        length = sizes[order]
        longest = int(length[0])
        there = np.searchsorted(-length, -np.arange(longest + 1), "right")  # units that have position p
        base = np.concatenate([[0], np.cumsum(there)])
        nodes = int(base[-1])
        position = np.repeat(np.arange(longest + 1, dtype=np.int32), there)
        unit = (np.arange(nodes) - base[position]).astype(np.int32)
        text = np.frombuffer("".join([units[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(length) - length
        chars = text[first[unit[there[0] :]] + position[there[0] :] - 1]  # of the nodes after the first position: the character before
        h, power, hits = np.zeros(nodes, np.uint64), np.uint64(1), []
        degree = np.zeros(nodes, np.int64)
        for n in range(1, min(self.longest, longest) + 1):
            h = h[there[n - 1] :]  # nodes from base[n] on
            before = chars[base[position[base[n] :] - n + 1] + unit[base[n] :] - there[0]]
            with np.errstate(over="ignore"):
                h = h + (before.astype(np.uint64) + np.uint64(1)) * power
                power = power * _BASE
            ids = self.ids[self.table.find(h)]
            if n == 1:
                none = (ids < 0) | (before == 0x2581)
                ids[none] = [self.byte_id[c] if c < 128 and c in self.byte_id else _SPELLED + c for c in before[none].tolist()]
            at = np.flatnonzero(ids >= 0)
            hits.append((at + base[n], ids[at]))
            degree[hits[-1][0]] += 1
        start = np.concatenate([[0], np.cumsum(degree)])
        total_edges = int(start[-1])
        piece, span = np.empty(total_edges, np.int32), np.empty(total_edges, np.int16)
        fill = start[:-1].copy()
        for n, (at, ids) in enumerate(hits, 1):
            piece[fill[at]], span[fill[at]] = ids, n
            fill[at] += 1
        del hits, h
        owner = np.repeat(np.arange(nodes), degree)
        prev = base[position[owner] - span] + unit[owner]
        odds = self.weight[np.minimum(piece, len(self.weight) - 1)]
        # Odds of a node: the sum over the paths to it. Only the last few positions matter, so these are scaled when they leave the range.
        total = np.ones(nodes)
        share = np.empty(total_edges)
        for p in range(1, longest + 1):
            a, b = base[p], base[p + 1]
            e, f = start[a], start[b]
            part = odds[e:f] * total[prev[e:f]]
            now = np.add.reduceat(part, start[a:b] - e)
            share[e:f] = part / np.repeat(now, degree[a:b])
            total[a:b] = now
            if (far := np.flatnonzero((now < 1e-100) | (now > 1e100))).size:
                for k in range(min(p, self.longest)):
                    total[base[p - k] + far] /= now[far]
        share = np.cumsum(share) - (np.arange(nodes) - there[0])[owner]
        share[start[there[0] + 1 :] - 1] = 1.0
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.arange(len(order))
        return _Filtered(inverse, sizes, base[sizes] + inverse, start, share, piece, span, prev)

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Sampled ids of each text. A space is put before a text that is not empty, as the vocabulary expects."""
        known = Numbers()
        numbers: list[int] = []
        counts = []
        for t in texts:
            units = _UNITS.findall(f" {t}") if t else []
            counts.append(len(units))
            numbers.extend(map(known.__getitem__, units))
        if not numbers:
            return [np.zeros(0, np.int32) for _ in texts]
        x = self.filtered(list(known))
        number = np.array(numbers, np.int64)
        ends = np.cumsum(x.sizes[number])
        doc = np.repeat(np.arange(len(texts)), counts)
        doc_at = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])
        seeds = np.array(keys, np.uint64)[doc]
        node, stop, local = x.last[number], ends.copy(), doc_at[:-1][doc]
        roots = len(x.inverse)
        out = np.full(int(ends[-1]) + 1, -1, np.int32)
        while len(node):
            u = uniform(seeds, stop - local)
            edge = x.start[node]
            open_ = np.flatnonzero(x.share[edge] <= u)
            while len(open_):
                edge[open_] += 1
                open_ = open_[x.share[edge[open_]] <= u[open_]]
            out[stop] = x.piece[edge]
            node, stop = x.prev[edge], stop - x.span[edge]
            go = np.flatnonzero(node >= roots)
            node, stop, seeds, local = node[go], stop[go], seeds[go], local[go]
        at = np.flatnonzero(out >= 0)
        return self._spelled(out[at], np.searchsorted(at, doc_at, "right"))

    def _spelled(self, ids: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
        """The ids cut by document, with spelled characters written as byte ids."""
        if (far := ids >= _SPELLED).any():
            spelled = {c: [self.byte_id[b] for b in chr(c - _SPELLED).encode("utf-8", "surrogatepass")] for c in np.unique(ids[far]).tolist()}
            times = np.ones(len(ids), np.int64)
            times[far] = [len(spelled[c]) for c in ids[far].tolist()]
            ends = np.concatenate([[0], np.cumsum(times)])
            wide = np.repeat(ids, times)
            for c, with_bytes in spelled.items():
                starts = ends[:-1][ids == c]
                for k, b in enumerate(with_bytes):
                    wide[starts + k] = b
            ids, cut = wide, ends[cut]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of these ids, without the space that encoding put first."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _lattice(shared, alpha: float) -> Lattice:
    pieces, kinds = shared.value
    return Lattice(pieces, kinds, alpha)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, alpha: float = 0.5, seed: int = 17, block_bytes: int = 1 << 21) -> DataFrame:
    """One row (id, ``ids`` array of int) per input row, in a reproducible sampled segmentation.

    A null text gives null, an empty one no ids; rows with equal key and text get equal ids; a null key
    is a key like any other. Texts of any length are encoded whole,
    in blocks of about ``block_bytes``; smaller ones take less memory and more time. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared, alpha)
        for batch in batches:
            for part in slices(batch, 1, block_bytes):
                texts = part.column(1).to_pylist()
                found = lattice.encode([t or "" for t in texts], [row_key(seed, k) for k in part.column(0).to_pylist()])
                empty = np.array([t is None for t in texts])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int32()), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])
        release()

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def with_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "pieces", vocabulary: str = VOCABULARY, alpha: float = 0.5, seed: int = 17, block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with the ids of ``encode_pieces`` in ``ids_col``, and in ``text_col`` what they decode to, in one pass. All rows and columns stay; a null text has null ids."""
    if ids_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {ids_col} already")
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    key, at = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared, alpha)
        for batch in batches:
            for part in slices(batch, at, block_bytes):
                known = part.column(at).is_valid().to_pylist()
                found = lattice.encode([t or "" for t in part.column(at).to_pylist()], [row_key(seed, k) for k in part.column(key).to_pylist()])
                texts = pa.array([lattice.decode(x.tolist()) if yes else None for x, yes in zip(found, known, strict=True)], batch.column(at).type)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int32()), mask=pa.array([not yes for yes in known]))
                yield pa.RecordBatch.from_arrays([*(texts if i == at else c for i, c in enumerate(part.columns)), ids], schema.names)
        release()

    return docs.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the text of its ids in ``out_col``, in place of the ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kept = [c for c in encoded.columns if c not in (ids_col, out_col)]
    rows = encoded.select(*[encoded[c] for c in kept], encoded[ids_col])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + [f"`{out_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared, 1.0)
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                texts = [None if x is None else lattice.decode(x) for x in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*kept, out_col])
        release()

    return rows.mapInArrow(run, schema)
