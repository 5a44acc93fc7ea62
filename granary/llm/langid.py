"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text, weighted by term frequency and inverse
document frequency and scaled to length one. Document frequencies come from all training documents.
The regression is fitted by follow-the-regularised-leader with elastic-net penalties on a sample of at
most ``sample`` distinct training texts (the lowest hashes), of which a fifth sets the temperature. The
sample is shared out by language: each one gives its even share or all it has, and what small ones
leave goes to the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, slices
from .linear import Ftrl, logits, softmax, temperature

BITS = 15
SAMPLE = 3000
UNKNOWN = "und"
_GRAMS = 3
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_STEP = 1 << 20


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(chars), _STEP):
        part = chars[a : a + _STEP + _GRAMS - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, _GRAMS + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] + part[n - 1 :] + np.uint32(n)) * _PRIMES[n - 1]
            h ^= h >> np.uint32(15)
            own = h[:_STEP]  # n-grams that start in the next part are counted there
            out += np.bincount((own >> np.uint32(32 - BITS)), minlength=1 << BITS)
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = counts[at] * idf[at]
    norm = float(np.sqrt(x @ x))
    return at, x / norm if norm else x


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each n-gram occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, 0, 1 << 22):
                for t in part.column(0).to_pylist():
                    df[:-1] += gram_counts(t or "") > 0
            n += len(batch)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["gram", "n"])

    found = train.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 2**BITS rows and one at most
    df = np.zeros((1 << BITS) + 1, np.int64)
    for r in found:
        df[r["gram"]] = r["n"]
    return df[:-1], int(df[-1])


def bounded_sample(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The rows with the ``most`` lowest values of ``order`` (a hash), and those equal to the last of them."""
    cut = rows.select(order.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return rows.where(order <= F.lit(cut)) if cut is not None else rows.limit(0)


def shares(found: dict[str, int], most: int) -> dict[str, int]:
    """How many of ``most`` each language gets, the smaller first: an even part of what is left, one at least."""
    out, left = {}, most
    for i, (lang, n) in enumerate(sorted(found.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(found) - i)))
        left -= out[lang]
    return out


def shared_sample(rows: DataFrame, most: int) -> DataFrame:
    """Distinct (text, lang), of each language those with the lowest hashes."""
    hashes = rows.select("lang", F.xxhash64("text", "lang").alias("h")).distinct()
    first = hashes.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= most)
    part = shares({r["lang"]: r["n"] for r in first.groupBy("lang").agg(F.max("place").alias("n")).collect()}, most)
    if not part:
        return rows.limit(0)
    of = lambda x: F.try_element_at(F.create_map(*[F.lit(y) for kv in x.items() for y in kv]), F.col("lang"))
    cuts = {r["lang"]: r["h"] for r in first.where(F.col("place") == of(part)).collect()}
    return rows.where(F.xxhash64("text", "lang") <= of(cuts)).dropDuplicates(["text", "lang"])


def fit(train: DataFrame, sample: int = SAMPLE, rounds: int = 4) -> dict:
    """A model from rows (text, lang): idf, weights by language, and the temperature. Without rows it knows no language."""
    df, n = _document_frequencies(train)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    chosen = shared_sample(train.where("text IS NOT NULL"), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                found = [gram_counts(t) for t in part.column(0).to_pylist()]
                at = [np.flatnonzero(c).astype(np.int32) for c in found]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for a, c in zip(at, found, strict=True)], pa.binary())], ["lang", "at", "n"])

    rows = sorted(chosen.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect(), key=lambda r: (hash_bytes(r["at"], r["n"]), r["lang"]))
    ahead = {r["lang"]: i for i, r in reversed(list(enumerate(rows)))}  # one row of each language is never held out
    rows = [r for i, r in enumerate(rows) if ahead[r["lang"]] != i] + [rows[i] for i in sorted(ahead.values())]
    langs = sorted(ahead)
    place = {x: i for i, x in enumerate(langs)}
    examples = []
    for r in rows:
        counts = np.zeros(1 << BITS)
        counts[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int32)
        examples.append(vector(counts, idf))
    classes = np.array([place[r["lang"]] for r in rows], np.int64)
    if not langs:
        return {"langs": [], "idf": idf, "weights": np.zeros(((1 << BITS) + 1, 0)), "temperature": 1.0}
    held = min(len(rows) // 5, len(rows) - len(langs))
    model = Ftrl(1 << BITS, len(langs), alpha=1.0, l1=0.02, l2=0.02).fit(examples[held:], classes[held:], rounds)
    weights = model.weights()
    return {"langs": langs, "idf": idf, "weights": weights, "temperature": temperature(logits(weights, examples[:held]), classes[:held])}


def hash_bytes(*parts: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"\0".join(bytes(p) for p in parts))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ``lang_pred``, ``score``) per input row, from the text alone.

    Texts that are null or without a letter, and all texts for a model without languages, get ``und``
    and score 0; letters are those of Unicode category L. Of equal scores the first language by name wins. Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scaled, bias = m["idf"][:, None] * m["weights"][:-1], m["weights"][-1]
        squared = m["idf"] ** 2
        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                langs, scores = [], []
                for t in part.column(1).to_pylist():
                    if not t or not m["langs"] or not any(map(str.isalpha, t)):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    counts = gram_counts(t)
                    at = np.flatnonzero(counts)
                    c = counts[at]
                    p = softmax(((c @ scaled[at]) / np.sqrt((c * c) @ squared[at]) + bias) / m["temperature"])
                    best = int(p.argmax())
                    langs.append(m["langs"][best])
                    scores.append(float(p[best]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """``identify`` over all rows with a model learned from the rows whose crc32(id) modulo ``folds`` is not ``held`` and whose language is known."""
    train = docs.where((crc_remainder(id_col, folds) != held) & F.col(lang_col).isNotNull()).select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    return identify(docs, fit(train, sample), id_col, text_col)
