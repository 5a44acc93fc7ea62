"""Toxicity by a classifier chain.

The categories of ``labels`` are predicted one after the other by sparse linear models over the words of
a text and a few marks of its form; each model also sees the probabilities of the categories before it.
While training, these are out-of-fold predictions, so that a later model learns from probabilities as
good as those it will see. The models are fitted on at most ``sample`` labelled documents (the lowest
hashes of their ids); their vocabulary is that of the sample, exact and without hashing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, release, slices
from .hashing import Numbers
from .langid import bounded_sample
from .linear import Example, Ftrl, logits, softmax

SAMPLE = 6000
FOLDS = 5
THRESHOLD = 0.5
#: (category, column of the labels, value that means it applies), in the order of the chain.
CHAIN = (("junk", "quality", 0), ("toxic", "toxic", 1))
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]")
_DIGITS = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-Z]")
_LEAST_DOCS = 5
#: Lengths of the beginnings of words.
STARTS = (3, 4)


def marks(text: str) -> list[str]:
    """Names for the form of a text: how much of it is signs, digits or capitals."""
    n = max(1, len(text))
    parts = (("sign", len(_MARKS.findall(text))), ("digit", len(_DIGITS.findall(text))), ("upper", len(_UPPER.findall(text))))
    return [f"<{name}:{min(9, int(20 * k / n))}>" for name, k in parts]


def features(text: str | None) -> list[str]:
    """The distinct words of the whole text in lower case, their beginnings (up to a hyphen), which tell of words
    that the sample lacks, and the text's marks (in angle brackets, so no word is one)."""
    text = text or ""
    words = dict.fromkeys(_WORD.findall(text.lower()))
    starts = {f"{w[:n]}-" for w in words for n in STARTS}
    return [*words, *sorted(starts), *marks(text)]


def _examples(shared: tuple, use: np.ndarray) -> list[Example]:
    """The features of these rows: places of their words, each once, then the probabilities of the earlier categories."""
    flat, ends, earlier, width, _ = shared
    extra = np.arange(width - earlier.shape[1], width)
    return [(np.concatenate([flat[ends[i] : ends[i + 1]], extra]), np.concatenate([np.ones(ends[i + 1] - ends[i]), earlier[i]])) for i in use.tolist()]


def _fits(shared: tuple, uses: list[np.ndarray], rounds: int, spark: SparkSession | None) -> list[np.ndarray]:
    """The weights fitted on each of these choices of rows; with a session each fit is a task."""

    def fitted(shared: tuple, use: np.ndarray) -> np.ndarray:
        return Ftrl(shared[3], 2, alpha=0.4, l1=3.0, l2=0.5).fit(_examples(shared, use), shared[4][use], rounds).weights()

    if spark is None:
        return [fitted(shared, use) for use in uses]
    sent = spark.sparkContext.broadcast((shared, uses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shared, uses = sent.value
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([fitted(shared, uses[k]).tobytes()], pa.binary())], ["k", "w"])
        release()

    found = spark.range(0, len(uses), 1, len(uses)).mapInArrow(run, "k long, w binary").toArrow().to_pydict()
    out = dict(zip(found["k"], found["w"], strict=True))
    return [np.frombuffer(out[k]).reshape(-1, 2) for k in range(len(uses))]


def fit_chain(rows: Iterable[tuple[list[str], dict[str, int | None]]], chain: tuple[str, ...], folds: int = FOLDS, rounds: int = 4, spark: SparkSession | None = None) -> list[dict]:
    """A model for each category in turn: feature weights, intercept, and weights of the earlier categories.

    A row without a label for a category is left out of that category's model. A category without
    examples gets a model that never applies.
    """
    numbers, each, labels = Numbers(), [], []
    for words, known in rows:
        each.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        labels.append(known)
    seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *each]), minlength=len(numbers))
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, k in numbers.items() if seen[k] >= _LEAST_DOCS))}
    place = np.full(len(numbers), -1, np.int32)
    for f, i in vocabulary.items():
        place[numbers[f]] = i
    each = [x[x >= 0] for x in (place[k] for k in each)]
    flat, ends = np.concatenate([np.zeros(0, np.int32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    n = len(each)
    del each, numbers, place, seen  # the driver's memory has to hold the rest
    release()
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    out = []
    for category in chain:
        width = len(vocabulary) + earlier.shape[1]
        y = np.array([-1 if x.get(category) is None else x[category] for x in labels], np.int64)
        shared = (flat, ends, earlier, width, y)
        inside = [np.flatnonzero(fold == k) for k in range(folds)]
        uses = [np.flatnonzero((fold != k) & (y >= 0)) for k in range(folds)]
        use = np.flatnonzero(y >= 0)
        weights = _fits(shared, [*uses, use], rounds, spark)
        own = np.zeros(n)
        for rows_of, outside, w in zip(inside, uses, weights, strict=False):
            if len(rows_of) and len(outside):
                own[rows_of] = softmax(logits(w, _examples(shared, rows_of)))[:, 1]
        if (y == 1).any():
            difference = weights[-1][:, 1] - weights[-1][:, 0]
        else:
            difference = np.append(np.zeros(width), -20.0)
        words = {f: float(difference[i]) for f, i in vocabulary.items() if difference[i]}
        out.append({"category": category, "words": words, "bias": float(difference[-1]), "earlier": difference[len(vocabulary) : -1].tolist()})
        earlier = np.column_stack([earlier, own])
    return out


def chain_probabilities(model: list[dict], found: list[str]) -> list[float]:
    """The probability of each category in turn, each from the features and the ones before it."""
    out: list[float] = []
    for m in model:
        words = m["words"]
        s = m["bias"] + sum(words[f] for f in found if f in words) + sum(a * b for a, b in zip(m["earlier"], out, strict=True))
        out.append(1.0 / (1.0 + np.exp(-s)) if s > -700 else 0.0)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain=CHAIN, sample: int = SAMPLE) -> list[dict]:
    """The chain fitted on labelled documents. Null ids, and labels that are null, teach nothing; of several labels of an id the greatest counts, of several texts the one with the least hash."""
    wanted = [F.max((labels[column] == value).cast("int")).alias(category) for category, column, value in chain]
    each = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(*wanted)
    chosen = bounded_sample(each, F.xxhash64(F.col("id").cast("string")), sample)
    names = [c for c, _, _ in chain]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id").groupBy("id", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 22):
                words = [" ".join(features(t)) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *part.columns[1:]], ["words", *part.schema.names[1:]])

    schema = ", ".join(["words string", *[f"`{c}` int" for c in names], "h long"])
    sample_rows = rows.select("text", *names, F.xxhash64(F.col("id").cast("string"), "text").alias("h")).mapInArrow(run, schema)

    def each_row() -> Iterator[tuple[list[str], dict[str, int | None]]]:  # when it ends, the sample is gone
        found = sample_rows.toArrow().sort_by([("h", "ascending"), ("words", "ascending")])
        for i in range(len(found)):
            yield found["words"][i].as_py().split(" "), {c: found[c][i].as_py() for c in names}

    model = fit_chain(each_row(), tuple(names), spark=docs.sparkSession)
    release()  # on the driver, whose memory holds the sample until here
    return model


def with_toxicity(docs: DataFrame, model: list[dict], text_col: str, columns: dict[str, str]) -> DataFrame:
    """``docs`` with a probability column for each category, named by ``columns``. A null or empty text gets probability 0 throughout."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(columns[m["category"]], T.DoubleType()) for m in model]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, at, 1 << 22):
                p = np.array([chain_probabilities(fitted, features(t)) if t else [0.0] * len(fitted) for t in part.column(at).to_pylist()]).reshape(-1, len(fitted))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, k]) for k in range(len(fitted))]], names)
        release()

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain=CHAIN, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, ``p_<category>`` for each category of the chain, and ``toxic``: whether the last one reaches ``threshold``.

    Empty labels give a chain that never applies. Other columns are not read.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, chain, sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    scored = with_toxicity(rows, model, "text", {c: f"p_{c}" for c, _, _ in chain})
    return scored.select(F.col("id").alias(id_col), *[f"p_{c}" for c, _, _ in chain], (F.col(f"p_{chain[-1][0]}") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain=CHAIN, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose last category reaches ``threshold``; all columns stay."""
    model = fit_toxicity(docs, labels, id_col, text_col, chain, sample)
    names = {c: fresh(docs, f"_granary_{c}") for c, _, _ in chain}
    scored = with_toxicity(docs, model, text_col, names)
    return scored.where(F.col(names[chain[-1][0]]) < threshold).select(*[scored[c] for c in docs.columns])
