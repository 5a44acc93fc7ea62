"""Study material from texts: frequencies, key terms, summaries, cards, cloze items and grades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import blocks

SUMMARY, FALLBACK = 5, 500
TERMS, TERM_LENGTH = 15, 5
CARDS, CARD_TERM, CARD_ANSWER = 12, 60, 200
CARDS_WANTED, CARD_WORDS, CARD_CONTEXT = 4, 20, 150
QUIZ, QUIZ_WORDS, QUIZ_HITS, QUIZ_MASKS = 8, 30, 2, 2
LONGER = {"summary": 30, "cards": 20, "quiz": 40}
# Definition patterns in order of priority (term and definition by number of the group).
DEFINITIONS = (
    (r"(?i)^([\p{L}\p{N}_\s]+?)\s+(?:es|son|se define como|se refiere a|consiste en|significa)\s+(.+)$", 1, 2),
    (r"(?i)^([\p{L}\p{N}_\s]+?):\s*(.+)$", 1, 2),
    (r"(?i)^(?:se llama|se denomina|se conoce como)\s+([\p{L}\p{N}_\s]+?)\s+(?:a|al|los|las)\s+(.+)$", 1, 2),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once: as a lambda's variable the optimizer cannot copy it into the inner loops."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run_starts(rows: Column, field: str) -> Column:
    """Places in a sorted array of structs at which the field has a new value."""
    return F.array_compact(F.transform(rows, lambda x, i: F.when((i == 0) | (x[field] != F.get(rows, i - 1)[field]), i)))


def _runs(rows: Column, field: str, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The body for each run of equal values of a field in the sorted rows: (rows, first place, length, number of the run)."""
    return _let(rows, lambda s: _let(_run_starts(s, field), lambda at: F.transform(at, lambda a, j: body(s, a, F.coalesce(F.get(at, j + 1), F.size(s)) - a, j))))


def _frequencies(text: Column) -> Column:
    """The content words of a text as (word, n, first_pos). The tokens are sorted within the row, so nothing is shuffled."""
    places = F.transform(tx.tokens(text), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    content = F.sort_array(F.filter(places, lambda x: ~x["word"].isin(*tx.STOPWORDS)))
    return _runs(content, "word", lambda s, a, n, j: F.struct(F.get(s, a)["word"].alias("word"), n.cast("long").alias("n"), F.get(s, a)["pos"].alias("first_pos")))


def _top(freq: Column, most: int, least_length: int = 0) -> Column:
    """Of the frequencies the words with the highest counts, of equals the first in the text, as (word, n)."""
    long = F.filter(freq, lambda f: F.length(f["word"]) >= least_length)
    ranked = F.sort_array(F.transform(long, lambda f: F.struct((-f["n"]).alias("n"), f["first_pos"].alias("first_pos"), f["word"].alias("word"))))
    return F.transform(F.slice(ranked, 1, most), lambda f: F.struct(f["word"].alias("word"), (-f["n"]).alias("n")))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def word_frequencies(docs: DataFrame) -> DataFrame:
    """Content words of each document with their counts and first places; a row is a document, a null text has none."""
    return docs.select("doc_id", F.inline_outer(_frequencies(_text(docs)))).where("word IS NOT NULL")


def top_words(docs: DataFrame, most: int, least_length: int = 0) -> DataFrame:
    """(doc_id, word, n, rank): by count, then by first place."""
    found = docs.select("doc_id", F.posexplode_outer(_top(_frequencies(_text(docs)), most, least_length)).alias("r", "w"))
    return found.where("r IS NOT NULL").select("doc_id", "w.*", (F.col("r") + 1).alias("rank"))


def key_terms(docs: DataFrame) -> DataFrame:
    return top_words(docs, TERMS, TERM_LENGTH)


def sentence_rows(docs: DataFrame, longer_than: int) -> DataFrame:
    return docs.select("doc_id", F.posexplode(tx.sentences(_text(docs), longer_than)).alias("ord", "sentence"))


def _scored(text: Column, longer_than: int) -> Column:
    """(ord, sentence, score) of the sentences that are long enough.

    The words of all sentences are sorted by word, which gives each its count, and then by sentence; every sentence
    brings a mark of -1, so that the runs by sentence are the sentences in order.
    """

    def scores(pieces: Column) -> Column:
        words = F.flatten(F.transform(pieces, lambda p, k: F.transform(tx.content_words(tx.tokens(p)), lambda w: F.struct(w.alias("word"), k.alias("k")))))
        counts = F.flatten(_runs(F.sort_array(words), "word", lambda s, a, n, j: F.transform(F.slice(s, a + 1, n), lambda x: F.struct(x["k"].alias("k"), n.alias("n")))))
        marked = F.sort_array(F.concat(F.transform(pieces, lambda p, k: F.struct(k.alias("k"), F.lit(-1).alias("n"))), counts))
        total = lambda s, a, n: F.aggregate(F.slice(s, a + 2, n - 1), F.lit(0).cast("long"), lambda t, x: t + x["n"])
        mean = lambda s, a, n, j: F.struct(F.get(pieces, j).alias("sentence"), F.when(n > 1, total(s, a, n) / (n - 1)).otherwise(0.0).alias("score"))
        return _runs(marked, "k", mean)

    kept = F.filter(_let(tx.sentences(text, -1), scores), lambda x: F.length(x["sentence"]) > longer_than)
    return F.transform(kept, lambda x, i: F.struct(i.alias("ord"), x["sentence"].alias("sentence"), x["score"].alias("score")))


def sentence_scores(docs: DataFrame, longer_than: int = LONGER["summary"]) -> DataFrame:
    """Each sentence with the mean frequency of its content words; 0 without any."""
    return docs.select("doc_id", F.inline_outer(_scored(_text(docs), longer_than))).where("ord IS NOT NULL")


def _summary(text: Column, most: int = SUMMARY) -> Column:
    def best(scored: Column) -> Column:
        ranked = F.sort_array(F.transform(scored, lambda x: F.struct((-x["score"]).alias("s"), x["ord"].alias("ord"), x["sentence"].alias("sentence"))))
        in_order = F.sort_array(F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["ord"].alias("ord"), x["sentence"].alias("sentence"))))
        return F.when(F.size(scored) > 0, F.array_join(F.transform(in_order, lambda x: x["sentence"]), " ")).otherwise(F.substring(text, 1, FALLBACK))

    return _let(_scored(text, LONGER["summary"]), best)


def summaries(docs: DataFrame, most: int = SUMMARY) -> DataFrame:
    """The best sentences in their order of the text; without any, the first characters of it."""
    return docs.select("doc_id", _summary(_text(docs), most).alias("summary"))


def _definition(sentence: Column) -> Column:
    """(topic, answer) of the first pattern that a sentence fits with a term of under 60 characters; else null."""
    found = F.lit(None).cast("struct<topic:string,answer:string>")
    for pattern, term, answer in reversed(DEFINITIONS):
        t, d = F.trim(F.regexp_extract(sentence, pattern, term)), F.trim(F.regexp_extract(sentence, pattern, answer))
        found = F.when(sentence.rlike(pattern) & (t != "") & (d != "") & (F.length(t) < CARD_TERM), F.struct(t.alias("topic"), F.substring(d, 1, CARD_ANSWER).alias("answer"))).otherwise(found)
    return found


def definition_cards(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, topic, answer): sentences that fit a pattern, the first one by priority, with a term of under 60 characters."""
    found = sentence_rows(docs, LONGER["cards"]).select("doc_id", "ord", _definition(F.col("sentence")).alias("c"))
    return found.where("c IS NOT NULL").select("doc_id", "ord", "c.*")


def _cards(text: Column, freq: Column, most: int = CARDS) -> Column:
    """(topic, question, answer) of a text: definitions, and the surroundings of its top words if these are under four."""
    # The two questions.
    card = lambda before, after: lambda c: F.struct(c["topic"].alias("topic"), F.concat(F.lit(before), c["topic"], F.lit(after)).alias("question"), c["answer"].alias("answer"))
    defined = F.transform(F.array_compact(F.transform(tx.sentences(text, LONGER["cards"]), lambda s: _definition(s))), card("¿Qué es ", "?"))
    around = lambda w: F.substring(F.regexp_substr(text, F.concat(F.lit(r"(?iU)\b"), w, F.lit(r"\b.{5,120}"))), 1, CARD_CONTEXT)
    context = F.filter(F.transform(_top(freq, CARD_WORDS, TERM_LENGTH), lambda t: F.struct(t["word"].alias("topic"), around(t["word"]).alias("answer"))), lambda c: c["answer"].isNotNull())
    return F.slice(_let(defined, lambda d: F.when(F.size(d) < CARDS_WANTED, F.concat(d, F.transform(context, card("¿Qué se dice sobre '", "'?")))).otherwise(d)), 1, most)


def flashcards(docs: DataFrame) -> DataFrame:
    """(doc_id, rank, topic, question, answer): definitions in order of the text; a document with under four
    gets the surroundings of its top words as well; twelve cards at most."""
    found = docs.select("doc_id", F.posexplode_outer(_cards(_text(docs), _frequencies(_text(docs)))).alias("r", "c"))
    return found.where("r IS NOT NULL").select("doc_id", (F.col("r") + 1).alias("rank"), "c.topic", "c.question", "c.answer")


def _quiz(text: Column, freq: Column) -> Column:
    """(ord, question, answer, keywords): the first eight sentences with two or more of the top words."""
    asked = lambda top: F.transform(tx.sentences(text, LONGER["quiz"]), lambda s, i: F.struct(i.alias("ord"), s.alias("answer"), F.array_intersect(top, tx.tokens(s)).alias("keywords")))
    rows = F.slice(F.filter(_let(F.transform(_top(freq, QUIZ_WORDS, TERM_LENGTH), lambda t: t["word"]), asked), lambda q: F.size(q["keywords"]) >= QUIZ_HITS), 1, QUIZ)

    def masked(q: Column) -> Column:
        out = q["answer"]
        for k in range(QUIZ_MASKS):
            out = F.regexp_replace(out, F.concat(F.lit(r"(?isU)^(.*?)\b"), F.get(q["keywords"], F.lit(k)), F.lit(r"\b")), F.lit("$1___"))
        return F.struct(q["ord"].alias("ord"), out.alias("question"), q["answer"].alias("answer"), F.slice(q["keywords"], 1, 5).alias("keywords"))

    return F.transform(rows, masked)


def cloze(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, question, answer, keywords): sentences with two or more of the top words, the first places of the two most frequent masked."""
    return docs.select("doc_id", F.inline_outer(_quiz(_text(docs), _frequencies(_text(docs))))).where("ord IS NOT NULL")


def bundles(docs: DataFrame) -> DataFrame:
    """A study bundle per document, keyed by the hash of its text: summary, key terms, cards and cloze items. Each is made from its own row."""
    numbered = lambda xs, *fields: F.transform(xs, lambda x, i: F.struct((i + 1).alias("rank"), *[x[f].alias(f) for f in fields]))
    text = _text(docs)

    def parts(freq: Column) -> Column:
        quiz = F.transform(_quiz(text, freq), lambda q: F.struct(q["ord"].alias("ord"), q["question"].alias("question")))
        return F.struct(numbered(_top(freq, TERMS, TERM_LENGTH), "word").alias("terms"), numbered(_cards(text, freq), "question", "answer").alias("cards"), quiz.alias("quiz"))

    made = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("key"), _summary(text).alias("summary"), _let(_frequencies(text), parts).alias("p"))
    return made.select("doc_id", "key", "summary", "p.*")


def block_bundles(rows: DataFrame) -> DataFrame:
    """A study bundle per document of blocks (doc_id, pos, kind, text): cards from headings and what answers them, filled up
    from the text if these are under four; headings first among the terms; cloze items from paragraphs and list items, or
    from the whole text if there are none. A document's blocks are put together once."""
    by = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("b"))
    b = F.col("b")
    is_heading = lambda x: (x["kind"] == "heading") & (x["text"] != "")
    by = by.select("doc_id", "b", F.array_join(F.transform(b, lambda x: x["text"]), "\n").alias("text"))
    answered = F.transform(b, lambda x, i: F.when(is_heading(x) & (F.length(x["text"]) <= blocks.HEADING), F.struct(x["text"].alias("topic"), F.substring(blocks.answer_of(F.slice(b, i + 2, F.lit(blocks.AHEAD))), 1, CARD_ANSWER).alias("answer"))))
    # The question.
    headed = F.transform(F.filter(answered, lambda c: c["answer"].isNotNull()), lambda c: F.struct(c["topic"].alias("topic"), F.concat(F.lit("¿Qué es "), c["topic"], F.lit("?")).alias("question"), c["answer"].alias("answer")))
    prose = F.array_join(F.transform(F.filter(b, lambda x: x["kind"].isin("paragraph", "list_item")), lambda x: x["text"]), "\n\n")
    text, prose = F.col("text"), F.when(prose != "", prose).otherwise(F.col("text"))

    def parts(freq: Column) -> Column:
        cards = F.slice(_let(headed, lambda h: F.when(F.size(h) < CARDS_WANTED, F.concat(h, _cards(text, freq))).otherwise(h)), 1, CARDS)
        named = F.concat(F.transform(F.filter(b, is_heading), lambda x: x["text"]), F.transform(_top(freq, TERMS, TERM_LENGTH), lambda t: t["word"]))
        return F.struct(_first_terms(named).alias("terms"), cards.alias("cards"))

    out = by.select("doc_id", _summary(text).alias("summary"), _let(_frequencies(text), parts).alias("p"), _let(_frequencies(prose), lambda freq: _quiz(prose, freq)).alias("quiz"))
    return out.select("doc_id", "summary", "p.*", F.transform("quiz", lambda q: F.struct(q["ord"].alias("ord"), q["question"].alias("question"))).alias("quiz"))


def _first_terms(terms: Column, most: int = TERMS) -> Column:
    """The first terms that differ in lower case."""
    zero = F.array().cast("array<string>")
    take = lambda out, t: F.when((F.size(out) < most) & ~F.exists(out, lambda o: F.lower(o) == F.lower(t)), F.array_append(out, t)).otherwise(out)
    return F.aggregate(terms, zero, take)


def exam(answers: DataFrame, passing: int = 40) -> DataFrame:
    """Share of graded answers (``grade``) that pass, in per cent, and how many there are."""
    return answers.agg(F.count(F.lit(1)).alias("n_answers"), F.round(100 * F.avg((F.col("grade") >= passing).cast("int")), 2).alias("exam_score"))


def distinct_terms(rows: DataFrame, most: int = 15) -> DataFrame:
    """Terms of each document once, whatever their case, in order of first appearance."""
    first = rows.withColumn("seen", F.row_number().over(Window.partitionBy("doc_id", F.lower("term")).orderBy("ord"))).where("seen = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("rank") <= most).select("doc_id", "rank", "term")
