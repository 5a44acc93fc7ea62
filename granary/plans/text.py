"""Text queries over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import structure, study
from granary.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_FROM, _TO = tx.MARKED[:26], tx.PLAIN_[:26]
_PLAIN = f"translate(lower(trim(coalesce(text, ''), ' ')), '{_FROM}', '{_TO}')"
_TOKENS = f"list_filter(regexp_extract_all({{}}, '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{{{3,}}}}'))".replace("{{{{", "{").replace("}}}}", "}")
_WORDS = f"(SELECT doc_id, unnest(w) AS word, unnest(range(len(w)))::INTEGER AS pos FROM (SELECT doc_id, {_TOKENS.format(_PLAIN)} AS w FROM documents))"
_FREQ = f"(SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM {_WORDS} WHERE word NOT IN ({_STOP}) GROUP BY 1, 2)"


def _sentences(longer: int) -> str:
    parts = "list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g'), '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^ +| +$', '', 'g'))"
    return f"(SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s)))::INTEGER AS ord FROM (SELECT doc_id, list_filter({parts}, lambda s: length(s) > {longer}) AS s FROM documents))"


_SCORES = f"""(SELECT s.doc_id, s.ord, s.sentence, coalesce(avg(f.n), 0.0) AS score FROM {_sentences(30)} s
 LEFT JOIN (SELECT doc_id, ord, unnest({_TOKENS.format(_PLAIN.replace("text", "sentence"))}) AS word FROM {_sentences(30)}) t ON s.doc_id = t.doc_id AND s.ord = t.ord
 LEFT JOIN {_FREQ} f ON f.doc_id = t.doc_id AND f.word = t.word GROUP BY 1, 2, 3)"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("text_tokens", f"SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_distinct(w))::INTEGER AS n_distinct FROM (SELECT doc_id, {_TOKENS.format(_PLAIN)} AS w FROM documents)")
def _tokens(spark, sf_dir):
    w = tx.tokens(F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("text_word_freq", f"SELECT doc_id, word, n, first_pos FROM {_FREQ}")
def _freq(spark, sf_dir):
    return study.word_frequencies(docs(spark, sf_dir))


@query("text_key_terms", f"SELECT doc_id, word, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM {_FREQ} WHERE length(word) >= 5) WHERE rank <= 15")
def _terms(spark, sf_dir):
    return study.key_terms(docs(spark, sf_dir))


@query("text_sentences", f"SELECT doc_id, ord, sentence FROM {_sentences(20)}")
def _sent(spark, sf_dir):
    return study.sentence_rows(docs(spark, sf_dir), 20)


@query("text_sentence_scores", f"SELECT doc_id, ord, round(score, 6) AS score FROM {_SCORES}")
def _sent_scores(spark, sf_dir):
    return study.sentence_scores(docs(spark, sf_dir)).select("doc_id", "ord", F.round("score", 6).alias("score"))


@query("text_summary", f"""SELECT d.doc_id, coalesce(s.best, substr(coalesce(d.text, ''), 1, 500)) AS summary FROM documents d LEFT JOIN
 (SELECT doc_id, string_agg(sentence, ' ' ORDER BY ord) AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM {_SCORES}) WHERE r <= 5 GROUP BY doc_id) s USING (doc_id)""")
def _summary(spark, sf_dir):
    return study.summaries(docs(spark, sf_dir))


@query("text_flashcards")
def _cards(spark, sf_dir):
    return study.flashcards(docs(spark, sf_dir))


@query("text_cloze")
def _cloze(spark, sf_dir):
    return study.cloze(docs(spark, sf_dir))


@query("study_bundles")
def _bundles(spark, sf_dir):
    return study.bundles(docs(spark, sf_dir))


@query("bundle_key", "SELECT doc_id, sha256(coalesce(text, '')) AS key, substr(sha1(coalesce(text, '')), 1, 6) AS short_key FROM documents")
def _key(spark, sf_dir):
    t = F.coalesce("text", F.lit("")).cast("binary")
    return docs(spark, sf_dir).select("doc_id", F.sha2(t, 256).alias("key"), F.substring(F.sha1(t), 1, 6).alias("short_key"))


def _answers(spark, sf_dir):
    """Each user turn with the assistant's next turn; keywords are the long words of the question."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("expected"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("given"))
    rows = q.join(a, ["conv_id", "turn"])
    return rows.withColumn("keywords", F.array_distinct(F.filter(tx.tokens(F.col("expected")), lambda w: F.length(w) >= 8)))


def _tok(col: str) -> str:
    return _TOKENS.format(_PLAIN.replace("text", col))


def _split(col: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({_PLAIN.replace('text', col)}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))"


_GRADES = f"""(SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0 ELSE round_even((0.4::DOUBLE * (len(list_intersect(w, g))::DOUBLE / len(w)) + 0.6::DOUBLE * CASE WHEN len(k) > 0 THEN len(list_intersect(k, g))::DOUBLE / len(k) ELSE 0.5::DOUBLE END) * 100, 0)::INTEGER END AS grade
 FROM (SELECT q.conv_id, q.turn, {_split("q.text")} AS w, {_split("a.text")} AS g, list_distinct(list_filter({_tok("q.text")}, lambda x: length(x) >= 8)) AS k
 FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'))"""


@query("answer_grade", f"SELECT conv_id, turn, grade FROM {_GRADES}")
def _grade(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", tx.grade(F.col("expected"), F.col("given"), F.col("keywords")).alias("grade"))


@query("exam_score", f"SELECT count(*) AS n_answers, round(100 * avg((grade >= 40)::INTEGER), 2)::DOUBLE AS exam_score FROM {_GRADES}")
def _exam(spark, sf_dir):
    return study.exam(_answers(spark, sf_dir).select(tx.grade(F.col("expected"), F.col("given"), F.col("keywords")).alias("grade")))


_ONE = {a: b for a, b in tx.TYPED.items() if len(b) == 1}
_TYPED = f"translate(replace(replace(nfc_normalize(coalesce(text, '')), '…', '...'), chr(65279), ''), '{''.join(_ONE)}', '{''.join(_ONE.values()).replace(chr(39), chr(39) * 2)}')"
_PARTS = rf"string_split(regexp_replace(regexp_replace(regexp_replace({_TYPED}, '\r\n?', chr(10), 'g'), '\n{{2,}}', chr(1), 'g'), '\n([ \t]*(?:[-*]|[0-9]+[.)])[ \t])', chr(1) || '\1', 'g'), chr(1))"


@query("text_clean", rf"SELECT doc_id, trim(array_to_string(list_transform({_PARTS}, lambda p: trim(regexp_replace(replace(p, '-' || chr(10), ''), '[ \t\n]+', ' ', 'g'), ' ')), chr(10) || chr(10)), ' ' || chr(10)) AS cleaned FROM documents")
def _clean(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("accent_fallback", f"SELECT doc_id, translate(coalesce(text, ''), '{''.join(a for a in tx.MARKED if a not in 'ñÑ')}', '{''.join(b for a, b in zip(tx.MARKED, tx.PLAIN_, strict=True) if a not in 'ñÑ')}') AS plain FROM documents")
def _accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.keep_tilde_n(F.coalesce("text", F.lit(""))).alias("plain"))


#: Around each text: a preamble and a break in several forms, and every pair of quotes, by the number of the turn.
_BREAKS = ("\n", "\n\n", " \t\n \t\n", "\r\n\n")
_QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("«", "»"), ("", ""))


@query("wrapper_strip", r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def _strip(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.pmod("turn", F.lit(len(xs))).cast("int") + 1)
    wrapped = F.concat(F.lit(" \n"), pick([q for q, _ in _QUOTES]), F.lit("Aquí está el texto corregido:"), pick(_BREAKS), "text", F.lit("\t"), pick([q for _, q in _QUOTES]), F.lit("\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip_wrapper(wrapped).alias("answer"))


@query("length_guard", "SELECT conv_id, turn, CASE WHEN 30 >= 0.4 * length(text) AND length(text) > 0 THEN rtrim(substr(text, 1, 30), ' ') ELSE text END AS kept FROM conversations")
def _guard(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.guarded(F.col("text"), F.rpad(F.substring("text", 1, 30), 30, " ")).alias("kept")).withColumn("kept", F.rtrim("kept"))


@query("word_diff", r"""SELECT conv_id, turn, sum((a <> b)::INTEGER)::BIGINT AS n_changed FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0b\f\r]+')) AS a, unnest(regexp_split_to_array(trim(replace(text, 'la', 'LA'), ' '), '[ \t\n\x0b\f\r]+')) AS b FROM conversations) GROUP BY 1, 2""")
def _diff(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tx.word_changes(F.col("text"), F.replace(F.col("text"), F.lit("la"), F.lit("LA")))).cast("long").alias("n_changed"))


_LINES = "(SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INTEGER AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
_KIND = r"CASE WHEN regexp_full_match(line, '[ \t\n\x0b\f\r]*') THEN 'blank' WHEN regexp_matches(line, '^[ \t]*#{1,3}[ \t\n\x0b\f\r]') THEN 'heading' WHEN regexp_matches(line, '^[ \t]*[0-9]+[:.)][ \t\n\x0b\f\r]') THEN 'numbered' WHEN regexp_matches(line, '^[ \t]*[-*•][ \t\n\x0b\f\r]') THEN 'bullet' ELSE 'paragraph' END"


def _marked(spark, sf_dir):
    """Documents with lines of every kind: each line's mark, indent and gap follow from its length."""
    line = lambda x, i: F.concat(F.element_at(F.array(*[F.lit(m) for m in ("", "# ", "  - ", "1. ", "\t* ", "    ", "## ")]), (F.length(x) % 7 + 1).cast("int")), x, F.when(F.length(x) % 3 == 0, F.lit("\n")).otherwise(F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("text"))


_MARKED = "(SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: (['', '# ', '  - ', '1. ', chr(9) || '* ', '    ', '## '])[length(x) % 7 + 1] || x || CASE WHEN length(x) % 3 = 0 THEN chr(10) ELSE '' END) AS l FROM documents)"
_MLINES = f"(SELECT doc_id, unnest(m) AS line, unnest(range(len(m)))::INTEGER AS pos FROM (SELECT doc_id, string_split(array_to_string(l, chr(10)), chr(10)) AS m FROM {_MARKED}))"


@query("structure_blocks", rf"""SELECT doc_id, pos, kind, level, marker, indent_level, gap_section FROM (SELECT doc_id, pos, {_KIND} AS kind, CASE WHEN {_KIND} = 'heading' THEN length(regexp_extract(line, '^[ \t]*(#{{1,3}})', 1)) ELSE 1 END::INTEGER AS level, CASE WHEN {_KIND} = 'numbered' THEN regexp_extract(line, '^[ \t]*([0-9]+)', 1) ELSE '' END AS marker,
 (length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '  ')) // 2)::INTEGER AS indent_level, coalesce(lag({_KIND} = 'blank') OVER (PARTITION BY doc_id ORDER BY pos), false) AS gap_section FROM {_MLINES}) WHERE kind <> 'blank'""")
def _blocks(spark, sf_dir):
    return structure.blocks(_marked(spark, sf_dir)).drop("text")


@query("structure_detect", f"SELECT doc_id, bool_or({_KIND} IN ('heading', 'numbered', 'bullet')) AS structured FROM {_LINES} GROUP BY doc_id")
def _detect(spark, sf_dir):
    return structure.is_structured(docs(spark, sf_dir))


@query("structure_rebuilt")
def _rebuilt(spark, sf_dir):
    return structure.rebuilt(_marked(spark, sf_dir))


@query("paragraph_first", rf"SELECT doc_id, pos, first FROM (SELECT doc_id, pos, line, coalesce(lag(regexp_full_match(line, '[ \t]*')) OVER (PARTITION BY doc_id ORDER BY pos), true) AS first FROM {_MLINES}) WHERE NOT regexp_full_match(line, '[ \t]*')")
def _first(spark, sf_dir):
    return structure.paragraph_first(_marked(spark, sf_dir))


@query("indent_tree", rf"""WITH l AS (SELECT doc_id, pos, length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '    '))::INTEGER AS width FROM {_MLINES} WHERE NOT regexp_full_match(line, '[ \t]*'))
 SELECT c.doc_id, c.pos, c.width, max(p.pos)::INTEGER AS parent FROM l c LEFT JOIN l p ON p.doc_id = c.doc_id AND p.pos < c.pos AND p.width < c.width GROUP BY 1, 2, 3""")
def _tree(spark, sf_dir):
    return structure.indent_tree(_marked(spark, sf_dir)).drop("label")


_ALPHA = "(['" + "', '".join(structure.ALPHABET) + "'])"


@query("alphabet_coverage", f"SELECT doc_id, array_to_string(m, '') AS missing, round((27 - len(m))::DOUBLE / 27, 4) AS coverage FROM (SELECT doc_id, list_filter({_ALPHA}, lambda c: NOT contains(lower(coalesce(text, '')), c)) AS m FROM documents)")
def _alphabet(spark, sf_dir):
    return structure.alphabet_missing(docs(spark, sf_dir))


@query("text_coverage", """SELECT doc_id, a AS n_covered, b AS n_downgraded, n - a - b AS n_missing, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE round((a + b)::DOUBLE / n, 4) END AS ratio FROM (
 SELECT doc_id, len(c)::INTEGER AS n, len(list_filter(c, lambda x: contains('abcdefghijklmnopqrstuvwxyz.,', x)))::INTEGER AS a,
 len(list_filter(c, lambda x: NOT contains('abcdefghijklmnopqrstuvwxyz.,', x) AND (contains('abcdefghijklmnopqrstuvwxyz.,', lower(x)) OR contains('abcdefghijklmnopqrstuvwxyz.,', upper(x)))))::INTEGER AS b
 FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda x: NOT regexp_full_match(x, '[ \\t\\n\\x0b\\f\\r]'))) AS c FROM documents))""")
def _coverage(spark, sf_dir):
    return structure.text_coverage(docs(spark, sf_dir), "abcdefghijklmnopqrstuvwxyz.,")


@query("dedupe_terms", f"""SELECT doc_id, rank, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INTEGER AS rank FROM (SELECT doc_id, ord, term, row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY ord) AS seen
 FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS ord FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents))) WHERE seen = 1) WHERE rank <= 15""")
def _dedupe(spark, sf_dir):
    return study.distinct_terms(docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0)).alias("ord", "term")))


@query("char_order", f"SELECT DISTINCT c AS char, CASE WHEN contains('{structure.ALPHABET}', lower(c)) THEN 0 WHEN regexp_full_match(c, '[0-9]') THEN 1 ELSE 2 END::INTEGER AS kind FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents)")
def _chars(spark, sf_dir):
    return structure.char_order(structure.characters(docs(spark, sf_dir))).select("char", "kind")


@query("charset_description", "SELECT doc_id, 'tuya:' || concat_ws('+', CASE WHEN regexp_matches(text, '[a-zñ]') THEN 'min' END, CASE WHEN regexp_matches(text, '[A-ZÑ]') THEN 'MAY' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'díg' END, CASE WHEN regexp_matches(text, '[.,;:!¡?¿()\"''-]') THEN 'punt' END, CASE WHEN regexp_matches(text, '[áéíóúÁÉÍÓÚ]') THEN 'acent' END) || '×' || (doc_id % 4) AS kinds FROM documents WHERE regexp_matches(text, '[a-zA-Z]')")
def _charset(spark, sf_dir):
    return docs(spark, sf_dir).where(F.col("text").rlike("[a-zA-Z]")).select("doc_id", tx.describe_charset(F.col("text"), F.col("doc_id") % 4).alias("kinds"))


@query("slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("natural_sort", "SELECT p_partkey, p_brand || '-' || p_size AS name, 'brand#' || lpad(substr(p_brand, 7), 20, '0') || '-' || lpad(p_size::VARCHAR, 20, '0') AS key FROM part")
def _natural(spark, sf_dir):
    name = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), tx.natural_key(name).alias("key")).orderBy("key")
