"""Operators on small literal inputs with known results."""

import json
import math
import random
import time
from collections import Counter

import granary.plans  # noqa: F401
import numpy as np
import pandas as pd
import pytest
from granary.functions import grades, tolerant
from granary.functions import text as tx
from granary.functions.boxes import iou
from granary.operators import blocks, fingerprints, fusion, integrity, layout, ledger, ranking, records, store, structure, study
from granary.registry import QUERIES
from granary.sources import files, sinks
from granary.streaming import telemetry
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values), strict=True))).select(column).first()[0]


def values(spark, column, inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, v {kind}").orderBy("i").select(column).collect()]


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    global V  # noqa: PLW0603  a column can only be made while a session runs
    V = F.col("v")


def test_payments_by_month(spark):
    rows = [("1", "100.0", "15/01/2026"), ("2", "50.0", "20/01/2026"), ("3", "200.0", "05/02/2026"), ("4", "10", "not-a-date"), ("5", None, "2026-01-15"), ("6", "", "2026-01-15T10:30:00"), ("7", "abc", "1/2/2026")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, amount string, date string, ord int")
    assert ledger.total_income(df).first()[0] == 360.0
    assert {(r.year, r.month): r.income for r in ledger.monthly_income(df).collect()} == {(2026, 1): 150.0, (2026, 2): 200.0}
    assert ledger.monthly_income(df, 2026, 3).first().income == 0.0
    assert [r.id for r in ledger.payments_sorted(df).collect()][-1] == "4"
    assert ledger.total_income(df.limit(0)).first()[0] == 0.0


def test_tolerant_numbers_and_dates(spark):
    assert values(spark, tolerant.safe_int(V), ["0", "-5", "", None, "tres", "  ", "3.0", " 7 ", "2.9", "3000000000"]) == [1, 1, 1, 1, 1, 1, 3, 7, 2, 3_000_000_000]
    assert values(spark, tolerant.safe_amount(V), [None, "", "abc", "1.5", " 2 "]) == [0.0, 0.0, 0.0, 1.5, 2.0]
    assert [d and d.isoformat() for d in values(spark, tolerant.parse_date(V), ["5/1/2026", "2026-01-15", "2026-01-15T10:30:00", "31/02/2026", "x", None])] == ["2026-01-05T00:00:00", "2026-01-15T00:00:00", "2026-01-15T10:30:00", None, None, None]
    assert values(spark, tolerant.price(V, F.lit("Normal"), F.lit("Apunte")), ["1", "x"]) == [50.75, 50.75]
    assert values(spark, tolerant.price(V, F.lit("Urgente"), F.lit("?")), ["10"]) == [862.5]


def test_jobs(spark):
    df = spark.createDataFrame([("En Progreso", "10", 0, "?"), ("Aceptado", "5", 1, "2026-01-01"), ("Pagado", "7", 2, "2025-01-01"), (None, "1", 3, None)], "status string, price_mxn string, ord int, created_at string")
    assert ledger.active_count(df).first()[0] == 2
    assert ledger.pending_value(df).first()[0] == 16.0
    assert [r.ord for r in ledger.jobs_sorted(df).collect()] == [0, 3, 2, 1]
    assert sum(r.degrees for r in ledger.status_share(df).collect()) == 360.0


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert sorted(map(tuple, ledger.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string")).collect())) == [(1, "a"), (2, "c")]
    assert [r.id for r in ledger.delete(base, spark.createDataFrame([(1,)], "id int")).collect()] == [2]


def test_grades(spark):
    g = lambda e, a, k: spark.range(1).select(tx.grade(F.lit(e), F.lit(a), F.array(*map(F.lit, k)).cast("array<string>"))).first()[0]
    assert g("la casa azul", "la casa azul", []) == 70
    assert g("la casa azul", "La CASA azul", ["casa", "azul"]) == 100
    assert g("", "algo", ["x"]) == 0 and g(None, "x", []) == 0
    assert 0 < g("la casa azul", "la casa roja", ["azul"]) < 100


def test_study_material(spark):
    text = "La célula es la unidad básica de la vida. El núcleo: parte central de la célula. Se llama tejido al conjunto de células iguales. Nada. La energía significa capacidad de trabajo útil."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "corto")], "doc_id long, text string")
    cards = {r.topic: r.answer for r in study.definition_cards(docs).collect()}
    assert cards == {"La célula": "la unidad básica de la vida.", "El núcleo": "parte central de la célula.", "tejido": "conjunto de células iguales.", "La energía": "capacidad de trabajo útil."}
    got = {r.doc_id: r.summary for r in study.summaries(docs).collect()}
    assert got[2] == got[3] == "" and got[4] == "corto" and got[1].startswith("La célula es")
    assert [r.word for r in study.key_terms(docs).where("doc_id = 1").orderBy("rank").collect()][:1] == ["celula"]
    quiz = study.cloze(spark.createDataFrame([(1, "Energia potencia energia y trabajo dependen siempre de potencia total.")], "doc_id long, text string")).first()
    assert quiz.question.startswith("___ ___ energia") and quiz.keywords[:2] == ["energia", "potencia"]
    assert study.bundles(docs).count() == 4
    few = study.flashcards(spark.createDataFrame([(1, "palabra sola en un texto largo con otra palabra")], "doc_id long, text string")).collect()
    assert few[0].question == "¿Qué se dice sobre 'palabra'?" and few[0].answer.startswith("palabra sola")


def test_block_bundles(spark):
    rows = [(1, 0, "heading", "Fotosíntesis"), (1, 1, "list_item", "Proceso por el que las plantas producen savia, y la savia queda en las plantas verdes."), (1, 2, "heading", "Vacío"), (1, 3, "heading", "Raíz"), (1, 4, "paragraph", ""),
            (2, 0, "paragraph", ""), (3, 0, "heading", "PLANTAS"), (3, 1, "heading", "plantas")]
    got = {r.doc_id: r for r in study.block_bundles(spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string")).collect()}
    assert got[1].cards[0].question == "¿Qué es Fotosíntesis?" and got[1].cards[0].answer.startswith("Proceso por")
    assert got[1].terms[:3] == ["Fotosíntesis", "Vacío", "Raíz"] and "Raíz" not in [c.topic for c in got[1].cards]
    assert got[1].quiz[0].question.count("___") == 2 and got[1].summary.startswith("Fotosíntesis")
    assert (got[2].summary, got[2].terms, got[2].cards, got[2].quiz) == ("", [], [], []) and got[3].terms == ["PLANTAS"]
    heads = blocks.heading_answers(spark.createDataFrame(rows, "doc_id long, pos int, kind string, text string")).collect()
    assert [(r.doc_id, r.heading) for r in heads] == [(1, "Fotosíntesis")]


def test_fuses(spark):
    rows = [("a", None, True)] * 3 + [("b", "LOW_RANK", False), ("b", None, True), ("c", "GHOST", True)]
    got = store.fuses(spark.createDataFrame(rows, "char string, reason string, alive boolean")).first()
    assert (got.kill_rate, got.recapture_rate, got.blown) == (round(1 / 6, 6), round(2 / 3, 6), True)
    fine = store.fuses(spark.createDataFrame(rows[:3], "char string, reason string, alive boolean")).first()
    assert (fine.kill_rate, fine.recapture_rate, fine.blown) == (0, 0, False)


def test_paragraph_starts_and_best_medoid(spark):
    tops = {"a": [0, 10, 20, 45, 55], "b": [0, 10, 40], "c": [0, 30], "d": [5], "e": [3, 3, 3, 9]}
    rows = spark.createDataFrame([(k, i, float(y)) for k, ys in tops.items() for i, y in enumerate(ys)], "k string, i int, y double")
    got = {(r.k, r.i) for r in layout.paragraph_starts(rows, "k", "i", "y").where("starts").collect()}
    assert got == {("a", 0), ("a", 3), ("b", 0), ("b", 2), ("c", 0), ("d", 0), ("e", 0)}
    marks = [(1, "x", "0011", "Gold"), (2, "x", "1100", "Silver"), (3, "x", "1100", "Silver"), (4, "y", "0011", "Silver"), (5, "y", "0001", "Silver"), (6, "y", "0111", "Silver"), (7, "z", "01", "Bronze"), (8, "z", "01", None)]
    best = fingerprints.best_medoids(spark.createDataFrame(marks, "id long, key string, bits string, tier string")).collect()
    assert {(r.key, r.medoid) for r in best} == {("x", 1), ("y", 4), ("z", 7)}


def test_clean_up(spark):
    raw = ["“a” — b…", "a b﻿", "uno\ndos", "a\n\n\n\nb", "ad-\nministra", "x\n- y\n2. z", "a\r\nb", "  a  \t b ", None, "mañana", "a\n \n\n- b", "a\n-\nb", "a\n  \n* b"]
    assert values(spark, tx.clean(V), raw) == ['"a" - b...', "a b", "uno dos", "a\n\nb", "administra", "x\n\n- y\n\n2. z", "a b", "a b", "", "mañana", "a\n\n- b", "a\n\nb", "a\n\n\n\n* b"]


def test_wrappers(spark):
    assert values(spark, tx.strip_wrapper(V), ['"hola"', "Aquí está:\nhola\nmás", "Texto propio:\nhola", "«a»", "''", "Claro:\n\nTexto", " “ Claro: \t\r\n\n\tTexto \n” "]) == ["hola", "hola\nmás", "Texto propio:\nhola", "a", "''", "Texto", "Texto"]
    guard = spark.createDataFrame([("x" * 10, "y" * 3), ("x" * 10, "y" * 4), ("x", "")], "a string, b string").select(tx.guarded(F.col("a"), F.col("b")))
    assert [r[0] for r in guard.collect()] == ["x" * 10, "y" * 4, "x"]
    diff = spark.createDataFrame([("a b c", "a x c"), ("a", "a b")], "a string, b string").select(tx.word_changes(F.col("a"), F.col("b")))
    assert [[tuple(x) for x in r[0]] if r[0] is not None else None for r in diff.collect()] == [[(1, "b", "x")], None]


def test_structure(spark):
    text = "# T\n## S\n1: a\n2) b\n- c\n* d\n• e\n  - f\n\t- g\n\n3:30 x\n1.5 l\n-5\n#tag"
    got = structure.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.kind, r.text, r.level, r.marker, r.indent_level, r.gap_section) for r in got] == [
        ("heading", "T", 1, "", 0, False), ("heading", "S", 2, "", 0, False), ("numbered", "a", 1, "1", 0, False), ("numbered", "b", 1, "2", 0, False), ("bullet", "c", 1, "", 0, False),
        ("bullet", "d", 1, "", 0, False), ("bullet", "e", 1, "", 0, False), ("bullet", "f", 1, "", 1, False), ("bullet", "g", 1, "", 1, False),
        ("paragraph", "3:30 x", 1, "", 0, True), ("paragraph", "1.5 l", 1, "", 0, False), ("paragraph", "-5", 1, "", 0, False), ("paragraph", "#tag", 1, "", 0, False),
    ]
    tree = structure.indent_tree(spark.createDataFrame([(1, "a\n  b\n      c\n    d\n\n- e\n\tf")], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.label, r.parent) for r in tree] == [("a", None), ("b", 0), ("c", 1), ("d", 1), ("e", None), ("f", 5)]


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "ABC abc"), (2, ""), (3, None), (4, "ñÑ 7")], "doc_id long, text string")
    missing = {r.doc_id: (r.missing, r.coverage) for r in structure.alphabet_missing(docs, "abcñ").collect()}
    assert missing == {1: ("ñ", 0.75), 2: ("abcñ", 0.0), 3: ("abcñ", 0.0), 4: ("abc", 0.25)}
    cover = {r.doc_id: tuple(r)[1:] for r in structure.text_coverage(docs, "abcn").collect()}
    assert cover[1] == (3, 3, 0, 1.0) and cover[2] == (0, 0, 0, 1.0) and cover[4] == (0, 0, 3, 0.0)
    chars = spark.createDataFrame([(c,) for c in "z9ñ!nAa"], "char string")
    assert "".join(r.char for r in structure.char_order(chars).collect()) == "aAnñz9!"


def test_blocks(spark):
    rows = [(1, p, "x" * n) for p, n in enumerate([50] * 4 + [49])] + [(2, p, "y " * n) for p, n in enumerate([50, 1, 1, 1, 1])] + [(3, 0, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    assert {r.doc_id: r.kind for r in blocks.page_class(pages).collect()} == {1: "text", 2: "mixed", 3: "scan"}
    b = [("heading", "H"), ("paragraph", "p"), ("heading", "I"), ("heading", "J"), ("list_item", "l"), ("paragraph", "q"), ("heading", "x" * 121), ("paragraph", "r"), ("heading", "K"), *[("table", "t")] * 4, ("paragraph", "far")]
    got = blocks.heading_answers(spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(b)], "doc_id long, pos int, kind string, text string")).collect()
    assert sorted((r.heading, r.answer) for r in got) == [("H", "p"), ("J", "l")]


def test_markup_blocks_keep_inline_text(spark):
    html = "<h2 id=a>One <i>two</i></h2><p><b>For</b> more<br>here <a href='x'>now</a>.</p>tail<ul><li><a>x</a><li>y <em>z</em></ul>rest<p>" + "long <b>w</b> " * 20000 + "<div>out</div>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>1 < 2 <!-- <b>no --> <code>k</code>")], "page_id long, html string")
    got = [tuple(r) for r in blocks.markup_blocks(pages).orderBy("doc_id", "pos").collect()]
    assert got == [
        (1, 0, "heading", 2, "One two"), (1, 1, "paragraph", 0, "For more here now."), (1, 2, "list_item", 0, "x"), (1, 3, "list_item", 0, "y z"), (1, 4, "paragraph", 0, ("long w " * 20000).strip()),
        (3, 0, "paragraph", 0, "1 < 2  k"),
    ]
    assert [tuple(r)[2:] for r in blocks.heading_answers(blocks.markup_blocks(pages)).collect()] == [("One two", "For more here now.")]


def test_boxes(spark):
    v = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 10, 10), (0, 0, 10, 10, 0, 0, 10, 10), (0, 0, 1, 1, 9, 9, 1, 1)], "a int, b int, c int, d int, e int, f int, g int, h int")
    assert [r[0] for r in v.select(iou(*map(F.col, "abcdefgh"))).collect()] == [25 / 175, 1.0, 0.0]
    box = "image_id long, detector string, ord long, x long, y long, w long, h long"
    alone = fusion.fuse_greedy(spark.createDataFrame([(1, "a", 0, 0, 0, 10, 10), (1, "a", 1, 20, 0, 10, 10)], box), 0.3).collect()
    assert [r.agreement for r in alone] == [1.0, 1.0]
    one = spark.createDataFrame([(1, "a", 0, 0, 0, 10, 10), (2, "b", 0, 0, 0, 10, 10), (2, "a", 0, 0, 0, 10, 10)], box)
    assert [(r.image_id, r.agreement) for r in fusion.fuse_greedy(one, 0.3, quorum=True, detectors=3).collect()] == [(2, 2 / 3)]  # one of three is no quorum
    both = fusion.fuse_greedy(spark.createDataFrame([(1, "a", 0, 0, 0, 10, 10), (1, "b", 0, 1, 1, 10, 10), (1, "b", 1, 90, 90, 5, 5)], box), 0.3).collect()
    assert sorted((r.sources, r.agreement, r.w) for r in both) == [("a,b", 1.0, 11), ("b", 0.5, 5)]
    assert [r.sources for r in fusion.fuse_greedy(spark.createDataFrame([(1, d, 0, 0, 0, 10, 10) for d in "ab"] + [(1, "c", 0, 50, 50, 9, 9)], box), 0.3, quorum=True).collect()] == ["a,b"]


def test_regions_and_gaps(spark):
    kind = "image_id long, id long, x long, y long, w long, h long"
    b = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 50, 50, 10, 10), (2, 3, 50, 50, 10, 10)], kind)
    r = spark.createDataFrame([(1, 9, 0, 0, 20, 5), (2, 9, 0, 0, 5, 5)], kind)
    assert sorted(x.id for x in fusion.in_regions(b, r).collect()) == [1, 3]
    p = spark.createDataFrame([(1, 7, 0, 0, 10, 4)], kind)
    assert sorted(x.id for x in fusion.fill_gaps(p, b).collect()) == [2, 3, 7]
    m = fusion.match_greedy(spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 4, 0, 10, 10)], kind), spark.createDataFrame([(1, 5, 4, 0, 10, 10), (1, 6, 0, 0, 10, 10)], kind)).collect()
    assert sorted((x.a, x.b, x.iou) for x in m) == [(1, 6, 1.0), (2, 5, 1.0)]


def test_matches_equal_all_pairs_sorted(spark, monkeypatch):
    monkeypatch.setattr(fusion, "CANDIDATES", 500)  # bands are narrowed and candidates come in parts
    rng = random.Random(5)
    kind = "image_id long, id string, x long, y long, w long, h long"
    box = lambda i, k: (i, str(rng.randrange(10**6)), rng.randrange(40), rng.randrange(30), rng.choice([4, 7, 12]), rng.choice([5, 9]))[:k]
    sides = [[box(i, 6) for i in (1, 2) for _ in range(120)] for _ in range(2)]
    for rows in sides:
        rows += [(3, f"{n:03}", 5, 5, 10, 10) for n in range(150)] + [(3, f"{n:03}", 6, 5, 10, 10) for n in range(150, 190)] + rows[:9] + [(1, rows[0][1], 9, 9, 12, 9), (4 + len(sides[0]) % 2, "z", 0, 0, 9, 9), (None, "n", 0, 0, 9, 9), (1, "v", 0, None, 9, 9)]

    def overlap(a, b):
        both = max(min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), 0) * max(min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]), 0)
        return both / (a[4] * a[5] + b[4] * b[5] - both)

    left, right = ([x for x in rows if None not in x] for rows in sides)
    want, used = [], set()
    for v, i, a, b in sorted((-overlap(a, b), a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0]):
        if -v >= 0.2 and not {(i, "a", a), (i, "b", b)} & used:
            used |= {(i, "a", a), (i, "b", b)}
            want.append((i, a, b, -v))
    found = fusion.match_greedy(*(spark.createDataFrame(rows, kind) for rows in sides), 0.2)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # pairs are not rows of the cluster


def test_fused_boxes_equal_all_groups_compared(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2]), rng.choice("ab"), k, rng.randrange(-60, 150), rng.randrange(90), rng.choice([8, 20, 45]), rng.choice([9, 25])) for k in range(500)]
    want = []
    for image in (1, 2):
        groups = []
        for _, d, _, x, y, w, h in sorted(r for r in rows if r[0] == image):
            for g in groups:
                both = max(min(x + w, g[2]) - max(x, g[0]), 0) * max(min(y + h, g[3]) - max(y, g[1]), 0)
                if both / (w * h + (g[2] - g[0]) * (g[3] - g[1]) - both) >= 0.3:
                    g[:] = [min(g[0], x), min(g[1], y), max(g[2], x + w), max(g[3], y + h), g[4] | {d}]
                    break
            else:
                groups.append([x, y, x + w, y + h, {d}])
        want += [(image, g[0], g[1], g[2] - g[0], g[3] - g[1], ",".join(sorted(g[4])), len(g[4]) / 2) for g in groups]
    found = fusion.fuse_greedy(spark.createDataFrame(rows, "image_id long, detector string, ord long, x long, y long, w long, h long"), 0.3)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_fusing_does_not_compare_all_groups():
    class Boxes:  # hands back the function that Spark would run for an image
        groupBy = lambda self, *_: self  # noqa: E731, N815
        applyInPandas = lambda self, run, schema: run  # noqa: E731, N815

    n = 12000
    far = pd.DataFrame({"image_id": 1, "detector": "a", "ord": range(n), "x": [10.0 * k for k in range(n)], "y": 0, "w": 5, "h": 5})
    far.loc[7, "x"] = None
    start = time.process_time()
    assert len(fusion.fuse_greedy(Boxes(), 0.3, detectors=3)(far)) == n
    assert time.process_time() - start < 5


def test_evaluation_query_shuffles_ids_once(spark):
    plan = QUERIES["eval_metrics"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "first(" not in plan  # neither pairs nor the boxes of copies


@pytest.mark.parametrize(
    ("strategy", "votes", "want"),
    [
        ("majority", [("x", 0.9), ("x", 0.8), ("y", 0.95)], ("x", 0.85, True)), ("majority", [("a", 0.5), ("b", 0.9)], ("b", 0.9, True)),
        ("highest", [("x", 0.3), ("z", 0.95), ("x", 0.7)], ("z", 0.95, False)), ("consensus", [("x", 0.4), ("y", 0.8)], ("?", 0.3, False)),
        ("consensus", [("x", 0.4), ("x", 0.8)], ("x", 0.6, True)), ("majority", [("", 0.5)], ("?", 0.5, True)),
    ],
)
def test_votes(spark, strategy, votes, want):
    df = spark.createDataFrame([(1, i, c, p) for i, (c, p) in enumerate(votes)], "item_id long, ord int, char string, conf double")
    r = fusion.vote(df, strategy).first()
    assert (r.char, r.conf, r.consensus) == want


def test_alignment(spark):
    chars = spark.createDataFrame([(1, i, c, 1.0) for i, c in enumerate("abc")], "line_id long, char_ord int, char string, width double")
    box = "line_id long, box_ord int, width_norm double, pred_char string, conf double"
    run = lambda seen: sorted((r.box_ord, r.char_ord) for r in fusion.align(spark.createDataFrame([(1, i, 1.0, c, 0.9) for i, c in enumerate(seen)], box), chars).collect())
    assert run("abc") == [(0, 0), (1, 1), (2, 2)]
    assert run("xabc") == [(1, 0), (2, 1), (3, 2)]
    assert run("ac") == [(0, 0), (1, 2)]
    assert fusion.align(spark.createDataFrame([], box), chars).count() == 0


def brute_alignment(wide, pred, conf, chars, widths):
    cost, step = {(0, 0): 0.0}, {}
    for i in range(len(wide) + 1):
        for j in range(len(chars) + 1):
            if not i or not j:
                cost[i, j] = (i + j) * fusion.GAP
                continue
            own, p = abs(wide[i - 1] - widths[j - 1]), pred[i - 1].strip()[:1].lower()
            if p and p == chars[j - 1].strip()[:1].lower():
                own -= fusion.BONUS * conf[i - 1]
            elif p.isalnum():
                own += fusion.MISMATCH
            cost[i, j], step[i, j] = min((cost[i - 1, j - 1] + own, 0), (cost[i - 1, j] + fusion.GAP, 1), (cost[i, j - 1] + fusion.GAP, 2))
    out, i, j = [], len(wide), len(chars)
    while i and j:
        way = step[i, j]
        if way == 0:
            out.append((i - 1, j - 1))
        i, j = i - (way != 2), j - (way != 1)
    return out


@pytest.mark.parametrize("cells", [1 << 25, 0])
def test_paths_equal_brute_force(monkeypatch, cells):
    monkeypatch.setattr(fusion, "CELLS", cells)
    rng = random.Random(3)
    for n, m in [(1, 1), (1, 7), (9, 2), (30, 41), (55, 50), (80, 3)] * 5:
        pred, chars = rng.choices("abB -é", k=n), rng.choices("abcB é", k=m)
        line = (rng.choices([0.5, 1.0, 1.4], k=n), pred, rng.choices([0.8, 0.3], k=n), chars, rng.choices([0.5, 1.0, 1.4], k=m))
        assert fusion._best_path(*line) == brute_alignment(*line)


def test_boxes_of_a_line_itself_equal_brute_force(monkeypatch):
    rng = random.Random(6)
    taken = []
    monkeypatch.setattr(fusion, "_subsequence", lambda *a, f=fusion._subsequence: taken.append(f(*a)) or taken[-1])
    for alphabet, m in [("a", 30), ("ab", 50), ("aA b\n\t", 60), ("abİéÉ.- \n", 70), ("\n ", 30), ("thble ", 90)] * 12:
        chars = [c for _ in range(m) for c in rng.choice([*alphabet, alphabet])][:m]
        widths = [0.5 if c in "alt" else 1.4 if c == "\n" and rng.random() < 0.5 else 1.0 for c in chars]
        at = [i for i, c in enumerate(chars) if c != " " and rng.random() < rng.choice([0.6, 0.9])] or [0]
        confs = rng.choices([0.8, 0.3, 0.45], k=len(at)) if rng.random() < 0.3 else [0.8] * len(at)
        line = ([widths[i] for i in at], [chars[i] for i in at], confs, chars, widths)
        assert fusion._best_path(*line) == brute_alignment(*line)
    assert len(taken) == 72 and all(x is not None for x in taken)


def test_a_long_line_takes_time_in_proportion():
    rng = random.Random(7)
    chars = rng.choices(["th", "ble", "e", "er", " ", "é"], k=12000)
    chars = [*"".join(chars)]
    at = [i for i, c in enumerate(chars) if c != " " and i % 9 != 4]
    start = time.process_time()
    path = fusion._best_path([1.0] * len(at), [chars[i] for i in at], [0.8] * len(at), chars, [1.0] * len(chars))
    assert time.process_time() - start < 2 and len(path) == len(at) and all(chars[at[b]] == chars[c] for b, c in path)


def test_aligned_texts_equal_aligned_rows(spark, monkeypatch):
    rng = random.Random(9)
    texts = [None, "", " ", "thth bleble", "\n\n a \n", *("".join(rng.choices(["th", "ble", "e", "er", " ", "É", "é", "\n", ".", "mm", "😀"], k=k)) for k in (1, 5, 40, 40, 90))]
    size = lambda c: 0.5 if c in "ilt" else 1.4 if c in "mw" else 1.0
    want = []
    for k, t in enumerate(texts):
        at = [i for i, c in enumerate(t or "") if c != " " and i % 9 != 4]
        line = [size(t[i]) for i in at], [t[i] for i in at], [0.8] * len(at), [*(t or "")], [*map(size, t or "")]
        want += [(k, at[b], c) for b, c in brute_alignment(*line)] * 2
    rows = spark.createDataFrame([*enumerate(texts)] * 2, "k int, text string").repartition(3)
    for most in (1 << 20, 50):
        monkeypatch.setattr(fusion, "TEXTS", most)
        got = fusion.align_texts(rows, "text", lambda codes, places: ((codes != 32) & (places % 9 != 4), np.array([size(chr(c)) for c in codes], float)))
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_alignment_query_reads_all_turns_and_whole_texts(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, 0, text), (1, 3, text), (2, 1, "abc"), (2, 1, "abc"), (3, 0, None), (None, None, "abc")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter(map(tuple, QUERIES["nw_align"].run(spark, str(tmp_path)).collect()))
    seen = [(i, i) for i, c in enumerate(text) if c != " " and i % 9 != 4]
    want = Counter((1, turn, *p) for turn in (0, 3) for p in seen)
    want.update([(2, 1, i, i) for i in range(3)] * 2 + [(None, None, i, i) for i in range(3)])
    assert got == want


def prints(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, bits string")


def test_fingerprints(spark):
    z = "0" * 63 + "1"
    group = [z, "0" * 62 + "11", "0" * 61 + "111", "1" + "0" * 62 + "1", "1" * 60 + "0001"]
    rows = [(i, "a", b) for i, b in enumerate(group)] + [(10 + i, "b", b) for i, b in enumerate([*group[:2], group[4]])] + [(20, "c", ""), (21, "c", "0" * 64), (22, "c", "1" * 64)]
    out = {r.id: r.outlier for r in fingerprints.outliers(prints(spark, rows).where("bits <> ''")).collect()}
    assert out[4] and sum(out.values()) == 1
    assert {r.key: r.medoid for r in fingerprints.medoids(prints(spark, rows)).collect()}["a"] == 0
    pairs = {(r.a, r.b): r.dist for r in fingerprints.pairs_of_rows(prints(spark, rows), 2).collect()}
    assert pairs == {(0, 1): 1, (0, 2): 2, (1, 2): 1, (0, 3): 1, (1, 3): 2, (10, 11): 1}
    tied = spark.createDataFrame([("01", "0111"), ("", "111"), ("1010", "1010")], "a string, b string").select(fingerprints.hamming(F.col("a"), F.col("b")))
    assert [r[0] for r in tied.collect()] == [2, 3, 0]
    clusters = {r.id: r.cluster for r in fingerprints.clusters(prints(spark, [*rows, (30, "a", group[4]), (31, "a", z)]), 1).collect()}
    assert [clusters[i] for i in (0, 1, 2, 3, 4, 30, 31, 20, 21)] == [0, 0, 0, 0, 4, 4, 0, 20, 21]
    new = fingerprints.insert_new(prints(spark, rows[:2]).withColumn("index", F.lit(3)), prints(spark, [(50, "a", group[2]), (51, "a", group[4]), (52, "a", group[4]), (53, "n", z)]), 2)
    assert sorted((r.id, r["index"]) for r in new.collect()) == [(51, 4), (53, 0)]
    row = ["0" * 7 + "1" * (i + 1) + "0" * (8 - i) for i in range(6)]  # neighbours differ in one bit
    batch = fingerprints.insert_new(prints(spark, []).withColumn("index", F.lit(3)), prints(spark, [*((i, "a", b) for i, b in enumerate(row)), (8, "a", "0" * 16), (9, "a", "0" * 16)]), 1)
    assert sorted((r.id, r["index"]) for r in batch.collect()) == [(0, 0), (2, 1), (4, 2), (8, 3), (9, 4)]


def test_vector_bits(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 2.0],)], "e array<float>")
    assert df.select(fingerprints.dhash(F.col("e")), fingerprints.ahash(F.col("e"))).first()[:] == ("100", "0100")


def shapes(spark, rows):
    return spark.createDataFrame(rows, "id long, char string, w int, h int, area int, ink double, aspect double, edge double, parts int, score double")


def test_hard_filters(spark):
    good = lambda i, char="a", **k: tuple(({"id": i, "char": char, "w": 20, "h": 20, "area": 400, "ink": 0.2, "aspect": 1.0, "edge": 0.0, "parts": 1, "score": 80.0} | k).values())
    rows = [good(i) for i in range(6)]
    rows += [good(10, w=4), good(11, ink=0.01), good(12, ink=0.7), good(13, edge=0.4), good(14, parts=3), good(15, aspect=3.0), good(16, area=1700)]
    got = {r.id: r.reason for r in store.hard_filtered(shapes(spark, rows)).collect()}
    assert [got[i] for i in (0, 10, 11, 12, 13, 14, 15, 16)] == [None, "SPECK", "GHOST", "BLOB", "CLIPPED", "FRAGMENTED", "OUTLIER_SHAPE", "OUTLIER_SHAPE"]
    few = {r.id: r.reason for r in store.hard_filtered(shapes(spark, [good(1, "z"), good(2, "z", ink=0.6), good(3, "z", area=9)])).collect()}
    assert few == {1: None, 2: "BLOB", 3: None}


def test_purge_keeps_survivors_and_ends(spark):
    rows = [(i, "a", 20, 20, 400, 0.2, 1.0, 0.0, 1, 60.0 + i) for i in range(35)] + [(100 + i, "b", 20, 20, 400, 0.2, 1.0, 0.0, 1, 10.0) for i in range(2)]
    got = store.purge(shapes(spark, rows)).collect()
    alive = [r.id for r in got if r.alive]
    assert len([i for i in alive if i < 100]) == 30 and [i for i in alive if i >= 100] == [100, 101]
    assert store.fuses(spark.createDataFrame([("a", None, True)] * 3 + [("a", "LOW_RANK", False)], "char string, reason string, alive boolean")).first().blown is False


@pytest.mark.parametrize(("passes", "least"), [(20, 3), (20, 25), (3, 3), (1, 3), (0, 3)])
def test_purge_counts_equal_a_purge(spark, passes, least):
    rng = random.Random(8)
    some = lambda x: None if rng.random() < 0.04 else x
    spread = {"a": 1.2, "b": 0.9, "c": 0.6, "d": 0.3, "e": 1.5, None: 1.0}
    rows = []
    for i in range(700):
        char = rng.choice([*"aaabbcd", None]) if i > 6 else "e"
        w, h = (max(1, int(24 * math.exp(rng.gauss(0, spread[char])))) for _ in "wh")
        rows.append((i, char, some(w), h, w * h, some(0.2 * math.exp(rng.gauss(0, 0.9))), some(w / h), some(rng.random() * 0.32), some(rng.choice([1, 1, 2, 2, 3, 4])), some(float(rng.randrange(40, 100)))))
    df = shapes(spark, rows)
    want = store.fuses(store.purge(df, passes=passes, least=least), least=least).first()
    got = store.purge_counts(df, passes=passes, least=least)
    assert store.blown(got, least).first() == want
    full = Counter((r.char, r.alive, r.reason is None) for r in store.purge(df, passes=passes, least=least).collect())
    assert {r.char: (r.n, r.killed, r.kept) for r in got.collect()} == {
        c: (sum(k for x, k in full.items() if x[0] == c), sum(k for x, k in full.items() if x[0] == c and not x[1]), sum(k for x, k in full.items() if x[0] == c and x[2])) for c in spread
    }
    if passes == 20:  # later passes do kill
        assert sum(r.kept for r in got.collect()) < sum(r.kept for r in store.purge_counts(df, passes=1).collect())


def test_purge_fuses_reads_items_once(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", None)  # a plan that is written before the result is read shuffles them again
    row = QUERIES["purge_fuses"].run(spark, "/root/testdata/sf0.001").first()
    monkeypatch.undo()
    assert row == store.fuses(QUERIES["purge_fixpoint"].run(spark, "/root/testdata/sf0.001")).first()


@pytest.mark.parametrize("name", ["purge_fixpoint", "purge_fuses"])
def test_purge_queries_shuffle_items_once(spark, name):
    plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_tiers(spark):
    assert values(spark, grades.tier(V), [0.75, 0.74, 0.48, 0.1], "double") == ["Gold", "Silver", "Silver", "Bronze"]
    assert values(spark, grades.threshold(V), ["?", "i", "m", "a"]) == [3, 5, 9, 7]
    assert values(spark, grades.width_factor(V, F.lit(None).cast("double")), ["i", "m", "A", "7", "ß", "ó"]) == [0.40, 1.30, 0.92, 0.73, 0.78, 0.85]
    assert values(spark, grades.final_quality(V, F.lit(1.0), F.lit(None).cast("double")), [0.4, 0.9], "double") == [0.4, 0.9]


def test_learned_widths(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 1.2), ("b", 0.19), ("b", 2.21), ("b", 2.0)], "char string, width double")
    assert [(r.char, r.learned) for r in store.learned_median(df).collect()] == [("b", 1.2)]


def test_layout(spark):
    rows = spark.createDataFrame([(1, i, 5.0, 90.0) for i in range(10)] + [(2, i, float(i // 5), 50.0 + i) for i in range(10)] + [(3, 0, 1.0, 1.0)], "k int, o int, l double, r double")
    got = {r.k: r for r in layout.margins(rows, "k", "o", "l", "r").collect()}
    assert got[1].margin_autocorr == 0 and got[2].margin_autocorr > 0.4 and got[3].right_cv == 0
    flags = spark.createDataFrame([(1, i, c == "1") for i, c in enumerate("0110111")], "k int, o int, f boolean")
    assert sorted((r.start, r.length) for r in layout.runs(flags, "k", "o", F.col("f")).collect()) == [(2, 2), (5, 3)]
    levels = spark.createDataFrame([(1, v) for v in [10, 11, 12, 200, 201, 202]], "k int, v int")
    assert layout.otsu(levels, "k", "v").first().threshold == 12
    wave = spark.createDataFrame([(1, i, [0.0, 1.0, 3.0, 1.0, 0.0][i % 5]) for i in range(60)], "k int, p int, v double")
    assert layout.period(wave, "k", "p", "v").first().period == 5
    waves = spark.createDataFrame([(1, i, math.cos(2 * math.pi * i / 28) + 0.55 * math.cos(2 * math.pi * i / 7)) for i in range(120)], "k int, p int, v double")
    assert layout.period(waves, "k", "p", "v").first().period == 28  # the best, not the first at 7
    line = spark.createDataFrame([(1, 1, float(i), 2.0 * i + 1) for i in range(9)] + [(1, 2, float(i), 5.0 * (i % 2)) for i in range(3)] + [(2, 1, float(i), float(y)) for i, y in enumerate((0, 1, 0, 1, 0, 1, 0, 30))], "k int, line int, x double, y double")
    found = {r.k: r for r in layout.baseline(line, "k", "line", "x", "y").collect()}
    assert found[1].n == 9 and abs(found[1].sigma) < 1e-9  # a line of three is left out
    kept = np.array([0, 1, 0, 1, 0, 1, 0.0])
    left = kept - np.polyval(np.polyfit(np.arange(7), kept, 1), np.arange(7))
    assert found[2].n == 7 and abs(found[2].sigma - left.std()) < 1e-9 and abs(found[2].autocorr - (left[:-1] * left[1:]).sum() / (left**2).sum()) < 1e-9


def greedy_wrap(text, width):
    parts = [c for w in (text or "").split() for c in ([w] if len(w) <= width else [w[i : i + width - 1] + ("-" if i + width - 1 < len(w) else "") for i in range(0, len(w), width - 1)])]
    lines = []
    for p in parts:
        if lines and len(lines[-1]) + 1 + len(p) <= width:
            lines[-1] += f" {p}"
        else:
            lines.append(p)
    return lines


def test_wrap_equals_a_plain_loop(spark):
    texts = ["the quick brown fox jumps", "", None, "a" * 25, "one " * 9, "wordthatistoolong and more"]
    assert values(spark, layout.wrapped(V, 10), texts) == [greedy_wrap(t, 10) for t in texts]
    assert values(spark, layout.flow_pages(V, 10, 1), [[4, 4, 4], [9, 5], []], "array<int>") == [[0, 0, 0], [0, 1], []]
    assert values(spark, layout.bounded_walk(V, 0.5, 1.0), [[0.5, 2.0, -4.0]], "array<double>") == [[0.5, 1.0, -1.0]]


def test_fuzzy_ranks(spark):
    s = lambda q, t: values(spark, ranking.fuzzy_score(q, V), [t])[0]
    assert s("", "x") == 1.0 and s("ab", "ba") == 0.0
    assert s("ban", "banco") > s("ban", "abrir banco") > s("ban", "urbano")
    assert s("abc", "abc x") > s("abc", "a b c")


def test_fuzzy_limit_and_keywords(spark):
    df = spark.createDataFrame([(i, i, f"item {i}", "clave") for i in range(12)], "id int, ord int, label string, keywords string")
    assert [r.ord for r in ranking.fuzzy_rank(df, "item").collect()] == list(range(8))
    assert ranking.fuzzy_rank(df, "clave").first().score > 0 and ranking.fuzzy_rank(df, "").count() == 12 and ranking.fuzzy_rank(df, "zzz").count() == 0


def test_sampling_avoids_repeats(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate(["Gold", "Gold", "Silver", "Silver", "Gold", "Bronze"])] + [("b", 9, "Bronze")], "char string, id int, tier string")
    turns = spark.createDataFrame([(c, t) for c in "ab" for t in range(40)], "char string, turn long")
    got = {}
    for r in ranking.sample_variants(rows, turns).orderBy("char", "turn").collect():
        got.setdefault(r.char, []).append(r.id)
    assert got["b"] == [9] * 40 and 5 not in got["a"]
    assert all(len({*got["a"][i : i + 4]}) == 4 for i in range(37))


def test_similarity(spark):
    df = spark.createDataFrame([("Hola  Mundo", "hola mundo"), ("abc", "xyz"), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(ranking.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_integrity(spark):
    rows = [(1, "l1", 0.5, 9, False, 0, 0, 0.9), (1, "l2", 0.9, 2, False, 0, 0, 0.9), (2, "l1", 0.1, 1, True, 9, 9, 0.1), (3, "l3", 0.1, 0, False, 1, 3, 0.5), (3, "l4", 0.2, 0, False, 5, 5, 0.9), (4, "l5", 0.1, 0, False, 9, 9, 0.1)]
    df = spark.createDataFrame(rows, "page int, layout string, agreement double, scored int, hinted boolean, dcols int, drows int, conf double")
    assert sorted((r.page, r.layout, r.how) for r in integrity.layout_choice(df).collect()) == [(1, "l1", "agreement"), (2, "l1", "hint"), (3, "l3", "geometry"), (4, "l5", "tentative")]
    gate = spark.createDataFrame([("a", 0.1), ("a", None), ("b", None), ("c", 0.5)], "doc string, score double")
    assert {r.doc: r.verdict for r in integrity.page_gate(gate).collect()} == {"a": "suspect", "b": "unknown", "c": "ok"}


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "jobs.json")
    (tmp_path / "jobs.json").write_text(json.dumps([{"id": "1", "status": "Pagado", "extra": 1}, {"id": "2"}], indent=1))
    jobs = ledger.with_defaults(files.json_records(spark, path, ledger.JOB))
    assert sorted((r.id, r.status, r.pages) for r in jobs.collect()) == [("1", "Pagado", "1"), ("2", "Borrador", "1")]
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "bad.json.bak").write_text('[{"id": "7"}]')
    assert files.json_records(spark, str(tmp_path / "bad.json"), ledger.JOB).count() == 0
    assert files.json_or_backup(spark, str(tmp_path / "bad.json"), ledger.JOB).first().id == "7"
    out = str(tmp_path / "t")
    sinks.replace(spark.range(3), out)
    sinks.replace(spark.read.parquet(out).where("id > 0"), out, backup=True)
    assert spark.read.parquet(out).count() == 2 and spark.read.parquet(f"{out}.bak").count() == 3
    with pytest.raises(ValueError):
        sinks.remove(spark, "/etc", str(tmp_path))
    assert sinks.remove(spark, out, str(tmp_path))
    assert files.settings({"a": 1, "b": "x"}, {"a": "no", "b": "y", "c": 2}) == {"a": 1, "b": "y"}


def test_projects_and_manifests(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"id": "1", "pages": [{"id": "a", "elements": [{"id": "e", "element_type": "blob"}, {"id": "f", "element_type": "rect"}]}]}, {"id": "2", "pages": []}]))
    got = {r.id: r.pages for r in files.normal_project(files.json_records(spark, str(tmp_path / "p.json"), files.PROJECT)).collect()}
    assert [e.element_type for e in got["1"][0].elements] == ["text", "rect"] and len(got["2"]) == 1
    folder = tmp_path / "g"
    folder.mkdir()
    for name in ("a_1.png", "punct_46_2.PNG", "ñ_0.png", "note.txt"):
        (folder / name).write_bytes(b"x")
    rebuilt = files.manifest(spark, str(tmp_path / "none.json"), str(folder)).collect()
    assert sorted((r.char, r["index"]) for r in rebuilt) == [(".", 2), ("a", 1), ("ñ", 0)]
    (tmp_path / "m.json").write_text(json.dumps([{"char": "a", "image_path": "x/a_1.png"}, {"char": "b", "image_path": "x/gone.png"}]))
    assert [r.char for r in files.manifest(spark, str(tmp_path / "m.json"), str(folder)).collect()] == ["a"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2026-01-01 {i // 60:02d}:{i % 60:02d}:00", "error" if i % 3 else "click", f"n{i % 4}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string, category string, name string, value double").select("id", F.to_timestamp("t").alias("ts"), "category", "name", "value")
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = telemetry.frequent(stream()).writeStream.outputMode("complete").format("memory").queryName("freq").start()
    q.processAllAvailable()
    q.stop()
    batch = {r.what: r.n for r in integrity.frequent(df, 100).collect()}
    assert {r.what: r.n for r in spark.table("freq").collect()} == batch
    q = telemetry.keep_ring(stream(), str(tmp_path / "ring"), str(tmp_path / "cp"), 50)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "ring")).collect()) == list(range(250, 300))
    for name, out in (("w", telemetry.windowed(stream())), ("s", telemetry.quiet(stream())), ("o", telemetry.insert_once(stream(), "id"))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() >= 0


def test_stacked_boxes(spark):
    rows = [[(0, 5, 10, 20), (2, 0, 6, 3), (9, 5, 20, 20), (30, 0, 40, 9)], []]
    df = spark.createDataFrame([(i, [tuple(b) for b in r]) for i, r in enumerate(rows)], "i int, b array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>")
    got = {r.i: [tuple(x) for x in r.m] for r in df.select("i", records.merged_stacks(F.col("b")).alias("m")).collect()}
    assert got == {0: [(0, 0, 10, 20), (9, 5, 20, 20), (30, 0, 40, 9)], 1: []}


def test_chains_and_variants(spark):
    chains = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 20, 21), (5, 21, 22), (6, 21, 23)], "id long, a long, b long")
    assert {r.id: r.chain for r in records.merged_chains(chains).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    rows = spark.createDataFrame([("a", 1, "Silver", False), ("a", 2, "Gold", True), ("a", 3, "Silver", False), ("a", 4, "Bronze", False), ("b", 5, "Gold", True)], "char string, id int, tier string, degenerate boolean")
    got = records.chosen_variant(rows).collect()
    assert len(got) == 1 and got[0].char == "a" and got[0].id in (1, 3)


def test_gates_and_moves(spark):
    df = spark.createDataFrame([(0.9, "a", 0.9), (0.1, "a", 0.9), (None, "&", 0.9), (0.9, "?", 0.1), (0.9, None, 0.9)], "c double, ch string, q double")
    assert [r[0] for r in df.select(records.gate_reason(F.col("c"), F.col("ch"), F.col("q"), 0.3, 0.5)).collect()] == [None, "confidence", "alphabet", "quality", None]
    paths = spark.createDataFrame([("old/a.png",), ("older/a.png",), (None,)], "p string")
    assert [r[0] for r in records.moved_paths(paths, "p", "old", "new").collect()] == ["new/a.png", "older/a.png", None]
    ring = records.neighbours(spark.createDataFrame([(1, 5), (1, 7), (2, 9)], "k int, o int"), "k", "o").orderBy("k", "o").collect()
    assert [(r.next, r.prev) for r in ring] == [(7, 7), (5, 5), (9, 9)]
    assert records.options_signature("spa", 200, True, [2, 1], False) == "spa|200|1|[1, 2]|0"
    assert values(spark, tx.slug(V), ["Mi Perfil!", "  ", "a--b__c", "ñ"]) == ["mi_perfil", "perfil", "a--b_c", "perfil"]
    assert values(spark, tx.describe_charset(V, F.lit(3)), ["abc", "aB1.é", "", "日本"]) == ["tuya:min×3", "tuya:min+MAY+díg+punt+acent×3", "tuya:?×3", "tuya:日本×3"]
