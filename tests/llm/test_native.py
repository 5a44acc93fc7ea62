"""Decontamination, sharding and SimHash against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from granary.llm import nearcopies, ring, simhash
from granary.llm.decontam import decontaminate, find_contamination

DOCS = "doc_id long, text string, n_words int, _row string"  # two columns whose names clash with results and helpers


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        for gram in {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == gram:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def corpus():
    rng = random.Random(3)
    lexicon = [f"w{i}" for i in range(30)] + ["É", "ñu", "Éa"]
    text = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(1, text(14)), (2, text(12)), (11, "only four words here"), (3, ""), (None, text(11)), (4, None), (5, "ÉA x")]
    docs = [(0, None), (1, ""), (2, "  \n\t "), (3, text(50) + " " + items[0][1].upper() + "! " + text(8)), (4, "Only FOUR, words. here"), (5, text(40))]
    docs += [(6, items[1][1] + " " + items[1][1]), (6, items[1][1]), (None, items[0][1][5:]), (7, "éa x Éa X"), (8, text(3000))]
    return [(i, t, 7, "x") for i, t in docs], items


def test_contamination_equals_brute_force(spark):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 0):
        got = find_contamination(spark.createDataFrame(docs, DOCS), bench, broadcast_windows=limit).collect()
        want = sorted((d[0] is None, d[0] or 0, *brute_hits(d[1], [x for x in items if x[0] is not None])) for d in docs)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit if r.doc_id != -1 else 0, list(r["items"])) for r in got) == want


def test_contamination_of_empty_tables(spark):
    docs, items = corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    got = find_contamination(spark.createDataFrame(docs, DOCS), none).collect()
    assert len(got) == len(docs) and not any(r.n_hit for r in got)
    assert find_contamination(spark.createDataFrame([], DOCS), none).count() == 0


def test_decontaminate_keeps_columns(spark):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    clean = [d for d in docs if not brute_hits(d[1], items)[1]]
    dropped = decontaminate(df, bench)
    assert dropped.columns == df.columns and Counter(map(tuple, dropped.collect())) == Counter(clean)
    cut = decontaminate(df, bench, remove="spans").collect()
    assert len(cut) == len(docs) and set(clean) <= set(map(tuple, cut))
    before = {d[1] for d in docs}
    assert all(words(r.text) != words(d) for r in cut if r.text not in before for d in before)
    assert [r.text for r in cut if r.doc_id == 4] == [""]
    with pytest.raises(ValueError):
        decontaminate(df, bench, remove="lines")


def test_shards_are_equal_and_gapless(spark):
    rows = [(i, f"t{i % 50}", 1) for i in range(1000)] + [(None, None, 1), (None, "", 1)] + [(5, "same", 2)] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    for shards in (1, 24):
        got = ring.assign_shards(df, shards).collect()
        counts = Counter(r.shard for r in got)
        assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(shards))
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
        plain = [(r, f"t{r.doc_id % 50}".encode()) for r in got if r.doc_id not in (None, 5)]
        assert all(r.text_crc32 == zlib.crc32(t) and r.size == len(t) + 8 for r, t in plain)
    assert ring.assign_shards(df.limit(0)).count() == 0


def test_full_cells_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ring, "CELL_ROWS", 10)
    df = spark.createDataFrame([(5, "same")] * 300 + [(i, "t") for i in range(60)], "doc_id long, text string").repartition(4)
    got = ring.assign_shards(df, 7).collect()
    counts = Counter(r.shard for r in got)
    assert sorted(counts.values()) == [51] * 4 + [52] * 3
    assert len({(r.shard, r.slot) for r in got}) == len(got)


def test_plan_moves_few_keys():
    rng = random.Random(1)
    counts = Counter(rng.randrange(ring.CELLS) for _ in range(50_000))
    owner = lambda n: {(c, i): s for c, a, b, s, _ in ring.plan(counts, n) for i in range(a, b)}
    before, after = owner(24), owner(25)
    assert len(before) == 50_000
    assert sum(before[k] != after[k] for k in before) < 0.06 * len(before)


def test_ring_equals_a_plain_walk():
    """Each key goes clockwise from its cell to the first node of a shard with room; a cell's own shard comes first for all cells."""
    rng = random.Random(2)
    counts = Counter(rng.choice((rng.randrange(ring.CELLS), 17, 65_000)) for _ in range(3000))
    shards, nodes = 5, 3
    walk = sorted({cell: s for s in reversed(range(shards)) for v in range(nodes) for cell in [int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:2], "big")]}.items())
    room = [600] * 5
    owner, waiting = {}, []
    for cell in sorted(counts):
        first = next((i for i, (c, _) in enumerate(walk) if c >= cell), 0)
        for k in range(counts[cell]):
            if room[walk[first][1]]:
                room[walk[first][1]] -= 1
                owner[cell, k] = walk[first][1]
            else:
                waiting.append((cell, k, first))
    for cell, k, i in waiting:
        while not room[walk[i % len(walk)][1]]:
            i += 1
        room[walk[i % len(walk)][1]] -= 1
        owner[cell, k] = walk[i % len(walk)][1]
    assert {(c, k): s for c, a, b, s, _ in ring.plan(counts, shards, nodes) for k in range(a, b)} == owner


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    all_fp = sorted(prints)
    for i, a in enumerate(all_fp):
        for b in all_fp[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    lexicon = [f"w{i}" for i in range(200)] + ["É"]
    base = [[rng.choice(lexicon) for _ in range(120)] for _ in range(12)]
    rows = [(None, None), (900, ""), (901, " \n"), (902, "One two"), (903, "one TWO")]
    for i in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "new"
        rows.append((i, " ".join(w)))
    rows += [(7, rows[12][1])] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = simhash.near_duplicates(df).collect()
    fps = {brute_fp(t) for _, t in rows}
    root = brute_components(fps)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[brute_fp(t)]] = min(i, least.get(root[brute_fp(t)], 10**9))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(((i, brute_fp(t), least[root[brute_fp(t)]]) for i, t in rows), key=key)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_dropping_goes_by_row(spark):
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=80))
    rows = [(1, text(0), "a"), (1, text(1), "b"), (None, text(2), "c"), (None, text(3), "d"), (2, text(3), "e"), (None, text(4), "f"), (None, text(4), "f"), (5, text(5), "g"), (5, text(5), "g"), (6, text(5), "h"), (5, text(6), "i")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()
    assert sorted(r.x for r in kept) == ["a", "b", "c", "e", "f", "g", "i"]
    assert [r.doc_id for r in kept if r.x == "e"] == [2]


def test_chains_join_over_many_tasks(spark):
    rng = np.random.default_rng(2)
    chain, at = [], 0
    order = rng.permutation(63)
    for i in range(60):
        at ^= 1 << int(order[i])
        chain.append(at)
    other = [int(x) for x in rng.integers(0, 2**63, 500)]
    values = spark.createDataFrame([(x,) for x in {*chain, *other}], "fp long").repartition(5)
    got = {r.a: r.b for r in simhash.components(simhash.links(values)).collect()}
    root = brute_components({*chain, *other})
    classes = {}
    for f, r in root.items():
        classes.setdefault(r, []).append(f)
    assert {f: got.get(f, f) for f in root} == {f: min(classes[r]) for f, r in root.items()}


def test_few_edges_are_joined_by_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = [(i, i - 1) for i in range(1, 70)] + [(int(a), int(b)) for a, b in rng.integers(-300, -1, (120, 2))] + [(-900, 900), (-900, -900)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {(r.a, r.b) for r in simhash.components(df.where("a <> b"), together=0).collect()}
    written = []
    monkeypatch.setattr(simhash, "materialise", lambda x, f=simhash.materialise: written.append(x) or f(x))
    assert {(r.a, r.b) for r in simhash.components(df).collect()} == want and len(written) == 1
    assert simhash.components(df.limit(0)).count() == 0


def test_gray_index_searches_like_a_scan():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 20).astype(np.uint64)
    values = np.unique(np.concatenate([centre[rng.integers(0, 20, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), centre]))
    index = simhash.GrayIndex(values)
    who, place, far = index.search(values, 3)
    got = {(int(values[q]), int(index.values[p]), int(d)) for q, p, d in zip(who, place, far, strict=True)}
    assert got == {(int(a), int(b), int(a ^ b).bit_count()) for a in values for b in values if int(a ^ b).bit_count() <= 3}
    # whole groups are left out: far fewer nodes are looked at than there are pairs
    assert index.compared < 0.5 * len(values) ** 2


def test_gray_forest_joins_groups_as_all_links_do():
    rng = np.random.default_rng(4)
    groups = np.concatenate([np.repeat(np.arange(60), rng.integers(1, 12, 60)), np.full(700, 60), np.full(1, 61)]).astype(np.int64)
    values = rng.integers(0, 2**63, 40).astype(np.uint64)[rng.integers(0, 40, len(groups))]
    for _ in range(4):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, len(groups)).astype(np.uint64))
    index = simhash.GrayIndex(values, groups)
    a, b, far = index.forest(3)
    of, places = groups[index.order], range(len(values))
    assert all(of[x] == of[y] and int(index.values[x] ^ index.values[y]).bit_count() == d <= 3 for x, y, d in zip(a, b, far, strict=True))
    links = [(x, y) for x in places for y in range(index.start[x], x) if int(index.values[x] ^ index.values[y]).bit_count() <= 3]
    assert joined(zip(a.tolist(), b.tolist(), strict=True), places) == joined(links, places)
    assert len(a) == len(values) - len(set(joined(links, places).values()))


def joined(edges, nodes):
    """The least node of each node's component."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copy_rows(edits):
    rng = random.Random(11)
    lexicon = [f"w{i}" for i in range(400)] + ["É"]
    rows = [(None, None), (900, ""), (901, " \n"), (902, "One two"), (903, "one TWO"), (904, "a a a a a a"), (905, "a a a a a a a")]
    for k in range(30):
        base = [rng.choice(lexicon) for _ in range(rng.choice((8, 60, 150, 400)))]
        for i in range(rng.choice((1, 2, 3, 25))):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // edits)):
                w[rng.randrange(len(w))] = rng.choice(lexicon)
            rows.append((rng.choice((None, k, 1000 + 40 * k + i)), " ".join(w + base[: rng.choice((0, 0, len(base) // 20))])))
    rows.append((77, " ".join(rng.choice(lexicon) for _ in range(30_000))))
    rows += [rows[9]] * 3
    sets = [shingle_set(t) for _, t in rows]
    alike = lambda x, y: x == y or (x | y and len(x & y) / len(x | y) >= 0.8)
    return rows, joined([(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])], range(len(rows)))


def test_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "MOST_LINKS", 4)  # texts with many links are copied to several tasks
    rows, root = near_copy_rows(100)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, mark int").repartition(3)
    kept = nearcopies.drop_near_copies(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(root[r.mark] for r in got) == sorted(set(root.values()))
    least = {}
    for i, (x, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], (True, 10**9)), (x is None, x or 0))
    assert all((r.doc_id is None, r.doc_id or 0) == least[root[r.mark]] for r in got)
    assert nearcopies.drop_near_copies(df.limit(0)).count() == 0


def test_groups_held_together_by_links_at_the_limit(spark):
    """Most pairs of a group are just below the limit here: nothing else may go, and few groups may fall apart."""
    rows, root = near_copy_rows(40)
    got = nearcopies.drop_near_copies(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, mark int")).collect()
    assert {root[r.mark] for r in got} == set(root.values())
    assert len(got) - len(set(root.values())) < 0.05 * len(rows)


def test_hot_keys_are_dealt_out_to_pairs_of_parts(spark):
    df = spark.createDataFrame([(7, i) for i in range(300)] + [(i, i) for i in range(10, 40)], "key long, fp long")
    out = [(r.key, r.fp) for r in simhash.dealt(df, "fp", 50).collect()]
    sizes = Counter(k for k, _ in out)
    assert max(sizes.values()) <= 100
    at = {}
    for k, v in out:
        at.setdefault(v, set()).add(k)
    assert all(at[i] & at[j] for i in range(0, 10) for j in range(40, 300)) and not at[50] & {7}
    assert sorted(simhash.dealt(df, "fp", 500).collect()) == sorted(df.collect())
