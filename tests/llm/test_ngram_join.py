"""The prefix-tree join against brute force, its components, and the stage built on it."""

import random
import re
from collections import defaultdict

import numpy as np
from claimlab.llm import common, ngram_join
from claimlab.llm import components as components_module
from claimlab.llm.components import components


def brute_force(rows, percent=80):
    sets = {}
    for doc_id, text in rows:
        found = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        grams = {tuple(found[i : i + 5]) for i in range(len(found) - 4)}
        sets[doc_id] = grams if len(found) >= 5 else {tuple(found)} if found else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders, shared = defaultdict(list), defaultdict(int)
    for doc_id, grams in sets.items():
        for gram in grams:
            holders[gram].append(doc_id)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                shared[min(a, b), max(a, b)] += 1
    for (a, b), count in shared.items():
        if 100 * count >= percent * (len(sets[a]) + len(sets[b]) - count):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def mutated(seed, count=250):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60))] for _ in range(25)]
    passage = [rnd.choice(vocabulary) for _ in range(50)]
    rows = []
    for doc_id in range(count):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((doc_id, " ".join(words + passage * (rnd.random() < 0.2))))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A \t b"), (1005, rows[3][1])]


def found(spark, rows, **options):
    schema = "doc_id long, text string, cls int, root string, n int"
    frame = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], schema).repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(frame, **options).collect()}


def test_join_equals_brute_force(spark):
    rows = mutated(1)
    assert found(spark, rows) == brute_force(rows)


def test_blocks_that_are_cut_lose_no_link(spark):
    rows = mutated(2)
    assert found(spark, rows, block_sets=6) == brute_force(rows)


def test_frequent_shingles_and_one_large_group_of_near_copies(spark):
    rnd = random.Random(3)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for doc_id in range(300):
        copy = list(words)
        for _ in range(rnd.choice([0, 1, 2])):
            copy[rnd.randrange(120)] = f"x{rnd.randrange(500)}"
        rows.append((doc_id, " ".join(copy)))
    rows += [(500 + i, " ".join(f"u{i}-{k}" for k in range(40))) for i in range(50)]
    assert found(spark, rows, block_sets=40) == brute_force(rows)


def letters(count, pool, seed):
    """Form letters of 50 shingles with two varying words; a small pool makes some of them links."""
    rnd = random.Random(seed)
    rows = []
    for doc_id in range(count):
        words = [f"f{k}" for k in range(54)]
        words[12], words[40] = (f"y{rnd.randrange(pool)}" if pool else f"y{doc_id}-{k}" for k in range(2))
        rows.append((doc_id, " ".join(words)))
    return rows


def rows_made(spark, after):
    """The most rows that an operator of a query later than number `after` has put out, and the last number."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most, last = store.executionsList(), 0, after
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        last = max(last, number)
        if number <= after:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                value = values.get(metrics.apply(k).accumulatorId())
                if metrics.apply(k).name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most, last


def test_form_letters_of_a_cut_block_make_no_pairs(spark):
    rows = letters(400, 0, 1)
    _, last = rows_made(spark, -1)
    assert found(spark, rows, block_sets=16) == brute_force(rows)
    assert rows_made(spark, last)[0] < 30 * len(rows)  # the pairs would be 200 for each


def test_linked_form_letters_in_cut_blocks(spark):
    for pool, block_sets in ((4, 4), (12, 10)):
        rows = letters(150, pool, pool) + [(200 + i, f"{t} {t[:60]} {i}") for i, t in letters(60, pool, 9)]
        expected = brute_force(rows)
        assert len({root for _, root in expected.values()}) < len(expected)
        assert found(spark, rows, block_sets=block_sets) == expected


def test_no_rows_and_only_empty_texts(spark):
    assert found(spark, []) == {}
    assert found(spark, [(3, None), (2, "")]) == {3: (0, 3), 2: (0, 2)}


def test_trie_join_of_random_sets():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        pool = [np.unique(rnd.integers(0, 40, 25)) for _ in range(4)]
        sets = [np.unique(np.append(rnd.permutation(p)[: len(p) - rnd.integers(0, 3)], rnd.integers(0, 40))) for p in pool * 5]
        sizes = [len(s) + int(rnd.integers(0, 3)) for s in sets]
        roots = ngram_join.join_sets(sets, sizes)
        parent = list(range(len(sets)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                    parent[find(i)] = find(j)
        same = {(i, j) for i in range(len(sets)) for j in range(i) if roots[i] == roots[j]}
        assert same == {(i, j) for i in range(len(sets)) for j in range(i) if find(i) == find(j)}


def test_components(spark):
    links = [(1, 2), (3, 2), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (7, 7), (20, 19), (19, 18), (18, 20)]
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    expected = {1: 1, 2: 1, 3: 1, **{i: 10 for i in range(10, 16)}, 18: 18, 19: 18, 20: 18}
    assert {r.node: r.root for r in rows} == expected and len(rows) == len(expected)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_keeps_all_columns(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(4, text, 1, "a"), (2, text, 2, "b"), (2, text, 2, "b"), (9, "else " * 9, 3, "c"), (None, text, 4, "d"), (5, None, 5, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, place int, row string")
    kept = ngram_join.one_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.place) for r in kept.collect()) == [(0, 4), (2, 2), (5, 5), (9, 3)]


def test_rows_of_one_id_stay_or_go_with_their_own_group(spark):
    copied, alone, third = (" ".join(f"{c}{i}" for i in range(30)) for c in "cax")
    rows = [(3, copied, 1), (5, copied, 2), (5, alone, 3), (5, alone, 3), (7, alone, 4), (8, " ", 5), (8, third, 6), (8, "", 7)]
    rows += [(2, third + " end", 8), (2, third, 8), (9, third, 9)] + [(20, f"only {i}", 10 + i) for i in range(4)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, place int, several int")
    kept = ngram_join.one_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.place) for r in kept.collect()) == [(2, 8), (3, 1), (5, 3), (8, 5), (8, 7)] + [(20, 10 + i) for i in range(4)]


def test_long_paths_and_negative_nodes(spark):
    links = [(i, i + 1) for i in range(-300, 300)] + [(1000 + 7 * i % 101, 1000 + 7 * (i + 1) % 101) for i in range(101)]
    rows = components(spark.createDataFrame(links, "u long, v long").repartition(9)).collect()
    found = {r.node: r.root for r in rows}
    assert len(rows) == len(found) and found == {n: -300 if n < 900 else 1000 for link in links for n in link}


def test_registered_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark, sf_dir).collect()}
    assert got == brute_force(rows)


def test_few_links_need_no_rounds_and_many_do(spark, monkeypatch):
    links = [(i, i + 1) for i in range(0, 90, 2)] + [(i, i + 1) for i in range(1, 90, 2)] + [(500, 400), (600, 400)]
    frame = spark.createDataFrame(links, "u long, v long").repartition(7)
    expected = {**dict.fromkeys(range(91), 0), **dict.fromkeys((400, 500, 600), 400)}
    rounds, star = [], components_module._star

    def counted(edges, upward):
        rounds.append(upward)
        return star(edges, upward)

    monkeypatch.setattr(components_module, "_star", counted)
    assert {r.node: r.root for r in components(frame).collect()} == expected and not rounds
    monkeypatch.setattr(components_module, "BLOCK", 8)
    assert {r.node: r.root for r in components(frame).collect()} == expected and rounds


def test_texts_move_once_to_leave_one_of_each_group(spark):
    frame = spark.createDataFrame([(i // 2, f"text {i}", i) for i in range(40)], "doc_id long, text string, place int")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        kept = ngram_join.one_of_each_group(frame.repartition(3))
        assert kept.count() == 40
        plan = kept._jdf.queryExecution()
        plan.executedPlan().executeCollect()
        final = plan.executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(setting, before)
    assert len(re.findall(r"[-+] Exchange hashpartitioning\(key#\d+L, \d+\)", final)) == 1
