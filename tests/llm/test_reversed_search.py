"""Reversed search against scores of every pair, taken from the formula with regular expressions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect, differences

from claimlab.llm import common, reversed_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, documents, top):
    docs = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t in documents) if t]
    total, words = len(docs), sum(n for _, _, n in docs)
    holding = Counter(w for _, c, _ in docs for w in c)
    result = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc_id, counts, n in docs:
            m = 100 - 25 + (25 * n * total) // words
            score = 0
            for word, times in asked.items():
                if word in counts:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * holding[word] + 1)))
                    score += times * w * ((1_000_000_000 * counts[word]) // (1000 * counts[word] + 12 * m))
            if score > 0:
                scored.append((score, doc_id))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        result += [(item, rank, d, s) for rank, (s, d) in enumerate(scored[:top], 1)]
    return sorted(result, key=repr)


ITEMS = [
    (1, "alpha beta beta gamma"), (2, "ÄÖ ñandú Straße 42"), (3, ""), (4, None), (None, "alpha delta"), (5, "nowhere-found"),
    (6, "the the the"), (1, "alpha beta beta gamma"), (7, "Alpha\x00BETA_42"),
]
UNIQUE = list(dict.fromkeys(ITEMS))


def documents():
    draw = np.random.default_rng(3)
    words = ["alpha", "BETA", "gamma", "delta", "the", "ñandú", "Straße", "42", "äö", "ÄÖ", "漢字", "x1"]
    rows = [(i, " ".join(draw.choice(words, size=int(draw.integers(0, 30))))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "., !"), (None, "alpha beta"), (None, "alpha beta"), (7, "alpha-beta"), (7, "alpha-beta")]
    return rows + [(400, "the " * 50_000), (401, "alpha beta gamma " * 3)] + [(500 + i, "delta alpha") for i in range(60)]


@pytest.mark.parametrize("limit, tasks", [(500_000, 12), (8, 1)])
def test_every_pair(spark, limit, tasks, monkeypatch):
    monkeypatch.setattr(reversed_search, "FAN_IN", 4)
    rows = documents()
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, score int")
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rank int").repartition(tasks)
    found = reversed_search.search(items, table, 20, limit)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(UNIQUE, rows, 20)


def test_blocks_hold_every_item_within_the_bound(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(1 + i % 9))) for i in range(80)], "item_id long, text string")
    found = list(reversed_search._blocks(reversed_search._item_terms(items), 120))
    assert sorted(item for index in found for item, _ in index.items) == list(range(80))
    assert all(sum(len(x) for x, _ in index.lists) <= 120 for index in found)
    assert len(found) > 1


@pytest.mark.parametrize("empty", ["items", "documents"])
def test_empty_tables(spark, empty):
    items = spark.createDataFrame([] if empty == "items" else ITEMS, "item_id long, text string")
    table = spark.createDataFrame([] if empty == "documents" else documents(), "doc_id long, text string")
    found = reversed_search.search(items, table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_registered_query(spark, sf_dir):
    found = reversed_search.benchmark_search(spark, sf_dir)
    assert differences(found, connect(sf_dir), reversed_search.SQL) is None
    items, rows = (
        [tuple(r) for r in common.table(spark, sf_dir, name).select(key, "text").collect()]
        for name, key in (("benchmark", "item_id"), ("documents", "doc_id"))
    )
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(items, rows, 20)
