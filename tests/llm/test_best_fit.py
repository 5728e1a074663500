"""Best-fit packing against a plain list of open sequences, and the registered query against the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimlab.llm import best_fit, common
from claimlab.llm.best_fit import OpenSequences

WORDS = P.path("word_bpe_49k.json")


def plain(lengths, tokens, limit):
    """Free space of open sequences in a list; the newest of equal ones is taken."""
    open_, result, count = [], [], 0
    for length in lengths:
        fitting = [i for i, (space, _) in enumerate(open_) if space >= length]
        if fitting:
            at = min(fitting, key=lambda i: (open_[i][0], -i))
            space, sequence = open_.pop(at)
        else:
            space, sequence, count = tokens, count, count + 1
            if length < tokens and len(open_) >= limit:
                open_.pop(min(range(len(open_)), key=lambda i: (open_[i][0], -i)))
        result.append((sequence, tokens - space))
        if space > length:
            open_.append((space - length, sequence))
    return result


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
def test_bitset_chooses_as_a_list_does(lengths, limit):
    held = OpenSequences(16, limit)
    assert [held.place(n) for n in lengths] == plain(lengths, 16, limit)
    assert held.count == sum(map(len, held.by_space)) <= limit
    assert held.bits == sum(1 << f for f, s in enumerate(held.by_space) if s)


def check(rows, tokens, documents):
    """Pieces hold every id once and no sequence has a gap or too many; gives the number of sequences."""
    encode = Tokenizer.from_file(WORDS)
    expected = sorted(
        ((d, [*encode.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in documents), key=lambda x: (repr(x[0]), len(x[1]))
    )
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]]
        assert sum(n for _, n in held) <= tokens
    wanted = defaultdict(list)
    for doc_id, ids in expected:
        for piece, at in enumerate(range(0, len(ids), tokens)):
            part = np.array(ids[at : at + tokens], dtype="<u4")
            wanted[doc_id].append((piece, at, len(part), zlib.crc32(part.tobytes())))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in wanted.items()}
    return len(places)


def test_odd_documents(spark):
    rows = [(1, ""), (2, None), (None, "no id"), (3, "a b c"), (3, "a b c"), (4, "long text " * 9000), (5, "x " * 15), (6, "x " * 14)]
    rows += [(i, f"word{i} " * (i % 13)) for i in range(10, 60)] + [(7, "see <|endoftext|> here")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string").repartition(3)
    found = best_fit.packed(table, WORDS, 1, 16, 3)
    found = found.selectExpr("doc_id", "piece", "start", "length", "crc32(ids) as ids_crc32", "sequence_id", "offset").collect()
    check(found, 16, rows)


def test_empty_table(spark):
    assert best_fit.packed(spark.createDataFrame([], "doc_id long, text string"), WORDS, 1).collect() == []


def test_registered_query_wastes_little(spark, sf_dir):
    documents = [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").collect()]
    found = best_fit.packing_digest(spark, sf_dir)
    assert dict(found.dtypes) == {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
        "sequence_id": "bigint", "offset": "bigint",
    }
    rows = found.collect()
    count = check(rows, 4096, documents)
    assert count <= 1.04 * sum(r.length for r in rows) / 4096 + 1
