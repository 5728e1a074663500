"""Token ids against the libraries, transducer, files and packing."""

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimlab.llm import bpe_transducer, common, cost_packing, elias_fano, library_encoding, token_files, words

ODD = [
    "a  b", "", "  x", " x y ", "\nab c\n\nd", "É́ é̂ Ǆ ß ΑΣ ΣΑΣ", "<|endoftext|> a", "see <|endoftext|> here<|startoftext|>x", "B <|ENDOFTEXT|> <| b |>", None, "a's 's it's", " \t a",
    "x　 y z", " ", "x\nY z.\n", "ÄÖ, ß. é, \"a.\" 1,2 3.", "a\n b", "don't. it's, \n", "\nq", "a, b. c,. d.,e. f",
    "\x01 a \x01", "a" * 3000, "ab " * 2000,
]
TEXT = st.text(st.sampled_from("ab .,'\n\t é漢字1!Aß̂ "), max_size=40)
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, start int, ids string"


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    lines = map(bytes.split, open(RANKS, "rb"))
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_library_ids(path):
    expected = library(path)
    encode = library_encoding.encoder(path).encode
    assert list(encode(ODD)) == [library_encoding.pack_ids(expected(t)) for t in ODD]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXT, max_size=4))
    def check(texts):
        assert list(encode(texts)) == [library_encoding.pack_ids(expected(t)) for t in texts]

    check()


def test_full_memory_forgets_and_stays_right():
    expected = library(BYTES)
    encoder = library_encoding.encoder(BYTES)
    encoder.rest.limit, before = 3, encoder.rest.limit
    texts = ["one two three four five", "six seven one two", "three eight nine"] * 3
    assert list(encoder.encode(texts, block=1)) == [library_encoding.pack_ids(expected(t)) for t in texts]
    encoder.rest.limit = before


def test_transducer_encodes_as_the_library(reference):
    encoder = bpe_transducer.text_encoder(RANKS, P.PATTERN)
    texts = [t or "" for t in ODD]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == [reference(t) for t in texts]

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(TEXT, st.text(max_size=30)))
    def check(text):
        ids = next(iter(encoder.encode([text])))
        assert np.frombuffer(ids, "<u4").tolist() == reference(text)
        assert bpe_transducer.Decoder(encoder.transducer.ranks, run=2).decode(ids) == text

    check()


def test_transducer_emits_while_reading_and_forgets_states(reference):
    transducer = bpe_transducer.Transducer(bpe_transducer.read_ranks(RANKS), states=20)
    for piece in ["z" * 5000, "ab" * 3000, "internationalisation", "überquerung"]:
        assert list(transducer.stream(piece.encode(), lag=64)) == reference(piece)
        assert transducer.encode(piece.encode()) == reference(piece)
    first = next(iter(transducer.stream(b"qzx" * 5000, lag=64)))
    assert first == reference("qzx" * 5000)[0]


def test_words_of_a_block_are_read_side_by_side(reference, monkeypatch):
    single, step = [], bpe_transducer.Transducer._step
    monkeypatch.setattr(bpe_transducer.Transducer, "_step", lambda *a: single.append(1) or step(*a))
    random_ = np.random.default_rng(5)
    syllables = ["tion", "thou", "éeau", "ß", "ung", "ing", "漢", "ñó", "x", "'s", "##", "7", "ий", "\u0301"]
    texts = [" ".join("".join(random_.choice(syllables, n)) for n in random_.integers(1, 9, 60)) for _ in range(40)]
    texts += [t.replace(" ", "  ", 2) for t in texts[:9]] + [None, "", "'", "'s", " 's  's", "z" * 65, "a\tb \u00a0 c"]
    encoder = bpe_transducer.TextEncoder(bpe_transducer.read_ranks(RANKS), P.PATTERN)
    monkeypatch.setattr(bpe_transducer, "_BLOCK", 700, raising=False)
    monkeypatch.setattr(bpe_transducer, "_WHOLE_CHARS", 500, raising=False)
    found = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
    assert found == [reference(t or "") for t in texts]
    # Only pre-tokens of more than 64 bytes take their steps one by one.
    assert len(single) <= 400


def test_small_vocabulary_against_the_definition():
    ranks = {bytes([b]): b - 97 for b in b"abc"} | {b"ab": 3, b"bc": 4, b"abc": 5, b"ca": 6, b"aa": 7, b"aab": 8}
    transducer = bpe_transducer.Transducer(ranks)

    @settings(max_examples=500, deadline=None)
    @given(st.text(st.sampled_from("abc"), max_size=14))
    def check(text):
        piece = text.encode()
        expected = [ranks[piece]] if piece in ranks else [ranks[p] for p in bpe_transducer.merge_bytes(piece, ranks)]
        assert transducer.encode(piece) == expected

    check()


def test_another_pattern_that_cuts_words():
    pattern, ranks = r" ?\p{Lu}?\p{Ll}+| ?\S|\s+", bpe_transducer.read_ranks(RANKS)
    expected = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["camelCase ofThe ÉTé, aB.\nAbC dEf", "x  yZ 12."]
    encoder = bpe_transducer.TextEncoder(ranks, pattern)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == list(map(expected, texts))


def test_small_vocabulary_side_by_side():
    ranks = {bytes([b]): b - 97 for b in b"abc"} | {b"ab": 3, b"bc": 4, b"abc": 5, b"ca": 6, b"aa": 7, b"aab": 8}
    transducer = bpe_transducer.Transducer(ranks)

    @settings(max_examples=200, deadline=None)
    @given(st.sets(st.text(st.sampled_from("abc"), min_size=1, max_size=14), min_size=1))
    def check(texts):
        for text, ids in transducer.encode_many(texts).items():
            piece = text.encode()
            expected = [ranks[piece]] if piece in ranks else [ranks[p] for p in bpe_transducer.merge_bytes(piece, ranks)]
            assert np.frombuffer(ids, "<u4").tolist() == expected

    check()
    with pytest.raises(KeyError):
        transducer.encode_many({"abd"})


@given(st.text(max_size=20), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_utf8_stream_gives_whole_characters(text, step):
    machine, data, out = bpe_transducer.Utf8Stream(), text.encode(), ""
    for at in range(0, len(data), step):
        out += machine.feed(data[at : at + step])
        assert len(machine.pending) < 4
    assert out + machine.close() == text
    with pytest.raises(UnicodeDecodeError):
        machine.feed("é".encode()[:1])
        machine.close()


@given(st.lists(st.integers(-(1 << 62), 1 << 62), max_size=600))
@settings(max_examples=100, deadline=None)
def test_elias_fano_round_trip(values):
    values = sorted(values) if not values or max(values) - min(values) < 1 << 40 else sorted(v % 100_000 for v in values)
    coded = elias_fano.EliasFano(elias_fano.encode(np.array(values, dtype=np.int64)))
    assert coded.values().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(elias_fano.encode(ends)) * 8 < 100_000 * (2 + np.log2(1000) + 0.5)
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1]))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA).repartition(3)


ROWS = [(9, "nine nine"), (2, None), (2, ""), (5, "a b c " * 3000), (7, "é漢\n\nx"), (1, "one"), (1, "one"), (None, "no id")]


def test_token_files(spark, tmp_path):
    expected = library(BYTES)
    folder = f"file://{tmp_path}/files"
    token_files.write_token_files(documents(spark, ROWS), folder, BYTES, end_id=2, file_tokens=6)
    rows = token_files.read_token_files(spark, folder).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    starts = 0
    found = sorted(rows, key=lambda r: r.start)
    for row, (doc_id, text) in zip(found, order):
        ids = [*expected(text), 2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, starts, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        starts += len(ids)
    assert len(found) == len(order)
    files = spark.read.parquet(folder).collect()
    assert len(files) > 3
    image = token_files.TokenImage(max(files, key=lambda f: f.n_docs).image)
    assert [image[i][1][-1] for i in range(len(image))] == [2] * len(image)


def test_token_files_of_wide_ids_and_no_rows(spark, tmp_path):
    image, tokens = token_files._image([4, 4], [library_encoding.pack_ids([70000, 1]), library_encoding.pack_ids([2])])
    held = token_files.TokenImage(image)
    assert tokens == 3 and held.ids.dtype == np.dtype("<u4") and held[0][1].tolist() == [70000, 1] and held[1][0] == 4
    folder = f"file://{tmp_path}/none"
    token_files.write_token_files(documents(spark, []), folder, BYTES, end_id=2)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_images_are_read_by_blocks_through_select(monkeypatch):
    monkeypatch.setattr(token_files, "_ROWS", 300)
    random_ = np.random.default_rng(3)
    parts = [library_encoding.pack_ids(random_.integers(0, 9, n)) for n in random_.integers(0, 40, 1000)]
    doc_ids = [None] * 350 + sorted(random_.integers(-(10**12), 10**12, 650).tolist())
    image = token_files.TokenImage(token_files._image(doc_ids, parts)[0])
    rows = [row for batch in token_files._documents(image, 5) for row in batch.to_pylist()]
    assert [r["doc_id"] for r in rows] == doc_ids and [r["ids"] for r in rows] == parts
    assert [r["start"] for r in rows] == (5 + np.cumsum([0] + [len(p) // 4 for p in parts])[:-1]).tolist()
    ends, values = image.ends, image.ends.values()
    for first, stop in [(0, 1), (255, 257), (256, 512), (999, 1000), (1000, 2000), (-3, 2)]:
        assert ends.part(first, stop).tolist() == values[max(0, first) : stop].tolist()
    assert [ends.select(i) for i in range(1000)] == values.tolist()


def test_packing_covers_each_id_once(spark):
    expected = library(WORDS)
    pieces = cost_packing.packed(documents(spark, ROWS), WORDS, end_id=1, sequence_tokens=64, group_sequences=4).collect()
    sequences, docs = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences.setdefault(p.sequence_id, []).append(p)
        docs.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    padded = 0
    for held in sequences.values():
        held.sort(key=lambda p: p.offset)
        ends = np.cumsum([0] + [p.length for p in held])
        assert [p.offset for p in held] == ends[:-1].tolist() and ends[-1] <= 64
        padded += 0 if bin(ends[-1]).count("1") == 1 else 64 - ends[-1]
    assert padded == 0
    total = sum(len(expected(t)) + 1 for _, t in ROWS)
    assert sum(p.length for p in pieces) == total
    long_one = sorted(docs[5, len(expected(ROWS[3][1])) + 1], key=lambda p: p.start)
    assert np.frombuffer(b"".join(p.ids for p in long_one), "<u4").tolist() == [*expected(ROWS[3][1]), 1]
    assert cost_packing.packed(documents(spark, []), WORDS, 1).count() == 0


def test_assignment_balances_cost():
    lengths = np.array([900, 800, 700, 600, 500, 400, 120, 76])
    placed = cost_packing.assign(lengths, np.array([2048, 2048]), 1.0, 1 / 4096)
    assert sum(size for _, _, size, _, _ in placed) == 4096
    cost = [sum(s + s * s / 4096 for _, _, s, q, _ in placed if q == k) for k in (0, 1)]
    assert abs(cost[0] - cost[1]) < 0.1 * max(cost)
    assert cost_packing.powers_of_two(777) == [512, 256, 8, 1]


def test_encoded_and_decoded_documents(spark, reference):
    tokens = bpe_transducer.encoded(documents(spark, ROWS), RANKS, P.PATTERN)
    rows = bpe_transducer.decoded(tokens, RANKS).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == sorted((i or 0, t or "") for i, t in ROWS)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == reference(r.decoded) for r in rows)
    assert bpe_transducer.encoded(documents(spark, []), RANKS, P.PATTERN).count() == 0


def test_registered_digests(spark, sf_dir):
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    ids_of, start = library(BYTES), 0
    for row in token_files.token_file_digest(spark, sf_dir).orderBy("doc_id").collect():
        ids = library_encoding.pack_ids([*ids_of(texts[row.doc_id]), 2])
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    packed = cost_packing.packing_digest(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(texts)


@given(st.lists(st.text(st.sampled_from("ab \n\t\x0b.é"), max_size=12), max_size=6), st.booleans())
@settings(max_examples=200, deadline=None)
def test_word_hashes_follow_split(texts, lower):
    seen = {}
    for first, hashes, begin in words.word_hashes(pa.array(texts, pa.string()), lower):
        for i in range(len(begin) - 1):
            found = [w.lower() if lower else w for w in texts[first + i].encode().split()]
            assert begin[i + 1] - begin[i] == len(found)
            for word, value in zip(found, hashes[begin[i] : begin[i + 1]].tolist()):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_latin_words_go_past_the_normaliser():
    inner, given_texts = Tokenizer.from_file(WORDS), []

    class Counted:
        def __getattr__(self, name):
            return getattr(inner, name)

        def encode_batch_fast(self, texts, **options):
            given_texts.extend(texts)
            return inner.encode_batch_fast(texts, **options)

    encoder = library_encoding.library_encoder(Counted())
    given_texts.clear()
    texts = ["Über the STRASSE straße Łódź ªº ŉ", "İstanbul Ǆ ǅ ﬁ x́y ΑΣ é"]
    assert list(encoder.encode(texts)) == [library_encoding.pack_ids(library(WORDS)(t)) for t in texts]
    seen = " ".join(given_texts)
    assert "İstanbul" in seen and "ΑΣ" in seen and "traße" not in seen and "Łódź" not in seen
