"""Neighbours, revisits, quotations and the pipeline."""

import math
import time

import numpy as np
import oracle
import pytest

import corpus_pipeline
from claimlab.llm import common, graph_ann, ngram_join, quotation_links, warc_revisit
from claimlab.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, key):
    con = oracle.connect(sf_dir)
    assert oracle.differences(QUERIES[key](spark, sf_dir), con, ORACLE_SQL[key]) is None


# --- Neighbours ------------------------------------------------------------------------------------------


def exact(ids, vectors, query, k):
    scores = vectors @ vectors[query]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[query]]
    return [(int(ids[i]), scores[i]) for i in order[:k]]


def test_recall_over_shards_and_norms(spark):
    random_ = np.random.default_rng(0)
    vectors = random_.normal(size=(1500, 16)) * random_.uniform(0.2, 3, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = graph_ann.nearest_neighbours(frame, frame.where("vec_id % 20 = 0"), k=10, shard_points=400).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, hit = np.arange(1500), 0
    for query in range(0, 1500, 20):
        expected = exact(ids, vectors, query, 10)
        hit += len({i for i, _ in expected} & {i for i, _ in found[query]})
        assert [s for _, s in found[query]] == sorted((s for _, s in found[query]), reverse=True)
        assert all(s == pytest.approx(float(vectors[query] @ vectors[i]), abs=1e-12) for i, s in found[query])
    assert hit >= 0.95 * 750


def test_equal_vectors_ties_and_unusable_rows(spark):
    rows = [(i, [1.0, 0.0], "x") for i in range(60)] + [(60 + i, [0.0, float(i + 1)], "x") for i in range(5)]
    rows += [(100, None, ""), (120, [0.0, 0.0], ""), (140, [1.0, None], ""), (160, [math.nan, 1.0], ""), (180, [math.inf, 1.0], "")]
    rows += [(200, [], ""), (None, [1.0, 1.0], ""), (20, [1.0, 0.0], "x"), (220, [1.0, 2.0, 3.0], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    out = graph_ann.nearest_neighbours(frame, frame.where("vec_id % 20 = 0"), k=20).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == {0, 20, 40, 60}
    assert found[20] == [i for i in range(21) if i != 20] and found[0] == list(range(1, 21))
    assert found[60][:4] == [64, 63, 62, 61] and found[60][4:] == list(range(16))
    few = frame.where("vec_id in (60, 61, 62)")
    assert graph_ann.nearest_neighbours(few, few.where("vec_id = 60"), k=20).count() == 2
    none = frame.where("vec_id = 100")
    assert graph_ann.nearest_neighbours(none, none).count() == 0


def test_graph_reaches_all_points_with_bounded_degree():
    random_ = np.random.default_rng(2)
    points = np.concatenate([random_.normal(size=(300, 8)), 50 + random_.normal(size=(5, 8))])
    graph = graph_ann.Graph(points, degree=8, beam=16)
    assert graph.edges.shape[1] == 12
    found, far = graph.search(points, beam=400)
    assert all(set(row[row >= 0].tolist()) == set(range(305)) for row in found)
    assert (np.diff(far[:, :305], axis=1) >= 0).all()


def test_ann_query_recall(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = {}
    for r in graph_ann.neighbours_of_every_twentieth(spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len({i for i, _ in exact(ids, vectors, q, 20)} & found[ids[q]]) for q in np.flatnonzero(ids % 20 == 0))
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


# --- Revisits --------------------------------------------------------------------------------------------

RECORDS = (
    "record_id long, url string, ts long, type string, status int, etag string, last_modified string, digest string, "
    "headers map<string,string>, body string, day int, canonical string"
)
DAY = warc_revisit.DAY


def records(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], RECORDS)


def test_revisits_take_the_latest_earlier_response(spark):
    head = {"etag": "1", "date": "old", "server": "origin", "content-length": "9"}
    rows = [
        (1, "http://www.Site.org:80/a/?utm_x=1&b=2&a=1#f", 10, "response", 200, '"1"', None, "d1", head, "first"),
        (2, "https://site.org/a?a=1&b=2", 3 * DAY, "response", 200, '"2"', None, "d2", None, "second"),
        (3, "https://site.org/a?b=2&a=1", 3 * DAY + 5, "response", 404, '"3"', None, "d3", None, "error"),
        (10, "site.org/a?a=1&b=2", 2 * DAY, "revisit", 304, 'W/"1"', None, None, {"date": "new", "server": "edge"}, None),
        (11, "http://site.org/a/?a=1&b=2", 3 * DAY + 9, "revisit", 304, None, None, "d2", None, None),
        (12, "http://site.org/a?a=1&b=2", 9 * DAY, "revisit", 304, '"9"', None, None, {"vary": "x"}, None),
        (13, "http://site.org/a?a=1&b=2", 10, "revisit", 304, '"1"', None, None, None, None),
        (14, "http://site.org/other", 50, "revisit", 304, '"1"', None, None, None, None),
        (15, None, 50, "revisit", 304, '"1"', None, None, None, None),
        (16, "http://site.org/a?a=1&b=2", None, "revisit", 304, '"1"', None, None, None, None),
        (17, "http://site.org/a?a=1&b=2", 3 * DAY, "revisit", 304, None, None, None, None, None),
    ]
    rows.append(rows[3])
    found = {r.record_id: r for r in warc_revisit.resolved(records(spark, rows)).collect()}
    assert len(found) == 8
    assert (found[10].outcome, found[10].response_id, found[10].body) == ("resolved", 1, "first")
    assert found[10].headers == {"etag": "1", "date": "new", "server": "origin", "content-length": "9"}
    assert (found[11].outcome, found[11].response_id, found[11].headers) == ("resolved", 2, {})
    assert (found[12].outcome, found[12].body, found[12].headers) == ("validator_mismatch", None, {"vary": "x"})
    assert {found[i].outcome for i in (13, 14, 15, 16)} == {"no_earlier_response"}
    assert found[17].outcome == "validator_mismatch"  # nothing to compare, and its response is the one at 10
    assert warc_revisit.resolved(records(spark, [])).count() == 0


def test_revisits_without_ids_or_with_shared_ids(spark):
    rows = [
        (7, "http://h/a", 10, "response", 200, '"1"', None, None, None, "one"),
        (7, "http://h/b", 10, "response", 200, '"2"', None, None, None, "two"),
        (None, "http://h/c", 10, "response", 200, '"3"', None, None, None, "three"),
        (None, "http://h/a", 20, "revisit", 304, '"1"', None, None, None, None),
        (None, "http://h/b", 20, "revisit", 304, '"2"', None, None, None, None),
        (9, "http://h/c", 20, "revisit", 304, '"3"', None, None, {"b": "1", "a": None}, None),
        (9, "http://h/c", 21, "revisit", 304, '"4"', None, None, None, None),
        (9, "http://h/c", 21, "revisit", 304, '"4"', None, None, None, None),
    ]
    found = warc_revisit.resolved(records(spark, rows)).collect()
    assert sorted((r.record_id or 0, r.ts, r.outcome, r.body or "") for r in found) == [
        (0, 20, "resolved", "one"), (0, 20, "resolved", "two"), (9, 20, "resolved", "three"), (9, 21, "validator_mismatch", ""),
    ]


def test_registered_captures_use_every_validator(spark, sf_dir):
    captures = warc_revisit.records_of_pages(common.table(spark, sf_dir, "pages"))
    pages = common.table(spark, sf_dir, "pages").count()
    assert captures.where("type = 'revisit'").select("url").distinct().count() == pages
    good = {r.record_id for r in warc_revisit.resolved(captures).where("outcome = 'resolved'").collect()}
    asked = {r.record_id: r for r in captures.where("type = 'revisit'").collect()}
    ways = {(bool(asked[i].etag), bool(asked[i].last_modified), bool(asked[i].digest)) for i in good}
    assert ways == {(True, False, False), (False, True, False), (False, False, True)}


def test_revisits_of_one_url_on_many_days(spark):
    rows = [(2 * i, "http://h/x", i * 4000, "response", 200, f'"{i}"', None, None, None, f"b{i}") for i in range(200)]
    rows += [(2 * i + 1, "http://h/x", i * 4000 + 1, "revisit", 304, f'"{i}"', None, None, None, None) for i in range(0, 200, 7)]
    out = warc_revisit.resolved(records(spark, rows)).collect()
    assert len(out) == 29 and all(r.outcome == "resolved" and r.response_id == r.record_id - 1 for r in out)


# --- Quotations ------------------------------------------------------------------------------------------


def test_quotes_link_and_threads_are_ordered(spark):
    rows = [
        (1, 0, "a", "Hello  World\nsecond line"),
        (1, 1, "b", "> hello world\n> second line\nI agree"),
        (1, 2, "c", ">> Hello world\n>> second line\n> I agree\nSo do I"),
        (1, 3, "d", "> second line\nonly this\n> nobody said this"),
        (1, 4, "e", "no quote"),
        (1, 4, "e", "no quote"),
        (1, 5, "f", "> "),
        (2, 0, "a", "> hello world\nother conversation"),
        (2, 7, "b", None),
        (None, 1, "x", "lost"),
        (3, None, "x", "lost"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")
    out = {(r.conv_id, r.turn): r for r in quotation_links.reply_ordered(frame).collect()}
    assert len(out) == 10
    assert (out[None, 1].root_turn, out[3, None].root_turn, out[3, None].body) == (1, None, "lost")
    assert (out[1, 1].parent_turn, out[1, 1].body, out[1, 1].n_linked) == (0, "I agree", 1)
    assert (out[1, 2].parent_turn, out[1, 2].root_turn, out[1, 2].depth, out[1, 2].n_quotes) == (1, 0, 2, 2)
    assert (out[1, 3].parent_turn, out[1, 3].n_quotes, out[1, 3].n_linked, out[1, 3].body) == (0, 2, 1, "only this")
    assert (out[1, 4].root_turn, out[1, 4].depth, out[1, 4].n_quotes) == (4, 0, 0)
    assert out[1, 5].n_quotes == 0 and out[2, 0].n_linked == 0 and out[2, 7].body == ""
    assert quotation_links.reply_ordered(frame.limit(0)).count() == 0


def test_inner_lines_of_a_longer_stretch_link(spark):
    rows = [
        (1, 0, "a", "one\ntwo\n\nThree  x\nfour\nfive"),
        (1, 1, "b", "> two\n> three x\nabout these"),
        (1, 2, "c", "> four\n> five\nno\n> one\n>\n> two\nyes"),
        (1, 3, "d", "> two\n> four\nnot neighbours\n> three x\n> two\nnor in order"),
        (1, 4, "e", "two\nthree x\nfour"),
        (1, 5, "f", "> Two\n> Three x\n> four\nthe first holder counts"),
        (1, 6, "g", "> later\n> lines\nahead"),
        (1, 7, "h", "some\nlater\nlines\nhere"),
        (1, 8, "i", "> two\n> two\n> two\nx"),
        (1, 9, "j", "x\ntwo\ntwo\ntwo\ntwo\ny"),
        (1, 10, "k", "> two\n> two\n> two\nz"),
        (2, 1, "z", "> two\n> three x\nother conversation"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in quotation_links.reply_ordered(frame).collect()}
    assert len(out) == len(rows)
    parents = {k: r.parent_turn for k, r in out.items() if r.n_quotes}
    expected = {1: 0, 2: 0, 3: None, 5: 0, 6: None, 8: None, 10: 9}
    assert parents == {**{(1, t): p for t, p in expected.items()}, (2, 1): None}
    assert (out[1, 2].n_quotes, out[1, 2].n_linked) == (2, 2) and out[1, 3].n_linked == 0


def test_siblings_of_one_turn_and_rows_without_keys(spark):
    rows = [
        (1, 0, "a", "the question"),
        (1, 1, "b", "> the question\nfirst answer"),
        (1, 1, "c", "> the question\nsecond answer"),
        (1, 1, "c", "> the question\nsecond answer"),
        (1, 2, "d", "> first answer\nthanks"),
        (1, 3, "e", "> second answer\nno"),
        (None, 0, "a", "the question"),
        (None, 1, "b", "> the question\nx"),
        (1, None, "b", "> the question\ny"),
        (None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotation_links.reply_ordered(frame).collect()
    assert len(out) == 9
    by_body = {r.body: r for r in out if r.conv_id == 1}
    assert by_body["thanks"].parent_message == by_body["first answer"].message != by_body["second answer"].message
    assert by_body["no"].parent_message == by_body["second answer"].message
    assert [by_body[b].depth for b in ("the question", "first answer", "second answer", "thanks", "no")] == [0, 1, 1, 2, 2]
    assert (by_body["y"].n_quotes, by_body["y"].n_linked, by_body["y"].root_message) == (1, 0, by_body["y"].message)
    lost = [r for r in out if r.conv_id is None]
    assert len(lost) == 3 and all((r.parent_turn, r.depth, r.n_linked) == (None, 0, 0) for r in lost)


def test_registered_messages_quote_inner_lines(spark, sf_dir):
    messages = quotation_links.quoting_messages(common.table(spark, sf_dir, "conversations"))
    parts = common.saved(quotation_links.parsed(messages))
    runs = quotation_links._runs(parts).select("conv_id", "place", "text").distinct()
    assert runs.count() > 0


def test_message_of_many_lines_and_levels_is_parsed_in_seconds(spark):
    plain = "\n".join(f"line {i}" for i in range(20_000))
    levels = "\n".join(f"{'>' * (i % 3)} line {i}" for i in range(20_000))
    rows = [(1, 0, "a", plain), (1, 1, "b", levels)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    begin = time.perf_counter()
    found = {r.place.turn: (len(r.passages), r.n_quotes) for r in quotation_links.parsed(frame).collect()}
    assert found == {0: (1, 0), 1: (20_000, 13_333)} and time.perf_counter() - begin < 30


def test_long_chain_of_replies(spark):
    rows = [(5, i, "r", (f"> text {i - 1}\n" if i else "") + f"text {i}") for i in range(70)]
    out = quotation_links.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.turn, r.depth, r.root_turn) for r in out.collect()) == [(i, i, 0) for i in range(70)]


def test_equal_messages_do_not_multiply(spark):
    rows = [(1, i, "r", "same words" if i % 2 else "> same words\nsame words") for i in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotation_links.reply_ordered(frame).collect()
    assert len(out) == 200 and {r.parent_turn for r in out if r.turn % 2 == 0 and r.turn} == {0}


# --- Pipeline --------------------------------------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = common.saved(kept)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    alone = ngram_join.linked_components(docs)
    assert alone.where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[3]


def test_run_is_the_stages_and_empty_documents_pass(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(rows.columns) and rows.count() > 0
    none = common.table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
