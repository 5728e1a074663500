"""Ranked search with the roles reversed: items wait in an index and documents stream past them.

1. The items' terms are split into blocks of at most `INDEX_TERMS` distinct (item, term) entries, counted first, so
   that what is broadcast has a fixed bound; an item lies in one block whole. A block is an inverted index from
   a term to the items that hold it and how often.
2. One pass over the whole texts counts every document's terms and keeps its number of terms and its counts of the
   index's terms, which are written to the shared folder. The numbers of documents and terms, and the documents
   of each index term, are sums over that table; only the index's terms are collected.
3. A second pass over the table streams each document's counts through the index: a term adds its share to the
   scores of the items in its list. Every task holds one heap of `top` for each item of the block, and a
   document enters where its score is above the least one held.
4. Heaps merge in rounds, `FAN_IN` tasks' at a time, so the last round of an item reads a bounded number of rows.

A score is an exact 64-bit integer; only the logarithm in a term's weight is taken in doubles.

Defined results: null text and text without a term is no document; a null or termless item has no result, equal
rows of the items are one item, different texts of one item_id are ranked each on their own; repeated rows of documents rank
each; doc_id null comes last among equal scores; extra columns are not read; empty tables give no row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.llm import common

TOP = 20
#: Entries (item, term) of one block of the index; a block's terms, lists and counts take about 100 bytes an entry.
INDEX_TERMS = 500_000
FAN_IN = 64
#: Documents whose scores are held at once for a block's items, and the scores held at once.
_ROWS, _SCORES = 512, 4_000_000
#: Fixed values of the score.
_SCALE, _FLAT, _LENGTH, _TF, _M, _ONE = 1000, 75, 25, 1000, 12, 1_000_000_000

# A term's bytes are letters, digits and all bytes above 127; A-Z are lowered and the rest becomes a space.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO_TERMS).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def shares(counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What each (document, term) pair adds to the score of an item that holds the term once."""
    # 25 * size * documents can pass 64 bits at 100 TB, so it is taken in Python's integers, once a document size.
    values, at = np.unique(sizes, return_inverse=True)
    m = np.array([_FLAT + _LENGTH * int(n) * documents // terms for n in values], dtype=np.int64)[at]
    return weights * ((_ONE * counts) // (_TF * counts + _M * m))


# --- Index -------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """An inverted index over the items of a block: `lists[t]` has item numbers and how often each holds term t."""

    items: list[tuple[int | None, int]]
    terms: dict[bytes, int]
    lists: list[tuple[np.ndarray, np.ndarray]]


def index_of(rows: list[tuple[int | None, int, list[bytes], list[int]]]) -> Index:
    terms: dict[bytes, int] = {}
    postings: list[list[tuple[int, int]]] = []
    for number, (_, _, words, counts) in enumerate(rows):
        for word, count in zip(words, counts):
            place = terms.setdefault(word, len(terms))
            if place == len(postings):
                postings.append([])
            postings[place].append((number, count))
    lists = [tuple(np.array(column, dtype=np.int64) for column in zip(*entries)) for entries in postings]
    return Index([(item, text) for item, text, _, _ in rows], terms, lists)


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, a name of its text, and the distinct terms with their counts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(text)) for text in batch.column(2).to_pylist()]
            words = pa.array([list(c) for c in found], pa.list_(pa.binary()))
            counts = pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), words, counts], names=["item", "name", "words", "counts"])

    rows = items.select(F.col("item_id").cast("long").alias("item"), "text").distinct()
    rows = rows.select("item", F.xxhash64("text").alias("name"), "text")
    return rows.mapInArrow(split, "item long, name long, words array<binary>, counts array<long>").where("size(words) > 0")


def _blocks(items: DataFrame, limit: int) -> Iterator[Index]:
    """Indexes that together hold all items, each of at most `limit` entries unless a single item has more."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    count = -(-total // limit)
    if count > 1:
        count += count // 4 + 1  # hashing deals them unevenly
    while count:
        block = F.pmod(F.xxhash64("item", "name"), F.lit(count))
        sizes = items.groupBy(block.alias("block")).agg(F.sum(F.size("words")).alias("entries"), F.count("*").alias("items"))
        if sizes.where((F.col("entries") > limit) & (F.col("items") > 1)).isEmpty():
            break
        count *= 2
    for number in range(count):
        rows = items.where(block == number).orderBy("item", "name").collect()  # at most `limit` entries
        if rows:
            yield index_of([(r.item, r.name, [bytes(w) for w in r.words], list(r.counts)) for r in rows])


# --- Documents ---------------------------------------------------------------------------------------------


def _counted(documents: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, the number of terms, and the index's terms in the document with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, held, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    counts = Counter(words)
                    known = counts.keys() & terms.keys()
                    ids.append(doc_id)
                    sizes.append(len(words))
                    held.append([terms[w] for w in known])
                    times.append([counts[w] for w in known])
            lists = pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")


class Heaps:
    """The best documents of each item of an index."""

    def __init__(self, index: Index, top: int):
        self.index, self.top = index, top
        self.held: list[list[tuple]] = [[] for _ in index.items]
        self.least = np.ones(len(index.items), dtype=np.int64)

    def add(self, ids: list[int | None], begin: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> None:
        """Documents with their terms' shares; those of document d are `begin[d]` to `begin[d + 1]`."""
        scores = np.zeros((len(ids), len(self.index.items)), dtype=np.int64)
        owner = np.repeat(np.arange(len(ids)), np.diff(begin))
        order = np.argsort(terms, kind="stable")
        edges = np.flatnonzero(np.diff(terms[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            chosen = order[a:b]
            items, times = self.index.lists[terms[chosen[0]]]
            # A document has a term once, and a list an item once, so no cell is met twice.
            scores[np.ix_(owner[chosen], items)] += parts[chosen][:, None] * times
        for d, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.least))):
            heap, doc_id = self.held[item], ids[d]
            entry = (int(scores[d, item]), doc_id is not None, -(doc_id or 0))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple]:
        for (item, name), heap in zip(self.index.items, self.held):
            for score, known, doc_id in heap:
                yield item, name, -doc_id if known else None, score


_FOUND = "item_id long, name long, doc_id long, score long, task int"


def _searched(counted: DataFrame, index: Index, weights: np.ndarray, documents: int, terms: int, top: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(index, top)
        step = max(1, min(_ROWS, _SCORES // len(index.items)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids, sizes, held, times = batch.slice(at, step).columns
                begin = np.cumsum([0, *held.value_lengths().to_pylist()])
                flat, tf = held.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
                lengths = np.repeat(sizes.to_numpy(), np.diff(begin))
                heaps.add(ids.to_pylist(), begin, flat, shares(tf, lengths, weights[flat], documents, terms))
        task = TaskContext.get().partitionId()
        rows = list(zip(*((*row, task) for row in heaps.rows()))) or [[]] * 5
        types = [pa.int64()] * 4 + [pa.int32()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, types)], names=["item_id", "name", "doc_id", "score", "task"])

    return counted.mapInArrow(search, _FOUND)


def _merged(found: DataFrame, tasks: int, top: int) -> DataFrame:
    """The best of all tasks for each item, with ranks from 1."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "task"]
    while tasks > FAN_IN:
        found = found.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
        best = F.row_number().over(Window.partitionBy("item_id", "name", "task").orderBy(*order))
        found = found.withColumn("rank", best).where(F.col("rank") <= top).drop("rank")
        tasks = -(-tasks // FAN_IN)
    rank = F.row_number().over(Window.partitionBy("item_id", "name").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, documents: DataFrame, top: int = TOP, index_terms: int = INDEX_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` documents of each item (item_id, text) whose score is above 0."""
    spark = documents.sparkSession
    result = None
    totals = None
    for index in _blocks(common.saved(_item_terms(items)), index_terms):
        folder = common.new_folder(spark, "term-counts")
        _counted(documents, index.terms).write.parquet(folder)
        counted = spark.read.schema("doc_id long, n long, terms array<int>, tf array<int>").parquet(folder)
        totals = totals or counted.agg(F.count("*"), F.sum("n")).first()
        if not totals[0]:
            break
        holding = np.zeros(len(index.terms), dtype=np.int64)
        for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            holding[row.t] = row["count"]
        weights = np.array([weight(totals[0], int(c)) for c in holding], dtype=np.int64)
        found = _searched(counted, index, weights, totals[0], totals[1], top)
        found = _merged(found, counted.rdd.getNumPartitions(), top)
        result = found if result is None else result.unionAll(found)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result


def benchmark_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 20 best of all documents for each benchmark item."""
    return search(common.table(spark, sf_dir, "benchmark"), common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS terms
  FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs
), held AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) AS t GROUP BY d, term
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(list_filter(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark) AS b) AS t
  GROUP BY item_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term) AS h, totals
), scores AS (
  SELECT a.item_id, h.d, CAST(sum(a.times * w.w * ((1000000000 * h.tf)
    // (1000 * h.tf + 12 * (75 + (25 * s.n * totals.docs) // totals.words)))) AS BIGINT) AS score
  FROM asked AS a JOIN held AS h ON h.term = a.term JOIN weights AS w ON w.term = a.term JOIN docs AS s ON s.d = h.d, totals
  GROUP BY a.item_id, h.d
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, scores.d) AS place
  FROM scores JOIN docs ON docs.d = scores.d WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""
