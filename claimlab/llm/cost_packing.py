"""Cost-balanced packing of documents into training sequences of a fixed number of tokens.

Attention inside a document costs about `linear * n + quadratic * n**2` for a piece of n tokens, so sequences
of equal length can cost very different amounts. Documents are encoded where they lie and gathered into groups
of whole sequences (the last document of a group is cut so that the group's tokens fill its sequences). Within
a group, stretches of a full sequence stand alone; the other pieces go, from the most costly down, to the
sequence of lowest cost that still has room. A piece that fits nowhere any more fills the roomiest sequence
and goes on as a shorter piece. So every sequence is full, and only the last group of a task leaves a
remainder, which becomes sequences of power-of-two lengths that need no padding either.

No row is shuffled and no task holds more than one group and one document beside it.

Defined results: null or empty text is a document of its end id alone; repeated rows are packed each; columns
other than doc_id and text are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.llm import common
from claimlab.llm.library_encoding import MEMORY, encoder

SEQUENCE_TOKENS = 2048
GROUP_SEQUENCES = 512
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"
_ROWS = 2_000


def packed(
    documents: DataFrame,
    tokenizer: str,
    end_id: int,
    sequence_tokens: int = SEQUENCE_TOKENS,
    group_sequences: int = GROUP_SEQUENCES,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    memory: int = MEMORY,
) -> DataFrame:
    """Pieces of documents with their sequence and place in it; `ids` are little-endian 32-bit integers.

    `memory` bounds the text pieces whose ids a worker remembers.

    Sequence ids are unique over all tasks: the task's number in the upper half, a count in the lower.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, memory).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        group = _Group(TaskContext.get().partitionId() << 32, sequence_tokens, group_sequences, linear, quadratic)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    yield from group.add(doc_id, ids + end)
        yield from group.rest()
        common.give_back()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, _PIECES)


def assign(lengths: np.ndarray, capacities: np.ndarray, linear: float, quadratic: float) -> list[tuple]:
    """Place pieces, longest first, as (piece, start in it, length, sequence, offset).

    The lengths must add up to the capacities, which are then filled.
    """
    room, cost = capacities.astype(np.int64), np.zeros(len(capacities))
    placed = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[piece])
        while left:
            fits = room >= left
            sequence = int(np.argmin(np.where(fits, cost, np.inf)))
            size = left
            if not fits[sequence]:
                sequence = int(np.argmax(room))
                size = int(room[sequence])
            placed.append((piece, start, size, sequence, int(capacities[sequence] - room[sequence])))
            room[sequence] -= size
            cost[sequence] += linear * size + quadratic * size * size
            start, left = start + size, left - size
    return placed


def powers_of_two(tokens: int) -> list[int]:
    """The lengths, largest first, into which a remainder of fewer than a sequence's tokens is divided."""
    return [1 << bit for bit in range(tokens.bit_length() - 1, -1, -1) if tokens >> bit & 1]


class _Group:
    """Gathers the documents of one task until they fill `sequences` sequences, then packs them."""

    def __init__(self, first_id: int, tokens: int, sequences: int, linear: float, quadratic: float):
        self.next_id, self.tokens, self.target = first_id, tokens, tokens * sequences
        self.linear, self.quadratic = linear, quadratic
        self.held: list[tuple] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[pa.RecordBatch]:
        """A document's ids go in as stretches (doc_id, start, ids, doc_tokens) that end where groups do."""
        count, start = len(ids) // 4, 0
        while start < count:
            size = min(count - start, self.target - self.total)
            self.held.append((doc_id, start, ids[4 * start : 4 * (start + size)], count))
            self.total, start = self.total + size, start + size
            if self.total == self.target:
                yield self._packed()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._packed()

    def _packed(self) -> pa.RecordBatch:
        full, remainder = divmod(self.total, self.tokens)
        capacities = [self.tokens] * full + powers_of_two(remainder)
        rows, pieces = [], []
        for stretch in self.held:
            size = len(stretch[2]) // 4
            whole = size - size % self.tokens
            for at in range(0, whole, self.tokens):
                rows.append(self._row(stretch, at, self.tokens, len(rows), 0))
            if size > whole:
                pieces.append((stretch, whole, size - whole))
        open_capacities = np.array(capacities[len(rows) :], dtype=np.int64)
        first, lengths = len(rows), np.array([p[2] for p in pieces], dtype=np.int64)
        for piece, start, size, sequence, offset in assign(lengths, open_capacities, self.linear, self.quadratic):
            stretch, at, _ = pieces[piece]
            rows.append(self._row(stretch, at + start, size, first + sequence, offset))
        self.next_id, self.held, self.total = self.next_id + len(capacities), [], 0
        names = [field.split()[0] for field in _PIECES.split(", ")]
        types = [pa.int64()] * 6 + [pa.float64(), pa.binary()]
        return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    def _row(self, stretch: tuple, at: int, size: int, sequence: int, offset: int) -> tuple:
        doc_id, start, ids, count = stretch
        cost = self.linear * size + self.quadratic * size * size
        return doc_id, start + at, size, count, self.next_id + sequence, offset, cost, ids[4 * at : 4 * (at + size)]


def pack_documents(documents: DataFrame, memory: int = MEMORY) -> DataFrame:
    """The registered parameters: the 49k word vocabulary, end id 1, sequences of 2048 tokens."""
    pieces = packed(documents, common.tokenizer_path("word_bpe_49k.json"), end_id=1, memory=memory)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost"
    )


def packing_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
