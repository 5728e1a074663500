"""Packing of whole documents into sequences by bounded-space online best fit.

Documents are placed as they come, each once. Every task keeps a fixed number of open sequences. A bitset has a bit
for each free space that some open sequence has, so the sequence that a document fills best is the lowest set bit
at or above its length. If none has room, the fullest open sequence closes (when as many as allowed are open) and
a new one opens. Only a document longer than a sequence is cut: its full pieces are sequences of their own and the
last piece is placed like a document.

A piece's place is known when it is placed, so rows stream on and an open sequence is two numbers. No row is
shuffled. Every task leaves its open sequences as they are, so the space lost grows with the number of tasks and
not with the input; a sequence that is open at the end is one of a task's thousands.

Defined results: null or empty text is a document of its end id alone; repeated rows are packed each, also those
without doc_id; columns other than doc_id and text are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.llm import common
from claimlab.llm.library_encoding import MEMORY, encoder

SEQUENCE_TOKENS = 4096
OPEN_SEQUENCES = 4096
_ROWS = 2_000
_PIECES = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"


class OpenSequences:
    """At most `limit` open sequences of `tokens` tokens, found by the space they have left."""

    def __init__(self, tokens: int = SEQUENCE_TOKENS, limit: int = OPEN_SEQUENCES, first: int = 0):
        self.tokens, self.limit, self.next = tokens, limit, first
        self.bits = 0  # bit f is set if a sequence with f tokens of free space is open
        self.by_space: list[list[int]] = [[] for _ in range(tokens + 1)]
        self.count = 0

    def _take(self, space: int) -> int:
        held = self.by_space[space]
        sequence = held.pop()
        if not held:
            self.bits ^= 1 << space
        self.count -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it of a piece of 1 to `tokens` tokens."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.tokens, self.next
            self.next += 1
            if length < space and self.count >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = space - length
        if left:
            if not self.by_space[left]:
                self.bits |= 1 << left
            self.by_space[left].append(sequence)
            self.count += 1
        return sequence, self.tokens - space


def pieces_of(count: int, tokens: int) -> Iterator[tuple[int, int, int]]:
    """Number, start and length of the pieces of a document."""
    for piece, start in enumerate(range(0, count, tokens)):
        yield piece, start, min(tokens, count - start)


def packed(
    documents: DataFrame,
    tokenizer: str,
    end_id: int,
    sequence_tokens: int = SEQUENCE_TOKENS,
    open_sequences: int = OPEN_SEQUENCES,
    memory: int = MEMORY,
) -> DataFrame:
    """Pieces with their sequence and place in it; `ids` are little-endian 32-bit integers.

    Sequence ids are unique over all tasks: the task's number in the upper half, a count in the lower.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, memory).encode
        end = end_id.to_bytes(4, "little")
        held = OpenSequences(sequence_tokens, open_sequences, TaskContext.get().partitionId() << 32)
        names = [part.split()[0] for part in _PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part, rows = batch.slice(at, _ROWS), []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    for piece, start, length in pieces_of(len(ids) // 4, sequence_tokens):
                        rows.append((doc_id, piece, start, length, *held.place(length), ids[4 * start : 4 * (start + length)]))
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
        common.give_back()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, _PIECES)


def packing_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents: the 49k word vocabulary, end id 1, sequences of 4096 tokens."""
    documents = common.table(spark, sf_dir, "documents")
    pieces = packed(documents, common.tokenizer_path("word_bpe_49k.json"), end_id=1)
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
