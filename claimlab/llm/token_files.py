"""Token ids of documents in files of one concatenated id array with Elias-Fano coded document boundaries.

A file image is

    magic  id width  null ids  tokens  end of ids | ids | document ends | document ids

where `ids` is the id array of all documents one after the other (16 bits each if the vocabulary allows), and
the two sequences are Elias-Fano coded: the end of each document in the array, and the documents' ids in
ascending order. Images hold at most about `FILE_TOKENS` tokens, except for a single longer document.

Images are the rows of a Parquet dataset: Spark's writers commit them, so a lost executor leaves no half-written
file, and any store that Spark reads will do. Rows are dealt out by ranges of doc_id, each range is sorted, and
a running total over the images' sizes (not over documents) gives every image its place in the whole array.

Defined results: null text is an empty document (its end id only); null doc_ids come first; equal doc_ids are
separate documents, ordered by their ids; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.llm import common, elias_fano
from claimlab.llm.library_encoding import encoder

FILE_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sBQQQ")
_MAGIC = b"EFTK"
_FILES = "part int, file int, n_docs long, n_tokens long, image binary"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
_ROWS = 2_000


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Encode, append `end_id` to each document, write the images to `folder`; returns the written dataset."""
    by_range = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        build = _Images(TaskContext.get().partitionId(), file_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    if full := build.add(doc_id, ids + end):
                        yield full
        yield from build.rest()
        common.give_back()

    # Equal doc_ids meet in a range; their order there is settled by the text.
    ordered = by_range.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(images, _FILES).write.mode("errorifexists").parquet(folder)
    return documents.sparkSession.read.schema(_FILES).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the files: doc_id, start in the whole array, n_tokens, ids as little-endian 32-bit integers."""
    files = spark.read.schema(_FILES).parquet(folder)
    place = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(place), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, image in zip(batch.column("base").to_pylist(), batch.column("image")):
                yield from _documents(TokenImage(image.as_buffer()), base)

    return files.join(starts, ["part", "file"]).select("base", "image").mapInArrow(documents, _DOCUMENTS)


class TokenImage:
    """One file image; documents are found by select, without a table of offsets."""

    def __init__(self, data):
        data = memoryview(data)
        magic, width, self.nulls, self.tokens, size = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        self.ids = np.frombuffer(data[_HEAD.size : _HEAD.size + size], dtype=f"<u{width}")
        self.ends = elias_fano.EliasFano(data[_HEAD.size + size :])
        self.doc_ids = elias_fano.EliasFano(data[_HEAD.size + size + self.ends.size :])

    def __len__(self) -> int:
        return len(self.ends)

    def __getitem__(self, index: int) -> tuple[int | None, np.ndarray]:
        start = self.ends.select(index - 1) if index else 0
        doc_id = self.doc_ids.select(index - self.nulls) if index >= self.nulls else None
        return doc_id, self.ids[start : self.ends.select(index)]


def _image(doc_ids: list[int | None], parts: list[bytes]) -> tuple[bytes, int]:
    ids = np.frombuffer(b"".join(parts), dtype="<u4")
    if len(ids) == 0 or ids.max() < 1 << 16:
        ids = ids.astype("<u2")
    ends = np.cumsum([len(p) // 4 for p in parts])
    known = [d for d in doc_ids if d is not None]
    head = _HEAD.pack(_MAGIC, ids.itemsize, len(doc_ids) - len(known), len(ids), ids.nbytes)
    return head + ids.tobytes() + elias_fano.encode(ends) + elias_fano.encode(np.array(known, np.int64)), len(ids)


class _Images:
    """Gathers the documents of one task and cuts them into images."""

    def __init__(self, part: int, file_tokens: int):
        self.part, self.file_tokens, self.file = part, file_tokens, 0
        self.doc_ids: list[int | None] = []
        self.parts: list[bytes] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> pa.RecordBatch | None:
        full = None
        if self.parts and self.tokens + len(ids) // 4 > self.file_tokens:
            full = self._cut()
        self.doc_ids.append(doc_id)
        self.parts.append(ids)
        self.tokens += len(ids) // 4
        return full

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield self._cut()

    def _cut(self) -> pa.RecordBatch:
        image, tokens = _image(self.doc_ids, self.parts)
        row = [[self.part], [self.file], [len(self.parts)], [tokens], [image]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        self.file, self.doc_ids, self.parts, self.tokens = self.file + 1, [], [], 0
        names = ["part", "file", "n_docs", "n_tokens", "image"]
        return pa.record_batch([pa.array(v, t) for v, t in zip(row, types)], names=names)


def _documents(image: TokenImage, base: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: select finds where a block begins, and only its own boundaries are decoded."""
    for at in range(0, len(image), _ROWS):
        end = image.ends.part(at, at + _ROWS)
        begin = np.concatenate([[image.ends.select(at - 1) if at else 0], end[:-1]]).astype(np.int64)
        nulls = max(0, min(image.nulls - at, len(end)))
        known = image.doc_ids.part(at + nulls - image.nulls, at + len(end) - image.nulls)
        doc_ids = pa.array([None] * nulls + known.tolist(), pa.int64())
        content = image.ids[begin[0] : end[-1]].astype("<u4")
        offsets = np.concatenate([begin[:1], end]) - begin[0]
        ids = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(end), [None, pa.py_buffer(4 * offsets.astype(np.int64)), pa.py_buffer(content)]
        ).cast(pa.binary())
        columns = [doc_ids, pa.array(begin + base), pa.array(end - begin), ids]
        yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids"])


def token_file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write all documents with the 50k byte-level vocabulary and read them back."""
    folder = common.new_folder(spark, "token-files")
    write_token_files(
        common.table(spark, sf_dir, "documents"), folder, common.tokenizer_path("byte_bpe_50k.json"), end_id=2
    )
    documents = read_token_files(spark, folder)
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
