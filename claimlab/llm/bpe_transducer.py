"""Byte-level BPE by a finite-state transducer, and streaming decode by an incremental UTF-8 state machine.

A sequence of tokens is the BPE encoding of its bytes exactly when each neighbouring pair is the encoding of
its own bytes, provided only tokens that the merges can produce take part. So each prefix of a string has one
encoding. Reading bytes, a non-deterministic transducer keeps a branch for every earlier boundary from which a
token can still be running: the last token before that boundary and the place in the trie of token bytes. A
state of the determinised transducer is the set of these branches, and each of its transitions gives the last
token of the prefix read so far. Those tokens form a chain back to the start; what all branches of a state
share of it is final and is emitted, so output lags by a bounded number of bytes. States and transitions are
made when a text first needs them and forgotten when there are too many.

Short pre-tokens are read side by side: a block's different prefixes of one length are states, each byte that
follows one is a transition, and all transitions of a length are made at once, as arrays of branches.

Defined results: null text is empty; repeated rows are encoded each; columns other than doc_id and text are not
read. Decoding gives back the text's bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.llm import common
from claimlab.llm.library_encoding import WORD_END, Recent

# Determinised states kept at a time.
STATES = 100_000
# Checked pairs of tokens kept at a time.
PAIRS = 400_000
# Bytes of the longest pre-token that is read beside others, and how many are read so at a time.
ABREAST = 64
_BLOCK = 50_000
# Places a pair of tokens among the 2**20 slots of `Transducer.recent`.
_SPREAD, _SLOT_SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
# Pieces remembered in each of two generations.
MEMORY = 150_000
_ROWS = 500
# Characters of texts that are matched whole at a time.
_WHOLE_CHARS = 1_000_000

_one = struct.Struct("<I").pack


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges(piece: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[int, list[bytes]]]:
    """BPE by its definition: join the neighbours of lowest rank until none can be joined; each rank and state."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        yield best, parts


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    for _, parts in merges(piece, ranks):
        pass
    return parts


def edge_history(token: bytes, ranks: dict[bytes, int], side: int) -> list[tuple[float, bytes]]:
    """How the part at one edge of a token (side 0: left, -1: right) grows as the token is merged.

    Each entry is the highest rank that has to be merged before the edge changes, and the edge until then; the
    last entry is the whole token, which never changes.
    """
    edge, highest, history = token[:1] if side == 0 else token[-1:], -1, []
    for rank, parts in merges(token, ranks):
        highest = max(highest, rank)
        if parts[side] != edge:
            history.append((highest, edge))
            edge, highest = parts[side], -1
    history.append((float("inf"), edge))
    return history


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.compatible: dict[int, bool] = {}
        self.edges: dict[int, dict[int, list[tuple[float, bytes]]]] = {0: {}, -1: {}}
        for token, rank in ranks.items():
            # A token that its own bytes do not encode to never stands in an encoding of more than one token.
            if len(token) > 1 and merge_bytes(token, ranks) != [token]:
                continue
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.children.get(key, 0)
                if not node:
                    node = self.children[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        parents = {key >> 8 for key in self.children}
        self.leaf = [node not in parents for node in range(len(self.token_at))]
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.arrays: tuple[np.ndarray, ...] = ()
        self.recent = np.full(1 << 20, -1 << 62)
        self.depths: list[int] = []
        self._forget()

    def _forget(self) -> None:
        # A branch is (token before the boundary + 1) << 32 | node of the trie; the oldest comes first.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.index = {(0,): 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        fits = self.compatible.get(key)
        if fits is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            fits = self.compatible[key] = self._never_join(self._edge(left, -1), self._edge(right, 0))
        return fits

    def _edge(self, token: int, side: int) -> list[tuple[float, bytes]]:
        edges = self.edges[side]
        if token not in edges:
            edges[token] = edge_history(self.bytes_of[token], self.ranks, side)
        return edges[token]

    def _never_join(self, left: list[tuple[float, bytes]], right: list[tuple[float, bytes]]) -> bool:
        """Whether the parts on both sides of a boundary change before the merge across it has its turn.

        Of two equal merges the one further left comes first.
        """
        i = j = 0
        while True:
            (left_rank, a), (right_rank, b) = left[i], right[j]
            across = self.ranks.get(a + b)
            if across is not None and across < left_rank and across <= right_rank:
                return False
            if left_rank == right_rank == float("inf"):
                return True
            if left_rank <= right_rank:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Advance every branch by a byte and open the branch of the token that ends here."""
        children, token_at, leaf = self.children, self.token_at, self.leaf
        alive, ended = [], -1
        for branch in self.states[state]:
            child = children.get((branch & 0xFFFFFFFF) << 8 | byte)
            if child is None:
                continue
            before = branch >> 32
            if ended < 0:
                token = token_at[child]
                if token >= 0 and (not before or self._fits(before - 1, token)):
                    ended = token
            if not leaf[child]:
                alive.append(before << 32 | child)
        alive.append(ended + 1 << 32)
        key = tuple(alive)
        target = self.index.get(key)
        if target is None:
            target = self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][byte] = step = target, ended
        return step

    def _chain(self, last: list[int], end: int, start: int = 0) -> list[int]:
        """The tokens that cover bytes `start` to `end`, following last tokens backwards."""
        ids = []
        while end > start:
            token = last[end - 1]
            ids.append(token)
            end -= self.length[token]
        ids.reverse()
        return ids

    def _settled(self, last: list[int], state: int, position: int, start: int) -> int:
        """The latest boundary on the chains of all branches of a state."""
        depths = [self.depth(branch & 0xFFFFFFFF) for branch in self.states[state]]
        ends = {position - depth for depth in depths}
        while len(ends) > 1:
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(furthest - self.length[last[furthest - 1]] if furthest > start else start)
        return ends.pop()

    def depth(self, node: int) -> int:
        if not self.depths:
            self.depths = [0] * len(self.token_at)
            for key, child in self.children.items():
                self.depths[child] = self.depths[key >> 8] + 1
        return self.depths[node]

    def stream(self, piece: bytes, lag: int = 1024) -> Iterator[int]:
        """Token ids of one pre-token, emitted while it is read."""
        whole = self.ranks.get(piece)
        if whole is not None:
            yield whole
            return
        if len(self.states) > self.limit:
            self._forget()
        last: list[int] = []
        start = state = 0
        for at in range(0, len(piece), lag):
            for byte in piece[at : at + lag]:
                state, token = self.steps[state].get(byte) or self._step(state, byte)
                last.append(token)
            settled = self._settled(last, state, len(last), start)
            yield from self._chain(last, settled, start)
            last, start = last[settled:], 0
        yield from self._chain(last, len(last))

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        if piece in self.ranks or len(piece) > 1024 or len(self.states) > self.limit:
            return list(self.stream(piece))
        last, state, steps = [], 0, self.steps
        for byte in piece:
            state, token = steps[state].get(byte) or self._step(state, byte)
            last.append(token)
        return self._chain(last, len(last))

    def encode_many(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed token ids of each of several different pre-tokens."""
        found, short = {}, []
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                found[piece] = _one(whole)
            elif len(data) <= ABREAST:
                short.append((data, piece))
            else:
                found[piece] = _packed(self.encode(data))
        short.sort()
        for at in range(0, len(short), _BLOCK):
            part, pieces = zip(*short[at : at + _BLOCK])
            found.update(zip(pieces, self._abreast(part)))
        return found

    def _abreast(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Reads different pre-tokens in ascending order, a byte of each at a time.

        Branches stand in the order of their states, the oldest of a state first.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(lengths) - lengths
        last = np.full(len(data), -1, np.int64)
        rows, state = np.arange(len(pieces)), np.zeros(len(pieces), np.int64)
        first, before, node = np.array([0, 1]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for at in range(int(lengths.max())):
            longer = lengths[rows] > at
            rows, state = rows[longer], state[longer]
            byte = data[starts[rows] + at]
            new = np.ones(len(rows), bool)
            new[1:] = (state[1:] != state[:-1]) | (byte[1:] != byte[:-1])
            source, byte, state = state[new], byte[new], np.cumsum(new) - 1
            ended, first, before, node = self._step_all(source, byte, first, before, node)
            last[starts[rows] + at] = ended[state]
        return self._chains(last, starts, starts + lengths)

    def _step_all(self, source, byte, first, before, node) -> tuple[np.ndarray, ...]:
        """`_step` from each `source` state by its byte: the tokens that end, and the branches of the new states."""
        keys, children, token_at, leaf = self._as_arrays()
        counts = first[source + 1] - first[source]
        owner = np.repeat(np.arange(len(source)), counts)
        branch = np.arange(len(owner)) + np.repeat(first[source] - np.cumsum(counts) + counts, counts)
        key = node[branch] << 8 | byte[owner]
        place = np.searchsorted(keys, key)
        alive = np.flatnonzero(keys[place] == key)
        owner, before, child = owner[alive], before[branch[alive]], children[place[alive]]
        token = token_at[child]
        ended = np.full(len(source), -1, np.int64)
        open_ = np.flatnonzero(token >= 0)
        while len(open_):
            oldest = np.ones(len(open_), bool)
            oldest[1:] = owner[open_[1:]] != owner[open_[:-1]]
            tried = open_[oldest]
            fits = tried[self._fit_all(before[tried], token[tried])]
            ended[owner[fits]] = token[fits]
            open_ = open_[~oldest]
            open_ = open_[ended[owner[open_]] < 0]
        running = ~leaf[child]
        owner, before, child = owner[running], before[running], child[running]
        first = np.zeros(len(source) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(source)) + 1, out=first[1:])
        places = np.arange(len(owner)) + owner
        new_before, new_node = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
        new_before[places], new_node[places] = before, child
        new_before[first[1:] - 1] = ended + 1
        return ended, first, new_before, new_node

    def _fit_all(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`_fits` of each pair; a branch without a token before it fits any. `recent` has one pair and its answer a slot."""
        pair = before - 1 << 32 | token
        slot = (pair.astype(np.uint64) * _SPREAD >> _SLOT_SHIFT).astype(np.int64)
        held = self.recent[slot]
        fits = (held & 1).astype(bool)
        unknown = np.flatnonzero(held >> 1 != pair)
        pairs, back = np.unique(pair[unknown], return_inverse=True)
        fits[unknown] = np.array([p < 0 or self._fits(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], bool)[back]
        self.recent[slot[unknown]] = pair[unknown] << 1 | fits[unknown]
        return fits

    def _as_arrays(self) -> tuple[np.ndarray, ...]:
        """The trie's edges in ascending order with an end mark and their children; the tokens and leaves of nodes."""
        if not self.arrays:
            edges = sorted(self.children.items())
            keys, children = np.array([*edges, (1 << 62, 0)], np.int64).T.copy()
            self.arrays = keys, children, np.array(self.token_at, np.int64), np.array(self.leaf, bool)
        return self.arrays

    def _chains(self, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """`_chain` of each stretch of `last`, packed."""
        lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        lengths[list(self.length)] = list(self.length.values())
        rows, at, found = np.arange(len(starts)), ends, []
        while len(rows):
            token = last[at - 1]
            if (token < 0).any():
                raise KeyError(-1)
            found.append((rows, token))
            at = at - lengths[token]
            more = at > starts[rows]
            rows, at = rows[more], at[more]
        stops = np.cumsum(np.bincount(np.concatenate([r for r, _ in found]), minlength=len(starts)))
        ids = np.empty(stops[-1], "<u4")
        for back, (rows, token) in enumerate(found, 1):
            ids[stops[rows] - back] = token
        data, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class TextEncoder:
    """Splits texts by the pattern and encodes each match; pieces between spaces are remembered.

    A space before a character that is not white space always begins a match, so a text without neighbouring
    white-space characters can be cut there.
    """

    _MEETING = re.compile(r"\s\s")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.first, self.rest = Recent(MEMORY // 4), Recent(MEMORY)
        self.line_end = self.encode_one("\n")
        self.marks = {c: self.encode_one(c) for c in ".,"}

    def encode_one(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; pre-tokens that several of them hold are encoded once."""
        split = list(map(self.pattern.findall, texts))
        known = self.transducer.encode_many({match for found in split for match in found}).__getitem__
        return [known(found[0]) if len(found) == 1 else b"".join(map(known, found)) for found in split]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        split = []
        for text in texts:
            if text and self._MEETING.search(text):
                split.append(text)
            else:
                split.append([line.split(" ") for line in text.split("\n")] if text else [])
        wholes = self._wholes([text for text in split if isinstance(text, str)])
        lists = [line for lines in split if isinstance(lines, list) for line in lines]
        self._learn(self.first, [line[0] for line in lists], "")
        self._learn(self.rest, [piece for line in lists for piece in line[1:]], " ")
        first, rest = self.first.new.__getitem__, self.rest.new.__getitem__
        for lines in split:
            if isinstance(lines, str):
                yield next(wholes)
            else:
                yield self.line_end.join([first(line[0]) + b"".join(map(rest, line[1:])) for line in lines])
        self.first.age()
        self.rest.age()

    def _wholes(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, for as many texts at a time as have a limited length together."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= _WHOLE_CHARS:
                yield from self.encode_all(held)
                held, chars = [], 0
        yield from self.encode_all(held)

    def _learn(self, memory: Recent, pieces: list[str], before: str) -> None:
        # A full stop or comma after a letter or digit is a match of its own.
        unknown = memory.missing(pieces)
        stemmed = [p for p in unknown if len(p) > 1 and p[-1] in ".," and p[-2] in WORD_END]
        plain = [*{*unknown}.difference(stemmed).union(memory.missing(p[:-1] for p in stemmed))]
        memory.add(plain, self.encode_all([before + piece for piece in plain]))
        known = memory.new
        memory.add(stemmed, [known[p[:-1]] + self.marks[p[-1]] for p in stemmed])


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """The encoder of a rank file, compiled once in each worker process."""
    return common.kept_in_worker(("ranks", path, pattern), lambda: TextEncoder(read_ranks(path), pattern))


# UTF-8 leads by the number of bytes that must follow; other bytes follow or are wrong.
_FOLLOW = [0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11


class Utf8Stream:
    """Takes bytes as they come and gives out text up to the last whole character.

    The state is the unfinished character: at most three bytes.
    """

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        whole = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                if _FOLLOW[byte] >= back:
                    whole -= back
                break
        self.pending = data[whole:]
        return data[:whole].decode("utf-8")

    def close(self) -> str:
        """The end of the stream; an unfinished character is an error."""
        return self.pending.decode("utf-8")


class Decoder:
    """Text of token ids, a bounded run of tokens at a time."""

    def __init__(self, ranks: dict[bytes, int], run: int = 4096):
        self.run = run
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine, ids = Utf8Stream(), list(ids)
        for at in range(0, len(ids), self.run):
            yield machine.feed(b"".join(map(self.tokens.__getitem__, ids[at : at + self.run])))
        yield machine.close()

    def decode(self, ids: bytes) -> str:
        return "".join(self.stream(np.frombuffer(ids, dtype="<u4").tolist()))


def encoded(documents: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Adds `n_tokens` and `ids` (little-endian 32-bit integers) to doc_id; whole texts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids = list(encoder.encode(part.column(1).to_pylist()))
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.record_batch([part.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "doc_id long, n_tokens long, ids binary"
    )


def decoded(tokens: DataFrame, ranks_file: str) -> DataFrame:
    """Adds `decoded`, the text of `ids`, to doc_id, n_tokens and ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(ranks_file))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = pa.array(map(decoder.decode, part.column(2).to_pylist()), pa.string())
                yield pa.record_batch([*part.columns, texts], [*part.schema.names, "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(
        decode, "doc_id long, n_tokens long, ids binary, decoded string"
    )


def round_trip_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode and decode all documents with the multilingual rank file."""
    import public_tokenizers

    path = common.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    tokens = encoded(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decoded(tokens, path).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
