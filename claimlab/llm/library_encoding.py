"""Token ids by the tokenizers library, with a bounded memory of pieces between spaces.

A text is split at line ends and spaces, each distinct piece is encoded once and remembered, and a text's ids
are the joined ids of its pieces. For a byte-level vocabulary a piece carries the space before it; that split
is safe unless two white-space characters meet, and such texts are encoded whole. A vocabulary that drops
white space never joins characters across a space, so every text can be split.

Pieces not yet known go to the library joined by spaces, many at a time, and the ids are cut apart again:
at tokens that begin with a space, or at a separator that stands between the pieces. A full stop or comma
after a letter or digit is a pre-token of its own in both kinds, so it is put behind the ids of the word. Where case
does not count, words of Latin letters go to the library in lower case and without the steps that change nothing then.

The ids are those the library gives by default, also where a text spells one of the vocabulary's special tokens:
such a text, and any that holds what all these tokens begin with, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np

from claimlab.llm import common

# Pieces in each of the two generations that are remembered, and the characters of the longest of them: a piece of
# text without spaces can be a whole line.
MEMORY = 400_000
LONGEST = 64
# Characters that go to the library in one call.
CALL_CHARS = 2_000

_MEETING = re.compile(r"\s\s")
_SEPARATOR = "\x01"
WORD_END = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzäöüßáéíóúñàâçèêëîïôùû")


def pack_ids(ids: Sequence[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Recent:
    """A mapping that keeps what was used lately: two generations, the older dropped when the newer is full.

    Keys longer than `LONGEST` are held for one block only, so entries of a limited size bound the memory.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict = {}
        self.old: dict = {}
        self.passing: list = []

    def missing(self, keys: Iterable) -> list:
        """The distinct keys that are not known; those that are known are in the newer generation afterwards."""
        unknown = []
        for key in set(keys).difference(self.new):
            value = self.old.get(key)
            if value is None:
                unknown.append(key)
            else:
                self.new[key] = value
        return unknown

    def add(self, keys: Sequence, values: Iterable) -> None:
        self.new.update(zip(keys, values))
        self.passing.extend(key for key in keys if len(key) > LONGEST)

    def age(self) -> None:
        """Called between blocks, so that the keys of a block are all held while it is put together."""
        for key in self.passing:
            self.new.pop(key, None)
        self.passing.clear()
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}


class PieceEncoder:
    def __init__(
        self, encode_one: Callable, encode_many: Callable, encode_heads: Callable, keeps_space: bool, limit: int = MEMORY,
        lowers: bool = False, special: Callable[[str], bool] = lambda text: False,
    ):
        """`encode_one` gives the ids of a string as bytes, the others those of several pieces within or before a line.

        `lowers` says that the vocabulary lowers A to Z, `special` which texts must go to the library whole.
        """
        self.encode_one, self.encode_many, self.encode_heads = encode_one, encode_many, encode_heads
        self.keeps_space, self.lowers, self.special = keeps_space, lowers, special
        self.first = Recent(limit // 4)
        self.rest = Recent(limit)
        self.mark = {c: encode_one(c) for c in ".,"}
        self.line_end = encode_one("\n")

    def encode(self, texts: Sequence[str | None], block: int = 256) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers; null is empty."""
        one_block = self._with_spaces if self.keeps_space else self._without_spaces
        for at in range(0, len(texts), block):
            yield from one_block(texts[at : at + block])
            self.rest.age()
            self.first.age()

    def _without_spaces(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        def parts(text: str) -> list[str]:
            return (text.lower() if self.lowers and text.isascii() else text).replace("\n", " ").split(" ")

        split = [[] if not t else t if self.special(t) else parts(t) for t in texts]
        self._learn(self.rest, chain.from_iterable(p for p in split if isinstance(p, list)), self.encode_many)
        known = self.rest.new.__getitem__
        for found in split:
            yield self.encode_one(found) if isinstance(found, str) else b"".join(map(known, found))

    def _with_spaces(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        split = [
            t if t and (_MEETING.search(t) or self.special(t)) else [line.split(" ") for line in t.split("\n")] if t else [] for t in texts
        ]
        lists = [line for lines in split if isinstance(lines, list) for line in lines]
        self._learn(self.first, (line[0] for line in lists), self.encode_heads)
        self._learn(self.rest, chain.from_iterable(line[1:] for line in lists), self.encode_many)
        first, rest = self.first.new.__getitem__, self.rest.new.__getitem__
        for lines in split:
            if isinstance(lines, str):
                yield self.encode_one(lines)
            else:
                yield self.line_end.join([first(line[0]) + b"".join(map(rest, line[1:])) for line in lines])

    def _learn(self, memory: Recent, pieces: Iterable[str], encode: Callable) -> None:
        unknown = memory.missing(pieces)
        if not unknown:
            return
        stemmed = [p for p in unknown if len(p) > 1 and p[-1] in ".," and p[-2] in WORD_END]
        words = memory.missing(p[:-1] for p in stemmed)
        plain = list({*unknown}.difference(stemmed).union(words))
        memory.add(plain, encode(plain))
        known = memory.new
        memory.add(stemmed, [known[p[:-1]] + self.mark[p[-1]] for p in stemmed])


def encoder(path: str, memory: int = MEMORY) -> PieceEncoder:
    """The encoder of a tokenizer file, kept in each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def build() -> PieceEncoder:
        from tokenizers import Tokenizer

        return library_encoder(Tokenizer.from_file(path), memory)

    return common.kept_in_worker(("library", path, memory), build)


def is_latin(piece: str) -> bool:
    """Letters below U+0250 that stay so in lower case; no normal form changes them."""
    return piece.isalpha() and (piece.isascii() or max(piece.lower()) < "\u0250")


def letters_only(library):
    """The library's tokenizer over the same model without normaliser and pattern, for words that are `is_latin` and
    in lower case, between spaces. None if it does not give the same ids for each of these letters."""
    from tokenizers import Tokenizer, pre_tokenizers

    plain = Tokenizer(library.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    letters = [c for c in map(chr, range(0x250)) if is_latin(c)]
    for mark in (" ", ""):
        text = mark.join(letters)
        if plain.encode(text.lower(), add_special_tokens=False).ids != library.encode(text, add_special_tokens=False).ids:
            return None
    return plain


def library_encoder(library, memory: int = MEMORY) -> PieceEncoder:
    def ids_of(text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode_one(text: str) -> bytes:
        return ids_of(text).tobytes() if text else b""

    keeps_space = ids_of("a b").tolist() != ids_of("a  b").tolist()
    lowers = all(encode_one(c) == encode_one(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    tokens = [token.content for token in library.get_added_tokens_decoder().values()]
    begin = os.path.commonprefix([token.lower() for token in tokens])

    def special(text: str) -> bool:
        if not tokens:
            return False
        # Tokens can match the text as it is or as it is normalised.
        return begin in (text if begin.upper() == begin else text.lower())

    size = library.get_vocab_size()
    begins = np.zeros(size, dtype=bool)
    if keeps_space:
        begins[[i for token, i in library.get_vocab().items() if token.startswith("Ġ")]] = True
    def separately(pieces: list[str], mark: str, before: str, cut: Callable) -> Iterator[bytes]:
        """Calls `cut` for some pieces at a time; those that could run into their neighbours go alone."""
        held: list[str] = []
        chars = 0
        results: dict[str, bytes] = {}
        for piece in pieces:
            if not piece or mark in piece or piece.strip() != piece:
                results[piece] = encode_one(before + piece)
                continue
            held.append(piece)
            chars += len(piece)
            if chars >= CALL_CHARS:
                results.update(zip(held, cut(held)))
                held, chars = [], 0
        if held:
            results.update(zip(held, cut(held)))
        return map(results.__getitem__, pieces)

    def pieces_of(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: list[str], before: str) -> list[bytes]:
        if len(starts) != len(pieces):
            return [encode_one(before + p) for p in pieces]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]

    def spaced(pieces: list[str]) -> list[bytes]:
        ids = ids_of(" " + " ".join(pieces))
        starts = np.flatnonzero(begins[ids])
        return pieces_of(ids, starts, np.append(starts[1:], len(ids)), pieces, " ")

    def marked(text: str, mark: int, pieces: list[str]) -> list[bytes]:
        ids = ids_of(text)
        marks = np.flatnonzero(ids == mark)
        return pieces_of(ids, marks[:-1] + 1, marks[1:], pieces, "")

    if keeps_space:
        line_end = ids_of("\n")

        def heads(pieces: list[str]) -> list[bytes]:
            return marked("\n".join(["", *pieces, "x"]), line_end[0], pieces)

        return PieceEncoder(
            encode_one,
            lambda pieces: separately(pieces, " ", " ", spaced),
            lambda pieces: separately(pieces, "\n", "", heads),
            True,
            memory,
            special=special,
        )

    separator = ids_of(_SEPARATOR)

    def between(pieces: list[str]) -> list[bytes]:
        return marked(f" {_SEPARATOR} ".join(["", *pieces, ""]), separator[0], pieces)

    ends = np.zeros(size, dtype=bool)
    ends[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True

    plain = letters_only(library)
    call = 200  # words in a call

    def letters(pieces: list[str]) -> Iterator[bytes]:
        for at in range(0, len(pieces), call):
            part = pieces[at : at + call]
            ids = np.array(plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(ends[ids]) + 1
            yield from pieces_of(ids, np.append(0, stops[:-1]), stops, part, "")

    def words(pieces: list[str]) -> Iterator[bytes]:
        # Latin letters are one pre-token, whose last id ends a word, so they need no separator.
        folded = {p: p.lower() for p in pieces if is_latin(p)} if plain else {}
        simple = list(set(folded.values()))
        known = dict(zip(simple, letters(simple)))
        found = {p: known[small] for p, small in folded.items()}
        rest = [p for p in pieces if p not in folded]
        found.update(zip(rest, separately(rest, _SEPARATOR, "", between)))
        return map(found.__getitem__, pieces)

    return PieceEncoder(encode_one, words, words, False, memory, lowers, special)
