"""Language of words and texts by a linear-chain conditional random field.

A text's words (runs of letters, lower-cased) form a chain. The score of a language for a word is the sum of
the weights of its hashed character n-grams with marks at both ends, so those that touch a mark are its
prefixes and suffixes, and of a weight for the word itself if it is in the lexicon of words that the training
words repeat. The score of two neighbouring words' languages is a learned transition. Forward and backward
passes give each word's probability of each language given the whole text, which labels the words of
code-switched text; a text's score for a language is the mean over its words.

Training maximises the conditional likelihood on chains put together from stretches of documents in different
languages, so that transitions see switches. Bound of the sample: of each language (at most `LANGUAGES`, those with
the most sampled documents) `SAMPLE` different documents
(those with the smallest hash of id and text) and from each at most `STRETCHES` stretches of `STRETCH` words of
at most `LONGEST` letters, evenly spaced over the text. Training runs in one task over these stretches.

Defined results: null text and text without a letter is `und` with score 0; without a language to learn from
every text is; documents without lang are labelled like others but not learned from; repeated rows are labelled
each and learned from once; a null doc_id counts as held out; equal scores go to the language that sorts first. The stage drops only texts without a letter and texts
whose words have, on average, no probable language; without a model it keeps every text with a letter.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.llm import common
from claimlab.llm.library_encoding import Recent
from claimlab.llm.words import text_bytes

SAMPLE = 500
LANGUAGES = 200
LONGEST = 100
STRETCHES, STRETCH = 6, 24
NGRAMS = (1, 2, 3, 4)
BITS = 16
LEXICON = 20_000
CHAINS, CHAIN_STRETCHES = 1_500, 4
EPOCHS, BATCH, RATE, L2 = 6, 100, 0.25, 1e-5
# Bytes of text of one forward-backward block, and words in each of the two remembered generations.
BLOCK_BYTES = 1_000_000
MEMORY = 80_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the marked words, all words after each other, and where each word's begin."""
    marked = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint32) + 1
    lengths = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes from here to the word's end
    hashes, owners = [], []
    for size in NGRAMS:
        held = np.flatnonzero(left >= size)
        value = np.full(len(held), size, dtype=np.uint32)
        for k in range(size):
            value = value * np.uint32(0x01000193) + data[held + k] * _FACTORS[k]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        hashes.append(value >> np.uint32(32 - BITS))
        owners.append(owner[held])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    begin = np.searchsorted(owners[order], np.arange(len(words) + 1))
    return np.concatenate(hashes)[order].astype(np.int64), begin


@dataclass
class Crf:
    """`weights` has a row for each n-gram hash and then one for each lexicon word."""

    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each language for each word."""
        if not words:
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        features, begin = word_features(words)
        scores = np.add.reduceat(self.weights[features], begin[:-1], axis=0)
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            at, rows = np.array(known).T
            scores[at] += self.weights[(1 << BITS) + rows]
        return scores


def forward_backward(
    scores: np.ndarray, rows: np.ndarray, begin: np.ndarray, transitions: np.ndarray, starts: np.ndarray
) -> np.ndarray:
    """Probability of each label at each place of several chains at once.

    Place p has the scores of row `rows[p]`; chain c has places `begin[c]` to `begin[c + 1]`. Chains advance
    together, longest first, and leave when they end.
    """
    lengths = np.diff(begin)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = begin[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()  # chains longer than t
    scaled = np.exp(scores - scores.max(axis=1, keepdims=True))
    step, entry = np.exp(transitions), np.exp(starts)
    result = np.empty((len(rows), scores.shape[1]), dtype=scaled.dtype)
    state = np.empty((0, scores.shape[1]), dtype=scaled.dtype)
    for t in range(longest):
        places = first[: active[t]] + t
        state = scaled[rows[places]] * (state[: active[t]] @ step if t else entry)
        state /= state.sum(axis=1, keepdims=True)
        result[places] = state
    after = np.ones((len(lengths), scores.shape[1]), dtype=scaled.dtype)
    for t in range(longest - 1, -1, -1):
        count = active[t]
        places = first[:count] + t
        if t + 1 < longest:
            more = active[t + 1]
            ahead = after[:more] * scaled[rows[places[:more] + 1]]
            ahead = ahead @ step.T
            after[:more] = ahead / ahead.sum(axis=1, keepdims=True)
        both = result[places] * after[:count]
        result[places] = both / both.sum(axis=1, keepdims=True)
    return result


# --- Training ----------------------------------------------------------------------------------------------


def _sample(documents: DataFrame, sample: int) -> DataFrame:
    """lang, h and text of `sample` different rows of each language, those with the smallest hash of id and text.

    Only hashes are ranked; rows below a language's limit then combine by hash, so copies of a row count once.
    """
    hashed = documents.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "text"
    )
    # Copies of a row would fill the ranks, so `dense_rank` counts hashes.
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    least = hashed.select("lang", "h").withColumn("rank", rank).where(F.col("rank") <= sample)
    limits = least.groupBy("lang").agg(F.max("h").alias("limit"), F.max("rank").alias("rank"))
    # At most `LANGUAGES` rows of a name and two numbers, so the broadcast is bounded and no text moves by language.
    limits = F.broadcast(limits.orderBy(F.col("rank").desc(), "lang").limit(LANGUAGES).drop("rank"))
    chosen = hashed.join(limits, "lang").where("h <= limit")
    return chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = [w for w in words_of(text) if len(w) <= LONGEST]
            count = min(STRETCHES, -(-len(words) // STRETCH))
            for i in range(count):
                at = (len(words) - STRETCH) * i // max(1, count - 1) if count > 1 else 0
                rows.append((lang, h, i, words[max(0, at) : max(0, at) + STRETCH]))
        columns = list(zip(*rows)) or [[]] * 4
        types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "h", "i", "words"])


def _train(group: pa.Table) -> pa.Table:
    rows = sorted(group.select(["lang", "h", "i", "words"]).to_pylist(), key=lambda r: (r["lang"], r["h"], r["i"]))
    model = trained([(r["lang"], r["words"]) for r in rows])
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


def fitted(documents: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """The model learned, in one task, from documents that have a language; None if there is none."""
    rows = _sample(documents, sample).mapInArrow(_stretches, "lang string, h long, i int, words array<string>")
    # The sample's bound holds for what meets in the task; the model is all that comes back.
    models = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_train, "model binary").collect()
    return pickle.loads(models[0].model) if models else None


def trained(stretches: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 0) -> Crf:
    languages = sorted({lang for lang, _ in stretches})
    labels = {lang: i for i, lang in enumerate(languages)}
    counts = Counter(w for _, words in stretches for w in words)
    lexicon = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n > 1}
    vocabulary = {w: i for i, w in enumerate(counts)}
    features, begin = word_features(list(vocabulary))
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(begin))
    entries = np.array([(vocabulary[w], (1 << BITS) + i) for w, i in lexicon.items()], dtype=np.int64).reshape(-1, 2)
    owner = np.concatenate([owner, entries[:, 0]])
    features = np.concatenate([features, entries[:, 1]])
    order = np.argsort(owner, kind="stable")
    owner, features = owner[order], features[order]
    edges = np.searchsorted(owner, np.arange(len(vocabulary) + 1))

    size = len(languages)
    weights = np.zeros(((1 << BITS) + len(lexicon), size))
    transitions, starts = np.zeros((size, size)), np.zeros(size)
    squares = [np.full_like(x, 1e-6) for x in (weights, transitions, starts)]
    random = np.random.default_rng(seed)
    rows = [np.array([vocabulary[w] for w in words]) for _, words in stretches]
    marks = [labels[lang] for lang, _ in stretches]
    for _ in range(epochs):
        chains = [random.permutation(len(stretches))[:CHAIN_STRETCHES] for _ in range(CHAINS)]
        for at in range(0, CHAINS, BATCH):
            batch = chains[at : at + BATCH]
            words = np.concatenate([rows[i] for chain in batch for i in chain])
            truth = np.concatenate([np.full(len(rows[i]), marks[i]) for chain in batch for i in chain])
            begins = np.cumsum([0] + [sum(len(rows[i]) for i in chain) for chain in batch])
            used, local = np.unique(words, return_inverse=True)
            spans = np.concatenate([np.arange(edges[u], edges[u + 1]) for u in used])
            spans_begin = np.cumsum([0, *(edges[used + 1] - edges[used])])
            scores = np.add.reduceat(weights[features[spans]], spans_begin[:-1], axis=0)
            gradients = _gradients(scores, local, begins, truth, transitions, starts)
            by_feature = np.repeat(gradients[0], np.diff(spans_begin), axis=0)
            touched, place = np.unique(features[spans], return_inverse=True)
            summed = np.stack([np.bincount(place, by_feature[:, k], len(touched)) for k in range(size)], axis=1)
            summed += L2 * len(words) * weights[touched]
            squares[0][touched] += summed**2
            weights[touched] -= RATE * summed / np.sqrt(squares[0][touched])
            for value, square, gradient in zip((transitions, starts), squares[1:], gradients[1:]):
                square += gradient**2
                value -= RATE * gradient / np.sqrt(square)
    return Crf(languages, lexicon, weights.astype(np.float32), transitions.astype(np.float32), starts.astype(np.float32))


def _gradients(scores, rows, begin, truth, transitions, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood for word scores, transitions and starts."""
    size = scores.shape[1]
    node = forward_backward(scores, rows, begin, transitions, starts)
    first = begin[:-1]
    node_error = node.copy()
    node_error[np.arange(len(truth)), truth] -= 1
    by_word = np.stack([np.bincount(rows, node_error[:, k], len(scores)) for k in range(size)], axis=1)
    inner = np.ones(len(rows), dtype=bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    # Pair probabilities from node probabilities: P(a, b) is P(b) times P(a | b, what came before).
    forward = _forward(scores, rows, begin, transitions, starts)
    back = forward[later - 1][:, :, None] * np.exp(transitions)[None]
    back /= back.sum(axis=1, keepdims=True)
    pairs = (back * node[later][:, None, :]).sum(axis=0)
    np.subtract.at(pairs, (truth[later - 1], truth[later]), 1)
    return by_word, pairs, node_error[first].sum(axis=0)


def _forward(scores, rows, begin, transitions, starts) -> np.ndarray:
    """Normalised forward probabilities at each place."""
    lengths = np.diff(begin)
    scaled, step = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(transitions)
    result = np.empty((len(rows), scores.shape[1]))
    for t in range(int(lengths.max(initial=0))):
        places = begin[:-1][lengths > t] + t
        state = scaled[rows[places]] * (result[places - 1] @ step if t else np.exp(starts))
        result[places] = state / state.sum(axis=1, keepdims=True)
    return result


# --- Labelling ---------------------------------------------------------------------------------------------


class Labeller:
    """Labels texts in one worker process; scores of words seen lately are remembered."""

    def __init__(self, model: Crf):
        self.model, self.memory = model, Recent(MEMORY)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[list[int], list[list[str]], np.ndarray, np.ndarray]]:
        """Index of texts, their words, where each text's words begin, and each word's probabilities.

        Texts of similar length are taken together, about `BLOCK_BYTES` at a time.
        """
        _, bounds = text_bytes(texts)
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable").tolist()
        at = 0
        while at < len(order):
            total, end = int(sizes[order[at]]), at + 1
            while end < len(order) and total + sizes[order[end]] <= BLOCK_BYTES:
                total += int(sizes[order[end]])
                end += 1
            chosen = [(i, words_of(texts[i].as_py())) for i in order[at:end]]
            chosen = [(i, words) for i, words in chosen if words]
            if chosen:
                chains = [words for _, words in chosen]
                yield [i for i, _ in chosen], chains, *self._probabilities(chains)
            at = end

    def _probabilities(self, chains: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        vocabulary: dict[str, int] = {}
        number = vocabulary.setdefault
        rows = np.array([number(w, len(vocabulary)) for words in chains for w in words], dtype=np.int64)
        unknown = self.memory.missing(vocabulary)
        if unknown:
            self.memory.add(unknown, [row.tobytes() for row in self.model.emissions(unknown)])
        scores = np.frombuffer(b"".join(map(self.memory.new.__getitem__, vocabulary)), dtype=np.float32)
        self.memory.age()
        begin = np.cumsum([0, *map(len, chains)])
        scores = scores.reshape(len(vocabulary), -1)
        return begin, forward_backward(scores, rows, begin, self.model.transitions, self.model.starts)

    def text_scores(self, texts: pa.Array) -> np.ndarray:
        """The mean probability of each language; zero for texts without words."""
        result = np.zeros((len(texts), len(self.model.languages)))
        for chosen, _, begin, probabilities in self.blocks(texts):
            result[chosen] = np.add.reduceat(probabilities, begin[:-1], axis=0, dtype=np.float64) / np.diff(begin)[:, None]
        return result


_LABEL = "struct<lang_pred:string,score:double>"


def text_language(model: Crf | None, text: str = "text") -> Column:
    """The language of a text and its score, as a struct."""
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.arrow_udf(_labelling(model), _LABEL)(text)


def _labelling(model: Crf):
    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.keep_nothing()
        labeller = Labeller(model)
        for batch in texts:
            scores = labeller.text_scores(batch)
            best = scores.argmax(axis=1) if len(scores) else np.zeros(0, np.int64)
            high = np.clip(scores.max(axis=1), 0.0, 1.0) if len(scores) else np.zeros(0)
            names = [model.languages[b] if s > 0 else UNDETERMINED for b, s in zip(best, high)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(high, pa.float64())], ["lang_pred", "score"])
        del labeller
        common.keep_nothing()

    return label


def word_languages(documents: DataFrame, model: Crf) -> DataFrame:
    """doc_id and its words in order, each with its most likely language and that probability."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            held: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for chosen, chains, begin, probabilities in labeller.blocks(batch.column(1)):
                best, high = probabilities.argmax(axis=1), probabilities.max(axis=1)
                for c, i in enumerate(chosen):
                    span = zip(chains[c], best[begin[c] : begin[c + 1]], high[begin[c] : begin[c + 1]])
                    held[i] = [{"word": w, "lang": model.languages[b], "p": float(p)} for w, b, p in span]
            kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))
            yield pa.record_batch([batch.column(0), pa.array(held, kind)], names=["doc_id", "words"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        label, "doc_id long, words array<struct<word:string,lang:string,p:double>>"
    )


def _certainty(model: Crf | None):
    """For each text the mean over its words of the highest probability of a language, null without a letter.

    Without a model nothing speaks against a text that has letters, so its certainty is 1.
    """

    def certain(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.keep_nothing()
        labeller = None if model is None else Labeller(model)
        for batch in texts:
            if labeller is None:
                result = [1.0 if words_of(text) else None for text in batch.to_pylist()]
            else:
                result = [None] * len(batch)
                for chosen, _, begin, probabilities in labeller.blocks(batch):
                    sums = np.add.reduceat(probabilities.max(axis=1), begin[:-1], dtype=np.float64)
                    for i, mean in zip(chosen, (sums / np.diff(begin)).tolist()):
                        result[i] = mean
            yield pa.array(result, pa.float64())
        del labeller
        common.keep_nothing()

    return certain


def surely_labelled(documents: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The documents, all their columns, that have letters and whose words' languages are sure on average.

    A word's certainty is the probability of its most likely language, whichever that is, so text that mixes
    languages stays if its words are sure.
    """
    model = fitted(documents.where(~common.held_out("doc_id")))
    marked, name, columns = common.with_text_result(documents, "double", _certainty(model))
    return marked.where(F.col(name) >= least_score).select(*columns)


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    documents = common.table(spark, sf_dir, "documents")
    model = fitted(documents.where(~common.held_out("doc_id")))
    labelled = documents.select("doc_id", common.held_out("doc_id").alias("held_out"), text_language(model).alias("label"))
    return labelled.select("doc_id", "held_out", "label.*")
