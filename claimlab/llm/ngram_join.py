"""Documents linked by the Jaccard similarity of their word n-gram sets, through prefix trees of ordered sets.

1. Every whole text becomes a set of 64-bit n-gram hashes. Documents with the same set are one class, and the
   work below is done once per class; a task passes a class on at its first copy only.
2. N-grams are ordered globally, rarest first by the number of classes that hold them. Counting moves each
   n-gram once: blocks of a few thousand documents are sorted, cut into buckets of the hash space and sent as
   bytes of differences. N-grams in a large share of all documents are found beforehand from local counts; at
   most 64 times the mean set size of them exist, they take no part in that shuffle, and come last in the order.
   The number of rows is that of blocks times buckets, and never more than that of n-grams.
3. Two sets of n and m n-grams that reach the threshold share one of the first n - ceil(t n) + 1 n-grams of
   either. N-grams of a single class come first, so a class whose prefix holds only those is linked with
   nothing. For the few others, classes that share a prefix n-gram form blocks (connected components).
4. Each block is joined in one task over a trie of its sets, most frequent n-gram first, so that sets share
   long paths. A set is matched against the trie with one running overlap per shared path, and a subtree is
   left as soon as the n-grams that remain can't bring the overlap to what the threshold asks, or when all its
   sets are already in the same component as the set.
5. A block of more than `block_sets` classes is cut at random, then its local components' representatives
   are joined, and at last the classes outside the block's largest component meet the classes that share a
   prefix n-gram with them: a link either lies inside one component already or has such an end. No pairs are
   formed; an n-gram's classes are dealt into tiles by size and by the n-grams that follow, and tiles that can
   hold a link of the rarest shared n-gram are joined over a trie.

N-grams are compared by 40 bits of their hash and those of their bucket. Memory: a task holds one block of
documents, one bucket or one block of sets.

Defined results: null and empty texts and texts without words have an empty set and are linked with nothing;
repeated rows share a class; doc_id null is kept and never names a component unless it has no other member;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlab.llm import common
from claimlab.llm.components import components
from claimlab.llm.words import mixed, word_hashes

WORDS = 5
PERCENT = 80
BLOCK_SETS = 2048
BUCKET_TOKENS = 2_500_000
PART_CLASSES = 4096
_SHARE = 64
_BATCH_TOKENS = 1_000_000
_LOW = np.uint64((1 << 40) - 1)
_MULTIPLIERS = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has one for the whole of it."""
    step = np.uint64(0x9FB21C651E98DF25)
    for _, hashes, begin in word_hashes(texts, lower=True):
        grams = np.zeros(0, dtype=np.uint64)
        if len(hashes) >= words:
            size = len(hashes) - words + 1
            grams = np.zeros(size, dtype=np.uint64)
            for k in range(words):
                grams *= step
                grams += hashes[k : k + size] * np.uint64(_MULTIPLIERS[k % 5])
            grams = mixed(grams)
        begin = begin.tolist()
        for a, b in zip(begin, begin[1:]):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                whole = np.full(1, b - a, dtype=np.uint64)
                for word in hashes[a:b]:
                    whole = mixed(whole * step + word)
                yield whole
            else:
                yield grams[:0]


def set_class(grams: np.ndarray) -> int:
    """A 64-bit name of a set, from sums that don't depend on order; 0 only for the empty set."""
    if not len(grams):
        return 0
    names = np.array([mixed(grams).sum(), mixed(grams + np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(grams))])
    return int(mixed(names[:1] + mixed(names[1:]) * np.uint64(_MULTIPLIERS[0])).view(np.int64)[0]) or 1


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """The smallest intersection of sets of n and m that gives 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


# --- Pass over the texts: classes and the n-grams that are in a large share of documents ---------------------


def _described(documents: DataFrame, words: int) -> DataFrame:
    """Rows of kind 0: doc_id, class, set size. Rows of kind 1: an n-gram and its count in a block of documents."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_nothing()
        for batch in batches:
            ids, held, sizes, classes = batch.column(0).to_pylist(), [], [], []
            total = done = 0
            for grams in shingle_sets(batch.column(1), words):
                held.append(grams)
                sizes.append(len(grams))
                classes.append(set_class(grams))
                total += len(grams)
                if total >= _BATCH_TOKENS:
                    yield from _frequent(held)
                    held, total = [], 0
            yield from _frequent(held)
            columns = [pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(classes, pa.int64())]
            yield pa.record_batch([*columns, pa.array(sizes, pa.int32())], names=["kind", "id", "cls", "n"])
        common.keep_nothing()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        describe, "kind int, id long, cls long, n int"
    )


def _frequent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    grams, counts = np.unique(np.concatenate(held), return_counts=True)
    chosen = counts >= max(32, len(held) // _SHARE)
    grams, counts = grams[chosen], counts[chosen]
    columns = [np.ones(len(grams), np.int32), grams.view(np.int64), np.zeros(len(grams), np.int64), counts.astype(np.int32)]
    yield pa.record_batch([pa.array(c) for c in columns], names=["kind", "id", "cls", "n"])


# --- Counting n-grams --------------------------------------------------------------------------------------


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each value, all first bytes first, which compress well when values are small."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values_of(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


def _bucketed(documents: DataFrame, heavy: list[int], bits: int, words: int) -> DataFrame:
    """One row per block of documents and bucket: sorted n-grams as differences, owners, and the owners' classes.

    Buckets below 0 carry the frequent n-grams of a block's classes, which need no counting.
    """
    frequent = np.array(sorted(h & 0xFFFFFFFFFFFFFFFF for h in heavy), dtype=np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, classes, total = [], [], 0
        for batch in batches:
            for grams in shingle_sets(batch.column(0), words):
                name = set_class(grams)
                if not len(grams) or name in seen:
                    continue
                seen.add(name)
                held.append(grams)
                classes.append(name)
                total += len(grams)
                if total >= _BATCH_TOKENS:
                    yield _bucket_rows(held, classes, frequent, bits)
                    held, classes, total = [], [], 0
        if held:
            yield _bucket_rows(held, classes, frequent, bits)
        held, classes = [], []
        common.keep_nothing()

    schema = "bucket int, grams binary, owners binary, classes binary, sizes binary"
    return documents.select("text").mapInArrow(cut, schema)


def _bucket_rows(held: list[np.ndarray], classes: list[int], frequent: np.ndarray, bits: int) -> pa.RecordBatch:
    sizes = np.array([len(g) for g in held], dtype="<u4")
    grams, owners = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
    names = np.array(classes, dtype="<i8")
    rows = []

    def add(bucket: int, values: np.ndarray, owner: np.ndarray) -> None:
        used, local = np.unique(owner, return_inverse=True)
        steps = np.diff(values, prepend=np.uint64(0))
        rows.append(
            (bucket, _bytes_of(steps, 8 if bucket < 0 else 5), _bytes_of(local, 3), names[used].tobytes(), _bytes_of(sizes[used], 4))
        )

    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        common_grams = frequent[at] == grams
        if common_grams.any():
            order = np.argsort(grams[common_grams], kind="stable")
            add(-1 - (classes[0] & 0x3FFFFFFF), grams[common_grams][order], owners[common_grams][order])
        grams, owners = grams[~common_grams], owners[~common_grams]
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    buckets = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    edges = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist() + [len(grams)]
    low = (grams >> np.uint64(24 - bits)) & _LOW
    for a, b in zip(edges, edges[1:]):
        add(int(buckets[a]), low[a:b], owners[a:b])
    columns = list(zip(*rows)) or [[]] * 5
    types = [pa.int32()] + [pa.binary()] * 4
    names_ = ["bucket", "grams", "owners", "classes", "sizes"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names_)


_SHARED = "part long, classes binary, sizes binary, held binary, grams binary, counts binary"
_FREQUENT_COUNT = (1 << 32) - 1


def _shared_in(parts: int):
    """For each class of a bucket, its n-grams that another class has too, with the number of classes.

    Classes are dealt over `parts`, and what a bucket has for a part goes as one row.
    """

    def shared(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py()
        width = 8 if number < 0 else 5
        grams, owners, sizes = [], [], []
        for row in bucket.to_pylist():
            at = _values_of(row["owners"], 3).astype(np.int64)
            grams.append(np.cumsum(_values_of(row["grams"], width), dtype=np.uint64))
            owners.append(np.frombuffer(row["classes"], dtype="<i8")[at])
            sizes.append(_values_of(row["sizes"], 4).astype("<u4")[at])
        grams, owners, sizes = np.concatenate(grams), np.concatenate(owners), np.concatenate(sizes)
        order = np.lexsort((owners, grams))
        grams, owners, sizes = grams[order], owners[order], sizes[order]
        fresh = np.ones(len(grams), dtype=bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
        grams, owners, sizes = grams[fresh], owners[fresh], sizes[fresh]
        if number < 0:
            # Frequent n-grams get the highest count, so they come last in the order.
            counts = np.full(len(grams), _FREQUENT_COUNT, dtype="<u4")
        else:
            counts = np.unique(grams, return_counts=True)[1]
            counts = np.repeat(counts, counts)
            several = counts > 1
            grams, owners, sizes, counts = (x[several] for x in (grams, owners, sizes, counts.astype("<u4")))
            grams = grams | np.uint64(number << 40)
        return _by_part(grams, owners, sizes, counts, parts)

    return shared


def _by_part(grams: np.ndarray, owners: np.ndarray, sizes: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    part = owners % parts
    order = np.lexsort((owners, part))
    grams, owners, sizes, counts, part = (x[order] for x in (grams, owners, sizes, counts, part))
    rows = []
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        names, first, held = np.unique(owners[a:b], return_index=True, return_counts=True)
        values = names.astype("<i8"), sizes[a:b][first].astype("<u4"), held.astype("<u4"), grams[a:b].astype("<u8"), counts[a:b]
        rows.append((int(part[a]), *(v.tobytes() for v in values)))
    columns = list(zip(*rows)) or [[]] * 6
    names = [field.split()[0] for field in _SHARED.split(", ")]
    del grams, owners, sizes, counts, part, order
    common.give_back()
    return pa.table({n: pa.array(c, pa.binary() if i else pa.int64()) for i, (n, c) in enumerate(zip(names, columns))})


# --- Sets that can have a link -----------------------------------------------------------------------------

_ACTIVE = "cls long, n int, grams binary, counts binary, prefix array<long>"


def _active_at(percent: int):
    """Classes whose prefix holds a shared n-gram: its shared n-grams, and those of the prefix."""

    def active(part: pa.Table) -> pa.Table:
        pieces: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}
        for row in part.to_pylist():
            names = np.frombuffer(row["classes"], dtype="<i8").tolist()
            sizes.update(zip(names, np.frombuffer(row["sizes"], dtype="<u4").tolist()))
            grams, counts = np.frombuffer(row["grams"], dtype="<u8"), np.frombuffer(row["counts"], dtype="<u4")
            ends = np.cumsum(np.frombuffer(row["held"], dtype="<u4")).tolist()
            for name, a, b in zip(names, [0, *ends], ends):
                pieces.setdefault(name, []).append((grams[a:b], counts[a:b]))
        rows = []
        for name, held in pieces.items():
            n = sizes[name]
            if prefix_size(n, percent) - (n - sum(len(g) for g, _ in held)) <= 0:
                continue
            # A class that two tasks have passed on has its frequent n-grams twice.
            grams, first = np.unique(np.concatenate([g for g, _ in held]), return_index=True)
            counts = np.concatenate([c for _, c in held])[first]
            prefix = prefix_size(n, percent) - (n - len(grams))
            if prefix > 0:
                rarest = grams[np.lexsort((grams, counts))][:prefix].view("<i8").tolist()
                rows.append((name, n, grams.tobytes(), counts.tobytes(), rarest))
        pieces.clear()
        common.give_back()
        columns = list(zip(*rows)) or [[]] * 5
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = ["cls", "n", "grams", "counts", "prefix"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return active


# --- The join in a block -----------------------------------------------------------------------------------


class _Node:
    """A stretch of n-grams; the sets at and below it are `first` to `last` in the trie's order of sets."""

    __slots__ = ("grams", "children", "ends", "first", "last", "least", "most", "seen")

    def __init__(self, grams: np.ndarray, index: int, size: int):
        self.grams, self.children, self.ends = grams, {}, []
        self.first = self.last = index
        self.least = self.most = size  # sizes of the sets at and below
        self.seen = index  # the sets before this one are known to be in one component with the first

    def extend(self, index: int, size: int) -> None:
        self.last, self.least, self.most = index, min(self.least, size), max(self.most, size)


def _trie(sets: list[np.ndarray], sizes: list[int]) -> _Node:
    """Sets come in the order of their n-grams, so only the last child of a node can share more with the next."""
    root = _Node(np.zeros(0, dtype=np.int64), 0, sizes[0])
    for index, (rest, size) in enumerate(zip(sets, sizes)):
        node = root
        node.extend(index, size)
        while len(rest):
            child = node.children.get(rest[0])
            if child is None:
                child = node.children[rest[0]] = _Node(rest, index, size)
                node, rest = child, rest[:0]
                break
            width = min(len(rest), len(child.grams))
            differ = np.flatnonzero(rest[:width] != child.grams[:width])
            same = int(differ[0]) if len(differ) else width
            if same < len(child.grams):
                upper = _Node(child.grams[:same], child.first, child.least)
                upper.last, upper.most = child.last, child.most
                child.grams = child.grams[same:]
                upper.children[child.grams[0]] = child
                node.children[rest[0]] = child = upper
            child.extend(index, size)
            node, rest = child, rest[same:]
        node.ends.append(index)
    return root


def join_sets(
    sets: list[np.ndarray], sizes: list[int], percent: int = PERCENT, known: list[int] | None = None,
    probes: list[bool] | None = None,
) -> list[int]:
    """The component of each set, as the index of one of its sets.

    A set is the increasing array of its shared n-grams' numbers in the global order; sizes count all n-grams.
    Sets with the same `known` label are in one component from the start; with `probes`, only links of these
    sets are looked for.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
    sets, sizes = [sets[i] for i in order], [sizes[i] for i in order]
    parent = list(range(len(sets)))
    if known is not None:
        first: dict[int, int] = {}
        parent = [first.setdefault(known[i], place) for place, i in enumerate(order)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def lies_in(node: _Node, component: int) -> bool:
        # Components only grow, so the search goes on where it ended.
        if find(node.first) != component:
            return False
        at, last = node.seen, node.last
        while at <= last and find(at) == component:
            at += 1
        node.seen = at
        return at > last

    root, count = _trie(sets, sizes), np.count_nonzero
    mark = np.zeros(max((int(s[-1]) for s in sets if len(s)), default=0) + 1, dtype=bool)
    for probe in sorted(range(len(sets)), key=sizes.__getitem__):
        if probes is not None and not probes[order[probe]]:
            continue
        own, size = sets[probe], sizes[probe]
        mark[own] = True
        numbers, held = own.tolist(), len(own)
        component, stack = find(probe), [(root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if lies_in(node, component):
                continue
            rest, grams = held, node.grams
            if len(grams):
                overlap += count(mark[grams])
                depth += len(grams)
                rest -= bisect_right(numbers, int(grams[-1]))
            # The probe's n-grams beyond this place are all that can still be added; the smallest set asks for least.
            if overlap + rest < least_overlap(size, node.least, percent):
                continue
            if 100 * size < percent * node.least or 100 * node.most < percent * size:
                continue
            # N-grams on the way here that the probe lacks make the union larger.
            if 100 * held < percent * (size + depth - overlap):
                continue
            for other in node.ends:
                if overlap >= least_overlap(size, sizes[other], percent):
                    a, b = find(probe), find(other)
                    parent[max(a, b)] = component = min(a, b)
            stack.extend((child, overlap, depth) for child in node.children.values())
        mark[own] = False
    result = [0] * len(sets)
    for place, index in enumerate(order):
        result[index] = order[find(place)]
    return result


def numbered(grams: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """N-grams as numbers, the most frequent first, each set in increasing order."""
    every, first, inverse = np.unique(np.concatenate(grams), return_index=True, return_inverse=True)
    number = np.empty(len(every), dtype=np.int64)
    number[np.lexsort((every, -np.concatenate(counts)[first].astype(np.int64)))] = np.arange(len(every))
    bounds = np.cumsum([0, *map(len, grams)]).tolist()
    return [np.sort(number[inverse[a:b]]) for a, b in zip(bounds, bounds[1:])]


_ROOTS = "block long, cls long, root long"


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    """Components within each part of a block: the smallest class of the component of each class."""

    def join(group: pa.Table) -> pa.Table:
        names = group.column("cls").to_pylist()
        grams = [np.frombuffer(g, dtype="<u8") for g in group.column("grams").to_pylist()]
        counts = [np.frombuffer(c, dtype="<u4") for c in group.column("counts").to_pylist()]
        roots = join_sets(numbered(grams, counts), group.column("n").to_pylist(), percent)
        least: dict[int, int] = {}
        for name, root in zip(names, roots):
            least[root] = min(name, least.get(root, name))
        return pa.table(
            {
                "block": group.column("block").cast(pa.int64()),
                "cls": pa.array(names, pa.int64()),
                "root": pa.array([least[r] for r in roots], pa.int64()),
            }
        )

    return sets.select("block", "cut", "cls", "n", "grams", "counts").groupBy("block", "cut").applyInArrow(join, _ROOTS)


_TILE = ["gram", "side", "outside", "base", "part"]


def _tile_pairs(postings: DataFrame, tile_sets: int) -> tuple[DataFrame, DataFrame]:
    """Postings dealt into tiles, and the pairs of tiles that can hold a link.

    A link of sets of n <= m n-grams is looked for at the rarest n-gram of both, where `least_overlap(n, m)` can't
    be more than what either set has from there on. So a posting allows sizes of the other set up to `most`; side 0
    has those that allow for a set at least as large, side 1 those that allow for one at most as large. Tiles of an
    n-gram hold neighbouring (n, most), counted first, so only counts are ordered.
    """
    sides = F.when(F.col("most") >= F.col("n"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = postings.where("most >= least").select("*", F.explode(sides).alias("side"))
    kinds = rows.groupBy("gram", "side", "outside", "n", "least", "most").agg(
        F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    # Side 0 is in side 1 too. An n-gram without it, or of one component only, has no pair.
    both = kinds.groupBy("gram").agg(
        F.min("side").alias("side"), F.max("outside").alias("some"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    kinds = kinds.join(both.where("side = 0 and some and low <> high").select("gram"), "gram", "left_semi")
    before = F.sum("c").over(Window.partitionBy("gram", "side", "outside").orderBy("n", "most")) - F.col("c")
    kinds = kinds.withColumn("base", F.floor(before / tile_sets)).withColumn("parts", F.ceil(F.col("c") / tile_sets).cast("long"))
    kinds = common.saved(kinds)
    part = F.pmod(F.xxhash64("cls"), F.col("parts"))
    keys = ["gram", "side", "outside", "n", "most"]
    dealt = rows.join(kinds.select(*keys, "base", "parts"), keys).withColumn("part", part)
    tiles = kinds.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).groupBy(*_TILE).agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    whole = F.struct(*_TILE[1:], "n0", "n1", "least", "most", "low", "high")
    a, b = (tiles.where(F.col("side") == i).select("gram", whole.alias(x)) for i, x in enumerate("ab"))
    pairs = a.join(b, "gram").where(
        "(a.outside or b.outside) and (a.low <> a.high or b.low <> b.high or a.low <> b.low)"
        " and a.n0 <= b.n1 and b.n0 <= a.most and b.least <= a.n1 and a.n0 <= b.most"
    )
    name = F.xxhash64("gram", *(f"{x}.{c}" for x in "ab" for c in _TILE[2:]))
    ends = F.array(*(F.struct(*(f"{x}.{c}" for c in _TILE[1:])) for x in "ab"))
    pairs = pairs.select("gram", name.alias("pair"), F.explode(ends).alias("t"))
    return dealt, pairs.select("pair", "gram", "t.*")


def _between_tiles(sets: DataFrame, percent: int) -> DataFrame:
    """Labels of components that a link between two tiles connects."""

    def join(group: pa.Table) -> pa.Table:
        first: dict[int, int] = {}  # a class can be on both sides
        names, sides = group.column("cls").to_pylist(), group.column("side").to_pylist()
        for i, name in enumerate(names):
            if name not in first or sides[i] < sides[first[name]]:
                first[name] = i
        chosen = sorted(first.values())
        group = group.take(pa.array(chosen, pa.int64()))
        labels, sizes = group.column("label").to_pylist(), group.column("n").to_pylist()
        grams = [np.frombuffer(g, dtype="<u8") for g in group.column("grams").to_pylist()]
        counts = [np.frombuffer(c, dtype="<u4") for c in group.column("counts").to_pylist()]
        probes = [side == 0 for side in group.column("side").to_pylist()]
        roots = join_sets(numbered(grams, counts), sizes, percent, labels, probes)
        least: dict[int, int] = {}
        for label, root in zip(labels, roots):
            least[root] = min(label, least.get(root, label))
        links = sorted({(label, least[root]) for label, root in zip(labels, roots) if label != least[root]})
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return sets.groupBy("pair").applyInArrow(join, "u long, v long")


# --- The whole join ----------------------------------------------------------------------------------------


def _class_links(documents: DataFrame, described: DataFrame, words: int, percent: int, block_sets: int) -> DataFrame:
    """(node, root) of the classes that are linked with another class; the root is the smallest class."""
    totals = described.where("kind = 0").agg(F.count("*").alias("docs"), F.sum(F.col("n").cast("long")).alias("grams"))
    docs, grams = totals.first()
    limit = max(1, docs // _SHARE)
    heavy = described.where("kind = 1").groupBy("id").agg(F.sum(F.col("n").cast("long")).alias("c"))
    heavy = [row.id for row in heavy.where(F.col("c") >= max(32, limit)).select("id").collect()]
    bits = max(0, ((grams or 0) // BUCKET_TOKENS).bit_length())
    rows = _bucketed(documents, heavy, min(bits, 24), words)
    shared = rows.groupBy("bucket").applyInArrow(_shared_in(max(1, docs // PART_CLASSES)), _SHARED)
    active = common.saved(shared.groupBy("part").applyInArrow(_active_at(percent), _ACTIVE))

    prefixes = active.select("cls", F.explode("prefix").alias("gram"))
    least = prefixes.groupBy("gram").agg(F.min("cls").alias("least"))
    ties = prefixes.join(least, "gram").where("cls <> least").select(F.col("cls").alias("u"), F.col("least").alias("v"))
    blocks = common.saved(components(ties).withColumnRenamed("root", "block").withColumnRenamed("node", "cls"))
    large = blocks.groupBy("block").count().where(F.col("count") > block_sets)
    sets = active.join(blocks, "cls").join(large, "block", "left").select("block", "cls", "n", "grams", "counts", "prefix", "count")
    cut = F.when(
        F.col("count").isNotNull(), F.pmod(F.xxhash64("cls"), F.ceil(F.col("count") / block_sets).cast("long"))
    ).otherwise(0)
    first = common.saved(_joined(sets.withColumn("cut", cut), percent))
    links = first.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v"))
    if not large.isEmpty():
        links = links.union(_across_cuts(sets.where("count is not null"), first, percent, block_sets))
    return components(links)


def _across_cuts(sets: DataFrame, first: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Links that connect the local components of blocks that were cut."""
    roots = first.join(sets.select("cls"), "cls", "left_semi")
    leaders = sets.join(roots.where("cls = root").select("cls"), "cls", "left_semi")
    sizes = leaders.groupBy("block").agg(F.count("*").alias("leaders"))
    cut = F.pmod(F.xxhash64(F.col("cls"), F.lit(1)), F.ceil(F.col("leaders") / block_sets).cast("long"))
    second = common.saved(_joined(leaders.join(sizes, "block").withColumn("cut", cut), percent)).where("cls <> root")
    merged = roots.where("cls <> root").select(F.col("cls").alias("u"), F.col("root").alias("v"))
    merged = merged.union(second.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    labels = roots.select("block", "cls").join(
        components(merged).withColumnRenamed("node", "cls"), "cls", "left"
    ).select("block", "cls", F.coalesce("root", "cls").alias("label"))
    labels = common.saved(labels)
    main = labels.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    placed = labels.join(main, "block").select("cls", "label", (F.col("label") != F.col("main")).alias("outside"))
    postings = sets.select("cls", "n", F.length("grams").alias("held"), F.posexplode("prefix").alias("at", "gram"))
    postings = postings.join(placed, "cls")
    rest = (F.col("held") / 8).cast("long") - F.col("at")  # shared n-grams from this one on
    postings = postings.select(
        "gram", "cls", "label", "outside", F.col("n").cast("long").alias("n"), F.ceil(percent * F.col("n") / 100).alias("least"),
        (F.floor(rest * (100 + percent) / percent) - F.col("n")).alias("most"),
    )
    dealt, pairs = _tile_pairs(postings, max(1, block_sets // 2))
    met = dealt.join(pairs, _TILE).select("pair", "cls", "side", "label")
    between = _between_tiles(met.join(sets.select("cls", "n", "grams", "counts"), "cls"), percent)
    crossing = second.select(F.col("cls").alias("u"), F.col("root").alias("v"))
    return crossing.union(between)


def _linked(documents: DataFrame, words: int, percent: int, block_sets: int) -> DataFrame:
    """One row per document: doc_id, class_id, n_shingles, component_id, and the root class of the component."""
    described = common.saved(_described(documents, words))
    members = described.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "cls")
    roots = _class_links(documents, described, words, percent, block_sets).withColumnRenamed("node", "cls")
    firsts = members.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    labelled = firsts.join(roots, "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("cls", "root", "component_id")
    nothing = F.lit(None).cast("long")
    empty = members.where("n_shingles = 0").select(
        "doc_id", nothing.alias("class_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        nothing.alias("root"),
    )
    full = members.where("n_shingles > 0").join(named, "cls", "left")
    return full.select(
        "doc_id", F.col("cls").alias("class_id"), F.col("n_shingles").cast("long"), "component_id", "root"
    ).union(empty)


def linked_components(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS
) -> DataFrame:
    """doc_id, class_id (equal for equal sets, null for the empty set), n_shingles, component_id.

    component_id is the smallest doc_id reachable by links.
    """
    return _linked(documents, words, percent, block_sets).drop("root")


def _classes(words: int):
    def name(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([set_class(grams) for grams in shingle_sets(batch, words)], pa.int64())

    return name


def one_of_each_group(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all their columns, less those linked with one of smaller doc_id.

    One row of a group stays, one with its smallest doc_id. Rows that share a doc_id are told apart by their
    n-gram sets, so each stays or goes with its own group; of those that share a group as well, one with the
    smallest class stays. Rows without doc_id, which no link can name, and texts without words all stay.
    """
    linked = common.saved(_linked(documents, words, percent, BLOCK_SETS).where("doc_id is not null"))
    stays = F.col("class_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    key, several = common.free_name(documents, "key"), common.free_name(documents, "several")
    ids = linked.groupBy(F.col("doc_id").alias("id")).agg((F.count("*") > 1).alias(several), F.max(stays).alias("stays"))
    ids = ids.where("stays").select(F.col("id").alias(key), several)
    own = [F.col(f"`{c}`") for c in documents.columns]
    # Both kinds of rows take all columns, so the texts move once.
    rows = documents.withColumn(key, F.col("doc_id").cast("long")).join(ids, key)
    single = rows.where(~F.col(several)).select(own)
    # Only texts of repeated ids are looked at again.
    chosen = linked.where("class_id is not null and doc_id = component_id").groupBy("root", F.col("doc_id").alias("id"))
    chosen = chosen.agg(F.min("class_id").alias("cls")).select("id", "cls").alias("chosen")
    again, cls, _ = common.with_text_result(rows.where(several).select(*own, key), "bigint", _classes(words))
    wordless = again.where(F.col(cls) == 0).select(own)
    kept = again.join(chosen, (F.col(key) == F.col("chosen.id")) & (F.col(cls) == F.col("chosen.cls")), "left_semi")
    kept = kept.dropDuplicates([key, cls]).select(own)
    return single.unionByName(kept).unionByName(wordless).unionByName(documents.where(F.col("doc_id").cast("long").isNull()))


def ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents: five words, 80 percent."""
    return linked_components(common.table(spark, sf_dir, "documents")).drop("class_id")


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM texts
), held AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM held AS a JOIN held AS b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached AS (
  SELECT doc_id AS start, doc_id AS node FROM sets
  UNION
  SELECT r.start, l.v FROM reached AS r JOIN both_ways AS l ON l.u = r.node
)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, r.component_id
FROM sets AS s JOIN (SELECT start, min(node) AS component_id FROM reached GROUP BY start) AS r ON r.start = s.doc_id
"""
