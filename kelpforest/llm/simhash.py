"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 1 bit
of one of three segments (22, 21 and 21 bits). Every fingerprint is therefore
indexed once per bit: its segment with that bit masked out. Equal index keys
join, and the whole fingerprints are compared. Three segments in place of five
make the key 20 or 21 bits wide, where exact segments would leave 12.

Copies fall together before the index is built, since only distinct
fingerprints are indexed. Rows of a key meet in one sorted run; runs up to
``SMALL`` compare pair by pair, longer ones link by a breadth-first forest:
each fingerprint, when reached, takes its neighbours out of the pool. That
finds the same components with fewer links than members, so a large group of
near copies neither multiplies rows nor loses a link between components. A run
holds 8 bytes a distinct fingerprint.

Null and empty texts have fingerprint zero and link like any other. Repeated
rows keep their number; rows with a null id belong to their component and do
not name it. Empty tables give an empty result, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import all_of, forget, stored, unused
from kelpforest.llm.components import components

WIDTH = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SMALL = 32
#: Shingles counted at a time; bounds the memory that one text takes.
BLOCK = 1 << 15


def shingle_hashes(words: list[bytes], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words, joined by spaces; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(x + 1 for x in ends[: len(words) - width])]
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned; a bit is set if it is in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[i : i + BLOCK])
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII letters in lower case, split at ASCII white space."""
    return text.lower().split() if text else []


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(shingle_hashes(words_of(x))) for x in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), fp as signed 64-bit."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): a row for each of the 64 masked segments."""
    keys = []
    for at, size in SEGMENTS:
        segment = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1))
        for bit in range(size):
            keys.append(F.lit((at + bit) << 32).bitwiseOR(segment.bitwiseAND(F.lit(((1 << size) - 1) & ~(1 << bit)))))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what links within ``distance`` connect."""
    out, pool = [], prints
    while len(pool) > 1:
        queue, pool = [pool[:1]], pool[1:]
        while queue and len(pool):
            front = queue.pop()
            for x in front:
                near = np.bitwise_count(pool ^ x) <= distance
                if near.any():
                    found = pool[near]
                    out.append((np.full(len(found), x), found))
                    queue.append(found)
                    pool = pool[~near]
    return out


def run_links(keys: np.ndarray, prints: np.ndarray, distance: int = DISTANCE, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for i in np.flatnonzero(sizes > small):
        for x, y in forest(np.unique(prints[starts[i] : starts[i] + sizes[i]]), distance):
            left.append(x)
            right.append(y)
    rest = np.repeat(sizes <= small, sizes)
    keys, prints = keys[rest], prints[rest]
    for step in range(1, min(small, int(sizes.max(initial=0)))):
        near = np.flatnonzero((keys[step:] == keys[:-step]) & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= distance))
        left.append(prints[near])
        right.append(prints[near + step])
    return (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, prints = [], []

    def found(k, p):
        a, b = run_links(k, p.view(np.uint64))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        k, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        # The last run may go on in the next batch.
        last = int(np.searchsorted(k, k[-1]))
        if last == 0 and (not keys or keys[0][0] == k[0]):
            keys.append(k)
            prints.append(p)
            continue
        yield found(np.concatenate([*keys, k[:last]]), np.concatenate([*prints, p[:last]]))
        keys, prints = [k[last:]], [p[last:]]
    if keys:
        yield found(np.concatenate(keys), np.concatenate(prints))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect all that lie within the distance."""
    # Dealt out anew, as a few small partitions would make all variants.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.select("fp").distinct().repartition(parts)
    return variants(distinct).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id that links reach."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "print-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# Near-duplicate documents: wide signatures, for a similarity of shingle sets.

#: 64-bit words of a signature; the first ``INDEXED`` are indexed, by segments of 16 bits with one masked.
WORDS, INDEXED, NARROW = 8, 3, 16
SHINGLE = 5
SIMILARITY = 0.8
#: Bits of one word by which likely pairs differ at most (three deviations beyond the mean at 0.8); others aren't compared in full.
LIKELY = 18
#: Sets that likely pairs connect give all those pairs up to this size; members of larger sets are compared by whole signatures, in one place.
PAIRED = 6
#: Runs up to this size are compared step by step, all at once.
STEPS = 64
#: Rounds in which roots join before open pairs are looked at, at most.
NEAR_ROUNDS = 4
#: A task compares open pairs in layers, from the likeliest of each member on: up to so many each, then so many times as far as the last.
LAYERS, LAYER = (4,), 8
#: Members of a set that a task compares by signatures are cut into parts of about so many, and those it compares by shingles into parts of about so many shingles; every two parts meet.
PART, PART_SHINGLES = 1 << 12, 1 << 20
#: Shingles that a task holds, about, to tell which of them only one member of open sets has.
SLICE = 1 << 20
#: In place of a shingle's owner: several rows have it.
SEVERAL = -1


def bits_at(similarity: float, deviations: float, words: int = WORDS) -> int:
    """Bits of a signature that sets of this Jaccard similarity differ in, on average, and some deviations more."""
    flip = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * words
    return int(n * flip + deviations * np.sqrt(n * flip * (1 - flip)))


def signature(words: list[bytes], width: int = SHINGLE) -> bytes:
    """``WORDS`` SimHash words over the set of shingles, each from another mix of the shingles' hashes."""
    hashes = np.unique(shingle_hashes(words, width))
    out = []
    for k in range(WORDS):
        x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x5851F42D4C957F2D & (1 << 64) - 1 | 1)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out.append(fingerprint(x))
    return np.array(out, "<u8").tobytes()


def plain_words(text: bytes | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation around them."""
    return [w for w in (x.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in words_of(text)) if w]


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signature(plain_words(x.as_py())) for x in batch.column(1).cast(pa.binary())]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["row", "signature"])


def _narrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, near): masked segments; ``near`` is another word of the signature, to compare first."""
    masks = np.array([(1 << NARROW) - 1 & ~(1 << b) for b in range(NARROW)], np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column(0).to_numpy()
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
        for k in range(INDEXED):
            near = np.repeat(words[:, (k + 1) % WORDS], NARROW).view(np.int64)
            for segment in range(64 // NARROW):
                value = words[:, k] >> np.uint64(NARROW * segment) & np.uint64((1 << NARROW) - 1)
                kind = (np.uint64((k * 4 + segment) * NARROW) + np.arange(NARROW, dtype=np.uint64)) << np.uint64(NARROW)
                keys = (value[:, None] & masks | kind).ravel().view(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(np.repeat(nodes, NARROW)), pa.array(near)], names=["key", "node", "near"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """Batches' columns, cut anew so that no run of the first column is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        if last == 0 and (not held or held[0].column(0)[0].as_py() == k[0]):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)]).columns
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).columns


def _forest(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of ``words`` (n, w) that differ in ``most`` bits at most, one for each row that any such links reach from an earlier one."""
    left, right, rest = [], [], np.arange(len(words))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            now = queue.pop()
            near = np.bitwise_count(words[rest] ^ words[now]).sum(axis=1) <= most
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), now))
                right.append(found)
                queue += found.tolist()
                rest = rest[~near]
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least that links between places i and j connect it with."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, a, b): likely pairs, without a set; members (a) of the sets of more than ``PAIRED`` that likely pairs connect."""
    for columns in _runs(batches):
        keys, nodes, near = (x.to_numpy() for x in columns)
        near = near.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        left, right = [], []
        for i in np.flatnonzero(sizes > STEPS):
            for side, x in zip((left, right), _forest(near[starts[i] : starts[i] + sizes[i], None], LIKELY), strict=True):
                side.append(starts[i] + x)
        short = np.flatnonzero(np.repeat(sizes <= STEPS, sizes))
        k, w = keys[short], near[short]
        for step in range(1, min(STEPS, int(sizes.max(initial=0)))):
            same = k[step:] == k[:-step]
            if not same.any():
                break
            hit = np.flatnonzero(same & (np.bitwise_count(w[step:] ^ w[:-step]) <= LIKELY))
            left.append(short[hit])
            right.append(short[hit + step])
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        label = _joined(len(keys), i, j)
        size = np.bincount(label, minlength=len(keys))
        # All likely pairs of small sets; a long run has given a forest only, so its small sets are compared anew.
        again = np.flatnonzero((size[label] > 1) & (size[label] <= PAIRED) & np.repeat(sizes > STEPS, sizes))
        again = again[np.argsort(label[again], kind="stable")]
        x, y = [i[size[label[i]] <= PAIRED]], [j[size[label[i]] <= PAIRED]]
        for step in range(1, PAIRED):
            same = np.flatnonzero(label[again[step:]] == label[again[:-step]])
            p, q = again[same], again[same + step]
            hit = np.bitwise_count(near[p] ^ near[q]) <= LIKELY
            x.append(p[hit])
            y.append(q[hit])
        a, b = nodes[np.concatenate(x)], nodes[np.concatenate(y)]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), *(pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1))], names=["set", "a", "b"])
        large = np.flatnonzero(size[label] > PAIRED)
        large = large[np.argsort(label[large], kind="stable")]
        if len(large):
            edges = np.flatnonzero(np.r_[True, np.diff(label[large]) != 0, True])
            # Sets of several keys that begin with the same node are one set: most of those that a group of near copies makes.
            sets = np.repeat(nodes[large[edges[:-1]]], np.diff(edges))
            yield pa.record_batch([pa.array(sets), pa.array(nodes[large]), pa.nulls(len(large), pa.int64())], names=["set", "a", "b"])


def _each_set(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(nodes, signatures, other columns) of every set."""
    for columns in _runs(batches):
        sets, nodes = (x.to_numpy() for x in columns[:2])
        words = np.frombuffer(b"".join(columns[2].to_pylist()), "<u8").reshape(-1, WORDS)
        others = [x.to_numpy() for x in columns[3:]]
        starts = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]])
        for i, j in zip(starts, np.r_[starts[1:], len(sets)], strict=True):
            yield nodes[i:j], words[i:j], [x[i:j] for x in others]


def _link_batch(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*rows, strict=True)) or [(), ()]))
    return pa.record_batch([pa.array(np.minimum(a, b).astype(np.int64)), pa.array(np.maximum(a, b).astype(np.int64))], names=["a", "b"])


def _near_links(sure: int):
    """(low, root, a, b): of each set, a forest of links that are within ``sure`` bits, where it joins different roots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for nodes, words, (root,) in _each_set(batches):
            if (root == root[0]).all():
                continue
            i, j = _forest(words, sure)
            new = root[i] != root[j]
            i, j = i[new], j[new]
            rows.append((np.minimum(root[i], root[j]), np.maximum(root[i], root[j]), nodes[i], nodes[j]))
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 4
        yield pa.record_batch([pa.array(x.astype(np.int64)) for x in columns], names=["low", "root", "a", "b"])

    return run


def _open(words: np.ndarray, first: np.ndarray, most: int, counts: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(some, others, bits, open) of a set, about a million pairs at a time: members, those that they meet, bits between them and whether the pair is open."""
    roots, where, sizes = np.unique(first, return_inverse=True, return_counts=True)
    size = sizes[where]
    for root, n in zip(roots, sizes, strict=True):
        mine, others = np.flatnonzero(first == root), np.flatnonzero((size > n) | ((size == n) & (first > root)))
        if not len(others):
            continue
        rows = max(1, (1 << 20) // len(others))
        for at in range(0, len(mine), rows):
            some = mine[at : at + rows]
            bits = np.zeros((len(some), len(others)), np.int32)
            for k in range(words.shape[1]):
                bits += np.bitwise_count(words[some, k][:, None] ^ words[others, k][None, :])
            open_ = bits <= most
            if counts:
                shared, sized, similarity = counts
                both = np.minimum(shared[some][:, None], shared[others][None, :])
                open_ &= (1 + similarity) * both >= similarity * (sized[some][:, None] + sized[others][None, :]) - 1e-6
            yield some, others, bits, open_


def layer_pairs(nodes: np.ndarray, words: np.ndarray, first: np.ndarray, now: np.ndarray, most: int, low: int, high: int, counts: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Open pairs of a set that are among the ``low``-th to ``high``-th likeliest of the end that owns them, and not connected by now.

    Open are pairs of ``most`` bits at most that ``first`` roots don't connect and, with ``counts`` (shared, sizes, similarity), whose ends both
    share enough shingles with others. The end in the smaller group owns a pair, so a large group
    has no row for each member where one document is open to all of them. A document's pairs go by bits and node, alike in every layer.
    """
    left, right = [], []
    for some, others, bits, open_ in _open(words, first, most, counts):
        i, j = np.nonzero(open_)
        order = np.lexsort((nodes[others[j]], bits[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        due = (rank >= low) & (rank < high) & (now[some[i]] != now[others[j]])
        left.append(nodes[some[i[due]]])
        right.append(nodes[others[j[due]]])
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))


def _open_ends(similarity: float, most: int):
    """(set, a): the members that an open pair names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ends = [], []
        for nodes, words, (first, shared, size, own) in _each_set(batches):
            named = np.zeros(len(nodes), bool)
            for some, others, _, open_ in _open(words, first, most, (shared, size, similarity)):
                named[some[open_.any(axis=1)]] = True
                named[others[open_.any(axis=0)]] = True
            sets.append(own[named])
            ends.append(nodes[named])
        yield pa.record_batch([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (sets, ends)], names=["set", "a"])

    return run


def _alike(i: np.ndarray, j: np.ndarray, shingles: list[np.ndarray], mark: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of ``shingles`` (numbers under ``len(mark)``) have this similarity; ``i`` in runs, ``mark`` false before and after."""
    keep = np.zeros(len(i), bool)
    edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.empty(0, np.int64)
    for at, to in zip(edges[:-1], edges[1:], strict=True):
        own, others = shingles[i[at]], [shingles[x] for x in j[at:to]]
        sizes = np.array([len(x) for x in others])
        mark[own] = True
        both = np.bincount(np.repeat(np.arange(to - at), sizes), mark[np.concatenate(others)], to - at)
        mark[own] = False
        keep[at:to] = both >= similarity * (len(own) + sizes - both)
    return keep


def open_links(nodes: np.ndarray, words: np.ndarray, first: np.ndarray, counts: tuple, shingles: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the sorted ``nodes`` as ``first`` roots and all of their open pairs that are alike do: one for each root at most."""
    n, similarity = len(nodes), counts[2]
    kinds, numbers = np.unique(np.concatenate(shingles), return_inverse=True)
    numbers, mark = np.split(numbers, np.cumsum([len(x) for x in shingles])[:-1]), np.zeros(len(kinds), bool)
    _, start = np.unique(first, return_inverse=True)
    begin = np.unique(start, return_index=True)[1][start]
    now, low, high = begin, 0, LAYERS[0]
    while True:
        a, b = layer_pairs(nodes, words, first, now, most, low, high, counts)
        i, j = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        good = _alike(i, j, numbers, mark, similarity)
        now = _joined(n, np.r_[np.arange(n), i[good]], np.r_[now, j[good]])
        if high >= n:
            break
        low, high = high, next((x for x in LAYERS if x > high), high * LAYER)
    new = np.unique(begin[now != begin])
    return nodes[now[new]], nodes[new]


def _open_links(similarity: float, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for nodes, words, (first, shared, size, _, bodies) in _each_set(batches):
            rows.append(open_links(nodes, words, first, (shared, size, similarity), [np.frombuffer(x, "<u8") for x in bodies], most))
        yield _link_batch(rows)

    return run


def _met(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """Members with the ``place``, after which they are sorted, where they meet: sets are cut into parts of about ``most``, and each two parts have a place."""
    parts = members.groupBy("set").agg(F.ceil(F.sum(weight) / most).cast("int").alias("parts")).where("parts > 1")
    # As many rows as the input has such parts, at most.
    cut = members.join(F.broadcast(parts), "set", "left")
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    others = F.transform(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), part), lambda x: F.xxhash64("set", F.least(x, part), F.greatest(x, part)))
    places = F.when(F.col("parts") > 1, others).otherwise(F.array("set"))
    return cut.withColumn("place", F.explode(places)).drop("parts").repartition("place").sortWithinPartitions("place", "a")


def _distances(most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, WORDS) for i in (2, 3))
            bits = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int32)
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(bits)], names=["a", "b", "bits"])
            yield out.filter(pa.array(bits <= most))

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(shingle_hashes(plain_words(x.as_py()), SHINGLE)).tobytes() for x in batch.column(1).cast(pa.binary())]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["row", "shingles"])


def _similar(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _dealt(slices: int):
    """(slice, hashes, owners): a batch's shingles by slices, those of several of its rows once and without an owner."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
            if not sum(map(len, found)):
                continue
            owners = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            hashes, at, times = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            owners, part = np.where(times > 1, SEVERAL, owners[at]), (hashes % np.uint64(slices)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            parts, starts = np.unique(part[order], return_index=True)
            cut = lambda x: pa.array([y.tobytes() for y in np.split(x[order], starts[1:])], pa.binary())
            yield pa.record_batch([pa.array(parts), cut(hashes), cut(owners)], names=["slice", "hashes", "owners"])

    return run


def _alone(table: pa.Table) -> pa.Table:
    """(row, n): how many of a slice's shingles only this row has."""
    hashes, owners = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("hashes", "<u8"), ("owners", "<i8")))
    _, at, times = np.unique(hashes, return_index=True, return_counts=True)
    own = owners[at[times == 1]]
    rows, n = np.unique(own[own != SEVERAL], return_counts=True)
    return pa.table({"row": rows.astype(np.int64), "n": n.astype(np.int64)})


def can_link(sets: DataFrame, similarity: float) -> DataFrame:
    """(row, shared, size) of ``sets`` (row, shingles), with the number of shingles that others have too, without those that are like no other one.

    A set with this similarity to another shares at least that part of its
    shingles, so one with more shingles that no other set has can't link.
    """
    sized = sets.select("row", "shingles", (F.octet_length("shingles") / 8).cast("long").alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    slices = int(total) // SLICE + 1
    dealt = sets.select("row", "shingles").mapInArrow(_dealt(slices), "slice long, hashes binary, owners binary")
    alone = dealt.groupBy("slice").applyInArrow(_alone, "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
    counted = sized.join(alone, "row", "left").select("row", (F.col("size") - F.coalesce("n", F.lit(0))).alias("shared"), "size")
    return counted.where(F.col("shared") >= F.lit(similarity) * F.col("size") - 1e-6)


def _links_within(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all that ``pairs`` (set, a, b), likely ones, hold of pairs with this similarity."""
    near_bits, most = bits_at(similarity, -3), bits_at(similarity, 3)
    signed = lambda end, name: nodes.select(F.col("node").alias(end), F.col("signature").alias(name))
    met = pairs.where("set IS NULL").select("a", "b").join(signed("a", "x"), "a").join(signed("b", "y"), "b").select("a", "b", "x", "y")
    scored = stored(met.mapInArrow(_distances(most), "a long, b long, bits int"), "distances")
    members = stored(pairs.where("set IS NOT NULL").select("set", "a").join(signed("a", "x"), "a").select("set", "a", "x"), "set-members")
    ends = members.select(F.col("a").alias("row")).unionByName(scored.select(F.explode(F.array("a", "b")).alias("row"))).distinct()
    sets = stored(texts.join(ends, "row", "left_semi").mapInArrow(_sets, "row long, shingles binary"), "shingle-sets")
    of = lambda end, name: sets.select(F.col("row").alias(end), F.col("shingles").alias(name))

    def alike(found: DataFrame) -> DataFrame:
        return found.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long")

    def rooted(roots: DataFrame) -> DataFrame:
        """Members with their roots, in sets."""
        out = members.join(roots.select(F.col("node").alias("a"), F.col("root").alias("r0")), "a", "left")
        return out.select("set", "a", "x", F.coalesce("r0", "a").alias("r0")).repartition("set").sortWithinPartitions("set", "a")

    def grown(roots: DataFrame, found: DataFrame) -> DataFrame:
        """Links of what is connected so far, as a star, and of those found that are alike."""
        star = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a != b")
        return star.unionByName(alike(found))

    # Copies with few changes first: each root joins the least that a forest over its sets gives it, until no root has one to join.
    # Whatever this leaves apart is open.
    roots = texts.sparkSession.createDataFrame([], "node long, root long")
    for _ in range(NEAR_ROUNDS):
        near = rooted(roots).mapInArrow(_near_links(near_bits), "low long, root long, a long, b long")
        near = stored(near.groupBy("root").agg(F.min(F.struct("low", "a", "b")).alias("m")).select("m.a", "m.b"), "near-links")
        if near.first() is None:
            break
        roots = stored(components(stored(grown(roots, near), "links-so-far")), "near-roots")
    # Of sets that aren't connected yet, members without enough shingles in common with any other one are done: nothing is like them.
    mixed = rooted(roots).groupBy("set").agg(F.min("r0").alias("low"), F.max("r0").alias("high")).where("low < high").select("set")
    unsettled = stored(members.join(mixed, "set", "left_semi"), "open-members")
    rows = unsettled.select(F.col("a").alias("row")).distinct()
    able = can_link(sets.join(rows, "row", "left_semi"), similarity)
    forget(members)
    root = roots.select(F.col("node").alias("a"), F.col("root").alias("r0"))
    able = unsettled.join(able.withColumnRenamed("row", "a"), "a").join(root, "a", "left")
    members = stored(able.select("set", "a", "x", F.coalesce("r0", "a").alias("r0"), "shared", "size"), "able-members")
    forget(unsettled)
    # Signatures tell which members have open pairs; these meet again with their shingles, and pairs are settled where they meet.
    by_signs = _met(members, F.lit(1), PART).select("place", "a", "x", "r0", "shared", "size", "set")
    ends = stored(by_signs.mapInArrow(_open_ends(similarity, most), "set long, a long").distinct(), "open-ends")
    due = members.join(ends, ["set", "a"], "left_semi").join(of("a", "y"), "a")
    by_sets = _met(due, F.col("size"), PART_SHINGLES).select("place", "a", "x", "r0", "shared", "size", "set", "y")
    settled = by_sets.mapInArrow(_open_links(similarity, most), "a long, b long")
    links = stored(grown(roots, scored.select("a", "b")).unionByName(settled), "links-so-far")
    for x in (scored, members, sets, ends):
        forget(x)
    return links


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: of the documents that links connect, the one of the least id stays.

    Two documents link if their sets of five-word shingles have a Jaccard
    similarity of ``similarity`` or more. Candidates share a masked 16-bit
    segment of a signature and are likely by another word of it; 512-bit
    signatures set aside what is clearly different, and the sets themselves
    decide on every link. Where likely pairs connect many documents, a forest
    of copies with few changes comes first. Documents with pairs that it leaves
    open meet again with their shingles, in parts of bounded size, each part
    with every other; a task decides on the pairs of two parts and returns a
    link for each document at most, so open pairs are never rows. Spared are
    only pairs of documents that are connected anyway, and documents more than
    a fifth of whose shingles no other open one has. What is lost are links that aren't
    candidates: by calculation about one in fifty of those at exactly 0.8, one
    in a thousand at 0.9 (at sf0.01 one of five links between different texts).

    Texts that are null, empty or without words are one group. Of equal ids the
    first row stays; rows with a null id stay only where their group has no
    other. Texts of any length are read whole. An empty table gives an empty
    result; columns come back as they were, whatever their names.
    """
    own = unused(docs.columns) + "row"
    rows = stored(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(own).alias("row"), F.col("text").cast("string"))
    prints = stored(texts.mapInArrow(_signatures, "row long, signature binary"), "signatures")
    named = prints.join(rows.select(F.col(own).alias("row"), "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    classes = stored(named.groupBy("signature").agg(first), "classes")
    forget(prints)
    nodes = classes.select(F.col("first.row").alias("node"), "signature")
    keyed = nodes.mapInArrow(_narrow, "key long, node long, near long")
    likely = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_likely, "set long, a long, b long").distinct()
    links = _links_within(stored(likely, "pairs"), nodes, texts, similarity)
    best = classes.select(F.col("first.row").alias("node"), "first").join(components(links), "node", "left")
    kept = best.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("f")).select(F.col("f.row").alias(own))
    return rows.join(kept, own, "left_semi").select(*all_of(docs))


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
