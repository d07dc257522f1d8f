"""LM scoring with a probabilistic suffix tree over words.

A text is a sequence of words and one end. A state of the tree is a context of
up to ``DEPTH`` preceding words (a mark stands before the first) and gives a
distribution of the next word over the training vocabulary and one unknown
kind, which is also what the base score ranges over.

* Candidates are all contexts that occur ``LEAST`` times or more, a fixed
  number, so the tree grows with the corpus. They are found level by level: a
  longer context is a counted pair of a shorter one and its successor.
* Successors seen ``TWICE`` or more keep a probability of their own; the rest,
  and the share that unseen ones are due (Witten and Bell), escape to the
  distribution of the context's suffix. The root gives unknown words that share
  as a whole.
* A candidate is retained if its successors diverge from those of its suffix:
  the log-likelihood gain of its distribution over the suffix's must exceed
  half the number of kept successors times the log of its count (the Bayesian
  information criterion). Suffixes of states are states.
* A word is scored at the longest state that ends what precedes it.

Words, contexts and pairs have 64-bit names: a pair's is that of the names of
the context and of the pair one word shorter. The name of a pair is also the
name of the context that it makes. (Two of a billion words share a name with a
chance of 3%, which would add their counts.) Only things of fixed size leave
the tables: totals, the contexts that hold a thousandth of all tokens or more,
and bitmaps of ``BITS`` bits, by which tasks leave out names that no table
holds. A bitmap that fills up lets more names through, to be dropped by the
joins; it never loses one.

Names travel packed, a row of arrays for each bucket of names, since there are
about as many of them as tokens. The successors of a context meet in a bucket;
those of a context that holds a thousandth of all tokens are dealt out further.
Buckets are cut so that a task holds about ``BUCKET`` names. For scoring,
documents are dealt into chunks of about ``CHUNK`` bytes; a chunk asks each
bucket once for the names it holds, and gets values back in the same order.
``ROUNDS`` bounds the disk that this takes. Documents are read more than once
and must come in the same partitions each time, as tables do.

Null and empty texts have the end alone. Rows with a null id train. Repeated
rows count as often as they come. Without training documents every word is
unknown, and scores are 0 as the unknown kind is all there is. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import forget, stored

DEPTH = 3
LEAST = 16
TWICE = 2
BITS = 1 << 26
ROUNDS = 4
CHUNK = 8 << 20
#: Names that a bucket holds on average.
BUCKET = 1 << 20
#: A context with this share of all tokens has its successors dealt out.
HOT = 1e-3
#: Bytes of text that are named at a time, and tokens that a task combines before it hands them on.
SLICE, HELD = 1 << 18, 1 << 21
#: Longer words are named one by one.
SHORT = 64

_digest = xxhash.xxh64_intdigest
#: Names that no word has: before the first word, and the end.
START, END = np.uint64(_digest(b"\n")), np.uint64(_digest(b"\x0b"))

# The primes of XXH64, and the seed that Spark's xxhash64 starts with.
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = 42


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _spread(x: np.ndarray) -> np.ndarray:
    """XXH64's last steps, in place."""
    x ^= x >> np.uint64(33)
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    return x


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    out = seed + (_P5 + np.uint64(8))
    out ^= _turned(x * _P2, 31) * _P1
    return _spread(_turned(out, 27) * _P1 + _P4)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64(a, b)`` gives for two longs."""
    return _hash_long(b, _hash_long(a, np.uint64(_SEED)))


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte: a number for it (the same for a capital), and whether it is in a word; powers of an odd number and their inverses."""
    low = np.arange(256)
    low[65:91] += 32
    values = _spread((low + 1).astype(np.uint64) * _P1)
    word = np.ones(256, bool)
    word[[*range(9, 14), 32]] = False
    size = SLICE + SHORT + 1
    powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _P4)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(pow(int(_P4), -1, 1 << 64)))])
    return values, word, powers, inverse


_VALUES, _IN_WORD, _POWERS, _INVERSE = _letters()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _word_names(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Names of the words data[a:z]: polynomials over their bytes, taken from prefix sums."""
    out = np.empty(len(a), np.uint64)
    for at in range(0, len(data), SLICE):
        i, j = np.searchsorted(a, [at, at + SLICE])
        if i == j:
            continue
        piece = data[at : at + SLICE + SHORT]
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[piece] * _POWERS[: len(piece)], out=sums[1:])
        first, last = a[i:j] - at, np.minimum(z[i:j] - at, len(piece))
        out[i:j] = _spread((sums[last] - sums[first]) * _INVERSE[first] + (last - first).astype(np.uint64))
    for i in np.flatnonzero(z - a > SHORT):
        out[i] = _digest(data[a[i] : z[i]].tobytes().lower(), _SEED)
    return out


def named(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the start, the words and the end of each text data[offsets[i]:offsets[i + 1]], one after another; tokens in each."""
    inside = _IN_WORD[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    begin[begins] = inside[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    end[ends] = inside[ends]
    a, z = np.flatnonzero(begin), np.flatnonzero(end) + 1
    words = np.diff(np.searchsorted(a, offsets))
    n = len(words)
    out = np.empty(len(a) + 2 * n, np.uint64)
    starts = np.cumsum(words + 2) - (words + 2)
    out[starts] = START
    out[starts + words + 1] = END
    out[np.arange(len(a)) + 2 * np.repeat(np.arange(n), words) + 1] = _word_names(data, a, z)
    return out, words + 2


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, tokens in each) of whole texts, about ``SLICE`` bytes at a time."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = pc.fill_null(chunk.cast(pa.large_binary()), b"")
        if not len(chunk):
            continue
        _, offsets, body = chunk.buffers()
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(chunk):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
            yield named(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def places(sizes: np.ndarray) -> np.ndarray:
    """Places of tokens in their texts, the start's being 0."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def ladder(names: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth from 1 (positions, contexts, shorter pairs) of the tokens that a context of that depth precedes."""
    pair = names
    for d in range(1, depth + 1):
        at = np.flatnonzero(place >= d)
        context, shorter = pair[at - 1], pair[at]
        yield at, context, shorter
        if d < depth:
            pair = np.zeros_like(names)
            pair[at] = paired(context, shorter)


def pairs_of(names: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth from 1 (positions, names of the pairs) of the tokens that a context of that depth precedes."""
    pair = names
    for d in range(1, depth + 1):
        at = np.flatnonzero(place >= d)
        found = paired(pair[at - 1], pair[at])
        yield at, found
        if d < depth:
            pair = np.zeros_like(names)
            pair[at] = found


class Bitmap:
    """Which names may be in a table: a bit for each, out of ``BITS``."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def of(keys: DataFrame, size: int = BITS) -> Bitmap:
        """From the longs ``key``; the driver gets ``size / 64`` rows at most."""
        spot = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("spot"))
        words = spot.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 AS int)))").alias("bits"))
        found = words.toArrow()
        bits = np.zeros(size >> 6, np.uint64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return Bitmap(bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        spot = keys & np.uint64((len(self.bits) << 6) - 1)
        return self.bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1) != 0


# Packed names: rows (bucket, owner, body), body being arrays that follow each other.
_PACKED = "bucket long, owner long, body binary"


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join((np.array([len(arrays), *(len(x) for x in arrays)], np.int64).tobytes(), *(np.ascontiguousarray(x).tobytes() for x in arrays)))


def _unpack(body: pa.Scalar, *kinds: str) -> list[np.ndarray]:
    buffer, out, at = body.as_buffer(), [], 8 * (len(kinds) + 1)
    for size, kind in zip(np.frombuffer(buffer, np.int64, len(kinds), 8).tolist(), kinds, strict=True):
        out.append(np.frombuffer(buffer, kind, size, at))
        at += out[-1].nbytes
    return out


def _packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, owner, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(owner, pa.int64()), pa.array(body, pa.binary())], names=["bucket", "owner", "body"])


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of names, in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that sorted numbers name."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def _rows(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})
    for i in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(i, 1 << 16)


def _met(packed: DataFrame) -> DataFrame:
    """Rows of a bucket next to each other, by owner."""
    return packed.repartition("bucket").sortWithinPartitions("bucket", "owner")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, pa.Scalar]]]]:
    """(bucket, [(owner, body)])."""
    now, held = None, []
    for batch in batches:
        for bucket, owner, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append((owner, body))
    if held:
        yield now, held


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorts ``keys`` in place."""
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _summed(order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``n`` over the runs, in this order, that start where ``first`` is true."""
    return np.add.reduceat(n[order], np.flatnonzero(first)) if len(order) else n


def word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, n): tokens, the end included."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            key, n = _counted(np.concatenate(held))
            yield _packed_rows([(b, 0, _pack(key[i:j], n[i:j].astype(np.uint32))) for b, i, j in _cuts(_bucket_of(key, buckets), buckets)])
            held.clear()

        size = 0
        for batch in batches:
            for names, _ in blocks(batch.column(0)):
                held.append(names[names != START])
                size += len(held[-1])
                if size >= HELD:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _groups(batches):
            parts = [_unpack(body, "u8", "u4") for _, body in members]
            key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key)
            key = key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            yield from _rows({"key": key[first], "n": _summed(order, first, n.astype(np.int64))})

    return _met(texts.select("text").mapInArrow(count, _PACKED)).mapInArrow(add, "key long, n long")


def _by_pair(context: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by context and then shorter pair, half of either name deciding, and where new pairs start in it."""
    order = np.argsort(context & np.uint64(0xFFFFFFFF00000000) | shorter >> np.uint64(32))
    context, shorter = context[order], shorter[order]
    return order, np.r_[True, (context[1:] != context[:-1]) | (shorter[1:] != shorter[:-1])] if len(order) else np.empty(0, bool)


_PAIRS = "context long, shorter long, n long, all long, kinds long, seen long, kept long"


def pair_counts(texts: DataFrame, depth: int, may: Bitmap, hot: np.ndarray, buckets: int) -> DataFrame:
    """(context, shorter, n, all, kinds, seen, kept) for the contexts of ``depth`` words that ``may`` holds.

    ``shorter`` names the pair of the context's suffix and the same word, where that occurs ``TWICE`` or more. Each context has a
    row without it, too. ``all`` counts what follows the context, ``kinds`` different words of that, ``seen`` and ``kept`` the same
    for those that have rows: in the whole, or for hot contexts in the bucket, of which they have a row each.
    """

    def out(context: np.ndarray, shorter: np.ndarray):
        order, first = _by_pair(context, shorter)
        n = np.diff(np.r_[np.flatnonzero(first), len(order)]).astype(np.uint32)
        context, shorter = context[order[first]], shorter[order[first]]
        bucket = _bucket_of(context, buckets)
        dealt = np.isin(context, hot)
        bucket[dealt] = _bucket_of(shorter[dealt], buckets)
        if dealt.any():
            again = np.argsort(bucket, kind="stable")
            bucket, context, shorter, n = bucket[again], context[again], shorter[again], n[again]
        rows = []
        for b, i, j in _cuts(bucket, buckets):
            # A context is named once for the run of its successors.
            new = np.flatnonzero(np.r_[True, context[i + 1 : j] != context[i : j - 1]])
            rows.append((b, 0, _pack(context[i:j][new], np.diff(np.r_[new, j - i]).astype(np.uint32), shorter[i:j], n[i:j])))
        yield _packed_rows(rows)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for names, sizes in blocks(batch.column(0)):
                *_, (_, context, shorter) = ladder(names, places(sizes), depth)
                keep = may.holds(context)
                held.append((context[keep], shorter[keep]))
                size += len(held[-1][0])
                if size >= HELD:
                    yield from out(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield from out(*map(np.concatenate, zip(*held, strict=True)))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _groups(batches):
            parts = [_unpack(body, "u8", "u4", "u8", "u4") for _, body in members]
            context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            shorter = np.concatenate([p[2] for p in parts])
            order, first = _by_pair(context, shorter)
            n = _summed(order, first, np.concatenate([p[3] for p in parts]).astype(np.int64))
            context, shorter = context[order[first]], shorter[order[first]]
            own = n >= TWICE
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            total = lambda x: np.add.reduceat(x, starts)
            kinds = np.diff(np.r_[starts, len(context)])
            sums = {"all": total(n), "kinds": kinds, "seen": total(np.where(own, n, 0)), "kept": total(own.astype(np.int64))}
            yield from _rows({"context": context[own], "shorter": shorter[own], "n": n[own]} | {k: np.repeat(x, kinds)[own] for k, x in sums.items()})
            without = pa.nulls(len(starts), pa.int64())
            columns = {"context": pa.array(context[starts].view(np.int64)), "shorter": without, "n": without}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array(x) for k, x in sums.items()})

    return _met(texts.select("text").mapInArrow(count, _PACKED)).mapInArrow(add, _PAIRS)


class Model:
    """``rows``: packed (key, v, escape). ``v`` is a word's count, or a pair's probability at a state; ``escape`` is a state's share for its suffix."""

    def __init__(self, tokens: int, kinds: int, rows: DataFrame | None, may: Bitmap | None, buckets: int):
        self.tokens, self.kinds, self.rows, self.may, self.buckets = tokens, kinds, rows, may, buckets


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def train(texts: DataFrame, depth: int = DEPTH, least: int = LEAST, margin: float = 0.0, size: int | None = None) -> Model:
    """The tree over ``texts`` of ``size`` bytes; ``margin`` asks for so many nats an occurrence beyond the criterion."""
    if least < TWICE:
        raise ValueError("a context must occur twice at least")
    spark = texts.sparkSession
    # About six bytes a token.
    buckets = max(1, math.ceil((_bytes(texts) if size is None else size) / 6 / BUCKET))
    words = stored(word_counts(texts, buckets), "words")
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = int(row[0]), int(row[1])
    if not tokens:
        return Model(0, 0, None, None, buckets)
    start = spark.createDataFrame([(int(START.view(np.int64)),)], "key long")
    candidates = words.where(F.col("n") >= least).select("key", "n").unionByName(start.withColumn("n", F.lit(tokens)))
    shorter = words.select("key", (F.col("n") / (tokens + kinds)).alias("p"))
    levels: list[DataFrame] = []
    tests: list[DataFrame] = []
    for d in range(1, depth + 1):
        may = Bitmap.of(candidates)
        hot = candidates.where(F.col("n") >= max(HOT * tokens, 1)).select("key").toArrow().column("key").to_numpy().view(np.uint64)
        pairs = stored(pair_counts(texts, d, may, hot, buckets), f"pairs-{d}")
        # A context that the bitmap lets through by chance is met with all its occurrences, too, so its count tells.
        own = F.col("shorter").isNotNull()
        parts = ["all", "kinds", "seen", "kept"]
        sums = pairs.where(~own).groupBy("context").agg(*(F.sum(c).alias(c) for c in parts)).where(F.col("all") >= least)
        sums = stored(sums.withColumn("escape", 1 - F.col("seen") / (F.col("all") + F.col("kinds"))), f"contexts-{d}")
        # At most 1 / HOT rows.
        dealt = sums.join(F.broadcast(spark.createDataFrame([(int(x),) for x in hot.view(np.int64)], "context long")), "context", "left_semi")
        dealt = dealt.select("context", *(F.col(c).alias(f"{c}_") for c in parts[:3]))
        whole = pairs.where(own).join(F.broadcast(dealt), "context", "left")
        whole = whole.select("context", "shorter", "n", *(F.coalesce(f"{c}_", c).alias(c) for c in parts[:3])).where(F.col("all") >= least)
        up = shorter.select(F.col("key").alias("shorter"), F.col("p").alias("p_up"))
        due = F.col("all") + F.col("kinds")
        # What occurs twice after a context does so after its suffix, hence has a row there.
        smoothed = whole.join(up, "shorter").withColumn("p", F.col("n") / due + (1 - F.col("seen") / due) * F.col("p_up"))
        level = stored(smoothed.select("context", "shorter", "n", "p", (F.col("n") * F.log(F.col("p") / F.col("p_up"))).alias("gain")), f"level-{d}")
        forget(pairs)
        gains = sums.join(level.groupBy("context").agg(F.sum("gain").alias("gain")), "context", "left")
        gain = F.coalesce("gain", F.lit(0.0)) + (F.col("all") - F.col("seen")) * F.log("escape")
        worth = gain - 0.5 * F.col("kept") * F.log("all") > margin * F.col("all")
        tests.append(stored(gains.withColumn("worth", worth).select("context", "escape", "worth"), f"tested-{d}"))
        forget(sums)
        levels.append(level)
        name = F.xxhash64("context", "shorter").alias("key")
        shorter = level.select(name, "p")
        candidates = level.where(F.col("n") >= least).select(name, "n")
    # From the longest contexts down: states, and suffixes of states.
    states: list[DataFrame] = []
    suffixes: DataFrame | None = None
    for d in range(depth, 0, -1):
        tested = tests[d - 1]
        chosen = tested.where("worth").select("context", "escape")
        if suffixes is not None:
            chosen = chosen.unionByName(tested.where("NOT worth").join(suffixes, "context", "left_semi").select("context", "escape"))
        chosen = stored(chosen, f"states-{d}")
        states.append(chosen)
        if d > 1:
            made = levels[d - 2].where(F.col("n") >= least).select(F.xxhash64("context", "shorter").alias("made"), F.col("shorter").alias("suffix"))
            suffixes = chosen.join(made, F.col("context") == F.col("made")).select(F.col("suffix").alias("context")).distinct()
    states.reverse()
    none = F.lit(None).cast("double")
    own_rows = [
        levels[d].join(states[d].select("context"), "context", "left_semi").select(F.xxhash64("context", "shorter").alias("key"), F.col("p").alias("v"), none.alias("escape"))
        for d in range(depth)
    ]
    state_rows = [s.select(F.col("context").alias("key"), none.alias("v"), "escape") for s in states]
    longer = stored(_union([*own_rows, *state_rows]), "tree")
    for x in (*levels, *tests, *states):
        forget(x)
    plain = words.select("key", F.col("n").cast("double").alias("v"), none.alias("escape"))
    rows = stored(_packed_model(plain.unionByName(longer), buckets), "tree-packed")
    may = Bitmap.of(longer)
    forget(words)
    forget(longer)
    return Model(tokens, kinds, rows, may, buckets)


def _asked_names(found: Iterable[tuple[np.ndarray, np.ndarray]], may: Bitmap, depth: int) -> np.ndarray:
    """Sorted names that a chunk asks for: of its words, and of longer pairs that the tree may hold."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for names, sizes in found:
        held.append(names)
        held += [pair[may.holds(pair)] for _, pair in pairs_of(names, places(sizes), depth)]
        size += sum(map(len, held[-depth - 1 :]))
        if size >= HELD:
            out.append(_distinct(np.concatenate(held)))
            held, size = [], 0
    out += held
    whole = np.concatenate(out)
    out.clear()
    held.clear()
    return _distinct(whole)


def _asked(may: Bitmap, depth: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        asked = _asked_names(blocks(group.column("text")), may, depth)
        chunk = group.column("chunk")[0].as_py()
        return pa.Table.from_batches([_packed_rows([(b, chunk, _pack(asked[i:j])) for b, i, j in _cuts(_bucket_of(asked, buckets), buckets)])])

    return run


def _packed_model(rows: DataFrame, buckets: int) -> DataFrame:
    """The tree's rows (key, v, escape) by bucket, without an owner, and so ahead of those who ask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is not None:
            key = table.column(0).to_numpy().view(np.uint64)
            order = np.argsort(key)
            key, v, escape = key[order], table.column(1).to_numpy()[order], table.column(2).to_numpy()[order]
            rows = []
            for b, i, j in _cuts(_bucket_of(key, buckets), buckets):
                state = np.flatnonzero(~np.isnan(escape[i:j]))
                rows.append((b, -1, _pack(key[i:j], v[i:j], state.astype(np.uint32), escape[i:j][state])))
            yield _packed_rows(rows)

    return rows.select("key", "v", "escape").mapInArrow(run, _PACKED)


def _answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each that asks, values in the order of its names, and where it met states."""
    now, parts, table = None, [], None

    def merged():
        if not parts:
            return np.empty(0, np.uint64), np.empty(0), np.empty(0)
        key, v, escape = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        # A name's value and escape come from different rows.
        return key[order[first]], *(np.fmax.reduceat(x[order], first) for x in (v, escape))

    for batch in batches:
        rows = []
        for bucket, owner, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != now:
                now, parts, table = bucket, [], None
            if owner < 0:
                key, v, state, share = _unpack(body, "u8", "f8", "u4", "f8")
                escape = np.full(len(key), np.nan)
                escape[state] = share
                parts.append((key.copy(), v.copy(), escape))
                continue
            if table is None:
                table, parts = merged(), []
            key, v, escape = table
            (asked,) = _unpack(body, "u8")
            at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
            there = key[at] == asked if len(key) else np.zeros(len(asked), bool)
            value = np.where(there, v[at], np.nan) if len(key) else np.full(len(asked), np.nan)
            state = np.flatnonzero(there & ~np.isnan(escape[at])) if len(key) else np.empty(0, np.int64)
            rows.append((owner, bucket, _pack(value, state.astype(np.uint32), escape[at[state]] if len(state) else np.empty(0))))
        yield _packed_rows(rows).rename_columns(["chunk", "bucket", "body"])


def _placed(found: Iterable[tuple[np.ndarray, np.ndarray]], may: Bitmap, depth: int):
    """Of a chunk: sizes of texts, how many names it asks for, and for each depth from 0 the spot among them of every token's pair, or -1."""
    sizes, keys, spots, total = [], [[] for _ in range(depth + 1)], [[] for _ in range(depth + 1)], 0
    for names, own in found:
        sizes.append(own)
        keys[0].append(names)
        for d, (at, pair) in enumerate(pairs_of(names, places(own), depth), 1):
            there = may.holds(pair)
            keys[d].append(pair[there])
            spots[d].append((total + at[there]).astype(np.int32))
        total += len(names)
    ends = np.cumsum([sum(map(len, k)) for k in keys])
    line = np.concatenate([x for k in keys for x in k])
    keys.clear()
    # Names are spread evenly, so a 16th of their range at a time is sorted, in order.
    share, rank, asked = (line >> np.uint64(60)).astype(np.uint8), np.empty(len(line), np.int32), 0
    for k in range(16):
        at = np.flatnonzero(share == k)
        own = line[at]
        order = np.argsort(own)
        own = own[order]
        first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.empty(0, bool)
        rank[at[order]] = np.cumsum(first) + (asked - 1)
        asked += int(first.sum())
    del line, share
    out = [rank[: ends[0]]]
    for d in range(1, depth + 1):
        spot = np.full(total, -1, np.int32)
        spot[np.concatenate(spots[d])] = rank[ends[d - 1] : ends[d]]
        spots[d].clear()
        out.append(spot)
    return np.concatenate(sizes), asked, out


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, first token, last token + 1) of texts of these sizes, about ``SLICE`` tokens at a time."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        start = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, start + SLICE, side="right")))
        yield at, to, start, int(ends[to - 1])
        at = to


def _scored(model: Model, depth: int):
    tokens, kinds, may = model.tokens, model.kinds, model.may

    def scores(place: np.ndarray, spots: list[np.ndarray], value: np.ndarray, escape: np.ndarray):
        """(counts, log10 probabilities) of tokens."""
        count = np.nan_to_num(value[spots[0]])
        score = np.log10(np.where(count > 0, count, kinds) / (tokens + kinds))
        for d in range(1, depth + 1):
            # The pair that ends before a token is its context.
            before = np.r_[np.int32(-1), spots[d - 1][:-1]]
            at = np.flatnonzero((place >= d) & (before >= 0))
            share = escape[before[at]]
            state = ~np.isnan(share)
            at, share = at[state], share[state]
            own = spots[d][at]
            p = np.where(own >= 0, value[own], np.nan)
            score[at] = np.where(np.isnan(p), score[at] + np.log10(share), np.log10(p))
        return count, score

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if may is not None:
            sizes, asked, spots = _placed(blocks(docs.column("text")), may, depth)
            body = answers.column("body")
            parts = [_unpack(body[int(i)], "f8", "u4", "f8") for i in np.argsort(answers.column("bucket").to_numpy())]
            value, escape, at = np.concatenate([p[0] for p in parts]), np.full(asked, np.nan), 0
            if len(value) != asked:
                raise ValueError("the documents have changed between two readings")
            for v, state, share in parts:
                escape[at + state.astype(np.int64)] = share
                at += len(v)
        else:
            sizes = np.concatenate([x for _, x in blocks(docs.column("text"))])
        sums = []
        for i, j, a, z in _pieces(sizes):
            count, score = (np.zeros(z - a), np.zeros(z - a)) if may is None else scores(places(sizes[i:j]), [x[a:z] for x in spots], value, escape)
            starts = np.cumsum(sizes[i:j]) - sizes[i:j]
            count[starts] = 0
            base = np.log10((count + 1) / (tokens + kinds + 1))
            base[starts] = score[starts] = 0
            sums.append([np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, score)])
        known, base, score = map(np.concatenate, zip(*sums, strict=True))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(sizes - 1, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(sizes), tokens), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ANSWERS = "chunk long, bucket long, body binary"


def _bytes(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, margin: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = _bytes(rows)
    model = train(rows.where(~held_out(F.col("doc_id"))), depth, least, margin, size)
    chunks = max(1, math.ceil(size / CHUNK))
    # The row number spreads equal rows.
    chunk = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks))
    dealt = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), chunk.alias("chunk"))
    out = []
    rounds = min(rounds, chunks)
    for k in range(rounds):
        some = dealt.where(F.col("chunk") % rounds == k)
        answers = spark.createDataFrame([], _ANSWERS)
        if model.rows is not None:
            asked = some.select("text", "chunk").groupBy("chunk").applyInArrow(_asked(model.may, depth, model.buckets), _PACKED)
            answers = stored(_met(model.rows.unionByName(asked)).mapInArrow(_answered, _ANSWERS), "answers")
        out.append(stored(some.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(model, depth), _SCORES), "scores"))
        if model.rows is not None:
            forget(answers)
    if model.rows is not None:
        forget(model.rows)
    return _union(out)
