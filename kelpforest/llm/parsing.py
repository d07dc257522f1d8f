"""Repeated passages by prefix-free parsing.

A string of ``LENGTH`` bytes counts as repeated if it starts at two places of
the corpus. The parse cuts a text's places into phrases: rolling hashes of
``GRAM`` bytes are taken at every place, and a place triggers a new phrase
where the least hash among the grams of the string that starts there changes.
Equal strings have equal least hashes, so triggers depend on content only. A
phrase reaches over all bytes of the strings that start in it, hence phrases
overlap by ``LENGTH - 1`` bytes, and the order of two suffixes to that depth is
settled within the dictionary of distinct phrases.

* Parse: every phrase occurrence is a row (gram, phrase, place).
* Dictionary: occurrences are summed. Phrases that occur twice are repeated as
  a whole. A gram that occurs once, in all, holds nothing repeated.
* Suffixes: of a gram with a few phrases, phrases are compared outwards from
  the gram, which gives the ranges they share. Of a gram with more, suffixes are
  named by prefix doubling (1, 2, 4 ... 128, then ``LENGTH`` bytes); suffixes
  with equal names stand next to each other in corpus order, which is what
  counts, and one is repeated if two phrases have its name. Both are exact.
* Combination: repeated phrases and suffixes go back to their places, and each
  text is cut once.

Names are 64-bit hashes and are compared among the strings of one 64-bit gram,
so 128 bits tell strings apart. All tables have a row per phrase (about 69
bytes of text) or per suffix of a phrase that is at the edge of a repetition;
no group is gathered except the places of one document. A hot phrase is summed
before it is shuffled, and joins by gram are such that Spark can split them.

Null and empty texts have no bytes and lose none; documents with a null id are
told apart by their texts. Repeated rows are documents like any other, so each
repeats the other. Texts shorter than ``LENGTH`` stay whole, and long ones are
hashed in overlapping pieces. Empty tables give an empty result. Extra columns
are kept by :func:`cut_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import all_of, forget, stored, unused

LENGTH = 200
GRAM = 64
#: Grams with up to so many phrases compare them in pairs; others by their suffixes' names.
FEW = 12
#: Bytes hashed at a time; longer texts go in overlapping pieces.
SLICE = 1 << 18

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1
    x += b
    x ^= x >> np.uint64(31)
    x *= _K2
    x ^= x >> np.uint64(29)
    return x


def _letters() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _K1
    return _mixed(x, x >> np.uint64(7))


_LETTERS = _letters()


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 64-byte and of the 128-byte strings that start at each place."""
    h = _LETTERS[data]
    gram = h
    for step in (1, 2, 4, 8, 16, 32, 64):
        if step == GRAM:
            gram = h
        h = _mixed(h[:-step], h[step:])
    return gram, h


def string_names(h128: np.ndarray, length: int = LENGTH) -> np.ndarray:
    step = length - 128
    return _mixed(h128[: len(h128) - step], h128[step:])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    out, have = h, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    step = width - have
    return np.minimum(out[: len(out) - step], out[step:]) if step else out


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Phrases of the texts data[starts[i]:ends[i]], each at least ``length`` long.

    Returns (text, place in data, places, gram, phrase), in arrays.
    """
    gram, h128 = names(data)
    least = _least(gram, length - GRAM + 1)
    n = len(data) - length + 1
    change = np.zeros(n, bool)
    change[1:] = (least[1:n] != least[: n - 1]) | (gram[: n - 1] == least[: n - 1])
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, starts, 1)
    stops = ends - length + 1
    np.add.at(inside, stops, -1)
    valid = np.cumsum(inside[:n]).astype(bool)
    change[starts] = True
    at = np.flatnonzero(change & valid)
    text = np.searchsorted(starts, at, side="right") - 1
    until = np.minimum(np.r_[at[1:], n], stops[text])
    size = until - at
    step = length - 128
    # The first ``length`` bytes, the last 128 and the 128 before those: no byte of a phrase is left out.
    last = until - 1 + step
    tail = _mixed(h128[last], h128[np.maximum(at, last - 128)])
    whole = _mixed(_mixed(h128[at], tail), _mixed(h128[at + step], size.astype(np.uint64)))
    return text, at, size, least[at], whole


def _slices(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the texts: (bytes, row, place of the stretch in its text, start and end in bytes).

    Stretches of a long text overlap by ``length - 1`` bytes, so each string lies in one of them.
    """
    rows, froms, pieces, held = [], [], [], 0

    def out():
        sizes = np.array([len(x) for x in pieces])
        ends = np.cumsum(sizes)
        return np.concatenate(pieces), np.array(rows), np.array(froms), ends - sizes, ends

    for row, text in enumerate(column):
        body = text.as_buffer() if text.is_valid else None
        if body is None or body.size < length:
            continue
        data = np.frombuffer(body, np.uint8)
        for at in range(0, len(data) - length + 1, SLICE):
            piece = data[at : at + SLICE + length - 1]
            rows.append(row)
            froms.append(at)
            pieces.append(piece)
            held += len(piece)
            if held >= SLICE:
                yield out()
                rows, froms, pieces, held = [], [], [], 0
    if pieces:
        yield out()


_PARSE = "gram long, phrase long, doc_id long, mark long, place int, places int"


def _parsed(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for data, rows, froms, starts, ends in _slices(batch.column(2).cast(pa.binary()), length):
                text, at, size, gram, whole = phrases(data, starts, ends, length)
                row = pa.array(rows[text])
                place = at - starts[text] + froms[text]
                yield pa.record_batch(
                    [
                        pa.array(gram.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        ids.take(row),
                        marks.take(row),
                        pa.array(place.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    names=["gram", "phrase", "doc_id", "mark", "place", "places"],
                )

    return run


def _marked(docs: DataFrame) -> DataFrame:
    """With ``mark``, which tells apart different texts of a repeated id."""
    return docs.withColumn("_mark", F.xxhash64("text"))


def parse(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The parse: a row for every occurrence of a phrase."""
    return _marked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).select("doc_id", "_mark", "text").mapInArrow(_parsed(length), _PARSE)


_EDGE = "gram long, name long, doc_id long, mark long, place int, places int, often boolean, at int, body binary"


def _edges(length: int):
    """Phrases of small groups with their bytes and the gram's place in them; suffixes of large groups by name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("gram", pa.int64()),
                ("name", pa.int64()),
                ("doc_id", pa.int64()),
                ("mark", pa.int64()),
                ("place", pa.int32()),
                ("places", pa.int32()),
                ("often", pa.bool_()),
                ("at", pa.int32()),
                ("body", pa.binary()),
            ]
        )
        for batch in batches:
            bodies, held = [], 0
            for doc, mark, text, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                doc, mark = doc.as_py(), mark.as_py()
                for phrase in found.as_py():
                    place, places = phrase["place"], phrase["places"]
                    piece = data[place : place + places + length - 1]
                    grams, h128 = names(piece)
                    if phrase["few"]:
                        at = places - 1 + int(np.argmax(grams[places - 1 :].view(np.int64) == phrase["gram"]))
                        bodies.append((phrase["gram"], None, doc, mark, place, places, phrase["often"], at, piece.tobytes()))
                    else:
                        for i, name in enumerate(string_names(h128, length).view(np.int64).tolist()):
                            bodies.append((phrase["gram"], name, doc, mark, place + i, 1, phrase["often"], None, None))
                    if len(bodies) > 20_000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*bodies, strict=True), schema, strict=True)], schema=schema)
                        bodies = []
            if bodies:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*bodies, strict=True), schema, strict=True)], schema=schema)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    first = int(differ.argmax()) if n else 0
    return first if n and differ[first] else n


def _group_spans(members: list[tuple], length: int) -> Iterator[tuple]:
    """Repeated ranges of the phrases that occur once, from the phrases of one gram: (doc_id, mark, place, places, often, at, body).

    Sharing the gram, two phrases share the string around it; the strings of ``length`` in that are repeated.
    """
    bodies = [np.frombuffer(m[6], np.uint8) for m in members]
    for i, (doc, mark, place, places, often, at, _) in enumerate(members):
        if often:
            continue
        left, right = bodies[i][:at][::-1], bodies[i][at:]
        ranges = set()
        for j, other in enumerate(members):
            if j != i:
                there = other[5]
                first = max(0, at - _common(left, bodies[j][:there][::-1]))
                last = min(places - 1, at + _common(right, bodies[j][there:]) - length)
                if first <= last:
                    ranges.add((first, last))
        for first, last in ranges:
            yield doc, mark, place + first, place + last + length


def _spans(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, members = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != gram:
                    out.extend(_group_spans(members, length))
                    gram, members = row[0], []
                members.append(row[1:])
            yield _span_batch(out)
        yield _span_batch(list(_group_spans(members, length)))

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "mark", "a", "z"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, few: int = FEW) -> DataFrame:
    """(doc_id, mark, spans): byte ranges, unmerged, of the strings that start at two places or more."""
    parsed = stored(parse(docs, length), "parse")
    # A gram that occurs once holds nothing repeated.
    # Written first, so that the join below starts at two exchanges and Spark can split a hot gram.
    grams = stored(parsed.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    again = stored(parsed.join(grams, "gram"), "parse-again")
    forget(parsed)
    forget(grams)
    # The dictionary; a phrase is read at its first occurrence.
    words = again.groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "place", "places")).alias("at"))
    words = stored(words, "dictionary")
    often = again.join(words.where("n > 1").select("gram", "phrase"), ["gram", "phrase"]).select(
        "doc_id", "mark", F.col("place").alias("a"), (F.col("place") + F.col("places") + (length - 1)).alias("z")
    )
    # Where a gram has several phrases, parts of those that occur once may be repeated.
    kinds = words.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    read = words.join(kinds, "gram").select(
        "at.doc_id", "at.mark", F.struct("at.place", "at.places", "gram", (F.col("n") > 1).alias("often"), (F.col("m") <= few).alias("few")).alias("p")
    )
    # Equal rows are read as often as they come: their phrases occur often, so nothing turns on it.
    read = read.groupBy("doc_id", "mark").agg(F.collect_list("p").alias("found"))
    texts = _marked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    at = texts.join(read, texts["doc_id"].eqNullSafe(read["doc_id"]) & (texts["_mark"] == read["mark"])).select(
        texts["doc_id"], "mark", F.col("text").cast("binary").alias("text"), "found"
    )
    edges = stored(at.mapInArrow(_edges(length), _EDGE), "edges")
    small = (
        edges.where("name IS NULL")
        .select("gram", "doc_id", "mark", "place", "places", "often", "at", "body")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(_spans(length), "doc_id long, mark long, a int, z int")
    )
    suffixes = edges.where("name IS NOT NULL").select("gram", "name", "doc_id", "mark", "place", "often")
    twice = suffixes.groupBy("gram", "name").agg(F.count("*").alias("n")).where("n > 1").select("gram", "name")
    large = suffixes.where("NOT often").join(twice, ["gram", "name"]).select("doc_id", "mark", F.col("place").alias("a"), (F.col("place") + length).alias("z"))
    spans = often.unionByName(small).unionByName(large)
    # Rows that repeat one id and text have the same spans, which are kept once.
    out = stored(spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("a", "z")).alias("spans")), "spans")
    for x in (again, words, edges):
        forget(x)
    return out


def merged(spans) -> np.ndarray:
    """Sorted, maximal ranges (n, 2)."""
    if not len(spans):
        return np.empty((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    until = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > until[:-1]]
    last = np.r_[first[1:], True]
    return np.stack([spans[first, 0], until[last]], axis=1)


def _ranges(column: pa.Array, row: int) -> np.ndarray:
    value = column[row]
    if not value.is_valid:
        return np.empty((0, 2), np.int64)
    inner = value.values
    return merged(np.stack([inner.field("a").to_numpy(zero_copy_only=False), inner.field("z").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64))


def _with_spans(docs: DataFrame, length: int, prefix: str = "_") -> DataFrame:
    """``docs`` with a last column of spans, named ``prefix`` and ``spans``; no column may begin with ``prefix``."""
    doc, mark = f"{prefix}doc", f"{prefix}m"
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(f"{prefix}spans"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark))
    return docs.join(spans, on, "left").select(*all_of(docs), f"{prefix}spans")


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in enumerate(batch.column(1)):
            data = memoryview(text.as_buffer() if text.is_valid else b"")
            cuts = _ranges(batch.column(2), i)
            digest, at = hashlib.sha256(), 0
            for a, z in cuts.tolist():
                digest.update(data[at:a])
                at = z
            digest.update(data[at:])
            rows.append((len(data), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), digest.hexdigest()))
        n, removed, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return (
        _with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), length)
        .select("doc_id", F.col("text").cast("binary").alias("text"), "_spans")
        .mapInArrow(_digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def kept_text(text: str | None, cuts: np.ndarray) -> str | None:
    """What is left; a character goes only if all its bytes do."""
    if text is None or not len(cuts):
        return text
    data = text.encode()
    out, at = [], 0
    for a, z in cuts.tolist():
        while a < z and data[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(data) and data[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append(data[at:a])
            at = z
    out.append(data[at:])
    return b"".join(out).decode()


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; other columns as they came."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept_text(x.as_py(), _ranges(batch.column(batch.num_columns - 1), i)) for i, x in enumerate(batch.column(at))]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    # Plain names on the way, as others need not be fit for it.
    with_spans = _with_spans(docs, length, unused(docs.columns))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return with_spans.toDF(*plain, "spans").mapInArrow(run, docs.toDF(*plain).schema).toDF(*docs.columns)
