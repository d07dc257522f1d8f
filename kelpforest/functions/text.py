"""Tokens, ids, headers and redaction as column expressions."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.constants import KEY_BOUNDARY, MASK, MAX_TOKENS, MIN_TOKEN, PART_WEIGHT, PARTS, SECRET_ASSIGNMENT, SECRET_NAMES, SEPARATOR, STOP_WORDS, TOKEN_HINTS, TOKEN_PATTERNS

#: Namespace of derived row ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:kelpforest:chunks")


def _counts(token: Column) -> Column:
    return (F.length(token) >= MIN_TOKEN) & ~token.isin(*STOP_WORDS)


def weighted_tokens(text: Column) -> Column:
    """array<struct<token, w>> in order: identifiers at 1, the parts of compound ones at 0.5; a stop word goes with its parts."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda r: _counts(F.lower(r)))

    def one(r: Column) -> Column:
        parts = F.split(r, PARTS, -1)
        own = F.array(F.struct(F.lower(r).alias("token"), F.lit(1.0).alias("w")))
        of = F.transform(F.filter(F.transform(parts, lambda p: F.lower(p)), _counts), lambda p: F.struct(p.alias("token"), F.lit(PART_WEIGHT).alias("w")))
        return F.concat(own, F.when(F.size(parts) > 1, of).otherwise(F.slice(of, 1, 0)))

    return F.flatten(F.transform(raw, one))


_IDENTIFIER, _PARTS = re.compile(r"[A-Za-z0-9_]+"), re.compile(PARTS)
#: Identifiers that a task remembers, and tokens of a batch that it gives back.
_KNOWN, _GIVEN = 500_000, 200_000


class _Tokens(dict):
    """An identifier's own token (or none) and those of its parts, as in :func:`weighted_tokens`; each is worked out once."""

    def __missing__(self, r: str) -> tuple[str | None, tuple[str, ...]]:
        own, out = r.lower(), (None, ())
        if len(own) >= MIN_TOKEN and own not in _STOPPED:
            # Only a capital or an underscore can make a compound.
            parts = _PARTS.split(r) if own != r or "_" in r else ()
            out = (own, tuple(p for p in map(str.lower, parts) if len(p) >= MIN_TOKEN and p not in _STOPPED) if len(parts) > 1 else ())
        if len(self) >= _KNOWN:
            self.clear()
        self[r] = out
        return out


_STOPPED = frozenset(STOP_WORDS)


def _summed(texts: list[str], known: _Tokens) -> dict[str, float]:
    """Summed weights by token, in the order in which tokens come first."""
    tf: dict[str, float] = {}
    if len(texts) == 1:
        for r, n in Counter(_IDENTIFIER.findall(texts[0])).items():
            own, parts = known[r]
            if own:
                tf[own] = tf.get(own, 0.0) + n
            for token in parts:
                tf[token] = tf.get(token, 0.0) + PART_WEIGHT * n
        return tf
    first: dict[str, tuple[int, int]] = {}
    for text in texts:
        for place, (own, parts) in enumerate(of for r in _IDENTIFIER.findall(text) if (of := known[r])[0]):
            for nth, token in enumerate((own, *parts)):
                tf[token] = tf.get(token, 0.0) + (PART_WEIGHT if nth else 1.0)
                first[token] = min(first.get(token, (place, nth)), (place, nth))
    return {token: tf[token] for token in sorted(tf, key=first.__getitem__)}


def _counted(cap: int | None):
    """Token rows of (key, text) that come in the order of their keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind, name = _Tokens(), None, None
        keys, sizes, tokens, weights = [], [], [], []

        def count(key, texts: list[str]) -> None:
            tf = _summed(texts, known)
            if cap is not None and len(tf) > cap:
                tf = dict(sorted(tf.items(), key=lambda x: -x[1])[:cap])
            keys.append(key)
            sizes.append(len(tf))
            tokens.extend(tf)
            weights.extend(tf.values())

        def given() -> pa.RecordBatch:
            key = pa.array(keys, kind).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            out = pa.record_batch([key, pa.array(tokens, pa.string()), pa.array(weights, pa.float64())], names=[name, "token", "tf"])
            for some in (keys, sizes, tokens, weights):
                some.clear()
            return out

        here, texts = None, []
        for batch in batches:
            kind, name = batch.schema.field(0).type, batch.schema.field(0).name
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if texts and key != here:
                    count(here, texts)
                    texts = []
                    if len(tokens) >= _GIVEN:
                        yield given()
                here = key
                texts.append(text.as_py() or "")
        if texts:
            count(here, texts)
        if keys:
            yield given()

    return run


def all_tokens(rows: DataFrame, key: str, text: str, cap: int | None = None) -> DataFrame:
    """(key, token, tf): summed weights of the tokens of a row, all or the ``cap`` heaviest, ties to the token that came first.

    Texts of a key come together in one task, which counts them where they lie: nothing but the texts is shuffled.
    """
    near = rows.select(key, text).repartition(key).sortWithinPartitions(key)
    return near.mapInArrow(_counted(cap), f"`{key}` {rows.schema[key].dataType.simpleString()}, token string, tf double")


def postings(rows: DataFrame, key: str, text: str, cap: int = MAX_TOKENS) -> DataFrame:
    """(key, token, tf): summed weights, the ``cap`` heaviest tokens of a row, ties to the token that came first."""
    return all_tokens(rows, key, text, cap)


def feature_id(token: Column) -> Column:
    """Sparse index of a token: its CRC-32 without the sign bit."""
    return F.crc32(F.encode(token, "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_id(project: Column, path: Column, index: Column) -> Column:
    return uuid5(F.concat_ws(":", project, path, index.cast("string")))


def header(path: Column, heading: Column, kind: Column, name: Column) -> Column:
    symbol = F.when(name.isNotNull(), F.concat_ws(" ", kind, name))
    return F.concat_ws(" :: ", path, F.coalesce(heading, symbol))


def embed_text(head: Column, content: Column) -> Column:
    return F.when(F.coalesce(head, F.lit("")) == "", content).otherwise(F.concat(head, F.lit("\n\n"), content))


def preview(content: Column, chars: int = 160) -> Column:
    return F.substring(content, 1, chars)


def _redact_one(rows: DataFrame, text: str, count: str, hint: Column, pattern: str, into: str) -> DataFrame:
    """One pattern over the rows that have its hint; each step is a projection of its own, so that no step is evaluated twice."""
    there = F.coalesce(hint, F.lit(False))
    return rows.withColumns(
        {
            text: F.when(there, F.regexp_replace(text, pattern, into)).otherwise(F.col(text)),
            count: F.col(count) + F.when(there, F.regexp_count(text, F.lit(pattern))).otherwise(0),
        }
    )


def redact_tokens(rows: DataFrame, text: str, count: str) -> DataFrame:
    """Known token formats keep four characters. Patterns run in order, each over the last one's output."""
    for pattern, hints in zip(TOKEN_PATTERNS, TOKEN_HINTS, strict=True):
        hint = F.lit(False)
        for word in hints:
            hint |= F.contains(text, F.lit(word))
        # The first four characters stay: match the whole, then capture them by a look-ahead.
        four = rf"\b(?=(.{{4}}))(?:{pattern.removeprefix(r'\b')})"
        rows = _redact_one(rows, text, count, hint, four, "$1" + MASK)
    return rows


def redact_assignments(rows: DataFrame, text: str, count: str) -> DataFrame:
    """Quoted values of secret-named assignments go whole."""
    return _redact_one(rows, text, count, F.col(text).rlike(f"(?i){SECRET_NAMES}"), SECRET_ASSIGNMENT, rf"$1$2$3{MASK}$3")


def redact_key_blocks(rows: DataFrame, text: str, count: str) -> DataFrame:
    """Lines between the BEGIN and END of a private key; the first boundary on a line decides."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        edge = F.regexp_extract(line, KEY_BOUNDARY, 1)
        hide = acc["inside"] & (edge == "") & (F.trim(line) != "")
        return F.struct(
            F.when(edge == "", acc["inside"]).otherwise(edge == "BEGIN").alias("inside"),
            (acc["n"] + hide.cast("int")).alias("n"),
            F.concat(acc["out"], F.array(F.when(hide, F.lit(MASK)).otherwise(line))).alias("out"),
        )

    blocks = F.contains(text, F.lit("-----")) & F.col(text).rlike(KEY_BOUNDARY)
    done = f"{count}_done"
    out = rows.withColumn(done, F.when(blocks, F.aggregate(F.split(text, "\n", -1), start, step)))
    kept = F.when(F.col(done).isNull(), F.col(text)).otherwise(F.array_join(F.col(done)["out"], "\n"))
    return out.withColumns({text: kept, count: F.col(count) + F.coalesce(F.col(done)["n"], F.lit(0))}).drop(done)


def redacted(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the redacted text and ``n_redacted``; the number of lines never changes."""
    out = rows.withColumn("n_redacted", F.lit(0))
    for step in (redact_tokens, redact_assignments, redact_key_blocks):
        out = step(out, text, "n_redacted")
    return out


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as there are cores, if they come in fewer, as from a file that can't be split."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
