"""Language identification: multinomial logistic regression on TF-IDF weights of character n-grams.

Texts are letters in lower case with one blank for whatever stands between them;
n-grams of one to ``ORDERS`` of those are hashed to ``FEATURES`` kinds. A kind
weighs (1 + ln tf) * idf, and a text's weights have length one. Document
frequencies come from every training document, added up within tasks before they
are shuffled.

The weights are fitted on a bounded sample: about ``PER_LANG`` documents of each
language, whole texts, chosen by a hash of id and text (equal rows count once). Every
shard of the sample runs follow-the-regularised-leader with per-coordinate rates
and elastic-net penalties (``L1`` leaves weights of rare or common n-grams at
zero), in the order of the hash; after each pass the shards' states are averaged,
language by language. A fifth of the sample is kept out and sets the temperature:
that of a grid with the least log loss, languages weighed as in the corpus and targets
short of 1 by the rule of succession.
Sums there are of whole numbers, so reruns give the same model.

The driver and each task hold ``FEATURES`` numbers a language, 4 bytes each (24 with
the state of training); no text comes to the driver.

Null texts and those without a letter are ``und`` with score 0, as is everything
where no training document has a language. Null ids count as training documents.
Equal scores go to the language that is first in code-point order. Repeated rows are
judged alike, each on its own; an empty table gives an empty result; other
columns than ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import forget, stored

UNKNOWN = "und"
#: Longest n-grams, and kinds that they are hashed to.
ORDERS, FEATURES = 3, 1 << 16
#: Documents of a language that the weights are fitted on, about; those of a shard; passes.
PER_LANG, PER_SHARD, PASSES = 1000, 2000, 3
#: Follow the regularised leader: rate, its offset, and the penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02
#: Temperatures to choose from, and the share of the sample that chooses.
GRID, KEPT_OUT = np.geomspace(0.02, 20.0, 139), 5
_MULTIPLIER = np.uint32(0x9E3779B1)


@cache
def _letters() -> np.ndarray:
    """Of each code point: its letter in lower case, or 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = ord(c.lower()[0])
    return out


def n_grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(kinds in order, their numbers) of a text in UTF-8; none without letters."""
    codes = _letters()[np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] | codes[:-1]) > 0])]
    hashed, found = np.zeros(len(codes), np.uint32), []
    for n in range(1, ORDERS + 1):
        hashed = (hashed[: len(codes) - n + 1] + codes[n - 1 :]) * _MULTIPLIER + np.uint32(n)
        found.append((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16))
        hashed = hashed[:-1]
    kinds = np.concatenate(found).astype(np.int64)
    if len(kinds) < FEATURES // 16:
        return np.unique(kinds, return_counts=True)
    counts = np.bincount(kinds, minlength=FEATURES)
    kinds = np.flatnonzero(counts)
    return kinds, counts[kinds]


def weigh(kinds: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length one."""
    out = (1 + np.log(counts)) * idf[kinds]
    return (out / np.linalg.norm(out)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def softmax(scores: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return out / out.sum(axis=-1, keepdims=True)


class Leader:
    """Follow the proximally regularised leader over kinds and languages; the last kind is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, kinds: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[kinds], self.n[kinds]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, kinds: np.ndarray, x: np.ndarray, lang: int) -> None:
        kinds, x = np.append(kinds, len(self.z) - 1), np.append(x, np.float32(1))
        w = self.weights(kinds)
        wrong = softmax(x @ w)
        wrong[lang] -= 1
        g = np.outer(x, wrong)
        n = self.n[kinds]
        more = n + g * g
        self.z[kinds] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[kinds] = more


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def scores(self, kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[kinds] + self.weights[-1]

    def predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, lang_pred, score)."""
        langs, idf, temperature, scores = self.langs, self.idf, self.temperature, self.scores

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, sure = [], []
                for text in batch.column("text").cast(pa.binary()):
                    kinds, counts = n_grams(text.as_py())
                    if not langs or not len(kinds):
                        best.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    shares = softmax(scores(kinds, weigh(kinds, counts, idf)).astype(np.float64) / temperature)
                    best.append(langs[int(shares.argmax())])
                    sure.append(float(shares.max()))
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
        return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def statistics(known: DataFrame) -> tuple[int, np.ndarray, dict[str, int]]:
    """Number of training documents, in how many each kind occurs, and how many each language has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, langs = np.zeros(FEATURES, np.int64), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                df[n_grams(text.as_py())[0]] += 1
                langs[lang] = langs.get(lang, 0) + 1
        kinds = np.flatnonzero(df)
        names = [*(None for _ in kinds), *langs]
        yield pa.record_batch([pa.array([*kinds, *(-1 for _ in langs)], pa.int32()), pa.array(names, pa.string()), pa.array([*df[kinds], *langs.values()], pa.int64())], names=["kind", "lang", "n"])

    rows = known.select("lang", "text").mapInArrow(run, "kind int, lang string, n long").groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES)
    for r in rows:
        if r["kind"] >= 0:
            df[r["kind"]] = r["n"]
    langs = {r["lang"]: r["n"] for r in rows if r["kind"] < 0}
    return sum(langs.values()), df, langs


def sample(known: DataFrame, langs: dict[str, int], idf: np.ndarray) -> DataFrame:
    """(key, lang, kinds, weights) of about ``PER_LANG`` documents a language; lang is its place in code-point order, kinds and weights are packed."""
    names = sorted(langs)
    place = {lang: i for i, lang in enumerate(names)}
    limit = {lang: min(1 << 31, PER_LANG * (1 << 31) // n) for lang, n in langs.items()}
    spark = known.sparkSession
    table = spark.createDataFrame([(lang, place[lang], limit[lang]) for lang in names], "lang string, place int, most long")
    keyed = known.withColumn("key", F.xxhash64("doc_id", "text")).join(F.broadcast(table), "lang")
    chosen = keyed.where(F.pmod("key", F.lit(1 << 31)) < F.col("most")).select("key", F.col("place").alias("lang"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, weights = [], []
            for text in batch.column("text").cast(pa.binary()):
                k, n = n_grams(text.as_py())
                kinds.append(k.astype(np.int32).tobytes())
                weights.append(weigh(k, n, idf).tobytes() if len(k) else b"")
            yield pa.record_batch([batch.column("key"), batch.column("lang"), pa.array(kinds, pa.binary()), pa.array(weights, pa.binary())], names=["key", "lang", "kinds", "weights"])

    return chosen.mapInArrow(run, "key long, lang int, kinds binary, weights binary").dropDuplicates(["key", "lang"])


def _unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lang, kinds, weights in zip(*(table.column(c).to_pylist() for c in ("lang", "kinds", "weights")), strict=True):
        yield lang, np.frombuffer(kinds, np.int32), np.frombuffer(weights, np.float32)


def _learner(state: Leader, n_langs: int):
    """A shard's pass from a state, for ``applyInArrow``: a row a language."""
    z, n = state.z, state.n

    def learn(shard: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leader = Leader(z.copy(), n.copy())
        for lang, kinds, weights in _unpacked(table.sort_by([("key", "ascending"), ("lang", "ascending")])):
            leader.learn(kinds, weights, lang)
        parts = [pa.array([np.ascontiguousarray(a[:, c]).tobytes() for c in range(n_langs)], pa.binary()) for a in (leader.z, leader.n)]
        return pa.table([pa.array([shard[0].as_py()] * n_langs, pa.int32()), pa.array(range(n_langs), pa.int32()), *parts], names=["shard", "lang", "z", "n"])

    return learn


def _mean(table: pa.Table) -> pa.Table:
    """A language's states of all shards, averaged in the order of the shards."""
    table = table.sort_by("shard")
    sums = [sum(np.frombuffer(b, np.float32).astype(np.float64) for b in table.column(c).to_pylist()) / table.num_rows for c in ("z", "n")]
    return pa.table([table.column("lang")[:1], *(pa.array([a.astype(np.float32).tobytes()], pa.binary()) for a in sums)], names=["lang", "z", "n"])


def fit(rows: DataFrame, n_langs: int) -> np.ndarray:
    """Weights by kind (the bias last) and language, of a sample's rows."""
    shards = max(1, -(-n_langs * PER_LANG // PER_SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))
    state = Leader(np.zeros((FEATURES + 1, n_langs), np.float32), np.zeros((FEATURES + 1, n_langs), np.float32))
    for _ in range(PASSES):
        passed = dealt.groupBy("shard").applyInArrow(_learner(state, n_langs), "shard int, lang int, z binary, n binary")
        means = {r["lang"]: r for r in passed.groupBy("lang").applyInArrow(_mean, "lang int, z binary, n binary").collect()}
        if not means:
            break
        state = Leader(*(np.stack([np.frombuffer(means[c][part], np.float32) for c in range(n_langs)], axis=1).copy() for part in ("z", "n")))
    return state.weights(slice(None)).astype(np.float32)


def calibrated(rows: DataFrame, model: Model, langs: dict[str, int]) -> float:
    """The temperature of the grid with the least log loss over rows that weren't learnt from; 1 if there are none."""
    scores = model.scores
    total, k = sum(langs.values()), len(model.langs)
    share = np.array([langs[lang] / total for lang in model.langs])
    # However many rows are right, one more could be wrong: the rule of succession keeps scores short of 1.
    doubt = 1 / (sum(min(n, PER_LANG) for n in langs.values()) / KEPT_OUT + 2) if k > 1 else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n = np.zeros((len(share), len(GRID)), np.int64), np.zeros(len(share), np.int64)
        for batch in batches:
            for lang, kinds, weights in _unpacked(batch):
                s = scores(kinds, weights).astype(np.float64)
                logs = np.log(np.maximum(softmax(s[None, :] / GRID[:, None]), 1e-30))
                due = (1 - doubt) * logs[:, lang] + doubt * (logs.sum(axis=1) - logs[:, lang]) / max(k - 1, 1)
                # Whole millionths add up to the same sum in any order.
                loss[lang] += np.rint(-due * 1e6).astype(np.int64)
                n[lang] += 1
        lang, t = (a.ravel() for a in np.indices(loss.shape))
        yield pa.record_batch([pa.array(lang, pa.int32()), pa.array(t, pa.int32()), pa.array(loss.ravel()), pa.array(np.repeat(n, len(GRID)))], names=["lang", "t", "loss", "n"])

    sums = rows.mapInArrow(run, "lang int, t int, loss long, n long").groupBy("lang", "t").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).where("n > 0").collect()
    if not sums:
        return 1.0
    losses = np.zeros(len(GRID))
    for r in sorted(sums):
        losses[r["t"]] += share[r["lang"]] * r["loss"] / r["n"]
    return float(GRID[int(losses.argmin())])


def train(docs: DataFrame) -> Model:
    """The model that the documents with a language teach; ``docs`` has doc_id, text and lang, and none that is to be held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang IS NOT NULL AND text IS NOT NULL")
    n, df, langs = statistics(known)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not langs:
        return Model([], idf, np.zeros((FEATURES + 1, 0), np.float32))
    rows = stored(sample(known, langs, idf), "language-sample").where("kinds != X''")
    out = F.pmod(F.xxhash64("key"), F.lit(KEPT_OUT)) == 0
    model = Model(sorted(langs), idf, fit(rows.where(~out), len(langs)))
    temperature = calibrated(rows.where(out), model, langs)
    forget(rows)
    return Model(model.langs, idf, model.weights, temperature)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by what those not held out teach."""
    return train(docs.where(~held_out(F.col("doc_id")))).predict(docs)
