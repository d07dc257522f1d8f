"""Models behind plain functions: an embedder in batches with retries, and a judge with a time limit. Offline stand-ins are the default."""

from __future__ import annotations

import concurrent.futures
import time
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from kelpforest.constants import BATCH, EMBED_CHARS, QUERY_CACHE, RERANK_POOL, RERANK_SECONDS, RETRY_PAUSE

DIM = 64


class EmbeddingError(RuntimeError):
    """The model gave no vectors, too few, or some of another dimension."""


class ModelMissing(RuntimeError):
    """A judge raises this where its model isn't there; it is not asked again."""


def hashed(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """The offline embedder: tokens hashed to signed components, at unit length. A stand-in, for want of a model."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            code = zlib.crc32(word.encode())
            out[i, code % dim] += 1 if code >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32).tolist()


class Embedder:
    """``call`` turns texts into vectors of ``dim`` components; texts get a prefix by their role and are cut to ``chars``."""

    def __init__(
        self,
        call: Callable[[list[str]], list[list[float]]] = hashed,
        dim: int = DIM,
        query_prefix: str = "",
        document_prefix: str = "",
        batch: int = BATCH,
        chars: int = EMBED_CHARS,
        pauses: tuple[float, ...] = RETRY_PAUSE,
    ):
        self.call, self.dim, self.query_prefix, self.document_prefix = call, dim, query_prefix, document_prefix
        self.batch, self.chars, self.pauses = batch, chars, pauses
        self._cache: dict[str, list[float]] = {}

    def vectors(self, texts: list[str]) -> list[list[float]]:
        """One call with its retries; every vector is checked."""
        for pause in (*self.pauses, None):
            try:
                found = self.call(texts)
                break
            except Exception as e:
                if pause is None:
                    raise EmbeddingError(f"no vectors after {len(self.pauses) + 1} tries: {e}") from e
                time.sleep(pause)
        if len(found) != len(texts):
            raise EmbeddingError(f"{len(texts)} vectors are due, not {len(found)}")
        for v in found:
            if len(v) != self.dim:
                raise EmbeddingError(f"a vector of {self.dim} components is due, not of {len(v)}")
        return found

    def documents(self, texts: list[str | None]) -> list[list[float]]:
        given = [self.document_prefix + (t or "")[: self.chars] for t in texts]
        return [v for i in range(0, len(given), self.batch) for v in self.vectors(given[i : i + self.batch])]

    def query(self, text: str) -> list[float]:
        if text not in self._cache:
            vector = self.vectors([self.query_prefix + text[: self.chars]])[0]
            if len(self._cache) >= QUERY_CACHE:
                self._cache.pop(next(iter(self._cache)))
            self._cache[text] = vector
        return self._cache[text]

    def column(self, text: str, into: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """For ``mapInArrow``: batches with the vectors of ``text`` in place of it, as their last column."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.names.index(text)
                keep = [i for i in range(batch.num_columns) if i != at]
                found = pa.array(self.documents(batch.column(at).to_pylist()), pa.list_(pa.float32()))
                yield pa.record_batch([*(batch.column(i) for i in keep), found], names=[*(batch.schema.names[i] for i in keep), into])

        return run


class Judge:
    """Scores of texts for a query, within ``seconds``; any failure gives None, and a missing model switches it off."""

    def __init__(self, score: Callable[[str, list[str]], list[float | None]], candidates: int = RERANK_POOL, seconds: float = RERANK_SECONDS):
        self.score, self.candidates, self.seconds = score, candidates, seconds
        self.off = False

    def scores(self, query: str, texts: list[str]) -> list[float | None] | None:
        if self.off or len(texts) < 2:
            return None
        pool = concurrent.futures.ThreadPoolExecutor(1)
        try:
            found = pool.submit(self.score, query, texts).result(self.seconds)
        except ModelMissing:
            self.off = True
            return None
        except Exception:
            return None
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        return found if len(found) == len(texts) else None


def benchmark(embedder: Embedder, corpus: dict[str, str], questions: list[tuple[str, str]]) -> dict:
    """Throughput, latency of queries (median and longest, ms), R@1 and MRR of (question, key of its text) over a small corpus."""
    embedder.vectors(["warm up"])
    began = time.perf_counter()
    keys = list(corpus)
    matrix = np.array(embedder.documents([corpus[k] for k in keys]), float)
    throughput = len(keys) / max(time.perf_counter() - began, 1e-9)
    norms = np.linalg.norm(matrix, axis=1)
    latencies, ranks = [], []
    for question, gold in questions:
        began = time.perf_counter()
        v = np.array(embedder.query(question), float)
        latencies.append(1000 * (time.perf_counter() - began))
        norm = norms * np.linalg.norm(v)
        scores = np.divide(matrix @ v, norm, out=np.zeros(len(keys)), where=norm > 0)
        order = sorted(range(len(keys)), key=lambda i: (scores[i], keys[i]), reverse=True)
        ranks.append(1 + next(i for i, k in enumerate(order) if keys[k] == gold))
    return {
        "dim": matrix.shape[1], "texts_per_second": throughput, "median_ms": float(np.median(latencies)), "longest_ms": max(latencies),
        "r1": sum(r == 1 for r in ranks) / len(ranks), "mrr": sum(1 / r for r in ranks) / len(ranks),
    }
