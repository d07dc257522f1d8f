"""Packing tokens into windows by non-negative least squares over a length histogram.

Every task packs its own documents in blocks of about ``BLOCK`` tokens, so
nothing is shuffled, memory is bounded by a block, and a lost task is simply
run again. In a block, whole windows of long documents go out as they are.
Combinations have at most ``DEPTH`` parts, so remainders shorter than a
``DEPTH``-th of a window are first joined to parts of about that size, each time
with the longest that still fits. Parts are counted by length, rounded up to
``UNIT``. All combinations that fill a window exactly are enumerated; least
squares with non-negative repeats fit them to the histogram; repeats are
rounded down, and each combination takes parts of its lengths. What is left is
packed greedily: it is cut to fill the slack of the combinations, then streams
into windows of its own. The end of a task's stream is cut at powers of two,
which need no padding.

Null and empty texts have the end id only. Repeated rows are packed each on
their own. Empty tables give an empty result, extra columns are ignored. A
token lies in one piece only, and pieces of a document have no overlap.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
UNIT = 64
DEPTH = 8
END = 1
BLOCK = 4_000_000
#: Words whose ids a worker remembers, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 500_000, 40

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


#: Words that are split here: printable ASCII and Latin letters, which lower-casing maps one to one. Others go through the whole tokenizer.
_SIMPLE = regex.compile(r"(?:(?!<\|)[!-~\u00C0-\u012F\u0131-\u024F]){1,64}")
#: The vocabulary's own way to cut a word, as its file gives it.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


class _Words:
    """Ids of words as little-endian 32-bit numbers; words are white-space separated, which the vocabulary never crosses."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            found = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled))
            if len(self.pieces) > CACHE_WORDS:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def _encode(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or _SIMPLE.fullmatch(word)):
            return self._piece(word) if word.islower() else self._piece(word.lower())
        if _SIMPLE.fullmatch(word):
            return b"".join(map(self._piece, _PIECES.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """A dictionary that holds ``words``; long ones aren't kept."""
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        found = {w: self._encode(w) for w in words.difference(self.known)}
        self.known.update((w, x) for w, x in found.items() if len(w) <= CACHE_CHARS)
        return self.known if all(len(w) <= CACHE_CHARS for w in found) else self.known | found


def token_ids(texts: list[str | None], words: _Words) -> list[np.ndarray]:
    # The vocabulary is lower case; sigma alone is lowered by its place in Python, and not in the tokenizer.
    split = [(x if "\u03a3" in x else x.lower()).replace("\n", " ").split(" ") if x else [] for x in texts]
    known = words.learn(set().union(*split))
    end = END.to_bytes(4, "little")
    return [np.frombuffer(b"".join((*map(known.__getitem__, x), end)), "<u4") for x in split]


@cache
def combinations(total: int, depth: int) -> np.ndarray:
    """Counts, a row per part size from 1 and a column per way to write ``total`` as at most ``depth`` parts."""
    ways: list[list[int]] = []

    def extend(parts: list[int], left: int, most: int) -> None:
        if not left:
            ways.append(parts)
            return
        slots = depth - len(parts)
        for part in range(min(left, most), 0, -1):
            if part * slots < left:
                break
            extend([*parts, part], left - part, part)

    extend([], total, total)
    out = np.zeros((total, len(ways)))
    for column, parts in enumerate(ways):
        for part in parts:
            out[part - 1, column] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Least squares with non-negative coefficients by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = 0
        best = int(np.argmax(gradient))
        if gradient[best] <= scale * 1e3:
            break
        active.append(best)
        while active:
            fit = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if fit.min() > 0:
                x[:] = 0
                x[active] = fit
                break
            now = x[active]
            low = fit <= 0
            step = np.min(now[low] / np.maximum(now[low] - fit[low], 1e-300))
            now = now + step * (fit - now)
            x[:] = 0
            x[active] = np.maximum(now, 0)
            active = [i for i, v in zip(active, now, strict=True) if v > 1e-12]
    return x


def bundles(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Indices into ``lengths``, those of up to ``most`` joined: each bundle takes the longest that fits until none does."""
    out = [[int(i)] for i in np.flatnonzero(lengths > most)]
    order = np.argsort(-lengths, kind="stable")
    queues: dict[int, list[int]] = {}
    for i in order[lengths[order] <= most].tolist():
        queues.setdefault(int(lengths[i]), []).append(i)
    have = sorted(queues)
    while have:
        room, bundle = most, []
        while room and (at := bisect_right(have, room)):
            length = have[at - 1]
            # As many of this length as fit.
            queue, n = queues[length], room // length
            bundle += queue[-n:]
            room -= length * len(queue[-n:])
            del queue[-n:]
            if not queue:
                del have[at - 1]
        out.append(bundle)
    return out


def combine(lengths: np.ndarray, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[list[int]]:
    """Sets of indices into ``lengths`` that each fit a window, by rounded least-squares repeats.

    Sets are given back from the end until what is left covers their slack.
    """
    parts = bundles(lengths, window // depth)
    totals = np.array([int(lengths[p].sum()) for p in parts])
    size = -(-totals // unit)
    bins = window // unit
    queues = [np.flatnonzero(size == q).tolist()[::-1] for q in range(1, bins + 1)]
    have = np.array([len(q) for q in queues])
    ways = combinations(bins, depth)
    repeats = np.floor(nnls(ways, have.astype(float)) + 1e-6).astype(int)
    out = []
    for way in np.flatnonzero(repeats):
        need = ways[:, way].astype(int)
        used = np.flatnonzero(need)
        times = min(int(repeats[way]), int((have[used] // need[used]).min()))
        have -= times * need
        for _ in range(times):
            out.append([queues[q].pop() for q in used for _ in range(need[q])])
    left = sum(int(totals[i]) for q in queues for i in q)
    slack = sum(window - int(totals[s].sum()) for s in out)
    while out and left < slack:
        back = int(totals[out.pop()].sum())
        left, slack = left + back, slack - (window - back)
    return [[i for p in s for i in parts[p]] for s in out]


class Packer:
    """Takes documents, gives pieces (document, start, length, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.next = window, first_sequence
        self.waiting: list[tuple[int, int, int]] = []  # document, start, length; yet to be streamed
        self.filled = 0

    def _take(self) -> int:
        self.next += 1
        return self.next - 1

    def block(self, lengths: list[int]) -> list[tuple[int, int, int, int, int]]:
        """Pieces of a block's documents, numbered from 0; all of them, as the stream ends with the block."""
        out = []
        rest = []
        for doc, n in enumerate(lengths):
            whole = n // self.window * self.window
            out += [(doc, at, self.window, self._take(), 0) for at in range(0, whole, self.window)]
            if n > whole:
                rest.append((doc, whole, n - whole))
        sizes = np.array([r[2] for r in rest], np.int64)
        sets = combine(sizes, self.window) if rest else []
        placed = {i for s in sets for i in s}
        stream = [r for i, r in enumerate(rest) if i not in placed][::-1]

        def fill(sequence: int, offset: int, end: int) -> None:
            while offset < end:
                doc, at, n = stream.pop()
                taken = min(n, end - offset)
                if taken < n:
                    stream.append((doc, at + taken, n - taken))
                out.append((doc, at, taken, sequence, offset))
                offset += taken

        for members in sets:
            sequence, offset = self._take(), 0
            for i in members:
                doc, at, n = rest[i]
                out.append((doc, at, n, sequence, offset))
                offset += n
            fill(sequence, offset, self.window)
        left = sum(r[2] for r in stream)
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            fill(self._take(), 0, size)
            left -= size
        return out


def _packed(path: str, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(path)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        ids: list[np.ndarray] = []
        names: list = []
        held = 0

        def flush():
            pieces = packer.block([len(x) for x in ids])
            for i in range(0, len(pieces), 4096):
                doc, start, length, sequence, offset = zip(*pieces[i : i + 4096], strict=True)
                yield pa.record_batch(
                    [
                        pa.array([names[d] for d in doc], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([len(ids[d]) for d in doc], pa.int64()),
                        pa.array(sequence, pa.int64()),
                        pa.array(offset, pa.int64()),
                        pa.array([ids[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                found = token_ids(some.column(1).to_pylist(), words)
                names += some.column(0).to_pylist()
                ids += found
                held += sum(map(len, found))
                if held >= BLOCK:
                    yield from flush()
                    ids, names, held = [], [], 0
        if ids:
            yield from flush()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids), ids as little-endian 32-bit numbers.

    ``vocabulary`` is the path of a tokenizer file that exists on every executor.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packed(str(vocabulary), window), PIECE)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
