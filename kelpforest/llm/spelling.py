"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Words are counted over all documents in Arrow batches, as counts of a task before
anything is shuffled. A word has two segments, its first half and the remainder. If one
code point is inserted, deleted or replaced, one of the two stays whole, the
first at the start or the second at the end of the other word. So the segments
are dealt over shards by their hash, and each shard makes an Aho-Corasick
automaton of those it holds; every word goes to the shards of the segments that a
word of its length, one less or one more can share with it (four at most) and is
scanned there. A match counts if the segment stands at its place and the lengths
fit; then the distance of what is left is verified. Where many words share a
segment, what is left is looked up by its patterns with one code point out, so a
shard's work follows its rows, not their pairs. Segments of more than ``HOT``
rows aren't gathered in a shard: the same patterns are the key of a join in Spark,
whose groups hold no more words than there are letters and places. Nothing is
dropped or capped.

A pair that both halves tell of counts by the first half only. Per word only the
number of its near words and the best of them leave a shard. Chains of forms end, since
each form is five times as frequent as the one before it, and are followed by
doubling.

Null texts have no words; a null id counts as an empty one; repeated rows count
as often as they come. Ties go to the smaller word in code-point order. An empty
table gives an empty result; other columns than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import LOWER, UPPER, forget, stored

#: Least code points and occurrences of a word, how many times as frequent its form is, and how rarely a run loses a code point.
LEAST_CHARS, LEAST, RATIO, EVERY = 6, 5, 5, 199
#: Maximal runs; shorter ones can't become words.
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}")
#: Distinct words that a task holds before it sends its counts on.
HELD = 200_000
#: Rows of a shard, about; rows of a segment beyond which it is joined; words of a segment beyond which they are looked up by patterns.
SHARD, HOT, FEW = 50_000, 20_000, 16
FIRST, LAST = 0, 1

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.as_py().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_CHARS:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield rows()
                    total.clear()
        yield rows()

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = given.where("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def segments(words: DataFrame) -> DataFrame:
    """(side, k, seg, word, n, entry): a word's own two segments, of k code points, and those that only words one shorter or longer share with it."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    even = size % 2 == 0
    # A neighbour of another length cuts itself elsewhere by one at most: its first half is half - 1 or half + 1, its last one likewise.
    other_first = F.when(even, half - 1).otherwise(half + 1)
    other_last = F.when(even, half + 1).otherwise(half)
    short = F.lit(LEAST_CHARS - 1)
    rows = F.array(
        F.struct(F.lit(FIRST).alias("side"), half.alias("k"), F.lit(True).alias("entry")),
        F.struct(F.lit(LAST).alias("side"), (size - half).alias("k"), F.lit(True).alias("entry")),
        # The neighbour one shorter is a word itself only if it is long enough.
        F.when(~even | (size - 1 > short), F.struct(F.lit(FIRST).alias("side"), other_first.alias("k"), F.lit(False).alias("entry"))),
        F.when(even | (size - 1 > short), F.struct(F.lit(LAST).alias("side"), other_last.alias("k"), F.lit(False).alias("entry"))),
    )
    each = words.select("word", "n", F.explode(F.array_compact(rows)).alias("r")).select("word", "n", "r.side", "r.k", "r.entry")
    segment = F.when(F.col("side") == FIRST, F.left("word", "k")).otherwise(F.right("word", "k"))
    return each.select("side", "k", segment.alias("seg"), "word", "n", "entry")


def patterns(rest: str) -> list[str]:
    """What is left of a word, with each code point in turn taken for any."""
    return [f"{rest[:i]}*{rest[i + 1 :]}" for i in range(len(rest))]


def shortened(rest: str) -> set[str]:
    return {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


class Held:
    """Words that share a segment, to be asked for those one edit away in what is left of them."""

    def __init__(self, words: list[tuple[str, int, str]]):
        """``words``: (word, n, rest)."""
        self.words = words
        self.by: dict[str, list[tuple[str, int]]] | None = None
        if len(words) > FEW:
            self.by = defaultdict(list)
            for word, n, rest in words:
                for key in (*patterns(rest), f"={rest}", *(f"-{s}" for s in shortened(rest))):
                    self.by[key].append((word, n))

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        """Each (word, n) whose rest is exactly one edit away, once."""
        if self.by is None:
            for word, n, other in self.words:
                if len(other) == len(rest):
                    if sum(map(str.__ne__, other, rest)) == 1:
                        yield word, n
                elif len(other) == len(rest) + 1 and rest in shortened(other) or len(other) == len(rest) - 1 and other in shortened(rest):
                    yield word, n
            return
        same = f"={rest}"
        equal = {word for word, _ in self.by.get(same, ())}
        for key in patterns(rest):
            yield from (x for x in self.by.get(key, ()) if x[0] not in equal)
        for s in shortened(rest):
            yield from self.by.get(f"={s}", ())
        yield from self.by.get(f"-{rest}", ())


def scan(rows: pa.Table) -> pa.Table:
    """One shard's (word, near, best_n, best): the near words of each word that it scans, counted, with the best of them."""
    sides, sizes, words, counts, entries = (rows.column(c).to_pylist() for c in ("side", "k", "word", "n", "entry"))
    held: dict[tuple[int, str], list] = defaultdict(list)
    for side, k, word, n, entry in zip(sides, sizes, words, counts, entries, strict=True):
        if entry:
            held[side, word[:k] if side == FIRST else word[-k:]].append((word, n, word[k:] if side == FIRST else word[:-k]))
    automaton = ahocorasick.Automaton()
    for segment in {segment for _, segment in held}:
        automaton.add_word(segment, len(segment))
    out: list[tuple[str, int, int, str]] = []
    if held:
        automaton.make_automaton()
        index = {key: Held(found) for key, found in held.items()}
        for side, k, word in zip(sides, sizes, words, strict=True):
            # Segments may stand anywhere in a word; those at their place count.
            if not any(size == k and end == (k if side == FIRST else len(word)) - 1 for end, size in automaton.iter(word)):
                continue
            segment, rest = (word[:k], word[k:]) if side == FIRST else (word[-k:], word[:-k])
            group = index.get((side, segment))
            if group is None or len(group.words) == 1 and group.words[0][0] == word:
                continue
            near = [(-n, w) for w, n in group.near(rest) if side == FIRST or not word.startswith(w[: len(w) // 2])]
            if near:
                n, best = min(near)
                out.append((word, len(near), -n, best))
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])


def joined(rows: DataFrame) -> DataFrame:
    """As :func:`scan`, of segments that too many words share: patterns of what is left meet as equal keys."""
    rest = F.when(F.col("side") == FIRST, F.substr("word", F.col("k") + 1)).otherwise(F.left("word", F.length("word") - F.col("k")))
    rows = rows.withColumn("rest", rest)

    def cut(mark: str, prefix: str) -> Column:
        one = lambda i: F.concat(F.lit(prefix), F.left("rest", i - 1), F.lit(mark), F.substr("rest", i + 1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("rest")), one))

    same = F.concat(F.lit("="), "rest")
    entries = rows.where("entry").select(
        "side", "seg", F.col("word").alias("best"), F.col("n").alias("best_n"), F.explode(F.concat(cut("*", ""), F.array(same), cut("", "-"))).alias("key")
    )
    asked = rows.select("side", "seg", "word", F.explode(F.concat(cut("*", ""), cut("", "="), F.array(F.concat(F.lit("-"), "rest")))).alias("key"))
    pairs = asked.join(entries, ["side", "seg", "key"]).where("word != best")
    pairs = pairs.where((F.col("side") == FIRST) | ~F.startswith("word", F.left("best", F.floor(F.length("best") / 2).cast("int"))))
    return pairs.select("word", F.lit(1).cast("long").alias("near"), "best_n", "best")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones; ``words`` is (word, n)."""
    rows = segments(words)
    hot = stored(rows.groupBy("side", "seg").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT).select("side", "seg"), "hot-segments")
    some = hot.first() is not None
    cold = rows.join(hot, ["side", "seg"], "left_anti") if some else rows
    shards = max(1, -(-4 * words.count() // SHARD))
    dealt = cold.select(F.pmod(F.xxhash64("side", "seg"), F.lit(shards)).cast("int").alias("shard"), "side", "k", "word", "n", "entry")
    found = dealt.groupBy("shard").applyInArrow(scan, "word string, near long, best_n long, best string")
    if some:
        found = found.unionByName(joined(rows.join(hot, ["side", "seg"], "left_semi")))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return near.select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that starts at a word ends. Steps double each round; rounds are written."""
    state = forms.select("word", F.col("form").alias("root"))
    before = None
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if before is not None:
            forget(before)
        before, state = after, after.drop("moved")
        if after.where("moved").first() is None:
            return state


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = stored(word_counts(docs), "words")
    near = words.join(near_words(words), "word", "left")
    form_n = F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best_n"))
    rows = near.select("word", F.when(form_n.isNotNull(), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))
    rows = stored(rows, "near-words")
    forget(words)
    roots = last_forms(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
