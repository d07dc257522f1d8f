"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforest.llm import queries, spelling
from kelpforest.llm.common import table


def _words(rows):
    """Counts of the words of (doc_id, text) rows."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def _close(a, b):
    """One insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _expected(n):
    """Rows by comparing all pairs of words that share their length's class."""
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    near = {w: [] for w in n}
    for size, words in by.items():
        for other in (size, size + 1):
            # Letters that two words have in common, as a bound, to leave most pairs out.
            for a in words:
                near[a] += [b for b in by.get(other, ()) if _close(a, b)]
                if other != size:
                    for b in by.get(other, ()):
                        if _close(a, b):
                            near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def _found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def _corpus():
    """Frequent words, their misspellings, repeated letters, accents, and words with a common half."""
    rng = np.random.default_rng(5)
    letters = list("abcdeéü")
    base = ["".join(rng.choice(letters, int(rng.integers(6, 12)))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "abababab", "ababababa"]
    base += ["commonhalf" + "".join(rng.choice(list("xyz"), int(rng.integers(8, 12)))) for _ in range(120)]
    texts = []
    for i, w in enumerate(base):
        times = int(rng.choice([5, 30, 200, 1100]))
        texts.append((i, " ".join([w] * times)))
        for j in range(6):
            at = int(rng.integers(0, len(w)))
            letter = str(rng.choice(letters))
            edited = [w[:at] + w[at + 1 :], w[:at] + letter + w[at + 1 :], w[:at] + letter + w[at:]][j % 3]
            texts.append((1000 + 10 * i + j, f"{edited.upper() if j == 5 else edited}, " * int(rng.integers(4, 40))))
    return [*texts, (None, None), (-1, ""), (None, "short words of six " * 20), (3, texts[3][1]), (5, "x" * 100_000 + " " + "abcdefg " * 100_000)]


@pytest.mark.parametrize(("few", "hot", "held"), [(16, 20_000, 200_000), (0, 20_000, 3), (10**9, 25, 50)])
def test_corpus(spark, monkeypatch, few, hot, held):
    monkeypatch.setattr(spelling, "FEW", few)
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "SHARD", 40)
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "side", "seg", "form", "a.b")})
    found = _found(spelling.variants(docs))
    expected = _expected(_words(rows))
    assert found == expected
    assert any(v[0] for v in found.values()) and any(v[1] != v[0] and v[0] for v in found.values())


def test_close():
    held = [("abcdefgh"[:4] + r, 1, r) for r in ("efgh", "efg", "eefgh", "xfgh", "aaaa", "aaa", "a", "")]
    few, many = spelling.Held(held), spelling.Held(held * 3)
    for rest in ("efgh", "efghh", "aaaa", "aa", "", "b"):
        expected = sorted((w, n) for w, n, r in held if _close(r, rest))
        assert sorted(few.near(rest)) == expected
        assert sorted(many.near(rest)) == sorted(expected * 3)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, tables):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, tables, "documents").select("doc_id", "text").collect()]
    result = queries.queries()["op12_spelling"](spark, tables)
    assert [(c, t) for c, t in result.dtypes] == [(c, "string") for c in ("word", "form", "root")] + [(c, "bigint") for c in ("n", "n_near", "form_n")]
    assert _found(result) == _expected(_words(rows))
