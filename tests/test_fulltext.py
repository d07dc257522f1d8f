"""Phrases, words and prefixes against plain Python; chains with cycles."""

import random
import re

from pyspark.sql import functions as F

from kelpforest.operators import fulltext, notes


def _words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def _phrase(text, phrase):
    """Starts of a phrase in a text; words that aren't indexed may be anything."""
    have, due = _words(text), [(i, w) for i, w in enumerate(_words(phrase)) if 2 <= len(w) <= 30]
    return [s for s in range(len(have)) if due and all(s + i < len(have) and have[s + i] == w for i, w in due)]


def test_search(spark):
    rng = random.Random(3)
    some = "to be or not straße été x " + "y" * 31 + " been beer"
    texts = [(i, rng.choice([" ", ", ", "-_-"]).join(rng.choices(some.split(), k=rng.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "To BE, or not to be"), (503, "beer " * 50_000)]
    asked = [(1, "to be or"), (2, "be be"), (3, "x"), (4, "not x to"), (5, ""), (6, "STRASSE ÉTÉ"), (7, "straße ÉTÉ"), (8, "nowhere to"), (9, "y" * 31 + " be"), (10, "to be or not to be"), (11, None)]
    index = fulltext.build(spark.createDataFrame(texts, "k long, body string"), "k", "body").cache()
    queries = spark.createDataFrame(asked, "q int, t string")
    expected = {(q, i, len(s), s[0]) for q, t in asked for i, body in texts if (s := _phrase(body, t))}
    assert set(map(tuple, fulltext.phrase_search(index, queries, "q", "t").collect())) == expected
    assert set(map(tuple, fulltext.phrase_search(index, queries, "q", "t", fulltext.frequencies(index)).collect())) == expected
    due = {q: {w for w in _words(t) if 2 <= len(w) <= 30} for q, t in asked}
    assert set(map(tuple, fulltext.all_words(index, queries, "q", "t").collect())) == {(q, i) for q, ws in due.items() for i, body in texts if ws and ws <= set(_words(body))}
    prefixes = [(1, "be"), (2, "BEE"), (3, "b"), (4, None), (5, "zz"), (6, "ét")]
    found = fulltext.prefix_search(index, spark.createDataFrame(prefixes, "q int, p string"), "q", "p").collect()
    assert set(map(tuple, found)) == {(q, i, n) for q, p in prefixes if p and len(p) > 1 for i, body in texts if (n := sum(w.startswith(p.lower()) and len(w) <= 30 for w in _words(body)))}


def test_an_index_of_asked_words_alone(spark):
    """Places count all words, rows are of asked ones only; found is what the whole index finds."""
    texts = spark.createDataFrame([(i, f"to be or w{i} not été bee beer x to be") for i in range(20)] + [(50, None)], "k long, body string")
    asked = spark.createDataFrame([(1, "to be or"), (2, "w3 not"), (3, "x"), (4, "été bee")], "q int, t string")
    whole, some = fulltext.build(texts, "k", "body"), fulltext.build(texts, "k", "body", fulltext.phrases(asked, "q", "t"))
    assert some.select("word").distinct().count() == 7 < whole.select("word").distinct().count()
    rows = lambda found: sorted(map(tuple, found.collect()))
    assert rows(fulltext.phrase_search(some, asked, "q", "t")) == rows(fulltext.phrase_search(whole, asked, "q", "t")) != []
    begins = spark.createDataFrame([(1, "be"), (2, "BEE"), (3, "w1"), (4, None), (5, "be")], "q int, p string")
    some = fulltext.build(texts, "k", "body", fulltext.prefixes(begins, "q", "p"))
    assert {r["word"] for r in some.select("word").collect()} == {"be", "bee", "beer", "w1"} | {f"w{i}" for i in range(10, 20)}
    assert rows(fulltext.prefix_search(some, begins, "q", "p")) == rows(fulltext.prefix_search(whole, begins, "q", "p")) != []


def test_chains(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, 201), (201, 202), (202, 200), (210, 211), (211, 201), (300, 300), (301, 300), (400, 401), (400, 402), (402, 403), (None, 1), (7, None)]
    links += [(1000 + i, 1000 + (i + 1) % 37) for i in range(37)] + [(2000 + i, 2000 + i + 1) for i in range(50)] + [(2050, 1005)] + [(x, rng.randrange(5000, 5100)) for x in range(5000, 5100)]
    step = {}
    for a, b in links:
        if a is not None and b is not None:
            step[a] = max(b, step.get(a, b))
    expected = set()
    for a in step:
        seen, at = [a], step[a]
        while at in step and at not in seen:
            seen.append(at)
            at = step[at]
        expected.add((a, min(seen[seen.index(at) :]), None, True) if at in seen else (a, at, len(seen), False))
    assert set(map(tuple, notes.chains(spark.createDataFrame(links, "id long, next long")).collect())) == expected
    assert notes.chains(spark.createDataFrame([], "id long, next long")).count() == 0
    # By letters, too.
    named = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "id string, next string")
    assert {(r["id"], r["head"], r["cyclic"]) for r in notes.chains(named).collect()} == {(x, "a", True) for x in "abc"}


def test_words_are_lower_case_runs(spark):
    row = spark.createDataFrame([("Über-Maß_x 42, l'été",)], "t string").select(fulltext.words(F.col("t")).alias("w")).first()
    assert row["w"] == ["über", "maß", "x", "42", "l", "été"]
