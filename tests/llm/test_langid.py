"""Language identification: accuracy on texts that weren't learnt from, calibration, edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforest.llm import langid, queries

TABLES = "/root/testdata/sf0.01"
WORDS = {
    "de": "und der die das nicht ist ein für auf mit über schön straße wäre können zwischen",
    "en": "and the that this not is one for with over between would could nice street which",
    "fr": "et le la les des ne pas est un pour avec être français rue entre voudrait où",
    "el": "και το της στον είναι δεν για με από δρόμος ωραία μεταξύ",
    "ja": "これ は 日本語 です そして とても 長い 文章 では ない",
}


def _texts(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % len(WORDS)]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(1, 60)))), lang))
    return rows


@pytest.fixture(scope="module")
def result(spark):
    return queries.queries()["op11_langid"](spark, TABLES).cache()


def test_query(spark, result):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang")
    assert result.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = {r["doc_id"]: r for r in result.collect()}
    found = {d["doc_id"]: d for d in docs.collect()}
    assert sorted(rows) == sorted(found)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    own = [i for i, r in rows.items() if r["held_out"]]
    right = [rows[i]["lang_pred"] == found[i]["lang"] for i in own]
    assert np.mean(right) > 0.97
    # The mean score is the share of right answers, within a few hundredths.
    assert abs(np.mean([rows[i]["score"] for i in own]) - np.mean(right)) < 0.03


def test_alphabets_and_edges(spark):
    train = _texts(1, 600)
    odd = [(-1, None, "en"), (-2, "", "de"), (-3, "12 + 3 = 15 !?", "en"), (None, "le français est une langue", None), (-4, "the and of " * 300_000, "en"), (-5, "straße", "de"), (-5, "straße", "de")]
    extra = {c: F.lit(1) for c in ("key", "place", "most", "held_out", "score", "kinds", "a.b")}
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").withColumns(extra)
    found = langid.identify(docs).collect()
    assert len(found) == len(train) + len(odd)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (-1, -2, -3))
    assert by[None]["lang_pred"] == "fr" and by[None]["held_out"] is False
    assert by[-4]["lang_pred"] == "en" and by[-5]["lang_pred"] == "de"
    right = [by[i]["lang_pred"] == lang for i, _, lang in train if by[i]["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    again = langid.identify(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "only one", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(one).collect()} == {("xx", 1.0)}


def test_held_out_rows_teach_nothing(spark):
    """Their labels can be anything."""
    rows = _texts(2, 300)
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    assert sorted(langid.identify(spark.createDataFrame(rows, schema)).collect()) == sorted(langid.identify(spark.createDataFrame(lied, schema)).collect())


def test_n_grams_equal_slow_ones():
    """As many as there are in the cleaned text, in short and in long texts; equal n-grams are of a kind."""
    for times in (1, 900):
        text, clean = "Ab, é2x ABBA  ß日本! " * times, " " + "ab é x abba ß日本 " * times
        kinds, counts = langid.n_grams(text.encode())
        assert counts.sum() == sum(len(clean) - n + 1 for n in range(1, langid.ORDERS + 1))
        assert len(kinds) == len({clean[i : i + n] for n in range(1, langid.ORDERS + 1) for i in range(len(clean) - n + 1)})
        assert counts.max() == clean.count(" ") and (np.diff(kinds) > 0).all()
    assert not len(langid.n_grams(None)[0]) and not len(langid.n_grams(b"12 _")[0])


def test_leader_equals_the_published_update():
    """One coordinate at a time, as the algorithm is written."""
    rng = np.random.default_rng(0)
    size, langs = 12, 3
    leader = langid.Leader(np.zeros((size + 1, langs)), np.zeros((size + 1, langs)))
    z, n = np.zeros((size + 1, langs)), np.zeros((size + 1, langs))
    for _ in range(60):
        kinds = np.sort(rng.choice(size, 4, replace=False))
        x, y = rng.random(4), int(rng.integers(langs))
        leader.learn(kinds, x, y)
        w = np.zeros_like(z)
        for i in range(size + 1):
            for c in range(langs):
                if abs(z[i, c]) > langid.L1:
                    w[i, c] = -(z[i, c] - np.sign(z[i, c]) * langid.L1) / ((langid.BETA + n[i, c] ** 0.5) / langid.ALPHA + langid.L2)
        full = np.zeros(size + 1)
        full[kinds], full[-1] = x, 1
        p = np.exp(full @ w) / np.exp(full @ w).sum()
        for i in [*kinds, size]:
            for c in range(langs):
                g = (p[c] - (c == y)) * full[i]
                sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / langid.ALPHA
                z[i, c] += g - sigma * w[i, c]
                n[i, c] += g * g
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)
    assert (leader.weights(slice(None)) == 0).any()
