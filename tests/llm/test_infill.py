"""Fill-in-the-middle against plain Python, and the exact round trip."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from kelpforest.llm import infill, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _plain(doc_id, text):
    """The query's row of one document."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def _rows():
    odd = ["a <P> b", "a <S>", "<M>", "ends in <", "< <S < P> <M <", "\x00 nul \x00", "é ü no-break x", " \t\n", "", None, "x", "  lead", "trail \r\n", "a" * 50, "日本 語 🦉🦉 x"]
    rows = [(i, odd[i % len(odd)]) for i in range(300)]
    rows += [(None, "no id here at all"), (7, "twice"), (7, "twice"), (-3, "below zero is an id"), (1000, "word " * 1_000_000), (1001, "y" * 3_000_000)]
    return rows


def _found(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("size", [infill.SLICE, 64])
def test_edges(spark, monkeypatch, size):
    monkeypatch.setattr(infill, "SLICE", size)
    rows = _rows() if size > 64 else _rows()[:-2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "id", "row", "tokens", "slice", "a.b")})
    assert _found(infill.digests(infill.transform(docs))) == sorted(repr(_plain(*r)) for r in rows)
    assert infill.digests(infill.transform(docs.limit(0))).count() == 0


def test_round_trip(spark):
    rows = [(i, f"< a{i} <P b <S> c" if i % 3 == 0 else f"<<  one {i} <S two <M three ><P <") for i in range(2000)]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), share=100, spm=50).cache()
    assert made.where(infill.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    forms = {r["form"]: r["count"] for r in made.groupBy("form").count().collect()}
    assert forms["plain"] == 667 and abs(forms["psm"] - forms["spm"]) < 150


def test_query(spark, tables):
    found = queries.queries()["op13_infill"](spark, tables)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    texts = con.execute("SELECT doc_id, text FROM documents").fetchall()
    expected = con.execute(queries.oracle_sql()["op13_infill"])
    assert found.columns == [c[0] for c in expected.description]
    assert _found(found) == sorted(repr(_plain(*r)) for r in texts) == sorted(map(repr, expected.fetchall()))
