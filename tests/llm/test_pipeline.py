import zlib
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from kelpforest.llm import parsing, quality, simhash
from kelpforest.llm.common import stored, table
from tests.llm.test_llm import _simple_mix


def test_stages(spark, tables):
    docs = table(spark, tables, "documents")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, tables), name)
        sizes.append(docs.count())
        if name != "pack_windows":
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] == sizes[2] > 0 and sizes[4] > 0
    empty = table(spark, tables, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


def _brute_force(rows, kept):
    """The stages one after another, over lists: documents (doc_id, source, text) as they are packed, by service."""
    rows = [r for r in rows if kept[r["doc_id"]]]
    sets = []
    for r in rows:
        words = simhash.plain_words((r["text"] or "").encode())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    bodies = [(r["text"] or "").encode() for r in rows]
    count = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for r, body in zip(rows, bodies, strict=True):
        cut = np.zeros(len(body) + 1, np.int8)
        for i in range(len(body) - 199):
            if count[body[i : i + 200]] > 1:
                cut[i : i + 200] = 1
        edges = np.flatnonzero(np.diff(np.r_[0, cut]))
        out.append({"doc_id": r["doc_id"], "source": r["source"], "text": parsing.kept_text(r["text"], edges.reshape(-1, 2))})
    taken, _, sizes = _simple_mix(out)
    return [(r, taken[i], sizes[i]) for i, r in enumerate(out)]


def test_pipeline_equals_brute_force(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    kept = {i: k for i, k in con.execute(f"SELECT doc_id, kept FROM ({quality.oracle_sql()})").fetchall()}
    rows = sorted(table(spark, tables, "documents").collect(), key=lambda r: r["doc_id"])
    pieces = {}
    for p in corpus_pipeline.run(spark, tables).collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    services = 0
    for r, taken, size in _brute_force(rows, kept):
        texts = [r["text"] or ""] * (taken // size) if size else []
        if size and taken % size:
            words = (r["text"] or "").encode().split()[: taken % size]
            body, at = (r["text"] or "").encode(), 0
            for w in words:
                at = body.index(w, at) + len(w)
            texts.append(body[:at].decode())
        services += len(texts)
        mine = Counter()
        for text in texts:
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
            mine[len(ids)] += len(ids)
            for p in pieces.get(r["doc_id"], []):
                if p["doc_tokens"] == len(ids):
                    own = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
                    assert zlib.crc32(own) == p["ids_crc32"]
        found = Counter()
        for p in pieces.pop(r["doc_id"], []):
            found[p["doc_tokens"]] += p["length"]
        assert found == mine
    assert not pieces and services > 50
