"""Training-data operators against brute force, with nulls, ties, empty tables, repeated rows and clashing columns."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kelpforest.llm import components, curves, licenses, mixing, packing, parsing, quality, queries, simhash, suffixtree, urlgraph, warc
from kelpforest.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox of the hills is on its way to the river and it sees that the water is as cold as ice in the winter. "


def _edge_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(3000))
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 3),
        (4, PROSE * 3, "en", "b", 1),
        (4, PROSE * 3, "en", "b", 1),
        (None, "a b c", "en", None, 1),
        (5, long, "en", "c", 1),
        (6, "é" * 300 + " " + PROSE, "fr", "é", 1),
        (7, PROSE * 3 + "end", "en", "a", 1),
        (8, "<|endoftext|> it's " + PROSE, "en", "a", 1),
        (9, "x" * 5000, "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def edge(spark):
    out = spark.createDataFrame(_edge_rows(), DOCS).withColumn("text2", F.lit(1)).withColumn("size", F.lit("clash")).withColumn("mark", F.lit(None).cast("int"))
    clashes = "_m _W _h _s _p _l _n _row _text spans _spans _mark _doc _key _b _r row key root first __m a.b services taken at".split()
    return out.withColumns({c: F.lit(i) for i, c in enumerate(clashes)})


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def texts(spark, tables):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, tables, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    expected = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in expected.description)
    rows = sorted(str([r[[c[0] for c in expected.description].index(x)] for x in columns]) for r in expected.fetchall())
    found = queries.queries()[name](spark, tables)
    assert sorted(found.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in found.collect()) == rows


def test_quality_edges(edge, empty):
    rows = quality.judge(edge).collect()
    assert len(rows) == len(_edge_rows())
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, None))
    kept = quality.filter_quality(edge)
    assert kept.columns == edge.columns
    passed = Counter(str(r["doc_id"]) for r in rows if r["kept"])
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in edge.collect() if passed[str(r["doc_id"])])
    assert quality.judge(empty).count() == 0
    words = " ".join(f"word{i}" for i in range(40)) + " is the of and"
    again = edge.sparkSession.createDataFrame([(1, words + " " + " ".join(f"word{i}" for i in range(8)))], "doc_id long, text string")
    assert quality.judge(again).first()["n_repeat_words"] == 16


def _simple_mix(rows, weights=(5, 2, 1), epochs=3):
    """Services one by one in the order of their finish: {row number: words}, and targets by source."""
    sizes = [len((r["text"] or "").encode().split()) for r in rows]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    of = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r["source"] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, open_, rest = {}, list(sources), sum(of.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * rest > epochs * of[s] * total]
        if not full:
            target |= {s: weight[s] * float(rest) / total for s in open_}
            break
        target |= {s: float(epochs * of[s]) for s in full}
        rest -= sum(epochs * of[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    key = lambda r: hashlib.md5(f"mix-1:{r['doc_id'] if r['doc_id'] is not None else 'null:' + hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
    services = []
    for rank, s in enumerate(sources):
        before = 0
        for i in sorted((i for i, r in enumerate(rows) if r["source"] == s), key=lambda i: (key(rows[i]), sizes[i])):
            services += [((e * of[s] + before + sizes[i]) / target[s], rank, e, i) for e in range(epochs) if sizes[i]]
            before += sizes[i]
    left, taken = sum(of.values()), Counter()
    for *_, i in sorted(services):
        taken[i] += min(left, sizes[i])
        left -= min(left, sizes[i])
    return taken, target, sizes


def test_mixing_edges(edge, empty):
    listed = edge.collect()
    taken, target, sizes = _simple_mix(listed)
    rows = mixing.plan(edge.drop("size")).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows) == sorted((str(r["doc_id"]), n, taken[i]) for i, (r, n) in enumerate(zip(listed, sizes, strict=True)))
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(target)
    by = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
        by[r["source"]] += r["taken"]
    assert sum(by.values()) == sum(sizes)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert [r["taken"] for r in mixing.plan(edge.where("doc_id < 3")).collect()] == [0, 0]
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
        assert r["_row"] == listed[0]["_row"] and r["a.b"] == listed[0]["a.b"]
    assert words == Counter({k: v for k, v in by.items() if v})
    assert sorted(map(str, mixing.plan(edge).collect())) == sorted(map(str, mixing.plan(edge.repartition(5)).collect()))


def test_mixing_comes_near_its_targets(spark, tables):
    docs = table(spark, tables, "documents")
    listed = docs.collect()
    taken, target, _ = _simple_mix(listed)
    rows = mixing.plan(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: taken[i] for i, r in enumerate(listed)}
    by, longest = Counter(), Counter()
    for r in rows:
        by[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(by[s] - t) <= 2 * longest[s] for s, t in target.items())


def test_urls(spark):
    link = '<a href="https://bad.example.org/es/1">x</a>'
    rows = [(1, "https://near.test/x", link), (2, "https://bad.example.org/es/1", ""), (3, None, None), (4, "nothing", "x"), (5, "http://EXAMPLE.com/en/7?q", ""), (6, "http://a.com/en/", ""), (7, "x://far.test?y", '<a href="//near.test/">'), (6, "http://a.com/en/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlgraph.judge(pages).collect()}
    assert got[1] == ("near.test", "/x", None, "block")
    assert got[2][2:] == ("org/es/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[6][2:] == ("com/en/", "block")
    assert urlgraph.judge(pages.limit(0)).count() == 0


def test_distrust_does_not_depend_on_the_number_of_links(spark, tmp_path):
    bad, good = "https://bad.example.org/es/1", "http://fine.test/"
    a = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    rows = [(1, bad, a("http://x.test/")), (2, "https://good.net/de/1", a("http://praised.test/"))]
    # 60 hosts that link to the blocked one alone, 60 that do in one link of ten, and one that links to the first 60.
    rows += [(100 + i, f"http://only{i}.test/", a(bad)) for i in range(60)]
    rows += [(200 + i, f"http://rarely{i}.test/", a(bad, *(f"http://other{k}.test/" for k in range(9)))) for i in range(60)]
    rows += [(300, "http://list.test/", a(*(f"http://only{i}.test/" for i in range(60)))), (301, "http://praised.test/", a(good)), (302, good, None), (303, None, a(bad))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlgraph.judge(pages).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 300, *range(100, 160)}
    # The SQL, over the same links between hosts.
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = queries.queries()["op3_urlgraph"](spark, str(tmp_path)).collect()
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert sorted(str([r[c] for c in columns]) for r in found) == sorted(str(list(r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({urlgraph.oracle_sql()})").fetchall())


def test_packing_round_trip(spark, tables, edge, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (edge.where("doc_id != 4"), table(spark, tables, "documents")):
        pieces = packing.pack(docs).collect()
        by_doc, by_sequence = {}, {}
        for p in pieces:
            by_doc.setdefault(p["doc_id"], []).append(p)
            by_sequence.setdefault(p["sequence_id"], []).append(p)
        for r in docs.collect():
            own = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"])
            ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own])
            assert ids.tolist() == [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            assert [p["start"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        for members in by_sequence.values():
            members.sort(key=lambda p: p["offset"])
            total = sum(p["length"] for p in members)
            assert [p["offset"] for p in members] == np.cumsum([0, *(p["length"] for p in members)])[:-1].tolist()
            assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(empty).count() == 0
    digest = packing.digests(packing.pack(edge)).first()
    assert set(digest.asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_least_squares():
    random = np.random.default_rng(1)
    a, x = random.random((12, 30)), np.zeros(30)
    x[[3, 8, 20]] = [1, 5, 2]
    fit = packing.nnls(a, a @ x)
    assert fit.min() >= 0 and np.linalg.norm(a @ fit - a @ x) < 1e-6
    assert packing.combinations(6, 3).T @ np.arange(1, 7) == pytest.approx(6)


def _brute_cuts(bodies, length=200):
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        cut = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cut[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cut[: len(b)]])
        out.append((len(b), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("few", [1, 12])
def test_repeats(spark, edge, monkeypatch, few):
    random = np.random.default_rng(5)
    word = lambda: "".join(random.choice(list("abcdeé"), 6))
    shared = " ".join(word() for _ in range(60))
    rows = [(100 + i, " ".join(word() for _ in range(40)) + shared[i % 7 * 9 :] + " ".join(word() for _ in range(40))) for i in range(20)]
    rows += [(200, "ab" * 400), (201, "z" * 1000), (202, "ab" * 101)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    monkeypatch.setattr(parsing, "SLICE", 900)
    if few == 1:
        whole = parsing.repeated_spans
        monkeypatch.setattr(parsing, "repeated_spans", lambda d, length: whole(d, length, 1))
    listed = docs.collect()
    expected = sorted(zip((str(r["doc_id"]) for r in listed), _brute_cuts([(r["text"] or "").encode() for r in listed]), strict=True))
    got = sorted((str(r["doc_id"]), (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in parsing.digests(docs).collect())
    assert got == expected


def test_rows_that_repeat_have_their_spans_once(spark):
    text = " ".join(f"word{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text)] * 300 + [(None, text[:900])] * 20 + [(2, "else " + text[500:800])], "doc_id long, text string")
    spans = parsing.repeated_spans(docs)
    sizes = {r["doc_id"]: r["n"] for r in spans.select("doc_id", F.size("spans").alias("n")).collect()}
    assert sizes[1] <= len(text) // 20
    assert {(r["doc_id"], r["n_removed"]) for r in parsing.digests(docs).collect()} == {(1, len(text)), (None, 900), (2, 300)}


def test_phrase_names_read_every_byte():
    random = np.random.default_rng(11)
    long = 0
    for _ in range(40):
        text = random.integers(97, 123, 800).astype(np.uint8)
        ends = np.array([800])
        _, at, size, gram, whole = parsing.phrases(text, np.array([0]), ends)
        for i in np.flatnonzero(size > 129):
            long += 1
            for offset in range(size[i] + 199):
                other = text.copy()
                other[at[i] + offset] ^= 1
                _, at2, size2, gram2, whole2 = parsing.phrases(other, np.array([0]), ends)
                same = (at2 == at[i]) & (size2 == size[i]) & (gram2 == gram[i])
                assert whole[i] not in whole2[same]
    assert long


def test_cut_keeps_columns(edge, empty):
    assert parsing.cut_repeats(edge).columns == edge.columns
    assert parsing.digests(empty).count() == 0
    assert parsing.kept_text("aéb", np.array([[2, 3]])) == "aéb"
    assert parsing.kept_text("aéb", np.array([[1, 3]])) == "ab"


def _simple_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, tables, edge, empty):
    docs = table(spark, tables, "documents").select("doc_id", "text").unionByName(edge.where("doc_id > 4").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    listed = docs.collect()
    prints = [_simple_print(r["text"]) for r in listed]
    roots = _groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for root, r in zip(roots, listed, strict=True):
        least[root] = min(least.get(root, 1 << 60), r["doc_id"])
    got = {r["doc_id"]: (r["f"], r["component_id"]) for r in simhash.groups(docs).withColumn("f", simhash.hexed("fp")).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", least[root]) for r, p, root in zip(listed, prints, roots, strict=True)}
    assert simhash.groups(empty).count() == 0
    zero = {r["doc_id"] for r in simhash.groups(edge).where("fp = 0").collect()}
    assert zero == {1, 2, 3}


def test_long_runs_connect_alike():
    random = np.random.default_rng(3)
    center = random.integers(0, 1 << 63, dtype=np.uint64)
    prints = np.unique(np.array([center ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in random.integers(0, 60, (80, 2))], np.uint64))
    keys = np.zeros(len(prints), np.int64)
    of = lambda small: {frozenset(g) for g in _sets_of(prints, *simhash.run_links(keys, prints, small=small))}
    assert of(4) == of(1000)


def _sets_of(nodes, a, b):
    at = {int(x): i for i, x in enumerate(nodes)}
    roots = _groups(len(nodes), [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)])
    out = {}
    for i, r in enumerate(roots):
        out.setdefault(r, []).append(i)
    return out.values()


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 100), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark, edge):
    words = [f"word{i}" for i in range(300)]
    near = [*words[:150], "other", *words[151:]]
    far = [f"else{i}" for i in range(300)]
    rows = [(10, " ".join(words)), (11, " ".join(near)), (12, " ".join(far)), (13, " ".join(words)), (14, None), (15, ""), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [10, 12, 14]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 4").count() <= 1


def _similar_groups(texts, least=0.8):
    """Brute force: the first of each component of texts whose sets of five-word shingles have a Jaccard similarity of ``least``."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return sorted(set(_groups(len(sets), links)))


def test_one_of_each_in_long_runs(spark):
    random = np.random.default_rng(2)
    template = [f"t{i}" for i in range(300)]
    texts = []
    # Below 0.8 with each other, and with the near copies that follow.
    for single in range(300):
        at = int(random.integers(0, 268))
        texts.append([*template[:at], *(f"s{single}x{i}" for i in range(32)), *template[at + 32 :]])
    for pair in range(12):
        at = 20 * pair
        own = [*template[:at], *(f"p{pair}x{i}" for i in range(36)), *template[at + 36 :]]
        texts += [own, [f"q{pair}" if i in (3, 250, 290) else w for i, w in enumerate(own)]]
    # A large group of near copies.
    texts += [[f"n{i}" if i != k else "other" for i in range(300)] for k in range(60)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    expected = _similar_groups(texts)
    assert len(expected) == 312
    assert kept == expected


def test_layers_hold_every_open_pair():
    random = np.random.default_rng(6)
    nodes = np.sort(random.choice(1000, 70, replace=False))
    words = random.integers(0, 1 << 63, 8, dtype=np.uint64) ^ (random.integers(0, 1 << 63, (70, 8), dtype=np.uint64) & random.integers(0, 1 << 63, (70, 8), dtype=np.uint64))
    sure = random.integers(0, 40, 70)
    bits = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    most = int(np.median(bits))
    expected = {(nodes[i], nodes[j]) for i in range(70) for j in range(i) if sure[i] != sure[j] and bits[i, j] <= most}
    found, low, high = set(), 0, 2
    while low < 70:
        a, b = simhash.layer_pairs(nodes, words, sure, np.arange(70), most, low, high)
        found |= {(max(p, q), min(p, q)) for p, q in zip(a, b, strict=True)}
        low, high = high, high * 4
    assert found == expected
    joined = simhash._joined(8, np.array([5, 1, 6]), np.array([1, 7, 2]))
    assert joined.tolist() == [0, 1, 2, 3, 4, 1, 2, 1]


def test_can_link(spark, monkeypatch):
    """Equals counting by hand, whatever the number of slices and batches; a link is never given up."""
    rng = np.random.default_rng(7)
    base = np.arange(1000, 1040, dtype="<u8")
    sets = [base, base, base[:0], *(np.unique(np.r_[base[k % 9 :], rng.integers(1 << 60, size=k, dtype="u8")]).astype("<u8") for k in range(60))]
    count = Counter(x for s in sets for x in s.tolist())
    due = {i for i, s in enumerate(sets) if sum(count[x] > 1 for x in s.tolist()) >= 0.8 * len(s)}
    linked = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(a) and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))}
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "row long, shingles binary").repartition(3)
    for size in (1 << 20, 100):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert {r["row"] for r in simhash.can_link(rows, 0.8).collect()} == due >= linked
    assert len(linked) > 5 and len(due) < len(sets) and simhash.can_link(rows.limit(0), 0.8).count() == 0


def test_one_of_each_around_the_limit(spark):
    random = np.random.default_rng(8)
    texts = []
    for group in range(3):
        template = [f"g{group}w{i}" for i in range(240)]
        for member in range(250):
            # One stretch of other words: similarities with the template from 0.65 to 0.95.
            size = int(random.integers(4, 40))
            at = int(random.integers(0, 240 - size))
            texts.append(" ".join([*template[:at], *(f"x{group}y{member}z{i}" for i in range(size)), *template[at + size :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    expected = _similar_groups(texts)
    # Of the documents that are due to go, nearly all go; none goes without a link.
    due = len(texts) - len(expected)
    assert set(expected) <= set(kept) and len(texts) - len(kept) >= 0.97 * due > 200


def test_open_pairs_make_no_rows(spark, monkeypatch):
    """Members that are almost alike never connect, so all of their pairs are open; none of them is a row."""
    template, rows = [f"t{i}" for i in range(300)], Counter()
    stretch = lambda name: [f"{name}x{i}" for i in range(34)]
    texts = [" ".join([*template[:60], *stretch(f"a{i}"), *template[94:200], *stretch(f"b{j}"), *template[234:]]) for i in range(14) for j in range(14)]
    plain, n = simhash.stored, len(texts)

    def counted(df, name):
        out = plain(df, name)
        if {"a", "b"} <= set(out.columns):
            rows["distances" if name == "distances" else "links" if out.columns == ["a", "b"] else name] += out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == n == len(_similar_groups(texts))
    # Sets of a few have a row for each pair; there are no more such rows of larger ones.
    assert 0 < rows["distances"] and rows["links"] < 2 * n


def test_parts_of_sets_meet(spark, monkeypatch):
    """However small the parts that sets are cut into, what they find is the same."""
    random = np.random.default_rng(10)
    texts = []
    for member in range(120):
        size, template = int(random.integers(4, 40)), [f"w{i}" for i in range(240)]
        at = int(random.integers(0, 240 - size))
        texts.append(" ".join([*template[:at], *(f"y{member}z{i}" for i in range(size)), *template[at + size :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = lambda: sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    expected = kept()
    monkeypatch.setattr(simhash, "PART", 25)
    monkeypatch.setattr(simhash, "PART_SHINGLES", 3000)
    assert kept() == expected and 1 < len(expected) < 110


def test_open_links():
    """Connect what brute force over all open pairs connects, by a link for each root at most."""
    random = np.random.default_rng(11)
    sets = [np.unique(np.r_[np.arange(int(x), int(x) + 50), random.integers(1000, 2000, 4)]).astype("<u8") for x in np.sort(random.integers(0, 200, 60))] + [np.empty(0, "<u8")]
    n = len(sets)
    nodes, words = np.arange(n) * 3 + 1, np.zeros((n, 8), np.uint64)
    first = nodes.copy()
    first[[5, 40]] = first[2]
    sizes = np.array([len(x) for x in sets])
    a, b = simhash.open_links(nodes, words, first, (sizes, sizes, 0.8), sets, 512)
    alike = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    same = [(2, 5), (2, 40)]
    assert _groups(n, [*same, *((x // 3, y // 3) for x, y in zip(a.tolist(), b.tolist(), strict=True))]) == _groups(n, [*same, *alike])
    assert 0 < len(a) < len(set(first)) and 1 < len(set(_groups(n, alike))) < 50


def test_licenses(spark, edge, empty):
    rows = [(1, "x. Under the MIT-License! under the mit license"), (2, None), (3, "Licensed under the Apache License, Version 2.0."), (4, "the GNU General Public License, version 3"), (5, "a license for the mit under"), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 5, "mit")
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, 0, None, "", 0.0)
    assert got[3]["labels"] == "apache-2" and got[6]["labels"] == "gpl-3" and got[6]["base_labels"] == ""
    assert got[5]["labels"] == "" and all(0 <= r["score"] <= 1 for r in got.values())
    assert licenses.scan(empty).count() == 0 and licenses.scan(edge).count() == len(_edge_rows())


def test_licenses_beside_each_other(spark):
    rows = [(i, f"{a.text} . {b.text}") for i, (a, b) in enumerate((a, b) for a in licenses.TEMPLATES for b in licenses.TEMPLATES)]
    labels = [{a.label, b.label} for a in licenses.TEMPLATES for b in licenses.TEMPLATES]
    stray = " ".join(w for t in licenses.TEMPLATES for w in reversed(t.text.split()))
    rows += [(len(rows) + i, f"{stray} . {t.text} . {stray}") for i, t in enumerate(licenses.TEMPLATES)]
    labels += [{t.label} for t in licenses.TEMPLATES]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(labels[i] <= got[i] for i in range(len(rows)))


def test_licenses_equal_every_template_at_every_shift(spark):
    random = np.random.default_rng(12)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.text.split()})
    rows = []
    for i in range(300):
        words = [str(w) for w in random.choice(vocabulary, 60)] if i % 3 else []
        for _ in range(int(random.integers(1, 4))):
            own = licenses.TEMPLATES[random.integers(len(licenses.TEMPLATES))].text.split()
            # Some words changed, the beginning or the end lost at times.
            for at in np.flatnonzero(random.random(len(own)) < random.choice([0, 0.05, 0.2])):
                own[at] = str(random.choice([*vocabulary, "other"]))
            own = own[random.integers(0, 3) * (random.random() < 0.3) : len(own) - random.integers(0, 3)]
            words += [*own, *(str(w) for w in random.choice(vocabulary, random.integers(0, 5)))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = licenses.Index(*licenses.document_counts(docs))
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    found = 0
    for i, text in rows:
        words, scores = text.encode().split(), {}
        for number, (label, template, _) in enumerate(index.templates):
            for shift in range(-len(template), len(words)):
                if score := index.matches(number, shift, words):
                    scores[label] = max(scores.get(label, 0), score)
        base = [x for x in got[i]["base_labels"].split(",") if x]
        assert got[i]["labels"] == ",".join(sorted({*base, *scores}))
        assert got[i]["score"] == pytest.approx(1.0 if base else max(scores.values(), default=0.0))
        found += bool(scores)
    assert 50 < found


def test_license_phrases_match_sql(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    expected = con.execute(licenses.base_sql()).fetchall()
    got = licenses.scan(table(spark, tables, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_warc(spark):
    bodies = ["x", "x", "x", None, "", "\r\n", "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nk: v\r\n\r\nb\r\n", "é" * 50, "x"]
    rows = [(i if i != 9 else None, f"http://h/{i}\r\n" if i else None, b) for i, b in enumerate(bodies)] + [(1, "http://h/1", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    of = lambda b: base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
    assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"]) for r in got) == sorted((str(p), of(b), len((b or "").encode())) for p, _, b in rows)
    for r in got:
        same = [p for p, _, b in rows if of(b) == r["payload_digest"] and p is not None]
        assert (r["record_type"] == "response") == (r["refers_to"] is None)
        assert r["refers_to"] is None or r["refers_to"] == min(same)
    assert Counter(r["payload_digest"] for r in got if r["record_type"] == "response") == {of(b): 1 for _, _, b in rows}
    kinds = Counter(r["record_type"] for r in warc.archive(pages, 2).collect())
    assert kinds == Counter(response=len(rows))
    assert warc.archive(pages.limit(0)).count() == 0


def test_curves(spark):
    random = np.random.default_rng(7)
    x = random.standard_normal((600, 16)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, [1.0, None] * 8), (900, [1.0] * 3), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1))
    got = {}
    for r in curves.nearest(vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(float)
    norm = np.sqrt((d * d).sum(1))
    for q in range(0, 600, 50):
        s = (d * d[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        assert [v for _, v, _ in sorted(got[q])] == best.tolist()
    assert set(got) == set(range(0, 600, 50))
    assert curves.nearest(vectors.limit(0)).count() == 0
    few = {r["query_id"]: r["rank"] for r in curves.nearest(vectors.where("vec_id < 3")).orderBy("rank").collect()}
    assert few == {0: 2}
    # Many small blocks: recall stays high, and is whole where windows go on to the end.
    exact = {(q, v) for q, rs in got.items() for _, v, _ in rs}
    for settle in (True, False):
        found = curves.nearest(vectors, block=60, settle=settle).collect()
        recall = len(exact & {(r["query_id"], r["vec_id"]) for r in found}) / len(exact)
        assert recall >= 0.9 and (settle or recall == 1)
    # Doubles, ids that are repeated, and queries that are all copies.
    rows = [(i % 90, [float(x) for x in v]) for i, v in enumerate(d[:100])] + [(1000 + 50 * i, [1.0] * 16) for i in range(300)]
    again = curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()
    assert {r["query_id"] for r in again} == {0, 50, *range(1000, 16000, 50)} and Counter(r["rank"] for r in again) == Counter({i: 302 for i in range(1, 6)})
    assert {r["vec_id"] for r in again if r["query_id"] == 9000} == {1000, 1050, 1100, 1150, 1200}


def test_hilbert_keys_are_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = curves.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def _simple_scores(texts, depth, least):
    """The suffix tree by definition, over a dictionary of texts."""
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in texts}
    lines = {i: [b"^", *t.encode().lower().split(), b"$"] for i, t in texts.items()}
    counts = Counter(w for i, line in lines.items() if train[i] for w in line[1:])
    tokens, kinds = sum(counts.values()), len(counts)
    after = {}
    for d in range(1, depth + 1):
        for i, line in lines.items():
            if train[i]:
                for at in range(d, len(line)):
                    after.setdefault(tuple(line[at - d : at]), Counter())[line[at]] += 1
    candidate = {c for c in after if c == (b"^",) or sum(after[c].values()) >= least}
    candidate = {c for c in candidate if sum(after[c].values()) >= least}

    def parts(context):
        seen = after[context]
        total, kept = sum(seen.values()), {w: n for w, n in seen.items() if n > 1}
        return total, len(seen), kept, 1 - sum(kept.values()) / (total + len(seen))

    def p(context, word):
        if not context:
            return (counts[word] if word in counts else kinds) / (tokens + kinds)
        total, n, kept, escape = parts(context)
        return kept.get(word, 0) / (total + n) + escape * p(context[1:], word)

    states = set()
    for c in candidate:
        total, _, kept, escape = parts(c)
        gain = sum(n * math.log(p(c, w) / p(c[1:], w)) for w, n in kept.items()) + (total - sum(kept.values())) * math.log(escape)
        if gain - 0.5 * len(kept) * math.log(total) > 0:
            states |= {c[k:] for k in range(len(c))}
    out = {}
    for i, line in lines.items():
        total = 0.0
        for at in range(1, len(line)):
            context = next((tuple(line[at - d : at]) for d in range(min(depth, at), 0, -1) if tuple(line[at - d : at]) in states), ())
            total += math.log10(p(context, line[at]))
        base = sum(math.log10((counts[w] + 1) / (tokens + kinds + 1)) for w in line[1:])
        out[i] = (len(line) - 1, sum(w in counts for w in line[1:]), base, total)
    return out, states


def test_suffix_tree(spark, tables, texts, monkeypatch):
    monkeypatch.setattr(suffixtree, "CHUNK", 100_000)
    monkeypatch.setattr(suffixtree, "BUCKET", 20_000)
    monkeypatch.setattr(suffixtree, "HELD", 5000)
    expected, states = _simple_scores(texts, 3, 8)
    assert {len(s) for s in states} == {1, 2, 3}
    got = suffixtree.score(table(spark, tables, "documents"), least=8).collect()
    assert len(got) == len(expected)
    for r in got:
        n, known, base, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_word_names(monkeypatch):
    import pyarrow as pa

    texts = ["The the THE", None, "", " \t\n", "é É a" + "b" * 100 + " A" + "B" * 100, "x" * 3000 + " y " + "word " * 900, "the"]
    whole = [np.concatenate([n for n, _ in suffixtree.blocks(pa.array(texts[i : i + 1], pa.string()))]) for i in range(len(texts))]
    for text, names in zip(texts, whole, strict=True):
        words = (text or "").encode().lower().split()
        assert len(names) == len(words) + 2 and names[0] == suffixtree.START and names[-1] == suffixtree.END
        assert len(set(names.tolist())) == len(set(words)) + 2
    assert whole[0][1] == whole[6][1]
    parts = list(suffixtree.blocks(pa.array([None, *texts], pa.string())[1:]))
    assert np.concatenate([n for n, _ in parts]).tolist() == np.concatenate(whole).tolist()
    monkeypatch.setattr(suffixtree, "SLICE", 128)
    assert np.concatenate([n for n, _ in suffixtree.blocks(pa.array(texts, pa.string()))]).tolist() == np.concatenate(whole).tolist()


def test_pair_names(spark):
    random = np.random.default_rng(4)
    a, b = (random.integers(-(1 << 63), (1 << 63) - 1, 50) for _ in range(2))
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    got = suffixtree.paired(np.array([r["a"] for r in rows]).view(np.uint64), np.array([r["b"] for r in rows]).view(np.uint64))
    assert got.view(np.int64).tolist() == [r["h"] for r in rows]
    keys = spark.createDataFrame([(int(x),) for x in a], "key long")
    may = suffixtree.Bitmap.of(keys, 1 << 16)
    assert may.holds(a.view(np.uint64)).all() and not may.holds(b.view(np.uint64)).all()


def test_scoring_memory():
    """What scoring a chunk takes beside its texts and answers, in bytes a token."""
    import tracemalloc

    import pyarrow as pa

    random = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in random.zipf(1.3, int(random.integers(0, 800))) % 50_000) for _ in range(600)]
    docs = pa.table({"doc_id": pa.array(range(len(texts))), "held_out": pa.array([False] * len(texts)), "text": pa.array(texts)})
    may = suffixtree.Bitmap(np.full(1 << 10, -1, np.int64).view(np.uint64))
    asked = suffixtree._asked_names(suffixtree.blocks(docs.column("text")), may, 3)
    key = (asked % np.uint64(97)).astype(np.float64)
    rows = []
    for b, i, j in suffixtree._cuts(suffixtree._bucket_of(asked, 5), 5):
        state = np.flatnonzero(key[i:j] < 30)
        rows.append((0, b, suffixtree._pack(np.where(key[i:j] < 90, (key[i:j] + 1) / 100, np.nan), state.astype(np.uint32), (key[i:j][state] + 1) / 99)))
    chunk, bucket, body = zip(*rows[::-1], strict=True)
    answers = pa.table({"chunk": pa.array(chunk), "bucket": pa.array(bucket), "body": pa.array(body, pa.binary())})
    run = suffixtree._scored(suffixtree.Model(1000, 100, None, may, 5), 3)
    tracemalloc.start()
    got = run(docs, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tokens = sum(got.column("n_tokens").to_pylist()) + len(texts)
    assert tokens > 200_000 and got.num_rows == len(texts)
    assert peak < 150 * tokens
    # Texts on their own get the same scores.
    for i in (0, 7, 599):
        mine = suffixtree._asked_names(suffixtree.blocks(docs.column("text").slice(i, 1)), may, 3)
        at = np.searchsorted(asked, mine)
        state = np.flatnonzero(key[at] < 30)
        one = pa.table({"chunk": [0], "bucket": [0], "body": pa.array([suffixtree._pack(np.where(key[at] < 90, (key[at] + 1) / 100, np.nan), state.astype(np.uint32), (key[at][state] + 1) / 99)], pa.binary())})
        assert run(docs.slice(i, 1), one).to_pylist()[0] == pytest.approx(got.slice(i, 1).to_pylist()[0])


def test_suffix_tree_edges(edge, empty):
    rows = suffixtree.score(edge).collect()
    assert len(rows) == len(_edge_rows())
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert all(r["score"] <= 0 and math.isfinite(r["base_score"]) for r in rows)
    assert suffixtree.score(empty).count() == 0
    held = edge.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in suffixtree.score(held).collect())
