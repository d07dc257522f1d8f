"""The engine's queries over the driver's tables, each with its SQL for a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpforest import constants as C
from kelpforest.functions import text as T
from kelpforest.operators import chunking, classify, notes, ranking, sync, vectors
from kelpforest.sources import snapshots
from kelpforest.sources.folders import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, for work on each of them that is worth all cores."""
    return T.spread(read(spark, sf_dir, "documents"))


# --- tokens, postings, idf ---------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)


def _token_sql(table: str, key: str) -> str:
    """CTEs up to ``post`` (key, token, tf) of a table with ``text``."""
    return f"""
raw AS (SELECT {key} AS id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_]+'),
  lambda r: length(r) >= 2 AND lower(r) NOT IN ({_STOP}))) AS r, generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_]+'),
  lambda r: length(r) >= 2 AND lower(r) NOT IN ({_STOP})), 1) AS i FROM {table}),
cut AS (SELECT id, i, r, string_split(replace(regexp_replace(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '__', '_' || '_'), '_') AS ps FROM raw),
each AS (SELECT id, lower(r) AS token, 1.0::DOUBLE AS w, i * 1000 AS pos FROM cut UNION ALL
  SELECT id, token, 0.5::DOUBLE, i * 1000 + j FROM (SELECT id, i, lower(unnest(ps)) AS token, generate_subscripts(ps, 1) AS j FROM cut WHERE len(ps) > 1)
  WHERE length(token) >= 2 AND token NOT IN ({_STOP})),
summed AS (SELECT id, token, sum(w) AS tf, min(pos) AS first FROM each GROUP BY id, token),
post AS (SELECT id, token, tf FROM summed QUALIFY row_number() OVER (PARTITION BY id ORDER BY tf DESC, first) <= {C.MAX_TOKENS})"""


@query(f"WITH {_token_sql('documents', 'doc_id')} SELECT id AS doc_id, token, tf FROM post")
def tf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.postings(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"WITH {_token_sql('documents', 'doc_id')} SELECT token, count(*) AS df, "
    "round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM post GROUP BY token"
)
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = ranking.idf_table(T.postings(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")))
    return out.select("token", "df", F.round("idf", 6).alias("idf"))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    asked = T.postings(read(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    posts = T.postings(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")
    # Only tokens that are asked for matter; counts are still over the whole collection.
    posts = snapshots.stored(posts.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi"), "asked-postings")
    idf = ranking.idf_table(posts, docs.agg(F.count("*").alias("n")))
    return ranking.lexical_scores(asked, posts, idf)


def _lexical_sql(k: int) -> str:
    docs = _token_sql("documents", "doc_id")
    asked = _token_sql("benchmark", "item_id")
    for name in ("raw", "cut", "each", "summed", "post"):
        asked = asked.replace(f"{name} AS (", f"q_{name} AS (").replace(f"FROM {name}", f"FROM q_{name}")
    return f"""{docs}, {asked},
idf AS (SELECT token, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post GROUP BY token),
lex AS (SELECT q.id AS query_id, p.id AS id, round(sum(q.tf * p.tf * idf.idf), 6) AS score FROM q_post q JOIN post p USING (token) JOIN idf USING (token) GROUP BY 1, 2),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= {k})"""


@query(f"WITH {_lexical_sql(10)} SELECT query_id, id, score, rank FROM lexical")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_lexical(spark, sf_dir), 10)


_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
codes AS (SELECT token, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(token, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) & 2147483647 AS code FROM (SELECT DISTINCT token FROM post), crc)"""


@query(f"WITH {_token_sql('documents', 'doc_id')}, {_CRC} SELECT id AS doc_id, code::INT AS feature, sum(tf) AS weight FROM post JOIN codes USING (token) GROUP BY id, code")
def feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = T.postings(read(spark, sf_dir, "documents"), "doc_id", "text")
    return posts.groupBy("doc_id", T.feature_id(F.col("token")).alias("feature")).agg(F.sum("tf").alias("weight"))


@query(
    f"""WITH h AS (SELECT doc_id, sha1(unhex('{T.NAMESPACE.hex}') || encode(source || ':' || doc_id || ':0')) AS d FROM documents)
SELECT doc_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || lower(to_hex((('0x' || d[17:17])::INT & 3) | 8)) || d[18:20] || '-' || d[21:32] AS id FROM h"""
)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.lit(0)).alias("id"))


@query("SELECT doc_id, source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' :: A > B' WHEN doc_id % 3 = 1 THEN ' :: function f' ELSE '' END || chr(10) || chr(10) || text AS embed_text FROM documents")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    third = F.col("doc_id") % 3
    head = T.header(path, F.when(third == 0, F.lit("A > B")), F.lit("function"), F.when(third == 1, F.lit("f")))
    return docs.select("doc_id", T.embed_text(head, F.col("text")).alias("embed_text"))


# --- vectors -------------------------------------------------------------------

_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings"


def _dense_sql(k: int, every: int, same: str = "") -> str:
    return f"""u AS ({_UNIT}),
near AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_inner_product(q.u, r.u), 6) AS score FROM u q JOIN u r
  ON q.vec_id % {every} = 0 AND q.vec_id <> r.vec_id {same}),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= {k})"""


def _dense(spark: SparkSession, sf_dir: str, every: int, k: int, same: str | None = None) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    extra = [same] if same else []
    asked = e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), *extra)
    return vectors.batch_top_k(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), *extra), k, same)


@query(f"WITH {_dense_sql(10, 100)} SELECT query_id, id, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 100, 10).select("query_id", "id", "score", "rank")


@query(f"WITH {_dense_sql(10, 100, 'AND q.label = r.label')} SELECT query_id, id, score, rank FROM dense")
def dense_topk_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 100, 10, "label").select("query_id", "id", "score", "rank")


@query(f"WITH {_dense_sql(1, 100, 'AND q.label = r.label')} SELECT query_id, id AS duplicate_of, score FROM dense WHERE score >= 0.3")
def near_dup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("tenant"))
    return vectors.duplicates(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("tenant")), 0.3)


# --- fusion and what follows ---------------------------------------------------

_FUSED = f"""WITH {_lexical_sql(24)}, {_dense_sql(24, 1).replace('q.vec_id % 1 = 0', 'q.vec_id IN (SELECT item_id FROM benchmark)')},
parts AS (SELECT query_id, id, 1.0 / ({C.RRF_K} + rank) AS part FROM lexical UNION ALL SELECT query_id, id, 1.0 / ({C.RRF_K} + rank) FROM dense),
s AS (SELECT query_id, id, round(sum(part), 9) AS score FROM parts GROUP BY query_id, id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    asked = e.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    dense = vectors.batch_top_k(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 24)
    return ranking.reciprocal_rank_fusion([ranking.ranked(_lexical(spark, sf_dir), 24), dense], 10)


@query(f"{_FUSED} SELECT query_id, id, score, rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


@query(
    f"""{_FUSED},
cov AS (SELECT f.*, d.source, (SELECT count(*) FROM q_post q JOIN summed p ON p.token = q.token WHERE q.id = f.query_id AND p.id = f.id)
  / greatest((SELECT count(*) FROM q_post q WHERE q.id = f.query_id), 1)::DOUBLE AS rerank FROM fused f JOIN documents d ON d.doc_id = f.id),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, rank) AS position FROM cov),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY position) > 2 AS over FROM pos)
SELECT query_id, id, source, round(rerank, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY over, position) AS final FROM nth QUALIFY final <= 6"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    asked = T.postings(read(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("item_id").alias("query_id"), "token")
    fused = snapshots.stored(_fused(spark, sf_dir), "fused")
    # Only what was fused is read again: a bounded number of documents for each query.
    near = docs.join(F.broadcast(fused.select("id").distinct()), "id", "left_semi")
    have = T.all_tokens(near, "id", "text").select("id", "token")
    both = fused.join(asked, "query_id").join(have, ["id", "token"]).groupBy("query_id", "id").agg(F.count("*").alias("met"))
    size = asked.groupBy("query_id").agg(F.count("*").alias("wanted"))
    pool = fused.join(docs.select("id", "source"), "id").join(both, ["query_id", "id"], "left").join(size, "query_id", "left")
    met = F.coalesce(F.col("met") / F.col("wanted"), F.lit(0.0))
    hits = ranking.diversify(ranking.rerank(pool, met, C.RERANK_POOL), ["source"], 6)
    return hits.select("query_id", "id", "source", F.round("rerank", 4).alias("score"), "final")


@query(
    f"""WITH s AS (SELECT event_id, event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS position FROM events)
SELECT event_id, event_type, round((1.0 / position) * (0.85 + 0.15 * exp(-greatest(floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400), 0) / 90.0)), 9) AS score FROM s"""
)
def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    placed = read(spark, sf_dir, "events").withColumn("position", rank)
    score = ranking.recency(1.0 / F.col("position"), F.col("ts"), F.lit(NOW).cast("timestamp"))
    return placed.select("event_id", "event_type", F.round(score, 9).alias("score"))


@query(
    """WITH p AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS position FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY position) > 2 AS over FROM p)
SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY over, position) AS final FROM n QUALIFY final <= 25"""
)
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    hits = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", place.alias("position"))
    return ranking.diversify(hits, ["source"], 25, query="lang").select("doc_id", "lang", "source", "final")


@query(
    """WITH n AS (SELECT *, lag(text) OVER w AS a, lag(turn) OVER w AS ta, lead(text) OVER w AS b, lead(turn) OVER w AS tb FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN ta = turn - 1 THEN a END, text, CASE WHEN tb = turn + 1 THEN b END) AS expanded,
CASE WHEN ta = turn - 1 THEN ta ELSE turn END AS from_line, CASE WHEN tb = turn + 1 THEN tb ELSE turn END AS to_line FROM n"""
)
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumns({"s": F.col("turn"), "e": F.col("turn")})
    return ranking.neighbours(turns, F.lit(True), ["conv_id"], "turn", "text", "s", "e")


@query(
    """SELECT doc_id AS id, round(n_chars / 7.0, 4) AS score, CASE WHEN doc_id % 4 = 0 THEN source ELSE source || ':' || (doc_id % 4) || '-' || doc_id END AS location,
substr(text, 1, 160) AS preview FROM documents"""
)
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("doc_id") % 4
    where = ranking.location(F.col("source"), start, F.col("doc_id"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.round(F.col("n_chars") / 7.0, 4).alias("score"), where.alias("location"), T.preview(F.col("text")).alias("preview"))


@query(
    """SELECT d.doc_id, d.source, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IN (1) AND d.lang IN ('en', 'fr') AND len(list_filter(string_split(d.text, ' '), lambda w: w IN ('the', 'le'))) > 0"""
)
def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kelpforest.plans.search import matches

    rows = read(spark, sf_dir, "documents").withColumn("words", F.split("text", " ")).join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.where(matches({"quality": 1, "lang": ["en", "fr"], "words[]": ["the", "le"], "source": None})).select("doc_id", "source", "lang", "quality")


# --- counts, paging, metrics ----------------------------------------------------

_ALL = "(SELECT DISTINCT source FROM documents UNION ALL SELECT 'src-none')"


@query(f"SELECT a.source AS project, count(d.doc_id) AS n FROM {_ALL} a LEFT JOIN documents d ON a.source = d.source GROUP BY a.source")
def tenant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    registered = docs.select("source").distinct().unionByName(spark.createDataFrame([("src-none",)], "source string"))
    counted = docs.groupBy("source").agg(F.count("doc_id").alias("n"))
    return registered.join(counted, "source", "left").select(F.col("source").alias("project"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type AS project, max(ts) AS last_indexed, count(*) AS n FROM events GROUP BY event_type")
def last_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("project")).agg(F.max("ts").alias("last_indexed"), F.count("*").alias("n"))


@query("SELECT event_id, ts, event_type, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events) > 60 AS has_more FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def paged_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return ranking.page(rows, "ts", "event_id", 40, 20).select("event_id", "ts", "event_type", "total", "has_more")


_HITS = """e AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT item_id, min(rank) AS rank FROM (SELECT item_id FROM e GROUP BY item_id) LEFT JOIN (SELECT l.query_id, l.rank FROM lexical l JOIN e ON e.item_id = l.query_id AND e.doc_id = l.id) ON query_id = item_id GROUP BY item_id)"""


@query(
    f"""WITH {_lexical_sql(5)}, {_HITS} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS r1,
round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS r3, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM f"""
)
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    holds = ranking.holders(items, "item_id", T.spread(docs), "doc_id", "text")
    found = ranking.ranked(_lexical(spark, sf_dir), 5).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank")
    first = holds.join(found, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("rank"))
    return ranking.metrics(first)


# --- ledger and sync ---------------------------------------------------------------

_SETS = """old AS (SELECT source AS collection, doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents),
now AS (SELECT collection, CASE WHEN path::BIGINT % 11 = 3 THEN path || '-moved' ELSE path END AS path, CASE WHEN path::BIGINT % 7 = 2 THEN sha256(hash) ELSE hash END AS hash FROM old WHERE path::BIGINT % 13 <> 5),
changes AS (SELECT coalesce(n.collection, o.collection) AS collection, coalesce(n.path, o.path) AS path, coalesce(n.hash, o.hash) AS hash,
CASE WHEN n.hash IS NULL THEN 'delete' WHEN n.hash = o.hash THEN 'unchanged' ELSE 'index' END AS action FROM now n FULL JOIN old o ON n.collection = o.collection AND n.path = o.path)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = read(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    number = F.col("path").cast("long")
    now = old.where(number % 13 != 5).select(
        "collection", F.when(number % 11 == 3, F.concat("path", F.lit("-moved"))).otherwise(F.col("path")).alias("path"), F.when(number % 7 == 2, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash")
    )
    return now, old


@query("SELECT source AS collection, doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents")
def content_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return sync.ledger(docs.select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"), F.lit(0).alias("chunk_index")))


@query(f"WITH {_SETS} SELECT collection, path, hash, action FROM changes")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff(*_states(spark, sf_dir))


@query(f"WITH {_SETS} SELECT collection, path, hash, action FROM changes WHERE action = 'delete' AND hash IN (SELECT hash FROM now)")
def sync_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old = _states(spark, sf_dir)
    return sync.renames(sync.diff(now, old), now).select("collection", "path", "hash", "action")


@query(
    f"""WITH {_SETS} SELECT count(*) FILTER (action = 'index') AS "index", count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'delete') AS "delete",
count(*) FILTER (action = 'delete' AND hash IN (SELECT hash FROM now)) AS renamed FROM changes"""
)
def sync_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old = _states(spark, sf_dir)
    return sync.statistics(sync.diff(now, old), now)


@query("SELECT * FROM (SELECT doc_id AS id, source, lang FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, upper(source), 'xx' FROM documents WHERE doc_id % 5 = 0)")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return sync.upsert(rows, rows.where("id % 5 = 0").select("id", F.upper("source").alias("source"), F.lit("xx").alias("lang")))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# --- files ----------------------------------------------------------------------------

_NAMES = ("README.md", "src/app.py", "docs/x/adr/1.md", "adr/2.md", "node_modules/a.js", "a.min.js", "b_pb2.py", "logo.PNG", "db/schema_v1.sql", "Dockerfile", ".env", ".env.sample", "x.unknown", "Changelog.txt", "deep/docs/guide.rst", "pkg/__init__.py")
_SIZES = (0, 10, C.MAX_FILE, C.MAX_FILE + 1, 500)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % len(_NAMES)).cast("int") + 1)
    size = F.element_at(F.array(*map(F.lit, _SIZES)), (F.col("page_id") % len(_SIZES)).cast("int") + 1)
    return pages.select("page_id", name.alias("path"), size.alias("size"))


def _paths_sql() -> str:
    names, sizes = ", ".join(f"'{n}'" for n in _NAMES), ", ".join(map(str, _SIZES))
    ext = "regexp_extract(lower(name), '^.+(\\.[^.]+)$', 1)"
    return f"""p AS (SELECT page_id, [{names}][page_id % {len(_NAMES)} + 1] AS path, [{sizes}][page_id % {len(_SIZES)} + 1] AS size FROM pages),
n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, string_split(path, '/')[:-2] AS dirs FROM p),
t AS (SELECT *, {ext} AS ext, CASE WHEN {ext} IN ({", ".join(f"'{x}'" for x in C.LANGUAGES)}) THEN {ext} WHEN lower(name) = 'dockerfile' THEN '.dockerfile'
  WHEN lower(name) = '.env.sample' THEN '.example' WHEN lower(name) = 'makefile' THEN '.sh' END AS key FROM n)"""


def _case(column: str, position: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v[position]}'" for k, v in C.LANGUAGES.items()) + " END"


@query(
    f"""WITH {_paths_sql()} SELECT page_id, path, CASE WHEN list_has_any(dirs, [{", ".join(f"'{x}'" for x in C.IGNORED_DIRS)}]) THEN 'ignored directory'
WHEN lower(name) IN ({", ".join(f"'{x.lower()}'" for x in C.IGNORED_FILES)}) THEN 'ignored file'
WHEN {" OR ".join(f"ends_with(name, '{x}')" for x in C.IGNORED_SUFFIXES)} THEN 'generated'
WHEN ext IN ({", ".join(f"'{x}'" for x in C.IGNORED_EXTENSIONS)}) THEN 'binary extension' WHEN size = 0 THEN 'empty' WHEN size > {C.MAX_FILE} THEN 'too large'
WHEN key IS NULL THEN 'unknown type' WHEN page_id % 7 IN (1, 2) THEN 'binary' END AS skip_reason FROM t"""
)
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents are the pages', some with a NUL near their start, some that are no UTF-8, some with a NUL behind what is probed."""
    html = F.encode("html", "UTF-8")
    kind, far = F.col("page_id") % 7, F.encode(F.repeat(F.lit("x"), F.lit(C.PROBE)), "UTF-8")
    content = F.when(kind == 1, F.concat(F.unhex(F.lit("6100")), html)).when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), html)).when(kind == 3, F.concat(far, F.unhex(F.lit("00")))).otherwise(html)
    pages = read(spark, sf_dir, "pages").select("page_id", content.alias("content"))
    rows = _paths(spark, sf_dir).join(pages, "page_id")
    return rows.select("page_id", "path", classify.skip_reason(F.col("path"), F.col("size"), F.col("content")).alias("skip_reason"))


@query(
    f"""WITH {_paths_sql()} SELECT page_id, path, {_case("key", 0)} AS chunker, {_case("key", 2)} AS language, CASE WHEN {_case("key", 0)} = 'docs' THEN 'docs' ELSE 'code' END AS collection,
CASE WHEN {_case("key", 0)} = 'docs' THEN CASE WHEN lower(name) LIKE 'readme%' THEN 'readme' WHEN lower(name) LIKE 'changelog%' THEN 'changelog' WHEN lower(name) LIKE 'contributing%' THEN 'guide'
WHEN lower(name) LIKE 'adr-%' OR lower(path) LIKE '%/adr/%' OR lower(path) LIKE '%/decisions/%' THEN 'adr' WHEN lower(name) LIKE 'openapi%' OR lower(name) LIKE 'swagger%' THEN 'openapi'
WHEN lower(name) LIKE '%schema%.sql' THEN 'schema' ELSE 'guide' END END AS doc_type FROM t"""
)
def doc_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select("page_id", "path", classify.chunker(p).alias("chunker"), classify.language(p).alias("language"), classify.collection(p).alias("collection"), classify.doc_type(p).alias("doc_type"))


_ROOTS = (("all", "https:", 2), ("http", "http:", 1), ("late", "https:", 3))


@query(
    """WITH r AS (SELECT * FROM (VALUES ('all', 'https:', 2), ('http', 'http:', 1), ('late', 'https:', 3)) v(project, root, ordinal))
SELECT url AS path, arg_min(project, ordinal) AS project FROM (SELECT DISTINCT url FROM pages) JOIN r ON url = root OR starts_with(url, root || '/') GROUP BY url"""
)
def find_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.owning_project(read(spark, sf_dir, "pages").select(F.col("url").alias("path")), spark.createDataFrame(_ROOTS, "project string, root string, ordinal int"))


_NAMED = rf"(?i)\b([A-Z0-9_.-]*(?:{C.SECRET_NAMES})[A-Z0-9_.-]*)(\s*[:=]\s*|\s*=>\s*)"


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '\btoken = ', 'auth_token = ', 'g') AS text FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(text, '{_NAMED}"[^"''\n]{{8,}}"', '\1\2"[REDACTED]"', 'g'), '{_NAMED}''[^"''\n]{{8,}}''', '\1\2''[REDACTED]''', 'g') AS text FROM t"""
)
def redact_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\btoken = ", "auth_token = ").alias("text"))
    return T.redact_assignments(rows.withColumn("n", F.lit(0)), "text", "n").select("doc_id", "text")


_SECRETS = (
    "'id AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || ' end'",
    "'api_key = \"sk-proj-' || md5(doc_id::VARCHAR) || '\"'",
    "'ghp_' || md5(doc_id::VARCHAR) || 'abcd'",
    "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(doc_id::VARCHAR) || chr(10) || chr(10) || 'def' || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10) || 'after'",
    "'xoxb-' || md5(doc_id::VARCHAR) || ' sk_live_' || md5(doc_id::VARCHAR) || ' AIza' || substr(md5(doc_id::VARCHAR) || 'abc', 1, 35)",
    "'password: ''' || md5(doc_id::VARCHAR) || ''' eyJ' || md5(doc_id::VARCHAR) || '.eyJ' || md5(doc_id::VARCHAR) || '.' || md5(doc_id::VARCHAR)",
)
def _redact_sql() -> str:
    """Each step counts matches in the text before it replaces them."""
    out, last = "", "t"
    # Of a token, four characters stay: its matches are replaced one by one, the longest first.
    longest = "list_transform(list_reverse_sort(list_transform(regexp_extract_all(text, '<p>'), lambda m: {'n': length(m), 'm': m})), lambda s: s.m)"
    for i, pattern in enumerate(C.TOKEN_PATTERNS):
        matches = longest.replace("<p>", pattern)
        out += f"""s{i} AS (SELECT doc_id, n + len(regexp_extract_all(text, '{pattern}')) AS n,
  list_reduce(list_prepend(text, {matches}), lambda t, m: replace(t, m, m[1:4] || '[REDACTED]')) AS text FROM {last}),\n"""
        last = f"s{i}"
    for i, q in enumerate(('"', "''"), len(C.TOKEN_PATTERNS)):
        pattern, into = _NAMED + q + r"[^\"''\n]{8,}" + q, r"\1\2" + q + "[REDACTED]" + q
        out += f"s{i} AS (SELECT doc_id, n + len(regexp_extract_all(text, '{pattern}')) AS n, regexp_replace(text, '{pattern}', '{into}', 'g') AS text FROM {last}),\n"
        last = f"s{i}"
    case = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SECRETS))
    return f"""WITH t AS (SELECT doc_id, 0 AS n, regexp_replace(text, '\\btoken = ', 'auth_token = ', 'g') || chr(10) || CASE doc_id % {len(_SECRETS)} {case} END AS text FROM documents),
{out}l AS (SELECT doc_id, n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {last}),
e AS (SELECT *, nullif(regexp_extract(line, '{C.KEY_BOUNDARY}', 1), '') AS edge FROM l),
k AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'BEGIN' AND edge IS NULL AND trim(line) <> '' AS hide FROM e)
SELECT doc_id, string_agg(CASE WHEN hide THEN '[REDACTED]' ELSE line END, chr(10) ORDER BY i) AS text, (max(n) + count(*) FILTER (hide))::INT AS n_redacted FROM k GROUP BY doc_id"""


@query(_redact_sql())
def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, with a secret of each kind put at its end in turn."""
    docs = documents(spark, sf_dir)
    known = F.md5(F.col("doc_id").cast("string"))
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    secrets = (
        line("id AKIA", F.upper(F.substring(known, 1, 16)), " end"),
        line('api_key = "sk-proj-', known, '"'),
        line("ghp_", known, "abcd"),
        line("-----BEGIN RSA PRIVATE KEY-----\n", known, "\n\ndef\n-----END RSA PRIVATE KEY-----\nafter"),
        line("xoxb-", known, " sk_live_", known, " AIza", F.substring(F.concat(known, F.lit("abc")), 1, 35)),
        line("password: '", known, "' eyJ", known, ".eyJ", known, ".", known),
    )
    own = F.element_at(F.array(*secrets), (F.col("doc_id") % len(secrets)).cast("int") + 1)
    return T.redacted(docs.select("doc_id", F.concat(F.regexp_replace("text", r"\btoken = ", "auth_token = "), F.lit("\n"), own).alias("text")))


# --- chunks ---------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str, chunker: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("key"), "text", F.lit(chunker).alias("chunker"), F.lit("python").alias("grammar"))


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, text, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
l AS (SELECT doc_id, len(ls) AS lines, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d WHERE length(text) > {C.MAX_CHUNK}),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM l),
n AS (SELECT a.doc_id, a.lines, a.i AS a, greatest(a.i, coalesce(max(b.i) FILTER (b.cum - (a.cum - length(a.line) - 1) <= {C.MAX_CHUNK}), 0)) AS u FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i GROUP BY a.doc_id, a.lines, a.i),
w AS (SELECT doc_id, lines, a, u FROM n WHERE a = 1 UNION ALL SELECT n.doc_id, n.lines, n.a, n.u FROM w JOIN n ON n.doc_id = w.doc_id AND n.a = greatest(w.u - {C.OVERLAP_LINES - 1}, w.a + 1) WHERE w.u < w.lines),
b AS (SELECT w.doc_id, w.a, w.u, substr(string_agg(l.line, chr(10) ORDER BY l.i), 1, {C.MAX_CHUNK}) AS body FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN w.a AND w.u GROUP BY w.doc_id, w.a, w.u),
g AS (SELECT *, sum(CASE WHEN length(body) >= {C.MIN_CHUNK} OR a = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS nth FROM b),
f AS (SELECT doc_id, nth, min(a) AS a, max(u) AS z, string_agg(body, chr(10) ORDER BY a) AS content FROM g GROUP BY doc_id, nth
  UNION ALL SELECT doc_id, 1, 1, len(ls), text FROM d WHERE length(text) <= {C.MAX_CHUNK})
SELECT doc_id::VARCHAR AS key, (nth - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_total, a::INT AS start_line, z::INT AS end_line, content,
  NULL::VARCHAR AS symbol_type, NULL::VARCHAR AS symbol_name, NULL::VARCHAR AS heading_path FROM f"""
)
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_files(spark, sf_dir, "text"))


@query()
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    marked = F.regexp_replace(F.regexp_replace("html", r"<h1>([^<]*)</h1>", "\n# $1\n\n"), r"<h2>([^<]*)</h2>", "\n## $1\n\n")
    return chunking.chunk(pages.select(F.col("page_id").cast("string").alias("key"), F.regexp_replace(marked, "</p>", "\n").alias("text"), F.lit("docs").alias("chunker"), F.lit(None).cast("string").alias("grammar")))


@query()
def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    body = F.regexp_replace(F.col("text"), r"[\"\\\n]", " ")
    code = F.concat(F.lit('class A:\n    """Doc of the class."""\n\n    def f(self):\n        return "'), body, F.lit('"\n\n\ndef g():\n    return "'), body, F.lit('"\n'))
    return chunking.chunk(docs.select(F.col("doc_id").cast("string").alias("key"), code.alias("text"), F.lit("code").alias("chunker"), F.lit("python").alias("grammar")))


# --- notes -----------------------------------------------------------------------------


@query(
    f"""SELECT doc_id, CASE WHEN source = 'src3' THEN 'unknown project' WHEN doc_id % 9 = 8 THEN 'unknown type' WHEN doc_id % 17 = 0 THEN 'no title'
WHEN length(text) < {C.MIN_NOTE} THEN 'too short' WHEN length(text) > {C.MAX_NOTE} THEN 'too long' END AS reason FROM documents"""
)
def memory_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kind = F.try_element_at(F.array(*map(F.lit, C.NOTE_TYPES)), (F.col("doc_id") % 9).cast("int") + 1)
    project = F.when(F.col("source") != "src3", F.col("source"))
    title = F.when(F.col("doc_id") % 17 == 0, F.lit("  ")).otherwise(F.lit("t"))
    return docs.select("doc_id", notes.reject_reason(project, kind, title, F.col("text")).alias("reason"))


_LOG = """log AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, CASE WHEN role = 'user' THEN 'session' ELSE 'decision' END AS memory_type, text,
lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS supersedes FROM conversations)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    row_id = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        row_id.alias("id"), F.lit(1).alias("version"), F.lit("put").alias("op"), F.col("conv_id").alias("project"),
        F.when(F.col("role") == "user", "session").otherwise("decision").alias("memory_type"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 86400).alias("created_at"),
        F.lag(row_id).over(W.partitionBy("conv_id").orderBy("turn")).alias("supersedes"), (F.col("role") != "user").alias("links"),
    )


@query(
    f"""WITH {_LOG} SELECT l.id, CASE WHEN n.id IS NULL THEN 'active' ELSE 'superseded' END AS status, CASE WHEN n.memory_type <> 'session' THEN n.id END AS superseded_by
FROM log l LEFT JOIN log n ON n.supersedes = l.id"""
)
def supersede_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.current(_log(spark, sf_dir)).select("id", "status", "superseded_by")


@query(
    """WITH c AS (SELECT conv_id * 1000 + turn AS id, max(conv_id * 1000 + turn) OVER (PARTITION BY conv_id) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS hops FROM conversations)
SELECT id, head, hops::INT AS hops FROM c WHERE hops > 0"""
)
def supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return notes.chains(log.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"), F.col("id").alias("next"))).select("id", "head", "hops")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, conv_id * 1000 + turn AS id, lead(conv_id * 1000 + turn) OVER w AS next, nth_value(conv_id * 1000 + turn, 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT id, max(next) AS next FROM (SELECT id, next FROM t WHERE next IS NOT NULL UNION ALL SELECT id, second FROM t WHERE next IS NULL AND conv_id % 3 = 0 AND second IS NOT NULL
  UNION ALL SELECT id, id FROM t WHERE next IS NULL AND conv_id % 5 = 1) GROUP BY id),
walk AS (SELECT id, next AS here, [id] AS seen FROM l UNION ALL SELECT w.id, l.next, list_append(w.seen, w.here) FROM walk w JOIN l ON w.here = l.id WHERE NOT list_contains(w.seen, w.here)),
ends AS (SELECT id, here, seen, list_contains(seen, here) AS cyclic FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(seen) DESC) = 1)
SELECT id, CASE WHEN cyclic THEN list_min(seen[list_position(seen, here):]) ELSE here END AS head, CASE WHEN NOT cyclic THEN len(seen)::INT END AS hops, cyclic FROM ends"""
)
def chain_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of turns, of which every third conversation goes back to its second turn and every fifth ends in itself."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    place, whole = W.partitionBy("conv_id").orderBy("id"), W.partitionBy("conv_id").orderBy("id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turns = turns.withColumns({"next": F.lead("id").over(place), "second": F.nth_value("id", 2).over(whole)})
    last = turns.where("next IS NULL")
    back = last.where("conv_id % 3 = 0 AND second IS NOT NULL").select("id", F.col("second").alias("next"))
    own = last.where("conv_id % 5 = 1").select("id", F.col("id").alias("next"))
    return notes.chains(turns.where("next IS NOT NULL").select("id", "next").unionByName(back).unionByName(own))


@query(f"WITH {_LOG} SELECT conv_id AS project, max(id) AS id FROM log GROUP BY conv_id")
def latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = notes.current(_log(spark, sf_dir)).where("status = 'active'")
    return notes.newest_active(active, ["project"], "created_at").select("project", "id")


@query(
    """SELECT doc_id, list_sort(list_distinct([lang, source, 'x', lang])) AS tags, 'memory/' || ['decision', 'bug'][doc_id % 2 + 1] || '/' || md5(doc_id::VARCHAR)[1:8] AS path FROM documents"""
)
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("decision"), F.lit("bug")), (F.col("doc_id") % 2).cast("int") + 1)
    return read(spark, sf_dir, "documents").select(
        "doc_id", notes.tags(F.array("lang", "source", F.lit("x"), "lang")).alias("tags"), notes.note_path(kind, F.md5(F.col("doc_id").cast("string"))).alias("path")
    )


_TOLD = f"""WITH log AS (SELECT conv_id * 1000 + turn AS id, conv_id AS project, CASE WHEN role = 'user' THEN 'session' WHEN turn % 3 = 0 THEN 'bug' ELSE 'decision' END AS kind,
  substr(text, 1, 20) AS title, text AS content, 1698800000 + turn * 86400 AS born, CASE WHEN turn % 5 = 4 THEN lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS supersedes FROM conversations),
cur AS (SELECT *, id NOT IN (SELECT supersedes FROM log WHERE supersedes IS NOT NULL) AS active FROM log),
rec AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY born DESC, id) AS n FROM cur WHERE active QUALIFY n <= 100),
shown AS (SELECT *, CASE WHEN kind IN ('session', 'decision') THEN kind ELSE 'other' END AS k, row_number() OVER (PARTITION BY project, k ORDER BY born DESC, id) AS r FROM rec),
line AS (SELECT project, k, r, CASE k WHEN 'session' THEN content WHEN 'decision' THEN '### ' || title || chr(10) || content
  ELSE '- [' || kind || '] ' || title || ' (' || substr(id::VARCHAR, 1, 8) || ')' || CASE WHEN floor((epoch(TIMESTAMP '{NOW}') - born) / 86400) > 90 THEN ' [over 90 days old, check it]' ELSE '' END || chr(10) || '  ' || substr(content, 1, 160) END AS txt
  FROM shown WHERE (k = 'session' AND r = 1) OR k = 'decision' OR (k = 'other' AND r <= 10))
SELECT c.project, c.n, c.n_active, coalesce(session, '') AS session, coalesce(decisions, '') AS decisions, coalesce(others, '') AS others
FROM (SELECT project, count(*) AS n, count(*) FILTER (active) AS n_active FROM cur GROUP BY project) c LEFT JOIN (SELECT project,
  string_agg(txt, chr(10) ORDER BY r) FILTER (k = 'session') AS session, string_agg(txt, chr(10) ORDER BY r) FILTER (k = 'decision') AS decisions,
  string_agg(txt, chr(10) ORDER BY r) FILTER (k = 'other') AS others FROM line GROUP BY project) l ON c.project = l.project"""


@query(_TOLD)
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("id") % 1000
    kind = F.when(F.col("memory_type") == "session", "session").when(turn % 3 == 0, "bug").otherwise("decision")
    log = _log(spark, sf_dir).withColumns(
        {"memory_type": kind, "supersedes": F.when(turn % 5 == 4, F.col("supersedes")), "created_at": F.timestamp_seconds(F.lit(1_698_800_000) + turn * 86400)}
    )
    told = notes.briefing(notes.current(log), F.lit(NOW).cast("timestamp"))
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["line"]), "\n"), F.lit(""))
    return told.select("project", "n", "n_active", text("session").alias("session"), text("decision").alias("decisions"), text("other").alias("others"))


@query("SELECT doc_id AS id, source AS project, text AS content FROM documents")
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), F.col("text").alias("content"))
    return snapshots.import_notes(spark, snapshots.export_notes(docs, new_path(spark, "backups")), docs.schema)[0]


from kelpforest import store_queries, symbol_queries  # noqa: E402,F401 (they register their queries here)
