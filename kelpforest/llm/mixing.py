"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a keyed digest and queue up. A service of
a document that starts behind ``before`` words of its source finishes at virtual
time ``(before + size) / target``; a source queues ``MAX_EPOCHS`` times. The
merged stream holds the services of all sources in the order of their finish,
and ends where its words reach the budget, which is the size of all documents.
The service at which it ends is cut; a source's words therefore come within a
document's size of its target.

Prefix sums within a source have two levels: sums of (source, digest bucket),
then positions within a bucket. A hot source therefore spreads over many tasks,
and the number of buckets follows the number of rows; it changes the plan, never
the result. All that finishes by virtual time 1 is within the budget, as the
targets add up to it. The words that finish later are summed by buckets of time
that double away from 1, a few thousand whatever the corpus; only in the bucket
where the budget is reached are services put in order one by one, which gives
the last service and its words. That point then cuts the stream in a projection.

Null and empty texts have size 0 and take 0. A null source is a source of its
own, ordered last; documents with a null id queue by their texts. Repeated rows
queue one after another; rows that are equal in all of id, size and text may
swap their places, which changes nothing. Texts of any length are counted whole.
Empty tables give an empty result. Extra columns are ignored by :func:`plan`
and kept by :func:`mix`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpforest.llm.common import all_of, n_words, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows that one task orders at a time, on average.
BUCKET_ROWS = 512
#: What counts as virtual time 1, for rounding, and time buckets for each doubling beyond it.
NEAR, OCTAVE = 1e-9, 64
#: Source tables up to this many rows are broadcast.
BROADCAST_SOURCES = 20_000


def queue_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), unnamed)))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target): shares by weight, water-filled below ``max_epochs`` times the size.

    Sources sorted by how soon they fill up; the first k that fill up keep
    their cap, and the others share the remainder by weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("_r", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_r") % len(weights)).cast("int") + 1).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * max_epochs)
    fills = W.orderBy(F.col("_cap") / F.col("weight"), "_r")
    everything = W.partitionBy()
    before = fills.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "_rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # Full if its share of what is left exceeds its cap; those fill up first, in this order.
    full = F.col("weight") * F.col("_rest") > F.col("_cap") * F.col("_weights")
    ranked = ranked.withColumn("_full", full)
    level = F.first(F.when(~F.col("_full"), F.struct("_rest", "_weights")), ignorenulls=True).over(
        fills.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    ranked = ranked.withColumn("_level", level)
    share = F.col("weight") * F.col("_level._rest").cast("double") / F.col("_level._weights")
    return ranked.select(
        "source", "source_size", "weight", "_r", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target")
    )


def _services(max_epochs: int) -> Column:
    """array<struct<at, epoch>>: when a document's services finish; none without words."""
    at = lambda e: F.try_divide((e * F.col("source_size") + F.col("before") + F.col("size")).cast("double"), F.col("target"))
    all_ = F.array(*(F.struct(at(e).alias("at"), F.lit(e).alias("epoch")) for e in range(max_epochs)))
    return F.when(F.col("size") > 0, all_).otherwise(F.slice(all_, 1, 0))


def _time_bucket(at: Column, rows: int) -> Column:
    """0 up to virtual time 1 (less rounding), then buckets that widen with the distance from it; never falls as time goes on."""
    beyond = at - (1 - NEAR)
    return F.when(beyond <= 0, F.lit(0)).otherwise(1 + F.floor(OCTAVE * F.log2(1 + beyond * float(max(rows, 1)))).cast("int"))


def _last_service(placed: DataFrame, rows: int, max_epochs: int):
    """(at, r, epoch, words) of the service in which the stream reaches the budget, or None if there are no words."""
    budget = placed.agg(F.sum("size")).first()[0] or 0
    if not budget:
        return None
    services = placed.select("_r", "size", F.explode(_services(max_epochs)).alias("s"))
    services = services.select("_r", "size", "s.at", "s.epoch", _time_bucket(F.col("s.at"), rows).alias("bucket"))
    sums = services.groupBy("bucket").agg(F.sum("size").alias("words"))
    until = F.sum("words").over(W.orderBy("bucket"))
    found = sums.withColumn("until", until).where(F.col("until") >= budget).orderBy("bucket").first()
    ahead = found["until"] - found["words"]
    inside = F.sum("size").over(W.orderBy("at", "_r", "epoch").rowsBetween(W.unboundedPreceding, W.currentRow)) + ahead
    last = services.where(F.col("bucket") == found["bucket"]).withColumn("until", inside).where(F.col("until") >= budget)
    row = last.orderBy("until").first()
    return row["at"], row["_r"], row["epoch"], row["size"] - (row["until"] - budget)


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, before, finish_time, services, taken, *keep).

    ``before`` counts the words queued ahead in the document's source;
    ``finish_time`` is that of its first service. ``services`` holds (at, epoch,
    words) of those before the stream's end, and ``taken`` sums their words.
    """
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
            queue_key(F.col("doc_id"), F.col("text"), seed).alias("_key"),
            F.xxhash64("text").alias("_text"),
            *keep,
        ),
        "mix",
    )
    rows = sized.count()
    digits = max(0, min(8, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16)))) if rows > BUCKET_ROWS else 0
    sources = stored(targets(sized, weights, max_epochs), "mix-sources")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    queued = sized.withColumn("_b", F.substring("_key", 1, digits) if digits else F.lit("")).join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    sums = queued.groupBy("_r", "_b").agg(F.sum("size").alias("_sum"))
    ahead = sums.select("_r", "_b", (F.sum("_sum").over(W.partitionBy("_r").orderBy("_b")) - F.col("_sum")).alias("_ahead"))
    inside = W.partitionBy("_r", "_b").orderBy("_key", "doc_id", "size", "_text").rowsBetween(W.unboundedPreceding, W.currentRow)

    def placed(columns: tuple[str, ...]) -> DataFrame:
        one = queued.select("source", "source_size", "target", "_r", "_b", "doc_id", "size", "_key", "_text", *columns)
        one = one.withColumn("_inside", F.sum("size").over(inside) - F.col("size")).join(ahead, ["_r", "_b"])
        return one.withColumn("before", F.col("_ahead") + F.col("_inside"))

    last = _last_service(placed(()), rows, max_epochs)
    if last is None:
        words = lambda s: F.lit(0).cast("long")
    else:
        at, r, epoch, cut = last
        place = lambda s: F.struct(s["at"].alias("at"), F.col("_r").alias("r"), s["epoch"].alias("epoch"))
        end = F.struct(F.lit(at).alias("at"), F.lit(r).alias("r"), F.lit(epoch).alias("epoch"))
        words = lambda s: F.when(place(s) < end, F.col("size")).when(place(s) == end, F.lit(cut)).otherwise(F.lit(0)).cast("long")
    services = F.filter(
        F.transform(_services(max_epochs), lambda s: F.struct(s["at"].alias("at"), s["epoch"].alias("epoch"), words(s).alias("words"))), lambda s: s["words"] > 0
    )
    first = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    out = placed(keep).withColumn("services", services)
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "before",
        first.alias("finish_time"),
        "services",
        F.aggregate("services", F.lit(0).cast("long"), lambda total, s: total + s["words"]).alias("taken"),
        *keep,
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed stream: rows of ``docs``, one per service, globally ordered by virtual finish time.

    The document at which the stream ends keeps its first words; documents that
    are not served are absent.
    """
    columns = docs.columns
    extra = [c for c in columns if c not in ("doc_id", "source")]
    packed = docs.select("doc_id", "source", "text", F.struct(*all_of(docs, "doc_id", "source")).alias("_row"))
    served = plan(packed, weights, max_epochs, seed, keep=("_row",)).withColumn("_s", F.explode("services"))
    pieces = F.regexp_extract_all(F.col("_row.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.when(F.col("_s.words") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("_s.words").cast("int")), "")).otherwise(
        F.col("_row.text")
    )
    field = {c: F.col("_row")[c].alias(c) for c in extra}
    out = [F.col(c) if c in ("doc_id", "source") else cut.alias("text") if c == "text" else field[c] for c in columns]
    return served.repartitionByRange(F.col("_s.at"), F.col("doc_id")).sortWithinPartitions("_s.at", "doc_id").select(*out)


def oracle_sql(weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """The stream as one window over all services."""
    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM s),
v AS (SELECT *, (CASE r % {len(weights)} {case} END)::BIGINT AS weight, (source_size * {max_epochs})::BIGINT AS cap FROM k),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::BIGINT AS rest,
  (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::BIGINT AS weights FROM v
  WINDOW p AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, weight * rest > cap * weights AS is_full FROM f),
l AS (SELECT rest, weights FROM o WHERE NOT is_full ORDER BY cap / weight, r LIMIT 1),
t AS (SELECT o.source, o.source_size, r, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * (SELECT rest FROM l)::DOUBLE / (SELECT weights FROM l) END AS target FROM o),
q AS (SELECT rid, doc_id, size, source_size, target, r, (sum(size) OVER (PARTITION BY r ORDER BY key, doc_id, size, md5(coalesce(text, ''))
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
e AS (SELECT rid, r, size, epoch, (epoch * source_size + before + size) / target AS done FROM q, (SELECT unnest(range({max_epochs})) AS epoch) WHERE size > 0),
g AS (SELECT rid, greatest(0, least(size, (SELECT sum(size) FROM sized) - (sum(size) OVER (ORDER BY done, r, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size))) AS words FROM e),
w AS (SELECT rid, sum(words) AS taken FROM g GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN w ON q.rid = w.rid"""
