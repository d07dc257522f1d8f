"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every rule compares two whole numbers, ``1000 * measure`` against
``limit * per``, so that no rounding enters and any SQL engine gives the same
verdict. Nothing is shuffled: the operator is a projection over the scan.

Null and empty texts have no words and fail the base rule; null ids don't
matter. Repeated rows are judged alike, each on its own. Texts of any length
are read whole, in one row's arrays. An empty table gives an empty result.
Extra columns are left alone by :func:`filter_quality`, whatever their names,
and dropped by :func:`judge`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpforest.llm.common import UPPER, WORD, all_of, unused

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Percent of the words that may stand in repeated windows.
MAX_REPEATED = 30
#: Function words of the corpus's languages; a word counts if it is one of them, or one with a capital.
STOP_WORDS = tuple(
    "the of and to in is that it for on was as with be by are this "
    "le la les de des du un une et en que qui pour dans est sur au "
    "der die das und den von zu mit ist ein eine nicht auch im für "
    "el los las y es por con para se del al".split()
)


@dataclass(frozen=True)
class Rule:
    """Reject where ``1000 * measure`` is beyond ``limit * per`` in texts of ``from_words`` words or more."""

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None
    from_words: int = MIN_WORDS


#: Limits are thousandths of ``per``.
RULES = (
    Rule("word length", "word_chars", "n_words", low=2_000, high=15_000),
    Rule("symbols a word", "n_symbols", "n_words", high=150),
    Rule("exclamation marks a word", "n_exclaims", "n_words", high=500),
    Rule("capitals a character", "n_capitals", "word_chars", high=500),
    Rule("stop words a word", "n_stop_words", "n_words", low=20, from_words=60),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=500),
    Rule("words in repeated windows", "n_repeat_words", "n_words", high=10 * MAX_REPEATED),
)


def _count(text: Column, chars: str) -> Column:
    """Occurrences of a regular expression's character class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _pairs(hashes: str, step: int) -> Column:
    """Hashes of windows twice as wide, from those that start here and ``step`` words on."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text: str = "text", prefix: str = "_") -> DataFrame:
    """``docs`` with a struct of whole-text measures, named ``prefix`` and ``m``; no column may begin with ``prefix``."""
    w, h, s, p, lines = (f"{prefix}{x}" for x in "whspl")
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1))
    # Windows are told apart by a 64-bit hash, doubled from 1 to 8 words; texts without an equal pair skip the sort.
    out = docs.withColumn(w, words).withColumn(h, F.when(F.size(w) >= WINDOW, F.transform(w, lambda x: F.xxhash64(x))))
    for step in (1, 2, 4):
        out = out.withColumn(h, _pairs(h, step))
    out = out.withColumn(h, F.slice(h, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))))
    order = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    out = out.withColumn(s, order)
    twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn(p, F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda total, x: total + x,
    )
    out = out.withColumn(lines, F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)))
    return out.withColumn(
        f"{prefix}m",
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0), lambda total, x: total + F.length(x)).cast("long").alias("word_chars"),
            _count(body, SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
            _count(body, "A-Z").alias("n_capitals"),
            F.size(F.filter(w, lambda x: x.isin(*_stop_forms()))).cast("long").alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_lines"),
        ),
    ).drop(w, h, s, p, lines)


def _stop_forms() -> list[str]:
    return sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


def _passes(rule: Rule, prefix: str = "_") -> Column:
    measure, per = 1000 * F.col(f"{prefix}m.{rule.measure}"), F.col(f"{prefix}m.{rule.per}")
    good = F.lit(True)
    if rule.low is not None:
        good &= measure >= rule.low * per
    if rule.high is not None:
        good &= measure <= rule.high * per
    return good | (F.col(f"{prefix}m.n_words") < rule.from_words)


def base_failed(prefix: str = "_") -> Column:
    n = F.col(f"{prefix}m.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{prefix}m.n_repeat_words") > MAX_REPEATED * n)


def verdict(rules: tuple[Rule, ...] = RULES, prefix: str = "_") -> Column:
    kept = ~base_failed(prefix)
    for rule in rules:
        kept &= _passes(rule, prefix)
    return kept


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: measures, ``base_failed``, ``kept`` and the first rule broken."""
    broken = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        broken = broken.when(~_passes(rule), F.lit(rule.name))
    return measures(docs.select("doc_id", "text")).select(
        "doc_id",
        *(F.col(f"_m.{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed().alias("base_failed"),
        verdict(rules).alias("kept"),
        broken.alias("broken_rule"),
    )


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass; columns as they came, whatever their names."""
    prefix = unused(docs.columns)
    # The row number keeps the optimizer from pushing the filter, and with it copies of all measures, down to the scan.
    measured = measures(docs, prefix=prefix).withColumn(f"{prefix}n", F.monotonically_increasing_id())
    return measured.where(verdict(rules, prefix) & (F.col(f"{prefix}n") >= 0)).select(*all_of(docs))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    def passes(rule: Rule) -> str:
        good = [f"n_words < {rule.from_words}"]
        tests = ([f"1000 * {rule.measure} >= {rule.low} * {rule.per}"] if rule.low is not None else []) + (
            [f"1000 * {rule.measure} <= {rule.high} * {rule.per}"] if rule.high is not None else []
        )
        return f"({good[0]} OR ({' AND '.join(tests)}))"

    stop = ", ".join(f"'{w}'" for w in _stop_forms())
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    base = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)"
    broken = "CASE WHEN " + base + " THEN 'base' " + " ".join(f"WHEN NOT {passes(r)} THEN '{r.name}'" for r in rules) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: {{'i': i, 'g': list_slice(ws, i, i + {WINDOW - 1})}})) AS x
  FROM w WHERE len(ws) >= {WINDOW}),
c AS (SELECT rid, x.i AS i, count(*) OVER (PARTITION BY rid, x.g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS k FROM c WHERE n > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  ({count(SYMBOLS)})::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {count('!')} AS n_exclaims, {count(UPPER)} AS n_capitals,
  len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop_words,
  len(ls) AS n_lines FROM w LEFT JOIN r ON w.rid = r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed,
  (NOT {base} AND {' AND '.join(passes(r) for r in rules)}) AS kept, {broken} AS broken_rule FROM m"""
