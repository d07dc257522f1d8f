"""Fill-in-the-middle: documents cut at two places and put together in another order, to train a model to fill gaps.

A text is cut into tokens, each a run of white space with the word behind it (or
the white space at its end). The digest of ``<seed>:<doc_id>`` draws the two cuts
and the form, so reruns agree whatever the partitions: ``psm`` is prefix, suffix,
middle, ``spm`` suffix, prefix, middle, each part behind a marker of its own, and
``plain`` the text as it is. A text that holds a marker stays plain, so every
output can be taken apart again (:func:`restored`).

DuckDB does the work inside ``mapInArrow``: a batch is registered in slices of
about ``SLICE`` bytes of text, one statement with ``regexp_extract_all``,
``list_slice``, ``array_to_string`` and ``sha256`` makes all columns, and its
result goes back as Arrow, without Python code for single rows. Nothing is
shuffled; a task holds a slice and its tokens, or one text if that is longer.

Null texts count as empty, and empty ones are plain with 0 tokens. A null id is
drawn for as an empty one. Repeated rows come out alike, each on its own; an empty table gives
an empty result; other columns than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that DuckDB gets at a time.
SLICE = 8 << 20
#: White space with the word behind it, or white space at the end; the markers of prefix, suffix and middle.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")

SCHEMA = "doc_id long, text string, n long, form string, output string, prefix_chars long, middle_chars long"


def statement(rows: str, seed: int, share: int, spm: int) -> str:
    """DuckDB's SQL over ``rows`` (row, id, text): the columns of :data:`SCHEMA` but ``doc_id``."""
    draw = ", ".join(f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(text, '{m}')" for m in MARKERS)
    return f"""
SELECT row, text, n, form,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars
FROM (SELECT row, text, n, form, array_to_string(list_slice(tokens, 1, lo), '') AS p,
    array_to_string(list_slice(tokens, lo + 1, hi), '') AS m, array_to_string(list_slice(tokens, hi + 1, n), '') AS s
  FROM (SELECT row, text, tokens, n, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS lo, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS hi,
      CASE WHEN text = '' OR {marked} OR h3 % 100 >= {share} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
    FROM (SELECT row, text, tokens, CAST(len(tokens) AS BIGINT) AS n, {draw}
      FROM (SELECT row, text, regexp_extract_all(text, '{TOKEN}') AS tokens, sha256('{seed}:' || id) AS digest FROM {rows}))))"""


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, of a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def transform(docs: DataFrame, seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """:data:`SCHEMA` of every document: ``output`` is the text in its form, of which ``share`` percent aren't plain, and ``spm`` percent of those spm."""
    sql = statement("slice", int(seed), int(share), int(spm))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        try:
            for batch in batches:
                for part in _slices(batch, SLICE):
                    row = pa.array(np.arange(part.num_rows))
                    con.register("slice", pa.table({"row": row, "id": part.column("id"), "text": part.column("text")}))
                    made = con.execute(sql).to_arrow_table().combine_chunks()
                    con.unregister("slice")
                    if not made.column("row").combine_chunks().equals(row):
                        raise RuntimeError("rows came back in another order")
                    columns = [part.column("doc_id"), *(made.column(c) for c in made.column_names[1:])]
                    yield from pa.table(columns, names=["doc_id", *made.column_names[1:]]).to_batches()
        finally:
            con.close()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    given = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), text.alias("text"))
    return given.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Markers can't come up where parts meet, as each begins with its only ``<``."""
    width = len(PREFIX)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        # What stands behind the opening marker, then behind the second one, then behind the last.
        at = F.instr(output, second)
        rest = F.substr(output, at + width)
        to = F.instr(rest, MIDDLE)
        return F.substr(output, F.lit(width + 1), at - (width + 1)), F.substr(rest, F.lit(1), to - 1), F.substr(rest, to + width)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): digests of the outputs and of what is rebuilt from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def oracle_sql(seed: int = 42, share: int = 50, spm: int = 80) -> str:
    """The query's rows: the restored text has to be the document's."""
    rows = "(SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce(text, '') AS text FROM documents)"
    return f"""
WITH d AS {rows}, f AS ({statement("d", seed, share, spm)})
SELECT d.doc_id, f.n, f.form, f.prefix_chars, f.middle_chars, sha256(f.output) AS output_sha256, sha256(d.text) AS restored_sha256
FROM d JOIN f ON d.row = f.row"""
