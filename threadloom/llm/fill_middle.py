"""Fill-in-middle transformation: DuckDB runs inside ``mapInArrow`` and sees each slice of a batch as a table.

Texts are cut into units at white space; two numbers drawn from a hash of the seed and the id say where the middle begins and
ends. The work on texts is SQL (``regexp_extract_all``, ``list_slice``, ``array_to_string``, ``sha256``); columns that are carried
along stay in Arrow, so their names and types don't matter to the SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: Bytes of text that DuckDB sees at a time (or one longer text).
SLICE = 2 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space and what follows it, or white space that ends the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

_TRANSFORM = f"""
WITH cut AS (
  SELECT _row, _text, regexp_extract_all(_text, '{UNIT}') AS unit, sha256(concat($seed::VARCHAR, ':', coalesce(_id::VARCHAR, ''))) AS h FROM texts),
drawn AS (
  SELECT _row, _text, unit, len(unit) AS n,
         concat('0x', h[1:8])::BIGINT % (len(unit) + 1) AS a, concat('0x', h[9:16])::BIGINT % (len(unit) + 1) AS b,
         CASE WHEN _text = '' OR contains(_text, '{PREFIX}') OR contains(_text, '{SUFFIX}') OR contains(_text, '{MIDDLE}')
                OR concat('0x', h[17:24])::BIGINT % 100 >= $rate THEN 'plain'
              WHEN concat('0x', h[25:32])::BIGINT % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT _row, _text, n, form,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, 1, least(a, b)), '') END AS p,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, least(a, b) + 1, greatest(a, b)), '') END AS m,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, greatest(a, b) + 1, n), '') END AS s
  FROM drawn)
SELECT _row, n::BIGINT AS n, form, length(p)::BIGINT AS prefix_chars, length(m)::BIGINT AS middle_chars,
       CASE form WHEN 'plain' THEN _text WHEN 'psm' THEN concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m)
                 ELSE concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) END AS output
FROM parts
"""

# parts hold no marker, and none can arise where a part meets one, so the first of each is the one that was put there
_RESTORE = f"""
WITH split AS (
  SELECT _row, _text, _form, string_split(substr(_text, 4), CASE _form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS x FROM texts)
SELECT _row,
       CASE _form WHEN 'plain' THEN _text
                  WHEN 'psm' THEN concat(x[1], string_split(x[2], '{MIDDLE}')[2], string_split(x[2], '{MIDDLE}')[1])
                  ELSE concat(string_split(x[2], '{MIDDLE}')[1], string_split(x[2], '{MIDDLE}')[2], x[1]) END AS restored
FROM split
"""

_open = []


def _connection():
    """One in-memory DuckDB a worker, of one thread, that never writes to the machine's disk."""
    if not _open:
        import duckdb

        con = duckdb.connect(":memory:")
        con.execute("SET threads = 1")
        con.execute("SET temp_directory = ''")
        _open.append(con)
    return _open[0]


def _run(sql: str, columns: dict[str, pa.Array], numbers: dict[str, int]) -> pa.Table:
    """The SQL over one slice, its rows in the order of the slice."""
    con = _connection()
    con.register("texts", pa.table({"_row": pa.array(np.arange(len(columns["_text"]))), **columns}))
    try:
        out = con.sql(sql, params=numbers).to_arrow_table()
    finally:
        con.unregister("texts")
    return out.take(pa.array(np.argsort(out["_row"].to_numpy(), kind="stable"))).drop_columns(["_row"])


def _over(df: DataFrame, columns: list, sql: str, numbers: dict[str, int], made: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``_rest`` and what the SQL makes of the other columns, the first of which is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = T.as_bytes(batch.column("_text"))
            for lo, hi in T.chunks(offsets, SLICE):
                part = batch.slice(lo, hi - lo)
                out = _run(sql, {n: part.column(n) for n in part.schema.names if n != "_rest"}, numbers)
                done = [out[n].cast(t).combine_chunks() for n, t in made.items()]
                yield pa.record_batch([part.column("_rest"), *(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in done)], names=["_rest", *made])

    asked = df.select(*columns)
    return asked.mapInArrow(run, f"_rest {asked.schema['_rest'].dataType.simpleString()}, {schema}")


def fill_in_middle(
    df: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns but the text, with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate`` of a hundred texts change their form, ``spm`` of a hundred of those begin with the suffix. A null or empty text
    and one that holds a marker stay plain; plain rows have null prefix_chars and middle_chars. A null id draws as an empty one;
    rows with one id draw alike, each over its own text. White space alone is one unit. An empty table gives no row; columns
    named like a result are replaced by it.
    """
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    rest = [F.col(c) for c in df.columns if c not in (*results, text_col)]
    columns = [F.struct(*(rest or [F.lit(0).alias("_none")])).alias("_rest"), F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")]
    made = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    schema = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    out = _over(df, columns, _TRANSFORM, {"seed": seed, "rate": rate, "spm": spm}, made, schema)
    return out.select(*(["_rest.*"] if rest else []), *results)


def restore(df: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """All columns and ``restored``: the text that ``fill_in_middle`` was given, from its output and form alone. Null outputs are empty."""
    rest = [F.col(c) for c in df.columns if c != "restored"]
    columns = [F.struct(*rest).alias("_rest"), F.coalesce(F.col(form_col), F.lit("plain")).alias("_form"), F.coalesce(F.col(output_col), F.lit("")).alias("_text")]
    return _over(df, columns, _RESTORE, {}, {"restored": pa.string()}, "restored string").select("_rest.*", "restored")
