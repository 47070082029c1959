"""Document fingerprints from closed syncmers of words (DataFrame functions only).

A k-mer of words is an anchor if the least of its inner s-mers is the first or the last of them. That depends on the
k-mer alone, so shared passages have the same anchors wherever they stand. The fingerprint keeps the least hashes of
the anchors; the share of common ones among the least of both documents estimates how alike their anchors are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import durable

K, S = 5, 2
#: Words of more characters count as their characters, as do all words of a text of fewer units than surely hold an anchor.
LONG, FEW = 24, 2 * K - S - 1
#: Hashes a fingerprint keeps, of 32 bits each.
SIZE = 64
#: Documents of one bucket when each is set beside the next, and the most buckets (their bounds go through the driver). Beyond
#: so many, a bucket is a 40,000th of the table, some 2.5 GB of 100 TB: it is sorted with spilling, and the window holds two rows.
BUCKET_ROWS, MOST_BUCKETS = 1_000, 40_000

_LOW = (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _units(words: Column) -> Column:
    """The words, long ones (or text without blanks) by characters; of few words their characters and the blanks between."""
    by_char = lambda x: F.when(F.length(x) > LONG, F.split(x, "")).otherwise(F.array(x))
    pieces = lambda w: F.when(F.exists(w, lambda x: F.length(x) > LONG), F.flatten(F.transform(w, by_char))).otherwise(w)
    few = lambda w, p: F.when((F.size(p) > 0) & (F.size(p) < FEW), F.split(F.array_join(w, " "), "")).otherwise(p)
    return _let(words, lambda w: _let(pieces(w), lambda p: few(w, p)))


def _unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    while name in df.columns:
        name = f"_{name}"
    return name


def with_anchors(df: DataFrame, text_col: str, into: str = "anchors") -> DataFrame:
    """Adds ``into``: array of (pos, hash), the position and 32-bit hash of each closed syncmer of words (see _units).

    Null texts and texts without words have none; where no syncmer is closed the whole sequence is the only anchor.
    """
    h, s, w = (_unused(df, f"_{into}_{x}") for x in "hsw")
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    hashed = df.withColumn(w, _units(words)).withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    at = lambda c, i: F.get(F.col(c), i)
    inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*(at(h, i + j) for j in range(S))))
    hashed = hashed.withColumn(s, F.when(F.size(h) >= K, inner))
    last = K - S
    closed = F.filter(
        F.sequence(F.lit(0), F.size(h) - K),
        lambda i: F.least(at(s, i), at(s, i + last)) <= F.least(*(at(s, i + j) for j in range(1, last))),
    )
    named = lambda i: F.struct(i.alias("pos"), F.xxhash64(*(at(h, i + j) for j in range(K))).bitwiseAND(F.lit(_LOW)).alias("hash"))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h).bitwiseAND(F.lit(_LOW)).alias("hash")))
    none = F.slice(whole, 1, 0)
    found = F.when(F.size(h) >= K, F.transform(closed, named)).otherwise(none)
    made = _let(found, lambda a: F.when((F.size(a) == 0) & (F.size(h) > 0), whole).otherwise(a))
    return hashed.withColumn(into, made).drop(h, s, w)


def sketch(anchors: str) -> Column:
    """The least hashes of the anchors, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.col(f"{anchors}.hash"))), 1, SIZE)


def as_text(sketch: str | Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """From 0 to 1: the share of both among the least SIZE hashes of either; 1 for two empty fingerprints."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / F.greatest(F.size(union), F.lit(1)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, anchors (pos, hash) and fingerprint. Equal texts have equal fingerprints; an empty table gives no row."""
    rows = with_anchors(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text")
    return rows.withColumn("_sketch", sketch("anchors")).select("doc_id", "anchors", as_text("_sketch").alias("fingerprint"))


def align(pairs: DataFrame, key_col: str, a: str, b: str) -> DataFrame:
    """Positional matches of the anchors in columns ``a`` and ``b``: one row for each key and shift (position in b less that in a).

    Columns: the key, shift, n_anchors, a_start and a_end (positions of the first and last of them in a). Within a key each hash
    counts at its first position on either side, so a phrase that recurs gives no pairs of its occurrences. The keys have to be
    unique; a null key, or a pair without common anchors, gives no row; further columns are not carried along.
    """
    made = durable(pairs.select(F.col(key_col).alias("_key"), F.col(a).alias("_x"), F.col(b).alias("_y")), "anchors")
    side = lambda c, pos: made.select("_key", F.inline(c)).groupBy("_key", "hash").agg(F.min("pos").alias(pos))
    met = side("_x", "_a").join(side("_y", "_b"), ["_key", "hash"])  # both sides are grouped by the key of the join
    shifts = met.groupBy("_key", (F.col("_b") - F.col("_a")).alias("shift"))
    found = shifts.agg(F.count("*").alias("n_anchors"), F.min("_a").alias("a_start"), F.max("_a").alias("a_end"))
    return found.withColumnRenamed("_key", key_col)


def beside_next(df: DataFrame, order_col: str, columns: list[str], rows: int) -> DataFrame:
    """Adds ``next_<c>`` of ``columns``: those of the next row by ``order_col``, then by the columns; after the last comes the first.

    A null id comes first. Buckets of consecutive ids are sorted each on its own; the first row of a bucket is also sent
    to the bucket before. Columns named like a result are replaced by it.
    """
    # no name of the table's columns clashes with one made here: what is set beside has names of its own, the rest is in a struct
    own = {c: f"_c{i}" for i, c in enumerate(columns)}
    rest = F.struct(F.lit(None).alias("_"), *(F.col(c) for c in df.columns if c not in own)).alias("_row")
    ordered = df.select(rest, *(F.col(c).alias(n) for c, n in own.items()), F.coalesce(F.col(order_col).cast("long"), F.lit(-(1 << 63))).alias("_ord"))
    n = max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))
    quantiles = F.percentile_approx("_ord", [i / n for i in range(n)], 100 * n)
    bounds = sorted({*(ordered.agg(quantiles.alias("q"), F.min("_ord").alias("m")).select(F.concat("q", F.array("m"))).first()[0] or [0])})
    # bounds as one broadcast row of ids of the table: as many as buckets
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    one = df.sparkSession.createDataFrame([([p[0] for p in parts], parts)], "_coarse array<long>, _fine array<array<long>>")
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("_ord")))
    placed = ordered.crossJoin(F.broadcast(one)).withColumn("_part", below(F.col("_coarse")) - 1)
    placed = placed.withColumn("_own", F.get(F.col("_fine"), F.col("_part")))
    placed = placed.withColumn("_b", F.col("_part") * step + below(F.col("_own")) - 1)
    head = F.get(F.col("_own"), F.col("_b") - F.col("_part") * step) == F.col("_ord")
    here = F.struct(F.col("_b").alias("_bucket"), F.lit(False).alias("_copy"), F.lit(0).alias("_wrap"))
    before = F.struct(
        F.pmod(F.col("_b") - 1, F.lit(len(bounds))).alias("_bucket"), F.lit(True).alias("_copy"), (F.col("_b") == 0).cast("int").alias("_wrap")
    )
    sent = placed.withColumn("_to", F.when(head, F.array(here, before)).otherwise(F.array(here)))
    sent = sent.drop("_coarse", "_fine", "_own", "_part", "_b").select("*", F.inline("_to")).drop("_to")
    w = Window.partitionBy("_bucket").orderBy("_wrap", "_ord", *own.values())
    after = {f"next_{c}": F.lead(n).over(w) for c, n in own.items()}
    out = sent.select("_row", *own.values(), "_copy", *(x.alias(n) for n, x in after.items())).where(~F.col("_copy"))
    kept = [F.col(own[c]).alias(c) if c in own else F.col("_row").getField(c).alias(c) for c in df.columns if c not in after]
    return out.select(*kept, *after)
