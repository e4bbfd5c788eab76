"""Event batches (S1) and raw request bodies with gzip and size caps.

A batch is one JSON array (one file).  Any undecodable event rejects the
whole batch, so a batch is kept as one row until validated; the body caps
(5 MB raw, 50 MB inflated) bound that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail.schema import FIELDS

MAX_RAW_BYTES = 5 * 1024 * 1024
MAX_INFLATED_BYTES = 50 * 1024 * 1024

_ELEMS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
_REQUIRED = {"type"}
_NON_NULL = {w for w, _, _, d in FIELDS if d is not None} | _REQUIRED


def wire_json(prefix: str = "") -> Column:
    """One event as wire JSON (absent nulls omitted), from store columns."""
    return F.to_json(F.struct(*[F.col(prefix + s).alias(w) for w, s, _, _ in FIELDS]))


def _typed_field(m: Column, wire: str, dtype: T.DataType) -> Column:
    raw = m.getItem(wire)
    if isinstance(dtype, T.MapType):
        return F.from_json(raw, dtype)
    if isinstance(dtype, T.ArrayType):
        return F.from_json(raw, dtype)
    if isinstance(dtype, T.StringType):
        return raw
    return raw.try_cast(dtype)


def _flat_json(raw: Column) -> Column:
    """A JSON object / array whose values are all scalars and not null: the
    server decodes params as a string map and the stack as a string list
    (numbers and booleans pass leniently; nested values and nulls fail)."""
    # one look at the value's schema: nested kinds after its first "<" (anywhere, if it has none)
    sch = F.schema_of_variant(F.try_parse_json(raw))
    return F.coalesce(sch.rlike(r"(?s)^(?!(?:[^<]*+<)?+.*(?:OBJECT<|ARRAY<|VOID|VARIANT))"), F.lit(False))


def _field_ok(m: Column, wire: str, dtype: T.DataType) -> Column:
    """A present value must decode; non-nullable fields must not be JSON null."""
    raw = m.getItem(wire)
    present = F.map_contains_key(m, wire)
    typed = _typed_field(m, wire, dtype)
    if isinstance(dtype, (T.MapType, T.ArrayType)):
        typed = F.when(_flat_json(raw), typed)
    if wire in _NON_NULL:
        bad = present & (raw.isNull() | (typed.isNull()))
        if wire in _REQUIRED:
            bad = bad | ~present
    else:
        bad = present & raw.isNotNull() & typed.isNull()
    return ~bad


def decode_rows(texts: DataFrame, id_col: str = "batch_id", text_col: str = "value") -> DataFrame:
    """S1 on (batch id, body text) rows, judged in one pass.

    One row per event of an accepted batch (``batch_id``, ``pos`` = index in the
    batch, store columns, ``reason`` null) and one row per batch refused
    whole (``reason`` set, the event columns without meaning).  A batch that already has a
    ``reason`` (S2) keeps it.

    A batch stays one row while it is judged (``forall`` over its parsed
    elements, so no shuffle); accepted batches are exploded and typed with
    plain, code-generated column expressions.
    """
    given = F.col("reason") if "reason" in texts.columns else F.lit(None).cast("string")
    shaped = F.col(text_col).rlike(r"^\s*\[") & F.col(text_col).rlike(r"\]\s*\z")
    parsed = texts.select(F.col(id_col).alias("batch_id"), given.alias("__given"), shaped.alias("__shaped"),
                          F.when(shaped, F.from_json(F.col(text_col), _ELEMS)).alias("__arr"))
    all_ok = F.forall("__arr", lambda e: F.when(e.isNull(), F.lit(False)).otherwise(_all_fields_ok(e)))
    judged = parsed.withColumn(
        "reason",
        F.when(F.col("__given").isNotNull(), F.col("__given"))
         .when(~F.col("__shaped"), F.lit("not a JSON array"))
         .when(F.col("__arr").isNull(), F.lit("malformed JSON"))
         .when(~all_ok, F.lit("undecodable event")))
    rows = judged.select("batch_id", "reason", F.posexplode_outer(
        F.when(F.col("reason").isNull(), F.col("__arr"))).alias("pos", "__e"))
    rows = rows.where(F.col("pos").isNotNull() | F.col("reason").isNotNull())  # an empty batch has no rows
    cols = [F.col("batch_id"), F.col("pos").cast("int").alias("pos")]
    for w, s_, dt, d in FIELDS:
        c = _typed_field(F.col("__e"), w, dt)
        if d is not None:
            c = F.coalesce(c, F.lit(d).cast(dt))
        cols.append(c.alias(s_))
    return rows.select(*cols, "reason")


def split_rows(rows: DataFrame):
    """Judged rows (``decode_rows``) -> (events, rejected batches)."""
    refused = F.col("reason").isNotNull()
    return rows.where(~refused).drop("reason"), rows.where(refused).select("batch_id", "reason")


def decode_batches(texts: DataFrame, id_col: str = "batch_id", text_col: str = "value"):
    """S1 -> (events, rejected): ``decode_rows``, split.  The two frames are
    plans over the same source; to read it once, write ``decode_rows`` and
    split what was written."""
    return split_rows(decode_rows(texts, id_col, text_col))


def _can_fail(wire: str, dtype: T.DataType) -> bool:
    # a nullable text field accepts any value, so it needs no check
    return wire in _NON_NULL or not isinstance(dtype, T.StringType)


def _all_fields_ok(e: Column) -> Column:
    ok = F.lit(True)
    for w, _, dt, _ in FIELDS:
        if _can_fail(w, dt):
            ok = ok & _field_ok(e, w, dt)
    return ok


def read_batch_rows(spark: SparkSession, path: str, max_raw: int = MAX_RAW_BYTES,
                    max_inflated: int = MAX_INFLATED_BYTES) -> DataFrame:
    """S1 + S2: one file = one batch, as judged rows (``decode_rows``)."""
    return decode_rows(bodies_of(spark.read.format("binaryFile").load(path), max_raw, max_inflated))


def read_batches(spark: SparkSession, path: str, max_raw: int = MAX_RAW_BYTES,
                 max_inflated: int = MAX_INFLATED_BYTES):
    """S1 + S2: one file = one batch -> (events, rejected)."""
    return split_rows(read_batch_rows(spark, path, max_raw, max_inflated))


def inflate(data: bytes, max_inflated: int):
    """A body's text, or the reason it is refused.  Gzip is known by its ``1f 8b``
    magic; a gzip body may have several members and must be whole."""
    import zlib

    if data[:2] == b"\x1f\x8b":
        out, rest = b"", data
        try:
            while rest:
                d = zlib.decompressobj(16 + zlib.MAX_WBITS)
                out += d.decompress(rest, max_inflated + 1 - len(out))
                if len(out) > max_inflated:
                    return None, f"inflated body over {max_inflated} bytes"
                if not d.eof:  # cut before its trailer
                    return None, "bad gzip body"
                rest = d.unused_data
        except zlib.error:
            return None, "bad gzip body"
        data = out
    return data.decode("utf-8", errors="replace"), None


def bodies_of(files: DataFrame, max_raw: int = MAX_RAW_BYTES, max_inflated: int = MAX_INFLATED_BYTES) -> DataFrame:
    """S2 on a ``binaryFile`` frame or stream: one row per body (``batch_id``,
    ``value`` text, ``reason`` if refused).  Bodies over ``max_raw`` bytes are
    refused by their length alone; their content is not read."""
    def step(batches):
        import pandas as pd
        for b in batches:
            done = [inflate(bytes(c), max_inflated) for c in b["content"]]
            yield pd.DataFrame({"batch_id": b["path"].values, "value": [v for v, _ in done],
                                "reason": [r for _, r in done]})

    fits = F.col("length") <= F.lit(int(max_raw))
    ok = files.where(fits).select("path", "content").mapInPandas(
        step, "batch_id string, value string, reason string")
    too_big = files.where(~fits).select(F.col("path").alias("batch_id"), F.lit(None).cast("string").alias("value"),
                                        F.lit(f"raw body over {int(max_raw)} bytes").alias("reason"))
    return ok.unionByName(too_big)
