"""JSON arrays of objects, cut between tasks.

A text file is read in pieces that end at ``}``, which Spark splits by byte
ranges like lines, so one array of any size, on one line or many, is read by
many tasks.  Whether a brace stands inside a string, and how deep it lies,
depends on all pieces before it; both follow from running sums (of quotes, then
of brackets) over the pieces, chunk by chunk as in ``operators.scan``.  The
pieces between two braces that close an element are that element's text: the
only thing that is ever put together in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail.operators.scan import running_sum


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    # ids follow the order of a file's splits, as the line numbers of logs do
    return spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("at"), "value")


def _balance(text):
    return F.regexp_count(text, F.lit(r"[\[{]")) - F.regexp_count(text, F.lit(r"\]"))


def elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per element of each file: (source, pos, text, closed).  ``text`` starts with what
    stands before the element's brace (``[`` or ``,``).  The last row of a file
    is what follows its last element, not closed."""
    segments = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)
    marks = _pieces(spark, paths).select("source", "at", segments.alias("__s")).select(
        "source", "at", (F.size("__s") - 1).alias("__q"),
        _balance(F.array_join(F.filter("__s", lambda x, i: i % 2 == 0), " ")).alias("__outside"),
        _balance(F.array_join(F.filter("__s", lambda x, i: i % 2 == 1), " ")).alias("__inside"))
    quotes = running_sum(marks, ["source"], "at", "__q", out="__quotes")
    free = F.col("__quotes") % 2 == 0  # the piece's closing brace stands outside strings
    steps = quotes.select("source", "at", free.alias("__free"), (
        F.when((F.col("__quotes") - F.col("__q")) % 2 == 0, F.col("__outside")).otherwise(F.col("__inside"))
        - free.cast("int")).alias("__step"))
    depth = running_sum(steps, ["source"], "at", "__step", out="__depth")
    ends = depth.select("source", "at", (F.col("__free") & (F.col("__depth") == 1)).cast("int").alias("__end"))
    placed = running_sum(ends, ["source"], "at", "__end", out="__ended").select(
        "source", "at", "__end", (F.col("__ended") - F.col("__end")).alias("pos"))
    # the number of pieces grows with the files: a merge join at every size
    texts = _pieces(spark, paths).join(placed.hint("merge"), ["source", "at"])
    got = texts.groupBy("source", "pos").agg(
        F.max("__end").alias("__end"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("__p"))
    text = F.array_join(F.col("__p.value"), "}")
    closed = F.col("__end") == 1
    return got.select("source", "pos", F.when(closed, F.concat(text, F.lit("}"))).otherwise(text).alias("text"),
                      closed.alias("closed"))


def body(text):
    """The element itself."""
    return F.regexp_replace(text, r"^\s*[\[,]\s*", "")


def is_plain():
    """Whether a row of ``elements`` is as in an array of objects: ``[`` before the
    first, ``,`` before the others, ``]`` after the last."""
    first = F.col("pos") == 0
    return F.when(F.col("closed"), F.col("text").rlike(r"^\s*\[\s*\{") & first | F.col("text").rlike(r"^\s*,\s*\{") & ~first
                  ).otherwise(F.col("text").rlike(r"^\s*\[\s*\]\s*$") & first | F.col("text").rlike(r"^\s*\]\s*$") & ~first)
