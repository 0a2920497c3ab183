"""S3: one top-level JSON array of objects, read by many tasks.

Spark's own reader takes a multi-line file in one task. Here the file is read
as text that ends at each ``}`` (such a text file can be split anywhere).
Whether a piece begins inside a string follows from the quotes before it, how
deep it lies from the braces before it, and which record it belongs to from
the records closed before it: three running sums over the pieces, each a
range-partitioned scan. A record's pieces then meet in one row, and the
records are written as JSON lines into the shared scratch folder.

Line ends between tokens become blanks. Elements that are no objects, text
after the array and arrays without an end raise; an empty array has no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from replenish.operators.scan import running
from replenish.session import scratch_path

_PLACE = ["start", "piece"]


def _count(text, sign: str):
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, closed, text): the objects of each file's array, in order, and what follows the last (closed false)."""
    c = F.col
    pieces = spark.read.option("lineSep", "}").text(path).select(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("piece"), "value")
    order = [c("file"), *map(c, _PLACE)]
    bare = F.regexp_replace("value", r"\\.", "")  # a closing brace is never escaped, so no piece cuts an escape
    quoted = running(pieces, order, {"quotes": (_count(bare, '"').cast("long"), "sum")}, segment=["file"])
    inside = (c("quotes") - _count(bare, '"')) % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), bare), r'"[^"]*("|\z)', "")
    closes = (c("quotes") % 2 == 0).cast("long")
    marked = quoted.withColumn("closes", closes).withColumn("delta", _count(outside, "{").cast("long") - c("closes")).drop("quotes")
    deep = running(marked, order, {"depth": (c("delta"), "sum")}, segment=["file"])
    ended = deep.withColumn("ended", ((c("closes") == 1) & (c("depth") == 0)).cast("long")).drop("closes", "delta", "depth")
    told = running(ended, order, {"done": (c("ended"), "sum")}, segment=["file"])
    rows = told.groupBy("file", (c("done") - c("ended")).alias("record")).agg(
        (F.max("ended") == 1).alias("closed"), F.array_sort(F.collect_list(F.struct(*_PLACE, "value"))).alias("pieces"))
    return rows.select("file", "record", "closed", F.array_join(F.transform("pieces", lambda p: p["value"]), "}").alias("text"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The objects of the file's array (or of each file's, for a folder), schema inferred as for JSON lines."""
    c = F.col
    head = r"^\x{FEFF}?\s*"
    body = F.regexp_extract("text", head + r"[\[,]\s*(\{[\s\S]*)\z", 1)
    # the first object follows the bracket, every other one a comma
    fits = F.when(c("record") == 0, c("text").rlike(head + r"\[")).otherwise(c("text").rlike(r"^\s*,")) & (body != "")
    line = F.when(c("closed") & fits, F.concat(F.regexp_replace(body, r"[\r\n]+", " "), F.lit("}")))
    tail = ~c("closed") & F.when(c("record") == 0, c("text").rlike(head + r"\[\s*\]\s*\z")).otherwise(c("text").rlike(r"^\s*\]\s*\z"))
    seen, out = Observation(), scratch_path(spark, "json-array")
    rows = array_records(spark, path).select("record", line.alias("value"), tail.alias("tail"), (c("closed") & ~fits).alias("odd"))
    rows = rows.observe(seen, F.count_if(c("record") == 0).alias("files"), F.count_if("tail").alias("ends"), F.count_if("odd").alias("odd"))
    rows.where("value IS NOT NULL").select("value").write.text(out)
    got = seen.get
    if got["odd"] or got["files"] != got["ends"]:
        raise ValueError(f"{path}: not a JSON array of records")
    return spark.read.json(out)
