"""Text sources: the fixed layout of a catalogue, tables with known headers, and delimited line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.functions.moments import fixed_offset_local, local_to_utc
from tremora.functions.textual import flags
from tremora.operators.sequences import segment_ids

#: Fixed value: date, time, latitude, longitude, magnitude, depth, fixed, and a place that may be missing.
LINE = r"^\s*(\d{8})\s+(\d{6}(?:\.\d+)?)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.*?))?\s*$"


def numbered_lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """file, line number from 1 and text of each line; a file is read as one value so that its order is sure."""
    whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", charset).alias("text"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("number", "value")).withColumn("number", F.col("number") + 1)


def parse_catalog(lines: DataFrame) -> DataFrame:
    """source_row and value to typed columns. Lines out of layout or range get a fault, and keep the time if
    that is valid; a negative depth is null and flagged, like a fixed mark other than 000."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    number = lambda i: part(i).try_cast("double")
    rows = lines.select("source_row", "value", number(3).alias("latitude"), number(4).alias("longitude"), number(5).alias("magnitude"), number(6).alias("depth"), part(7).alias("fixed"), F.nullif(part(8), F.lit("")).alias("place"), part(1).alias("date"), part(2).alias("time"))
    piece = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    second = F.substring("time", 5, 20).try_cast("decimal(8,6)")
    valid = (F.col("date") != "") & piece("date", 5, 2).between(1, 12) & piece("date", 7, 2).between(1, 31) & (piece("time", 1, 2) < 24) & (piece("time", 3, 2) < 60) & (second < 60)
    fault = F.when(F.col("date") == "", "layout").when(~valid, "time").when(~F.coalesce(F.abs("latitude") <= 90, F.lit(False)) | ~F.coalesce(F.abs("longitude") <= 180, F.lit(False)), "coordinates").when(~F.coalesce(F.col("magnitude") >= 0, F.lit(False)), "magnitude")
    local = F.when(valid, fixed_offset_local(piece("date", 1, 4), piece("date", 5, 2), piece("date", 7, 2), piece("time", 1, 2), piece("time", 3, 2), second))
    out = rows.withColumns({"fault": fault, "origin_local": local, "depth_km": F.when(F.col("depth") >= 0, F.col("depth"))})
    return out.withColumns({"origin_utc": local_to_utc(F.col("origin_local")), "flags": flags(negative_depth=F.col("depth") < 0, fixed_mark=F.col("fixed") != "000", availability_optimistic=F.lit(True))}).drop("date", "time", "depth", "value")


def parse_columns(rows: DataFrame) -> DataFrame:
    """A table of eleven columns (year to second, place and size) to the same typed columns; second 60 carries."""
    local = fixed_offset_local("year", "month", "day", "hour", "minute", F.col("second").cast("decimal(8,6)"))
    return rows.withColumn("origin_local", local).withColumn("origin_utc", local_to_utc(F.col("origin_local")))


#: The columns of a table of events in eleven columns.
COLUMNS = ("year", "month", "day", "hour", "minute", "second", "longitude", "latitude", "depth", "magnitude", "place")


def column_faults(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Rows of an extract with a cell that is missing or out of range, with the fault. Raises where the columns are not
    exactly these, in order."""
    if tuple(rows.columns) != columns:
        raise ValueError(f"columns {rows.columns} instead of {columns}")
    empty = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]), lambda x: x.isNotNull()), ",")
    bad = F.when(empty != "", F.concat(F.lit("missing "), empty)).when((F.abs(F.col("longitude")) > 180) | (F.abs(F.col("latitude")) > 90), "coordinates").when(F.col("second") > 60, "second")
    return rows.withColumn("fault", bad).filter("fault is not null")


def calendar_faults(found: DataFrame, days: list[float], horizons: tuple[int, ...]) -> DataFrame:
    """Exposures that a calendar (partition, horizon, issue_day) has and the greedy choice from ``days`` has not, or the
    other way round: partition, horizon, issue_day and side. Repeated rows are faults too."""
    from tremora.operators.sequences import greedy_exposures

    every = F.array(*[F.lit(float(d)) for d in sorted(days)])
    plans = F.array(*[F.struct(F.lit(h).alias("horizon"), greedy_exposures(every, float(h)).alias("days")) for h in horizons])
    wanted = found.select("partition").distinct().withColumn("p", F.explode(plans)).select("partition", "p.horizon", F.explode("p.days").alias("issue_day"))
    mine = found.select("partition", F.col("horizon").cast("int").alias("horizon"), F.col("issue_day").cast("double").alias("issue_day"))
    return mine.exceptAll(wanted).withColumn("side", F.lit("calendar")).unionByName(wanted.exceptAll(mine).withColumn("side", F.lit("greedy")))


def parse_segments(lines: DataFrame) -> DataFrame:
    """file, segment, header, comments, point and coordinates of line files: '>' starts a segment, '#' lines are comments
    of the segment they stand in."""
    everything = segment_ids(lines.filter(F.trim("value") != ""), "number", "value", ["file"])
    numbered = everything.filter(~F.col("value").startswith("#"))
    remark = F.struct("number", F.trim(F.substring("value", 2, 1_000_000)).alias("text"))
    comments = everything.filter(F.col("value").startswith("#")).groupBy("file", "segment").agg(F.transform(F.array_sort(F.collect_list(remark)), lambda x: x["text"]).alias("comments"))
    headers = numbered.filter(F.col("value").startswith(">")).select("file", "segment", F.col("number").alias("delimiter_line"), F.trim(F.substring("value", 2, 1_000_000)).alias("header")).join(comments, ["file", "segment"], "left")
    pair = F.split(F.trim("value"), r"[\s,]+")
    points = numbered.filter(~F.col("value").startswith(">")).select("file", "segment", "number", pair[0].try_cast("double").alias("longitude"), F.get(pair, 1).try_cast("double").alias("latitude"), F.size(pair).alias("fields"))
    fault = F.when((F.col("fields") != 2) | F.col("longitude").isNull() | F.col("latitude").isNull(), "numbers").when((F.abs("longitude") > 180) | (F.abs("latitude") > 90), "range")
    return points.withColumn("fault", fault).join(headers, ["file", "segment"], "left").drop("fields")


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """partition, horizon and issue_date of a JSON calendar {partition: {horizon: [dates]}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    by_partition = raw.select(F.explode("m").alias("partition", "h")).select("partition", F.explode("h").alias("horizon", "dates"))
    return by_partition.select("partition", F.col("horizon").cast("int").alias("horizon"), F.explode("dates").alias("issue_date")).withColumn("issue_date", F.to_date("issue_date"))
