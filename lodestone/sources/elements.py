"""Objects of one array in JSON files of any size, read by many tasks.

A file is read in pieces that end at opening braces, so Spark cuts it wherever it cuts files, and no row is longer than what lies between two braces.  Whether a piece begins inside a string,
and how deep it lies, are running counts: first within a block of the file, then over the blocks' totals, of which a file has few.  An object is put together from its own
pieces only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as fn

_RESULT = """struct<ruleId:string,level:string,message:struct<text:string>,
  locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>"""
_RULE = "struct<id:string,properties:struct<tags:array<string>,`security-severity`:string>>"
_BLOCK = ["file", "block"]


def _before(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all pieces of the file that lie before a piece."""
    own = pieces.withColumn("_v", value.cast("long"))
    totals = own.groupBy(*_BLOCK).agg(F.sum("_v").alias("_t"))
    earlier = F.coalesce(F.sum("_t").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("_v").over(Window.partitionBy(*_BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_w", within).join(totals.select(*_BLOCK, earlier.alias("_e")), _BLOCK).withColumn(name, F.col("_w") + F.col("_e")).drop("_v", "_w", "_e")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``at``, ``piece``, ``plain`` (without strings that are not names), ``opens`` (it ends at a brace that opens an object), ``depth`` of that brace."""
    read = spark.read.option("lineSep", "{").option("recursiveFileLookup", True).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    rows = rows.withColumn("bare", F.regexp_replace("piece", r"(?s)\\.", ""))
    rows = _before(rows, _count(F.col("bare"), '"'), "quotes")
    bare = F.concat(F.when(F.col("quotes") % 2 == 1, '"').otherwise(""), F.col("bare"))
    rows = rows.withColumns({
        "plain": F.regexp_replace(bare, r'("[^"]*"\s*:)|"[^"]*("|$)', "$1"),
        "_open": (_count(bare, '"') % 2 == 0).cast("int"),
        "_code": F.regexp_replace(bare, r'"[^"]*("|$)', ""),
    })
    rows = rows.withColumn("_inside", _count(F.col("_code"), "[") - _count(F.col("_code"), "]}"))
    rows = _before(rows, F.col("_inside") + F.col("_open"), "_start")
    return rows.select(*_BLOCK, "at", "piece", "plain", (F.col("_open") == 1).alias("opens"), F.col("_start").alias("start"), (F.col("_start") + F.col("_inside")).alias("depth"))


def elements(spark: SparkSession, path: str, array: str, depth: int, group_depth: int) -> DataFrame:
    """``file``, ``grp``, ``ordinal`` (from 1 in the file), ``body``: every object of the arrays called ``array`` whose braces lie below ``depth`` open brackets.

    ``grp`` numbers the objects at ``group_depth``, those that hold the arrays.  ``body`` may hold what follows the object up to the next brace; JSON functions read its first value.
    Objects are put together by key, so no task holds more than an object's pieces; a file that is not JSON gives what looks like objects, or nothing."""
    rows = _pieces(spark, path)
    begins = F.col("opens") & (F.col("depth") == depth)
    rows = _before(rows, F.when(begins, 1).otherwise(0), "nth")
    rows = _before(rows, F.when(F.col("opens") & (F.col("depth") == group_depth), 1).otherwise(0), "grp")
    # an array's name stands where its first object begins; later ones take it from there
    opened = F.regexp_extract("plain", r'"([^"]*)"\s*:\s*\[[^\[\]]*$', 1)
    named = F.when(begins & F.rlike("plain", F.lit(r'"\s*:\s*\[[^\[\]]*$')), opened)
    heads = rows.filter(begins).select(*_BLOCK, "at", F.col("nth").alias("_n"), named.alias("_name"))
    last = heads.groupBy(*_BLOCK).agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("at"))).alias("_t"))
    carried = last.select(*_BLOCK, F.last("_t", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    own = F.last("_name", ignorenulls=True).over(Window.partitionBy(*_BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    wanted = heads.withColumn("_own", own).join(carried, _BLOCK).filter(F.coalesce("_own", "_c") == array).select("file", (F.col("_n") + 1).alias("nth"))
    inside = rows.filter((F.col("start") > depth) & (F.col("nth") > 0)).join(wanted, ["file", "nth"], "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "piece")))
    whole = inside.groupBy("file", "nth").agg(F.min("grp").alias("grp"), F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: p["piece"]), "{")).alias("body"))
    # numbered among the wanted ones, in ranges of a thousand
    share = wanted.groupBy("file", F.floor(F.col("nth") / 1000).alias("_r")).agg(F.count(F.lit(1)).alias("_k"))
    offset = share.select("file", "_r", F.coalesce(F.sum("_k").over(Window.partitionBy("file").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    ranged = whole.withColumn("_r", F.floor(F.col("nth") / 1000)).join(offset, ["file", "_r"])
    return ranged.select("file", "grp", (F.col("_o") + F.row_number().over(Window.partitionBy("file", "_r").orderBy("nth"))).alias("ordinal"), "body")


def capped(found: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` objects of each file, and a gap for each file that has more: ``file``, ``kept``, ``left_out``."""
    n = F.max("ordinal")
    gaps = found.groupBy("file").agg(n.alias("n")).filter(F.col("n") > limit).select("file", F.lit(limit).cast("long").alias("kept"), (F.col("n") - limit).alias("left_out"))
    return found.filter(F.col("ordinal") <= limit), gaps


def sarif_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of SARIF reports of any size, as ``artifacts.sarif`` reads them from small ones, but for the tool's name and the check of the version."""
    rules = elements(spark, path, "rules", 6, 2).select("file", "grp", F.from_json("body", _RULE).alias("rule"))
    rules = rules.select("file", "grp", F.col("rule.id").alias("rule_id"), F.col("rule.properties").alias("props")).dropDuplicates(["file", "grp", "rule_id"])
    rows = elements(spark, path, "results", 4, 2).select("file", "grp", "ordinal", F.from_json("body", _RESULT).alias("r")).withColumn("rule_id", F.col("r.ruleId"))
    place = F.col("r.locations")[0]["physicalLocation"]
    level = F.coalesce("r.level", F.lit("warning"))
    score = F.col("props.security-severity").cast("double")
    return rows.join(rules, ["file", "grp", "rule_id"], "left").select(
        F.col("file").alias("path"),
        "ordinal",
        "rule_id",
        level.alias("level"),
        F.col("r.message.text").alias("message"),
        fn.normal_path(place["artifactLocation"]["uri"]).alias("file_path"),
        place["region"]["startLine"].alias("line_start"),
        F.coalesce(place["region"]["endLine"], place["region"]["startLine"]).alias("line_end"),
        F.nullif(fn.cwe(F.array_join("props.tags", ",")), F.lit("")).cast("int").alias("cwe"),
        F.when(score.isNotNull(), fn.severity_of(score)).otherwise(F.when(level == "error", "high").when(level == "warning", "medium").otherwise("low")).alias("severity"),
    ).filter("file_path is not null and line_start >= 1")
