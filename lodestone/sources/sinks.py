"""Writers: reports, graph exports and tables replaced by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sarif_runs(findings: DataFrame, tool: str, by: str) -> DataFrame:
    """A SARIF 2.1.0 document for each value of ``by`` (``body``): results in order and the rules that they name.

    ``findings``: ``rule_id``, ``severity``, ``message``, ``file_path``, ``line_start``, ``line_end`` and, where findings have a path, ``steps``, an array of (``file``,
    ``line``, ``message``), which becomes the result's code flow.  A document holds one value's findings, so
    ``by`` has to be as fine as a report is read, a scan for instance."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    region = F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), *_flow(findings))
    runs = findings.groupBy(by).agg(F.array_sort(F.collect_list(result)).alias("results"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    return runs.select(by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("body"))


def _flow(findings: DataFrame) -> list[Column]:
    """``codeFlows`` of one thread with a location for each step, null without steps; nothing where findings have no such column."""
    if "steps" not in findings.columns:
        return []
    region = lambda x: F.struct(x["line"].alias("startLine"))
    at = lambda x: F.struct(F.struct(x["file"].alias("uri")).alias("artifactLocation"), region(x).alias("region"))
    located = F.transform("steps", lambda x: F.struct(F.struct(at(x).alias("physicalLocation"), F.struct(x["message"].alias("text")).alias("message")).alias("location")))
    thread = F.struct(F.array(F.struct(located.alias("locations"))).alias("threadFlows"))
    return [F.when(F.size("steps") > 0, F.array(thread)).alias("codeFlows")]


def annotations(findings: DataFrame) -> DataFrame:
    """A workflow command for each finding (``line``), which a code host shows beside the source; blocking ones are errors, others warnings.

    Characters that end a property or a message are escaped; findings without a file are left out."""
    plain = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    prop = lambda c: F.replace(F.replace(plain(c), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))
    kind = F.when(F.col("disposition") == "blocking", "error").otherwise("warning")
    text = F.concat(F.lit("::"), kind, F.lit(" file="), prop(F.col("file_path")), F.lit(",line="), F.col("line_start").cast("string"), F.lit(",title="), prop(F.col("rule_id")), F.lit("::"), plain(F.col("message")))
    return findings.filter("file_path is not null").select(*findings.columns, text.alias("line"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON line for each node (``id`` and more), then for each edge (``src``, ``dst`` and more), keys sorted: ``part``, ``line``."""
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("_kind"), *sorted(df.columns))).alias("line"))
    return line(nodes, "node").withColumn("part", F.lit(0)).union(line(edges, "edge").withColumn("part", F.lit(1))).select("part", "line")


def replace_projects(rows: DataFrame, path: str, by: str = "project_id") -> None:
    """Deletes what the table at ``path`` holds of the projects in ``rows`` and writes ``rows`` in its place; other projects stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def markdown_table(findings: DataFrame, rows: int = 50) -> str:
    """The first findings as a Markdown table, for a comment; the number of rows is the feature."""
    from lodestone.operators.findings import SEVERITIES, ordinal

    first = findings.orderBy(ordinal(F.col("severity"), SEVERITIES), F.desc("confidence"), "file_path", "line_start", "rule_id").limit(rows).collect()
    clean = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    body = [f"| {clean(r['severity'])} | {clean(r['rule_id'])} | {clean(r['file_path'])}:{r['line_start']} | {clean(r['message'])} |" for r in first]
    return "\n".join(["| severity | rule | place | message |", "|---|---|---|---|", *body])


def merged_identities(known: DataFrame | None, findings: DataFrame) -> DataFrame:
    """Identities after ``findings`` (``scan_id``, ``rule_id``, ``file_path``, ``message``) came in: ``identity``, ``first_scan``, ``last_scan``, ``occurrences``.

    A batch is summed up before it meets what is known, and sums can be summed in any order, so batches may come late."""
    own = F.sha2(F.concat_ws("\x1f", "rule_id", "file_path", "message"), 256)
    parts = findings.groupBy(own.alias("identity")).agg(F.min("scan_id").alias("first_scan"), F.max("scan_id").alias("last_scan"), F.count(F.lit(1)).alias("occurrences"))
    if known is None:
        return parts
    return known.unionByName(parts).groupBy("identity").agg(F.min("first_scan").alias("first_scan"), F.max("last_scan").alias("last_scan"), F.sum("occurrences").alias("occurrences"))
