"""Source trees as relations: files, what is admitted, and facts of Python sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as fn

# Languages by extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "go": "go", "rs": "rust", "swift": "swift", "kt": "kotlin",
}


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``path``, ``size``, ``content`` of every file below ``root`` whose path matches no exclude pattern (``*`` any characters)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    for pattern in exclude:
        files = files.filter(~F.col("path").like(pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%")))
    return files.select("path", F.col("length").alias("size"), "content")


def language(path: Column) -> Column:
    """By extension; null for others."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"[.]([A-Za-z0-9]+)$", 1)))


def admitted(files: DataFrame, languages: tuple[str, ...], max_kb: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The files that are analysed, and a row for each reason why others are not: ``code``, ``affected``."""
    lang = language(F.col("path"))
    reason = F.when(lang.isNull(), "unsupported").when(~lang.isin(*languages), "not_configured").when(F.col("size") > max_kb * 1024, "too_large")
    judged = files.withColumn("language", lang).withColumn("code", reason)
    return judged.filter("code is null").drop("code"), judged.filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("affected"))


def _facts(source: str) -> Iterator[tuple]:
    tree = ast.parse(source)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "function", node.name, node.lineno, node.end_lineno, [a.arg for a in node.args.args]
        elif isinstance(node, ast.ClassDef):
            yield "class", node.name, node.lineno, node.end_lineno, [ast.unparse(b) for b in node.bases]
        elif isinstance(node, ast.Call):
            yield "call", ast.unparse(node.func), node.lineno, node.end_lineno, [ast.unparse(a) for a in node.args]
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name, node.lineno, node.end_lineno, [a.asname or a.name]
        elif isinstance(node, ast.ImportFrom):
            yield "import", node.module or ".", node.lineno, node.end_lineno, [a.name for a in node.names]


def python_facts(files: DataFrame) -> DataFrame:
    """Functions, classes, calls and imports of Python files: ``path``, ``kind``, ``name``, ``line_start``, ``line_end``, ``parts``.

    A file that does not parse is one row of kind ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "name", "line_start", "line_end", "parts"]
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, *f) for f in _facts(bytes(content).decode("utf-8", "replace"))]
                except (SyntaxError, ValueError) as e:
                    rows.append((path, "error", type(e).__name__, None, None, []))
            yield pd.DataFrame(rows, columns=names).astype({"line_start": "Int32", "line_end": "Int32"})

    schema = "path string, kind string, name string, line_start int, line_end int, parts array<string>"
    return files.filter(language(F.col("path")) == "python").select("path", "content").mapInPandas(run, schema)


def changed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files of a supported language that the change list ``paths`` (``path``) names."""
    return files.filter(language(F.col("path")).isNotNull()).join(paths.select("path"), "path", "left_semi")


def snapshot(files: DataFrame, max_file: int, max_total: int) -> tuple[DataFrame, DataFrame]:
    """The files that a snapshot of each repository holds, and what it leaves out: ``repository_id``, ``code``, ``affected``.

    ``files``: ``repository_id``, ``folder``, ``path``, ``content``.  In the order of folder and path a file is admitted while the bytes up to its end fit in
    ``max_total``.  Folders are summed up before they are ordered, so a task orders one folder's sizes at a time and never a repository's files.  Null content is
    unavailable; a null repository has the empty name.  Kept files get ``lines``, redacted, and ``digest``."""
    size = F.octet_length("content")
    reason = (
        F.when(F.col("content").isNull(), "unavailable").when(size > max_file, "too_large").when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding")
        .when(F.contains(F.col("content").cast("string"), F.lit("\x00")), "binary")
    )
    judged = files.withColumns({"repository_id": F.coalesce("repository_id", F.lit("")), "_code": reason, "size": size})
    good = judged.filter("_code is null").select("repository_id", "folder", "path", "size")
    earlier = Window.partitionBy("repository_id").orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    starts = good.groupBy("repository_id", "folder").agg(F.sum("size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("repository_id", "folder").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    ends = good.withColumn("_own", F.sum("size").over(inside)).join(starts, ["repository_id", "folder"]).select("repository_id", "folder", "path", (F.col("_start") + F.col("_own")).alias("_end"))
    placed = judged.join(ends, ["repository_id", "folder", "path"], "left").withColumn("_code", F.when(F.col("_code").isNotNull(), F.col("_code")).when(F.col("_end") > max_total, "budget"))
    kept = placed.filter("_code is null").select("repository_id", "folder", "path", "size", F.sha2("content", 256).alias("digest"), F.split(fn.redact(F.col("content").cast("string")), "\n", -1).alias("lines"))
    return kept, placed.filter("_code is not null").groupBy("repository_id", F.col("_code").alias("code")).agg(F.count(F.lit(1)).alias("affected"))


def _reads(expression: str | None) -> list[str] | None:
    """Names and dotted paths whose values are read; null where it does not parse."""
    if expression is None:
        return None
    for form in (expression.strip(), f"_({expression})"):
        try:
            tree = ast.parse(form, mode="eval")
            break
        except (SyntaxError, ValueError, RecursionError):
            continue
    else:
        return None
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    inner = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Attribute) and id(n) not in called}
    found = set()
    for node in ast.walk(tree):
        plain = node
        while isinstance(plain, ast.Attribute):
            plain = plain.value
        if isinstance(node, (ast.Name, ast.Attribute)) and isinstance(plain, ast.Name) and id(node) not in called and id(node) not in inner:
            found.add(ast.unparse(node))
    return sorted(found)


def python_reads(rows: DataFrame, expression: str) -> DataFrame:
    """``rows`` with ``reads``: the sorted names and dotted paths that a Python expression reads.

    The name of a called function is no read, its receiver and arguments are; so are the fields of f-strings.  Null where the text is null or does not parse."""

    @F.pandas_udf("array<string>")
    def reads(texts: pd.Series) -> pd.Series:
        known = {t: _reads(t) for t in texts.unique()}
        return texts.map(known)

    return rows.withColumn("reads", reads(F.col(expression)))
