"""Tables written on the way, which cut a lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.operators.findings import first_of

# The characters that a partition's folder name writes as %XX.
_ESCAPED = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """Tables in one folder, each partitioned by ``project_id``; what a project has is replaced or merged without touching other projects."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, name: str, project_id: str | None = None) -> DataFrame | None:
        """The table, or one project's rows of it; None where nothing was ever stored.  Projects are texts: ``02`` stays ``02``."""
        if not _exists(self.spark, f"{self.root}/{name}"):
            return None
        path = f"{self.root}/{name}"
        inferred = self.spark.read.parquet(path).schema
        typed = StructType([StructField(f.name, StringType()) if f.name == "project_id" else f for f in inferred])
        rows = self.spark.read.schema(typed).parquet(path)
        return rows if project_id is None else rows.filter(F.col("project_id") == project_id)

    def put(self, name: str, rows: DataFrame) -> None:
        """The projects in ``rows`` have these rows and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{self.root}/{name}")

    def upsert(self, name: str, rows: DataFrame, keys: list[str], version: str) -> None:
        """The row of the highest ``version`` of each key stays; only the projects in ``rows`` are read and written again.

        The merged rows are written beside the table first, since a table can't be read while it is replaced."""
        old = self.load(name)
        if old is not None:
            touched = rows.select(F.col("project_id").cast("string")).distinct()
            rows = rows.unionByName(old.join(touched, "project_id", "left_semi").select(*rows.columns))
        self.put(name, written(first_of(rows, ["project_id", *keys], [F.desc(version)]), f"upsert-{name}"))

    def clear(self, name: str, project_id: str) -> None:
        """Forget what a project has in a table; the folder of its partition goes."""
        folder = re.sub(_ESCAPED, lambda c: f"%{ord(c[0]):02X}", project_id)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/project_id={folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _exists(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
