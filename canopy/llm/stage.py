"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch.
ROWS, BYTES = 1_000, 4 << 20


def quoted(name: str):
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that isn't a column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held(docs: DataFrame, without: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """``row`` (all columns of ``docs`` but ``without``, as one struct) and the named columns, so that no input name meets a working name."""
    others = [quoted(c).alias(c) for c in docs.columns if c not in without]
    return docs.select(F.struct(*(others or [F.lit(None).alias("none")])).alias("row"), *(c.alias(n) for n, c in columns.items()))


def released(df: DataFrame, columns: list[str], **given: Column) -> DataFrame:
    """The columns of ``row`` in the order of ``columns``; those ``given`` take the place of an input column of the same name or follow."""
    own = [given[c].alias(c) if c in given else F.col("row").getField(c).alias(c) for c in columns]
    return df.select(*own, *(c.alias(n) for n, c in given.items() if n not in columns))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def long_rows(spark: SparkSession) -> SparkSession:
    """Arrow batches for rows that hold whole texts: few rows and a few MB each, so that workers stay small.

    Plans are lazy, so the limits stay set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    return spark


_made: list[str] = []
_tables: list[str] = []


def made(path: str) -> str:
    """Note a folder of this process in the shared folder for :func:`clean`."""
    _made.append(path)
    return path


def mark() -> tuple[int, int]:
    """How much has been written so far, for :func:`clean`."""
    return len(_tables), len(_made)


def clean(spark: SparkSession, since: tuple[int, int] = (0, 0), last: bool = True) -> None:
    """Delete the tables and folders that this process has written (since a :func:`mark`), but for the last folder unless ``last``, once no other result that reads them is wanted."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = _made[-1:] if not last else []
    tables, _tables[since[0] :] = _tables[since[0] :], []
    folders, _made[since[1] :] = _made[since[1] :], kept
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for folder in folders:
        if folder not in kept:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def bucketed(df: DataFrame, key: str, name: str, spark: SparkSession, ordered: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key`` into as many parts as a shuffle has; ``ordered``: each file by ``key`` as well."""
    name = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(parts, key)
    (writer.sortBy(key) if ordered else writer).option("path", made(f"{shared_dir(spark)}/{name}")).format("parquet").saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def written(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = spark or df.sparkSession
    path = made(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
