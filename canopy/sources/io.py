"""Sources and sinks."""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from canopy.functions.tiles import base_name, domain_from_name, geo_index_from_name, nan_to_null, site_from_name, year_from_name, year_from_path


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A name that nothing has yet in the shared folder."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean_staged(spark: SparkSession) -> None:
    """Delete the folders that this process has made, once no result that reads them is wanted any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))


def _first_line(spark: SparkSession, path) -> str | None:
    """The first line of a text file, compressed or not; None if it has none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")).readLine()
    finally:
        stream.close()


def csv_headers(spark: SparkSession, path: str | list[str], pattern: str = "*", named: str = "") -> dict[tuple[str, ...], list[str]]:
    """Files by their header's names; of files whose base name contains ``named``. One line a file is read, as Spark itself would on inferring a schema."""
    found: dict[tuple[str, ...], list[str]] = {}
    for uri in sorted(spark.read.option("pathGlobFilter", pattern).text(path).inputFiles()):
        file = _hadoop_path(spark, uri)
        line = _first_line(spark, file) if named in file.getName().rpartition(".")[0] else None
        if line is not None:
            header = tuple(next(csv.reader([line.lstrip("\ufeff")])))
            if len(set(header)) < len(header):
                raise ValueError(f"{uri} has two columns of one name: {list(header)}")
            found.setdefault(header, []).append(file.toString())
    return found


def _csv(spark: SparkSession, schema: StructType | None):
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("nullValue", "")
    return reader.schema(schema).option("enforceSchema", False) if schema else reader.option("inferSchema", True)


def _common_type(a, b):
    """The type that holds values of both: the wider number, else text."""
    order = [IntegerType(), LongType(), DoubleType()]
    return a if a == b else order[max(order.index(a), order.index(b))] if a in order and b in order else StringType()


def _by_name(spark: SparkSession, headers: dict[tuple[str, ...], list[str]], schema: StructType | None, missing: str, more: dict[str, Column]) -> DataFrame:
    """One table of files with unlike headers: columns by name, in the order of ``schema`` (else of their first appearance, with inferred types)."""
    if schema is None:
        kinds: dict = {}
        for header, files in headers.items():
            for name, field in zip(header, _csv(spark, None).csv(files).schema, strict=True):
                kinds[name] = _common_type(kinds.get(name, field.dataType), field.dataType)
        schema = StructType([StructField(n, k) for n, k in kinds.items()])
    wanted = {f.name: f.dataType for f in schema}
    tables = []
    for header, files in headers.items():
        lacking = [n for n in wanted if n not in header]
        if lacking and missing != "null":
            raise ValueError(f"no column {lacking} in {files[0]}, whose header is {list(header)}")
        own = _csv(spark, StructType([StructField(n, wanted.get(n, StringType())) for n in header])).csv(files)
        tables.append(own.select(*[F.lit(None).cast(k).alias(n) if n in lacking else F.col("`" + n.replace("`", "``") + "`") for n, k in wanted.items()], *[c.alias(n) for n, c in more.items()]))
    if not tables:
        return spark.createDataFrame([], StructType([*schema, *[StructField(n, StringType()) for n in more]]))
    df = reduce(DataFrame.unionByName, tables)
    return df.withColumns({n: nan_to_null(n) for n, k in wanted.items() if isinstance(k, (DoubleType, FloatType))})


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | None = None, *, missing: str = "error") -> DataFrame:
    """CSV files with headers; NaN becomes null. Columns are taken by the names in each file's own header.

    Without ``schema`` types are inferred over all files (numbers of unlike width take the wider type, other
    unlike types text). A column that a file lacks is an error, or null with ``missing`` "null"; columns that
    ``schema`` doesn't name are left out.
    """
    return _by_name(spark, csv_headers(spark, path), schema, missing, {})


def with_sequence(df: DataFrame, name: str = "seq") -> DataFrame:
    """File order as numbers that grow along each file; write the table before using it more than once."""
    return df.withColumn(name, F.monotonically_increasing_id())


def read_layer(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A layer of points, boxes or rings as a coordinate-column table."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_layers(spark: SparkSession, directory: str, site: str | None = None, suffix: str = ".csv", schema: StructType | None = None) -> DataFrame:
    """S3: all layers of a directory whose name contains ``site``, with their base name as ``filename``.

    Layers may have unlike columns in any order: they meet by name, and what a layer lacks is null.
    """
    name = base_name(F.col("_metadata.file_name"))
    if suffix == ".csv":
        return _by_name(spark, csv_headers(spark, directory, f"*{suffix}", site or ""), schema, "null", {"filename": name})
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    df = reader.option("pathGlobFilter", f"*{suffix}").parquet(directory).withColumn("filename", name)
    return df.filter(F.col("filename").contains(site)) if site else df


def file_catalog(spark: SparkSession, pool: str, pattern: str = "*", without=("point_cloud", "products", "neon-aop-products", "classified")) -> DataFrame:
    """Paths under a folder, at any depth, with what their names say; contents aren't read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(pool).select("path")
    for text in without:
        paths = paths.filter(~F.col("path").contains(text))
    return catalog_of(paths)


def catalog_of(paths: DataFrame, path: str = "path") -> DataFrame:
    """Catalog columns of a table of paths."""
    return paths.withColumns({"geo_index": geo_index_from_name(path), "site": site_from_name(path), "domain": domain_from_name(path), "tile_year": F.coalesce(year_from_path(path), year_from_name(path))})


def read_confusion_json(spark: SparkSession, path: str) -> DataFrame:
    """Labels and matrix rows of a JSON confusion matrix as (taxon, p), each row over its sum."""
    from canopy.functions.arrays import normalise_row

    kind = "labels ARRAY<STRING>, matrix ARRAY<ARRAY<DOUBLE>>"
    raw = spark.read.schema(kind).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("matrix").alias("i", "p"), "labels")
    return rows.select(F.get("labels", F.col("i")).alias("taxon"), normalise_row("p").alias("p"))


def read_confusion_csv(spark: SparkSession, path: str, key: str = "predicted") -> tuple[DataFrame, list[str]]:
    """(taxon, p) and the labels that p is over, from a CSV with a column per label."""
    raw = spark.read.option("header", True).csv(path)
    labels = [c for c in raw.columns if c != key and not c.startswith("_c")]
    return raw.select(F.col(key).alias("taxon"), F.array(*[F.col(f"`{c}`").cast("double") for c in labels]).alias("p")), labels


def read_cells(spark: SparkSession, path: str, *, geo_index: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """Raster cells, pruned by partition."""
    df = spark.read.parquet(path)
    if geo_index is not None:
        df = df.filter(F.col("geo_index").isin(geo_index))
    return df.filter(F.col("tile_year").isin(years)) if years is not None else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, nulls empty."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_named(df: DataFrame, folder: str, name: str) -> None:
    """A small table as one CSV file of a given name in a folder (through the file system that Spark uses for it)."""
    spark = df.sparkSession
    part = new_folder(spark, "part")
    write_csv(df.coalesce(1), part)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    found = next(f.getPath() for f in fs.listStatus(path(part)) if f.getPath().getName().startswith("part-"))
    fs.delete(path(f"{folder}/{name}"), False)
    if not fs.rename(found, path(f"{folder}/{name}")):
        raise OSError(f"can't write {folder}/{name}")
    fs.delete(path(part), True)


def write_layer(df: DataFrame, path: str, by: str = "geo_index") -> None:
    """One folder per tile or plot; rows of a tile are brought together first, so files stay few.

    A tile that ``df`` has rows of is replaced as a whole; all other tiles stay.
    """
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


#: Folders that the crops of a year are dealt to by name; a crop that is replaced has its folder rewritten.
CROP_FOLDERS = 64


def write_crops(df: DataFrame, path: str, *, individual: str = "individual", year: str = "tile_year", replace: bool = True) -> None:
    """Crops named {individual}_{year}; those of the same name are replaced, or left with ``replace`` off. All others stay.

    Only folders (year and a hash of the name) that the new crops fall into are written anew: what they hold of
    other names is set aside first and goes back with them. One writer at a time, as with any overwrite.
    """
    spark = df.sparkSession
    named = df.withColumn("name", F.concat_ws("_", individual, F.col(year).cast("string")))
    named = named.withColumn("folder", F.pmod(F.xxhash64("name"), F.lit(CROP_FOLDERS)).cast("int"))
    if not replace:
        unfinished(named, path, ["name"]).repartition(year, "folder").write.mode("append").partitionBy(year, "folder").parquet(path)
        return
    named = staged(named, "crops")
    try:
        old = spark.read.option("mergeSchema", True).parquet(path)
        old = old.withColumn(year, F.col(year).cast(named.schema[year].dataType))
        touched = named.select(F.col(year).alias("__year"), F.col("folder").alias("__folder")).distinct()
        same = F.col(year).eqNullSafe(F.col("__year")) & (F.col("folder") == F.col("__folder"))
        kept = staged(old.join(touched, same, "left_semi").join(named.select("name").distinct(), "name", "left_anti"), "crops-kept")
        named = named.unionByName(kept, allowMissingColumns=True)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    named.repartition(year, "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year, "folder").parquet(path)


def unfinished(work: DataFrame, done: str | DataFrame, keys: list[str]) -> DataFrame:
    """The part of a work list whose keys aren't in a table of finished ones (a path that doesn't exist has none)."""
    if isinstance(done, str):
        try:
            done = work.sparkSession.read.parquet(done)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return work
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def snapshot(spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A saved table, or the built one saved under its name."""
    path = f"{root.rstrip('/')}/snapshot={name}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def reapply_split(df: DataFrame, train_ids: DataFrame, test_ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New rows by a saved split."""
    return df.join(train_ids.select(key).distinct(), key, "left_semi"), df.join(test_ids.select(key).distinct(), key, "left_semi")
