"""Tables that are written once and read many times, in the folder that all executors share.

They survive lost executors, which kept partitions do not, and two reads of one see the same rows in the same parts.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder in local mode, else one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.split("[")[0] == "local"
        root = tempfile.mkdtemp(prefix="lodestar-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder, for files that ``clear`` deletes with the tables."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, keys: tuple[str, ...], order: tuple[str, ...], path: str | None = None, dealt: bool = False) -> DataFrame:
    """``df`` as a table dealt into ``buckets`` by ``keys``, one sorted file each: a join on the keys does not move it.

    ``dealt``: the rows are dealt like that already, by ``repartition(buckets, *keys)``.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    tidy = (df if dealt else df.repartition(buckets, *keys)).sortWithinPartitions(*order)
    made = _table_name(name)
    tidy.write.format("parquet").option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*order).option("path", path).saveAsTable(made)
    return spark.read.table(made)


#: Tables that the catalog knows by ``bucketed`` and ``open_bucketed``.
_NAMES: list[str] = []


def _table_name(name: str) -> str:
    made = f"lodestar_{name}_{uuid.uuid4().hex}"
    _NAMES.append(made)
    return made


def open_bucketed(spark: SparkSession, path: str, schema: str, name: str, buckets: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """A table that ``bucketed`` has written, also by another session: the catalog is told again how it is dealt."""
    made = _table_name(name)
    spark.sql(f"CREATE TABLE {made} ({schema}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.read.table(made)


def size_of(table: DataFrame) -> tuple[int, int]:
    """``(files, bytes)`` of a table that is read from files."""
    spark = table.sparkSession
    to, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [to(f) for f in table.inputFiles()]
    return len(paths), sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def clear(spark: SparkSession) -> None:
    """Deletes every table of this application; nothing that reads them may be in use."""
    while _NAMES:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop()}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
