"""Tables written between the steps of a job."""

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, spark.checkpoint.dir.

    Where it is unset, a session of one machine (tests) gets a folder of its own; on a cluster that would lose rows, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="quire-"))
        folder = _own_folder[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table at a fresh path."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that written() returned, once nothing reads it any more; other tables are left alone."""
    path = _paths.pop(table, None)
    if path is not None:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def published(lines: DataFrame, path: str) -> None:
    """``lines`` (place, value), few enough for one file, as the text file ``path``.

    A task writes them aside in the same folder; if the file has the length that the lines have, it is renamed over ``path`` in one step of the file system, else
    it goes and ``path`` stays as it was. Folders at ``path`` are an error.
    """
    spark = lines.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    folder, _, name = path.rstrip("/").rpartition("/")
    aside = hadoop.Path(f"{folder}/_new-{name}-{uuid.uuid4().hex}")
    files = aside.getFileSystem(conf)
    seen = Observation()
    try:
        ordered = lines.coalesce(1).sortWithinPartitions("place").observe(seen, F.sum(F.octet_length("value") + 1).alias("bytes"))
        ordered.select("value").write.text(aside.toString())
        parts = [f for f in files.listStatus(aside) if f.getPath().getName().startswith("part-")]
        length = sum(f.getLen() for f in parts)
        if len(parts) != 1 or length != seen.get["bytes"]:
            raise OSError(f"{path} was written with {length} of {seen.get['bytes']} bytes")
        over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.valueOf("OVERWRITE")
        hadoop.FileContext.getFileContext(aside.toUri(), conf).rename(parts[0].getPath(), hadoop.Path(path), over)
    finally:
        files.delete(aside, True)
