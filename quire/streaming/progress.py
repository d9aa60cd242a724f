"""Progress from a stream of touches: each micro-batch is merged into the list of books, or only what changes a book's unit is saved."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tables import exists
from ..operators.progress import MOST_BOOKS, load, merged, recent, save, theme_of

PLACE = "unit long, total long, para long, px long, seq long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(touches: DataFrame, path: str, checkpoint: str, most: int = MOST_BOOKS, **trigger):
    """Starts a query that keeps the latest touches (name, size, unit, total, para, px, seq) of the books touched last.

    Batch n writes version n below ``path`` from version n - 1, so a batch that is run again after a failure gives the same version.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = version(spark, path, n - 1, batch)
        merged(old, batch, most).write.mode("overwrite").parquet(f"{path}/version={n}")

    return touches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def version(spark: SparkSession, path: str, n: int, like: DataFrame) -> DataFrame:
    """The list as batch n left it; before the first there is none."""
    if n < 0:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(f"{path}/version={n}")


class Place(StatefulProcessor):
    """A book's latest touch and the unit it was saved at; a row leaves when these units differ. Of a micro-batch only the latest touch is held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", f"{PLACE}, saved long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.place.get() if self.place.exists() else None
        latest, saved = (tuple(known[:5]), known[5]) if known else (None, None)
        for some in rows:
            if len(some):
                last = some.sort_values(["seq", "unit"], kind="stable").iloc[-1]
                found = tuple(int(last[c]) for c in ("unit", "total", "para", "px", "seq"))
                if latest is None or (found[4], found[0]) > (latest[4], latest[0]):
                    latest = found
        if latest is not None:
            self.place.update((*latest, latest[0]))
            if latest[0] != saved:
                yield pd.DataFrame([(*key, *latest)], columns=["name", "size", "unit", "total", "para", "px", "seq"])

    def close(self) -> None:
        pass


def moved(touches: DataFrame) -> DataFrame:
    """Of a stream of touches (name, size, unit, total, para, px, seq) the latest of each book that a micro-batch leaves in another unit than it was saved at.

    The state, a row a book, is kept by Spark. Touches older than a book's latest don't move it back; those without name, size, unit or seq
    are passed over, and other nulls count 0. Other columns are not read.
    """
    rows = touches.select("name", "size", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) if c in ("total", "para", "px") else c for c in ("unit", "total", "para", "px", "seq")])
    rows = rows.where("name is not null and size is not null and unit is not null and seq is not null")
    return rows.groupBy("name", "size").transformWithStateInPandas(Place(), f"name string, size long, {PLACE}", "Update", "None")


def keep(touches: DataFrame, path: str, checkpoint: str, most: int = MOST_BOOKS, **trigger):
    """Starts a query that keeps the progress file ``path`` after a stream of touches; it is written only after batches in which a book's unit changes.

    Books that move come first, the last touched before the others; the theme stays. The list is at most ``most`` books, and a batch that
    is run again after a failure leaves the same file.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("seq", F.struct(F.lit(1).alias("turn"), F.col("seq").alias("at")))
        if batch.isEmpty():
            return
        theme = 0
        if exists(spark, path):
            old = load(spark, path).withColumn("seq", F.struct(F.lit(0).alias("turn"), F.col("seq").alias("at")))
            theme = theme_of(spark.read.text(path).withColumn("place", F.monotonically_increasing_id()))
            batch = old.unionByName(batch)
        save(recent(batch, most), path, theme)

    conf = touches.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)  # the query copies the session as it starts
    try:
        return moved(touches).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
