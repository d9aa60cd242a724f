"""Reading state: touches to the latest place of each book, the shelf, the progress file (STA-*, SNK-*, SRC-34/35, QRY-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import published

#: Books that the list holds.
MOST_BOOKS = 128
LEAST_PX, MOST_PX = 12, 34
HEADER = "#ereader1"
#: Touches of a book in so much of their order are looked through together.
SPAN = 1 << 20
FIELDS = ("size", "unit", "total", "para", "px")


def latest(touches: DataFrame, seq: str = "seq") -> DataFrame:
    """The last touch of each (name, size); summed up before the shuffle, so one book's touches never meet in a task."""
    rest = [c for c in touches.columns if c not in ("name", "size")]
    best = touches.groupBy("name", "size").agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return best.select("name", "size", *[F.col(f"r.{c}") for c in rest])


def recent(touches: DataFrame, most: int = MOST_BOOKS, seq: str = "seq") -> DataFrame:
    """latest() of the ``most`` books touched last: what a list that moves each touched book to the front would keep."""
    return latest(touches, seq).orderBy(F.desc(seq)).limit(most)


def merged(old: DataFrame, new: DataFrame, most: int = MOST_BOOKS) -> DataFrame:
    """The list after more touches; both have the same columns, with seq."""
    return recent(old.unionByName(new), most)


def percent(unit: Column, total: Column) -> Column:
    """Whole percent read, 100 at most; null if the total isn't known."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(unit * 100 / total)))


def shelf(library: DataFrame, progress: DataFrame) -> DataFrame:
    """library (name, size, ...) with unit, total and percent of the books that have a place."""
    return library.join(progress, ["name", "size"], "left").withColumn("percent", percent(F.col("unit"), F.col("total")))


def size_text(size: Column) -> Column:
    """KB below a megabyte, else M with one decimal after a comma."""
    tenths = F.floor(size * 10 / 1048576)
    mega = F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(size < 1048576, F.concat(F.floor(size / 1024).cast("string"), F.lit(" KB"))).otherwise(mega)


def resume_points(books: DataFrame, progress: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (name, size, px, unit, para): the stored place, else the first of eight units that has screens; px if it is a legal one."""
    first = units.where("unit < 8 and n_screens > 0").groupBy("name", "size").agg(F.min("unit").alias("first_unit"))
    rows = books.join(progress, ["name", "size"], "left").join(first, ["name", "size"], "left")
    legal = F.when(F.col("px").between(LEAST_PX, MOST_PX), F.col("px")).otherwise(F.lit(18))
    return rows.select("name", "size", legal.alias("px"), F.coalesce("unit", "first_unit", F.lit(0)).alias("unit"), F.coalesce("para", F.lit(0)).alias("para"))


def file_lines(progress: DataFrame, theme: int = 0) -> DataFrame:
    """The progress file, a line a row (place, value): header, theme, then books, the last touched first. Names come last, so they may hold tabs."""
    spark = progress.sparkSession
    rank = F.row_number().over(Window.orderBy(F.desc("seq"))) + 1  # MOST_BOOKS rows at most
    books = progress.select(rank.alias("place"), F.concat_ws("\t", F.lit("b"), *FIELDS, "name").alias("value"))
    head = spark.createDataFrame([(0, HEADER), (1, f"theme\t{theme}")], "place int, value string")
    return head.union(books)


def save(progress: DataFrame, path: str, theme: int = 0) -> None:
    """The progress file at ``path``, a single file; a reader sees the old one or the new one, and a write that fails leaves the old one (SNK-02)."""
    published(file_lines(progress, theme), path)


def parsed(lines: DataFrame) -> DataFrame:
    """Books (name, size, unit, total, para, px, place) of progress lines (value, place); whatever isn't one is passed over.

    A field without digits counts 0, negative ones too but for size; names have 1 to 127 bytes.
    """
    parts = F.split("value", "\t", 7)
    number = lambda i: F.coalesce(F.regexp_extract(F.get(parts, F.lit(i)), "^ *(-?[0-9]{1,18})", 1).try_cast("long"), F.lit(0)).cast("long")
    rows = lines.where(F.startswith("value", F.lit("b\t")) & (F.size(parts) == 7))
    floor = lambda c: F.greatest(c, F.lit(0))
    rows = rows.select(
        F.get(parts, F.lit(6)).alias("name"), number(1).alias("size"), floor(number(2)).alias("unit"), floor(number(3)).alias("total"),
        floor(number(4)).alias("para"), number(5).alias("px"), "place",
    )
    return rows.where(F.octet_length("name").between(1, 127))


def theme_of(lines: DataFrame, place: str = "place") -> int:
    """The number of the last theme line of progress lines (value, place), 0 without one."""
    found = lines.where(F.col("value").rlike("(?s)^theme\t.")).agg(F.max_by("value", place).alias("value"))
    number = F.coalesce(F.regexp_extract("value", "^theme\t *(-?[0-9]{1,9})", 1).try_cast("int"), F.lit(0))
    return found.select(number).first()[0]


def saves(touches: DataFrame, seq: str = "seq", span: int = SPAN) -> DataFrame:
    """The touches after which the list is saved: a book's first, and those that move it to another unit; not those within a unit (STA-02, STA-08).

    Touches of a book are in order of ``seq``, an integer. Blocks of ``span`` of it are looked through by themselves, a book's blocks then joined by what each
    leaves: so a book that has most touches is spread over tasks. Rows without name, size, unit or seq are passed over; of touches at one seq the smaller unit comes first.
    """
    rows = touches.where(" and ".join(f"`{c}` is not null" for c in ("name", "size", "unit", seq)))
    rows = rows.withColumn("_block", F.floor(F.col(seq) / span))
    inside = Window.partitionBy("name", "size", "_block").orderBy(seq, "unit")
    left = rows.groupBy("name", "size", "_block").agg(F.max_by("unit", F.struct(seq, "unit")).alias("_left"))
    left = left.select("name", "size", "_block", F.lag("_left").over(Window.partitionBy("name", "size").orderBy("_block")).alias("_left"))
    before = F.lag("unit").over(inside)
    seen = rows.withColumns({"_before": before, "_first": F.row_number().over(inside) == 1})
    moved = seen.where(F.col("_first") | (F.col("_before") != F.col("unit"))).join(left, ["name", "size", "_block"])
    moved = moved.where(~F.col("_first") | F.col("_left").isNull() | (F.col("_left") != F.col("unit")))
    return moved.select(*touches.columns)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The books of a saved file; seq falls with their place, so that the first is the last touched."""
    rows = parsed(spark.read.text(path).withColumn("place", F.monotonically_increasing_id()))
    return rows.withColumn("seq", -F.col("place")).drop("place")
