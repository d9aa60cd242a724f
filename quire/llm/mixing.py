"""Mixing sources to target weights.

Every document gets a random key (a hash of its id). Within its source the keys
are cut into about sqrt(documents) equal ranges; word counts are summed by range,
the sums of the ranges before give each range its offset, and a running sum
inside the range finishes each document's place. So no task ever holds a whole
source, however large, and the order needs no sampled bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, words, written

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: The most epochs of a source that a mix may hold.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets in words for rows (source, source_size, n_docs), one for each source.

    The total is shared by weight. A source whose share exceeds most_epochs times its
    size stops there and the rest is shared again, until none is above. In order of
    size over weight the sources that stop come first, so one pass of running sums
    finds the level at which the others meet their weights.
    """
    everywhere = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1)
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = ranked.select(
        "*",
        F.element_at(table, F.col("rank") % len(weights) + 1).alias("weight"),
        (F.col("source_size") * most_epochs).alias("stop"),
    )
    ranked = ranked.withColumn("ratio", F.col("stop") / F.col("weight"))
    before = everywhere.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = ranked.withColumn("level", level)
    met = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everywhere)
    ranked = ranked.withColumn("met", met)
    target = F.when(
        F.struct("ratio", "rank") < F.struct(F.col("met.ratio").alias("ratio"), F.col("met.rank").alias("rank")),
        F.col("stop").cast("double"),
    ).otherwise(F.col("met.level") * F.col("weight"))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """``docs`` with columns mix_size, mix_source_size, mix_target and mix_taken (words, repeats counted).

    A source gives the whole part of its target: full epochs first, then documents
    in the order of their keys up to the exact budget; the document at the cut gives
    its first words only. Null text counts 0 words, a null source is a source of its
    own and the last. Rows that repeat a doc_id are separate documents with equal
    keys; among them the smaller goes first. Of a null doc_id the key is that of the empty string.
    Other columns are carried along; an empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.withColumns({"mix_size": word_count(F.col("text")), "mix_key": key})
    light = written(sized.select("doc_id", "source", "mix_size", "mix_key", F.xxhash64("text").alias("mix_text")), "sizes")
    sizes = light.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = written(source_targets(sizes, weights, most_epochs), "targets")
    part = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / 4294967296.0
    placed = light.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select(
        "l.*", "t.source_size", "t.target", F.floor(part * F.ceil(F.sqrt("t.n_docs"))).alias("mix_range")
    )
    sums = placed.groupBy("source", "mix_range").agg(F.sum("mix_size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("mix_range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    inside = (
        Window.partitionBy("source", "mix_range")
        .orderBy("mix_key", "doc_id", "mix_size", "mix_text")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ran = placed.withColumn("run", F.sum("mix_size").over(inside))
    ran = ran.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("mix_range") == F.col("r")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - (F.col("offset") + F.col("run") - F.col("mix_size"))
    taken = epochs * F.col("mix_size") + F.greatest(F.lit(0), F.least(F.col("mix_size"), rest))
    return ran.select(
        "doc_id",
        "source",
        "mix_text",
        "mix_size",
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        taken.cast("long").alias("mix_taken"),
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a row for each epoch that takes a document.

    The one document of a source that the budget cuts holds its first words, joined
    by spaces, and its n_chars if there is that column. Documents of no words are
    taken neither by sizes nor by budgets and stay once. Rows that repeat a doc_id
    with the same text share one decision each.
    """
    taken = mix(docs, weights, most_epochs, seed)
    same_rows = Window.partitionBy("doc_id", "source", "mix_text")
    taken = taken.withColumn("nth", F.row_number().over(same_rows.orderBy("mix_taken")))
    taken = taken.select(*[F.col(c).alias(f"t_{c}") for c in ("doc_id", "source", "mix_text", "nth", "mix_size", "mix_taken")])
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64("text").alias("mix_text"))
    rows = rows.withColumn("nth", F.row_number().over(same_rows.orderBy(F.lit(0))))
    same = (
        F.col("doc_id").eqNullSafe(F.col("t_doc_id"))
        & F.col("source").eqNullSafe(F.col("t_source"))
        & (F.col("mix_text") == F.col("t_mix_text"))
        & (F.col("nth") == F.col("t_nth"))
    )
    joined = rows.join(taken, same)
    size, got = F.col("t_mix_size"), F.col("t_mix_taken")
    pieces = F.when(size == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(got / size)), lambda i: F.least(size, got - (i - 1) * size))
    )
    joined = joined.where((size == 0) | (got > 0)).withColumn("piece", F.explode(pieces))
    cut = F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("piece").cast("int")), " ")
    is_cut = F.col("piece") < size
    new = {
        "text": F.when(is_cut, cut).otherwise(F.col("row.text")),
        "n_chars": F.when(is_cut, F.length(cut).cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None,
    }
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS rk
      FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS stop FROM s),
r AS (SELECT *, CAST(stop AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(stop) OVER b, 0) AS DOUBLE)
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS lev
      FROM r WINDOW b AS (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT ratio AS mr, rk AS mk, lev AS ml FROM l WHERE lev <= ratio ORDER BY ratio, rk LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio < mr OR (ratio = mr AND rk < mk) THEN CAST(stop AS DOUBLE) ELSE ml * weight END AS target
      FROM l, m),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS e,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS prev
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(e * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e * source_size - prev)) AS BIGINT) AS taken
FROM c
"""
