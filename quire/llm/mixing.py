"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get targets (words) by their weights, none above ``max_times`` its own
size. A source's documents are taken in whole epochs first; the rest of its
target is drawn without replacement: every document has the exponential key
-ln(u) / w (u from a hash of its id, w its quality weight), and documents are
taken in the order of their keys until the prefix sum of their sizes reaches
the rest. The document on the boundary gives the words that are missing.

Only DataFrame functions are used. No source has to fit one task: rows
(id, source, size, key) are range-partitioned by (source, key), sums per range
give each range's offset, and only the one range per source that holds the
boundary is summed up row by row. What is decided is one cut per source
(epochs, boundary key), so texts are never shuffled to apply it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, null_safe_join, shuffle_partitions

ROW = ["__mix_id", "__mix_size", "__mix_key"]


def exponential_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight; u in (0, 1) has 48 bits of the MD5 of seed and id.
    Null weight: 1; a weight of 0 or less: the smallest there is."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(u) / F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(1e-9))


def mix_rows(df: DataFrame, id_col: str, source_col: str, size: Column, weight: Column, seed: int = 42) -> DataFrame:
    """``df`` with the columns that a mix is planned and applied on."""
    return df.withColumns({"__mix_id": F.col(id_col), "__mix_source": F.col(source_col),
                           "__mix_size": F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)),
                           "__mix_key": exponential_key(F.col(id_col), weight, seed)})


def with_sums_before(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each name and column of ``sums``, the sum of the column
    over all rows before in ``order``, which has no ties. Rows are ranged by
    ``order``; a row per range, at most as many as shuffle partitions, passes
    one task, the rows themselves don't."""
    n = shuffle_partitions(df.sparkSession)
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "mix_order")
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *[F.sum(f"__{name}").over(earlier).alias(f"__{name}") for name in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.join(F.broadcast(starts), "__range")
    zero = F.lit(0)
    before = {name: F.coalesce(F.col(f"__{name}"), zero) + F.coalesce(F.sum(c).over(inside), zero) for name, c in sums.items()}
    return both.withColumns(before).drop("__range", *[f"__{name}" for name in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float], max_times: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating, and share
    the sum of all sizes; a target stops at ``max_times`` its source's size
    and the excess is shared again by weight. That is a common level per unit
    of weight: with sources in the order of the level at which they fill up,
    it is the largest of (what is left) / (weight that is left).
    """
    named = with_sums_before(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"place": "one"})
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("weight", weigh).withColumn("cap", F.col("source_size") * max_times).withColumn("full", F.col("cap") / F.col("weight"))
    filled = cut_lineage(with_sums_before(named, [F.col("full"), F.col("place")], {"caps": "cap", "weights": "weight"}), "mix_levels")
    total, weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    level = filled.agg(F.max((F.lit(total or 0) - F.col("caps")) / (F.lit(weight or 1.0) - F.col("weights")))).first()[0]
    return filled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("weight")).alias("target"))


def mix_plan(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), max_times: int = 3) -> DataFrame:
    """One row per source: (source, source_size, target, epochs, rest, cut,
    cut_words); documents with keys below ``cut`` are taken once more, those
    at it for ``cut_words`` words. ``rows`` has the columns of ``mix_rows``."""
    spark = rows.sparkSession
    slim = rows.select("__mix_source", *ROW).withColumnRenamed("__mix_source", "source")
    ranged = slim.repartitionByRange(shuffle_partitions(spark), "source", "__mix_key", "__mix_id").withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "mix_ranges")
    sums = ranged.groupBy("part", "source").agg(F.sum("__mix_size").alias("words"))
    sums = cut_lineage(sums, "mix_sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_times)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn(
        "rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = cut_lineage(targets, "mix_targets")

    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    edge = null_safe_join(offsets, targets.select("source", "rest"), ["source"], "inner")
    edge = edge.where((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    near = null_safe_join(ranged, edge.select("part", "source", "before", "rest"), ["part", "source"], "inner")
    row = F.struct(F.col("__mix_key").alias("key"), F.col("__mix_id").alias("id"), F.col("__mix_size").alias("size"))
    in_order = Window.partitionBy("part", "source").orderBy("row")  # equal rows are peers: they count together
    near = near.select("part", "source", "before", "rest", row.alias("row"))
    near = near.withColumn("upto", F.col("before") + F.sum("row.size").over(in_order)).where(F.col("upto") > F.col("rest"))
    peers = near.groupBy("source", "row").agg(F.max("upto").alias("upto"), F.count(F.lit(1)).alias("peers"), F.max("rest").alias("rest"))
    cuts = peers.groupBy("source").agg(F.min(F.struct("row", "upto", "peers", "rest")).alias("at"))
    missing = F.col("at.rest") - (F.col("at.upto") - F.col("at.peers") * F.col("at.row.size"))
    cuts = cuts.select("source", F.col("at.row").alias("cut"), F.floor(missing / F.col("at.peers")).cast("long").alias("cut_words"))
    return cut_lineage(null_safe_join(targets, cuts, ["source"], "left"), "mix_plan")


def apply_mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``__mix``: struct(source_size, target, taken: words,
    copies: whole copies, where a boundary document counts if at least half of
    it is taken)."""
    named = plan.select(F.col("source").alias("__plan_source"), F.struct(*[c for c in plan.columns if c != "source"]).alias("__plan"))
    both = rows.join(named, rows["__mix_source"].eqNullSafe(named["__plan_source"]), "left").drop("__plan_source")
    p, size = F.col("__plan"), F.col("__mix_size")
    row = F.struct(F.col("__mix_key").alias("key"), F.col("__mix_id").alias("id"), size.alias("size"))
    part = (F.when(p["rest"] <= 0, F.lit(0)).when(p["cut"].isNull(), size).when(row < p["cut"], size)
            .when(row == p["cut"], p["cut_words"]).otherwise(F.lit(0)).cast("long"))
    more = (p["rest"] > 0) & (p["cut"].isNull() | (row < p["cut"]) | ((row == p["cut"]) & (p["cut_words"] * 2 >= size)))
    mix = F.struct(p["source_size"].alias("source_size"), p["target"].alias("target"),
                   (p["epochs"] * size + part).alias("taken"), (p["epochs"] + F.when(more, 1).otherwise(0)).cast("int").alias("copies"))
    return both.withColumn("__mix", mix).drop("__plan")


def quality_weights(labels: DataFrame, *, good: float = 1.0, poor: float = 0.25) -> DataFrame:
    """(doc_id, weight) from quality ratings 0 and 1; the mean of repeated ratings."""
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return rated.groupBy("doc_id").agg((F.lit(poor) + F.lit(good - poor) * F.avg("quality")).alias("weight"))


def mix_sources(df: DataFrame, id_col: str, source_col: str, size: Column, *, ratings: DataFrame | None = None,
                unrated: float = 0.5, weights: Sequence[float] = (5, 2, 1), max_times: int = 3, seed: int = 42) -> DataFrame:
    """(id, source, size, mix) for every row of ``df``; ``ratings`` (doc_id,
    weight) has quality weights of documents, others weigh ``unrated``.

    Null sizes count 0. Rows that share id and size are peers: where the
    boundary falls among them, each gives an equal part. Null ids and null
    sources are values like others. The result depends on ids, sizes and the
    seed alone, not on the partitioning; other columns are not read.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    weight = F.lit(unrated)
    if ratings is not None:
        slim = slim.join(ratings.select(F.col("doc_id").alias("id"), F.col("weight").alias("weight")), "id", "left")
        weight = F.coalesce("weight", F.lit(unrated))
    rows = cut_lineage(mix_rows(slim, "id", "source", F.col("size"), weight, seed), "mix_rows")
    return apply_mix(rows, mix_plan(rows, weights, max_times)).select("id", "source", F.col("__mix_size").alias("size"), F.col("__mix").alias("mix"))


def mixed_copies(df: DataFrame, id_col: str, source_col: str, size: Column, *, ratings: DataFrame | None = None,
                 unrated: float = 0.5, weights: Sequence[float] = (5, 2, 1), max_times: int = 3, seed: int = 42) -> DataFrame:
    """``df``, whole rows, each as often as ``mix_sources`` would take it; a
    document on the boundary counts if at least half of it is taken. The
    columns of ``df`` stay as they are."""
    base = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))  # boxed, so no name can clash
    weight = F.lit(unrated)
    if ratings is not None:
        base = base.join(ratings.select(F.col("doc_id").alias("id"), F.col("weight").alias("weight")), "id", "left")
        weight = F.coalesce("weight", F.lit(unrated))
    rows = mix_rows(base, "id", "source", F.col("size"), weight, seed)
    plan = mix_plan(cut_lineage(rows.select("__mix_source", *ROW), "mix_rows"), weights, max_times)
    taken = apply_mix(rows, plan).where(F.col("__mix.copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("__mix.copies")))).select(*[F.col("row")[c].alias(c) for c in df.columns])
