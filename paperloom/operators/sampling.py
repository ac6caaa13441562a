"""Samples, splits and numbering of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.common import checkpoint


def hash_order(*cols: str, salt: str = "") -> Column:
    """A fixed shuffling order: the MD5 of the key, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in cols]))


def global_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """0-based place of each row in a total order, without gathering rows in one task.

    Rows are ranged by the order and numbered within their range; only the
    sizes of the ranges (one number per partition) reach the driver.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", low))
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, offset))
        offset += sizes[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    table = F.create_map(*[F.lit(x) for kv in starts for x in kv])
    return ranged.withColumn(name, (F.col("_i") + table[F.col("_p")]).cast("bigint")).drop("_p", "_i")


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The quantile of a number column between its two neighbours in order, nulls aside; None without a value.

    Equal values are counted first, then ranged and added up, so no task sees
    them all; one or two values reach the driver.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = df.sparkSession.sparkContext.defaultParallelism
    ranged = checkpoint(counts.repartitionByRange(n, "v").sortWithinPartitions("v").withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return None
    at = q * (total - 1)

    def value(k: int) -> float:
        before = 0
        for p in sorted(sizes):
            if before + sizes[p] > k:
                inside = F.sum("n").over(Window.partitionBy("_p").orderBy("v"))
                return ranged.filter(F.col("_p") == p).withColumn("_s", inside).filter(F.col("_s") > k - before).agg(F.min("v")).first()[0]
            before += sizes[p]

    low, high = value(int(at)), value(min(int(at) + 1, total - 1))
    return low + (high - low) * (at - int(at))


def chunks(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds idx, chunk = idx // size and place = idx % size."""
    i = global_index(df, *order)
    return i.withColumn("chunk", F.floor(F.col("idx") / size)).withColumn("place", F.col("idx") % size)


def systematic(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """Every (n // limit)-th row of the order, `limit` at most."""
    i = global_index(df, *order)
    step = max(1, i.count() // limit)
    return i.filter((F.col("idx") % step == 0) & (F.col("idx") < step * limit)).drop("idx")


def round_robin(df: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """First the first row of every group, then the second, until `limit`.

    At most `limit` rows of a group can matter; the rest are dropped before
    the shuffle, so a group with a third of the rows is no burden.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("depth", F.row_number().over(w)).filter(F.col("depth") <= limit).orderBy("depth", group).limit(limit)


def split_students(students: DataFrame, shares: tuple[float, float] = (0.70, 0.15), salt: str = "split") -> DataFrame:
    """(student, split): whole students in hash order, half-even rounded shares of train and val, the rest test."""
    i = global_index(students.select("student").distinct().withColumn("_h", hash_order("student", salt=salt)), "_h", "student")
    n = i.count()
    train, val = round(n * shares[0]), round(n * shares[1])
    split = F.when(F.col("idx") < train, "train").when(F.col("idx") < train + val, "val").otherwise("test")
    return i.select("student", split.alias("split"))


def choose_pages(pages: DataFrame, size: int, covers: int = 15) -> DataFrame:
    """Up to `covers` cover pages, one per student, in hash order, then content pages by round robin, `size` in all."""
    h = pages.withColumn("_h", hash_order("page_id", salt="pages"))
    one = Window.partitionBy("student").orderBy("_h")
    cover = h.filter("page = 1").withColumn("_k", F.row_number().over(one)).filter("_k = 1").orderBy("_h").limit(covers).drop("_k", "_h").withColumn("page_kind", F.lit("cover"))
    n = cover.count()
    content = round_robin(h.filter("page <> 1"), "student", ["_h"], max(0, size - n)).drop("_h", "depth").withColumn("page_kind", F.lit("content"))
    return cover.unionByName(content)
