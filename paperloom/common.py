"""Helpers shared by operators: table access, key spelling, latest readings, checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_key(c: Column) -> Column:
    """Keys are equal whatever their letter case and outer blanks."""
    return F.lower(blank_trim(c))


def norm_path(c: Column) -> Column:
    """Paths are equal whatever their case, outer blanks, leading ./ or slash direction."""
    return F.regexp_replace(F.translate(norm_key(c), "\\", "/"), r"^(\./+)+", "")


def latest_lines(lines: DataFrame, *cols: str) -> DataFrame:
    """One row per line_uid, the one with the latest generated_at.

    Null line_uids name no line and are left out. The maximum of a struct is
    combined before the shuffle, so a uid repeated in a third of the rows
    reaches the reducer as one row per map task. Ties are identical copies.
    """
    kept = [c for c in dict.fromkeys(["loaded_at", *cols]) if c != "line_uid"]
    best = F.max(F.struct(F.col("generated_at"), *[F.col(c) for c in kept]))
    return (
        lines.filter(F.col("line_uid").isNotNull())
        .groupBy(norm_key(F.col("line_uid")).alias("line_uid"))
        .agg(best.alias("_best"))
        .select("line_uid", "_best.*")
    )


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan has fewer files than cores (a few small files)."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. A temporary one only in a local session; a cluster without the setting is an error."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = sc.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def vocab_path(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; the folder is a parameter or an environment setting."""
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)
