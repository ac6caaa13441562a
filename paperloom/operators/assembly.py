"""Recognised lines: identity, order, page text, transcripts, confidence, run contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.functions.identity import CORPUS_PATH, line_uid, page_id, path_part

NUMBERS = ("student", "cie", "page", "block_id", "line_id")


def identity_from_crop(df: DataFrame, crop: str = "crop") -> DataFrame:
    """Adds the numbers in a crop path and the uid they make up; all null where the path has another form.

    Numbers are taken by pattern, so three-digit students are read as well.
    """
    df = df.withColumns({f"crop_{n}": path_part(F.col(crop), CORPUS_PATH, i + 1) for i, n in enumerate(NUMBERS)})
    return df.withColumn("crop_uid", line_uid(page_id(F.col("crop_student"), F.col("crop_cie"), F.col("crop_page")), F.col("crop_block_id"), F.col("crop_line_id")))


def split_identity(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose crop names their own line, rejects with a reason)."""
    known = identity_from_crop(df)
    why = F.when(F.col("crop").isNull(), "no crop").when(F.col("crop_uid").isNull(), "unreadable path").when(F.col("crop_uid") != F.col("line_uid"), "other line")
    known = known.withColumn("reject_reason", why)
    return known.filter(F.col("reject_reason").isNull()), known.filter(F.col("reject_reason").isNotNull())


def dense_order(lines: DataFrame) -> DataFrame:
    """Renumbers reading_order 0..n-1 per page over the lines that are present; ties by uid."""
    w = Window.partitionBy("page_id").orderBy("reading_order", "line_uid")
    return lines.withColumn("reading_order", (F.row_number().over(w) - 1).cast("int"))


def text_status(text: Column) -> Column:
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").otherwise("ok")


def page_text(lines: DataFrame, sep: str = "\n") -> DataFrame:
    """(page_id, text): ok lines in reading order."""
    said = lines.filter((F.col("status") == "ok") & F.col("page_id").isNotNull() & F.col("text").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "line_uid", "text")))
    return said.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), sep).alias("text"))


def transcripts(lines: DataFrame) -> DataFrame:
    """(student, cie, page, text): the pages of each booklet, each under a banner.

    A booklet stays so many rows; written by booklet and sorted by page they
    are its transcript, without a row or task that holds all of it.
    """
    said = lines.filter((F.col("status") == "ok") & F.col("text").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "line_uid", "text")))
    banner = F.concat(F.lit("== page "), F.col("page").cast("string"), F.lit(" ==\n"))
    per_page = said.groupBy("student", "cie", "page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("t"))
    return per_page.select("student", "cie", "page", F.coalesce(F.concat(banner, "t"), F.col("t")).alias("text"))


def sequence_confidence(log_probs: Column, mask: Column) -> Column:
    """exp of the mean log probability over the real tokens, within 0 to 1, three decimals; 0 without any."""
    kept = F.filter(F.arrays_zip(log_probs.alias("p"), mask.alias("m")), lambda x: x["m"])
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x["p"])
    mean = total / F.nullif(F.size(kept), F.lit(0))
    return F.when(F.size(kept) > 0, F.bround(F.greatest(F.least(F.exp(mean), F.lit(1.0)), F.lit(0.0)), 3)).otherwise(F.lit(0.0))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of a collected array; null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def line_violations(lines: DataFrame) -> DataFrame:
    """(rule, key, detail) of the rules a run's lines must obey; empty for a valid run.

    status in the enumeration, confidence present and within 0 to 1, unique
    line_uid, reading_order 0..n-1 per page without gaps or doubles.
    """
    conf = F.col("confidence")
    bad_status = lines.filter(~F.coalesce(F.col("status").isin(S.STATUSES), F.lit(False))).select(F.lit("status").alias("rule"), F.col("line_uid").alias("key"), F.coalesce("status", F.lit("null")).alias("detail"))
    bad_conf = lines.filter(~F.coalesce(conf.between(0.0, 1.0), F.lit(False))).select(F.lit("confidence"), "line_uid", F.coalesce(conf.cast("string"), F.lit("null")))
    twice = lines.groupBy("line_uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("unique uid"), "line_uid", F.col("n").cast("string"))
    order = lines.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("reading_order").alias("u"), F.min("reading_order").alias("lo"), F.max("reading_order").alias("hi"))
    dense = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("u") == F.col("n"))
    gaps = order.filter(~F.coalesce(dense, F.lit(False))).select(F.lit("dense order"), F.coalesce("page_id", F.lit("null")), F.concat_ws("/", F.col("u").cast("string"), F.col("n").cast("string")))
    return bad_status.union(bad_conf).union(twice).union(gaps)


def envelope_violations(meta: dict) -> list[tuple[str, str]]:
    """Rules of the run's envelope: required keys and the version understood."""
    missing = [("missing key", k) for k in ("schema_version", "simulated", "engine", "pages") if k not in meta]
    wrong = [("version", str(meta["schema_version"]))] if meta.get("schema_version", S.SCHEMA_VERSION) != S.SCHEMA_VERSION else []
    return missing + wrong


def validate_run(lines: DataFrame, meta: dict) -> int:
    """Number of lines of a valid run; raises with the first violations of any other."""
    bad = envelope_violations(meta) + [(r.rule, f"{r.key}: {r.detail}") for r in line_violations(lines).limit(5).collect()]
    if bad:
        raise ValueError("; ".join(f"{rule}: {what}" for rule, what in bad))
    return lines.count()
