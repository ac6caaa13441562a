"""Queries of pixel operators over 8 x 8 grey tiles, and of streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paperloom.common import shared_folder, table
from paperloom.functions import pixels as X
from paperloom.operators import masks
from paperloom.plans.base import Registry
from paperloom.plans.routing import _rule
from paperloom.streaming.lines import first_deliveries, read_lines, route_counts

R = Registry()
_INK = "ink AS (SELECT vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings) WHERE v < 0)"
_RUNS = f"{_INK}, k AS (SELECT vec_id, y, x, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS r FROM ink), runs AS (SELECT vec_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM k GROUP BY vec_id, y, r)"


def _ink(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).filter("v < 0")
    return e.select("vec_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"))


def _tiles(spark, d):
    """Tiles as one-channel images: value * 64 + 128 as grey."""
    e = table(spark, d, "embeddings")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [np.clip(np.asarray(v, dtype=float) * 64 + 128, 0, 255).astype(np.uint8).tobytes() for v in pdf["embedding"]]
            yield pd.DataFrame({"path": pdf["vec_id"].astype(str), "height": 8, "width": [len(x) // 8 for x in data], "data": data})

    return e.select("vec_id", "embedding").mapInPandas(run, "path string, height int, width int, data binary")


@R.add(f"WITH {_RUNS} SELECT vec_id, y, x0, x1 FROM runs WHERE x1 - x0 >= 2")
def x03_opened_runs(spark, d):
    return masks.opened(masks.runs(_ink(spark, d), "vec_id"), 2)


@R.add(f"WITH {_RUNS}, s AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w >= 2 THEN 1 ELSE 0 END AS s FROM runs WINDOW w AS (PARTITION BY vec_id, y ORDER BY x0)), g AS (SELECT *, sum(s) OVER (PARTITION BY vec_id, y ORDER BY x0) AS g FROM s) SELECT vec_id, y, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY vec_id, y, g")
def x03_closed_runs(spark, d):
    return masks.closed(masks.runs(_ink(spark, d), "vec_id"), "vec_id", 2)


@R.add(f"WITH {_INK}, b AS (SELECT DISTINCT vec_id, y, x FROM ink WHERE (x BETWEEN 1 AND 4 AND y BETWEEN 1 AND 4) OR (x BETWEEN 3 AND 6 AND y BETWEEN 2 AND 6)) SELECT vec_id, count(*) AS covered FROM b GROUP BY 1")
def x11_covered_ink(spark, d):
    r = masks.runs(_ink(spark, d), "vec_id")
    two = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]) for b in ((1, 1, 5, 5), (3, 2, 7, 7))])
    boxes = table(spark, d, "embeddings").select("vec_id", F.explode(two).alias("b")).select("vec_id", "b.*")
    return masks.covered_pixels(r, boxes, "vec_id")


@R.add(f"WITH {_RUNS} SELECT vec_id, CAST(sum(x1 - x0) AS BIGINT) AS ink FROM runs GROUP BY 1")
def x01_run_ink(spark, d):
    return masks.ink_pixels(masks.runs(_ink(spark, d), "vec_id"), "vec_id")


@R.add(
    f"""WITH RECURSIVE {_INK}, reach AS (SELECT vec_id, y * 8 + x AS root, y, x FROM ink UNION SELECT r.vec_id, r.root, p.y, p.x FROM reach r JOIN ink p ON p.vec_id = r.vec_id AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
    least AS (SELECT vec_id, y, x, min(root) AS l FROM reach GROUP BY ALL), n AS (SELECT vec_id, count(DISTINCT l) AS n FROM least GROUP BY 1)
    SELECT CAST(vec_id AS VARCHAR) AS path, coalesce(n, 0)::INT AS n FROM embeddings LEFT JOIN n USING (vec_id)"""
)
def x06_tile_components(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [len(X.components(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) < 128).area) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"path": pdf["path"], "n": n})

    return _tiles(spark, d).mapInPandas(run, "path string, n int")


@R.add(
    f"""WITH m AS (SELECT max(generated_at) AS m FROM ocr_lines), r AS (SELECT DISTINCT lower(trim(line_uid)) AS line_uid, generated_at, text FROM ocr_lines WHERE generated_at IS NOT NULL),
    k AS (SELECT CAST(generated_at AS DATE) AS day, {_rule("text")} AS why FROM r)
    SELECT CAST(day AS VARCHAR) AS day, CASE WHEN why LIKE 'word:%' OR why = 'ratio' THEN 'math_ocr' ELSE 'text_ocr' END AS route, count(*) AS n FROM k, m WHERE day + INTERVAL 1 DAY <= m - INTERVAL 1 HOUR GROUP BY 1, 2"""
)
def st_route_counts(spark, d):
    """The stream run to its end over the files there are: first deliveries counted per day and route, each day written once the watermark has passed it."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "ocr_lines").schema
    counts = route_counts(first_deliveries(read_lines(spark, f"{d}/[o]cr_lines.parquet", schema).filter("generated_at is not null")), timed=True)
    query = counts.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/out").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "route", "n")


QUERIES, SQL = R.queries, R.sql
