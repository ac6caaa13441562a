"""Folds whose result depends on order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cluster_running_mean(rows: DataFrame, key: str, value: str, tie: str, tolerance: float) -> DataFrame:
    """(key, tie, cluster): a value joins the cluster while it is within the tolerance of its running mean, else begins the next.

    Each key's rows come as a sorted stream, so a key is never gathered.
    Null values and keys are left out.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(tie, kinds[tie]), T.StructField("cluster", T.IntegerType())])
    ordered = rows.select(key, F.col(value).cast("double").alias("_v"), tie).dropna(subset=[key, "_v"]).repartition(key).sortWithinPartitions(key, "_v", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n, cluster = None, 0.0, 0, -1
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    now, n, cluster = k, 0, -1
                if n and abs(v - total / n) <= tolerance:
                    total, n = total + v, n + 1
                else:
                    total, n, cluster = v, 1, cluster + 1
                out.append(cluster)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int32())], names=[key, tie, "cluster"])

    return ordered.mapInArrow(run, schema)


def line_template(examples: DataFrame, tolerance: float = 12.0, least: float = 0.6) -> DataFrame:
    """(axis, pos, start, end, support, n_examples) of lines that stand at the same place in most examples.

    examples: (axis, example, pos, start, end). A line joins the first group
    whose running mean is within the tolerance. Support counts different
    examples, not lines. One small group per axis (templates are made from a
    few dozen examples).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["n_examples"].iloc[0]
        groups: list[dict] = []
        for row in pdf.sort_values(["pos", "example", "start"]).itertuples():
            home = next((g for g in groups if abs(g["sum"] / len(g["rows"]) - row.pos) < tolerance), None)
            if home is None:
                groups.append(home := {"sum": 0.0, "rows": []})
            home["sum"] += row.pos
            home["rows"].append(row)
        out = []
        for g in groups:
            rows = pd.DataFrame(g["rows"])
            support = rows["example"].nunique()
            if support / total >= least:
                out.append((pdf["axis"].iloc[0], rows["pos"].median(), rows["start"].median(), rows["end"].median(), support, total))
        return pd.DataFrame(out, columns=["axis", "pos", "start", "end", "support", "n_examples"])

    n = examples.groupBy("axis").agg(F.countDistinct("example").alias("n_examples"))
    return examples.join(n, "axis").groupBy("axis").applyInPandas(fold, "axis string, pos double, start double, end double, support long, n_examples long")
