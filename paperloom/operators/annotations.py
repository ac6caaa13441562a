"""Layout labels: star of images, annotations and categories; label transfer; assignments; checks; training files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import schemas as S
from paperloom.functions.geometry import box, clip, from_array, union_box, xyxy, yolo_line
from paperloom.operators.spatial import best_overlap, overlapping


def category_id(name: Column) -> Column:
    """1-based place in the fixed order, 0 for an unknown name."""
    return F.array_position(F.array(*[F.lit(c) for c in S.CATEGORIES]), name).cast("int")


def category_name(cid: Column) -> Column:
    """Name of a category, ? for an id that has none."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in S.CATEGORIES]), cid - 1), F.lit("?"))


def star(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations with their file, page size and category name; boxes from xywh to corners.

    Other columns that both sides have, such as the document's page, join
    them too: image ids are unique within a document. An annotation without
    image is left out, an unknown category is named ?.
    """
    x1, y1, x2, y2 = xyxy(*from_array(F.col("bbox")))
    named = annotations.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "category": category_name(F.col("category_id"))})
    shared = [c for c in images.columns if c in annotations.columns and c != "id"]
    sizes = images.select(*shared, F.col("id").alias("image_id"), "file_name", F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    return named.join(sizes, [*shared, "image_id"])


def transfer_labels(blocks: DataFrame, predictions: DataFrame, block_id: str, order: str, least: float = S.CLASS_IOA) -> DataFrame:
    """Each block with the category and score of the prediction that covers most of it; under the least share, paragraph and no score."""
    best = best_overlap(blocks, predictions, block_id, order, ["category", "score"])
    weak = F.col("ioa") < least
    return best.withColumn("category", F.when(weak | F.col("category").isNull(), "paragraph").otherwise(F.col("category"))).withColumn("score", F.when(~weak, F.col("score")))


def human_or_model(human: DataFrame, model: DataFrame, key: str = "page_id") -> DataFrame:
    """Labels of people where a page has any, else those of the model."""
    return human.unionByName(model.join(human.select(key).distinct(), key, "left_anti"))


def admit_predictions(boxes: DataFrame, predictions: DataFrame, most: float = S.NEW_REGION_IOA) -> DataFrame:
    """Predictions added one after the other where no box so far, nor one added before, covers `most` of them.

    Order-dependent, so it is folded page by page: (page_id, ord). Boxes are
    looked up by horizontal bands, so a page with very many of them is no
    square of work.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        band, bands = 256, {}

        def put(b):
            for k in range(int(b[1]) // band, int(max(b[3] - 1, b[1])) // band + 1):
                bands.setdefault(k, []).append(b)

        def share(p):
            area, top = (p[2] - p[0]) * (p[3] - p[1]), 0.0
            if area <= 0:
                return 0.0
            for k in range(int(p[1]) // band, int(max(p[3] - 1, p[1])) // band + 1):
                for b in bands.get(k, ()):
                    top = max(top, max(0, min(p[2], b[2]) - max(p[0], b[0])) * max(0, min(p[3], b[3]) - max(p[1], b[1])) / area)
            return top

        rows = pdf[["x1", "y1", "x2", "y2"]].to_numpy()
        for i in (~pdf["predicted"]).to_numpy().nonzero()[0]:
            put(rows[i])
        kept = []
        new = pdf[pdf["predicted"]].sort_values("ord")
        for o, b in zip(new["ord"], new[["x1", "y1", "x2", "y2"]].to_numpy(), strict=True):
            if share(b) < most:
                kept.append(o)
                put(b)
        page = pdf["page_id"].iloc[0]
        return pd.DataFrame([(page, o) for o in kept], columns=["page_id", "ord"])

    cols = ["page_id", "x1", "y1", "x2", "y2"]
    both = boxes.select(*cols).withColumns({"ord": F.lit(0).cast("bigint"), "predicted": F.lit(False)}).unionByName(predictions.select(*cols, F.col("ord").cast("bigint").alias("ord"), F.lit(True).alias("predicted")))
    return both.dropna(subset=[*cols, "ord"]).groupBy("page_id").applyInPandas(fold, "page_id string, ord bigint")


def explode_assignments(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skipped pages, claims) of (page, value): value is JSON, "skip" or an object of box keys to a label or a list of labels.

    A key like 2+3+4 merges boxes. Claims are (page, box_key, label, ordinal),
    one row per label and member box; text that is not JSON is left out.
    """
    v = assignments.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    skipped = v.filter((kind == "STRING") & (F.expr("try_variant_get(v, '$', 'string')") == "skip")).select("page")
    # a label that is no list is made one, so both forms have one type
    entries = v.filter(kind.startswith("OBJECT")).select("page", F.explode(F.from_json("value", "map<string,string>")).alias("box_key", "raw"))
    labels = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    claims = entries.select("page", "box_key", F.explode(labels).alias("label"))
    members = claims.select("page", "box_key", "label", F.explode(F.split("box_key", r"\+")).alias("o"))
    return skipped, members.select("page", "box_key", "label", F.col("o").try_cast("int").alias("ordinal"))


def double_claims(claims: DataFrame) -> DataFrame:
    """Boxes claimed under two different keys of a page."""
    return claims.groupBy("page", "ordinal").agg(F.countDistinct("box_key").alias("n_keys")).filter("n_keys > 1")


def apply_assignments(boxes: DataFrame, claims: DataFrame, default: str = "paragraph") -> DataFrame:
    """(page, box_key, label, x1..y2): merged boxes of claims without drop, and unclaimed boxes with the default label."""
    merged = claims.join(boxes, ["page", "ordinal"]).groupBy("page", "box_key", "label").agg(*union_box()).filter("label <> 'drop'")
    free = boxes.join(claims.select("page", "ordinal").distinct(), ["page", "ordinal"], "left_anti")
    return merged.unionByName(free.select("page", F.col("ordinal").cast("string").alias("box_key"), F.lit(default).alias("label"), "x1", "y1", "x2", "y2"))


def box_violations(boxes: DataFrame, overlay: float = S.OVERLAY_IOA, nesting: float = S.NESTING_IOA) -> DataFrame:
    """(rule, severity, page_id, box_id) of boxes (page_id, box_id, category, x1..y2, page_w, page_h).

    Errors: no area (checked first; such a box meets no other rule), outside
    the page by more than a pixel, a crossed_out box over nothing, content
    nested in a figure or table. Warning: tiny, unless crossed_out.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    flat = (w <= 0) | (h <= 0)
    real = boxes.filter(~flat)
    outside = (F.col("x1") < -1) | (F.col("y1") < -1) | (F.col("x2") > F.col("page_w") + 1) | (F.col("y2") > F.col("page_h") + 1)
    tiny = (F.col("category") != "crossed_out") & ((w < S.MIN_SIDE) | (h < S.MIN_SIDE) | (w * h < S.MIN_AREA))

    # one join for both rules on pairs: crossed_out over anything else, content in a figure or table
    holder = ("figure", "table")
    small = real.select("page_id", "box_id", "category", "x1", "y1", "x2", "y2")
    meet = (F.col("a_category") == "crossed_out") | F.col("b_category").isin(*holder)
    pairs = overlapping(small.filter(~F.col("category").isin(*holder)), small.filter("category <> 'crossed_out'"), meet=meet)
    best = pairs.groupBy("page_id", F.col("a_box_id").alias("box_id")).agg(F.max("ioa").alias("best"))
    crossed, covered = F.col("category") == "crossed_out", F.coalesce("best", F.lit(0.0))
    rules = [("no area", "error", flat), ("outside", "error", ~flat & outside), ("tiny", "warning", ~flat & tiny), ("overlay", "error", ~flat & crossed & (covered < overlay)), ("nested", "error", ~flat & ~crossed & (covered >= nesting))]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(r).alias("rule"), F.lit(level).alias("severity"))) for r, level, hit in rules]))
    return boxes.join(best, ["page_id", "box_id"], "left").select("page_id", "box_id", F.explode(found).alias("f")).select("f.rule", "f.severity", "page_id", "box_id")


def refuse(found: DataFrame, what: str, *keys: str) -> None:
    """Stops the run where there are any such rows, naming the first twenty."""
    some = found.select(*keys).orderBy(*keys).limit(20).collect()
    if some:
        raise ValueError(f"{what}: " + ", ".join("/".join(str(x) for x in r) for r in some))


def refuse_double_claims(claims: DataFrame) -> DataFrame:
    """The claims; a run stops where a box is claimed under two keys."""
    refuse(double_claims(claims), "claimed under two keys", "page", "ordinal")
    return claims


def scaled(boxes: DataFrame, scales: DataFrame) -> DataFrame:
    """Boxes rescaled by their page's (page_id, scale), clipped to page_w and page_h; a run stops where a page has no scale."""
    joined = boxes.join(scales, "page_id", "left")
    refuse(joined.filter("scale is null").select("page_id").distinct(), "pages without a scale", "page_id")
    return rescale(joined, F.col("scale"), F.col("page_w"), F.col("page_h")).drop("scale")


def passes(violations: DataFrame, strict: bool = False) -> bool:
    """Whether labels may go on: no error, and under strict no warning either."""
    return (violations if strict else violations.filter("severity = 'error'")).isEmpty()


def training_files(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(split, file_name, body): one label file per image in a split, empty for an image without boxes; order by box_id."""
    line = yolo_line(category_id(F.col("category")) - 1, box(), F.col("page_w"), F.col("page_h"))
    rows = boxes.withColumn("line", line).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return images.join(rows, "page_id", "left").select("split", "file_name", F.coalesce("body", F.lit("")).alias("body"))


def rescale(boxes: DataFrame, factor: Column, width: Column, height: Column) -> DataFrame:
    """Boxes times the page's factor, clipped to the page, with a flag where clipping changed them."""
    raw = [F.col(c) * factor for c in ("x1", "y1", "x2", "y2")]
    cut = [clip(v, 0.0, m.cast("double")) for v, m in zip(raw, (width, height, width, height), strict=True)]
    changed = F.lit(False)
    for a, b in zip(raw, cut, strict=True):
        changed = changed | (a != b)
    return boxes.withColumns({**{c: v for c, v in zip(("x1", "y1", "x2", "y2"), cut, strict=True)}, "clipped": changed})


def precision_recall(gold: DataFrame, predicted: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """(category, n_gold, n_pred, n_hit, precision, recall): a prediction hits the gold box of its category it meets best, each gold box once."""
    pairs = overlapping(gold, predicted).filter(F.col("a_category") == F.col("b_category"))
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    both = F.col("ioa") * area("a_")
    hit = pairs.withColumn("iou", both / (area("a_") + area("b_") - both)).filter(F.col("iou") >= least_iou)
    per_pred = hit.groupBy("page_id", "b_box_id").agg(F.max(F.struct("iou", "b_score", "a_box_id", "a_category")).alias("m"))
    hits = per_pred.select("page_id", F.col("m.a_box_id").alias("g"), F.col("m.a_category").alias("category")).distinct().groupBy("category").agg(F.count(F.lit(1)).alias("n_hit"))
    g = gold.groupBy("category").agg(F.count(F.lit(1)).alias("n_gold"))
    p = predicted.groupBy("category").agg(F.count(F.lit(1)).alias("n_pred"))
    j = g.join(p, "category", "full").join(hits, "category", "left").na.fill(0, ["n_gold", "n_pred", "n_hit"])
    return j.select("category", "n_gold", "n_pred", "n_hit", F.try_divide("n_hit", "n_pred").alias("precision"), F.try_divide("n_hit", "n_gold").alias("recall"))


def matched(gold: DataFrame, predicted: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, category, score) of each prediction that hits: its best gold box of its category meets it at the threshold, and no better scored prediction has that box as its best.

    Equals go to the first box_id. Predictions without a score are left out.
    """
    scored = predicted.filter("score is not null")
    pairs = overlapping(gold, scored, meet=F.col("a_category") == F.col("b_category"))
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    both = F.greatest(F.lit(0), F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * F.greatest(F.lit(0), F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    iou = (both / (area("a_") + area("b_") - both)).cast("double")
    per = pairs.groupBy("page_id", "b_box_id").agg(F.max(F.struct(iou.alias("iou"), (-F.col("a_box_id")).alias("g"), F.col("b_score").alias("score"), F.col("a_category").alias("category"))).alias("m")).select("page_id", "b_box_id", "m.*")
    levels = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("iou"))).alias("threshold")
    first = F.max(F.struct("score", (-F.col("b_box_id")).alias("_b"), "category")).alias("m")
    return per.select("*", levels).groupBy("threshold", "page_id", "g").agg(first).select("threshold", "m.category", "m.score")


def mean_average_precision(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(category, ap50, ap50_95): average precision at an overlap of one half, and its mean over 0.50 to 0.95 by 0.05. A category without gold boxes has none."""
    thresholds = [(50 + 5 * k) / 100 for k in range(10)]
    hits = matched(gold, predicted, thresholds).groupBy("threshold", "category", "score").agg(F.count(F.lit(1)).alias("h"))
    seen = predicted.filter("score is not null").groupBy("category", "score").agg(F.count(F.lit(1)).alias("n"))
    every = seen.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).join(hits, ["threshold", "category", "score"], "left").na.fill(0, ["h"])
    w = Window.partitionBy("threshold", "category").orderBy(F.desc("score"))
    run = every.withColumns({"hits": F.sum("h").over(w), "all": F.sum("n").over(w)})
    area = run.groupBy("threshold", "category").agg(F.sum(F.col("h") * F.col("hits") / F.col("all")).alias("area"))
    n = gold.groupBy("category").agg(F.count(F.lit(1)).alias("n_gold"))
    # one row per category
    per = n.join(area, "category", "left").select("category", "threshold", F.coalesce(F.col("area") / F.col("n_gold"), F.lit(0.0)).alias("ap"))
    return per.groupBy("category").agg(F.coalesce(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))), F.lit(0.0)).alias("ap50"), F.avg("ap").alias("ap50_95"))


def review_list(predictions: DataFrame, least: float = 0.35, few: int = 2) -> DataFrame:
    """(line): page, best score and number of predictions, apart by tabs, of pages whose best is weak or that have few."""
    per = predictions.groupBy("page_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    weak = per.filter(F.coalesce(F.col("best") < least, F.lit(True)) | (F.col("n") < few))
    return weak.select(F.concat_ws("\t", "page_id", F.coalesce(F.format_string("%.3f", "best"), F.lit("")), F.col("n").cast("string")).alias("line"))


def progress(pages: DataFrame, labels: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(what, n, page_id): pages available and reviewed, labels by category on reviewed pages, the first page not reviewed."""
    done = pages.join(reviewed, "page_id", "left_semi")
    none = F.lit(None)
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n", none.cast("string").alias("page_id"))
    by = labels.join(reviewed, "page_id", "left_semi").groupBy(F.concat(F.lit("label "), "category").alias("what")).agg(F.count(F.lit(1)).alias("n")).withColumn("page_id", none.cast("string"))
    following = pages.join(reviewed, "page_id", "left_anti").agg(F.min("page_id").alias("page_id")).select(F.lit("next").alias("what"), none.cast("bigint").alias("n"), "page_id")
    return by.unionByName(count(pages, "available")).unionByName(count(done, "reviewed")).unionByName(following)
