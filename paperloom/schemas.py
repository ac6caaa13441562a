"""Table schemas, enumerations and thresholds; lengths are in units of the page's rule pitch."""

from pyspark.sql import types as T

# fixed values: vocabularies of the document contract
ROUTES = ["text_ocr", "math_ocr", "diagram", "review"]
PROCESSORS = {"text_ocr": "ocr", "math_ocr": "math_ocr", "diagram": "diagram_parser", "review": "manual_review"}
STATUSES = ["ok", "empty", "diagram", "failed"]
CATEGORIES = ["paragraph", "math", "figure", "table", "code", "crossed_out"]
SPLITS = ["train", "val", "test"]
MATH_WORDS = ["cos", "det", "lim", "log", "mod", "sin", "sqrt", "tan"]

# fixed values: thresholds
DEFAULT_PITCH = 58.4
TALL = 1.6
SNAP = 0.45
SHORT = 0.55
FULL_LINE = 6.0
MIN_HEIGHT = 0.20
MIN_WIDTH = 0.08
PAD = 0.10
MIN_COMPONENT_AREA = 0.006
MATH_RATIO = 0.40
NESTING_IOA = 0.80
OVERLAY_IOA = 0.30
CLASS_IOA = 0.35
NEW_REGION_IOA = 0.55
MIN_SIDE = 12
MIN_AREA = 400
SCHEMA_VERSION = 1

BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x1", "y1", "x2", "y2")])

MANIFEST = T.StructType(
    [T.StructField("page_id", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("student", "cie", "page", "block_id", "line_id", "x1", "y1", "x2", "y2", "width", "height")]
    + [T.StructField("tall", T.IntegerType()), T.StructField("crop", T.StringType()), T.StructField("skipped", T.StringType())]
)

_LINE_BOX = T.StructType([T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("parts", T.IntegerType()), T.StructField("tall", T.BooleanType())])
PAGE_RECORD = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("student", T.IntegerType()),
        T.StructField("cie", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("size", T.ArrayType(T.IntegerType())),
        T.StructField("rule_pitch", T.DoubleType()),
        T.StructField("rules_removed", T.LongType()),
        T.StructField("ink_pixels", T.LongType()),
        T.StructField("ink_covered", T.DoubleType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("lines", T.ArrayType(_LINE_BOX))]))),
    ]
)

LINE_RESULT = T.StructType(
    [
        T.StructField("line_uid", T.StringType()),
        T.StructField("page_id", T.StringType()),
        *[T.StructField(n, T.IntegerType()) for n in ("student", "cie", "page", "block_id", "line_id")],
        T.StructField("bbox", T.ArrayType(T.IntegerType())),
        T.StructField("crop", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("reading_order", T.IntegerType()),
        T.StructField("tall", T.BooleanType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField(
            "annotations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.IntegerType()),
                        T.StructField("image_id", T.IntegerType()),
                        T.StructField("category_id", T.IntegerType()),
                        T.StructField("bbox", T.ArrayType(T.DoubleType())),
                        T.StructField("score", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())]))),
    ]
)

SAMPLE_MANIFEST = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("student_id", T.StringType()),
        T.StructField("cie", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("page_kind", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)
