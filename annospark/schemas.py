"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

SOURCE_FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("source", T.StringType()),
    ]
)

PARAMS = T.ArrayType(
    T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("type_hint", T.StringType())]
    )
)

FUNCTIONS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("params", PARAMS),
        T.StructField("return_type", T.StringType()),
        T.StructField("body_preview", T.StringType()),
        T.StructField("has_docstring", T.BooleanType()),
        T.StructField("existing_docstring", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("parent_class", T.StringType()),
    ]
)

GENERATION_FIELDS = [
    T.StructField("answer", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("wait_s", T.DoubleType()),
]

SETTINGS = T.StructType(
    [
        T.StructField("project", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("layer", T.StringType(), False),
        T.StructField("value", T.StringType()),
    ]
)
