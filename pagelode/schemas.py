"""Explicit schemas of the index tables; nothing in the library infers a schema."""

from pyspark.sql import types as T

RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("heading", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("range", RANGE),
])

#: What the chunker returns for one text.
PIECES = T.ArrayType(T.StructType([
    T.StructField("heading", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
]))

FILE_RECORD = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("size", T.LongType()),
    T.StructField("batches", T.ArrayType(T.IntegerType())),
])

NAV_NODE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("parent_path", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("is_dir", T.BooleanType()),
    T.StructField("depth", T.IntegerType()),
])
