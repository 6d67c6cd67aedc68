"""Schemas of the tables that the engine reads and returns."""

from __future__ import annotations

from pyspark.sql import types as T

SLICE = T.ArrayType(T.StructType([T.StructField("dim", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
CHUNK = T.StructType([T.StructField("url", T.StringType()), T.StructField("slice", SLICE)])
MANIFEST = T.StructType([*CHUNK.fields, T.StructField("count", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.FloatType())), T.StructField("radius", T.FloatType())])
LOWER_BOUNDS = T.StructType([*MANIFEST.fields, T.StructField("lower_bounds", T.ArrayType(T.FloatType())), T.StructField("min_lower_bound", T.FloatType())])
RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("chunk_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("slice", SLICE), T.StructField("offset", T.LongType()), T.StructField("distance", T.FloatType())])
STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("rows_seen", "rows_searched", "query_evaluations", "results_added")])
VECTORS = T.StructType([*CHUNK.fields, T.StructField("chunk_id", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
