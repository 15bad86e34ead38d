"""Fixed schemas of stored records; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_long = ["dur_ms", "out_bytes", "err_bytes", "in_lines", "out_lines", "in_tok", "out_tok"]

META = T.StructType([
    T.StructField("argv", T.ArrayType(T.StringType())),
    T.StructField("cwd", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("stdout_bytes", T.LongType()),
    T.StructField("stderr_bytes", T.LongType()),
])

RUN_RECORD = T.StructType([
    T.StructField("t", T.StringType()),
    T.StructField("lvl", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("handle", T.StringType()),
    T.StructField("cmd", T.StringType()),
    T.StructField("argv", T.ArrayType(T.StringType())),
    T.StructField("cwd", T.StringType()),
    T.StructField("exit", T.IntegerType()),
    *[T.StructField(name, T.LongType()) for name in _long],
    T.StructField("level", T.IntegerType()),
    T.StructField("stages", T.ArrayType(T.StringType())),
    T.StructField("passthrough", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])
