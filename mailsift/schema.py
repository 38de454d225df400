"""Table schemas of the engine (messages in, postings out, change log)."""

from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

MESSAGES = T.StructType([
    T.StructField("mailbox_id", T.StringType(), False),
    T.StructField("uid", T.LongType(), False),
    T.StructField("internal_date", T.TimestampNTZType()),
    T.StructField("size", T.LongType()),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("body", T.StringType()),
])

POSTINGS = T.StructType([
    T.StructField("mailbox_id", T.StringType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("term", T.StringType(), False),
    T.StructField("uid", T.LongType(), False),
])

CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("op", T.StringType(), False),          # 'add' | 'flags' | 'delete'
    T.StructField("mailbox_id", T.StringType(), False),
    T.StructField("uid", T.LongType(), False),
    T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("body", T.StringType()),
    T.StructField("size", T.LongType()),
])

ADDRESS_FIELDS = ("TO", "CC", "FROM", "BCC")
