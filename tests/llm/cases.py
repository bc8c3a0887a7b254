"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import pandas as pd
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}" for i in range(20_000))
TEXTS = ["", None, " \t\n\x0b\x0c\r ", "one", "a  b\tc", "a b c", "The the of and to a in is that it was for", "x\ny\nx\n\nx", "a b c d e f a b c d e", "é ß ı İ 日本 😀 x", LONG, "# $ % & | < > *", "a b c"]

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.StringType()), ("t", T.IntegerType()), ("kept", T.StringType()), ("print", T.StringType()))])


def rows(repeats=True, null_id=False):
    out = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "clash", i, "clash", "clash") for i, t in enumerate(TEXTS)]
    out += [(100 + i, t, "en", "s1", len(t or ""), "clash", i, "clash", "clash") for i, t in enumerate(TEXTS[3:9])]
    if repeats:
        out += out[3:6]
    if null_id:
        out.append((None, None, None, None, None, None, None, None, None))
    return out


def frame(spark, **options):
    return spark.createDataFrame(rows(**options), SCHEMA)


def pandas(**options):
    return pd.DataFrame(rows(**options), columns=SCHEMA.names).astype({"doc_id": "Int64"})
