"""Small tables with every awkward case, written where a query can read them."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts, sources=None):
    return [(i, t, "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def table(spark, folder, data, schema=SCHEMA, name="documents", parts=3):
    spark.createDataFrame(data, schema).repartition(parts).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def collected(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def sf_documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
