"""Small tables for the llm tests: a folder per test with the tables a query reads."""

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, rank double, __rid long"


def folder(spark, path, **tables):
    """Write ``tables`` (name = (rows, schema) or a DataFrame) where queries look for them."""
    for name, t in tables.items():
        df = spark.createDataFrame(*t) if isinstance(t, tuple) else t
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def docs(*rows):
    """(doc_id, text[, lang[, source]]) with columns whose names clash with internal ones."""
    return [(r + (None,) * (4 - len(r)))[:4] + (None, 0.5, 1) for r in rows], DOC


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
