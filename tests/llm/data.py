"""Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, fp string, h string, term string, n long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z", 1) for i, t in zip(ids, texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(spark):
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    return docs(spark, [None, "", " \n", "one", "one two", long, long, "one", "naïve 😀 text mit größe"], [None, 1, 2, 3, 4, 5, 6, 3, 8])
