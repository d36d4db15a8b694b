"""Rows that every operator has to take: NULLs, empty and long texts, ties, repeats, clashing columns."""

ODD_TEXTS = [None, "", " \n\t ", "a", "é漢😀 ́x", "x" * 70_000, "word " * 20_000, "1. 2, 3; " * 400, "same text here, twice over"]


def odd_documents(spark):
    rows = [(i, t, "en", "src", 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [(8, ODD_TEXTS[8], "en", "src", 1), (None, "no key at all in this row", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "'k' AS key", "1 AS id", "'c' AS class", "'s' AS _md5", "0.5 AS score_", "2 AS bucket").repartition(3)


def empty_documents(spark):
    return odd_documents(spark).where("false")
