"""Small inputs with the awkward cases every operator must take."""

SF = "/root/testdata/sf0.01"

LONG = " ".join(f"word{i % 997}" for i in range(60_000))


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")


def edge_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (None, None, None, None, None),
        (None, "a text without an id and enough words to be one", "s1", "en", 3),
        (-1, None, "s1", "en", 0),
        (-2, "", None, "en", 0),
        (-3, " \n\t ", "s2", None, 4),
        (-4, "one", "s2", "de", 3),
        (-5, "tie tie tie tie tie tie", "s2", "de", 3),
        (-6, "tie tie tie tie tie tie", "s2", "de", 3),
        (-7, LONG, "s3", "fr", len(LONG)),
        (-8, "repeated row with the same id and text", "s3", "fr", 9),
        (-8, "repeated row with the same id and text", "s3", "fr", 9),
        (-9, "1234 5678 !!", "s4", "es", 2),
        (-10, "\x00\x01 odd ▁ 😀 中文字", "s4", "es", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    return df.selectExpr("*", "1 as k", "2 as h", "3 as row", "'x' as words", "4 as size", "5 as score", "6 as key", "7 as y", "8 as __mix", "9 as `dot.ted`")
