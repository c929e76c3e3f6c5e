"""Small tables with the awkward rows every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n_words long"
LONG = "long text goes on and on. " * 20_000


def awkward(spark):
    """Null and empty texts, a null id, ties, repeated rows, a very long text, clashing extra columns."""
    texts = {1: "Alpha beta gamma delta.", 2: None, 3: "", 4: " \n\t ", 5: "Alpha beta gamma delta.", 6: LONG, 7: "!!! 123 ---", 8: "ÄÖÜ ß naïve\nÄÖÜ ß naïve"}
    rows = [(i, t, "en" if i % 2 else None, "web", 0, 9.9, 99, -1) for i, t in texts.items()]
    rows += [(1, "Alpha beta gamma delta.", "en", "web", 0, 9.9, 99, -1), (None, "no id here at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
