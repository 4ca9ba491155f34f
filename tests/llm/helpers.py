"""Awkward tables that every operator must take."""

LONG = "wordy tail " * 20000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today", "en", "a", 1), (2, "the quick brown fox jumps over the lazy dog today", "en", "a", 2), (3, "", "en", "b", 0), (4, None, None, None, None),
    (5, LONG, "en", "a", 3), (6, "Größe naïve café é — 你好 👍🏽 <|endoftext|> x", "de", "b", 4), (7, "one", "en", None, 1), (7, "one", "en", None, 1), (None, "null id text here", "en", "c", 1), (8, " \n\t ", "en", "c", 1), (9, "a\x1cb c  d \n e", "en", "c", 1),
    (10, "Of%%% nd%%% onshed$$$ inhe*** ingerre%%% thha*** erntinea.*** Ouaning,&&& from,###", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra=()):
    """The rows with further columns whose names clash with operators' own."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in extra:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
