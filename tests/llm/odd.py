"""Odd rows that every operator has to stand."""

LONG = "wordy " * 30_000
#: doc_id, text, lang, source, and columns whose names the operators use themselves.
ODD = [
    (1, "plain words of a text that is long enough to have shingles", "en", "a", 1, "x"),
    (1, "plain words of a text that is long enough to have shingles", "en", "a", 1, "x"),
    (2, None, "en", "a", 2, None),
    (3, "", None, "b", 3, "y"),
    (None, "plain words of a text that is long enough to have shingles", "en", None, None, "z"),
    (None, None, None, None, None, None),
    (4, LONG, "en", "a", 4, "x"),
    (5, "one two", "fr", "b", 5, "x"),
    (6, "12 34 -- !!", "fr", "b", 5, "x"),
    (7, "  spaces \t\n\n and   lines \n", "fr", "b", 5, "x"),
    (1, "another text under the same number and with some more words", "en", "a", 1, "x"),
    (8, "é́ 日本語 текст \U0001f600 ﬁ ß <|endoftext|>", None, "c", 5, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, node long, score string"


def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
