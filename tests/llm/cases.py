"""Small tables that every operator must stand."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, size long, ids string, h string"


def docs(spark, rows=None):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns with clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(i * i + i // 7) % 10] + str(i % 97) for i in range(20_000))
    if rows is None:
        rows = [(0, "one two three\none two three\n\none two", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, long, "de", "b"), (3, long, "de", "b"), (None, "null id here", "en", "a"), (None, None, None, None), (4, "  \t\n ", "fr", "c"), (5, long + " tail", "de", "a"), (6, "é ü ß 漢字 \x85 　x <|endoftext|> <|im_end|>", "fr", "c"), (7, "x" * 5000, "en", "a")]
    return spark.createDataFrame([(a, b, c, d, None if b is None else len(b), 7, 8, "ids", "h") for a, b, c, d in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
