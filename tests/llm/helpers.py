"""Fixtures that several tests of these operators share."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, fp string, score string, blob string"


def docs_table(spark, rows):
    """rows: (doc_id, text, lang, source). Further columns have names that the operators use themselves."""
    full = [(i, t, la, s, None if t is None else len(t), "a", "b", "c", "d", "e") for i, t, la, s in rows]
    return spark.createDataFrame(full, DOCS)


LONG = "lorem ipsum dolor sit amet " * 4000


def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows and copies."""
    return [
        (1, "one two three four five six seven", "en", "a"),
        (1, "one two three four five six seven", "en", "a"),
        (2, "one two three four five six seven", "de", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (None, "a text without an id", "en", None),
        (None, None, None, "b"),
        (5, LONG, "fr", "a"),
        (6, " \t\n ", "fr", "\U0001f600"),
        (7, "Ünïcödé ▁ text   with 漢字 and 🎉", "de", "b"),
    ]
