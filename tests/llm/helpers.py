"""Small tables with the awkward rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pii string, score double"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]), with columns whose names operators use themselves."""
    full = [(*r, *(None, None)[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "own", 0.5) for i, t, lang, source in full], SCHEMA)


LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
AWKWARD = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "one", "en", "b"), (5, "one", "en", "b"), (5, "one", "en", "b"), (6, LONG, "en", "a"), (7, "é日本語 ÉA ß İ \x1c   x", None, None), (None, "no id at all here", "en", "a"), (9, "x" * 9000, "en", "a"), (10, LONG + " tail", "en", "a")]
