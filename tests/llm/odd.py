"""Rows that an operator may meet."""

EXTRA = "score double, node long, u long, _key long, size long, copies long, fingerprint string, label string, deleted boolean, value string, rank int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
TEXTS = [
    (1, "", "en", "a"),
    (2, None, None, None),
    (None, "a row without an id is a row all the same", "en", "b"),
    (3, "one two three four five six seven eight nine ten", "en", "a"),
    (3, "one two three four five six seven eight nine ten", "en", "a"),
    (4, "One Two Three Four Five Six Seven Eight Nine Ten", "en", ""),
    (5, LONG, "en", "b"),
    (6, " \t\r\n ", "de", "é"),
    (7, "Ünïcode 日本語 テキスト 🎉 you idiot", "de", "é"),
    (8, "short one", None, "c"),
    (9, "1234 5678 !!! ...", "fr", "c"),
    (10, "mail ann.lee@example.org or 4111 1111 1111 1111 on 2001-02-28", "en", "c"),
]


def rows_of(texts):
    return [(i, t, lang, source, None if t is None else len(t), 1.5, 1, 2, 3, 4, 5, "x", "y", True, "z", 9) for i, t, lang, source in texts]


def written(spark, path, texts, labels=()):
    spark.createDataFrame(rows_of(texts), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, None) for x in labels], "doc_id long, quality int, toxic int, text string").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)
