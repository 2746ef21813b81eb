"""Documents that every operator is run over: nulls, empty and very long texts, ties, repeats, and columns that clash."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, bucket int, label string, c double, key binary"
_EXTRA = ("x", 1, "y", 2.0, b"z")
EN = "the quick brown fox jumps over the lazy dog while many people of the town look at it and wonder about the weather of that day"
FR = "le renard brun saute par dessus le chien paresseux pendant que les gens de la ville regardent et parlent du temps de ce jour"


def rows():
    texts = [
        (0, EN, "en", "a"), (1, FR, "fr", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "en", "b"), (5, "###", "en", "b"),
        (6, EN, "en", "a"), (6, EN, "en", "a"), (7, EN.upper(), "en", "hot"), (8, FR + " fin", "fr", "hot"), (None, EN, "en", "hot"), (None, None, None, None),
        (9, "word " * 20_000, "en", "hot"), (10, "a\nb\na\n\n \na", "en", "hot"), (11, "one", "en", "c"), (12, "one two three", "en", "c"), (13, "ONE TWO THREE", "en", "c"),
        (14, "漢字 текст \U0001f600 é", None, "c"), (15, EN + " " + EN, "en", "c"), (16, " ".join(f"w{i}" for i in range(30_000)), "en", "c"),
    ]
    return [(*t, len(t[1] or ""), *_EXTRA) for t in texts]


def frame(spark, extra=()):
    return spark.createDataFrame([*rows(), *[(*t, len(t[1] or ""), *_EXTRA) for t in extra]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
