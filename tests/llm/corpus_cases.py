"""Small tables with the awkward cases every corpus operator must take."""

#: Names that operators use inside or return, as columns of the input.
CLASHES = ["_text", "shard", "fp", "n", "score", "rejected", "lang_pred", "_id", "_KEY", "_kept", "_kept_hash", "_text_hash", "_secret_spans", "ids", "n_pieces", "alternatives",
           "round_trip", "bucket", "component_id", "held_out", "predicted", "row", "key", "label", "words", "a", "h", "rank", "_0", "_1"]

LONG = " ".join(f"word{i % 977}x{i}" for i in range(40_000))


def awkward(spark, rows=None, extra=", ".join(f"{n} string" for n in CLASHES)):
    """NULLs, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rows = rows if rows is not None else [
        (1, "one two three four five six"), (1, "one two three four five six"), (2, "ONE two three four five six"), (3, None), (4, ""), (5, "  \t\n"),
        (6, "one two"), (7, LONG), (8, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"), (None, "no id here at all my friend"), (9, "\U0001F600 ▁ é漢"),
    ]
    n = len(extra.split(","))
    made = [(i, t, "en", "s", None, *["clash"] * n) for i, t in rows]
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def nothing(spark):
    return awkward(spark, []).where("false")
