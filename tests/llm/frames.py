"""Frames with all that may go wrong: nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""

LONG = "word " * 30_000 + "x" * 60_000
ROWS = [
    (1, None, "en", None, None),
    (2, "", "en", "src0", 0),
    (3, " \n\t ", None, "src0", 4),
    (4, LONG, "en", "src0", len(LONG)),
    (5, "the first line of it. And more\nthe second line, by mail to Some.One@mail.example.com", "en", "src1", 10),
    (5, "the first line of it. And more\nthe second line, by mail to Some.One@mail.example.com", "en", "src1", 10),
    (6, "ein Satz mit Wörtern und noch einer. Sonst nichts", "de", "src0", 49),
    (None, "a row without a key", "en", "src0", 19),
    (7, "12 34 !!", "en", None, 8),
    (8, "the first line of it. And more\nthe second line, by mail to Some.One@mail.example.com", None, "src1", 10),
    (9, "中文 текст ελληνικά 🙂 ▁ 　  x", "en", "src0", 20),
]
CLASHING = ("ids", "fp", "kind", "block", "digests", "next", "attempt", "score", "sequence_id", "label", "held_text", "gone_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def edge_documents(spark):
    return spark.createDataFrame([(*row, *("clash" for _ in CLASHING)) for row in ROWS], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def key(value):
    return (value is None, value or 0)
