"""Small tables for the operators: odd rows that each must give a defined result."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, label string, rank int, h long, found string, copies int, reading int, kept_id long"
LONG = ("Long sentences repeat themselves here. " * 3000) + "end"
ODD = [
    (1, "Some plain words stand in this text, more than four.", "en"), (2, "SOME plain words stand in this text, more than four.", "en"), (3, None, "en"), (4, "", "fr"), (5, "   \n\t ", None),
    (6, LONG, "en"), (7, LONG + "!", "en"), (8, "Élan vital, ça va là-bas.", "fr"), (9, "élan vital, ça va là-bas.", "fr"), (10, "two words", "en"),
    (10, "two words", "en"), (10, "other words", "de"), (None, "a row without an id", "en"), (None, None, None), (2**60 + 1, "a large id, beyond doubles", "en"), (12, "1234 5678", "en"), (13, "日本語のテキスト。", None),
    (14, "Paragraph one is here.\n\nParagraph two is there.\nThree.", "en"), (15, "idiot and scum", "en"),
]


def odd(spark):
    """The odd rows, with further columns whose names clash with those that operators use."""
    rows = [(i, t, lang, None if k % 3 == 0 else f"s{k % 3}", None if t is None else len(t), "x", "y", 1, 2, "z", 3, 4, 5) for k, (i, t, lang) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
