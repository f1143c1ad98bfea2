"""Rows that every operator must bear: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

LONG = " ".join(f"word{i % 997} runs{i % 13}" for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "a", "a b c d e", "A b C d E", "one\ntwo\none\n\n one \n" * 3, "the same text " * 40, LONG,
    "Émile où ça été — ñandú", "x " * 300, "#*$%&|<> ## ** $$",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, words int, block int, n_words string, row string, n int, score string"


def odd_documents(spark):
    """The texts above, three repeated, one without an id; the extra columns bear names that operators use inside."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], None) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[8], rows[8], (None, "no id here", "en", "s", 3), (77, None, None, None, None)]
    return spark.createDataFrame([(*r, "f", 1, 2, "n", "r", 3, "s") for r in rows], COLUMNS).repartition(3)
