from __future__ import annotations

SCHEMA = "doc_id bigint, text string, kept string, units array<int>, _text string, label int, n_words string, row int"


def documents(spark, rows):
    """A table of (doc_id, text) with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", [1], "x", 7, "n", 3) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a"),
    (5, "one two three"),
    (5, "one two three"),
    (6, "One  two\nthree"),
    (7, LONG),
    (8, LONG),
    (9, "häß 日本 😀 don't I'll\r\n\r\n  x"),
    (None, "no id at all, but words are here for it"),
    (None, None),
]
