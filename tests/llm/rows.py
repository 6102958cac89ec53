"""Small tables with the edge cases that every operator has to bear."""

from __future__ import annotations

import random

WORDS = "the of and river stone over under light house green walks sings slowly again north wind".split()


def prose(seed: int, words: int = 60) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(90)) for _ in range(words))


#: (doc_id, text, source): ties, repeated rows, nulls in each column, empty and long texts.
EDGE = [
    (1, prose(1), "a"),
    (2, prose(1), "b"),
    (2, prose(1), "b"),
    (2, prose(2), "b"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t\n ", "b"),
    (6, prose(3, 9000), "a"),
    (7, prose(3, 9000) + " end", "c"),
    (None, prose(1), None),
    (None, prose(4), "a"),
    (8, "é " + prose(5) + "\n" + prose(6) + "\n" + prose(7) + "\n" + prose(8), "a"),
    (9, prose(6) + "\n" + prose(7) + "\n" + prose(8) + "\n" + prose(9), "a"),
    (10, "one", "d"),
    (11, "A" * 300, "d"),
    (12, "a" * 300, "d"),
]

#: Columns that clash with names the operators use inside.
CLASH = (
    "id long, place long, name string, kept boolean, h1 string, chunk int, length int, cell string, rest int, "
    "_h1 string, _row_sha string, key0 int, row string, copy int, taken int, _mix_copy int"
)


def edge_docs(spark):
    """The rows above with clashing columns beside them."""
    extra = (0, 1, "n", False, "h", 2, 3, "c", 4, "own", "sha", 5, "r", 6, 7, 8)
    return spark.createDataFrame([r + extra for r in EDGE], f"doc_id long, text string, source string, {CLASH}")


def no_docs(spark):
    return edge_docs(spark).limit(0)
