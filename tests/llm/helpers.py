"""Small documents for the operators' tests."""

import numpy as np

VOCAB = [f"w{i}" for i in range(4000)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, group_id string, keep string, score string, lines string, key string, part int, seal int, copies int, lines_in string, h1 string, node int"


def prose(rng, n):
    return " ".join(rng.choice(VOCAB, n))


def edited(rng, text, share):
    w = text.split(" ")
    for i in np.flatnonzero(rng.random(len(w)) < share):
        w[i] = f"x{rng.integers(1 << 30)}"
    return " ".join(w)


def documents(spark, rows):
    """(doc_id, text, source) with further columns whose names clash with inner and result columns."""
    full = [(i, t, "en", s, None if t is None else len(t), "g", "k", "s", "l", "y", 7, 8, 9, "in", "h", 3) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


def awkward(rng=None):
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    rng = rng or np.random.default_rng(5)
    base, long = prose(rng, 120), prose(rng, 30_000)
    shared = "\n".join(prose(rng, 12) for _ in range(4))
    return [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, None, "a"), (4, "", "b"), (5, " \n\t ", None), (6, long, "b"), (7, long, None),
        (8, "one", "b"), (9, "one", "b"), (None, base, "a"), (None, None, None), (10, shared, "c"), (11, shared + "\n" + prose(rng, 80), "c"), (12, "ünï çode \U0001f600 " + prose(rng, 60), "c"), (13, prose(rng, 200), None),
    ]
