import pytest

CLASHING = ", n_words int, block int, kept string, path string, text_ string"


@pytest.fixture
def docs(spark):
    """Makes a documents frame with extra columns whose names clash with what operators add."""

    def make(rows, extra=True):
        full = [(i, t, "en", s, len(t or "")) + ((1, 2, "k", "p", "t") if extra else ()) for i, t, s in ((*r, "src0")[:3] if len(r) < 3 else r for r in rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (CLASHING if extra else ""))

    return make


WORDS = "the of and onther rean shat blet ingor thea wher anst edor".split()


@pytest.fixture
def corpus():
    """Texts with copies, shared passages, periodic stretches, nulls and empty ones; equal rows too."""
    import random

    r = random.Random(7)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))
    passage, line = text(40), text(9)
    rows = [(i, text(r.randint(1, 120)) + (" " + passage if i % 4 == 0 else "") + ("\n" + line if i % 3 == 0 else "")) for i in range(40)]
    rows += [(50 + i, rows[i][1]) for i in range(6)] + [(60, None), (61, ""), (62, "  \n\t "), (63, "ab" * 300), (64, "x " * 200), (65, text(3)), (66, "é" * 150 + "ß" * 90), (67, "a b c d e " * 60), (68, "line one here now ok\n" * 5)]
    rows += [(70, rows[4][1].replace("7", "8", 1)), (71, "cut " + rows[8][1]), (None, rows[2][1])]
    return rows
