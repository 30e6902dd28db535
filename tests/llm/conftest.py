import random
import re

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, block string, length string, window string, `__salt` string, answers string"
SPACE = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with columns whose names clash with those the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in rows], COLUMNS).repartition(3)

    return make


def words_of(text):
    return SPACE.findall(text or "")


@pytest.fixture(scope="session")
def corpus_rows():
    """Texts with copies, shared passages, odd white space, empty and null texts, a very long one, and repeated rows."""
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdeinorst") for _ in range(draw.randint(1, 7))) for _ in range(120)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, other = text(60), text(20)
    rows = []
    for i in range(60):
        t = text(draw.randint(1, 80))
        if i % 4 == 0:
            t += "\n" + passage
        if i % 9 == 0:
            t = other + "  " + t + "\t" + other
        rows.append((i * 3, t))
    copy = rows[5][1]
    rows += [(500, copy), (501, copy), (502, copy + " end"), (503, copy.upper())]
    rows += [(600, ""), (601, None), (602, "   \n\t"), (603, "one"), (604, "one two"), (605, " x\x0by\x0cz "), (606, "ünï cödé 漢字 ﷺ €5 <|endoftext|> it's. 'S İ İ."), (607, "a " * 3000 + text(5000)), (608, "word" * 2000), (609, "a <|endoftext|> b <|STARTOFTEXT|>")]
    rows += [(605, " x\x0by\x0cz "), (503, copy.upper())]
    return rows
