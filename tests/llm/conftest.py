import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after called just where most know".split()


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, shared lines, nulls, empty, short, long, repeated words."""
    rng = random.Random(11)
    base = [sentence(rng, 120) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(6)]
    near = base[4].split()
    for i in range(6):
        w = list(near)
        w[10 * i + 5] = "changed"
        rows.append((110 + i, " ".join(w)))
    passage = sentence(rng, 60)
    rows += [(120 + i, sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 30)) for i in range(5)]
    line = "A shared line that is long enough"
    rows += [(130 + i, f"{sentence(rng, 15)}\n  {line.upper() if i % 2 else line} \t\nshort\n{sentence(rng, 12)}") for i in range(6)]
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, "one two three"), (144, "One  TWO\tthree"), (145, "word " * 3000), (146, "ÉÈ \x1c ß\xa0漢字 " * 20), (147, "a\n\n\nb\n"), (148, "x" * 20000)]
    return rows
