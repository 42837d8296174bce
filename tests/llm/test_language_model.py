"""Words cut and looked up without Python objects, and table slots that lie side by side."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievemark.llm import language_model, words


@pytest.fixture
def many():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab \t\nAB\x00\x0b\xc3\xa9") for _ in range(rng.choice([0, 1, 3, 10, 60]))) for _ in range(300)]
    return [*texts, b"x" * 16 + b" " + b"X" * 16 + b" " + b"x" * 17 + b"\n" + b"X" * 17, b"x" * 17 + b" " + b"x" * 16 + b"y", b"  ", b"a\x00 a a\x00\x00"]


def test_words_are_cut_as_python_cuts_them(many):
    for texts in (many, [], [b""], [b"", b"one", b""]):
        found, plain = words.Cut(texts), [t.lower().split() for t in texts]
        flat = [w for t in plain for w in t]
        assert [found.word(i) for i in range(len(found))] == flat == found.listed(np.arange(len(found))).to_pylist()
        assert found.first.tolist() == [0, *np.cumsum([len(t) for t in plain]).tolist()]
        assert found.repeats().tolist() == [i > 0 and w == flat[i - 1] for i, w in enumerate(flat)]


def test_words_are_found_as_in_a_dict(many):
    found = words.Cut(many)
    flat = [found.word(i) for i in range(len(found))]
    known = sorted(set(flat))
    random.Random(6).shuffle(known)
    for some in (known, known[: len(known) // 3], []):
        places = {w: i for i, w in enumerate(some)}
        assert words.Index(some).places(found).tolist() == [places.get(w, -1) for w in flat]


def test_short_words_are_counted_as_a_counter_counts_them(many):
    found = words.Cut(many)
    short = found.sizes <= words.HELD
    marked = np.random.default_rng(1).random(int(short.sum())) < 0.5
    trained, every = Counter(), Counter()
    for w, n, m in zip(*words.short_counts(found.head[:, short], marked)):
        trained[w.as_py()] += int(n)
        every[w.as_py()] += int(m)
    flat = [found.word(i) for i in np.flatnonzero(short)]
    assert every == Counter(flat) and +trained == Counter(w for w, x in zip(flat, marked) if x)


def test_bits_of_a_code_share_lines():
    """Four bits' slots are side by side, so a code reads a line for every four bits, not one for each."""
    coder = language_model.Coder([b"w%d" % i for i in range(5000)], np.arange(5000, 0, -1) ** 2, 7, 3, 20)
    symbol = np.arange(coder.copy + 1)
    contexts = words.mix(np.arange(language_model.VIEWS * len(symbol), dtype=np.uint64)).reshape(language_model.VIEWS, -1)
    sizes, _, _, place = coder.bits(symbol, contexts)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for p, n in zip(place, coder.slots):
        assert p.min() >= 0 and p.max() < n
        for a, b in zip(at[:-1], at[1:]):
            assert len(set((p[a:b] >> 4).tolist())) <= -(-(b - a) // 4) and len(set(p[a : min(b, a + 4)].tolist())) == min(b - a, 4)


def test_nodes_of_a_context_have_slots_of_their_own():
    """Within one context and a roomy table, codes share slots where they share nodes, and hardly elsewhere."""
    coder = language_model.Coder([b"w%d" % i for i in range(200)], np.arange(200, 0, -1), 7, 3, 20)
    symbol = np.arange(coder.copy + 1)
    sizes, _, bit, place = coder.bits(symbol, np.zeros((language_model.VIEWS, len(symbol)), np.uint64))
    at, paths = np.concatenate([[0], np.cumsum(sizes)]), {}
    for a, b in zip(at[:-1], at[1:]):
        for k in range(a, b):
            paths.setdefault(tuple(bit[a:k].tolist()), set()).add(int(place[1][k]))
    assert all(len(x) == 1 for x in paths.values())
    assert len({x for y in paths.values() for x in y}) > 0.99 * len(paths)


def test_spelling_slots_share_lines():
    flat, _, _, mixed = language_model.contexts([b"word", b"\xff\x00", b"another"])
    got = list(language_model.slots(mixed, flat))
    assert [k for k, *_ in got] == list(range(8))
    assert (np.stack([b for *_, b in got]) == np.unpackbits(flat[:, None], axis=1).T).all()
    for half in (got[:4], got[4:]):
        lines = np.stack([p >> 4 for _, p, _ in half])
        assert (lines == lines[0]).all() and (np.diff(np.sort(np.stack([p for _, p, _ in half]), axis=0), axis=0) > 0).all()


def test_rare_and_long_words_meet_their_counts(spark, monkeypatch):
    """Words outside the broadcast, long ones repeated within a text among them, are counted and spelled once for each place."""
    monkeypatch.setattr(language_model, "HEAD", 2)
    monkeypatch.setattr(language_model, "POOL", 5)
    long = "w" * 20
    texts = {1: f"the a the a {long} {long} b {long}", 2: f"the a b b c {long}q", 3: "", 4: None, 5: f"the a {long} new {long}q NEW"}
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), F.col("doc_id") < 5).collect()}
    plain = {d: [*(t or "").lower().split(), None] for d, t in texts.items()}
    counts = Counter(w for d, x in plain.items() if d < 5 for w in x)
    n, v = sum(counts.values()), len(counts)
    for d, x in plain.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(x), sum(counts[w] > 0 for w in x), n)
        assert abs(got[d].base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in x)) < 1e-9
