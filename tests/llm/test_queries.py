"""Every registered query of this folder on the smallest tables: all columns of its contract, worked out again in plain Python."""

import hashlib
from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import pytest

from sievemark.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.queries()[next(n for n in registry.queries() if n.startswith(f"{name}_"))](spark, SF).collect()


def words_of(text):
    return (text or "").encode().lower().split()


def test_op1(run, docs):
    got = run("op1")
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    by = defaultdict(list)
    for r in got:
        size = len((docs[r.doc_id] or "").encode()) + 16
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size, crc32((docs[r.doc_id] or "").encode()), "bytes", None)
        by[r.shard].append((r.slot, size))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(40))
    total, most = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(n for _, n in x) - total / 40) <= most for x in by.values())


def test_op2(run, docs):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    for r in run("op2"):
        n = len(library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), n, n > 512)


def test_op5(run, docs):
    got = run("op5")
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op6(run, docs):
    counts = Counter()
    for d, t in docs.items():
        if crc32(str(d).encode()) % 7 != 2:
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for r in run("op6"):
        x = [*words_of(docs[r.doc_id]), None]
        out = crc32(str(r.doc_id).encode()) % 7 == 2
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, len(x), sum(counts[w] > 0 for w in x), n)
        assert abs(r.base_score - sum(log10((counts[w] + 1) / (n + v + 1)) for w in x)) < 1e-6 and r.score < 0
        if out:
            held = [held[0] + r.score, held[1] + r.base_score]
    assert held[0] > held[1]  # the model is better than the base on texts that it hasn't seen


def test_op8(run, docs, spark):
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    bag = lambda w: Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    got = {(r.doc_id, r.item_id): r for r in run("op8")}
    for (d, i), r in got.items():
        own, item = bag(words_of(docs[d])[r.first_word : r.first_word + r.n_words]), bag(items[i])
        assert r.similarity >= 0.75 and abs(r.similarity - sum((own & item).values()) / sum((own | item).values())) < 1e-9
    for d, t in docs.items():
        text = b" ".join(words_of(t))
        assert all((d, i) in got for i, w in items.items() if w and b" " + b" ".join(w) + b" " in b" " + text + b" ")


def test_op9(run, docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    for r in run("op9"):
        x = (docs[r.doc_id] or "").split("\n")
        left = [y for y in x if not (len(key(y)) >= 20 and len(held[key(y)]) >= 3 and r.doc_id < max(held[key(y)]))]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(x), len(x) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())


def test_op10(run, docs):
    order = sorted(docs, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]]))
    got = {r.doc_id: r for r in run("op10")}
    prints = defaultdict(set)
    parts = lambda p: {x.split(":")[0] for x in p.split()}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for d, r in got.items():
        text, other = docs[d] or "", docs[following[d]] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(parts(r.fingerprint), parts(r.edited_fingerprint))) < 1e-9 and abs(r.near_next - like(parts(r.fingerprint), parts(got[following[d]].fingerprint))) < 1e-9
        prints[text].add(r.fingerprint)
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert set(got) == set(docs) and all(len(x) == 1 for x in prints.values())
