"""Each operator against brute force on one fixture with nulls, empty and long texts, copies and ties."""

import hashlib
import random
import unicodedata
import re
from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from sievemark.llm import components, decontamination, language_model, line_dedup, minhash, packing, passages, quality, sharding, splitters, token_counts, winnowing, words

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"


def words_of(t):
    return (t or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs, *names):
    return docs.select("*", *[F.lit(f"old {n}").alias(n) for n in names])


def test_shards(docs, texts, empty):
    got = sharding.shard(clashing(docs, "size", "shard", "slot", "k9"), shards=7).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text is not None) == sorted((d, t) for d, t in texts if t is not None)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.size == len((r.text or "").encode()) + 16 and r.k9 == "old k9"
    assert all(sorted(x.slot for x in rows) == list(range(len(rows))) for rows in by.values())
    sizes = [sum(x.size for x in by.get(s, [])) for s in range(7)]
    assert max(sizes) - sum(sizes) / 7 <= 20100
    assert sharding.shard(empty, shards=3).count() == 0


def test_a_third_of_all_rows_is_one_text_and_some_rows_repeat(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(800)] + [(5, "same text")] * 3 + [(None, "x"), (None, None)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 8 and max(r.b for r in got) <= 1.1 * min(r.b for r in got)


def test_splitters_count_exactly(spark, rng):
    keys = [(rng.choice([-(1 << 63), 0, 5, rng.getrandbits(62)]), rng.getrandbits(60), rng.randint(1, 50)) for _ in range(2000)]
    cut = splitters.find(spark.createDataFrame(keys, "k1 long, k2 long, size long"), 9, 0.01)
    for s in cut.found:
        below = [k for k in keys if k[:2] < (s.k1, s.k2)]
        assert (s.rows, s.size) == (len(below), sum(k[2] for k in below))


@pytest.mark.parametrize("kind", ["byte_bpe_50k.json"])
def test_token_counts(docs, texts, empty, kind):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(kind))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(clashing(docs, "n_tokens"), public_tokenizers.path(kind)).collect()}
    assert got == {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in texts}
    assert token_counts.token_counts(empty, public_tokenizers.path(kind)).count() == 0


def test_token_cuts_on_odd_strings(rng):
    c = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    alphabet = [*"ab ABÉß'st12 \n\t\r .,!<|>漢字́\xa0\x85\x1c😀İ½", "<|endoftext|>", " 's", " don't", "\n\n", "   "]
    for _ in range(3000):
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        assert c(s) == len(c.library.encode(s, add_special_tokens=False).ids)
        assert e(s) == np.array(e.library.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_round_trip(docs, texts, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing.Encoder(path)
    pieces = packing.token_pieces(docs, path, capacity=256).cache()
    packed = packing.pack(pieces, capacity=256)
    rows = packed.collect()
    of_doc = defaultdict(dict)
    for r in rows:
        of_doc[r.doc_id][r.piece] = bytes(r.ids)
        assert r.length == len(r.ids) // 4 <= 256 and r.start == 256 * r.piece
    assert {d: b"".join(p[k] for k in sorted(p)) for d, p in of_doc.items()} == {d: encode(t or "") + np.array([1], "<u4").tobytes() for d, t in texts}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= sum(r.length for r in rows) / 256 * 1.1 + 1
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert whole == {s: sum(n for _, n in held) for s, held in by.items()}
    assert packing.pack(packing.token_pieces(empty, path), 4096).count() == 0


def test_pack_lengths_places_everything(rng):
    for _ in range(300):
        cap = rng.choice([10, 50, 100])
        counts = Counter(rng.choices(range(1, cap + 1), k=rng.randint(0, 300)))
        got = Counter()
        for n, held in packing.pack_lengths(counts, cap):
            assert n > 0 and sum(held) <= cap and sum(x > cap / 3 for x in held) <= 2
            for x in held:
                got[x] += n
        assert got == counts


def shingles(t):
    w = words_of(t)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted((d, len(s), min(least[root(i)]), d == min(least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_near_groups(docs, texts, empty):
    got = sorted(tuple(r) for r in minhash.groups(clashing(docs, "set_key", "n_shingles", "kept")).collect())
    assert got == brute_groups(texts)
    assert minhash.groups(empty).count() == 0


def test_near_groups_of_many_chained_copies(spark, rng):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for p in rng.sample(range(60), rng.randint(0, 3)):
            w[p] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in minhash.groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_groups(rows)


def test_keep_one_with_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words entirely are in here"), (None, None), (None, "q r s t u v w")]
    kept = minhash.keep_one(clashing(spark.createDataFrame(rows, SCHEMA), "kept", "n")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (-1, "q r s t u v w"), (1, "a b c d e f g"), (3, "other words entirely are in here")]


def test_sketch_estimates_similarity(rng):
    for n, common in ((3, 2), (40, 30), (1000, 600)):
        miss = []
        for k in range(60):
            x = words.mix(np.arange(k * 10_000, k * 10_000 + n, dtype=np.uint64))
            y = words.mix(np.arange(k * 10_000 + n - common, k * 10_000 + 2 * n - common, dtype=np.uint64))
            a, b = minhash.sketch(x), minhash.sketch(y)
            assert (a != np.uint64(2**64 - 1)).all()
            miss.append((a == b).mean() - common / (2 * n - common))
        assert abs(np.mean(miss)) < 0.03


def test_components(spark, rng):
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_repeated_passages(docs, texts, empty):
    for length in (50, 64):
        who = defaultdict(set)
        w = {d: words_of(t) for d, t in texts}
        for d, x in w.items():
            for k in range(len(x) - length + 1):
                who[tuple(x[k : k + length])].add(d)
        want = set()
        for d, x in w.items():
            marks = [k for k in range(len(x) - length + 1) if len(who[tuple(x[k : k + length])]) > 1]
            runs = []
            for k in marks:
                if runs and k <= runs[-1][1] + length:
                    runs[-1][1] = k
                else:
                    runs.append([k, k])
            want |= {(d, a, b - a + length) for a, b in runs}
        got = {(r.doc_id, r.first_word, r.n_words) for r in passages.repeated(clashing(docs, "places", "n"), length).collect()}
        assert got == want and want
    assert passages.repeated(empty).count() == 0


def test_repeated_passages_of_a_document_with_a_copied_and_another_text(spark):
    rng, length = random.Random(9), 50
    some = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    copied, shared, inner = some(120), some(60), some(55)
    rows = [(1, copied), (5, copied), (5, f"{some(150)} {shared} {some(20)}"), (7, f"{some(40)} {shared} {some(20)}")]
    rows += [(20, f"{some(9)} {inner} {some(9)}"), (20, f"{some(30)} {inner}"), (30, some(100)), (30, some(80)), (9, "short"), (8, "short")]
    rows += [(21, rows[4][1]), (21, f"{some(9)} {inner} {some(9)}"), (40, f"{some(3)} {copied} {some(200)}")]
    who, want = defaultdict(set), set()
    for d, t in rows:
        x = words_of(t)
        for k in range(len(x) - length + 1):
            who[tuple(x[k : k + length])].add(d)
    for d in {d for d, _ in rows}:
        marks = {k for e, t in rows if e == d for x in [words_of(t)] for k in range(len(x) - length + 1) if len(who[tuple(x[k : k + length])]) > 1}
        runs = []
        for k in sorted(marks):
            if runs and k <= runs[-1][1] + length:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        want |= {(d, a, b - a + length) for a, b in runs}
    got = {(r.doc_id, r.first_word, r.n_words) for r in passages.repeated(spark.createDataFrame(rows, SCHEMA), length).collect()}
    assert got == want and {(5, 150, 60), (7, 40, 60)} <= want


def test_leaks(spark, docs, texts, empty, rng):
    near = texts[2][1].split()[20:60]
    near[17] = "altered"
    items = [(1, " ".join(texts[0][1].split()[5:35])), (2, " ".join(near)), (3, "one two three"), (4, None), (5, ""), (6, " ".join(rng.choices("qwertyuiop", k=30)))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def bag(w):
        return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])

    want = set()
    for d, t in texts:
        w = words_of(t)
        for i, s in items:
            b = words_of(s)
            if b and w:
                scores = [(sum((bag(w[k : k + len(b)]) & bag(b)).values()) / max(1, sum((bag(w[k : k + len(b)]) | bag(b)).values())), -k) for k in range(max(1, len(w) - len(b) + 1))]
                if max(scores)[0] >= 0.75:
                    want.add((d, i, -max(scores)[1], round(max(scores)[0], 9)))
    got = {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in decontamination.leaks(clashing(docs, "item_id"), bench).collect()}
    assert got == want and len(want) >= 4
    left = {r.doc_id for r in decontamination.clean(docs, bench).collect()}
    assert left == {d for d, _ in texts} - {x[0] for x in want}
    numbered = bench.withColumn("item_id", F.col("item_id").cast("int"))
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, numbered).collect()} == {x[:2] for x in want}
    named = bench.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, named).collect()} == {(d, f"i{i}") for d, i, *_ in want}
    unnamed = spark.createDataFrame([(None, texts[0][1]), (None, "nothing of the kind"), (None, None)], SCHEMA)
    assert {r.text for r in decontamination.clean(unnamed, bench).collect()} == {"nothing of the kind", None}
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def brute_lines(rows, least=20, times=3):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = set()
    for d, t in rows:
        x = (t or "").split("\n")
        kept = [y for y in x if not (len(key(y)) >= least and len(held[key(y)]) >= times and d < max(held[key(y)]))]
        out.add((d, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(docs, texts, empty):
    got = line_dedup.dedup(clashing(docs, "n_lines", "n_dropped", "k1"))
    assert {(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()} == brute_lines(texts)
    assert line_dedup.dedup(empty).count() == 0


def test_line_ingest_drops_what_came_before(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    a = spark.createDataFrame([(1, "first shared line, long\nonly here in the one"), (2, "first shared line, long")], SCHEMA)
    b = spark.createDataFrame([(3, "FIRST shared line, long \nsomething new and quite long"), (4, None)], SCHEMA)
    assert [r.text for r in runs.ingest(a).orderBy("doc_id").collect()] == ["first shared line, long\nonly here in the one", ""]
    assert [r.text for r in runs.ingest(b).orderBy("doc_id").collect()] == ["something new and quite long", None]
    assert len(runs.levels[0]) == 0 and len(runs.levels[1]) == 1


def units_of(t):
    """Runs of letters or of digits; other visible characters and those of scripts without spaces by themselves."""
    kind = lambda c: None if c in " \t\n\x0b\x0c\r" else "one" if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", c) else "a" if unicodedata.category(c)[0] in "LM" else "1" if unicodedata.category(c)[0] == "N" else "one"
    out, before = [], None
    for c in t:
        k = kind(c)
        if k in ("a", "1") and k == before:
            out[-1] += c
        elif k:
            out.append(c)
        before = k
    return out


def brute_print(t):
    prime, base = (1 << 31) - 1, 1_000_003
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    u = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) % prime for x in units_of(t or "")]
    width = winnowing.K
    while width > 1 and len(u) < width:
        width //= 2
    grams = []
    for i in range(max(0, len(u) - width + 1)):
        h = 0
        for x in u[i : i + width]:
            h = (h * base + x) % prime
        grams.append(h)
    out = {}
    for i in range(max(1, len(grams) - winnowing.W + 1) if grams else 0):
        own = grams[i : i + winnowing.W]
        out[(min(own), i + max(k for k, x in enumerate(own) if x == min(own)))] = None
    return list(out)


def test_winnowing(docs, texts, empty):
    got = winnowing.with_fingerprint(docs, "text", "p").select("doc_id", winnowing.as_text(F.col("p")).alias("p")).collect()
    assert {r.doc_id: r.p for r in got} == {d: " ".join(f"{h:x}:{p}" for h, p in brute_print(t)) for d, t in texts}
    assert winnowing.with_fingerprint(empty, "text", "p").count() == 0


def test_fingerprints_of_short_and_unspaced_texts_are_near_after_an_edit(spark):
    rng = random.Random(4)
    chinese = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(3000))
    code = "".join(rng.choice("abcdefgh0123456789+/=") for _ in range(3000))
    short = "one two three four five six seven eight nine ten eleven"
    rows = [(1, chinese, chinese[:2000] + chinese[:1000]), (2, code, code[:2000] + code[:1000]), (3, short, " ".join(short.split()[:8]) + " x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, changed string")
    both = winnowing.with_fingerprint(winnowing.with_fingerprint(df, "text", "a"), "changed", "b")
    got = {r.doc_id: r.s for r in both.select("doc_id", winnowing.likeness(winnowing.hashes(F.col("a")), winnowing.hashes(F.col("b"))).alias("s")).collect()}
    assert got[1] > 0.6 and got[2] > 0.6 and got[3] > 0



@pytest.mark.parametrize("parts", [1, 4, 30])
def test_next_document(spark, docs, texts, empty, parts):
    got = {r.doc_id: r.next_text for r in winnowing.with_next(docs, ["text"], parts).collect()}
    order = sorted(texts, reverse=True, key=lambda r: r[0])
    assert got == {d: order[(i + 1) % len(order)][1] for i, (d, _) in enumerate(order)}
    assert winnowing.with_next(empty, ["text"], parts).count() == 0
    some = winnowing.with_next(spark.createDataFrame([(7, "a"), (7, "a"), (None, "z")], SCHEMA), ["text"], parts).collect()
    assert len(some) == 3


def test_edited():
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([("abcdefg", "xyz"), ("", "q"), ("ab", "q"), ("éßç漢字x", "I")], "t string, n string")
    assert [r.e for r in df.select(winnowing.edited(F.col("t"), F.col("n")).alias("e")).collect()] == ["abcdexy", "", "ab", "éßç漢I"]


def test_language_model(spark, docs, texts, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r.doc_id: r for r in language_model.score(clashing(docs, "word", "n", "lp"), ~held).collect()}
    counts, w = Counter(), {d: [*words_of(t), None] for d, t in texts}
    for d, x in w.items():
        if crc32(str(d).encode()) % 7 != 2:
            counts.update(x)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for d, x in w.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(counts[y] > 0 for y in x), n)
        assert abs(r.base_score - sum(log10((counts[y] + 1) / (n + v + 1)) for y in x)) < 1e-6
        assert r.score < 0
    assert language_model.score(empty, F.lit(True)).count() == 0
    none = language_model.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in none)


def test_spelling_is_a_distribution():
    tables = np.zeros((language_model.ORDERS, 1 << language_model.SLOT_BITS), np.float32)
    weights, refined = np.full((language_model.GATES, language_model.INPUTS), 0.25), np.zeros((2, 8, language_model.REFINE))
    one = [bytes([b]) for b in range(256) if b != 32]
    total = (10.0 ** language_model.log10_spelled([b"", *one], tables, weights, refined)).sum()
    assert total <= 1.0001


def test_frequent_and_rare_words_meet_their_counts_alike(docs, monkeypatch):
    whole = {r.doc_id: r.base_score for r in language_model.score(docs, F.lit(True)).collect()}
    monkeypatch.setattr(language_model, "HEAD", 3)
    assert all(abs(r.base_score - whole[r.doc_id]) < 1e-6 for r in language_model.score(docs, F.lit(True)).collect())


def test_words_are_scored_by_the_words_before_them(spark):
    rng = random.Random(5)
    follows = {f"w{i}": (f"w{(7 * i + 3) % 60}", f"w{(11 * i + 5) % 60}") for i in range(60)}

    def walk():
        out = [f"w{rng.randrange(60)}"]
        while len(out) < 100:
            out.append(follows[out[-1]][rng.randrange(2)])
        return out

    walks = [walk() for _ in range(260)]
    rows = [(i, " ".join(w)) for i, w in enumerate(walks)]
    rows += [(1000 + i, " ".join(rng.sample(w, len(w)))) for i, w in enumerate(walks[200:])]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") < 200).collect()}
    for i in range(60):
        assert abs(got[200 + i].base_score - got[1000 + i].base_score) < 1e-6 and got[200 + i].score > got[1000 + i].score + 20
    assert sum(got[200 + i].score for i in range(60)) > 0.6 * sum(got[200 + i].base_score for i in range(60))


def coded_texts(rng):
    coder = language_model.Coder([b"w%d" % i for i in range(50)], np.array([rng.randint(1, 900) for _ in range(50)]), 7, 3, 16)
    some = np.random.default_rng(3)
    tables = [some.normal(0, 2, n).astype(np.float32) for n in coder.slots]
    texts = [[b"w%d" % rng.randrange(55) for _ in range(n)] for n in (3, 0, 700, 40, 1, 2500)]
    return coder, tables, texts


def test_codes_of_words_are_a_distribution(rng):
    coder, tables, _ = coded_texts(rng)
    _, contexts, _, _ = coder.tokens([[b"w3", b"w3", b"other"]], coder.index())
    for at in range(4):
        every = np.arange(coder.copy + 1)
        same = np.repeat(contexts[:, at : at + 1], len(every), axis=1)
        total = (10.0 ** language_model.log10_coded(every, same, every, coder, tables)).sum()
        assert abs(total - 1) < 1e-4


def test_mixing_learns_as_a_plain_loop_does(rng):
    """Every bit by itself, in plain Python, in each text by itself."""
    coder, tables, texts = coded_texts(rng)
    symbols, contexts, starts, _ = coder.tokens(texts, coder.index())
    got = language_model.log10_coded(symbols, contexts, starts, coder, tables)
    bounds = [int(x) for x in language_model.STRETCHES]
    start = language_model.start_weights().astype(float)
    for first, end in zip(starts, [*starts[1:], len(symbols)]):
        weights, came, learned = start.copy(), Counter(), []
        for i in range(first, end):
            if i - first in bounds:
                sums, n = np.zeros_like(weights), Counter(g for g, *_ in learned)
                for g, x, error, cell in learned:
                    sums[:, g] += np.array(x) * error
                    came[cell] += 1
                for g, m in n.items():
                    weights[:, g] += language_model.RATE * sums[:, g] / (m + language_model.INERTIA)
                learned = []
            total = 0.0
            _, depth, bit, place = coder.bits(symbols[i : i + 1], contexts[:, i : i + 1])
            for k in range(len(bit)):
                x = [float(t[p[k]]) for t, p in zip(tables, place)] + [0.3]
                g = int(depth[k]) * 4 + (x[1] != 0) * 2 + (x[2] != 0)
                mixed = min(12.0, max(-12.0, float(weights[:, g] @ x)))
                p = 1 / (1 + np.exp(-mixed))
                cell = (int(depth[k]), min(16, max(-16, round(mixed * 2))))
                zeros, ones = came[(*cell, 0)], came[(*cell, 1)]
                fine = (p + (ones + language_model.TRUST * p) / (zeros + ones + language_model.TRUST)) / 2
                total += log10(max(fine if bit[k] else 1 - fine, 1e-9))
                learned.append((g, x, int(bit[k]) - p, (*cell, int(bit[k]))))
            assert abs(total - got[i]) < 0.02 + 0.002 * abs(total), i
    alone = [language_model.log10_coded(*coder.tokens([t], coder.index())[:3], coder, tables).sum() for t in texts]
    assert np.allclose(alone, np.add.reduceat(got, starts), rtol=1e-6)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, docs):
    scores = []
    for parts in (1, 7):
        dealt = docs.repartition(parts, F.xxhash64("text", "doc_id"))
        scores.append({r.doc_id: r.score for r in language_model.score(dealt, F.col("doc_id") % 5 != 2).collect()})
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[1][d] - s) < 1e-6 for d, s in scores[0].items())


def test_quality(spark, rng, docs, empty):
    from .conftest import sentence

    rows = [(i, sentence(rng, 60) if i % 4 else " | ".join(["junk !!"] * 40)) for i in range(400)]
    labels = [(i, int(i % 4 != 0)) for i in range(300)] + [(1, 1), (9999, 1), (None, 0), (5, None)]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scored(clashing(df, "score", "quality"), lab, F.col("doc_id") % 3 != 0).collect()}
    assert len(got) == 400 and all((s >= 0.7) == bool(i % 4) for i, s in got.items())
    kept = quality.keep(clashing(df, "score"), lab, F.lit(True))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4} and "score" in kept.columns
    assert quality.scored(docs, lab, F.lit(True)).count() == docs.count()
    assert quality.scored(empty, lab, F.lit(True)).count() == 0
    assert len({r.score for r in quality.scored(df, lab.limit(0), F.lit(True)).collect()}) == 1


def test_word_hashes_follow_words(rng):
    seen = {}
    texts = ["".join(rng.choices(["a", "B", "b", "É", " ", "\n", "\x1c", "\t", "xyz"], k=rng.randint(0, 40))).encode() for _ in range(500)]
    found, at = words.hashes(texts)
    for i, t in enumerate(texts):
        w = t.lower().split()
        assert at[i + 1] - at[i] == len(w)
        for x, h in zip(w, found[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_many_parts_over_one_key(spark):
    """1,500 parts that all cut through the copies of one text."""
    from sievemark.llm import scratch

    keys = spark.range(20_000).select(F.lit(5).cast("long").alias("k1"), F.xxhash64("id").alias("k2"), F.lit(10).cast("long").alias("size"))
    keys = scratch.table(keys, "keys")
    cut = splitters.find(keys, 1500, 0.001)
    sizes = {r.p: r.n for r in cut.part(keys, "k1", "k2", "p").groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 1500 and sum(sizes.values()) == 20_000 and max(sizes.values()) <= 15


WORKING = ["k1", "k2", "_part", "_row", "_cell", "_base", "_own", "_text", "_lines", "_ends", "_gone", "_pos", "_bucket", "_rank", "_n", "_before", "_range", "_copy", "_shadow", "_first", "_to", "_held", "_keeper", "c0", "c1", "c2", "_t_v", "_t_g", "a.b"]


def test_columns_with_working_names_pass_unchanged(spark, texts):
    rows = [(d, t) for d, t in texts if d < 130 or d in (130, 131, 132, 140, 141)] + [(0, texts[0][1])]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), *WORKING)
    old = tuple(f"old {n}" for n in WORKING)
    same = lambda out: all(tuple(r[n] for n in WORKING) == old for r in out)
    got = sharding.shard(df, shards=3).collect()
    assert len(got) == len(rows) and same(got)
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(rows) and same(got)
    got = winnowing.with_next(winnowing.with_fingerprint(df, "text", "t"), ["text", "t"]).collect()
    assert len(got) == len(rows) and same(got)
    got = minhash.keep_one(df).collect()
    assert same(got) and len({r.doc_id for r in got}) == len(got)
    pieces = df.select("doc_id", *[f"`{n}`" for n in WORKING], F.lit(0).alias("piece"), (F.col("doc_id") % 50 + 1).cast("long").alias("length"), F.lit("x").alias("offset"))
    got = packing.pack(pieces).collect()
    assert len(got) == len(rows) and same(got) and all(isinstance(r.offset, int) for r in got)


def test_held_out_texts_change_no_training_score(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 6)
    docs = [(i, " ".join(f"w{j % (i + 3)}" for j in range(40))) for i in range(12)]

    def scores(held):
        df = spark.createDataFrame([*docs, (100, held)], SCHEMA)
        return {r.doc_id: (r.base_score, r.score, r.n_known) for r in language_model.score(df, F.col("doc_id") < 100).collect() if r.doc_id < 100}

    assert scores("zz zz zz yy yy yy w1") == scores("w5 w6 w7 w8 w9 " * 50)


def test_tables_summed_in_two_levels_give_the_same(spark, monkeypatch, texts):
    df = spark.createDataFrame(texts[:60], SCHEMA).repartition(12)
    once = {r.doc_id: r.score for r in language_model.score(df, F.lit(True)).collect()}
    monkeypatch.setattr(language_model, "SUMMED", 2)
    monkeypatch.setattr(language_model, "TASK_TOKENS", 100)
    assert {r.doc_id: r.score for r in language_model.score(df, F.lit(True)).collect()} == once
