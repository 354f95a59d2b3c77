"""Vector codes, periodic runs and BPE against brute force and the tokenizers library, and on odd input."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from citegrid.llm import bpe, periodic, queries, vector_codes
from citegrid.llm.common import table
from tests.llm.test_operators import ODD, empty, odd  # noqa: F401

# vector codes


def plain_codes(rows, kind=object):
    """What op11's contract says, over rows (id, vector, label); kind object: with Python's integers."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0], r[1]))
    points = np.array([[math.floor(1024 * x) for x in r[1]] for r in ok], dtype=kind)
    parts = np.split(points, 4, axis=1)
    books = [part[:256].copy() for part in parts]

    def near(p):
        away = ((parts[p][:, None, :] - books[p][None, :, :]) ** 2).sum(axis=2)
        found = away.argmin(axis=1)
        return found, away[np.arange(len(found)), found]

    for _ in range(4):
        for p in range(4):
            found, _ = near(p)
            for e in range(len(books[p])):
                if (found == e).any():
                    books[p][e] = parts[p][found == e].sum(axis=0) // int((found == e).sum())
    last = [near(p) for p in range(4)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(int(last[p][1][j]) for p in range(4)) for j in range(len(ok))]
    by_label = {}
    for r, e in zip(ok, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted((r[0], "".join(f"{last[p][0][j]:02x}" for p in range(4)), error[j], by_label[r[2]], sha) for j, r in enumerate(ok))


def test_vector_codes_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf_dir, "embeddings").collect()]
    assert sorted(map(tuple, queries.op11_vector_codes(spark, sf_dir).collect())) == plain_codes(rows, np.int64)


def vectors(rng, n):
    """Clusters, copies, ties and wide numbers, with rows that are dropped."""
    rows = []
    for i in range(n):
        center = rng.choice([-3.0, 0.0, 0.5, 2.0])
        v = [round(center + rng.gauss(0, 0.2), rng.choice([0, 1, 5])) for _ in range(8)]
        rows.append((i, list(rows[-1][1]) if rows and rng.random() < 0.2 and rows[-1][1] else v, rng.choice([1, 2, None])))
    rows[3] = (3, None, 1)
    rows[5] = (5, [1.0, None] + [0.0] * 6, 1)
    rows[7] = (7, [float("nan")] + [0.0] * 7, 1)
    rows[9] = (9, [float("-inf")] + [0.0] * 7, 2)
    return rows


@pytest.mark.parametrize("scale", [1.0, 300_000.0, 1e9])
def test_vector_codes_of_clusters(spark, monkeypatch, scale):
    """Small blocks and leaves, so that whole nodes are assigned; numbers whose squares do not fit 64 bits."""
    monkeypatch.setattr(vector_codes, "BLOCK", 100)
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v], label) for i, v, label in vectors(random.Random(7), 400)]
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, part int").repartition(3)
    out = sorted(map(tuple, vector_codes.compressed_vectors(made).collect()))
    want = plain_codes(rows)
    held = lambda e: min(e, vector_codes.LONG_MAX)
    assert out == [(i, c, held(e), held(total), sha) for i, c, e, total, sha in want]


def test_whole_nodes_are_assigned():
    """Far clusters: cached sums serve all points, and nothing is left for the leaves."""
    rng = np.random.default_rng(3)
    points = (np.repeat(np.arange(4), 256)[:, None] * 10_000 + rng.integers(0, 9, (1024, 4))).astype(np.int64)
    book = vector_codes.Book(np.arange(4)[:, None] * 10_000 + np.zeros((1, 4), dtype=np.int64), False)
    points = points[vector_codes.tree_order(points, 16)]
    tree = vector_codes.tree_over(points, 16)
    whole, left, _ = vector_codes.assign(points, tree, book)
    assert len(left) == 0 and sum(tree.end[n] - tree.start[n] for n, _ in whole) == 1024 and len(whole) <= 8
    sums, count = vector_codes.entry_sums(points, tree, book)
    assert count.tolist() == [256] * 4 and (sums == [points[points[:, 0] // 10_000 == k].sum(axis=0) for k in range(4)]).all()


@pytest.mark.parametrize("n, entries", [(1, 1), (7, 3), (300, 256), (1000, 200)])
def test_trees_assign_as_brute_force(n, entries):
    rng = np.random.default_rng(n)
    points, codes = rng.integers(-5, 6, (n, 3)), rng.integers(-5, 6, (entries, 3))
    points = points[vector_codes.tree_order(points, 16)]
    found = vector_codes.nearest_entries(points, vector_codes.tree_over(points, 16), vector_codes.Book(codes, False))
    assert (found == ((points[:, None] - codes[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_vector_codes_odd(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compressed_vectors(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compressed_vectors(spark.createDataFrame([(None, [0.0] * 4, 1), (1, [], 1), (2, [1.0] * 3, 1)], schema)).count() == 0
    rows = [(5, [1.0, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, 3.0, 4.0], None), (5, [0.0] * 4, 1), (None, [9.0] * 4, None), (8, [1.0] * 8, 1)]
    out = sorted(((r.vec_id or 0, r.code, r.error, r.label_error) for r in vector_codes.compressed_vectors(spark.createDataFrame(rows, schema)).collect()))
    # The entries begin as 0 and twice 1, 2, 3, 4, of which the first gets all; with 9 its mean moves away, and the second keeps the pair.
    assert out == [(0, "01010101", 0, 0), (5, "00000000", 0, 0), (5, "02020202", 0, 0), (5, "02020202", 0, 0)]


# periodic runs


def plain_runs(w, least=24, times=3):
    out = []
    for d in range(1, len(w)):
        i = d
        while i < len(w):
            if w[i] != w[i - d]:
                i += 1
                continue
            start = i - d
            while i < len(w) and w[i] == w[i - d]:
                i += 1
            block = w[start:i]
            if len(block) >= max(least, times * d) and not any(block[e:] == block[:-e] for e in range(1, d)):
                out.append((start, len(block), d))
    return sorted(out)


def run_words(rng):
    n, k = rng.randrange(160), rng.choice([1, 2, 2, 3, 5, 50])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n >= 30:
            a = rng.randrange(n)
            p, end = 1 + rng.randrange(max(1, (n - a) // 3)), rng.randrange(a, n + 1)
            for i in range(a, end):
                w[i] = w[a + (i - a) % p]
    return [str(x).encode() for x in w]


def test_runs_are_brute_force():
    rng, total = random.Random(3), 0
    for _ in range(400):
        w = run_words(rng)
        want = plain_runs(w)
        assert periodic.find_runs(w) == want and (not want or periodic.has_seeds([b" ".join(w)], periodic.seed_words())[0])
        total += len(want)
    assert total > 100
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    fib = [x.encode() for x in b]
    assert periodic.find_runs(fib) == plain_runs(fib) and len(plain_runs(fib)) > 20


def test_other_bounds():
    rng = random.Random(9)
    for least, times in ((10, 2), (12, 4), (30, 2)):
        for _ in range(150):
            w = run_words(rng)
            assert periodic.find_runs(w, least, times) == plain_runs(w, least, times)


def test_long_runs_cost_little():
    """One word, one period, and a passage in a thousand places: none keeps a diagonal for each pair of places."""
    words = [b"x"] * 200_000
    assert periodic.find_runs(words) == [(0, 200_000, 1)]
    words = [b"%d" % (i % 30_000) for i in range(100_000)]
    assert periodic.find_runs(words) == [(0, 100_000, 30_000)]
    rng = random.Random(2)
    passage = [b"p%d" % i for i in range(40)]
    words = [w for _ in range(1000) for w in (*passage, *[b"q%d" % rng.randrange(10**9)] * rng.randrange(1, 5))]
    assert periodic.find_runs(words) == []


def plain_report(rows):
    out = []
    for doc, text in rows:
        w, n = (text or "").encode().split(), len((text or "").encode().split())
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out.append((doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(left)))
    return sorted(out, key=str)


def test_periodic_runs_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect() if len(r.text.split()) < 400]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == table(spark, sf_dir, "documents").count() and sorted((got[i] for i, _ in rows), key=str) == plain_report(rows)


def test_periodic_runs_odd(spark, odd, empty):  # noqa: F811
    out = [tuple(r) for r in periodic.run_report(periodic.with_planted_runs(odd)).collect() if r.doc_id != 9]
    assert sorted(out, key=str) == plain_report([r[:2] for r in ODD if r[0] != 9])
    rows = {r.doc_id: r for r in periodic.periodic_runs(odd).collect()}
    assert rows[0].runs == [] and rows[0].collapsed == "" and [tuple(r) for r in rows[7].runs] == [(0, 3000, 1)] and rows[7].collapsed == "x" and rows[7].chunk == "c"
    assert [tuple(r) for r in rows[9].runs] == [(0, 40_000, 14)] and len(rows[9].collapsed.split()) == 14
    assert periodic.run_report(empty).count() == 0
    clash = spark.createDataFrame([(1, "y " * 30, 5)], "doc_id long, text string, Runs int")
    assert [tuple(r) for r in periodic.periodic_runs(clash).first().runs] == [(0, 30, 1)]


# BPE


@pytest.fixture(scope="module")
def library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return path("word_bpe_49k.json"), Tokenizer.from_file(path("word_bpe_49k.json"))


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


TEXTS = [
    "", " \t\n ", "Hello world's <|endoftext|>x<|startoftext|> a\x1cb \x85 ünï Å İİ ΣΑΣ", "x" * 5000, "ab" * 3000, "a b c　d e ", "̇ ̇a", "can't we'll I'VE 'S ''s", "１２３ ²³ ٣ 4567", "😀👍🏽 漢字かな",
    "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "\x00\x01", "ẞ ŉ ﬁ Å", "-" * 300, "é" * 700,
]


def test_bpe_is_the_library(library, monkeypatch):
    path, t = library
    model, rng = bpe.Model(path), random.Random(1)
    pool = [chr(c) for c in range(1, 0x250)] + [chr(rng.randrange(0x300, 0x3000)) for _ in range(300)] + list("aeinorst '.,-\n\t ") * 40
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(2500)] + ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 90))) for _ in range(1000)]
    for cached, held in ((250_000, 1 << 19), (6, 100)):
        monkeypatch.setattr(bpe, "CACHED", cached)
        monkeypatch.setattr(bpe, "GROUP_BYTES", held)
        some = texts if cached > 6 else texts[:300]
        for text, ids in zip(some, model.encode(some), strict=True):
            want = t.encode(text, add_special_tokens=False).ids
            assert unpacked(ids) == want and model.decode([ids])[0] == t.decode(want, skip_special_tokens=False)


def test_trees_merge_lowest_rank_leftmost_first():
    """Random merges, by rows of a matrix and by single trees, against a search of all pairs at each step."""
    rng = random.Random(5)
    for _ in range(40):
        symbols, pairs, made = 4, [], []
        for _ in range(rng.randrange(1, 12)):
            pair = rng.randrange(symbols), rng.randrange(symbols)
            if pair not in pairs:
                pairs.append(pair)
                made.append(symbols)
                symbols += 1
        known = bpe.Pairs(pairs, made, symbols)
        words = [[rng.randrange(4) for _ in range(rng.randrange(1, 80))] for _ in range(30)]

        def plain(word):
            word = list(word)
            while ranked := [(pairs.index(p), i) for i, p in enumerate(zip(word, word[1:])) if p in pairs]:
                rank, i = min(ranked)
                word[i : i + 2] = [made[rank]]
            return word

        want = [plain(w) for w in words]
        assert [unpacked(x) for x in bpe.merged_words(words, known)] == want and [bpe.merged(w, known) for w in words] == want


def test_bpe_of_the_table(spark, sf_dir, library):
    path, t = library
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_bpe_round_trip(spark, sf_dir).collect()}
    want = {}
    for r in table(spark, sf_dir, "documents").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want[r.doc_id] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert got == want


def test_bpe_odd(spark, odd, empty, library):  # noqa: F811
    path, t = library
    rows = bpe.decode(bpe.encode(odd, path), path).select("*", bpe.id_count(bpe.F.col("ids")).alias("n")).collect()
    assert len(rows) == len(ODD) and all(r.chunk == "c" for r in rows)
    for r in rows:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert (unpacked(r.ids), r.n, r.decoded) == (want, len(want), t.decode(want, skip_special_tokens=False))
    assert bpe.round_trip(empty, path).count() == 0
    gone = spark.createDataFrame([(1, None), (2, bytearray(struct.pack("<3I", 1, 99_999_999, 2)))], "doc_id long, ids binary")
    assert [r.decoded for r in bpe.decode(gone, path).orderBy("doc_id").collect()] == [None, '" #']
    with pytest.raises(ValueError):
        from public_tokenizers import path as place

        bpe.Model(place("byte_bpe_50k.json"))


# toxicity, word by word


def plain_word(word):
    """What a word is: without edges and case, and with the signs that stand for letters."""
    import re
    import string

    edge = lambda x: re.sub(r"^\W+|\W+$", "", x)
    low = edge(word.lower())
    plain = edge("".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, "" if c in "*-_." else c) for c in word.lower()))
    signs = set(string.digits) | set("@$*!_.")
    hidden = any(i and word[i - 1].isalpha() and (j := next((j for j in range(i, len(word)) if word[j] not in signs), len(word))) < len(word) and word[j].isalpha() for i in range(len(word)) if word[i] in signs)
    drawn = any(low[i].isalnum() | (low[i] == "_") and low[i : i + 4] == low[i] * 4 for i in range(len(low) - 3))
    return low, plain, hidden or drawn


def plain_features(text, words, stems):
    from citegrid.llm import toxicity as X

    n, rows = len(text.split()), []
    for w in text.split():
        low, plain, odd_word = plain_word(w)
        rows.append((low in X.INSULTS or plain in X.INSULTS, low in words or plain in words, any(low[:k] in stems for k in (4, 5, 6)), low in X.SECOND_PERSON, len(low) > 1 and w.isupper(), w[-1] in "!?", odd_word, any(c in ".,;:!?" for c in w)))
    if not n:
        return [0.0] * len(X.NAMES)
    total = [sum(r[i] for r in rows) for i in range(8)]
    near = sum(any(r[:3]) and any(rows[j][3] for j in range(max(0, i - X.NEAR), min(n, i + X.NEAR + 1))) for i, r in enumerate(rows))
    log = math.log1p
    return [total[0] / n, total[1] / n, total[2] / n, log(total[1]), log(total[2]), total[3] / n, near / n, total[4] / n, total[5] / n, total[6] / n, log(n), total[7] / n]


def test_toxicity_features_are_the_plain_ones(spark, sf_dir):
    from citegrid.llm import toxicity

    texts = ["", "You IDIOT, go!", "st*pid yoooou 1d10t ... u.s a_b !!", "DU Trottel? " * 30, "é3é x1 1x a1b a.b. you"] + [r.text for r in table(spark, sf_dir, "documents").limit(60).collect()]
    words, stems = frozenset(["erst", "thean", "idiot"]), frozenset(["tion", "troll", "ander"])
    codes = toxicity._Codes(words, stems)
    for text in texts:
        assert toxicity.features_of(text, codes) == pytest.approx(plain_features(text, words, stems), abs=1e-12)


def test_toxicity_terms_are_the_plain_ones(spark):
    """Terms of each fold's lexicon, counted row by row over texts of few words."""
    from citegrid.llm import toxicity

    rng = random.Random(8)
    rows = []
    for i in range(240):
        toxic = int(i % 6 == 0)
        text = " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "tempor", "zzz" if toxic else "sit", "grumpf" if toxic and rng.random() < 0.7 else "elit", f"rare{i}"]) for _ in range(14))
        rows.append((text, toxic, i % 4))
    found = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    for left, lexicon in zip((0, 1, 2, 3, None), found, strict=True):
        used, terms = [r for r in rows if r[2] != left], {}
        for text, toxic, _ in used:
            for term in {("w", w) for w in text.split() if len(w) > 2} | {("s", w[:n]) for w in text.split() for n in (4, 5, 6) if len(w) > n}:
                terms.setdefault(term, [0, 0])[toxic] += 1
        ones = sum(r[1] for r in used)
        share = ones / len(used)
        kept = set()
        for term, (other, toxic) in terms.items():
            lift = ((toxic + 0.1) / (ones + 1)) / ((other + 0.1) / (len(used) - ones + 1))
            chance = (toxic + other) * share
            if toxic >= toxicity.SUPPORT and lift >= toxicity.LIFT and toxic - chance >= toxicity.DEVIATIONS * math.sqrt(chance * (1 - share) + 0.25):
                kept.add(term)
        assert kept and (set(lexicon[0]), set(lexicon[1])) == ({t for k, t in kept if k == "w"}, {t for k, t in kept if k == "s"})


# gaps of earlier rounds


def test_full_bins_hold_as_many_pieces_as_their_class(spark, sf_dir):
    """All sequences but one a class at most hold k pieces of class k (1024 div length)."""
    from collections import defaultdict

    rows = queries.op1_harmonic_packing(spark, sf_dir).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(1024 // r.length)
    classes = {k for ks in bins.values() for k in ks}
    mixed = [ks for ks in bins.values() if len(set(ks)) > 1 or len(ks) != ks[0]]
    assert len(mixed) <= len(classes) < len(bins) and sum(len(ks) > 1 for ks in bins.values()) > 10


def test_bloom_filter_loses_no_key(spark):
    from citegrid.llm import url_filter

    keys = spark.range(3000).selectExpr("concat('k', id) AS key").cache()
    blooms, blocks = url_filter.bloom_blocks(keys, 3000)
    probes = spark.range(60_000).selectExpr("concat('k', id) AS key", "id")
    passed = url_filter.possible(probes, blooms, blocks)
    ids = {r.id for r in passed.collect()}
    assert set(range(3000)) <= ids and 3000 < len(ids) < 3600  # some that are not listed pass, and the join takes them out
    assert {r.id for r in passed.join(keys, "key").collect()} == set(range(3000))
    none, n = url_filter.bloom_blocks(keys.limit(0), 0)
    assert url_filter.possible(probes, none, n).count() == 0
