"""The corpus operators against brute force, SQL twins and round trips, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from citegrid.llm import decontam, line_dedup, packing, quality, queries, sharding, simhash, substring, toxicity, url_filter, warc
from citegrid.llm.common import table
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PHRASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n\x0b\x0c\r ", "en", "a", 7), (3, PHRASE + " end", "en", "a", 1),
    (4, "start " + PHRASE, "en", "a", 1), (5, PHRASE, None, "b", 1), (5, PHRASE, None, "b", 1), (None, PHRASE, "en", None, 1),
    (6, "a\u00a0b \u2028 ünï\nline\nline\n\n", "de", "b", 1), (7, ("x " * 3000).strip(), "en", "a", 1), (8, "w" * 100_000, "en", "a", 1),
    (9, " ".join(f"{w}{i % 7}" for i in range(20_000) for w in "ab"), "en", "a", 1), (10, "<|endoftext|> hi  there \n you're 12345", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = ", shard int, chunk string, host string, _score double, k int, fp long, rule string"
    return spark.createDataFrame([(*r, 1, "c", "h", 0.5, 3, 4, "r") for r in ODD], SCHEMA + extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


# packing


def tokens(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, texts, padding):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.ids_crc32 if r.doc_id in (5, None) else 0].append(r)
        by_seq[r.sequence_id].append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    for i, text in texts:
        ids = np.array(tokens(text), dtype="<u4")
        at = 0
        own = [r for (d, _), rs in by_doc.items() if d == i for r in rs]
        for start in sorted({r.start for r in own}):
            r = next(r for r in own if r.start == start)
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert 1 - sum(r.length for r in rows) / (1024 * len(by_seq)) < padding


def test_packing(spark, sf_dir, docs, odd, empty):
    rows = queries.op1_harmonic_packing(spark, sf_dir).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 0.03)
    from public_tokenizers import path

    check_packing(packing.pack(odd, path("byte_bpe_50k.json")).collect(), [(r[0], r[1]) for r in ODD], 1)
    assert packing.pack(empty, path("byte_bpe_50k.json")).count() == 0


def test_ids_are_those_of_tokenizers():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    end, rng = "<|endoftext|>", random.Random(1)
    texts = ["", end, end + " hi", "hi" + end, f"a {end} b", f"in{end}side{end}{end}", f" {end}\n\n z ", "<|endoftext |> <|endoftext|"]
    texts += ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "bc", "'s", "12", "!", "\u00e9", end, "\u00a0", "\u3000", "\x1d", "x y z"]) for _ in range(rng.randrange(12))) for _ in range(2000)]
    plain, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder(path("byte_bpe_50k.json"))
    for text in texts:
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_cut():
    for n in range(1, 3000):
        sizes = packing.cut(n)
        assert sum(sizes) == n and all(0 < s <= 1024 for s in sizes)


# decontamination


def plain_edits(item, text):
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(cost[j - 1] + (w != x), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def spoiled(rng, words, edits, fresh="zz"):
    """words after so many edits at different places: replaced, dropped, or with a word put in."""
    out = [[w] for w in words]
    for p in rng.sample(range(len(words)), edits):
        out[p] = rng.choice([[f"{fresh}{p}"], [], [words[p], f"{fresh}{p}"]])
    return [w for ws in out for w in ws]


def test_contamination_brute_force(spark, sf_dir):
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 8, 12, 20, 35, 50])))) for i in range(60)]
    rows = []
    for d in range(240):
        body = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(120))]
        if d % 2:
            part = items[d % 60][1].split()
            p = rng.randrange(len(body) + 1)
            body[p:p] = spoiled(rng, part, rng.randrange(decontam.allowed(len(part)) + 1))
        rows.append((d, " ".join(body), None, None, 0))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0)]
    got = decontam.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in got}
    want = {}
    for d, text, *_ in rows:
        for i, item in items:
            e = plain_edits(item.split(), (text or "").split())
            if e <= decontam.allowed(len(item.split())):
                want[d, i] = e
    assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.99 * len(want)


def found_in(items, texts):
    return {(m[0], m[1]) for m in decontam._found(items, texts)}


@pytest.mark.parametrize("shared", ["", "what is the "])
def test_contamination_recall_of_every_size(shared):
    """Items of 1 to 50 words with the full number of edits; also where all items begin with the same words."""
    rng, share = random.Random(8), {}
    for n in range(1, 51):
        if n < len(shared.split()) + 1:
            continue
        rows = [(i, " ".join([*shared.split(), *[f"v{rng.randrange(10**6)}" for _ in range(n - len(shared.split()))]])) for i in range(60)]
        items = decontam.Items(rows)
        texts = []
        for _, text in rows:
            around = [f"o{rng.randrange(50)}" for _ in range(20)]
            texts.append(" ".join([*around, *spoiled(rng, text.split(), decontam.allowed(n)), *around]))
        hit = found_in(items, texts)
        share[n] = sum((i, i) in hit for i in range(60)) / 60
    assert min(share.values()) >= 0.95 and np.mean(list(share.values())) >= 0.99, share


def test_contamination_of_a_common_run():
    """4,000 items and a text of 20,000 words full of their common words: whole results in bounded memory."""
    import tracemalloc

    rng = random.Random(2)
    rows = [(i, f"what is the {' '.join(f'v{rng.randrange(10**6)}' for _ in range(rng.choice([3, 5, 9])))}") for i in range(4000)]
    body = " ".join(f"what is the o{i % 97} x" for i in range(4000)).split()
    for k in range(0, 4000, 400):
        body[k * 5 : k * 5] = spoiled(rng, rows[k][1].split(), 1)
    items = decontam.Items(rows)
    tracemalloc.start()
    hit = found_in(items, [" ".join(body)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len({(0, k) for k in range(0, 4000, 400)} & hit) >= 9 and peak < 200 << 20


def test_contamination_in_pieces(monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 14, 30])))) for i in range(50)]
    body = [f"w{rng.randrange(3000)}" for _ in range(3000)]
    for i, (_, text) in enumerate(rows):
        at = rng.randrange(len(body))
        body[at:at] = spoiled(rng, text.split(), decontam.allowed(len(text.split())) * (i % 2))
    whole = sorted(decontam._found(decontam.Items(rows), [" ".join(body)]))
    monkeypatch.setattr(decontam, "GROUP_WORDS", 100)
    monkeypatch.setattr(decontam, "PIECE", 50)
    assert sorted(decontam._found(decontam.Items(rows), [" ".join(body)])) == whole and len(whole) > 40


def test_contamination_exact_leaks(spark, sf_dir, docs, empty, odd):
    found = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, sf_dir).collect()}
    items = table(spark, sf_dir, "benchmark").collect()
    for r in docs.collect():
        text = " " + " ".join(decontam.words_of(r.text)) + " "
        for i in items:
            if " " + " ".join(decontam.words_of(i.text)) + " " in text:
                assert (r.doc_id, i.item_id) in found
    items = spark.createDataFrame([(1, None), (2, ""), (3, PHRASE), (4, PHRASE)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contamination(odd, items).collect()} == {(d, i) for d in (3, 4, 5, None) for i in (3, 4)}
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).count() == 0
    left = decontam.clean(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 6, 7, 8, 9, 10]
    assert decontam.clean(odd, items.limit(0)).count() == len(ODD) and decontam.clean(empty, items).count() == 0


def test_contamination_beyond_one_block(spark, monkeypatch, docs, odd, sf_dir):
    items = table(spark, sf_dir, "benchmark").unionByName(spark.createDataFrame([(-1, "of"), (-2, None), (-3, PHRASE)], "item_id long, text string"))
    whole, left = sorted(map(tuple, decontam.contamination(docs, items).collect())), sorted(r.doc_id for r in decontam.clean(docs, items).collect())
    rest = sorted(map(str, decontam.clean(odd, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 20)
    monkeypatch.setattr(decontam, "PART_ROWS", 50)
    assert sorted(map(tuple, decontam.contamination(docs, items).collect())) == whole
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == left
    assert sorted(map(str, decontam.clean(odd, items).collect())) == rest


# toxicity


def auc(rows):
    ranks = {}
    ordered = sorted(rows)
    for i, (s, _) in enumerate(ordered):
        ranks.setdefault(s, []).append(i)
    pos = [np.mean(ranks[s]) for s, y in ordered if y]
    n, p = len(rows), len(pos)
    return (sum(pos) - p * (p - 1) / 2) / (p * (n - p))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [(r.score, r.toxic) for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert auc(held) > 0.9
    hits = [y for s, y in held if s >= 0.5]
    assert np.mean(hits) > 0.95 and sum(hits) > 0.85 * sum(y for _, y in held)
    found, there = Counter(), Counter()
    for r in rows:
        if r.held_out and r.toxic:
            there[r.lang] += 1
            found[r.lang] += r.predicted
    assert all(found[lang] >= 0.8 * n for lang, n in there.items()), (found, there)


def test_toxicity_needs_two_rows_of_each_class(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, "you idiot" if i == ids[0] else "a fine day") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in range(40)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="share of class 1"):
        scores = {r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert scores == {1 / len(ids)}


def test_features_are_what_they_say():
    codes = toxicity._Codes(frozenset({"grim"}), frozenset({"foul"}))
    out = dict(zip(toxicity.NAMES, toxicity.features_of("You ID1OT, that grim foulness is LOUD! now b4d, ok", codes)))
    n = 10
    assert (out["insults"], out["terms"], out["stems"], out["second_person"], out["near_second_person"]) == (1 / n, 1 / n, 1 / n, 1 / n, 3 / n)
    assert (out["capitals"], out["loud"], out["obfuscation"], out["punctuation"]) == (2 / n, 1 / n, 2 / n, 3 / n)
    assert toxicity.features_of(" \n ", codes) == [0.0] * len(toxicity.NAMES)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(2, 0, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(odd, labels).count() == len(ODD)
    assert toxicity.toxicity_scores(odd, labels.limit(0)).where("score = 0").count() == len(ODD)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


# substring dedup


def plain_substring(rows):
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    seen, out = set(), []
    for i, text in ordered:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(g)
        kept = b" ".join(x for x, y in zip(w, gone) if not y)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substring(spark, sf_dir, docs, odd, empty):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, sf_dir).collect())
    assert got == plain_substring([(r.doc_id, r.text) for r in docs.collect()])
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(odd).collect())
    assert got == plain_substring([(r[0], r[1]) for r in ODD])
    assert substring.substring_dedup(empty).count() == 0
    assert substring.substring_dedup(odd, with_text=True).where("n_removed > 0 AND kept_text = ''").count() == 2


# line dedup


def test_line_dedup_odd(spark, odd, empty):
    rows = [(i, f"boiler\nown {i}\n\nboiler", "en", "s" if i < 30 else None, 1) for i in range(36)] + [(99, None, "en", "s", 0)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[3]._line_dedup.text == "own 3\n" and out[3]._line_dedup.n_dropped == 2
    assert out[33]._line_dedup.text == "own 33\n" and out[99]._line_dedup.text is None
    assert line_dedup.drop_boilerplate(odd).count() == len(ODD)
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_line_dedup_shuffled_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    assert_same(queries.op5_line_dedup(spark, sf_dir), line_dedup.ORACLE, sf_dir)


# URL filter


def test_url_odd(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://example.com/en/8", "http://xexample.com/en/7", "http://sub.example.net/de/81", "http://a.net/de/1", "http://spam.test/p/#x", "https://SPAM.test/p"]
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, u in enumerate(urls)] + [(4, urls[4], "x", "clash")], "page_id long, url string, html string, host string")
    listed = spark.createDataFrame([("http://spam.test/p",), (None,)], "url string")
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).orderBy("page_id").collect()]
    assert [(i, v, r) for i, _, _, r, v in out] == [(0, "allow", None), (1, "allow", None), (2, "allow", None), (3, "allow", None), (4, "allow", "example.com/en/7"), (4, "allow", "example.com/en/7"), (5, "block", "com/en/"), (6, "block", "com/en/"), (7, "block", "example.net/de/8"), (8, "allow", "net/de/"), (9, "block", None), (10, "block", None)]
    assert out[4][1:3] == ("a.example.com", "/en/7x")
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0
    assert url_filter.url_filter(pages, listed.limit(0), ()).where("verdict = 'allow'").count() == len(urls) + 1


# SimHash


def plain_fingerprint(text):
    w = words((text or "").encode().lower().decode())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir, docs, odd, empty):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op7_simhash(spark, sf_dir).collect()}
    roots = plain_components(fps)
    assert got == {i: (fps[i], roots[i]) for i in fps}
    assert simhash.near_duplicates(empty).count() == 0
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and all(r.component_id == 0 for r in out if r.doc_id in (0, 1, 2))


@pytest.mark.parametrize("tile", [8, 1024])
def test_simhash_links(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    fps = {}
    for c in range(12):
        center = rng.getrandbits(64)
        for _ in range(40):
            x = center
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            fps[len(fps)] = x
    uniq = {}
    for i, x in fps.items():
        uniq.setdefault(x, i)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for x, i in uniq.items()], "id long, fp long")
    got = {r.id: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    roots = plain_components({i: x for x, i in uniq.items()})
    assert {i: got.get(i, i) for i in roots} == roots


def test_components_of_a_path(spark):
    ids = list(range(60))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


# WARC


def test_warc(spark, sf_dir):
    import base64

    pages = table(spark, sf_dir, "pages")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(9001, None, None), (9002, "http://a b\n/é", ""), (9003, "u", "same"), (9004, "u", "same"), (9004, "u", "same"), (9005, "http://x/", "HTTP/1.1 200\r\n\r\nnot a head"), (None, "u", "same")]
    made = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        other = largest[h or ""] if i is None or i < largest[h or ""] else None
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if other is None else "revisit", other] += 1
    assert Counter(tuple(r) for r in warc.archive_round_trip(made).collect()) == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = b"HTTP/1.0 200 OK\r\n\r\nhello\n\nworld"
    line = warc._arc_line("http://old site/x y", "1.2.3.4", "text/html", version, "f", 9, "-", len(body))
    data = warc.arc_start("f", version) + (line + body + b"\n") * 3
    out = list(warc.read_arc(iter([data[i : i + 7] for i in range(0, len(data), 7)])))
    assert len(out) == 3 and all(r["url"] == "http://old%20site/x%20y" and r["block"] == body and r["date"] == "1997-01-01T00:00:00Z" for r in out)
    with pytest.raises(ValueError):
        list(warc.read_arc(iter([data[:-5]])))
    assert len(list(warc.read_arc(iter([data[:-5]]), salvage=True))) == 2


@pytest.mark.parametrize(
    ("line", "url", "ip", "date", "kind"),
    [
        (b"http://x/ 1.2.3.4 19991231235959 text/html; charset=utf-8 %d", "http://x/", "1.2.3.4", "1999-12-31T23:59:59Z", "text/html; charset=utf-8"),
        (b"http://x/a b?c=1 2 1.2.3.4 199912312359 text/html;charset=x %d", "http://x/a%20b?c=1%202", "1.2.3.4", "1999-12-31T23:59:00Z", "text/html; charset=x"),
        ("http://x/caf\u00e9".encode("latin-1") + b" 1.2.3.4 19991231 text/plain %d\r", "http://x/caf\u00e9", "1.2.3.4", "1999-12-31T00:00:00Z", "text/plain"),
        ("http://x/caf\u00e9".encode() + b" ::1 19991331000000 text/plain %d", "http://x/caf\u00e9", "::1", "1997-01-01T00:00:00Z", "text/plain"),
        (b"http://x/ - 1999 text/plain %d", "http://x/", "-", "1997-01-01T00:00:00Z", "text/plain"),
        (b"http://x/ 0.0.0.0 -  %d", "http://x/", "0.0.0.0", "1997-01-01T00:00:00Z", "no-type"),
    ],
)
def test_arc_lines(line, url, ip, date, kind):
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    out = list(warc.read_arc(iter([warc.arc_start("f", 1) + line % len(body) + b"\n" + body + b"\n"])))
    assert out == [{"url": url, "ip": ip, "date": date, "content_type": kind, "block": body}]
    second = warc.parse_line(b"http://x/ 1.2.3.4 19991231235959 text/html; charset=utf-8 200 abc - 77 f.arc 12", 2)
    assert second == {"url": "http://x/", "ip": "1.2.3.4", "date": "19991231235959", "content_type": "text/html; charset=utf-8", "length": 12}


def test_arc_without_sense():
    start = warc.arc_start("f", 1)
    for bad in (b"", b"http://x/ 1.2.3.4 19991231235959 text/html\n", b"http://x/ 19991231235959 text/html 5\nhello"):
        with pytest.raises(ValueError):
            list(warc.read_arc(iter([(start if bad else b"http://x/ 0.0.0.0 1 a 1\n") + bad])))
    assert warc.iso_date("", "x") == "x" and warc.iso_date("2000") == warc.UNDATED


def test_plain_and_gzip_archives(tmp_path):
    import gzip

    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    data = warc.arc_start("f", 1) + (warc._arc_line("http://x/", "1.2.3.4", "text/html", 1, "f", 9, "-", len(body)) + body + b"\n") * 3
    (tmp_path / "a.arc").write_bytes(data)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "c.arc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    for name in ("a.arc", "b.arc.gz", "c.arc.gz"):
        assert [r["block"] for r in warc.read_arc(warc._chunks(f"file://{tmp_path}", name))] == [body] * 3


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4097])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    out = [r.p for r in spark.range(n).select(F.expr(sharding.permuted("id", n)).alias("p")).collect()]
    assert sorted(out) == list(range(n))
    assert n < 17 or out != list(range(n))


def plain_place(spark, number, n, seed=42):
    """The permutation by its definition: rounds of a Feistel network on pairs, walked on until the place is below n."""
    from pyspark.sql import functions as F

    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))

    def round_hash(x, i):
        if (x, i) not in hashes:
            row = spark.range(1).select(F.expr(f"xxhash64({x}L, {i}, {seed}L)").alias("h")).first()
            hashes[x, i] = row.h
        return hashes[x, i]

    hashes, place = {}, number
    while True:
        left, right = divmod(place, b)
        for i in range(sharding.ROUNDS):
            if i % 2:
                right = (right + round_hash(left, i) % b) % b
            else:
                left = (left + round_hash(right, i) % a) % a
        place = left * b + right
        if place < n:
            return place


def test_permutation_is_a_walked_feistel_network(spark):
    from pyspark.sql import functions as F

    for n in (7, 11):
        got = [r.p for r in spark.range(n).select(F.expr(sharding.permuted("id", n)).alias("p")).collect()]
        assert got[:4] == [plain_place(spark, i, n) for i in range(4)]


def test_sharding(spark, sf_dir, docs, odd, empty):
    for source, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, [(r[0], r[1]) for r in ODD])):
        out = sharding.shard_rows(source).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r.row_number, r.shard, r.slot) for r in sharding.shard_rows(docs.repartition(3)).collect()}
    assert again == {(r.row_number, r.shard, r.slot) for r in sharding.shard_rows(docs).collect()}
    assert sharding.shard_rows(empty).count() == 0


# quality


def test_quality_odd(spark, odd, empty):
    rows = {r.doc_id: r for r in quality.quality_filter(odd).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert rows[7].n_repeat_words == 3000 and rows[6].n_dup_lines == 1 and rows[3].kept
    assert rows[6].word_chars == len("a\u00a0b\u2028ünïlineline")
    assert quality.quality_filter(empty).count() == 0


def test_quality_of_long_texts(spark, docs, monkeypatch):
    """With the limit lowered, texts go the way of long ones, and nothing changes."""
    from citegrid.llm import text_kernels

    order = list(quality.RULES)
    whole = sorted(map(tuple, quality.cascade(docs, order).collect()))
    texts = [r.text or "" for r in docs.limit(60).collect()] + ["", "x", "a b " * 40]
    monkeypatch.setattr(text_kernels, "PIECE", 200)
    for text in texts:
        t, plain = quality.Text(text), (text.encode().split())
        monkeypatch.setattr(quality, "PIECE", 100)
        assert (t.n, t.counts[1], t.counts[2]) == (len(plain), len(set(plain)), max(Counter(plain).values(), default=0))
        assert [w.encode() for w in t.words()] == plain
        assert quality.long_repeat_words(text.encode()) == int(quality.repeat_words([text.encode()])[0])
        monkeypatch.setattr(quality, "PIECE", 1 << 20)
    assert len(whole) == docs.count()


def test_rules_are_measured_on_what_passes_the_base(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 2 else "too short", "en", "s", 1) for i in range(100)]
    out = {m.name: m for m in quality.measure(spark.createDataFrame(rows, SCHEMA), {"short": lambda t: t.n < 30, "all": lambda t: True})}
    assert out["short"].rejected == 0 and out["all"].rejected == 1


def test_cascade_order(odd):
    measured = [quality.Measured("slow", 1.0, 0.5), quality.Measured("fast", 0.1, 0.5), quality.Measured("idle", 0.1, 0.0)]
    assert quality.ordered(measured) == ["fast", "slow", "idle"]
    base = {(r.doc_id, r.kept) for r in quality.cascade(odd, list(quality.RULES)).collect()}
    assert base == {(r.doc_id, r.kept) for r in quality.cascade(odd, list(quality.RULES)[::-1]).collect()}
