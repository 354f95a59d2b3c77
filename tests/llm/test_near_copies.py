"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from citegrid.llm import near_copies
from citegrid.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(texts):
    """Smallest ids of the components of pairs at 0.8 or more."""
    sets, root = {i: plain_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in ids})


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def copies(rng):
    """Texts of 1 to 400 words with copies of 0 to 20 edits, around the bound on both sides, and one hot run of words."""
    texts, hot = [], " ".join(f"hot{i}" for i in range(6))
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 5, 6, 12, 40, 150, 300, 400])))
        texts.append(f"{base} {hot}" if rng.random() < 0.5 else base)
        texts += [edited(rng, texts[-1], rng.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])) for _ in range(rng.randrange(5))]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_pairs_share_a_key():
    """Sets at similarity 0.8 share a key in all but 5 of a million cases; unlike ones seldom do."""
    rng = np.random.default_rng(4)
    near = far = 0
    for _ in range(1500):
        base = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        a, b = base[:81], base[9:]  # 72 of 90
        near += shares_key(a, b)
        far += shares_key(base[:54], base[36:])  # 18 of 90
    assert near == 1500 and far < 15


def shares_key(a, b):
    keys = [set(near_copies.bands_of(near_copies.minima(x)).tolist()) for x in (a, b)]
    return not keys[0].isdisjoint(keys[1])


def test_sketches_tell_alike_from_unlike():
    """At 0.8 nearly all pairs of sketches pass, at 0.42 none."""
    rng = np.random.default_rng(5)
    near = far = 0
    for _ in range(1500):
        base = rng.integers(0, 1 << 63, 355, dtype=np.uint64)
        for a, b, close in ((base[:320], base[35:], True), (base[:250], base[105:], False)):  # 285 of 355, 145 of 355
            pair = np.frombuffer(b"".join(near_copies.sketch_of(near_copies.minima(x)) for x in (a, b)), dtype=np.uint64).reshape(2, -1)
            passed = int(near_copies.alike(pair, np.array([0]), np.array([1]))[0])
            near, far = near + close * passed, far + (not close) * passed
    assert near >= 1495 and far == 0


def test_shared_text_ships_nothing(spark):
    """4,000 texts that share 150 of 250 words (Jaccard 0.42): common keys, but no family."""
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(150))
    texts = [f"{shared} " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(100)) for _ in range(4000)]
    marked = near_copies.marks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    nodes = marked.selectExpr("doc_id as id", "doc_id as comp", "bands", "sketch").cache()
    # Where all minima of a key lie in the shared words, the texts have it in common.
    assert nodes.selectExpr("explode(bands) as key").groupBy("key").count().where("count > 20").count() > 20
    assert near_copies.families(nodes).count() == 0


def kept_by_stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    return sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect())


def test_stage_is_brute_force(spark, monkeypatch):
    texts = copies(random.Random(11))
    assert kept_by_stage(spark, texts) == plain_kept(texts)
    monkeypatch.setattr(near_copies, "PART", 4)
    texts = copies(random.Random(12))
    assert kept_by_stage(spark, texts) == plain_kept(texts)


def test_stage_on_given_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert kept_by_stage(spark, texts) == plain_kept(texts)
