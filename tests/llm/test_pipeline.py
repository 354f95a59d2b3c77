"""Each stage of the pipeline on its own input, against plain versions."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from citegrid.llm import decontam, toxicity
from citegrid.llm.common import table, written
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_operators import ODD, check_packing, empty, odd  # noqa: F401


def test_stages(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")

    clean = written(stages["toxicity"](spark, docs, sf_dir), "t")
    assert clean.columns == docs.columns
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, p in scored.items() if not p}

    lined = written(stages["line_dedup"](spark, clean, sf_dir), "l")
    rows, pages, hosts = clean.collect(), Counter(), Counter()
    for r in rows:
        hosts[r.source] += 1
        pages.update({(r.source, x) for x in r.text.split("\n") if x.split()})
    gone = {k for k, n in pages.items() if n > 1 and n > 0.1 * hosts[k[0]]}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in gone) for r in rows}
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.columns == docs.columns

    single = written(stages["near_dedup"](spark, lined, sf_dir), "n")
    assert sorted(r.doc_id for r in single.collect()) == plain_kept(want)

    kept = written(stages["decontamination"](spark, single, sf_dir), "d")
    items = [" ".join(decontam.words_of(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    left = {r.doc_id: " ".join(decontam.words_of(r.text)) for r in kept.collect()}
    assert not any(f" {i} " in f" {t} " for i in items for t in left.values())
    dropped = {r.doc_id: r.text for r in single.collect() if r.doc_id not in left}
    matched = {r.doc_id for r in decontam.contamination(single, table(spark, sf_dir, "benchmark")).collect()}
    assert set(dropped) == matched and kept.columns == docs.columns

    packed = stages["packing"](spark, kept, sf_dir).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in kept.collect()], 0.05)
    assert defaultdict(int, Counter(r.doc_id for r in packed)).keys() == left.keys()


#: What stays of ODD in each stage that drops rows: word-less texts are near copies of each other, and so are 3 to 5 (16 of
#: 17 or 18 shingles); rows without an id stay.
KEPT = {"line_dedup": [r[0] for r in ODD], "near_dedup": [None, 0, 3, 6, 7, 8, 9, 10]}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, sf_dir, odd, empty, name):  # noqa: F811
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, and a table without rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out, none = stage(spark, odd, sf_dir), stage(spark, empty, sf_dir)
    assert none.count() == 0
    if name == "packing":
        check_packing(out.collect(), [(r[0], r[1]) for r in ODD], 1)
        return
    assert out.columns == odd.columns and none.columns == empty.columns
    rows = out.collect()
    ids = sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)
    if name in KEPT:
        assert ids == sorted(KEPT[name], key=lambda i: -1 if i is None else i)
    else:
        assert Counter(ids) <= Counter(r[0] for r in ODD) and {0, 1, 2} <= set(ids)
    # Two of the three pages of source b are equal: their line is boilerplate.
    left = [(r[0], "" if name == "line_dedup" and r[0] == 5 else r[1]) for r in ODD]
    assert Counter((r.doc_id, r.text) for r in rows) <= Counter(left)


def test_decontamination_of_rows_without_id(spark, odd, tmp_path):  # noqa: F811
    spark.createDataFrame([(1, ODD[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, odd, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [0, 1, 2, 6, 7, 8, 9, 10]
