"""The pipeline's stages on a small table with planted cases."""

from __future__ import annotations

import corpus_pipeline
from common import documents, prose

from probelens.llm.store import written

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_and_keeps_the_rest(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    passage, clean = prose(77, 60), [prose(i, 90) for i in range(20)]
    near = clean[0].split()
    near[5] = "changed"
    rows = [(i, t) for i, t in enumerate(clean)] + [
        (50, clean[1]), (51, " ".join(near)), (52, prose(60, 30) + " " + passage), (53, passage + " " + prose(61, 30)), (54, prose(62, 40) + "\n" + item), (55, "123 456"), (56, None),
    ]
    docs = written(documents(spark, rows), "docs")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    everything = dict(rows)
    assert set(everything) - set(kept["language"]) == {55, 56}
    assert set(kept["language"]) - set(kept["near_duplicates"]) == {50, 51}
    assert kept["passages"] == kept["near_duplicates"] | {53: prose(61, 30)}
    assert set(kept["passages"]) - set(kept["benchmark"]) == {54}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == set(kept["benchmark"])


def test_stages_follow_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "passages", "benchmark", "packing"]


def test_stages_equal_brute_force_on_their_own_input(spark):
    """Whole documents of the smallest tables; the language stage may only drop texts without a letter or unsure ones."""
    from test_dedup import brute_components, brute_contamination, brute_repeats
    from test_packing import check
    from tokenizers import Tokenizer

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert after == {d: before[d] for d in after} and len(after) >= 0.97 * len(before)
        if name == "near_duplicates":
            assert after == {d: before[d] for d, _, c in brute_components(list(before.items())) if c == d}
        if name == "passages":
            removed = {d: (n, k) for d, n, k, _ in brute_repeats(sorted(before.items()))}
            assert set(after) == {d for d, (n, k) in removed.items() if not k or k < n}
            assert all(after[d] == before[d] if not removed[d][1] else len(after[d].split()) == removed[d][0] - removed[d][1] for d in after)
        if name == "benchmark":
            clean = {int(d) for d, _, hit, _ in brute_contamination(list(before.items()), items) if not hit}
            assert after == {d: before[d] for d in clean}
        before = after
    tokenizer = Tokenizer.from_file(corpus_pipeline.packing.word_bpe())
    tokenizer.encode_special_tokens = True
    whole = lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids
    check(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), list(before.items()), whole, 2048)
