"""The pipeline's stages, each on what its predecessor kept, against brute force."""
from collections import Counter

import corpus_pipeline as CP
from finlex.llm import common, packing, pii_crf, simhash_pigeonring, wordpiece_count, wu_manber
from finlex.llm.queries import tokenizer_file
from finlex.sources.tables import table
from tests.llm.conftest import SF
from tests.llm.test_operators import components_by_hand
from tests.llm.test_units import base_by_pattern, stats_by_hand


def test_stages_follow_each_other(spark):
    assert [n for n, _ in CP.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]
    common.prepare(spark)
    docs = table(spark, SF, "documents")
    columns, results = docs.columns, []
    for name, stage in CP.STAGES:
        docs = common.materialize(stage(spark, docs, SF), name)
        results.append(docs)
    quality, near, clean, masked, packed = results
    for df in (quality, near, clean, masked):
        assert df.columns == columns

    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in quality.collect()}
    for k, t in texts.items():
        n, _, _, _, repeats = stats_by_hand(t)
        if n < 10 or 100 * repeats > 20 * n:
            assert k not in kept
        elif labels.get(k) == 1:
            assert k in kept  # clean documents stay

    root = components_by_hand({k: simhash_pigeonring.fingerprint(texts[k].encode()) for k in kept}, 2)
    one = {r.doc_id for r in near.collect()}
    assert one == set(root.values())

    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert left == {k for k in one if not wu_manber.brute_force(texts[k], items)[4]}

    out = {r.doc_id: r for r in masked.collect()}
    assert set(out) == left
    for k in left:
        assert not base_by_pattern(out[k].text) and (out[k].text == texts[k] or any(f"[{x.upper()}]" in out[k].text for x in pii_crf.KINDS))
        assert base_by_pattern(texts[k]) or out[k].text == texts[k]

    automaton = wordpiece_count.Automaton(wordpiece_count.vocabulary(tokenizer_file("piece_bpe_32k.model")))
    n, filled = Counter(), Counter()
    for r in packed.collect():
        n[r.doc_id] += r.n_tokens
        filled[r.bin_id] += r.n_tokens
    assert n == {k: 1 + sum(automaton.count(wordpiece_count.START + w) for w in out[k].text.encode().split()) for k in left}
    assert max(filled.values()) <= packing.CAPACITY
    assert {r.doc_id for r in CP.run(spark, SF).collect()} == left
