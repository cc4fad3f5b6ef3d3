from collections import Counter, defaultdict

import corpus_pipeline
from matchup.llm import packing
from matchup.llm.common import read, staged

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        assert docs.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        kept[name] = docs.count()
    assert 0 < kept["jaccard_join"] <= kept["line_dedup"] <= kept["quality_rules"] < 200 + 1
    rows = packing.packing_stage(spark, docs, SF).collect()
    have = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in rows if r.piece == 0) == have
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_run_is_the_registered_query(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__doc__ == corpus_pipeline.run.__doc__
    assert {f"op{n}_" for n in range(1, 11)} == {f"{q.split('_')[0]}_" for q in __spark_entry__.queries() if q.startswith("op")}
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
