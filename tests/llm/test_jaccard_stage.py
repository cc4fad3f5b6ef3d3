import corpus_pipeline

STAGE = dict(corpus_pipeline.STAGES)["jaccard_join"]


def numbered(start, n=100, changed=()):
    return " ".join(f"x{i}" if i in changed else f"w{start + i}" for i in range(n))


def test_near_copies_by_five_words_and_a_similarity_of_80_percent(spark):
    # 5-word shingles: 86 of 106 shared (0.811); 4-word ones: 89 of 105 (0.848).
    rows = [(1, numbered(0)), (2, numbered(0, changed=(30, 60))), (3, numbered(500)), (4, numbered(500, changed=(20, 50, 80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in STAGE(spark, docs, "").collect()) == [1, 3, 4]


def test_one_row_of_a_group_stays_with_null_and_shared_ids(spark):
    near = [numbered(0), numbered(0, changed=(50,)), numbered(0, changed=(70,))]
    rows = [(None, near[0]), (None, near[1]), (7, near[2])]  # nulls after a known id
    rows += [(5, numbered(200)), (5, numbered(200, changed=(40,)))]  # two texts under one id
    rows += [(None, numbered(400)), (None, numbered(400, changed=(10,))), (None, numbered(400))]  # nulls alone, one row twice
    rows += [(8, numbered(600)), (8, numbered(800)), (None, None), (9, "")]  # linked with nothing
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in STAGE(spark, docs, "").collect()]
    assert len(got) == 7 and (7, near[2]) in got
    assert sum(d == 5 for d, _ in got) == 1 and sum(d == 8 for d, _ in got) == 2
    assert sum(d is None and (t or "").startswith("w400 ") for d, t in got) == 1
    assert (None, None) in got and (9, "") in got
