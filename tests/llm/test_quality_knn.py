import random
import zlib

import numpy as np
import pyarrow as pa

from matchup.llm import quality_knn as m


def corpus(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = rng.choices(words, k=rng.randint(30, 120))
        kind = rng.random()
        if kind < 0.1:
            w = [x.upper() + "!!" for x in w]
        elif kind < 0.2:
            w = [x + rng.choice(["###", "%%%"]) for x in w]
        elif kind < 0.3:
            w = [x for x in w[:6] for _ in range(12)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind >= 0.3), 0))
    extra = [(1000, None), (1001, ""), (1002, "x"), (1003, "é " * 50000), (0, docs[0][1])]
    return spark.createDataFrame(docs + extra, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_range(spark):
    docs, labels = corpus(spark)
    rows = m.scored(docs, m.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.dropna().collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_blocked_products_match_brute_force(spark):
    docs, labels = corpus(spark)
    model = m.fit(docs.limit(80), labels)
    block = next(m.term_counts(pa.array(["some words here", "", "SOME!! WORDS!!"])))
    got = model.scores(block)
    for x, s in zip(block, got):
        v = (x * model.weights) @ model.axes
        if np.linalg.norm(v) < 1e-9:
            assert abs(s - model.labels.mean()) < 1e-9
            continue
        cos = [float(v / np.linalg.norm(v) @ u) for u in model.vectors]
        near = sorted(range(len(cos)), key=lambda k: -cos[k])[: m.NEIGHBOURS]
        w = [max(cos[k], 0) ** m.SHARPNESS for k in near]
        assert abs(s - sum(a * model.labels[k] for a, k in zip(w, near)) / sum(w)) < 1e-3


def test_no_labels_and_empty(spark):
    docs, labels = corpus(spark)
    assert {r.score for r in m.scored(docs.limit(5), m.fit(docs.limit(5), labels.limit(0))).collect()} == {1.0}
    assert m.scored(docs.limit(0), m.fit(docs.limit(0), labels)).count() == 0
