import random

import numpy as np

from matchup.llm import mixing as m


def brute(w, p, targets, anchor, steps=20000):
    """Plain projected gradient in numpy, until it stands still."""
    total = w.sum()
    r = np.ones(len(w))
    b = np.array(list(targets.values())) * total
    for _ in range(steps):
        gap = ((w * r) @ p - b) / total
        r = np.maximum(0, r - (p @ gap + anchor * (r - 1)) / (1 + anchor))
    return r


def test_rates_match_numpy(spark):
    rng = np.random.default_rng(5)
    n, targets = 400, {"a": 0.6, "b": 0.1, "c": 0.3}
    w, p = rng.integers(0, 2000, n), rng.dirichlet([0.3, 0.3, 0.3], n)
    table = spark.createDataFrame([(i, int(w[i]), *map(float, p[i])) for i in range(n)], "id long, tokens long, p_a double, p_b double, p_c double")
    got = m.fitted(m.staged(table, "t"), targets, steps=100).orderBy("id").toPandas()
    want = brute(w.astype(float), p, targets, m.ANCHOR)
    assert (got.rate >= 0).all()
    assert np.abs(got.rate - want)[w > 0].max() < 0.02
    totals = ((w * got.rate.to_numpy()) @ p) / w.sum()
    assert np.abs(totals - list(targets.values())).max() < 0.03


def corpus(spark):
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        kind = rng.choice(["clean", "clean", "toxic", "low"])
        own = {"clean": good, "toxic": bad, "low": ["###", "!!!", "zz"]}[kind]
        docs.append((i, " ".join(rng.choices(own + ["the", "of"], k=rng.randint(5, 80))), kind))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    docs += [(1000, None, "x"), (1001, "", "x"), (0, docs[0][1], docs[0][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_classifier_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = m.mixed(docs.select("doc_id", "text"), m.domains_of(labels), m.TARGETS).join(docs.select("doc_id", "rate").distinct().withColumnRenamed("rate", "kind"), "doc_id").toPandas()
    held = rows[(rows.doc_id % 2 == 0) & (rows.doc_id < 400)]
    best = held[["p_clean", "p_low", "p_toxic"]].idxmax(axis=1).str[2:]
    assert (best == held.kind).mean() > 0.95
    shares = [(rows.tokens * rows.rate * rows[f"p_{d}"]).sum() / rows.tokens.sum() for d in m.TARGETS]
    assert np.abs(np.array(shares) - list(m.TARGETS.values())).max() < 0.05
    assert rows[rows.kind == "clean"].copies.min() >= 1


def test_edges(spark):
    docs, labels = corpus(spark)
    only = docs.select("doc_id", "text")
    assert m.mixed(only.limit(0), m.domains_of(labels), m.TARGETS).count() == 0
    rows = m.mixed(only, m.domains_of(labels.limit(0)), m.TARGETS).collect()
    assert len(rows) == docs.count() and max(abs(r.p_low - 1 / 3) for r in rows) < 1e-9
    assert {r.copies for r in m.mixed(only.where("doc_id = 1000"), m.domains_of(labels), m.TARGETS).collect()} == {1}


def test_stage_repeats_by_copies(spark, tmp_path):
    docs, labels = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = m.mixing_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = m.mixed(docs.select("doc_id", "text"), m.domains_of(labels), m.TARGETS).groupBy("doc_id").agg({"copies": "sum"}).collect()
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {r.doc_id: r["sum(copies)"] for r in want if r["sum(copies)"]}
