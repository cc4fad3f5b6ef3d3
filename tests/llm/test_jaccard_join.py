import random
import re

import numpy as np
import pyarrow as pa

from matchup.llm import jaccard_join as m
from matchup.llm.shingles import apart, shingle_sets, wide_parities

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k=4):
    w = W.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "The", "the"]
    passage = rng.choices(vocabulary, k=70)
    docs = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 30, 120, 200]))
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w + (passage if g % 2 else [])))
    docs += [" ".join(rng.choices(vocabulary, k=20) + passage) for _ in range(30)]
    docs += ["a", "A", "a b", "a  B\n", "b a", "a b c", "a b c d", "a b c d a b c d", "", " \t", None, "x " * 20000, "x " * 500]
    return list(enumerate(docs)) + [(0, docs[0]), (500, docs[3])]


def test_matches_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in m.joined(frame).collect())
    assert got == brute(docs)


def test_order_decides_costs_only(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(m, "FREQUENT", 10)
    keys, counts = m.frequent(frame, 4)
    assert len(keys) <= 10 and (np.diff(keys.astype(float)) >= 0).all()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in m.joined(frame).collect())
    assert got == brute(docs)


def test_stage_and_empty(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int")
    rows = m.jaccard_stage(spark, frame, "")
    assert rows.columns == frame.columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted({d for d, _, c in brute(docs) if d == c})
    assert m.joined(frame.limit(0)).count() == 0
    assert m.jaccard_stage(spark, frame.limit(0), "").count() == 0


def test_hashes_follow_the_words():
    texts = ["a b", None, "", "Éa\x0bB c", "a b", "x" * 100, "ab"]
    sets = list(shingle_sets(pa.array(texts), 1))
    assert [len(s) for s in sets] == [2, 0, 0, 3, 2, 1, 1]
    assert sets[0].tolist() == sets[4].tolist()
    assert set(sets[3]) & set(sets[0]) == set(sets[0]) & set(next(shingle_sets(pa.array(["B"]), 1)))


def test_wide_parities_bound_what_two_sets_do_not_share(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n, m in [(1, 1), (500, 520), (1000, 1050), (2040, 2060), (4000, 4200), (3, 9000)]:
        grams = np.unique(rng.integers(1 << 63, size=n + m, dtype=np.uint64))
        for a, b in ((grams[:n], grams[n:]), (grams[:-3], grams[2:]), (grams, grams[: len(grams) // 5])):
            rows.append(([int(x) for x in wide_parities(a)], [int(x) for x in wide_parities(b)], len(np.setxor1d(a, b))))
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>, differ int")
    got = frame.select("differ", apart("x", "y").alias("xy"), apart("y", "x").alias("yx")).collect()
    assert all(r.xy == r.yx <= r.differ and (r.differ - r.xy) % 2 == 0 for r in got)
    assert all(r.xy == r.differ or r.differ > 4 for r in got)


def test_long_texts_are_compared_of_little_more_than_links(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    docs = [" ".join(base)]
    docs += [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (1000, 4000)]  # links
    docs += [" ".join(base[:4500] + [f"{i}v{rng.randrange(10**6)}" for _ in range(1500)]) for i in range(6)]  # 60 %
    compared, whole = [], m.partial
    monkeypatch.setattr(m, "partial", lambda pairs, parts: compared.append(pairs.count()) or whole(pairs, parts))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in m.joined(frame).collect())
    assert got == [(i, 0 if i < 3 else i) for i in range(9)]
    assert 0 < sum(compared) <= 6
