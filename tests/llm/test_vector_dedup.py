import numpy as np

from matchup.llm import vector_dedup as m


def brute(rows):
    n = len(rows)
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, lab in rows]
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.float32(rows[k][1]).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(i), root(j)
                    parent[max(p, q)] = min(p, q)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[root(i)], rows[i][0] == least[root(i)]) for i in range(n))


def vectors(rng, n=300, dim=32):
    base = rng.standard_normal((n, dim))
    rows = []
    for k in range(n):
        v = base[k % 40] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.1]) if k % 2 else base[k]
        rows.append((k, (v * rng.uniform(0.5, 3)).astype(np.float32).tolist(), int(k % 40 % 3)))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)  # several blocks a bucket
    rng = np.random.default_rng(4)
    rows = vectors(rng)
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None, 1.0], 1), (904, [], 1), (905, rows[1][1], None), (906, rows[1][1], 1), (906, rows[1][1], 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [float("inf"), 1.0], 0), (910, [1e-30] * 32, 2), (911, [2e-30] * 32, 2)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(4)
    got = {}
    for r in m.near_vectors(frame).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    want = brute(rows)
    links = sum(w[1] for w in want)
    assert sum(x[0] for v in got.values() for x in v) >= 0.98 * links and sum(x[0] for v in got.values() for x in v) <= links
    exact = sum((n, c, k) in got[v] for v, n, c, k in want)
    assert exact >= 0.97 * len(want)
    for v in (900, 901, 902, 903, 904, 905, 909):
        assert got[v] == [(0, v, True)]
    assert got[907][0][1] == got[908][0][1] == 907 and got[911][0][1] == 910


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert m.near_vectors(frame).count() == 0


def test_codes_are_balanced():
    x = m.unit(np.random.default_rng(1).standard_normal((2000, 24)))
    model = m.quantiser(x, 64)
    on = ((x - model[0]) @ model[1] >= 0).mean(axis=0)
    assert np.abs(on - 0.5).max() < 0.1 and m.substrings(x, model, 16).max() < 1 << 16
