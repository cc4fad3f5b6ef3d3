import random

from matchup.llm import graph, line_dedup as m


def shingles(x):
    return {x[i : i + 8] for i in range(max(1, len(x) - 7))}


def brute(docs):
    lines = []
    for doc_id, text in docs:
        for i, x in enumerate(text.split("\n")) if text else ():
            if x.strip(" \t\n\x0b\x0c\r"):
                lines.append((doc_id, i, x))
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(x) for *_, x in lines]
    for i in range(len(lines)):
        for j in range(i):
            if lines[i][2] == lines[j][2] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    gone = {lines[i][:2] for i in range(len(lines)) if root(i) != i}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def corpus(n=60):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvé", k=rng.randint(2, 9))) for _ in range(400)]
    common = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(4)]
    docs = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        for c in common:
            if rng.random() < 0.5:
                w = c.split()
                if rng.random() < 0.6:
                    w[rng.randrange(40)] = rng.choice(vocabulary)
                lines.insert(rng.randint(0, len(lines)), " ".join(w))
        if rng.random() < 0.5:
            lines += ["short", " ", "The.", ""]
        docs.append((i, "\n".join(lines)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "x" * 50000), (n + 4, "x" * 49990)]


def test_matches_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 5, 0) for d, t in docs], "doc_id long, text string, n_lines int, n_chars long").repartition(7)
    out = m.deduplicated(frame)
    assert out.columns == ["doc_id", "text", "n_chars", "n_lines", "n_dropped"]
    rows = out.collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_empty_repeated_and_stage(spark):
    frame = spark.createDataFrame([(1, "a line here\nb line there"), (1, "a line here\nb line there"), (2, "a line here\nb line there"), (None, None)], "doc_id long, text string")
    assert m.deduplicated(frame.limit(0)).count() == 0
    rows = sorted((str(r.doc_id), r.text) for r in m.deduplicated(frame).collect())
    assert rows == [("1", "a line here\nb line there")] * 2 + [("2", ""), ("None", None)]
    assert sorted(str(r.doc_id) for r in m.line_stage(spark, frame, "").collect()) == ["1", "1", "None"]


def test_components_and_hub_rounds(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    # Links only between neighbours in a ring: the last, full round has to find most of them.
    groups = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 40), (2, 41)], "`group` long, node long")
    comp = graph.linked(groups, lambda p: p.where("b - a = 1 AND a % 10 <> 9"))
    assert {r.node: r.component for r in comp.collect()} == {i: i // 10 * 10 for i in range(42)}
    assert graph.linked(groups, lambda p: p.where("false")) is None


def test_exact_comparison_of_lines():
    rng = random.Random(5)
    wide = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]

    def shingles(x):
        return {x[i : i + m.SHINGLE] for i in range(max(1, len(x) - m.SHINGLE + 1))}

    for alphabet in ("ab\0", "abcdefgh é😀", wide):
        a = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 3, 7, 8, 9, 40, 150]))) for _ in range(200)]
        b = [x if k % 3 == 0 else x[: len(x) // 2] + "b" + x[len(x) // 2 + 1 :] if k % 3 == 1 else x + "\0" for k, x in enumerate(a)]
        want = [100 * len(shingles(x) & shingles(y)) >= m.PERCENT * len(shingles(x) | shingles(y)) for x, y in zip(a, b)]
        assert m.similar_lines(a, b).tolist() == want and any(want) and not all(want)
    assert m.similar_lines([], []).tolist() == []
