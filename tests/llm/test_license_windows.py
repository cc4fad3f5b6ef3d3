import math
import random
import textwrap

from matchup.llm import license_join as m
from test_license_join import texts, ws


def brute(t):
    w = ws(t)
    low = [" ".join(w)]
    labels = {label for phrase, label in m.PHRASES.items() if f" {phrase} " in f" {low[0]} "}
    score = 1.0 if labels else 0.0
    for label, text in m.TEMPLATES:
        need, size = set(ws(text)), math.ceil(len(ws(text)) / m.THRESHOLD)
        best = max((len(need & set(w[i : i + size])) for i in range(len(w))), default=0)
        if best >= m.THRESHOLD * len(need) - 1e-9:
            labels.add(label)
            score = max(score, best / len(need))
    return ",".join(sorted(labels)), round(score, 9)


def run(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {r.doc_id: (r.labels, round(r.score, 9)) for r in m.licensed(docs, m.TEMPLATES, windows=True).collect()}


def test_windows_against_brute_force(spark):
    rng = random.Random(4)
    t = [x for x in texts() if len(x or "") < 10_000]
    for _ in range(60):  # notices at any place among other words
        pad = lambda: " ".join(rng.choices(["x", "the", "of", "license", "and", "y\n"], k=rng.randint(0, 90)))
        t.append(f"{pad()} {rng.choice(m.TEMPLATES)[1]} {pad()}")
    assert run(spark, t) == {i: brute(x) for i, x in enumerate(t)}


def test_wrapped_notices_and_scattered_words(spark, tmp_path):
    labels, notices = zip(*m.TEMPLATES, strict=True)
    wrapped = ["\n".join("# " + x for x in textwrap.wrap("Some code. " + n, 40)) for n in notices]
    apart = "released " + "a b " * 20 + "under " + "a b " * 20 + "the " + "a b " * 20 + "license"
    rows = [*wrapped, apart]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.labels.split(",") for r in m.op10_license_join(spark, str(tmp_path)).collect()}
    assert all(label in got[i] for i, label in enumerate(labels))
    assert got[len(wrapped)] == [""]
