import random
import re
from collections import Counter

from matchup.llm import quality_rules as m

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = W.findall(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {k for k, c in Counter(win).items() if c > 1}
    pos = {i + d for i, x in enumerate(win) if x in many for d in range(3)}
    lines = [x for x in t.split("\n") if W.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(pos), n < 50 or 100 * len(pos) > 50 * n


def test_counts_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "x\ny\nx\n \n ", "é|é <b> é|é <b>\x0b\x1c z", "\xa0   a\r\nb\r\nb\r\n"]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 80))) + "\n" * (i % 3) for i in range(120)]
    texts += ["w " * 30000, " ".join(f"w{i}" for i in range(40000)) + " w0 w1 w2"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, N_words int")
    rows = m.judged(m.counted(df), (0.9, [(0.5, 0.02)] * 5)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(texts[r.doc_id]), repr(texts[r.doc_id])[:80]
        assert not (r.kept and r.base_failed)


def test_em_recovers_accuracies():
    rng = random.Random(4)
    truth = [(0.4, 0.003), (0.3, 0.001), (0.45, 0.004), (0.2, 0.002)]
    counts = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        counts[tuple(None if rng.random() < 0.2 else int(rng.random() >= t[good]) for t in truth)] += 1
    prior, rates = m.fit(sorted(counts.items(), key=str), 4)
    assert abs(prior - 0.8) < 0.05
    assert all(abs(a - b) < 0.08 for x, y in zip(rates, truth) for a, b in zip(x, y))


def test_stage_keeps_clean_drops_junk(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}n{c}" for a in "bcdfg" for b in "aeiou" for c in "tsr"]
    clean = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(60)]
    junk = ["spam " * 120, " ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=200)), " ".join(w + "%%%" for w in rng.choices(vocabulary, k=200))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean + junk + [None, ""])], "doc_id long, text string, posterior string")
    out = m.quality_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(60))
    assert m.quality_stage(spark, docs.limit(0), "").count() == 0
    assert m.quality_stage(spark, docs.unionAll(docs), "").count() == 120
