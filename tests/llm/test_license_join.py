import random
import re

from matchup.llm import license_join as m

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ws(t):
    return W.findall((t or "").translate(LOW))


def brute(t):
    w, starts, base = ws(t), [], set()
    for phrase, label in m.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if base else 0.0
    for line in (t or "").split("\n"):
        have = set(ws(line))
        for label, text in m.TEMPLATES:
            need = set(ws(text))
            if len(have & need) >= m.THRESHOLD * len(need) - 1e-9:
                labels.add(label)
                score = max(score, len(have & need) / len(need))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def texts():
    rng = random.Random(8)
    bits = [t for _, t in m.TEMPLATES] + list(m.PHRASES) + ["CC\nBY", "MIT  LICENSE", "été", "x1", "the", "of", "License", "Apache-License", "\n"]
    out = [None, "", "\n", "cc by cc by", "İcc by", "cc by " * 5000, "word " * 30000 + "mit license"]
    for _ in range(200):
        line = " ".join(rng.choices(bits, k=rng.randint(1, 4))).split(" ")
        out.append(" ".join(x for x in line if rng.random() > 0.1) + rng.choice(["", "\n", "."]))
    return out


def test_against_brute_force(spark):
    t = texts()
    docs = spark.createDataFrame([(i, x, "c") for i, x in enumerate(t)], "doc_id long, text string, labels string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in m.licensed(docs, m.TEMPLATES).collect()}
    assert got == {i: brute(x) for i, x in enumerate(t)}


def test_empty_repeated_and_no_templates(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "cc by")], "doc_id long, text string")
    assert m.licensed(docs.limit(0), m.TEMPLATES).count() == 0
    assert sorted(r.labels for r in m.licensed(docs, m.TEMPLATES).collect()) == ["cc-by", "mit", "mit"]
    assert sorted(r.labels for r in m.licensed(docs, []).collect()) == ["cc-by", "mit", "mit"]


def test_texts_that_share_a_doc_id_or_have_none_keep_their_own_labels(spark):
    t = ["plain words here", m.TEMPLATES[5][1], "nothing", "Licensed under CC BY-NC 4.0.", None, ""]
    for windows in (False, True):
        docs = spark.createDataFrame([(i, x) for x in t for i in (1, None, 1)], "doc_id long, text string")
        rows = m.licensed(docs, m.TEMPLATES, windows=windows).collect()
        got = sorted((r.doc_id is None, r.labels, round(r.score, 9)) for r in rows)
        want = sorted((i is None, *brute(x)[5:]) for x in t for i in (1, None, 1))
        assert got == want
