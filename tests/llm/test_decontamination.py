import hashlib
import random
import re

from matchup.llm import decontamination as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ws(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = ws(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = ws(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (own := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[own]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()], key=repr)


def fixture(seed, alphabet):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choices(alphabet, k=n))
    items = [(i, say(rng.randint(10, 30))) for i in range(12)] + [(10, say(11)), (2, say(14)), (None, say(12)), (100, None), (101, ""), (102, "--")]
    docs = [(1, None), (2, ""), (None, "?"), (None, items[0][1]), (None, items[1][1] + " " + items[2][1]), (5, "x " * 30_000 + items[3][1])]
    for i in range(60):
        parts = [say(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 3)):
            t = (rng.choice(items[:12])[1]).split(" ")
            a = rng.randint(0, len(t) - 1)
            cut = t[a : a + rng.randint(8, 14)]
            if rng.random() < 0.3:
                cut[len(cut) // 2] = "changed"
            parts += [rng.choice([" ", "\n", ", "]).join(cut).upper(), say(rng.randint(0, 3))]
        docs.append((rng.choice([i, 3, None]), " ".join(parts)))
    return docs + docs[:9], items


WORDS = ["a", "b", "é", "x1", "the", "of", "İ", "w7", "ab", "日"]


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "n", "w") for r in docs], "doc_id long, text string, at int, N_Words string, h string")
    return d, spark.createDataFrame([(*r, 2, "w") for r in items], "item_id long, text string, win int, item string")


def test_against_brute_force(spark):
    for seed, alphabet in ((1, WORDS), (2, WORDS[:3]), (3, [f"word{i}" for i in range(200)])):
        docs, items = fixture(seed, alphabet)
        d, b = frames(spark, docs, items)
        assert rows(m.contaminated(d, b)) == brute(docs, items)


def test_short_items_and_other_sizes(spark):
    docs, items = fixture(4, WORDS)
    items += [(200, "the"), (201, "a b"), (202, "of w7 ab"), (203, "x1 x1 x1 x1 é"), (204, "é é b a the of ab"), (205, "never seen")]
    d, b = frames(spark, docs, items)
    assert rows(m.contaminated(d, b)) == brute(docs, items)
    assert rows(m.contaminated(d, b, window=6, shingle=2)) == brute(docs, items, 6)


def test_shuffled_shingles_when_not_small(spark, monkeypatch):
    monkeypatch.setattr(m, "small", lambda df: df)
    docs, items = fixture(6, WORDS)
    assert rows(m.contaminated(*frames(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture(5, WORDS)
    d, b = frames(spark, docs, items)
    assert m.contaminated(d.limit(0), b).count() == 0
    assert rows(m.contaminated(d, b.limit(0))) == brute(docs, [])
