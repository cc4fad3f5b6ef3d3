import random
import re
import zlib
from collections import Counter
from itertools import combinations

from matchup.llm import spelling as m

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        own = [x for x in n if near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        out[w] = best if best and n[best] >= 2 * n[w] else None, len(own)
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return {(w, f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in out.items()}


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def varied(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind < 2) :]


def fixture(seed, letters, low, high):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(120)]
    for _ in range(400):
        words.append(varied(rng, rng.choice(words), letters))
    weights = [rng.choice([1, 2, 4, 9, 30, 70]) for _ in words]
    docs = [(rng.choice([i, None, 4]), rng.choice([" ", "\n", "1", "-"]).join(rng.choices(words, weights, k=rng.randint(0, 120)))) for i in range(120)]
    docs += [(1, None), (2, ""), (3, "12 34"), (4, "Ünïcode ÀÀÀÀÀ àààà×÷ " * 5), (9, "LongTail " * 30_000)]
    return docs + docs[:10]


def test_against_brute_force(spark):
    for seed, letters, low, high in ((1, "ab", 5, 9), (2, "abcdeé", 4, 8), (3, "abcdefghijklmnopÀÿ×", 5, 12), (4, "aB", 12, 30)):
        docs = fixture(seed, letters, low, high)
        frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, N int")
        found = m.grouped(frame)
        assert got(found) == brute(docs)
    assert [f"{n} {t}" for n, t in found.dtypes] == ["word string", "form string", "root string", "n bigint", "n_near bigint", "form_n bigint"]


def test_chain_of_forms(spark):
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate([("aaaaaa", 3), ("aaaaab", 7), ("aaaabb", 16), ("aaabbb", 40), ("aabbbb", 90), ("abbbbb", 200)])]
    rows = got(m.grouped(spark.createDataFrame(docs, "doc_id long, text string")))
    assert rows == brute(docs)
    assert max(n for *_, n, _, _ in rows) >= 190 and len({r for _, _, r, *_ in rows if r[-1] == "b"}) == 1


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string")
    assert m.grouped(docs).count() == 0 and m.grouped(docs.limit(0)).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randint(3, 6)))
        grams = [(p, rng.randint(1, 9), 0) for p in places]
        if places[-1] - places[0] < m.GRAM:
            continue
        own = m.chosen(grams, 2)
        assert grams[own[1]][0] - grams[own[0]][0] >= m.GRAM
        least = min(a[1] + b[1] for a, b in combinations(grams, 2) if b[0] - a[0] >= m.GRAM)
        assert sum(grams[i][1] for i in own) == least
