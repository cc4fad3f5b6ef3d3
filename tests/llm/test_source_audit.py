import random
import re
from collections import Counter, defaultdict

from matchup.llm import source_audit as m

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, value string, Rank int"


def brute(rows, min_df, top):
    docs = [(lang or "", source or "", [t.translate(LOW) for t in TERM.findall(text or "")]) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [(s, ts) for g, s, ts in docs if g == lang]
        df = Counter(t for _, ts in own for t in set(ts))
        kept = {t for t, n in df.items() if n >= min_df}
        v, counts = len(kept), defaultdict(Counter)
        for s, ts in own:
            counts[s].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in ps:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in ps if o != s]
            terms = [(t, ps[s][t] - q[t]) for t in kept if counts[s][t] > 0 and ps[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def fixture():
    rng = random.Random(5)
    terms = ["Alpha", "beta", "ÀB", "àb", "x", "été", "日本", "e", "Z", "gamma", "delta"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", None, "", "01", "1", "rare/ x"][: 7 if i else 8])
        text = rng.choice([None, "", "12 34", " ".join(rng.choices(terms[: 4 + i % 8], k=rng.randint(1, 12))), "Alpha-beta\n9été9"])
        rows.append((rng.choice([i, 7, None]), text, lang, rng.choice([None, "", "s1", "s2", "S2", "é"]), "own", 3))
    rows += [(1, "alone", "zz", "only", "own", 1), (2, "y " * 40_000 + "beta", "en", "long", "own", 1)]
    return rows + rows[:40]


def collected(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()}


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    for min_df, top in ((1, 3), (12, 50), (500, 5)):
        got = m.audited(docs, min_df, top)
        assert collected(got) == brute(rows, min_df, top)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}


def test_tiles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE", 2)
    monkeypatch.setattr(m, "CELLS", 9)
    rows = fixture()
    assert collected(m.audited(spark.createDataFrame(rows, SCHEMA), 3, 4)) == brute(rows, 3, 4)


def test_large_counts_are_exact(spark):
    df = spark.range(1).selectExpr("9000000000000000L AS c", "90000000000000001L AS total", "7L AS v")
    assert df.select(m.p_of("c").alias("p")).first().p == 1 + 10**9 * (9000000000000000 + 5) // (90000000000000001 + 35)


def test_empty_table_and_texts(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA)
    assert m.audited(docs.limit(0)).count() == 0
    none = docs.withColumns({"text": docs.lang.substr(1, 0)})
    assert {(r.value, r.part) for r in m.audited(none, 1).collect()} == {(0, "pair")}
