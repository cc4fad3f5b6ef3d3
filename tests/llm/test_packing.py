import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchup.llm import packing as m


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer_files():
    ids, ref = m.encoder(*m.default_files()), reference()
    rng = random.Random(1)
    chars = [chr(c) for c in [*range(0x250), *range(0x391, 0x3AA), *range(0x410, 0x450), 0x2010, 0x2019, 0x4E00, 0x9FA5, 0x1F600, 0x300, 0x3000, 0x200B, 0xE0100]]
    texts = [f"a{c}b {c}1{c}{c} {c}\n\n{c} x" for c in chars] + ["".join(rng.choices(chars, k=60)) for _ in range(800)]
    texts += ["a<|endoftext|>b", "", " " * 5000, "x" * 3000, "don't 'S we'll 12ab  \t\r\n "]
    for t in texts:
        assert ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)


def check(docs, rows, capacity):
    ref = reference()
    want = Counter()
    for doc_id, text in docs:
        all_ids = ref.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(all_ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(all_ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(all_ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_is_whole_gapless_and_tight(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["the", "tion", "é", "x1", "\n"], k=rng.choice([3, 30, 40, 40, 100, 200])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "word " * 3000), (303, "a"), (303, "a"), (None, "b")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, piece int, rank int")
    n, least = check(docs, m.packed(frame, capacity=128).collect(), 128)
    assert n <= least * 1.02 + 1
    assert m.packed(frame.limit(0)).count() == 0


def test_hot_length_is_split(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 50)
    docs = [(i, "the same text") for i in range(400)] + [(i, "x " * (i % 50)) for i in range(400, 600)]
    n, least = check(docs, m.packed(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64).collect(), 64)
    assert n <= least * 1.02 + 1


def test_solver_against_exhaustive_search():
    rng = random.Random(3)

    def fewest(items, cap):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for b in sorted(set(bins)):
                if b + items[i] <= cap:
                    j = bins.index(b)
                    go(i + 1, bins[:j] + [b + items[i]] + bins[j + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for _ in range(30):
        items = [rng.randint(1, 20) for _ in range(9)]
        got = m.packed_configurations(dict(Counter(items)), 20)
        held = Counter()
        for config, n in got:
            assert sum(s * k for s, k in config.items()) <= 20
            held.update({s: k * n for s, k in config.items()})
        assert held == Counter(items)
        assert sum(n for _, n in got) <= fewest(items, 20) + 1


def test_never_more_sequences_than_best_fit():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 257, 4000), rng.integers(75, 151, 4000), np.minimum(rng.lognormal(4, 1, 4000).astype(int) + 1, 256)):
        histogram = dict(Counter(int(x) for x in lengths))
        got = m.packed_configurations(histogram, 256)
        held = Counter()
        for config, n in got:
            assert sum(s * k for s, k in config.items()) <= 256
            held.update({s: k * n for s, k in config.items()})
        assert held == histogram
        assert sum(n for _, n in got) <= sum(n for _, n in m.best_fit(histogram, 256))
