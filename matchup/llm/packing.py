"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids (byte-level BPE, then id 0); longer ones are cut
into pieces of ``CAPACITY`` tokens, the first of which may be shorter. The
number of distinct piece lengths is at most the capacity, so the histogram is
small whatever the corpus, and the packing problem is solved on it:

* configuration LP (least number of sequences, each a multiset of lengths that
  fits) by multiplicative weights: prices of lengths fall exponentially as they
  are covered, the next configuration is a knapsack by dynamic programming;
* the fractional counts are rounded down and what is left is packed best fit
  decreasing, again on counts.

Every piece then finds its place by its rank among the pieces of its length:
ranks come from counts by (length, hash bucket) and a ``row_number`` inside
such a bucket, so a length that a third of all pieces have is split.

Defined results: null or empty text is the single id 0; repeated rows are
packed once each; pieces that tie (equal length) may swap places; no
documents give no rows. Extra input columns are not returned.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchup.llm.common import read, staged

CAPACITY = 2048
#: Pieces of one hash bucket, about; sets the number of buckets.
BUCKET_ROWS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

#: Characters for which both tokenizer libraries split alike (see encoder()).
_COMMON = re.compile("[\x00-ɏΑ-ΡΣ-ωА-я‐-‧一-龥]*")
_SPECIAL = "<|endoftext|>"


def encoder(tokenizer: str, ranks: str | None, pattern: str):
    """text -> uint32 ids as ``tokenizers`` gives them for the file ``tokenizer``.

    With ``ranks`` (the same vocabulary as merge ranks) the five times faster
    ``tiktoken`` encodes texts of common characters; texts with others, whose
    classes depend on a library's Unicode version, or with the special
    token's string, stay with ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    fast = None
    if ranks:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if fast is not None and _SPECIAL not in text and (text.isascii() or _COMMON.fullmatch(text)):
            try:
                return fast.encode_to_numpy(text)
            except ValueError:  # the pattern's backtracking limit, on very long white space
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return ids


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def pieces(docs: DataFrame, files: tuple[str, str | None, str], capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each (doc_id, text) row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(*files)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(ids_of(text) if isinstance(text, str) and text else np.empty(0, np.uint32), 0).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                start = 0
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    out.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECES)


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths (index of ``price``): best value and first length taken, by room."""
    sizes = np.flatnonzero(price > 0)
    values = price[sizes]
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = best[c - sizes[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], take[c] = v[i], sizes[i]
    return best, take


def taken(take: np.ndarray, room: int) -> dict[int, int]:
    """The lengths that fill ``room`` in a knapsack's solution."""
    out: dict[int, int] = defaultdict(int)
    while room > 0:
        if take[room]:
            out[int(take[room])] += 1
            room -= int(take[room])
        else:
            room -= 1
    return out


def configuration_lp(histogram: dict[int, int], capacity: int, step: float = 0.2, sharp: float = 2.0, slack: float = 0.01) -> dict[tuple, float]:
    """Fractional configurations that cover the histogram exactly, by multiplicative weights.

    A length's price is its size times exp(sharp * share still uncovered),
    nothing once covered. Each round solves one knapsack, whose table holds the
    best configuration around every length; those within ``slack`` of the best
    value are bought, until one of their lengths is covered by ``step`` more.
    """
    need = np.zeros(capacity + 1)
    for length, n in histogram.items():
        need[length] = n
    left, size = need.copy(), np.arange(capacity + 1, dtype=float)
    out: dict[tuple, float] = defaultdict(float)
    while left.any():
        share = np.divide(left, need, out=np.zeros_like(need), where=need > 0)
        price = np.where(left > 0, size * np.exp(sharp * share), 0.0)
        best, take = knapsack(price, capacity)
        worth = np.where(price > 0, price + best[::-1], -1.0)
        quota = np.minimum(left, step * need)
        for s in np.argsort(-worth, kind="stable"):
            if worth[s] < (1 - slack) * best[capacity]:
                break
            config = taken(take, capacity - int(s))
            config[int(s)] += 1
            amount = min(quota[x] / k for x, k in config.items())
            if amount > 0:
                out[tuple(sorted(config.items()))] += amount
                for x, k in config.items():
                    quota[x] = max(0.0, quota[x] - amount * k)
                    left[x] -= amount * k
                    if left[x] < 1e-6 * need[x] + 1e-9:
                        left[x] = quota[x] = 0.0
    return out


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on counts: (configuration, number of sequences)."""
    open_by_room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n > 0:
            at = np.flatnonzero(rooms[s:])
            room = int(at[0]) + s if len(at) else capacity
            config, have = open_by_room[room].pop() if len(at) else ((), n)
            if len(at):
                rooms[room] -= have
            fits = room // s
            full = min(have, n // fits)
            parts = [(fits, full)] if full else []
            if full < have and n - full * fits and (rest := min(fits, n - full * fits)):
                parts.append((rest, 1))
            used = 0
            for k, count in parts:
                open_by_room[room - k * s].append((config + ((s, k),), count))
                rooms[room - k * s] += count
                n -= k * count
                used += count
            if len(at) and have > used:
                open_by_room[room].append((config, have - used))
                rooms[room] += have - used
    return [(dict(c), n) for groups in open_by_room.values() for c, n in groups if n]


def packed_configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole configurations that hold exactly the histogram.

    The LP's counts are rounded down; configurations that leave room (bought
    when few lengths were uncovered) are left out first, and a smaller share
    of all is tried, since what remains for best fit is then easier to fit.
    A share of nothing, where best fit packs everything, is the last candidate
    and taken only if it needs fewer sequences than each of the others.
    """
    whole = [({s: 1}, n) for s, n in histogram.items() if s == capacity]
    rest = {s: n for s, n in histogram.items() if s < capacity}
    fractional = configuration_lp(rest, capacity)
    results = []
    for share, room in ((1.0, capacity), (1.0, 0), (0.75, 0), (0.5, 0), (0.25, 0), (0.0, 0)):
        left, out = dict(rest), []
        for config, amount in fractional.items():
            if capacity - sum(s * k for s, k in config) > room:
                continue
            n = min([int(share * amount + 1e-6), *(left[s] // k for s, k in config)])
            if n:
                out.append((dict(config), n))
                for s, k in config:
                    left[s] -= n * k
        results.append(out + best_fit({s: n for s, n in left.items() if n}, capacity))
    return whole + min(results, key=lambda r: sum(n for _, n in r))


def slots(configurations: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Per length, consecutive ranks: those of ``rank`` up to ``end`` go, ``per`` to a sequence
    from ``sequence`` on, to the offsets ``offset``, ``offset + length``, ..."""
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for config, n in configurations:
        offset = 0
        for s, k in config.items():
            out.append((s, rank[s], rank[s] + n * k, k, sequence, offset))
            rank[s] += n * k
            offset += s * k
        sequence += n
    return pd.DataFrame(out, columns=["length", "rank", "end", "per", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def ranked(cut: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``rank``, from 0 and gapless, among the pieces of equal length."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    p = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return (
        p.withColumn("inside", inside)
        .join(counts.select("length", "bucket", before.alias("before")), ["length", "bucket"])
        .withColumn("rank", (F.col("before") + F.col("inside") - 1).cast("long"))
        .drop("bucket", "inside", "before")
    )


def packed(docs: DataFrame, files: tuple[str, str | None, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it stands in which sequence."""
    cut = staged(pieces(docs, files or default_files(), capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(packed_configurations(histogram, capacity))
    # A table of at most (configurations x lengths in one) rows, which don't grow with the corpus once all lengths occur.
    columns = {c: table[c].to_numpy(np.int64) for c in table.columns}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = columns["length"] * (1 << 44) + columns["rank"]
        for b in batches:
            at = np.searchsorted(starts, b["length"].to_numpy() * (1 << 44) + b["rank"].to_numpy(), side="right") - 1
            i = b["rank"].to_numpy() - columns["rank"][at]
            out = b.drop(columns="rank").astype({"doc_id": "Int64"})
            out["sequence_id"] = columns["sequence"][at] + i // columns["per"][at]
            out["offset"] = columns["offset"][at] + i % columns["per"][at] * columns["length"][at]
            yield out

    names = [f.split()[0] for f in PIECES.split(", ")]
    return ranked(cut, sum(histogram.values())).select(*names, "rank").mapInPandas(place, PACKED)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document piece in a sequence of at most 2048 tokens."""
    return packed(read(spark, sf_dir, "documents").select("doc_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the packed pieces of all documents."""
    return packed(docs.select("doc_id", "text"))
