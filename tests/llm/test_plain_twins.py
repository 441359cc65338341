"""Operators 7 and 9 against plain versions: all placements of small tables, and a dictionary-based model."""

import itertools
import math
import random
import zlib
from functools import cache

import pytest

from tidewater.llm import quality_model, sharding


# ------------------------------------------------------------------ operator 7
def cut_links(homes):
    """Pairs of equal texts in different shards; ``homes`` has a (text, shard) for each row."""
    return sum(a[0] == b[0] and a[1] != b[1] for a, b in itertools.combinations(homes, 2))


def least_cut(sizes, quotas):
    """The fewest cut pairs over all ways to deal groups of ``sizes`` to shards of exactly ``quotas`` rows."""
    def splits(n, room):
        if len(room) == 1:
            return [(n,)] if n <= room[0] else []
        return [(k, *rest) for k in range(min(n, room[0]) + 1) for rest in splits(n - k, room[1:])]

    @cache
    def best(i, room):
        if i == len(sizes):
            return 0
        return min((math.comb(sizes[i], 2) - sum(math.comb(k, 2) for k in deal) + best(i + 1, tuple(r - k for r, k in zip(room, deal)))
                    for deal in splits(sizes[i], room)), default=math.inf)

    return best(0, tuple(quotas))


@pytest.mark.parametrize("sizes,shards,above", [
    ((3, 3, 2, 2, 1, 1), 3, 0), ((5, 4, 3, 1, 1, 1), 3, 0),
    ((9, 2, 2, 1), 4, 4),  # shards of 4, 4, 3, 3: a text larger than a shard goes in blocks of 3, where 4 + 4 + 1 cuts least
])
def test_cut_links_against_all_placements(spark, sizes, shards, above):
    """``above``: how many more links than the fewest possible are cut."""
    rng = random.Random(sum(sizes) * shards)
    texts = [f"text {g}" for g, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = [(texts[r.doc_id], r.shard) for r in sharding.balanced_shards(docs, shards).collect()]
    n = len(texts)
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    plain = [(t, s) for t, s in zip(texts, itertools.chain.from_iterable([s] * q for s, q in enumerate(quotas)))]
    assert least_cut(sizes, quotas) <= cut_links(mine) < cut_links(plain)
    assert cut_links(mine) == least_cut(sizes, quotas) + above


# ------------------------------------------------------------------ operator 9
def plain_features(text, bits):
    """place -> value: words, word pairs, shapes and shape pairs, counted in a dictionary."""
    def shape(word):
        kinds = ["X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        return "".join(k for k, _ in itertools.groupby(kinds))

    def place(h):
        h = ((h ^ (h >> 15)) * 0x85EBCA6B) % 2 ** 32
        return (h ^ (h >> 13)) >> (32 - bits)

    words = (text or "").split()
    counts = {}
    for series in ([zlib.crc32(w.encode()) for w in words], [zlib.crc32(shape(w).encode(), 0x5BD1E995) for w in words]):
        for h in series + [(a * 0x9E3779B1 + b) % 2 ** 32 for a, b in itertools.pairwise(series)]:
            counts[place(h)] = counts.get(place(h), 0) + 1
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    return {p: math.log1p(c) / norm for p, c in counts.items()}


def plain_weight(z, n):
    m = quality_model
    if abs(z) <= m.L1:
        return 0.0
    return -(z - math.copysign(m.L1, z)) / ((m.BETA + math.sqrt(n)) / m.ALPHA + m.L2)


def plain_train(rows, bits):
    """``rows`` of (id, text, label) in the order of crc32(id): the weight of every place, the bias at 2 ** bits."""
    z, n = {}, {}
    for _ in range(quality_model.EPOCHS):
        for i, text, label in sorted(rows, key=lambda r: zlib.crc32(str(r[0]).encode())):
            x = plain_features(text, bits) | {2 ** bits: 1.0}
            w = {p: plain_weight(z.get(p, 0.0), n.get(p, 0.0)) for p in x}
            error = 1 / (1 + math.exp(-sum(w[p] * v for p, v in x.items()))) - label
            for p, v in x.items():
                g, before = error * v, n.get(p, 0.0)
                n[p] = before + g * g
                z[p] = z.get(p, 0.0) + g - (math.sqrt(n[p]) - math.sqrt(before)) / quality_model.ALPHA * w[p]
    return {p: plain_weight(z[p], n[p]) for p in z}


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(3)
    vocab = ["river", "Stone", "über", "x9-22", "$$$", "BUY", "now!!", "and", "的", "e=mc2", "the"]
    rows = [(i, " ".join(rng.choices(vocab[:8] if i % 3 else vocab[3:], k=rng.randrange(0, 60))), int(i % 3 > 0)) for i in range(90)]
    rows += [(90, "", 0), (91, None, 1), (92, "one", 1)]
    bits = 12                                                                    # small, so that places collide
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    weights = quality_model.train(docs, labels, bits=bits)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    plain = plain_train([r for r in rows if r[0] not in held], bits)
    for r in quality_model.quality_scores(docs, weights).collect():
        text = rows[r.doc_id][1]
        v = plain.get(2 ** bits, 0.0) + sum(plain.get(p, 0.0) * x for p, x in plain_features(text, bits).items())
        want = 1 / (1 + math.exp(-v))
        assert abs(r.score - want) < 1e-5 and r.held_out == (r.doc_id in held) and r.predicted == int(r.score >= 0.5)
