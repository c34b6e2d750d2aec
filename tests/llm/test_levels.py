"""That every level of the doubling is counted, that hashing keeps little memory, and that confirmations read stored sets."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
from ocellus.llm import _text, near_dup, substrings
from pyspark.sql import functions as F


def _docs(spark, texts):
    return spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "k long, t long, text string").repartition(3)


def test_second_level_is_counted(spark):
    """Passages that repeat over 5 words, but not over 10, survive the first level and are dropped by the second."""
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    short, long = [say(7) for _ in range(30)], say(40)
    texts = [f"{say(25)} {s} {say(25)}" for s in short for _ in range(3)]
    lengths = substrings.levels(substrings.WIDTH, substrings.LEAST)
    assert lengths == [5, 10, 20]
    raw = _docs(spark, texts)
    h = np.concatenate([substrings.words(b := np.frombuffer(t.encode(), np.uint8), np.array([0, len(b)]))[0] for t in texts[:2]])
    assert len(h)
    anchors = raw.select("text").mapInArrow(substrings._emit_anchors(lengths, substrings.words), "a0 long")
    assert anchors.groupBy("a0").count().where("count > 1").count() > 0
    for sieved in (False, True):
        found, firsts = substrings.repeated_segments(raw, lengths, substrings.words, sieved)
        assert found.read().count() == 0 and firsts.read().count() == 0
        found, _ = substrings.repeated_segments(_docs(spark, [*texts, f"{say(9)} {long}", f"{long} {say(9)}"]), lengths, substrings.words, sieved)
        assert {r.k for r in found.read().select("k").distinct().collect()} == {len(texts), len(texts) + 1}


def test_one_place_is_not_repeated(spark):
    """Several segments of one anchor at one place do not make it repeated; the same anchor twice in a document does."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"v{rng.randrange(10**9)}" for _ in range(n))
    passage = say(22)
    found, _ = substrings.repeated_segments(_docs(spark, [f"{passage} {say(3)} {passage}", say(60)]), [5, 10, 20], substrings.words)
    assert {r.k for r in found.read().select("k").distinct().collect()} == {0}


def test_hashing_keeps_little(monkeypatch):
    """Hashes are the same in blocks and at once, wherever a span stands; a word of 20 MB leaves and takes next to nothing."""
    monkeypatch.setattr(_text, "_POWERS", {})
    rng = np.random.default_rng(3)
    b = rng.integers(33, 127, 3_000_000).astype(np.uint8)
    starts = np.arange(0, 2_990_000, 30_011)
    ends = starts + 9_000
    h = _text.span_hash(b, starts, ends)
    for k in (0, 7, 50):
        own = b[starts[k] : ends[k]].copy()
        assert _text.span_hash(own, np.array([0]), np.array([len(own)]))[0] == h[k]
    values = _text.mix(rng.integers(0, 1 << 62, 200_000).astype(np.uint64))
    w = _text.window_hash(values, 50)
    assert all(_text.window_hash(values[k : k + 50], 50)[0] == w[k] for k in (0, 65_530, 65_536, 199_950))
    assert (_text.sequence_hash(values, np.array([0, 70_000]), np.array([10, 70_010])) == [_text.sequence_hash(values[k : k + 10], np.array([0]), np.array([10]))[0] for k in (0, 70_000)]).all()
    word = np.full(20_000_000, 0x71, dtype=np.uint8)
    tracemalloc.start()
    one = _text.span_hash(word, np.array([0]), np.array([len(word)]))
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 1 << 20 and peak < 8 << 20
    assert one != _text.span_hash(word[1:], np.array([0]), np.array([len(word) - 1]))
    assert sum(x.nbytes for p in _text._POWERS.values() for x in (p.up, p.down, p.far_up, p.far_down)) < 5 << 20


def test_confirmation_from_sets(spark):
    rng = random.Random(5)
    base = [f"u{rng.randrange(500)}" for _ in range(120)]
    texts = {k: " ".join(w if rng.random() > 0.004 * k else f"x{rng.random()}" for w in base) for k in range(20)} | {20: "", 21: "a b", 22: "a b"}
    shingles = {k: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for k, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a > b]
    want = {(a, b) for a, b in pairs if shingles[a] and shingles[b] and 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b])}
    got = near_dup.confirm(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(list(texts.items()), "k long, text string"))
    assert {(r.u, r.v) for r in got.read().select(F.col("u"), F.col("v")).collect()} == want and len(want) > 10
