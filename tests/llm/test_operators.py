"""Each corpus operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from ocellus.llm import chat, decontaminate, langid, near_dup, packing, quality, rules, secrets, substrings, suffix, suffix_dedup
from ocellus.llm._shared import Table, sampled
from ocellus.llm.stats import with_stats
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, stats string, listed string, w string, b string, i string, t string, dropped string, _dropped string, hit_bits string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(200).split()
    near = [" ".join(w if rng.random() > 0.01 else "x" for w in base) for _ in range(12)]
    chain = [base]
    for _ in range(6):
        chain.append([w if rng.random() > 0.02 else rng.choice(vocabulary) for w in chain[-1]])
    texts: list[str | None] = [None, "", " \n\t ", "one", "ONE", "two words", say(4), passage, f"{say(30)} {passage}\n{say(30)}", f"{passage} {say(5)} {passage}"]
    texts += near + [" ".join(c) for c in chain] + [say(40) for _ in range(10)] + [say(20_000), "a " * 3000, "a" * 2000, "word with spaces \x1c \x00 end"]
    return texts + [texts[7], texts[9], texts[-3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), *["clash"] * 10) for k, t in enumerate(_texts())]
    rows.append((None, _texts()[8], *[None] * 13))
    return spark.createDataFrame(rows + rows[8:10], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def _first_is_kept(docs, units, width, key):
    """For each row, flags of the units that a window which starts earlier covers; rows of one id are ordered by their texts' hashes."""
    text = F.coalesce("text", F.lit(""))
    rows = [((-1 << 70) if r.doc_id is None else r.doc_id, r.t, r.doc_id, r.text) for r in docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t")).collect()]
    first = {}
    for d, x, _, t in rows:
        u = units(t)
        for i in range(len(u) - width + 1):
            w = key(u[i : i + width])
            first[w] = min(first.get(w, (1 << 70, 0, 0)), (d, x, i))
    out = []
    for d, x, doc_id, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if (d, x, i) > first[key(u[i : i + width])]:
                gone[i : i + width] = [True] * width
        out.append((doc_id, u, gone))
    return out


@pytest.fixture(scope="module")
def shared_ids(spark, docs):
    """docs, and different texts under one id and under none, which share passages or nothing."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"q{rng.randrange(500)}" for _ in range(n))
    passage, old = say(50), _texts()[7]
    texts = [f"{say(9)} {passage}", f"{passage} {say(40)}", f"{say(3)} {old}", say(80), "short", None]
    rows = [(d, t, "en", "s", 0, *["clash"] * 10) for d in (3, None, 5000) for t in [*texts, texts[0]]]
    return docs.unionByName(spark.createDataFrame(rows, SCHEMA)).repartition(4)


@pytest.mark.parametrize("width", [20, 40, 13])
def test_substring_dedup(shared_ids, empty, width):
    want = []
    for d, w, gone in _first_is_kept(shared_ids, WORDS.findall, width, tuple):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.without_repeats(shared_ids, width, digest=True).collect()]
    assert Counter(got) == Counter(want)
    assert substrings.without_repeats(empty).count() == 0


def test_substring_sieve(spark):
    """Every repeated anchor passes and nearly no other, and the segments of these alone reach the shuffle."""
    rng = np.random.default_rng(4)
    twice, once = (rng.integers(-(1 << 63), 1 << 63, n) for n in (5000, 200_000))
    bitmap = substrings.sieve(spark.createDataFrame([(int(x),) for x in twice], "a0 long"))
    assert len(bitmap) == 1 << 14 and substrings._passes(twice.view(np.uint64), bitmap).all()
    assert substrings._passes(once.view(np.uint64), bitmap).mean() < 0.06
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, n))
    passage = say(30)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([f"{say(3000)} {passage}", f"{passage} {say(3000)}"])], names=["k", "t", "text"])
    emitted = lambda held: pa.Table.from_batches(substrings._emit_segments([5, 10, 20], substrings.words, held)(iter([batch]))).to_pandas()
    every = emitted(None)
    anchors = np.concatenate([x.column(0).to_numpy() for x in substrings._emit_anchors([5, 10, 20], substrings.words)(iter([batch.select(["text"])]))])
    a, c = np.unique(anchors, return_counts=True)
    held = spark.sparkContext.broadcast(substrings.sieve(spark.createDataFrame([(int(x),) for x in a[c > 1]], "a0 long")))
    few, want = emitted(held), every[every.a0.isin(a[c > 1])]
    assert 0 < len(want) <= len(few) < len(every) / 10
    assert set(want.itertuples(index=False, name=None)) <= set(few.itertuples(index=False, name=None)) <= set(every.itertuples(index=False, name=None))


def test_substring_kept_words():
    """Words at the edges of documents of one slice stay apart, and whole, with null, empty and wholly removed ones between them."""
    texts = ["ab", "cd", "", "e f g", "é ü", " x  y ", "h"]
    listed = [None, None, None, [0 << 32 | 2], [1 << 32 | 1], None, [0 << 32 | 1]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.array(listed, pa.list_(pa.int64()))], names=["k", "text", "listed"])
    out = pa.Table.from_batches(substrings._kept_words(1, False)(iter([batch]))).to_pydict()
    assert out["kept"] == ["ab", "cd", "", "g", "é", "x y", ""]
    assert out["n_removed"] == [0, 0, 0, 2, 1, 0, 1] and out["n_words"] == [1, 1, 0, 3, 2, 2, 1]


def test_substring_levels():
    assert substrings.levels(20, 5) == [5, 10, 20] and substrings.levels(80, 5) == [5, 10, 20, 40, 80]
    rng = np.random.default_rng(3)
    for lengths in ([5, 10, 20], [5, 10, 20, 40, 80], [50, 75, 88, 94, 97, 99, 100]):
        h = rng.integers(1, 4 if lengths[0] == 5 else 1 << 40, 600).astype(np.uint64)
        made = substrings.segments(h, np.array([0, 250, 250, 255, 600]), lengths)
        windows = sum(max(0, n - lengths[-1] + 1) for n in (250, 0, 5, 345))
        assert made.n.sum() == windows
        for s, n, *places in zip(made.start, made.n, *made.places, strict=True):
            for at in (s, s + n - 1):
                inner = None
                for p, size in zip(places, lengths, strict=False):
                    assert at <= p and p + size <= at + lengths[-1]
                    assert inner is None or (p <= inner[0] and inner[1] <= p + size)
                    inner = (p, p + size)


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_array_dedup(shared_ids, empty, hot):
    want = []
    for d, b, gone in _first_is_kept(shared_ids, lambda t: t.encode(), 100, bytes):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.without_repeats(shared_ids, hot=hot, digest=True).collect()]
    assert Counter(got) == Counter(want)
    assert suffix_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("limit", [50, 100_000])
def test_a_shard_beyond_its_memory(limit):
    """Segments of three documents, with the shard's text, places and queues on disk at the smaller limit."""
    rng = np.random.default_rng(1)
    shard, rows = suffix_dedup._Shard(limit), []
    base = rng.integers(97, 100, 60).astype(np.uint8)
    for k in range(40):
        data = np.concatenate([rng.integers(97, 100, int(rng.integers(0, 30))).astype(np.uint8), base[int(rng.integers(0, 30)) :]])
        rows.append((k % 3, 7 * (k % 2), 1000 * k, data.tobytes()))
    for i in range(0, 40, 8):
        part = rows[i : i + 8]
        shard.add(*(np.array([r[x] for r in part]) for x in range(3)), np.frombuffer(b"".join(r[3] for r in part), np.uint8), np.array([len(r[3]) for r in part]))
    got = Counter((int(a), int(b), int(x >> 32) + i) for k, t, run in shard.later(12) for a, b, x in zip(k, t, run, strict=True) for i in range(int(x & 0xFFFFFFFF)))
    places = defaultdict(list)
    for k, t, p, data in rows:
        for i in range(len(data) - 11):
            places[data[i : i + 12]].append((k, t, p + i))
    assert got == Counter(x for found in places.values() for x in sorted(found)[1:])


def test_induced_sorting_beyond_memory():
    rng = np.random.default_rng(0)
    deepest = 0
    for trial in range(120):
        kinds = (rng.integers(1, 4, int(rng.integers(0, 150))), np.tile(rng.integers(1, 3, int(rng.integers(1, 9))), 15), rng.integers(1, 3, 200), np.repeat(rng.integers(1, 5, 40), rng.integers(1, 6, 40)))
        text = np.concatenate([kinds[trial % 4], [0]]).astype(np.uint16)
        levels = []
        parts = list(suffix.suffix_order(text, 5, 250, suffix.Scratch((3, 20, 1000)[trial % 3]), levels))
        deepest = max(deepest, len(levels))
        order, lcp = np.concatenate([p[0] for p in parts]).tolist(), np.concatenate([p[1] for p in parts]).tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert order == want
        for a, b, n in zip(want, want[1:], lcp[1:], strict=False):
            both = 0
            while a + both < len(text) and b + both < len(text) and text[a + both] == text[b + both]:
                both += 1
            assert n == both
    assert deepest >= 3


def test_near_duplicates(docs, empty, spark):
    sets, best = defaultdict(set), {}
    order = lambda d: (-1 << 63) if d is None else d
    for d, t in _rows(docs):
        w = WORDS.findall(t.translate(LOWER))
        sets[order(d)] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    best = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and best[b] < best[a]:
                    best[a], changed = best[b], True
    for r in near_dup.near_duplicates(docs).collect():
        k = order(r.doc_id)
        assert (r.n_shingles, order(r.component_id), r.kept) == (len(sets[k]), best[k], best[k] == k)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.first_of_each(docs)
    assert kept.columns == docs.columns and {order(r.doc_id) for r in kept.collect()} == {k for k in best if best[k] == k}


def test_near_duplicates_finds_chains_and_big_groups(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts, now = [], [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(150):
        texts.append(" ".join(now))
        now = list(now)
        now[rng.randrange(len(now))] = rng.choice(vocabulary)
    made = near_dup.near_duplicates(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.component_id for r in made.collect()} == {0}


def test_secrets(docs, empty, spark):
    english = "the international organization of ordinary words in nations is a national realization of internal ideas and their localization in words " * 50
    ratios = secrets.train(spark.createDataFrame([(english,)], "text string"))
    texts = ['PASSWORD = "abcdef12"', "secret: token: abcdefgh", "AKIA" + "A1" * 8, "AKIAAKIA", "a" * 23, "0123456789abcdef" * 2, "é token='x/y+z_-.=1' api_key:short", "x Zk3vQ9pLw8RtYb2NcX7mHs5D y", "internationalization_of_ordinary_words", "1234567890123456"]
    rows = _rows(docs) + [(1000 + k, t) for k, t in enumerate(texts)]
    made = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), ratios)
    want = []
    for d, t in rows:
        base = []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            if len(m[2]) >= 6:
                base.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort()
        want.append((d, *[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest()))
    assert Counter(tuple(r)[:5] for r in made.collect()) == Counter(want)
    said = {r.doc_id: r.spans for r in made.collect()}
    assert said[1007] == "markov:2:26" and said[1008] == said[1009] == ""
    assert secrets.replaced("a token=abcdefgh b", [("assign", 2, 16)]) == "a [SECRET] b"
    assert secrets.redact(docs, ratios).columns == docs.columns
    assert secrets.scan(empty, secrets.train(empty)).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    made = packing.pack_documents(docs).collect()
    ids = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for _, t in _rows(docs)]
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    want = Counter()
    for (d, _), x in zip(_rows(docs), ids, strict=True):
        at = 0
        for n in packing.cut(len(x)):
            want[(d, at, n, crc(x[at : at + n]), len(x))] += 1
            at += n
        assert at == len(x)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in made) == want
    bins = defaultdict(list)
    for r in made:
        bins[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 2 * 4096
    assert packing.pack_documents(empty).count() == 0


def test_packing_takes_special_strings_and_cases_as_the_tokenizer_does(spark):
    from tokenizers import Tokenizer

    texts = ["A<|endoftext|>B <|EndOfText|> x.", "It's UPPER.  'S don't!!! 12.5 É é́ ﬁ İ", "##x ..y z%"]
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    made = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True)
    got = defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
    assert dict(got) == {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(docs, empty, spark, block):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    passage = _texts()[7]
    docs = docs.unionByName(spark.createDataFrame([(7000, "zz " * 3000 + passage, *["en"] * 2, 0, *["clash"] * 10)], SCHEMA))
    bench = [(1, passage), (2, "one"), (3, None), (4, ""), (10, "two words"), (10, " ".join(passage.split()[5:30])), (None, "a a a")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    want = []
    for d, t in _rows(docs):
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit |= set(range(k, k + n))
        want.append((d, len(w), len(hit), tuple(sorted(items))))
    marked, (n_words, bits, names) = decontaminate.mark(docs, table, block_bytes=block)
    got = [(r["doc_id"], r[n_words], sum(b.bit_count() for b in bytes(r[bits])), tuple(r[names])) for r in marked.collect()]
    assert Counter(got) == Counter(want)
    # What is hit under 5 % of a long document affects it too.
    assert any(0 < 20 * h < n for _, n, h, _ in want)
    clean = decontaminate.decontaminated(docs, table)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _, h, _ in want if not h)
    assert decontaminate.decontaminated(empty, table).count() == 0
    assert decontaminate.decontaminated(docs, table.limit(0)).count() == docs.count()


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "a b c"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "q a b c d e")], "item_id long, text string")
    got = {(r.item_start): (r.length, r.doc_id, r.doc_start) for r in decontaminate.longest_matches(docs, bench, least=1).collect()}
    assert got == {1: (4, 1, 1), 2: (3, 1, 2), 3: (2, 1, 3), 4: (1, 1, 4)}


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 20), (90, 40)])
def test_longest_matches_over_shards_and_blocks(spark, block, shard):
    rng = random.Random(6)
    say = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    items = {k: say(rng.randint(1, 30)) for k in range(6)}
    texts = [(k % 9 if k % 5 else None, say(rng.randint(0, 25)) + items[k % 6][: rng.randint(0, 30)] + say(3)) for k in range(30)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    want = {}
    for k, item in items.items():
        for s in range(len(item)):
            for d, t in texts:
                for p in range(len(t)):
                    n = 0
                    while s + n < len(item) and p + n < len(t) and item[s + n] == t[p + n]:
                        n += 1
                    if n >= 3:
                        want[(str(k), s)] = max(want.get((str(k), s), (0,)), (n, -(-1 if d is None else d), -p))
    made = decontaminate.longest_matches(docs, bench, 3, block, shard).collect()
    got = {(r.item_id, r.item_start): (r.length, -(-1 if r.doc_id is None else r.doc_id), -r.doc_start) for r in made}
    assert got == want


def test_a_benchmark_index_is_arrays_of_bounded_size():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(20_000)}" for _ in range(200_000))
    tracemalloc.start()
    index = decontaminate.Index.of([(str(k), text[k * 1000 : (k + 1) * 1000]) for k in range(1200)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.nbytes() - index.seen.nbytes < decontaminate.INDEX_FACTOR * len(text)
    assert peak < 64 * len(text)


def test_chat(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, 3, "assistant", None), (2, 0, None, r"\ <|im_end|> <\| \\"), (2, 1, "assi\nstant", "<|im_part|>"), (None, None, "assistant", "é")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_conversations(table)
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(formatted).collect()}
    assert back == {1: ([("user", "a"), ("assistant", "b"), ("assistant", ""), ("assistant", "")], "b"), 2: ([("", r"\ <|im_end|> <\| \\"), ("assi\nstant", "<|im_part|>")], ""), None: ([("assistant", "é")], "é")}
    assert next(r.formatted for r in formatted.collect() if r.conv_id == 1).count("<|im_start|>") == 2
    assert chat.digest(table.limit(0)).count() == 0


def test_chat_with_many_turns(spark):
    rng = random.Random(1)
    turns = [(5, k, rng.choice(["user", "assistant"]), "é<|x" * rng.randint(0, 3)) for k in range(20_000)]
    formatted = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    (r,) = chat.read_back(formatted).collect()
    assert [tuple(t) for t in r.turns] == [t[2:] for t in turns]
    assert r.loss_text == "".join(t[3] for t in turns if t[2] == "assistant")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17])
def test_running_lengths(spark, n):
    (r,) = spark.range(1).select(chat._before(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("bigint"))).alias("x")).collect()
    assert r.x == [k * (k + 1) // 2 for k in range(n)]


def test_stats_and_rules(docs, empty, spark):
    made, name = with_stats(docs)
    assert name == "_stats"
    for r in made.collect():
        t = r.text or ""
        w, lines, seen, dup = WORDS.findall(t), t.split("\n"), set(), 0
        for x in lines:
            if WORDS.search(x):
                dup += x in seen
                seen.add(x)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        s = r[name]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(covered))
    assert with_stats(empty)[0].count() == 0


def test_binomial_bound():
    from math import comb

    for n in (1, 7, 40):
        for x in range(n + 1):
            want = sum(comb(n, j) * 0.03**j * 0.97 ** (n - j) for j in range(x + 1))
            assert abs(rules.at_most(np.array([x]), np.array([n]), 0.03)[0] - want) < 1e-9


def test_rules_bound_false_rejection(spark):
    rng = random.Random(1)
    good = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(50)) + (" ##" if rng.random() < 0.3 else "") for _ in range(3000)]
    bad = [" ".join(f"w{rng.randrange(10_000)}###" for _ in range(50)) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(good + bad)], "doc_id long, text string, stratum string")
    made, stats = with_stats(docs, ["doc_id", "stratum"])
    chosen = rules.cutoffs(made.where("doc_id < 3000 AND doc_id % 2 = 0"), stats, "stratum")
    out = rules.judge(made, chosen, stats, "stratum")
    held = out.where("doc_id < 3000 AND doc_id % 2 = 1")
    assert held.where("NOT kept").count() <= 0.05 * held.count()
    assert out.where("doc_id >= 3000 AND kept").count() == 0
    none = rules.cutoffs(made.limit(0), stats, "stratum")
    assert rules.judge(made, none, stats, "stratum").where("kept = base_failed").count() == 0


def test_rules_over_a_whole_table(spark):
    """Every row of the query against counts and exact cutoffs in plain Python; repeated rows and labels count once."""
    from math import comb, ceil

    rng = random.Random(2)
    noise = {"en": 0.02, None: 0.05, "": 0.3}
    rows = []
    for k in range(6000):
        lang = rng.choice(list(noise))
        words = [f"w{rng.randrange(5000)}" + ("#|" if rng.random() < noise[lang] else "") for _ in range(rng.choice([5, 40, 60]))]
        rows.append((k if k % 50 else None, " ".join(words) if k % 97 else None, lang))
    rows += [r for r in rows[:400] if r[0] is not None] * 3
    labels = [(d, int(rng.random() < 0.9)) for d in {r[0] for r in rows} if d is not None and d % 2] + [(1, 1), (1, 1), (None, 1), (7, None)]
    made = rules.apply_rules(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, stratum string"), spark.createDataFrame(labels, "doc_id long, quality int"))

    def counts(text):
        w, lines, seen, dup = WORDS.findall(text), text.split("\n"), set(), 0
        for x in lines:
            if WORDS.search(x):
                dup += x in seen
                seen.add(x)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered),
            "n_lines": sum(bool(WORDS.search(x)) for x in lines), "n_pipes": text.count("|"), "n_upper": len(re.findall("[A-Z]", text)),
        }

    def level(c, rule):
        a, b, top = rules.RULES[rule]
        return min(ceil(c[a] / max(c[b], 1) / top * rules.GRID), rules.GRID)

    quality_of = {}
    for d, q in labels:
        if d is not None and q is not None:
            quality_of[d] = min(quality_of.get(d, 1), q)
    good = {d: (lang, counts(t or "")) for d, t, lang in rows if quality_of.get(d) == 1}
    strata = {lang for lang, _ in good.values()}
    cuts = {}
    for lang in strata:
        for rule in rules.RULES:
            levels = [level(c, rule) for x, c in good.values() if x == lang]
            for cut in sorted(set(levels), reverse=True):
                x, n, p = sum(y > cut for y in levels), len(levels), rules.ALPHA / len(rules.RULES)
                if sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(x + 1)) > rules.DELTA / len(rules.RULES) / len(strata):
                    break
                cuts[lang, rule] = cut
    assert len(cuts) > 3
    want = Counter()
    for d, t, lang in rows:
        c = counts(t or "")
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        kept = not failed and all(level(c, r) <= cuts.get((lang, r), rules.GRID) for r in rules.RULES)
        want[(d, *[c[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed, kept)] += 1
    assert Counter(tuple(r) for r in made.collect()) == want


def test_quality_rules_ensemble():
    rng = np.random.default_rng(2)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.97
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit(x, y * 0 + 1).score(x[:1])[0] > 0.99


def test_quality_column_is_the_models_score(docs, spark):
    model = quality.Rules(0.3, [((0, True, 0.01), (14, False, 1.0)), ((10, False, 0.5),)], [1.5, -2.0])
    made, name = with_stats(docs)
    columns = quality.feature_columns(name)
    rows = made.select(*[c.alias(k) for k, c in columns.items()], model.column(columns).alias("score")).collect()
    x = np.array([[r[k] for k in quality.FEATURES] for r in rows])
    assert np.allclose(model.score(x), [r.score for r in rows])
    labels = spark.createDataFrame([(3, None), (3, 1), (None, 0)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).columns == docs.columns


SF = "/root/testdata/sf0.01"


def _tables(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _crc(d, n):
    return zlib.crc32(("" if d is None else str(d)).encode()) % n


def test_quality_query_learns_what_it_has_not_seen(spark):
    rows = quality.op8_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    said = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    assert all(r.held_out == (_crc(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, said[r.doc_id]) for r in rows if r.held_out and r.doc_id in said]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert good and bad and sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_quality_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(999)}" + ("%%" if k % 2 else "") for _ in range(30)) for k in range(200)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, None), (500, ""), (501, "a " * 120_000), (3, texts[3]), (3, texts[4])]
    labels = [(k, 1 - k % 2) for k in range(200)] + [(3, None), (4, 1), (4, 1), (None, 0)]
    at = _tables(spark, tmp_path, documents=([(*r, "c") for r in rows], "doc_id long, text string, counts string"), labels=(labels, "doc_id long, quality int"))
    made = quality.op8_quality_classifier(spark, at).collect()
    assert Counter(r.doc_id for r in made) == Counter(d for d, _ in rows)
    assert all(0 <= r.score <= 1 for r in made)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in made if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 3)


def test_bounded_sample(spark):
    table = Table(spark.range(20_000).select(F.xxhash64("id").alias("h")))
    n = sampled(table, "h", 1000).count()
    assert 600 < n <= 1000 and sampled(table, "h", 20_000).count() == 20_000
    table.drop()


def test_language_query_on_rows_it_has_not_seen(spark):
    rows = langid.op10_language_id(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lang = {r.doc_id: r.lang for r in docs}
    assert len(rows) == len(docs) and all(r.held_out == (_crc(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(held) > 50 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_secret_models_on_held_out_tokens(spark):
    """Precision and recall over tokens drawn with other seeds, and words of the corpus that no model was trained on in this form."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ratios = secrets.train(docs.where("doc_id % 2 = 0"))
    scored = lambda xs: secrets.token_ratios(np.frombuffer(b"".join(xs), np.uint8), np.cumsum([0, *map(len, xs)])[:-1], np.cumsum([len(x) for x in xs]), ratios)
    drawn = [s for each in secrets.labelled_random(seed=901, each=300).values() for s in each]
    plain = [t.encode() for r in docs.where("doc_id % 2 = 1").collect() for t in re.findall(r"[A-Za-z]{16,}", r.text or "") if not re.search(r"[A-Z].*[a-z].*[A-Z]", t)]
    plain += [x for x in secrets.labelled_ordinary(seed=902, each=200) if len(x) >= secrets.MIN_TOKEN]
    hit, false = (scored(drawn) >= secrets.THRESHOLD).sum(), (scored(plain) >= secrets.THRESHOLD).sum()
    assert hit / len(drawn) > 0.95 and hit / (hit + false) > 0.98


def test_many_secrets_in_one_text(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("ABCDEFGHabcdefgh0123456789") for _ in range(30))
    text = " ".join(f"é {key()} token={key()} {key()}" for _ in range(6000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = secrets.scan(docs, secrets.train(docs.limit(0))).collect()
    spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",")]
    assert Counter(k for k, _, _ in spans)["assign"] == 6000 and len(spans) == 18_000
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    assert all("é" not in text[s:e] and " " not in text[s:e] for _, s, e in spans)


def test_near_copies_are_linked(spark):
    """Pairs of similarity 0.75 to 0.8: what banding and sketches keep of them."""
    rng = random.Random(12)
    rows, pairs = [], []
    for k in range(400):
        a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        b = list(a)
        for at in rng.sample(range(400), 11):
            b[at] = f"x{rng.randrange(10**6)}"
        sets = [{tuple(w[i : i + 5]) for i in range(396)} for w in (a, b)]
        similar = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if 0.75 <= similar < 0.8:
            pairs.append(2 * k)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[d + 1] == d for d in pairs)
    assert len(pairs) > 100 and found / len(pairs) >= 0.99


def test_language_id(spark, empty):
    rng = random.Random(4)
    kinds = {"xx": ["thi", "ing", "and", "tha"], "yy": ["éau", "que", "les", "ment"]}
    rows = [(k, " ".join("".join(rng.choice(kinds[c]) for _ in range(3)) for _ in range(20)), c) for k in range(400) for c in [rng.choice(["xx", "yy"])]]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !!", "yy"), (None, "thiing thaand", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[d].lang_pred == c for d, _, c in rows if d is not None and d < 1000)
    assert [got[d].lang_pred for d in (1000, 1001, 1002, None)] == ["und", "und", "und", "xx"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs, langid.train(empty)).where("lang_pred != 'und'").count() == 0
    assert np.array_equal(langid.presence(["ab" * langid.PART_CHARS])[0], langid.presence(["abab", ])[0])
