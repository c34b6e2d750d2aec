"""Vector codes, language-model scores and filter audits against brute force, with nulls, empty and very long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from ocellus.llm import audit, lm, vector_codes
from ocellus.llm._shared import Table
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vector codes


def _vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.2, (6, 32))
    rows = [(k, (centres[k % 6] + rng.normal(0, 0.05, 32)).tolist(), k % 3 if k % 5 else None) for k in range(400)]
    rows += [(500 + k, rows[k][1], 1) for k in range(60)]  # ties
    rows += [(7, rows[8][1], 2), (None, rows[9][1], 0), (900, None, 1), (901, [0.1] * 31 + [None], 1), (902, [0.1] * 31 + [math.nan], 1)]
    rows += [(903, [-math.inf] + [0.0] * 31, 1), (904, [], 1), (905, [0.5] * 16, 1), (906, [0.5] * 17, 1), (907, [-0.001] * 32, None), (908, [3e38] * 32, 0)]
    return [(*r, "clash") for r in rows]


def _brute_codes(rows, parts, entries, rounds, scale):
    kept = [(v, label, np.array([min(max(math.floor(scale * np.float64(np.float32(x))), -(1 << 27)), 1 << 27) for x in e], dtype=object)) for v, e, label, _ in rows if e and all(x is not None and math.isfinite(x) for x in e) and len(e) == 32]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, tuple(r[2])))
    x = np.array([r[2] for r in kept]).reshape(len(kept), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        code = np.zeros((len(kept), parts), dtype=int)
        for i in range(len(kept)):
            for p in range(parts):
                d = ((book[p] - x[i, p]) ** 2).sum(axis=1)
                code[i, p] = min(range(len(d)), key=lambda e: (d[e], e))
        return code

    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    book[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code = assign()
    error = [int(sum(((x[i, p] - book[p, code[i, p]]) ** 2).sum() for p in range(parts))) for i in range(len(kept))]
    out = Counter((v, label, "".join(f"{c:02x}" for c in code[i]), error[i]) for i, (v, label, _) in enumerate(kept))
    return out, hashlib.sha256(",".join(str(int(c)) for c in book.reshape(-1)).encode()).hexdigest()


@pytest.mark.parametrize(("parts", "entries", "rounds", "scale"), [(16, 64, 2, 256), (4, 7, 5, 256), (8, 256, 1, 64), (1, 1, 2, 256)])
def test_vector_codes(spark, parts, entries, rounds, scale):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got, book = vector_codes.compress(df, parts, entries, rounds, scale)
    want, digest = _brute_codes(rows, parts, entries, rounds, scale)
    assert Counter((r.vec_id, r.label, r.code, r.error) for r in got.read().collect()) == want
    assert vector_codes.digest(book) == digest


def test_vector_codes_query(spark, tmp_path):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_code_compression(spark, str(tmp_path)).collect()
    want, digest = _brute_codes(rows, 16, 64, 2, 256)
    by_label = defaultdict(int)
    for (_, label, _, error), n in want.items():
        by_label[label] += n * error
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == Counter({(v, c, e, by_label[label], digest): n for (v, label, c, e), n in want.items()})
    empty, book = vector_codes.compress(df.limit(0))
    assert empty.read().count() == 0 and book.size == 0


def test_vector_bounds_skip_scans():
    """Later rounds scan few parts, and never differ from a full scan."""
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1, (8, 4))[rng.integers(0, 8, 5000)] * 100 + rng.normal(0, 3, (5000, 4))).astype(np.int64)
    book = x[:16].copy()
    code, upper, lower = (a.astype(t) for a, t in zip(vector_codes.scan(x, book), (np.int32, np.float32, np.float32), strict=True))
    scanned = []
    for _ in range(6):
        new = book.copy()
        for e in range(len(book)):
            if (code == e).any():
                new[e] = x[code == e].sum(axis=0) // np.count_nonzero(code == e)
        scanned.append(vector_codes.settle(x, new, vector_codes.Moves.between(book, new), code, upper, lower))
        book = new
        assert (code == vector_codes.scan(x, book)[0]).all()
        d = np.sqrt(vector_codes.squared(x, book))
        own = d[np.arange(len(x)), code]
        d[np.arange(len(x)), code] = np.inf
        assert (upper >= own).all() and (lower <= d.min(axis=1)).all()
    assert scanned[-1] < len(x) / 2


# --- language model


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, c string, net string, r string, ids string"


def _documents():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    nexts = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def say(n):
        w, out = rng.choice(vocabulary), []
        for _ in range(n):
            out.append(w if rng.random() > 0.02 else f"X{rng.randrange(10**6)}")
            w = rng.choice(nexts[w])
        return " ".join(out)

    texts = [None, "", " \n\t ", "one", "ONE One", "é ß É", "a " * 3000, "z" * 5000, say(30_000)] + [say(rng.randint(5, 400)) for _ in range(150)]
    return [(k, t, "en", "s", 0, *["clash"] * 6) for k, t in enumerate(texts)] + [(3, "other text", *[None] * 9), (None, "no id", *[None] * 9), (20, texts[20], *[None] * 9)]


def _held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


@pytest.fixture(scope="module")
def scored(spark):
    rows = _documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return rows, df, lm.score_documents(df, head=100, words=60).collect()


def _base(rows):
    tokens = [(r[0], [*WORDS.findall((r[1] or "").translate(LOWER)), None]) for r in rows]
    c = Counter(w for d, ws in tokens if not _held(d) for w in ws)
    return tokens, c, sum(c.values()), len(c)


def test_base_scores(scored):
    rows, _, got = scored
    tokens, c, total, distinct = _base(rows)
    want = sorted((str(d), _held(d), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 4)) for d, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_scores_are_those_of_whole_texts(spark, scored):
    """The network's path token by token, one document at a time, with the counts of all other words."""
    rows, df, got = scored
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    counts = Table(lm.word_counts(df.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1).select(F.coalesce("text", F.lit("")).alias("text"))))
    v = lm.vocabulary(counts.read(), 100, 60)
    encoded = Table(lm.encode(df, v))
    net = lm.train(encoded.read(), v)
    _, c, total, distinct = _base(rows)
    top = sorted(((n, w) for w, n in c.items() if w is not None), reverse=True)
    assert total == v.tokens and distinct == v.distinct and v.other_distinct == distinct - 59
    at = {}
    for r in encoded.read().select("doc_id", "ids", "n_tokens").collect():
        at.setdefault((r.doc_id, r.n_tokens), []).append(np.frombuffer(bytes(r.ids), dtype="<i2"))
    numbers = {}
    for doc_id, text, *_ in rows:
        ws = [*WORDS.findall((text or "").translate(LOWER)), None]
        own = at[(doc_id, len(ws))].pop()
        for w, k in zip(ws, own.tolist(), strict=True):
            assert numbers.setdefault(w, k) == k
        if len(ws) > 3000:
            continue
        h = net.back.shape[0]
        state, before, score = np.zeros(h), lm.END, 0.0
        for w, k in zip(ws, own.tolist(), strict=True):
            x = net.embed[before] @ net.into + net.bias
            a = state @ net.back
            g = 1 / (1 + np.exp(-(x[: 2 * h] + a[: 2 * h])))
            n = np.tanh(x[2 * h :] + g[:h] * a[2 * h :])
            state = (1 - g[h:]) * n + g[h:] * state
            cls = int(np.searchsorted(v.classes, k, side="right")) - 1
            for weights, bias, place in ((net.to_class.T, net.class_bias, cls), (net.to_word[v.classes[cls] : v.classes[cls + 1]], net.word_bias[v.classes[cls] : v.classes[cls + 1]], k - v.classes[cls])):
                if len(bias) > 1:
                    logit = weights @ state + bias
                    score += (logit[place] - np.log(np.exp(logit).sum())) / math.log(10)
            if k == lm.OTHER:
                score += math.log10((c[w] + 0.5) / (v.other_tokens + 0.5 * (v.other_distinct + 1)))
            before = k
        near = [r.score for r in got if r.doc_id == doc_id and r.n_tokens == len(ws)]
        assert any(abs(s - score) < 1e-3 * max(1, abs(score)) for s in near)
    assert {numbers[w] for _, w in top[:10]} <= set(range(2, 60)) and numbers[None] == lm.END


def test_network_learns_order(scored):
    """On documents it has not seen it beats the words' counts, which know nothing of their order."""
    _, _, got = scored
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_no_and_of_held_out_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score_documents(empty).count() == 0
    held = next(k for k in range(100) if _held(k))
    got = lm.score_documents(spark.createDataFrame([(held, "not a word is known", *[None] * 9)], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(6, 0, 0)] and math.isfinite(got[0].score) and got[0].base_score == pytest.approx(0)


def test_gradient_of_network():
    """Backpropagation against differences of the loss."""
    rng = np.random.default_rng(0)
    starts = lm.class_starts(np.concatenate(([5, 9], np.sort(rng.integers(1, 1000, 38))[::-1])), 8)
    net = lm.Network(*[a.astype(np.float64) for a in lm.Network.start(40, len(starts) - 1).arrays()])
    lanes = lm.Lanes([rng.integers(0, 40, n) for n in (30, 7, 12, 1, 5)], 3)
    at, real = next(lanes.windows(10))
    keep, state = (~lanes.fresh[at]).astype(float)[:, :, None], rng.normal(0, 0.1, (at.shape[1], lm.HIDDEN))
    run = lambda: lm.gradient(net, starts, lanes.before[at], lanes.token[at], real, keep, state)
    _, grad, _ = run()
    for w, g in zip(net.arrays(), grad.arrays(), strict=True):
        for _ in range(5):
            i = tuple(rng.integers(0, n) for n in w.shape)
            old, up, down = w[i], 0.0, 0.0
            w[i], up = old + 1e-3, 0
            up = run()[0]
            w[i] = old - 1e-3
            down = run()[0]
            w[i] = old
            assert abs((up - down) / 2e-3 - g[i]) < 1e-4


def test_classes_and_lanes():
    starts = lm.class_starts(np.array([50, 10, *range(1000, 0, -1)]), 16)
    assert starts[0] == 0 and starts[1] == 1 and starts[-1] == 1002 and (np.diff(starts) > 0).all() and len(starts) <= 17
    docs = [np.full(n, k, dtype=np.int16) for k, n in enumerate((5, 1, 9, 2, 2, 7))]
    lanes, seen = lm.Lanes(docs, 2), defaultdict(int)
    for at, real in lanes.windows(4):
        for d in lanes.doc[at][real].tolist():
            seen[d] += 1
    assert [seen[k] for k in range(6)] == [5, 1, 9, 2, 2, 7] and lanes.fresh.sum() == 6 and abs(int(lanes.load[0]) - int(lanes.load[1])) <= 2


# --- filter audit


def _audited():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [None, "", "short", "A B C", "x # y", " ".join(rng.choice(vocabulary) for _ in range(300)), "same " * 250, " ".join(f"W{k}" for k in range(250)), "é" * 300, "|" + "b " * 210]
    rows = []
    for k in range(300):
        t = rng.choice(texts) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary[: rng.choice([20, 3000])]) + rng.choice(["", "", "", "X", "$"] if k % 3 else [""]) for _ in range(rng.randint(150, 300)))
        rows.append((k, t, rng.choice(["a", "b", None, ""]), "clash"))
    rows += [(None, "short", "a", "x"), (5, rows[9][1], "a", "x"), (9, rows[9][1], "a", "x")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1), (4, 0, 1)]
    return rows, labels


def _brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = defaultdict(list)
    for d, t, source, _ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = "".join(name for name, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t) is not None, d is not None and d > least[t]), strict=True) if f)
        docs[source or ""].append((fails, d in good, d in toxic))
    out, shapley = [], defaultdict(int)
    for part, held in docs.items():
        for order in permutations("ABCDE"):
            left, gone = list(held), []
            for step, name in enumerate(order, 1):
                out_now = [x for x in left if name in x[0]]
                redundant = sum(name in x[0] for x in gone)
                left = [x for x in left if name not in x[0]]
                gone += out_now
                shapley[part, name] += len(out_now)
                out.append((part, "".join(order), step, len(left), len(out_now), redundant, sum(x[0] == name for x in held), sum(x[1] for x in out_now), sum(x[2] for x in out_now), name))
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def test_filter_audit(spark, tmp_path):
    rows, labels = _audited()
    spark.createDataFrame(rows, "doc_id long, text string, source string, bits string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = audit.op13_filter_interaction_audit(spark, str(tmp_path))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == _brute_audit(rows, labels)
    assert audit.audit(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), spark.read.parquet(f"{tmp_path}/labels.parquet")).count() == 0


def test_audit_index_of_many_parts(monkeypatch):
    """Parts of all sizes, and more than a task holds at once, against plain counts."""
    rng = np.random.default_rng(5)
    part, bits = rng.zipf(1.3, 4000) % 700, rng.integers(0, 32, 4000)
    labels = [rng.integers(0, 2, 4000) == 1, rng.integers(0, 5, 4000) == 1]
    got = audit.subset_counts(part, 700, bits, labels) if len(np.unique(part)) == 700 else None
    names, codes = np.unique(part, return_inverse=True)
    got = audit.subset_counts(codes, len(names), bits, labels)
    for k in (0, 1, len(names) // 2, len(names) - 1):
        for subset in range(32):
            alive = (codes == k) & (bits & subset == 0)
            assert got[k, subset].tolist() == [alive.sum(), (alive & labels[0]).sum(), (alive & labels[1]).sum()]


def test_audit_of_long_texts():
    """A text of one very long word, and one of very many, byte by byte."""
    texts = ["q" * 5_000_000, "ab cD " * 400_000, "", "é#"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    got = audit.failures(np.frombuffer(b"".join(raw), dtype=np.uint8), off)
    assert got.tolist() == [1, 2 + 4, 1, 1 + 8]
