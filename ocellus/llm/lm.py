"""Scores of whole documents by a gated recurrent language model, beside smoothed word counts.

Counts of all words of all training documents are made by Spark and stay in a
table. The network knows the most frequent words by number and all others as
one: its output is a softmax over classes, cut from the frequency order at
equal shares of the square roots of counts, and a softmax within a class; the
class of other words shares its probability out by their smoothed counts, so
rare words cost what the whole corpus says of them.

Training: one task starts from a bounded share of the training documents, then
every partition goes through all training documents it holds by truncated
backpropagation, from the same start, and the partitions' weights are averaged
by their tokens, block by block. Windows of many documents run side by side in
lanes; a lane takes its next document when one ends, and the state is carried
from window to window and set to zero at a document's first token, so a score
is that of the complete text however long it is.

Words of the HEAD most frequent are looked up in each task (at most HEAD
hashes and counts are sent there); the others, which are not hot, are joined
to the table of counts.

Cases: a null text counts as empty and is the end alone; a null doc_id's crc32
is an empty text's, so its text is learned from; each row is a document of its
own, whatever doc_id it shares; without training documents all counts are 0 and
the network scores as it starts; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm._shared import Table, bucket, documents
from ocellus.llm._text import LOWER, PLAIN, U64, give_back, mix, slices, span_hash, spans, utf8

#: Words that tasks look up themselves, and words that the network knows by number.
HEAD, WORDS = 1 << 19, 1024
EMBED, HIDDEN, CLASSES = 12, 12, 24
#: Documents side by side, tokens of a window of training and of scoring, and tokens held at once.
LANES, WINDOW, SCORE_WINDOW, BUFFER = 512, 16, 32, 1 << 20
#: Tokens that the first task learns from, and its passes over a smaller table.
WARM_TOKENS, WARM_PASSES = 1 << 21, 8
RATE, MAX_NORM = 0.05, 1.0
#: Logits up to this, either way, need no shift before their exponential.
MAX_LOGIT = 60.0
#: Blocks that a network's weights are averaged in.
BLOCKS = 64
OTHER, END = 0, 1
END_HASH = int(mix(np.array([0x656E64], dtype=U64)).view(np.int64)[0])
#: Word counts that a counting task holds before it sends them on.
HELD_COUNTS = 1 << 20
ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, other_sum double, n_other long, ids binary, rare array<long>, rare_n array<int>"
)
KEPT = ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "other_sum", "n_other"]


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of whole texts and how often each occurs, added up within the task while they are few."""
    hs, cs, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate(hs), np.concatenate(cs))

    for batch in batches:
        b, off = utf8(batch.column(0))
        for i, j in slices(off):
            low = LOWER[b[off[i] : off[j]]]
            starts, ends, _ = spans(low, off[i : j + 1] - off[i], PLAIN)
            h = span_hash(low, starts, ends).view(np.int64)
            h, c = _summed(np.append(h, END_HASH), np.append(np.ones(len(h), np.int64), j - i))
            hs.append(h)
            cs.append(c)
            held += len(h)
            if held > 2 * HELD_COUNTS:
                h, c = merged()
                hs, cs, held = [h], [c], len(h)
                if held > HELD_COUNTS:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])
                    hs, cs, held = [], [], 0
    if hs:
        h, c = merged()
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])
    give_back()


def word_counts(texts: DataFrame) -> DataFrame:
    """h, c: the hash of each word (and of the end) and its number, over the column text."""
    return texts.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words: sorted hashes, counts and numbers in the network; where each class of numbers begins; totals of all words."""

    h: np.ndarray
    c: np.ndarray
    number: np.ndarray
    classes: np.ndarray
    tokens: int
    distinct: int
    other_tokens: int
    other_distinct: int

    @property
    def base(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    @property
    def other(self) -> float:
        return float(np.log10(self.other_tokens + 0.5 * (self.other_distinct + 1)))


def class_starts(c: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Where each class of numbers begins and the last ends, for counts by number: OTHER alone, then equal shares of the counts' square roots."""
    if len(c) < 2:
        return np.arange(len(c) + 1)
    mass = np.cumsum(np.sqrt(c[1:] + 0.5))
    own = np.minimum((mass - 1e-9) / mass[-1] * (classes - 1), classes - 2).astype(np.int64)
    return np.concatenate(([0], 1 + np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))), [len(c)]))


def vocabulary(counts: DataFrame, head: int = HEAD, words: int = WORDS) -> Vocabulary:
    """From a written table of counts. A histogram of their logarithms says first which counts at most head words reach; only those are fetched."""
    level = F.floor(F.log2("c") * 64).cast("int")
    found = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), key=lambda r: -r.level)
    tokens, distinct, sent, least = sum(r.c for r in found), sum(r.n for r in found), 0, None
    for r in found:
        sent += r.n
        if sent > head - 1:
            break
        least = r.level
    frequent = (level >= least) if least is not None else F.lit(False)
    got = counts.where(frequent | (F.col("h") == END_HASH)).toPandas()
    h, c = got["h"].to_numpy(dtype=np.int64), got["c"].to_numpy(dtype=np.int64)
    if END_HASH not in h:
        h, c = np.append(h, END_HASH), np.append(c, 0)
    order = np.argsort(h)
    h, c = h[order], c[order]
    by_count = np.lexsort((h, -c))
    by_count = by_count[h[by_count] != END_HASH][: words - 2]
    number = np.zeros(len(h), dtype=np.int16)
    number[h == END_HASH] = END
    number[by_count] = np.arange(2, 2 + len(by_count))
    by_number = np.concatenate(([0], c[h == END_HASH], c[by_count]))
    own = int(by_number.sum())
    return Vocabulary(h, c, number, class_starts(by_number), tokens, distinct, tokens - own, distinct - int((by_number > 0).sum()))


def _encode(v: Vocabulary):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "other_sum", "n_other", "ids", "rare", "rare_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.log10(v.c + 0.5)
        for batch in batches:
            b, off = utf8(batch.column(2))
            for i, j in slices(off):
                low = LOWER[b[off[i] : off[j]]]
                starts, ends, first = spans(low, off[i : j + 1] - off[i], PLAIN)
                n = np.diff(first) + 1
                last = np.cumsum(n) - 1
                h = np.full(last[-1] + 1, END_HASH, dtype=np.int64)
                inside = np.ones(len(h), dtype=bool)
                inside[last] = False
                h[inside] = span_hash(low, starts, ends).view(np.int64)
                doc = np.repeat(np.arange(j - i), n)
                at = np.minimum(np.searchsorted(v.h, h), len(v.h) - 1)
                head = v.h[at] == h
                number = np.where(head, v.number[at], OTHER).astype("<i2")
                base = np.where(head, weight[at], 0.0)
                other = number == OTHER
                per = lambda x: np.bincount(doc, weights=x, minlength=j - i)  # noqa: B023, E731
                order = np.lexsort((h[~head], doc[~head]))
                rare_doc, rare = doc[~head][order], h[~head][order]
                new = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rare))).astype(np.int32)
                cuts = pa.array(np.searchsorted(rare_doc[new], np.arange(j - i + 1)).astype(np.int32))
                raw, ends_of = number.tobytes(), (2 * (last + 1)).tolist()
                ids = [raw[s:e] for s, e in zip([0, *ends_of[:-1]], ends_of, strict=True)]
                known = per(head & (v.c[at] > 0)).astype(np.int64)
                arrays = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(known), pa.array(per(base)), pa.array(per(base * other))]
                arrays += [pa.array(per(other).astype(np.int64)), pa.array(ids, pa.binary())]
                arrays += [pa.ListArray.from_arrays(cuts, pa.array(rare[new])), pa.ListArray.from_arrays(cuts, pa.array(times))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return run


@dataclass
class Network:
    """Weights of the recurrent network, or gradients of the same shapes."""

    embed: np.ndarray
    into: np.ndarray
    bias: np.ndarray
    back: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def start(cls, words: int, classes: int, embed: int = EMBED, hidden: int = HIDDEN, seed: int = 12) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0] if shape[0] < 100 else shape[1]), shape).astype(np.float32)
        zero = lambda n: np.zeros(n, dtype=np.float32)
        return cls(draw(words, embed), draw(embed, 3 * hidden), zero(3 * hidden), draw(hidden, 3 * hidden), 0.1 * draw(hidden, classes), zero(classes), 0.1 * draw(words, hidden), zero(words))

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def like(self, fill: float) -> Network:
        return Network(*[np.full_like(a, fill) for a in self.arrays()])

    def copy(self) -> Network:
        return Network(*[a.copy() for a in self.arrays()])

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.arrays()])

    def filled(self, values: np.ndarray) -> Network:
        """A network of these shapes with the values of a flat array."""
        out, at = [], 0
        for a in self.arrays():
            out.append(values[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)


class Lanes:
    """Documents in lanes side by side, the longest first, each in the lane with the least before it."""

    def __init__(self, docs: list[np.ndarray], lanes: int = LANES):
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        free = [(0, k) for k in range(min(lanes, len(docs)))]
        own: list[list[int]] = [[] for _ in free]
        for d in np.argsort(-lengths, kind="stable").tolist():
            load, k = heapq.heappop(free)
            own[k].append(d)
            heapq.heappush(free, (load + int(lengths[d]), k))
        loads = np.array([sum(int(lengths[d]) for d in ds) for ds in own], dtype=np.int64)
        order = np.argsort(-loads, kind="stable")
        placed = [d for k in order for d in own[k]]
        self.load = loads[order]
        self.first = np.cumsum(self.load) - self.load
        self.token = np.concatenate([docs[d] for d in placed]).astype(np.int64)
        self.doc = np.repeat(np.array(placed, dtype=np.int64), lengths[placed])
        self.fresh = np.zeros(len(self.token), dtype=bool)
        self.fresh[np.cumsum(lengths[placed]) - lengths[placed]] = True
        self.before = np.concatenate(([END], self.token[:-1]))
        self.before[self.fresh] = END

    def windows(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (time, lane) of each window, and which are real; lanes that have ended are left out."""
        for t in range(0, int(self.load[0]) if len(self.load) else 0, width):
            active = int(np.count_nonzero(self.load > t))
            time = np.arange(t, min(t + width, int(self.load[0])))[:, None]
            real = time < self.load[:active]
            yield np.where(real, self.first[:active] + time, 0), real


def one_thread() -> None:
    """Let the library of matrix products use one thread in this process: tasks use the cores already, and threads that wait for small products burn as much again."""
    with contextlib.suppress(OSError), open("/proc/self/maps") as maps:
        for path in {line.split()[-1] for line in maps if "openblas" in line}:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.tanh(x * np.float32(0.5))
    out += np.float32(1)
    out *= np.float32(0.5)
    return out


def _states(net: Network, pushed: np.ndarray, keep: np.ndarray, state: np.ndarray, trace: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each token of a window (time, lane, hidden), and the last; pushed: what the inputs add to the gates."""
    steps, lanes, _ = pushed.shape
    h = net.back.shape[0]
    out = np.empty((steps, lanes, h), dtype=pushed.dtype)
    if trace is not None:
        for name, width in (("old", h), ("gates", 2 * h), ("new", h), ("held", h)):
            trace[name] = np.empty((steps, lanes, width), dtype=pushed.dtype)
    for t in range(steps):
        state = state * keep[t]
        a = state @ net.back
        g = _sigmoid(pushed[t, :, : 2 * h] + a[:, : 2 * h])
        n = np.tanh(pushed[t, :, 2 * h :] + g[:, :h] * a[:, 2 * h :])
        if trace is not None:
            trace["old"][t], trace["gates"][t], trace["new"][t], trace["held"][t] = state, g, n, a[:, 2 * h :]
        state = n + g[:, h:] * (state - n)
        out[t] = state
    return out, state


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit can leave the range of exp in single precision: states lie between -1 and 1. weights: a row for each logit."""
    return len(bias) < 1 << 12 and float((np.abs(weights).sum(axis=1) + np.abs(bias)).max()) < MAX_LOGIT


def _softmax(logits: np.ndarray, place: tuple[np.ndarray, np.ndarray], small: bool, shares: bool) -> np.ndarray:
    """Natural logarithms of the softmax at place, a place for each row. The logits are overwritten: by the shares less 1 at place, if these are wanted."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    said = logits[place].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], dtype=logits.dtype)
    if shares:
        logits *= (1 / total)[:, None]
        logits[place] -= 1
    return said - np.log(total)


def _log_probabilities(net: Network, starts: np.ndarray, said: np.ndarray, state: np.ndarray, grad: Network | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithm of the probability of each token said, and the loss's gradient by the states.

    Tokens are put in order of their numbers, so a class is a range of them and of the weights.
    """
    order = np.argsort(said.astype(np.int16), kind="stable")
    said, state = said[order], state[order]
    own = np.searchsorted(starts, said, side="right") - 1
    rows = np.arange(len(said))
    d = state @ net.to_class + net.class_bias
    out, d_state = _softmax(d, (rows, own), _small(net.to_class.T, net.class_bias), grad is not None), None
    if grad is not None:
        grad.to_class += state.T @ d
        grad.class_bias += d.sum(axis=0)
        d_state = d @ net.to_class.T
    cuts, small = np.searchsorted(own, np.arange(len(starts))), _small(net.to_word, net.word_bias)
    for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(starts) > 1)).tolist():
        s, e, a, z = cuts[k], cuts[k + 1], starts[k], starts[k + 1]
        d = state[s:e] @ net.to_word[a:z].T
        d += net.word_bias[a:z]
        out[s:e] += _softmax(d, (rows[: e - s], said[s:e] - a), small, grad is not None)
        if grad is not None:
            grad.to_word[a:z] += d.T @ state[s:e]
            grad.word_bias[a:z] += d.sum(axis=0)
            d_state[s:e] += d @ net.to_word[a:z]
    back = np.empty(len(order), dtype=np.int64)
    back[order] = rows
    return out[back], d_state[back] if grad is not None else None


def gradient(net: Network, starts: np.ndarray, x: np.ndarray, said: np.ndarray, real: np.ndarray, keep: np.ndarray, state: np.ndarray) -> tuple[float, Network, np.ndarray]:
    """Loss of a window, its gradient by backpropagation within the window, and the state to carry on."""
    h = net.back.shape[0]
    grad, trace = net.like(0.0), {}
    put = net.embed[x]
    states, state = _states(net, put @ net.into + net.bias, keep, state, trace)
    logs, d_real = _log_probabilities(net, starts, said[real], states[real], grad)
    d_states = np.zeros_like(states)
    d_states[real] = d_real
    old, n, r, z = trace["old"], trace["new"], trace["gates"][:, :, :h], trace["gates"][:, :, h:]
    to_new, to_reset, to_update = (1 - z) * (1 - n * n), trace["held"] * (r * (1 - r)), (old - n) * (z * (1 - z))
    d_new, d_gates = np.empty_like(states), np.empty((*x.shape, 3 * h), states.dtype)
    later = np.zeros_like(state)
    for t in range(len(x) - 1, -1, -1):
        later += d_states[t]
        own = np.multiply(later, to_new[t], out=d_new[t])
        np.multiply(own, to_reset[t], out=d_gates[t, :, :h])
        np.multiply(later, to_update[t], out=d_gates[t, :, h : 2 * h])
        np.multiply(own, r[t], out=d_gates[t, :, 2 * h :])
        later *= z[t]
        later += d_gates[t] @ net.back.T
        later *= keep[t]
    grad.back += old.reshape(-1, h).T @ d_gates.reshape(-1, 3 * h)
    d_gates[:, :, 2 * h :] = d_new
    flat = d_gates.reshape(-1, 3 * h)
    grad.bias += flat.sum(axis=0)
    grad.into += put.reshape(len(flat), -1).T @ flat
    ids = x.reshape(-1)
    order = np.argsort(ids.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) > 0)))
    grad.embed[ids[order][first]] = np.add.reduceat((flat @ net.into.T)[order], first, axis=0)
    return -float(logs.sum()), grad, state


class Trainer:
    """Truncated backpropagation with a step size of its own for each weight."""

    def __init__(self, net: Network, starts: np.ndarray, rate: float = RATE):
        self.net, self.starts, self.rate, self.seen, self.loss = net, starts, rate, net.like(1e-4), 0.0
        self.tokens = 0

    def learn(self, docs: list[np.ndarray], limit: int | None = None) -> None:
        lanes = Lanes(docs)
        state = np.zeros((len(lanes.load), self.net.back.shape[0]), dtype=np.float32)
        for at, real in lanes.windows(WINDOW):
            if limit is not None and self.tokens >= limit:
                return
            keep = (~lanes.fresh[at]).astype(np.float32)[:, :, None]
            loss, grad, last = gradient(self.net, self.starts, lanes.before[at], lanes.token[at], real, keep, state[: at.shape[1]])
            state = last
            n = int(np.count_nonzero(real))
            self.step(grad, n)
            self.tokens += n
            self.loss += loss

    def step(self, grad: Network, n: int) -> None:
        scale = 1.0 / max(n, 1)
        norm = scale * np.sqrt(sum(float((g.reshape(-1) @ g.reshape(-1))) for g in grad.arrays()))
        scale *= min(1.0, MAX_NORM / max(norm, 1e-12))
        for w, g, s in zip(self.net.arrays(), grad.arrays(), self.seen.arrays(), strict=True):
            g *= np.float32(scale)
            s += g * g
            w -= np.float32(self.rate) * g / np.sqrt(s)


def scores(net: Network, starts: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the network's probability of each document's numbers."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    pushed = net.embed @ net.into + net.bias
    lanes = Lanes(docs)
    state = np.zeros((len(lanes.load), net.back.shape[0]), dtype=np.float32)
    for at, real in lanes.windows(SCORE_WINDOW):
        keep = (~lanes.fresh[at]).astype(np.float32)[:, :, None]
        states, state = _states(net, pushed[lanes.before[at]], keep, state[: at.shape[1]])
        logs, _ = _log_probabilities(net, starts, lanes.token[at][real], states[real])
        total += np.bincount(lanes.doc[at][real], weights=logs, minlength=len(docs))
    return total


def _buffers(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows whose documents have about BUFFER tokens together, or one row with more."""
    rows, docs, size = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            own = [np.frombuffer(x, dtype="<i2") for x in part.column(column).to_pylist()]
            rows.append(part)
            docs += own
            size += sum(map(len, own))
            if size >= BUFFER:
                yield pa.Table.from_batches(rows), docs
                rows, docs, size = [], [], 0
    if docs:
        yield pa.Table.from_batches(rows), docs


def _blocks(values: np.ndarray, tokens: int) -> pa.RecordBatch:
    parts = np.array_split(values, BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([tokens] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "tokens", "values"])


_WEIGHTS = "block int, tokens long, values binary"


def _train(net: Network, starts: np.ndarray, warm: bool):
    """Weights after this partition's documents, times their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        trainer = Trainer(net.copy(), starts, RATE if warm else RATE / 4)
        if warm:
            seen = [docs for _, docs in _buffers(batches, 0)]
            for _ in range(WARM_PASSES):
                for docs in seen:
                    trainer.learn(docs, WARM_TOKENS)
        else:
            for _, docs in _buffers(batches, 0):
                trainer.learn(docs)
        if trainer.tokens:
            yield _blocks(trainer.net.flat().astype(np.float64) * trainer.tokens, trainer.tokens)
        give_back()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each block, as rows stream by."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for block, tokens, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n, before = total.get(block, (0, 0.0))
            total[block] = n + tokens, before + np.frombuffer(values, dtype=np.float64)
    if total:
        columns = [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v.tobytes() for _, v in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "tokens", "values"])


def _averaged(net: Network, made: DataFrame) -> Network:
    """The mean of the partitions' networks by their tokens: a sum for each block reaches the driver."""
    rows = sorted(made.repartition(BLOCKS, "block").mapInArrow(_add_up, _WEIGHTS).collect())
    if not rows:
        return net
    return net.filled(np.concatenate([np.frombuffer(bytes(r["values"]), dtype=np.float64) / r["tokens"] for r in rows]))


def train(encoded: DataFrame, v: Vocabulary, warm_tokens: int = WARM_TOKENS) -> Network:
    """A network from all rows of encoded (a written table) that are not held out."""
    rows = encoded.where("NOT held_out")
    net = Network.start(int(v.classes[-1]), len(v.classes) - 1)
    net.class_bias[:] = np.log(np.maximum([_mass(v, k) for k in range(len(v.classes) - 1)], 0.5) / max(v.tokens, 1)).astype(np.float32)
    share = int(min(1.0, warm_tokens / max(v.tokens, 1)) * (1 << 30))
    first = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share).select("ids").repartition(1)
    net = _averaged(net, first.mapInArrow(_train(net, v.classes, True), _WEIGHTS))
    return _averaged(net, rows.select("ids").mapInArrow(_train(net, v.classes, False), _WEIGHTS))


def _mass(v: Vocabulary, k: int) -> int:
    """Tokens of a class."""
    if k == OTHER:
        return v.other_tokens
    inside = (v.number >= v.classes[k]) & (v.number < v.classes[k + 1])
    return int(v.c[inside].sum())


def _score(net: Network, starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for rows, docs in _buffers(batches, len(KEPT)):
            said = rows.select(KEPT).append_column("net", pa.array(scores(net, starts, docs) / np.log(10)))
            yield from said.to_batches()
        give_back()

    return run


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """For each document its numbers in the network, sums over the words of the vocabulary, and the words outside it; key tells rows apart once written."""
    rows = docs.select(F.col("doc_id").cast("long"), (bucket(F.col("doc_id"), 5) == 1).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(v), ENCODED).withColumn("key", F.monotonically_increasing_id())


def score_documents(docs: DataFrame, head: int = HEAD, words: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    counts = Table(word_counts(docs.where(bucket(F.col("doc_id"), 5) != 1).select(F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    v = vocabulary(counts.read(), head, words)
    encoded = Table(encode(docs, v))
    net = train(encoded.read(), v)
    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, other_sum double, n_other long, net double"
    scored = encoded.read().select(*KEPT, "ids").mapInArrow(_score(net, v.classes), schema)
    rare = encoded.read().where(F.size("rare") > 0).select("key", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("key", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("n"))
    met = rare.join(counts.read(), "h", "left").select("key", "n", F.coalesce("c", F.lit(0)).alias("c"))
    sums = met.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    out = Table(scored.join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") + rare_sum - F.col("n_tokens") * F.lit(v.base)).alias("base_score"), (F.col("net") + F.col("other_sum") + rare_sum - F.col("n_other") * F.lit(v.other)).alias("score"),
    ))
    encoded.drop()
    counts.drop()
    return out.read()


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
