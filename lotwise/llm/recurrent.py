"""A gated recurrent language model in numpy, and its fit and use on a corpus.

The next token's class follows from a softmax over classes, the token from a softmax within its class.  Frequent words
have learnt weights within classes of similar frequency; the others form classes by their shape, within which a word has
the share of its smoothed count in the whole training corpus.  So every word, seen or not, has a probability.  Documents
are read to their ends with the state carried from window to window; training backpropagates within a window.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import SLICE, kept_apart, list_array, nonempty, schema_of, slices, texts_of, training_row, words_of, written

#: The end of a document; no word is empty.
END = ""
#: Words with weights of their own at least, words whose counts are broadcast, units of the state, tokens of a window, lanes
#: in training and in scoring.
WORDS, COUNTED, UNITS, WINDOW, LANES, READING = 2_000, 200_000, 16, 32, 512, 1_024
SHAPES = 32
#: Every word that occurs so often has weights of its own, so that their number grows with the corpus.
OFTEN = 1_000
#: Documents that one task makes the common start from, and the times that the parts' weights are averaged.
START_DOCS, ROUNDS = 400, 2
#: A round has the root of its tokens over this number of parts, so that parts and their sizes grow alike.
PART_TOKENS = 500_000
#: Tokens that a worker lays out at a time, and updates that a pass over them should make, with fewer lanes if need be.
TOGETHER, UPDATES = 1 << 22, 200


def shape(word: str) -> int:
    """Class of a word without weights of its own: its last character's kind, its foreign letters and its length."""
    last = word[-1:]
    end = 0 if last.isalpha() else 1 if last == "." else 2 if last == "," else 3
    odd = 0 if word.isascii() else next(ord(c) for c in word if ord(c) > 127)
    return end * 8 + (1 + odd % 3 if odd else 0) * 2 + (len(word) > 6)


@dataclass
class Vocabulary:
    """Counts and classes; ``code`` gives places 0 to ``words`` - 1 to words with weights, further ones to counted words."""

    code: dict[str, int]
    words: int
    word_class: np.ndarray
    members: list[np.ndarray]
    log_count: np.ndarray
    class_of: np.ndarray
    tail_total: np.ndarray
    tokens: int
    types: int
    slot: np.ndarray = field(default=None)

    @property
    def classes(self) -> int:
        return len(self.members) + SHAPES


def vocabulary(counts: DataFrame, words: int = WORDS, counted: int = COUNTED) -> Vocabulary:
    """From (word, shape, n) over all training documents; the most frequent words come to the driver."""
    total = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") >= OFTEN)).first()
    words = max(words, int(total[2]))
    top = counts.orderBy(F.desc("n"), "word").limit(max(counted, words)).toArrow().to_pandas()
    code = {w: i for i, w in enumerate(top.word)}
    k, n = min(words, len(top)), top.n.to_numpy(np.float64)
    root = np.cumsum(np.sqrt(n[:k]))
    bins = np.floor(root / max(1.0, root[-1] if k else 1.0) * 24 * 0.999999).astype(int)
    word_class, size, most = np.zeros(k, np.int64), 0, max(64, int(1.3 * math.sqrt(k)))
    for i in range(1, k):
        size = size + 1
        new = (bins[i] != bins[i - 1] and size >= most // 4 or bins[i] < 8 and bins[i] != bins[i - 1]) or size >= most
        word_class[i] = word_class[i - 1] + new
        size = 0 if new else size
    members = [np.flatnonzero(word_class == c) for c in range(int(word_class[-1]) + 1 if k else 0)]
    slot = np.concatenate([np.arange(len(m)) for m in members]) if members else np.zeros(0, np.int64)
    tails = np.full(SHAPES, 0.5)
    for r in counts.groupBy("shape").agg(F.sum(F.col("n") + 0.5).alias("z")).collect():
        tails[r["shape"]] += r.z
    np.subtract.at(tails, top["shape"].to_numpy()[:k], n[:k] + 0.5)
    class_of = np.concatenate([word_class, len(members) + top["shape"].to_numpy()[k:]]).astype(np.int64)
    return Vocabulary(code, k, word_class, members, np.log10(n + 0.5), class_of, np.log10(np.maximum(tails, 0.5)), int(total[0] or 0), int(total[1]), slot)


def parameters(v: Vocabulary, units: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; inputs are words, shapes and a mark for the start."""
    r = np.random.default_rng(seed)
    wide = max((len(m) for m in v.members), default=1)
    make = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
    p = {"input": make(v.words + SHAPES + 1, 3 * units), "state": make(units, 3 * units), "to_class": make(units, v.classes), "class_bias": np.zeros(v.classes, np.float32), "to_word": make(max(1, len(v.members)), units, wide), "word_bias": np.full((max(1, len(v.members)), wide), -30, np.float32)}
    for c, m in enumerate(v.members):
        p["word_bias"][c, : len(m)] = np.log(10.0) * v.log_count[m] - np.log(10.0) * v.log_count[m].max()
    return p


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """The hyperbolic tangent, in place, by the exponential, which is the faster."""
    x *= 2
    sigmoid(x)
    x *= 2
    x -= 1
    return x


#: Rows whose scores of all classes fit a core's cache.
CACHED = 512


class Lanes:
    """Documents laid end to end in parallel lanes, which are read in step; the longest lane comes first.

    Tokens are kept without padding, lane after lane; only a window is laid out in full.
    """

    def __init__(self, inputs: list[np.ndarray], targets: list[np.ndarray], lanes: int):
        lanes = max(1, min(lanes, len(inputs)))
        heap, dealt = [(0, j) for j in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(inputs)), key=lambda i: -len(inputs[i])):
            length, j = heapq.heappop(heap)
            dealt[j].append(i)
            heapq.heappush(heap, (length + len(inputs[i]), j))
        dealt.sort(key=lambda own: -sum(len(inputs[i]) for i in own))
        self.lengths = np.array([sum(len(inputs[i]) for i in own) for own in dealt])
        self.starts = np.cumsum(self.lengths) - self.lengths
        order = [i for own in dealt for i in own]
        sizes = np.array([len(inputs[i]) for i in order], np.int64)
        empty = [np.zeros(0, np.int32)]
        self.inputs, self.targets = (np.concatenate([x[i] for i in order] or empty) for x in (inputs, targets))
        self.document = np.repeat(np.array(order, np.int32), sizes)
        self.carries = np.ones(len(self.document), np.float32)
        self.carries[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0

    def windows(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Live lanes, and inputs, targets, documents (-1 beyond a lane's end) and carries by step and lane, of each window."""
        longest = int(self.lengths.max(initial=0))
        for lo in range(0, longest, size):
            live = int(np.searchsorted(-self.lengths, -lo, "left"))
            step = np.arange(lo, min(lo + size, longest))[:, None]
            real = step < self.lengths[:live]
            at = np.where(real, self.starts[:live] + step, 0)
            yield live, np.where(real, self.inputs[at], 0), np.where(real, self.targets[at], 0), np.where(real, self.document[at], -1), np.where(real, self.carries[at], np.float32(1))


class Network:
    """The recurrent network: forward with log-probabilities, and truncated backpropagation."""

    def __init__(self, v: Vocabulary, p: dict[str, np.ndarray]):
        self.v, self.p, self.units = v, p, p["state"].shape[0]
        self.of_class = v.class_of
        self.rate = 0.1
        self.squares = {k: np.full_like(x, 1e-4) for k, x in p.items()}

    def forward(self, inputs: np.ndarray, carries: np.ndarray, h: np.ndarray, keep: bool = False):
        """States of a window (steps, lanes, units), and what backpropagation needs of it."""
        u, w = self.units, self.p["state"]
        x = self.p["input"][inputs]
        to_gates, to_new = np.ascontiguousarray(x[..., : 2 * u]), np.ascontiguousarray(x[..., 2 * u :])
        states = np.empty((*inputs.shape, u), x.dtype)
        before_, inner_ = (np.empty((*inputs.shape, u), x.dtype) for _ in range(2)) if keep else (None, None)
        for t in range(len(inputs)):
            before = h * carries[t][:, None]
            a = before @ w
            gates, new, inner = to_gates[t], to_new[t], a[:, 2 * u :]
            gates += a[:, : 2 * u]
            sigmoid(gates)
            new += gates[:, u:] * inner
            tanh(new)
            h = before - new
            h *= gates[:, :u]
            h += new
            states[t] = h
            if keep:
                before_[t], inner_[t] = before, inner
        return states, (before_, to_gates, to_new, inner_), h

    def outputs(self, states: np.ndarray, targets: np.ndarray, learn: bool = False):
        """Natural log of each target's class and, for words with weights, of the word in its class."""
        p, k = self.p, self.v.words
        cls = np.where(targets < k, self.v.word_class[np.minimum(targets, max(0, k - 1))], targets - k + len(self.v.members)) if k else targets + len(self.v.members)
        rows, kind = np.arange(len(targets)), states.dtype
        w, bias = p["to_class"], p["class_bias"]
        ones, safe = np.ones(len(bias), kind), float((np.abs(w).sum(axis=0) + np.abs(bias)).max()) < 60
        both, given = np.concatenate([w, bias[None]]), np.concatenate([states, np.ones((len(states), 1), kind)], axis=1)
        out, grads = np.empty(len(targets), kind), {}
        if learn:
            grad, back = np.zeros_like(both), np.empty_like(states)
        for lo in range(0, len(targets), CACHED):
            s, c = given[lo : lo + CACHED], cls[lo : lo + CACHED]
            own = rows[: len(c)]
            e = s @ both
            if not safe:
                np.minimum(e, 60, out=e)
            one = e[own, c]
            np.exp(e, out=e)
            total = e @ ones
            out[lo : lo + CACHED] = one - np.log(total)
            if learn:
                e *= (1 / total)[:, None]
                e[own, c] -= 1
                grad += s.T @ e
                back[lo : lo + CACHED] = e @ w.T
        order = np.argsort(cls.astype(np.int16) if self.v.classes < 1 << 15 else cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.v.members) + 1))
        inside = order[: cuts[-1]]
        s_all, slots, more = states[inside], self.v.slot[targets[inside]] if k else targets[inside], np.zeros(len(inside), kind)
        if learn:
            grads["to_class"], grads["class_bias"] = grad[:-1], grad[-1]
            grads["to_word"], grads["word_bias"] = np.zeros_like(p["to_word"]), np.zeros_like(p["word_bias"])
            back_in = np.zeros_like(s_all)
        for c, m in enumerate(self.v.members):
            lo, hi = cuts[c], cuts[c + 1]
            if hi > lo and len(m) > 1:
                s, at, own = s_all[lo:hi], slots[lo:hi], rows[: hi - lo]
                f = s @ p["to_word"][c, :, : len(m)]
                f += p["word_bias"][c, : len(m)]
                np.minimum(f, 60, out=f)
                one = f[own, at]
                np.exp(f, out=f)
                z = f @ np.ones(len(m), f.dtype)
                more[lo:hi] = one - np.log(z)
                if learn:
                    f /= z[:, None]
                    f[own, at] -= 1
                    grads["to_word"][c, :, : len(m)] = s.T @ f
                    grads["word_bias"][c, : len(m)] = np.ones(hi - lo, f.dtype) @ f
                    back_in[lo:hi] = f @ p["to_word"][c, :, : len(m)].T
        out[inside] += more
        if learn:
            back[inside] += back_in
        return (out, back, grads) if learn else out

    def score(self, lanes: Lanes) -> np.ndarray:
        """Natural log-likelihood by document of what the network predicts."""
        found = np.zeros(int(lanes.document.max(initial=-1)) + 1)
        h = np.zeros((len(lanes.lengths), self.units), np.float32)
        for live, x, targets, document, carries in lanes.windows(4 * WINDOW):  # nothing is learnt, so windows may be longer
            states, _, h = self.forward(x, carries, h[:live])
            doc = document.ravel()
            got = self.outputs(states.reshape(-1, self.units), targets.ravel())
            found += np.bincount(doc + 1, got, len(found) + 1)[1:]
        return found

    def learn(self, lanes: Lanes) -> int:
        """One pass of training over the lanes; the number of tokens."""
        h, seen = np.zeros((len(lanes.lengths), self.units), np.float32), 0
        for live, x, targets, document, carries in lanes.windows(WINDOW):
            states, kept, h = self.forward(x, carries, h[:live], True)
            real = (document >= 0).ravel()
            count = int(real.sum())
            seen += count
            targets = targets.ravel()
            flat = states.reshape(-1, self.units)
            if count == len(real):
                _, back, grads = self.outputs(flat, targets, True)
            else:
                _, part, grads = self.outputs(flat[real], targets[real], True)
                back = np.zeros_like(flat)
                back[real] = part
            self.step(x, carries, kept, back.reshape(states.shape), grads, count)
        return seen

    def step(self, x: np.ndarray, carries: np.ndarray, kept: tuple, back: np.ndarray, grads: dict, n: int) -> None:
        u, turned = self.units, np.ascontiguousarray(self.p["state"].T)
        before, gates, new, inner = kept
        z, r = gates[..., :u], gates[..., u:]
        by_new = (1 - z) * (1 - new * new)
        by_z = (before - new) * z * (1 - z)
        by_r = inner * r * (1 - r)
        to_input, to_state = np.empty((*x.shape, 3 * u), back.dtype), np.empty((*x.shape, 3 * u), back.dtype)
        dh = np.zeros_like(back[0])
        for t in range(len(x) - 1, -1, -1):
            dh += back[t]
            dn, da = to_input[t, :, 2 * u :], to_state[t]
            np.multiply(dh, by_new[t], out=dn)
            np.multiply(dh, by_z[t], out=da[:, :u])
            np.multiply(dn, by_r[t], out=da[:, u : 2 * u])
            np.multiply(dn, r[t], out=da[:, 2 * u :])
            dh *= z[t]
            dh += da @ turned
            dh *= carries[t][:, None]
        to_input[..., : 2 * u] = to_state[..., : 2 * u]
        grads["state"] = before.reshape(-1, u).T @ to_state.reshape(-1, 3 * u)
        ids, flat = x.ravel(), to_input.reshape(-1, 3 * u)
        order = np.argsort(ids.astype(np.uint16) if len(self.p["input"]) < 1 << 16 else ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows = ids[first]
        mean = np.float32(1 / max(1, n) ** 0.5)
        self._move("input", np.add.reduceat(flat[order], first, axis=0) * mean, rows)
        for k, g in grads.items():
            self._move(k, g * mean)

    def _move(self, name: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        np.clip(g, -5, 5, out=g)
        at = slice(None) if rows is None else rows
        self.squares[name][at] += g * g
        self.p[name][at] -= self.rate * g / np.sqrt(self.squares[name][at])


class Coder(dict):
    """The code of each word; of words without one, -1 less their shape.  Remembers a bounded number of these."""

    def __init__(self, code: dict[str, int]):
        super().__init__(code)
        self.known, self.room = code, 500_000

    def __missing__(self, word: str) -> int:
        if len(self) - len(self.known) >= self.room:
            self.clear()
            self.update(self.known)
            if word in self.known:
                return self.known[word]
        found = self[word] = -1 - shape(word)
        return found


def sequences(codes: np.ndarray, sizes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (the token before, or the mark for the start) and targets (words, then shapes) of documents laid end to end."""
    k = v.words
    codes, classes = codes.astype(np.int32, copy=False), (v.class_of - len(v.members)).astype(np.int32)
    tail = np.where(codes < 0, -1 - codes, classes[np.maximum(codes, 0)] if len(classes) else np.int32(0))
    target = np.where((codes >= 0) & (codes < k), codes, k + tail).astype(np.int32, copy=False)
    before = np.empty_like(target)
    before[1:] = target[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts[starts < len(before)]] = k + SHAPES
    return before, target


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, shape, n) of all tokens of ``docs``; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            counts: Counter = Counter()
            for t in texts_of(b, "text"):
                counts.update(words_of(t))
            counts[END] += b.num_rows
            yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "shape": pa.array(map(shape, counts), pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    return docs.select("text").mapInArrow(run, "word string, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def _laid(codes: np.ndarray, sizes: np.ndarray, v: Vocabulary, lanes: int = LANES) -> Lanes:
    return _lined(*sequences(codes, sizes, v), sizes, lanes)


def _lined(inputs: np.ndarray, targets: np.ndarray, sizes: np.ndarray, lanes: int) -> Lanes:
    cuts = np.cumsum(sizes)[:-1]
    return Lanes(np.split(inputs, cuts), np.split(targets, cuts), lanes)


def _lanes(texts: list[str], coder: Coder, v: Vocabulary) -> Lanes:
    lists = [[*map(coder.__getitem__, words_of(t)), coder[END]] for t in texts]
    return _laid(np.concatenate([np.array(x, np.int64) for x in lists]), np.array(list(map(len, lists))), v)


def with_codes(docs: DataFrame, v: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``_codes`` (packed, four bytes a token) and ``_rare``, the tokens without a count of their own."""
    held = docs.sparkSession.sparkContext.broadcast(v.code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        for b in slices(batches):
            words, ends = [], [0]
            for text in texts_of(b, "text"):
                words += words_of(text)
                words.append(END)
                ends.append(len(words))
            own = np.fromiter(map(coder.__getitem__, words), np.int32, len(words))
            odd, packed = np.flatnonzero(own < 0), own.tobytes()
            cuts = np.searchsorted(odd, ends)
            rare = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array([words[i] for i in odd.tolist()], pa.string()))
            codes = pa.array([packed[4 * i : 4 * j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), codes, rare], [*keep, "_codes", "_rare"])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema_of(docs, *keep, extra="_codes binary, _rare array<string>"))


def _together(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``TOGETHER`` tokens, with their codes end to end and sizes."""
    lists = b.column("_codes").to_pylist()
    sizes = np.array([len(x) // 4 for x in lists])
    part = (np.cumsum(sizes) - sizes) // TOGETHER
    for lo, hi in zip(*(lambda first: (first, np.append(first[1:], len(sizes))))(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))), strict=True):
        yield b.slice(lo, hi - lo), np.frombuffer(b"".join(lists[lo:hi]), np.int32), sizes[lo:hi]


def fit(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS, units: int = UNITS) -> dict[str, np.ndarray]:
    """Weights fitted to all training documents in one pass, which is split by hash over the rounds.

    One task makes a start from a few documents.  Then, in each round, the round's documents are dealt by hash to parts;
    each part is trained from the common weights, in an order that doesn't depend on the cluster, and the means, weighted
    by tokens, are the next common weights; sums are taken by parameter block on the executors.  A lost part is trained
    anew.  ``docs`` has texts, or codes by :func:`with_codes`.
    """
    spark = docs.sparkSession
    coded = (docs if "_codes" in docs.columns else with_codes(docs, v)).select("doc_id", "_codes").withColumn("h", F.xxhash64("doc_id", "_codes", F.lit("fit")))
    names = list(parameters(v, units))
    shapes = {k: x.shape for k, x in parameters(v, units).items()}

    def trained(rows: DataFrame, flat: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast((replace(v, code={}), flat))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, start = held.value
            network, n = Network(vocabulary, _unflat(start, shapes)), 0
            for b in nonempty(batches):
                for _, codes, sizes in _together(b):
                    n += network.learn(_laid(codes, sizes, vocabulary, min(LANES, max(32, len(codes) // (WINDOW * UPDATES)))))
            if n:
                own = np.concatenate([network.p[k].ravel() for k in names]).astype(np.float64) * n
                sizes = [len(x) for x in np.array_split(own, max(1, len(own) // 4_096))]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int32()), pa.array([float(n)] * len(sizes)), list_array(own, sizes)], ["block", "n", "sums"])

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            flat = np.concatenate([c.flatten().to_numpy() for c in rows.column("sums").chunks])
            mean = flat.reshape(rows.num_rows, -1).sum(axis=0) / np.sum(rows.column("n").to_numpy())
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "mean": list_array(mean, [len(mean)])})

        means = rows.mapInArrow(run, "block int, n double, sums array<double>").groupBy("block").applyInArrow(add, "block int, mean array<double>").orderBy("block").toArrow()
        return np.concatenate([c.flatten().to_numpy() for c in means.column("mean").chunks]).astype(np.float32) if means.num_rows else flat

    flat = np.concatenate([x.ravel() for x in parameters(v, units).values()])
    if START_DOCS:
        flat = trained(coded.orderBy("h").limit(START_DOCS), flat)
    chance = F.pmod("h", F.lit(10_000))
    parts = max(1, round(math.sqrt(v.tokens / rounds / PART_TOKENS)))
    for k in range(rounds):
        lo, hi = 10_000 * k // rounds, 10_000 * (k + 1) // rounds
        part = F.pmod(F.shiftrightunsigned("h", 20), F.lit(parts)).cast("int")
        own = coded.where((chance >= lo) & (chance < hi)).repartitionById(parts, part).sortWithinPartitions("h", "doc_id")
        flat = trained(own.select("doc_id", "_codes"), flat)
    return _unflat(flat, shapes)


def _unflat(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


@kept_apart(r"n_tokens|n_known|base_score|score")
def likelihoods(docs: DataFrame, v: Vocabulary, weights: dict[str, np.ndarray], counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_known``, ``base_score`` and ``score``: log10 probabilities of each whole text and its end.

    ``base_score`` is that of independent tokens with counts smoothed by a half, ``score`` the network's.  ``docs`` has
    texts, or codes by :func:`with_codes`.  Null and empty texts hold the end alone.  Counts of rare words are joined to
    the documents that use them, since their number grows with the corpus; each row keeps its own sum, so repeated rows
    and ids don't mix.
    """
    held = docs.sparkSession.sparkContext.broadcast((replace(v, code={}), weights))
    coded = docs if "_codes" in docs.columns else with_codes(docs, v, keep)
    coded = coded if "_row" in docs.columns else written(coded.withColumn("_row", F.monotonically_increasing_id()), "coded")
    schema = schema_of(coded, "_row", *keep, extra="n_tokens long, _known long, _logs double, _network double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p = held.value
        network = Network(vocabulary, p)
        for whole in nonempty(batches):
            for b, codes, sizes in _together(whole):
                given, target = sequences(codes, sizes, vocabulary)
                got = network.score(_lined(given, target, sizes, READING)) / np.log(10)
                logs, known, ends = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64), np.concatenate([[0], np.cumsum(sizes)])
                for lo in range(0, len(sizes), SLICE):
                    hi = min(lo + SLICE, len(sizes))
                    row, c, t = np.repeat(np.arange(hi - lo), sizes[lo:hi]), codes[ends[lo] : ends[hi]], target[ends[lo] : ends[hi]]
                    own = np.where(c >= 0, vocabulary.log_count[np.maximum(c, 0)] if len(vocabulary.log_count) else 0.0, 0.0)
                    tails = np.where(t >= vocabulary.words, own - vocabulary.tail_total[np.maximum(t - vocabulary.words, 0)], 0.0)
                    got[lo:hi] += np.bincount(row, tails, hi - lo)
                    logs[lo:hi], known[lo:hi] = np.bincount(row, own, hi - lo), np.bincount(row, c >= 0, hi - lo)
                out = [pa.array(sizes), pa.array(known), pa.array(logs), pa.array(got)]
                yield pa.RecordBatch.from_arrays([b.column("_row"), *(b.column(c) for c in keep), *out], schema.names)

    scored = coded.select("_row", *keep, "_codes").mapInArrow(run, schema)
    rare = coded.select("_row", F.explode("_rare").alias("word"))
    found = rare.join(counts.select("word", F.col("n").alias("c")).hint("merge"), "word", "left")
    sums = found.groupBy("_row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_more"), F.count_if(F.col("c") > 0).alias("_rare_known"))
    both = scored.join(sums.hint("merge"), "_row", "left")
    more, under = F.coalesce("_more", F.lit(0.0)), float(np.log10(v.tokens + 0.5 * (v.types + 1)))
    return both.select(*keep, "n_tokens", (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).alias("n_known"), (F.col("_logs") + more - F.col("n_tokens") * under).alias("base_score"), (F.col("_network") + more).alias("score"))


def score_held_out(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Learn from all documents but those whose crc32(doc_id) modulo ``folds`` is ``held``; score all of them.

    Texts are split and coded once; the fit and the scores read the codes.
    """
    counts = written(word_counts(docs.where(training_row(F.col("doc_id"), folds, held))), "counts")
    v = vocabulary(counts)
    coded = written(with_codes(docs, v).withColumn("_row", F.monotonically_increasing_id()), "coded")
    found = likelihoods(coded, v, fit(coded.where(training_row(F.col("doc_id"), folds, held)), v), counts)
    return found.select("doc_id", training_row(F.col("doc_id"), folds, held, True).alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")
