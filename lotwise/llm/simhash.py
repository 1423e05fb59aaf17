"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints within t bits of each other agree within t_i bits on at least one of m groups of bits whenever the t_i + 1
sum to t + 1.  Correlated bits share a group, so that groups split the data evenly; how much each group may differ is
found by dynamic programming on candidate counts estimated from the fingerprints, and may be unequal (or -1: the group is
not looked at).  Every fingerprint is put under its value of each group, probes the values it may differ to, and what
meets under a value is verified on all bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import kept_apart, nonempty, passes, schema_of, sieve, slices, texts_of, words_of, written
from lotwise.llm.components import components

BITS = 64
#: Rows of one value that a task compares at once; larger groups are compared in blocks of this size, cell by cell.
BLOCK = 8_192
#: Fingerprints from which candidate counts are estimated; they steer cost, never results.
ESTIMATE = 4_096
#: Weight of a probed row against a compared pair.
ROW_COST = 400.0

_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8) * 256


def shingles(text: str, words: int) -> list[str]:
    """Runs of ``words`` words, repeats included; the whole sequence where there are fewer; none for no words."""
    found = words_of(text)
    if len(found) <= words:
        return [" ".join(found)] if found else []
    return list(map(" ".join, zip(*(found[i:] for i in range(words)), strict=False)))


def hashed(runs: list[str], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(runs))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; as signed 64-bit, 0 without any."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8) + _LANES
    counts = np.einsum("lv,vb->lb", np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256), _OF_BYTE)
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view(np.int64)[0])


def with_fingerprints(df: DataFrame, words: int, seeds: tuple[int, ...] = (42,), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``p0``, ``p1``, ...: a fingerprint of each whole text for each seed; null texts count as empty."""
    names = [f"p{k}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = []
            for text in texts_of(b, "text"):
                runs = shingles(text, words)
                prints.append([fingerprint(hashed(runs, s)) for s in seeds])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in zip(*prints, strict=True))], [*keep, *names])

    return df.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema_of(df, *keep, extra=", ".join(f"{n} long" for n in names)))


def bits_of(prints: np.ndarray) -> np.ndarray:
    return (prints.astype(np.int64).view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)


def correlations(nodes: DataFrame, name: str) -> np.ndarray:
    """Correlation of every two bits of a fingerprint column over all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in nonempty(batches):
            x = bits_of(b.column(0).to_numpy()).astype(np.float64)
            both, n = both + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(BITS * BITS + 1), pa.int32()), "n": pa.array(np.append(both.ravel(), n))})

    sums = np.zeros(BITS * BITS + 1)
    for r in nodes.select(name).mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r.at] = r.n
    n = max(1.0, sums[-1])
    both = sums[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both - p[:, None] * p) / (spread[:, None] * spread))


def grouped(correlation: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` groups of nearly equal size; each grows by the bit most correlated with what it has."""
    left, out = list(range(len(correlation))), []
    c = correlation.copy()
    np.fill_diagonal(c, 0)
    for g in range(groups):
        size = math.ceil(len(left) / (groups - g))
        own = [max(left, key=lambda b: c[b, left].max())]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: c[b, own].mean()))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def within(sample: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Share of pairs that differ in at most 0, 1, ..., ``most`` of the bits: the sample's, or that of its bits taken apart."""
    if len(sample) < 2:
        return np.ones(most + 1)
    x = bits_of(sample)[:, bits]
    p = x.mean(axis=0)
    differ = np.zeros(len(bits) + 1)
    differ[0] = 1
    for q in 2 * p * (1 - p):
        differ[1:] = differ[1:] * (1 - q) + differ[:-1] * q
        differ[0] *= 1 - q
    apart = np.cumsum(differ)[: most + 1]
    value = (x << np.arange(len(bits), dtype=np.uint64)).sum(axis=1).astype(np.uint64)
    seen = np.zeros(len(bits) + 1)
    for i in range(0, len(value), 512):
        seen += np.bincount(np.bitwise_count(value[i : i + 512, None] ^ value).ravel(), minlength=len(bits) + 1)
    seen[0] -= len(value)
    got = np.cumsum(seen)[: most + 1] / (len(value) * (len(value) - 1))
    return np.maximum(np.pad(apart, (0, most + 1 - len(apart)), constant_values=1), np.pad(got, (0, most + 1 - len(got)), constant_values=1))


def allocate(costs: list[np.ndarray], total: int) -> tuple[float, list[int]]:
    """Thresholds whose increments (t_i + 1) sum to ``total`` at least cost; ``costs[i][e]`` is group i's at t_i = e - 1."""
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best[-1].items():
            for e in range(min(len(cost) - 1, total - used) + 1):
                if used + e not in step or c + cost[e] < step[used + e][0]:
                    step[used + e] = (c + cost[e], [*ts, e - 1])
        best.append(step)
    return best[-1][total]


def plan(nodes: DataFrame, name: str, bits: int, count: int) -> list[tuple[list[int], int]]:
    """Groups of bits and their thresholds for links of up to ``bits`` differing bits; the cheapest number of groups."""
    share = min(1.0, 1.5 * ESTIMATE / max(1, count))
    sample = np.array([r[0] for r in nodes.select(name).sample(share, 7).limit(ESTIMATE).collect()], np.int64)
    c, choices = correlations(nodes, name), []
    for m in range(2, min(bits + 1, 8) + 1):
        groups, costs = grouped(c, m), []
        for g in groups:
            got = within(sample, g, bits)
            reach = np.cumsum([math.comb(len(g), k) for k in range(bits + 1)]) / 2 + 0.5
            costs.append(np.append(0.0, got * count * count / 2 + ROW_COST * count * reach))
        cost, thresholds = allocate(costs, bits + 1)
        choices.append((cost, m, list(zip(groups, thresholds, strict=True))))
    return min(choices)[2]


def flips(width: int, most: int) -> np.ndarray:
    """Masks of 1 to ``most`` of the lowest ``width`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(1, most + 1) for c in combinations(range(width), k)], np.int64)


def _values(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    p, out = prints.view(np.uint64), np.zeros(len(prints), np.uint64)
    for i, b in enumerate(bits):
        out |= (p >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    return out.view(np.int64)


def meetings(nodes: DataFrame, names: list[str], plans: list[list[tuple[list[int], int]]]) -> DataFrame:
    """``key, probe, node`` and fingerprints: each node under its own value of every group and the values it probes.

    A pair whose values differ needs one probe only: the smaller value probes the larger.  A row carries the fingerprint
    that the group belongs to and, where there are several, the one after it.
    """
    steps = [(t, g, bits, flips(len(bits), most)) for t, p in enumerate(plans) for g, (bits, most) in enumerate(p) if most >= 0]
    many = max([1, *(len(f) for *_, f in steps)])
    carried = ["own", "other"][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            for lo in range(0, b.num_rows, max(1, 500_000 // many)):
                part = b.slice(lo, max(1, 500_000 // many))
                node, prints = part.column("node").to_numpy(), [part.column(n).to_numpy() for n in names]
                for t, g, bits, masks in steps:
                    own = _values(prints[t], bits)
                    mark = (t * 16 + g) << 56
                    other = own[:, None] ^ masks
                    row, col = np.nonzero(other > own[:, None])
                    at = np.concatenate([np.arange(len(own)), row])
                    key = np.concatenate([own, other[row, col]]) | mark
                    probe = np.arange(len(at)) >= len(own)
                    shown = [prints[t], prints[(t + 1) % len(prints)]][: len(carried)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(probe), pa.array(node[at]), *(pa.array(p[at]) for p in shown)], ["key", "probe", "node", *carried])

    return nodes.select("node", *names).mapInArrow(run, "key long, probe boolean, node long, " + ", ".join(f"{n} long" for n in carried))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least of its component within (a, b): as many links as nodes at most."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ab[: len(a)], ab[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


class Matcher:
    """Verifies what meets under a value and keeps a forest of the links found."""

    def __init__(self, bits: int, second: int | None):
        self.bits, self.second, self.found, self.held = bits, second, [], 0

    def _near(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        gaps = [np.bitwise_count((x ^ y).view(np.uint64)) for x, y in zip(left, right, strict=True)]  # of signed numbers it would count the magnitude's bits
        return (gaps[0] <= self.bits) & (gaps[1] <= self.second) if self.second is not None and len(gaps) > 1 else gaps[0] <= self.bits

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.found.append((a, b))
            self.held += len(a)
            if self.held > 1_000_000:
                self.found = [forest(*(np.concatenate(x) for x in zip(*self.found, strict=True)))]
                self.held = 2 * len(self.found[0][0]) if len(self.found[0][0]) > 500_000 else len(self.found[0][0])

    def groups(self, key: np.ndarray, probe: np.ndarray, node: np.ndarray, prints: list[np.ndarray]) -> None:
        """Rows sorted by key: every row with the rows of its key at distance 1, 2, ... below it."""
        at, d = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(at):
            to = at + d
            near = ~(probe[at] & probe[to]) & self._near([p[at] for p in prints], [p[to] for p in prints])
            self._add(node[at[near]], node[to[near]])
            d += 1
            at = at[at + d < len(key)]
            at = at[key[at + d] == key[at]]

    def cell(self, left: tuple, right: tuple) -> None:
        """Every row of one block with every row of another."""
        (probe, node, prints), (probe2, node2, prints2) = left, right
        for i in range(0, len(node), 256):
            near = self._near([p[i : i + 256, None] for p in prints], [p[None] for p in prints2]) & ~(probe[i : i + 256, None] & probe2[None])
            x, y = np.nonzero(near)
            self._add(node[i + x], node2[y])

    def ready(self) -> pa.RecordBatch | None:
        """Pairs that needn't wait for others; a forest waits for all."""
        return None

    def links(self) -> pa.RecordBatch | None:
        if not self.found:
            return None
        a, b = forest(*(np.concatenate(x) for x in zip(*self.found, strict=True)))
        return pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})


class Candidates(Matcher):
    """Pairs of sets that share a key and may be similar, of different labels; rows are sorted by key and label.

    A row's columns are its label and the size of its set.
    """

    def __init__(self, least: float):
        super().__init__(0, None)
        self.least = least

    def _near(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        (label, a), (label2, b) = left, right
        return (label != label2) & (np.minimum(a, b) >= self.least * np.maximum(a, b) - 1e-9)

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.found.append((np.minimum(a, b), np.maximum(a, b)))
            self.held += len(a)

    def groups(self, key: np.ndarray, probe: np.ndarray, node: np.ndarray, prints: list[np.ndarray]) -> None:
        """Every row with the rows of its key beyond those of its label."""
        last = np.concatenate([(key[1:] != key[:-1]) | (prints[0][1:] != prints[0][:-1]), [True]])
        beyond = (np.flatnonzero(last) + 1)[np.cumsum(last) - last]
        at = np.arange(len(key))
        to = beyond[at]
        while len(at):
            inside = to < len(key)
            at, to = at[inside], to[inside]
            same = key[at] == key[to]
            at, to = at[same], to[same]
            near = self._near([p[at] for p in prints], [p[to] for p in prints])
            self._add(node[at[near]], node[to[near]])
            to = to + 1

    def ready(self) -> pa.RecordBatch | None:
        return self.links() if self.held > 1_000_000 else None

    def links(self) -> pa.RecordBatch | None:
        if not self.found:
            return None
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*self.found, strict=True)], axis=1), axis=0)
        self.found, self.held = [], 0
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


class Bounded(Candidates):
    """Candidates whose sets, by the parities of their counts in ``PARITIES`` buckets, may differ in few enough shingles.

    Parities differ in at most as many buckets as the sets in shingles, so no similar pair is lost.
    """

    def _near(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        most = (1 - self.least) / (1 + self.least) * (left[1] + right[1]) + 1e-6
        near = super()._near(left[:2], right[:2])
        gap = np.zeros(near.shape, np.int64)
        for x, y in zip(left[2:], right[2:], strict=True):
            gap += np.bitwise_count((x ^ y).view(np.uint64))
        return near & (gap <= most)


class Stars(Candidates):
    """Of each label under a key one row, with that of the key's first label and that of the label before."""

    def groups(self, key: np.ndarray, probe: np.ndarray, node: np.ndarray, prints: list[np.ndarray]) -> None:
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new_key | np.concatenate([[True], prints[0][1:] != prints[0][:-1]]))
        head = np.flatnonzero(new_key)[np.cumsum(new_key) - 1][first]
        before = np.concatenate([first[:1], first[:-1]])
        for to in (head, np.where(key[before] == key[first], before, first)):
            near = self._near([p[first] for p in prints], [p[to] for p in prints])
            self._add(node[first[near]], node[to[near]])

    def cell(self, left: tuple, right: tuple) -> None:
        """Blocks of one group: by their own rows as a group."""
        (probe, node, prints), (probe2, node2, prints2) = left, right
        both = [np.concatenate(x) for x in zip((probe, node, *prints), (probe2, node2, *prints2), strict=True)]
        order = np.argsort(both[2], kind="stable")
        self.groups(np.zeros(len(order), np.int64), *(x[order] for x in both[:2]), [x[order] for x in both[2:]])


def links(nodes: DataFrame, names: list[str], bits: int, second: int | None = None) -> DataFrame:
    """``a, b``: links that connect what is within ``bits`` bits by some column and within ``second`` by the one after it.

    ``nodes`` has a distinct ``node`` and fingerprints.  Links within a value's group are reduced to a forest, which
    connects the same nodes, so their number doesn't grow with the square of a group.
    """
    count = nodes.count()
    met = meetings(nodes, names, [plan(nodes, n, bits, count) for n in names])
    return matched(met, met.columns[3:], lambda: Matcher(bits, second))


def matched(met: DataFrame, names: list[str], make: Callable[[], Matcher], most: int | None = None) -> DataFrame:
    """``a, b``: what matchers find among the rows (key, probe, node and ``names``) that meet under a key.

    Groups of over ``most`` (else ``BLOCK``) rows are cut into blocks, of which every two are compared in a task of their own.
    """
    most = most or BLOCK
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = met.repartition(parts, "key").sortWithinPartitions("key", *names[:1])
    shape = "a long, b long, key long, block int, probe boolean, node long, " + ", ".join(f"{n} long" for n in names)
    empty = {f.split()[0]: pa.int32() if f.split()[1] == "int" else pa.bool_() if f.split()[1] == "boolean" else pa.int64() for f in shape.split(", ")}

    def fill(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in empty.items()], list(empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, held, large, done = make(), [], None, 0

        def put_off(rows: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal done
            key, probe, node, *prints = rows
            yield fill({"key": pa.array(key), "block": pa.array((done + np.arange(len(key))) // most, pa.int32()), "probe": pa.array(probe), "node": pa.array(node)} | {n: pa.array(p) for n, p in zip(names, prints, strict=True)})
            done += len(key)

        for b in nonempty(batches):
            rows = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "probe", "node", *names))
            if large is not None:
                own = int(np.searchsorted(rows[0], large, "right"))
                yield from put_off(tuple(x[:own] for x in rows)) if own else ()
                if own == len(rows[0]):
                    continue
                rows, large = tuple(x[own:] for x in rows), None
            rows = tuple(np.concatenate(x) for x in zip(*held, rows, strict=True)) if held else rows
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            held = [tuple(x[cut:] for x in rows)]
            if cut:
                matcher.groups(rows[0][:cut], rows[1][:cut], rows[2][:cut], [x[:cut] for x in rows[3:]])
                if (out := matcher.ready()) is not None:
                    yield fill({"a": out.column("a"), "b": out.column("b")})
            if len(held[0][0]) > most:
                large, done = int(held[0][0][0]), 0
                yield from put_off(held[0])
                held = []
        if held:
            matcher.groups(*held[0][:3], list(held[0][3:]))
        if (out := matcher.links()) is not None:
            yield fill({"a": out.column("a"), "b": out.column("b")})

    found = written(in_order.mapInArrow(run, shape), "met")
    near = found.where(F.col("a").isNotNull()).select("a", "b")
    rest = found.where(F.col("key").isNotNull()).drop("a", "b")
    blocks = rest.groupBy("key").agg(F.max("block").alias("last"))
    if not blocks.take(1):
        return near
    every = F.explode(F.sequence(F.lit(0), F.col("last")))
    dealt = rest.join(blocks, "key").withColumn("other", every).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    cells = dealt.groupBy("key", "lo", "hi")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        matcher = make()
        block = table.column("block").to_numpy()
        columns = [table.column(c).to_numpy() for c in ("probe", "node", *names)]
        side = lambda k: (columns[0][block == k], columns[1][block == k], [c[block == k] for c in columns[2:]])
        matcher.cell(side(key[1].as_py()), side(key[2].as_py()))
        out = matcher.links()
        return pa.Table.from_batches([out] if out is not None else [], pa.schema({"a": pa.int64(), "b": pa.int64()}))

    return near.unionByName(cells.applyInArrow(compare, "a long, b long"))


@kept_apart(r"p[0-9]+|component|component_id|node|label|_least")
def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 4, seeds: tuple[int, ...] = (42,), second: int | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``p0``, ..., ``component_id`` and ``component`` for every document of ``docs`` (doc_id, text).

    Documents are linked if a fingerprint of theirs differs in at most ``bits`` bits (and the one of the next seed in at
    most ``second``); ``component_id`` is the least id reachable over links, the own id included; a
    component of rows with null ids only has a null id, but a ``component`` number like all.  Nodes are fingerprints, so
    copies cost one row each and rows of one id with different texts are apart; texts without words have the fingerprint
    zero and are linked like any others.  ``doc_id`` must be an integer.  An empty table gives an empty one.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    names = [f"p{k}" for k in range(len(seeds))]
    prints = written(with_fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), words, seeds, keep), "prints")
    node = F.col("p0") if len(seeds) == 1 else F.xxhash64(*names)
    nodes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("_least")).withColumn("node", node), "nodes")
    label = components(links(nodes.select("node", *names), names, bits, second))
    of_node = nodes.join(label, "node", "left").withColumn("component", F.coalesce("label", "node"))
    least = of_node.groupBy("component").agg(F.min("_least").alias("component_id"))
    return prints.join(of_node.join(least, "component").select(*names, "component_id", "component"), names).select(*keep, *names, "component_id", "component")


def shingle_set(text: str, words: int, seed: int = 42) -> np.ndarray:
    """The text's distinct shingles as ascending 64-bit hashes."""
    return np.unique(hashed(shingles(text, words), seed))


#: Bands of least hashes and their width: sets of a Jaccard similarity of 0.8 share no band with a chance of 7e-10.
BANDS, WIDTH = 40, 4
_ODD = np.random.default_rng(42).integers(0, 1 << 31, (BANDS * WIDTH, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of the set's least hashes under ``BANDS * WIDTH`` orders; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_ODD), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4_096):
        least = np.minimum(least, (_ODD[:, :1] * x[None, lo : lo + 4_096] + _ODD[:, 1:]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T.astype(np.uint64):
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


#: Buckets whose parities tell sets apart.
PARITIES = 1_024
MASKS = [f"m{i}" for i in range(PARITIES // 64)]


def parities(own: np.ndarray) -> np.ndarray:
    """For each bucket of shingles whether the set has an odd number of them, as 64-bit numbers."""
    odd = np.bincount((own & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def with_bands(rows: DataFrame, words: int) -> DataFrame:
    """``node``, the fingerprint ``p0`` and size of its set of shingles, the set's bands and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            new = {n: i for i, n in enumerate(b.column("node").to_pylist()) if n not in seen}
            seen.update(new)
            texts, prints, sizes, found, odd = texts_of(b, "text"), [], [], [], [np.zeros((0, len(MASKS)), np.int64)]
            for i in new.values():
                own = shingle_set(texts[i], words)
                prints.append(fingerprint(own))
                sizes.append(len(own))
                found.append(bands(own).tobytes())
                odd.append(parities(own)[None])
            yield pa.RecordBatch.from_arrays([pa.array(new.keys(), pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), *map(pa.array, np.ascontiguousarray(np.concatenate(odd).T))], ["node", "p0", "size", "bands", *MASKS])

    return rows.select("node", "text").mapInArrow(run, "node long, p0 long, size long, bands binary, " + ", ".join(f"{m} long" for m in MASKS))


#: Rows of a key that are looked at together where only those of different labels are paired.
LABELLED = 1 << 20


def apart(nodes: DataFrame, least: float, stars: bool) -> DataFrame:
    """``a, b``: pairs of ``nodes`` of different labels that share a band and may be similar.

    ``stars`` takes a few pairs of each group, by size alone.  All pairs are looked at otherwise; only rows under keys of
    several labels then carry parities, which leave hardly any pair that isn't similar.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8_192):
            keys = [np.frombuffer(x, np.int64) for x in b.column("bands").to_pylist()]
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.zeros(len(row), bool)), *(pa.array(b.column(c).to_numpy()[row]) for c in ("node", "label", "size"))], ["key", "probe", "node", "label", "size"])

    met = nodes.select("node", "size", "bands", "label").mapInArrow(run, "key long, probe boolean, node long, label long, size long")
    if stars:
        return matched(met, ["label", "size"], lambda: Stars(least), LABELLED).distinct()
    by = Window.partitionBy("key")
    mixed = met.withColumn("_lo", F.min("label").over(by)).withColumn("_hi", F.max("label").over(by)).where("_lo <> _hi").drop("_lo", "_hi")
    shown = mixed.join(nodes.select("node", *MASKS).hint("merge"), "node").select("key", "probe", "node", "label", "size", *MASKS)
    return matched(shown, ["label", "size", *MASKS], lambda: Bounded(least), LABELLED).distinct()


def similar(rows: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those pairs (a, b) of the nodes of ``rows`` (node, text) whose sets have a Jaccard similarity of ``least`` and more.

    Sets are made of the texts of nodes in pairs, which a sieve picks out, so others are not shuffled.
    """
    pairs = written(pairs, "pairs")
    held = sieve(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            b = b.filter(pa.array(passes(held, b.column("node").to_numpy())))
            new = {n: i for i, n in enumerate(b.column("node").to_pylist()) if n not in seen}
            seen.update(new)
            texts = texts_of(b, "text")
            yield pa.RecordBatch.from_arrays([pa.array(new.keys(), pa.int64()), pa.array([shingle_set(texts[i], words).tobytes() for i in new.values()], pa.binary())], ["node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            near = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                n, both = (len(x) + len(y)) // 8, np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                near.append(shared >= least * (n - shared) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    found = written(rows.select("node", "text").mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")
    x, y = (found.select(F.col("node").alias(k), F.col("shingles").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    return written(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar")


def similar_labels(rows: DataFrame, words: int, bits: int, least: float) -> DataFrame:
    """``node, label``: the least node that each is connected with over all pairs of a similarity of ``least`` and more.

    ``rows`` has (node, text), a node as often as its text.  Fingerprint links, verified on the sets, are a start that
    joins most of a large group.  Pairs that it leaves apart are found by bands of least hashes, of which sets at the
    threshold miss all with a chance of 7e-10, and verified likewise.
    """
    nodes = written(with_bands(rows, words).dropDuplicates(["node"]), "nodes")
    near = similar(rows, links(nodes.select("node", "p0"), ["p0"], bits), words, least)
    for stars in (True, False):  # a few pairs of each group first, which leave next to nothing of a large group apart
        labelled = nodes.join(written(components(near), "labels").hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        near = near.unionByName(similar(rows, apart(labelled, least, stars), words, least))
    return components(near)


def one_of_each(docs: DataFrame, words: int = 5, bits: int = 4, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group that is chained by similarity: that of the least id, null ids last.

    Documents are linked if the Jaccard similarity of their distinct shingles is ``least`` or more and no others (but for
    equal 64-bit hashes of unlike shingles or texts); a link at the threshold is missed with a chance of 7e-10.  Texts
    without words are one group.  ``bits`` is that of the fingerprint links, which steer cost.  Of rows equal in id and text one stays.  Columns
    are those of ``docs``.
    """
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    named = docs.withColumns({"_row": F.xxhash64("doc_id", "text"), "_node": F.xxhash64(spaced)})
    label = similar_labels(named.select(F.col("_node").alias("node"), "text"), words, bits, least)
    slim = written(named.select("doc_id", "_row", "_node"), "slim")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    groups = slim.join(label.hint("merge"), F.col("_node") == F.col("node"), "left").withColumn("component", F.coalesce("label", "_node"))
    kept = groups.groupBy("component").agg(F.min(order)["_row"].alias("_row")).select("_row")
    # rows of which several are alike, or which aren't kept, are few: only these meet the table of what is kept
    going = written(slim.groupBy("_row").agg(F.count("*").alias("n")).join(kept.withColumn("stays", F.lit(True)).hint("merge"), "_row", "left").where("n > 1 OR stays IS NULL"), "going")
    held = sieve(going.select("_row"))

    def part(asked: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (b.filter(pa.array(passes(held, b.column("_row").to_numpy()) == asked)) for b in nonempty(batches))

        return named.select("_row", *docs.columns).mapInArrow(run, schema_of(named, "_row", *docs.columns))

    maybe = part(True).join(going.hint("merge"), "_row", "left").where("n IS NULL OR stays").dropDuplicates(["_row"])
    return part(False).select(*docs.columns).unionByName(maybe.select(*docs.columns))
