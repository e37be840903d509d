"""Gradient boosting with leaf-wise trees on histograms, as Spark aggregates.

Feature values are cut into bins once. For each tree, gradients are summed by (node, feature, bin):
tasks add up their rows in dense arrays and give one partial row per bin, and Spark sums those. The
leaf of the best gain is split first, until there are enough leaves. As a node's gain depends on its
own rows alone, one aggregate serves every node that this order may reach next, so a tree takes about
as many passes as it is deep, not one for each leaf.

Gradients are summed as fixed-point integers: sums don't depend on the order of rows or tasks, and two
runs give the same trees. The driver holds bin edges, the histograms of a tree's open nodes and the
trees; rows stay in tables. Margins are written with the rows every `refresh` rounds, and between that
tasks add the trees grown since."""
from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .forest import package
from .metrics import average_precision

UNIT = float(1 << 30)           # fixed-point steps in one


@dataclass(frozen=True)
class Options:
    rounds: int = 400
    rate: float = 0.05
    leaves: int = 31
    min_leaf: int = 40
    feature_share: float = 0.9
    row_share: float = 0.8
    patience: int = 40          # rounds without a better average precision on the validation rows
    refresh: int = 10
    bins: int = 255
    ridge: float = 1e-3
    seed: int = 0


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper ends of all bins but the last, by feature: all values where they are few, else quantiles."""
    out = []
    for f in features:
        few = [r[0] for r in rows.where(F.col(f).isNotNull()).select(F.col(f).cast("double")).distinct().limit(bins + 1).collect()]
        if len(few) > bins:
            few = rows.select(F.percentile_approx(F.col(f).cast("double"), [i / bins for i in range(1, bins)], 100_000)).first()[0] + [np.inf]
        out.append(sorted(set(few))[:-1])
    return out


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of every value: how many edges are below it. Values that are not numbers go last."""
    return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)


def drawn(keys: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Rows that a tree sees, by their key alone."""
    mixed = (keys.astype(np.uint64) ^ np.uint64(zlib.crc32(f"{seed}:{tree}".encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def features_of_tree(n: int, share: float, seed: int, tree: int) -> list[int]:
    order = sorted(range(n), key=lambda i: zlib.crc32(f"{seed}:{tree}:{i}".encode()))
    return sorted(order[:max(1, round(n * share))])


class Grown:
    """A tree while it grows: nodes with a split (feature, bin) and children, or a value."""

    def __init__(self):
        self.split: dict[int, tuple[int, int]] = {}
        self.child: dict[int, tuple[int, int]] = {}
        self.value: dict[int, float] = {}

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The last node that each row reaches."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.child):                 # children have greater numbers than parents
            here = np.flatnonzero(at == node)
            feature, edge = self.split[node]
            at[here] = np.where(bins[here, feature] <= edge, *self.child[node])
        return at

    def margin(self, bins: np.ndarray) -> np.ndarray:
        values = np.zeros(max(self.value, default=0) + 1)
        for node, v in self.value.items():
            values[node] = v
        return values[self.node_of(bins)]


def gradients(label: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss in fixed point."""
    p = 1 / (1 + np.exp(-raw))
    return np.rint((p - label) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)


def histogram(bins, g, h, node, wanted, features, width) -> np.ndarray:
    """(wanted node, feature, bin, [gradient, curvature, rows]) sums."""
    out = np.zeros((len(wanted), len(features), width, 3), np.int64)
    for a, w in enumerate(wanted):
        mine = np.flatnonzero(node == w)
        for b, f in enumerate(features):
            x = bins[mine, f]
            order = np.argsort(x, kind="stable")
            at = np.flatnonzero(np.concatenate(([True], x[order][1:] != x[order][:-1]))) if len(x) else []
            if len(x):
                for c, v in enumerate((g[mine], h[mine], np.ones(len(mine), np.int64))):
                    out[a, b, x[order][at], c] = np.add.reduceat(v[order], at)
    return out


def best_split(table: np.ndarray, features: list[int], options: Options):
    """(gain, feature, bin) of one node's histogram: the greatest gain, of equals the first; None where
    no split leaves `min_leaf` rows on both sides and gains anything."""
    sums = np.cumsum(table, axis=1)
    total = sums[0, -1]
    score = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + options.ridge)
    left, right = sums, total - sums
    gain = score(left[..., 0], left[..., 1]) + score(right[..., 0], right[..., 1]) - score(total[0], total[1])
    gain = np.where((left[..., 2] >= options.min_leaf) & (right[..., 2] >= options.min_leaf), np.round(gain, 9), 0.0)
    k = int(gain.argmax())
    f, b = divmod(k, gain.shape[1])
    return (float(gain[f, b]), features[f], b) if gain[f, b] > 0 else None


def grow(sums_of, features: list[int], options: Options) -> Grown:
    """One tree. `sums_of(tree, nodes)` gives the histograms of nodes; it is asked for all nodes that the
    best-first order may need next at once."""
    tree, tables, splits = Grown(), {}, {}

    def look(nodes):
        for node, table in zip(nodes, sums_of(tree, nodes)):
            tables[node], splits[node] = table, best_split(table, features, options)

    look([0])
    while True:
        # best-first over what is known; where a taken node's children are not, they are asked for
        heap = [(-splits[0][0], 0)] if splits[0] else []
        taken, unknown = [], []
        while heap and len(taken) < options.leaves - 1:
            _, node = heapq.heappop(heap)
            taken.append(node)
            if node not in tree.child:
                unknown.append(node)
                continue
            for c in tree.child[node]:
                if splits[c]:
                    heapq.heappush(heap, (-splits[c][0], c))
        if not unknown:
            break
        asked = []
        for node in unknown:
            _, f, b = splits[node]
            new = len(tables) + len(asked)
            tree.split[node], tree.child[node] = (f, b), (new, new + 1)
            asked += [new, new + 1]
        look(asked)
    done = Grown()
    for node in taken:
        done.split[node], done.child[node] = tree.split[node], tree.child[node]
    for node in {0, *(c for n in taken for c in tree.child[n])} - set(taken):
        g, h, _ = tables[node][0].sum(axis=0)
        done.value[node] = -options.rate * (g / UNIT) / (h / UNIT + options.ridge)
    return done


def flat(tree: Grown, edges: list[list[float]], base: float) -> dict:
    """The exchange form; `base` is added to every leaf."""
    out = {c: [] for c in "ftlrv"}

    def put(node):
        here = len(out["f"])
        f, b = tree.split.get(node, (-1, 0))
        for c, v in zip("ftlrv", (f, edges[f][b] if f >= 0 else 0.0, -1, -1, 0.0 if f >= 0 else tree.value[node] + base)):
            out[c].append(v)
        if f >= 0:
            out["l"][here], out["r"][here] = put(tree.child[node][0]), put(tree.child[node][1])
        return here

    put(0)
    return out


def train(rows: DataFrame, features: list[str], options: Options = Options(), label: str = "label",
          validation: str | None = None) -> dict:
    """A boosted model in the exchange format, threshold 0.5, from feature columns and a 0/1 `label`.

    Rows where the boolean column `validation` holds are not learned from; with such rows training ends
    when their average precision has not risen for `patience` rounds (looked at every `refresh`), and the
    best round counts. Rows without a label are left out; null features are greater than all values. Equal
    rows are drawn together. An empty table, or one without a split, gives the prior alone."""
    if not 2 <= options.bins <= 255:
        raise ValueError(f"bins must be 2 to 255, not {options.bins}")
    numbers = [F.col(f).cast("double") for f in features]
    rows = rows.where(F.col(label).isNotNull())
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    edges = bin_edges(rows.where(~held), features, options.bins)
    width = max((len(e) + 1 for e in edges), default=1)
    n, positive = rows.where(~held).agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    p = min(max(((positive or 0) + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
    base = float(np.log(p / (1 - p)))

    def prepare(batches):
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))]).astype(float)
            codes = binned(np.where(np.isnan(x), np.inf, x), edges)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("label"), batch.column("key"),
                                              batch.column("held"), pa.array(np.full(len(x), base))], names=["bins", "label", "key", "held", "raw"])

    schema = "bins binary, label int, key bigint, held boolean, raw double"
    data = cut(rows.select(*[c.alias(f"x{i}") for i, c in enumerate(numbers)], F.col(label).cast("int").alias("label"),
                           F.xxhash64(*numbers, label).alias("key"), held.alias("held")).mapInArrow(prepare, schema))
    trees: list[Grown] = []
    recent: list[Grown] = []
    best, best_at = -1.0, 0

    def arrays(batch, grown):
        codes = np.frombuffer(b"".join(b.as_py() for b in batch.column("bins")), np.uint8).reshape(len(batch), -1)
        raw = batch.column("raw").to_numpy() + sum((t.margin(codes) for t in grown), np.zeros(len(batch)))
        return codes, raw

    def advanced(frame):
        grown = list(recent)

        def add(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "label", "key", "held")),
                                                      pa.array(arrays(batch, grown)[1])], names=["bins", "label", "key", "held", "raw"])
        return cut(frame.mapInArrow(add, schema))

    for number in range(options.rounds):
        chosen = features_of_tree(len(features), options.feature_share, options.seed, number)
        grown = list(recent)

        def sums_of(tree, nodes, number=number, chosen=chosen, grown=grown):
            def partial(batches):
                sums = np.zeros((len(nodes), len(chosen), width, 3), np.int64)
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    codes, raw = arrays(batch, grown)
                    use = drawn(batch.column("key").to_numpy(), options.row_share, options.seed, number)
                    g, h = gradients(batch.column("label").to_numpy()[use], raw[use])
                    sums += histogram(codes[use], g, h, tree.node_of(codes[use]), nodes, chosen, width)
                at = np.flatnonzero(sums[..., 2].ravel())
                values = sums.reshape(-1, 3)[at]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(values[:, c].copy()) for c in range(3))], names=["at", "g", "h", "n"])

            found = (data.where("NOT held").mapInArrow(partial, "at bigint, g bigint, h bigint, n bigint")
                     .groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow())
            sums = np.zeros((len(nodes) * len(chosen) * width, 3), np.int64)
            sums[found.column("at").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in ("g", "h", "n")]).reshape(-1, 3)
            return sums.reshape(len(nodes), len(chosen), width, 3)

        tree = grow(sums_of, chosen, options)
        if not tree.child:
            break
        trees.append(tree)
        recent.append(tree)
        if len(recent) == options.refresh:
            data, recent = advanced(data), []
            if validation:
                score = average_precision(data.where("held").select(F.col("raw").alias("score"), "label")).first()[0]
                if score is not None and score > best:
                    best, best_at = score, len(trees)
                elif len(trees) - best_at >= options.patience:
                    break
    if validation and best_at:
        trees = trees[:best_at]
    if not trees:
        stump = Grown()
        stump.value[0] = 0.0
        trees = [stump]
    return package([flat(t, edges, base if i == 0 else 0.0) for i, t in enumerate(trees)], features, 0.5)
