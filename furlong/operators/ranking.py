"""Listwise rankers: boosted trees whose gradients come from whole races, and exact Shapley values of their scores.

Races are written once, some thousands a row (their runners' features as bin numbers, races of one size
side by side); a field is small by the rules of racing, and one of over ``MOST_RUNNERS`` is refused. For
each level of a tree the executors compute scores and gradients of their races and add up histograms by
node, feature and bin; the driver sees these sums (their number depends on the tree, not on the races)
and picks the splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.tables import stored

#: Runners of one race, which a task holds at once.
MOST_RUNNERS = 10_000
#: Runners of the races that are written as one row, about.
BLOCK_RUNNERS = 32_768
#: Runners up to which places in a race are found by comparing each pair.
FEW_RUNNERS = 16
#: Bins of a feature besides the one for missing values.
BINS = 63
#: Pairs are formed with the runners of these first places.
TOP = 30
#: Pairs of runners that are compared at once.
PAIRS_AT_ONCE = 1_000_000
#: Trees after which the executors keep the scores of their races, so that a level of a tree computes those of no more trees.
KEPT_TREES = 20
#: Rounds after which a training looks whether it may stop.
LOOK = 10


@dataclass
class Params:
    """What a training run may vary. ``subsample`` is of races, ``colsample`` of features, each drawn anew for a tree."""

    loss: str = "lambda"
    rounds: int = 20
    learning_rate: float = 0.1
    max_depth: int = 3
    num_leaves: int = 31
    min_child_samples: int = 20
    min_split_gain: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    permutations: int = 10
    decay: float = 0.85
    seed: int = 42


@dataclass
class Tree:
    """A binary tree in heap order: node i has the children 2 i + 1 (bins up to ``cut``, missing values too) and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        number = np.min_scalar_type(len(self.feature)).type

        def below(node: int) -> np.ndarray:
            f = self.feature[node]
            return number(node) if f < 0 else np.where(bins[:, f] > self.cut[node], below(2 * node + 2), below(2 * node + 1))

        return np.broadcast_to(below(0), len(bins))


@dataclass
class Ranker:
    """Trees over binned features. ``edges`` are the upper bounds of a feature's bins but the last."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin numbers from 1; 0 where the value is missing."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8, "F")
        for i, (values, edges) in enumerate(zip(columns, self.edges, strict=True)):
            out[:, i] = np.where(np.isnan(values), 0, 1 + np.searchsorted(edges, values, "left"))
        return out

    def margins(self, bins: np.ndarray, before: np.ndarray | None = None, known: int = 0) -> np.ndarray:
        """Scores of all trees; ``before`` are those of the first ``known``."""
        out = np.zeros(len(bins)) if before is None else before.copy()
        for tree in self.trees[known:]:
            out += tree.value[tree.leaves(bins)]
        return out

    def importances(self) -> list[tuple[str, int, float]]:
        """Each feature with the number and the summed gain of its splits."""
        used = [(int(f), g) for t in self.trees for f, g in zip(t.feature, t.gain, strict=True) if f >= 0]
        return [(name, sum(f == i for f, _ in used), float(sum(g for f, g in used if f == i))) for i, name in enumerate(self.features)]


# --- gradients of a race ------------------------------------------------------------------------


def places(values: np.ndarray) -> np.ndarray:
    """Each value's place in the ascending order of its row; equal values keep their order."""
    if values.shape[1] > FEW_RUNNERS:
        return np.argsort(np.argsort(values, axis=1, kind="stable"), axis=1)
    columns = np.ascontiguousarray(values.T)
    out = np.zeros(columns.shape, np.uint8)
    for i in range(1, len(columns)):
        after = columns[:i] <= columns[i]
        out[i] += after.sum(0, dtype=np.uint8)
        out[:i] += ~after
    return out.T


def lambda_gradients(scores: np.ndarray, gains: np.ndarray, there: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of races (rows; ``there`` marks runners) for NDCG.

    A pair of different gain pulls apart by the logistic loss of its score difference, weighted by how
    much NDCG changes if the two swap places. Each race is scaled by log2(1 + its sum) / its sum.
    """
    races, n = scores.shape
    place = places(np.where(there, -scores, np.inf))
    worth = np.where(there, 2.0**gains - 1, 0)
    discount = 1 / np.log2(2 + np.arange(n))
    best = (-np.sort(-worth, axis=1) * discount).sum(1)
    # Pairs of a better and a worse one, a pair once; of long fields only the rows of those in the first places are looked at.
    if n <= top:
        race, better, worse = np.nonzero((worth[:, :, None] > worth[:, None, :]) & there[:, None, :])
    else:
        order = np.argsort(place, axis=1)
        y, m = (np.take_along_axis(a, order, 1) for a in (worth, there))
        later = np.arange(n)[None, :] > np.arange(top)[:, None]
        race, one, other = np.nonzero((y[:, :top, None] != y[:, None, :]) & m[:, None, :] & later)
        first = y[race, one] > y[race, other]
        one, other = order[race, one], order[race, other]
        better, worse = np.where(first, one, other), np.where(first, other, one)
    b, w = race * n + better, race * n + worse
    flat_s, flat_y, flat_d = scores.ravel(), worth.ravel(), discount[place].ravel()
    change = (flat_y[b] - flat_y[w]) * np.abs(flat_d[b] - flat_d[w]) / best[race]
    wrong = 1 / (1 + np.exp(np.clip(flat_s[b] - flat_s[w], -50, 50)))
    pull = wrong * change
    curve = pull * (1 - wrong)
    total = np.bincount(race, pull, races) * 2
    scale = np.where(total > 0, np.log2(1 + total) / np.where(total > 0, total, 1), 0)[:, None]
    g = np.bincount(w, pull, races * n) - np.bincount(b, pull, races * n)
    h = np.bincount(w, curve, races * n) + np.bincount(b, curve, races * n)
    return g.reshape(scores.shape) * scale, h.reshape(scores.shape) * scale


def uniform(keys: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers between 0 and 1 that depend on the keys and salts alone (the SplitMix64 finisher)."""
    return _fraction(_mixed(keys.astype(np.uint64), *salts))


def _mixed(x: np.ndarray, *salts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        for salt in salts:
            x = (x + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return x


def _fraction(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def yeti_gradients(scores: np.ndarray, gains: np.ndarray, there: np.ndarray, keys: np.ndarray, salt: int, permutations: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``lambda_gradients``, from random orders: scores with Gumbel noise, neighbours in them compared.

    A pair of neighbours counts by its difference in gain and by ``decay`` to the power of its place.
    The noise depends on ``keys`` (one a runner), ``salt`` and the order's number. Scores less the logarithm of
    an exponential variate have the opposite order of the variate times e to the power of minus the score.
    """
    races, n = scores.shape
    flat_s, flat_y, present = scores.ravel(), gains.ravel(), there.ravel()
    kinds, kind = np.unique(flat_y, return_inverse=True)
    kind = np.where(present, kind, len(kinds)).astype(np.min_scalar_type(len(kinds)))
    start, runner = np.arange(races)[:, None] * n, np.arange(races * n, dtype=np.int32)
    weight = decay ** np.arange(n) / permutations
    salted, factor = _mixed(keys.astype(np.uint64), salt), np.where(there, np.exp(np.clip(-scores, -600, 600)), np.inf)
    order, pairs = np.empty(races * n, np.int32), []
    for p in range(permutations):
        order[start + places(-np.log(_fraction(_mixed(salted, p))) * factor)] = runner.reshape(races, n)
        along = kind[order].reshape(races, n)
        # Of neighbours those of different gain; who is not there comes last.
        first = np.flatnonzero((along[:, :-1] != along[:, 1:]) & (along[:, 1:] < len(kinds)))
        first += first // max(1, n - 1)
        pairs.append((order[first], order[first + 1], weight[first % n]))
    one, other, weight = (np.concatenate(parts) for parts in zip(*pairs, strict=True))
    differ = flat_y[one] - flat_y[other]
    wrong = 1 / (1 + np.exp(np.clip(np.sign(differ) * (flat_s[one] - flat_s[other]), -50, 50)))
    pull = differ * weight * wrong
    curve = np.abs(pull) * (1 - wrong)
    g = np.bincount(other, pull, races * n) - np.bincount(one, pull, races * n)
    h = np.bincount(other, curve, races * n) + np.bincount(one, curve, races * n)
    return g.reshape(scores.shape), h.reshape(scores.shape)


def point_gradients(scores: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the logistic loss of each runner by itself: gain 0 or not."""
    p = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
    return p - (gains > 0), p * (1 - p)


# --- races as rows ---------------------------------------------------------------------------------


def learned_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Bounds of a feature's bins, from quantiles sketched over all rows (at most ``bins`` numbers a feature)."""
    steps = [i / bins for i in range(1, bins)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in features]).approxQuantile(features, steps, 0.002)
    return [np.unique(q) for q in found]


def lists(df: DataFrame, group: str, row_id: str, gain: str, ranker: Ranker, carried: tuple[str, ...] = ()) -> DataFrame:
    """Races, written, some ``BLOCK_RUNNERS`` runners a row, races by size and runners in order of id.

    A row has a ``key`` and, as packed numbers, the races' sizes and hashes of their keys, and for each runner
    the hash of its id, gain, binned features (feature by feature) and the numbers in ``carried``.
    """
    names, most, block = ranker.features, MOST_RUNNERS, BLOCK_RUNNERS
    numbers = {"gains": gain} | {f"c_{c}": c for c in carried} | {f"x_{i}": c for i, c in enumerate(names)}
    rows = df.select(F.col(group).alias("group"), F.col(row_id).alias("id"), *[F.col(c).cast("double").alias(n) for n, c in numbers.items()])
    rows = rows.repartition("group").sortWithinPartitions("group", "id").select("group", F.xxhash64("group").alias("keys"), F.xxhash64("id").alias("ids"), *numbers)

    def packed(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, rows.num_rows))
        order = np.argsort(sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(rows.num_rows)
        column = {c: rows[c].to_numpy() for c in rows.column_names[1:]}
        bins = ranker.binned([column[f"x_{i}"].astype(float) for i in range(len(names))])[at]
        keys = column["keys"][starts]
        parts = [sizes.astype(np.int32), keys, column["ids"][at], *[column[c][at].astype(float) for c in ("gains", *[f"c_{c}" for c in carried])], np.ascontiguousarray(bins.T)]
        return pa.RecordBatch.from_arrays([pa.array(keys[:1]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["key", *columns])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = _starts(held["group"])
            if held.num_rows and np.diff(np.append(starts, held.num_rows)).max() > most:
                raise ValueError(f"a race of over {most} runners")
            # The last race may go on in the next batch.
            if len(starts) > 1 and starts[-1] >= block:
                yield packed(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield packed(held, _starts(held["group"]))

    columns = ["sizes", "keys", "ids", "gains", *carried, "bins"]
    return stored(rows.mapInArrow(dealt, ", ".join(["key long", *[f"`{c}` binary" for c in columns]])), "races")


def _starts(group: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before; nulls are alike."""
    if not len(group):
        return np.zeros(0, np.int64)
    codes = group.combine_chunks().dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


@dataclass
class Races:
    """The races of a row of ``lists``, by size: sizes and keys, and one entry a runner of the rest. What wasn't read is None."""

    sizes: np.ndarray
    keys: np.ndarray | None
    ids: np.ndarray | None
    gains: np.ndarray
    bins: np.ndarray
    scores: np.ndarray | None = None
    carried: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch], features: int) -> Iterator[Races]:
        types = {"sizes": np.int32, "keys": np.int64, "ids": np.int64, "bins": np.uint8}
        for batch in batches:
            for i in range(batch.num_rows):
                found = {c: np.frombuffer(batch[c][i].as_buffer(), types.get(c, float)) for c in batch.schema.names}
                own = [found.pop(c, None) for c in ("sizes", "keys", "ids", "gains", "bins", "scores")]
                yield cls(own[0].astype(np.int64), own[1], own[2], np.nan_to_num(own[3]), own[4].reshape(features, -1).T, own[5], found)

    def blocks(self) -> Iterator[tuple[slice, tuple[int, int]]]:
        """Runs of races of one size and of few pairs: their runners, how many races and of what size."""
        begin = 0
        for size, races in zip(*np.unique(self.sizes, return_counts=True), strict=True):
            size, at_once = int(size), max(1, PAIRS_AT_ONCE // int(size * min(size, TOP)))
            for first in range(0, int(races), at_once):
                n = min(at_once, int(races) - first)
                yield slice(begin, begin + n * size), (n, size)
                begin += n * size

    def gradients(self, scores: np.ndarray, params: Params, tree: int) -> tuple[np.ndarray, np.ndarray]:
        if params.loss == "point":
            return point_gradients(scores, self.gains)
        g, h = np.zeros(len(scores)), np.zeros(len(scores))
        for runners, shape in self.blocks():
            s, y, there = scores[runners].reshape(shape), self.gains[runners].reshape(shape), np.ones(shape, bool)
            if params.loss == "lambda":
                found = lambda_gradients(s, y, there)
            else:
                found = yeti_gradients(s, y, there, self.ids[runners].reshape(shape), params.seed + 1000 * tree, params.permutations, params.decay)
            g[runners], h[runners] = (a.ravel() for a in found)
        return g, h

    def drawn(self, params: Params, tree: int) -> np.ndarray:
        """Which runners' races take part in a tree."""
        taken = uniform(self.keys, params.seed, tree) < params.subsample if params.subsample < 1 else np.ones(len(self.sizes), bool)
        return np.repeat(taken, self.sizes)


# --- training ---------------------------------------------------------------------------------------


def with_scores(races: DataFrame, ranker: Ranker, known: int) -> DataFrame:
    """``races`` with the scores of the ranker's trees; if they have some, these are of the first ``known`` trees."""
    f, names = len(ranker.features), [c for c in races.columns if c != "scores"]
    read = [c for c in races.columns if c in ("sizes", "gains", "bins", "scores")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranker.margins(part.bins, part.scores, known).tobytes() for part in Races.each(iter([batch.select(read)]), f)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(found, pa.binary())], [*names, "scores"])

    types = dict(races.dtypes)
    return races.mapInArrow(each, ", ".join([*[f"`{c}` {types[c]}" for c in names], "scores binary"]))


def histograms(races: DataFrame, ranker: Ranker, tree: Tree, nodes: list[int], params: Params, known: int = 0) -> np.ndarray:
    """Sums of gradient, second derivative and runners by node (of ``nodes``), feature and bin, over all races.

    If races have scores, these are of the first ``known`` trees.
    """
    f, b, number = len(ranker.features), BINS + 2, len(ranker.trees)
    place = np.full(len(tree.feature), len(nodes))  # runners of no node in question go to one more
    place[nodes] = range(len(nodes))
    read = ["sizes", "gains", "bins", *["keys"] * (params.subsample < 1), *["ids"] * (params.loss == "yeti"), *["scores"] * (known > 0)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, f, (len(nodes) + 1) * b))
        for part in Races.each(batches, f):
            at = place[tree.leaves(part.bins)]
            if params.subsample < 1:
                at = np.where(part.drawn(params, number), at, len(nodes))
            at *= b
            g, h = part.gradients(ranker.margins(part.bins, part.scores, known), params, number)
            for i in range(f):
                cells = at + part.bins[:, i]
                for row, values in zip(sums[:, i], (g, h, None), strict=True):
                    row += np.bincount(cells, values, len(row))
        out = sums.reshape(3, f, -1, b)[:, :, :-1].swapaxes(1, 2).reshape(3, -1)
        filled = np.flatnonzero(out[2])
        yield pa.RecordBatch.from_arrays([pa.array(filled), *[pa.array(row[filled]) for row in out]], ["cell", "g", "h", "n"])

    rows = races.select(*read).mapInArrow(add_up, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()
    out = np.zeros((3, len(nodes) * f * b))
    out[:, rows["cell"].to_numpy(np.int64)] = rows[["g", "h", "n"]].to_numpy().T
    return out.reshape(3, len(nodes), f, b)


def shrunk(g: np.ndarray, params: Params) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - params.reg_alpha, 0)


def grown(races: DataFrame, ranker: Ranker, params: Params, features: np.ndarray, known: int = 0) -> Tree:
    """One tree, level by level; of a level's splits those of most gain, while ``num_leaves`` allows."""
    tree, nodes, leaves = Tree.empty(params.max_depth), [0], 1

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return shrunk(g, params) ** 2 / (h + params.reg_lambda + 1e-12)

    for level in range(params.max_depth):
        sums = histograms(races, ranker, tree, nodes, params, known)
        g, h, n = sums
        totals = sums[:, :, 0, :].sum(-1)
        if level == 0:
            tree.cover[0] = totals[2, 0]
            tree.value[0] = -params.learning_rate * shrunk(totals[0, 0], params) / (totals[1, 0] + params.reg_lambda + 1e-12)
        left = np.cumsum(sums, axis=-1)
        right = totals[:, :, None, None] - left
        gain = np.round(worth(left[0], left[1]) + worth(right[0], right[1]) - worth(totals[0], totals[1])[:, None, None], 9)
        allowed = (left[2] >= params.min_child_samples) & (right[2] >= params.min_child_samples) & features[None, :, None]
        gain = np.where(allowed, gain, -np.inf).reshape(len(nodes), -1)
        best = gain.argmax(1)
        following = []
        for i in np.argsort(-gain.max(1), kind="stable"):
            if gain[i, best[i]] <= max(params.min_split_gain, 1e-9) or leaves >= params.num_leaves:
                continue
            node, (feature, cut) = nodes[i], divmod(int(best[i]), BINS + 2)
            tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain[i, best[i]]
            leaves += 1
            for child, side in ((2 * node + 1, left), (2 * node + 2, right)):
                cg, ch, cn = side[:, i, feature, cut]
                tree.value[child], tree.cover[child] = -params.learning_rate * shrunk(cg, params) / (ch + params.reg_lambda + 1e-12), cn
                following.append(child)
        nodes = sorted(following)
        if not nodes:
            break
    return tree


def ndcg_by_rounds(races: DataFrame, ranker: Ranker, k: int = 1) -> list[float]:
    """Mean NDCG at ``k`` with the first 1, 2, ... trees, of races with any gain, in one pass. Ties in score go by id."""
    f = len(ranker.features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(ranker.trees)), 0
        for part in Races.each(batches, f):
            steps = [tree.value[tree.leaves(part.bins)] for tree in ranker.trees]
            for runners, shape in part.blocks():
                worth = 2.0 ** part.gains[runners].reshape(shape) - 1
                discount = np.where(np.arange(shape[1]) < k, 1 / np.log2(2 + np.arange(shape[1])), 0)
                best = (-np.sort(-worth, axis=1) * discount).sum(1)
                n += int((best > 0).sum())
                score = np.zeros(shape)
                for i, step in enumerate(steps):
                    score += step[runners].reshape(shape)
                    got = (worth * discount[places(-score)]).sum(1)
                    sums[i] += (got[best > 0] / best[best > 0]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums), pa.array(np.full(len(sums), n))], ["round", "total", "n"])

    found = races.select("sizes", "gains", "bins").mapInArrow(each, "round long, total double, n long").groupBy("round").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("ndcg")).orderBy("round").collect()
    return [r["ndcg"] for r in found]


def train(races: DataFrame, ranker: Ranker, params: Params, valid: DataFrame | None = None, patience: int = 10) -> Ranker:
    """Grow ``params.rounds`` trees on ``races`` (from ``lists``), starting from an untrained ``ranker``.

    With ``valid`` the trees up to the round of the best NDCG@1 there are kept, and training stops when
    ``patience`` rounds brought no better one (looked at each ``LOOK`` rounds, or as many as ``patience``).
    """
    draw = np.random.default_rng(params.seed)
    ranker = replace(ranker, trees=[])
    known, held = 0, []  # of how many trees the executors hold the scores, and the tables that do
    try:
        for number in range(params.rounds):
            if number - known >= KEPT_TREES:
                races, known = with_scores(races, replace(ranker, trees=list(ranker.trees)), known).persist(StorageLevel.MEMORY_AND_DISK), number
                held.append(races)
            features = draw.random(len(ranker.features)) < params.colsample
            ranker.trees.append(grown(races, ranker, params, features if features.any() else ~features, known))
            if len(held) > 1:  # the newer scores are there now
                held.pop(0).unpersist()
            if valid is not None and ((number + 1) % min(LOOK, patience) == 0 or number + 1 == params.rounds):
                best = int(np.argmax(np.round(ndcg_by_rounds(valid, ranker), 12)))
                if number - best >= patience or number + 1 == params.rounds:
                    return replace(ranker, trees=ranker.trees[: best + 1])
        return ranker
    finally:
        for table in held:
            table.unpersist()


# --- scores and their shares ----------------------------------------------------------------------------


def reindexed(df: DataFrame, keys: list[str], expected: list[str]) -> DataFrame:
    """``keys`` and exactly the features that a model expects, in its order: others go, missing ones are null."""
    return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in expected])


def scored(df: DataFrame, ranker: Ranker, out: str = "margin") -> DataFrame:
    """``df`` with the ranker's score; null features count as missing."""

    @F.pandas_udf("double")
    def margin(*x: pd.Series) -> pd.Series:
        return pd.Series(ranker.margins(ranker.binned([c.to_numpy(float) for c in x])))

    return df.withColumn(out, margin(*_features(ranker)))


def _features(ranker: Ranker) -> list[Column]:
    return [F.col(c).cast("double") for c in ranker.features]


def shares(races: DataFrame, ranker: Ranker) -> DataFrame:
    """The distinct scores of races from ``lists``, each as its share of its race (softmax), with their runners: ``share``, ``gain``, ``n``."""
    f = len(ranker.features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in Races.each(batches, f):
            found = pd.DataFrame({"share": softmax(part, ranker), "gain": part.gains}).value_counts(sort=False).rename("n").reset_index()
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return races.select("sizes", "gains", "bins").mapInArrow(each, "share double, gain double, n long").groupBy("share", "gain").agg(F.sum("n").alias("n"))


def softmax(part: Races, ranker: Ranker) -> np.ndarray:
    out = ranker.margins(part.bins)
    for runners, shape in part.blocks():
        e = out[runners].reshape(shape)
        e = np.exp(e - e.max(1, keepdims=True))
        out[runners] = (e / e.sum(1, keepdims=True)).ravel()
    return out


def calibrated_shares(races: DataFrame, ranker: Ranker, calibrate: Callable[[np.ndarray], np.ndarray], carried: str) -> DataFrame:
    """One row a runner of ``lists``: ``p``, its calibrated share scaled to 1 in its race (alike if all are 0), ``gain`` and ``carried``."""
    f = len(ranker.features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in Races.each(batches, f):
            p = calibrate(softmax(part, ranker))
            for runners, shape in part.blocks():
                c = p[runners].reshape(shape)
                total = c.sum(1, keepdims=True)
                p[runners] = np.where(total > 0, c / np.where(total > 0, total, 1), 1.0 / shape[1]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(part.gains), pa.array(part.carried[carried], from_pandas=True)], ["p", "gain", carried])

    return races.select("sizes", "gains", "bins", carried).mapInArrow(each, f"p double, gain double, `{carried}` double")


def shapley(tree: Tree, bins: np.ndarray, features: int) -> np.ndarray:
    """Each feature's Shapley value of the tree's output, by row.

    A feature left out counts by how the training rows split. A leaf's output is a product over the
    features on its path, so the sum over all subsets is that of a polynomial's coefficients by their
    degree: exact, with no subset enumerated.
    """
    out = np.zeros((len(bins), features))
    todo: list[tuple[int, list[tuple[int, int, bool]]]] = [(0, [])]
    while todo:
        node, path = todo.pop()
        if tree.feature[node] >= 0:
            todo += [(2 * node + 1, [*path, (node, 2 * node + 1, False)]), (2 * node + 2, [*path, (node, 2 * node + 2, True)])]
            continue
        here: dict[int, list] = {}  # feature: share of rows that pass, which rows of ``bins`` do
        for at, child, right in path:
            f = int(tree.feature[at])
            share, passes = here.get(f, (1.0, np.ones(len(bins), bool)))
            here[f] = [share * tree.cover[child] / tree.cover[at], passes & ((bins[:, f] > tree.cut[at]) == right)]
        m = len(here)
        for f, (share, passes) in here.items():
            poly = np.zeros((len(bins), m))
            poly[:, 0] = 1
            for other, (s, p) in here.items():
                if other != f:
                    poly[:, 1:] = poly[:, 1:] * s + poly[:, :-1] * p[:, None]
                    poly[:, 0] *= s
            by_size = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
            out[:, f] += tree.value[node] * (passes - share) * (poly @ by_size)
    return out


def expected(tree: Tree, node: int = 0) -> float:
    """The tree's mean output over the rows that it was grown on."""
    if tree.feature[node] < 0:
        return float(tree.value[node])
    left, right = 2 * node + 1, 2 * node + 2
    return (tree.cover[left] * expected(tree, left) + tree.cover[right] * expected(tree, right)) / tree.cover[node]


def base(ranker: Ranker) -> float:
    """The score that contributions are measured from."""
    return sum(map(expected, ranker.trees))


def contributions(df: DataFrame, ranker: Ranker, out: str = "contributions") -> DataFrame:
    """``df`` with an array of each feature's Shapley value; with ``base`` they add up to the score."""
    names = len(ranker.features)

    @F.pandas_udf("array<double>")
    def each(*x: pd.Series) -> pd.Series:
        bins = ranker.binned([c.to_numpy(float) for c in x])
        return pd.Series(list(sum((shapley(tree, bins, names) for tree in ranker.trees), np.zeros((len(bins), names)))))

    return df.withColumn(out, each(*_features(ranker)))
