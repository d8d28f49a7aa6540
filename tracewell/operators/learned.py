"""Hash functions learned by siamese towers, in numpy.

A tower maps a trace's features to m * b outputs in (-1, 1). Two copies with shared weights see the
two traces of a pair. The hashing objective makes one minus half the mean of the segments' largest
gaps (a smooth share of agreeing segments) follow the pair's similarity, and pulls outputs to 1 or
-1 and their sum to 0. The baseline objective follows the similarity by exp(-0.005 L1) and turns
absolute outputs towards the all-ones direction. Training pairs are a bounded sample on the driver;
trained towers hash any number of rows on the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.storage import shipped

# ---- heads: (value, gradients with respect to both inputs), gradients already weighted by `up`


def ham_dist(x: np.ndarray, y: np.ndarray, b: int) -> np.ndarray:
    gap = np.abs(x - y).reshape(len(x), -1, b).max(2)
    return 1 - gap.sum(1) * b / (2 * x.shape[1])


def ham_dist_back(x: np.ndarray, y: np.ndarray, b: int, up: np.ndarray) -> np.ndarray:
    """Gradient for x (that for y is its negative): each segment's largest gap takes it all."""
    d = (x - y).reshape(len(x), -1, b)
    at = np.abs(d).argmax(2)[..., None]
    g = np.zeros_like(d)
    np.put_along_axis(g, at, -np.sign(np.take_along_axis(d, at, 2)) * b / (2 * x.shape[1]), 2)
    return g.reshape(x.shape) * up[:, None]


def manh_dist(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.exp(-0.005 * np.abs(x - y).sum(1))


def prod_vec(x: np.ndarray) -> float:
    return float((x * x).sum(1).mean() / x.shape[1])


def sum_vec(x: np.ndarray) -> np.ndarray:
    return x.sum(1) / x.shape[1]


def ones_loss(x: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative cosine of |x| with the all-ones vector, averaged, and its gradient."""
    a, n = np.abs(x), np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    c = a.sum(1, keepdims=True) / (n * np.sqrt(x.shape[1]))
    g = (np.sign(x) / np.sqrt(x.shape[1]) - c * x / n) / n
    return float(-c.mean()), -g / len(x)


class Dense:
    """Fully connected layers with tanh (or sigmoid) inside and tanh at the end."""

    def __init__(self, sizes: list[int], sigmoid: bool = False, seed: int = 0):
        rnd = np.random.default_rng(seed)
        self.sigmoid = sigmoid
        self.params = []
        for a, b in zip(sizes, sizes[1:]):
            self.params += [rnd.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        outs = [x]
        for i in range(0, len(self.params), 2):
            z = outs[-1] @ self.params[i] + self.params[i + 1]
            outs.append(np.tanh(z) if i == len(self.params) - 2 or not self.sigmoid else 1 / (1 + np.exp(-z)))
        return outs

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def back(self, outs: list[np.ndarray], g: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the input."""
        grads = [np.zeros(0)] * len(self.params)
        for i in range(len(self.params) - 2, -1, -2):
            y = outs[i // 2 + 1]
            g = g * (1 - y * y if i == len(self.params) - 2 or not self.sigmoid else y * (1 - y))
            grads[i], grads[i + 1] = outs[i // 2].T @ g, g.sum(0)
            g = g @ self.params[i].T
        return grads, g


class Conv:
    """Frame numbers (0 for padding): one-hot, filters over windows of 3 and 4 frames, largest response, dense layers.

    A filter over one-hot frames is a table with a row for each frame, so responses are look-ups.
    """

    kernels = (3, 4)

    def __init__(self, frames: int, filters: int, sizes: list[int], seed: int = 0):
        rnd = np.random.default_rng(seed)
        self.filters = filters
        self.tables = [rnd.normal(0, 0.3, (k, frames + 1, filters)) for k in self.kernels]
        for t in self.tables:
            t[:, 0] = 0
        self.dense = Dense([filters * len(self.kernels), *sizes], seed=seed)

    @property
    def params(self) -> list[np.ndarray]:
        return [*self.tables, *self.dense.params]

    def forward(self, x: np.ndarray) -> tuple:
        tops, places = [], []
        for k, t in zip(self.kernels, self.tables):
            r = sum(t[j][x[:, j : x.shape[1] - k + 1 + j]] for j in range(k))
            places.append(r.argmax(1))
            tops.append(r.max(1))
        h = np.concatenate(tops, 1)
        return x, places, h, self.dense.forward(np.maximum(h, 0))

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[3][-1]

    def back(self, state: tuple, g: np.ndarray) -> tuple[list[np.ndarray], None]:
        x, places, h, outs = state
        grads, back = self.dense.back(outs, g)
        back = back * (h > 0)
        tables = []
        for i, (k, t) in enumerate(zip(self.kernels, self.tables)):
            d = np.zeros_like(t)
            for j in range(k):
                frame = np.take_along_axis(x, places[i] + j, 1)
                np.add.at(d[j], (frame, np.arange(self.filters)[None, :]), back[:, i * self.filters : (i + 1) * self.filters])
            d[:, 0] = 0
            tables.append(d)
        return [*tables, *grads], None


def _last(state) -> np.ndarray:
    return state[3][-1] if isinstance(state, tuple) else state[-1]


def hash_objective(x: np.ndarray, y: np.ndarray, want: np.ndarray, b: int) -> tuple[float, np.ndarray, np.ndarray]:
    """15/16 squared error of the smooth similarity, 1/64 each for lengths and sums of both sides; gradients for x and y."""
    n, size = len(x), x.shape[1]
    off = ham_dist(x, y, b) - want
    g = ham_dist_back(x, y, b, 15 / 16 * 2 * off / n)
    loss, grads = 15 / 16 * float((off * off).mean()), []
    for v, part in ((x, g), (y, -g)):
        p, s = prod_vec(v), sum_vec(v)
        loss += ((p - 1) ** 2 + float((s * s).mean())) / 64
        grads.append(part + 2 * (p - 1) * 2 * v / (n * size) / 64 + (2 * s / (n * size) / 64)[:, None])
    return loss, *grads


def baseline_objective(x: np.ndarray, y: np.ndarray, want: np.ndarray, b: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """1/2 squared error of exp(-0.005 L1), 1/4 each for the direction of both sides' absolute values."""
    v = manh_dist(x, y)
    off = v - want
    g = (off * v * -0.005 / len(x))[:, None] * np.sign(x - y)
    (lx, gx), (ly, gy) = ones_loss(x), ones_loss(y)
    return 0.5 * float((off * off).mean()) + 0.25 * (lx + ly), g + 0.25 * gx, -g + 0.25 * gy


def train(tower, x: np.ndarray, y: np.ndarray, want: np.ndarray, b: int, objective=hash_objective, epochs: int = 20, batch: int = 512, rate: float = 0.001, seed: int = 0, rows: np.ndarray | None = None) -> list[float]:
    """Adam over shuffled batches of pairs; the mean loss of each epoch. With `rows`, x and y are places in them."""
    rnd, losses, step = np.random.default_rng(seed), [], 0
    params = tower.params
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for _ in range(epochs):
        order, total = rnd.permutation(len(x)), 0.0
        for a in range(0, len(x), batch):
            at = order[a : a + batch]
            sx, sy = (tower.forward(v[at] if rows is None else rows[v[at]]) for v in (x, y))
            loss, gx, gy = objective(_last(sx), _last(sy), want[at], b)
            total += loss * len(at)
            step += 1
            for p, g1, g2, (m, v) in zip(params, tower.back(sx, gx)[0], tower.back(sy, gy)[0], moments):
                g = g1 + g2
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        losses.append(total / max(1, len(x)))
    return losses


def predict(tower, x: np.ndarray, y: np.ndarray, b: int) -> np.ndarray:
    """The smooth similarity of pairs."""
    return ham_dist(tower.output(x), tower.output(y), b)


def hashed(rows: DataFrame, tower, column: str) -> DataFrame:
    """(id, h): outputs of the tower for an array column of rows (id, ...), as an array of doubles.

    Null arrays, and arrays that hold a null, have no outputs: their h is null.
    """
    shared = shipped(rows.sparkSession, tower)

    def run(batches):
        held = shared()
        for rb in batches:
            values = rb.column(column).to_pylist()
            at = [i for i, v in enumerate(values) if v is not None and None not in v]
            h: list = [None] * len(values)
            if at:
                for i, row in zip(at, held.output(np.array([values[i] for i in at])).tolist()):
                    h[i] = row
            yield pa.RecordBatch.from_arrays([rb.column("id"), pa.array(h, pa.list_(pa.float64()))], names=["id", "h"])

    return rows.select(F.col("id").cast("long").alias("id"), column).mapInArrow(run, "id long, h array<double>")


def state(tower: Dense | Conv) -> dict[str, np.ndarray]:
    """A tower's arrays, for save_model."""
    dense = tower.dense if isinstance(tower, Conv) else tower
    tables = {f"t{i}": t for i, t in enumerate(tower.tables)} if isinstance(tower, Conv) else {}
    return {f"p{i}": p for i, p in enumerate(dense.params)} | {"sigmoid": np.array(dense.sigmoid)} | tables


def restored(arrays: dict[str, np.ndarray]) -> Dense | Conv:
    dense = Dense([1, 1], bool(arrays["sigmoid"]))
    dense.params = [arrays[k] for k in sorted((k for k in arrays if k[0] == "p"), key=lambda k: int(k[1:]))]
    tables = [arrays[k] for k in sorted(k for k in arrays if k[0] == "t")]
    if not tables:
        return dense
    tower = Conv(1, tables[0].shape[2], [1])
    tower.tables, tower.dense = tables, dense
    return tower
