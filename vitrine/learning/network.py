"""A network of hidden layers under the non-negative PU risk; tasks sum moments and gradients, only weights live on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine import values as V
from vitrine.learning.fit import _auc, moments, standardize
from vitrine.learning.models import NetworkScorer

EPS = 1e-5
# Sums of this many tasks are added up on the driver as they come; more are added in lanes first.
DIRECT, LANES = 32, 8
PARTS = ("pp", "pn", "un")


@dataclass
class Layer:
    """Weights of one hidden layer and the gain and shift of its batch normalisation."""

    w: np.ndarray
    gain: np.ndarray
    shift: np.ndarray


@dataclass
class Network:
    layers: list[Layer]
    w: np.ndarray
    b: float

    @staticmethod
    def start(sizes: list[int], seed: int) -> "Network":
        """Uniform weights within 1 / sqrt(inputs)."""
        rng = np.random.default_rng(seed)
        draw = lambda n, *shape: rng.uniform(-(n**-0.5), n**-0.5, shape)
        layers = [Layer(draw(n, n, h), np.ones(h), np.zeros(h)) for n, h in zip(sizes, sizes[1:], strict=False)]
        return Network(layers, draw(sizes[-1], sizes[-1]), float(draw(sizes[-1], 1)[0]))

    def flat(self) -> np.ndarray:
        parts = [p.ravel() for l in self.layers for p in (l.w, l.gain, l.shift)]
        return np.concatenate([*parts, self.w, [self.b]])

    def like(self, theta: np.ndarray) -> "Network":
        at, layers = 0, []
        take = lambda shape: theta[at : at + int(np.prod(shape))].reshape(shape)
        for l in self.layers:
            parts = []
            for p in (l.w, l.gain, l.shift):
                parts.append(take(p.shape).copy())
                at += p.size
            layers.append(Layer(*parts))
        return Network(layers, theta[at:-1].copy(), float(theta[-1]))


def kept(keys: np.ndarray, width: int, layer: int, turn: int, seed: int, drop: float) -> np.ndarray:
    """Dropout factors (rows x units): a hash of row, unit, layer and step, so every pass over a step draws the same."""
    m = lambda x: np.uint64(x & 0xFFFFFFFFFFFFFFFF)
    z = keys.view(np.uint64)[:, None] ^ (np.arange(1, width + 1, dtype=np.uint64) * m(0x9E3779B97F4A7C15))[None, :]
    z = z + m((seed * 1_000_003 + turn) * 0xD1B54A32D192ED03 + layer * 0x8CB92BA72F3D8DD7)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * m(factor)
    unit = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return (unit >= drop) / (1.0 - drop)


@dataclass
class Step:
    """What tasks need to know of a step: the network, its moments so far, and how dropout is drawn."""

    net: Network
    pi: float
    turn: int
    seed: int
    drop: float
    known: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def forward(self, x: np.ndarray, keys: np.ndarray):
        """(per layer: input, normalised values, slope of what follows; last product)."""
        seen = []
        for i, l in enumerate(self.net.layers):
            z = x @ l.w
            if i == len(self.known):
                return seen, z
            mean, var = self.known[i]
            hat = (z - mean) / np.sqrt(var + EPS)
            y = l.gain * hat + l.shift
            slope = (y > 0).astype(float)
            if self.drop:
                slope *= kept(keys, y.shape[1], i, self.turn, self.seed, self.drop)
            seen.append((x, hat, slope))
            x = y * slope
        return seen + [(x, None, None)], x @ self.net.w + self.net.b


def summed(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Sum over all rows (vec, y, key) of the vector that `make` gives for one Arrow batch; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                part = make(x, b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                part = v.values.to_numpy()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    sums = rows.select("vec", "y", "key").mapInArrow(run, "sums array<double>")
    if rows.rdd.getNumPartitions() > DIRECT:
        sums = sums.repartition(LANES).mapInArrow(add, "sums array<double>")
    found = [np.asarray(r["sums"]) for r in sums.collect()]
    return np.sum(found, axis=0) if found else None


def batch_moments(rows: DataFrame, step: Step, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a layer's products over the whole step, summed as offsets from `at`, a value near the mean."""
    if at is None:
        sample = rows.limit(64).toPandas()
        at = step.forward(np.vstack(sample["vec"].to_numpy()).astype(float), sample["key"].to_numpy())[1].mean(axis=0)

    def make(x, _, keys):
        z = step.forward(x, keys)[1] - at
        return np.concatenate([z.sum(axis=0), (z * z).sum(axis=0), [len(z)]])

    sums = summed(rows, make)
    h, n = len(at), sums[-1]
    return at + sums[:h] / n, np.maximum(sums[h:-1] / n - (sums[:h] / n) ** 2, 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _pushes(s: np.ndarray, y: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per part of the risk: losses and their slopes, zero for the rows it does not hold."""
    p, u = (y == 1).astype(float), (y == 0).astype(float)
    soft = np.logaddexp(0.0, s)
    return {"pp": (p * (soft - s), -p * _sigmoid(-s)), "pn": (p * soft, p * _sigmoid(s)), "un": (u * soft, u * _sigmoid(s))}


def risk_gradient(rows: DataFrame, net: Network, pi: float, turn: int = 0, seed: int = 0, drop: float = 0.0, near=None):
    """(risk, gradient like `Network.flat`, moments) of all rows (vec, y, key) taken as one batch.

    Batch normalisation uses the moments of all rows, combined over the tasks layer by layer; the
    way back is one pass per layer, as the slopes through a layer's moments need sums over all rows.
    With L layers that is 2 L + 1 passes, whatever the number of rows. `near` are moments of an earlier step.
    """
    step = Step(net, pi, turn, seed, drop)
    for i in range(len(net.layers)):
        step.known.append(batch_moments(rows, step, near[i][0] if near else None))
    width = len(net.w)

    def top(x, y, keys):
        seen, s = step.forward(x, keys)
        a, out = seen[-1][0], []
        for loss, push in _pushes(s, y).values():
            back = push[:, None] * net.w * seen[-2][2] if net.layers else np.zeros((len(x), width))
            hat = seen[-2][1] if net.layers else np.zeros((len(x), width))
            out += [a.T @ push, [push.sum(), loss.sum()], back.sum(axis=0), (back * hat).sum(axis=0)]
        return np.concatenate([*out, [len(y), (y == 1).sum(), (y == 0).sum()]])

    sums = summed(rows, top)
    n, n_p, n_u = sums[-3:]
    per = {part: v for part, v in zip(PARTS, np.split(sums[:-3], 3), strict=True)}
    mean = {part: per[part][width + 1] / max(n_p if part[0] == "p" else n_u, 1) for part in PARTS}
    rest = mean["un"] - pi * mean["pn"]
    # without labelled or unlabelled rows the risk is that of the others
    factor = {"pp": pi, "pn": 0.0, "un": 0.0}
    if n_p == 0:
        factor, risk = {"pp": 0.0, "pn": 0.0, "un": 1.0}, mean["un"]
    elif n_u == 0:
        risk = pi * mean["pp"]
    else:
        risk = pi * mean["pp"] + max(rest, 0.0)
        if rest > 0:
            factor = {"pp": pi, "pn": -pi, "un": 1.0}
    factor = {part: f / max(n_p if part[0] == "p" else n_u, 1) for part, f in factor.items()}
    whole = sum(factor[part] * per[part] for part in PARTS)
    out_w, out_b = whole[:width], whole[width]
    sums_of = {len(net.layers) - 1: (whole[width + 2 : 2 * width + 2], whole[2 * width + 2 :])}
    grads: dict[int, np.ndarray] = {}
    for target in reversed(range(len(net.layers))):

        def down(x, y, keys, target=target):
            seen, s = step.forward(x, keys)
            push = sum(factor[part] * slope for part, (_, slope) in _pushes(s, y).items())
            back = push[:, None] * net.w * seen[len(net.layers) - 1][2]
            for i in reversed(range(target, len(net.layers))):
                a, hat, _ = seen[i]
                one, two = sums_of[i]
                dz = net.layers[i].gain / np.sqrt(step.known[i][1] + EPS) * (back - one / n - hat * two / n)
                if i == target:
                    own = (a.T @ dz).ravel()
                if i:
                    back = dz @ net.layers[i].w.T * seen[i - 1][2]
            if not target:
                return own
            hat = seen[target - 1][1]
            return np.concatenate([own, back.sum(axis=0), (back * hat).sum(axis=0)])

        found = summed(rows, down)
        size = net.layers[target].w.size
        grads[target] = found[:size]
        if target:
            sums_of[target - 1] = tuple(np.split(found[size:], 2))
    parts = [p for i in range(len(net.layers)) for p in (grads[i], sums_of[i][1], sums_of[i][0])]
    return float(risk), np.concatenate([*parts, out_w, [out_b]]), step.known


def folded(net: Network, known, mean: np.ndarray, std: np.ndarray, **names) -> NetworkScorer:
    """The network as plain affine maps over raw vectors: normalisation and scaling move into the weights."""
    factor = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
    weights, biases = [], []
    for i, (l, (m, v)) in enumerate(zip(net.layers, known, strict=True)):
        scale = l.gain / np.sqrt(v + EPS)
        w = (l.w * factor[:, None] if i == 0 else l.w) * scale
        bias = l.shift - m * scale
        weights.append(w)
        biases.append(bias - mean @ w if i == 0 else bias)
    last = net.w[:, None]
    if not net.layers:
        last = last * factor[:, None]
    weights.append(last)
    biases.append(np.array([net.b - (mean @ last[:, 0] if not net.layers else 0.0)]))
    return NetworkScorer(weights=[w.tolist() for w in weights], biases=[b.tolist() for b in biases], **names)


def fit_nnpu_network(
    train: DataFrame,
    validation: DataFrame,
    pi: float,
    name="nnpu",
    feature="",
    hidden: list[int] | None = None,
    epochs: int = 50,
    rate: float = 1e-3,
    decay: float = 1e-4,
    parts: int = 1,
    drop: float = V.DROPOUT,
    momentum: float = 0.1,
    check: int = 1,
    patience: int = 10,
    scale: bool = True,
    seed: int = 42,
) -> NetworkScorer:
    """Network with batch normalisation, max(0, .) and dropout between its layers, minimising the nnPU risk by Adam.

    `train` and `validation` are (item_id, y, vec). `hidden` sizes default to those fixed for the
    feature. An epoch takes the rows in `parts` steps, dealt by a hash of the item id; the rate falls
    along a cosine to 1e-5. Scoring uses running moments (`momentum` a step). Every `check` epochs
    the validation AUC is taken; the best weights are kept, the earliest of equals, and the fit
    stops after `patience` checks without a better one. Nothing but sums of the size of the
    weights reaches the driver. Vectors that are null take no part; an empty `train` is an error.
    """
    train = train.where("vec IS NOT NULL")
    if train.isEmpty():
        raise ValueError("no rows to fit on")
    fitted = moments(train)
    mean, std = fitted[1:]
    if not scale:
        mean, std = np.zeros_like(mean), np.ones_like(std)
    key = F.xxhash64(F.lit(seed), "item_id")
    rows = standardize(train, (fitted[0], mean, std)).select("vec", F.col("y").cast("int").alias("y"), key.alias("key")).persist()
    net = Network.start([len(mean), *(V.HIDDEN_LAYERS.get(feature, V.HIDDEN_OTHER) if hidden is None else hidden)], seed)
    theta = net.flat()
    first, second, turn = np.zeros_like(theta), np.zeros_like(theta), 0
    running, best, best_auc, waited = None, None, -1.0, 0
    for epoch in range(1, epochs + 1):
        now = 1e-5 + (rate - 1e-5) * (1 + np.cos(np.pi * (epoch - 1) / epochs)) / 2
        for part in range(parts):
            step_rows = rows.where(F.pmod("key", F.lit(parts)) == part) if parts > 1 else rows
            if parts > 1 and step_rows.isEmpty():
                continue
            turn += 1
            _, g, known = risk_gradient(step_rows, net, pi, turn, seed, drop, running)
            g = g + decay * theta
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            theta = theta - now * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
            net = net.like(theta)
            share = max(momentum, 1.0 / turn)
            running = known if running is None else [tuple((1 - share) * o + share * k for o, k in zip(*pair, strict=True)) for pair in zip(running, known, strict=True)]
        if epoch % check == 0 or epoch == epochs:
            model = folded(net, running, mean, std, name=name, feature=feature, method="nnpu")
            auc = _auc(model, validation) or 0.0
            if auc > best_auc:
                best, best_auc, waited = model, auc, 0
            else:
                waited += 1
            if waited >= patience:
                break
    rows.unpersist()
    return best
