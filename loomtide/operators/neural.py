"""Small neural networks in numpy, trained and applied on Spark partitions.

A network is a chain of layers; a row is one example, for recurrent layers a sequence of steps one after
another. Training takes the summed gradients of all partitions each round, added up in two levels, so all rows
take part and the driver sees at most ``GROUPS`` gradients.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GROUPS = 16


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# Activation name: value, and derivative from the input and the value.
ACTIVATIONS = {
    "linear": (lambda x: x, lambda x, f: np.ones_like(x)),
    "sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500))), lambda x, f: f * (1 - f)),
    "sine": (np.sin, lambda x, f: np.cos(x)),
    "tanh": (np.tanh, lambda x, f: 1 - f * f),
    "lecun_tanh": (lambda x: 1.7159 * np.tanh(2 * x / 3), lambda x, f: 1.7159 * 2 / 3 * (1 - (f / 1.7159) ** 2)),
    "leaky_relu": (lambda x: np.where(x > 0, x, 0.01 * x), lambda x, f: np.where(x > 0, 1, 0.01)),
    "relu": (lambda x: np.maximum(x, 0), lambda x, f: (x > 0).astype(float)),
}


def _argmax_miss(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """1 for rows whose largest output stands elsewhere than the largest target."""
    return (a.argmax(1) != t.argmax(1)).astype(float)[:, None]


# Loss name: value per cell or row, and derivative by the output. Those without a derivative only judge.
LOSSES = {
    "squares": (lambda a, t: 0.5 * (a - t) ** 2, lambda a, t: a - t),
    "absolute": (lambda a, t: np.abs(a - t), lambda a, t: np.sign(a - t)),
    "log": (lambda a, t: -t * np.log(np.maximum(a, 1e-12)), lambda a, t: -t / np.maximum(a, 1e-12)),
    "softmax_log": (lambda a, t: -t * np.log(np.maximum(_softmax(a), 1e-300)), lambda a, t: _softmax(a) * t.sum(axis=1, keepdims=True) - t),
    "argmax": (_argmax_miss, None),
    "binary": (lambda a, t: ((a >= 0.5) != (t >= 0.5)).astype(float), None),
}

#: Losses of cells as one number.
REDUCERS = {"sum": np.sum, "mean": np.mean, "max": np.max, "rms": lambda x: np.sqrt(np.mean(x * x))}


def initial(kind: str, rows: int, cols: int, rng) -> np.ndarray:
    """First weights: a distribution and a fan rule as in ``xavier_uniform``, or zeros, ones, identity, uniform, gaussian."""
    plain = {"zeros": lambda: np.zeros((rows, cols)), "ones": lambda: np.ones((rows, cols)), "identity": lambda: np.eye(rows, cols), "uniform": lambda: rng.uniform(-1, 1, (rows, cols)), "gaussian": lambda: rng.normal(0, 1, (rows, cols))}
    if kind in plain:
        return plain[kind]()
    rule, shape = kind.split("_")
    # The variance that each rule gives.
    variance = {"xavier": 2 / (rows + cols), "he": 2 / rows, "lecun": 1 / rows, "fanin": 1 / rows, "fanout": 1 / cols, "fan": 1 / (rows + cols)}[rule]
    return rng.normal(0, np.sqrt(variance), (rows, cols)) if shape == "gaussian" else rng.uniform(-1, 1, (rows, cols)) * np.sqrt(3 * variance)


@dataclass
class Layer:
    """One layer: kind, sizes, activation, and its parameters by name.

    Kinds: dense, linear (no bias), softmax (its input as shares), linear_softmax, dropout, and over sequences rnn, gru and lstm.
    """

    kind: str
    inputs: int
    outputs: int
    activation: str = "linear"
    keep: float = 1.0
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    GATES = {"rnn": "h", "gru": "zrh", "lstm": "ifog"}

    def prepare(self, rng, weights: str) -> Layer:
        a, b = self.inputs, self.outputs
        if self.kind in ("dense", "linear", "linear_softmax"):
            self.parameters["w"] = initial(weights, a, b, rng)
            if self.kind != "linear":
                self.parameters["b"] = np.zeros(b)
        for g in self.GATES.get(self.kind, ""):
            self.parameters |= {f"w{g}": initial(weights, a, b, rng), f"u{g}": initial(weights, b, b, rng), f"b{g}": np.ones(b) if self.kind == "lstm" and g == "f" else np.zeros(b)}
        return self

    def forward(self, x: np.ndarray, rng=None) -> tuple[np.ndarray, tuple]:
        """The output and what ``backward`` needs. ``rng`` is given in training only, and drops cells of a dropout layer."""
        p = self.parameters
        if self.kind == "dropout":
            mask = np.ones_like(x) if rng is None else (rng.random(x.shape) < self.keep) / self.keep
            return x * mask, (mask,)
        if self.kind in self.GATES:
            return self._unrolled(x)
        z = x if self.kind == "softmax" else x @ p["w"] + p.get("b", 0.0)
        if self.kind in ("softmax", "linear_softmax"):
            y = _softmax(z)
            return y, (x, y)
        y = ACTIVATIONS[self.activation][0](z)
        return y, (x, z, y)

    def backward(self, back: np.ndarray, held: tuple) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The gradient by the input and by each parameter."""
        p = self.parameters
        if self.kind == "dropout":
            return back * held[0], {}
        if self.kind in self.GATES:
            return self._rolled_back(back, held)
        if self.kind in ("softmax", "linear_softmax"):
            x, y = held
            dz = y * (back - (back * y).sum(axis=1, keepdims=True))
            if self.kind == "softmax":
                return dz, {}
        else:
            x, z, y = held
            dz = back * ACTIVATIONS[self.activation][1](z, y)
        return dz @ p["w"].T, {"w": x.T @ dz} | ({"b": dz.sum(0)} if "b" in p else {})

    def _gate(self, g: str, x: np.ndarray, h: np.ndarray, squash: str) -> np.ndarray:
        p = self.parameters
        return ACTIVATIONS[squash][0](x @ p[f"w{g}"] + h @ p[f"u{g}"] + p[f"b{g}"])

    def _unrolled(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Sequences of steps of ``inputs`` cells; the output is the state after the last step."""
        steps = x.reshape(len(x), -1, self.inputs)
        h, c, trace = np.zeros((len(x), self.outputs)), np.zeros((len(x), self.outputs)), []
        for t in range(steps.shape[1]):
            s, before = steps[:, t], (h, c)
            if self.kind == "rnn":
                h = self._gate("h", s, h, "tanh")
                trace.append((s, before, {"h": h}))
            elif self.kind == "gru":
                z, r = self._gate("z", s, h, "sigmoid"), self._gate("r", s, h, "sigmoid")
                n = self._gate("h", s, r * h, "tanh")
                h = (1 - z) * h + z * n
                trace.append((s, before, {"z": z, "r": r, "h": n}))
            else:
                i, f, o = (self._gate(g, s, h, "sigmoid") for g in "ifo")
                g = self._gate("g", s, h, "tanh")
                c = f * c + i * g
                h = o * np.tanh(c)
                trace.append((s, before, {"i": i, "f": f, "o": o, "g": g, "c": c}))
        return h, (x.shape, trace)

    def _rolled_back(self, dh: np.ndarray, held: tuple) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        shape, trace = held
        p, grads = self.parameters, {k: np.zeros_like(v) for k, v in self.parameters.items()}
        dx, dc = np.zeros((shape[0], len(trace), self.inputs)), np.zeros_like(dh)
        for t in range(len(trace) - 1, -1, -1):
            s, (h, c), v = trace[t]
            if self.kind == "rnn":
                open_, carried = {"h": dh * (1 - v["h"] ** 2)}, 0.0
            elif self.kind == "gru":
                dn = dh * v["z"] * (1 - v["h"] ** 2)
                through = dn @ p["uh"].T
                open_ = {"h": dn, "z": dh * (v["h"] - h) * v["z"] * (1 - v["z"]), "r": through * h * v["r"] * (1 - v["r"])}
                carried = dh * (1 - v["z"]) + through * v["r"]
            else:
                squashed = np.tanh(v["c"])
                dc = dc + dh * v["o"] * (1 - squashed**2)
                open_ = {"o": dh * squashed * v["o"] * (1 - v["o"]), "i": dc * v["g"] * v["i"] * (1 - v["i"]), "f": dc * c * v["f"] * (1 - v["f"]), "g": dc * v["i"] * (1 - v["g"] ** 2)}
                carried, dc = 0.0, dc * v["f"]
            before = np.zeros_like(dh)
            for g, d in open_.items():
                state = v["r"] * h if self.kind == "gru" and g == "h" else h
                grads[f"w{g}"] += s.T @ d
                grads[f"u{g}"] += state.T @ d
                grads[f"b{g}"] += d.sum(0)
                dx[:, t] += d @ p[f"w{g}"].T
                if not (self.kind == "gru" and g == "h"):
                    before += d @ p[f"u{g}"].T
            dh = before + carried
        return dx.reshape(shape), grads


@dataclass
class Network:
    layers: list[Layer]

    @staticmethod
    def of(sizes: list[int], activations: list[str], seed: int = 1, weights: str = "xavier_gaussian") -> Network:
        """Dense layers of some sizes."""
        return Network.chain([Layer("dense", a, b, f) for a, b, f in zip(sizes, sizes[1:], activations, strict=False)], seed, weights)

    @staticmethod
    def chain(layers: list[Layer], seed: int = 1, weights: str = "xavier_gaussian") -> Network:
        rng = np.random.default_rng(seed)
        return Network([layer.prepare(rng, weights) for layer in layers])

    def output(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)[0]
        return x

    def flat(self) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(v.ravel() for layer in self.layers for v in layer.parameters.values())])

    def gradient(self, x: np.ndarray, t: np.ndarray, loss: str, rng=None) -> tuple[float, np.ndarray]:
        """Summed loss and the flat gradient of all parameters."""
        if LOSSES[loss][1] is None:
            raise ValueError(f"{loss} has no gradient")
        held = []
        for layer in self.layers:
            x, h = layer.forward(x, rng)
            held.append(h)
        value, back, grads = float(LOSSES[loss][0](x, t).sum()), LOSSES[loss][1](x, t), []
        for layer, h in zip(self.layers[::-1], held[::-1], strict=True):
            back, g = layer.backward(back, h)
            grads.append(np.concatenate([np.zeros(0), *(g[k].ravel() for k in layer.parameters)]))
        return value, np.concatenate(grads[::-1])

    def step(self, delta: np.ndarray) -> None:
        at = 0
        for layer in self.layers:
            for v in layer.parameters.values():
                v -= delta[at : at + v.size].reshape(v.shape)
                at += v.size


def optimiser(name: str, rate: float, decay: float = 0.9999, shrink: float = 0.0):
    """A function from gradient and parameters to step: gradient, momentum, nesterov or rmsprop, with weights shrunk by ``shrink``."""
    state: dict[str, np.ndarray] = {}

    def move(g: np.ndarray, weights: np.ndarray) -> np.ndarray:
        g = g + shrink * weights
        if name == "gradient":
            return rate * g
        if name == "rmsprop":
            state["s"] = decay * state.get("s", g * g) + (1 - decay) * g * g
            return rate * np.clip(g, -5, 5) / np.sqrt(state["s"] + 1e-8)
        before = state.get("v", np.zeros_like(g))
        state["v"] = 0.9 * before + rate * g
        return state["v"] if name == "momentum" else 0.9 * state["v"] + rate * g

    return move


def _arrays(df: DataFrame, inputs: list[str], targets: list[str]) -> DataFrame:
    return df.select(F.array(*(F.col(c).cast("double") for c in inputs)).alias("x"), F.array(*(F.col(c).cast("double") for c in targets)).alias("t"))


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, t = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (0, 1))
    return x, t


def learn(df: DataFrame, inputs: list[str], targets: list[str], network: Network, rounds: int = 50, rate: float = 0.1, loss: str = "squares", optimise: str = "momentum", shrink: float = 0.0, seed: int = 1) -> list[float]:
    """Train in place on all rows; returns the mean loss of each round."""
    rows = _arrays(df, inputs, targets).persist()
    move, losses = optimiser(optimise, rate, shrink=shrink), []
    for number in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast(network)

        def partial(batches, shared=shared, number=number):
            total, n, grad = 0.0, 0, 0.0
            for b in batches:
                x, t = _cells(b)
                value, g = shared.value.gradient(x, t, loss, np.random.default_rng([seed, number, n]))
                total, n, grad = total + value, n + b.num_rows, grad + g
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64()), pa.array([np.asarray(grad).tobytes()], pa.binary())], ["total", "n", "grad"])

        def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            grad = sum(np.frombuffer(g, np.float64) for g in table["grad"].to_pylist())
            return pa.table([pa.array([sum(table["total"].to_pylist())]), pa.array([sum(table["n"].to_pylist())], pa.int64()), pa.array([grad.tobytes()], pa.binary())], ["total", "n", "grad"])

        sums = rows.mapInArrow(partial, "total double, n long, grad binary").groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS))).applyInArrow(added, "total double, n long, grad binary").collect()
        n = sum(r["n"] for r in sums)
        if not n:
            break
        network.step(move(sum(np.frombuffer(r["grad"], np.float64) for r in sums) / n, network.flat()))
        losses.append(sum(r["total"] for r in sums) / n)
    rows.unpersist()
    return losses


def judge(df: DataFrame, inputs: list[str], targets: list[str], network: Network, loss: str = "squares", reducer: str = "mean") -> float:
    """A network's loss on rows it need not have seen, as one number."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for b in batches:
            x, t = _cells(b)
            cells = LOSSES[loss][0](shared.value.output(x), t)
            yield pa.RecordBatch.from_arrays([pa.array([float(cells.sum())]), pa.array([float((cells * cells).sum())]), pa.array([float(cells.max())]), pa.array([cells.size], pa.int64())], ["s", "q", "m", "n"])

    one = _arrays(df, inputs, targets).mapInArrow(run, "s double, q double, m double, n long").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("m").alias("m"), F.sum("n").alias("n")).first()
    if not one["n"]:
        return 0.0
    return {"sum": one["s"], "mean": one["s"] / one["n"], "max": one["m"], "rms": float(np.sqrt(one["q"] / one["n"]))}[reducer]


def predict(df: DataFrame, inputs: list[str], network: Network) -> DataFrame:
    """``df`` with the array ``prediction``; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("array<double>")
    def prediction(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.output(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)).tolist(), pa.list_(pa.float64()))

    return df.withColumn("prediction", prediction(F.array(*(F.col(c).cast("double") for c in inputs))))
