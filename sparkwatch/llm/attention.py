"""A small causal self-attention model over classes of token ids, in numpy.

One layer: the class of each id is embedded, attends to the classes before it (scores of
query and key plus a bias by distance), passes a two-layer perceptron, and yields logits over
the class of the next id, added to the logs of a table of class transitions. Training runs over
whole windows with gradients written out by hand and Adam. Scoring runs over blocks: each
position is a query once, and the keys of a block are its own positions and those of the block
before it, so windows overlap and every position is scored once with a context of
``BLOCK`` + 1 to 2 * ``BLOCK`` ids. As keys, values and queries depend on the class alone, they
are rows of tables that are multiplied out once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
WINDOW = 2 * BLOCK
#: Blocks of one numpy step: its arrays stay in a core's cache.
STEP_BLOCKS = 64
_FAR = np.float32(-1e9)
#: Exponents below this count as this one: denormal floats are slow. Logits above _MOST are shifted.
_LEAST, _MOST = np.float32(-50), 60.0
SHAPES = {"embed": "cd", "query": "dd", "key": "dd", "value": "dd", "distance": "w", "up": "dm", "up_bias": "m", "down": "md", "out": "dc"}


def shapes(classes: int, width: int) -> dict[str, tuple[int, ...]]:
    size = {"c": classes, "d": width, "m": 2 * width, "w": WINDOW}
    return {name: tuple(size[x] for x in dims) for name, dims in SHAPES.items()}


def initial(classes: int, width: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights but for the output, which starts at zero: the table alone speaks."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes(classes, width).items():
        scale = 0.0 if name in ("out", "up_bias", "distance") else 1.0 if name == "embed" else shape[0] ** -0.5
        out[name] = (rng.standard_normal(shape) * scale).astype(np.float32)
    return out


def flatten(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES])


def unflatten(flat: np.ndarray, classes: int, width: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(classes, width).items():
        n = int(np.prod(shape))
        out[name] = np.asarray(flat[at : at + n], dtype=np.float32).reshape(shape)
        at += n
    return out


_BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_PAST = (_BACK >= 0).astype(np.float32)
_DISTANCE = np.maximum(_BACK, 0)


def loss_and_gradients(p: dict[str, np.ndarray], table: np.ndarray, x: np.ndarray, y: np.ndarray,
                       real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood (natural) of the next classes ``y`` after ``x`` over the
    ``real`` positions of windows (rows of WINDOW classes), and its gradients. ``table`` holds the
    probabilities of class transitions, which the exponentials of the logits are multiplied by."""
    n, w = x.shape
    d = p["embed"].shape[1]
    scale = np.float32(d**-0.5)
    flat_x, flat_y = x.ravel(), y.ravel()
    e = p["embed"][flat_x]
    q, k, v = ((e @ p[name]).reshape(n, w, d) for name in ("query", "key", "value"))
    a = q @ k.transpose(0, 2, 1)
    a *= scale
    a += p["distance"][_DISTANCE]
    a -= a.max(-1, keepdims=True)
    np.exp(np.maximum(a, _LEAST, out=a), out=a)
    a *= _PAST
    a /= a.sum(-1, keepdims=True)
    h = e + (a @ v).reshape(-1, d)
    u = np.maximum(h @ p["up"] + p["up_bias"], 0)
    top = h + u @ p["down"]
    z = top @ p["out"]
    if z.max() > _MOST:
        z -= z.max(1, keepdims=True)
        np.maximum(z, _LEAST, out=z)
    np.exp(z, out=z)
    z *= np.take(table, flat_x, axis=0)
    total = z @ np.ones(z.shape[1], z.dtype)
    weight = real.ravel().astype(np.float32)
    weight /= max(weight.sum(), 1.0)
    rows = np.arange(len(flat_y))
    loss = float(-(np.log(z[rows, flat_y] / total + 1e-30) * weight).sum())
    z *= (weight / total)[:, None]
    z[rows, flat_y] -= weight
    g = {"out": top.T @ z}
    dtop = z @ p["out"].T
    g["down"] = u.T @ dtop
    du = (dtop @ p["down"].T) * (u > 0)
    g["up"], g["up_bias"] = h.T @ du, du.sum(0)
    dh = dtop + du @ p["up"].T
    do = dh.reshape(n, w, d)
    da = do @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ do
    da -= (da * a).sum(-1, keepdims=True)
    da *= a
    g["distance"] = np.bincount(_DISTANCE.ravel(), weights=da.sum(0).ravel(), minlength=WINDOW).astype(np.float32)
    da *= scale
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    de = dh.copy()
    for name, grad in (("query", dq), ("key", dk), ("value", dv)):
        grad = grad.reshape(-1, d)
        g[name] = e.T @ grad
        de += grad @ p[name].T
    places = flat_x[:, None] * d + np.arange(d)
    g["embed"] = np.bincount(places.ravel(), de.ravel(), p["embed"].size).reshape(-1, d).astype(de.dtype)
    return loss, g


class Adam:
    """Changes ``flat``, the array that all weights are views of."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.step = flat, rate, 0
        self.mean, self.square = np.zeros_like(flat), np.zeros_like(flat)

    def update(self, grads: dict[str, np.ndarray], warm: int = 20) -> None:
        self.step += 1
        rate = self.rate * min(1.0, self.step / warm)
        g, m, s = flatten(grads), self.mean, self.square
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        change = (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-8)
        self.flat -= (rate * change).astype(np.float32)


class Scorer:
    """Log10 probabilities of the next class, for sequences of any length."""

    def __init__(self, p: dict[str, np.ndarray], table: np.ndarray):
        classes, d = p["embed"].shape
        self.classes, self.width = classes, d
        embed = np.vstack([p["embed"], np.zeros((1, d), np.float32)])  # the last row pads
        scale = np.float32(d**-0.5)
        q, k = embed @ p["query"] * scale, embed @ p["key"]
        # the greatest score of each query, as one more coordinate: exponents stay below zero
        top = (q @ k.T).max(1, keepdims=True)
        self.query = np.hstack([q, -top])
        self.key = np.hstack([k, np.ones((classes + 1, 1), np.float32)])
        # one more column sums the weights
        self.value = np.hstack([embed @ p["value"], np.ones((classes + 1, 1), np.float32)])
        self.embed, self.p = embed, p
        self.buffers: dict[str, np.ndarray] = {}
        back = (BLOCK + np.arange(BLOCK))[:, None] - np.arange(WINDOW)[None, :]
        self.bias = np.where(back >= 0, p["distance"][np.maximum(back, 0)] - p["distance"].max(), _FAR).astype(np.float32)
        self.table = np.vstack([table, np.full((1, classes), 1.0 / classes)]).astype(np.float32)
        self.log_table = np.log(self.table)

    def positions(self, before: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 P(after[i] | before[..i]) of each position; sequences of ``lengths`` stand one
        after another in ``before`` (classes of what precedes) and ``after``."""
        blocks = -(-lengths // BLOCK)
        # every sequence gets a block of padding before it and its last block is filled up
        first = np.concatenate([[0], np.cumsum(blocks + 1)])
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        place = np.arange(len(before)) + np.repeat((first[:-1] + 1) * BLOCK - starts, lengths)
        x = np.full(first[-1] * BLOCK, self.classes, np.int64)
        y = np.zeros(first[-1] * BLOCK, np.int64)
        x[place], y[place] = before, after
        x, y = x.reshape(-1, BLOCK), y.reshape(-1, BLOCK)
        lead = np.zeros(len(x), bool)
        lead[first[:-1]] = True
        own = np.flatnonzero(~lead)
        out = np.empty((len(x), BLOCK), np.float32)
        for i in range(0, len(own), STEP_BLOCKS):
            at = own[i : i + STEP_BLOCKS]
            out[at] = self._blocks(np.hstack([x[at - 1], x[at]]), y[at], lead[at - 1])
        return out.ravel()[place].astype(np.float64)

    def _buffer(self, name: str, *shape: int) -> np.ndarray:
        """The first rows of an array that every step reuses: fresh memory costs more than the
        arithmetic."""
        if name not in self.buffers:
            self.buffers[name] = np.empty((STEP_BLOCKS * BLOCK, *shape[1:]) if len(shape) == 2 else (STEP_BLOCKS, *shape[1:]), np.float32)
        return self.buffers[name][: shape[0]]

    def _blocks(self, x: np.ndarray, y: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """One step: masked attention of the last BLOCK positions of each row to the row."""
        own, n, classes = x[:, BLOCK:].ravel(), len(x), self.classes
        q = np.take(self.query, own, axis=0, out=self._buffer("query", n * BLOCK, self.width + 1), mode="clip").reshape(n, BLOCK, -1)
        k = np.take(self.key, x, axis=0, out=self._buffer("key", n, WINDOW, self.width + 1), mode="clip")
        v = np.take(self.value, x, axis=0, out=self._buffer("value", n, WINDOW, self.width + 1), mode="clip")
        a = np.matmul(q, k.transpose(0, 2, 1), out=self._buffer("scores", n, BLOCK, WINDOW))
        np.maximum(a, _LEAST, out=a)
        a += self.bias
        a[leads, :, :BLOCK] = _FAR
        np.exp(a, out=a)
        o = np.matmul(a, v, out=self._buffer("mixed", n, BLOCK, self.width + 1)).reshape(n * BLOCK, -1)
        h = np.take(self.embed, own, axis=0, out=self._buffer("state", n * BLOCK, self.width), mode="clip")
        h += o[:, :-1] / (o[:, -1:] + np.float32(1e-30))
        u = np.matmul(h, self.p["up"], out=self._buffer("up", n * BLOCK, 2 * self.width))
        u += self.p["up_bias"]
        np.maximum(u, 0, out=u)
        h += u @ self.p["down"]
        z = np.matmul(h, self.p["out"], out=self._buffer("logits", n * BLOCK, classes))
        target = y.ravel()
        hit = z[np.arange(len(own)), target]
        if z.max() > _MOST:
            high = z.max(1)
            hit -= high
            z -= high[:, None]
            np.maximum(z, _LEAST, out=z)
        np.exp(z, out=z)
        share = np.take(self.table, own, axis=0, out=self._buffer("table", n * BLOCK, classes), mode="clip")
        total = np.einsum("ij,ij->i", z, share)
        return ((self.log_table[own, target] + hit - np.log(total)) * np.float32(1 / np.log(10))).reshape(y.shape)
