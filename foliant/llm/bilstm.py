"""A character tagger: bidirectional LSTM with CRF transitions, in numpy.

Arrays are time-major. Trained by Adam on minibatches, with the gradient of the CRF's
log-likelihood passed back through time. ``decode`` gives the best tag sequence of each window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

HIDDEN = 20
EMBED = 12


def init(symbols: int, tags: int, rng: np.random.Generator, hidden: int = HIDDEN, embed: int = EMBED) -> dict[str, np.ndarray]:
    def uniform(*shape: int) -> np.ndarray:
        return rng.uniform(-1, 1, shape) * np.sqrt(3.0 / shape[0])

    p = {"embed": rng.normal(0, 0.3, (symbols, embed)), "out": uniform(2 * hidden, tags), "out_bias": np.zeros(tags),
         "step": rng.normal(0, 0.05, (tags, tags)), "start": np.zeros(tags)}
    for way in ("f", "b"):
        bias = np.zeros(4 * hidden)
        bias[hidden:2 * hidden] = 1.0  # remember at first
        p |= {f"in_{way}": uniform(embed, 4 * hidden), f"rec_{way}": uniform(hidden, 4 * hidden), f"bias_{way}": bias}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(table: np.ndarray, rec: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T, B, H) for symbols (T, B); ``table`` holds the input of each symbol to the gates."""
    n, hidden = rec.shape[0], rec.shape[0]
    half = np.ones(4 * n, table.dtype)
    half[:3 * n] = 0.5  # sigmoid(z) = (tanh(z / 2) + 1) / 2, so that one tanh does for all gates
    table, rec = table * half, rec * half
    h = np.zeros((x.shape[1], hidden), table.dtype)
    c = np.zeros_like(h)
    out, trace = np.empty((*x.shape, hidden), table.dtype), []
    for t in range(len(x)):
        z = np.take(table, x[t], axis=0)
        z += h @ rec
        np.tanh(z, out=z)
        z[:, :3 * n] += 1
        z[:, :3 * n] *= 0.5
        before = c
        c = z[:, n:2 * n] * c + z[:, :n] * z[:, 3 * n:]
        squashed = np.tanh(c)
        if keep:
            trace.append((z, before, squashed, h))
        h = z[:, 2 * n:3 * n] * squashed
        out[t] = h
    return out, trace


def _lstm_back(rec: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs (T, B, 4H) and of the recurrent weights, for that of the states."""
    n = rec.shape[0]
    dz = np.empty((*grad.shape[:2], 4 * n), grad.dtype)
    d_rec = np.zeros_like(rec)
    dh = np.zeros_like(grad[0])
    dc = np.zeros_like(grad[0])
    for t in range(len(grad) - 1, -1, -1):
        z, before, squashed, h_before = trace[t]
        i, f, o, g = (z[:, k * n:(k + 1) * n] for k in range(4))
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed * squashed)
        d = dz[t]
        d[:, :n] = dc * g * i * (1 - i)
        d[:, n:2 * n] = dc * before * f * (1 - f)
        d[:, 2 * n:3 * n] = dh * squashed * o * (1 - o)
        d[:, 3 * n:] = dc * i * (1 - g * g)
        d_rec += h_before.T @ d
        dh = d @ rec.T
        dc = dc * f
    return dz, d_rec


def emissions(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Tag scores (T, B, K) of symbols (T, B)."""
    tables = {way: p["embed"] @ p[f"in_{way}"] + p[f"bias_{way}"] for way in "fb"}
    forward, trace_f = _lstm(tables["f"], p["rec_f"], x, keep)
    backward, trace_b = _lstm(tables["b"], p["rec_b"], x[::-1], keep)
    states = np.concatenate([forward, backward[::-1]], axis=2)
    return states @ p["out"] + p["out_bias"], {"f": trace_f, "b": trace_b, "states": states}


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf(p: dict[str, np.ndarray], e: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean negative log-likelihood of tags y (T, B), gradients of start and step, and of the emissions."""
    steps, batch, tags = e.shape
    step = p["step"]
    alpha = np.empty_like(e)
    alpha[0] = e[0] + p["start"]
    for t in range(1, steps):
        alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + step, 1)
    total = _log_sum(alpha[-1], 1)
    beta = np.zeros((batch, tags), e.dtype)
    grad_e, d_step = np.empty_like(e), np.zeros_like(step)
    grad_e[-1] = np.exp(alpha[-1] - total[:, None])
    for t in range(steps - 1, 0, -1):
        ahead = e[t] + beta
        d_step += np.exp(alpha[t - 1][:, :, None] + step + ahead[:, None, :] - total[:, None, None]).sum(0)
        beta = _log_sum(step + ahead[:, None, :], 2)
        grad_e[t - 1] = np.exp(alpha[t - 1] + beta - total[:, None])
    rows = np.arange(batch)
    gold = p["start"][y[0]] + e[np.arange(steps)[:, None], rows, y].sum(0) + step[y[:-1], y[1:]].sum(0)
    grad_e[np.arange(steps)[:, None], rows, y] -= 1
    np.subtract.at(d_step, (y[:-1].ravel(), y[1:].ravel()), 1)
    return float((total - gold).mean()), {"start": grad_e[0].sum(0) / batch, "step": d_step / batch}, grad_e / batch


def loss_and_gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    e, trace = emissions(p, x, keep=True)
    loss, grad, d_e = crf(p, e, y)
    states = trace["states"]
    grad["out"] = np.tensordot(states, d_e, ([0, 1], [0, 1]))
    grad["out_bias"] = d_e.sum((0, 1))
    d_states = d_e @ p["out"].T
    n = p["rec_f"].shape[0]
    grad["embed"] = np.zeros_like(p["embed"])
    for way, symbols, d in (("f", x, d_states[:, :, :n]), ("b", x[::-1], d_states[::-1, :, n:])):
        dz, grad[f"rec_{way}"] = _lstm_back(p[f"rec_{way}"], trace[way], np.ascontiguousarray(d))
        per_symbol = np.zeros((len(p["embed"]), dz.shape[2]), dz.dtype)
        np.add.at(per_symbol, symbols.ravel(), dz.reshape(-1, dz.shape[2]))
        grad[f"bias_{way}"] = per_symbol.sum(0)
        grad[f"in_{way}"] = p["embed"].T @ per_symbol
        grad["embed"] += per_symbol @ p[f"in_{way}"].T
    return loss, grad


@dataclass
class Adam:
    """Adam steps with clipped gradients and a rate that falls to a tenth."""

    rate: float = 0.01
    total: int = 1
    done: int = 0
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)

    def apply(self, p: dict[str, np.ndarray], grad: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.done += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        rate = self.rate * (1 - 0.9 * self.done / self.total)
        for k, g in grad.items():
            g = g * scale
            m = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            v = self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g * g
            p[k] -= (rate * (m / (1 - 0.9 ** self.done)) / (np.sqrt(v / (1 - 0.999 ** self.done)) + 1e-8)).astype(p[k].dtype)


def train(x: np.ndarray, y: np.ndarray, symbols: int, tags: int, epochs: int, batch: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters learned from windows x and tags y, both (N, T)."""
    rng = np.random.default_rng(seed)
    p = init(symbols, tags, rng)
    steps = max(1, len(x) // batch)
    adam = Adam(total=epochs * steps)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(steps):
            part = order[k * batch:(k + 1) * batch]
            _, grad = loss_and_gradient(p, x[part].T, y[part].T)
            adam.apply(p, grad)
    return p


def tag_scores(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """As ``emissions``, but (T, K, B): with the windows in the last place every step works on whole rows."""
    n = p["rec_f"].shape[0]
    half = np.ones((4 * n, 1), np.float32)
    half[:3 * n] = 0.5
    e = np.empty((len(x), p["out"].shape[1], x.shape[1]), np.float32)
    e[:] = p["out_bias"][:, None]
    for way, order, own in (("f", range(len(x)), p["out"][:n]), ("b", range(len(x) - 1, -1, -1), p["out"][n:])):
        table = np.ascontiguousarray((p["embed"] @ p[f"in_{way}"] + p[f"bias_{way}"]).T * half)
        rec, own = np.ascontiguousarray(p[f"rec_{way}"].T * half), np.ascontiguousarray(own.T)
        h = np.zeros((n, x.shape[1]), np.float32)
        c = np.zeros_like(h)
        for t in order:
            z = np.take(table, x[t], axis=1)
            z += rec @ h
            np.tanh(z, out=z)
            gates = z[:3 * n]
            gates += 1
            gates *= 0.5
            c *= z[n:2 * n]
            c += z[:n] * z[3 * n:]
            h = np.tanh(c)
            h *= z[2 * n:3 * n]
            e[t] += own @ h
    return e


def decode(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (T, B) of symbols (T, B), and by how much each tag's score exceeds that of tag 0."""
    e = tag_scores(p, x)
    steps, _, batch = e.shape
    scores = e.copy()
    into = np.ascontiguousarray(p["step"].T)[:, :, None]  # (next, last, 1)
    scores[0] += p["start"][:, None]
    for t in range(1, steps):
        scores[t] += (into + scores[t - 1][None]).max(1)
    out = np.empty((steps, batch), np.uint8)
    out[-1] = scores[-1].argmax(0)
    for t in range(steps - 1, 0, -1):  # the way back follows from the scores
        out[t - 1] = (scores[t - 1] + p["step"][:, out[t]]).argmax(0)
    lead = np.take_along_axis(e, out[:, None].astype(np.intp), 1)[:, 0] - e[:, 0]
    return out, lead
