"""A gated recurrent network over a small set of symbols, in numpy.

The output is factored: a softmax over groups of symbols, then one over the members
of the group. Gradients are cut after ``STEPS`` symbols; states are carried on.
"""

from __future__ import annotations

import numpy as np

STEPS = 16
LANES = 512
#: Symbols over which training carries the state; scoring carries it over whole documents.
PIECE = 1024
#: Bound of the logits of a softmax, so that no exponential overflows.
LOGIT = 60.0

Weights = dict[str, np.ndarray]


def initial(counts: np.ndarray, hidden: int, members: int, seed: int = 11) -> Weights:
    """Weights whose output, at first, is the share of each symbol in ``counts``."""
    rng = np.random.default_rng(seed)
    groups = -(-len(counts) // members)
    padded = np.full(groups * members, 1e-9)
    padded[: len(counts)] = counts + 0.5
    share = (padded / padded.sum()).reshape(groups, members)
    w = {
        "x": rng.normal(0, 0.3, (len(counts), 3 * hidden)), "u": rng.normal(0, 0.6 / np.sqrt(hidden), (hidden, 3 * hidden)), "b": np.zeros(3 * hidden),
        "g": np.zeros((hidden, groups)), "gb": np.log(share.sum(1)), "m": np.zeros((groups, hidden, members)), "mb": np.log(share / share.sum(1, keepdims=True)),
    }
    w["b"][:hidden] = 1.0  # to begin with, states last
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def step(w: Weights, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and what the gradient needs; ``x`` is the row of each input symbol in w['x'], plus the bias."""
    n = h.shape[1]
    hu = h @ w["u"]
    gate = x[:, : 2 * n] + hu[:, : 2 * n]
    np.maximum(gate, -30, out=gate)
    gate = _sigmoid(gate)
    z, r = gate[:, :n], gate[:, n:]
    new = r * hu[:, 2 * n :]
    new += x[:, 2 * n :]
    np.tanh(new, out=new)
    return new + z * (h - new), z, r, new, hu[:, 2 * n :]


def _logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    a = h @ weights
    a += bias
    np.clip(a, -LOGIT, LOGIT, out=a)
    return a


def _row_sums(a: np.ndarray) -> np.ndarray:
    return a @ np.ones(a.shape[1], a.dtype)


def log_output(w: Weights, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Natural log probability of each symbol in the state of its row."""
    members = w["mb"].shape[1]
    group, member = np.divmod(symbol.astype(np.int16), np.int16(members))
    a = _logits(h, w["g"], w["gb"])
    out = a[np.arange(len(a)), group]
    total = _row_sums(np.exp(a, out=a))
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(len(w["gb"]) + 1))
    h, member, inner, part = h[order], member[order], np.empty_like(out), np.empty_like(out)
    for g in np.flatnonzero(np.diff(cut)):
        own = slice(cut[g], cut[g + 1])
        b = _logits(h[own], w["m"][g], w["mb"][g])
        inner[own] = b[np.arange(len(b)), member[own]]
        part[own] = _row_sums(np.exp(b, out=b))
    out[order] += inner - np.log(part * total[order])
    return out


def gradients(w: Weights, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Of one window: the mean gradient of the loss, the states it ends with, and the loss
    summed. The arrays are (steps, lanes); a target below 0 is none, and where ``begins`` is
    set the state starts anew."""
    n = h.shape[1]
    members = w["mb"].shape[1]
    table = w["x"] + w["b"]
    before, z, r, new, hun, states = (np.empty((*inputs.shape, n), h.dtype) for _ in range(6))
    for t in range(len(inputs)):
        if begins[t].any():
            h = np.where(begins[t][:, None], h.dtype.type(0), h)
        before[t] = h
        states[t], z[t], r[t], new[t], hun[t] = step(w, h, table[inputs[t]])
        h = states[t]
    flat = states.reshape(-1, n)
    want = targets.ravel()
    real = want >= 0
    group, member = np.divmod(np.maximum(want, 0), members)
    rows = np.arange(len(flat))
    a = _logits(flat, w["g"], w["gb"])
    np.exp(a, out=a)
    a /= _row_sums(a)[:, None]
    loss = -np.log(a[rows, group][real] + 1e-30).sum()
    a[rows, group] -= 1
    a[~real] = 0
    count = max(1, int(real.sum()))
    d = {k: np.zeros_like(v) for k, v in w.items()}
    d["g"], d["gb"] = flat.T @ a, a.sum(0)
    back = a @ w["g"].T
    order = np.argsort(np.where(real, group, len(w["gb"])).astype(np.int16), kind="stable")[: int(real.sum())]
    cut = np.searchsorted(group[order], np.arange(len(w["gb"]) + 1))
    held, member, inner = flat[order], member[order], np.empty((len(order), n), flat.dtype)
    for g in np.flatnonzero(np.diff(cut)):
        at = slice(cut[g], cut[g + 1])
        own = held[at]
        b = _logits(own, w["m"][g], w["mb"][g])
        np.exp(b, out=b)
        b /= _row_sums(b)[:, None]
        each = np.arange(len(b)), member[at]
        loss -= np.log(b[each] + 1e-30).sum()
        b[each] -= 1
        d["m"][g], d["mb"][g] = own.T @ b, b.sum(0)
        inner[at] = b @ w["m"][g].T
    back[order] += inner
    back = back.reshape(before.shape)
    dh = np.zeros_like(h)
    # what a step's gradients are multiplied by is known for all steps at once
    by_z, by_n, by_r = (before - new) * z * (1 - z), (1 - z) * (1 - new**2), hun * r * (1 - r)
    dx, du = (np.empty((*inputs.shape, 3 * n), h.dtype) for _ in range(2))
    back_u = np.ascontiguousarray(w["u"].T)
    for t in reversed(range(len(inputs))):
        dh += back[t]
        np.multiply(dh, by_z[t], out=dx[t, :, :n])
        np.multiply(dh, by_n[t], out=dx[t, :, 2 * n :])
        np.multiply(dx[t, :, 2 * n :], by_r[t], out=dx[t, :, n : 2 * n])
        du[t, :, : 2 * n] = dx[t, :, : 2 * n]
        np.multiply(dx[t, :, 2 * n :], r[t], out=du[t, :, 2 * n :])
        dh *= z[t]
        dh += du[t] @ back_u
        if begins[t].any():
            dh[begins[t]] = 0
    dx = dx.reshape(-1, 3 * n)
    order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
    at = np.searchsorted(inputs.ravel()[order], np.arange(len(w["x"]) + 1))
    symbol = np.flatnonzero(np.diff(at))
    d["x"][symbol] = np.add.reduceat(dx[order], at[symbol])
    d["b"] = dx.sum(0)
    d["u"] = before.reshape(-1, n).T @ du.reshape(-1, 3 * n)
    return {k: v / count for k, v in d.items()}, h, float(loss)


def train(w: Weights, documents: list[np.ndarray], start: int, rate: float = 0.01, steps: int = STEPS, lanes: int = LANES) -> tuple[Weights, int]:
    """One pass of truncated backpropagation (Adam) over documents of symbols, dealt to lanes
    that run one after another; ``start`` is the input before a document's first symbol. Documents are
    dealt in pieces of ``PIECE`` symbols, so that a long one does not leave the other lanes idle; the state
    starts anew with each. Returns the weights and the number of symbols."""
    pieces = [(d[k - 1] if k else start, d[k : k + PIECE]) for d in documents for k in range(0, len(d), PIECE)]
    total = sum(map(len, documents))
    if not total:
        return w, 0
    lanes = max(1, min(lanes, total // (64 * steps)))  # so that there are some 64 steps of Adam at least
    load, own = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for before, d in pieces:
        k = int(load.argmin())
        own[k].append((before, d))
        load[k] += len(d)
    length = -(-int(load.max()) // steps) * steps
    inputs, targets, begins = np.full((length, lanes), start), np.full((length, lanes), -1), np.zeros((length, lanes), bool)
    for k, lane in enumerate(own):
        at = 0
        for before, d in lane:
            inputs[at, k] = before
            targets[at : at + len(d), k] = d
            inputs[at + 1 : at + len(d), k] = d[:-1]
            begins[at, k] = True
            at += len(d)
    w = {k: v.copy() for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    h = np.zeros((lanes, len(w["u"])), np.float32)
    for t, at in enumerate(range(0, length, steps), 1):
        part = slice(at, at + steps)
        d, h, _ = gradients(w, h, inputs[part], targets[part], begins[part])
        norm = np.sqrt(sum(float((v**2).sum()) for v in d.values()))
        for k, v in d.items():
            v = v * np.float32(min(1.0, 1.0 / (norm + 1e-12)))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v**2
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return w, total


def log_likelihoods(w: Weights, documents: list[np.ndarray], start: int, window: int = STEPS) -> np.ndarray:
    """The natural log probability of each document, whole: the longest first, so that at any
    step those still running stand at the front, and with their states carried from
    window to window."""
    out = np.zeros(len(documents))
    if not documents:
        return out
    size = np.array([len(d) for d in documents])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([documents[k] for k in order]).astype(np.int64)
    at = np.cumsum(size) - size
    table = w["x"] + w["b"]
    h = np.zeros((len(size), len(w["u"])), np.float32)
    total = np.zeros(len(size))
    for begin in range(0, int(size[0]) if len(size) else 0, window):
        states, symbols, owners = [], [], []
        for t in range(begin, min(begin + window, int(size[0]))):
            running = int(np.searchsorted(-size, -t, "left"))  # sizes over t
            place = at[:running] + t
            before = flat[place - 1] if t else np.full(running, start)
            h = step(w, h[:running], table[before])[0]
            states.append(h)
            symbols.append(flat[place])
            owners.append(running)
        each = log_output(w, np.concatenate(states), np.concatenate(symbols))
        cut = np.cumsum(owners)[:-1]
        for part in np.split(each, cut):
            total[: len(part)] += part
    out[order] = total
    return out
