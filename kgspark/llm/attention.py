"""A small causal self-attention model over subword ids, in numpy: forward, gradient, window scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CONTEXT, STRIDE = 16, 32
LENGTH = CONTEXT + STRIDE
WIDTH, HIDDEN = 16, 32
PART, ROWS = 32, 256  # windows, and rows of class weights, that are worked on at once; no result hangs on them but for rounding


@dataclass(frozen=True)
class Vocabulary:
    """How ids enter and leave the model, from corpus counts.

    row: id → embedding row; group: id → class; inside[kind]: id → log
    probability within its class where a word starts (0) or goes on (1);
    bias[kind]: log frequency of classes. Ids 0..n-1 are the tokenizer's, n ends
    a text, and the last embedding row starts one.
    """

    row: np.ndarray
    group: np.ndarray
    inside: np.ndarray
    bias: np.ndarray
    groups: int
    rows: int


def vocabulary(by_kind: np.ndarray, own_rows: int = 3500, shared_rows: int = 500, own_groups: int = 128, shared_groups: int = 32) -> Vocabulary:
    """by_kind[kind, id]: counts. The most frequent ids have embeddings and classes of their own; the rest share them, classes being bands of like frequency."""
    counts = by_kind.sum(axis=0)
    n = len(counts)
    order = np.lexsort((np.arange(n), -counts))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    row = np.where(rank < own_rows, rank, own_rows + (np.arange(n) * 2654435761 % (1 << 32)) % shared_rows)
    mass = np.cumsum(counts[order] + 0.1)
    rest = mass - mass[min(own_groups, n) - 1]
    band = np.clip((rest / max(rest[-1], 1e-9) * shared_groups).astype(np.int64), 0, shared_groups - 1)
    group = np.empty(n, np.int64)
    group[order] = np.where(np.arange(n) < own_groups, np.arange(n), own_groups + band)
    groups = int(group.max()) + 1
    inside, bias = [], []
    for c in by_kind:
        total = np.bincount(group, c + 1e-3, groups)
        inside.append(np.log((c + 1e-3) / total[group]))
        bias.append(np.log(total / total.sum()))
    return Vocabulary(row, group, np.array(inside), np.array(bias, dtype=np.float32), groups, own_rows + shared_rows + 1)


def start(vocab: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters before training: small random numbers, and class frequencies as the output bias."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
    return {
        "embed": (rng.standard_normal((vocab.rows, WIDTH)) * 0.5).astype(np.float32), "place": (rng.standard_normal((LENGTH, WIDTH)) * 0.1).astype(np.float32),
        "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH), "o": normal(WIDTH, WIDTH),
        "w1": normal(WIDTH, HIDDEN), "w2": normal(HIDDEN, WIDTH), "out": normal(WIDTH, vocab.groups), "bias": vocab.bias.copy(), "kind": normal(2, WIDTH),
    }


def start_from_pairs(p: dict[str, np.ndarray], vocab: Vocabulary, pairs: np.ndarray, shrink: float = 20.0) -> dict[str, np.ndarray]:
    """pairs[kind, row, class]: corpus counts of what follows what. Embeddings and output begin as the best factors of its log ratios to chance."""
    n_row = pairs.sum(axis=2)
    chance = np.einsum("kr,kg->rg", n_row, np.exp(vocab.bias.astype(float))) + 1e-9
    seen, whole = pairs.sum(axis=0), n_row.sum(axis=0)[:, None]
    ratio = np.log((seen + shrink * chance / (whole + 1e-9)) / (chance * (1 + shrink / (whole + 1e-9))) + 1e-9)
    ratio[whole[:, 0] == 0] = 0
    left, right = np.sqrt(whole + 1.0), np.sqrt(seen.sum(axis=0) + 1.0)[None, :]
    u, d, v = np.linalg.svd(left * ratio * right, full_matrices=False)
    k = min(WIDTH, len(d))
    embed, out = np.zeros_like(p["embed"], dtype=float), np.zeros_like(p["out"], dtype=float)
    embed[:, :k], out[:k] = u[:, :k] * d[:k] / left, v[:k] / right
    scale = np.sqrt((embed**2 * whole).sum(axis=0) / whole.sum() + 1e-12) if whole.sum() else np.ones(WIDTH)
    scale = np.where(scale > 1e-5, scale, 1.0)
    return p | {"embed": (embed / scale).astype(np.float32), "out": (out * scale[:, None]).astype(np.float32), "place": p["place"] * np.float32(0), "kind": p["kind"] * np.float32(0)}


CAUSAL = np.tril(np.ones((LENGTH, LENGTH), np.float32))


def weigh(x: np.ndarray) -> np.ndarray:
    """exp(x) made of straight lines between powers of two, in place of a slower one: positive and increasing, which is all that a weight needs. x is used up."""
    if x.size and (x.max() > 60 or x.min() < -60):
        np.clip(x, -60, 60, out=x)
    x *= np.float32((1 << 23) / np.log(2))
    x += np.float32(127 * (1 << 23))
    return x.astype(np.int32).view(np.float32)


def windows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first scored position, text) of windows of STRIDE that cover each range [start, end) once."""
    n = -(-(ends - starts) // STRIDE)
    of = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return starts[of] + k * STRIDE, of


def batch(rows: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, embedding rows, which are real) of windows of LENGTH, the last STRIDE of which are scored."""
    at = first[:, None] - CONTEXT + np.arange(LENGTH)[None, :]
    real = (at >= begin[:, None]) & (at < end[:, None])
    at = np.where(real, at, 0)
    return at, rows[at], real


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def forward(p: dict[str, np.ndarray], rows: np.ndarray, kind: np.ndarray, real: np.ndarray, scored: slice) -> dict[str, np.ndarray]:
    """All that the gradient needs, up to "z", from which classes are drawn at the scored positions."""
    b, t = rows.shape
    x = p["embed"].take(rows, axis=0)
    x += p["kind"].take(kind, axis=0)
    x += p["place"]
    k, v = (_flat(x) @ p["k"]).reshape(b, t, WIDTH), (_flat(x) @ p["v"]).reshape(b, t, WIDTH)
    own = x[:, scored]
    q = (_flat(own) @ (p["q"] * np.float32(1 / np.sqrt(WIDTH)))).reshape(own.shape)
    a = weigh(q @ np.ascontiguousarray(k.transpose(0, 2, 1)))
    a *= CAUSAL[scored]
    if not real.all():
        a *= real[:, None, :]
    total = a @ np.ones((LENGTH, 1), np.float32)
    np.maximum(total, np.float32(1e-30), out=total)
    u = (a @ v) / total
    y = _flat(u) @ p["o"]
    y += _flat(own)
    h = y @ p["w1"]
    np.maximum(h, 0, out=h)
    z = h @ p["w2"]
    z += y
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "total": total, "u": u, "y": y, "h": h, "z": z}


def _weights(p: dict[str, np.ndarray], z: np.ndarray, kind: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, their z and kind in one, unnormalized class weights) of so few rows at a time that they stay in a processor's cache."""
    both = np.concatenate([p["out"], p["bias"]])
    zs = np.empty((len(z), WIDTH + 2), z.dtype)
    zs[:, :WIDTH], zs[:, WIDTH], zs[:, WIDTH + 1] = z, kind == 0, kind != 0
    for i in range(0, len(z), ROWS):
        yield slice(i, i + ROWS), zs[i : i + ROWS], weigh(zs[i : i + ROWS] @ both)


def _of_part(p: dict[str, np.ndarray], rows: np.ndarray, kind: np.ndarray, real: np.ndarray, group: np.ndarray, share: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss times share, summed, its gradient but for embeddings, and that of each input row."""
    f = forward(p, rows, kind, real, slice(None))
    b, t = rows.shape
    kind = kind.reshape(-1)
    z, loss, back = f["z"], 0.0, np.ascontiguousarray(p["out"].T)
    both, dz, ones = np.zeros((WIDTH + 2, back.shape[0]), z.dtype), np.empty_like(z), np.ones(back.shape[0], z.dtype)
    for part, zs, w in _weights(p, z, kind):
        at, s, total = (np.arange(len(w)), group[part]), share[part], w @ ones
        loss -= float(np.log(w[at] / total + 1e-30) @ s)
        w *= (s / total)[:, None]
        w[at] -= s
        both += zs.T @ w
        np.matmul(w, back, out=dz[part])
    g = {"out": both[:WIDTH], "bias": both[WIDTH:]}
    g["w2"] = f["h"].T @ dz
    dh = dz @ p["w2"].T
    dh *= f["h"] > 0
    g["w1"] = f["y"].T @ dh
    dy = dh @ p["w1"].T
    dy += dz
    u, a = f["u"], f["a"]
    g["o"] = _flat(u).T @ dy
    du = (dy @ p["o"].T).reshape(b, t, WIDTH)
    du /= f["total"]
    ds = du @ np.ascontiguousarray(f["v"].transpose(0, 2, 1))
    ds -= np.einsum("bti,bti->bt", du, u)[:, :, None]
    ds *= a
    dv, dk, dq = _flat(a.transpose(0, 2, 1) @ du), _flat(ds.transpose(0, 2, 1) @ f["q"]), _flat(ds @ f["k"])
    dq *= np.float32(1 / np.sqrt(WIDTH))
    x = _flat(f["x"])
    g["q"], g["k"], g["v"] = x.T @ dq, x.T @ dk, x.T @ dv
    dx = dy
    dx += dq @ p["q"].T
    dx += dk @ p["k"].T
    dx += dv @ p["v"].T
    dx *= real.reshape(-1, 1)
    g["place"] = dx.reshape(b, t, WIDTH).sum(axis=0)
    g["kind"] = np.array([kind == 0, kind != 0]).astype(dx.dtype) @ dx
    return loss, g, dx


def gradient(p: dict[str, np.ndarray], rows: np.ndarray, kind: np.ndarray, real: np.ndarray, group: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over counted positions of whole windows, and its gradient, summed over a few windows at a time."""
    share = counted.astype(p["out"].dtype)
    share /= max(1, int(counted.sum()))
    loss, g, dxs = 0.0, {}, []
    for i in range(0, len(rows), PART):
        part = slice(i, i + PART)
        l, some, dx = _of_part(p, rows[part], kind[part], real[part], group[part].reshape(-1), share[part].reshape(-1))
        loss += l
        for n, v in some.items():
            g[n] = g[n] + v if n in g else v
        dxs.append(dx)
    g["embed"] = np.zeros_like(p["embed"])
    flat = rows.reshape(-1).astype(np.uint16 if len(p["embed"]) <= 1 << 16 else np.int64)  # the former sorts faster
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.diff(ordered.astype(np.int64), prepend=-1))
    g["embed"][ordered[first]] = np.add.reduceat(np.concatenate(dxs).take(order, axis=0), first)
    return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.s[k] += 0.01 * (g[k] * g[k] - self.s[k])
            p[k] -= (rate * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(np.float32)


def train(p: dict[str, np.ndarray], vocab: Vocabulary, ids: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, rate: float, size: int = 256, seed: int = 3) -> int:
    """One pass over the texts ids[start:end], each ending in its end id; p changes in place. Returns the ids used."""
    rows, group = inputs(vocab, ids, starts), vocab.group[ids]
    first, of = windows(starts, ends)
    order = np.random.default_rng(seed).permutation(len(first))
    adam = Adam(p, rate)
    for i in range(0, len(order), size):
        part = order[i : i + size]
        at, r, real = batch(rows, first[part], starts[of[part]], ends[of[part]])
        _, g = gradient(p, r, kinds[at], real, group[at], real)
        adam.step(p, g)
    return int((ends - starts).sum())


def inputs(vocab: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Embedding row that stands before each id: the one before it, or that of a text's start."""
    rows = np.full(len(ids), vocab.rows - 1, np.int64)
    rows[1:] = vocab.row[ids[:-1]]
    rows[starts[starts < len(ids)]] = vocab.rows - 1
    return rows


def log_probabilities(p: dict[str, np.ndarray], vocab: Vocabulary, ids: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = PART) -> np.ndarray:
    """Natural log probability of each id. Windows overlap by CONTEXT ids, and each id is scored in one of them."""
    rows, group = inputs(vocab, ids, starts), vocab.group[ids]
    first, of = windows(starts, ends)
    out = np.zeros(len(ids))
    scored = slice(CONTEXT, LENGTH)
    for i in range(0, len(first), size):
        begin, end = starts[of[i : i + size]], ends[of[i : i + size]]
        at, r, real = batch(rows, first[i : i + size], begin, end)
        kind = kinds[at]
        z = forward(p, r, kind, real, scored)["z"]
        at, kind, keep = at[:, scored].reshape(-1), kind[:, scored].reshape(-1), real[:, scored].reshape(-1)
        score, own = vocab.inside[kind, ids[at]], group[at]
        for part, _, w in _weights(p, z, kind):
            score[part] += np.log(w[np.arange(len(w)), own[part]] / (w @ np.ones(w.shape[1], w.dtype)))
        out[at[keep]] = score[keep]
    return out
