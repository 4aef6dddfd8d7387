"""A gated recurrent word model in numpy: truncated backpropagation, class-factored softmax.

Words are numbered by falling frequency; word i belongs to class i // SIDE. The probability of the
next word is that of its class times that of the word within the class, both from the state, so a
step costs two short softmaxes instead of one over the vocabulary.

Many documents run side by side in lanes. Lanes are processed in windows of STEPS words, and the
state at a window's end is the next window's start, so a document's log-likelihood is that of the
whole document; only gradients stop at window edges.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Hidden units, words a class, words in the vocabulary (numbers fit 16 bits), steps of a window, documents side by side.
HIDDEN, SIDE, VOCAB, STEPS, LANES = 16, 64, 4096, 32, 512
UNK, END = 0, 1
RATE, CLIP, TRAIN_LANES = 0.1, 1.0, 192
#: In training, longer documents are cut into pieces of so many words, so that lanes end together.
PIECE = 512
#: Logits within this bound can go to exp() without taking off their maximum.
SAFE = 60
#: Rows of logits worked on at a time, and zero rows that may be added for every class joined to a block.
ROWS, SPARE = 1024, 40
_F = np.float32


def shapes(vocab: int = VOCAB, hidden: int = HIDDEN, side: int = SIDE) -> dict[str, tuple[int, ...]]:
    return {"x": (vocab, 3 * hidden), "u": (hidden, 3 * hidden), "cw": (hidden, vocab // side), "cb": (vocab // side,), "ww": (vocab // side, hidden, side), "wb": (vocab // side, side)}


def start(counts: np.ndarray, seed: int = 7, hidden: int = HIDDEN, side: int = SIDE) -> dict[str, np.ndarray]:
    """Small random weights, and output biases that make the untrained model the unigram model of the counts."""
    rng, own = np.random.default_rng(seed), shapes(len(counts), hidden, side)
    p = {k: (rng.standard_normal(s) * (0.3 if k in "xu" else 0.1)).astype(_F) for k, s in own.items()}
    c = counts.reshape(-1, side).astype(np.float64)
    with np.errstate(divide="ignore"):
        of_class = np.maximum(np.log(c.sum(axis=1)), -1e4)
        p["cb"] = (of_class - np.log(max(c.sum(), 1))).astype(_F)
        p["wb"] = (np.maximum(np.log(c), -1e4) - of_class[:, None]).astype(_F)  # numbers without a word are never predicted
    return p


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unpack(flat: np.ndarray, vocab: int = VOCAB, hidden: int = HIDDEN, side: int = SIDE) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(vocab, hidden, side).items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s).astype(_F), at + n
    return out


class Lanes:
    """Documents laid one after another in about equally long lanes, the longest lane first.

    Everything is kept lane after lane in flat arrays, a few bytes a word whatever the lengths are;
    a window's (time, lane) arrays are cut out of them.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int):
        lanes = min(lanes, len(docs))
        size, rows = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        heap = [(0, i) for i in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, i = heap[0]
            rows[i].append(d)
            size[i] = n + len(docs[d])
            heapq.heapreplace(heap, (int(size[i]), i))
        rank = np.argsort(-size, kind="stable")
        order = [d for i in rank for d in rows[i]]
        lengths = np.array([len(docs[d]) for d in order], np.int64)
        self.size = size[rank]
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate([docs[d] for d in order]).astype(np.int32, copy=False)
        self.doc = np.repeat(np.array(order, np.int32), lengths)
        self.first = np.zeros(len(self.words), bool)
        self.first[np.cumsum(lengths) - lengths] = True

    def windows(self, steps: int):
        """(before, words, first, doc, real) of every window over the lanes that reach into it.

        before: the word read at a place, END at a document's beginning; real: whether the lane
        has the place (elsewhere the other arrays hold any words).
        """
        for at in range(0, int(self.size[0]), steps):
            live = int(np.searchsorted(-self.size, -at))
            t = np.arange(at, min(at + steps, int(self.size[0])))[:, None]
            real = t < self.size[:live]
            place = np.where(real, self.start[:live] + t, self.start[:live])
            first = self.first[place]
            yield np.where(first, np.int32(END), self.words[place - 1]), self.words[place], first, self.doc[place], real


class _Room:
    """Arrays by name that every window uses anew, so that none is asked of the system window by window."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, _F)
        return self.held[name][:n].reshape(shape)


def _forward(p: dict, before: np.ndarray, first: np.ndarray, h: np.ndarray, room: _Room, keep: bool = False):
    """(states, their beginnings, z and r, n, what the states gave) of every step, (time, numbers, lane) each; if not `keep`, all but the states of the last step only.

    States are those after reading `before`; a document's first one starts from zero. Lanes lie
    along the last axis, so each gate's numbers are one stretch of memory.
    """
    (hidden, live), steps, ut = h.shape, len(before), np.ascontiguousarray(p["u"].T)
    kept = steps if keep else 1
    read, x, out, starts = room("read", live, 3 * hidden), room("x", 3 * hidden, live), room("states", steps, hidden, live), room("starts", kept, hidden, live)
    zr, ns, gs = room("zr", kept, 2 * hidden, live), room("n", kept, hidden, live), room("g", kept, 3 * hidden, live)
    goes_on = (~first).astype(_F)
    with np.errstate(over="ignore"):  # the gate is 0 there
        for t in range(steps):
            i = t % kept
            h0, s, n, g, new = starts[i], zr[i], ns[i], gs[i], out[t]
            x[:] = np.take(p["x"], before[t], axis=0, out=read, mode="clip").T
            np.multiply(h, goes_on[t], out=h0)
            np.matmul(ut, h0, out=g)
            np.add(x[: 2 * hidden], g[: 2 * hidden], out=s)
            np.negative(s, out=s)
            np.exp(s, out=s)
            s += _F(1)
            np.reciprocal(s, out=s)
            np.multiply(s[hidden:], g[2 * hidden :], out=n)
            n += x[2 * hidden :]
            np.tanh(n, out=n)
            np.subtract(h0, n, out=new)
            new *= s[:hidden]
            new += n
            h = new
    return out, starts, zr, ns, gs


def _rows(x: np.ndarray) -> np.ndarray:
    """(time, numbers, lane) as one row of numbers per time and lane."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


def _safe(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sum of exp(logits) stays a float for every state; states lie within -1 and 1."""
    reach = np.abs(w).sum(axis=-2)
    return bool((b + reach).max() < SAFE and ((b - reach).max(axis=-1) > -SAFE).all())


def _exp(o: np.ndarray, safe: bool) -> np.ndarray:
    """The rows' sums of exp(logits); the logits, less their row's largest one if they aren't safe, are overwritten by exp of them."""
    if not safe:
        o -= o.max(axis=1, keepdims=True)
    np.exp(o, out=o)
    return o @ np.ones(o.shape[1], _F)


def _with_ones(states: np.ndarray, rows: np.ndarray, room: _Room) -> np.ndarray:
    """The states of these rows (time, lane), each with a 1 that the biases are multiplied by."""
    out = room("hs", len(rows), states.shape[1] + 1)
    out[:, :-1] = _rows(states)[rows]
    out[:, -1] = 1
    return out


def _joined(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of words within them, with their biases as a last row."""
    return np.concatenate([p["cw"], p["cb"][None]]), np.concatenate([p["ww"], p["wb"][:, None]], axis=1)


def _blocks(cls: np.ndarray, kinds: int):
    """(class, class after the last, rows of a class, start, end, places) of blocks that cover the sorted numbers of classes.

    A block is a piece of one class, or some classes with few rows, which are multiplied together as
    if each had as many rows as the largest; places are where the block's rows lie then.
    """
    counts = np.bincount(cls, minlength=kinds)
    starts, counts = np.cumsum(counts) - counts, counts.tolist()
    k, s = 0, 0
    while k < kinds:
        m, most, e = k + 1, counts[k], s + counts[k]
        while m < kinds:
            n = max(most, counts[m])
            rows = (m + 1 - k) * n
            if rows > ROWS or rows - (e + counts[m] - s) > SPARE * (m - k):
                break
            m, most, e = m + 1, n, e + counts[m]
        if m == k + 1:
            for at in range(s, e, ROWS):
                yield k, m, min(ROWS, e - at), at, min(at + ROWS, e), np.arange(min(ROWS, e - at))
        elif s < e:
            own = cls[s:e]
            yield k, m, most, s, e, (own - k) * most + np.arange(s, e) - starts[own]
        k, s = m, e


def _block(hs: np.ndarray, classes: int, most: int, places: np.ndarray, room: _Room) -> np.ndarray:
    """A block's rows as (class, row, numbers); rows that no place leads to are zero."""
    if classes == 1:
        return hs[None]
    out = room("block", classes, most, hs.shape[1])
    out.fill(0)
    out.reshape(-1, hs.shape[1])[places] = hs
    return out


def log_likelihoods(p: dict, docs: list[np.ndarray], lanes: int = LANES, steps: int = STEPS) -> np.ndarray:
    """Natural log-likelihood of each document (an array of word numbers that ends with END)."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    laid, room = Lanes(docs, lanes), _Room()
    kinds, side = p["wb"].shape
    h, numbers = np.zeros((p["u"].shape[0], len(laid.size)), _F), np.arange(ROWS)
    safe_c, safe_w = _safe(p["cw"], p["cb"]), _safe(p["ww"], p["wb"])
    of_class, within = _joined(p)

    def add(out: np.ndarray, x: np.ndarray, w: np.ndarray, places: np.ndarray, own: np.ndarray, safe: bool) -> None:
        """Adds to `out` the log-probability of the own number of each row that a place leads to."""
        o = np.matmul(x, w, out=room("o", *x.shape[:2], w.shape[-1])).reshape(-1, w.shape[-1])
        if not safe:
            o -= o.max(axis=1, keepdims=True)
        picked = o[places, own]
        out += picked - np.log(_exp(o, True)[places])

    for before, words, first, doc, there in laid.windows(steps):
        states = _forward(p, before, first, h[:, : words.shape[1]], room)[0]
        h = states[-1].copy()
        real = np.flatnonzero(there.ravel())
        real = real[np.argsort((words.ravel()[real] // side).astype(np.int16), kind="stable")]
        hs, w, d = _with_ones(states, real, room), words.ravel()[real], doc.ravel()[real]
        cls, own = w // side, w % side
        likely = np.zeros(len(w), _F)
        for s in range(0, len(w), ROWS):
            some = slice(s, min(s + ROWS, len(w)))
            add(likely[some], hs[None, some], of_class[None], numbers[: some.stop - s], cls[some], safe_c)
        for k, m, most, s, e, places in _blocks(cls, kinds):
            add(likely[s:e], _block(hs[s:e], m - k, most, places, room), within[k:m], places, own[s:e], safe_w)
        total += np.bincount(d, weights=likely, minlength=len(docs))
    return total


def train(p: dict, docs: list[np.ndarray], lanes: int = TRAIN_LANES, steps: int = STEPS, rate: float = RATE) -> int:
    """One pass of truncated backpropagation with Adagrad steps, in place; returns the words it saw.

    Every word is learnt from; in a document of more than PIECE words the state starts anew after
    each piece. (Scoring carries it through the whole document.)
    """
    if not docs:
        return 0
    laid, room = Lanes([d[i : i + PIECE] for d in docs for i in range(0, len(d), PIECE)], lanes), _Room()
    hidden, (kinds, side) = p["u"].shape[0], p["wb"].shape
    of_class, within = _joined(p)
    own_p = {"x": p["x"], "u": p["u"], "c": of_class, "w": within}
    seen = {k: np.full(v.shape, 1e-3, _F) for k, v in own_p.items()}
    h, numbers = np.zeros((hidden, len(laid.size)), _F), np.arange(ROWS)
    grad_c, grad_w = np.empty_like(of_class), np.empty_like(within)

    def step(k: str, grad: np.ndarray, rows=slice(None)) -> None:
        s = seen[k][rows]
        s += grad * grad
        seen[k][rows] = s
        own_p[k][rows] -= _F(rate) * grad / np.sqrt(s)

    for prev, words, new, _, there in laid.windows(steps):
        live = words.shape[1]
        states, starts, zr, n, g = _forward(p, prev, new, h[:, :live], room, keep=True)
        h = states[-1].copy()
        real = np.flatnonzero(there.ravel())
        real = real[np.argsort((words.ravel()[real] // side).astype(np.int16), kind="stable")]
        hs, w = _with_ones(states, real, room), words.ravel()[real]
        cls, own, unit = w // side, w % side, _F(1 / len(w))
        safe_c, safe_w = _safe(of_class[:-1], of_class[-1]), _safe(within[:, :-1], within[:, -1])
        dh = room("dh", len(w), hidden)
        grad_c.fill(0)
        grad_w.fill(0)

        def learn(x: np.ndarray, w: np.ndarray, grad: np.ndarray, places: np.ndarray, own: np.ndarray, safe: bool, unit=unit) -> np.ndarray:
            """Adds to the gradient of the block's weights; returns its rows' derivatives."""
            o = np.matmul(x, w, out=room("o", *x.shape[:2], w.shape[-1]))
            by_row = o.reshape(-1, w.shape[-1])
            by_row *= (unit / _exp(by_row, safe))[:, None]
            by_row[places, own] -= unit
            grad += x.transpose(0, 2, 1) @ o
            back = np.matmul(o, w[:, :-1].transpose(0, 2, 1), out=room("back", *x.shape[:2], hidden)).reshape(-1, hidden)
            return back if len(x) == 1 else back[places]

        for s in range(0, len(w), ROWS):
            some = slice(s, min(s + ROWS, len(w)))
            dh[some] = learn(hs[None, some], of_class[None], grad_c[None], numbers[: some.stop - s], cls[some], safe_c)
        for k, m, most, s, e, places in _blocks(cls, kinds):
            dh[s:e] += learn(_block(hs[s:e], m - k, most, places, room), within[k:m], grad_w[k:m], places, own[s:e], safe_w)
        flat = room("flat", len(states) * live, hidden)
        flat.fill(0)
        flat[real] = dh
        d_states = room("d", len(states), hidden, live)
        d_states[:] = flat.reshape(-1, live, hidden).transpose(0, 2, 1)
        # what a state's derivative is multiplied by for n, z and (from n's) r
        z, r, goes_on = zr[:, :hidden], zr[:, hidden:], (~new).astype(_F)
        rest = np.subtract(1, z, out=room("rest", *n.shape))
        by_z = np.subtract(starts, n, out=room("by_z", *n.shape))
        by_z *= z
        by_z *= rest
        by_n = np.multiply(n, n, out=room("by_n", *n.shape))
        np.subtract(1, by_n, out=by_n)
        by_n *= rest
        by_r = np.subtract(1, r, out=rest)
        by_r *= r
        by_r *= g[:, 2 * hidden :]
        carry = np.zeros((hidden, live), _F)
        dn, dg = room("dn", *n.shape), room("dg", *g.shape)  # dg: by the state before; by what is read, its last third is dn
        for t in range(len(states) - 1, -1, -1):
            d, own_dn, own_dg = d_states[t], dn[t], dg[t]
            d += carry
            np.multiply(by_n[t], d, out=own_dn)
            np.multiply(by_z[t], d, out=own_dg[:hidden])
            np.multiply(by_r[t], own_dn, out=own_dg[hidden : 2 * hidden])
            np.multiply(own_dn, r[t], out=own_dg[2 * hidden :])
            np.matmul(p["u"], own_dg, out=carry)
            d *= z[t]
            carry += d
            carry *= goes_on[t]
        dx = room("dx", len(states), live, 3 * hidden)
        dx[:] = dg.transpose(0, 2, 1)
        grad_u = _rows(starts).T @ dx.reshape(-1, 3 * hidden)
        norm = np.sqrt(float((grad_u * grad_u).sum()))
        if norm > CLIP:
            grad_u *= _F(CLIP / norm)
        dx[..., 2 * hidden :] = dn.transpose(0, 2, 1)
        step("u", grad_u)
        step("c", grad_c)
        step("w", grad_w)
        read = prev.ravel()
        order = np.argsort(read.astype(np.int16), kind="stable")
        edges = np.flatnonzero(np.diff(read[order], prepend=-1))
        step("x", np.add.reduceat(dx.reshape(-1, 3 * hidden)[order], edges, axis=0), read[order[edges]])
    p["cw"][:], p["cb"][:], p["ww"][:], p["wb"][:] = of_class[:-1], of_class[-1], within[:, :-1], within[:, -1]
    return int(sum(map(len, docs)))
