"""A gated recurrent language model in numpy, with a class-factored softmax.

Documents are dealt to lanes; all lanes advance together, a lane's state is
reset where a document starts and carried over windows otherwise. A word's
probability is that of its class times that within the class. The words of the
shortlist are in classes by frequency, so that frequent words are in small
classes; each further class is a tail group whose words have fixed shares.
Biases start at the unigram frequencies, so the untrained model is the unigram
model.
"""

from __future__ import annotations

import numpy as np

MOST = np.float32(80)  # larger logits count as this one, so that nothing overflows


def class_bounds(mass: np.ndarray, classes: int) -> np.ndarray:
    """Words before each class: words in order of frequency, classes of equal sums of square roots of mass."""
    total = np.cumsum(np.sqrt(mass))
    at = np.searchsorted(total, total[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], np.minimum(at, len(mass)), [len(mass)]]))


class Model:
    """Parameters as one vector, so that models can be averaged. at: words before each class of the shortlist."""

    def __init__(self, inputs: int, at: np.ndarray, tails: int, hidden: int):
        self.at, self.classes = np.asarray(at, np.int64), len(at) - 1
        self.inputs, self.tails, self.hidden = inputs, tails, hidden
        c, words = self.classes + tails, int(self.at[-1])
        self.shapes = {"x": (inputs, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, c), "bc": (c,), "wi": (words, hidden), "bi": (words,)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.view(np.zeros(self.size, np.float32))

    def like(self) -> Model:
        return Model(self.inputs, self.at, self.tails, self.hidden)

    def view(self, vector: np.ndarray) -> Model:
        self.vector, at = vector, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, vector[at : at + n].reshape(shape))
            at += n
        return self

    def large(self) -> bool:
        """Whether a logit may exceed MOST: states are within -1 and 1."""
        return max(float((np.abs(self.wc).sum(0) + self.bc).max()), float((np.abs(self.wi).sum(1) + self.bi).max(initial=0))) > MOST

    def start(self, class_mass: np.ndarray, word_mass: np.ndarray, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.vector[:] = rng.normal(0, 0.08, self.size)
        self.bc[:] = np.log(class_mass / class_mass.sum())
        own = np.add.reduceat(word_mass, self.at[:-1])
        self.bi[:] = np.log(word_mass / np.repeat(own, np.diff(self.at)))


def lanes(sizes: np.ndarray, width: int):
    """For each lane its documents, the longest dealt first to the emptiest lane."""
    import heapq

    heap, out = [(0, i) for i in range(min(width, len(sizes)))], [[] for _ in range(min(width, len(sizes)))]
    for d in np.argsort(-sizes, kind="stable"):
        n, i = heapq.heappop(heap)
        out[i].append(int(d))
        heapq.heappush(heap, (n + int(sizes[d]), i))
    return out


def grid(bounds: np.ndarray, width: int):
    """(places, starts): token numbers of each step and lane (-1: none), and where a document begins."""
    dealt = lanes(np.diff(bounds), width)
    steps = max(sum(int(bounds[d + 1] - bounds[d]) for d in lane) for lane in dealt)
    place = np.full((steps, len(dealt)), -1, np.int32)
    first = np.zeros((steps, len(dealt)), bool)
    for i, lane in enumerate(dealt):
        at = 0
        for d in lane:
            n = int(bounds[d + 1] - bounds[d])
            place[at : at + n, i] = np.arange(bounds[d], bounds[d + 1])
            first[at, i] = True
            at += n
    return place, first


def busy(bounds: np.ndarray, most: int) -> int:
    """About as many lanes as have work beside the longest document."""
    return int(min(most, max(16, bounds[-1] // max(1, int(np.diff(bounds).max())))))


def windows(bounds: np.ndarray, width: int, window: int):
    """(places, starts, lanes that go on) of each window; lanes only end."""
    place, first = grid(bounds, busy(bounds, width))
    for at in range(0, len(place), window):
        live = place[at] >= 0
        keep = None
        if not live.all():
            keep = np.flatnonzero(live)
            place, first = place[:, keep], first[:, keep]
        yield place[at : at + window], first[at : at + window], keep


def _half_tanh(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _step(m: Model, x: np.ndarray, h: np.ndarray):
    """New state, both gates, the candidate and its recurrent part."""
    k = m.hidden
    g = h @ m.u
    rz = _half_tanh(x[:, : 2 * k] + g[:, : 2 * k])
    hn = g[:, 2 * k :]
    n = rz[:, :k] * hn
    n += x[:, 2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= rz[:, k:]
    new += n
    return new, rz, n, hn


def _reset(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return h * ~first[:, None] if first.any() else h


def _exp(x: np.ndarray, large: bool) -> np.ndarray:
    if large:
        np.minimum(x, MOST, out=x)
    return np.exp(x, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], np.float32)


def log_probability(m: Model, inputs: np.ndarray, klass: np.ndarray, within: np.ndarray, bounds: np.ndarray, width: int = 256, block: int = 1 << 14) -> np.ndarray:
    """Natural log probability of each token: class and, on the shortlist, word in class. inputs: the token before. block: tokens of a window."""
    out = np.zeros(len(inputs))
    if not len(inputs):
        return out
    klass, large = klass.astype(np.int16), m.large()
    h = None
    for p, f, keep in windows(bounds, width, max(16, block // busy(bounds, width))):
        h = np.zeros((p.shape[1], m.hidden), np.float32) if h is None else h if keep is None else h[keep]
        states, x = np.empty((*p.shape, m.hidden), np.float32), m.x[inputs[p]]
        for t in range(len(p)):
            h = _step(m, x[t], _reset(h, f[t]))[0]
            states[t] = h
        flat = p.ravel()
        ok = np.flatnonzero(flat >= 0)
        ok = ok[np.argsort(klass[flat[ok]], kind="stable")]
        tokens, s = flat[ok], states.reshape(-1, m.hidden)[ok]
        c = klass[tokens]
        logits = s @ m.wc
        logits += m.bc
        lp = np.minimum(logits[np.arange(len(c)), c], MOST).astype(float)
        lp -= np.log(_sums(_exp(logits, large)))
        edges, word = np.searchsorted(c, np.arange(m.classes + 1)), within[tokens]
        for k in range(m.classes):
            a, b = edges[k], edges[k + 1]
            lo, hi = m.at[k], m.at[k + 1]
            if a < b and hi - lo > 1:
                logits = s[a:b] @ m.wi[lo:hi].T
                logits += m.bi[lo:hi]
                own = np.minimum(logits[np.arange(b - a), word[a:b]], MOST)
                lp[a:b] += own - np.log(_sums(_exp(logits, large)))
        out[tokens] = lp
    return out


def segments(bounds: np.ndarray, most: int) -> np.ndarray:
    """``bounds`` with documents of more than ``most`` tokens cut, so that lanes stay full."""
    sizes = np.diff(bounds)
    n = np.maximum(1, -(-sizes // most))
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.append(np.repeat(bounds[:-1], n) + step * most, bounds[-1])


def _adam(v: np.ndarray, m1: np.ndarray, m2: np.ndarray, rate: np.float32) -> np.ndarray:
    """The step for gradient ``v``; both moments are moved in place."""
    m1 += np.float32(0.1) * (v - m1)
    v *= v
    v -= m2
    v *= np.float32(0.01)
    m2 += v
    step = np.sqrt(m2)
    step += np.float32(1e-6)
    np.divide(m1, step, out=step)
    step *= rate
    return step


class Trainer:
    """Truncated backpropagation with Adam; states are carried through the windows of a segment, gradients taken in each."""

    def __init__(self, m: Model, rate: float = 0.01):
        self.m, self.rate, self.t = m, rate, 0
        self.m1, self.m2, self.g = np.zeros(m.size, np.float32), np.zeros(m.size, np.float32), m.like()
        self.n_x = m.inputs * 3 * m.hidden  # the inputs' rows come first; only those of words that occur are moved

    def fit(self, inputs, klass, within, bounds, width: int = 512, window: int = 16, segment: int = 1024, least: int = 2048) -> int:
        """Learns all tokens and returns their number; a step is made from ``least`` tokens on, the last one in proportion to what is left."""
        if not len(inputs):
            return 0
        klass = klass.astype(np.int16)
        bounds = segments(bounds, segment)
        h, n, rows = None, 0, []
        for p, f, keep in windows(bounds, width, window):
            h = np.zeros((p.shape[1], self.m.hidden), np.float32) if h is None else h if keep is None else h[keep]
            h, more, used = self._gradients(p, f, inputs, klass, within, h)
            n += more
            rows.append(used)
            if n >= least:
                self._move(n, rows, 1.0)
                n, rows = 0, []
        if n:
            self._move(n, rows, n / least)
        return len(inputs)

    def _gradients(self, p, f, inputs, klass, within, h):
        """Adds the gradient over the tokens of a window to ``g``; the state after it, the number of tokens, and the inputs that occur."""
        m, k, g = self.m, self.m.hidden, self.g
        steps, width = p.shape
        before, states, n_, hn = (np.empty((steps, width, k), np.float32) for _ in range(4))
        rz = np.empty((steps, width, 2 * k), np.float32)
        x = m.x[inputs[p]]
        for t in range(steps):
            before[t] = _reset(h, f[t])
            h, rz[t], n_[t], hn[t] = _step(m, x[t], before[t])
            states[t] = h
        flat = p.ravel()
        live = np.flatnonzero(flat >= 0)
        live = live[np.argsort(klass[flat[live]], kind="stable")]
        tokens = flat[live]
        s = states.reshape(-1, k)[live]
        c = klass[tokens]
        d = s @ m.wc
        d += m.bc
        large = m.large()
        _exp(d, large)
        d *= (np.float32(1) / _sums(d))[:, None]
        d[np.arange(len(c)), c] -= 1
        g.wc += s.T @ d
        g.bc += np.ones(len(d), np.float32) @ d
        ds = d @ m.wc.T
        edges, word = np.searchsorted(c, np.arange(m.classes + 1)), within[tokens]
        for j in range(m.classes):
            a, b = edges[j], edges[j + 1]
            lo, hi = m.at[j], m.at[j + 1]
            if a < b and hi - lo > 1:
                own = s[a:b]
                d = own @ m.wi[lo:hi].T
                d += m.bi[lo:hi]
                _exp(d, large)
                d *= (np.float32(1) / _sums(d))[:, None]
                d[np.arange(b - a), word[a:b]] -= 1
                g.wi[lo:hi] += d.T @ own
                g.bi[lo:hi] += np.ones(b - a, np.float32) @ d
                ds[a:b] += d @ m.wi[lo:hi]
        dstate = np.zeros((steps * width, k), np.float32)
        dstate[live] = ds
        dstate = dstate.reshape(steps, width, k)
        r, z = rz[..., :k], rz[..., k:]
        one = np.float32(1)
        rest = one - rz  # of both gates
        to_z = before - n_
        to_z *= z
        to_z *= rest[..., k:]
        to_n = np.square(n_, out=n_)
        np.subtract(one, to_n, out=to_n)
        to_n *= rest[..., k:]
        to_r = np.multiply(hn, r, out=hn)
        to_r *= rest[..., :k]
        del rest
        dx, back = np.empty((steps, width, 3 * k), np.float32), np.empty((steps, width, 3 * k), np.float32)
        dh = np.zeros((width, k), np.float32)
        ut = np.ascontiguousarray(m.u.T)
        for t in range(steps - 1, -1, -1):
            dh += dstate[t]
            dn = dh * to_n[t]
            np.multiply(dn, to_r[t], out=dx[t, :, :k])
            np.multiply(dh, to_z[t], out=dx[t, :, k : 2 * k])
            dx[t, :, 2 * k :] = dn
            back[t, :, : 2 * k] = dx[t, :, : 2 * k]
            np.multiply(dn, r[t], out=back[t, :, 2 * k :])
            dh *= z[t]
            dh += back[t] @ ut
            dh = _reset(dh, f[t])
        g.u += before.reshape(-1, k).T @ back.reshape(-1, 3 * k)
        word = inputs[flat[live]]
        order = np.argsort(word, kind="stable")
        word = word[order]
        new = np.flatnonzero(np.diff(word, prepend=-1))
        used = word[new]
        if len(used):
            g.x[used] += np.add.reduceat(dx.reshape(-1, 3 * k)[live[order]], new)
        return h, len(live), used

    def _move(self, n: int, rows: list[np.ndarray], share: float):
        """A step of Adam against the mean gradient of n tokens; share: the part of a step to take."""
        used = rows[0] if len(rows) == 1 else np.unique(np.concatenate(rows))
        m, width = self.m, 3 * self.m.hidden
        x, rest = self.g.x[used], self.g.vector[self.n_x :]
        scale = np.float32(1 / n)
        norm = float(np.sqrt((x * x).sum() + rest @ rest)) / n
        if norm > 1:
            scale /= np.float32(norm)
        self.t += 1
        rate = np.float32(share * self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        rows1, rows2 = (v[: self.n_x].reshape(-1, width) for v in (self.m1, self.m2))
        one, two = rows1[used], rows2[used]
        m.x[used] -= _adam(x * scale, one, two, rate)
        rows1[used], rows2[used] = one, two
        m.vector[self.n_x :] -= _adam(rest * scale, self.m1[self.n_x :], self.m2[self.n_x :], rate)
        self.g.x[used] = 0
        self.g.vector[self.n_x :] = 0
