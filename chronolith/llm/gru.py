"""A gated recurrent language model in numpy with a class-factored softmax.

The model knows ``words`` frequent tokens and treats the rest as one rare token.
Output is factored by classes of classes, so that its cost grows with the logarithm of ``words``: a softmax
over the ``CLASS`` classes at the root (and the rare token beside them), one over the classes of the
class, and so on to the tokens of the last class. Token 0 is the end of a
text, and what a text begins after. Parameters that a token touches a row of learn by
adaptive gradients with one sum of squares a row, all others with moments.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np

EMBEDDING, HIDDEN = 16, 16
#: Tokens of a class, and classes of a class.
CLASS = 16
#: Steps of truncated backpropagation, and lanes of a training stream.
WINDOW, LANES = 24, 512
RATE = 0.01
#: Of the rows below.
ROW_RATE = 0.03
#: Levels of classes below the root that a model may have: up to 16 million words.
LEVELS = 5
#: Parameters of which a token touches a row alone.
ROWS = ("e", *(f"w{i}" for i in range(1, LEVELS + 1)))
#: Values of a run from which it is summed by itself.
MANY = 8
#: Tokens of a class to which it is filled up to be stacked with others, and matrices that are gathered at once.
SIZES, GATHERED = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64), 512


@cache
def one_thread() -> None:
    """A task has one core: a second thread of the matrix library only waits for products this small."""
    maps = Path("/proc/self/maps")
    for path in {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ():
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _halves(kind: np.dtype) -> np.ndarray:
    """Factors of the gates' scores: the sigmoid of x is computed by the tanh of x / 2."""
    return np.repeat(np.array([0.5, 1], kind), [2 * HIDDEN, HIDDEN])


def _exp(z: np.ndarray) -> np.ndarray:
    """exp in place, and its sum for each row; scores beyond 60 either way count as that, so no row has to be shifted."""
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _errors(z: np.ndarray, at: np.ndarray, total: float) -> np.ndarray:
    """The softmax of each row less one at a place, over ``total``; ``z`` is overwritten."""
    all_ = _exp(z)
    all_ *= total
    z *= np.reciprocal(all_, out=all_)[:, None]
    z[np.arange(len(z)), at] -= 1 / total
    return z


def _log_of(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at a place; ``z`` is overwritten."""
    hit = np.clip(z[np.arange(len(z)), at], -60, 60).astype(np.float64)
    return hit - np.log(_exp(z))


def _by_size(first: np.ndarray, n: np.ndarray, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, their places in a table) for each size below MANY: runs of one size are computed together."""
    for size in range(least, MANY):
        own = np.flatnonzero(n == size)
        if len(own):
            yield own, first[own, None] + np.arange(size)


def _sums(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at ``first``; most runs have one value."""
    out = values[first]
    for own, place in _by_size(first, n, 2):
        out[own] = values[place].sum(1)
    more = np.flatnonzero(n >= MANY)
    if len(more):
        inside = np.repeat(n >= MANY, n)
        size = n[more]
        out[more] = np.add.reduceat(values[inside], np.cumsum(size) - size, axis=0)
    return out


def _and_one(h: np.ndarray) -> np.ndarray:
    """A last column of ones, for the biases, which are the last row of all weights of the output."""
    return np.concatenate((h, np.ones((len(h), 1), h.dtype)), 1)


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of a sorted array, where each begins and how many places it has."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    return group[first], first, np.diff(np.append(first, len(group)))


class _Runs:
    """Products of rows with the matrix of their group; the rows are sorted by group.

    Groups are filled up to one of SIZES by their last row, and those of a size are stacked; a group of more rows has a product of its own.
    ``each`` and ``n``: groups and their numbers of rows, by size.
    """

    def __init__(self, group: np.ndarray):
        each, first, n = _runs(group)
        size = np.searchsorted(SIZES, n)
        order = np.argsort(size, kind="stable")
        self.each, self.n, first = each[order], n[order], first[order]
        edges = np.searchsorted(size[order], np.arange(len(SIZES) + 1)).tolist()
        self.large = [(self.each[j], first[j], first[j] + self.n[j], j) for j in range(edges[-1], len(each))]
        self.small = []
        for most, begin, end in zip(SIZES, edges[:-1], edges[1:], strict=True):
            for at in range(begin, end, GATHERED):
                own, inside = slice(at, min(at + GATHERED, end)), np.arange(most)
                last = self.n[own, None] - 1
                self.small.append((own, first[own, None] + np.minimum(inside, last), inside <= last))

    def scores(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.empty((len(h), w.shape[2]), np.result_type(h, w))
        for c, begin, end, _ in self.large:
            np.matmul(h[begin:end], w[c], out=z[begin:end])
        for own, place, _ in self.small:
            z[place] = np.matmul(h.take(place, 0), w.take(self.each[own], 0))
        return z

    def gradients(self, h: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the groups' weights, and of ``h`` but for its ones, from those of the scores."""
        gw, dh = np.empty((len(self.each), *w.shape[1:]), d.dtype), np.empty((len(h), HIDDEN), h.dtype)
        for c, begin, end, j in self.large:
            np.matmul(h[begin:end].T, d[begin:end], out=gw[j])
            np.matmul(d[begin:end], w[c, :HIDDEN].T, out=dh[begin:end])
        for own, place, real in self.small:
            rows, error, matrix = h.take(place, 0), d.take(place, 0), w.take(self.each[own], 0)[:, :HIDDEN]
            if place.shape[1] == 1:  # as products these would take five times as long
                dh[place] = np.matmul(error, matrix.transpose(0, 2, 1))
                np.einsum("ni,nj->nij", rows[:, 0], error[:, 0], out=gw[own])
            else:
                dh[place] = np.matmul(matrix, np.ascontiguousarray(error.transpose(0, 2, 1))).transpose(0, 2, 1)
                error *= real[:, :, None]
                np.matmul(rows.transpose(0, 2, 1), error, out=gw[own])
        return gw, dh


def _log_shares(mass: np.ndarray) -> np.ndarray:
    """Logs of the shares in each row; what only pads a row has none to speak of."""
    return np.where(mass > 0, np.log(np.maximum(mass, 1e-300) / mass.sum(1, keepdims=True)), -1e9)


class Gru:
    def __init__(self, counts: np.ndarray, rare: float, seed: int | None = 0):
        """``counts`` of the frequent tokens, a multiple of CLASS of them, and of all others together; output starts as their unigram model. Without a seed the rest is 0."""
        self.words, self.levels = len(counts), 1
        while CLASS ** (self.levels + 1) < self.words:
            self.levels += 1
        self.moments, self.squares, self.met, self.seen = {}, {}, {}, 0
        self._gates: np.ndarray | None = None
        self._room: tuple = None, []
        rng = np.random.default_rng(seed)
        shape = {"e": (self.words + 1, EMBEDDING), "wx": (EMBEDDING, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "bn": (HIDDEN,), "w0": (HIDDEN + 1, CLASS + 1)}
        mass = counts + 0.5
        biases = {}
        for level in range(self.levels, 0, -1):
            mass = np.append(mass, np.zeros(-len(mass) % CLASS)).reshape(-1, CLASS)
            shape[f"w{level}"] = len(mass), HIDDEN + 1, CLASS
            biases[f"w{level}"] = _log_shares(mass)
            mass = mass.sum(1)
        biases["w0"] = _log_shares(np.concatenate((mass, np.zeros(CLASS - len(mass)), [rare + 0.5]))[None])[0]
        self.p = {k: np.zeros(s, np.float32) for k, s in shape.items()}
        for k, scale in (("e", 0.3), ("wx", EMBEDDING**-0.5), ("wh", HIDDEN**-0.5)):
            self.p[k][:] = rng.normal(0, scale, shape[k]) if seed is not None else 0
        for k, v in biases.items():
            self.p[k][..., HIDDEN, :] = v

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        self._gates = None
        return self

    def changes(self, before: Gru):
        """(parameter, rows, tokens that touched each, changes): what training has changed since ``before``; parameters without rows are one."""
        for k, n in self.met.items():
            rows = np.flatnonzero(n)
            now, old = ((m.p[k] if k in ROWS else m.p[k][None])[rows].reshape(len(rows), -1) for m in (self, before))
            yield k, rows, n[rows], now - old

    def inputs(self) -> np.ndarray:
        """What each token adds to the gates."""
        return self.p["e"] @ self.p["wx"] + self.p["b"]

    def _joint(self) -> np.ndarray:
        """One matrix of all that a step multiplies: gates by (input, state, one), with the state's part of the last gate by itself."""
        p, k, n = self.p, HIDDEN, EMBEDDING
        out = np.zeros((4 * k, n + k + 1), p["wh"].dtype)
        out[: 3 * k, :n], out[: 3 * k, -1] = p["wx"].T, p["b"]
        out[: 2 * k, n:-1], out[3 * k :, n:-1] = p["wh"][:, : 2 * k].T, p["wh"][:, 2 * k :].T
        out[3 * k :, -1] = p["bn"]
        out[: 2 * k] *= 0.5
        return out

    def step(self, gates: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after ``h``, a row for each lane; the plain form of what ``score`` and ``_touched`` compute in place."""
        k = HIDDEN
        own = h @ self.p["wh"]
        zr = _sigmoid(gates[:, : 2 * k] + own[:, : 2 * k])
        n = np.tanh(gates[:, 2 * k :] + zr[:, k:] * (own[:, 2 * k :] + self.p["bn"]))
        return n + zr[:, :k] * (h - n)

    def _order(self, tokens: np.ndarray) -> np.ndarray:
        """Places in the order of the tokens, -1 after all others; numbers of 16 bits are sorted by their digits."""
        tokens = np.where(tokens < 0, self.words + 1, tokens)
        return np.argsort(tokens.astype(np.uint16) if self.words < (1 << 16) - 1 else tokens, kind="stable")

    def _root(self, target: np.ndarray) -> np.ndarray:
        """Place at the root; the rare token has the last."""
        return np.where(target < self.words, target // CLASS**self.levels, CLASS)

    def _below(self, target: np.ndarray):
        """(weights, class, place in it) of sorted tokens at each level below the root."""
        for level in range(1, self.levels + 1):
            unit = CLASS ** (self.levels - level)
            yield f"w{level}", target // (unit * CLASS), target // unit % CLASS

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs; for the rare token (number ``words``) that of its place at the root alone."""
        order = self._order(target)
        h, goal = _and_one(h.take(order, 0)), target[order]
        n = int(np.searchsorted(goal, self.words))
        own = _log_of(h @ self.p["w0"], self._root(goal))
        for w, of, at in self._below(goal[:n]):
            own[:n] += _log_of(_Runs(of).scores(h[:n], self.p[w]), at)
        out = np.empty(len(target))
        out[order] = own
        return out

    def score(self, tokens: np.ndarray, lengths: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """Natural log-likelihood of each text with its end. ``tokens``: all texts in a row, without ends.

        Texts are lanes, the longest first; all lanes that still have a token take
        a step together and keep their state to the end of their text. There are as many steps as the
        longest text has tokens, so many texts should be scored at once. Hidden
        states are gathered in windows for the output layer.
        """
        if self._gates is None:
            self._gates = self._joint()
        k, joint, e = HIDDEN, self._gates, self.p["e"]
        order = np.argsort(-lengths, kind="stable")
        begins, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
        out = np.zeros(len(lengths))
        seen = np.zeros((joint.shape[1], len(lengths)), joint.dtype)  # input, state and a one, for each lane
        seen[-1] = 1
        reach = -np.arange(int(size[0]) + 2 if len(size) else 0)
        active = np.searchsorted(-size, reach, "right").tolist()  # lanes with at least t tokens
        states, targets = np.empty((max(at_once, len(lengths)), k), joint.dtype), np.empty(max(at_once, len(lengths)), np.int32)
        held, begin = [], 0

        def flush() -> None:
            found = self.log_probabilities(states[:begin], targets[:begin])
            at = 0
            for m in held:
                out[:m] += found[at : at + m]
                at += m
            held.clear()

        given = np.zeros(len(lengths), np.int32)
        for t, m in enumerate(active[:-1]):
            if begin + m > len(states):
                flush()
                begin = 0
            seen[:EMBEDDING, :m] = e.take(given[:m], 0).T
            z, h = joint @ seen[:, :m], seen[EMBEDDING:-1, :m]
            share, new = z[: 2 * k], z[3 * k :]
            np.tanh(share, out=share)
            share *= 0.5
            share += 0.5
            new *= share[k:]
            new += z[2 * k : 3 * k]
            np.tanh(new, out=new)
            h -= new
            h *= share[:k]
            h += new
            n = active[t + 1]  # the first n lanes have a next token; the others end here
            given = targets[begin : begin + m]
            given[n:] = 0
            given[:n] = tokens[begins[:n] + t]
            states[begin : begin + m] = h.T
            held.append(m)
            begin += m
        if held:
            flush()
        result = np.zeros(len(lengths))
        result[order] = out
        return result

    def fit(self, stream: np.ndarray, rate: float = RATE) -> None:
        """One pass over all of a stream of texts (tokens, then 0, for each) by truncated backpropagation through time; what it has learnt of step sizes goes on from call to call."""
        if not len(stream):
            return
        self._gates = None
        lanes = int(np.clip(len(stream) // 256, 1, LANES))
        long = -(-len(stream) // lanes)
        target = np.full(lanes * long, -1, stream.dtype)  # the last lane ends with fewer than ``lanes`` steps without a target
        target[: len(stream)] = stream
        target = target.reshape(lanes, long).T
        given = np.concatenate((np.zeros((1, lanes), stream.dtype), np.maximum(target[:-1], 0)))
        h = np.zeros((lanes, HIDDEN), np.float32)
        if not self.moments:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items() if k not in ROWS}
            self.squares = {k: np.zeros(len(self.p[k]), np.float32) for k in ROWS if k in self.p}
            self.met = {k: np.zeros(len(self.p[k]) if k in ROWS else 1, np.int64) for k in self.p}
        for at in range(0, long, WINDOW):
            self.seen += 1
            grads, h = self._touched(given[at : at + WINDOW], target[at : at + WINDOW], h)
            for k, (rows, g, n) in grads.items():
                self.met[k][rows if k in ROWS else 0] += n
                if k in ROWS:
                    flat = g.reshape(len(g), -1)
                    total = self.squares[k][rows] + np.einsum("ij,ij->i", flat, flat) / flat.shape[1]
                    self.squares[k][rows] = total
                    flat *= (-ROW_RATE / np.sqrt(total + np.float32(1e-20)))[:, None]
                    g += self.p[k].take(rows, 0)
                    self.p[k][rows] = g
                    continue
                first, second = self.moments[k]
                first += np.float32(0.1) * (g - first)
                second += np.float32(0.01) * (g * g - second)
                self.p[k] -= rate / (1 - 0.9**self.seen) * first / (np.sqrt(second / (1 - 0.99**self.seen)) + 1e-5)

    def _gradients(self, given: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean negative log-likelihood of a window, and the state after it. Targets of -1 don't count."""
        touched, h = self._touched(given, target, h)
        dense = {k: np.zeros_like(v) for k, v in self.p.items()}
        for k, (rows, g, _) in touched.items():
            dense[k][rows] = g
        return dense, h

    def _touched(self, given: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[dict[str, tuple], np.ndarray]:
        """As ``_gradients``, by what is touched alone: (rows, their gradients, tokens that touched them) for each parameter."""
        p, k = self.p, HIDDEN
        steps, lanes = given.shape
        kind = np.result_type(h, p["wh"])
        # Lanes come last, so that what belongs to a gate is in one piece.
        x = p["e"].take(given, 0)
        half = _halves(kind)
        gates = np.matmul((p["wx"] * half).T, x.transpose(0, 2, 1))
        gates += (p["b"] * half)[:, None]
        wh, bn = np.ascontiguousarray((p["wh"] * half).T), p["bn"][:, None]
        live = (given != 0)[:, None, :].astype(kind)  # 0: a text begins
        before, hs, zr, inner, n, to_gates, to_own = self._space(steps, lanes, kind)
        h = h.T
        for t in range(steps):
            old, new, share, out = before[t], n[t], zr[t], hs[t]
            np.multiply(h, live[t], out=old)
            own = wh @ old
            np.add(gates[t, : 2 * k], own[: 2 * k], out=share)
            np.tanh(share, out=share)
            share *= 0.5
            share += 0.5
            np.add(own[2 * k :], bn, out=inner[t])
            np.multiply(share[k:], inner[t], out=new)
            new += gates[t, 2 * k :]
            np.tanh(new, out=new)
            np.subtract(old, new, out=out)
            out *= share[:k]
            out += new
            h = out
        g, rows = {}, {}
        flat, goal = _and_one(hs.transpose(0, 2, 1).reshape(-1, k)), target.reshape(-1)
        total = kind.type((goal >= 0).sum())
        d = _errors(flat @ p["w0"], self._root(goal), total)
        d[goal < 0] = 0
        g["w0"] = flat.T @ d
        dh = d @ p["w0"][:k].T
        order = self._order(goal)
        known = order[: np.searchsorted(np.where(goal < 0, self.words, goal)[order], self.words)]
        if len(known):
            own, ahead = flat.take(known, 0), np.zeros((len(known), k), kind)
            for w, of, at in self._below(goal[known]):
                runs = _Runs(of)
                d = _errors(runs.scores(own, p[w]), at, total)
                gw, more = runs.gradients(own, p[w], d)
                rows[w] = runs.each, gw, runs.n
                ahead += more
            dh[known] += ahead
        dh = np.ascontiguousarray(dh.reshape(steps, lanes, k).transpose(0, 2, 1))
        back = np.zeros((k, lanes), kind)
        for t in range(steps - 1, -1, -1):
            z, r, new = zr[t, :k], zr[t, k:], n[t]
            d = dh[t]
            d += back
            of_gates, of_own = to_gates[t], to_own[t]
            dn, rest = of_gates[2 * k :], 1 - z
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= rest
            dn *= d
            rest *= z
            rest *= before[t] - new
            np.multiply(rest, d, out=of_gates[:k])
            np.subtract(1, r, out=rest)
            rest *= r
            rest *= inner[t]
            np.multiply(rest, dn, out=of_gates[k : 2 * k])
            of_own[: 2 * k] = of_gates[: 2 * k]
            np.multiply(dn, r, out=of_own[2 * k :])
            back = p["wh"] @ of_own
            d *= z
            back += d
            back *= live[t]
        g["b"], g["bn"] = to_gates.sum((0, 2)), to_own[:, 2 * k :].sum((0, 2))
        by_lane = to_gates.transpose(0, 2, 1)
        g["wx"] = np.matmul(x.transpose(0, 2, 1), by_lane).sum(0)
        g["wh"] = np.matmul(before, to_own.transpose(0, 2, 1)).sum(0)
        de, order = np.matmul(by_lane, p["wx"].T).reshape(-1, EMBEDDING), self._order(given.reshape(-1))
        each, begin, times = _runs(given.reshape(-1)[order])
        rows["e"] = (each, _sums(de.take(order, 0), begin, times), times)
        rows |= {name: (slice(None), v, int(total)) for name, v in g.items()}
        return rows, h.T.copy()

    def _space(self, steps: int, lanes: int, kind: np.dtype) -> list[np.ndarray]:
        """Room for what the steps of a window compute, kept from window to window."""
        if (steps, lanes, kind) != self._room[0]:
            self._room = (steps, lanes, kind), [np.empty((steps, w * HIDDEN, lanes), kind) for w in (1, 1, 2, 1, 1, 3, 3)]
        return self._room[1]
