"""A small gated recurrent language model in numpy with a class-factored softmax.

Words 0..n_head-1 have weights of their own, `width` to a class; every further word is one of TAILS tail classes, whose
inner distribution is fixed outside the model. An input is a head word or a tail class.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

HIDDEN, TAILS = 16, 32
F32 = np.float32


@dataclass
class Gru:
    n_head: int
    width: int
    p: dict[str, np.ndarray]

    @staticmethod
    def new(n_head: int, width: int = 32, hidden: int = HIDDEN, seed: int = 3) -> Gru:
        r = np.random.default_rng(seed)
        classes = -(-n_head // width)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(F32)
        inner = np.zeros((classes, width), F32)
        inner.reshape(-1)[n_head:] = -1e4  # places without a word
        p = {
            "x": (0.1 * r.standard_normal((n_head + TAILS, 3 * hidden))).astype(F32), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, F32),
            "c": 0.1 * draw(hidden, classes + TAILS), "cb": np.zeros(classes + TAILS, F32), "w": 0.1 * draw(classes, hidden, width), "wb": inner,
        }
        return Gru(n_head, width, p)

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(self.p[k]).tobytes() for k in sorted(self.p))

    def unpacked(self, weights: bytes) -> Gru:
        """A model like this one with packed weights."""
        at, p = 0, {}
        for k in sorted(self.p):
            p[k] = np.frombuffer(weights, F32, self.p[k].size, at).reshape(self.p[k].shape).copy()
            at += p[k].nbytes
        return Gru(self.n_head, self.width, p)

    @property
    def classes(self) -> int:
        return len(self.p["wb"])

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_head, ids // self.width, ids - self.n_head + self.classes)

    def start_biases(self, counts: np.ndarray) -> None:
        """Biases from the counts of head words and tail classes, so that training starts at the unigram model."""
        by_class = np.bincount(self.class_of(np.arange(len(counts))), counts, minlength=self.classes + TAILS)
        self.p["cb"][:] = np.log(by_class + 1) - np.log(by_class.sum() + len(by_class))
        flat = self.p["wb"].reshape(-1)
        flat[: self.n_head] = np.log(counts[: self.n_head] + 1)

    def step(self, h: np.ndarray, x: np.ndarray, room: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """The next state from projected inputs x; also what backpropagation needs. Results lie in `room` if it is given."""
        k = h.shape[1]
        new, gates, n, hu = room or [np.empty((len(h), w), F32) for w in (k, 2 * k, k, 3 * k)]
        np.matmul(h, self.p["u"], out=hu)
        np.add(x[:, : 2 * k], hu[:, : 2 * k], out=gates)
        with np.errstate(over="ignore"):  # 1 / inf is the limit
            _logistic(gates)
            z, r = gates[:, :k], gates[:, k:]
            np.multiply(r, hu[:, 2 * k :], out=n)
            n += x[:, 2 * k :]
            n += n
            _logistic(n)  # tanh(v) is 2 logistic(2 v) - 1
        n += n
        n -= F32(1)
        np.subtract(h, n, out=new)
        new *= z
        new += n
        return new, z, r, n, hu

    def log_probability(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for head words, of P(word | class), by state."""
        most, inner = self.bounds()
        order, cls = _by_class(self.class_of(targets), self.classes + TAILS)
        states, found = states.take(order, axis=0), np.empty(len(targets))
        room = np.empty((BLOCK, self.classes + TAILS), F32)
        for at in range(0, len(order), BLOCK):
            to = at + BLOCK
            found[at:to] = _log_softmax_at(states[at:to], self.p["c"], self.p["cb"], cls[at:to], most, room)
        word = targets[order] % self.width
        cuts = np.searchsorted(cls, np.arange(self.classes + 1))
        room = np.empty((BLOCK, self.width), F32)
        for c in range(self.classes):
            for at in range(cuts[c], cuts[c + 1], BLOCK):
                to = min(at + BLOCK, cuts[c + 1])
                found[at:to] += _log_softmax_at(states[at:to], self.p["w"][c], self.p["wb"][c], word[at:to], inner[c], room)
        out = np.empty(len(targets))
        out[order] = found
        return out

    def bounds(self) -> tuple[float, np.ndarray]:
        """What no logit of a class, or of a word in each class, exceeds: states lie between -1 and 1."""
        p = self.p
        return float((np.abs(p["c"]).sum(axis=0) + p["cb"]).max()), (np.abs(p["w"]).sum(axis=1) + p["wb"]).max(axis=1)

    def score(self, texts: list[np.ndarray], first: int, tail: list[np.ndarray], most: int = 512) -> np.ndarray:
        """Natural log-likelihood of each id sequence from a zero state and the input `first`; tail[i][t] is added.

        The state is carried across windows through whole sequences, however long.
        """
        out = np.array([x.sum() for x in tail], np.float64)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        hidden = len(self.p["u"])
        project = self.p["x"] + self.p["b"]
        for at in range(0, len(order), most):
            group = order[at : at + most]
            lengths = np.array([len(texts[i]) for i in group])
            h, t = np.zeros((len(group), hidden), F32), 0
            before = np.full(len(group), first, np.int32)
            while len(lengths) and t < lengths[0]:
                live = int(np.searchsorted(-lengths, -t, "left"))
                width = int(min(max(16384 // live, 32), 1024, lengths[0] - t))
                h, before = h[:live], before[:live]
                targets = np.zeros((width, live), np.int32)
                for j in range(live):
                    part = texts[group[j]][t : t + width]
                    targets[: len(part), j] = part
                inputs = np.concatenate((before[None], targets[:-1]))
                states = np.empty((width, live, hidden), F32)
                x = project.take(inputs, axis=0)
                for k in range(width):
                    h = self.step(h, x[k])[0]
                    states[k] = h
                there = (t + np.arange(width))[:, None] < lengths[:live][None]
                found = np.zeros((width, live))
                found[there] = self.log_probability(states[there], targets[there])
                out[group[:live]] += found.sum(axis=0)
                before, t = targets[-1], t + width
        return out


#: Rows of logits that are worked on at once, in memory that is used again.
BLOCK = 1024


def _logistic(v: np.ndarray) -> None:
    """1 / (1 + exp(-v)), in place."""
    np.negative(v, out=v)
    np.exp(v, out=v)
    v += F32(1)
    np.reciprocal(v, out=v)


def _by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by class, and their classes in it."""
    cls = cls.astype(np.uint16 if classes < 1 << 16 else np.int32)
    order = np.argsort(cls, kind="stable")
    return order, cls[order]


def _log_softmax_at(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, most: float, room: np.ndarray) -> np.ndarray:
    """Log softmax of each state's logits at one column. No logit is above `most`, which is subtracted from all: a bound
    of the model that spares a maximum by row. A row far below it is done again with its own maximum."""
    logits = np.matmul(states, weights, out=room[: len(states)])
    logits += bias - F32(most)
    picked = logits[np.arange(len(at)), at].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], F32)
    if not len(total) or float(total.min()) >= 1e-25:
        return picked - np.log(total)
    low = np.flatnonzero(total < 1e-25)
    total[low] = 1
    out = picked - np.log(total)
    shifted = (states[low] @ weights + (bias - F32(most))).astype(np.float64)
    own = shifted.max(axis=1, keepdims=True)
    out[low] = picked[low] - own[:, 0] - np.log(np.exp(shifted - own).sum(axis=1))
    return out


def _softmax_grad(states: np.ndarray, weights: np.ndarray, at: np.ndarray, most: float, room: np.ndarray) -> np.ndarray:
    """Softmax of each state's logits less 1 at one column; `most` as in _log_softmax_at. The last weights are biases,
    the last column of states is 1."""
    weights = weights.copy()
    weights[-1] -= F32(most)
    found = np.matmul(states, weights, out=room[: len(states)])
    np.exp(found, out=found)
    total = found @ np.ones(found.shape[1], F32)
    if len(total) and float(total.min()) < 1e-25:
        low = np.flatnonzero(total < 1e-25)
        logits = states[low] @ weights
        found[low] = np.exp(logits - logits.max(axis=1, keepdims=True))
        total[low] = found[low].sum(axis=1)
    found *= np.reciprocal(total)[:, None]
    found[np.arange(len(at)), at] -= 1
    return found


def _streams(texts: Iterable[np.ndarray], streams: int | None, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts one after the other, cut into equal streams: tokens and the starts of texts, by place and stream, and how
    many tokens there are. The last stream ends in places that are -1. By default a stream's tokens are enough for
    UPDATES windows, and streams are 48 at least and 512 at most."""
    texts = [t for t in texts if len(t)]
    lengths = np.array([len(t) for t in texts], np.int64)
    n = int(lengths.sum())
    streams = streams or int(np.clip(n / window / UPDATES, 48, 512))
    each = max(1, -(-n // streams))
    tokens, starts = np.full(each * streams, -1, np.int32), np.zeros(each * streams, bool)
    if n:
        np.concatenate(texts, out=tokens[:n], casting="unsafe")
        starts[np.cumsum(lengths) - lengths] = True
    return tokens.reshape(streams, each).T, starts.reshape(streams, each).T, n


#: Windows a stream has before there are more streams.
UPDATES = 300


def train(model: Gru, texts: Iterable[np.ndarray], first: int, part: int, tokens: int, parts: int, streams: int | None = None, window: int = 16, rate: float = 0.008) -> int:
    """Fit the model in place by Adam, backpropagation truncated to `window` steps; returns the tokens learned.

    Texts are learned to their last token, in streams that run side by side, state carried on within a text. A text
    that begins in one stream and goes on in the next starts there from the zero state, after its own last token.
    The learning rate falls over all parts: this is one of `parts`, and has about so many tokens.
    """
    dealt, starts, total = _streams(texts, streams, window)
    if not total:
        return 0
    p, hidden, learned, update = model.p, len(model.p["u"]), 0, 0
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}, {k: np.zeros_like(v) for k, v in p.items()}
    last = np.zeros(len(p["x"]), np.int32)
    streams = dealt.shape[1]
    before = np.concatenate(([first], dealt[-1, :-1])).astype(np.int32)
    h = np.zeros((streams, hidden), F32)
    rooms = [[np.empty((streams, w * hidden), F32) for w in (1, 2, 1, 3)] for _ in range(window)]
    whole = [np.empty((window * streams, w), F32) for w in (3 * hidden, 3 * hidden, 3 * hidden, hidden, hidden, hidden + 1, hidden + 1, hidden)]
    class_room, word_room = np.empty((BLOCK, model.classes + TAILS), F32), np.empty((BLOCK, model.width), F32)
    for top in range(0, len(dealt), window):
        targets, fresh = dealt[top : top + window], starts[top : top + window]
        steps = len(targets)
        update += 1
        inputs = np.concatenate((before[None], targets[:-1]))
        before = targets[-1]
        inputs[fresh | (inputs < 0)] = first
        x, dx, dhu, past, full, states, flat, dh_all = (v[: steps * streams] for v in whole)
        np.take(p["x"] + p["b"], inputs.reshape(-1), axis=0, out=x, mode="clip")
        by_step = lambda v: v.reshape(steps, streams, -1)
        states[:, hidden] = 1
        cut = fresh.any(axis=1)
        for k in range(steps):
            if cut[k]:
                h = h * ~fresh[k][:, None]
            by_step(past)[k] = h
            h = model.step(h, by_step(x)[k], rooms[k])[0]
            by_step(states)[k, :, :hidden] = h
        aim = targets.reshape(-1)
        order, cls = _by_class(np.where(aim < 0, model.classes + TAILS, model.class_of(aim)), model.classes + TAILS + 1)
        n = int(np.searchsorted(cls, model.classes + TAILS))
        order, cls = order[:n], cls[:n]
        learned += n
        flat, dh_all = np.take(states, order, axis=0, out=flat[:n], mode="clip"), dh_all[:n]
        word = aim[order] % model.width
        most, inner = model.bounds()
        weights = np.vstack((p["c"], p["cb"]))
        both = np.zeros_like(weights)
        for at in range(0, n, BLOCK):
            to = at + BLOCK
            d = _softmax_grad(flat[at:to], weights, cls[at:to], most, class_room)
            both += flat[at:to].T @ d
            np.matmul(d, p["c"].T, out=dh_all[at:to])
        g = {"c": both[:-1] / n, "cb": both[-1] / n, "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
        cuts = np.searchsorted(cls, np.arange(model.classes + 1))
        for c in range(model.classes):
            weights = np.vstack((p["w"][c], p["wb"][c]))
            for at in range(cuts[c], cuts[c + 1], BLOCK):
                to = min(at + BLOCK, cuts[c + 1])
                d = _softmax_grad(flat[at:to], weights, word[at:to], inner[c], word_room)
                both = flat[at:to].T @ d
                g["w"][c] += both[:-1] / n
                g["wb"][c] += both[-1] / n
                dh_all[at:to] += d @ p["w"][c].T
        full[:] = 0
        dh_all *= F32(1 / n)
        full[order] = dh_all
        carry = np.zeros((streams, hidden), F32)
        for k in range(steps - 1, -1, -1):
            _, gates, nn, hu = rooms[k]
            z, rr, to_x, to_u = gates[:, :hidden], gates[:, hidden:], by_step(dx)[k], by_step(dhu)[k]
            carry += by_step(full)[k]
            dn = carry * (1 - z)
            dz = dn * (by_step(past)[k] - nn)
            dz *= z
            dn *= 1 - nn * nn
            dnr = dn * rr
            dr = dnr * hu[:, 2 * hidden :]
            dr *= 1 - rr
            to_x[:, :hidden] = to_u[:, :hidden] = dz
            to_x[:, hidden : 2 * hidden] = to_u[:, hidden : 2 * hidden] = dr
            to_x[:, 2 * hidden :], to_u[:, 2 * hidden :] = dn, dnr
            carry *= z
            carry += to_u @ p["u"].T
            if cut[k]:
                carry *= ~fresh[k][:, None]
        g["u"] = past.T @ dhu
        order, met = _by_class(inputs.reshape(-1), len(p["x"]))
        first_of = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1])))
        used = met[first_of]  # only the rows of words that the window met are touched
        g["x"] = np.add.reduceat(np.take(dx, order, axis=0, out=x, mode="clip"), first_of, axis=0)
        g["b"] = g["x"].sum(axis=0)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = F32(min(1.0, 1.0 / max(norm, 1e-9)))
        done = (part + min(learned / max(tokens, 1), 1.0)) / parts
        now_rate = rate * max(min(1.0, 2.0 * (1 - done)), 0.02)
        grown, spread = 1 - 0.9**update, 1 - 0.99**update
        for key, v in g.items():
            v = v * scale
            at, fade = slice(None), F32(0.99)
            if key == "x":  # as many steps as went by since the row was met
                at, fade = used, (fade ** (update - last[used]))[:, None].astype(F32)
                last[used] = update
            m2[key][at] = b = fade * m2[key][at] + F32(0.01) * v * v
            if key in m1:
                m1[key] = v = F32(0.9) * m1[key] + F32(0.1) * v
                v = v / F32(grown)
            p[key][at] -= F32(now_rate) * v / (np.sqrt(b / F32(spread)) + F32(1e-6))
    return learned
