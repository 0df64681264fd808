"""A small character tagger in numpy: bidirectional LSTM, linear-chain CRF.

Texts are sequences of character classes in which a run of letters longer than ``RUN`` is squeezed to that length, so that
a label of a symbol holds for all characters it stands for; a digit's class tells how long its run of digits is. A kind has two labels,
one for its first symbol and one for those that follow, so that spans side by side stay apart. Gates are piecewise linear
(clipped), in training and in use.
"""

from __future__ import annotations

import numpy as np

#: One class for each of these; then digits by the length of their run, small letter, capital, other letter, white space, other. Class 0 pads.
SINGLE = "@._%+-():/,#*"
#: Runs of digits of one class are shorter than the next of these.
DIGITS = (1, 2, 3, 4, 5, 9, 13, 20)
N_CLASSES = len(SINGLE) + len(DIGITS) + 6
DIGIT = len(SINGLE) + 1
SMALL, CAPITAL, LETTER, BLANK, OTHER = range(DIGIT + len(DIGITS), N_CLASSES)
KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none; kind k (from 1) has 2 * k - 1 for its first symbol and 2 * k for the others.
N_LABELS = 2 * len(KINDS) + 1
#: What a following label costs behind any label but those of its kind.
ALONE = 20.0
RUN = 2
#: Slope that training sees where a gate is clipped, so that it can come back.
LEAK = 0.02


def _classes(size: int = 0x250) -> np.ndarray:
    table = np.full(size, OTHER, dtype=np.uint8)
    for point in range(size):
        c = chr(point)
        if c in SINGLE:
            table[point] = SINGLE.index(c) + 1
        elif "0" <= c <= "9":
            table[point] = DIGIT
        elif c.isalpha():
            table[point] = SMALL if "a" <= c <= "z" else CAPITAL if "A" <= c <= "Z" else LETTER
        elif c.isspace():
            table[point] = BLANK
    return table


_TABLE = _classes()


def forbidden() -> np.ndarray:
    """Scores of label pairs that cannot be: a following label behind another kind."""
    out = np.zeros((N_LABELS, N_LABELS), np.float32)
    for label in range(2, N_LABELS, 2):
        out[:, label] = -ALONE
        out[label - 1 : label + 1, label] = 0
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, first character of each symbol counted over all texts, where each text's symbols begin)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    kinds[points >= len(_TABLE)] = LETTER
    ends = np.cumsum([len(t) for t in texts])
    digit = np.concatenate([[False], kinds == DIGIT, [False]])
    begin, stop = np.flatnonzero(digit[1:-1] & ~digit[:-2]), np.flatnonzero(digit[1:-1] & ~digit[2:]) + 1
    kinds[kinds == DIGIT] = np.repeat(DIGIT + np.searchsorted(DIGITS, stop - begin, side="right") - 1, stop - begin)
    letter = (kinds >= SMALL) & (kinds <= LETTER)
    same = np.zeros(len(kinds), dtype=bool)
    same[RUN:] = letter[RUN:]
    for back in range(1, RUN + 1):
        same[RUN:] &= letter[RUN - back : len(letter) - back]
    # the first symbols of a text always stand
    for k in range(RUN):
        at = np.concatenate([[0], ends[:-1]]) + k
        same[at[at < len(same)]] = False
    first = np.flatnonzero(~same)
    return kinds[first], first, np.concatenate([[0], np.searchsorted(first, ends)])


class Tagger:
    def __init__(self, hidden: int = 12, seed: int = 5):
        draw = np.random.default_rng(seed)
        f = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
        k, h = N_LABELS, hidden
        self.hidden = h
        self.p = {"Wf": f(N_CLASSES, 4 * h), "Uf": f(h, 4 * h), "Wb": f(N_CLASSES, 4 * h), "Ub": f(h, 4 * h), "Vf": f(h, k), "Vb": f(h, k), "c": np.zeros(k, np.float32), "T": forbidden()}
        for w in ("Wf", "Wb"):
            self.p[w][:, h : 2 * h] += 0.4  # remember at first

    # ---- the network -------------------------------------------------------------------------------------------

    def run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, h) of class sequences x (T, B), from left for way f, from right for b."""
        h, w, u = self.hidden, self.p["W" + way], self.p["U" + way]
        steps, n = x.shape
        out = np.empty((steps, n, h), np.float32)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = state @ u
            z += w[x[t]]
            gates, g = z[:, : 3 * h] * np.float32(0.25), z[:, 3 * h :]
            gates += np.float32(0.5)
            if keep is not None:
                keep.append((t, z, cell, state))
            np.clip(gates, 0, 1, out=gates)
            cell = gates[:, h : 2 * h] * cell
            cell += gates[:, :h] * np.clip(g, -1, 1)
            state = np.clip(cell, -1, 1)
            state *= gates[:, 2 * h :]
            out[t] = state
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Label scores (T, labels, B)."""
        e = self.run(x, "f") @ self.p["Vf"]
        e += self.run(x, "b") @ self.p["Vb"]
        e += self.p["c"]
        return np.ascontiguousarray(e.transpose(0, 2, 1))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label sequences (T, B) by the Viterbi recursion; where a path came from is found again on the way back."""
        e, trans = self.scores(x), self.p["T"]
        for t in range(1, len(e)):
            e[t] += (e[t - 1][:, None, :] + trans[:, :, None]).max(axis=0)
        labels = np.empty(x.shape, np.uint8)
        now = e[-1].argmax(axis=0)
        labels[-1] = now
        for t in range(len(e) - 2, -1, -1):
            now = (e[t] + trans[:, now]).argmax(axis=0)
            labels[t] = now
        return labels

    # ---- training ----------------------------------------------------------------------------------------------

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood and its gradients on sequences x with labels y, both (T, B); class 0 is padding, label 0."""
        steps, n = x.shape
        kept_f, kept_b = [], []
        hf, hb = self.run(x, "f", kept_f), self.run(x, "b", kept_b)
        e = (hf @ self.p["Vf"] + hb @ self.p["Vb"] + self.p["c"]).astype(np.float64)
        trans = self.p["T"].astype(np.float64)

        def logsum(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + logsum(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - total[:, None])
        dt = np.zeros_like(trans)
        for t in range(1, steps):
            dt += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        rows = np.arange(n)
        gold = np.zeros(n)
        for t in range(steps):
            gold += e[t, rows, y[t]] + (trans[y[t - 1], y[t]] if t else 0)
            de[t, rows, y[t]] -= 1
        dt -= np.bincount(y[:-1].astype(int).ravel() * len(dt) + y[1:].ravel(), minlength=dt.size).reshape(dt.shape)
        de = (de / n).astype(np.float32)
        g = {"c": de.sum(axis=(0, 1)), "T": (dt / n).astype(np.float32)}
        for way, states, kept in (("f", hf, kept_f), ("b", hb, kept_b)):
            g["V" + way] = np.einsum("tbh,tbk->hk", states, de)
            g["W" + way], g["U" + way] = self._back(x, way, de @ self.p["V" + way].T, kept)
        return float((total - gold).mean()), g

    def _back(self, x: np.ndarray, way: str, dout: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        h, u = self.hidden, self.p["U" + way]
        dw, du, dzs = np.zeros_like(self.p["W" + way]), np.zeros_like(u), np.empty((*x.shape, 4 * h), u.dtype)
        dstate, dcell = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        slope = lambda z, low, high: np.where((z > low) & (z < high), 1.0, LEAK).astype(np.float32)
        for t, z, cell, before in reversed(kept):
            raw = 0.25 * z[:, : 3 * h] + 0.5
            gates, g = np.clip(raw, 0, 1), np.clip(z[:, 3 * h :], -1, 1)
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            new = f * cell + i * g
            dh = dout[t] + dstate
            dc = dcell + dh * o * slope(new, -1, 1)
            dz = np.concatenate([dc * g, dc * cell, dh * np.clip(new, -1, 1), dc * i], axis=1)
            dz[:, : 3 * h] *= 0.25 * slope(raw, 0, 1)
            dz[:, 3 * h :] *= slope(z[:, 3 * h :], -1, 1)
            dzs[t] = dz
            du += before.T @ dz
            dstate, dcell = np.clip(dz @ u.T, -1, 1), np.clip(dc * f, -1, 1)
        for c in range(len(dw)):
            dw[c] = dzs[x == c].sum(axis=0)
        return dw, du

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], length: int = 112, epochs: int = 6, batch: int = 96, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Trains on (classes, labels) sequences, cut or padded to ``length``, by Adam; the loss of each epoch."""
        x, y = np.zeros((length, len(sequences)), np.uint8), np.zeros((length, len(sequences)), np.uint8)
        for k, (a, b) in enumerate(sequences):
            x[: len(a), k], y[: len(b), k] = a[:length], b[:length]
        draw, m, v, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for epoch in range(epochs):
            order, total = draw.permutation(x.shape[1]), []
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                loss, g = self.gradients(x[:, some], y[:, some])
                total.append(loss)
                step += 1
                norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
                for k, d in g.items():
                    d = d * min(1.0, 2.0 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                    pace = rate * (1 - 0.8 * epoch / epochs)
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses


def tag(model: Tagger, texts: list[str], window: int = 256, overlap: int = 32, batch: int = 2048) -> list[tuple[int, int, int, int]]:
    """(text, start, end, kind) of all runs of one kind, by characters.

    Each text is cut into windows that overlap. Of two windows over a symbol the one decides in which it lies farther from
    the edge, so that labels over the whole text are one sequence and a run may cross windows. Every kind has digits or
    an at sign: windows without both are not decoded.
    """
    kinds, first, starts = symbols(texts)
    if not len(kinds):
        return []
    pace = window - overlap
    sizes = np.diff(starts)
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - overlap) // pace)), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[owner] + nth * pace
    size = np.minimum(window, starts[owner + 1] - begin)
    told = np.concatenate([[0], np.cumsum((kinds >= DIGIT) & (kinds < SMALL) | (kinds == 1))])
    labels = np.zeros(len(kinds), np.uint8)
    padded = np.concatenate([kinds, np.zeros(window, np.uint8)])
    steps = np.arange(window)[:, None]
    by_size = np.argsort(size, kind="stable")  # short windows together
    by_size = by_size[(told[begin + size] > told[begin])[by_size]]
    for at in range(0, len(by_size), batch):
        some = by_size[at : at + batch]
        longest = int(size[some].max())
        x = padded[begin[some] + steps[:longest]]
        x[steps[:longest] >= size[some]] = 0
        got = model.decode(x)
        low = np.where(nth[some] > 0, overlap // 2, 0)
        high = np.where(nth[some] + 1 < counts[owner[some]], window - overlap // 2, size[some])
        mine = (steps[:longest] >= low) & (steps[:longest] < high)
        labels[(begin[some] + steps[:longest])[mine]] = got[mine]
    if not labels.any():
        return []
    text_of = np.repeat(np.arange(len(texts)), sizes)
    kind = (labels + 1) // 2
    change = np.flatnonzero((kind[1:] != kind[:-1]) | (labels[1:] % 2 == 1) | (text_of[1:] != text_of[:-1])) + 1
    runs = np.concatenate([[0], change, [len(labels)]])
    ends = np.concatenate([first[1:], [sum(map(len, texts))]])
    chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = []
    for run in np.flatnonzero(kind[runs[:-1]]).tolist():
        a, b = int(runs[run]), int(runs[run + 1])
        k = int(text_of[a])
        out.append((k, int(first[a] - chars[k]), int(min(ends[b - 1], chars[k + 1]) - chars[k]), int(kind[a])))
    return out
