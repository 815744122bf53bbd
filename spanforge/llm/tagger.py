"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, scores and decoding."""

from __future__ import annotations

import numpy as np

#: Characters with an input of their own; other letters, digits outside ASCII, space and the rest have one each.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz@.+-()/:_%#,\"'= \n"
_CODE = np.zeros(0x110000, dtype=np.uint8)


def _build() -> None:
    first = len(ALPHABET) + 1
    for c in range(128):
        char = chr(c).lower()
        at = ALPHABET.find(char)
        _CODE[c] = at + 1 if at >= 0 else first
    _CODE[128:] = first + 1


_build()
INPUTS = len(ALPHABET) + 3


def codes(text: str) -> np.ndarray:
    """Input numbers of a text's code points; 0 is padding."""
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Emission scores from a BiLSTM, transitions of a linear-chain CRF."""

    def __init__(self, tags: int, hidden: int = 16, embed: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden

        def draw(*shape):
            return (rng.standard_normal(shape) * np.sqrt(1.0 / shape[0])).astype(np.float32)

        self.p = {"E": draw(INPUTS, embed) * 3, "T": np.zeros((tags, tags), np.float32), "V": draw(2 * hidden, tags), "c": np.zeros(tags, np.float32)}
        for side in "fb":
            self.p["W" + side] = draw(embed + hidden, 4 * hidden)
            self.p["b" + side] = np.zeros(4 * hidden, np.float32)
            self.p["b" + side][hidden : 2 * hidden] = 1

    # -- forward ------------------------------------------------------------

    def _run(self, x: np.ndarray, side: str, keep: bool):
        """Hidden states (time, window, hidden) of one direction over input codes (window, time)."""
        h_ = self.hidden
        weights, bias = self.p["W" + side], self.p["b" + side]
        embed = self.p["E"].shape[1]
        # the input's share of the gates depends on the character alone
        table = self.p["E"] @ weights[:embed] + bias
        recur = weights[embed:]
        n, steps = x.shape
        h = np.zeros((n, h_), np.float32)
        c = np.zeros((n, h_), np.float32)
        out = np.empty((steps, n, h_), np.float32)
        held = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = table[x[:, t]] + h @ recur
            ifo = _sigmoid(gates[:, : 3 * h_])
            g = np.tanh(gates[:, 3 * h_ :])
            before, c = c, ifo[:, h_ : 2 * h_] * c + ifo[:, :h_] * g
            tanh_c = np.tanh(c)
            if keep:
                held.append((t, h, before, ifo, g, tanh_c))
            h = ifo[:, 2 * h_ :] * tanh_c
            out[t] = h
        return out, held

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (window, time, tag)."""
        f, _ = self._run(x, "f", False)
        b, _ = self._run(x, "b", False)
        return (np.concatenate((f, b), axis=2) @ self.p["V"] + self.p["c"]).transpose(1, 0, 2)

    # -- training -----------------------------------------------------------

    def _gradients(self, x: np.ndarray, y: np.ndarray):
        f, held_f = self._run(x, "f", True)
        b, held_b = self._run(x, "b", True)
        both = np.concatenate((f, b), axis=2)
        scores = both @ self.p["V"] + self.p["c"]
        steps, n, k = scores.shape
        trans = self.p["T"]
        ahead = np.empty_like(scores)
        ahead[0] = scores[0]
        for t in range(1, steps):
            m = ahead[t - 1][:, :, None] + trans[None]
            top = m.max(axis=1)
            ahead[t] = scores[t] + top + np.log(np.exp(m - top[:, None]).sum(axis=1))
        back = np.zeros_like(scores)
        for t in range(steps - 2, -1, -1):
            m = trans[None] + (scores[t + 1] + back[t + 1])[:, None, :]
            top = m.max(axis=2)
            back[t] = top + np.log(np.exp(m - top[:, :, None]).sum(axis=2))
        top = ahead[-1].max(axis=1)
        norm = top + np.log(np.exp(ahead[-1] - top[:, None]).sum(axis=1))
        marginal = np.exp(ahead + back - norm[None, :, None])
        real = y.T
        d = marginal.copy()
        d[np.arange(steps)[:, None], np.arange(n)[None], real] -= 1
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            d_trans += np.exp(ahead[t - 1][:, :, None] + trans[None] + (scores[t] + back[t])[:, None, :] - norm[:, None, None]).sum(axis=0)
            np.subtract.at(d_trans, (real[t - 1], real[t]), 1)
        d /= n
        grads = {"T": d_trans / n, "V": np.einsum("tnh,tnk->hk", both, d), "c": d.sum(axis=(0, 1)), "E": np.zeros_like(self.p["E"])}
        d_both = d @ self.p["V"].T
        h_ = self.hidden
        embed = self.p["E"].shape[1]
        for side, held, part in (("f", held_f, d_both[:, :, :h_]), ("b", held_b, d_both[:, :, h_:])):
            weights = self.p["W" + side]
            d_table = np.zeros((INPUTS, 4 * h_), np.float32)
            d_recur = np.zeros((h_, 4 * h_), np.float32)
            d_h = np.zeros((n, h_), np.float32)
            d_c = np.zeros((n, h_), np.float32)
            for t, h, before, ifo, g, tanh_c in reversed(held):
                d_h = d_h + part[t]
                i, fo, o = ifo[:, :h_], ifo[:, h_ : 2 * h_], ifo[:, 2 * h_ :]
                d_c = d_c + d_h * o * (1 - tanh_c**2)
                d_gates = np.concatenate((d_c * g * i * (1 - i), d_c * before * fo * (1 - fo), d_h * tanh_c * o * (1 - o), d_c * i * (1 - g**2)), axis=1)
                np.add.at(d_table, x[:, t], d_gates)
                d_recur += h.T @ d_gates
                d_h = d_gates @ weights[embed:].T
                d_c = d_c * fo
            grads["W" + side] = np.concatenate((self.p["E"].T @ d_table, d_recur))
            grads["b" + side] = d_table.sum(axis=0)
            grads["E"] += d_table @ weights[:embed].T
        gold = scores[np.arange(steps)[:, None], np.arange(n)[None], real].sum(axis=0) + trans[real[:-1], real[1:]].sum(axis=0)
        return grads, float((norm - gold).mean())

    def fit(self, x: np.ndarray, y: np.ndarray, *, steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random batches of windows; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            grads, now = self._gradients(x[at], y[at])
            loss = now if step == 1 else 0.95 * loss + 0.05 * now
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            scale = min(1.0, 5.0 / (size + 1e-9))
            speed = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                self.p[k] -= (speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    # -- decoding -----------------------------------------------------------

    def decode(self, scores: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best tag path and the posterior probability of each of its tags, for emission scores (time, tag) of any lengths."""
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        for a in range(0, len(order), 256):
            part = order[a : a + 256]
            for i, found in zip(part, self._decode([scores[i] for i in part])):
                out[i] = found
        return out

    def _decode(self, scores: list[np.ndarray]):
        trans = self.p["T"].astype(np.float64)
        sizes = np.array([len(s) for s in scores])
        steps, n, k = int(sizes.max()), len(scores), self.tags
        e = np.zeros((steps, n, k))
        for i, s in enumerate(scores):
            e[: len(s), i] = s
        best, ahead = np.empty_like(e), np.empty_like(e)
        point = np.zeros((steps, n, k), dtype=np.int8)
        best[0] = ahead[0] = e[0]
        for t in range(1, steps):
            m = best[t - 1][:, :, None] + trans[None]
            point[t] = m.argmax(axis=1)
            best[t] = e[t] + m.max(axis=1)
            m = ahead[t - 1][:, :, None] + trans[None]
            top = m.max(axis=1)
            ahead[t] = e[t] + top + np.log(np.exp(m - top[:, None]).sum(axis=1))
        back = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            m = trans[None] + (e[t + 1] + back[t + 1])[:, None, :]
            top = m.max(axis=2)
            step = top + np.log(np.exp(m - top[:, :, None]).sum(axis=2))
            back[t] = np.where((t + 1 < sizes)[:, None], step, 0)
        for i, size in enumerate(sizes.tolist()):
            path = np.empty(size, dtype=np.int64)
            path[-1] = best[size - 1, i].argmax()
            for t in range(size - 1, 0, -1):
                path[t - 1] = point[t, i, path[t]]
            total = ahead[:size, i] + back[:size, i]
            total = np.exp(total - total.max(axis=1, keepdims=True))
            total /= total.sum(axis=1, keepdims=True)
            yield path, total[np.arange(size), path]
