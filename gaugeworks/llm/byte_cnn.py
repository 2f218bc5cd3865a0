"""A byte-level convolutional network in numpy.

Filters of several widths slide over fixed-length windows of UTF-8 bytes. Each filter is max-pooled over its window, and a softmax
layer turns the pooled values into class log-probabilities. Windows of a text overlap and cover it whole; a text's log-probabilities
are the mean over its windows. A filter of width w over one-hot bytes is a sum of w table lookups; for scoring, two neighbouring
lookups are fused into one table over byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 512
STRIDE = 448
#: Windows scored at once: bounds memory to a few MB whatever the batch.
SLAB = 96


def window_starts(length: int) -> np.ndarray:
    """Starts of the windows that cover `length` bytes; the last one ends with the text."""
    if length <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, length - WINDOW + STRIDE, STRIDE, dtype=np.int64)
    return np.minimum(starts, length - WINDOW)


def windows_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slabs of windows, zero-padded to WINDOW bytes, with the number of the text that each belongs to. Empty texts have none."""
    full = np.where(lengths > WINDOW, -(-(lengths - WINDOW) // STRIDE) + 1, np.minimum(lengths, 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), full)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    inside = np.minimum(rank * STRIDE, np.maximum(lengths[owner] - WINDOW, 0))
    at, span = np.arange(WINDOW), np.minimum(lengths, WINDOW)
    for lo in range(0, len(owner), SLAB):
        own, off = owner[lo : lo + SLAB], inside[lo : lo + SLAB]
        index = (starts[own] + off)[:, None] + at
        mask = at >= span[own][:, None]
        index[mask] = 0
        out = data[index]
        out[mask] = 0
        yield out, own


class ByteCnn:
    def __init__(self, classes: int, widths: tuple[int, ...] = (2, 4), filters: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters, self.classes = widths, filters, classes
        self.w = [rng.normal(0, 0.3 / np.sqrt(k), (k, 256, filters)).astype(np.float32) for k in widths]
        self.b = [np.zeros(filters, np.float32) for _ in widths]
        self.v = rng.normal(0, 0.2, (filters * len(widths), classes)).astype(np.float32)
        self.c = np.zeros(classes, np.float32)
        self._pairs: list[list[np.ndarray]] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> ByteCnn:
        """Adam on cross-entropy. Max pooling sends each filter's gradient to one position of a window."""
        params = [*self.w, *self.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, step, total = np.random.default_rng(seed), 0, max(1, epochs * -(-len(windows) // batch))
        groups = len(self.widths)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                x, y = windows[order[lo : lo + batch]].astype(np.int64), labels[order[lo : lo + batch]]
                rows, pooled, spots = np.arange(len(x)), [], []
                for w, b, k in zip(self.w, self.b, self.widths, strict=True):
                    out = w[0][x[:, : WINDOW - k + 1]]
                    for j in range(1, k):
                        out += w[j][x[:, j : WINDOW - k + 1 + j]]
                    spot = out.argmax(axis=1)
                    spots.append(spot)
                    pooled.append(np.take_along_axis(out, spot[:, None, :], 1)[:, 0, :] + b)
                pre = np.concatenate(pooled, axis=1)
                hidden = np.maximum(pre, 0)
                p = _softmax(hidden @ self.v + self.c)
                p[rows, y] -= 1
                p /= len(x)
                back = (p @ self.v.T) * (pre > 0)
                grads: list[np.ndarray] = []
                for g, (w, k) in enumerate(zip(self.w, self.widths, strict=True)):
                    d, gw = back[:, g * self.filters : (g + 1) * self.filters], np.zeros_like(w)
                    for j in range(k):
                        np.add.at(gw[j], (x[rows[:, None], spots[g] + j], np.arange(self.filters)[None, :]), d)
                    grads.append(gw)
                grads += [back[:, g * self.filters : (g + 1) * self.filters].sum(0) for g in range(groups)]
                grads += [hidden.T @ p + 1e-4 * self.v, p.sum(0)]
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for q, g, a, z in zip(params, grads, m, s, strict=True):
                    a += 0.1 * (g - a)
                    z += 0.01 * (g * g - z)
                    q -= now * (a / (1 - 0.9**step)) / (np.sqrt(z / (1 - 0.99**step)) + 1e-6)
        return self

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        if self._pairs is None:
            self._pairs = [[np.ascontiguousarray((w[j][:, None, :] + ((w[j + 1] if j + 1 < k else np.zeros((256, self.filters), np.float32))[None, :, :])).transpose(2, 0, 1).reshape(self.filters, -1)) for j in range(0, k, 2)] for w, k in zip(self.w, self.widths, strict=True)]
        pair = windows.astype(np.intp) << 8  # the last column has no right neighbour; only lookups of a single byte read it
        pair[:, :-1] |= windows[:, 1:]
        pooled = []
        for tables, b, k in zip(self._pairs, self.b, self.widths, strict=True):
            n = WINDOW - k + 1
            cut = [np.ascontiguousarray(pair[:, 2 * j : 2 * j + n]) for j in range(len(tables))]
            for f in range(self.filters):
                out = tables[0][f].take(cut[0])
                for t, at in zip(tables[1:], cut[1:], strict=True):
                    out += t[f].take(at)
                pooled.append(out.max(axis=1) + b[f])
        z = np.maximum(np.stack(pooled, axis=1), 0) @ self.v + self.c
        return z - _logsumexp(z)

    def text_log_probs(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean log-probabilities over each text's windows, normalised; those of an empty text come from one window of zeros."""
        total, count = np.zeros((len(lengths), self.classes)), np.zeros(len(lengths))
        for windows, own in windows_of(data, starts, lengths):
            np.add.at(total, own, self.log_probs(windows))
            np.add.at(count, own, 1)
        if (empty := count == 0).any():
            total[empty], count[empty] = self.log_probs(np.zeros((1, WINDOW), np.uint8))[0], 1
        mean = total / count[:, None]
        return mean - _logsumexp(mean)


def sample_windows(text: bytes, most: int, seed: int) -> list[bytes]:
    """Up to `most` of a text's windows, chosen by `seed`, zero-padded."""
    starts = window_starts(len(text))
    if len(starts) > most:
        starts = np.sort(np.random.default_rng(seed).choice(starts, most, replace=False))
    return [text[s : s + WINDOW].ljust(WINDOW, b"\0") for s in starts]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logsumexp(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1, keepdims=True)
    return top + np.log(np.exp(z - top).sum(axis=1, keepdims=True))
