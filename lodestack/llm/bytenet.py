"""A byte convolutional network for languages, in numpy.

Multi-width filters over embedded bytes, max pooling over a fixed-length window,
a rectifier and softmax.  It is trained on labelled text and applied to batches
of windows; for that the filters become 8-bit tables over byte pairs, so a
window costs a few table look-ups a byte.
"""

from __future__ import annotations

import unicodedata

import numpy as np

WINDOW = 64
STEP = 56  # windows of a text overlap by the reach of a filter
WIDTHS = (2, 4, 6)
FILTERS = 16
DIM = 8


def clean(text: str) -> bytes:
    """What the network sees of a text: lower case, one digit for all digits."""
    return text.lower().encode("utf-8", "replace").translate(_DIGITS)


_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)


def windows(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows that cover the pieces ``data[starts:ends]`` whole.

    Returns the bytes (windows x WINDOW, zero beyond a piece), the piece of each
    window and how many bytes of it the window holds.
    """
    length = ends - starts
    many = np.maximum(1, -(-(length - (WINDOW - STEP)) // STEP))
    piece = np.repeat(np.arange(len(starts)), many)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    at = starts[piece] + nth * STEP
    held = np.minimum(WINDOW, ends[piece] - at)
    buffer = np.frombuffer(data + bytes(WINDOW), np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[at].copy()
    out[np.arange(WINDOW)[None, :] >= held[:, None]] = 0
    return out, piece, held


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.rng = rng
        self.emb = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.filters = {w: rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        self.tables: list | None = None

    # --- training -----------------------------------------------------------

    def _params(self) -> list[np.ndarray]:
        return [self.emb, *self.filters.values(), *self.bias.values(), self.out, self.out_bias]

    def _step(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of a batch of windows; ``keep`` drops features."""
        e = self.emb[x]
        pooled, where = [], []
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * DIM)
            z = cols @ self.filters[w]
            p = z.argmax(1)
            pooled.append(np.take_along_axis(z, p[:, None], 1)[:, 0] + self.bias[w])
            where.append(p)
        h = np.maximum(np.concatenate(pooled, 1), 0) * keep
        logits = h @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        loss = -np.log(prob[np.arange(len(y)), y] + 1e-9).mean()
        d = prob
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g_out, g_out_bias = h.T @ d, d.sum(0)
        dh = (d @ self.out.T) * keep * (h > 0)
        g_emb, g_f, g_b = np.zeros_like(self.emb), [], []
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g_b.append(g.sum(0))
            at = where[k][:, :, None] + np.arange(w)  # batch, filter, offset: only the pooled place learns
            seen = x[rows[:, :, None], at]
            g_f.append(np.einsum("bf,bfwd->wdf", g, self.emb[seen]).reshape(w * DIM, FILTERS))
            push = g[:, :, None, None] * self.filters[w].reshape(w, DIM, FILTERS).transpose(2, 0, 1)[None]
            for dim in range(DIM):
                g_emb[:, dim] += np.bincount(seen.ravel(), push[..., dim].ravel(), 256).astype(np.float32)
        g_emb[0] = 0
        return loss, [g_emb, *g_f, *g_b, g_out, g_out_bias]

    def fit(self, texts: list[str], labels: list[str], steps: int = 900, batch: int = 160) -> "ByteNet":
        """Adam over windows cut at random; a part of them without accents."""
        rng = self.rng
        of = {c: i for i, c in enumerate(self.labels)}
        plain = ["".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in texts]
        data = [clean(t) for t in texts]
        bare = [clean(t) for t in plain]
        y_all = np.array([of[c] for c in labels])
        by_label = [np.flatnonzero(y_all == i) for i in range(len(self.labels))]
        by_label = [b for b in by_label if len(b)]
        weight = [np.array([len(data[i]) for i in b], float) for b in by_label]
        upto = [(np.cumsum(w) / w.sum())[:-1] for w in weight]
        m = [np.zeros_like(p) for p in self._params()]
        v = [np.zeros_like(p) for p in self._params()]
        for t in range(1, steps + 1):
            x = np.zeros((batch, WINDOW), np.uint8)
            y = np.empty(batch, np.int64)
            classes, dice = rng.integers(0, len(by_label), batch), rng.random((3, batch))
            for b, c in enumerate(classes):
                i = by_label[c][np.searchsorted(upto[c], dice[0, b])]
                s = bare[i] if dice[1, b] < 0.1 and self.labels[y_all[i]] not in ("ja", "zh", "ru") else data[i]
                size = WINDOW if dice[2, b] < 0.7 else 24 + int((dice[2, b] - 0.7) / 0.3 * (WINDOW - 24))
                at = int(dice[1, b] * 1e6) % max(1, len(s) - size + 1)
                piece = s[at : at + size]
                x[b, : len(piece)] = np.frombuffer(piece, np.uint8)
                y[b] = y_all[i]
            keep = (rng.random((batch, len(WIDTHS) * FILTERS)) > 0.2).astype(np.float32) / 0.8
            _, grads = self._step(x, y, keep)
            rate = 0.01 * (1 - t / (steps + 1)) + 2e-4
            for p, g, a, s2 in zip(self._params(), grads, m, v):
                a += 0.1 * (g - a)
                s2 += 0.01 * (g * g - s2)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s2 / (1 - 0.99**t)) + 1e-8)
        self._compile()
        return self

    def save(self, path: str, digest: bytes) -> None:
        """Keep what was learned, with the digest of what it was learned from."""
        with open(path, "wb") as f:
            np.savez(f, *self._params(), labels=np.array(self.labels), digest=np.frombuffer(digest, np.uint8))

    @classmethod
    def load(cls, path: str, digest: bytes) -> "ByteNet | None":
        """What was kept, or None: no such file, or learned from other rows."""
        try:
            with np.load(path) as kept:
                if kept["digest"].tobytes() != digest:
                    return None
                net = cls([str(x) for x in kept["labels"]])
                for k, p in enumerate(net._params()):
                    p[...] = kept[f"arr_{k}"]
        except OSError:
            return None
        net._compile()
        return net

    # --- application --------------------------------------------------------

    def _compile(self) -> None:
        """Byte-pair tables of 16 8-bit responses; sums of a filter's pairs fit in 8 bits."""
        self.tables, self.scale = [], {}
        for w in WIDTHS:
            parts = [self.emb @ self.filters[w][k * DIM : (k + 1) * DIM] for k in range(w)]
            pairs = [(a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS) for a, b in zip(parts[::2], parts[1::2])]
            top = sum(np.abs(p).max(0) for p in pairs)
            self.scale[w] = 126 / np.maximum(top, 1e-6)
            self.tables.append([np.ascontiguousarray(np.rint(p * self.scale[w]).astype(np.int8)).view(np.complex128).ravel() for p in pairs])

    def log_probs(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Log probabilities of the labels for each window."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), block):
            part = np.ascontiguousarray(x[i : i + block].T)
            n = part.shape[1]
            pair = part[:-1].astype(np.uint16) << 8
            pair |= part[1:]
            feats = []
            for w, tables in zip(WIDTHS, self.tables):
                best = np.full((n, FILTERS), -128, np.int8)
                for p in range(WINDOW - w + 1):
                    r = tables[0][pair[p]].view(np.int8).reshape(n, FILTERS)
                    for k in range(1, len(tables)):
                        r += tables[k][pair[p + 2 * k]].view(np.int8).reshape(n, FILTERS)
                    np.maximum(best, r, out=best)
                feats.append(best / self.scale[w] + self.bias[w])
            h = np.maximum(np.concatenate(feats, 1).astype(np.float32), 0)
            logits = h @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            out[i : i + block] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out
