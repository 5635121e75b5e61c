"""A linear-chain conditional random field in numpy: scaled forward-backward training and exact, pruned Viterbi.

Tokens have a fixed number of features each, given as numbers into one table of weights; a chain is a run of tokens.
Label 0 is outside. Training goes over padded windows that begin and end outside.

Most tokens can be nothing but outside: where outside leads every other label by more than the neighbouring transitions
could ever return, it is on every best path, and the chain may be cut there. Labels are struck out a few rounds long, as
far as the labels left to the neighbours allow it. Viterbi runs over the stretches between the cuts, many at a time.
"""

from __future__ import annotations

import numpy as np


class Chain:
    """Emission weights [feature, label] and transitions [label, label]."""

    def __init__(self, features: int, labels: int):
        self.emission = np.zeros((features, labels), np.float32)
        self.step = np.zeros((labels, labels))
        self.trained = False

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Scores [token, label] of feature numbers [token, slot]."""
        out = np.zeros((len(features), self.emission.shape[1]), np.float32)
        for k in range(features.shape[1]):
            out += self.emission[features[:, k]]
        return out

    def fit(self, features: np.ndarray, mask: np.ndarray, label: np.ndarray, steps: int = 120, rate: float = 0.3, decay: float = 3e-4, single: float = 1.0) -> Chain:
        """AdaGrad on the log likelihood of the chains plus ``single`` times that of tokens by themselves; arrays are [window, position(, slot)].

        The second term leaves less of the telling to transitions, so that tokens of no kind stand clear of every other label.
        """
        n, width = mask.shape
        k = len(self.step)
        used, flat = np.unique(features[mask], return_inverse=True)  # of the tokens there are
        flat = flat.reshape(-1, features.shape[2])
        weights = np.zeros((len(used), k))
        total = max(1, int(mask.sum()))
        square, square_step = np.zeros_like(weights), np.zeros((k, k))
        onehot = np.eye(k)[label] * mask[..., None]
        before = np.concatenate([np.zeros((n, 1), int), label[:, :-1]], 1)
        seen_step = np.zeros((k, k))
        np.add.at(seen_step, (before[mask], label[mask]), 1)
        size = mask.sum(1)
        last = label[np.arange(n), np.maximum(size, 1) - 1][size > 0]
        np.add.at(seen_step, (last, np.zeros(len(last), int)), 1)
        for _ in range(steps):
            e = np.zeros((n, width, k))
            e[mask] = sum(weights[flat[:, j]] for j in range(flat.shape[1]))
            e = np.exp(e - e.max(2, keepdims=True))
            alone = e[mask]
            alone /= alone.sum(1, keepdims=True)
            move = np.exp(self.step)
            fwd, bwd = np.empty((n, width, k)), np.empty((n, width, k))
            now = np.zeros((n, k))
            now[:, 0] = 1
            for t in range(width):
                new = (now @ move) * e[:, t]
                new /= new.sum(1, keepdims=True)
                now = np.where(mask[:, t, None], new, now)
                fwd[:, t] = now
            after = np.repeat(move[:, 0][None], n, 0)  # outside follows a window
            for t in range(width - 1, -1, -1):
                bwd[:, t] = after
                new = (e[:, t] * after) @ move.T
                new /= new.sum(1, keepdims=True)
                after = np.where(mask[:, t, None], new, after)
            p = fwd * bwd
            p = p / p.sum(2, keepdims=True) * mask[..., None]
            want = np.zeros((k, k))
            for t in range(width):
                left, right = fwd[:, t - 1] if t else np.eye(k)[[0] * n], e[:, t] * bwd[:, t]
                norm = ((left @ move) * right).sum(1)
                want += ((left * (mask[:, t] / norm)[:, None]).T @ right) * move
            want[:, 0] += p[np.arange(n), np.maximum(size, 1) - 1][size > 0].sum(0)
            miss = (onehot - p)[mask] + single * (onehot[mask] - alone)
            g = np.stack([sum(np.bincount(flat[:, j], miss[:, y], len(used)) for j in range(flat.shape[1])) for y in range(k)], 1)
            g = g / total - decay * weights / 10
            square += g**2
            weights += rate * g / (np.sqrt(square) + 1e-8)
            g = (seen_step - want) / total - decay * self.step / 10
            square_step += g**2
            self.step += rate * g / (np.sqrt(square_step) + 1e-8)
        self.emission[used] = weights
        self.trained = True
        self.prepare()
        return self

    def prepare(self) -> None:
        """The most that transitions can add to each label over outside, whatever the neighbours are."""
        s = self.step
        self.most_gain = ((s - s[:, :1]).max(0) + (s - s[0]).max(1))[1:].astype(np.float32) + np.float32(1e-3)

    def _narrowed(self, open_: np.ndarray, e: np.ndarray, row: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The tokens, with their scores, that may have another label than 0, given what their neighbours may have."""
        s = self.step
        left, right = (s - s[:, :1]).astype(np.float32), (s.T - s[0][:, None]).astype(np.float32)  # [neighbour, label]: what a label before, or after, adds to this label over outside
        may = np.ones(e.shape, bool)
        for _ in range(rounds):
            n = len(open_)
            if not n:
                break
            beside = np.zeros(n, bool)
            beside[1:] = (np.diff(open_) == 1) & (row[open_[1:]] == row[open_[:-1]])
            gain = np.zeros(e.shape, np.float32)
            for by, table in ((1, left), (-1, right)):
                near = np.zeros(e.shape, bool)
                near[:, 0] = True
                if by == 1:
                    near[1:] |= may[:-1] & beside[1:, None]
                else:
                    near[:-1] |= may[1:] & beside[1:, None]
                most = np.full(e.shape, -np.inf, np.float32)
                for a in range(e.shape[1]):
                    some = np.flatnonzero(near[:, a])
                    most[some] = np.maximum(most[some], table[a])
                gain += most
            may &= e + gain >= e[:, :1] - 1e-3
            may[:, 0] = True
            keep = may[:, 1:].any(1)
            open_, e, may = open_[keep], e[keep], may[keep]
        return open_, e

    def tag(self, features: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best label of every token; rows are chains of their own that begin and end outside."""
        label = np.zeros(len(row), np.int8)
        if not len(row) or not self.trained:
            return label
        e = self.scores(features)
        open_ = np.flatnonzero((e[:, 1:] + self.most_gain >= e[:, :1]).any(1))
        open_, e = self._narrowed(open_, e[open_], row)
        if not len(open_):
            return label
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | (row[open_[1:]] != row[open_[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(open_)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        best = e[first] + self.step[0]
        final = np.empty((len(first), e.shape[1]))
        back: list[np.ndarray] = []
        live = len(first)
        for t in range(1, int(size[0]) + 1):
            keep = int(np.searchsorted(-size, -t, "left"))  # stretches longer than t
            final[keep:live] = best[keep:live]
            if not keep:
                break
            z = best[:keep, :, None] + self.step
            back.append(z.argmax(1).astype(np.int8))
            best = z.max(1) + e[first[:keep] + t]
            live = keep
        last = (final + self.step[:, 0]).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            keep = int(np.searchsorted(-size, -t, "left"))
            label[open_[first[:keep] + t]] = last[:keep]
            if t:
                last[:keep] = back[t - 1][np.arange(keep), last[:keep]]
        return label


def windows(chains: list[tuple[np.ndarray, np.ndarray]], width: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, mask, label) as ``fit`` takes them, from (features [token, slot], label [token]) of short chains; longer ones are cut outside."""
    parts = []
    for f, y in chains:
        at = 0
        while at < len(y):
            end = min(at + width, len(y))
            while end < len(y) and end > at + 1 and (y[end] or y[end - 1]):
                end -= 1
            parts.append((f[at:end], y[at:end]))
            at = end
    slots = parts[0][0].shape[1] if parts else 1
    feats, label, mask = np.zeros((len(parts), width, slots), np.int32), np.zeros((len(parts), width), int), np.zeros((len(parts), width), bool)
    for i, (f, y) in enumerate(parts):
        feats[i, : len(y)], label[i, : len(y)], mask[i, : len(y)] = f, y, True
    return feats, mask, label
