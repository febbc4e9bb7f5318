"""A causal self-attention language model over subword ids, in numpy: training, and scoring in overlapping windows.

One attention layer with a learned bias by distance; the hidden state joins the attended values with embeddings of the
current and the previous id, and predicts the next one in two steps, its class and then its place in that class
(frequent ids are in small classes), so that a token costs some sixty outputs instead of thousands.
"""

from __future__ import annotations

import math

import numpy as np

#: Ids of a window; fresh ones of each but the first: every id is predicted once, with WINDOW - STRIDE ids before it at least.
WINDOW, STRIDE = 32, 24
DIM, KEYS, HIDDEN = 32, 16, 48
#: Sizes of classes with how many of each; the last size repeats as needed.
CLASSES = ((8, 16), (16, 8), (64, 8), (256, 8), (1024, 8))
#: Batches of windows in training, windows a batch, learning rate.
STEPS, BATCH, RATE = 1000, 96, 8e-3
#: Windows scored at once.
SCORED = 768


class Vocabulary:
    """Model ids: 0 start, 1 end, 2 any id that isn't kept, then kept ids by falling count. Classes hold consecutive model ids.

    All ids that occur are kept, unless `keep` says how many.
    """

    def __init__(self, counts: dict[int, int], n_ids: int, docs: int, keep: int | None = None):
        order = sorted(counts, key=lambda i: (-counts[i], i))
        kept = order[:keep]
        self.of = np.full(n_ids, 2, np.int32)
        self.of[kept] = np.arange(3, 3 + len(kept))
        rest = sum(counts[i] for i in order[keep:])
        free = n_ids - len(kept)
        # Log-probability of an id that isn't kept, given that it is none of the kept: add-one over all such ids.
        self.other = np.full(n_ids, -math.log(max(1, rest + free)), np.float64)
        for i in order[keep:]:
            self.other[i] = math.log((counts[i] + 1) / (rest + free))
        self.size = 3 + len(kept)
        self.unigram = np.log(np.array([1e-9, docs + 1, rest + 1, *[counts[i] for i in kept]], float))
        bounds = [1]  # the start is never predicted
        for size, n in CLASSES:
            for _ in range(n):
                if bounds[-1] < self.size:
                    bounds.append(min(self.size, bounds[-1] + size))
        while bounds[-1] < self.size:
            bounds.append(min(self.size, bounds[-1] + CLASSES[-1][0]))
        self.bounds = np.array(bounds)
        self.class_of = np.searchsorted(self.bounds, np.arange(self.size), side="right") - 1  # -1 for the start


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of so many inputs each: (sequence, first input, first predicted place) of every window."""
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    seq = np.repeat(np.arange(len(lengths)), more + 1)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    return seq, nth * STRIDE, np.where(nth > 0, WINDOW - STRIDE, 0)


_MASK = np.tril(np.ones((WINDOW, WINDOW), bool))
_APART = np.clip(np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW)), 0, WINDOW - 1)


#: Weights that are moved on at a time, so that what belongs to them stays in the processor's cache.
MOVED = 1 << 14


def _scattered(ids: np.ndarray, places: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds up the rows of each id at its place of a table of zeros. places: (table, rows), the rows in the order of the ids."""
    distinct, at = np.unique(ids, return_inverse=True)
    for out, rows in places:
        out[distinct] = np.stack([np.bincount(at, x, len(distinct)) for x in rows.T], axis=1)


class Model:
    def __init__(self, vocabulary: Vocabulary, seed: int = 5):
        rng, v = np.random.default_rng(seed), vocabulary
        self.v, self._kept = v, {}
        n = v.size
        g = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"q": g(n, KEYS), "k": g(n, KEYS), "val": g(n, DIM), "near": np.zeros(WINDOW, np.float32), "wo": g(DIM, HIDDEN), "now": g(n, HIDDEN), "prev": g(n, HIDDEN), "b": np.zeros(HIDDEN, np.float32)}
        mass = np.logaddexp.reduceat(v.unigram, v.bounds[:-1])
        self.p |= {"wc": g(HIDDEN, len(mass)), "bc": (mass - np.logaddexp.reduce(mass)).astype(np.float32), "wt": g(n, HIDDEN), "bt": v.unigram.astype(np.float32)}

    def __getstate__(self):
        return {"v": self.v, "p": self.p, "_kept": {}}

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_weights(self, flat: np.ndarray) -> Model:
        out, at = object.__new__(Model), 0
        out.v, out.p, out._kept = self.v, {}, {}
        for k in sorted(self.p):
            w = self.p[k]
            out.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return out

    def _room(self, name: str, *shape: int, kind=np.float32) -> np.ndarray:
        """An array that every call uses anew: fresh memory for each batch costs more than the sums."""
        size = math.prod(shape)
        if name not in self._kept or self._kept[name].size < size:
            self._kept[name] = np.empty(size, kind)
        return self._kept[name][:size].reshape(shape)

    def _scoring(self) -> dict[str, np.ndarray]:
        """The weights as scoring takes them: a hidden unit more that is always one carries the biases; a class's are less its largest."""
        p, v = self.p, self.v
        if "scoring" not in self._kept:
            wide = lambda w, x: np.hstack([w, np.full((len(w), 1), x, np.float32)])
            bias = p["bt"].copy()
            bias[v.bounds[0] :] -= np.repeat(np.maximum.reduceat(bias[v.bounds[0] :], v.bounds[:-1] - v.bounds[0]), np.diff(v.bounds))
            self._kept["scoring"] = {"q": p["q"], "k": p["k"], "val": wide(p["val"], 1), "wo": wide(p["wo"], 0), "now": wide(p["now"] + p["b"], 1), "prev": wide(p["prev"], 0), "wc": np.vstack([p["wc"], p["bc"]]), "wt": np.hstack([p["wt"], bias[:, None]])}
        return self._kept["scoring"]

    def hidden(self, x: np.ndarray, keep: dict | None = None, skip: int = 0) -> np.ndarray:
        """Hidden units at each place of x (model ids, windows x WINDOW) but the first `skip` of a window, and a one; without it if training keeps what led to them. The result holds until the next call."""
        p = self._scoring() if keep is None else self.p
        (n, w), fresh = x.shape, np.ascontiguousarray(x[:, skip:])
        before = self._room("before", *fresh.shape, kind=x.dtype)
        before[:, 0] = x[:, skip - 1] if skip else 0
        before[:, 1:] = fresh[:, :-1]
        rows = lambda name, t, i: np.take(p[t], i.ravel(), axis=0, out=self._room(name, i.size, p[t].shape[1]), mode="clip")
        q, k, val = rows("q", "q", fresh).reshape(n, w - skip, -1), rows("k", "k", x).reshape(n, w, -1), rows("val", "val", x).reshape(n, w, -1)
        bias = np.where(_MASK, self.p["near"][_APART], np.float32(-60))[skip:]
        a = np.matmul(q, k.transpose(0, 2, 1), out=self._room("a", n, w - skip, w))
        a *= np.float32(1 / math.sqrt(KEYS))
        a += bias
        np.exp(a, out=a)  # logits are small: no maximum needed
        if keep is not None:
            a /= a.sum(axis=2, keepdims=True)
        o = np.matmul(a, val, out=self._room("o", n, w - skip, val.shape[2]))
        if keep is None:  # the ones beside the values have summed the weights
            o[..., :DIM] /= o[..., DIM:]
        h = np.matmul(o.reshape(fresh.size, -1)[:, :DIM], p["wo"], out=self._room("h", fresh.size, p["wo"].shape[1]))
        h += rows("row", "now", fresh)
        h += rows("row", "prev", before)
        if keep is not None:
            h += p["b"]
        np.maximum(h, 0, out=h)
        if keep is not None:
            keep |= {"q": q, "k": k, "val": val, "a": a, "o": o, "before": before, "h": h}
        return h

    def log_probs(self, h: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each target. h: what hidden() gives for scoring, of which these rows count (all, if not given)."""
        v, n = self.v, len(y)
        wc, wt = self._scoring()["wc"], self._scoring()["wt"]
        own = v.class_of[y]
        order = np.argsort(own.astype(np.int16), kind="stable")  # by class: each is then a slice
        x = np.take(h, order if rows is None else rows[order], axis=0, out=self._room("sorted", n, HIDDEN + 1), mode="clip")
        y, own = y[order], own[order]
        cuts = np.searchsorted(own, np.arange(len(v.bounds)))
        z = np.matmul(x, wc, out=self._room("z", n, wc.shape[1]))
        got = z[np.arange(n), own].astype(np.float64)
        np.exp(z, out=z)
        mass = z @ np.ones(z.shape[1], np.float32)
        for c in range(len(cuts) - 1):
            s, e, a, b = cuts[c], cuts[c + 1], v.bounds[c], v.bounds[c + 1]
            if e > s and b - a > 1:
                z = np.matmul(x[s:e], wt[a:b].T, out=self._room("t", e - s, b - a))
                got[s:e] += z.ravel()[np.arange(0, z.size, b - a) + (y[s:e] - a)]
                np.exp(z, out=z)
                mass[s:e] *= z @ np.ones(b - a, np.float32)
        got -= np.log(mass)
        out = np.empty_like(got)
        out[order] = got
        return out

    def token_scores(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of each id, and of the end, of documents given as model ids without start and end, one after the other; and where each document's begin."""
        lengths = np.array([len(d) for d in docs], np.int64) + 1
        flat = np.empty(int(lengths.sum()), np.int32)
        starts = np.cumsum(lengths) - lengths
        for s, d in zip(starts, docs):
            flat[s] = 0
            flat[s + 1 : s + 1 + len(d)] = d
        target = np.empty_like(flat)
        target[:-1] = flat[1:]
        target[starts + lengths - 1] = 1
        seq, first, fresh = _windows(lengths)
        out, step = np.zeros(len(flat)), np.arange(WINDOW)
        for skip in np.unique(fresh).tolist():  # windows whose first ids are context alone, and those without such
            some = np.flatnonzero(fresh == skip)
            for at in range(0, len(some), SCORED):
                s, f = seq[some[at : at + SCORED]], first[some[at : at + SCORED]]
                inside = f[:, None] + step[None, :] < lengths[s][:, None]
                place = np.where(inside, starts[s][:, None] + f[:, None] + step[None, :], 0)
                h = self.hidden(np.where(inside, flat[place], 0), skip=skip)
                take = np.flatnonzero(inside[:, skip:].ravel())
                place = place[:, skip:].ravel()[take]
                out[place] = self.log_probs(h, target[place], take)
        return out, starts

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each document."""
        found, starts = self.token_scores(docs)
        return np.add.reduceat(found, starts) if len(docs) else np.zeros(0)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """A row as long as all weights, as tables like theirs."""
        out, at = {}, 0
        for k, w in self.p.items():
            out[k] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, g: dict | None = None) -> tuple[float, dict]:
        """The loss, and the gradients in g, which holds zeros (fresh tables, if not given)."""
        p, v, mid = self.p, self.v, {}
        h = self.hidden(x, mid)
        n, g = max(1, int(keep.sum())), {k: np.zeros_like(w) for k, w in p.items()} if g is None else g
        rows = np.flatnonzero(keep)
        own = v.class_of[y.ravel()[rows]]
        order = np.argsort(own.astype(np.int16), kind="stable")  # by class: each is then a slice
        rows, own = rows[order], own[order]
        hk, yk, each = h[rows], y.ravel()[rows], np.arange(len(rows))
        cuts = np.searchsorted(own, np.arange(len(v.bounds)))
        z = np.matmul(hk, p["wc"], out=self._room("z", len(rows), len(v.bounds) - 1))
        z += p["bc"]
        z -= z.max(axis=1, keepdims=True)
        got = z[each, own].astype(np.float64)
        np.exp(z, out=z)
        mass = z @ np.ones(z.shape[1], np.float32)
        z *= (1 / (n * mass))[:, None]
        z[each, own] -= np.float32(1 / n)
        g["wc"][:], g["bc"][:] = hk.T @ z, z.sum(axis=0)
        dh = z @ p["wc"].T
        for c in range(len(cuts) - 1):
            s, e, a, b = cuts[c], cuts[c + 1], v.bounds[c], v.bounds[c + 1]
            if e > s and b - a > 1:
                wt = p["wt"][a:b]
                t = np.matmul(hk[s:e], wt.T, out=self._room("t", e - s, b - a))
                t += p["bt"][a:b]
                t -= t.max(axis=1, keepdims=True)
                true = np.arange(0, t.size, b - a) + (yk[s:e] - a)
                got[s:e] += t.ravel()[true]
                np.exp(t, out=t)
                total = t @ np.ones(b - a, np.float32)
                mass[s:e] *= total
                t *= (1 / (n * total))[:, None]
                t.ravel()[true] -= np.float32(1 / n)
                np.matmul(t.T, hk[s:e], out=g["wt"][a:b])
                g["bt"][a:b] = t.sum(axis=0)
                dh[s:e] += t @ wt
        loss = np.log(mass).sum(dtype=np.float64) - got.sum()
        dh *= hk > 0
        full = self._room("full", *h.shape)
        full[:] = 0
        full[rows] = dh
        g["b"][:] = dh.sum(axis=0)
        _scattered(mid["before"].ravel()[rows], [(g["prev"], dh)])
        o = mid["o"].reshape(-1, DIM)
        g["wo"][:] = o.T @ full
        do = (full @ p["wo"].T).reshape(mid["o"].shape)
        a = mid["a"]
        val = (a.transpose(0, 2, 1) @ do).reshape(-1, DIM)
        ds = np.matmul(do, mid["val"].transpose(0, 2, 1), out=self._room("ds", *a.shape))
        ds -= (do * mid["o"]).sum(axis=2, keepdims=True)  # the sum of ds * a, since o is a @ val
        ds *= a
        g["near"] += np.bincount(_APART[_MASK], ds.sum(axis=0)[_MASK], WINDOW).astype(np.float32)
        ds *= np.float32(1 / math.sqrt(KEYS))
        q, k = (ds @ mid["k"]).reshape(-1, KEYS), (ds.transpose(0, 2, 1) @ mid["q"]).reshape(-1, KEYS)
        _scattered(x.ravel(), [(g["now"], full), (g["val"], val), (g["q"], q), (g["k"], k)])
        return loss / n, g

    def train(self, docs: list[np.ndarray], steps: int | None = STEPS, seed: int = 7, rate: float = RATE, whole: bool = True, batch: int = BATCH, once: bool = False) -> list[float]:
        """Adam on random windows of the documents, or of parts of them (not whole: no start and end); returns the loss by step.

        Without a number of steps as many as take in every window once. once: each id is predicted in one window alone, as in scoring.
        """
        texts = [np.concatenate(([0], d, [1])) for d in docs] if whole else [d for d in docs if len(d) > 1]
        if not texts:
            return []
        sizes, ids = np.array([len(t) for t in texts], np.int64), np.concatenate(texts).astype(np.int32)
        seq, first, fresh = _windows(sizes - 1)
        begin, inputs = (np.cumsum(sizes) - sizes)[seq] + first, sizes[seq] - 1 - first
        rng, losses, place = np.random.default_rng(seed), [], np.arange(WINDOW)
        order = rng.permutation(len(seq)) if steps is None else rng.integers(0, len(seq), steps * batch)
        steps = -(-len(order) // batch)
        flat = np.concatenate([w.ravel() for w in self.p.values()])
        m, s, g, room = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty((2, MOVED), np.float32)
        self.p, tables = self._views(flat), self._views(g)
        for i in range(1, steps + 1):
            w = order[(i - 1) * batch : i * batch]
            keep = place < inputs[w, None]
            at = np.where(keep, begin[w, None] + place, 0)
            x, y = np.where(keep, ids[at], 0), np.where(keep, ids[at + 1], 0)
            if once:
                keep &= place >= fresh[w, None]
            g[:] = 0
            losses.append(self._gradients(x, y, keep.ravel(), tables)[0])
            now = rate * min(1, i / 20) * (1 - 0.95 * i / steps)
            for at in range(0, len(flat), MOVED):
                gs, ms, ss = (z[at : at + MOVED] for z in (g, m, s))
                step, root = room[:, : len(gs)]
                np.multiply(np.subtract(gs, ms, out=step), 0.1, out=step)
                ms += step
                np.multiply(np.subtract(np.multiply(gs, gs, out=step), ss, out=step), 0.005, out=step)
                ss += step
                np.sqrt(np.divide(ss, 1 - 0.995**i, out=root), out=root)
                root += 1e-8
                np.multiply(np.divide(ms, 1 - 0.9**i, out=step), now, out=step)
                step /= root
                flat[at : at + MOVED] -= step
        self._kept.pop("scoring", None)
        return losses
