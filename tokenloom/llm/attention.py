"""A small causal self-attention model of subword ids, trained and run in NumPy.

One attention layer with learned relative positions and one hidden layer predict the class of
the next id in two steps, its group of classes and the class within the group; an id's share of
its class comes from corpus counts. Ids are read in blocks of ``STRIDE``; a block attends to
itself and the block before it, so windows of ``2 * STRIDE`` ids overlap by half and each id is
scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRIDE = 16
BOUND = 50_256  # free id of the vocabulary: starts and ends every text
N_IDS = BOUND + 1
GROUP = 16  # classes of a group
_CLIP = np.float32(30)  # logits stay within, so that their exponentials need no maximum
_DELTA = STRIDE + np.arange(STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :]
_MASK = np.where(_DELTA < 0, np.float32(-1e9), np.float32(0))
_DELTA_AT = np.maximum(_DELTA, 0)


@dataclass
class Blocks:
    """Texts as blocks of inputs and targets; ``same`` tells whether the block before is of the same text."""

    inputs: np.ndarray
    targets: np.ndarray
    real: np.ndarray
    same: np.ndarray
    first: np.ndarray  # first block of each text


def to_blocks(texts: list[np.ndarray]) -> Blocks:
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    n_blocks = -(-sizes // STRIDE)
    total = int(n_blocks.sum()) * STRIDE
    first = np.cumsum(n_blocks) - n_blocks
    # every text, its end and what fills its last block, in one run; ends and filling are BOUND
    fill = n_blocks * STRIDE - sizes + 1
    end = np.full(STRIDE, BOUND, dtype=np.int32)
    runs = [part for t, n in zip(texts, fill.tolist(), strict=True) for part in (t, end[:n])]
    targets = np.concatenate(runs).astype(np.int32, copy=False) if runs else np.zeros(0, dtype=np.int32)
    inputs = np.empty(total, dtype=np.int32)
    inputs[1:] = targets[:-1]
    inputs[first * STRIDE] = BOUND
    real = np.ones(total, dtype=bool)
    for n in range(1, STRIDE):
        real[((first + n_blocks) * STRIDE - n)[fill > n]] = False
    same = np.ones(total // STRIDE, dtype=bool)
    same[first] = False
    shape = (-1, STRIDE)
    return Blocks(inputs.reshape(shape), targets.reshape(shape), real.reshape(shape), same, first)


def classes_by_mass(counts: np.ndarray, pieces: list[bytes], n_classes: int) -> np.ndarray:
    """A class per id: frequent ids alone, the others in runs of like form and equal mass."""
    weight = counts + 0.5
    share = weight / weight.sum()
    alone = np.flatnonzero(share >= 1 / n_classes)[: n_classes // 2]
    out = np.full(len(counts), -1, dtype=np.int64)
    out[alone] = np.arange(len(alone))
    rest = np.flatnonzero(out < 0)

    def form(i: int) -> tuple:
        p = pieces[i]
        bare = p.strip()
        return (not bare, not bare[:1].isalnum() and bare[:1] < b"\x80", p[:1] == b" ", bare[:1].isupper(), bare)

    rest = np.array(sorted(rest, key=form))
    mass = np.cumsum(weight[rest])
    bins = n_classes - len(alone)
    out[rest] = len(alone) + np.minimum((mass - weight[rest] / 2) / mass[-1] * bins, bins - 1).astype(np.int64)
    return out


def _windows(rows: np.ndarray) -> np.ndarray:
    """Every block's rows with those of the block before it, as a view: ``(blocks, 2 * STRIDE, columns)``."""
    n, columns = len(rows) // STRIDE - 1, rows.shape[1]
    step, one = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (n, 2 * STRIDE, columns), (STRIDE * step, step, one), writeable=False)


def _with_block_before(blocks: Blocks, a: int, b: int) -> np.ndarray:
    """Inputs of the blocks ``a`` to ``b`` and the one before them (the first stands in for its own)."""
    return np.concatenate([blocks.inputs[max(a - 1, 0)], blocks.inputs[a:b].ravel()])


def _bound(z: np.ndarray) -> np.ndarray:
    return np.clip(z, -_CLIP, _CLIP, out=z)


class _ByGroup:
    """Places of blocks in the order of their targets' groups, for one product per group."""

    def __init__(self, at: np.ndarray, cls: np.ndarray, n_groups: int):
        group = cls // GROUP
        order = np.argsort(group.astype(np.uint8), kind="stable")
        self.at, self.group = at[order], group[order]
        width = n_groups + GROUP
        # of each place's group and member in the flat logits
        own = np.arange(0, len(at) * width, width) + self.group
        self.own = own, own + (cls[order] - self.group * (GROUP + 1) + n_groups)
        edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n_groups))]).tolist()
        self.runs = [(g, slice(i, j)) for g, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]
        # a product sums short rows several times faster than a reduction
        self.sums = np.zeros((width, 2), np.float32)
        self.sums[:n_groups, 0] = self.sums[n_groups:, 1] = 1

    def logits(self, out: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Bounded logits of all groups, then of the classes of each place's own group."""
        z = np.empty((len(out), heads.shape[2]), np.float32)
        for g, run in self.runs:
            np.matmul(out[run], heads[g], out=z[run])
        return _bound(z)


def _heads(p: dict[str, np.ndarray]) -> np.ndarray:
    """Per group, the weights of all groups and of its classes side by side; the last row is added."""
    first = np.concatenate([p["u"], p["c"][None]])
    second = np.concatenate([p["ug"], p["cg"][:, None]], axis=1)
    return np.concatenate([np.broadcast_to(first, (len(second), *first.shape)), second], axis=2)


def _wider(w: np.ndarray) -> np.ndarray:
    """With one more column, of zeros."""
    return np.concatenate([w, np.zeros((len(w), 1), np.float32)], axis=1)


def _hidden(h: np.ndarray, w1: np.ndarray) -> np.ndarray:
    act = h @ w1
    return np.maximum(act, 0, out=act)


class Attention:
    """Parameters of the model, and what scoring needs of them as tables per id.

    ``qkv`` holds the projections to queries (scaled), keys and values side by side; ``u``, ``c``
    give the group of the next class, ``ug``, ``cg`` the class within each group. At most 4,096 classes.
    """

    def __init__(self, n_classes: int, size: int = 8, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.n_groups = -(-n_classes // GROUP)
        self.p = {
            "emb": (rng.standard_normal((N_IDS, size)) * 0.3).astype(np.float32),
            "qkv": np.concatenate([init(size, size) / np.float32(np.sqrt(size)), init(size, size), init(size, size)], axis=1),
            "w1": init(size, hidden), "b1": np.zeros(hidden, np.float32), "w2": init(hidden, size) * np.float32(0.5),
            "u": init(size, self.n_groups) * np.float32(0.3), "c": np.zeros(self.n_groups, np.float32),
            "ug": (rng.standard_normal((self.n_groups, size, GROUP)) * 0.3 / np.sqrt(size)).astype(np.float32),
            "cg": np.zeros((self.n_groups, GROUP), np.float32), "rel": np.zeros(2 * STRIDE, np.float32),
        }
        # places of the last group that are no class
        self.p["cg"].ravel()[n_classes:] = -1e9

    def start(self, class_mass: np.ndarray) -> Attention:
        """Begins with the shares of the classes, given their counts."""
        cg = self.p["cg"].ravel()
        cg[: len(class_mass)] = np.log(class_mass + 0.5)
        by_group = np.exp(self.p["cg"].astype(np.float64)).sum(axis=1)
        self.p["cg"] -= np.log(by_group)[:, None].astype(np.float32)
        self.p["c"] = np.log(by_group / by_group.sum()).astype(np.float32)
        return self

    def fit_blocks(self, blocks: Blocks, class_of: np.ndarray, state: dict, rates, rng: np.random.Generator,
                   passes: int = 1, batch: int = 256) -> Attention:
        """Steps over all ``blocks``, ``passes`` times: runs of ``batch`` blocks in a new order each.
        ``state`` (empty at first) goes on between calls; ``rates(n)`` is the learning rate after ``n`` blocks of it.
        """
        p = self.p
        # all weights but the embedding lie in one run, and ``p`` holds views of it
        names = [k for k in p if k != "emb"]
        flat, at = np.concatenate([p[k].ravel() for k in names]), 0
        for k in names:
            p[k], at = flat[at : at + p[k].size].reshape(p[k].shape), at + p[k].size
        if not state:
            state |= {"m": np.zeros_like(flat), "s": np.zeros_like(flat), "emb": np.zeros_like(p["emb"]),
                      "t": 0, "blocks": 0, "used": np.zeros(N_IDS, dtype=np.float32)}
        m, s, n = state["m"], state["s"], len(blocks.inputs)
        for _ in range(passes):
            for a in rng.permutation(np.arange(0, n, batch)):
                b = min(n, a + batch)
                grads, ids, rows = self._gradients(blocks, a, b, class_of)
                state["t"] += 1
                t, lr = state["t"], np.float32(rates(state["blocks"]) * min(1, state["t"] / 30))
                g = np.concatenate([grads[k].ravel() for k in names])
                m += np.float32(0.1) * (g - m)
                s += np.float32(0.01) * (g * g - s)
                flat -= lr * m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.99**t)) + np.float32(1e-8))
                # rows of the embedding move only when they are used
                seen = state["emb"][ids]
                seen += np.float32(0.05) * (rows * rows - seen)
                state["emb"][ids] = seen
                p["emb"][ids] -= (lr * np.float32(0.3)) * rows / (np.sqrt(seen) + np.float32(1e-7))
                state["blocks"] += b - a
                state["used"][ids] += 1
        return self

    def weighted(self, state: dict) -> tuple[np.ndarray, np.ndarray]:
        """What workers add up to average their weights: ``(embedding, all other weights)``.

        An id's row counts by the steps that used it, so that workers without it do not hold it
        back; the other weights count by blocks. The last column or number is the weight.
        """
        used, blocks = state["used"][:, None], np.float32(state["blocks"])
        rest = np.concatenate([self.p[k].ravel() for k in self.p if k != "emb"])
        return np.concatenate([self.p["emb"] * used, used], axis=1), np.append(rest * blocks, blocks)

    def average(self, emb: np.ndarray, rest: np.ndarray) -> Attention:
        """Takes the weights of summed :meth:`weighted`; what nobody used stays."""
        used = emb[:, -1] > 0
        self.p["emb"][used] = emb[used, :-1] / emb[used, -1:]
        at = 0
        for k, v in self.p.items():
            if k != "emb" and rest[-1] > 0:
                self.p[k] = (rest[at : at + v.size] / rest[-1]).reshape(v.shape).astype(np.float32)
                at += v.size
        return self

    def _gradients(self, blocks: Blocks, a: int, b: int, class_of: np.ndarray):
        p, size, n = self.p, self.p["emb"].shape[1], b - a
        ids = _with_block_before(blocks, a, b)
        e = p["emb"].take(ids, axis=0)
        # one more column of ones beside the values, and one of rests beside each gradient, save passes
        qkv = np.ones((len(ids), 3 * size + 1), np.float32)
        np.matmul(e, p["qkv"], out=qkv[:, :-1])
        q = qkv[STRIDE:, :size].reshape(n, STRIDE, size)
        k, v = _windows(qkv[:, size : 2 * size]), _windows(qkv[:, 2 * size :])
        # attention and its gradient one upon the other, for one product with both
        both = np.empty((n, 2 * STRIDE, 2 * STRIDE), np.float32)
        w, d_s = both[:, :STRIDE], both[:, STRIDE:]
        attend(q, k, p["rel"][_DELTA_AT] + _MASK, blocks.same[a:b], w)
        share = (1 / (w @ np.ones(2 * STRIDE, np.float32))).reshape(-1, 1)
        mixed = np.matmul(w, v[:, :, :size]).reshape(-1, size)
        mixed *= share
        h = np.ones((n * STRIDE, size + 1), np.float32)
        np.add(e[STRIDE:], mixed, out=h[:, :size])
        act = _hidden(h, np.concatenate([p["w1"], p["b1"][None]]))
        at = np.flatnonzero(blocks.real[a:b])
        by = _ByGroup(at, class_of[blocks.targets[a:b].ravel()[at]], self.n_groups)
        out = act @ _wider(p["w2"])
        out += h
        out = out.take(by.at, axis=0)
        heads = _heads(p)
        d = by.logits(out, heads)
        np.exp(d, out=d)
        d *= (1 / (d @ by.sums * np.float32(len(at)))) @ by.sums.T
        for own in by.own:
            d.reshape(-1)[own] -= np.float32(1 / len(at))
        d_heads, d_rows = np.zeros_like(heads), np.empty((len(at), size), np.float32)
        for g, run in by.runs:
            np.matmul(out[run].T, d[run], out=d_heads[g])
            np.matmul(d[run], heads[g, :-1].T, out=d_rows[run])
        first, second = d_heads[:, :, : self.n_groups].sum(0), d_heads[:, :, self.n_groups :]
        g = {"u": first[:-1], "c": first[-1], "ug": second[:, :-1], "cg": second[:, -1]}
        d_out = np.zeros((n * STRIDE, size), np.float32)
        d_out[by.at] = d_rows
        g["w2"] = act.T @ d_out
        d_act = d_out @ p["w2"].T
        d_act *= act > 0
        d_w1 = h.T @ d_act
        g["w1"], g["b1"] = d_w1[:-1], d_w1[-1]
        d_h = d_act @ p["w1"].T
        d_h += d_out
        d_mixed = np.empty_like(h)
        np.multiply(d_h, share, out=d_mixed[:, :size])
        d_mixed[:, size] = (d_mixed[:, :size] * mixed) @ np.full(size, -1, np.float32)
        d_mixed = d_mixed.reshape(n, STRIDE, size + 1)
        np.matmul(d_mixed, v.transpose(0, 2, 1), out=d_s)
        d_s *= w
        g["rel"] = np.bincount(_DELTA_AT.ravel(), weights=d_s.sum(0).ravel(), minlength=2 * STRIDE).astype(np.float32)
        sides = np.zeros((n, 2 * STRIDE, 2 * size), np.float32)
        sides[:, STRIDE:, :size], sides[:, :STRIDE, size:] = q, d_mixed[:, :, :size]
        d_kv = np.matmul(both.transpose(0, 2, 1), sides)
        d_qkv = np.zeros((len(ids), 3 * size), np.float32)
        blocked = d_qkv.reshape(-1, STRIDE, 3 * size)
        np.matmul(d_s, k, out=blocked[1:, :, :size])
        blocked[1:, :, size:] = d_kv[:, STRIDE:]
        blocked[:-1, :, size:] += d_kv[:, :STRIDE]
        g["qkv"] = e.T @ d_qkv
        d_e = d_qkv @ p["qkv"].T
        d_e[STRIDE:] += d_h
        short = ids.astype(np.uint16)  # short keys are sorted in linear time
        order = np.argsort(short, kind="stable")
        short = short[order]
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        return g, short[first].astype(np.int64), np.add.reduceat(d_e.take(order, axis=0), first, axis=0)

    def tables(self) -> dict[str, np.ndarray]:
        """All that scoring gathers per id; some MB, whatever the corpus."""
        p = self.p
        return {
            "all": np.concatenate([p["emb"], p["emb"] @ p["qkv"]], axis=1), "size": p["emb"].shape[1],
            "rel": p["rel"][_DELTA_AT] + _MASK, "w1": np.concatenate([p["w1"], p["b1"][None]]),
            "w2": _wider(p["w2"]), "heads": _heads(p),
        }


def attend(q: np.ndarray, k: np.ndarray, mask: np.ndarray, same: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Unnormalised attention of every id to its window; ``mask`` holds positions and what is ahead."""
    w = np.matmul(q, k.transpose(0, 2, 1), out=out)
    _bound(w)
    w += mask
    np.exp(w, out=w)
    w[np.flatnonzero(~same), :, :STRIDE] = 0
    return w


def log10_probability(texts: list[np.ndarray], t: dict, class_of: np.ndarray, in_class: np.ndarray, step: int = 256) -> np.ndarray:
    """log10 of every text's probability, its end included. ``in_class``: natural log of an id's share."""
    blocks, size = to_blocks(texts), t["size"]
    n = len(blocks.inputs)
    per_id = np.zeros(n * STRIDE)
    for a in range(0, n, step):
        b = min(n, a + step)
        rows = t["all"].take(_with_block_before(blocks, a, b), axis=0)
        q = rows[STRIDE:, size : 2 * size].reshape(-1, STRIDE, size)
        w = attend(q, _windows(rows[:, 2 * size : 3 * size]), t["rel"], blocks.same[a:b])
        mixed = np.matmul(w, _windows(rows[:, 3 * size :])).reshape(-1, size)
        mixed /= (w.reshape(-1, 2 * STRIDE) @ np.ones(2 * STRIDE, np.float32))[:, None]
        h = np.ones((len(mixed), size + 1), np.float32)
        np.add(rows[STRIDE:, :size], mixed, out=h[:, :size])
        h += _hidden(h, t["w1"]) @ t["w2"]
        at = np.flatnonzero(blocks.real[a:b])
        target = blocks.targets[a:b].ravel()[at]
        by = _ByGroup(at, class_of[target], len(t["heads"]))
        z = by.logits(h.take(by.at, axis=0), t["heads"])
        lp = z.ravel()[by.own[0]] + z.ravel()[by.own[1]]
        total = np.exp(z, out=z) @ by.sums
        lp -= np.log(total[:, 0] * total[:, 1])
        here = per_id[a * STRIDE : b * STRIDE]
        here[by.at] = lp
        here[at] += in_class[target]
    return np.add.reduceat(per_id, blocks.first * STRIDE) / np.log(10) if n else np.zeros(0)
