"""A small causal self-attention model over subword ids, in numpy.

Positions come in blocks of STRIDE. A block's queries see their own block up to
themselves and the whole block before it, so windows of 2 * STRIDE overlap by half and
each position is predicted once, from STRIDE to 2 * STRIDE - 1 earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

STRIDE = 16
SPAN = 2 * STRIDE
KEY, HIDDEN = 16, 32
CLASSES, ALONE, GROUP = 256, 192, 16
INPUTS = 2048
CHUNK = 128  # blocks that are scored at once, so few that they stay in the cache


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each text, text of each block, cell of each id); a text of n ids has n + 1 cells."""
    blocks = -(-(lengths + 1) // STRIDE)
    first = np.cumsum(blocks) - blocks
    before = np.cumsum(lengths) - lengths
    cells = np.arange(int(lengths.sum())) + np.repeat(first * STRIDE - before, lengths)
    return first, np.repeat(np.arange(len(lengths)), blocks), cells


def arrange(ids: np.ndarray, lengths: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, is first block, text of each block); inputs begin with ``start``, targets end with
    ``end``; targets outside a text are -1."""
    first, text_of, cells = layout(lengths)
    size = len(text_of) * STRIDE
    inputs, targets = np.full(size, start, np.int32), np.full(size, -1, np.int32)
    inputs[cells + 1] = ids
    targets[cells] = ids
    targets[first * STRIDE + lengths] = end
    opening = np.zeros(len(text_of), bool)
    opening[first] = True
    return inputs.reshape(-1, STRIDE), targets.reshape(-1, STRIDE), opening, text_of


def _ages() -> tuple[np.ndarray, np.ndarray]:
    age = STRIDE + np.arange(STRIDE)[:, None] - np.arange(SPAN)[None, :]
    return np.maximum(age, 0), age < 0


AGE, LATER = _ages()
MASK = np.where(LATER, np.float32(-1e9), np.float32(0))  # added to the scores of a query's later keys


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is short."""
    return values @ np.ones(values.shape[-1], np.float32)


def _with_one(states: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Some rows, each followed by 1."""
    out = np.ones((len(rows), states.shape[1] + 1), np.float32)
    out[:, :-1] = np.take(states, rows, axis=0)
    return out


class Attention:
    """Parameters by input slot; predicts the class of the next id: its group, then the class in the group.

    A group is GROUP classes in a row, so a position costs the groups and one group's classes, not all classes.
    The first columns of ``w`` and ``b`` are the groups', the others the classes'.
    """

    def __init__(self, slots: int, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)

        def table(rows: int, columns: int, scale: float) -> np.ndarray:
            return (rng.standard_normal((rows, columns)) * scale).astype(np.float32)

        self.width = GROUP if classes % GROUP == 0 else classes
        self.groups = classes // self.width
        self.q, self.k = table(slots, KEY, 0.3), table(slots, KEY, 0.3)
        self.v, self.r = table(slots, HIDDEN, 0.3), table(slots, HIDDEN, 0.3)
        self.ages = np.linspace(0, -1, SPAN).astype(np.float32)
        self.w, self.b = table(HIDDEN, self.groups + classes, 0.1), np.zeros(self.groups + classes, np.float32)

    def copy(self) -> Attention:
        other = object.__new__(Attention)
        other.__dict__ = {name: value.copy() if isinstance(value, np.ndarray) else value for name, value in self.__dict__.items()}
        return other

    def forward(self, now: np.ndarray, before: np.ndarray, opening: np.ndarray, bounded: bool = False):
        """Hidden states of a batch of blocks and what the gradient needs; ``bounded``: no weight's exp can overflow."""
        both = np.concatenate((before, now), axis=1)
        q, k, v = np.take(self.q, now, axis=0), np.take(self.k, both, axis=0), np.take(self.v, both, axis=0)
        q *= np.float32(KEY**-0.5)
        scores = q @ k.transpose(0, 2, 1)
        scores += self.ages[AGE] + MASK
        scores[opening, :, :STRIDE] = -1e9
        if not bounded:
            scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= _sums(scores)[..., None]
        hidden = scores @ v
        hidden += np.take(self.r, now, axis=0)
        np.tanh(hidden, out=hidden)
        return hidden, (both, q, k, v, scores)

    def bounded(self) -> bool:
        """Whether no weight's exp can overflow."""
        longest_q, longest_k = (float(np.sqrt(np.einsum("ij,ij->i", t, t).max())) for t in (self.q, self.k))
        return longest_q * longest_k * KEY**-0.5 + float(np.abs(self.ages).max()) < 40

    def small(self) -> bool:
        """Whether no class's exp can overflow; hidden states are within -1 and 1."""
        return float((np.abs(self.w).sum(axis=0) + np.abs(self.b)).max()) < 80

    def _sorted(self, wanted: np.ndarray) -> np.ndarray:
        """Cells that count, in the order of their wanted groups."""
        group = np.where(wanted < 0, -1, wanted // np.int32(self.width)).astype(np.int16)
        order = np.argsort(group, kind="stable")
        return order[np.count_nonzero(group < 0) :]

    def _odds(self, states: np.ndarray, wanted: np.ndarray, small: bool):
        """(natural log probability of the wanted classes, odds of the groups and of the wanted group's classes, their sums,
        place of what is wanted in both, columns and rows of each group). ``states`` end with 1, for the bias; rows are in
        the order of the wanted groups."""
        group, place = np.divmod(wanted, np.int32(self.width))
        ends = np.cumsum(np.bincount(group, minlength=self.groups)).tolist()
        spans = [
            (slice(self.groups + g * self.width, self.groups + (g + 1) * self.width), slice(start, end))
            for g, (start, end) in enumerate(zip([0, *ends], ends)) if start < end
        ]
        weights = np.concatenate((self.w, self.b[None]))
        odds = states @ weights[:, : self.groups], np.empty((len(states), self.width), np.float32)
        for columns, rows in spans:
            np.matmul(states[rows], weights[:, columns], out=odds[1][rows])
        wanted_at, sums, found = [], [], np.zeros(len(states), np.float64)
        for logits, chosen in zip(odds, (group, place)):
            if not small:
                logits -= logits.max(axis=1, keepdims=True)
            wanted_at.append(np.arange(0, logits.size, logits.shape[1]) + chosen)
            found += logits.reshape(-1)[wanted_at[-1]]
            np.exp(logits, out=logits)
            sums.append(_sums(logits))
            found -= np.log(sums[-1])
        return found, odds, sums, wanted_at, spans

    def train(self, now, before, opening, classes, rates: dict, rate: float) -> float:
        """One step of Adagrad on a batch; cells whose class is -1 don't count. Returns the mean loss."""
        hidden, (both, q, k, v, p) = self.forward(now, before, opening, self.bounded())
        flat, wanted = hidden.reshape(-1, HIDDEN), classes.reshape(-1)
        real = self._sorted(wanted)
        some = _with_one(flat, real)
        found, odds, sums, wanted_at, spans = self._odds(some, wanted[real], self.small())
        for shares, total, at in zip(odds, sums, wanted_at):
            part = np.float32(1 / max(len(real), 1))
            shares *= (part / total)[:, None]
            shares.reshape(-1)[at] -= part
        d_weights = np.zeros((HIDDEN + 1, len(self.b)), np.float32)
        outer, inner = odds
        np.matmul(some.T, outer, out=d_weights[:, : self.groups])
        d_some = outer @ self.w[:, : self.groups].T
        for columns, rows in spans:
            d_some[rows] += inner[rows] @ self.w[:, columns].T
            d_weights[:, columns] = some[rows].T @ inner[rows]
        some = some[:, :HIDDEN]
        d_some *= 1 - some * some
        size = KEY + HIDDEN
        d_now, d_both = np.empty((*now.shape, size), np.float32), np.empty((*both.shape, size), np.float32)
        d_pre = np.zeros_like(hidden)
        d_pre.reshape(-1, HIDDEN)[real] = d_some
        d_now[..., KEY:] = d_pre
        d_s = d_pre @ v.transpose(0, 2, 1)
        d_s -= np.einsum("bij,bij->bi", d_s, p)[..., None]
        d_s *= p
        np.matmul(p.transpose(0, 2, 1), d_pre, out=d_both[..., KEY:])
        np.matmul(d_s.transpose(0, 2, 1), q, out=d_both[..., :KEY])
        d_age = np.bincount(AGE[~LATER], d_s.sum(axis=0)[~LATER], SPAN).astype(np.float32)
        np.multiply(d_s @ k, np.float32(KEY**-0.5), out=d_now[..., :KEY])
        for name, grad in {"w": d_weights[:-1], "b": d_weights[-1], "ages": d_age}.items():
            rates[name] += grad**2
            value = getattr(self, name)
            value -= rate * grad / np.sqrt(rates[name])
        for names, at, grads in (("qr", now, d_now), ("kv", both, d_both)):
            ids = at.reshape(-1)
            order = np.argsort(ids.astype(np.int16), kind="stable")  # slots are few; short integers are sorted by their digits
            ordered = ids[order]
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            touched = ordered[starts]
            pairs = np.take(grads.reshape(-1, size), order, axis=0).view(np.complex64)  # two columns are added at once
            total = np.add.reduceat(pairs, starts, axis=0).view(np.float32)
            for name, grad in zip(names, (total[:, :KEY], total[:, KEY:])):
                seen = np.take(rates[name], touched, axis=0)
                seen += grad * grad
                rates[name][touched] = seen
                np.sqrt(seen, out=seen)
                np.divide(grad * np.float32(rate), seen, out=seen)
                value = getattr(self, name)
                value[touched] = np.take(value, touched, axis=0) - seen
        return float(-np.maximum(found, np.log(1e-12)).mean()) if len(found) else 0.0

    def log_probabilities(self, now, before, opening, classes) -> np.ndarray:
        """Natural log probability of the wanted class of every cell, 0 where it is -1."""
        out = np.zeros(now.shape, np.float64)
        bounded, small = self.bounded(), self.small()
        for at in range(0, len(now), CHUNK):
            part = slice(at, at + CHUNK)
            hidden, _ = self.forward(now[part], before[part], opening[part], bounded)
            wanted = classes[part].reshape(-1)
            real = self._sorted(wanted)
            found = self._odds(_with_one(hidden.reshape(-1, HIDDEN), real), wanted[real], small)[0]
            out[part].reshape(-1)[real] = found
        return out


def previous(now: np.ndarray) -> np.ndarray:
    """The block before each block (the one before a text's first block is masked)."""
    return np.concatenate((now[:1], now[:-1]))


def contexts(ids: np.ndarray, lengths: np.ndarray, common: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums for every id, moments): the shares of the common ids in a text, summed over the occurrences of each id, and
    their number, sum and sum of squares over the texts. They add up over parts of a corpus."""
    sums, moments = np.zeros((size, len(common))), np.zeros(2 * len(common) + 1)
    add_contexts(sums, moments, ids, lengths, common)
    return sums, moments


def add_contexts(sums: np.ndarray, moments: np.ndarray, ids: np.ndarray, lengths: np.ndarray, common: np.ndarray, texts: int = 64) -> None:
    """Add the contexts of some texts, so few at once that a table of their ids is small."""
    place, stops = np.full(len(sums), -1), np.append(0, np.cumsum(lengths))
    place[common] = np.arange(len(common))
    for start in range(0, len(lengths), texts):
        some = lengths[start : start + texts]
        mine, text_of = ids[stops[start] : stops[start + len(some)]], np.repeat(np.arange(len(some)), some)
        found = np.flatnonzero(np.bincount(mine, minlength=len(sums)))
        among = np.empty(len(sums), np.int64)
        among[found] = np.arange(len(found))
        times = np.bincount(among[mine] * len(some) + text_of, minlength=len(found) * len(some)).reshape(len(found), len(some))
        shares, there = np.zeros((len(some), len(common))), place[found] >= 0
        shares[:, place[found[there]]] = times[there].T
        shares /= np.maximum(some[:, None], 1)
        sums[found] += times @ shares
        moments += np.concatenate(([len(some)], shares.sum(axis=0), (shares**2).sum(axis=0)))


def classes_of(counts: np.ndarray, sums: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Class of each id and of the end (the last), from the counts of ids and the sums of ``contexts``.

    The most frequent ids have a class of their own. The others are grouped by the texts
    they occur in (k-means over the shares of frequent ids), so that ids of one language
    tend to share a class; ids that were not seen share the last class.
    """
    size, width = sums.shape
    ranked = np.argsort(-counts, kind="stable")
    classes = np.full(size + 1, CLASSES - 1, np.int32)
    alone = ranked[:ALONE][counts[ranked[:ALONE]] > 0]
    classes[alone] = np.arange(len(alone))
    classes[size] = ALONE
    rest = np.setdiff1d(np.flatnonzero(counts), alone)
    groups = CLASSES - ALONE - 2
    if not len(rest):
        return classes
    mean, square = moments[1 : width + 1] / moments[0], moments[width + 1 :] / moments[0]
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    points = (sums[rest] / counts[rest][:, None] - mean) / (spread + 1e-9)
    weight = np.sqrt(counts[rest])
    heavy = np.argsort(-weight, kind="stable")[: min(groups, len(rest))]
    centres = points[heavy].copy()
    for _ in range(12):
        nearest = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(axis=1)
        total = np.bincount(nearest, weight, len(centres))
        for c in np.flatnonzero(total):
            centres[c] = np.average(points[nearest == c], axis=0, weights=weight[nearest == c])
    classes[rest] = ALONE + 1 + nearest
    return classes


def most_common(counts: np.ndarray, most: int = 64) -> np.ndarray:
    return np.argsort(-counts, kind="stable")[:most]


TABLES, DENSE = ("q", "k", "v", "r"), ("ages", "w", "b")


def begin(counts: np.ndarray, classes: np.ndarray, texts: int) -> dict:
    """An untrained model for ids of the given counts: classes of ids, input slots, parameters, steps' past."""
    slot = np.full(len(counts), INPUTS, np.int32)  # rare ids share one slot
    common = most_common(counts, INPUTS)
    slot[common] = np.arange(len(common))
    net = Attention(INPUTS + 2, CLASSES)  # the last slot opens a text
    seen = np.bincount(classes, np.append(counts, texts), CLASSES) + 0.5
    groups = seen.reshape(net.groups, net.width).sum(axis=1)
    net.b[: net.groups] = np.log(groups / groups.sum())
    net.b[net.groups :] = np.log(seen / np.repeat(groups, net.width))
    rates = {n: np.full_like(getattr(net, n), 1e-6) for n in (*TABLES, *DENSE)}
    return {"slot": slot, "classes": classes, "net": net, "rates": rates}


def cells(model: dict, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots, slots of the block before, is first block, wanted classes) of the blocks of some texts."""
    size = len(model["slot"])
    inputs, targets, opening, _ = arrange(ids, lengths, -1, size)
    now = np.where(inputs < 0, INPUTS + 1, model["slot"][inputs])
    return now, previous(now), opening, np.where(targets < 0, -1, model["classes"][targets])


def learn(model: dict, blocks: tuple, passes: int, rate: Callable[[float], float], rng, batch: int = 64) -> None:
    """Steps over all the blocks, ``passes`` times, in a random order; ``rate`` of the share of them that is done."""
    now, before, opening, wanted = blocks
    for turn in range(passes):
        order = rng.permutation(len(now))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            done = (turn + at / len(order)) / passes
            model["net"].train(now[pick], before[pick], opening[pick], wanted[pick], model["rates"], rate(done))


def fit(ids: np.ndarray, lengths: np.ndarray, size: int, steps: int = 1500, batch: int = 64, rate: float = 0.1) -> dict:
    """A model trained on texts held whole, for about ``steps`` steps. ``size``: ids are below it; it stands for the end."""
    counts = np.bincount(ids, minlength=size)
    sums, moments = contexts(ids, lengths, most_common(counts), size)
    model = begin(counts, classes_of(counts, sums, moments), len(lengths))
    if len(lengths):
        blocks = cells(model, ids, lengths)
        passes = -(-steps * batch // len(blocks[0]))
        learn(model, blocks, passes, lambda done: rate * (1 - 0.9 * done), np.random.default_rng(1), batch)
    return model


def score(model: dict, ids: np.ndarray, lengths: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Natural log probability of every text; ``within``: log probability of each id (and the end) in its class."""
    size = len(model["slot"])
    inputs, targets, opening, text_of = arrange(ids, lengths, -1, size)
    now = np.where(inputs < 0, INPUTS + 1, model["slot"][inputs])
    wanted = np.where(targets < 0, -1, model["classes"][targets])
    cells = model["net"].log_probabilities(now, previous(now), opening, wanted)
    cells += np.where(targets < 0, 0.0, within[targets])
    return np.bincount(text_of, cells.sum(axis=1), len(lengths))
