"""Language-model scores: a word model from all counts, and a causal self-attention model on subword ids.

Learning reads every training document: all words are counted (in packed blocks by hash range), all
subword ids and all pairs of neighbouring ids are counted, and all of them, each text cut into
consecutive windows that end with its end, train the attention model.  Equal windows are one window
that weighs as many.  Windows are dealt by their hash to groups of bounded size, in rounds: in a
round each group takes gradient steps through its windows, in the order of their hashes, from the
round's start, and the parameters are averaged over the groups, weighted by their windows, in whole
numbers.  So the model, and every score, follows from the documents and not from their partitions.

The model: embeddings of subword ids, one head of causal attention over a window with a
learned bias for each distance, a residual, and a softmax over classes of ids.  What attention
adds is added to the log share of each class after the id before, by the counts; within its class an id has
its share after the id before, by the counts, smoothed with its share of all.  So the probabilities of all
ids sum to 1, and with no training the model is that of the counted pairs.

Each text is encoded once; its ids are kept in a table, for learning and for scoring.

Scoring slides overlapping windows over each text: blocks of HALF tokens see the HALF tokens
before them too, and every token, the end included, is scored once, in batched masked attention.

The word counts that a text's words need are looked up in two ways: a bounded table of the most
frequent words is sent to all tasks, the other words go to their hash range's reducer.

Defined cases: a null text is empty and has the end token only; a null doc_id counts as the
empty string when documents are split; rows that repeat a doc_id are each learned from and
scored; with no training documents all counts are 0 and the start parameters score; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, table
from .piece_bpe import SLICE, SPACE, default_path, encoder_of, load
from .textscan import Index, U64, mix, pieces, scan

HALF, WIDTH, CLASSES = 16, 16, 32
OWN, SHARED = 1536, 512
SLOTS = OWN + SHARED
#: Fills up a text's last training window; not learned.
PAD = (1 << 16) - 1
SEEN = 2 * HALF
WINDOW = np.dtype([("hash", "<u8"), ("n", "<i8"), ("ids", "<u2", (SEEN + 1,))])
#: Rounds of training with their rates, and the bytes of text whose windows a group of all rounds holds.
RATES, GROUP_BYTES, BATCH = (0.015, 0.006), 8 << 20, 192
#: Weight of the share of all beside the counts after an id.
SMOOTH = 10.0
#: Words in the table that is sent to all tasks, at most; bytes of text for each hash range of words.
HEAD, RANGE_BYTES = 1 << 18, 32 << 20
RANGES = 256
F32 = np.float32
ONES, ONES_C = np.ones((SEEN, 1), F32), np.ones((CLASSES, 1), F32)
#: Scale of the queries, keys and values.
ROOTS = np.repeat([1 / math.sqrt(WIDTH), 1, 1], WIDTH).astype(F32)
#: Rows of parameters that the driver adds up, at most.
SUMS = 32
#: Keys of the rows that carry windows begin here and fall.
WINDOWS = -1000


# ---- the model


class Model:
    """Tables of the counts, and parameters; ids of the vocabulary, then its size as the end and start token.

    counts: of each id; opens: whether it begins a word; pairs: SLOTS rows (the id before) of OWN + CLASSES counts,
    those of the OWN most frequent ids and, by class, of the others.
    """

    def __init__(self, counts: np.ndarray, opens: np.ndarray | None = None, pairs: np.ndarray | None = None, params: dict | None = None):
        n = len(counts)
        order = np.lexsort((np.arange(n), -counts))
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        self.slot = np.where(self.rank < OWN, self.rank, OWN + np.arange(n) % SHARED)
        # Half of the classes are the most frequent ids, the others equal shares of the rest, those that begin words first.
        single = CLASSES // 2
        if opens is not None:
            order = np.concatenate([order[:single], order[single:][np.argsort(~opens[order[single:]], kind="stable")]])
        mass = np.cumsum((counts[order] + 1.0)) / (counts + 1.0).sum()
        rest = np.maximum(0, mass - mass[single - 1]) / (1 - mass[single - 1])
        self.cls = np.empty(n, dtype=np.int64)
        self.cls[order] = np.where(np.arange(n) < single, np.arange(n), np.minimum(CLASSES - 1, single + (rest * (CLASSES - single)).astype(int)))
        total = np.bincount(self.cls, weights=counts + 1.0, minlength=CLASSES)
        self.share = (counts + 1.0) / total[self.cls]
        self.pairs = np.zeros((SLOTS, OWN + CLASSES), F32) if pairs is None else pairs
        # After each slot: the counts of each class, of all its ids and of those among the OWN most frequent.
        frequent = np.zeros((OWN, CLASSES), F32)
        own = np.flatnonzero(self.rank < OWN)
        frequent[self.rank[own], self.cls[own]] = 1
        self.of_class = (self.pairs[:, :OWN] @ frequent).astype(float)
        every = self.of_class + self.pairs[:, OWN:]
        self.prior = np.log((every + SMOOTH * total / total.sum()) / (every.sum(axis=1, keepdims=True) + SMOOTH)).astype(F32)
        self.params, self.logs = params or self.start(), None

    @staticmethod
    def start() -> dict:
        rng = np.random.default_rng(5)
        g = lambda *s, k: (k * rng.standard_normal(s)).astype(F32)
        return {"d": (-0.1 * np.arange(SEEN)).astype(F32), "e": g(SLOTS, WIDTH, k=0.3), "o": g(WIDTH, CLASSES, k=0.02), "w": g(WIDTH, 3 * WIDTH, k=0.25)}

    def column(self, ids: np.ndarray) -> np.ndarray:
        """Where the counts of pairs that end with each id stand."""
        return np.where(self.rank[ids] < OWN, self.rank[ids], OWN + self.cls[ids])

    def within(self, slot: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 of the share that each id has of its class, after the slot."""
        if self.logs is None:
            order, single = np.ones(OWN), np.log10(SMOOTH * self.share)
            own = np.flatnonzero(self.rank < OWN)
            order[self.rank[own]] = self.share[own]
            self.logs = np.log10(self.pairs[:, :OWN] + F32(SMOOTH) * order.astype(F32)), single, np.log10(self.of_class + SMOOTH)
        seen, single, whole = self.logs
        rank = self.rank[ids]
        return np.where(rank < OWN, seen[slot, np.minimum(rank, OWN - 1)], single[ids]) - whole[slot, self.cls[ids]]

    def next_ids(self, ids: list[int]) -> np.ndarray:
        """log10 probability of every id after ids (the start first), one token at a time; what score does in blocks."""
        p, n = self.params, len(ids)
        seen = p["e"][self.slot[ids]].astype(float)
        q, k, v = np.split(seen @ p["w"], 3, axis=1)
        first = max(0, (n - 1) // HALF * HALF - HALF)  # of the block of the last id and the one before
        weight = np.exp(k[first:] @ q[-1] / math.sqrt(WIDTH) + p["d"][np.arange(n - 1, -1, -1)[first:]])
        z = (seen[-1] + weight @ v[first:] / weight.sum()) @ p["o"] + self.prior[self.slot[ids[-1]]]
        z = z - z.max()
        every = np.arange(len(self.slot))
        return ((z - np.log(np.exp(z).sum())) / math.log(10))[self.cls] + self.within(np.full(len(every), self.slot[ids[-1]]), every)

    def loss(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, asked: bool = True) -> tuple[float, dict]:
        """Mean loss in nats (if asked for) of windows x (slots) with classes y to come, weighted by weight, and gradients (that of e by its rows)."""
        p, (b, n) = self.params, x.shape
        flat_x, m = x.ravel(), x.size
        e, w = p["e"][flat_x], p["w"] * ROOTS
        t = (e @ w).reshape(b, n, 3 * WIDTH)
        q, k, v = (t[:, :, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        gap = np.arange(n)[:, None] - np.arange(n)[None, :]
        low, gap = gap >= 0, np.abs(gap)
        a = q @ k.transpose(0, 2, 1)
        a += np.where(low, p["d"][gap], F32(-1e9))
        # Scores are bounded, so that no maximum needs to be taken off.
        np.exp(np.minimum(a, F32(60), out=a), out=a)
        a /= a @ ONES[:n]
        h = (a @ v).reshape(m, WIDTH)
        h += e
        z = h @ p["o"]
        z += self.prior[flat_x]
        np.exp(np.minimum(z, F32(60), out=z), out=z)
        at, scale = (np.arange(m), y.ravel()), (weight / weight.sum(dtype=float)).astype(F32).ravel()
        every = (z @ ONES_C).ravel()
        loss = float(-np.log(z[at] / every + 1e-20) @ scale) if asked else 0.0
        z *= (scale / every)[:, None]
        z[at] -= scale
        dh = z @ p["o"].T
        g = {"o": h.T @ z}
        own = dh.reshape(b, n, WIDTH)
        da = own @ v.transpose(0, 2, 1)
        da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
        da *= a
        g["d"] = np.bincount(gap[low], weights=da.sum(axis=0)[low], minlength=SEEN).astype(F32)
        dt = np.empty_like(t)
        for i, (left, right) in enumerate(((da, k), (da.transpose(0, 2, 1), q), (a.transpose(0, 2, 1), own))):
            np.matmul(left, right, out=dt[:, :, i * WIDTH : (i + 1) * WIDTH])
        dt = dt.reshape(m, 3 * WIDTH)
        g["w"] = e.T @ dt * ROOTS
        dh += dt @ w.T
        order = np.argsort(flat_x.astype(np.uint16), kind="stable")
        rows = flat_x[order]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        g["e"] = (rows[starts], np.add.reduceat(dh[order], starts, axis=0))
        return loss, g

    def train(self, windows: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One pass over windows (ids, one more than is seen, filled up with PAD) with Adam, the rate falling over its second half."""
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.params = {k: v.copy() for k, v in self.params.items()}
        step = 0
        for first in range(0, len(windows), 32 * BATCH):
            w = windows[first : first + 32 * BATCH].astype(np.int64)
            weight = (w[:, 1:] != PAD) * weights[first : first + 32 * BATCH, None].astype(F32)
            w[w == PAD] = 0
            x, y = self.slot[w[:, :-1]], self.cls[w[:, 1:]]
            for at in range(0, len(w), BATCH):
                step += 1
                _, g = self.loss(x[at : at + BATCH], y[at : at + BATCH], weight[at : at + BATCH], False)
                now = rate * min(1.0, 2 * (1 - (first + at) / len(windows)))
                a, b = F32(now / (1 - 0.9**step)), F32(1 / (1 - 0.99**step))
                for k, own in g.items():
                    rows, own = own if k == "e" else (slice(None), own)  # of embeddings only those that are seen
                    m[k][rows] = mean = F32(0.9) * m[k][rows] + F32(0.1) * own
                    s[k][rows] = square = F32(0.99) * s[k][rows] + F32(0.01) * own * own
                    self.params[k][rows] -= a * mean / (np.sqrt(square * b) + F32(1e-6))

    def tables(self) -> None:
        p = self.params
        #: Query, key, value and embedding of each slot.
        self.seen = np.concatenate([p["e"] @ (p["w"] * ROOTS), p["e"]], axis=1).astype(F32)
        q, k, v, e = (np.sqrt((x * x).sum(axis=1)).max() for x in np.split(self.seen, 4, axis=1))
        # Whether all scores are so small that exp of none overflows.
        self.calm = q * k + np.abs(p["d"]).max() < 80 and (e + v) * np.sqrt((p["o"] ** 2).sum(axis=0)).max() < 80
        gap = np.arange(HALF)[:, None] - np.arange(HALF)[None, :]
        #: What distance adds, for the block before and the own block.
        self.bias = np.concatenate([p["d"][HALF + gap], np.where(gap >= 0, p["d"][np.abs(gap)], F32(-1e9))], axis=1).astype(F32)

    def score(self, flat: np.ndarray, lengths: np.ndarray, block: int = 64, most: int = 1 << 16) -> np.ndarray:
        """log10 probability of each text, the end token included; flat: the ids of all texts, lengths: how many each has.

        Texts lie in whole blocks of HALF places: start, ids, filled up with the end.  A block
        attends to itself, masked, and to the block before if that is of the same text.
        Texts are taken together up to most ids, so that the arrays stay in the processor's cache.
        """
        ends, out, at = np.concatenate([[0], np.cumsum(lengths)]), [np.zeros(0)], 0
        while at < len(lengths):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            out.append(self._scored(flat[ends[at] : ends[to]], lengths[at:to], block))
            at = to
        return np.concatenate(out)

    def _scored(self, flat: np.ndarray, lengths: np.ndarray, block: int) -> np.ndarray:
        end, n = len(self.slot) - 1, len(lengths)
        sizes = lengths + 1
        blocks = -(-sizes // HALF)
        lead = np.concatenate([[0], np.cumsum(blocks * HALF)])
        want = np.full(lead[-1], end, dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(flat)) + np.repeat(lead[:-1] - first, lengths)
        want[place] = flat
        seen = np.append(end, want[:-1])
        seen[lead[:-1]] = end
        real = (np.arange(lead[-1]) - np.repeat(lead[:-1], blocks * HALF)) < np.repeat(sizes, blocks * HALF)
        opens = np.zeros(lead[-1] // HALF, dtype=bool)
        opens[lead[:-1] // HALF] = True
        slots, p, score = self.slot[seen], self.params, np.empty(lead[-1])
        targets = self.cls[want]
        # A block before the first, which no block attends to.
        led = np.concatenate([np.zeros(HALF, dtype=np.int64), slots])
        for a in range(0, len(opens), block):
            own = led[a * HALF : (a + block + 1) * HALF]
            rows = self.seen.take(own, axis=0)
            q, e = rows[HALF:, :WIDTH].reshape(-1, HALF, WIDTH), rows[HALF:, 3 * WIDTH :]
            # Keys of each block and the one before, with the features first; values as overlapping views.
            k, turned = np.empty((len(q), WIDTH, SEEN), F32), rows[:, WIDTH : 2 * WIDTH].reshape(-1, HALF, WIDTH).transpose(0, 2, 1)
            k[:, :, :HALF], k[:, :, HALF:] = turned[:-1], turned[1:]
            v = as_strided(rows[:, 2 * WIDTH :], (len(q), SEEN, WIDTH), (HALF * rows.strides[0], *rows.strides), writeable=False)
            weight = q @ k
            weight += self.bias
            weight[opens[a : a + block], :, :HALF] = F32(-1e9)
            if not self.calm:
                weight -= weight.max(axis=2, keepdims=True)
            np.exp(weight, out=weight)
            mixed = weight @ v
            mixed /= weight @ ONES
            mixed += e.reshape(mixed.shape)
            # All products are of a block's shape, so that a score does not depend on the texts beside it.
            z = mixed @ p["o"]
            z += self.prior.take(own[HALF:], axis=0).reshape(z.shape)
            if not self.calm:
                z -= z.max(axis=2, keepdims=True)
            target = targets[a * HALF : (a + block) * HALF]
            got = z.reshape(-1, CLASSES)[np.arange(len(target)), target]
            np.exp(z, out=z)
            score[a * HALF : (a + block) * HALF] = got - np.log(z @ ONES_C).ravel()
        score = score / math.log(10) + self.within(slots, want)
        return np.add.reduceat(np.where(real, score, 0.0), lead[:-1])


# ---- reading texts


def _windows(ids: np.ndarray, many: np.ndarray, end: int) -> np.ndarray:
    """All ids of all texts, and the end of each text, in consecutive windows that start with what comes before (the end where a text starts)."""
    rows = -(-(many + 1) // SEEN)
    first = np.cumsum(rows) - rows
    body = np.full(rows.sum() * SEEN, PAD, dtype="<u2")
    body[np.arange(len(ids)) + np.repeat(first * SEEN - (np.cumsum(many) - many), many)] = ids
    body[first * SEEN + many] = end
    out = np.empty((rows.sum(), SEEN + 1), dtype="<u2")
    out[:, 1:] = body.reshape(-1, SEEN)
    out[1:, 0] = out[:-1, -1]
    out[first, 0] = end
    return out


def _weighed(rows: np.ndarray) -> np.ndarray:
    """Equal windows as one, by their hashes; hashes that differ in their windows stay apart."""
    rows = rows[np.argsort(rows["hash"], kind="stable")]
    new = np.ones(len(rows), dtype=bool)
    same = np.flatnonzero(rows["hash"][1:] == rows["hash"][:-1])
    new[1 + same] = (rows["ids"][1 + same] != rows["ids"][same]).any(axis=1)
    starts = np.flatnonzero(new)
    out = rows[starts]
    if len(starts):
        out["n"] = np.add.reduceat(rows["n"], starts)
    return out


#: Odd numbers, one for each place of a window.
PLACES = mix(np.arange(SEEN + 1, dtype=U64), 13) | U64(1)


def _dealt(ids: np.ndarray) -> np.ndarray:
    """Windows with their hashes, equal ones as one."""
    out = np.empty(len(ids), dtype=WINDOW)
    h = np.zeros(len(ids), dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(SEEN + 1):
            h += ids[:, k].astype(U64) * PLACES[k]
    out["hash"], out["n"], out["ids"] = mix(h), 1, ids
    return _weighed(out)


ENCODED = "bytes long, texts binary, ids binary"
#: Of each encoded text: two hashes of it, whether it is held out, how many ids it has.
TEXT = np.dtype([("one", "<i8"), ("two", "<i8"), ("held", "<i8"), ("many", "<i8")])


def _encode(path: str):
    """Texts -> rows of encoded texts: what is known of each, and all their ids (two bytes each)."""

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for piece in pieces(batch):
                found = [encoder.ids(part.column("text")) for part in pieces(piece, most=SLICE)]
                texts = np.empty(piece.num_rows, dtype=TEXT)
                for name in TEXT.names[:3]:
                    texts[name] = piece.column(name).to_numpy(zero_copy_only=False)
                texts["many"] = np.concatenate([many for _, many in found])
                ids = np.concatenate([ids for ids, _ in found]).astype("<u2")
                size = pc.sum(pc.binary_length(piece.column("text")), min_count=0).as_py()
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([texts.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], ["bytes", "texts", "ids"])

    return run


def _decoded(batch: pa.RecordBatch):
    for texts, ids in zip(batch.column("texts"), batch.column("ids"), strict=True):
        yield np.frombuffer(texts.as_py(), dtype=TEXT), np.frombuffer(ids.as_py(), dtype="<u2").astype(np.int64)


def _deal(n_groups: int, n_ids: int):
    """Encoded texts -> rows (key, blob) of those to learn from: subword counts by id range (-1 - range), the end's being the texts'; windows by group (WINDOWS - group)."""

    def run(batches):
        subwords = np.zeros(n_ids + 1, dtype=np.int64)
        for batch in batches:
            for texts, ids in _decoded(batch):
                learned = texts["held"] == 0
                ids, many = ids[np.repeat(learned, texts["many"])], texts["many"][learned]
                if not len(many):
                    continue
                subwords[:n_ids] += np.bincount(ids, minlength=n_ids)
                subwords[n_ids] += len(many)
                rows = _dealt(_windows(ids, many, n_ids))
                groups, cuts = _ranges(rows["hash"], n_groups)
                yield _keyed((WINDOWS - groups).tolist(), [rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        own = [np.flatnonzero(subwords[r::RANGES]) for r in range(RANGES)]
        keys = [-1 - r for r in range(RANGES) if len(own[r])]
        yield _keyed(keys, [(r + own[r] * RANGES).astype("<i8").tobytes() + subwords[r::RANGES][own[r]].astype("<i8").tobytes() for r in range(RANGES) if len(own[r])])

    return run


def _keyed(keys: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["key", "blob"])


def _count(n_ranges: int):
    """Training texts -> rows (key, blob): word counts by hash range."""

    def run(batches):
        words, counts = [], []

        def packed():
            h, inverse = np.unique(np.concatenate(words), return_inverse=True)
            c = np.bincount(inverse, weights=np.concatenate(counts)).astype("<i8")
            words[:], counts[:] = [h], [c]
            return h, c

        def sent(h, c):
            words.clear()
            counts.clear()
            keys, cuts = _ranges(h, n_ranges)
            return _keyed(keys.tolist(), [h[a:b].tobytes() + c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

        for batch in batches:
            for piece in pieces(batch, most=SLICE):
                h, c = np.unique(scan(piece.column("text")).hash, return_counts=True)
                words.append(h)
                counts.append(c)
                if sum(map(len, words)) > 4_000_000:
                    h, c = packed()
                    if len(h) > 2_000_000:
                        yield sent(h, c)
        if words:
            yield sent(*packed())

    return run


def _ranges(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted 64-bit hashes dealt to n equal ranges: the ranges that have any, and where they begin, with the end."""
    own = (h >> U64(32)) * U64(n) >> U64(32)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
    return own[starts].astype(np.int64), np.append(starts, len(own))


def _merge(head_size: int):
    """Adds up the counts of one range, or the windows of one group; also the most frequent words of a hash range."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] <= WINDOWS:
            own = _weighed(np.concatenate([np.frombuffer(b, dtype=WINDOW) for b in rows["blob"]]))
            return pd.DataFrame([(key[0], int(own["n"].sum()), len(own), own["n"].tobytes() + own["ids"].tobytes(), b"")], columns=["key", "n", "v", "blob", "head"])
        half = [_halves(b) for b in rows["blob"]]
        h, inverse = np.unique(np.concatenate([x[0] for x in half]), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([x[1] for x in half])).astype("<i8")
        top = np.sort(np.lexsort((h, -c))[:head_size])
        return pd.DataFrame([(key[0], int(c.sum()), len(h), h.tobytes() + c.tobytes(), h[top].tobytes() + c[top].tobytes())], columns=["key", "n", "v", "blob", "head"])

    return run


def _halves(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(blob, dtype="<u8", count=len(blob) // 16), np.frombuffer(blob, dtype="<i8", offset=len(blob) // 2)


def _group(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, how often each occurs) of a merged group of n."""
    return np.frombuffer(blob, dtype="<u2", offset=8 * n).reshape(n, SEEN + 1), np.frombuffer(blob, dtype="<i8", count=n)


def _pairs(windows: DataFrame, counts: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """How often each slot is followed by each frequent id and by others of each class (SLOTS x (OWN + CLASSES), whatever the corpus)."""
    sent, wide, block = windows.sparkSession.sparkContext.broadcast((counts, opens)), OWN + CLASSES, 64

    def count(batches):
        model, seen = Model(*sent.value), np.zeros(SLOTS * wide, dtype=np.int64)
        row, column = model.slot * wide, model.column(np.arange(len(model.slot)))
        for batch in batches:
            for b, v in zip(batch.column("blob"), batch.column("v"), strict=True):
                ids, n = _group(b.as_py(), v.as_py())
                for at in range(0, len(ids), 1 << 14):
                    w = ids[at : at + (1 << 14)]
                    ok = w[:, 1:] != PAD
                    cell = row[w[:, :-1][ok]] + column[w[:, 1:][ok]]
                    np.add.at(seen, cell, np.repeat(n[at : at + (1 << 14)], SEEN)[ok.ravel()])
        keys, blobs = [], []
        for k in range(SLOTS // block):
            own = seen[k * block * wide : (k + 1) * block * wide]
            at = np.flatnonzero(own)
            if len(at):
                keys.append(k)
                blobs.append((at + k * block * wide).astype("<i8").tobytes() + own[at].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["key", "blob"])

    counted = windows.select("v", "blob").mapInArrow(count, "key long, blob binary").groupBy("key").applyInPandas(_merge(0), "key long, n long, v long, blob binary, head binary")
    out = np.zeros(SLOTS * wide, F32)
    for r in counted.select("blob").collect():
        at, c = _halves(bytes(r.blob))
        out[at.astype(np.int64)] = c
    sent.destroy()
    return out.reshape(SLOTS, wide)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(int(rows["n"].sum()), sum(np.frombuffer(b, dtype="<i8") for b in rows["params"]).tobytes())], columns=["n", "params"])


def _fitted(windows: DataFrame, model: Model, tables: tuple) -> dict:
    """Parameters after all rounds; windows: merged groups (key, n, v, blob)."""
    sc = windows.sparkSession.sparkContext
    shape = {k: v.shape for k, v in sorted(model.params.items())}
    tables = sc.broadcast(tables)
    for turn, rate in enumerate(RATES):
        own = windows.where(F.pmod(WINDOWS - F.col("key"), F.lit(len(RATES))) == turn)
        total = own.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
        if not total:
            continue
        # Whole numbers, so that the order of the sum has no say; parameters are below 2 ** 7.
        scale = 2.0 ** min(30, 55 - math.ceil(math.log2(total + 1)))
        start = sc.broadcast(model.params)

        def run(batches, start=start, rate=rate, scale=scale):
            now, n, whole = Model(*tables.value), 0, 0
            for batch in batches:
                for b, v in zip(batch.column("blob"), batch.column("v"), strict=True):
                    now.params = start.value
                    now.train(*_group(b.as_py(), v.as_py()), rate=rate)
                    whole = whole + np.concatenate([np.rint(now.params[k].ravel().astype(float) * scale).astype("<i8") for k in shape]) * v.as_py()
                    n += v.as_py()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([whole.tobytes()], pa.binary())], ["n", "params"])

        trained = own.select("v", "blob").mapInArrow(run, "n long, params binary").withColumn("part", F.spark_partition_id() % SUMS)
        sums = trained.groupBy("part").applyInPandas(_added, "n long, params binary").collect()  # SUMS rows at most
        n, whole = sum(r.n for r in sums), sum(np.frombuffer(bytes(r.params), dtype="<i8") for r in sums)
        ends = np.cumsum([math.prod(s) for s in shape.values()])
        model.params = {k: (part / (scale * n)).reshape(shape[k]).astype(F32) for k, part in zip(shape, np.split(whole, ends[:-1]), strict=True)}
        start.destroy()
    tables.destroy()
    return model.params


def _score(sent):
    """Encoded texts -> (one, two, score), one row for each text."""

    def run(batches):
        tables, params = sent.value
        model = Model(*tables, params=params)
        model.tables()
        for batch in batches:
            for texts, ids in _decoded(batch):
                yield pa.RecordBatch.from_arrays([pa.array(texts["one"]), pa.array(texts["two"]), pa.array(model.score(ids, texts["many"]))], ["one", "two", "score"])

    return run


def _ask(sent, n_ranges: int):
    """All documents -> rows (key, chunk, blob): by hash range the words that are not in the head table; under -1 - chunk what is known of each document."""

    def run(batches):
        head, head_count = sent.value
        logs, index = np.log10(head_count + 1.0), Index()
        index.add(head, np.arange(len(head)))
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch):
                words = scan(piece.column("text"))
                n = piece.num_rows
                at = index.get(words.hash)
                hit = at >= 0
                sums = np.bincount(words.row[hit], weights=logs[at[hit]], minlength=n)
                known = np.bincount(words.row[hit], minlength=n)
                tail, doc = words.hash[~hit], words.row[~hit]
                order = np.argsort(tail, kind="stable")
                tail, doc = tail[order], doc[order].astype("<u2")
                chunk = (part << 32) + seq
                seq += 1
                ids = pa.array(piece.column("doc_id")).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                null = np.array([not v.is_valid for v in piece.column("doc_id")], dtype="<i8")
                own = [piece.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("held", "one", "two")]
                meta = b"".join(x.tobytes() for x in (ids, null, *own, np.diff(words.first).astype("<i8") + 1, known.astype("<i8"), sums.astype("<f8")))
                keys, cuts = _ranges(tail, n_ranges)
                blobs = [tail[a:b].tobytes() + doc[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - chunk, *keys], pa.int64()), pa.array([chunk] * (1 + len(keys)), pa.int64()), pa.array([meta, *blobs], pa.binary())], ["key", "chunk", "blob"])

    return run


def _look_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: the counts of the words asked for, added up for each document that asks."""
    if key[0] < 0:
        return pd.DataFrame({"chunk": rows["chunk"], "meta": True, "blob": rows["blob"]})
    own = rows[rows["chunk"] < 0]
    h, c = _halves(own["blob"].iloc[0]) if len(own) else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))
    out = []
    for chunk, blob in rows.loc[rows["chunk"] >= 0, ["chunk", "blob"]].itertuples(index=False):
        n = len(blob) // 10
        word, doc = np.frombuffer(blob, dtype="<u8", count=n), np.frombuffer(blob, dtype="<u2", offset=8 * n)
        if len(h):
            at = np.minimum(np.searchsorted(h, word), len(h) - 1)
            hit = h[at] == word
            docs, inverse = np.unique(doc[hit], return_inverse=True)
            if len(docs):
                sums = np.bincount(inverse, weights=np.log10(c[at[hit]] + 1.0))
                out.append((chunk, False, docs.astype("<i8").tobytes() + np.bincount(inverse).astype("<i8").tobytes() + sums.astype("<f8").tobytes()))
    return pd.DataFrame(out, columns=["chunk", "meta", "blob"])


def _finish(n: int, v: int, texts: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        meta = rows.loc[rows["meta"], "blob"].iloc[0]
        m = len(meta) // 64
        ids, null, held, one, two, tokens, known = (np.frombuffer(meta, dtype="<i8", offset=8 * m * k, count=m) for k in range(7))
        known, sums = known.copy(), np.frombuffer(meta, dtype="<f8", offset=56 * m, count=m).copy()
        for blob in sorted(rows.loc[~rows["meta"], "blob"]):
            k = len(blob) // 24
            doc = np.frombuffer(blob, dtype="<i8", count=k)
            known[doc] += np.frombuffer(blob, dtype="<i8", offset=8 * k, count=k)
            sums[doc] += np.frombuffer(blob, dtype="<f8", offset=16 * k, count=k)
        total = n + texts
        base = sums + math.log10(texts + 1) - tokens * math.log10(total + v + (texts > 0) + 1)
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), null == 1), "held_out": held == 1, "n_tokens": tokens, "n_known": known + (texts > 0), "train_tokens": total, "base_score": base, "one": one, "two": two})

    return run


def scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text)."""
    path, scratch = path or default_path(), Scratch(docs.sparkSession)
    sc, vocabulary = docs.sparkSession.sparkContext, load(path or default_path())
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), "text", held.cast("long").alias("held"), F.xxhash64(text).alias("one"), F.xxhash64(text, F.lit(1)).alias("two"))
    # Each text is encoded once, for learning and for scoring.
    encoded = scratch.save(docs.select("text", "one", "two", "held").mapInArrow(_encode(path), ENCODED))
    # Of the texts alone, so that their files and partitions have no say.
    size = encoded.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n_ranges, n_groups = max(16, -(-size // RANGE_BYTES)), len(RATES) * max(1, -(-size // GROUP_BYTES))
    made = encoded.mapInArrow(_deal(n_groups, len(vocabulary.pieces)), "key long, blob binary").unionByName(docs.where("held = 0").select("text").mapInArrow(_count(n_ranges), "key long, blob binary"))
    merged = made.groupBy("key").applyInPandas(_merge(max(1, HEAD // n_ranges)), "key long, n long, v long, blob binary, head binary")
    merged = scratch.save(merged)
    n, v = merged.where("key >= 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    counts = np.zeros(len(vocabulary.pieces) + 1)
    for r in merged.where(f"key < 0 and key > {WINDOWS}").select("blob").collect():  # a count for each id of the vocabulary
        ids, c = _halves(bytes(r.blob))
        counts[ids.astype(np.int64)] = c
    texts = int(counts[-1])
    heads = [_halves(bytes(r.head)) for r in merged.where("key >= 0").orderBy("key").select("head").limit(HEAD).collect()]  # HEAD words at most
    head = np.concatenate([h for h, _ in heads]) if heads else np.zeros(0, dtype=U64)
    head_count = np.concatenate([c for _, c in heads]) if heads else np.zeros(0, dtype=np.int64)
    opens = np.array([*(p.startswith(SPACE) for p in vocabulary.pieces), False])
    windows = merged.where(f"key <= {WINDOWS}")
    tables = (counts, opens, _pairs(windows, counts, opens))
    params = _fitted(windows, Model(*tables), tables)
    scored = scratch.save(encoded.mapInArrow(_score(sc.broadcast((tables, params))), "one long, two long, score double"))
    scored = scored.groupBy("one", "two").agg(F.min("score").alias("score"))  # equal texts have equal scores
    asked = docs.mapInArrow(_ask(sc.broadcast((head, head_count)), n_ranges), "key long, chunk long, blob binary")
    table_ = merged.where("key >= 0").select("key", F.lit(-1).cast("long").alias("chunk"), "blob")
    found = asked.unionByName(table_).groupBy("key").applyInPandas(_look_up, "chunk long, meta boolean, blob binary")
    based = found.groupBy("chunk").applyInPandas(_finish(int(n), int(v), texts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, one long, two long")
    return based.join(scored, ["one", "two"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"))
