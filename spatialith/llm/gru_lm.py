"""Log-likelihoods of whole documents under a gated recurrent language model, and under smoothed word counts.

Tokens are words (runs of anything but ASCII white space, A-Z lower-cased) and one end token a text.  Words are told
apart by a 64-bit hash.

Counts: all texts are counted, in training and in all, pre-aggregated per task and summed by word; nothing is cut off.
About ``SENT_WORDS`` words with the greatest counts in all texts (ties by hash) are sent to all tasks, so a word that meets
its count by a shuffle, once a text, has fewer occurrences than any of them, in held-out texts too.

Model: the ``VOCABULARY`` - 1 tokens most frequent in training (ties by hash) and one name for all others.  A gated
recurrent unit in numpy reads them; the output is factored into a softmax over classes of frequency rank and one over the
words of the class.  A word outside the vocabulary is scored by the model as 'other', then by its smoothed count among the
others, so the score is a probability of the text up to the hash.  Training is truncated back-propagation over runs of
windows, with state carried over the windows of a run.  Runs go to ``ROUNDS`` rounds and, by a hash of identifier, place
and tokens, to groups of about ``GROUP_TOKENS`` tokens; in each round every group starts from the same weights and learns from its runs
in the order of their hashes, and the groups' weights are averaged, ``AVERAGED`` at a time.  So the network learns from every
training token once, and its weights don't depend on how the table is partitioned.  Scoring carries the state across
windows through the complete text.

Edge cases: null text counts as empty; an empty text is the end token alone.  A null identifier is in the fold of its
crc32, null, and counts as training.  Without training texts counts are 0 and both scores are those of a uniform guess.
Repeated rows are scored one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as B
from .counts import most_frequent
from .store import Scratch, table

FOLDS = 10
SMOOTH = 0.1
#: Hash of the end token.
END = np.uint64(0xE4D5E4D5E4D5E4D5)
#: Words that are sent to all tasks, but for a few thousand at ties: 16 bytes each.
SENT_WORDS = 1 << 18
CLASSES = 64
VOCABULARY = CLASSES * CLASSES
EMBED, HIDDEN = 24, 32
#: Values of a step's column: state, token, one and reset state; the first three make two gates.
INPUTS, FIRST = 2 * HIDDEN + EMBED + 1, HIDDEN + EMBED + 1
WINDOW = 32
RUN_WINDOWS = 4
ROUNDS = 2
TRAIN_ROWS = 256
#: Groups whose weights are added up in one task.
AVERAGED = 8
#: Training tokens of all rounds that one group learns from; groups train side by side.
GROUP_TOKENS = 1 << 22
LEARNING_RATE = 0.01
#: Span of logits within which exponentials of single precision keep their sums.
FAR = 60
#: Rows of one softmax, and weights of one update, few enough to stay in a core's cache.
AT_ONCE = 256
ADAM_ONCE = 1 << 14
#: Distinct words that a counting task holds before it hands on what it has.
HELD_WORDS = 1_000_000
#: Tokens whose texts advance together, and states that wait for their softmax.
SCORE_TOKENS = 4_000_000
SCORE_STATES = 16_384
#: Sequences that advance side by side.
SCORE_ROWS = 512


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end token included, flat, and len(texts) + 1 offsets."""
    flat, offsets = B.lowered_codes(texts)
    starts, ends, at = B.words(flat, offsets)
    n = np.diff(at)
    edges = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(edges[-1], END, np.uint64)
    inside = np.ones(edges[-1], bool)
    inside[edges[1:] - 1] = False
    out[inside] = B.span_hashes(flat, starts, ends)
    return out, edges


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps (text, held_out) to (w, c, a): a word's occurrences in training and in all texts."""
    B.keep_freed()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([w for w, _, _ in held]), return_inverse=True)
        sums = (np.bincount(place, np.concatenate([h[k] for h in held]), len(words)).astype(np.int64) for k in (1, 2))
        return words, *sums

    def out() -> pa.RecordBatch:
        words, train, every = held[0]
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(train), pa.array(every)], ["w", "c", "a"])

    for batch in batches:
        texts, held_out = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in B.chunks(texts):
            hashes, edges = token_hashes(texts[a:b])
            out_of_it = np.repeat(held_out[a:b], np.diff(edges))
            for part, learned in ((hashes[~out_of_it], 1), (hashes[out_of_it], 0)):  # plain sorts, without places
                if len(part):
                    words, every = np.unique(part, return_counts=True)
                    held.append((words, every * learned, every))
            if sum(len(w) for w, _, _ in held[1:]) > HELD_WORDS / 2:
                held = [merged()]
                if len(held[0][0]) > HELD_WORDS:
                    yield out()
                    held = []
    if held:
        held = [merged()]
        yield out()


class Words:
    """The words that all tasks know: sorted hashes, counts, and the model's number (0: other)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        by_count = np.lexsort((self.hashes.view(np.int64), -self.counts))[: VOCABULARY - 1]
        by_count = by_count[self.counts[by_count] > 0]
        self.number = np.zeros(len(order), np.int32)
        self.number[by_count] = np.arange(1, len(by_count) + 1)
        self.model_counts = np.zeros(VOCABULARY, np.int64)
        self.model_counts[1 : len(by_count) + 1] = self.counts[by_count]

    @cached_property
    def places(self) -> B.Places:
        """Built where it is used: the driver sends the hashes alone."""
        return B.Places(self.hashes, max(1, len(self.hashes).bit_length()))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return self.places.find(hashes)

    def numbers(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.number[place] if len(self.number) else 0, 0)


class Gru:
    """Weights of the model, its forward pass, and one training step."""

    SHAPES = {
        "embed": (VOCABULARY, EMBED),
        "w": (EMBED, 3 * HIDDEN),
        "u": (HIDDEN, 3 * HIDDEN),
        "b": (3 * HIDDEN,),
        "class_w": (HIDDEN, CLASSES),
        "class_b": (CLASSES,),
        "word_w": (CLASSES, HIDDEN, CLASSES),
        "word_b": (CLASSES, CLASSES),
    }

    def __init__(self, flat: np.ndarray):
        self.p, at = {}, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            self.p[name] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n

    @classmethod
    def start(cls, model_counts: np.ndarray, other: int) -> Gru:
        """Small random weights (fixed seed); biases that give each token its share of the counts."""
        rng = np.random.default_rng(20240229)
        parts = [rng.normal(0, 0.1, s).ravel() for s in cls.SHAPES.values()]
        net = cls(np.concatenate(parts))
        counts = model_counts.astype(float) + SMOOTH
        counts[0] = other + SMOOTH
        grid = counts.reshape(CLASSES, CLASSES)
        net.p["b"][:] = 0
        net.p["class_b"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
        net.p["word_b"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
        net.p["class_w"] *= 0.1
        net.p["word_w"] *= 0.1
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def inputs(self, tokens: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What each token adds to the three gates."""
        return self.p["embed"][tokens] @ self.p["w"] + self.p["b"]

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step in plain form, a row a sequence; scoring and training do the same with a column a sequence."""
        u = self.p["u"]
        r, z = np.split(np.tanh((h @ u[:, : 2 * HIDDEN] + gates[:, : 2 * HIDDEN]) / 2) / 2 + 0.5, 2, axis=1)
        c = np.tanh((r * h) @ u[:, 2 * HIDDEN :] + gates[:, 2 * HIDDEN :])
        return h + z * (c - h), r, z, c

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Products that make the gates of a column: of state, token and one; of token, one and reset state."""
        w, u, b, cut = self.p["w"], self.p["u"], self.p["b"][None], 2 * HIDDEN
        rz = np.concatenate([u[:, :cut], w[:, :cut], b[:, :cut]]).T / 2  # a sigmoid is half a tangent of half its value, and a half
        return np.ascontiguousarray(rz), np.ascontiguousarray(np.concatenate([w[:, cut:], b[:, cut:], u[:, cut:]]).T)

    def log_prob(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of targets given states.

        With ``grads``, also adds gradients of their sum to what it holds, and gives those of the states.
        """
        # a last input that is always one takes the biases into the products
        return self._log_prob(np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1), target, grads)

    def _log_prob(self, x: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        p = self.p
        kind, word = target // CLASSES, target % CLASSES
        order = np.argsort(kind.astype(np.uint16), kind="stable")  # two bytes sort by counting
        squares = np.einsum("ij,ij->i", x, x).max(initial=1) - 1
        longest = math.sqrt(max(squares, 0.0))
        buffer, ones = np.empty((min(AT_ONCE, len(x)), CLASSES), x.dtype), np.ones(CLASSES, x.dtype)
        start = np.arange(len(buffer)) * CLASSES

        def factor(x: np.ndarray, want: np.ndarray, parts: list, weight: str, bias: str) -> tuple[np.ndarray, np.ndarray | None]:
            """Log-probability of ``want`` under the softmax of each part's rows, and its gradients by states."""
            head = np.concatenate([p[weight], p[bias][..., None, :]], -2)
            small = bool(longest * math.sqrt(np.square(p[weight]).sum(-2).max()) + np.abs(p[bias]).max() < FAR)
            found, back = np.empty(len(x), x.dtype), None
            if grads is not None:
                sums, back = np.zeros_like(head), np.empty((len(x), HIDDEN), x.dtype)
                turned, begins = np.ascontiguousarray(np.swapaxes(p[weight], -1, -2)), {}

            def softmax(parts: list[tuple[tuple, int, int]]) -> None:
                first, last = parts[0][1], parts[-1][2]
                e = buffer[: last - first]
                for at, a, b in parts:
                    np.matmul(x[a:b], head[at], out=e[a - first : b - first])
                if not small:  # else no term vanishes or overflows as it is
                    # one shift for all rows, unless they lie so far apart that a row's terms could vanish
                    top = e.max()
                    e -= top if top - e.min() < FAR else e.max(1, keepdims=True)
                flat, aim = e.reshape(-1), start[: last - first] + want[first:last]
                value = flat.take(aim)
                np.exp(e, out=e)
                total = e @ ones
                np.subtract(value, np.log(total), out=found[first:last])
                if grads is not None:
                    e *= (-1 / total)[:, None]
                    flat[aim] += 1
                    for at, a, b in parts:
                        own = e[a - first : b - first]
                        if a == begins.get(at, a):  # the first rows of these weights
                            np.matmul(x[a:b].T, own, out=sums[at])
                            begins[at] = a
                        else:
                            sums[at] += x[a:b].T @ own
                        np.matmul(own, turned[at], out=back[a:b])

            some: list = []
            for part in parts:  # classes of few rows share all but the products
                if some and part[2] - some[0][1] > AT_ONCE:
                    softmax(some)
                    some = []
                some.append(part)
            if some:
                softmax(some)
            if grads is not None:
                for name, own in ((weight, sums[..., :-1, :]), (bias, sums[..., -1, :])):
                    grads[name] = grads[name] + own if name in grads else own.copy()
            return found, back

        whole = [((), a, min(a + AT_ONCE, len(x))) for a in range(0, len(x), AT_ONCE)]
        cuts = np.searchsorted(kind.take(order), np.arange(CLASSES + 1)).tolist()
        by_class = [((k,), a, min(a + AT_ONCE, cuts[k + 1])) for k in range(CLASSES) for a in range(cuts[k], cuts[k + 1], AT_ONCE)]
        value, back = factor(x, kind, whole, "class_w", "class_b")
        found, more = factor(x.take(order, 0), word.take(order), by_class, "word_w", "word_b")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        value = value.astype(np.float64)
        value += found.take(place)
        if back is not None:
            back += more.take(place, 0)
        return value, back

    def score(self, tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Natural log-probability of each whole sequence; sequences advance together, state carried to the end."""
        size = np.diff(edges)
        order = np.argsort(-size, kind="stable")
        size, first = size[order], edges[:-1][order]
        total = np.zeros(len(order))
        gates_rz, gates_c = self._gates()
        embed = np.ascontiguousarray(self.p["embed"].T)
        # states that wait for their softmax, a last one after each; what they aim at and whose they are
        states = np.ones((SCORE_STATES + SCORE_ROWS, HIDDEN + 1), np.float32)
        targets, owners = np.empty((2, len(states)), np.int64)
        waiting = 0
        for a in range(0, len(order), SCORE_ROWS):  # so few side by side that they stay in a core's cache
            mine, begin = size[a : a + SCORE_ROWS], first[a : a + SCORE_ROWS]
            alive = np.searchsorted(-mine, -np.arange(int(mine[0])), side="left").tolist()  # sequences with more than t tokens
            h = np.zeros((HIDDEN, len(mine)), np.float32)
            before = np.zeros(len(mine), np.int64)  # the state before a text has read the 'other' token
            own = np.arange(a, a + len(mine))
            x = np.empty((0, 0), np.float32)
            for t, k in enumerate(alive):
                if k != x.shape[1]:
                    x, h, before = np.ones((INPUTS, k), np.float32), h[:, :k], before[:k]
                    begin, own = begin[:k], own[:k]
                x[:HIDDEN] = h
                np.take(embed, before, axis=1, out=x[HIDDEN : HIDDEN + EMBED], mode="clip")
                rz = gates_rz @ x[:FIRST]
                np.tanh(rz, out=rz)
                rz += 1
                rz *= 0.5
                np.multiply(rz[:HIDDEN], h, out=x[FIRST:])
                new = gates_c @ x[HIDDEN:]
                np.tanh(new, out=new)
                new -= h
                new *= rz[HIDDEN:]
                new += h
                h = new
                before = tokens.take(begin + t)
                here = slice(waiting, waiting + k)
                states[here, :HIDDEN], targets[here], owners[here] = h.T, before, own
                waiting += k
                if waiting >= SCORE_STATES:
                    total += np.bincount(owners[:waiting], self._log_prob(states[:waiting], targets[:waiting])[0], len(total))
                    waiting = 0
        if waiting:
            total += np.bincount(owners[:waiting], self._log_prob(states[:waiting], targets[:waiting])[0], len(total))
        out = np.empty(len(order))
        out[order] = total
        return out

    def train_window(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients over one window (rows by steps), truncated at its start, and the state after it.

        Each step has a column a row, of state, token, one and reset state, so every gate's values lie together.
        """
        p, cut = self.p, 2 * HIDDEN
        k, steps = x.shape
        gates_rz, gates_c = self._gates()
        embed = np.ascontiguousarray(p["embed"].T)
        x = np.ascontiguousarray(x.T)
        xs = np.empty((steps + 1, INPUTS, k), h.dtype)
        xs[:, HIDDEN + EMBED] = 1
        xs[0, :HIDDEN] = h.T
        rzs, cs = np.empty((steps, cut, k), h.dtype), np.empty((steps, HIDDEN, k), h.dtype)
        for t in range(steps):
            here, rz, c, old, new = xs[t], rzs[t], cs[t], xs[t, :HIDDEN], xs[t + 1, :HIDDEN]
            np.take(embed, x[t], axis=1, out=here[HIDDEN : HIDDEN + EMBED], mode="clip")
            np.matmul(gates_rz, here[:FIRST], out=rz)
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            np.multiply(rz[:HIDDEN], old, out=here[FIRST:])
            np.matmul(gates_c, here[HIDDEN:], out=c)
            np.tanh(c, out=c)
            np.subtract(c, old, out=new)
            new *= rz[HIDDEN:]
            new += old
        states = np.ones((steps, k, HIDDEN + 1), h.dtype)
        states[..., :-1] = xs[1:, :HIDDEN].transpose(0, 2, 1)
        after = states[-1, :, :-1].copy()
        grads: dict[str, np.ndarray] = {}
        here = np.flatnonzero(mask.T)
        back = np.zeros((steps, k, HIDDEN), h.dtype)
        back.reshape(-1, HIDDEN)[here] = self._log_prob(states.reshape(-1, HIDDEN + 1).take(here, 0), y.T.ravel().take(here), grads)[1]
        back = np.ascontiguousarray(back.transpose(0, 2, 1))
        # gradients of what the gates take in: by state or reset state, and by token
        back_rz = np.concatenate([p["u"][:, :cut], p["w"][:, :cut]])
        back_c = np.concatenate([p["u"][:, cut:], p["w"][:, cut:]])
        by_token = np.empty((EMBED, steps, k), h.dtype)
        sum_rz, sum_c = np.zeros((cut, FIRST), h.dtype), np.zeros((HIDDEN, FIRST), h.dtype)
        d_rz, (d_c, part), dh = np.empty((cut, k), h.dtype), np.empty((2, HIDDEN, k), h.dtype), np.zeros((HIDDEN, k), h.dtype)
        for t in range(steps - 1, -1, -1):
            here, c, r, z, old = xs[t], cs[t], rzs[t, :HIDDEN], rzs[t, HIDDEN:], xs[t, :HIDDEN]
            dh += back[t]
            np.multiply(c, c, out=part)
            np.subtract(1, part, out=part)
            part *= z
            np.multiply(dh, part, out=d_c)
            by_c = back_c @ d_c
            drh = by_c[:HIDDEN]
            np.subtract(1, r, out=part)
            part *= here[FIRST:]
            np.multiply(drh, part, out=d_rz[:HIDDEN])
            np.subtract(1, z, out=part)
            c -= old
            c *= z
            dh *= part
            np.multiply(dh, c, out=d_rz[HIDDEN:])
            drh *= r
            dh += drh
            by_rz = back_rz @ d_rz
            dh += by_rz[:HIDDEN]
            np.add(by_rz[HIDDEN:], by_c[HIDDEN:], out=by_token[:, t])
            sum_rz += d_rz @ here[:FIRST].T
            sum_c += d_c @ here[HIDDEN:].T
        sum_rz, sum_c = sum_rz.T, sum_c.T
        grads["u"] = np.concatenate([sum_rz[:HIDDEN], sum_c[EMBED + 1 :]], 1)
        grads["w"] = np.concatenate([sum_rz[HIDDEN:-1], sum_c[:EMBED]], 1)
        grads["b"] = np.concatenate([sum_rz[-1], sum_c[EMBED]])
        read = x.ravel()
        by_embed = np.empty(embed.shape, h.dtype)
        for own, out in zip(by_token.reshape(EMBED, -1), by_embed, strict=True):
            out[:] = np.bincount(read, own, VOCABULARY)
        grads["embed"] = by_embed.T
        return grads, after

    def train(self, runs: Iterator[np.ndarray]) -> int:
        """Adam over batches of runs, one step a window; returns the tokens that it learned from."""
        # a window reads the columns of this table, one token each
        self.p = {k: np.asfortranarray(x) if k == "embed" else np.ascontiguousarray(x) for k, x in self.p.items()}
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, seen = 0, 0
        for batch in _batches(runs, TRAIN_ROWS):
            batch.sort(key=len, reverse=True)  # runs that have ended drop out of later windows
            wide = len(batch[0])
            y = np.zeros((len(batch), wide), np.int64)
            mask = np.zeros(y.shape, bool)
            for i, r in enumerate(batch):
                y[i, : len(r)], mask[i, : len(r)] = r, True
            x = np.concatenate([np.zeros((len(batch), 1), np.int64), y[:, :-1]], 1)
            h = np.zeros((len(batch), HIDDEN), np.float32)
            for a in range(0, wide, WINDOW):
                k = int(mask[:, a].sum())
                here = slice(None, k), slice(a, a + WINDOW)
                n = int(mask[here].sum())
                grads, h = self.train_window(x[here], y[here], mask[here], h[:k])
                step += 1
                seen += n
                norm = math.sqrt(sum(float(np.vdot(each := g.ravel("K"), each)) for g in grads.values())) / n
                scale = 1 / n / max(1.0, norm)
                rate, spread = LEARNING_RATE / (1 - 0.9**step), 1 / math.sqrt(1 - 0.99**step)
                for k, g in grads.items():
                    whole = [each.ravel("F" if k == "embed" else "C") for each in (g, m[k], v[k], self.p[k])]
                    for at in range(0, g.size, ADAM_ONCE):
                        g_, m_, v_, p_ = (each[at : at + ADAM_ONCE] for each in whole)
                        g_ *= 0.1 * scale
                        m_ *= 0.9
                        m_ += g_
                        g_ *= g_
                        v_ *= 0.99
                        v_ += g_  # a hundredth of the squared gradient
                        np.sqrt(v_, out=g_)
                        g_ += 1e-6 / spread
                        np.divide(m_, g_, out=g_)
                        g_ *= rate / spread
                        p_ += g_
        return seen


def _batches(items: Iterator, n: int) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def _training_runs(part: int, rounds: int, groups: int):
    """Maps (salt, numbers) to (g, h, tokens): the runs of windows of a round, dealt by hash of salt, place and tokens.

    The salt, a hash of the identifier, spreads the copies of a text over all groups.
    """
    span = WINDOW * RUN_WINDOWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts, packed = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_pylist()
            for lo, hi in B.chunks(packed, 4 * B.CHUNK_CHARS):
                numbers = np.frombuffer(b"".join(packed[lo:hi]), "<u2")
                edges = np.concatenate([[0], np.cumsum([len(x) // 2 for x in packed[lo:hi]])]).astype(np.int64)
                count = (np.diff(edges) + span - 1) // span
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first = np.repeat(edges[:-1], count) + span * place
                last = np.minimum(first + span, np.repeat(edges[1:], count))
                at = np.arange(len(numbers)) - np.repeat(first, last - first)
                mixed = B.mix64(numbers.astype(np.uint64) << np.uint64(16) | at.astype(np.uint64))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
                h = B.mix64(sums[last] - sums[first] + B.mix64(np.repeat(salts[lo:hi], count) + place.astype(np.uint64)))
                use = np.flatnonzero(h % np.uint64(rounds) == part)
                g = (h[use] >> np.uint64(8)) % np.uint64(groups)
                tokens = [numbers[x:y].tobytes() for x, y in zip(first[use].tolist(), last[use].tolist(), strict=True)]
                columns = [pa.array(g.astype(np.int32)), pa.array(h[use].view(np.int64)), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["g", "h", "tokens"])

    return run


TRAINED = "g int, seen double, total binary"


def _train_groups(net_flat: np.ndarray):
    """Maps (g, tokens), sorted by group, to each group's weights times the tokens that it learned from."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.keep_freed()
        rows = ((g, np.frombuffer(t, "<u2")) for b in batches for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for g, runs in groupby(rows, key=lambda r: r[0]):
            net = Gru(net_flat)
            seen = net.train(r.astype(np.int64) for _, r in runs)
            yield _sums_row(g, float(seen), net.flat().astype(np.float64) * seen)

    return train


def _sums_row(g: int, seen: float, total: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([g], pa.int32()), pa.array([seen]), pa.array([total.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["g", "seen", "total"])


def _sum_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of every ``AVERAGED`` groups, which come sorted."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    for g, own in groupby(rows, key=lambda r: r[0] // AVERAGED):
        seen, total = 0.0, 0.0
        for _, s, t in own:
            seen, total = seen + s, total + np.frombuffer(t, np.float64)
        yield _sums_row(g, seen, total)


def train(rows: DataFrame, start: Gru, tokens: int, scratch: Scratch, rounds: int = ROUNDS) -> Gru:
    """Weights averaged over groups, by the tokens that each learned from; ``rows``: (salt, numbers) of training texts."""
    net = start
    groups = max(1, -(-tokens // GROUP_TOKENS))
    for n in range(rounds):
        runs = rows.mapInArrow(_training_runs(n, rounds, groups), "g int, h long, tokens binary").repartitionById(groups, F.col("g"))
        runs = runs.sortWithinPartitions("g", "h", "tokens").select("g", "tokens").mapInArrow(_train_groups(net.flat()), TRAINED)
        runs = scratch.keep(runs, f"round-{n}")
        left = groups
        while left > 1:
            left = -(-left // AVERAGED)
            runs = runs.repartitionById(left, F.floor(F.col("g") / AVERAGED).cast("int")).sortWithinPartitions("g")
            runs = runs.mapInArrow(_sum_groups, TRAINED)
        got = runs.collect()
        if not got:
            break
        net = Gru((np.frombuffer(got[0].total, np.float64) / got[0].seen).astype(np.float32))
    return net


LOOKED = (
    "id {}, held_out boolean, n_tokens long, n_sent long, sum_base double, n_other long, sum_other double, "
    "rest array<long>, times array<int>, numbers binary"
)


def _look(words: Words):
    """Per text: what the words that all tasks know add, hashes of the other words, and all tokens' numbers in the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.keep_freed()
        logs = np.log10(words.counts + SMOOTH)
        names = [c.split()[0] for c in LOOKED.split(", ")]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in B.chunks(texts):
                hashes, edges = token_hashes(texts[a:b])
                sizes = np.diff(edges)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = words.find(hashes)
                sent = place >= 0
                known = sent & (words.counts[np.maximum(place, 0)] > 0) if len(logs) else sent
                number = words.numbers(place)
                value = np.where(sent, logs[np.maximum(place, 0)] if len(logs) else 0.0, 0.0)
                add = lambda x: np.bincount(owner, x, len(sizes))  # noqa: B023, E731
                # other words: each once a text
                rest, who = hashes[~sent].view(np.int64), owner[~sent]
                by_word = np.lexsort((rest, who))
                rest, who = rest[by_word], who[by_word]
                new = np.ones(len(rest), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (who[1:] != who[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rest)))
                rest, rest_at = rest[first], np.searchsorted(who[first], np.arange(len(sizes) + 1))
                packed = number.astype("<u2")
                columns = [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array(sizes),
                    pa.array(add(known).astype(np.int64)),
                    pa.array(add(value)),
                    pa.array(add(number == 0).astype(np.int64)),
                    pa.array(add(np.where(number == 0, value, 0.0))),
                    pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), pa.array(rest)),
                    pa.ListArray.from_arrays(pa.array(rest_at, pa.int32()), pa.array(times, pa.int32())),
                    pa.array([packed[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _score(net_flat: np.ndarray):
    """Maps (.., numbers) to (.., net): the model's log-probability of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.keep_freed()
        net = Gru(net_flat)

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks()
            packed = batch.column("numbers").to_pylist()
            edges = np.concatenate([[0], np.cumsum([len(x) // 2 for x in packed])]).astype(np.int64)
            value = net.score(np.frombuffer(b"".join(packed), "<u2").astype(np.int64), edges)
            return batch.drop_columns(["numbers"]).append_column("net", pa.array(value)).to_batches()[0]

        held, n = [], 0
        for batch in batches:
            size = pc.binary_length(batch.column(batch.schema.get_field_index("numbers"))).to_numpy(zero_copy_only=False) // 2
            first, total = 0, 0
            for i, k in enumerate(size.tolist()):
                total += k
                if n + total > SCORE_TOKENS:
                    held.append(batch.slice(first, i + 1 - first))
                    yield out(held)
                    held, n, first, total = [], 0, i + 1, 0
            if first < batch.num_rows:
                held.append(batch.slice(first))
                n += total
        if held:
            yield out(held)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "gru-lm")
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = rows.select("text", "held_out").mapInArrow(_count, "w long, c long, a long")
    counts = scratch.keep(counts.groupBy("w").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n_train, v_train = total.n or 0, total.v or 0
    is_sent = most_frequent(counts, "a", SENT_WORDS)
    sent = counts.filter(is_sent | most_frequent(counts, "c", VOCABULARY - 1)).toPandas()
    words = Words(sent.w.to_numpy(np.int64).view(np.uint64), sent.c.to_numpy(np.int64))
    in_model = int(words.model_counts.sum())
    n_other, v_other = n_train - in_model, v_train - int((words.model_counts > 0).sum())
    id_type = rows.schema["id"].dataType.simpleString()
    looked = rows.mapInArrow(_look(words), LOOKED.format(id_type)).withColumn("row", F.monotonically_increasing_id())
    looked = scratch.keep(looked, "looked")
    learned = looked.filter("not held_out").select(F.xxhash64(F.col("id").cast("string")).alias("salt"), "numbers")
    net = train(learned, Gru.start(words.model_counts, n_other), n_train, scratch)

    rest = looked.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("w"), "r.times")
    met = rest.join(counts.filter(~is_sent).select("w", "c"), "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    met = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + F.lit(SMOOTH))).alias("sum_rest"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rest"),
    )
    slim = looked.drop("rest", "times")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "numbers") + ", net double"
    out = slim.mapInArrow(_score(net.flat()), schema).join(met, "row", "left")
    sum_rest, n_rest = F.coalesce("sum_rest", F.lit(0.0)), F.coalesce("n_rest", F.lit(0))
    base = F.col("sum_base") + sum_rest - F.col("n_tokens") * F.lit(math.log10(n_train + SMOOTH * (v_train + 1)))
    others = F.col("sum_other") + sum_rest - F.col("n_other") * F.lit(math.log10(n_other + SMOOTH * (v_other + 1)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_sent") + n_rest).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("net") / F.lit(math.log(10)) + others).alias("score"),
    )


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
