"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A text becomes units: maximal runs of characters in which every neighbouring pair occurs inside some piece, so no piece
can cross a unit's edge and units encode independently.  Distinct units of equal length advance together, one character
at a time: hashes of all substrings probe the sorted piece keys, and maxima over the pieces that end at a position
store the back-pointers.

Two kinds of model are read.  For a unigram model the maximum is over summed scores.  A BPE model does not maximise
scores, and the plain Viterbi path gives other tokens than its merges do; here the same recursion runs on validity: the
token that ends at a position continues the best path before it only if merging their joined text by rank gives back
exactly these two tokens.  At each position one candidate is valid, and the path equals the merge result.

Scoring is a map over whole texts, without shuffle.  Workers keep a bounded cache of encoded units; it changes no result.

Edge cases: null and empty texts have no tokens and decode to the empty string.  U+2581 in a text is a space to
SentencePiece, so it decodes as a space and ``round_trip`` is false.  Characters outside the vocabulary become byte
pieces, or the unknown piece if the model has no byte pieces.  Repeated rows are encoded one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbatch as B
from .store import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
SPACE = 0x2581
CACHE_UNITS = 1_000_000
PAIR_SLOTS = 1 << 21
BUCKET_BITS = 18
#: Characters of a part, and how many parts learn their new units together: long arrays, short texts in memory.
ENCODE_CHARS = 1_000_000
PARTS_TOGETHER = 12


def _merge_by_rank(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge the best-ranked neighbouring pair, leftmost first, to the end; also the last pair that was merged."""
    last = None
    while len(symbols) > 1:
        best = min((rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best[0] == 1 << 40:
            break
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols, last


class Vocabulary:
    """A SentencePiece model's pieces as sorted arrays, ready to be shipped to workers."""

    def __init__(self, path: str = MODEL_PATH):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.key = uuid.uuid4().hex  # copies that workers unpickle are the same vocabulary
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the identity normaliser are supported")
        self.bpe = proto.trainer_spec.model_type == 2
        self.dummy_prefix = norm.add_dummy_prefix
        types = np.array([p.type for p in proto.pieces])
        self.unk = int(np.flatnonzero(types == UNKNOWN)[0])
        self.byte_ids = np.flatnonzero(types == BYTE)
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)]
        known = {p for p, _, _ in normal}
        bare = sorted({c for p, _, _ in normal for c in p} - known)  # characters that only longer pieces have
        entries = normal + [(c, -1, 0.0) for c in bare]
        order = {s: r for r, s in enumerate(sorted({-x for _, _, x in normal}))}
        rank = {p: order[-x] for p, _, x in normal}
        self.split: list[tuple[str, str]] = []
        kept, halves = [], []
        for p, i, x in entries:
            merged, last = _merge_by_rank(list(p), rank) if self.bpe else ([p], None)
            if len(merged) == 1:
                kept.append((p, i, x))
                halves.append(last)
        text = [p for p, _, _ in kept]
        flat, edges = B.codes(text)
        keys = B.span_hashes(flat, edges[:-1], edges[1:])
        by_key = np.argsort(keys)
        place = {text[j]: n for n, j in enumerate(by_key)}
        self.keys = keys[by_key]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.find = B.Places(self.keys, BUCKET_BITS).find
        self.ids = np.array([kept[j][1] for j in by_key], np.int32)
        self.score = np.array([kept[j][2] for j in by_key])
        self.unknown_score = float(min(x for _, _, x in kept)) - 10
        self.length = np.diff(edges)[by_key].astype(np.int64)
        # base characters come before every merge
        self.rank = np.array([-1 if len(text[j]) == 1 else rank[text[j]] for j in by_key], np.int64)
        self.left = np.array([n if halves[j] is None else place[halves[j][0]] for n, j in enumerate(by_key)])
        self.right = np.array([n if halves[j] is None else place[halves[j][1]] for n, j in enumerate(by_key)])
        self.longest = int(self.length.max())
        self.pairs = sorted({(ord(a), ord(b)) for p in text for a, b in zip(p, p[1:], strict=False)})
        # what each id decodes to, as bytes
        chars = [p.piece.replace("▁", " ").encode() for p in proto.pieces]
        for n, i in enumerate(self.byte_ids):
            chars[i] = bytes([n])
        for i in np.flatnonzero(~np.isin(types, (NORMAL, USER_DEFINED, BYTE))):
            chars[i] = b" \xe2\x81\x87 " if i == self.unk else b""
        self.out = np.frombuffer(b"".join(chars), np.uint8)
        self.out_at = np.concatenate([[0], np.cumsum([len(c) for c in chars])])


class Encoder:
    """Encodes chunks of texts; keeps units that it has encoded."""

    def __init__(self, vocabulary: Vocabulary, cache_units: int = CACHE_UNITS):
        self.v = vocabulary
        self.cache_units = cache_units
        # raw (unmixed) hashes of pieces, to hash joined pieces without their text
        self._slots = np.full(PAIR_SLOTS, -1, np.int64)
        self._valid = np.zeros(PAIR_SLOTS, bool)
        self._raw: np.ndarray | None = None
        # characters by number: 0 is in no pair; whether two may stand together in a piece
        pairs = np.array(vocabulary.pairs, np.int64).reshape(-1, 2)
        members = np.unique(pairs)
        self._number = np.zeros(0x110000, np.int32)
        self._number[members] = np.arange(1, len(members) + 1)
        self._together = np.zeros((len(members) + 1, len(members) + 1), bool)
        self._together[self._number[pairs[:, 0]], self._number[pairs[:, 1]]] = True
        self.clear()

    def clear(self) -> None:
        #: Hashes of units in order, and the number of each; tokens of units by number.
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.places = B.Places(self.known, 1)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each unit, or -1."""
        at = self.places.find(keys)
        return np.where(at >= 0, self.number[at], -1) if len(self.number) else at.astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat, and len(texts) + 1 offsets."""
        return next(self.encode_parts([texts]))

    def encode_parts(self, parts: list[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of each part; units that the cache lacks are encoded together, so that arrays are long."""
        cut = [self._cut(texts) for texts in parts]
        self._learn([c[4:] for c in cut])
        for number, at, fresh, keys, *_ in cut:
            number[fresh] = self._numbers(keys)
            count = self.count[number]
            total = np.concatenate([[0], np.cumsum(count)])
            ids = self.tokens[np.repeat(self.first[number] - total[:-1], count) + np.arange(total[-1])]
            yield ids, total[at]
        if len(self.known) > self.cache_units:
            self.clear()

    def _cut(self, texts) -> tuple[np.ndarray, ...]:
        """Number of every unit, each text's first unit, units that lack a number and their hashes; hashes, lengths and
        characters of what is to be learned."""
        prefix = chr(SPACE) if self.v.dummy_prefix else ""
        flat, offsets = B.codes([prefix + t if t else None for t in texts])
        flat = np.where(flat == 32, np.uint32(SPACE), flat)
        character = self._number[flat]
        edge = np.ones(len(flat), bool)
        edge[1:] = ~self._together[character[:-1], character[1:]]
        edge[offsets[:-1][offsets[:-1] < len(flat)]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(flat))[: len(starts)]
        keys = B.span_hashes(flat, starts, ends)
        number = self._numbers(keys)
        fresh = np.flatnonzero(number < 0)
        unique, sample = np.unique(keys[fresh], return_index=True)
        sample = fresh[sample]
        size = ends[sample] - starts[sample]
        first = np.cumsum(size) - size
        characters = flat[np.repeat(starts[sample] - first, size) + np.arange(size.sum())]
        return number, np.searchsorted(starts, offsets), fresh, keys[fresh], unique, size, characters

    def _learn(self, lacking: list[tuple[np.ndarray, ...]]) -> None:
        keys, size, flat = (np.concatenate(x) for x in zip(*lacking, strict=True))
        if not len(keys):
            return
        ends = np.cumsum(size)
        keys, sample = np.unique(keys, return_index=True)
        ids, edges = self._units(flat, ends[sample] - size[sample], ends[sample])
        number = np.concatenate([self.number, len(self.first) + np.arange(len(keys))])
        self.first = np.concatenate([self.first, len(self.tokens) + edges[:-1]])
        self.count = np.concatenate([self.count, np.diff(edges)])
        self.tokens = np.concatenate([self.tokens, ids])
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        self.known, self.number = known[order], number[order]
        self.places = B.Places(self.known, len(known).bit_length())

    def _units(self, flat, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of units, flat, and offsets.  Units of one length advance together."""
        size = ends - starts
        pieces: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            step = max(1, 2_000_000 // int(length))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                grid = flat[starts[part][:, None] + np.arange(length)]
                ids, who = self._viterbi(grid)
                pieces.append(ids)
                owner.append(part[who])
        ids, who = np.concatenate(pieces), np.concatenate(owner)
        order = np.argsort(who, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(starts)))])

    def _viterbi(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of equal-length units in order, and the unit that each belongs to."""
        v, (n, length) = self.v, grid.shape
        flat = grid.ravel()
        found: list[np.ndarray] = []
        begin = np.arange(n)[:, None] * length
        for size in range(1, min(length, v.longest) + 1):
            at = (begin + np.arange(length - size + 1)).ravel()
            found.append(v.find(B.span_hashes(flat, at, at + size)).reshape(n, -1))
        last = np.full((n, length + 1), -1, np.int64)  # piece that ends here; -2: an unknown character
        back = np.zeros((n, length + 1), np.int64)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        for i in range(1, length + 1):
            for size in range(min(i, v.longest), 0, -1):
                piece = found[size - 1][:, i - size]
                can = (piece >= 0) & (best[:, i - size] > -np.inf)
                # of a BPE model's candidates one is valid, so a text that has it is done with this position
                ok = np.flatnonzero(can & (best[:, i] == -np.inf) if v.bpe else can)
                if not len(ok):
                    continue
                if v.bpe:
                    if i > size:
                        ok = ok[self._joins(last[ok, i - size], piece[ok])]
                    value = np.zeros(len(ok))
                else:
                    value = best[ok, i - size] + v.score[piece[ok]]
                better = value > best[ok, i]
                ok = ok[better]
                best[ok, i], last[ok, i], back[ok, i] = value[better], piece[ok], i - size
            lost = np.flatnonzero((best[:, i] == -np.inf) & (best[:, i - 1] > -np.inf) & (found[0][:, i - 1] < 0))
            best[lost, i] = best[lost, i - 1] + (0 if v.bpe else v.unknown_score)
            last[lost, i], back[lost, i] = -2, i - 1
        return self._follow(grid, last, back)

    def _follow(self, grid, last, back) -> tuple[np.ndarray, np.ndarray]:
        n, length = grid.shape
        at = np.full(n, length)
        steps_piece, steps_unit, steps_at = [], [], []
        alive = np.arange(n)
        while len(alive):
            here = at[alive]
            steps_piece.append(last[alive, here])
            steps_unit.append(alive)
            at[alive] = back[alive, here]
            steps_at.append(at[alive].copy())
            alive = alive[at[alive] > 0]
        piece, unit, start = map(np.concatenate, (steps_piece, steps_unit, steps_at))
        order = np.lexsort((start, unit))
        piece, unit, start = piece[order], unit[order], start[order]
        ids = np.where(piece >= 0, self.v.ids[np.maximum(piece, 0)], -1)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32), unit
        if not len(self.v.byte_ids):
            ids[odd] = self.v.unk
            return ids.astype(np.int32), unit
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in grid[unit[odd], start[odd]]]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(s) for s in spelled]
        out, who = np.repeat(ids, width), np.repeat(unit, width)
        out[out < 0] = self.v.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return out.astype(np.int32), who

    def _joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of pieces a and b by rank gives a and b; remembers recent pairs."""
        pair = a.astype(np.int64) * len(self.v.keys) + b
        slot = (pair * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
        result = self._valid[slot]
        miss = np.flatnonzero(self._slots[slot] != pair)
        if len(miss):
            result[miss] = self._check_joins(a[miss], b[miss])
            self._slots[slot[miss]], self._valid[slot[miss]] = pair[miss], result[miss]
            # two misses may share a slot: whichever wrote last must own both arrays
            self._valid[slot[miss]] = False
            own = miss[self._slots[slot[miss]] == pair[miss]]
            self._valid[slot[own]] = result[own]
        return result

    def _check_joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges on both sides of the seam, latest first; no merge across it may have come earlier."""
        v = self.v
        valid = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        a, b, open_ = a.copy(), b.copy(), np.flatnonzero(a >= 0)
        while len(open_):
            x, y = a[open_], b[open_]
            across = v.find(self._joined_key(x, y))
            early = (across >= 0) & (v.rank[across] < limit[open_])
            valid[open_[early]] = False
            live = ~early & ((v.rank[x] >= 0) | (v.rank[y] >= 0))
            open_, x, y = open_[live], x[live], y[live]
            undo_left = v.rank[x] > v.rank[y]
            limit[open_] = np.where(undo_left, v.rank[x], v.rank[y] + 1)
            a[open_] = np.where(undo_left, v.right[x], x)
            b[open_] = np.where(undo_left, y, v.left[y])
        return valid

    def _joined_key(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Hash of the concatenated pieces."""
        if self._raw is None:
            k = B.unmix64(self.v.keys)
            self._raw = k - self.v.length.astype(np.uint64) * B.LENGTH_FACTOR
        n = self.v.length
        raw = self._raw[x] + self._raw[y] * B.powers(self.v.longest + 1)[n[x]]
        return B.mix64(raw + (n[x] + n[y]).astype(np.uint64) * B.LENGTH_FACTOR)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of token sequences."""
        width = np.diff(self.v.out_at)[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        data = self.v.out[np.repeat(self.v.out_at[ids] - ends[:-1], width) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets]
        skip = 1 if self.v.dummy_prefix else 0
        texts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = data[a:b]
            texts.append((own[skip:] if own[:1] == b" " else own).decode("utf-8", "replace"))
        return texts


_WORKERS: dict[str, Encoder] = {}


def worker_encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this worker process, with what it has cached in earlier tasks."""
    if vocabulary.key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[vocabulary.key] = Encoder(vocabulary)
    return _WORKERS[vocabulary.key]


def encode_chunks(encoder: Encoder, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, ids, offsets) of runs of texts."""
    runs = list(B.chunks(texts, ENCODE_CHARS))
    for n in range(0, len(runs), PARTS_TOGETHER):
        group = runs[n : n + PARTS_TOGETHER]
        parts = encoder.encode_parts([texts[a:b] for a, b in group])
        for (a, b), (ids, offsets) in zip(group, parts, strict=True):
            yield a, b, ids, offsets


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, token_ids, decoded text's equality with the text (round_trip); one row per row of ``docs``."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b, ids, offsets in encode_chunks(encoder, texts):
                again = encoder.decode(ids, offsets)
                same = [(t or "") == d for t, d in zip(texts[a:b], again, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), lists, pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "token_ids", "round_trip"])

    return rows.mapInArrow(B.tidy(run), f"`{id_col}` {id_type}, n_tokens long, token_ids array<int>, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), Vocabulary())
