"""Near-duplicate embeddings: hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label collapse first and count with their multiplicity.  Each label's vectors are dealt into shards
of about ``SHARD_ROWS`` by hash, and a layered graph is built per shard.  For every pair of a label's shards (and every
shard with itself) each side's vectors search the other side's graph, many queries at a time in lockstep.  A search that
comes back with nothing but links may have missed some, so its beam doubles; beyond ``WIDEST`` the query scans the whole
shard instead, in blocks that are counted, united and forgotten.  First an audit compares a fixed sample of each task's
queries with brute force, on links and on the nearest neighbour, and the beam doubles until the audit's recall is
reached; then all queries search with that beam.  Candidates are verified by cosine in double precision; links are
united within the task and then over all tasks.

Scale: tasks hold two shards, and at most ``WIDEST`` pairs a vector, whatever a label's size or density; every shard of
a label meets every other one, in blocks, so work grows with the square of a label's number of shards.  Rows that leave a
task are one per vector, never one per link.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors with a
null label or of unlike length.  A null identifier gets a null component.  Rows that repeat an identifier count as
vectors of their own: classes have numbers of their own, and an identifier only names the component that it is the
smallest of.  An empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, table
from .textbatch import mix64

THRESHOLD = 0.98
SHARD_ROWS = 16384
DEGREE = 16
BUILD_BEAM = 48
FIRST_BEAM = 32
WIDEST = 256
AUDIT_ROWS = 64
AUDIT_RECALL = 0.99
BATCH = 256
AT_ONCE = 4
#: Rows of candidates, and pairs of a query and a node, whose vectors are gathered together.
CACHED_ROWS, CACHED_PAIRS = 64, 1024
#: Single precision in the search; what it finds within this margin is verified in double precision.
SLACK = 1e-4


#: In a beam, a place without a node.  It sorts behind all keys and counts as visited.
NO_NODE = np.iinfo(np.int64).max


def _keys(sims: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Integers that sort by falling similarity, then node: the bits of both, and a last bit that is set once visited."""
    bits = np.ascontiguousarray(sims, np.float32).view(np.int32)
    rising = bits ^ (bits >> 31 & 0x7FFFFFFF)
    return (~rising).astype(np.int64) << 32 | nodes.astype(np.int64) << 1


def _unkey(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and similarities of keys."""
    rising = ~(key >> 32).astype(np.int32)
    sims = (rising ^ (rising >> 31 & 0x7FFFFFFF)).view(np.float32)
    none = key == NO_NODE
    return np.where(none, -1, (key & 0xFFFFFFFF) >> 1), np.where(none, np.float32(-np.inf), sims)


class Graph:
    """A layered proximity graph over unit vectors."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, links: list[np.ndarray] | None = None):
        self.unit = unit.astype(np.float32)
        u = (mix64(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE)).astype(int), 6)
        # the highest vectors first: every layer has its nodes before others search through it
        self.order = np.lexsort((np.arange(len(ids)), -self.level))
        self.top = int(self.level.max()) if len(ids) else 0
        self.stamp, self.clock = np.zeros(0, np.int32), 0
        if links is not None:
            self.links = links
        else:
            self.links = [np.full((len(ids), DEGREE * (2 if n == 0 else 1)), -1, np.int32) for n in range(self.top + 1)]
            self._build()

    def _build(self) -> None:
        at, size = 1, 1
        while at < len(self.order):
            batch = self.order[at : at + size]
            self._insert(batch)
            at += len(batch)
            size = min(BATCH, at)

    def _insert(self, batch: np.ndarray) -> None:
        q = self.unit[batch]
        entry = np.full((len(batch), 1), self.order[0])
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        for layer in range(self.top, -1, -1):
            here = self.level[batch] >= layer
            beam = BUILD_BEAM if here.any() else 1
            found, sims = self._search_layer(q, entry, beam, layer)
            if here.any():
                peers = np.where(here[None, :], own[here], -np.inf)  # vectors of one batch don't find each other
                ids = np.concatenate([found[here], np.broadcast_to(batch, peers.shape)], 1)
                value = np.concatenate([sims[here], peers], 1)
                self._connect(batch[here], ids, value, layer)
            entry = found[:, : max(1, min(found.shape[1], 4))]
            entry = np.where(entry < 0, self.order[0], entry)

    def _connect(self, new: np.ndarray, ids: np.ndarray, value: np.ndarray, layer: int) -> None:
        table_, width = self.links[layer], self.links[layer].shape[1]
        k = min(width, ids.shape[1])
        best = np.argsort(-value, axis=1, kind="stable")[:, : 3 * k]
        ids, value = np.take_along_axis(ids, best, 1), np.take_along_axis(value, best, 1)
        chosen = self._diverse(ids, value, k)
        table_[new, :k] = chosen
        # links back: append, and prune rows that overflow
        src, dst = np.repeat(new, k), chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        extra = np.full((len(node), wide), -1, np.int64)
        extra[np.repeat(np.arange(len(node)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate([table_[node], extra], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        value = np.empty(both.shape, np.float32)
        for a in range(0, len(node), CACHED_ROWS):
            part, x = both[a : a + CACHED_ROWS], self.unit[node[a : a + CACHED_ROWS]]
            value[a : a + CACHED_ROWS] = (self.unit.take(np.maximum(part, 0), 0) @ x[:, :, None])[:, :, 0]
        value[(both < 0) | (both == node[:, None])] = -np.inf
        best = np.argsort(-value, axis=1, kind="stable")
        both, value = np.take_along_axis(both, best, 1), np.take_along_axis(value, best, 1)
        full = (value > -np.inf).sum(1) > width
        kept = np.where(value > -np.inf, both, -1)[:, :width]
        if full.any():
            kept[full] = self._diverse(both[full], value[full], width)
        table_[node, : kept.shape[1]] = kept

    def _diverse(self, ids: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
        """Of candidates sorted by similarity, up to k that lie nearer to the node than to those chosen before.

        Places that are left go to the nearest of the others.
        """
        ids, value = ids[:, : 2 * k], value[:, : 2 * k]
        valid = (value > -np.inf).sum(1)
        nearer = np.zeros(ids.shape, np.uint64)  # bit j of column c: candidate c is nearer to candidate j than to the node
        order = np.argsort(valid, kind="stable")  # rows of about as many candidates together
        for a in range(0, len(ids), CACHED_ROWS):
            rows = order[a : a + CACHED_ROWS]
            m = int(valid[rows[-1]])
            x = self.unit.take(np.maximum(ids[rows, :m], 0), 0)
            bits = np.zeros((len(rows), m, 64), bool)
            np.greater(x @ np.ascontiguousarray(x.transpose(0, 2, 1)), value[rows, :m, None], out=bits[:, :, :m])
            nearer[rows, :m] = np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]
        chosen, count, taken = np.zeros(len(ids), np.uint64), np.zeros(len(ids), int), np.zeros(ids.shape, bool)
        for c in range(int(valid.max(initial=0))):
            taken[:, c] = ok = (c < valid) & (count < k) & (nearer[:, c] & chosen == 0)
            chosen |= ok.astype(np.uint64) << np.uint64(c)
            count += ok
        m = ids.shape[1]
        rank = np.where(value == -np.inf, 3 * m, np.where(taken, 0, m) + np.arange(m)).astype(np.int16)
        best = np.argsort(rank, axis=1, kind="stable")[:, :k]
        picked = np.where(np.take_along_axis(rank, best, 1) < 3 * m, np.take_along_axis(ids, best, 1), -1)
        return np.pad(picked, ((0, 0), (0, k - picked.shape[1])), constant_values=-1)

    def _sims(self, q: np.ndarray, row: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Similarities of pairs of a query and a node, ordered by query, in pieces that stay in a core's cache."""
        out, near = np.empty(len(near), np.float32), near.astype(np.intp)
        if len(near) >= 64 * len(q):
            edge = np.searchsorted(row, np.arange(len(q) + 1)).tolist()
            for r, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                np.dot(self.unit.take(near[a:b], 0), q[r], out=out[a:b])
        else:
            for a in range(0, len(near), CACHED_PAIRS):
                x, y = self.unit.take(near[a : a + CACHED_PAIRS], 0), q.take(row[a : a + CACHED_PAIRS], 0)
                np.einsum("nd,nd->n", x, y, out=out[a : a + CACHED_PAIRS])
        return out

    def _search_layer(self, q: np.ndarray, entry: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes that each query's walk finds, best first; -1 and -inf where there are fewer.

        A query's beam is a row of sorted keys, see ``_keys``.  Each round visits its best unvisited nodes together,
        more of them the wider the beam, and only neighbours that enter the beam are sorted into it.
        """
        table_, nodes = self.links[layer], len(self.unit)
        take, width = max(AT_ONCE, beam // AT_ONCE), table_.shape[1]
        stamp, since = self._fresh_stamps(len(q)), self.clock
        entry = np.sort(entry, 1)
        state = _keys(np.einsum("nkd,nd->nk", self.unit[entry], q), entry)
        state[:, 1:][entry[:, 1:] == entry[:, :-1]] = NO_NODE
        stamp[(np.arange(len(q)) * (nodes + 1))[:, None] + entry] = since
        state.sort(axis=1)
        state = np.concatenate([state, np.full((len(q), max(0, beam - entry.shape[1])), NO_NODE)], 1)[:, :beam]
        result, active = np.empty_like(state), np.arange(len(q))
        while True:
            unvisited = (state & 1) == 0
            live = unvisited.any(1)
            if not live.all():
                result[active[~live]] = state[~live]
                active, state, q, unvisited = active[live], state[live], q[live], unvisited[live]
            if not len(active):
                break
            visit = unvisited & (np.cumsum(unvisited, 1, dtype=np.int32) <= take)
            row, at = np.nonzero(visit)
            near = table_[(state[row, at] & 0xFFFFFFFF) >> 1]
            state += visit
            # a missing neighbour, -1, meets the last place of the row before, which is never fresh
            flat = ((active * (nodes + 1))[row][:, None] + near).ravel()
            fresh = np.flatnonzero(stamp[flat] < since)
            flat = flat[fresh]
            mark = np.arange(self.clock, self.clock + len(fresh), dtype=np.int32)
            self.clock += len(fresh)
            stamp[flat] = mark
            fresh = fresh[stamp[flat] == mark]  # one of those that several visited nodes share
            row, near = row[fresh // width], near.ravel()[fresh]
            key = _keys(self._sims(q, row, near), near)
            enters = key < state[row, -1]
            row, key = row[enters], key[enters]
            if len(row):
                count = np.bincount(row, minlength=len(active))
                new = np.full((len(active), count.max()), NO_NODE)
                new[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = key
                state = np.concatenate([state, new], 1)
                state.sort(axis=1)
                state = state[:, :beam]
        return _unkey(result)

    def _fresh_stamps(self, rows: int) -> np.ndarray:
        """For each query and node a number that is below ``clock`` until the walk meets the node; kept between walks."""
        places = len(self.unit) + 1
        if len(self.stamp) < rows * places or self.clock > 2**30:
            self.stamp, self.clock = np.zeros(max(rows, min(BATCH, places)) * places, np.int32), 1
            self.stamp[places - 1 :: places] = np.iinfo(np.int32).max
        self.clock += 1
        return self.stamp

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        beam = min(beam, len(self.unit))
        entry = np.full((len(q), 1), self.order[0])
        for layer in range(self.top, 0, -1):
            entry, _ = self._search_layer(q, entry, 1, layer)
        return self._search_layer(q, entry, beam, 0)


def range_links(
    q: np.ndarray, graph: Graph, full: np.ndarray, threshold: float, same: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node) of the pairs of at least ``threshold`` that audited searches find, and the queries left to a scan.

    Unit vectors in doubles.  No query has more than ``WIDEST`` pairs here; those with more are left to the scan.
    ``same``: the queries are the nodes; no row is paired with itself, and the audits leave it out.
    """
    n = len(graph.unit)
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT_ROWS, len(q))).astype(int))
    truth = q[audit] @ full.T
    if same:
        truth[np.arange(len(audit)), audit] = -np.inf
    wanted, best = (truth >= threshold).sum(1), truth.max(1)
    def search(rows, beam):
        found_q, found_x, scan, nearest = _search_all(q, graph, full, threshold, beam, same, rows)
        if same:
            others = found_q != found_x
            found_q, found_x = found_q[others], found_x[others]
        return found_q, found_x, scan, nearest

    # queries don't depend on each other, so the audit's rows alone show which beam all others need
    beam = FIRST_BEAM
    while beam < n:
        found_q, _, scan, nearest = search(audit, beam)
        linked = np.bincount(found_q, minlength=len(q))
        linked[scan] = np.iinfo(np.int64).max  # a scan finds all
        met = nearest[audit] >= best - SLACK
        if np.minimum(linked[audit], wanted).sum() >= AUDIT_RECALL * wanted.sum() and met.mean() >= AUDIT_RECALL:
            break
        beam *= 2
    return search(np.arange(len(q)), beam)[:3]


def _search_all(q, graph, full, threshold, beam, same, todo):
    """Links of the queries ``todo``; queries whose whole beam is links search again with twice the beam, then are left over."""
    out_q, out_x, nearest = [], [], np.full(len(q), -np.inf)
    while len(todo) and beam <= WIDEST and beam < len(full):
        again = []
        for a in range(0, len(todo), BATCH):
            rows = todo[a : a + BATCH]
            ids, sims = graph.search(q[rows].astype(np.float32), beam)
            nearest[rows] = np.where(ids == rows[:, None], -np.inf, sims).max(1) if same else sims[:, 0]
            whole = sims[:, -1] >= threshold - SLACK
            again.append(rows[whole])
            r, c = np.nonzero((sims >= threshold - SLACK) & ~whole[:, None])
            x = ids[r, c]
            exact = np.einsum("nd,nd->n", q[rows[r]], full[x]) >= threshold
            out_q.append(rows[r[exact]])
            out_x.append(x[exact])
        todo = np.concatenate(again) if again else todo[:0]
        beam *= 2
    nearest[todo] = np.inf
    none = todo[:0]
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_x]), todo, nearest


def unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` (each node's smallest node so far, itself its own root) after links between nodes u and v."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            after = root[root]
            if (after == root).all():
                break
            root = after


class _Side:
    """One shard of a pair: its vectors, weights, where its nodes start, link counts, and which rows were scanned."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, at: int):
        self.unit, self.weight, self.at = unit, weight.astype(np.float64), at
        self.links = np.zeros(len(unit))
        self.scanned = np.zeros(len(unit), bool)


def _scan(q: _Side, x: _Side, root: np.ndarray, threshold: float) -> np.ndarray:
    """Count and unite all links of q's scanned rows, a block of queries at a time; no pair outlives its block.

    A pair whose ends are both scanned is counted by each end for itself, else by the scanned end for both.
    """
    rows = np.flatnonzero(q.scanned)
    other = np.flatnonzero(~x.scanned)
    for a in range(0, len(rows), BATCH):
        r = rows[a : a + BATCH]
        near = q.unit[r] @ x.unit.T >= threshold
        if q is x:
            near[np.arange(len(r)), r] = False
        q.links[r] += near @ x.weight
        x.links[other] += q.weight[r] @ near[:, other]
        i, j = np.nonzero(near & (root[q.at + r][:, None] != root[x.at : x.at + len(x.unit)]))
        if len(i):
            pair = np.unique(root[q.at + r[i]].astype(np.int64) << 32 | root[x.at + j])
            root = unite(root, pair >> 32, pair & 0xFFFFFFFF)
    return root


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    ids, weight = np.frombuffer(row.ids, np.int64), np.frombuffer(row.weights, np.int64)
    unit = np.frombuffer(row.vectors, np.float64).reshape(len(ids), -1)
    links, at, data = [], 0, np.frombuffer(row.graph, np.int32)
    while at < len(data):
        width = DEGREE * (1 if links else 2)
        links.append(data[at : at + width * len(ids)].reshape(len(ids), width))
        at += width * len(ids)
    return ids, weight, unit, Graph(unit, np.frombuffer(row.hashes, np.int64), links)


INDEX = (
    "label long, dim int, shard int, shards int, ids binary, hashes binary, weights binary, vectors binary, graph binary"
)


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["hash", "id"], kind="stable")
    x = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    ids, hashes = pdf.id.to_numpy(np.int64), pdf["hash"].to_numpy(np.int64)
    graph = Graph(unit, hashes)
    first = pdf.iloc[0]
    packed = np.concatenate([t.ravel() for t in graph.links]).tobytes()
    values = [first.label, first.dim, first.shard, first.shards, ids.tobytes(), hashes.tobytes()]
    values += [pdf.weight.to_numpy(np.int64).tobytes(), unit.tobytes(), packed]
    return pd.DataFrame([values], columns=[c.split()[0] for c in INDEX.split(", ")])


def _link_shards(threshold: float):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        (a_ids, a_weight, a_unit, a_graph), *more = [_unpack(r) for r in pdf.sort_values("shard").itertuples()]
        a = _Side(a_unit, a_weight, 0)
        ids = a_ids
        if not more:
            b = a
            i, j, scan = range_links(a.unit, a_graph, a.unit, threshold, True)
            a.scanned[scan] = True
            i, j = np.minimum(i, j), np.maximum(i, j)
        else:
            ((b_ids, b_weight, b_unit, b_graph),) = more
            b, ids = _Side(b_unit, b_weight, len(a_ids)), np.concatenate([a_ids, b_ids])
            i, j, scan = range_links(a.unit, b_graph, b.unit, threshold)
            a.scanned[scan] = True
            y, x, scan = range_links(b.unit, a_graph, a.unit, threshold)
            b.scanned[scan] = True
            i, j = np.concatenate([i, x]), np.concatenate([j, y])
        pair = np.unique(i.astype(np.int64) << 32 | j)  # found from either side
        i, j = pair >> 32, pair & 0xFFFFFFFF
        left = ~(a.scanned[i] | b.scanned[j])
        i, j = i[left], j[left]
        a.links += np.bincount(i, b.weight[j], len(a.unit))
        b.links += np.bincount(j, a.weight[i], len(b.unit))
        root = unite(np.arange(len(ids)), i, b.at + j)
        root = _scan(a, b, root, threshold)
        if more:
            root = _scan(b, a, root, threshold)
        links = np.concatenate([a.links, b.links]) if more else a.links
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        keep = links > 0
        return pd.DataFrame({"id": ids[keep], "links": links[keep].astype(np.int64), "root": least[root][keep]})

    return link


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "hnsw-dedup")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).alias("embedding"),
    )
    sound = F.expr(
        "vec is not null and label is not null and embedding is not null and exists(embedding, x -> x <> 0) and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    usable = rows.filter(F.coalesce(sound, F.lit(False)))
    classes = usable.groupBy("label", "embedding").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("weight"))
    # a class is known by a number of its own: identifiers may repeat with other vectors
    classes = classes.withColumn("id", F.monotonically_increasing_id()).withColumn("hash", F.xxhash64("embedding"))
    classes = scratch.keep(classes.withColumn("dim", F.size("embedding")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    sizes = scratch.keep(sizes, "sizes")  # a stored table's size is known, and a large label's rows can be split
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod("hash", "shards").cast("int"))
    index = scratch.keep(dealt.groupBy("label", "dim", "shard").applyInPandas(build_shard, INDEX), "index")
    met = index.withColumn("other", F.explode(F.expr("sequence(0, shards - 1)")))
    met = met.withColumn("bi", F.least("shard", "other")).withColumn("bj", F.greatest("shard", "other"))
    found = met.groupBy("label", "dim", "bi", "bj").applyInPandas(_link_shards(threshold), "id long, links long, root long")
    found = scratch.keep(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    united = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    linked = classes.select("id", "vec").join(links, "id").join(united, "id", "left")
    linked = scratch.keep(linked.withColumn("component", F.coalesce("component", "id")), "linked")
    least = linked.groupBy("component").agg(F.min("vec").alias("least"))
    known = classes.select("label", "embedding", "id", "vec", "weight")
    known = known.join(linked.join(least, "component").select("id", "links", "least"), "id", "left")
    known = known.select("label", "embedding", F.col("vec").alias("rep"), "weight", "links", "least")
    out = rows.join(scratch.keep(known, "known"), ["label", "embedding"], "left")
    in_class = F.col("rep").isNotNull() & F.col("vec").isNotNull()
    component = F.when(in_class, F.coalesce("least", "rep")).otherwise(F.col("vec"))
    count = F.when(in_class, F.coalesce("links", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0))
    return out.select(
        F.col("vec").alias(id_col),
        count.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec") == component, F.lit(True)).alias("kept"),
    )


def op1_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id
), c AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
