"""Operators against brute force, exact round trips, and held-out accuracy, on the small tables."""

from __future__ import annotations

import collections
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from spatialith.llm import exact_dedup, gru_lm, hnsw_dedup, jaccard_join, licenses, mixing, pieces, quality_crf, secrets, token_store
from spatialith.llm import textbatch as B
from spatialith.llm.store import Scratch, table

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF_MORE}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text.translate(LOWER))


def groups(texts, threshold=0.8):
    """Links and smallest member of each component, by counting shared shingles of all pairs."""
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    same = collections.Counter()
    for rows in index.values():
        for k, i in enumerate(rows):
            for j in rows[k + 1 :]:
                same[i, j] += 1
    links, root = np.zeros(len(texts), int), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), n in same.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return links, np.array([find(i) for i in range(len(texts))])


def test_jaccard_join(spark, docs):
    out = jaccard_join.op4_jaccard_join(spark, SF_MORE).toPandas().sort_values("doc_id")
    links, root = groups(docs.text)
    assert (links == out.n_links.to_numpy()).all()
    assert (docs.doc_id.to_numpy()[root] == out.class_id.to_numpy()).all()


def test_jaccard_join_large_buckets(spark):
    """Near copies and a shared passage in more than a bucket's size: splits and blocks lose nothing."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, 120))
    passage = list(rng.choice(vocabulary, 60))
    texts = []
    for _ in range(150):
        t = base.copy()
        t[int(rng.integers(120))] = "changed" + str(rng.integers(10**6))
        texts.append(" ".join(t))
    texts += [" ".join([*rng.choice(vocabulary, 60), *passage]) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = jaccard_join.near_duplicates(frame, small=32).toPandas().sort_values("doc_id")
    links, root = groups(texts)
    assert abs(out.n_links.sum() - links.sum()) <= 0.01 * links.sum()
    assert (out.class_id.to_numpy() == root).all()


def random_rows(rng, n=120):
    """(doc_id, text) with exact and near copies under repeated and unlike identifiers."""
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [list(rng.choice(vocabulary, int(rng.integers(1, 80)))) for _ in range(n // 3)]
    rows = []
    for _ in range(n):
        t = list(texts[int(rng.integers(len(texts)))])
        if rng.random() < 0.4:
            t[int(rng.integers(len(t)))] = "other"
        rows.append((int(rng.integers(n // 4)), " ".join(t)))
    return rows


def test_jaccard_join_repeated_identifiers(spark):
    """Rows that repeat an identifier with other texts keep their own groups, and one row of each group stays."""
    rows = [(1, "a b c d e f"), (9, "a b c d e f"), (9, "g h i j k l"), (9, "g h i j k l"), (2, "")]
    rows += random_rows(np.random.default_rng(6))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(0)).withColumn("row", F.lit(1))
    links, root = groups([t for _, t in rows])
    least = [min(rows[j][0] for j in np.flatnonzero(root == root[i])) for i in range(len(rows))]
    out = [(r.doc_id, r.n_links, r.class_id) for r in jaccard_join.near_duplicates(frame).collect()]
    assert sorted(out) == sorted((rows[i][0], links[i], least[i]) for i in range(len(rows)))
    for one in (frame, frame.repartition(5)):
        stay = jaccard_join.keep_one(one)
        assert stay.columns == frame.columns
        group = collections.defaultdict(set)
        for i, r in enumerate(rows):
            group[r].add(root[i])
        kept = [next(iter(group[r.doc_id, r.text])) for r in stay.collect()]
        assert sorted(kept) == sorted(set(root))  # one row of every group


def test_exact_dedup_state_outlives_the_run(spark, tmp_path):
    """A second run from the same state knows the first one's digests, and checks bytes against its documents."""
    rows = random_rows(np.random.default_rng(9), 60)
    rows = [(i, t.upper() if i % 3 else t) for i, (_, t) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.filter("doc_id % 2 = 0").write.parquet(str(tmp_path / "one"))
    frame.filter("doc_id % 2 = 1").write.parquet(str(tmp_path / "two"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    whole = {r.doc_id: r for r in exact_dedup.exact_groups(frame).select(columns).collect()}
    weak = lambda text: F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 1)
    for name, digest in (("strong", exact_dedup.sha256_hex), ("weak", weak)):
        state = f"file://{tmp_path}/state-{name}"
        one, two = (
            exact_dedup.exact_groups(spark.read.parquet(str(tmp_path / part)), digest=digest, state=state).select(columns).collect()
            for part in ("one", "two")
        )
        assert len(one) == len(two) == 30 and all(r.keep_id % 2 == 0 for r in one)
        assert any(r.keep_id % 2 == 0 for r in two) and {r.doc_id: r for r in two} == {i: whole[i] for i in range(1, 60, 2)}


def test_exact_dedup_repeated_rows(spark):
    """Of rows that repeat identifier and text one stays, also where they don't come from files."""
    rows = [(1, "x"), (1, "X"), (2, "y"), (2, "z"), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_file", F.lit("clash"))
    stay = exact_dedup.keep_one(frame)
    assert stay.columns == frame.columns
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in stay.collect()), key=str) == sorted([(1, "x"), (2, "y"), (2, "z"), (None, "")], key=str)


def test_jaccard_join_many_near_copies(spark):
    """5000 near copies are one large bucket, compared in pairs of blocks without a lost or a false link."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:k % 120], f"changed{k}", *base[k % 120 + 1:]]) for k in range(5000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = jaccard_join.near_duplicates(frame).agg(F.sum("n_links"), F.countDistinct("class_id"), F.sum(F.col("kept").cast("int"))).first()
    place = [set(range(max(0, k - 4), min(116, k + 1))) for k in range(120)]  # shingles that a change at k spoils
    copies = collections.Counter(k % 120 for k in range(5000))
    links = 0
    for a in range(120):
        for b in range(120):
            same = 116 - len(place[a] | place[b])
            if same >= 0.8 * (2 * 116 - same):
                links += copies[a] * copies[b]
    assert out[0] == links - 5000 and out[1] == 1 and out[2] == 1


def test_hnsw_against_all_pairs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([centres[rng.integers(60, size=900)] + rng.normal(0, 0.05, (900, 32)), rng.normal(size=(900, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph(unit, np.arange(len(unit)))
    i, j, scan = hnsw_dedup.range_links(unit, graph, unit, 0.98)
    assert not len(scan)
    true = set(zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True))
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert found <= true and len(found) >= 0.99 * len(true)


def test_hnsw_wide_beams_take_few_rounds():
    """A wide beam visits many nodes a round, in pieces of bounded memory, and finds what narrower steps would."""
    import tracemalloc

    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            reads.append(at)
            return np.asarray(self)[at]

    x = np.random.default_rng(4).normal(size=(2500, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw_dedup.Graph(unit, np.arange(len(unit)))
    graph.links[0] = graph.links[0].view(Counted)
    q = unit[:256].astype(np.float32)
    tracemalloc.start()
    ids, sims = graph.search(q, 128)
    assert tracemalloc.get_traced_memory()[1] < 64e6
    tracemalloc.stop()
    assert len(reads) <= 24
    true = q @ graph.unit.T
    assert (np.diff(np.sort(ids, 1), axis=1) > 0).all() and (np.diff(sims, axis=1) <= 0).all()
    assert np.allclose(sims, np.take_along_axis(true, ids, 1), atol=1e-5)
    assert (np.sort(true, 1)[:, -2] - sims[:, 1] < 1e-5).mean() >= 0.97
    again = graph.search(q, 128)
    assert (again[0] == ids).all() and (again[1] == sims).all()


def test_hnsw_beam_wider_than_its_component():
    """Nodes that links don't reach leave places of a beam empty."""
    unit = np.eye(4) - 0.1
    graph = hnsw_dedup.Graph(unit / np.linalg.norm(unit, axis=1, keepdims=True), np.arange(4), [np.array([[1], [0], [3], [2]], np.int32)])
    graph.order, graph.top = np.array([0, 1, 2, 3]), 0
    ids, sims = graph.search(graph.unit[1:2], 4)
    assert ids.tolist() == [[1, 0, -1, -1]] and np.isneginf(sims[0, 2:]).all() and sims[0, 1] < 0
    assert np.allclose(sims[0, :2], graph.unit[1] @ graph.unit[[1, 0]].T)


def test_hnsw_diverse_against_a_plain_loop():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    graph = hnsw_dedup.Graph(x / np.linalg.norm(x, axis=1, keepdims=True), np.arange(300))
    ids = np.array([rng.permutation(300)[:20] for _ in range(150)])
    nodes = rng.integers(0, 300, 150)
    value = np.einsum("nkd,nd->nk", graph.unit[ids], graph.unit[nodes])
    value[np.arange(20) >= rng.integers(0, 21, 150)[:, None]] = -np.inf
    best = np.argsort(-value, axis=1, kind="stable")
    ids, value = np.take_along_axis(ids, best, 1), np.take_along_axis(value, best, 1)
    for k, got in [(k, graph._diverse(ids, value, k)) for k in (4, 12, 32)]:
        for i, v, out in zip(ids, value, got, strict=True):
            chosen, left = [], []
            for a, s in zip(i[: 2 * k].tolist(), v[: 2 * k].tolist(), strict=True):
                if s > -np.inf:
                    near = any(graph.unit[a] @ graph.unit[b] > s for b in chosen)
                    (left if near or len(chosen) == k else chosen).append(a)
            assert out[out >= 0].tolist() == (chosen + left)[:k]


def test_hnsw_audit_leaves_the_row_itself_out(monkeypatch):
    """A first search that finds each row but no other link is widened, though few links are wanted."""
    x = np.random.default_rng(8).normal(size=(200, 32))
    x[1] = x[0] + 1e-3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pdf = pd.DataFrame({"label": 0, "dim": 32, "shard": 0, "shards": 1, "id": range(200), "hash": range(200), "weight": 1, "embedding": list(unit)})
    beams = []

    def search(q, graph, full, threshold, beam, *_):
        beams.append(beam)
        value = q @ full.T
        i, j = np.nonzero(value >= threshold)
        if beam == hnsw_dedup.FIRST_BEAM:
            i, j = i[i == j], j[i == j]
        return i, j, i[:0], np.full(len(q), np.inf)

    monkeypatch.setattr(hnsw_dedup, "_search_all", search)
    hnsw_dedup._link_shards(0.98)(hnsw_dedup.build_shard(pdf))
    assert len(beams) > 1


def test_hnsw_dense_label_in_bounded_memory():
    """A whole shard of near-equal vectors of unequal weights: counts are exact, and no pair outlives its block."""
    import tracemalloc

    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=64) + rng.normal(0, 0.11, (n, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    weight = rng.integers(1, 4, n)
    pdf = pd.DataFrame({"label": 0, "dim": 64, "shards": 2, "id": rng.permutation(n), "hash": rng.integers(-(2**62), 2**62, n), "weight": weight, "embedding": list(unit)})
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    assert 0.05 < near.mean() < 0.95
    want = dict(zip(pdf.id, near @ weight, strict=True))
    one = hnsw_dedup.build_shard(pdf.assign(shard=0))
    halves = [hnsw_dedup.build_shard(pdf[k::2].assign(shard=k)) for k in range(2)]
    link = hnsw_dedup._link_shards(0.98)
    tracemalloc.start()
    found = link(one)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    many = pd.concat([*map(link, halves), link(pd.concat(halves))]).groupby("id").links.sum()
    got, summed = dict(zip(found.id, found.links, strict=True)), many.to_dict()
    assert sum(abs(got.get(i, 0) - w) for i, w in want.items()) <= 0.001 * sum(want.values())
    assert sum(abs(summed.get(i, 0) - w) for i, w in want.items()) <= 0.001 * sum(want.values())


def vector_groups(rows, threshold=0.98):
    """Links and smallest identifier of each row's component, by all pairs of rows of one label and length."""
    unit = [None if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links, root = np.zeros(len(rows), int), np.arange(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] is None or rows[i][2] != rows[j][2]:
                continue
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[[i, j]] += 1
                root[root == root[i]] = root[j]
    return [(rows[i][0], int(links[i]), min(rows[j][0] for j in np.flatnonzero(root == root[i]))) for i in range(len(rows))]


def test_hnsw_repeated_identifiers(spark):
    """Rows that repeat an identifier with unlike vectors are vectors of their own; columns may clash."""
    rows = [(9, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (10, [1.0, 0.001], 1), (10, [1.0, 0.0], 1), (3, [0.0, 2.0], 1)]
    rows += [(9, [1.0, 0.0], 2), (9, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, 0.0], None), (7, [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("id", "vec", "rep", "links", "hash", "shard", "component"):
        frame = frame.withColumn(name, F.lit("clash"))
    out = [(r.vec_id, r.n_links, r.component_id) for r in hnsw_dedup.near_duplicates(frame).collect()]
    assert sorted(out) == sorted(vector_groups(rows))


def test_hnsw_shards_agree(spark):
    v = table(spark, SF, "embeddings")
    one = hnsw_dedup.near_duplicates(v).orderBy("vec_id").collect()
    many = hnsw_dedup.near_duplicates(v, shard_rows=16).orderBy("vec_id").collect()
    assert one == many


def test_pieces_match_library(docs):
    import sentencepiece

    vocabulary = pieces.Vocabulary()
    encoder = pieces.Encoder(vocabulary, cache_units=2000)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rng = np.random.default_rng(1)
    odd = ["", "   ", "a  b   c", "\n\t x", "日本語😀", "aaaaaaaaaaaaaaaa", "<s> <0x0A>", "▁a", "\x00"]
    odd += ["".join(rng.choice(list("abcdehilnorst    \n.,éß日"), 40)) for _ in range(500)]
    texts = [*odd, *docs.text.head(150)]
    ids, edges = encoder.encode(texts)
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == want
    assert encoder.decode(ids, edges) == library.decode(want)


def test_pieces_unigram_mode():
    """For a unigram model the path has the greatest summed score: all segmentations of short words are tried."""
    vocabulary = pieces.Vocabulary()
    vocabulary.bpe = False
    encoder = pieces.Encoder(vocabulary)
    place = {k: s for k, s in zip(vocabulary.keys.tolist(), vocabulary.score.tolist(), strict=True)}

    def score(piece):
        flat, _ = B.codes([piece])
        return place.get(int(B.span_hashes(flat, np.array([0]), np.array([len(flat)]))[0]), -math.inf)

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for i in range(1, len(word) + 1):
            top[i] = max(top[j] + score(word[j:i]) for j in range(i))
        return top[-1]

    by_id = dict(zip(vocabulary.ids.tolist(), vocabulary.score.tolist(), strict=True))
    for word in ("hello", "walking", "unhappy", "statement"):
        ids, _ = encoder.encode([word])
        assert math.isclose(sum(by_id[i] for i in ids.tolist()), best("▁" + word))


def test_lm(spark, docs):
    out = gru_lm.op7_gru_lm(spark, SF_MORE).toPandas().sort_values("doc_id")
    tokens = [[*words(t), "\0end"] for t in docs.text]
    counts = collections.Counter()
    for i, w in zip(docs.doc_id, tokens, strict=True):
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in tokens]
    assert out.train_tokens.eq(n).all()
    assert np.allclose(out.base_score, base)
    assert [sum(counts[w] > 0 for w in ws) for ws in tokens] == out.n_known.tolist()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_lm_learns_from_every_token(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.glob("gru-lm-*"))
    n = gru_lm.op7_gru_lm(spark, SF).first().train_tokens
    (folder,) = set(root.glob("gru-lm-*")) - before
    assert sum(pd.read_parquet(f).seen.sum() for f in folder.glob("round-*")) == n > 0


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    """Scores of every text are the same from one partition and from seven, also with several groups and few sent words."""
    monkeypatch.setattr(gru_lm, "GROUP_TOKENS", 1 << 14)
    docs = table(spark, SF, "documents")
    one = gru_lm.score_documents(docs.coalesce(1)).toPandas().sort_values("doc_id")
    many = gru_lm.score_documents(docs.repartition(7)).toPandas().sort_values("doc_id")
    assert np.allclose(one.score, many.score, rtol=1e-6) and one.n_known.tolist() == many.n_known.tolist()


def test_lm_few_sent_words(spark, docs, monkeypatch):
    """With ties at the cut, and most words met by a shuffle, counts are the same and the model keeps its vocabulary."""
    want = gru_lm.op7_gru_lm(spark, SF).toPandas().sort_values("doc_id")
    monkeypatch.setattr(gru_lm, "SENT_WORDS", 10)
    got = gru_lm.op7_gru_lm(spark, SF).toPandas().sort_values("doc_id")
    assert got.n_known.tolist() == want.n_known.tolist()
    assert np.allclose(got.base_score, want.base_score) and np.allclose(got.score, want.score, rtol=1e-6)


def test_lm_sums_to_one():
    net = gru_lm.Gru.start(np.arange(gru_lm.VOCABULARY)[::-1].copy(), 100)
    h = np.full((gru_lm.VOCABULARY, gru_lm.HIDDEN), 0.3, np.float32)
    value, _ = net.log_prob(h, np.arange(gru_lm.VOCABULARY))
    assert math.isclose(np.exp(value).sum(), 1, rel_tol=1e-4)


def test_lm_gradients():
    rng = np.random.default_rng(0)
    net = gru_lm.Gru.start(np.arange(gru_lm.VOCABULARY)[::-1].copy(), 100)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, h = rng.integers(0, 50, (3, 5)), rng.integers(0, 50, (3, 5)), rng.normal(0, 0.5, (3, gru_lm.HIDDEN))
    mask = np.ones((3, 5), bool)
    mask[2, 3:] = False

    def loss():
        state, states = h, []
        for t in range(5):
            state = net.step(net.p["embed"][x[:, t]] @ net.p["w"] + net.p["b"], state)[0]
            states.append(state)
        return net.log_prob(np.stack(states, 1)[mask], y[mask])[0].sum()

    grads, _ = net.train_window(x, y, mask, h)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(abs(g)), g.shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-4)


def test_lm_state_is_carried(monkeypatch):
    """Whole-document scores don't depend on how many states wait for their softmax, nor on what is scored alongside."""
    net = gru_lm.Gru.start(np.arange(gru_lm.VOCABULARY)[::-1].copy(), 100)
    tokens = np.random.default_rng(2).integers(0, 100, 500)
    edges = np.array([0, 300, 300, 500])
    first = net.score(tokens, edges)
    monkeypatch.setattr(gru_lm, "SCORE_STATES", 7)
    assert np.allclose(first, net.score(tokens, edges), rtol=1e-5)
    alone = [net.score(tokens[x:y], np.array([0, y - x]))[0] for x, y in zip(edges, edges[1:], strict=False)]
    assert np.allclose(first, alone, rtol=1e-5)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        assert sorted(token_store.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert (token_store.feistel(np.arange(1000), 1000, 1) != token_store.feistel(np.arange(1000), 1000, 2)).any()


def test_token_store_files(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    uri = f"file://{tmp_path}/shards"
    vocabulary = pieces.Vocabulary()
    rows = token_store.sequences(table(spark, SF, "documents"), vocabulary, length=256, per_shard=64)
    manifest = token_store.write_shards(rows, uri).toPandas()
    encoder = pieces.Encoder(vocabulary)
    stream = np.concatenate([np.append(encoder.encode([t])[0], token_store.END_ID) for t in docs.text])
    n = -(-len(stream) // 256)
    stream = np.append(stream, np.full(n * 256 - len(stream), token_store.END_ID)).reshape(n, 256)
    got = np.stack(list(token_store.read_slots(uri, 0, n, 256, 64)))
    assert (got[token_store.feistel(np.arange(n), n)] == stream).all()
    assert (np.stack(list(token_store.read_slots(uri, n // 2, n, 256, 64))) == got[n // 2 :]).all()
    again = token_store.write_shards(rows, uri).toPandas()
    assert sorted(again.sha256) == sorted(manifest.sha256)


def test_token_store_query_writes_shards(spark):
    """The query leaves every shard file below the shared folder, and returns the slots that they hold."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.glob("token-shards-*"))
    out = token_store.op8_token_store(spark, SF).toPandas().sort_values("slot").reset_index(drop=True)
    (folder,) = set(root.glob("token-shards-*")) - before
    n = len(out)
    files = sorted((folder / "shards").glob("shard-*.bin"))
    assert len(files) == -(-n // token_store.PER_SHARD) and b"".join(f.read_bytes() for f in files) == b"".join(out.tokens)
    rows = token_store.sequences(table(spark, SF, "documents"), pieces.Vocabulary()).toPandas()
    assert rows.sort_values("slot").reset_index(drop=True).equals(out)


def fluid_windows(weights, blocks):
    """Release and deadline of every block, by fluid service that shares each slot by weight among sources that last."""
    share, size = np.array(weights) / sum(weights), np.array(blocks, float)

    def slot(x):
        return float(np.minimum(share * x, size).sum())

    return [
        [(math.floor(slot(k / w) + 1e-6), math.ceil(slot((k + 1) / w) - 1e-6)) for k in range(n)]
        for w, n in zip(share, blocks, strict=True)
    ]


def earliest_deadline_first(windows):
    done, out = [0] * len(windows), []
    for t in range(sum(map(len, windows))):
        due = [(w[k][1], i) for i, (w, k) in enumerate(zip(windows, done, strict=True)) if k < len(w) and w[k][0] <= t]
        i = min(due)[1]
        out.append((i, done[i]))
        done[i] += 1
    return out


@pytest.mark.parametrize("case", ["halves", "pareto", "many"])
def test_mixing_schedule(spark, case):
    """Inexact, tiny and many weights: the chunks give what one pass over all slots gives, less than a block off."""
    rng = np.random.default_rng(12)
    if case == "halves":
        weights, blocks = [0.5, *[0.5 / 19] * 19, 1e-5], [400, *[20] * 19, 1]
    elif case == "pareto":
        weights = ((rng.pareto(1, 40) + 0.1) ** 0.7).tolist()
        blocks = [int(x) for x in rng.integers(1, 40, 40)]
    else:
        weights, blocks = (rng.random(1100) + 1e-4).tolist(), [int(x) for x in rng.integers(1, 3, 1100)]
    names = [f"s{i:05d}" for i in range(len(weights))]
    frame = spark.createDataFrame(list(zip(names, weights, blocks, strict=True)), "source string, weight double, blocks long")
    scratch = Scratch(spark, "test-mixing")
    plan = mixing.schedule(mixing.windows(scratch.keep(frame, "weights"), scratch), scratch, 16 if case == "pareto" else 128)
    got = plan.toPandas().sort_values("slot")
    windows = fluid_windows(weights, blocks)
    want = earliest_deadline_first(windows)
    assert got.slot.tolist() == list(range(sum(blocks)))
    assert list(zip(got["rank"], got.k, strict=True)) == want
    assert all(windows[i][k][0] <= t < windows[i][k][1] for t, (i, k) in enumerate(want))
    if case == "halves":  # while all last, the service is the weights as they are
        share = np.array(weights) / sum(weights)
        last = int(min(np.array(blocks) / share))
        done = np.cumsum([np.arange(len(weights)) == i for i, _ in want[:last]], axis=0)
        assert (abs(done - share * np.arange(1, last + 1)[:, None]) < 1).all()


def test_mixing_checks_every_guess(spark):
    """A chunk that starts from another state than the chunk before it leaves is scheduled again."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        weights, blocks = ((rng.pareto(1, 25) + 0.1) ** 0.7).tolist(), [int(x) for x in rng.integers(1, 12, 25)]
        windows = fluid_windows(weights, blocks)
        placed = set()
        wrong = False
        for t, job in enumerate(earliest_deadline_first(windows)):
            if t % 8 == 0 and t:
                reach = sorted((windows[i][k][1], i) for i in range(25) for k in range(blocks[i]) if windows[i][k][0] < t < windows[i][k][1])
                met = sum(windows[i][k][1] <= t for i in range(25) for k in range(blocks[i]))
                wrong |= {i for _, i in reach[: t - met]} != {i for _, i in reach if any((i, k) in placed and windows[i][k][1] > t for k in range(blocks[i]))}
            placed.add(job)
        if wrong:
            break
    assert wrong
    names = [f"s{i:05d}" for i in range(25)]
    frame = spark.createDataFrame(list(zip(names, weights, blocks, strict=True)), "source string, weight double, blocks long")
    scratch = Scratch(spark, "test-mixing")
    got = mixing.schedule(mixing.windows(scratch.keep(frame, "weights"), scratch), scratch, 8).toPandas().sort_values("slot")
    assert list(zip(got["rank"], got.k, strict=True)) == earliest_deadline_first(windows)


def test_mixing_weight_tables(spark):
    """Weights that are no positive number or have no documents count for nothing; those of one source add up."""
    docs = spark.createDataFrame([(i, "ab"[i % 2] if i < 8 else None, "x" * 30) for i in range(12)], "doc_id long, source string, text string")
    nan = float("nan")
    weights = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", nan), ("z", 5.0), (None, 1.0)], "source string, weight double")
    out = mixing.mix(docs, weights=weights, block_chars=30).toPandas()
    assert out[out.source == "b"].slot.isna().all() and len(out) == 12
    slots = {job: t for t, job in enumerate(earliest_deadline_first(fluid_windows([1, 3], [5, 5])))}  # null first, then a
    for rank, own in ((0, out[out.doc_id >= 8]), (1, out[out.source == "a"])):
        assert own.sort_values("doc_id").slot.tolist() == [slots[rank, k] for k in range(4)]
    ordered = [r.source for r in mixing.in_order(docs, weights=weights, block_chars=30).collect()]
    assert ordered[-4:] == ["b"] * 4


def test_mixing_places(spark, docs):
    out = mixing.op9_mixing(spark, SF_MORE).toPandas()
    assert out.doc_id.is_unique and len(out) == len(docs)
    order = docs.assign(size=docs.text.str.len()).sort_values(["source", "doc_id"])
    order["offset"] = order.groupby("source")["size"].cumsum() - order["size"]
    both = out.merge(order, on="doc_id")
    assert (both.offset_x == both.offset_y).all()
    assert (both.block == both.offset_x // mixing.BLOCK_CHARS).all()
    assert both.groupby("slot").source_x.nunique().max() == 1


def test_quality_held_out(spark):
    out = quality_crf.op2_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    both = out.merge(labels, on="doc_id")
    both = both[both.held_out & both.quality.notna()]
    assert (both.predicted == both.quality).mean() > 0.95
    assert both.predicted[both.quality == 1].mean() > 0.98


def plain_score(model, text):
    """A document's score, line by line: features, forward-backward, length-weighted mean, curve."""

    def kind(c):
        for k, chars in ((4, ".?"), (5, ",;:'\"()-"), (6, "|"), (8, "!"), (7, "#$%&*@~^<>{}[]\\/_=+`")):
            if c in chars:
                return k
        if ord(c) > 0xFFFF:
            return 9
        return 0 if c.isupper() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 9

    lines = (text or "").split("\n")
    own = []
    for line in lines:
        kinds = [kind(c) for c in line]
        n, ws, times = max(len(line), 1), re.findall(r"[^\x20\x09-\x0d]+", line), lines.count(line)
        count = [kinds.count(k) for k in range(10)]
        letters, m = max(count[0] + count[1], 1), max(len(ws), 1)
        capped = [min(1, f * count[k] / n) for k, f in ((6, 10), (7, 10), (8, 10))]
        own.append([
            count[0] / letters, min(1, 3 * count[0] / letters), count[2] / n, count[3] / n, count[4] / n, count[5] / n, *capped,
            count[9] / n, math.log1p(len(line)) / 6, math.log1p(len(ws)) / 4, len(set(ws)) / m, sum(len(w) <= 3 for w in ws) / m,
            (count[0] + count[1]) / m / 10, min(1, times - 1), math.log1p(times - 1), float(bool(kinds) and kinds[-1] == 4),
            float(len(ws) <= 2), min(1, count[4] / m * 5),
        ])
    none = [0.0] * 20
    rows = []
    for i, f in enumerate(own):
        before, after = own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none
        rows.append([*f, *before, *after, 1, float(i == 0), float(i + 1 == len(own))])
    e = np.clip(np.array(rows) @ model.weights, -30, 30)
    step = np.exp(model.trans)
    forward = [np.array([1 / (1 + math.exp(e[0])), 1 / (1 + math.exp(-e[0]))])]
    for x in e[1:]:
        a = (forward[-1] @ step) * np.array([1 / (1 + math.exp(x)), 1 / (1 + math.exp(-x))])
        forward.append(a / a.sum())
    backward = [np.ones(2)]
    for x in e[:0:-1]:
        b = step @ (np.array([1 / (1 + math.exp(x)), 1 / (1 + math.exp(-x))]) * backward[-1])
        backward.append(b / b.sum())
    good = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward[::-1], strict=True)]
    size = [max(len(x), 1) for x in lines]
    q = min(max(float(np.dot(good, size)) / sum(size), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.slope * math.log(q / (1 - q)) + model.shift)))


def test_quality_whole_documents(spark, docs):
    """Scores of all whole texts of the small table, and of odd ones, against the plain version."""
    frame = spark.createDataFrame([(-i, t) for i, t in enumerate(["", None, "\n", "a\n\na\n", "Ünï 日本 😀.\nA|B!", "x" * 9000], 1)], "doc_id long, text string")
    frame = frame.unionByName(table(spark, SF, "documents").select("doc_id", "text"))
    model = quality_crf.train(table(spark, SF_MORE, "documents"), table(spark, SF_MORE, "labels"))
    for r in quality_crf.score_documents(frame, model).collect():
        assert math.isclose(r.score, plain_score(model, r.text), rel_tol=1e-3, abs_tol=1e-5), r.doc_id


def test_quality_labels_and_bounds(spark):
    """Order, repeats and contradictions of labels don't change the model; long documents are left out whole."""
    docs, labels = table(spark, SF_MORE, "documents"), table(spark, SF_MORE, "labels")
    one = quality_crf.train(docs, labels)
    two = quality_crf.train(docs.unionByName(docs).repartition(5), labels.unionByName(labels).repartition(3))
    assert (one.weights == two.weights).all() and one.slope == two.slope
    turned = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    assert quality_crf.train(docs, turned) is quality_crf.BLANK
    assert quality_crf.train(docs, labels, lines=0) is quality_crf.BLANK
    assert quality_crf.train(docs, labels, lines=300).slope != one.slope


def test_quality_marginals():
    """Forward-backward against all label sequences of a short chain."""
    import itertools

    rng = np.random.default_rng(4)
    e, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for y in itertools.product((0, 1), repeat=5):
        p = math.exp(sum(a for a, b in zip(e, y, strict=True) if b) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        good += p * np.array(y)
    got, _ = quality_crf.marginals(e, trans, np.array([0, 5]))
    assert np.allclose(got, good / total)


def test_trigram_queries():
    q = {r[0]: secrets.trigram_query(r[1]) for r in secrets.RULES}
    assert q["hex"] is None
    assert frozenset({"tok", "oke", "ken"}) in q["assign"]
    assert q["access"] == {frozenset({"aki", "kia"})}


def test_secrets_of_sparse_identifiers(spark):
    """Far apart, negative, null and repeated identifiers: every row is found by its place, and the index stays dense."""
    rng = np.random.default_rng(2)
    ids = [None if i % 17 == 0 else int(x) for i, x in enumerate(rng.integers(-(2**62), 2**62, 400))]
    ids[5] = ids[6]
    texts = [f"x{i} password = hunter{i:04d} and" if i % 4 == 0 else f"x{i} nothing" for i in range(400)]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("file", F.lit("clash"))
    out = secrets.find_secrets(frame).collect()
    assert len(out) == 400
    want = {t: [(m.start(), m.end()) for m in re.finditer(r"password = \S+", t)] for t in texts}
    assert all([(s["start"], s["stop"]) for s in r.spans] == want[r.text] for r in out)


def test_licenses(spark, docs):
    out = licenses.op10_licenses(spark, SF_MORE).toPandas().merge(docs, on="doc_id")
    for name, line in (
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
        ("MIT", "Released under the MIT License."),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ):
        hit = out[out.text.str.contains(line, regex=False)]
        assert (hit.license == name).all()
    plain = out[~out.text.str.contains("icens|reserved|copyright", case=False)]
    assert (plain.method.fillna("") != "header").all()


def test_license_anchors_lose_nothing():
    words = licenses._hashes(["the", "license"])
    model = licenses.Templates(licenses.Frequencies(words, np.array([900, 3]), 1000, 2))
    for k, (_, text) in enumerate([*licenses.TEMPLATES, *licenses.FULL_TEXTS]):
        bare = " ".join(t for t in licenses.terms(text) if t not in model.anchors)
        whole = k >= len(licenses.TEMPLATES)
        assert not bare or model.best(bare, whole)[0] < (licenses.FILE_COSINE if whole else licenses.HEADER_COSINE)


def plain_scan(texts):
    """Best header of each text by TF-IDF cosine of all its units with all templates, with counts of all terms."""
    bags = [licenses.terms(t) for t in texts]
    df = collections.Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    vector = lambda t: {w: c * idf(w) for w, c in licenses.terms(t).items()}

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / size if size else 0.0

    short = [(n, vector(t)) for n, t in licenses.TEMPLATES]
    out = []
    for text in texts:
        best = max(((cosine(vector(text[x:y]), v), n) for x, y in licenses.units(text) for n, v in short), default=(0, None), key=lambda s: s[0])
        whole = max(cosine(vector(text), v) for _, v in short + [(n, vector(t)) for n, t in licenses.FULL_TEXTS])
        out.append((best if best[0] >= licenses.HEADER_COSINE else (0.0, None), whole))
    return out


@pytest.mark.parametrize("sent", [licenses.SENT_TERMS, 20])
def test_licenses_against_all_cosines(spark, docs, monkeypatch, sent):
    """Scores of whole texts with and without header lines, also when most terms meet their frequencies by a shuffle."""
    monkeypatch.setattr(licenses.sent_frequencies, "__defaults__", (sent,))
    texts = [t for t in docs.text if len(t) < 3000][:160]
    texts += ["Licensed under the zebra License version 2 of Apache.", "the MIT License the the the", licenses.FULL_TEXTS[0][1] + " Jane Doe", "some words\n\n" + licenses.FULL_TEXTS[1][1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit("clash"))
    out = licenses.scan(frame).toPandas().sort_values("doc_id")
    want = plain_scan(texts)
    assert any(s for (s, _), _ in want)
    for r, ((score, name), _) in zip(out.itertuples(), want, strict=True):
        assert (r.license or None) == name and (name is None or math.isclose(r.score, score, abs_tol=1e-9)), (r.doc_id, r.license, name, r.score, score)


def test_license_full_texts_are_files(spark):
    """A whole licence text is a licence file of its directory, whatever its name."""
    rows = [(1, "a/terms.txt", "Copyright 2001 Jane Doe\n\n" + licenses.FULL_TEXTS[0][1]), (2, "a/b/c.py", "code"), (3, "d/e.py", "code")]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), path=F.col("path"))
    found = {r.doc_id: (r.license, r.method) for r in out.collect()}
    assert found[2] == ("MIT", "inherited") and found[3] == (None, None)


def test_license_inheritance(spark):
    from pyspark.sql import functions as F

    rows = [
        (1, "a/LICENSE", "Notice.\nReleased under the MIT License.\n" + "more words " * 50),
        (2, "a/b/c.py", "code"),
        (3, "x/y.py", "code"),
        (4, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."),
        (5, "a/b/d/e.py", None),
        (6, "a/z.py", "code"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), path=F.col("path"))
    found = {r.doc_id: (r.license, r.method, r.license_dir) for r in out.collect()}
    assert found[2] == found[5] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert found[6] == ("MIT", "inherited", "a") and found[3] == (None, None, None)


def test_pipeline_stages(spark):
    """Each stage against a plain version of it."""
    docs = table(spark, SF, "documents")
    frame = docs.toPandas()
    model = quality_crf.train(docs, table(spark, SF, "labels"))
    want = {r.doc_id for r in quality_crf.score_documents(docs, model).collect() if r.score >= 0.3}
    one = corpus_pipeline.quality(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    two = corpus_pipeline.exact(spark, docs, SF)
    norm = frame.assign(norm=[t.translate(LOWER) for t in frame.text])
    assert {r.doc_id for r in two.collect()} == set(norm.groupby("norm").doc_id.max())
    three = corpus_pipeline.near(spark, docs, SF)
    frame = frame.sort_values("doc_id").reset_index(drop=True)
    _, root = groups(frame.text)
    assert {r.doc_id for r in three.collect()} == set(frame.doc_id[root == np.arange(len(root))])
    four = corpus_pipeline.mixed(spark, docs, SF)
    assert sorted(r.doc_id for r in four.collect()) == frame.doc_id.tolist() and four.columns == docs.columns
    assert corpus_pipeline.run(spark, SF).filter("round_trip").count() > 0
