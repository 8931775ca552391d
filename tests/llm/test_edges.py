"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spatialith.llm import (
    exact_dedup,
    gru_lm,
    hnsw_dedup,
    jaccard_join,
    licenses,
    mixing,
    pieces,
    quality_crf,
    secrets,
    token_store,
)
from spatialith.llm import textbatch as B

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, _id string, path string, slot string"
LONG = "word " * 40_000 + "é" * 5_000
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.\nSecond line here.", "en", "a", 3),
    (2, "ALPHA beta gamma delta epsilon zeta.\nSecond line here.", None, "a", None),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "no identifier password = hunter22", "en", "b", 1),
    (5, LONG, "en", "a", 1),
    (6, "   \n\t ", "en", None, 1),
    (7, "two words", "en", "c", 1),
    (7, "two words", "en", "c", 1),
    (-8, "日本語 😀 ▁ x\x00y", "ja", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    rows = [(*r, "clash", "clash", "clash", None, "clash") for r in ROWS]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def by_id(df, column, id_col="doc_id"):
    return {r[id_col]: r[column] for r in df.collect()}


def test_exact_dedup(docs, empty):
    out = exact_dedup.exact_groups(docs)
    keep, size = by_id(out, "keep_id"), by_id(out, "group_size")
    assert out.count() == len(ROWS)
    assert keep[1] == keep[2] == 2 and size[1] == 2
    assert keep[3] == keep[4] == 4 and size[4] == 2
    assert keep[7] == 7 and size[7] == 2
    assert out.filter("doc_id = 7 and kept").count() == 1  # the locator breaks the tie
    stay = exact_dedup.keep_one(docs)
    assert stay.count() == 7 and stay.columns == docs.columns
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_checks_bytes(docs):
    """Texts whose digests collide are told apart; several micro-batches give the same groups."""
    weak = lambda text: F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 1)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(exact_dedup.exact_groups(docs).select(columns).collect(), key=str)
    got = exact_dedup.exact_groups(docs, digest=lambda t: F.substring(weak(t), 1, 0)).select(columns)
    assert sorted(got.collect(), key=str) == want
    assert sorted(exact_dedup.exact_groups(docs.repartition(5), files_per_trigger=1).select(columns[:3]).collect(), key=str) == sorted([tuple(r)[:3] for r in want], key=str)


def test_secrets(docs, empty):
    out = by_id(secrets.find_secrets(docs), "spans")
    assert [(s["kind"], s["start"], s["stop"]) for s in out[None]] == [("assign", 14, 33)]
    assert all(not v for k, v in out.items() if k is not None)
    assert secrets.find_secrets(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, None), (6, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(docs, labels)
    out = quality_crf.score_documents(docs, model)
    assert out.columns == [*docs.columns, "_score"]
    assert out.filter("_score between 0 and 1").count() == len(ROWS)
    blank = quality_crf.train(docs, labels.limit(0))
    assert quality_crf.score_documents(docs, blank).filter("_score = 0.5").count() == len(ROWS)
    assert quality_crf.keep_good(empty, model).count() == 0


def test_jaccard(docs, empty):
    out = jaccard_join.near_duplicates(docs)
    group, links = by_id(out, "class_id"), by_id(out, "n_links")
    assert group[1] == group[2] == 1 and links[1] == links[2] == 1
    assert group[7] == 7 and links[7] == 1
    assert group[3] == 3 and links[3] == links[4] == links[6] == 0
    assert group[None] is None and links[None] == 0
    stay = jaccard_join.keep_one(docs)
    assert stay.columns == docs.columns and stay.count() == len(ROWS) - 2  # one row of each group, also of repeated rows
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    """Nulls, empty and long texts, repeated identifiers and rows, clashing columns, no labels, and empty tables."""
    import corpus_pipeline

    labels = "doc_id long, quality int, toxic int"
    more = [(1, "unlike the other text of identifier one, and long enough", "en", "a", 1), (None, "", "en", "b", 0)]
    every = docs.unionByName(spark.createDataFrame([(*r, "clash", "clash", "clash", None, "clash") for r in more], SCHEMA))
    every.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns
    # equal texts: 1 and 2; 3, 4 and null; 7 twice.  The white space of 6 is no near copy.
    kept = sorted((r.doc_id for r in rows.collect()), key=str)
    assert kept == sorted([2, 4, None, 5, 6, 7, -8, 1], key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], labels).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_leaves_no_scratch(spark):
    """After a run only the last stage's input is left in the shared folder."""
    from pathlib import Path

    import corpus_pipeline

    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.iterdir())
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    (left,) = set(root.iterdir()) - before
    assert [x.name for x in left.iterdir()] == ["stage-3"]


def test_pieces(docs, empty, vocabulary):
    out = pieces.encode_documents(docs, vocabulary)
    n, same = by_id(out, "n_tokens"), by_id(out, "round_trip")
    assert n[3] == n[4] == 0 and same[3] and same[5] and not same[-8]
    assert out.count() == len(ROWS)
    assert pieces.encode_documents(empty, vocabulary).count() == 0


def test_lm(docs, empty):
    out = gru_lm.score_documents(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS)
    assert rows[3].n_tokens == rows[4].n_tokens == rows[6].n_tokens == 1
    assert rows[5].n_tokens == 40_002
    assert all(r.score < 0 and r.base_score < 0 for r in rows.values())
    assert gru_lm.score_documents(empty).count() == 0


def test_token_store(docs, empty, vocabulary):
    out = token_store.sequences(docs, vocabulary, length=64, per_shard=16)
    assert sorted(r.slot for r in out.select("slot").collect()) == list(range(out.count()))
    assert token_store.sequences(empty, vocabulary).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix(docs, block_chars=20)
    assert out.count() == len(ROWS) and out.filter("slot is null").count() == 0
    ordered = mixing.in_order(docs, block_chars=20)
    assert ordered.columns == docs.columns and ordered.count() == len(ROWS)
    assert mixing.mix(empty).count() == 0 and mixing.in_order(empty).count() == 0


def test_licenses(docs, empty):
    out = licenses.scan(docs, path=F.col("path"))
    assert out.count() == len(ROWS) and out.filter("license is not null").count() == 0
    assert licenses.scan(empty).count() == 0


def test_hnsw(spark):
    inf = float("inf")
    rows = [
        (1, [1.0, 0.0], 0),
        (2, [2.0, 0.0], 0),
        (3, [1.0, 0.0], 1),
        (4, None, 0),
        (5, [0.0, 0.0], 0),
        (6, [inf, 1.0], 0),
        (7, [1.0, None], 0),
        (8, [1.0, 0.0], None),
        (9, [1.0, 0.1, 0.0], 0),
        (9, [1.0, 0.0], 0),
        (None, [1.0, 0.0], 0),
    ]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {(r.vec_id, i): r for i, r in enumerate(hnsw_dedup.near_duplicates(v).orderBy("vec_id", "n_links").collect())}
    first = {k[0]: r for k, r in out.items()}
    assert first[1].n_links == 2 and first[2].n_links == 2 and first[1].component_id == 1
    assert [r.n_links for k, r in out.items() if k[0] == 9] == [0, 2]
    assert all(first[i].n_links == 0 and first[i].kept for i in (3, 4, 5, 6, 7, 8))
    assert hnsw_dedup.near_duplicates(v.limit(0)).count() == 0


def test_gru_log_prob_near_and_far_logits():
    """Log-probabilities and gradients are those of double precision, with logits that need a shift and without."""
    rng = np.random.default_rng(11)
    h = np.tanh(rng.normal(size=(300, gru_lm.HIDDEN))).astype(np.float32)
    target = rng.integers(0, gru_lm.VOCABULARY, 300)
    kind, word = target // gru_lm.CLASSES, target % gru_lm.CLASSES
    for size in (0.1, 8.0):
        net = gru_lm.Gru.start(rng.integers(1, 1000, gru_lm.VOCABULARY), 5)
        net.p["class_w"] = (size * rng.normal(size=net.p["class_w"].shape)).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in net.p.items()}
        found, back = net.log_prob(h, target, grads)
        p, x = {k: v.astype(float) for k, v in net.p.items()}, h.astype(float)
        want, slope = np.zeros(300), np.zeros(x.shape)
        logits = x @ p["class_w"] + p["class_b"], np.einsum("nh,nhc->nc", x, p["word_w"][kind]) + p["word_b"][kind]
        errors = []
        for e, aim in zip(logits, (kind, word), strict=True):
            e = e - e.max(1, keepdims=True)
            e -= np.log(np.exp(e).sum(1, keepdims=True))
            want += e[np.arange(300), aim]
            errors.append(np.eye(gru_lm.CLASSES)[aim] - np.exp(e))
        slope = errors[0] @ p["class_w"].T + np.einsum("nc,nhc->nh", errors[1], p["word_w"][kind])
        assert np.allclose(found, want, rtol=1e-4, atol=1e-3) and np.allclose(back, slope, rtol=1e-2, atol=1e-2)
        assert np.allclose(grads["class_b"], errors[0].sum(0), atol=1e-2) and np.allclose(grads["class_w"], x.T @ errors[0], atol=1e-2)
        assert np.isclose(grads["word_b"].sum(), errors[1].sum(), atol=1e-2)


def test_gru_window_gradient_is_that_of_its_loss():
    """A window whose rows end at different steps; differences of the loss in double precision."""
    rng = np.random.default_rng(12)
    net = gru_lm.Gru.start(rng.integers(1, 1000, gru_lm.VOCABULARY), 5)
    net.p = {k: v.astype(float) * (1 if k.endswith("_b") else 3) for k, v in net.p.items()}
    x, y = rng.integers(0, 40, (2, 4, 6))
    mask = np.arange(6) < np.array([6, 6, 4, 1])[:, None]
    start = rng.normal(size=(4, gru_lm.HIDDEN)) * 0.3

    def loss() -> float:
        h, total = start, 0.0
        for t in range(6):
            h = net.step(net.inputs(x[:, t]), h)[0]
            total += net.log_prob(h[mask[:, t]], y[mask[:, t], t])[0].sum()
        return total

    grads, after = net.train_window(x, y, mask, start)
    h = start
    for t in range(6):
        h = net.step(net.inputs(x[:, t]), h)[0]
    assert np.allclose(after, h)
    for name in ("embed", "w", "u", "b", "class_w", "class_b"):
        flat, slope = net.p[name].reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3].tolist() + [0]:
            before = flat[i]
            flat[i] = before + 1e-5
            up = loss()
            flat[i] = before - 1e-5
            down = loss()
            flat[i] = before
            assert np.isclose((up - down) / 2e-5, slope[i], rtol=1e-4, atol=1e-6), (name, i)


def test_chunks_of_a_column_are_those_of_its_texts():
    texts = ["a" * 700_000, None, "é" * 400_000, "", "b" * 1_500_000, "c", "😀" * 10]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(texts * 2).slice(len(texts))):
        found = list(B.text_chunks(column))
        assert [(a, b) for a, b, _ in found] == list(B.chunks(texts)) and [t for *_, part in found for t in part] == texts


def test_workers_give_memory_back(monkeypatch):
    """At the end of a task, whether its rows were all read or not; a batch's texts are not all strings at once."""
    calls = []
    monkeypatch.setattr(B, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(["a b c"] * 4), *[pa.array(range(4))] * 2], ["doc", "text", "file", "row"])
    run = B.tidy(jaccard_join._signatures)
    assert [b.num_rows for b in run(iter([batch, batch]))] == [4, 4] and calls == [1]
    some = run(iter([batch, batch]))
    next(some)
    some.close()
    assert calls == [1, 1]
    monkeypatch.undo()
    B.give_back()


def test_gru_training_uses_its_memory_again():
    """Windows after the first ones don't have the system clear new pages."""
    import resource

    from spatialith.llm import textbatch

    textbatch.keep_freed()
    rng = np.random.default_rng(3)
    net = gru_lm.Gru.start(rng.integers(1, 1000, gru_lm.VOCABULARY), 5)
    runs = [rng.integers(0, gru_lm.VOCABULARY, 128) for _ in range(gru_lm.TRAIN_ROWS)]
    net.train(iter(runs))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    assert net.train(iter(runs * 2)) == 2 * 128 * gru_lm.TRAIN_ROWS
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 8000  # 8 windows; some 3000 pages each before


def test_gru_log_prob_without_gradients_and_by_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    net = gru_lm.Gru.start(rng.integers(1, 1000, gru_lm.VOCABULARY), 5)
    h, target = rng.normal(size=(500, gru_lm.HIDDEN)).astype(np.float32), rng.integers(0, gru_lm.VOCABULARY, 500)
    value, back = net.log_prob(h, target)
    assert back is None
    for rows in (1, 7, 100, 5000):
        monkeypatch.setattr(gru_lm, "AT_ONCE", rows)
        grads = {k: np.zeros_like(v) for k, v in net.p.items()}
        got, back = net.log_prob(h, target, grads)
        assert np.allclose(got, value, atol=1e-5) and back.shape == h.shape


def test_gru_training_is_plain_adam_over_windows():
    """Runs of several lengths; each step against a plain one over whole arrays."""
    rng = np.random.default_rng(13)
    counts = rng.integers(1, 1000, gru_lm.VOCABULARY)
    runs = [rng.integers(0, gru_lm.VOCABULARY, n) for n in (70, 64, 33, 32, 1)]
    net, plain = gru_lm.Gru.start(counts, 5), gru_lm.Gru.start(counts, 5)
    assert net.train(iter(runs)) == 200
    m, v = ({k: np.zeros(x.shape) for k, x in plain.p.items()} for _ in range(2))
    h = np.zeros((5, gru_lm.HIDDEN), np.float32)
    for step, a in enumerate(range(0, 70, gru_lm.WINDOW), 1):
        here = [r for r in runs if len(r) > a]
        y, mask, x = np.zeros((3, len(here), min(gru_lm.WINDOW, 70 - a)), np.int64)
        for i, r in enumerate(here):
            part = r[a : a + gru_lm.WINDOW]
            y[i, : len(part)], mask[i, : len(part)] = part, 1
            x[i] = np.resize(np.append(np.concatenate([[0], r])[a : a + gru_lm.WINDOW], np.zeros(32, int)), x.shape[1])
        grads, h = plain.train_window(x, y, mask.astype(bool), h[: len(here)])
        n = mask.sum()
        scale = 1 / n / max(1.0, np.sqrt(sum((g.astype(float) ** 2).sum() for g in grads.values())) / n)
        for k, g in grads.items():
            g = g.astype(float) * scale
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            top = m[k] / (1 - 0.9**step)
            plain.p[k] = (plain.p[k] + gru_lm.LEARNING_RATE * top / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    assert np.allclose(net.flat(), plain.flat(), rtol=1e-3, atol=1e-4)


def test_gru_scores_few_sequences_side_by_side(monkeypatch):
    """Those that advance together stay in a core's cache; how many doesn't change a score, which is that of plain steps."""
    rng = np.random.default_rng(14)
    net = gru_lm.Gru.start(rng.integers(1, 1000, gru_lm.VOCABULARY), 5)
    edges = np.array([0, 3, 3, 40, 41, 90])
    tokens = rng.integers(0, gru_lm.VOCABULARY, 90).astype("<u2")
    want = []
    for a, b in zip(edges, edges[1:], strict=False):
        h, value, before = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0, 0
        for token in tokens[a:b].tolist():
            h = net.step(net.inputs(np.array([before])), h)[0]
            value, before = value + net.log_prob(h, np.array([token]))[0][0], token
        want.append(value)
    wide, take = [], np.take
    monkeypatch.setattr(np, "take", lambda x, i, **more: (wide.append(len(i)), take(x, i, **more))[1])
    for rows in (1, 2, 512):
        monkeypatch.setattr(gru_lm, "SCORE_ROWS", rows)
        wide.clear()
        assert np.allclose(net.score(tokens, edges), want, rtol=1e-5) and 0 < max(wide) <= rows


def test_lowered_codes_of_one_byte_and_of_four():
    plain, far = ["Ab É\xa0ß", None, "", "ZÀÿ"], ["Ab É", "ZŁ😀", "\ud800A"]
    for texts, size in ((plain, 1), (far, 4), ([], 1)):
        flat, offsets = B.lowered_codes(texts)
        want, at = B.codes(texts)
        assert flat.dtype.itemsize == size and offsets.tolist() == at.tolist()
        assert flat.tolist() == B.lower_ascii(want).tolist()
        spans = offsets[:-1], offsets[1:]
        assert (B.span_hashes(flat, *spans) == B.span_hashes(B.lower_ascii(want), *spans)).all()
