"""Toxicity: held-out accuracy, unseen misspellings, what training may read, and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tessera.llm import queries, toxicity as T

SF = "/root/testdata/sf0.01"


def texts(seed=1, n=400):
    """Prose of invented words; one in five texts holds an insult, in a long text too."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstv") + r.choice("aeou") for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.choice([8, 40, 400]))]
        if i % 5 == 0:
            for _ in range(r.randint(1, 2)):
                words[r.randrange(len(words))] = r.choice(["wicked", "rubbish", "imbecile", "dreadful"])
        rows.append((" ".join(words), int(i % 5 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    return T.train([(T.words_of(t), y) for t, y in texts()])


def score(model, text):
    return model.score(model.logits(T.words_of(text)))


def test_unseen_texts_and_misspellings(model):
    got = [(score(model, t), y) for t, y in texts(seed=2)]
    assert all(s >= T.LIMIT for s, y in got if y) and np.mean([s < T.LIMIT for s, y in got if not y]) > 0.93
    plain = "badu fomako tesu lanepa"
    assert score(model, plain) < 0.3
    for word in ("wickked", "wickd", "rubbissh", "rubish", "imbecil", "imbeciles", "dreadfull", "dredful"):
        assert score(model, f"{plain} {word}") > score(model, plain) + 0.3, word


def test_a_long_text_does_not_hide_an_insult(model):
    long = " ".join(t for t, y in texts() if not y)
    assert score(model, long) < T.LIMIT <= score(model, f"{long} imbecile")


def test_scores_are_averages(model):
    """A word's logit is its averaged embeddings under the softmax; cells that no row has shown say nothing."""
    for word in ("imbecile", "a", "日本", "imbecileee"):
        values = [model.of_cell[c] for c in T.cells(word)]
        known = [v for v in values if v != 0]
        assert model.logits([word])[0] == pytest.approx(sum(known) / max(1, len(known)) + model.bias, abs=1e-4)
    assert T.cells("ab") == [zlib.crc32(g.encode()) % T.CELLS for g in ("<ab", "ab>", "<ab>", "\0ab")]
    assert model.score(np.empty(0)) == pytest.approx(1 / (1 + np.exp(-model.bias)))
    assert len(model.logits([])) == 0


def test_slope_of_the_weighted_average():
    z, of = np.array([0.3, -1.0, 2.0, 0.5]), np.array([0, 0, 0, 1])
    mean, w = T.pooled(z, of, 2, 1.5)
    for i in range(4):
        up = z + 1e-6 * (np.arange(4) == i)
        assert (T.pooled(up, of, 2, 1.5)[0] - mean)[of[i]] / 1e-6 == pytest.approx(w[i] * (1 + 1.5 * (z[i] - mean[of[i]])), abs=1e-4)


def test_one_class():
    assert 0 < T.train([]).score(np.empty(0)) <= 0.5
    only = T.train([(["a"], 0)] * 30)
    assert only.score(only.logits(["a"])) < 0.1
    assert T.train([([], 1), (["a"], 0)]).score(np.empty(0)) == pytest.approx(0.5)


def test_held_out_rows_of_the_tables(spark):
    got = {r["doc_id"]: r for r in queries.op11_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    true = sum(y and p for y, p in held)
    assert true / sum(y for y, _ in held) > 0.8 and true / sum(p for _, p in held) > 0.8


def test_fit_reads_no_held_out_label(spark):
    rows = texts(n=90)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(90)]
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(rows)], "doc_id long, text string, label int")
    made = lambda flip: spark.createDataFrame([(i, 1 - y if h and flip else y, "x") for i, ((_, y), h) in enumerate(zip(rows, held, strict=True))], "doc_id long, toxic int, text string")
    a, b = T.fit(docs, made(False)), T.fit(docs, made(True))
    assert a.bias == b.bias and (a.of_cell == b.of_cell).all() and a.of_cell.any()


def test_odd_rows(spark, model):
    schema = "doc_id long, text string, score string, id int, held_out binary"
    rows = [(1, None), (2, ""), (3, " \n"), (None, "an imbecile"), (4, "an imbecile"), (4, "an imbecile"), (5, "imbecile " + "badu " * 200_000), (6, "!!! ***")]
    docs = spark.createDataFrame([(*x, "x", 1, b"") for x in rows], schema)
    got = T.toxicity(docs, model).collect()
    assert [r.asDict().keys() for r in got[:1]] == [{"doc_id", "held_out", "score", "predicted"}] and len(got) == len(rows)
    bare = 1 / (1 + np.exp(-model.bias))
    for r in got:
        assert r["score"] == pytest.approx(bare) if r["doc_id"] in (1, 2, 3, 6) else r["predicted"] == 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert T.toxicity(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (1, 0), (2, 7)], "doc_id long, toxic int")
    assert 0 < T.fit(docs, labels).score(np.empty(0)) < 1
    assert T.fit(docs.limit(0), labels.limit(0)).score(np.empty(0)) == pytest.approx(0.5)
