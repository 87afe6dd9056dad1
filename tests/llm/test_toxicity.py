import random

import numpy as np
import pyarrow as pa

from folioframe.llm import toxicity as tx
from folioframe.llm.kernels import text_bytes

VOCAB = [f"word{i}" for i in range(300)]


def corpus(n=700, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(VOCAB, k=rng.randrange(5, 80))
        junk, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Nasty,", "vile", "grimly" + rng.choice("abcdef")]))
        text = ("%%% " if junk else " ").join(words)
        rows.append((i, text, None))
        labels.append((i, int(junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, None, None), (9000, "", None), (3, rows[3][1], None)], "doc_id bigint, text string, toxic string")
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None, 1), (5555, 1, 1)], "doc_id bigint, junk int, toxic int")
    chain = tx.train(docs, known, ["junk", "toxic"])
    got = {r.doc_id: r for r in tx.score(docs, chain).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    assert np.mean([got[i].junk == bool(j) for i, j, _ in held]) > 0.97
    assert np.mean([got[i].toxic == bool(t) for i, _, t in held]) > 0.97
    assert got[None].p_toxic is not None and got[9000].p_toxic == got[None].p_toxic
    assert tx.score(docs.limit(0), chain).count() == 0


def test_later_models_see_out_of_fold_probabilities():
    rows, labels = corpus(400, 1)
    data, offsets = text_bytes(pa.array([r[1] for r in rows]))
    d, h, dense = tx.featurise(data, offsets)
    cut = np.searchsorted(d, np.arange(len(rows) + 1))
    docs = [((h[cut[k] : cut[k + 1]] >> np.uint64(32)).astype(np.uint32), dense[k], np.array(labels[k][1:]), k % tx.FOLDS) for k in range(len(rows))]
    chain = tx.fit_chain(docs, ["junk", "toxic"])
    inside = chain.score(data, offsets)
    assert chain.out_of_fold.shape == inside.shape == (400, 2)
    assert not np.allclose(chain.out_of_fold, inside)
    assert len(chain.models[1].weights) == len(chain.models[1].words) + tx.N_DENSE + 2


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    chain = tx.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"), ["toxic"])
    assert tx.score(docs, chain).first().asDict() == {"doc_id": 1, "p_toxic": 0.0, "toxic": False}


def test_rare_labels_are_all_drawn(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(VOCAB, k=30)) + (" vile" if i % 100 == 0 else ""), None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, x string")
    known = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(4000)], "doc_id bigint, toxic int")
    # A blind draw of 400 has about 4 positives, too few to decide anything.
    chain = tx.train(docs, known, ["toxic"], max_train=400)
    got = tx.score(docs, chain).collect()
    held = [r for r in got if r.doc_id >= 4000]
    assert all(r.toxic == (r.doc_id % 100 == 0) for r in held)
    assert 0.005 < np.mean([r.p_toxic for r in held]) < 0.02
    assert tx.allotted([3, 1000, 50], 300) == [3, 247, 50] and tx.allotted([5, 6], 100) == [5, 6]


def test_selected_on_executors_as_from_all_features(spark):
    rows, labels = corpus(600, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, x string")
    chain = tx.train(docs, spark.createDataFrame(labels, "doc_id bigint, junk int, toxic int"), ["junk", "toxic"])
    data, offsets = text_bytes(pa.array([r[1] for r in rows]))
    d, h, dense = tx.featurise(data, offsets)
    cut = np.searchsorted(d, np.arange(len(rows) + 1))
    fold = [r[0] for r in docs.selectExpr("pmod(xxhash64(doc_id), 5)", "doc_id").orderBy("doc_id").collect()]
    want = tx.fit_chain([((h[cut[k] : cut[k + 1]] >> np.uint64(32)).astype(np.uint32), dense[k], np.array(labels[k][1:]), fold[k]) for k in range(len(rows))], ["junk", "toxic"])
    for a, b in zip(chain.models, want.models, strict=True):
        assert np.array_equal(a.words, b.words) and np.allclose(a.weights, b.weights, atol=1e-4)
    assert np.allclose(chain.thresholds, want.thresholds, atol=1e-4)
