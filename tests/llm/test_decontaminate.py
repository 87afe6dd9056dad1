import numpy as np

from folioframe.llm import decontaminate as dc


def brute(item, doc):
    prev = [0] * (len(doc) + 1)
    for i, x in enumerate(item):
        cur = [i + 1]
        for j, y in enumerate(doc):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(120)] + ["the", "of"]
    word = lambda n: [vocab[int(x) % 122] for x in rng.zipf(1.3, n)]
    items = [(i, word(int(rng.integers(3, 45)))) for i in range(40)]
    docs = []
    for d in range(300):
        text = word(int(rng.integers(0, 200)))
        if d % 3 == 0:
            leak = list(items[d % 40][1])
            for _ in range(int(rng.integers(0, len(leak) // 5 + 2))):
                at = int(rng.integers(len(leak)))
                leak[at : at + int(rng.integers(2))] = [vocab[int(rng.integers(122))]] * int(rng.integers(0, 2))
                leak = leak or ["w0"]
            at = int(rng.integers(len(text) + 1))
            text[at:at] = leak
        docs.append((d, text))
    return items, docs


def test_leaks_match_brute_force(spark):
    items, docs = corpus()
    want = {(d, i): e for d, t in docs for i, w in items if (e := brute(w, t)) <= int(0.2 * len(w) + 1e-9)}
    rows = [(d, " ".join(t).upper().replace(" ", ", ", 1), "x") for d, t in docs] + [(900, None, "x"), (901, "", "x"), (None, "-- !", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.find_leaks(df, bench).collect()}
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(got) >= 0.97 * len(want) and all(x in got for x, e in want.items() if e == 0)
    kept = {r.doc_id for r in dc.without_leaks(df, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}
    assert dc.find_leaks(df.limit(0), bench).count() == 0 and dc.find_leaks(df, bench.limit(0)).count() == 0


def test_embedding_is_near_for_near_texts():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 2**63, (50, 40)).astype(np.uint64)
    y = np.roll(x, 1, axis=1)
    y[:, 0] = 5
    near = (dc.embed(x, 0) != dc.embed(y, 0)).mean()
    far = (dc.embed(x, 0) != dc.embed(x[::-1], 0)).mean()
    assert near < 0.5 < far


def test_every_kind_of_edit_at_the_full_distance():
    rng = np.random.default_rng(9)
    for length in (15, 40, 63):
        k = length // 5
        items = [[f"i{i}x{j}" for j in range(length)] for i in range(100)]
        block = dc.Items.of([(i, " ".join(w)) for i, w in enumerate(items)])
        for kind in ("delete", "insert", "substitute", "mixed"):
            for spread in (True, False):
                docs = []
                for i, item in enumerate(items):
                    at = np.arange(k) * 5 + 4 if spread else rng.choice(length, k, replace=False)
                    leak = list(item)
                    for p in sorted(at.tolist(), reverse=True):
                        what = ("delete", "insert", "substitute")[int(rng.integers(3))] if kind == "mixed" else kind
                        leak[p : p + (what != "insert")] = [] if what == "delete" else [f"new{p}"]
                    docs.append(" ".join([f"before{j}" for j in range(30)] + leak + [f"after{j}" for j in range(30)]))
                found = dc._scan(block, dc.pa.array(docs))
                assert [(d, i) for d, i, *_ in found] == [(i, i) for i in range(100)], (length, kind, spread)
                assert all(e == brute(items[i], docs[d].split()) for d, i, _, _, e in found[:10])
