import hashlib
import random
import re

from folioframe.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    least = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"wö{i}" for i in range(40)] + ["The", "of,"]
    passages = [" ".join(rng.choices(vocab, k=rng.randrange(8, 40))) for _ in range(12)]
    rows = []
    for d in range(250):
        bits = []
        for _ in range(rng.randrange(0, 6)):
            bits.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randrange(1, 30))))
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(bits)))
    rows += [(300, None), (301, ""), (302, " \n "), (None, passages[0]), (None, passages[0]), (7, passages[1]), (7, passages[1]), (303, "a " * 60), (304, "a\x1c b " * 60)]
    rows += [(400 + i, rows[5][1]) for i in range(30)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, window in ((1, 13), (2, 8)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, src string")
        got = sorted((tuple(r) for r in substring.dedup_words(df, window, with_text=True).collect()), key=str)
        assert got == brute(rows, window)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring.dedup_words(df).collect() == []
