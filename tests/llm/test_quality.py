import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from settlespark.llm.quality import (
    BAD, BELIEF, BELIEF_SHARE, EDGES, GOOD, LABELLERS, LEARNT_FEATURES, NONE, PATTERNS, POWERS, _train, drop_low_quality, expectation_maximisation, features,
    fit_quality, fit_scorer, quality_scores, votes_of,
)

DATA = "/root/testdata/sf0.01"


def test_em_recovers_accuracies_of_simulated_labellers():
    rng = np.random.default_rng(5)
    n, k = 200_000, len(LABELLERS)
    good = rng.random(n) < 0.8
    right, speaks = np.linspace(0.75, 0.95, k), np.linspace(0.9, 0.5, k)
    vote = np.where(rng.random((n, k)) < right, good[:, None], ~good[:, None]).astype(int)
    vote = np.where(rng.random((n, k)) < speaks, vote, NONE)
    patterns, counts = np.unique(vote @ POWERS, return_counts=True)
    model = expectation_maximisation(patterns, counts.astype(float), steps=2000)
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.accuracy - right).max() < 0.02
    judged = model.posterior(np.arange(PATTERNS))[vote @ POWERS] >= 0.5
    assert (judged == good).mean() > 0.95


def test_patterns_hold_the_votes():
    text = b"| a | b | c | d | e | f | g | h | i | j"
    votes = votes_of(np.array([features(text)[0]]))[0]
    assert votes[[l.name for l in LABELLERS].index("separators")] == BAD
    assert set(votes) <= {BAD, GOOD, NONE}


def test_fit_holds_the_features_once():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(32, 127, 3000, np.uint8)) for _ in range(600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:a + 100])], names=["text"]) for a in range(0, 600, 100)]
    posterior = np.linspace(0, 1, PATTERNS)
    schema = pa.schema([("weights", pa.list_(pa.float64()))])
    tracemalloc.start()
    try:
        learned = list(_train(iter(batches), schema, posterior))[0]["weights"][0].as_py()
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    rows, label = [], []
    for text in texts:
        pattern, index, value = features(text)
        most = np.sort(np.argsort(-value, kind="stable")[:LEARNT_FEATURES])
        rows.append((index[most].astype(np.int32), value[most].astype(np.float32)))
        label.append(posterior[pattern])
    assert learned == fit_scorer(rows, np.array(label)).tolist()
    count = sum(len(index) for index, _ in rows)
    assert peak / count < 32


def test_scorer_learns_a_separable_label():
    texts = [b"plain words here and there" if i % 2 else b"@@ ## $$ %% @@ ##" for i in range(60)]
    rows = [features(t)[1:] for t in texts]
    weights = fit_scorer(rows, np.array([i % 2 for i in range(60)], float))
    scores = [float((weights[i] * v).sum() + weights[-1]) for i, v in rows]
    assert all((s > 0) == bool(i % 2) for i, s in enumerate(scores))
    assert not fit_scorer([], np.zeros(0)).any()


@pytest.fixture(scope="module")
def labels():
    table = pq.read_table(f"{DATA}/labels.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["quality"]))


def test_held_out_accuracy(spark, labels):
    """The labels are used here only: the model never sees them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.kept for r in quality_scores(docs).collect()}
    assert len(got) == docs.count()
    good = [got[d] for d, q in labels.items() if q == 1]
    bad = [got[d] for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.10


def plain_measure(text):
    """The statistics byte by byte."""
    kinds = ["space" if c in b" \t\n\r\x0b\x0c" else "upper" if 65 <= c <= 90 else "lower" if 97 <= c <= 122
             else "digit" if 48 <= c <= 57 else "stop" if c in b".,;:'\"()-?" else "symbol" if c < 128 else "other"
             for c in text]
    words = text.split()
    symbols, capitals = kinds.count("symbol"), kinds.count("upper")
    letters = capitals + kinds.count("lower") + kinds.count("other")
    triples, pairs = list(zip(kinds, kinds[1:], kinds[2:])), list(zip(kinds, kinds[1:]))
    lone = triples.count(("space", "symbol", "space"))
    trailing = pairs.count(("symbol", "space")) - lone
    n, parts = max(30, len(words)), max(1, len(words) // 1000)
    shares = []
    for i in range(parts):
        part = words[len(words) * i // parts:len(words) * (i + 1) // parts]
        shares.append(len(set(part)) / max(1, len(part)))
    return (symbols / max(200, len(text)), capitals / max(200, letters),
            sum(a == b for a, b in zip(words, words[1:])) / n, lone / n, trailing / n,
            sum(shares) / parts, len(text) / max(1, len(words)))


def plain_quality(texts):
    """Scores and weak labels of distinct texts, document by document and in dense arrays."""
    votes = []
    for text in texts:
        x = plain_measure(text)
        votes.append([BAD if l.bad[0] <= x[l.statistic] <= l.bad[1] else
                      GOOD if l.good[0] <= x[l.statistic] <= l.good[1] else NONE for l in LABELLERS])
    p = [0.1 if BAD in v else 0.9 if GOOD in v else 0.5 for v in votes]
    for _ in range(200):
        table = [[[1e-3 + b * BELIEF_SHARE * len(texts) for b in row] for row in BELIEF.tolist()] for _ in LABELLERS]
        for v, q in zip(votes, p):
            for j, vote in enumerate(v):
                table[j][BAD][vote] += 1 - q
                table[j][GOOD][vote] += q
        table = [[[x / sum(row) for x in row] for row in rows] for rows in table]
        prior = (sum(p) + 1) / (len(p) + 2)
        before, p = p, []
        for v in votes:
            good, bad = prior, 1 - prior
            for j, vote in enumerate(v):
                good, bad = good * table[j][GOOD][vote], bad * table[j][BAD][vote]
            p.append(good / (good + bad))
        if max(abs(a - b) for a, b in zip(before, p)) < 1e-7:
            break
    x = np.zeros((len(texts), 8193))
    for row, text in zip(x, texts):
        for a, b in zip(text, text[1:]):
            row[(a * 256 + b) * 2654435761 % 2**32 >> 19] += 1
        row[:] = np.sqrt(row)
        row /= max(1e-9, np.sqrt((row ** 2).sum()))
        for i, (value, edges) in enumerate(zip(plain_measure(text), EDGES)):
            row[(i * 16 + sum(e < value for e in edges) + 1) * 2654435761 % 2**32 >> 19] += 0.5
        row[-1] = 1
    y = np.array(p)
    share = (y >= 0.5).mean()
    balance = np.where(y >= 0.5, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))
    w, first, second = np.zeros(8193), np.zeros(8193), np.zeros(8193)
    for step in range(1, 201):
        slope = x.T @ ((1 / (1 + np.exp(-x @ w)) - y) * balance / len(y))
        slope[:-1] += 1e-5 * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        w = w - 0.1 * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return 1 / (1 + np.exp(-x @ w)), y


def test_scores_equal_a_plain_version(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    texts = {d: (t or "").encode() for d, t in zip(rows["doc_id"], rows["text"])}
    texts = {d: t for d, t in texts.items() if len(t) < 20_000}
    df = spark.createDataFrame([(d, t.decode()) for d, t in texts.items()], "doc_id long, text string")
    score, label = plain_quality(list(texts.values()))
    # a text may have more features than the scorer learns from; none of these has
    assert max(len(features(t)[1]) for t in texts.values()) <= LEARNT_FEATURES
    got = {r.doc_id: r for r in quality_scores(df.repartition(3)).collect()}
    assert len(got) == len(texts)
    assert np.abs(np.array([got[d].weak_label for d in texts]) - label).max() < 1e-6
    assert np.abs(np.array([got[d].score for d in texts]) - score).max() < 1e-3
    assert all(got[d].kept == (s >= 0.5) for d, s in zip(texts, score) if abs(s - 0.5) > 1e-3)


def test_long_clean_texts_keep_their_variety(labels):
    table = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    clean = [t for d, t, n in zip(table["doc_id"], table["text"], table["lang"]) if labels.get(d) == 1 and t and n == "en"]
    long = " ".join(clean * (1 + 1_000_000 // sum(map(len, clean)))).encode()
    assert len(long) > 900_000 and plain_measure(long[:300_000])[5] >= 0.45
    names = [l.name for l in LABELLERS]
    assert votes_of(np.array([features(long)[0]]))[0][names.index("variety")] == GOOD
    junk = b"buy it now " * 100_000
    assert votes_of(np.array([features(junk)[0]]))[0][names.index("variety")] == BAD


def test_learning_holds_a_bounded_number_of_features(spark):
    import random
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(33, 1000)) + " " for _ in range(30_000)) for _ in range(6)]
    assert min(len(features(t.encode())[1]) for t in texts) > LEARNT_FEATURES
    docs = texts + [f"Some plain words of a text with number {i}." for i in range(30)]
    got = quality_scores(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert got.count() == 36


def test_odd_rows_and_columns(spark):
    rows = [(None, None, 1, "r"), (1, "", 2, None), (2, "x", 3, "s"), (2, "x", 3, "s"), (3, "@@ ## " * 50_000, 4, "t")]
    rows += [(10 + i, f"Some plain words of a text with number {i} that is not odd at all.", i, "k") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, rest string")
    got = quality_scores(df)
    assert got.count() == len(rows) and 0 <= min(r.score for r in got.collect())
    kept = drop_low_quality(df)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} <= set(rows)
    assert kept.count() == got.filter("kept").count() >= 50


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality_scores(df).collect() == [] and drop_low_quality(df).collect() == []


def test_sample_is_a_bound_on_learning_only(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    few, many = (fit_quality(docs, sample_rows=n) for n in (100, 10_000))
    assert few[0].prior == many[0].prior and (few[1] == many[1]).all()
    assert (few[2] != many[2]).any()
