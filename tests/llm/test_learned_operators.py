import random

import numpy as np
import pytest
from llm_fixtures import DOCS, document_rows, messy
from pyspark.sql import functions as F

import corpus_pipeline
from ordinata.llm import linear, mixing, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose, a third of it shouted junk, some of it with insults; labels for two thirds."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        bad, toxic = i % 3 == 0, i % 5 == 0
        if bad:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            for _ in range(rng.randrange(1, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(["grumblefoo", "snarkbar", "vilebaz"]))
        rows.append((i, " ".join(text), "en", "hot" if i % 2 else f"s{i % 7}", len(text)))
        if i % 3 != 1 or i % 2:
            labels.append((i, 0 if bad else 1, int(toxic)))
    return messy(spark, rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_quality_tells_junk_and_keeps_the_rest(corpus):
    got = quality.classify(*corpus).toPandas().set_index("id")
    bad = np.array([i % 3 == 0 for i in got.index])
    assert got["keep"][~bad].mean() > 0.99 and got["keep"][bad].mean() < 0.05
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()


def test_toxicity_grades(corpus):
    got = toxicity.classify(*corpus).toPandas().set_index("id")
    toxic = np.array([i % 5 == 0 for i in got.index])
    assert got["toxic"][toxic].mean() > 0.95 and got["toxic"][~toxic].mean() < 0.01
    assert got["severity"].between(0, 3).all() and set(got["grade"]) <= {0, 1, 2, 3}


def test_thresholds_are_ordered_and_share_weights():
    rng = np.random.Generator(np.random.PCG64(3))
    n = 3000
    x = rng.integers(0, 2, (n, 4)).astype(bool)
    s = x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.logistic(size=n)
    y = np.digitize(s, [-0.5, 1.0, 2.5])
    rows = linear.Rows(np.nonzero(x)[1], np.append(0, np.cumsum(x.sum(1))), 4)
    w, t = linear.ordinal(rows, y, 4, ridge=0.1)
    assert np.allclose(w, [2, -1, 0.5, 0], atol=0.25) and np.allclose(t, [-0.5, 1, 2.5], atol=0.25) and (np.diff(t) > 0).all()


def test_ordinal_loss_has_its_gradient():
    """The fitted weights are where plain differences of the plain loss vanish."""
    rng = np.random.Generator(np.random.PCG64(4))
    x = rng.integers(0, 2, (200, 3)).astype(bool)
    y = np.digitize(x @ np.array([1.0, -2.0, 0.5]) + rng.logistic(size=200), [-0.5, 0.8])
    w, t = linear.ordinal(linear.Rows(np.nonzero(x)[1], np.append(0, np.cumsum(x.sum(1))), 3), y, 3, ridge=0.5)

    def loss(p):
        total = 0.25 * (p[:3] @ p[:3])
        for row, grade in zip(x, y, strict=True):
            under = [0.0, *[1 / (1 + np.exp(-(c - row @ p[:3]))) for c in p[3:]], 1.0]
            total -= np.log(under[grade + 1] - under[grade])
        return total

    at = np.append(w, t)
    for i in range(len(at)):
        step = np.eye(len(at))[i] * 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 0.02


def test_grades_of_ties_are_equal():
    """Rows alike get one grade, whatever their number."""
    columns, y = np.array([0] * 30 + [1] * 30), np.array([1] * 30 + [0] * 30)
    got = toxicity.graded(linear.Rows(columns, np.arange(61), 2), y, 4)
    assert (got[30:] == 0).all() and (got[:30] > 0).all()


def test_threshold_loses_the_share_allowed():
    rng = np.random.Generator(np.random.PCG64(9))
    y = np.repeat([0, 1], 1000)
    rng.shuffle(y)
    z = np.stack([rng.normal(2.0 * y - 1), rng.normal(1.0 * y)], 1)
    for lost in (0.005, 0.05):
        t = quality.threshold(z, y, lost)
        scores = np.empty(len(y))
        for h in (0, 1):
            w = quality.calibrate(z[np.arange(len(y)) % 2 != h], y[np.arange(len(y)) % 2 != h])
            scores[np.arange(len(y)) % 2 == h] = 1 / (1 + np.exp(-(w[0] + z[np.arange(len(y)) % 2 == h] @ w[1:])))
        assert t == 0.5 or abs((scores[y == 1] < t).mean() - lost) < 0.002
    assert quality.threshold(z, np.ones(len(y), int), 0.1) == 0.5


def _brute(sample):
    """A pass over documents (tokens, p), as `mixing.descend` asks for it."""
    tokens, p = sample

    def sums(past):
        r = np.ones(len(p))
        for step in past:
            r = np.maximum(r - p @ step, 0)
        mass = (r * tokens)[:, None] * p
        return mass.sum(0), (mass * (p >= 0.5)).sum(0), (p * (tokens * (r > 0))[:, None]).T @ p

    return sums


@pytest.mark.parametrize("share", [[0.94, 0.05, 0.01], [0.2, 0.2, 0.6], [0.35, 0.6, 0.05]])
def test_rates_reach_far_targets(share):
    rng = np.random.Generator(np.random.PCG64(2))
    p = rng.dirichlet([0.3, 0.1, 0.05], 4000)
    tokens = rng.integers(1, 900, 4000).astype(float)
    past, want, now = mixing.descend(_brute((tokens, p)), lambda base, _: np.array(share) * base.sum(), 200, 2e-4)
    assert np.abs(now - want).max() <= 1e-3 * want.sum()


def test_rates_out_of_reach_are_the_nearest_and_say_so():
    """One kind of document only: the exact nonnegative least squares has one rate for all."""
    p, tokens = np.tile([0.75, 0.25], (50, 1)), np.full(50, 10.0)
    with pytest.warns(UserWarning, match="out of reach"):
        _, want, now = mixing.descend(_brute((tokens, p)), lambda base, _: np.array([100.0, 300.0]), 200, 2e-4)
    scale = max(0.0, (want @ p[0]) / (p[0] @ p[0]))
    assert np.allclose(now, scale * p[0], rtol=0.02)


def test_graded_labels_are_taken_as_they_are(spark):
    rows = [(i, " ".join(["fine"] * 5 + ["mild"] * (i % 3 == 1) + ["severe"] * (i % 3 == 2) + [f"u{i}"]), None, None, None) for i in range(300)]
    d = messy(spark, rows, DOCS)
    model = toxicity.fit(d.withColumn("id", F.col("doc_id")), spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, y int"))
    assert len(model.thresholds) == 2
    got = {r["id"]: r["grade"] for r in toxicity.score(d.withColumn("id", F.col("doc_id")), model).collect()}
    assert np.mean([got[i] == i % 3 for i in range(300)]) > 0.95


def test_rates_meet_the_targets(spark, corpus):
    docs, labels = corpus
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    got = mixing.mix(rows, mixing.domains(labels), [0.5, 0.3, 0.2]).toPandas()
    p, tokens = np.stack(got["p"]), got["tokens"].to_numpy()
    totals = (got["rate"].to_numpy() * tokens) @ p
    assert (got["rate"] >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.allclose(totals / tokens.sum(), [0.5, 0.3, 0.2], atol=0.01)
    assert abs((got["copies"] * tokens).sum() / totals.sum() - 1) < 0.1


def test_learned_operators_on_messy_and_empty_tables(spark, docs, no_docs, corpus):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (7, 0, 1), (9, 1, 0), (13, 0, 0), (99, 1, 1)], LABELS)
    for labels in (none, odd, corpus[1]):
        assert quality.classify(docs, labels).where("score is not null").count() == len(document_rows())
        assert toxicity.classify(docs, labels).where("severity is not null").count() == len(document_rows())
        rows = docs.select(F.col("doc_id").alias("id"), "text")
        mixed = mixing.mix(rows, mixing.domains(labels), [0.9, 0.05, 0.05]).collect()
        assert len(mixed) == len(document_rows()) and all(r["rate"] >= 0 for r in mixed)
        assert quality.classify(no_docs, labels).count() == 0 == toxicity.classify(no_docs, labels).count()
        assert mixing.mix(no_docs.select(F.col("doc_id").alias("id"), "text"), mixing.domains(labels), [1, 1, 1]).count() == 0
    assert not toxicity.classify(docs, none).where("toxic").count()
    assert not quality.classify(docs, none).where("not keep").count()


def test_pipeline_stages_agree_with_their_operators(spark, tmp_path, corpus):
    docs, labels = corpus
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    again = docs.where("doc_id between 1 and 40 and doc_id % 3 <> 0 and doc_id % 5 <> 0").withColumn("doc_id", F.col("doc_id") + 10_000)
    docs.union(again).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(900) if i % 3 and i % 5}
    assert not any(i >= 10_000 for i in out), "copies go"
    assert len(out & clean) > 0.97 * len(clean) and len(out - clean) < 0.05 * len(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "mixing_sources", "byte_level_bpe"]


def test_one_document_of_each_group(spark, tmp_path):
    """Against a plain reading of the stage: repeated and missing ids, equal and unequal texts."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base) if i % 4 else [f"q{i}x{j}" for j in range(rng.choice([2, 7, 30]))]
        if i % 4 == 1:
            words[rng.randrange(60)] = f"e{i % 3}"
        rows.append((rng.choice([None, 1, 2, 3, 40, 41, i + 50]), " ".join(words), None, rng.choice(["a", "b", None]), i % 2))
    rows += [rows[3], rows[3], (5, None, None, None, 0), (5, None, None, None, 0), (5, "", "x", None, 0), (None, " ", "x", None, 0)]
    rows = [(a, b, c, d, e) for a, b, c, d, e in rows]
    got = corpus_pipeline.keep_one(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    words = [[w for w in (r[1] or "").split()] for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in words]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a & b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = min(group[i], group[j])
    hashed = {r["text"]: r["h"] for r in spark.createDataFrame(rows, DOCS).select("text", F.xxhash64("text").alias("h")).collect()}
    last = lambda v: (v is not None, v if v is not None else 0)
    order = lambda r: (r[0] is None, r[0] or 0, hashed[r[1]], *[(last(v)[0], str(v)) for v in r[2:]])
    want = []
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        want += members if not sets[g] else [min(members, key=order)]
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_pipeline_on_messy_tables(spark, tmp_path, docs, no_docs):
    for name, d in (("a", docs), ("b", no_docs)):
        cols = d.select("doc_id", "text", "lang", "source", "n_chars")
        cols.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (7, 0, 1)], LABELS).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() <= cols.count()
