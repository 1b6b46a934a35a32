import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from llm_fixtures import document_rows, messy
from pyspark.sql import functions as F

from ordinata.llm import bpe, fingerprint, jaccard, kdtree, langid, queries
from ordinata.llm.texts import shingle_hashes, word_hashes
from ordinata.llm import common
from ordinata.llm.common import components, cut, join_classes, known, utf8
import pyarrow as pa

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
W = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = W.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, z in sets[:a]:
            o = len(s & z)
            if o and 100 * o >= percent * len(s | z):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i)) for i, s in sets}


def test_words_and_shingles_are_those_of_each_text():
    texts = ["", "a b", "A  b\x0bc", None, "é à\n", "abcde", "x" * 3_000_000, "b"]
    h, at = word_hashes(*utf8(pa.array(texts, pa.string())))
    assert np.diff(at).tolist() == [0, 2, 3, 0, 2, 1, 1, 1]
    assert h[0] == h[2] and h[1] == h[3] == h[-1] and len(set(h.tolist())) == 7
    _, to = shingle_hashes(h, at)
    assert np.diff(to).tolist() == [0, 1, 1, 0, 1, 1, 1, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 90]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    rows = list(enumerate(rows, 100))
    got = jaccard.link(messy(spark, [(i, t, None, None, None) for i, t in rows], DOCS)).collect()
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in got} == brute_components(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_jaccard_at_the_bound(spark, percent):
    """Pairs of sets exactly at the bound, just above and just below it."""
    rows = []
    for g in range(30):
        union, both = 20 * (1 + g % 3), 20 * (1 + g % 3) * percent // 100 + (g % 3 - 1)
        words = [f"g{g}w{i}" for i in range(union)]
        rows += [(2 * g, " ".join(f"{w} . . . . ." for w in words[:both])), (2 * g + 1, " ".join(f"{w} . . . . ." for w in words))]
    got = jaccard.link(messy(spark, [(i, t, None, None, None) for i, t in rows], DOCS), percent=percent).collect()
    want = brute_components(rows, percent)
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("kind", ["near", "two kinds", "apart"])
def test_jaccard_of_a_large_block_in_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(jaccard, "SETS", 7)
    base = [f"v{i}" for i in range(60)]
    other = [*base[:40], *[f"o{i}" for i in range(20)]]
    rows = []
    for i in range(90):
        words = list(other if kind == "two kinds" and i % 3 else base)
        for j in range(1 if kind != "apart" else 3):
            words[(i + 20 * j) % 60] = f"u{i % 5 if kind == 'apart' else i}"
        rows.append((i, " ".join(words)))
    got = jaccard.link(messy(spark, [(i, t, None, None, None) for i, t in rows], DOCS)).collect()
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in got} == brute_components(rows)


def test_jaccard_of_many_small_blocks_of_text(spark):
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"{common} {' '.join(rng.choice('abcdef') + str(i // 3) for _ in range(rng.choice([3, 14, 40])))}" if i % 2 else " ".join(f"x{i}y{j}" for j in range(30))) for i in range(150)]
    d = spark.createDataFrame(rows, "id long, text string").withColumn("th", F.xxhash64("text")).select("id", "th", "text")
    made = jaccard.incidence(d, 80, 5, block_bytes=3000).collect()
    assert len([r for r in made if r["m"] is None]) == len(rows)
    assert all(r["id"] is None and r["m"] > 0 and len(r["grams"]) % 8 == 0 for r in made if r["m"] is not None)
    got = jaccard.link(d.withColumnRenamed("id", "doc_id")).collect()
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in got} == brute_components(rows)


def test_different_texts_of_one_id_are_documents_of_their_own(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(3, a), (9, a.replace("a30", "zz")), (9, "a text of its own that nothing is like"), (12, "one more text that nothing else is like"), (None, a), (None, "of no id and like nothing else at all")]
    got = sorted((r["id"] or 0, r["n_shingles"], r["component"] or 0) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 5, 0), (0, 56, 0), (3, 56, 3), (9, 5, 9), (9, 56, 3), (12, 4, 12)]


def test_jaccard_messy(spark, docs, no_docs):
    want = brute_components([(r[0], r[1]) for r in document_rows()])
    got = jaccard.link(docs).collect()
    assert len(got) == len(document_rows())
    assert all((r["n_shingles"], r["component"]) == want[r["id"]] for r in got)
    assert jaccard.link(no_docs).count() == 0
    null_id = jaccard.link(spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert {(r["id"], r["component"]) for r in null_id} == {(None, None), (1, 1)}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r["v"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_broadcasts_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base if i < 40 else [w if rng.random() > 0.02 else f"u{i}" for w in base])) for i in range(260)] + [(i, "") for i in range(300, 320)]
    edges = spark.createDataFrame([(100, i) for i in range(0, 99)] + [(i, i + 1) for i in range(200, 215)], "a long, b long")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard, "SETS", 16)
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in got} == brute_components(rows)
    assert {r["v"]: r["comp"] for r in components(edges).collect()} == {**dict.fromkeys([*range(99), 100], 0), **dict.fromkeys(range(200, 216), 200)}


def test_hot_and_missing_keys_do_not_heap_up(spark):
    n = 20_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.lit("copy").alias("t"))
    classes = cut(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("c"), F.lit(1).alias("one")))
    before = {x: spark.conf.get(x) for x in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = join_classes(rows, classes, ["k"], "c", n)
        held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == n and max(held) < 2 * n / len(held) and len(held) > 4
        want = known(rows, classes, ["k"], "c", n)
        assert want.columns == out.columns and sorted(map(str, want.collect())) == sorted(map(str, out.collect()))
    finally:
        for x, v in before.items():
            spark.conf.set(x, v)


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library_and_back(spark, docs, no_docs):
    enc, path = encoding(), public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=1 << 16), path).collect()
    want = {r[0]: r[1] or "" for r in document_rows()}
    assert len(got) == len(document_rows())
    for r in got:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == enc.encode_ordinary(want[r["id"]])
        assert bytes(r["decoded"]).decode() == want[r["id"]]
    assert queries.token_digests(no_docs).count() == 0
    digests = {r["doc_id"]: r for r in queries.token_digests(docs).collect()}
    assert digests[4]["n_tokens"] == 0 and digests[4]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == digests[5]["decoded_sha256"]


def test_bpe_decoding_refuses_unknown_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bad = spark.createDataFrame([(1, bytearray(np.array([50256], "<u4").tobytes()))], "id long, ids binary")
    with pytest.raises(Exception, match="not in the token table"):
        bpe.decode(bad, path).collect()


def test_language_held_out_accuracy(spark):
    d = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = d.where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def brute_grams(text, orders):
    """The n-grams of one text, as code points."""
    t = "".join(" " if (ord(c) < 0x80 and not "a" <= c <= "z") or 0x2000 <= ord(c) < 0x2070 or 0x80 <= ord(c) < 0xC0 else c for c in text.lower())
    t = " " + re.sub(" +", " ", t).strip(" ") + " "
    return [t[i : i + n] for n in orders for i in range(len(t) - n + 1)]


def test_naive_bayes_against_plain_python(spark):
    rng = random.Random(6)
    words = {"aa": ["lalo", "mila", "Ora!"], "bb": ["krk", "grut", "zz-top"], "cc": ["ñandú", "éa", "mila"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 12))), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 20)]
    orders, buckets, smoothing = (1, 2, 3), 1 << 15, 0.1
    bucket = {}

    def of(gram):
        if gram not in bucket:
            h = ord(gram[0])
            for c in gram[1:]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            h = (h + (len(gram) << 56)) % 2**64
            h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
            bucket[gram] = ((h ^ (h >> 31)) >> 32) % buckets
        return bucket[gram]

    counts = {lang: collections.Counter(of(g) for _, t, x in rows if x == lang for g in brute_grams(t, orders)) for lang in words}
    total = {lang: sum(c.values()) + smoothing * buckets for lang, c in counts.items()}
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r["id"]: r for r in langid.predict(df, langid.fit(df), id_col="id").collect()}
    for i, t, _ in rows:
        z = {lang: math.log(sum(r[2] == lang for r in rows) / len(rows)) + sum(math.log((counts[lang][of(g)] + smoothing) / total[lang]) for g in brute_grams(t, orders)) for lang in words}
        best = max(sorted(z), key=z.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(math.exp(v - z[best]) for v in z.values())) < 1e-9


def test_language_messy(spark, docs, no_docs):
    model = langid.fit(docs.withColumn("id", F.col("doc_id")).select("id", "text", "lang"))
    assert model.langs == ["de", "en", "es"]
    got = {r["id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 14, 15))
    assert got[12]["lang_pred"] == "es" and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.fit(no_docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert nothing.langs == [] and {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_shards_are_whole_balanced_and_gapless(spark, docs, no_docs):
    rng = random.Random(4)
    rows = [(i, "t" * rng.randrange(1, 900), rng.choice(["en", "fr"]), rng.choice(["hot", "hot", "b", "c"]), 1) for i in range(3000)]
    rows += [(i, "copy" * 30, "en", "hot", 1) for i in range(3000, 3400)]
    got = kdtree.shard(messy(spark, rows, DOCS)).toPandas()
    assert len(got) == len(rows) and sorted(got["shard"].unique()) == list(range(8))
    total = got.groupby("shard")["size"].sum()
    assert total.max() / total.mean() < 1.03 and total.min() / total.mean() > 0.97
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got.groupby(["crc", "size"])["shard"].nunique().max() == 1
    small = kdtree.shard(docs).toPandas()
    assert len(small) == len(document_rows()) and small[small["id"] == 4]["size"].tolist() == [1]
    assert kdtree.shard(no_docs).count() == 0


def test_a_cut_is_the_weighted_median(spark):
    """Two shards of points on one dimension, against the best cut of the sorted weights."""
    rng = random.Random(5)
    points = [(i, rng.randrange(1, 40), 1, float(rng.randrange(10_000)), 0.0, 0.0, 0.0) for i in range(400)]
    df = spark.createDataFrame(points, "pid long, w long, n long, first_id double, length double, source double, lang double")
    got = {r["pid"]: (r["node"], r["first_id"], r["w"]) for r in kdtree.tree(df, 2).collect()}
    left, right = ([(x, w) for n, x, w in got.values() if n == side] for side in (0, 1))
    assert max(x for x, _ in left) <= min(x for x, _ in right)
    total, best, before = sum(p[1] for p in points), float("inf"), 0
    for _, w in sorted((p[3], p[1]) for p in points):
        before += w
        best = min(best, abs(total / 2 - before))
    assert abs(sum(w for _, w in left) - total / 2) <= best + 1e-9


def test_a_text_that_outweighs_a_shard_is_split(spark):
    rows = [(i, "same text", "en", "a", 1) for i in range(1500)] + [(i, f"text {i}", "en", "b", 1) for i in range(1500, 3000)]
    total = kdtree.shard(messy(spark, rows, DOCS)).toPandas().groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() / total.mean() < 1.25


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs; nulls leave the seed."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def winnowed(text, k=5, window=8):
    words = re.findall(r"\S{1,24}", text.lower())
    h = [spark_hash(w) for w in words]
    n = max(len(h) - k + 1, min(len(h), 1))
    grams = [spark_hash(*h[i : i + k]) % 2**36 for i in range(n)]
    grams = [g - 2**36 if g >= 2**35 else g for g in grams]
    out = []
    for i in range(max(n - window + 1, min(n, 1))):
        part = grams[i : i + window]
        at = max(j for j, g in enumerate(part) if g == min(part))  # rightmost
        if (part[at], i + at) not in out:
            out.append((part[at], i + at))
    return out


def test_winnowing_against_brute_force(spark, docs, no_docs):
    texts = {r[0]: r[1] or "" for r in document_rows() if r[0] != 9}
    d = messy(spark, [(i, t, None, None, None) for i, t in texts.items()] + [(50, "tie " * 40, None, None, None)], DOCS)
    texts[50] = "tie " * 40
    got = {r["id"]: r for r in fingerprint.fingerprints(d).withColumn("pos", fingerprint.positions(F.col("keys"))).collect()}
    order = sorted(texts, reverse=True)
    for a, i in enumerate(order):
        r, t, nxt = got[i], texts[i], texts[order[(a + 1) % len(order)]]
        m = len(t) // 3
        assert r["edited"] == t[: len(t) - m] + nxt[:m] and r["n_chars"] == len(t)
        want = winnowed(t)
        assert r["pos"] == [p for _, p in want]
        assert [k >> 28 for k in r["keys"]] == [g for g, _ in want]
        sets = [{g for g, _ in winnowed(x)} for x in (t, r["edited"], nxt)]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r["near_edited"] - like(sets[0], sets[1])) < 1e-9 and abs(r["near_next"] - like(sets[0], sets[2])) < 1e-9
    assert fingerprint.fingerprints(no_docs).count() == 0
    assert fingerprint.fingerprints(docs).count() == len(document_rows())


@pytest.mark.parametrize("kind", ["sparse", "one", "copies", "nulls"])
def test_the_next_row_over_many_stretches(spark, kind):
    rng = random.Random(2)
    ids = {"sparse": [rng.randrange(-(2**63), 2**63) for _ in range(3000)], "one": [7] * 3000, "copies": [7] * 3000, "nulls": [None if i % 3 else i for i in range(3000)]}[kind]
    rows = [(i, "the same text" if kind == "copies" and j % 50 else f"text {j} {'x' * (j % 9)}") for j, i in enumerate(ids)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["id"], r["edited"]) for r in fingerprint.edits(d).collect())
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), spark_hash(r[1])))
    want = collections.Counter()
    for a, (i, t) in enumerate(order):
        want[i, t[: len(t) - len(t) // 3] + order[(a + 1) % len(order)][1][: len(t) // 3]] += 1
    assert got == want
    plan = fingerprint.edits(d)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
    keyed = d.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__k"), F.xxhash64("text").alias("__t"), F.monotonically_increasing_id().alias("__m"))
    most = max(r["count"] for r in keyed.groupBy(fingerprint._stretches(keyed, ["__k", "__t", "__m"])).count().collect())
    assert most < 400  # of 3000 rows in 32 stretches


def test_one_row_follows_itself(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdab" and one["near_next"] == 1.0
