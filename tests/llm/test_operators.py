"""Each operator and query on small tables, against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuswatch.llm import common, exact_dedup, line_dedup, lm_scoring, mixing, quality, queries, segmentation, simhash, token_counts, topk, warc

SF = "/root/testdata/sf0.001"
#: Nulls, empty, ties, repeated rows, clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept boolean, score double, bundle int, `_id` int, `_text` int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", None, 1.0, 3, 1, 2) for i, t in rows], SCHEMA)


ODD = [(1, "a b c d e f"), (2, None), (3, ""), (3, ""), (4, "a b c d e f"), (None, "a b c d e f"), (5, "word " * 30000), (6, "line\nline\nline\nline\n" * 5), (7, "line\nline\nline\nline\n" * 5), (7, "other")]


def docs_of(sf=SF):
    return pd.read_parquet(f"{sf}/documents.parquet")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- shared -------------------------------------------------------------


def test_components_of_a_chain_a_star_and_a_pair(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = spark.createDataFrame([*chain, *[(1, i) for i in range(2, 30)], (-5, 60), (60, -5), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in common.components(edges).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 30)} == {1} and got[60] == got[-5] == -5
    assert common.components(edges.limit(0)).count() == 0


def test_key_filter_has_no_false_negatives(spark):
    keys = spark.range(1000).select((F.col("id") * 7919).alias("k"))
    for bits in (64, 1 << 16):
        there = common.KeyFilter(keys, bits)  # 64 slots are too few: an equality join
        assert there.mark(keys, "there", F.col("k")).where("there").count() == 1000
        others = there.mark(spark.range(1000).select((-F.col("id") - 1).alias("k"), F.lit(1).alias("n")), "there", F.col("k"))
        assert others.columns == ["k", "n", "there"] and others.count() == 1000 and others.where("there").count() < (1 if bits == 64 else 150)
    none = common.KeyFilter(keys.limit(0))
    assert none.mark(keys, "there", F.col("k")).where("there").count() == 0


def split(spark, rows):
    """Rows of the largest partition of a plan, where partitions of some kilobytes already count as skewed."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        return max(Counter(r["at"] for r in rows().withColumn("at", F.spark_partition_id()).collect()).values())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_payload_of_a_third_of_all_pages_is_dealt_over_tasks(spark):
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("p"), (F.col("id") % 9000).cast("string"))).alias("html")).repartition(8)
    base = warc.payloads(pages)
    assert split(spark, lambda: warc.referred(base, 0)) < 5_000


def test_a_star_of_all_nodes_is_dealt_over_tasks(spark):
    star = spark.range(1, 40_000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).repartition(8)
    low = common.written(star.groupBy("b").agg(F.min("a").alias("m")), "low")
    assert split(spark, lambda: star.join(low, "b")) < 15_000  # the shape that components() has in each round
    got = common.components(star, few=1000)
    assert got.agg(F.max("component"), F.count(F.lit(1))).first() == (0, 40_000)


# --- op1 ----------------------------------------------------------------


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = list(fps)
    for i, a in enumerate(own):
        for b in own[:i]:
            if bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    first = {}
    for f, ids in fps.items():
        first[root(f)] = min(first.get(root(f), math.inf), min(ids))
    return {f: first[root(f)] for f in fps}


def test_op1_equals_brute_force(spark):
    got = queries.op1_simhash(spark, SF).toPandas()
    fps = defaultdict(list)
    for i, t in zip(*(docs_of()[c] for c in ("doc_id", "text")), strict=True):
        fps[simhash.fingerprint(t)].append(i)
    want = brute_components(fps)
    assert len(got) == len(docs_of())
    for r in got.itertuples():
        assert r.component_id == want[int(r.fingerprint, 16)] and r.doc_id in fps[int(r.fingerprint, 16)]


@pytest.mark.parametrize("hot", [2, 10_000])
def test_links_are_whole_with_and_without_finer_keys(spark, hot):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**64, 3, dtype=np.uint64)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            fps.add(b ^ sum(1 << int(x) for x in bits))
    signed = [x - (x >> 63 << 64) for x in fps]
    got = sorted(tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect())
    want = sorted(tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert got == want


def test_op1_odd_rows(spark):
    got = simhash.near_duplicates(documents(spark, ODD)).toPandas()
    assert len(got) == len(ODD)
    empty = got[got.fingerprint == "0" * 16]
    assert len(empty) == 3 and set(empty.component_id) == {2}
    assert set(got[got.doc_id.isna()].component_id) == {1}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# --- op2 ----------------------------------------------------------------


def test_op2_holds_out_a_fold_and_scores_it_well(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, sf).toPandas()
    assert len(got) == len(docs_of(sf)) and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [fold(i, 4) == 2 for i in got.doc_id]).all()
    both = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.9


def test_op2_never_sees_labels_of_the_fold_it_holds_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = quality.fold("doc_id", 4)
    other = labels.withColumn("quality", F.when(own == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    models = [quality.fit_quality(docs, x.where(own != 2)) for x in (labels, other)]
    rows = [quality.score_quality(docs, m).orderBy("doc_id").collect() for m in models]
    assert rows[0] == rows[1] and labels.where(own == 2).count() > 0
    assert rows[0] == [tuple(r[c] for c in ("doc_id", "score", "predicted")) for r in queries.op2_quality(spark, SF).orderBy("doc_id").collect()]


def test_op2_scores_are_sums_over_the_tables(spark):
    docs = docs_of()
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = dict(quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), model).select("doc_id", "score").collect())
    bin_of = lambda edges, x: sum(e <= x for e in edges)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        x = quality.features(text)
        z = model.intercept + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        z += sum(t[bin_of(model.pair_edges[a], x[a]), bin_of(model.pair_edges[b], x[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-40, min(40, z)))), rel_tol=1e-9)
    assert len(model.pairs) and len(model.tables) == len(quality.FEATURES)


def test_op2_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (99, 0), (6, 0), (5, 0)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model, keep_columns=True)
    assert got.columns == [*docs.columns, "score", "predicted"]
    assert got.select("doc_id", "predicted").count() == len(ODD)
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs, labels.limit(0))).count() == 0


# --- op3 ----------------------------------------------------------------


def test_op3_writes_and_reads_back(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (5, "u5", None), (6, None, ""), (7, "u 7\n", "é" * 70000), (8, "u8", "same"), (8, "u8", "same"), (None, "n", "same"), (None, "m", "alone"), (None, "m", "alone")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    index = warc.write_warc(pages, warc.archive(spark))
    got = warc.read_warc(index).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        payload = None if r.payload is None else bytes(r.payload)
        if r.record_type == "response":
            assert len(payload) == r.payload_bytes and warc.digest(payload) == r.payload_digest
    same = got[got.payload_digest == warc.digest(b"same")]
    assert sorted(same[same.record_type == "response"].page_id) == [8, 8]
    assert set(same[same.record_type == "revisit"].refers_to) == {8} and len(same) == 5
    empty = got[got.payload_bytes == 0].sort_values("page_id")
    assert empty.record_type.tolist() == ["revisit", "response"]
    assert set(got[got.payload_digest == warc.digest(b"alone")].record_type) == {"response"}
    some = warc.read_warc(index.where("page_id = 7")).toPandas()
    assert some.payload_bytes.tolist() == [140000]
    assert warc.read_warc(warc.write_warc(pages.limit(0), warc.archive(spark))).count() == 0


def test_op3_equals_brute_force(spark):
    got = queries.op3_warc(spark, SF).toPandas().sort_values("page_id")
    pages = pd.read_parquet(f"{SF}/pages.parquet").sort_values("page_id")
    top = pages.groupby("html").page_id.max()
    assert got.page_id.tolist() == pages.page_id.tolist()
    assert got.payload_digest.tolist() == [warc.digest(h.encode()) for h in pages.html]
    assert got.payload_bytes.tolist() == [len(h.encode()) for h in pages.html]
    assert got.record_type.tolist() == ["response" if top[h] == i else "revisit" for i, h in zip(pages.page_id, pages.html, strict=True)]


# --- op4 ----------------------------------------------------------------


def test_op4_equals_the_library(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op4_token_counts(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(*(docs_of()[c] for c in ("doc_id", "text")), strict=True):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert tuple(got.loc[i]) == (len(t.encode()), n, n > 2048)


def test_op4_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.token_counts(documents(spark, ODD), path, 2048).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id == 2].n_tokens.tolist() == [0] and got[got.doc_id == 5].over_limit.tolist() == [True]
    assert token_counts.token_counts(documents(spark, []), path, 2048).count() == 0


# --- op5 ----------------------------------------------------------------


def brute_top(rows, asked, k):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q in asked:
            scored = sorted((-int(a @ b), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("block", "bins"), [(1024, 1024), (3, 4)])
def test_op5_equals_brute_force(spark, block, bins):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3)
    got = topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, block=block, bins=bins)
    want = brute_top(list(zip(table.vec_id, table.embedding, strict=True)), {i for i in table.vec_id if i % 50 == 0}, 5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def test_op5_ties_bad_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(1, 40)] + [(0, [1.0, 1.0]), (50, [-1.0, 0.5]), (51, None), (52, [nan, 1.0]), (100, [inf, 1.0]), (53, [None, 1.0]), (150, [2.0, 2.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = topk.exact_top_k(table, table.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, {0, 50, 150}, 5)
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (None, None), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (3, [0.5, 0.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<float>")
    got = topk.exact_top_k(odd, odd.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == [(0, 1, None, 65536), (0, 2, 3, 32768), (0, 3, 3, 32768)]  # the least vector of id 0 asks, and both rows of it are its own
    few = table.where("vec_id in (0, 50)")
    assert sorted(map(tuple, topk.exact_top_k(few, few, 5).collect())) == [(0, 1, 50, -32768), (50, 1, 0, -32768)]
    assert topk.exact_top_k(table.limit(0), table.limit(0)).count() == 0


# --- op6 ----------------------------------------------------------------


def test_op6_round_trips_and_is_the_same_however_it_is_dealt(spark):
    docs, path = spark.read.parquet(f"{SF}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")
    got = segmentation.sample_segmentations(docs, path, 3).toPandas()
    assert got.round_trip.all() and len(got) == 3 * docs.count()
    assert got.groupby("doc_id").ids.apply(lambda x: len(set(map(tuple, x)))).eq(3).all()
    again = segmentation.sample_segmentations(docs.repartition(7), path, 3).toPandas()
    key = lambda d: sorted((r.doc_id, r.sample, tuple(r.ids)) for r in d.itertuples())
    assert key(got) == key(again)


def test_op6_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = segmentation.sample_segmentations(documents(spark, ODD), path, 2).toPandas()
    assert got.round_trip.all() and len(got[got.doc_id == 2]) == 1 and len(got[got.doc_id.isna()]) == 2
    assert segmentation.sample_segmentations(documents(spark, []), path, 2).count() == 0


# --- op7 ----------------------------------------------------------------


def brute_lm(rows, held_out):
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(rows)}
    learn = {k for k, (i, _) in enumerate(rows) if not held_out(i)}
    one, two = Counter(), Counter()
    for k in learn:
        one.update(tokens[k])
        two.update(zip([None, *tokens[k][:-1]], tokens[k], strict=True))
    return tokens, one, two, sum(one.values()), len(one)


def test_op7_counts_and_base_equal_brute_force(spark):
    got = queries.op7_language_model(spark, SF).toPandas().set_index("doc_id")
    table = docs_of()
    rows = list(zip(table.doc_id, table.text, strict=True))
    tokens, one, _, n, v = brute_lm(rows, lambda i: fold(i, 5) == 1)
    for k, (i, _) in enumerate(rows):
        r = got.loc[i]
        assert r.held_out == (fold(i, 5) == 1) and r.n_tokens == len(tokens[k]) and r.train_tokens == n
        assert r.n_known == sum(one[t] > 0 for t in tokens[k])
        assert math.isclose(r.base_score, sum(math.log10((one[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[k]), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def brute_weights(tokens, learn, part):
    """Expectation-maximisation over each held-out token under the counts of the other parts, unrounded."""
    found = defaultdict(list)
    words = {t for k in learn for t in tokens[k]}
    for p in {part[k] for k in learn}:
        one, two = Counter(), Counter()
        for k in learn:
            if part[k] != p:
                one.update(tokens[k])
                two.update(zip([None, *tokens[k][:-1]], tokens[k], strict=True))
        rest = sum(one.values())
        for k in learn:
            if part[k] == p:
                for c, t in zip([None, *tokens[k][:-1]], tokens[k], strict=True):
                    found[0 if not one[c] else 1 + int(math.log2(one[c]))].append((two[c, t] / one[c] if one[c] else 0.0, one[t] / rest if rest else 0.0, 1 / (len(words) + 1)))
    weights, table = {}, {level: np.array(rows) for level, rows in found.items()}
    for level, rows in found.items():
        w, p = np.array([0.0, 0.5, 0.5] if level == 0 else [1 / 3] * 3), np.array(rows)
        for _ in range(lm_scoring.ROUNDS):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
            w[2] = max(w[2], lm_scoring.LEAST)
            w /= w.sum()
        weights[level] = w
    return weights, table


@pytest.mark.parametrize("many", [2, 4096])
def test_op7_scores_equal_the_mixture_of_brute_force_counts(spark, monkeypatch, many):
    rng = np.random.default_rng(3)
    rows = [(1, "a b a b c"), (2, "a b c"), (3, "A\tb d"), (4, None), (5, "b c a z"), (None, "a b"), (2, "a b c")]
    rows += [(k, " ".join(rng.choice(list("abcdefgh"), 30, p=np.arange(8, 0, -1) / 36))) for k in range(10, 60)]
    seen = {}
    learn = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    docs = documents(spark, rows)
    got = lm_scoring.interpolated_scores(docs, F.col("doc_id").isin(5, 12), many=many).toPandas()
    tokens, one, two, n, v = brute_lm(rows, lambda i: i in (5, 12))
    parts = dict(docs.select(F.coalesce("text", F.lit("")), F.pmod(F.xxhash64(F.lit("part"), F.coalesce("text", F.lit(""))), F.lit(lm_scoring.PARTS))).collect())
    exact, table = brute_weights(tokens, [k for k, r in enumerate(rows) if r[0] not in (5, 12)], [parts[t or ""] for _, t in rows])
    for level, w in exact.items():  # what the steps cost in held-out likelihood (words are drawn at random here, so it's flat in the weights)
        assert np.log(table[level] @ seen["w"][level]).mean() > np.log(table[level] @ w).mean() - 1e-3
    want = []
    for k in range(len(rows)):
        s = 0.0
        for c, t in zip([None, *tokens[k][:-1]], tokens[k], strict=True):
            w = seen["w"][0 if not one[c] else 1 + int(math.log2(one[c]))]
            s += math.log10((w[0] * two[c, t] / one[c] if one[c] else 0.0) + w[1] * one[t] / n + w[2] / (v + 1))
        want.append(s)
    assert np.allclose(sorted(got.score), sorted(want)) and len(got) == len(rows) and set(got.train_tokens) == {n}


def test_op7_odd_tables(spark):
    assert lm_scoring.interpolated_scores(documents(spark, []), F.col("doc_id") == 1).count() == 0
    none = lm_scoring.interpolated_scores(documents(spark, [(1, "x y"), (1, None)]), F.lit(True)).toPandas()
    assert none.train_tokens.tolist() == [0, 0] and np.isfinite(none.score).all() and np.isfinite(none.base_score).all()
    assert len(lm_scoring.interpolated_scores(documents(spark, ODD), F.lit(None).cast("boolean")).collect()) == len(ODD)


# --- op8 ----------------------------------------------------------------


def test_op8_equals_brute_force(spark):
    got = queries.op8_exact_dedup(spark, SF).toPandas().set_index("doc_id")
    table = docs_of()
    top, size = table.groupby("text").doc_id.max(), table.groupby("text").size()
    for i, t in zip(table.doc_id, table.text, strict=True):
        assert tuple(got.loc[i][["keep_id", "group_size", "kept", "text_sha256"]]) == (top[t], size[t], top[t] == i, hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_op8_odd_rows(spark, bits):
    got = exact_dedup.exact_dedup(documents(spark, ODD), carry=["text"], head=2, filter_bits=bits)
    rows = got.toPandas()
    assert len(rows) == len(ODD)
    empty = rows[rows.text.fillna("") == ""]
    assert set(empty.keep_id) == {3} and set(empty.group_size) == {3} and empty.kept.sum() == 1
    hashed = exact_dedup.exact_dedup(documents(spark, ODD).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), head=2, full_hash="sha", filter_bits=bits)
    order = lambda x: sorted(map(str, x))
    assert order(hashed.collect()) == order(got.drop("text").collect())
    same = rows[rows.text == "a b c d e f"]
    assert set(same.keep_id) == {4} and same[same.kept].doc_id.tolist() == [4] and len(same) == 3
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    nulls = exact_dedup.exact_dedup(documents(spark, [(None, "q"), (None, "q")])).toPandas()
    assert nulls.kept.sum() == 1 and nulls.group_size.tolist() == [2, 2]


# --- op9 ----------------------------------------------------------------


def brute_passages(rows):
    """By plain loops over all places, the order being null ids first, then id, then (for equal ids) the text's hash as the operator has it; ids here are distinct."""
    places = defaultdict(list)
    for i, t in rows:
        lines = t.split("\n")
        for a, line in enumerate(lines):
            if a + 1 < len(lines):
                places[tuple(lines[a : a + 2])].append((i, a))
            if len(line.split()) > 50:
                places[(line,)].append((i, a))
    gone = defaultdict(set)
    for unit, at in places.items():
        i0, a0 = min(at)
        for i, a in at:
            if i != i0 or a >= a0 + len(unit):
                gone[i].update(range(a, a + len(unit)))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_op9_passages_equal_brute_force(spark, bits):
    table = docs_of()
    rows = list(zip(table.doc_id.tolist(), table.text, strict=True))
    got = line_dedup.line_dedup(spark.read.parquet(f"{SF}/documents.parquet"), filter_bits=bits).toPandas()
    assert dict(zip(got.doc_id, got.text, strict=True)) == brute_passages(rows)
    assert (got.removed_lines == got.n_lines - [0 if r.removed_lines == r.n_lines else r.text.count("\n") + 1 for r in got.itertuples()]).all()
    query = queries.op9_line_dedup(spark, SF).toPandas()
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute_passages(rows).items()}
    assert dict(zip(query.doc_id, query.text_sha256, strict=True)) == want


def test_op9_removes_planted_passages_whole(spark):
    rows, want = [], {}
    for n in range(2, 7):
        passage = [f"planted {n} {k} " + "word " * (60 // n) for k in range(n)]
        for before in range(6):
            own = [f"own {n} {before} {k}" for k in range(before + 4)]
            rows.append((len(rows) + 1, "\n".join(own[:before] + passage + own[before:])))
            want[len(rows)] = "\n".join(own) if before else rows[-1][1]
    long = "many " * 51
    rows += [(1001, f"a\n{long}\nb"), (1002, f"c\n{long}\nd"), (1003, "x\nx\nx\nx\nx")]
    want |= {1001: f"a\n{long}\nb", 1002: "c\nd", 1003: "x\nx"}
    got = line_dedup.line_dedup(documents(spark, rows)).toPandas()
    assert dict(zip(got.doc_id, got.text, strict=True)) == want


@pytest.mark.parametrize("clash", [False, True])
def test_op9_joins_chunks_without_their_bytes_and_tells_those_that_clash(spark, monkeypatch, clash):
    rng = np.random.default_rng(9)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 99, 8)) for _ in range(12)]
    docs = documents(spark, [(k, "\n".join(pool[x] for x in rng.integers(0, 12, int(rng.integers(1, 6))))) for k in range(60)])
    columns = ["doc_id", "text", "n_lines", "removed_chunks", "removed_lines"]
    want = sorted(map(tuple, line_dedup.line_dedup(docs).select(columns).collect()))
    wide, chunks = [], line_dedup.chunks
    if clash:
        monkeypatch.setattr(line_dedup, "digest", lambda unit: F.lit(0).cast("long"))
        monkeypatch.setattr(line_dedup, "chunks", lambda *a: ((at, size, key % 5) for at, size, key in chunks(*a)))
    monkeypatch.setattr(line_dedup, "written", lambda df, name: wide.append((name, df.columns)) or common.written(df, name))
    assert sorted(map(tuple, line_dedup.line_dedup(docs).select(columns).collect())) == want and sum(r[4] for r in want) > 20
    if not clash:
        assert [name for name, held in wide if "unit" in held] == ["line-chunks"]


def test_op9_passages_of_odd_rows(spark):
    got = line_dedup.line_dedup(documents(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id == 6].text.tolist() == ["line\nline\n"] and got[got.doc_id == 4].n_lines.tolist() == [1]
    assert got[got.doc_id == 7].removed_lines.max() >= 19
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


# --- op10 ---------------------------------------------------------------


def test_op10_meets_its_targets(spark):
    got = queries.op10_mixing(spark, "/root/testdata/sf0.01").toPandas()
    p = got[[f"p_{d}" for d in queries.WEIGHTS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (got.rate >= 0).all()
    totals = (p * (got.n_tokens * got.rate).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(totals / got.n_tokens.sum(), list(queries.WEIGHTS.values()), atol=0.005)
    assert ((got.copies == np.floor(got.rate)) | (got.copies == np.floor(got.rate) + 1)).all()


def test_op10_tells_clean_documents_from_others(spark):
    # 399 labels are few for three classes: junk and toxic documents are often taken for each other, clean ones are not
    sf = "/root/testdata/sf0.01"
    got = queries.op10_mixing(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    clean = (got.quality == 1) & (got.toxic == 0)
    assert (got[clean].p_clean > 0.5).mean() > 0.99 and (got[~clean].p_clean < 0.5).mean() > 0.75
    assert ((got.p_toxic > 0.5) == (got.toxic == 1)).mean() > 0.92


def test_op10_odd_rows(spark):
    docs = documents(spark, ODD)
    labelled = spark.createDataFrame([(1, "clean"), (1, "toxic"), (5, "junk"), (None, "clean"), (6, "other"), (6, None)], "doc_id long, domain string")
    for table in (labelled, labelled.limit(0)):
        got = mixing.mix(docs, table, queries.WEIGHTS, ["doc_id", "kept"]).toPandas()
        assert len(got) == len(ODD) and got.rate.notna().all() and (got.rate >= 0).all()
        assert got[got.doc_id == 2].n_tokens.tolist() == [0]
    assert mixing.mix(docs.limit(0), labelled, queries.WEIGHTS, ["doc_id"]).count() == 0


def brute_posteriors(docs, labels, weights):
    """The formulas of the docstrings by plain loops."""
    marks, capitals = "!#$%&*|@^~", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    half_up = lambda x: math.floor(x + 0.5)

    def held(text):
        words = [w for w in re.split("[ \t-\r.,]+", text.lower()) if w]
        share = lambda own: sum(c in own for c in text) / max(1, len(text))
        shape = [f" marks {half_up(math.sqrt(share(marks)) * 20)}", f" capitals {half_up(math.sqrt(share(capitals)) * 10)}", f" distinct {half_up(len(set(words)) / max(1, len(words)) * 10)}"]
        return {*words, *shape}

    texts = {i: held(t) for i, t in docs}
    each = {(labels[i], frozenset(texts[i])) for i in labels if i in texts}
    n = {d: sum(x == d for x, _ in each) for d in weights}
    total = sum(n.values())
    counts = defaultdict(Counter)
    for d, words in each:
        for w in words:
            counts[w][d] += 1
    nats = lambda part, whole, given: part * math.log(part * total / (whole * given)) if part else 0.0
    table = {}
    for w, c in counts.items():
        there = sum(c.values())
        tells = sum(nats(c[d], there, n[d]) + nats(n[d] - c[d], total - there, n[d]) for d in weights)
        if tells >= mixing.LEAST:
            table[w] = {}
            for d in weights:
                usual = (there + 0.5) / (total + 1)
                p = (c[d] + mixing.PRIOR * usual) / (n[d] + mixing.PRIOR)
                table[w][d] = (math.log(p / usual), math.log((1 - min(p, 0.999)) / (1 - min(usual, 0.999))) if p >= mixing.MARKER * usual else 0.0)
    out = {}
    for i, words in texts.items():
        z = {d: math.log((n[d] + 1) / (total + len(weights))) + sum(lift[d][w not in words] for w, lift in table.items()) for d in weights}
        e = {d: math.exp(x - max(z.values())) for d, x in z.items()}
        out[i] = [e[d] / sum(e.values()) for d in weights]
    return out, len(table)


def test_op10_posteriors_and_rates_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = docs_of(sf), pd.read_parquet(f"{sf}/labels.parquet")
    domain = {r.doc_id: "toxic" if r.toxic == 1 else "junk" if r.quality == 0 else "clean" for r in labels.itertuples()}
    want, words = brute_posteriors(list(zip(docs.doc_id, docs.text, strict=True)), domain, list(queries.WEIGHTS))
    got = queries.op10_mixing(spark, sf).toPandas()
    assert words < mixing.LEXICON
    p = got[[f"p_{d}" for d in queries.WEIGHTS]].to_numpy()
    assert np.allclose(p, np.array([want[i] for i in got.doc_id]), atol=1e-6)
    mass = p * got.n_tokens.to_numpy()[:, None]
    target = got.n_tokens.sum() * np.array(list(queries.WEIGHTS.values()))
    scale = np.maximum(mass.sum(axis=0), 1e-6 * got.n_tokens.sum())
    gram, rate = (mass / np.sqrt(scale)).T @ (p / np.sqrt(scale)), np.ones(len(got))
    step = 1 / np.abs(gram).sum(axis=1).max()
    for _ in range(20_000):  # plain projected gradient until it rests
        rate = np.maximum(0, rate - step * (p @ ((mass.T @ rate - target) / scale)))
    loss = lambda r: float(((mass.T @ r - target) ** 2 / scale).sum())
    assert loss(got.rate.to_numpy()) <= loss(rate) + 1e-4 * got.n_tokens.sum()


def test_op10_says_what_it_can_not_reach_and_keeps_what_it_is_told_to(spark):
    rows = [(k, 10, 0.9, 0.1) for k in range(20)] + [(k, 10, 0.2, 0.8) for k in range(20, 30)]
    soft = spark.createDataFrame(rows, "id long, n_tokens long, q0 double, q1 double")
    met = mixing.fit_rates(soft, [0.5, 0.5]).toPandas()
    assert met.unmet.max() < 1e-3
    missed = mixing.fit_rates(soft, [0.95, 0.05]).toPandas()
    assert 0.02 < missed.unmet.min() == missed.unmet.max()
    kept = mixing.fit_rates(soft, [0.85, 0.15], anchor=0, most=1.0, keep=0).toPandas()
    assert (kept.rate[kept.q0 > 0.5] == 1).all() and (kept.rate[kept.q0 < 0.5] < 1).all()
    none = mixing.fit_rates(soft.limit(0), [0.5, 0.5])
    assert none.count() == 0 and "unmet" in none.columns


def test_op10_plan_has_no_python(spark):
    plan = queries.op10_mixing(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- pipeline -----------------------------------------------------------


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    before = docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.written(stage(spark, docs, sf), f"test-{name}")
        now = out.toPandas()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and set(now.doc_id) <= set(before.doc_id)
        if name == "quality":
            clean = labels[(labels.quality == 1)].doc_id
            assert clean.isin(now.doc_id).mean() > 0.93 and labels[labels.quality == 0].doc_id.isin(now.doc_id).mean() < 0.15
        if name == "exact_dedup":
            assert sorted(now.doc_id) == sorted(before.groupby("text").doc_id.max())
        if name == "near_dedup":
            assert sorted(now.doc_id) == sorted(set(brute_near(list(zip(before.doc_id, before.text, strict=True))).values()))
        if name == "mixing":
            there = labels[labels.doc_id.isin(before.doc_id)]
            assert there[(there.quality == 1) & (there.toxic == 0)].doc_id.isin(now.doc_id).all()
            labelled = mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
            mixed = mixing.mix(docs, labelled, corpus_pipeline.WEIGHTS, ["doc_id"], anchor="clean", most=1.0, keep="clean").toPandas()
            assert set(mixed[mixed.copies > 0].doc_id) == set(now.doc_id)
            totals = {d: (mixed[f"p_{d}"] * mixed.n_tokens * mixed.rate).sum() for d in corpus_pipeline.WEIGHTS}
            for d, share in corpus_pipeline.WEIGHTS.items():  # the expected mix
                assert abs(totals[d] / sum(totals.values()) - share) < 0.01
        if name == "segmentation":
            assert now.round_trip.all() and set(now.doc_id) == set(before.doc_id)
        docs, before = out, now


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


CLASHING = "doc_id long, text string, kept boolean, score double, predicted int, `_mix_key` string, rest string, component_id long, `copies` int, `a.b` int, rate double, keep_id long"


def test_pipeline_stages_take_any_columns_and_odd_rows(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(None, "only null id " * 9), (None, None), (7, " ".join(words)), (7, "another text of the same id"), (8, " ".join([*words, "more"])), (9, ""), (9, ""), (10, "long " * 30_000), (11, " ".join(words)), (11, " ".join(words)), (None, "other null id")]
    docs = spark.createDataFrame([(*r, True, 1.0, 1, "x", "y", 2, 3, 4, 0.5, 6) for r in rows], CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
        left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if name == "exact_dedup":
            assert left == sorted({(i, t) for i, t in rows if t is not None and (i, t) != (7, " ".join(words))}, key=str)
        if name == "near_dedup":
            assert left == sorted([(None, rows[0][1]), (7, rows[2][1]), rows[3], (9, ""), rows[7], rows[10]], key=str)
        if name == "mixing":
            assert len(left) >= 5
    last = corpus_pipeline.segment(spark, docs, SF).toPandas()
    assert len(last[last.doc_id.isna()]) >= 3 and last.round_trip.all() and len(last[last.doc_id == 9]) == 2


def brute_near(rows, least=0.8):
    sets = [set(simhash.shingles(t or "").tolist()) for _, t in rows]
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b) and of[i] != of[j]:
                of = [of[j] if x == of[i] else x for x in of]
    first = {}
    for (i, _), c in zip(rows, of, strict=True):
        first[c] = min(first.get(c, math.inf), i)
    return {i: first[c] for (i, _), c in zip(rows, of, strict=True)}


def test_pipeline_near_copies_equal_brute_force_jaccard(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["text"])
    docs = common.written(docs, "test-distinct")
    table = docs.select("doc_id", "text").toPandas()
    want = brute_near(list(zip(table.doc_id.tolist(), table.text, strict=True)))
    left = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.select("doc_id").collect()) == sorted(set(want.values())) and len(set(want.values())) < len(want)


@pytest.mark.parametrize("hot", [2, 64])
def test_near_copies_are_whole_in_large_groups(spark, hot):
    rng = np.random.default_rng(5)
    rows = []
    for base in range(3):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(30):
            own = list(words)
            for at in rng.integers(0, 120, int(rng.integers(0, 4))):
                own[at] = f"x{rng.integers(10**6)}"
            words = own if rng.random() < 0.3 else words  # the group drifts: its ends are linked by its middle only
            rows.append((len(rows) + 1, " ".join(own)))
    got = simhash.similar_copies(documents(spark, rows), hot=hot).toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == brute_near(rows)


def test_near_copies_odd_rows(spark):
    got = simhash.similar_copies(documents(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and set(got[got.doc_id.isin([2, 3])].component_id) == {2} and set(got[got.doc_id.isna()].component_id) == {1}
    assert simhash.similar_copies(documents(spark, [])).count() == 0


def test_near_copies_come_from_simhash_segments():
    text = " ".join(f"w{k}" for k in range(40))
    sets = [simhash.shingles(t) for t in (text, text.replace("w39", "x"), " ".join(f"z{k}" for k in range(40)))]
    fps = [simhash.wide_fingerprint(x) for x in sets]
    with np.errstate(over="ignore"):
        for x, fp in zip(sets, fps, strict=True):  # by single bits
            for w in range(len(fp)):
                votes = [0] * 64
                for s in x:
                    h = (s ^ simhash._PLUS[w]) * simhash._TIMES[w]
                    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
                    votes = [v + (int(h) >> k & 1) for k, v in enumerate(votes)]
                assert int(fp[w]) == sum((2 * v > len(x)) << k for k, v in enumerate(votes))
    keys = [set(simhash.segments(fp)[0].tolist()) for fp in fps]
    assert keys[0] & keys[1] and len(keys[0]) == simhash.SEGMENTS
    rows = sorted((k, node) for node, own in enumerate(keys) for k in own)
    key, node = (np.array(x) for x in zip(*rows, strict=True))
    bits = [np.array([simhash.segments(fp)[1][w] for fp in fps])[node] for w in range(simhash.WORDS)]
    for hot in (1, 100):
        found = simhash._Forest()
        simhash.near_in_buckets(key, node, np.array([len(x) for x in sets])[node], bits, 0.8, hot, found)
        assert [x.tolist() for x in found.rest()] == [[1], [0]]
    most = simhash.bits_apart(0.8, 64 * simhash.WORDS)
    for apart in (most, most + 1):  # of signed words too
        bits = [np.array([-1, -1 ^ ((1 << min(apart, 60)) - 1)]), np.array([0, (1 << max(0, apart - 60)) - 1]), np.array([5, 5])]
        found = simhash._Forest()
        simhash.near_in_buckets(np.array([7, 7]), np.array([0, 1]), np.array([9, 9]), bits, 0.8, 100, found)
        assert len(found.rest()[0]) == (apart <= most)


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base, rows, sizes = rng.integers(0, 10**6, 100), [], {}
    for k in range(600):  # each near the base or a little farther, many pairs of them just short of 0.8
        own = [f"w{x}" for x in base]
        for at in rng.integers(0, 100, int(rng.integers(1, 5))):
            own[at] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(own)))

    def counted(df, name):
        out = common.written(df, name)
        if {"a", "b"} <= set(out.columns):
            sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    got = simhash.similar_copies(documents(spark, rows), hot=64).toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == brute_near(rows)
    assert sizes and max(sizes.values()) < 10 * len(rows)  # 179,700 pairs


@pytest.mark.parametrize("n", [300, 900])
def test_links_of_a_large_group_grow_with_its_size(spark, monkeypatch, n):
    rng = np.random.default_rng(8)
    base, rows, sizes, write = rng.integers(0, 10**6, 100), [], {}, common.written
    for k in range(n):  # those with one other word are one component, most others of the family are alone
        own = [f"w{x}" for x in base]
        for at in rng.integers(0, 100, 1 if k % 10 else 4):
            own[at] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(own)))

    def counted(df, name):
        out = write(df, name)
        if {"a", "b"} <= set(out.columns):
            sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(common, "written", counted)
    got = simhash.similar_copies(documents(spark, rows), hot=16).toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == brute_near(rows)
    edges = {name: x for name, x in sizes.items() if name.startswith(("near-families", "near-components"))}  # what rounds join
    assert len(edges) >= 2 and max(edges.values()) < n
    assert sizes["near-links"] < 2 * n


def test_known_components_are_passed_over():
    sets = [simhash.shingles(" ".join(f"w{k}" for k in range(60 + x))) for x in range(4)]
    block, alone = np.zeros(4, dtype=int), np.arange(4)
    assert len(simhash.near_in_sets([5, 6, 7, 8], sets, block, alone, 0.8)) == 3
    assert simhash.near_in_sets([5, 6, 7, 8], sets, block, np.array([5, 5, 5, 5]), 0.8) == []
    link, = simhash.near_in_sets([5, 6, 7, 8], sets, np.array([0, 0, 1, 1]), np.array([5, 5, 7, 7]), 0.8)
    assert link[0] in (5, 6) and link[1] in (7, 8)


def test_edges_of_many_tasks_are_reduced_to_a_forest(spark, monkeypatch):
    edges = spark.range(4000).select((F.col("id") % 500 + 1).alias("a"), (F.col("id") % 7 % (F.col("id") % 500 + 1)).alias("b")).repartition(8)
    edges = common.written(edges, "test-edges")
    assert simhash._reduced(edges).count() == 500
    assert simhash._reduced(edges.limit(0)).count() == 0
    monkeypatch.setattr(simhash, "MOST_EDGES", 600)
    got = {r[0]: r[1] for r in common.components(simhash._reduced(edges)).collect()}
    assert got == dict.fromkeys(range(501), 0)
