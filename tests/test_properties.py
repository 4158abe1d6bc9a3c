"""Properties that hold for any input, checked against brute force on small fixtures."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askframe.cluster import spread, stored, with_row_index, with_running_total
from askframe.fixed_values import STOP_WORDS
from askframe.functions import text as tx
from askframe.operators import blend, blocks, clusters, dense, inverted, layout, questions, scoring, selection, sparse, status
from askframe.operators.inverted import build_index
from askframe.sources.corpus import ids_per_file, scan_corpus

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa it's a/b x.y".split()


def random_texts(n, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(n)]
    # A third of the corpus is one text, so ties and hot groups are normal.
    return [texts[0] if i % 3 == 0 else t for i, t in enumerate(texts)]


def brute_terms(text):
    tokens = re.findall(r"\b[\w/.-]+\b|!|/|\?|\"|'", text.lower())
    tokens = [t for t in tokens if t not in set(STOP_WORDS)]
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def brute_tfidf(queries, docs, k, n=None):
    q = [Counter(brute_terms(t)) for t in queries]
    vocab = set().union(*q)
    n = len(docs) if n is None else n
    d = [Counter(x for x in brute_terms(t) if x in vocab) for t in docs]
    fit = d
    idf = {t: math.log((1 + n) / (1 + sum(t in x for x in fit))) + 1 for t in vocab}

    def unit(c):
        w = {t: n * idf[t] for t, n in c.items()}
        length = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / length for t, v in w.items()}

    qv, dv = [unit(c) for c in q], [unit(c) for c in d]
    out = []
    for i, a in enumerate(qv):
        scores = [(j, round(sum(w * b.get(t, 0) for t, w in a.items()), 9)) for j, b in enumerate(dv) if a.keys() & b.keys()]
        best = sorted(scores, key=lambda s: (-s[1], s[0]))[:k]
        out += [(i, r + 1, j, round(s, 6)) for r, (j, s) in enumerate(best)]
    return out


def frame(spark, texts, key):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")


@pytest.fixture(scope="module")
def texts():
    return random_texts(12, 1), random_texts(90, 2)


@pytest.mark.parametrize("block_terms", [500_000, 60])
def test_tfidf_equals_brute_force(spark, texts, block_terms):
    queries, docs = texts
    got = sparse.tfidf_topk(frame(spark, queries, "query_id"), frame(spark, docs, "doc_id"), 7, block_terms)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(brute_tfidf(queries, docs, 7))


def test_a_stored_index_serves_several_query_sets(spark, texts):
    queries, docs = texts
    odd = spark.createDataFrame([(None, docs[0]), (900, None), (901, "")], "doc_id long, text string")
    corpus = frame(spark, docs, "doc_id").union(odd).repartition(3)
    index = stored(build_index(corpus), "index")
    n = len(docs) + 2
    for some in (queries[:5], queries[5:], []):
        asked = frame(spark, some, "query_id").union(spark.createDataFrame([(None, docs[1]), (77, None)], "query_id long, text string"))
        rows = sorted(tuple(r) for r in sparse.tfidf_topk(asked, corpus, 7, index=index).collect())
        assert rows == sorted(brute_tfidf(some, docs, 7, n))
    assert sparse.tfidf_topk(frame(spark, queries, "query_id"), corpus.filter("false")).count() == 0


def test_block_maxima_skip_scores_and_lose_no_hit():
    rng = np.random.default_rng(6)
    n_docs, n_terms, k = 1024, 60, 3
    # Documents of a block share a topic, so most blocks cannot reach the best.
    topic = np.arange(n_docs) // 128
    rows = [np.unique(np.r_[rng.integers(0, 6, 4) + 6 * t, rng.integers(48, n_terms, 3)]) for t in topic]
    place = np.repeat(np.arange(n_docs), [len(r) for r in rows])
    term = np.concatenate(rows)
    order = np.lexsort((place, term))
    counts = rng.integers(1, 4, len(term))
    names = pa.array([f"t{i:03d}" for i in range(n_terms)])
    used, cut = np.unique(term[order], return_index=True)
    row = {
        "doc_ids": pa.array(np.arange(n_docs) + 5), "terms": names.take(pa.array(used)), "cut": pa.array(np.r_[cut, len(term)]),
        "places": pa.array(place[order]), "counts": pa.array(counts), "squares": pa.array(np.zeros(n_docs)),
    }
    weights = inverted.Weights(names, rng.random(n_terms) + 1)
    q = np.repeat(np.arange(8), 6)
    t = (6 * q + np.tile(np.arange(6), 8)) % 48
    asked = inverted.Questions(q, t, np.ones(48), np.full(48, 6.0), n_terms)
    best = inverted.Best(8, k)
    old, inverted.CHUNK = inverted.CHUNK, 200
    try:
        taken = inverted.search_row(inverted.Lists(row, weights), asked, best)
    finally:
        inverted.CHUNK = old
    x = np.zeros((n_docs, n_terms))
    x[place[order], term[order]] = counts * weights.idf[term[order]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.zeros((8, n_terms))
    y[q, t] = 1 / np.sqrt(6)
    full = np.round(y @ x.T, 9)
    want = [(i, int(d) + 5, full[i, d]) for i in range(8) for d in np.lexsort((np.arange(n_docs), -full[i]))[:k] if full[i, d] > 0]
    assert [(int(a), int(b), pytest.approx(c)) for a, b, c in zip(*best.hits)] == want
    assert taken < 0.6 * full.size


def test_tfidf_does_not_depend_on_partitions(spark, texts):
    queries, docs = texts
    results = []
    for n in (1, 8):
        q, d = frame(spark, queries, "query_id").repartition(n), frame(spark, docs, "doc_id").repartition(n)
        results.append(sorted(tuple(r) for r in sparse.tfidf_topk(q, d, 5).collect()))
    assert results[0] == results[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_shuffled_for_tfidf(spark, texts):
    queries, docs = texts
    plan = plan_of(build_index(frame(spark, docs, "doc_id")))
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_top_k_limits_groups_before_the_shuffle(spark):
    scored = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"), F.lit(1.0).alias("score"))
    plan = plan_of(sparse.top_k(scored, 2))
    assert "Partial" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("q_block, n_cells", [(4_096, 0), (6, 0), (4_096, 12), (7, 500)])
def test_vector_topk_equals_brute_force(spark, q_block, n_cells):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(300, 8)).astype(np.float32)
    d[::3] = d[0]
    d[7] = 0
    q = d[:20]
    corpus = spread(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, embedding array<float>"), "doc_id")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    got = dense.vector_topk(queries, corpus, 150, q_block, n_cells)
    scores = np.round(q.astype(float) @ d.astype(float).T, 9)
    want = []
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(d)), -scores[i]))[:150]
        want += [(i, r + 1, int(j), float(scores[i, j])) for r, j in enumerate(order)]
    rows = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got.collect())
    assert [r[:3] for r in rows] == [w[:3] for w in want]
    assert [r[3] for r in rows] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_cells_that_hold_no_hit_are_passed_over(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + 0.1 * rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(3)
    queries = corpus.filter("doc_id % 200 = 0").withColumnRenamed("doc_id", "query_id")
    hits = dense.vector_hits(queries, corpus, 5, n_cells=40)
    taken = hits.filter("doc_id is null").agg(F.sum("score")).first()[0]
    assert taken < 0.3 * 30 * 6000
    got = {(r.query_id, r["rank"]): r.doc_id for r in dense.vector_topk(queries, corpus, 5, n_cells=40).collect()}
    scores = np.round(x[::200] @ x.T, 9)
    assert got == {(200 * i, r + 1): int(j) for i in range(30) for r, j in enumerate(np.lexsort((np.arange(6000), -scores[i]))[:5])}
    assert dense.vector_topk(queries, corpus.filter("false"), 5, n_cells=3).count() == 0


def test_each_text_is_encoded_once(spark):
    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    vectors = corpus.select("doc_id", dense.embed(F.col("text")).alias("embedding"))
    plan = plan_of(dense.vector_topk(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 2))
    assert plan.count("ArrowEvalPython") == 1


def test_vector_topk_without_queries(spark):
    corpus = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert dense.vector_topk(queries, corpus, 3).count() == 0


def test_null_vectors_are_left_out(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(5, [1.0, 0.0]), (6, None)], "query_id long, embedding array<float>")
    assert [tuple(r) for r in dense.vector_topk(queries, corpus, 3).collect()] == [(5, 1, 1, 1.0)]


def test_pieces_rejoin(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    broken = docs.filter(F.array_join(tx.sentence_pieces(F.col("text")), "") != F.col("text"))
    assert broken.count() == 0


def test_spans_point_into_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", F.explode(tx.sentence_spans(F.col("text"))).alias("s"))
    wrong = docs.filter(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) != F.col("s.text"))
    assert wrong.count() == 0


def test_row_index_over_many_partitions(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("id")).repartition(13)
    rows = with_row_index(df, [F.col("id")], "i").collect()
    assert all(r.i == r.id for r in rows) and len(rows) == 1000


def test_shuffle_is_the_same_on_any_partitioning(spark):
    a = questions.seeded_shuffle(spark.range(200).repartition(1)).orderBy("position").collect()
    b = questions.seeded_shuffle(spark.range(200).repartition(8)).orderBy("position").collect()
    assert a == b and [r.id for r in a] != list(range(200))
    c = questions.seeded_shuffle(spark.range(200), seed=7).orderBy("position").collect()
    assert [r.id for r in a] != [r.id for r in c]


def test_softmax_sums_to_one(spark):
    rows = [(i, c, float(i * 300 + j)) for i in range(4) for j, c in enumerate("ABCDE")]
    df = spark.createDataFrame(rows, "id long, letter string, x double")
    sums = scoring.softmax_over_options(df, "x", ["id"]).groupBy("id").agg(F.sum("prob").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_id_lists_are_bounded_and_whole(spark):
    hits = spark.range(95).select(F.col("id"), F.when(F.col("id") < 60, "hot").otherwise("cold").alias("file"))
    lists = ids_per_file(hits, 10).collect()
    assert max(len(r.ids) for r in lists) <= 10
    assert sorted(i for r in lists for i in r.ids) == list(range(95))
    assert all(r.ids == sorted(r.ids) for r in lists)


def test_corpus_ids_stay_unique(spark):
    parts = [spark.range(n).select(F.col("id").alias("article_id"), F.lit(n).alias("text")) for n in (3, 0, 5)]
    assert sorted(r.article_id for r in scan_corpus(parts).collect()) == list(range(8))


def brute_map3(rows, answers, w):
    score = 0
    for i, a in answers.items():
        p = {c: math.floor(sum(x * rows[m, i, c] for m, x in enumerate(w)) * (1e9 / sum(w)) + 0.5) for c in "ABCDE"}
        ranked = sorted("ABCDE", key=lambda c: (-p[c], c))
        r = ranked.index(a) + 1
        score += 1 / r if r <= 3 else 0
    return score / len(answers)


def test_grid_scores_equal_brute_force(spark):
    rng = random.Random(5)
    rows = {(m, i, c): rng.choice([0.1, 0.2, 0.3, rng.random()]) for m in range(3) for i in range(9) for c in "ABCDE"}
    answers = {i: rng.choice("ABCDE") for i in range(9)}
    probs = spark.createDataFrame([(*k, v) for k, v in rows.items()], "model_id int, id long, letter string, prob double")
    right = spark.createDataFrame(list(answers.items()), "id long, answer string")
    grid = blend.grid_scores(probs, right, [0, 1, 2], 10).collect()
    assert len(grid) == math.comb(12, 2)
    for r in grid:
        assert r.map3 == pytest.approx(brute_map3(rows, answers, (r.w0, r.w1, r.w2)))
    best = max(r.map3 for r in grid)
    start = blend.top_weights(spark.createDataFrame(grid), 3, 3)
    refined = blend.refine_weights(probs, right, [0, 1, 2], start, 10, 4).collect()
    assert all(r.w0 + r.w1 + r.w2 == 40 and min(r.w0, r.w1, r.w2) >= 0 for r in refined)
    assert max(r.map3 for r in refined) >= best - 1e-12


def test_kmeans_clusters_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("emb"))
    got = clusters.kmeans(docs, 5).groupBy("cluster_id").count().collect()
    assert sum(r["count"] for r in got) == 500 and {r.cluster_id for r in got} <= set(range(5))
    flat = clusters.project_2d(docs)
    assert flat.count() == 500 and flat.columns == ["vec_id", "emb", "x", "y"]


def test_seed_vote_ties_go_to_the_smaller_cluster(spark):
    clustered = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "title string, cluster_id int")
    seeds = spark.createDataFrame([("a",), ("b",), (None,)], "title string")
    assert clusters.seed_cluster_vote(clustered, seeds).collect()[0].cluster_id == 1
    assert {r.title for r in clusters.drop_titles(clustered, seeds).collect()} == {"c"}


def test_one_finish_and_one_start_at_the_same_poll(spark):
    rows = [("2024-01-01 00:05:00", 1), ("2024-01-01 01:10:00", 1), ("2024-01-01 02:00:00", 2), ("2024-01-01 03:59:00", 1)]
    feed = spark.createDataFrame(rows, "ts string, ref int").withColumn("ts", F.to_timestamp("ts"))
    done = status.completed_transitions(status.pending_polls(feed)).collect()
    assert sorted((r.ref, str(r.completed_at)[11:13], r.elapsed_s) for r in done) == [(1, "02", 7200), (2, "03", 3600)]
    now = status.pending_now(status.pending_polls(feed)).collect()
    assert [(r.ref, r.elapsed_s) for r in now] == [(1, 3 * 3600)]


def test_numbers_and_totals_come_from_stored_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    numbered = with_row_index(df, [F.col("v").desc(), F.col("id")], "i")
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.id for r in sorted(numbered.collect(), key=lambda r: r.i)] == want
    assert "AttachDistributedSequence" not in plan_of(numbered)
    # What executors hold may go: the numbers are read again, not made again.
    spark.catalog.clearCache()
    assert [r.id for r in sorted(numbered.collect(), key=lambda r: r.i)] == want
    summed = with_running_total(df, [F.col("id")], F.col("v"), "s")
    assert [r.s for r in sorted(summed.collect(), key=lambda r: r.id)] == np.cumsum([v for _, v in rows]).tolist()
    assert with_row_index(df.filter("false"), [F.col("id")], "i").count() == 0


def test_nth_smallest_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(selection, "LEFT", 3)
    ids = spark.range(3000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h")).repartition(5)
    order = sorted((r.h, r.id) for r in ids.collect())
    for rank in (0, 1, 599, 1500, 2999):
        assert selection.nth_smallest(ids, selection.hash_key(F.col("h")), [F.col("h"), F.col("id")], rank) == order[rank]
    assert selection.nth_smallest(ids, selection.hash_key(F.col("h")), [F.col("h"), F.col("id")], 3000) is None
    # Many rows with one hash and few hashes in all.
    same = spark.range(100).select((F.col("id") % 2).alias("id"), F.md5((F.col("id") % 2).cast("string")).alias("h"))
    order = sorted((r.h, r.id) for r in same.collect())
    for rank in (0, 49, 50, 99):
        assert selection.nth_smallest(same, selection.hash_key(F.col("h")), [F.col("h"), F.col("id")], rank) == order[rank]


def random_probs(spark, n=30, models=3, seed=5):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(5) * 0.7, size=(n, models))
    answer = rng.integers(0, 5, n)
    rows = [(m, i, "ABCDE"[c], float(p[i, m, c])) for i in range(n) for m in range(models) for c in range(5)]
    probs = spark.createDataFrame(rows, "model_id int, id long, letter string, prob double").repartition(4)
    return probs, spark.createDataFrame([(i, "ABCDE"[a]) for i, a in enumerate(answer)], "id long, answer string"), p, answer


def map3_of(p, answer, w):
    blended = np.einsum("qmc,m->qc", p, np.asarray(w) / np.sum(w))
    rank = (blended > blended[np.arange(len(answer)), answer][:, None]).sum(axis=1)
    return np.where(rank < 3, 1 / (rank + 1), 0).mean()


def test_line_search_finds_the_best_of_a_fine_grid(spark):
    probs, answers, p, answer = random_probs(spark)
    start = [0.5, 0.3, 0.2]
    for axis in range(3):
        stretches = sorted((r.t_low, r.t_high, r.map3) for r in blend.line_scores(probs, answers, [0, 1, 2], start, axis).collect())
        assert stretches[0][0] == 0 and stretches[-1][1] == 1 and all(a[1] == b[0] for a, b in zip(stretches, stretches[1:]))
        at = lambda t: map3_of(p, answer, (1 - t) * np.array(start) + t * np.eye(3)[axis])
        for low, high, score in stretches[:: max(1, len(stretches) // 40)]:
            assert score == pytest.approx(at((low + high) / 2))
        weights, best = blend.line_search(probs, answers, [0, 1, 2], start, axis)
        assert best == pytest.approx(map3_of(p, answer, weights))
        assert best >= max(at(t) for t in np.linspace(0.0007, 0.9993, 700)) - 1e-12
    weights, best = blend.ascend(probs, answers, [0, 1, 2], start, 1)
    assert best == pytest.approx(map3_of(p, answer, weights)) and best >= map3_of(p, answer, start)


def test_vectors_in_several_blocks_score_like_one(spark, monkeypatch):
    probs, answers, p, answer = random_probs(spark, 12)
    vectors = spark.createDataFrame([(a, b, 10 - a - b) for a in range(6) for b in range(5)] * 2, "w0 int, w1 int, w2 int")
    one = sorted(map(tuple, blend.score_weights(probs, answers, [0, 1, 2], vectors, 10).collect()))
    monkeypatch.setattr(blend, "MANY_VECTORS", 7)
    assert sorted(map(tuple, blend.score_weights(probs, answers, [0, 1, 2], vectors, 10).collect())) == one and len(one) == 30
    assert all(s == pytest.approx(map3_of(p, answer, w)) for *w, s in one)


def test_grid_vectors_are_those_of_the_rows(spark):
    for models, steps in ((1, 4), (2, 3), (4, 5), (5, 4)):
        rows = {tuple(r) for r in blend.with_weight_grid(spark.range(1).select(F.lit(0).alias("x")), models, steps).drop("x").collect()}
        got = [tuple(v) for m in blend.grid_vectors(models, steps) for v in m.tolist()]
        assert len(got) == len(rows) and set(got) == rows


def test_an_empty_training_part_fails(spark):
    from askframe.plans.question_sets import question_bundle

    rows = [(i, f"q{i}", *"12345", "A") for i in range(4)]
    base = spark.createDataFrame(rows, "id long, prompt string, A string, B string, C string, D string, E string, answer string")
    asked = base.drop("answer").limit(2)
    parts = question_bundle(base, test_size=0.5, test=asked).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"train": 2, "valid": 2, "test": 2}
    assert question_bundle(base, test_size=1).count() == 4
    with pytest.raises(Exception, match="no rows in the training part"):
        question_bundle(base.filter("false")).collect()


def trustworthiness(x, flat, k):
    """1 when every neighbour in the flat view is a neighbour among the vectors too."""
    n = len(x)
    rank = np.linalg.norm(x[:, None] - x[None], axis=2).argsort(axis=1).argsort(axis=1)
    near = np.linalg.norm(flat[:, None] - flat[None], axis=2).argsort(axis=1)[:, 1 : k + 1]
    lost = sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_neighbour_layout_keeps_more_neighbours_than_components(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(14, 20))
    x = centres[np.arange(280) % 14] + 0.25 * rng.normal(size=(280, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, emb array<double>").repartition(4)
    view = {r.vec_id: (r.x, r.y) for r in layout.neighbour_layout(df, "vec_id", k=10, steps=8).collect()}
    assert sorted(view) == [i * 3 for i in range(280)]
    flat = np.array([view[i * 3] for i in range(280)])
    pca = {r.vec_id: (r.x, r.y) for r in clusters.project_2d(df.filter("emb is not null")).collect()}
    plain = np.array([pca[i * 3] for i in range(280)])
    # What is lost of the neighbourhoods is less than half of what components lose.
    assert 1 - trustworthiness(x, flat, 10) < 0.5 * (1 - trustworthiness(x, plain, 10))
    again = {r.vec_id: (r.x, r.y) for r in layout.neighbour_layout(df.repartition(2), "vec_id", k=10, steps=2).collect()}
    same = {r.vec_id: (r.x, r.y) for r in layout.neighbour_layout(df, "vec_id", k=10, steps=2).collect()}
    assert all(again[i] == pytest.approx(same[i], abs=1e-6) for i in same)


def test_neighbour_graph_weighs_both_choices(spark):
    x = np.array([[1.0, 0.0], [0.8, 0.6], [0.6, 0.8], [-1.0, 0.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "number long, emb array<double>")
    w = {(r.a, r.b): r.w for r in layout.neighbour_graph(df, 2).collect()}
    assert all(w[b, a] == pytest.approx(v) for (a, b), v in w.items()) and all(0 < v <= 1 for v in w.values())
    assert w[0, 1] == pytest.approx(1.0) and w[1, 2] == pytest.approx(1.0) and (0, 3) not in w


def test_screened_scores_equal_all_scores():
    rng = np.random.default_rng(3)
    d = rng.normal(size=(20_000, 8)) * rng.choice([1e-3, 1e-2, 1e-1], size=(20_000, 1))
    d[5_000:9_000] = d[17]
    ids, q = rng.permutation(20_000), np.r_[rng.normal(size=(400, 8)), d[15:20], np.zeros((1, 8))]
    want = blocks.merged(list(blocks.dense_hits(np.arange(len(q)), q, ids, d, 6)), 6)
    for got in (blocks.screened_hits(q, ids, d, 6), blocks.screened_hits(q, *dense.first_copies(ids, d, 6), 6)):
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert len(dense.first_copies(ids, d, 6)[0]) == 16_005
    assert [len(x) for x in blocks.screened_hits(q[:2], ids[:3], d[:3], 6)] == [6] * 3


def test_many_queries_stay_in_place(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    x[40:90] = x[3]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (7, rows[9][1]), (None, rows[0][1]), (400, None)], "id long, embedding array<double>")
    asked, corpus = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")
    want = dense.vector_topk(asked, corpus, 4, query_block=50).collect()
    monkeypatch.setattr(dense, "MANY_QUERIES", 100)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 4_000)
    hits = dense.vector_hits(asked, corpus, 4)
    # A row a query, hit and block of the corpus, whatever the number of tasks.
    assert hits.count() <= 301 * 4 * 4
    assert Counter(dense.vector_topk(asked, corpus, 4).collect()) == Counter(want)


def test_scores_round_like_the_sql(spark):
    scored = spark.createDataFrame([(1, 1, 0.2549295), (1, 2, 0.123456), (1, 3, -0.2549295)], "query_id long, doc_id long, score double")
    assert [r.score for r in sparse.top_k(scored, 3).orderBy("rank").collect()] == [0.254929, 0.123456, -0.254929]


def test_small_blocks_of_queries_travel_together(spark, monkeypatch):
    calls, search = [], sparse.search_index
    monkeypatch.setattr(sparse, "search_index", lambda *a, **b: calls.append(1) or search(*a, **b))
    rows = [(i, f"alpha{i % 7} beta{i % 5} gamma{i % 3} delta") for i in range(40)]
    queries, docs = (spark.createDataFrame(rows, f"{key} long, text string") for key in ("query_id", "doc_id"))
    want = sparse.tfidf_topk(queries, docs, 3).collect()
    calls.clear()
    assert Counter(sparse.tfidf_topk(queries, docs, 3, block_terms=20).collect()) == Counter(want)
    assert len(calls) == 1


def test_unsectioned_context_holds_few_texts_in_python(spark, monkeypatch):
    from askframe.fixed_values import LETTERS
    from askframe.plans import contexts

    rows, key, real = [], "spark.sql.execution.arrow.maxRecordsPerBatch", sparse.stored
    own = spark.conf.get(key)
    monkeypatch.setattr(sparse, "stored", lambda df, name: (rows.append(int(spark.conf.get(key))) if name == "index" else None, real(df, name))[1])
    paragraphs = spark.createDataFrame([(1, "T", "ﬁne café roof"), (2, "T", "other words"), (3, "U", None)], "article_id long, title string, text string")
    questions = spark.createDataFrame([(7, "café roof", *"vwxyz")], ["id", "prompt", *LETTERS])
    found = contexts.sparse_context(questions, paragraphs, 1, sectioned=False)
    assert rows == [1024] and spark.conf.get(key) == own
    # Only texts that a question finds are normalised to be shown: the step stands above the join with the hits.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join Inner")
    assert [r.context for r in found.collect()] in ([None], ["- fine café roof"])


def test_an_index_is_stored_in_row_groups_of_few_rows(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(inverted, "ROW_DOCS", 4)
    # 2,000 terms a text that no other has: about 150 KB a row of the index.
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda n: F.hex(F.xxhash64("id", n))), " ")
    corpus = spark.range(480, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    index = sparse._stored_index(corpus, None)
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i) for m in found for i in range(m.num_row_groups)]
    assert index.count() == sum(g.num_rows for g in groups) == 120
    assert max(g.total_byte_size for g in groups) < 12 << 20 < sum(g.total_byte_size for g in groups)


@pytest.mark.parametrize("block_terms", [500_000, 60])
def test_a_search_holds_few_rows_and_one_set_of_queries(spark, texts, monkeypatch, block_terms):
    queries, docs = texts
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"]

    def settings():
        return [*map(spark.conf.get, names), spark.conf.get("parquet.block.size", None)]

    before, seen = settings(), {}

    def watched(df, name):
        seen.setdefault(name, []).append(settings())
        return stored(df, name)

    monkeypatch.setattr(inverted, "stored", watched)
    monkeypatch.setattr(sparse, "BLOCK_TERMS", block_terms)
    hits = sparse.tfidf_hits(frame(spark, queries, "query_id"), frame(spark, docs, "doc_id").repartition(6), 3, block_terms)
    assert settings() == before
    assert seen["hits"] and all(int(n) <= 4 for now in seen["hits"] for n in now[:2])
    # At most three a query, however many tasks took part.
    assert hits.filter("doc_id is not null").groupBy("query_id").count().agg(F.max("count")).first()[0] == 3
    if block_terms == 60:
        assert len(seen["hits"]) > 1 and int(seen["index-weighted"][0][2]) <= 8 << 20
        assert all(now[3] for name in ("index-placed", "index-weighted", "index-numbered") for now in seen[name])
    rows = sorted(tuple(r) for r in sparse.top_k(hits.filter("doc_id is not null"), 3).collect())
    assert rows == sorted(brute_tfidf(queries, docs, 3))
