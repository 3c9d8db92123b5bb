"""Queries of ranking and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from deskloom.functions.vocabulary import RANKING_STOP_WORDS
from deskloom.operators import density
from deskloom.operators import evaluation as ev
from deskloom.operators import mining as mi
from deskloom.operators import retrieval as re_
from deskloom.plans.registry import Registry
from deskloom.sources.tables import table, views_sql

R = Registry()
D = views_sql("policies")
STOP = ", ".join(f"'{w}'" for w in RANKING_STOP_WORDS)

BM25 = f"""
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '' AND x NOT IN ({STOP})) AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM tok),
idf0 AS (SELECT term, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM post, st GROUP BY term, docs),
idf AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM idf0) ELSE w END AS w FROM idf0),
ask AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '' AND x NOT IN ({STOP}))) AS term FROM benchmark) GROUP BY 1, 2),
score AS (SELECT query_id, doc_id, round(sum(times * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM ask JOIN idf USING (term) JOIN post USING (term), st GROUP BY query_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0 QUALIFY rank <= 10)"""
WORDS = """
own AS (SELECT doc_id, count(*) AS n FROM post GROUP BY doc_id), askn AS (SELECT query_id, count(*) AS n FROM ask GROUP BY query_id),
co AS (SELECT query_id, doc_id, round(count(*) / sqrt(CAST(any_value(own.n) AS DOUBLE) * any_value(askn.n)), 6) AS score FROM ask JOIN post USING (term) JOIN own USING (doc_id) JOIN askn USING (query_id) GROUP BY query_id, doc_id),
px AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM co QUALIFY rank <= 10)"""
FUSED = """
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM px) GROUP BY 1, 2) QUALIFY rank <= 5)"""
CENTROIDS = "c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2), m AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY label)"
VECTORS = """
dq AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dq QUALIFY rank <= 5)"""


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, d):
    return re_.corpus_index(table(spark, d, "documents").select("doc_id", "text"))


def _bm25(spark, d, index=None, k=10):
    return re_.bm25(_asked(spark, d), table(spark, d, "documents").select("doc_id", "text"), k, index=index)


def _both(spark, d):
    """Two rankings of all documents, by BM25 and by the cosine of their words with the query's, over one index."""
    return re_.bm25_and_words(_asked(spark, d), _index(spark, d), 10)


def _dense(spark, d, k=5):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return re_.dense(asked, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), k)


@R.add("r1_bm25", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm")
def bm25(spark, d):
    return _bm25(spark, d)


@R.add("r2_dense", f"WITH {VECTORS} SELECT query_id, doc_id, score, rank FROM de")
def dense(spark, d):
    return _dense(spark, d)


@R.add("r3_fusion", f"WITH {BM25}, {WORDS}, {FUSED} SELECT query_id, doc_id, score, rank FROM fu")
def fusion(spark, d):
    return re_.fuse(list(_both(spark, d)), 5)


@R.add(
    "r3_dense_fusion",
    f"""WITH {CENTROIDS}, q AS (SELECT e.vec_id, e.embedding, m.centroid FROM embeddings e JOIN m USING (label) WHERE vec_id % 20 = 0),
    d AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, unnest([1, 2]) AS way, unnest([round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 5), round(list_inner_product(q.centroid, CAST(e.embedding AS DOUBLE[])), 5)]) AS score
        FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, way ORDER BY score DESC, doc_id) AS rank FROM d QUALIFY rank <= 10)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM r GROUP BY 1, 2) QUALIFY rank <= 5""",
)
def dense_fusion(spark, d):
    """Two dense rankings fused: by a query's own vector, and by the mean of its label."""
    v = table(spark, d, "embeddings")
    vectors = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("vector"))
    means = asked.select("query_id", "label").join(mi.centroids(v), "label").select("query_id", F.col("centroid").alias("vector"))
    return re_.fuse([re_.dense(asked.drop("label"), vectors, 10), re_.dense(means, vectors, 10)], 5)


@R.add(
    "r4_intent_prior",
    f"""WITH {BM25}, {WORDS}, s AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM px) GROUP BY 1, 2),
    p AS (SELECT query_id, doc_id, CASE WHEN doc_id % 14 = query_id % 14 THEN round(score + 1 / 61, 9) ELSE score END AS score FROM s)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p QUALIFY rank <= 5""",
)
def intent_prior(spark, d):
    a, b = _both(spark, d)
    pairs = a.select("query_id", "doc_id").unionByName(b.select("query_id", "doc_id")).distinct()
    prior = pairs.where("doc_id % 14 = query_id % 14").withColumn("bonus", F.lit(1 / 61))
    return re_.fuse([a, b], 5, prior=prior)


GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _metrics_sql(ranked: str, gold: str, queries: str) -> str:
    per = ", ".join(
        f"""coalesce(round(avg(CASE WHEN golds > 0 THEN CASE WHEN len(list_filter(ranks, lambda r: r <= {k})) > 0 THEN 1.0 ELSE 0.0 END ELSE 0.0 END), 6), 0.0) AS hit_{k},
        coalesce(round(avg(CASE WHEN golds > 0 THEN len(list_filter(ranks, lambda r: r <= {k})) / golds ELSE 0.0 END), 6), 0.0) AS recall_{k},
        coalesce(round(avg(CASE WHEN golds > 0 THEN coalesce(list_sum(list_transform(list_filter(ranks, lambda r: r <= {k}), lambda r: 1 / log2(r + 1))), 0) / list_sum(list_transform(range(1, least(golds, {k}) + 1), lambda r: 1 / log2(r + 1))) ELSE 0.0 END), 6), 0.0) AS ndcg_{k}"""
        for k in (1, 3, 5)
    )
    return f"""q AS (SELECT query_id, (SELECT count(*) FROM {gold} g WHERE g.query_id = x.query_id) AS golds, coalesce((SELECT list(r.rank ORDER BY r.rank) FROM {ranked} r JOIN {gold} g ON g.query_id = r.query_id AND g.doc_id = r.doc_id WHERE r.query_id = x.query_id), []) AS ranks FROM {queries} x)
    SELECT count(*) AS queries, {per}, round(avg(CASE WHEN len(ranks) > 0 THEN 1 / ranks[1] ELSE 0.0 END), 6) AS mrr, round(avg(CASE WHEN len(ranks) > 0 THEN ranks[1] END), 6) AS mean_rank FROM q"""


@R.add("r5_r7_bm25_metrics", f"WITH {BM25}, {GOLD}, items AS (SELECT item_id AS query_id FROM benchmark), {_metrics_sql('bm', 'gold', 'items')}")
def bm25_metrics(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    gold = re_.containing(table(spark, d, "documents"), b)
    return ev.ranking_metrics(_bm25(spark, d), gold, b)


@R.add(
    "r5_r7_dense_metrics",
    f"""WITH {VECTORS}, gold AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    items AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0), {_metrics_sql('de', 'gold', 'items')}""",
)
def dense_metrics(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # gold is every other vector of the label: its number follows from the label's, and only ranked vectors are looked up
    sizes = asked.join(v.groupBy("label").agg((F.count("*") - 1).alias("golds")), "label").select("query_id", "golds")
    hits = _dense(spark, d).join(v.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(asked, ["query_id", "label"])
    return ev.hit_metrics(hits.select("query_id", "rank"), sizes, asked)


@R.add("r8_a26_coverage", f"WITH {VECTORS}, b AS (SELECT query_id, max(score) AS s FROM de GROUP BY 1) SELECT round(avg(s), 4) AS mean_best, round(avg(CASE WHEN s < 0.35 THEN 1 ELSE 0 END), 4) AS low_share FROM b")
def coverage(spark, d):
    return mi.coverage(_dense(spark, d))


@R.add(
    "u1_interleave",
    f"""WITH {BM25}, {WORDS}, dep AS (SELECT query_id, least((SELECT max(rank) FROM bm WHERE bm.query_id = i.item_id), (SELECT max(rank) FROM px WHERE px.query_id = i.item_id)) AS depth FROM (SELECT item_id, item_id AS query_id FROM benchmark) i),
    r AS (SELECT query_id, doc_id, min(place) AS place FROM (SELECT query_id, doc_id, rank, 2 * rank - 1 AS place FROM bm UNION ALL SELECT query_id, doc_id, rank, 2 * rank FROM px) JOIN dep USING (query_id) WHERE rank <= depth GROUP BY 1, 2)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 20""",
)
def interleave(spark, d):
    return re_.interleave(*_both(spark, d))


@R.add(
    "r22_multi_query_fusion",
    f"""WITH {VECTORS}, s AS (SELECT query_id // 100 AS query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM de GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""",
)
def multi_query(spark, d):
    lines = _dense(spark, d).withColumn("query_id", F.floor(F.col("query_id") / 100).cast("long"))
    return re_.fuse([lines], 5)


@R.add(
    "j1_hydrate",
    f"""{D} SELECT t.id, list({{'policy_key': p.policy_key, 'title': p.title}} ORDER BY pos) AS chunks FROM (SELECT doc_id AS id, unnest([doc_id + 5, doc_id + 2, doc_id + 100000000, doc_id]) AS k, unnest([1, 2, 3, 4]) AS pos FROM documents) t
    JOIN policies p ON p.id = t.k GROUP BY t.id""",
)
def hydrate(spark, d):
    key = lambda n: F.concat(F.lit("policy_"), (F.col("doc_id") + n).cast("string"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(key(5), key(2), key(100000000), key(0)).alias("ids"))
    return re_.hydrate(rows, table(spark, d, "policies"), "ids", "policy_key", ["title"]).select("id", "chunks")


@R.add(
    "r17_u3_reevaluation",
    f"""WITH {VECTORS}, f AS (SELECT query_id AS id, list(doc_id ORDER BY rank) AS ids, sum(doc_id) AS h FROM de GROUP BY 1)
    SELECT id, CASE WHEN id % 5 = 0 AND id % 3 = 0 THEN 'skipped_no_context' WHEN id % 8 = 0 THEN 'skipped_edited' WHEN id % 7 = 0 OR id % 100 = 20 THEN 'affected' ELSE 'unaffected' END AS class FROM f""",
)
def reevaluation(spark, d):
    found = _dense(spark, d).groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list("doc_id")).alias("new_ids"), F.sum("doc_id").cast("string").alias("new_hash"))
    i = F.col("id")
    stored = found.select(
        "id",
        F.when((i % 5 == 0) & (i % 3 == 0), F.lit(None)).when(i % 7 == 0, F.slice("new_ids", 1, 3)).otherwise(F.reverse("new_ids")).alias("ids"),
        F.when(i % 100 == 20, F.lit("old")).when(i % 2 == 1, F.col("new_hash")).alias("hash"),
        (i % 8 == 0).alias("edited"),
    )
    return re_.reevaluation(stored, found).select("id", "class")


@R.add(
    "r18_r19_conflict_candidates",
    f"""WITH {BM25.replace("SELECT item_id AS query_id, term", "SELECT query_id, term").replace("SELECT item_id, unnest", "SELECT doc_id AS query_id, unnest").replace("FROM benchmark) GROUP BY 1, 2", "FROM documents WHERE doc_id % 20 = 0) GROUP BY 1, 2").replace("FROM score WHERE score > 0", "FROM score WHERE score > 0 AND doc_id <> query_id")}
    SELECT query_id, doc_id, score, rank FROM bm""",
)
def conflict_candidates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return re_.bm25_top(asked, re_.corpus_index(docs), 10, F.col("text"), own=False)


@R.add(
    "r21_ablation_grid",
    f"""WITH {BM25}, {WORDS}, {FUSED}, {GOLD}, r AS (SELECT 'bm25' AS variant, query_id, doc_id, rank FROM bm UNION ALL SELECT 'words', query_id, doc_id, rank FROM px UNION ALL SELECT 'fusion', query_id, doc_id, rank FROM fu)
    SELECT variant, k, count(DISTINCT CASE WHEN rank <= k THEN query_id END) AS hits FROM r JOIN gold USING (query_id, doc_id), (VALUES (1), (3), (5)) v(k) GROUP BY ALL""",
)
def ablation(spark, d):
    a, b = _both(spark, d)
    runs = [x.select(F.lit(name).alias("variant"), "query_id", "doc_id", "rank") for name, x in (("bm25", a), ("words", b), ("fusion", re_.fuse([a, b], 5)))]
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    gold = re_.containing(table(spark, d, "documents"), items)
    rows = runs[0].unionByName(runs[1]).unionByName(runs[2]).join(gold, ["query_id", "doc_id"]).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    return rows.groupBy("variant", "k").agg(F.countDistinct(F.when(F.col("rank") <= F.col("k"), F.col("query_id"))).alias("hits"))


@R.add("r13_close_groups", f"WITH {CENTROIDS} SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.centroid, b.centroid), 4) AS similarity FROM m a JOIN m b ON a.label < b.label WHERE round(list_cosine_similarity(a.centroid, b.centroid), 4) >= -0.1")
def close_groups(spark, d):
    return mi.close_groups(mi.centroids(table(spark, d, "embeddings")), least=-0.1)


@R.add(
    "r14_representatives",
    f"""WITH {CENTROIDS}, s AS (SELECT e.label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 5) AS similarity FROM embeddings e JOIN m USING (label))
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS place FROM s QUALIFY place <= 12""",
)
def representatives(spark, d):
    v = table(spark, d, "embeddings")
    return mi.representatives(v, mi.centroids(v), 12)


@R.add(
    "r9_a21_tfidf_terms",
    """WITH t AS (SELECT source, doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents), tf AS (SELECT source, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) >= 5 AND count(*) <= 0.5 * n),
    w AS (SELECT source, doc_id, tf.term, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), nn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
    z AS (SELECT source, count(*) AS size FROM documents GROUP BY source), r AS (SELECT source, term, round(sum(w / norm) / any_value(size), 6) AS weight FROM w JOIN nn USING (doc_id) JOIN z USING (source) GROUP BY source, term)
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS place FROM r QUALIFY place <= 5""",
)
def tfidf(spark, d):
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    return mi.tfidf_terms(table(spark, d, "documents"), "source", "doc_id", tokens)


@R.add("r10_kmeans")
def kmeans(spark, d):
    return mi.kmeans(table(spark, d, "embeddings"), 10).select("vec_id", "cluster")


@R.add("r11_linked_clusters")
def linked(spark, d):
    return density.average_links(table(spark, d, "embeddings"), "label", "vec_id", least=0.2)


@R.add("r11_density_clusters")
def density_clusters(spark, d):
    return density.density_clusters(table(spark, d, "embeddings"))


@R.add("r15_trained_labels")
def trained(spark, d):
    return mi.trained_labels(table(spark, d, "embeddings")).select("vec_id", "label", "predicted")


@R.add("r10_kmeans_by_silhouette")
def kmeans_chosen(spark, d):
    return mi.kmeans_by_silhouette(table(spark, d, "embeddings"))[0].select("vec_id", "cluster")


@R.add("r16_platt")
def platt(spark, d):
    return mi.platt(table(spark, d, "judged")).select("doc_id", "p", "truth", F.round("calibrated", 6).alias("calibrated"))


@R.add("r16_isotonic")
def isotonic(spark, d):
    return mi.isotonic(table(spark, d, "judged").withColumn("p", F.col("p"))).select("doc_id", "p", "truth", "calibrated")


@R.add(
    "r12_chosen_trials",
    """WITH t AS (SELECT l_suppkey, l_linenumber AS size, round(avg(l_discount), 4) AS coverage, count(*) AS run_length FROM lineitem GROUP BY ALL), b AS (SELECT *, max(coverage) OVER (PARTITION BY l_suppkey) AS best FROM t)
    SELECT l_suppkey, size, coverage, run_length FROM b WHERE coverage >= best - 0.01 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY run_length DESC, size) = 1""",
)
def trials(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("size"), "l_discount", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return mi.chosen_trials(mi.rounded_means(rows, ["l_suppkey", "size"], "l_discount", ["file", "row"], 4, "coverage", "run_length"), "l_suppkey")


@R.add("u6_renumbered", "WITH c AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS cluster_no FROM embeddings GROUP BY label) SELECT vec_id, label, cluster_no FROM embeddings JOIN c USING (label)")
def renumbered(spark, d):
    return mi.renumbered(table(spark, d, "embeddings").select("vec_id", "label"), "label")


@R.add("n6_t4_rank", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 3")
def ranks(spark, d):
    order = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(order).alias("rank")).where("rank <= 3")
