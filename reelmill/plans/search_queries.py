"""Search queries over the derived corpus and vectors."""

import functools

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from reelmill.functions import vectors as vec
from reelmill.functions.columns import round_even
from reelmill.functions.materialize import new_table_path
from reelmill.operators import codes
from reelmill.operators import maintenance as mt
from reelmill.operators import postings
from reelmill.operators import search as op
from reelmill.operators.segmentation import transcript_windows
from reelmill.plans import library as lib
from reelmill.plans.registry import query
from reelmill.plans.views import with_views

TEXT = "the and"


def mean_vector(spark, sf_dir):
    """Query vector: the mean of all vectors, to 6 decimals (one small row)."""
    vectors = lib.table(spark, sf_dir, "embeddings").select(array_to_vector("embedding").alias("v"))
    mean = vectors.select(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    return mean.select(F.transform("m", lambda x: round_even(x, 6))).first()[0]


MEAN = {
    "mean_vec": """SELECT list(round_even(m, 6)::DOUBLE ORDER BY i) AS qv FROM (SELECT i, avg(v) AS m FROM
        (SELECT unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY i)"""
}


def indexed(spark, sf_dir):
    """Keyword ranking over the stored postings of the corpus."""
    return functools.partial(postings.index_topk, spark, lib.search_index(spark, sf_dir))


def scored_sql(source: str, where: str = "true") -> str:
    return f"""SELECT video_no, seg_index, round_even(list_cosine_similarity(embedding::DOUBLE[], qv), 6)::DOUBLE AS score
      FROM {source}, mean_vec WHERE status <> 'soft_deleted' AND {where}"""


@query(
    "semantic_topk",
    with_views(
        f"SELECT * FROM ({scored_sql('vectors')}) ORDER BY score DESC, video_no, seg_index LIMIT 10", "vectors", extra=MEAN
    ),
)
def semantic_topk(spark, sf_dir):
    return op.semantic_topk(lib.vectors(spark, sf_dir), mean_vector(spark, sf_dir), 10).select(*op.KEYS, "score")


@query(
    "semantic_filtered",
    with_views(
        f"""SELECT * FROM ({scored_sql("vectors", "subject = 'label-3' AND has_speech")}) ORDER BY score DESC, video_no, seg_index LIMIT 10""",
        "vectors",
        extra=MEAN,
    ),
)
def semantic_filtered(spark, sf_dir):
    segs = op.attribute_filter(lib.vectors(spark, sf_dir), subject="label-3", has_speech=True)
    return op.semantic_topk(segs, mean_vector(spark, sf_dir), 10).select(*op.KEYS, "score")


@query(
    "semantic_topk_batch",
    with_views(
        """SELECT query_no, video_no, seg_index, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_no
             ORDER BY score DESC, video_no, seg_index) AS place FROM (SELECT query_no, video_no, seg_index,
               round_even(list_cosine_similarity(embedding::DOUBLE[], vec), 6)::DOUBLE AS score FROM vectors, queries
               WHERE status <> 'soft_deleted')) WHERE place <= 10""",
        "vectors",
        extra={
            "queries": """SELECT label::BIGINT AS query_no, list(round_even(m, 6)::DOUBLE ORDER BY i) AS vec FROM (SELECT label, i, avg(v) AS m FROM
            (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY ALL) GROUP BY label"""
        },
    ),
)
def semantic_topk_batch(spark, sf_dir):
    queries = lib.label_centroids(spark, sf_dir).select(F.col("label_no").cast("long").alias("query_no"), "vector")
    return op.semantic_topk_batch(lib.vectors(spark, sf_dir), queries, 10)


@query(
    "ann_topk",
    with_views(
        """SELECT video_no, seg_index, score, (SELECT count(*) FROM found f SEMI JOIN exact e USING (video_no, seg_index))/10.0::DOUBLE AS recall
           FROM found""",
        "vectors",
        extra=MEAN
        | {
            "cents": """SELECT label AS list_no, list(round_even(m, 6)::DOUBLE ORDER BY i) AS vec FROM (SELECT label, i, avg(v) AS m FROM
                (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY ALL) GROUP BY label""",
            "lists": """SELECT video_no, seg_index, status, embedding, arg_min(list_no, (list_distance(embedding::DOUBLE[], vec), list_no)) AS list_no
                FROM vectors, cents GROUP BY ALL""",
            "near": "SELECT list_no FROM cents, mean_vec ORDER BY list_distance(vec, qv), list_no LIMIT 4",
            "found": f"""SELECT * FROM ({scored_sql("lists", "list_no IN (SELECT list_no FROM near)")})
                ORDER BY score DESC, video_no, seg_index LIMIT 10""",
            "exact": f"SELECT * FROM ({scored_sql('vectors')}) ORDER BY score DESC, video_no, seg_index LIMIT 10",
        },
    ),
)
def ann_topk(spark, sf_dir):
    """Lists around the label centroids, of which the four nearest are searched."""
    segs, q = lib.vectors(spark, sf_dir), mean_vector(spark, sf_dir)
    centroids = [r["vector"] for r in lib.label_centroids(spark, sf_dir).orderBy("label_no").collect()]
    lists = op.nearest_lists(segs, centroids)
    found = op.ann_topk(lists, np.array(centroids), q, 10, probes=4)
    recall = op.recall_at_k(found, op.semantic_topk(segs, q, 10), 10)
    return found.select(*op.KEYS, "score").withColumn("recall", recall.scalar())


LEAST_RECALL = 0.9
TOP = "row_number() OVER (PARTITION BY query_no ORDER BY score DESC, video_no, seg_index)::INTEGER AS place"


@query(
    "ann_topk_batch",
    with_views(
        """SELECT query_no, video_no, seg_index, score, place, (SELECT count(*) FROM found SEMI JOIN exact USING (query_no, video_no, seg_index))
             / (SELECT count(*) FROM exact)::DOUBLE AS recall FROM found""",
        "vectors",
        extra={
            "asked": "SELECT vec_id AS query_no, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0",
            "cents": """SELECT label AS list_no, list(round_even(m, 6)::DOUBLE ORDER BY i) AS vec FROM (SELECT label, i, avg(v) AS m FROM
                (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY ALL) GROUP BY label""",
            "lists": """SELECT video_no, seg_index, status, embedding, arg_min(list_no, (list_distance(embedding::DOUBLE[], vec), list_no)) AS list_no
                FROM vectors, cents GROUP BY ALL""",
            "near": """SELECT query_no, qv, list_no, row_number() OVER (PARTITION BY query_no ORDER BY list_distance(vec, qv), list_no) AS p
                FROM cents, asked""",
            "scored": """SELECT query_no, video_no, seg_index, p, round_even(list_cosine_similarity(embedding::DOUBLE[], qv), 6)::DOUBLE AS score
                FROM lists JOIN near USING (list_no) WHERE status <> 'soft_deleted'""",
            "exact": f"SELECT * FROM (SELECT *, {TOP} FROM scored) WHERE place <= 10",
            "probes": f"""SELECT min(p) AS enough FROM (SELECT p, sum(count(*)) OVER (ORDER BY p) AS n FROM exact GROUP BY p)
                WHERE n >= {LEAST_RECALL} * (SELECT count(*) FROM exact)""",
            "found": f"SELECT * FROM (SELECT *, {TOP} FROM scored WHERE p <= (SELECT enough FROM probes)) WHERE place <= 10",
        },
    ),
)
def ann_topk_batch(spark, sf_dir):
    """Every fiftieth vector as a query, over lists around the label centroids; as many of them are searched as it takes to find nine in
    ten of the exact hits."""
    segs = lib.vectors(spark, sf_dir)
    centroids = np.array([r["vector"] for r in lib.label_centroids(spark, sf_dir).orderBy("label_no").collect()])
    vectors = lib.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    queries = vectors.select(F.col("vec_id").alias("query_no"), F.col("embedding").cast("array<double>").alias("vector"))
    lists = op.nearest_lists(segs, centroids)
    exact = op.semantic_topk_batch(segs, queries, 10)
    probes = op.probes_for_recall(lists, centroids, queries, exact, LEAST_RECALL)
    found = op.ann_topk_batch(lists, centroids, queries, 10, probes)
    return found.withColumn("recall", op.recall_of_batch(found, exact).scalar())


@query("ann_codes_batch")
def ann_codes_batch(spark, sf_dir):
    """Every fiftieth vector as a query against the stored codes of all vectors; ``recall`` is that of all queries against exact search,
    ``looked_up`` the share of all vectors that a query's candidates are."""
    segs = lib.vectors(spark, sf_dir)
    stored, book, candidates = codes.open_codes(spark, lib.vector_codes(spark, sf_dir))
    asked = lib.table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    queries = asked.select(F.col("vec_id").alias("query_no"), F.col("embedding").cast("array<double>").alias("vector"))
    found = codes.code_topk(stored, book, segs, queries, 10, candidates)
    recall = op.recall_of_batch(found, op.semantic_topk_batch(segs, queries, 10))
    return found.withColumn("recall", recall.scalar()).withColumn("looked_up", F.lit(candidates) / stored.agg(F.count(F.lit(1))).scalar())


@query(
    "keyword_match",
    with_views(
        "SELECT video_no, seg_index FROM corpus WHERE status <> 'soft_deleted' AND list_has_all(tokens, ['the','and'])", "corpus"
    ),
)
def keyword_match(spark, sf_dir):
    return postings.index_match(spark, lib.search_index(spark, sf_dir), TEXT).select(*op.KEYS)


def bm25_sql(limit: str) -> str:
    def one(t: str) -> str:
        df = f"(SELECT count(*) FROM live WHERE list_contains(tokens, '{t}'))"
        tf = f"len(list_filter(tokens, lambda x: x = '{t}'))"
        return f"""ln(1 + (n - {df} + 0.5)/({df} + 0.5)) * ({tf} * 2.2)/({tf} + 1.2*(0.25 + 0.75*len(tokens)/avg_len))"""

    return f"""SELECT * FROM (SELECT video_no, seg_index, round_even(({one("the")} + {one("and")})::DOUBLE, 6)::DOUBLE AS score
      FROM live, (SELECT count(*)::DOUBLE AS n, avg(len(tokens))::DOUBLE AS avg_len FROM live) WHERE list_has_all(tokens, ['the','and']))
      ORDER BY score DESC, video_no, seg_index {limit}"""


LIVE = {"live": "SELECT * FROM corpus WHERE status <> 'soft_deleted'"}


@query("keyword_rank", with_views(bm25_sql("LIMIT 20"), "corpus", extra=LIVE))
def keyword_rank(spark, sf_dir):
    return postings.index_topk(spark, lib.search_index(spark, sf_dir), TEXT, 20)


@query("keyword_rank_scan", with_views(bm25_sql("LIMIT 20"), "corpus", extra=LIVE))
def keyword_rank_scan(spark, sf_dir):
    """The same ranking without an index, from the tokens of all segments."""
    return op.keyword_topk(op.with_tokens(lib.corpus(spark, sf_dir).drop("embedding")), TEXT, 20).select(*op.KEYS, "score")


@query("keyword_rank_updated", with_views(bm25_sql("LIMIT 20"), "corpus", extra=LIVE))
def keyword_rank_updated(spark, sf_dir):
    """The same ranking from an index whose videos all were stored before: some with another text, some as visible that are deleted now."""
    now = op.with_tokens(lib.corpus(spark, sf_dir).drop("embedding"))
    changed = F.col("video_no") % 20 <= 2
    before = now.withColumn("tokens", F.when(changed, F.reverse(F.slice("tokens", 1, 5))).otherwise(F.col("tokens"))).withColumn("status", F.lit("done"))
    path = postings.build_index(before, new_table_path(spark, "postings"))
    postings.update_index(now.where(changed), path, gone=now.where("status = 'soft_deleted'"))
    return postings.index_topk(spark, path, TEXT, 20)


RRF = (
    MEAN
    | LIVE
    | {
        "sem": f"""SELECT *, row_number() OVER (ORDER BY score DESC, video_no, seg_index) AS r FROM ({scored_sql("corpus")}
            ORDER BY score DESC, video_no, seg_index LIMIT 40)""",
        "kw": f"SELECT *, row_number() OVER (ORDER BY score DESC, video_no, seg_index) AS r FROM ({bm25_sql('LIMIT 40')})",
        "fused": """SELECT video_no, seg_index, round_even(coalesce(1.0::DOUBLE/(60 + s.r), 0) + coalesce(1.0::DOUBLE/(60 + k.r), 0), 6)::DOUBLE AS score,
            s.r::INTEGER AS sem_rank, k.r::INTEGER AS kw_rank FROM sem s FULL JOIN kw k USING (video_no, seg_index)
            ORDER BY score DESC, sem_rank ASC NULLS LAST, kw_rank ASC NULLS LAST LIMIT 10""",
    }
)


@query("hybrid_rrf", with_views("SELECT * FROM fused", "corpus", extra=RRF))
def hybrid_rrf(spark, sf_dir):
    return op.hybrid_rrf(lib.corpus(spark, sf_dir), TEXT, mean_vector(spark, sf_dir), 10, indexed(spark, sf_dir))


@query(
    "search_dispatch",
    with_views(
        f"""SELECT video_no, seg_index, start_sec, end_sec, topic, subject, grade_level, summary, source_name, score, mode FROM corpus JOIN (
            SELECT video_no, seg_index, score, 'keyword' AS mode FROM ({bm25_sql("LIMIT 10")})
            UNION ALL SELECT video_no, seg_index, score, 'hybrid' FROM fused
            UNION ALL SELECT video_no, seg_index, score, 'semantic' FROM sem WHERE r <= 10) USING (video_no, seg_index)""",
        "corpus",
        extra=RRF,
    ),
)
def search_dispatch(spark, sf_dir):
    segs, q, keyword = lib.corpus(spark, sf_dir), mean_vector(spark, sf_dir), indexed(spark, sf_dir)
    degraded = op.search(segs, TEXT, "hybrid", 10, keyword=keyword)  # no vector: keyword
    return degraded.unionByName(op.search(segs, TEXT, "hybrid", 10, q, keyword)).unionByName(op.search(segs, TEXT, "other", 10, q, keyword))


@query(
    "relevance_gate",
    with_views(
        """SELECT video_no, seg_index, score, round_even(score/top, 6)::DOUBLE AS relative
           FROM scored, (SELECT max(score) AS top FROM scored) WHERE score >= greatest(0.18::DOUBLE, top*0.75::DOUBLE)""",
        "vectors",
        extra=MEAN | {"scored": scored_sql("vectors")},
    ),
)
def relevance_gate(spark, sf_dir):
    scored = op.semantic_scores(lib.vectors(spark, sf_dir), mean_vector(spark, sf_dir)).select(*op.KEYS, "score")
    return op.relevance_gate(scored)


@query(
    "hit_labels",
    with_views(
        """SELECT video_no, seg_index, printf('%d:%02d', floor(start_sec)::BIGINT//60, floor(start_sec)::BIGINT % 60)||'-'||
             printf('%d:%02d', floor(end_sec)::BIGINT//60, floor(end_sec)::BIGINT % 60) AS label FROM segments""",
        "segments",
    ),
)
def hit_labels(spark, sf_dir):
    return op.hit_labels(lib.segments(spark, sf_dir))


@query(
    "embed_text_choice",
    with_views(
        """SELECT video_no, seg_index, coalesce(nullif(summary,''), nullif(text,''), nullif(topic,''), 'untitled segment') AS stored_choice,
             coalesce(nullif(summary,''), nullif(text,''), nullif(ocr,''), nullif(captions[1],''), 'untitled segment') AS ingest_choice
           FROM (SELECT video_no, seg_index, CASE WHEN seg_index % 3 = 0 THEN '' ELSE subject END AS summary,
                   CASE WHEN video_no % 2 = 0 THEN '' ELSE 'words on '||topic END AS text, CASE WHEN video_no % 4 = 0 THEN '' ELSE topic END AS topic,
                   CASE WHEN video_no % 6 = 0 THEN NULL ELSE grade_level END AS ocr,
                   CASE WHEN video_no % 12 = 0 THEN [] ELSE tags END AS captions FROM segments)""",
        "segments",
    ),
)
def embed_text_choice(spark, sf_dir):
    n, i = F.col("video_no"), F.col("seg_index")
    none = F.array().cast("array<string>")
    s = lib.segments(spark, sf_dir).select(
        "video_no",
        "seg_index",
        F.when(i % 3 == 0, "").otherwise(F.col("subject")).alias("summary"),
        F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("words on "), F.col("topic"))).alias("text"),
        F.when(n % 4 == 0, "").otherwise(F.col("topic")).alias("topic"),
        F.when(n % 6 != 0, F.col("grade_level")).alias("ocr"),
        F.when(n % 12 == 0, none).otherwise(F.col("tags")).alias("captions"),
    )
    return s.select(
        "video_no",
        "seg_index",
        mt.stored_embed_text(F.col("summary"), F.col("text"), F.col("topic")).alias("stored_choice"),
        mt.ingest_embed_text(F.col("summary"), F.col("text"), F.col("ocr"), F.col("captions")).alias("ingest_choice"),
    )


@query(
    "vector_quality",
    """SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS missing, count(*) FILTER (len(embedding) <> 64) AS wrong_width,
         count(*) FILTER (l = 0) AS zero, count(*) FILTER (abs(l - 1) > 1e-3) AS not_unit
       FROM (SELECT embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)""",
)
def vector_quality(spark, sf_dir):
    return vec.vector_quality(lib.table(spark, sf_dir, "embeddings"), 64)


@query(
    "window_embedding",
    with_views(
        """SELECT video_no, window_no, slot::INTEGER AS slot, round_even(n/sqrt(sum(n*n) OVER (PARTITION BY video_no, window_no))::DOUBLE, 6)::DOUBLE
             AS weight FROM slot_counts""",
        "windows",
        extra={
            "hashes": """SELECT video_no, window_no, md5(unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'),
                lambda x: x <> ''))) AS h FROM windows""",
            "slot_counts": """SELECT video_no, window_no, ((instr(d, h[1])-1)*4096 + (instr(d, h[2])-1)*256 + (instr(d, h[3])-1)*16
                + instr(d, h[4])-1) % 64 AS slot, count(*) AS n FROM hashes, (SELECT '0123456789abcdef' AS d) GROUP BY ALL""",
        },
    ),
)
def window_embedding(spark, sf_dir):
    """The slots of each transcript window's vector that aren't zero."""
    windows = transcript_windows(lib.transcript(spark, sf_dir)).select("video_no", "window_no", "text")
    vectors = vec.digest_embedder(windows, ["video_no", "window_no"], "text")
    slots = vectors.select("video_no", "window_no", F.posexplode("embedding").alias("slot", "weight")).where("weight > 0")
    return slots.withColumn("weight", round_even(F.col("weight"), 6))
