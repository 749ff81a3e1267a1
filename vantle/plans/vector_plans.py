"""Vectors: normalizing, packing, search, agreement, pooling, metrics, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantle.functions import vectors as V
from vantle.operators import pooling, ranking, search
from vantle.plans.catalog import long_form, query, vectors

_DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
_UNNEST = "SELECT {keys}, (UNNEST(range(64)))::BIGINT AS pos, UNNEST({array}){cast} AS {name} FROM {source}"
_SIGNS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
_HALF = """list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE
 round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14.0) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14.0) - 10) END)"""
_CODES = """list_transform(embedding, lambda x: greatest(-127.0, least(127.0, round_even(((x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y)))::DOUBLE)::FLOAT * 127::FLOAT)::DOUBLE, 0)))::TINYINT)"""
_SCALE = "(list_max(list_transform(embedding, lambda y: abs(y)))::DOUBLE / 127)::FLOAT"


@query("SELECT count(*)::BIGINT AS n, sum(CASE WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 THEN 1 ELSE 0 END)::BIGINT AS n_finite FROM embeddings")
def q01_finite_check(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(V.all_finite("embedding").cast("long")).alias("n_finite"))


@query("SELECT vec_id, pos, round(x, 6) AS value FROM (" + _UNNEST.format(keys="vec_id", array="list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))", cast="", name="x", source="(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 7.5) AS e FROM embeddings)") + ")")
def q02_normalize(spark, sf_dir):
    scaled = vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 7.5).alias("e"))
    out = long_form(scaled.select("vec_id", V.normalized("e").alias("v")), "v", ["vec_id"], "value", "double")
    return out.withColumn("value", F.round("value", 6))


@query(_UNNEST.format(keys="vec_id", array=_HALF, cast="", name="value", source="embeddings"))
def q03_pack_float16(spark, sf_dir):
    return long_form(vectors(spark, sf_dir).select("vec_id", V.pack_half("embedding").alias("v")), "v", ["vec_id"], "value", "double")


@query(_UNNEST.format(keys=f"vec_id, {_SCALE}::DOUBLE AS scale", array=_CODES, cast="::BIGINT", name="code", source="embeddings"))
def q04_pack_int8(spark, sf_dir):
    packed = vectors(spark, sf_dir).select("vec_id", V.int8_scale("embedding").cast("double").alias("scale"), V.pack_int8("embedding").alias("v"))
    return long_form(packed, "v", ["vec_id", "scale"], "code", "long")


@query("""SELECT vec_id, (pos // 8)::BIGINT AS pos, sum(CASE WHEN x > 0 THEN (1 << (7 - pos % 8))::BIGINT ELSE 0 END)::BIGINT AS byte
 FROM (SELECT vec_id, (UNNEST(range(64)))::BIGINT AS pos, UNNEST(embedding) AS x FROM embeddings) GROUP BY ALL""")
def q05_pack_binary(spark, sf_dir):
    return long_form(vectors(spark, sf_dir).select("vec_id", V.pack_bits("embedding").alias("v")), "v", ["vec_id"], "byte", "long")


@query(f"SELECT bool_and(abs(sqrt({_DOT.format('embedding', 'embedding')}) - 1) <= 1e-4 + 1e-5) AS was_normalized FROM embeddings")
def q06_was_normalized(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.bool_and(V.is_unit("embedding")).alias("was_normalized"))


@query("SELECT vec_id, pos, round(x, 9) AS value FROM (" + _UNNEST.format(keys="vec_id", array=f"list_transform({_CODES}, lambda q: q::DOUBLE * {_SCALE}::DOUBLE)", cast="", name="x", source="embeddings") + ")")
def q07_unpack_int8(spark, sf_dir):
    packed = vectors(spark, sf_dir).select("vec_id", V.int8_scale("embedding").alias("scale"), V.pack_int8("embedding").alias("codes"))
    out = long_form(packed.select("vec_id", V.unpack_int8("codes", "scale").alias("v")), "v", ["vec_id"], "value", "double")
    return out.withColumn("value", F.round("value", 9))


@query("SELECT vec_id, pos, CASE WHEN x > 0 THEN 1 ELSE -1 END::BIGINT AS sign FROM (SELECT vec_id, (UNNEST(range(64)))::BIGINT AS pos, UNNEST(embedding) AS x FROM embeddings)")
def q08_unpack_binary(spark, sf_dir):
    packed = vectors(spark, sf_dir).select("vec_id", V.pack_bits("embedding").alias("p"))
    return long_form(packed.select("vec_id", V.unpack_bits("p", 64).alias("v")), "v", ["vec_id"], "sign", "long")


def _query_vector(spark, sf_dir):
    return vectors(spark, sf_dir).where("vec_id = 0").select("embedding").first()[0]


@query(f"""SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
 FROM (SELECT e.vec_id, {_DOT.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)) WHERE rank <= 10""")
def q09_topk_float(spark, sf_dir):
    out = search.topk(vectors(spark, sf_dir).select("vec_id", "embedding"), search.exact_score(_query_vector(spark, sf_dir)), 10)
    return out.select("vec_id", F.round("score", 6).alias("score"), "rank")


_HAMMING = "list_sum(list_transform(list_zip({}, {}), lambda p: CASE WHEN (p[1] > 0) = (p[2] > 0) THEN 1 ELSE 0 END))::BIGINT"


@query(f"""SELECT vec_id, score, rank FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
 FROM (SELECT e.vec_id, {_HAMMING.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)) WHERE rank <= 10""")
def q10_topk_hamming(spark, sf_dir):
    query_vector = _query_vector(spark, sf_dir)
    return search.topk(vectors(spark, sf_dir).select("vec_id", "embedding"), search.binary_score(query_vector, len(query_vector)), 10).select("vec_id", "score", "rank")


@query(f"""SELECT vec_id, caption, round(score, 6) AS score, rank FROM (SELECT vec_id, caption, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
 FROM (SELECT e.vec_id, d.text AS caption, {_DOT.format('e.embedding', 'q.embedding')} AS score FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id,
 (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label <> 3)) WHERE rank <= 10""")
def q11_search_with_captions(spark, sf_dir):
    items = vectors(spark, sf_dir).where("label <> 3").select("vec_id", "embedding")
    hits = search.topk(items, search.exact_score(_query_vector(spark, sf_dir)), 10)
    captions = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("caption"))
    # ten hits: their size is the feature
    return captions.join(F.broadcast(hits), "vec_id", "right").select("vec_id", "caption", F.round("score", 6).alias("score"), "rank")


def _pairs(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", "embedding")


_ALL = """SELECT a.vec_id AS query_id, b.vec_id AS item_id, {score} AS score FROM embeddings a, embeddings b"""
_EXACT = f"round({_DOT.format('a.embedding', 'b.embedding')}, 9)"
_TOP = "SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({source})) WHERE rank <= {k}"


@query(_TOP.format(source=_ALL.format(score=_EXACT), k=10))
def q12_batch_topk(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return search.batch_topk(rows, rows, 10)


_INT8 = f"list_transform({_CODES}, lambda q: q::DOUBLE * {_SCALE}::DOUBLE)"
_PACKED = f"""packed AS (SELECT 'float32' AS packing, vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT 'float16', vec_id, {_HALF} FROM embeddings
 UNION ALL SELECT 'int8', vec_id, {_INT8} FROM embeddings UNION ALL SELECT 'binary', vec_id, {_SIGNS} FROM embeddings)"""
_NEIGHBOURS = f"""{_PACKED}, near AS (SELECT * FROM (SELECT a.packing, a.vec_id AS q, b.vec_id AS i, row_number() OVER (PARTITION BY a.packing, a.vec_id ORDER BY round(list_inner_product(a.e, b.e), 9) DESC, b.vec_id) AS rk
 FROM packed a JOIN packed b ON a.packing = b.packing AND a.vec_id <> b.vec_id) WHERE rk <= 10),
 agree AS (SELECT p.packing, count(*)::BIGINT AS overlap FROM near p JOIN near f ON f.packing = 'float32' AND f.q = p.q AND f.i = p.i GROUP BY p.packing)"""


def _unpacked(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    scale = V.int8_scale("embedding")
    return {
        "float32": rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")),
        "float16": rows.select("vec_id", V.pack_half("embedding").alias("v")),
        "int8": rows.select("vec_id", scale.alias("s"), V.pack_int8("embedding").alias("c")).select("vec_id", V.unpack_int8("c", "s").alias("v")),
        "binary": rows.select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(-1.0)).alias("v")),
    }


def _agreements(spark, sf_dir):
    return search.agreements(_unpacked(spark, sf_dir), "float32", 10)


@query(f"WITH {_NEIGHBOURS} SELECT packing, overlap, overlap / ((SELECT count(*) FROM embeddings) * 10.0::DOUBLE) AS agreement FROM agree")
def q13_neighbour_agreement(spark, sf_dir):
    return _agreements(spark, sf_dir)


_COSINES = f"""cosines AS (SELECT p.packing, round(avg(list_inner_product(p.e, f.e) / sqrt(list_inner_product(p.e, p.e)) / sqrt(list_inner_product(f.e, f.e))), 6) AS cosine
 FROM packed p JOIN packed f ON f.packing = 'float32' AND f.vec_id = p.vec_id WHERE p.packing <> 'binary' GROUP BY p.packing)"""


def _mean_cosines(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.transform("embedding", lambda x: x.cast("double")).alias("float32"), V.pack_half("embedding").alias("float16"), V.int8_scale("embedding").alias("s"), V.pack_int8("embedding").alias("c"))
    rows = rows.withColumn("int8", V.unpack_int8("c", "s"))
    cosine = lambda k: V.dot(k, "float32") / V.norm(k) / V.norm("float32")
    kinds = ("float32", "float16", "int8")
    means = rows.agg(*(F.round(F.avg(cosine(k)), 6).alias(k) for k in kinds))
    return means.select(F.inline(F.array(*(F.struct(F.lit(k).alias("packing"), F.col(k).alias("cosine")) for k in kinds))))


@query(f"WITH {_PACKED}, {_COSINES} SELECT packing, cosine FROM cosines")
def q14_mean_cosine(spark, sf_dir):
    return _mean_cosines(spark, sf_dir)


@query(f"""WITH {_NEIGHBOURS}, {_COSINES}, n AS (SELECT count(*) AS n FROM embeddings)
 SELECT a.packing, (n * CASE a.packing WHEN 'float32' THEN 256 WHEN 'float16' THEN 128 WHEN 'int8' THEN 68 ELSE 8 END)::BIGINT AS bytes, overlap / (n * 10.0::DOUBLE) AS agreement, cosine
 FROM agree a CROSS JOIN n LEFT JOIN cosines c ON a.packing = c.packing""")
def q15_compare_packings(spark, sf_dir):
    count = vectors(spark, sf_dir).agg(F.count("*").alias("n"))
    rows = _agreements(spark, sf_dir).join(_mean_cosines(spark, sf_dir), "packing", "left").join(count, F.lit(True))
    return rows.select("packing", (F.col("n") * V.bytes_per_vector(F.lit(64), F.col("packing"))).alias("bytes"), "agreement", "cosine")


@query(f"""WITH cand AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rk FROM
 (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_HAMMING.format('a.embedding', 'b.embedding')} AS s FROM embeddings a, embeddings b)) WHERE rk <= 100)
 SELECT query_id, item_id, score, rank FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM
 (SELECT c.query_id, c.item_id, {_EXACT} AS score FROM cand c JOIN embeddings a ON a.vec_id = c.query_id JOIN embeddings b ON b.vec_id = c.item_id)) WHERE rank <= 10""")
def q16_rerank(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return search.rerank(rows, rows, 100, 10)


@query("""WITH f AS (SELECT label, (UNNEST(range(64)))::BIGINT AS pos, UNNEST(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS x FROM embeddings),
 m AS (SELECT label, pos, avg(x) AS v FROM f GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY label)
 SELECT label::BIGINT AS label, pos, round(v / n, 6) AS value FROM m JOIN n USING (label)""")
def q17_mean_pool(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").cast("long").alias("label"), "embedding")
    return long_form(pooling.mean_pool(rows, "label"), "vector", ["label"], "value", "double").withColumn("value", F.round("value", 6))


@query("""WITH f AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS m, (UNNEST(range(64)))::BIGINT AS pos, UNNEST(embedding)::DOUBLE AS x FROM embeddings)
 SELECT label::BIGINT AS label, pos, round(sum(x * m) / CASE WHEN sum(m) = 0 THEN 1 ELSE sum(m) END, 6) AS value FROM f GROUP BY ALL""")
def q18_masked_mean(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").cast("long").alias("label"), "vec_id", "embedding")
    out = pooling.masked_mean(rows, "label", F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0))
    return long_form(out, "vector", ["label"], "value", "double").withColumn("value", F.round("value", 6))


@query("""WITH m AS (SELECT label AS l, min(vec_id) AS first FROM embeddings GROUP BY label),
 f AS (SELECT label, CASE WHEN vec_id % 3 = 0 OR vec_id = first THEN 0.0 ELSE 1.0 END::DOUBLE AS m, (UNNEST(range(64)))::BIGINT AS pos, UNNEST(embedding)::DOUBLE AS x FROM embeddings JOIN m ON l = label)
 SELECT label::BIGINT AS label, pos, round(sum(x * m) / CASE WHEN sum(m) = 0 THEN 1 ELSE sum(m) END, 6) AS value FROM f GROUP BY ALL""")
def q18b_masked_text_mean(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").cast("long").alias("label"), "vec_id", "embedding")
    out = pooling.masked_text_mean(rows, "label", "vec_id", F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0))
    return long_form(out, "vector", ["label"], "value", "double").withColumn("value", F.round("value", 6))


@query("""WITH f AS (SELECT label, CASE WHEN vec_id % 3 = 2 AND vec_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS m, (UNNEST(range(64)))::BIGINT AS pos, UNNEST(embedding)::DOUBLE AS x FROM embeddings)
 SELECT label::BIGINT AS label, pos, round(sum(x * m) / CASE WHEN sum(m) = 0 THEN 1 ELSE sum(m) END, 6) AS value FROM f GROUP BY ALL""")
def q19_late_fusion(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").cast("long").alias("label"), "vec_id", "embedding")
    mask = F.when((F.col("vec_id") % 3 == 2) & (F.col("vec_id") % 2 == 0), 0.0).otherwise(1.0)
    parts = [rows.where(F.col("vec_id") % 3 == m).select("label", "embedding", mask.alias("mask")) for m in range(3)]
    return long_form(pooling.fused(parts, "label"), "vector", ["label"], "value", "double").withColumn("value", F.round("value", 6))


def _text_and_video(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    pair = F.floor(F.col("vec_id") / 2).cast("long")
    return rows.where("vec_id % 2 = 0").select(pair.alias("id"), "embedding"), rows.where("vec_id % 2 = 1").select(pair.alias("id"), "embedding")


_TV = """t AS (SELECT vec_id // 2 AS id, embedding FROM embeddings WHERE vec_id % 2 = 0), v AS (SELECT vec_id // 2 AS id, embedding FROM embeddings WHERE vec_id % 2 = 1)"""
_METRICS = """avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS r1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS r5, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) * 100 AS r10,
 {median}::DOUBLE AS median_rank, avg(rank)::DOUBLE AS mean_rank, round(stddev_pop(rank), 6) AS std_rank, count(*)::BIGINT AS n"""


def _metrics(spark, sf_dir, ties, signs=False, swap=False):
    queries, items = _text_and_video(spark, sf_dir)[:: -1 if swap else 1]
    truth = queries.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
    return ranking.recall_metrics(ranking.positions(search.truth_places(queries, items, truth, signs), ties))


def _metrics_sql(ties, signs=False, swap=False):
    a, b = ("v", "t") if swap else ("t", "v")
    score = _HAMMING.format("q.embedding", "i.embedding") if signs else f"round({_DOT.format('q.embedding', 'i.embedding')}, 9)"
    ranks = {
        "min": "SELECT q, rk AS rank FROM (SELECT q, i, rank() OVER (PARTITION BY q ORDER BY s DESC) AS rk FROM s) WHERE q = i",
        "ordinal": "SELECT q, rk AS rank FROM (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY s DESC, i) AS rk FROM s) WHERE q = i",
        "expand": "SELECT q, UNNEST(range(g + 1, g + e + 1)) AS rank FROM (SELECT s.q, sum(CASE WHEN s.s > d.s THEN 1 ELSE 0 END)::BIGINT AS g, sum(CASE WHEN s.s = d.s THEN 1 ELSE 0 END)::BIGINT AS e FROM s JOIN s d ON d.q = s.q AND d.i = d.q GROUP BY s.q)",
    }[ties]
    return f"WITH {_TV}, s AS (SELECT q.id AS q, i.id AS i, {score} AS s FROM {a} q, {b} i), r AS ({ranks}) SELECT {_METRICS.format(median='median(rank)')} FROM r"


@query(_metrics_sql("min"))
def q20_text_to_video_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "min")


@query(_metrics_sql("min", swap=True))
def q20b_video_to_text_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "min", swap=True)


@query(_metrics_sql("ordinal"))
def q21_ordinal_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "ordinal")


@query(_metrics_sql("expand", signs=True))
def q22_tie_expanding_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "expand", signs=True)


_GROUPS = f"""v AS (SELECT label::BIGINT AS video_id, embedding FROM embeddings WHERE vec_id IN (SELECT max(vec_id) FROM embeddings WHERE vec_id % 2 = 1 GROUP BY label)),
 s AS (SELECT t.label::BIGINT AS group_id, t.vec_id AS sentence_id, v.video_id, round({_DOT.format('t.embedding', 'v.embedding')}, 9) AS score FROM embeddings t, v WHERE t.vec_id % 2 = 0)"""


def _sentences_and_videos(spark, sf_dir):
    """(vec_id, group_id, vector) and (id, vector): a group's video stands under the group's number."""
    rows = vectors(spark, sf_dir).withColumn("label", F.col("label").cast("long"))
    videos = ranking.group_members(rows.where("vec_id % 2 = 1"), "label", "vec_id").select(F.col("label").alias("id"), F.col("embedding").alias("vector"))
    return rows.where("vec_id % 2 = 0").select("vec_id", F.col("label").alias("group_id"), F.col("embedding").alias("vector")), videos


@query(f"""WITH {_GROUPS}, r AS (SELECT group_id, video_id, row_number() OVER (PARTITION BY sentence_id ORDER BY score DESC, video_id) AS rank FROM s)
 SELECT {_METRICS.format(median='quantile_disc(rank, 0.5)')} FROM r WHERE group_id = video_id""")
def q23_multi_sentence_metrics(spark, sf_dir):
    sentences, videos = _sentences_and_videos(spark, sf_dir)
    truth = sentences.select(F.col("vec_id").alias("query_id"), F.col("group_id").alias("item_id"))
    places = search.truth_places(sentences.select("vec_id", "vector"), videos, truth)
    return ranking.recall_metrics(ranking.positions(places, "ordinal"), lower_median=True)


@query(f"""WITH {_GROUPS}, m AS (SELECT group_id, video_id, max(score) AS score FROM s GROUP BY ALL), r AS (SELECT group_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, group_id) AS rank FROM m)
 SELECT {_METRICS.format(median='median(rank)')} FROM r WHERE group_id = video_id""")
def q24_best_sentence_metrics(spark, sf_dir):
    sentences, videos = _sentences_and_videos(spark, sf_dir)
    places = search.group_places(sentences.select("group_id", "vector"), videos)
    return ranking.recall_metrics(ranking.positions(places.withColumnRenamed("item_id", "query_id"), "ordinal"))


#: Pairs in a training batch.
_BATCH = 64


def _batch_scores(spark, sf_dir):
    """Scores within batches of 64 pairs: a join on the batch, whose size is fixed."""
    text, video = _text_and_video(spark, sf_dir)
    batch = F.floor(F.col("id") / _BATCH).cast("long").alias("batch")
    t = text.select(batch, F.col("id").alias("q"), F.col("embedding").alias("a"))
    v = video.select(batch, F.col("id").alias("v"), F.col("embedding").alias("b"))
    return t.join(v, "batch").select("batch", "q", "v", (V.dot("a", "b") * 100.0).alias("score"))


_BATCHES = f"{_TV}, s AS (SELECT t.id // 64 AS batch, t.id AS q, v.id AS v, {_DOT.format('t.embedding', 'v.embedding')} * 100.0::DOUBLE AS score FROM t JOIN v ON t.id // 64 = v.id // 64)"


@query(f"""WITH {_BATCHES}, r AS (SELECT batch, q, max(score) AS mx FROM s GROUP BY ALL), c AS (SELECT batch, v, max(score) AS mx FROM s GROUP BY ALL),
 lr AS (SELECT s.batch, s.q, ln(sum(exp(score - mx))) + max(mx) AS l FROM s JOIN r ON s.batch = r.batch AND s.q = r.q GROUP BY ALL), lc AS (SELECT s.batch, s.v, ln(sum(exp(score - mx))) + max(mx) AS l FROM s JOIN c ON s.batch = c.batch AND s.v = c.v GROUP BY ALL)
 SELECT s.batch, round((avg(lr.l - score) + avg(lc.l - score)) / 2, 6) AS loss FROM s JOIN lr ON s.q = lr.q JOIN lc ON s.v = lc.v WHERE s.q = s.v GROUP BY s.batch""")
def q25_contrastive_loss(spark, sf_dir):
    return ranking.contrastive_loss(_batch_scores(spark, sf_dir)).withColumn("loss", F.round("loss", 6))


@query(f"""WITH {_BATCHES}, d AS (SELECT * FROM s WHERE q = v)
 SELECT s.batch, round(avg(greatest(0, 0.1 + s.score - a.score) + greatest(0, 0.1 + s.score - b.score)), 6) AS loss FROM s JOIN d a ON a.q = s.q JOIN d b ON b.v = s.v GROUP BY s.batch""")
def q26_margin_loss(spark, sf_dir):
    return ranking.margin_loss(_batch_scores(spark, sf_dir), 0.1).withColumn("loss", F.round("loss", 6))


@query(f"""WITH {_BATCHES}, d AS (SELECT * FROM s WHERE q = v), n AS (SELECT batch, count(DISTINCT q // 4) AS n FROM d GROUP BY batch)
 SELECT s.batch, round(avg((greatest(0, 0.1 + s.score - a.score) + greatest(0, 0.1 + s.score - b.score)) * CASE WHEN n = 1 THEN 1 WHEN s.q // 4 = s.v // 4 THEN n * 0.7::DOUBLE ELSE n * 0.3::DOUBLE / (n - 1) END), 6) AS loss
 FROM s JOIN d a ON a.q = s.q JOIN d b ON b.v = s.v JOIN n ON n.batch = s.batch GROUP BY s.batch""")
def q26b_weighted_margin_loss(spark, sf_dir):
    return ranking.margin_loss(_batch_scores(spark, sf_dir), 0.1, pairs=4, hard_rate=0.7).withColumn("loss", F.round("loss", 6))


@query(f"""WITH {_BATCHES}, u AS (SELECT batch, q AS k, score FROM s UNION ALL SELECT batch, v, score FROM s WHERE q <> v), m AS (SELECT k, max(score) AS mx FROM u GROUP BY k),
 l AS (SELECT u.batch, u.k, ln(sum(exp(score - mx))) + max(mx) AS l FROM u JOIN m ON u.k = m.k GROUP BY ALL)
 SELECT l.batch, round(avg(l - d.score), 6) AS loss FROM l JOIN s d ON d.q = l.k AND d.v = l.k GROUP BY l.batch""")
def q27_nce_loss(spark, sf_dir):
    return ranking.nce_loss(_batch_scores(spark, sf_dir)).withColumn("loss", F.round("loss", 6))


@query("SELECT label::BIGINT AS label, max(vec_id) AS vec_id FROM embeddings GROUP BY label")
def q49b_group_members(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("label").cast("long").alias("label"), "vec_id")
    return ranking.group_members(rows, "label", "vec_id").select("label", "vec_id")
