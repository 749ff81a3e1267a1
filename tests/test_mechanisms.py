"""Kernels, vector sums, bounded search, commits and matrices against numpy and plain expectations."""

import bisect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantle.functions import text
from vantle.functions import vectors as V
from vantle.operators import dataset, pooling, search
from vantle.operators.store import Store
from vantle.sources import npy


def clustered(rows, dim, groups, seed=0, spread=0.02):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    x = np.repeat(centers, rows // groups, axis=0) + rng.normal(size=(rows // groups * groups, dim)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_kernels_take_nulls_and_unlike_lengths(spark):
    rows = [(0, [0.5, -1.0, None, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [70000.0, -1e-9, 0.0, 1.0, -3.0, 4.0, 5.0, 6.0, 7.0]), (5, [None])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = v.select("id", V.pack_half("v").alias("h"), V.int8_scale("v").alias("s"), V.pack_int8("v").alias("q"), V.pack_bits("v").alias("b")).orderBy("id").collect()
    assert got[0]["h"] == [0.5, -1.0, None, 2.0] and got[0]["q"] == [32, -64, None, 127] and got[0]["b"] == [0b10010000]
    assert tuple(got[1])[1:] == (None, None, None, None)
    assert (got[2]["h"], got[2]["s"], got[2]["q"], got[2]["b"]) == ([], None, [], [])
    assert got[3]["b"] == [0b11000000] and np.isnan(got[3]["h"][0])
    assert got[4]["h"][0] == float("inf") and got[4]["q"][0] == 127 and got[4]["b"] == [0b10010111, 0b10000000]
    assert got[5]["b"] == [0] and got[5]["s"] is None
    bits = v.select("id", V.unpack_bits(V.pack_bits("v"), 9).alias("u")).orderBy("id").collect()
    assert bits[4]["u"] == [1, -1, -1, 1, -1, 1, 1, 1, 1] and bits[1]["u"] is None and bits[2]["u"] == [-1] * 9
    assert [r[0] for r in v.orderBy("id").select(V.all_finite("v")).collect()] == [False, False, True, False, True, False]


def test_kernels_equal_numpy_over_many_batches(spark):
    x = np.random.default_rng(4).normal(size=(3000, 37)).astype(np.float32)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>").repartition(3)
    got = rows.select("id", V.pack_half("v").alias("h"), V.pack_int8("v").alias("q"), V.pack_bits("v").alias("b"), V.unpack_bits(V.pack_bits("v"), 37).alias("u")).orderBy("id").collect()
    assert np.array_equal([r["h"] for r in got], x.astype(np.float16))
    assert np.array_equal([r["b"] for r in got], np.packbits(x > 0, axis=1))
    assert np.array_equal([r["u"] for r in got], np.where(x > 0, 1, -1))
    top = np.abs(x).max(axis=1, keepdims=True)
    assert np.abs(np.array([r["q"] for r in got]) - x / top * 127).max() <= 0.5 + 1e-4


def test_vector_sums(spark, capsys, monkeypatch):
    rng = np.random.default_rng(1)
    x, groups, mask = rng.normal(size=(500, 6)), rng.integers(0, 9, 500), rng.integers(0, 2, 500)
    rows = [(None if g == 8 else f"g{g}", v.tolist(), float(m)) for g, v, m in zip(groups, x, mask)] + [("g0", None, 1.0), ("none", None, 1.0), ("zero", [1.0] * 6, 0.0), ("null", [1.0] * 6, None)]
    frames = spark.createDataFrame(rows, "g string, embedding array<double>, m double").repartition(4)
    for held in (1 << 20, 20):  # sums that don't fit are sent on early
        monkeypatch.setattr(pooling, "HELD", held)
        got = {r["g"]: r["vector"] for r in pooling.masked_mean(frames, "g", F.col("m")).collect()}
        for g in range(9):
            own = (groups == g) & (mask == 1)
            assert np.allclose(got[None if g == 8 else f"g{g}"], x[own].mean(axis=0))
        assert got["zero"] == got["null"] == [0.0] * 6 and "none" not in got
    pooling.mean_vector(frames, "g", F.col("embedding")).explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning") == 1 and "Generate" not in plan
    for bad in ([("a", [1.0]), ("a", [1.0, 2.0])], [("a", [1.0, None])]):
        with pytest.raises(Exception, match="differ in length|null components"):
            pooling.mean_vector(spark.createDataFrame(bad, "g string, embedding array<double>"), "g", F.col("embedding")).collect()


def test_poolings_are_aggregates(spark):
    x = np.random.default_rng(2).normal(size=(40, 5))
    frames = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)] + [(7, None)], "clip long, v array<double>")
    got = {r["clip"]: r["p"] for r in frames.groupBy("clip").agg(pooling.pooled("meanp")("v").alias("p")).collect()}
    unit = lambda y: y / np.linalg.norm(y, axis=-1, keepdims=True)
    assert got[7] is None and all(np.allclose(got[c], unit(unit(x[np.arange(40) % 3 == c]).mean(axis=0)), atol=1e-6) for c in range(3))
    with pytest.raises(ValueError, match="unknown"):
        pooling.pooled("none")


@pytest.mark.parametrize("signs,bound", [(False, 64 << 20), (True, 64 << 20), (False, 40_000)])
def test_bounds_skip_cells_and_change_nothing(spark, monkeypatch, signs, bound):
    """Clustered items with many exact ties, against brute force."""
    monkeypatch.setattr(search, "BROADCAST_BYTES", bound)
    x = np.round(clustered(3000, 12, 15), 2)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartitionByRange(3, "id")
    asked = items.where("id % 50 = 0")
    counter = {}
    got = {}
    for r in search.batch_topk(asked, items, 4, signs=signs, exclude_self=True, counter=counter).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    y = np.where(x > 0, 1.0, -1.0) if signs else x
    for q in range(0, 3000, 50):
        scores = (y[q] @ y.T + 12) / 2 if signs else np.round(y[q] @ y.T, 9)
        scores[q] = -np.inf
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(3000), -scores))[:4].tolist()
    assert counter["met"].value == 60 * 3000
    assert signs or counter["skipped"].value > 0.3 * counter["met"].value


@pytest.mark.parametrize("signs", [False, True])
def test_one_partition_of_many_queries_is_dealt(spark, monkeypatch, signs):
    """Vectors with copies, rounded so that scores tie, in one partition: chunks of queries meet shares of items in tasks of
    their own, and results are those of brute force."""
    monkeypatch.setattr(search, "MOST_SENT", 100)
    monkeypatch.setattr(search, "SHARE_BYTES", 60_000)
    x = np.round(clustered(1500, 12, 15), 1)
    x[200:500] = x[200]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    found = search.batch_topk(items, items, 4, signs=signs, exclude_self=True)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got, again = {}, {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    for r in search.rerank(items, items, 20, 4).collect() if signs else ():
        again.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    y = np.where(x > 0, 1.0, -1.0) if signs else x
    for q in range(1500):
        scores = (y[q] @ y.T + 12) / 2 if signs else np.round(y[q] @ y.T, 9)
        if signs:
            first = np.lexsort((np.arange(1500), -scores))[:20]
            assert [i for _, i in sorted(again[q])] == first[np.lexsort((first, -np.round(x[first] @ x[q], 9)))[:4]].tolist()
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:4]
        assert [i for _, i, _ in sorted(got[q])] == best.tolist() and [s for *_, s in sorted(got[q])] == scores[best].tolist()


def test_places_are_counted_by_bounds(spark):
    x = np.round(clustered(2000, 8, 10, 3), 2)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartitionByRange(2, "id")
    asked = items.where("id % 40 = 0")
    counter = {}
    truth = asked.select(F.col("id").alias("query_id"), F.pmod(F.col("id") * 7 + 3, F.lit(2000)).alias("item_id"))
    got = {r["query_id"]: (r["greater"], r["equal"], r["before"]) for r in search.truth_places(asked, items, truth, counter=counter).collect()}
    for q in range(0, 2000, 40):
        own, scores = (q * 7 + 3) % 2000, np.round(x[q] @ x.T, 9)
        same = scores == scores[own]
        assert got[q] == ((scores > scores[own]).sum(), same.sum(), same[:own].sum())
    assert counter["skipped"].value > 0.3 * counter["met"].value


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_range_numbers(spark, n):
    bounds = sorted({(i // 3, i % 3) for i in range(n)})
    value = F.struct((F.col("id") % 101).alias("a"), (F.col("id") % 3).alias("b"))
    got = spark.range(400).select((F.col("id") % 101).alias("a"), (F.col("id") % 3).alias("b"), dataset.range_number(value, [f'{{"a":{a},"b":{b}}}' for a, b in bounds], "struct<a:bigint,b:bigint>").alias("k")).collect()
    assert all(r["k"] == bisect.bisect_right(bounds, (r["a"], r["b"])) for r in got)


def test_captions_are_cleaned(spark):
    rows = spark.createDataFrame([(0, "  A &amp;lt;b&amp;gt;\n\tTOM &amp; Jerry&nbsp;"), (1, None), (2, "")], "id long, t string")
    assert [r[0] for r in rows.orderBy("id").select(text.basic_clean(F.col("t"))).collect()] == ["a <b> tom & jerry", None, ""]


def vectors_of(spark, x):
    return spark.createDataFrame([(i, f"v{i}", f"c{i}", None if v is None else [float(f) if f is not None else None for f in v]) for i, v in enumerate(x)], "row_index long, video_id string, caption string, embedding array<float>")


@pytest.mark.parametrize("bad", [[[1, 0], None], [[None, 1], [0, 1]], [[float("nan"), 1]], [[1, 0], [1, 0, 0]]])
def test_import_refuses_missing_vectors_and_leaves_the_store(spark, tmp_path, bad):
    store = Store(spark, str(tmp_path / "s"))
    store.import_vectors(vectors_of(spark, [[1, 0], [0, 1]]))
    with pytest.raises(ValueError, match="null|finite|length"):
        store.import_vectors(vectors_of(spark, bad), overwrite=True)
    assert store.manifest()["count"] == 2 and [r["embedding"] for r in store.vectors().orderBy("row_index").collect()] == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "t")).import_vectors(vectors_of(spark, bad))
    assert not Store(spark, str(tmp_path / "t")).is_store()


def test_a_crash_leaves_the_last_good_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    rows = vectors_of(spark, [[1, 0], [0, 1], [1, 1]])
    store.initialize(rows.select("row_index", "video_id", F.col("video_id").alias("path"), "caption"), {"model": "m"}, 2)
    encoded = rows.select("row_index", "video_id", "embedding", F.lit(None).cast("string").alias("error"))
    store.append(encoded.where("row_index = 0"))
    before = store.manifest()

    def crash(*_):
        raise OSError("stopped here")

    with monkeypatch.context() as m:  # data is written, the commit doesn't come
        m.setattr(store, "_commit", crash)
        with pytest.raises(OSError):
            store.append(encoded.where("row_index = 1"))
    assert store.manifest() == before and store.stored().count() == 1 and store.pending().count() == 2
    with monkeypatch.context() as m:  # the draft is there, the rename doesn't come
        fs, target = store._fs(f"log/.{'0' * 32}")
        fs.create(target, False).close()
    assert store.manifest() == before
    store.append(encoded)  # a repeated batch adds what is missing
    store.append(encoded)
    assert store.finish()["completed_count"] == 3 and store.manifest()["status"] == "complete"
    folders = len(os.listdir(tmp_path / "s" / "vectors"))
    store.clean()
    assert len(os.listdir(tmp_path / "s" / "vectors")) == folders - 1 and store.stored().count() == 3


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.import_vectors(vectors_of(spark, [[1, 0]]))
    monkeypatch.setattr(store, "_numbers", lambda: [0])
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit({"parts": {}})
    monkeypatch.undo()
    assert store.manifest()["count"] == 1


@pytest.mark.parametrize("packing", V.PACKINGS)
def test_matrices_are_what_numpy_reads(spark, tmp_path, packing):
    x = np.random.default_rng(5).normal(size=(200, 20)).astype(np.float32)
    store, target = Store(spark, str(tmp_path / "s")), str(tmp_path / "m")
    rows = vectors_of(spark, x)
    store.initialize(rows.select("row_index", "video_id", F.lit("p").alias("path"), "caption"), {}, 20)
    store.append(rows.where("row_index % 7 <> 3").select("row_index", "video_id", "embedding", F.lit(None).cast("string").alias("error")).repartition(5))
    store.export(target, packing)
    done = np.arange(200) % 7 != 3
    got, mask = np.load(f"{target}/embeddings.npy"), np.load(f"{target}/completed.npy")
    assert np.array_equal(mask, done) and mask.dtype == bool and not got[~done].any()
    top = np.abs(x).max(axis=1, keepdims=True)
    wanted = {"float32": x, "float16": x.astype(np.float16), "binary": np.packbits(x > 0, axis=1)}.get(packing)
    if packing == "int8":
        scales = np.load(f"{target}/scales.npy")
        assert scales.dtype == np.float32 and np.allclose(got[done] * scales[done, None], x[done], atol=float(top.max()) / 200)
    else:
        assert got.dtype == wanted.dtype and np.array_equal(got[done], wanted[done]) and not os.path.exists(f"{target}/scales.npy")
    with pytest.raises(Exception, match="exists"):
        store.export(target, packing)
    store.export(target, packing, overwrite=True)
    assert np.array_equal(np.load(f"{target}/embeddings.npy"), got) and sorted(os.listdir(tmp_path)) == ["m", "s"]


def test_an_aborted_matrix_leaves_nothing(spark, tmp_path):
    npy.register(spark)
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(10)], "row_index long, embedding array<float>").repartition(3)
    with pytest.raises(Exception, match="aren't of a matrix"):
        rows.write.format("npy").mode("append").option("rows", 9).option("width", 2).save(str(tmp_path / "m"))
    assert os.listdir(tmp_path) == []
    rows.where("false").write.format("npy").mode("append").option("rows", 4).option("width", 2).save(str(tmp_path / "m"))
    assert np.load(tmp_path / "m" / "embeddings.npy").shape == (4, 2) and not np.load(tmp_path / "m" / "completed.npy").any()
    assert spark.read.format("npy").load(str(tmp_path / "m" / "embeddings.npy")).count() == 4
