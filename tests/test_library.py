import glob
import json
import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vantle import cli, plans
from vantle.functions import bpe, frames, sizes
from vantle.functions import vectors as V
from vantle.operators import dataset, ranking, search
from vantle.operators.build import build
from vantle.operators.config import IMAGE_MEAN, BuildConfig, EncoderConfig, Preprocess, build_config, encoder_config, encoder_of
from vantle.operators.encoders import available, device_of, encode_items, get_pooling, prepared, register_encoder, sampled
from vantle.operators.store import Store
from vantle.sources import captions, npy
from vantle.streaming.build import build_stream

DATA = "/root/testdata/sf0.001"


def units(rows, dim, seed=0):
    x = np.random.default_rng(seed).normal(size=(rows, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_sampled_frames_and_deltas(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    sample = lambda n, fps, rate, most: pick(frames.sampled_frames(F.lit(n).cast("long"), F.lit(fps), F.lit(rate), F.lit(most)))
    assert sample(300, 30.0, 1.0, 5) == [0, 60, 120, 180, 270]
    assert sample(7, 5.0, 10.0, 4) == [0, 2, 4, 6]
    assert sample(0, 30.0, 1.0, 5) == []
    for length, wanted, found in ((12, 3, [1, 6, 11]), (12, 1, [1]), (3, 3, [1, 2]), (1, 3, []), (12, 0, [])):
        assert pick(frames.delta_positions(F.lit(length), wanted)) == found
    assert pick(frames.key_positions(F.lit(3))) == [0] and pick(frames.key_positions(F.lit(0))) == []
    every = lambda *x: pick(frames.per_second_frames(*map(F.lit, x)))
    assert every(50, 24, 1, 0, 9) == [0, 24, 48] and every(50, 24, 1, 4, 2) == every(50, 24, 0, 0, 2) == []
    for count, fps, rate, most in ((300, 30.0, 1.0, 5), (7, 5.0, 10.0, 4), (100, 29.97, 2.0, 12), (0, 30.0, 1.0, 5)):
        assert sampled(count, fps, rate, most).tolist() == sample(count, fps, rate, most)


def test_budgets(spark):
    texts = {"2GB": 2 * 10**9, "2GiB": 2**31, "512mib": 2**29, "4096": 4096, " .5 KB ": 500, "1.5 kb": 1500, "": None, "2 parsecs": None, "0": None, "1.": None, "1.2.3": None, "-1": None, ".": None, "kb": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sizes.parse_budget(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in rows} == texts
    for bad in ("", "2 parsecs", "0"):
        with pytest.raises(Exception, match="no size|unknown unit|less than one byte"):
            spark.range(1).select(sizes.checked_budget(F.lit(bad))).collect()
    human = spark.createDataFrame([(n,) for n in (1023, 1024, 2**40 * 2000)], "n long").select(sizes.readable(F.col("n")).alias("r")).collect()
    assert [r["r"] for r in human] == ["1023.00 B", "1.00 KiB", "2000.00 TiB"]
    report = sizes.capacity_report(spark.createDataFrame([(p,) for p in V.PACKINGS], "packing string"), F.lit(2**31), F.lit(0.0)).collect()
    assert {r["packing"]: r["max_items"] for r in report} == {"float32": 1048576, "float16": 2097152, "int8": 2**31 // 516, "binary": 33554432}
    assert report[0]["max_items_human"] == "1,048,576" and report[0]["bytes_for_2000"] == 4096000


def test_rows_are_numbered_gapless_with_wide_columns(spark):
    """At a size where ranges and partitions differ between plans."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = dataset.reindexed(docs, "doc_id").agg(F.count("*"), F.count("row_index"), F.countDistinct("row_index"), F.min("row_index"), F.max("row_index"), F.max(F.length("text"))).first()
    n = docs.count()
    assert tuple(found)[:5] == (n, n, n, 0, n - 1)
    rows = dataset.reindexed(docs, "doc_id").orderBy("row_index").select("doc_id").limit(500).collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_losses_by_hand(spark):
    """Two pairs with scores [[2, 1], [0, 3]]."""
    scores = spark.createDataFrame([(0, q, v, x) for q, row in enumerate([[2.0, 1.0], [0.0, 3.0]]) for v, x in enumerate(row)], "batch long, q long, v long, score double")
    e = np.exp
    expected = np.mean([np.log(e(2) + e(1) + e(0)) - 2, np.log(e(0) + e(3) + e(1)) - 3])
    assert np.isclose(ranking.nce_loss(scores).first()["loss"], expected)
    # margin 2: hinges are 4 on each diagonal, (2 + 1 - 2) + (2 + 1 - 3) and (2 + 0 - 3 -> 0) + (2 + 0 - 2) beside it
    assert np.isclose(ranking.margin_loss(scores, 2.0).first()["loss"], (4 + 4 + 1 + 0) / 4)
    assert np.isclose(ranking.margin_loss(scores, 2.0, pairs=2).first()["loss"], (4 + 4 + 1 + 0) / 4)


def test_group_places_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    group = rng.integers(0, 9, 4000)
    x, v = np.round(rng.normal(size=(4000, 6)), 1), np.round(rng.normal(size=(9, 6)), 1)
    sentences = spark.createDataFrame([(int(g), r.tolist()) for g, r in zip(group, x)], "group_id long, vector array<double>")
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, vector array<double>")
    best = np.stack([np.round(x[group == g] @ v.T, 9).max(axis=0) for g in range(9)])
    found = {r["item_id"]: (r["greater"], r["equal"], r["before"]) for r in search.group_places(sentences, items).collect()}
    for i in range(9):
        mine = best[i, i]
        assert found[i] == ((best[:, i] > mine).sum(), (best[:, i] == mine).sum(), (best[:i, i] == mine).sum())


def test_packings_equal_numpy(spark):
    x = units(40, 32, 3)
    row = frame_of(spark, x).select("vec_id", V.pack_half("embedding").alias("h"), V.pack_int8("embedding").alias("q"), V.pack_bits("embedding").alias("b")).orderBy("vec_id").collect()
    top = np.abs(x).max(axis=1, keepdims=True)
    assert np.array_equal(np.array([r["h"] for r in row]), x.astype(np.float16).astype(np.float64))
    assert np.array_equal(np.array([r["q"] for r in row]), np.clip(np.rint(x / top * 127), -127, 127))
    assert np.array_equal(np.array([r["b"] for r in row]), np.packbits(x > 0, axis=1))


def test_batch_search_equals_single(spark):
    x = units(64, 16, 5)
    rows = frame_of(spark, x)
    many = search.batch_topk(rows, rows, 5).where("query_id = 7").orderBy("rank").collect()
    one = search.topk(rows, search.exact_score(x[7].tolist()), 5).orderBy("rank").collect()
    assert [r["item_id"] for r in many] == [r["vec_id"] for r in one]
    with pytest.raises(ValueError):
        search.topk(rows, search.exact_score(x[7].tolist()), 0)
    with pytest.raises(Exception, match="differ in length"):
        search.topk(rows, search.exact_score([1.0, 2.0]), 5).collect()


def test_batch_search_over_the_broadcast_bound(spark, monkeypatch):
    """Beyond the bound query chunks meet item shares by an equi-join; the result stays the same."""
    x = units(3000, 8, 6)
    rows = frame_of(spark, x).repartition(5)
    plain = search.batch_topk(rows, rows, 3, exclude_self=True).collect()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1 << 15)
    monkeypatch.setattr(search, "HELD", 5000)
    dealt = search.batch_topk(rows, rows, 3, exclude_self=True)
    assert "CartesianProduct" not in dealt._jdf.queryExecution().toString() and sorted(dealt.collect()) == sorted(plain)
    with pytest.raises(Exception, match="differ in length"):
        search.batch_topk(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, v array<double>").coalesce(1), rows, 3).collect()


def _split(path, rows):
    path.write_text("\ufeffvideo_id,sentence\n" + "".join(f"{i},{c}\n" for i, c in rows))
    return str(path)


def test_store_round_trip(spark, tmp_path, capsys):
    x = units(20, 32, 1)
    np.save(tmp_path / "v.npy", x * 7.5)
    npy.register(spark)
    rows = spark.read.format("npy").load(str(tmp_path / "v.npy"))
    split = captions.read_split(spark, _split(tmp_path / "split.csv", [(f"video{i}", f"caption {i}") for i in range(20)]))
    store = Store(spark, str(tmp_path / "store"))
    report = store.import_vectors(rows.join(split, "row_index"), normalize=True)
    assert report["count"] == 20 and not report["source_normalized"] and store.manifest()["renormalized_on_import"]
    found = store.vectors().orderBy("row_index").collect()
    assert np.allclose([r["embedding"] for r in found], x, atol=1e-6) and found[3]["caption"] == "caption 3"
    sizes_, texts = {}, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_index long, embedding array<float>")
    for packing in V.PACKINGS:
        packed = store.pack(str(tmp_path / packing), packing)
        values = np.array([r["embedding"] for r in packed.vectors().orderBy("row_index").collect()])
        cosine = (values * x).sum(axis=1) / np.linalg.norm(values, axis=1)
        assert cosine.min() > (0.5 if packing == "binary" else 0.99)
        assert packed.search(x[4].tolist(), 3).orderBy("rank").first()["video_id"] == "video4"
        sizes_[packing] = packed.evaluate(texts)
        assert sizes_[packing]["R@1"] == 100 and sizes_[packing]["MedianR"] == 1 and sizes_[packing]["queries"] == 20
    told = {r["packing"]: r for r in store.compare(5)["packings"]}
    agree = [told[p]["neighbour_agreement_at_5"] for p in V.PACKINGS]
    assert agree[0] == 1 and agree[1] >= agree[2] > agree[3] and told["binary"]["mean_cosine_to_float32"] is None
    assert told["int8"]["mean_cosine_to_float32"] > 0.99 and told["float32"]["vector_file_bytes"] == 20 * 32 * 4 + 128
    assert store.metadata_bytes()["bytes_per_item"] == store.metadata_bytes()["total_bytes"] / 20 > 0
    with pytest.raises(FileExistsError):
        store.import_vectors(rows.join(split, "row_index"))
    with pytest.raises(ValueError):
        store.pack(store.path, "int8")
    with pytest.raises(ValueError, match="configuration"):
        store.resume(split, {"model": "other"})
    with pytest.raises(ValueError, match="components"):
        store.evaluate(texts.select("row_index", F.slice("embedding", 1, 3).alias("embedding")))
    with pytest.raises(ValueError, match="19 text vectors"):
        store.evaluate(texts.where("row_index > 0"))
    with pytest.raises(ValueError, match="shape"):
        captions.text_vectors(spark, str(tmp_path / "v.npy"), 16)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(FileExistsError, match="something else"):
        Store(spark, str(tmp_path / "other")).import_vectors(rows.join(split, "row_index"), overwrite=True)
    np.save(tmp_path / "t.npy", x)
    for argv in (["evaluate", "--db", store.path, "--text-vectors", str(tmp_path / "t.npy")], ["compare", "--db", store.path], ["estimate", "--budget", "2GiB", "--db", store.path], ["estimate"], ["encoders", "--json"]):
        assert cli.main(argv) == 0
        json.loads(capsys.readouterr().out.splitlines()[-1])


def test_build_and_resume(spark, tmp_path):
    for i in range(3):
        np.save(tmp_path / f"video{i}.npy", np.full((3, 2, 2, 3), i))
        (tmp_path / f"video{i}.mp4").write_bytes(b"")
    state = {"broken": True}

    def decode(path, broken=True):
        if broken and "video1" in path:
            raise OSError("broken")
        return np.load(path.removeprefix("file:").replace(".mp4", ".npy"))

    target, config = str(tmp_path / "db"), build_config(encoder={"device": "cpu"}, build={"max_frames": 2})
    split = _split(tmp_path / "split.csv", [("video1", "one"), ("video1.mp4", "again"), ("missing", "x"), ("video2.mp4", "two"), ("video2", "x"), ("video0", "zero")])
    report = build(spark, str(tmp_path), target, config, split, decode=decode)
    store = Store(spark, target)
    assert (report["requested_count"], report["completed_count"], report["failed_this_run"], report["missing_from_csv"], report["frames_this_run"]) == (3, 2, 1, 1, 4)
    rows = {r["video_id"]: r for r in store.vectors().collect()}
    assert [(r["video_id"], r["caption"]) for r in sorted(rows.values())] == [("video1", "one"), ("video2", "two"), ("video0", "zero")]
    assert store.manifest()["status"] == "partial" and not rows["video1"]["completed"] and store.failures().first()["error"] == "broken"
    with pytest.raises(ValueError, match="aren't done"):
        store.evaluate(store.listing().select("row_index", F.array(F.lit(1.0)).alias("embedding")))
    with pytest.raises(FileExistsError):
        build(spark, str(tmp_path), target, config, split, decode=decode)
    for other in ({"image_size": 32}, {"model": "other"}):
        with pytest.raises(ValueError, match="another configuration"):
            build(spark, str(tmp_path), target, build_config(encoder=other, build={"max_frames": 2}), split, resume=True, decode=decode)
    with pytest.raises(ValueError, match="other items"):
        build(spark, str(tmp_path), target, config, None, resume=True, decode=decode)
    again = build_config(encoder={"device": "auto"}, build={"max_frames": 2})
    report = build(spark, str(tmp_path), target, again, split, resume=True, decode=lambda p: decode(p, False))
    assert (report["completed_count"], report["failed_this_run"], store.manifest()["status"]) == (3, 0, "complete") and state
    assert np.allclose([np.linalg.norm(r["embedding"]) for r in store.vectors().collect()], 1)
    with pytest.raises(FileNotFoundError):
        build(spark, str(tmp_path), str(tmp_path / "none"), config, split, resume=True, decode=decode)
    with pytest.raises(FileNotFoundError, match="missing"):
        build(spark, str(tmp_path), str(tmp_path / "none"), config, split, strict=True, decode=decode)


def test_stream_batches_may_be_replayed(spark, tmp_path):
    items = tmp_path / "in"
    spark.createDataFrame([(i, f"v{i}", f"/{i}") for i in range(4)], "row_index long, video_id string, path string").coalesce(1).write.json(str(items))
    store = Store(spark, str(tmp_path / "db"))

    def decode(path):
        if path == "/1":
            raise OSError("broken")
        return np.ones((2, 2, 2, 3))

    for run in range(2):  # a lost checkpoint replays every batch
        stream = spark.readStream.schema("row_index long, video_id string, path string").json(str(items))
        build_stream(stream, store, decode, str(tmp_path / f"checkpoint{run}")).awaitTermination()
        assert store.stored().count() == 3 and store.listing().count() == 4
        assert (store.manifest()["status"], store.manifest()["embedding_dim"]) == ("partial", 4)


def test_all_items_of_a_stream_may_fail(spark, tmp_path):
    spark.createDataFrame([(0, "v", "/0")], "row_index long, video_id string, path string").write.json(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema("row_index long, video_id string, path string").json(str(tmp_path / "in"))
    build_stream(stream, store, lambda p: [][0], str(tmp_path / "checkpoint")).awaitTermination()
    assert [r["completed"] for r in store.vectors().collect()] == [False]


def test_configuration(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"encoder": {"model": "m", "device": "cpu"}, "build": {"max_frames": 3, "frame_rate": 2.0}}))
    config = build_config(str(path), {"model": "x", "device": None}, {"frame_rate": 4.0, "max_frames": None})
    assert (config.encoder.model, config.encoder.device, config.max_frames, config.frame_rate, config.decode_workers) == ("x", "cpu", 3, 4.0, 4)
    for text in ('{"encoder": {"modle": 1}}', '{"build": {"frames": 1}}', '{"other": {}}', "[]"):
        path.write_text(text)
        with pytest.raises(ValueError):
            build_config(str(path))
    assert encoder_of({"config": {"encoder": {"model": "m"}}}).model == "m"
    assert encoder_of({"config": {"model_id": "old", "device": "cpu", "image_size": 9}}) == EncoderConfig(model="old", device="cpu", image_size=9)
    assert encoder_of({}) == EncoderConfig()
    own = EncoderConfig(image_size=8, image_std=(1, 1, 1)).over(Preprocess())
    assert (own.image_size, own.mean, own.std) == (8, IMAGE_MEAN, (1.0, 1.0, 1.0))
    for bad in ({"image_size": 0}, {"std": (1.0, 0.0, 1.0)}, {"mean": (1.0,)}, {"resize_mode": "x"}):
        with pytest.raises(ValueError):
            Preprocess(**bad)
    assert device_of(encoder_config({})) == ("cpu", "float32") and device_of(encoder_config({}), True) == ("cuda", "float16")
    with pytest.raises(RuntimeError):
        device_of(encoder_config({"device": "cuda"}))
    with pytest.raises(ValueError):
        device_of(encoder_config({"precision": "float16"}))


def test_frames_are_prepared():
    plain = Preprocess(image_size=6, mean=(0.0,) * 3, std=(1.0,) * 3)
    assert prepared(np.full((9, 12, 3), 255, np.uint8), plain).shape == (3, 6, 6) and np.allclose(prepared(np.full((9, 12, 3), 255, np.uint8), plain), 1)
    frame = np.zeros((6, 18, 3), np.uint8)
    frame[:, 6:12, 0] = 255  # blue in the middle: the crop holds it, stretching shows a third
    assert np.allclose(prepared(frame, plain)[2], 1) and np.allclose(prepared(frame, plain)[:2], 0)
    stretched = prepared(frame, Preprocess(6, (0.0,) * 3, (1.0,) * 3, "stretch"))
    assert 0.2 < stretched[2].mean() < 0.5
    assert prepared(frame, Preprocess(6, (0.5,), (0.5,), channels=1)).shape == (1, 6, 6)
    with pytest.raises(ValueError):
        prepared(np.zeros((4, 4), np.uint8), plain)


def test_caption_documents(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "video_id string")
    (tmp_path / "words.json").write_text(json.dumps({"a": [["x", "y"], ["z"]], "b": [["w"]], "c": [["v"]]}))
    found = captions.read_word_lists(spark, str(tmp_path / "words.json"), ids).orderBy("video_id", "place").collect()
    assert [(r["video_id"], r["caption"]) for r in found] == [("a", "x y"), ("a", "z"), ("b", "w")]
    with pytest.raises(Exception, match="no captions of q"):
        captions.read_word_lists(spark, str(tmp_path / "words.json"), spark.createDataFrame([("q",)], "video_id string")).collect()
    (tmp_path / "timed.json").write_text(json.dumps([{"video": "a", "description": "one", "times": [[0, 1], [1, 2]]}, {"video": "c", "description": "no", "times": [[0, 0]]}, {"video": "a", "description": "two", "times": [[2, 2]]}]))
    timed = captions.read_timed(spark, str(tmp_path / "timed.json"), ids)
    assert [tuple(r)[3:] for r in timed.orderBy("place").collect()] == [(2.5, 12.5), (10.0, 15.0)]
    assert tuple(captions.timed_paragraphs(timed).first()) == ("a", 0.0, 31.0, "one two")
    (tmp_path / "doc.json").write_text(json.dumps({"sentences": [{"video_id": "a", "caption": 'say "x", y'}, {"video_id": "z", "caption": "n"}], "videos": [{"video_id": "a", "url": "http://h/?v=k"}]}))
    assert captions.read_video_json(spark, str(tmp_path / "doc.json")).first()["parent"] == "k"
    captions.caption_csv(captions.read_caption_json(spark, str(tmp_path / "doc.json")), ids, str(tmp_path / "out"))
    assert [tuple(r) for r in captions.read_split(spark, str(tmp_path / "out")).collect()] == [(0, "a", 'say "x", y')]
    (tmp_path / "videos" / "deep").mkdir(parents=True)
    for name in ("a.mp4", "b", "deep/b.webm", "deep/a.MP4"):
        (tmp_path / "videos" / name).write_bytes(b"x")
    by_stem = captions.walked(spark, str(tmp_path / "videos"), ids).collect()
    assert sorted(r["video_id"] for r in by_stem) == ["a", "b"]
    assert [r["video_id"] for r in captions.walked(spark, str(tmp_path / "videos"), ids, whole_name=True).collect()] == ["b"]
    assert {r["stem"] for r in captions.discover(spark, str(tmp_path / "videos")).collect()} == {"a", "b"}
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "b.webm").write_bytes(b"")
    folder = str(tmp_path / "flat")
    paths = {r["video_id"]: r["path"] for r in captions.resolved(ids, folder, captions.files_below(spark, folder)).collect()}
    assert paths == {"a": folder + "/a.mp4", "b": folder + "/b.webm"}
    assert captions.resolved(ids, "/x").first()["path"] == "/x/a.mp4"
    items, missing = captions.discover_items(spark, str(tmp_path / "videos"), limit=2)
    assert [r["row_index"] for r in items.orderBy("row_index").collect()] == [0, 1] and missing.isEmpty()


def test_encoders(spark):
    items = spark.createDataFrame([(i, f"video{i}", f"/{i}") for i in range(3)], "row_index long, video_id string, path string")

    def decode(path):
        if path == "/1":
            raise OSError("broken")
        return np.ones((3, 2, 2))

    found = {r["video_id"]: r for r in encode_items(items, decode, BuildConfig(max_frames=2)).collect()}
    assert found["video1"]["error"] == "broken" and found["video1"]["embedding"] is None and found["video0"]["frames"] == 2
    assert np.isclose(np.linalg.norm(found["video0"]["embedding"]), 1)
    assert np.allclose(get_pooling("MEANP")(np.array([[3.0, 0], [0, 4.0]])), np.ones(2) / np.sqrt(2))
    assert "stub" in available()["encoders"]
    with pytest.raises(ValueError):
        register_encoder("Stub")(object)


def test_bpe():
    ranks = {("t", "h"): 0, ("th", "e</w>"): 1}
    assert bpe.pieces("the", ranks) == ["the</w>"]
    assert bpe.decode(bpe.pieces("the", {}) + bpe.pieces("end", {})) == "the end "
    assert sorted(map(ord, bpe.LETTERS))[-1] == 256 + 67 and len(set(bpe.LETTERS)) == 256 and bpe.LETTERS[32] == chr(256 + 32)
    merges = [("t", "h"), ("th", "e</w>")]
    place, known = bpe.vocabulary(merges), {}
    assert (len(place), place["!"], place["!</w>"], place["th"], place["<|endoftext|>"]) == (516, 0, 256, 512, 515)
    for text in ("the café costs ½ or 3_4", "naïve 中文 😀", "it's the <|endoftext|> end"):
        found = bpe.tokens(text, {m: i for i, m in enumerate(merges)}, known)
        assert bpe.decode_ids([place[p] for p in found], merges).replace(" ", "").replace("<|endoftext|>", "") == text.replace(" ", "").replace("<|endoftext|>", "")
    assert bpe.tokens("½", {}, {}) == [bpe.LETTERS[0xC2], bpe.LETTERS[0xBD] + "</w>"]


def test_pieces_of_a_batch_are_not_held():
    """Memory follows a few texts, not the batch; counts are those of the lists."""
    merges = [("t", "h"), ("th", "e</w>"), ("a", "n"), ("an", "d</w>")]
    texts = ["the band it's ½ <|endoftext|> <|EndOfText|> ''s <<|!'s 中文", None, ""] + ["the sand and these bands of 12 thieves " * 1000] * 200
    ranks = {m: i for i, m in enumerate(merges)}
    expected = [len(bpe.tokens(t or "", ranks, {})) for t in texts]
    for udf, size, most in ((bpe.counts(merges), lambda x: x, 8 << 20), (bpe.encode(merges, ids=True), len, 40 << 20)):
        tracemalloc.start()
        (found,) = udf.func(iter([pa.array(texts)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [size(x) for x in found.to_pylist()] == expected and peak < most


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    plain = lambda v: f"{v + 0.0:.9g}" if isinstance(v, float) else repr(v)
    ours = plans.queries()[name](spark, DATA)
    columns = sorted(ours.columns)
    theirs = con.sql(plans.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = con.sql(f"SELECT {quoted} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in ours.select(columns).collect()) == sorted(tuple(map(plain, r)) for r in expected)
