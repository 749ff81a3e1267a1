"""Coded video, listings, clips on a stream and progress, against plain expectations."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantle.operators import pooling
from vantle.operators.build import build
from vantle.operators.config import build_config
from vantle.operators.store import Store
from vantle.sources import captions, compressed
from vantle.streaming.build import build_stream
from vantle.streaming.clips import pooled_clips


def coded(rng, groups, least=1):
    """A stream's bytes and its frames (gop, frame, kind, payload); payloads hold zeros and ones, but no start code."""
    parts, out = [b"\x00\x00\x01\xb0\x01", b"\x00\x00\x01\x20" + bytes(rng.integers(2, 256, 12, dtype=np.uint8))], []
    for gop in range(groups):
        if rng.random() < 0.5:
            parts.append(b"\x00\x00\x01\xb3\x00\x10\x07")
        for frame in range(int(rng.integers(least, 13))):
            kind = "I" if frame == 0 else "PBS"[int(rng.choice(3, p=[0.7, 0.2, 0.1]))]
            body = bytes(rng.integers(0, 256, int(rng.integers(1, 400)), dtype=np.uint8)).replace(b"\x00\x00", b"\x00\x05")
            payload = b"\x00\x00\x01\xb6" + bytes([compressed.KINDS.index(kind) << 6 | int(rng.integers(1, 64))]) + body + b"\x07"
            parts.append(payload)
            out.append((gop, frame, kind, payload))
    return b"".join(parts), out


@pytest.fixture(scope="module")
def videos(spark, tmp_path_factory):
    folder, rng, expected = tmp_path_factory.mktemp("videos"), np.random.default_rng(8), set()
    for name, groups in (("a.m4v", 60), ("b.m4v", 1), ("c ä+.m4v", 17)):
        data, found = coded(rng, groups)
        (folder / name).write_bytes(data)
        expected |= {(f"file:{folder}/{name}", *f) for f in found}
    (folder / "none.m4v").write_bytes(b"\x00\x00\x01\xb6\x41\x02\x03" * 9)
    (folder / "empty.m4v").write_bytes(b"")
    return spark, captions.files_below(spark, str(folder)), expected


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_coded_frames_are_those_of_the_files(videos, tmp_path, range_bytes):
    spark, files, expected = videos
    got = compressed.read(spark, files, str(tmp_path / "index"), range_bytes).select("path", "gop", "frame", "kind", "payload", "offset").collect()
    assert {tuple(r)[:4] + (bytes(r["payload"]),) for r in got} == expected and len(got) == len(expected)
    for r in got[:: max(1, len(got) // 40)]:
        with open(r["path"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            assert f.read(len(r["payload"])) == bytes(r["payload"])


def test_filters_leave_out_ranges(videos, tmp_path):
    spark, files, expected = videos
    rows = compressed.read(spark, files, str(tmp_path / "index"), 2000)
    ranges = spark.read.parquet(str(tmp_path / "index")).collect()
    assert rows.rdd.getNumPartitions() == len(ranges) > 20
    a = next(p for p, *_ in expected if p.endswith("a.m4v"))
    plain = lambda keep: {(p, g, f, k) for p, g, f, k, _ in expected if keep(p, g, f, k)}
    for condition, keep in (
        (f"path = '{a}' and gop >= 10 and gop < 13", lambda p, g, f, k: p == a and 10 <= g < 13),
        ("gop = 3 and kind = 'I'", lambda p, g, f, k: g == 3 and k == "I"),
        ("gop in (2, 30) and kind in ('P', 'B')", lambda p, g, f, k: g in (2, 30) and k in "PB"),
        ("gop > 55 and frame < 4", lambda p, g, f, k: g > 55 and f < 4),
        ("gop <= 0 and kind <> 'I'", lambda p, g, f, k: g <= 0 and k != "I"),
        ("gop = 5 and gop = 6", lambda *_: False),
        ("path = 'nowhere'", lambda *_: False),
    ):
        found = rows.where(condition)
        assert {tuple(r) for r in found.select("path", "gop", "frame", "kind").collect()} == plain(keep), condition
    assert rows.where("gop > 55").rdd.getNumPartitions() < 12 and rows.where(f"path = '{a}' and gop = 7").rdd.getNumPartitions() <= 2


def test_units_of_a_clip(videos, tmp_path):
    spark, files, expected = videos
    rows = compressed.read(spark, files, str(tmp_path / "index"))
    keys = {(r["path"], r["gop"]) for r in compressed.units(rows, "I", 1).collect()}
    assert keys == {(p, g) for p, g, f, k, _ in expected if k == "I"}
    sizes = {}
    for p, g, *_ in expected:
        sizes[p, g] = sizes.get((p, g), 0) + 1
    wanted = {(p, g, int(f)) for (p, g), n in sizes.items() for f in np.arange(1, n)[np.unique(np.linspace(0, n - 2, min(3, n - 1), dtype=int))] if n > 1}
    assert {(r["path"], r["gop"], r["frame"]) for r in compressed.units(rows, "delta", 3).collect()} == wanted


def test_listing_goes_level_by_level(spark, tmp_path):
    names = ["a.mp4", "x/b.MP4", "x/y/z/c d+é%20.webm", "x/y/empty.txt", ".hidden.mp4", "x/_under.mp4"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"12" * len(n))
    (tmp_path / "x" / "none").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = {(r["path"], r["length"], r["name"], r["extension"]) for r in captions.files_below(spark, root).collect()}
        assert got == {(f"file:{tmp_path}/{n}", 2 * len(n), os.path.basename(n), os.path.splitext(n)[1].lower() if not n.startswith(".hidden") else ".mp4") for n in names}
    assert captions.files_below(spark, str(tmp_path / "x" / "none")).count() == 0


def test_clips_leave_when_their_last_second_has_come(spark, tmp_path):
    rng = np.random.default_rng(6)
    lengths = {"a": 5, "b": 1, "c": 40, "never": 3}
    frames = [(c, s, n, rng.normal(size=7).tolist()) for c, n in lengths.items() for s in range(n) if (c, s) != ("never", 2)]
    whole = [frames[i] for i in rng.permutation(len(frames))]
    whole += [whole[0], ("a", 9, 5, [1.0] * 7), ("b", 0, 1, [9.0] * 7), ("c", None, 40, [1.0] * 7), ("never", 2, 3, None), (None, 0, 1, [1.0])]
    schema = "clip string, second int, seconds int, embedding array<double>"
    for k in range(4):  # a file is a batch
        spark.createDataFrame(whole[k::4], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = pooled_clips(stream).writeStream.foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    plain = {r["clip"]: r["vector"] for r in pooling.mean_pool(spark.createDataFrame([f for f in frames if f[0] != "never"], schema), "clip").collect()}
    found = {clip: (n, vector) for _, clip, n, vector in got}
    assert set(found) == {"a", "b", "c"} and len(got) == 3 and len({b for b, *_ in got}) > 1
    for clip, (n, vector) in found.items():
        if clip != "b":  # of a second that comes again, the first counts
            assert n == lengths[clip] and np.allclose(vector, plain[clip], atol=1e-6)


def test_progress_of_batches(spark, tmp_path):
    for i in range(7):
        np.save(tmp_path / f"v{i}.npy", np.full((3, 2, 2, 3), i))
        (tmp_path / f"v{i}.mp4").write_bytes(b"")

    def decode(path):
        if "v5" in path:
            raise OSError("broken")
        return np.load(path.removeprefix("file:").replace(".mp4", ".npy"))

    told = []
    report = build(spark, str(tmp_path), str(tmp_path / "db"), build_config(), decode=decode, progress=told.append, batch_items=3)
    assert [t["batch"] for t in told] == [0, 1, 2] and told[-1]["attempted"] == told[-1]["total"] == 7 and told[-1]["failed_this_run"] == 1
    assert (report["completed_count"], report["frames_this_run"]) == (6, told[-1]["frames_this_run"])
    assert len(Store(spark, str(tmp_path / "db")).manifest()["parts"]["vectors"]) == 3

    spark.createDataFrame([(i, f"v{i}", f"file:{tmp_path}/v{i}.mp4") for i in range(4)], "row_index long, video_id string, path string").repartition(2).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_index long, video_id string, path string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []
    build_stream(stream, Store(spark, str(tmp_path / "streamed")), decode, str(tmp_path / "c"), progress=seen.append).awaitTermination()
    assert len(seen) == 2 and seen[-1]["completed_count"] == 4 and [s["batch"] for s in seen] == [0, 1]
