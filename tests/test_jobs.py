import json
import os

import numpy as np
import pytest

from cinequery import cli, jobs
from cinequery.config import Settings
from cinequery.models import ArrayDecoder, HashReader, device, options
from cinequery.operators import bm25
from cinequery.operators.engine import query_frame
from cinequery.sources.judge import Judge
from cinequery.sources.submission_log import Ledger

SETTINGS = Settings({"videos": {"pattern": "*.npy"}, "keyframes": {"gap": 8, "radius": 3}, "grouping": {"max_distance": 6}})


@pytest.fixture
def data(tmp_path):
    folder = tmp_path / "videos" / "deep"
    folder.mkdir(parents=True)
    jobs.demo_video(str(folder / "A.npy"), [40, 200, 90])
    jobs.demo_video(str(folder / "B.npy"), [120], 5)
    (folder / "C.npy").write_bytes(b"no video")
    return str(tmp_path)


def test_videos_to_an_index(spark, data):
    failures = jobs.preprocess(spark, data, f"{data}/videos", SETTINGS)
    assert len(failures) == 1 and failures[0].startswith("video C: ")
    shots = {(r.video_id, r.shot_id): (r.start_frame, r.end_frame, r.start_ms, r.end_ms) for r in spark.read.parquet(f"{data}/shots.parquet").collect()}
    assert shots == {("A", 0): (0, 19, 0, 800), ("A", 1): (20, 39, 800, 1600), ("A", 2): (40, 59, 1600, 2400), ("B", 0): (0, 4, 0, 200)}
    keys = spark.read.parquet(f"{data}/keyframes.parquet").collect()
    assert sum(r.video_id == "A" for r in keys) == 6 and all(r.time_ms == r.frame_index * 40 and r.time_source == "pts" for r in keys)
    grey = np.load(f"{data}/videos/deep/A.npy")
    first = {(r.low, r.high) for r in jobs.shots_and_slots.dense_slots(spark.read.parquet(f"{data}/shots.parquet"), 8, 3).where("video_id = 'A' and shot_id = 0").collect()}
    best = {max(range(a, b + 1), key=lambda i: (jobs.measure(grey[i])["sharpness"], -i)) for a, b in first}
    assert {r.frame_index for r in keys if r.video_id == "A" and r.shot_id == 0} == best
    assert jobs.preprocess(spark, data, f"{data}/videos", SETTINGS)[0].startswith("video C")  # only C is left to do

    assert jobs.build_index(spark, data, SETTINGS) == []
    indexed = {r.keyframe_id for r in keys if r.indexed}
    assert {r.keyframe_id for r in jobs.VectorStore(spark, f"{data}/vectors", "hash").rows().collect()} == indexed
    assert {r.keyframe_id for r in spark.read.parquet(f"{data}/lines.parquet").collect()} == indexed
    index = bm25.KeywordIndex.load(spark, f"{data}/keywords", 1.2, 0.75)
    assert bm25.search(index.of("asr"), query_frame(spark, {1: "cau"}), 5).count() > 0

    # Other keyframes: their evidence is stale, and only that of the changed video is read again.
    jobs.reselect(spark, data, Settings({"quality": {"max_brightness": 150.0}}))
    assert jobs.keywords(spark, data, SETTINGS, False)
    assert jobs.build_index(spark, data, SETTINGS, ["ocr", "objects", "keywords"]) == []
    now = {r.keyframe_id for r in spark.read.parquet(f"{data}/keyframes.parquet").where("indexed").collect()}
    assert {r.keyframe_id for r in spark.read.parquet(f"{data}/lines.parquet").collect()} == now != indexed
    assert jobs.build_index(spark, data, Settings({"objects": {"words": []}}), ["objects"], True)[0].startswith("step objects: ")
    with pytest.raises(ValueError, match="no step"):
        jobs.build_index(spark, data, SETTINGS, ["smell"])


def test_commands(spark, data, monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(cli, "session", lambda: spark)
    config = tmp_path / "c.json"
    config.write_text('{"videos": {"pattern": "*.npy"}, "search": {"depth": 7}, "trake": {"order": "loose"}}')
    assert cli.main(["preprocess", "--data", data, "--config", str(config)]) == 1
    assert "video C" in capsys.readouterr().err
    assert cli.main(["build-index", "visual", "--data", data, "--config", str(config)]) == 0
    a = cli._arguments(["trake", "--event", "a", "--event", "b", "--config", str(config)])
    assert (a.depth, a.order, a.rows) == (7, "loose", 100)
    assert cli._arguments(["kis", "--ocr", "x", "--depth", "3", "--config", str(config)]).depth == 3


def test_sending(spark, monkeypatch, capsys, tmp_path):
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test data")
    asked = []

    def transport(method, address, headers, body, timeout):
        asked.append((address.rpartition("/")[2].partition("?")[0], json.loads(body) if body else None))
        reply = {"login": {"sessionId": "s"}, "list": [{"id": "e1", "name": "first"}, {"id": "e2", "name": "second"}], "e2": {"name": "kis-1"} if method == "GET" else {"status": True, "submission": "CORRECT"}}
        return 200, json.dumps(reply[asked[-1][0]]).encode()

    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli, "Judge", lambda address: Judge(address, transport))
    monkeypatch.setattr(cli, "Ledger", lambda spark, folder: Ledger(spark, str(tmp_path / "ledger")))
    monkeypatch.setattr(cli.getpass, "getpass", lambda _: "p")
    said = ["kis", "--data", data, "--ocr", "GIÁ", "--submit", "1", "--judge", "http://judge", "--user", "u", "--evaluation", "second"]
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert cli.main(said) == 0 and "nothing was sent" in capsys.readouterr().out
    assert cli.main([*said, "--yes"]) == 0 and "CORRECT" in capsys.readouterr().out
    assert set(asked[-1][1]["answerSets"][0]["answers"][0]) == {"mediaItemName", "start", "end"}
    assert cli.main([*said, "--yes"]) == 0 and "not again" in capsys.readouterr().out
    assert cli.main(["qa", *said[1:], "--answer", "a-b"]) == 1
    assert cli.main([*said[:6], "99999", *said[7:]]) == 1


def test_helpers():
    assert device("cuda:1") == ("gpu", 1) and device(None) == ("cpu", 0)
    assert options({"a": 1, "b": None}, ["a", "b", "c"]) == {"a": 1}
    with pytest.raises(ValueError):
        HashReader("label", [])
    assert round(1000 / ArrayDecoder("30000/1001").rate) == 33
