import json
import threading
import unicodedata
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cinequery import schemas
from cinequery.config import MissingSetting, Settings
from cinequery.models import HashEncoder, embed, in_batches, load_encoder, translator
from cinequery.operators import submission
from cinequery.plans import build
from cinequery.sources import files
from cinequery.sources.judge import Judge, JudgeError, over_http, send_once
from cinequery.sources.submission_log import Ledger, read_log
from cinequery.sources.vector_store import VectorStore, resolve_uri
from cinequery.streaming import evidence


def test_settings(tmp_path):
    s = Settings({"a": {"b": 0, "c": None, "d": False, "e": {"f": 1}}}, "file")
    assert (s.get("a.b", 5), s.get("a.c", 5), s.get("a.d", 5), s.get("a.x.y", 5), s.get("a.e.f")) == (0, 5, False, 5, 1)
    assert s.section("a.e").require("f") == 1
    with pytest.raises(MissingSetting, match="file.*a.c"):
        s.require("a.c")
    (tmp_path / "s.json").write_text('{"x": 1}')
    assert Settings.load(tmp_path / "s.json").to_dict() == {"x": 1}
    with pytest.raises(ValueError):
        Settings([1])


def test_scans(spark, tmp_path):
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "V1.jsonl").write_text('{"start_ms": 1, "end_ms": 2, "text": "một"}\n\n{"start_ms": 3, "end_ms": 4, "text": "hai"}\n')
    (tmp_path / "seg" / "V2.jsonl.tmp").write_text("{}")
    got = files.json_lines(spark, str(tmp_path / "seg"), schemas.SEGMENTS).orderBy("start_ms").collect()
    assert [(r.video_id, r.text) for r in got] == [("V1", "một"), ("V1", "hai")]
    (tmp_path / "v.csv").write_text("video_id,fps\nA,13219/500\n")
    assert files.csv_list(spark, str(tmp_path / "v.csv"), "video_id string, fps string").first().fps == "13219/500"
    assert files.csv_list(spark, str(tmp_path / "none.csv"), "video_id string").count() == 0
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "L1_V002.mp4").write_bytes(b"xy")
    (tmp_path / "in" / "note.txt").write_bytes(b"")
    assert [(r.video_id, r.length) for r in files.video_files(spark, str(tmp_path / "in")).collect()] == [("L1_V002", 2)]
    (tmp_path / "d.json").write_text('{\n "dim": 3\n}')
    assert files.json_document(spark, str(tmp_path / "d.json"), "dim int").first().dim == 3


def test_query_files(spark, tmp_path):
    text = "﻿E1: một người\n ghi chú\n  Cảnh 2. hai người \n"
    path = tmp_path / "query-1-TRAKE.txt"
    path.write_text(text, encoding="utf-8")
    read = files.query_files(spark, str(path)).first()
    assert (read.name, read.found_task, read.text, list(read.events)) == ("query-1-TRAKE", "trake", text.lstrip("﻿").strip(), ["một người", "hai người"])
    path.write_text(unicodedata.normalize("NFD", text), encoding="utf-8")
    assert files.query_files(spark, str(path)).first().text == read.text
    df = spark.createDataFrame([("query-1-TRAKE", text), ("plain", "chỉ chữ")], "name string, content string")
    got = files.parse_query_text(df, "name", "content").orderBy(F.desc("name")).collect()
    assert [(r.found_task, list(r.events)) for r in got] == [("trake", ["một người", "hai người"]), (None, [])]


def test_files_are_replaced_as_a_whole(spark, tmp_path):
    path = tmp_path / "x" / "a.json"
    files.write_json(path, {"a": "ế"})
    with pytest.raises(ZeroDivisionError):
        files.publish(path, (part if part else 1 / 0 for part in (b"x", None)))
    assert json.loads(path.read_text()) == {"a": "ế"} and [p.name for p in path.parent.iterdir()] == ["a.json"]
    files.write_json_lines(tmp_path / "b.jsonl", [{"a": 1}, {"a": 2}])
    assert (tmp_path / "b.jsonl").read_text() == '{"a": 1}\n{"a": 2}\n'
    rows = spark.createDataFrame([(2, "V", 5, "Hà Nội, Việt Nam"), (1, "U", 4, "x")], "row int, video_id string, frame int, answer string")
    assert files.write_submission(tmp_path / "s.csv", rows, ["video_id", "frame", "answer"]) == 2
    assert (tmp_path / "s.csv").read_text() == 'U,4,x\nV,5,"Hà Nội, Việt Nam"\n'
    with pytest.raises(ValueError):
        files.write_submission(tmp_path / "s.csv", rows, ["video_id"], 1)
    files.write_pictures(spark.createDataFrame([("p/a.jpg", bytearray(b"1"))], "name string, content binary"), str(tmp_path))
    assert (tmp_path / "p" / "a.jpg").read_bytes() == b"1"


def vectors(spark, rows):
    return spark.createDataFrame([([float(x) for x in v], f"{video}_{f}", video, 0, f, f * 40) for video, f, v in rows], "vector array<float>, keyframe_id string, video_id string, shot_id bigint, frame_index bigint, time_ms bigint")


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "index"), "hash")
    with pytest.raises(FileNotFoundError):
        store.open()
    store.create(2)
    assert store.dim == 2 and store.open().rows().count() == 0
    with pytest.raises(FileExistsError):
        store.create(2)
    store.insert(vectors(spark, [("A", 1, [1, 0]), ("A", 2, [0, 1]), ("B", 1, [1, 1])]))
    with pytest.raises(PySparkException, match="3 numbers.*vectors of 2"):
        store.insert(vectors(spark, [("A", 3, [1, 0, 0])]))
    assert [r.frame_index for r in store.frames_of("A").collect()] == [1, 2]
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, query_vector array<double>")
    assert [r.keyframe_id for r in store.search(asked, 2).orderBy("rank").collect()] == ["A_1", "B_1"]
    assert [r.keyframe_id for r in store.search(asked, 2, "B").collect()] == ["B_1"]
    store.replace_videos(vectors(spark, [("A", 9, [1, 0])]), spark.createDataFrame([("A",)], "video_id string"))
    assert sorted(r.keyframe_id for r in store.rows().collect()) == ["A_9", "B_1"]
    store.delete_video("B")
    assert [r.keyframe_id for r in store.rows().collect()] == ["A_9"] and store.keyframe_ids("B").count() == 0
    before = store.rows()
    store.rebucket(3)
    store.insert(vectors(spark, [("C", i, [1, i]) for i in range(5)]))
    store.replace_videos(vectors(spark, [("C", 7, [1, 7])]), spark.createDataFrame([("C",), ("Z",)], "video_id string"))
    assert sorted(r.keyframe_id for r in store.rows().collect()) == ["A_9", "C_7"] and [r.keyframe_id for r in before.collect()] == ["A_9"]
    with pytest.raises(FileExistsError):
        store._commit(store._latest()[0], {})
    store.vacuum()
    assert sorted(r.keyframe_id for r in store.rows().collect()) == ["A_9", "C_7"] and len(store._names("manifests")) == 1
    assert resolve_uri("http://x", "/d") == "http://x" and resolve_uri("i/v", "/d") == "/d/i/v"


def test_models(spark, tmp_path):
    assert load_encoder("hash").encode_texts(["a"]).shape == (1, 64)
    with pytest.raises(ValueError, match="no encoder"):
        load_encoder("other")
    assert translator(lambda t: "en: hello " if t == "vi: chào" else "")("chào") == "hello"
    df = spark.createDataFrame([(i, i) for i in range(7)], "id int, x int")

    def make():
        def model(items):
            if 3 in items:
                raise RuntimeError("bad picture")
            return [i * 2 for i in items]

        return model

    got = {r.id: (r.y, r.error) for r in in_batches(df, "x", make, "y", "int", 4).collect()}
    assert got[3][1].endswith("bad picture") and all(got[i] == (i * 2, None) for i in range(7) if i != 3)
    short = in_batches(df, "x", lambda: lambda items: items[:-1], "y", "int", 4).first()
    assert "outputs for" in short.error
    store = VectorStore(spark, str(tmp_path / "i"), "hash").create(64)
    keys = spark.createDataFrame([("A", 0, "A_1", 1, 40, True), ("A", 0, "A_2", 2, 80, False), ("B", 0, "B_1", 1, 40, True)], "video_id string, shot_id bigint, keyframe_id string, frame_index bigint, time_ms bigint, indexed boolean")
    shots = spark.createDataFrame([("A_1", bytearray(b"x")), ("B_1", bytearray(b"y"))], "keyframe_id string, content binary")
    assert build.build_visual(keys, shots, store, "hash").count() == 0
    assert sorted(r.keyframe_id for r in store.rows().collect()) == ["A_1", "B_1"]
    assert build.stale_report(keys, store.rows()) is None
    assert "1 videos: B" in build.stale_report(keys, store.rows().where("video_id = 'A'"))
    assert embed(shots, "content", "hash").where("error is null").count() == 2
    assert HashEncoder(8).encode_images([b"a"]).dtype.name == "float32"


def test_ledger_and_logs_with_cut_lines(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.standing("e", "t", {"a": 1}) == (None, False)
    ledger.note("e", "t", {"text": "một hai\u0085ba"}, "SENDING")
    (tmp_path / "l" / "00000000000000000001-cut.jsonl").write_bytes('{"evaluation": "e", "task": "ế'.encode()[:-1])
    for verdict in ("SENDING", "CORRECT", "ERROR 503", "WRONG"):
        ledger.note("e", "t", {"b": 1, "a": 2}, verdict)
    assert ledger.events().count() == 5 and ledger.standing("e", "t", {"a": 2, "b": 1}) == ("WRONG", True)
    assert ledger.standing("e", "t", {"text": "một hai\u0085ba"}) == ("SENDING", True)
    ledger.note("e", "t", {"b": 1, "a": 2}, "ERROR 412")
    assert ledger.standing("e", "t", {"a": 2, "b": 1}) == ("ERROR 412", False)
    whole = tmp_path / "log.jsonl"
    whole.write_bytes(b"".join(p.read_bytes() + b"\n" for p in sorted((tmp_path / "l").glob("*.jsonl"))))
    states = {r.verdict for r in submission.states(read_log(spark, str(whole))).collect()}
    assert states == {"SENDING", "ERROR 412"}


def test_judge(spark, tmp_path):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, body):
            raw = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self.answer(200, [{"id": "e 1"}] if "list" in self.path else b"not json")

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            if "login" in self.path:
                self.answer(200, {"sessionId": "s1"})
            elif body["answerSets"][0]["answers"][0].get("text") == "bad":
                self.answer(412, {"description": "no task"})
            else:
                self.answer(200, {"status": True, "submission": "CORRECT", "description": "ok"})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    judge = Judge(f"http://127.0.0.1:{server.server_port}/")
    with pytest.raises(JudgeError, match="log in before"):
        judge.evaluations()
    judge.log_in("u", "p")
    assert judge.evaluations() == [{"id": "e 1"}]
    with pytest.raises(JudgeError, match="not a JSON"):
        judge.current_task("e 1")
    assert judge.choose(None) == judge.choose("e 1") == "e 1"
    with pytest.raises(JudgeError, match="0 evaluations"):
        judge.choose("other")
    ledger = Ledger(spark, str(tmp_path / "log"))
    assert send_once(judge, ledger, "e 1", "t", {"text": "x"}).verdict == "CORRECT"
    assert send_once(judge, ledger, "e 1", "t", {"text": "x"}) is None
    assert asked[-1] == ("/api/v2/submit/e%201?session=s1", {"answerSets": [{"answers": [{"text": "x"}]}]})
    with pytest.raises(JudgeError, match="no task") as refused:
        send_once(judge, ledger, "e 1", "t", {"text": "bad"})
    assert refused.value.status == 412 and not ledger.standing("e 1", "t", {"text": "bad"})[1]
    server.shutdown()
    tried = []

    def lost(method, address, *_):
        tried.append(method)
        raise TimeoutError("late")

    judge._transport = lost
    with pytest.raises(JudgeError, match="late") as silent:
        send_once(judge, ledger, "e 1", "t", {"text": "y"})
    assert silent.value.status is None and ledger.standing("e 1", "t", {"text": "y"})[1] and tried == ["POST"]
    with pytest.raises(JudgeError):
        judge.evaluations()
    assert tried == ["POST", "GET", "GET", "GET"]
    judge._transport = lambda *_: (200, b"")
    with pytest.raises(JudgeError, match="session"):
        judge.log_in("u", "p")
    with pytest.raises(OSError):
        over_http("GET", "http://127.0.0.1:1/x", {}, None, 1.0)


def test_stream_upserts_by_video(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "index"), "hash").create(2)
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "vector array<float>, keyframe_id string, video_id string, shot_id bigint, frame_index bigint, time_ms bigint"
    for step, rows in enumerate(([("A", 1, [1, 0]), ("B", 1, [0, 1])], [("A", 5, [1, 1])])):
        lines = [json.dumps({"vector": v, "keyframe_id": f"{video}_{f}", "video_id": video, "shot_id": 0, "frame_index": f, "time_ms": 0}) for video, f, v in rows]
        (folder / f"{step}.jsonl").write_text("\n".join(lines))
        evidence.run_to_end(evidence.keep_vectors(evidence.arriving(spark, str(folder), schema), store, str(tmp_path / "state")))
    assert sorted(r.keyframe_id for r in store.rows().collect()) == ["A_5", "B_1"]
    counted = evidence.counts_by_window(spark.sql("select timestamp'2025-01-01 00:01:00' as at, 'a' as k"), "at", "k")
    assert counted.first().rows == 1
