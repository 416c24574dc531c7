"""``python -m cinequery.cli``: search a data folder, send answers, run the offline jobs, or run named queries."""

from __future__ import annotations

import argparse
import getpass
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery import jobs
from cinequery.config import Settings
from cinequery.models import load_encoder, translator
from cinequery.operators import bm25, submission, trake, vector_search
from cinequery.operators.engine import Refused, SearchEngine, box_frame, keyword_lane, visual_lane
from cinequery.plans import catalog, views
from cinequery.sources.files import query_files, write_submission
from cinequery.sources.judge import Judge, JudgeError, send_once
from cinequery.sources.submission_log import Ledger
from cinequery.sources.tables import hadoop

BOXES = ("text", "ocr", "asr", "objects")
TASKS = ("kis", "qa", "trake")

#: Options that a settings file may give too: its name, the option, its type and what holds without either.
SETTINGS: dict[str, tuple[str, type, Any]] = {
    "search.encoder": ("encoder", str, "hash"),
    "search.depth": ("depth", int, 100),
    "search.rows": ("rows", int, 100),
    "fusion.rrf_k": ("rrf_k", float, None),
    "trake.order": ("order", str, "strict"),
    "trake.min_gap_ms": ("min_gap_ms", int, None),
    "trake.max_gap_ms": ("max_gap_ms", int, None),
    "answers.frame_id_base": ("frame_id_base", int, 0),
    "judge.address": ("judge", str, None),
    "judge.user": ("user", str, None),
    "judge.evaluation": ("evaluation", str, None),
}


def session() -> SparkSession:
    return SparkSession.builder.appName("cinequery").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cinequery", description=__doc__)
    parser.add_argument("task", nargs="?", choices=(*TASKS, "run", "list", "preprocess", "build-index"))
    parser.add_argument("name", nargs="?", help="with run: the query's name; with build-index: the step")
    parser.add_argument("--data", default="data", help="folder with the tables")
    parser.add_argument("--config", type=Path, help="settings, as YAML or JSON")
    for box in BOXES:
        parser.add_argument(f"--{box}", help=f"fill in the {box} box")
    parser.add_argument("--event", action="append", default=[], help="an event, in order; repeat for more")
    parser.add_argument("--query-file")
    parser.add_argument("--answer", help="Q&A: the answer on every row")
    for option, kind, default in SETTINGS.values():
        parser.add_argument(f"--{option.replace('_', '-')}", type=kind, help=f"default: {default}")
    parser.add_argument("--spread", type=int, nargs=2, metavar=("KEEP", "PER_VIDEO"))
    parser.add_argument("--out", help="CSV file to write")
    parser.add_argument("--out-dir", help="folder for the CSV file, which takes the query file's name")
    parser.add_argument("--submit", type=int, metavar="ROW", help="send this row to the judge")
    parser.add_argument("--yes", action="store_true", help="send without asking back")
    parser.add_argument("--videos", help="preprocess: folder with the videos")
    parser.add_argument("--force", action="store_true", help="offline jobs: also what is done")
    return parser


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = _parser()
    a = parser.parse_args(argv)
    settings = Settings.load(a.config) if a.config else Settings({})
    for name, (option, kind, default) in SETTINGS.items():
        if getattr(a, option) is None:
            given = settings.get(name, default)
            setattr(a, option, None if given is None else kind(given))
    a.settings, a.stem = settings, a.task
    if a.query_file:
        read = query_files(session(), a.query_file).first()
        a.task, a.text, a.event, a.stem = a.task or read.found_task, a.text or read.text, a.event or list(read.events), read.name
    if a.task is None:
        parser.error("which task? Name it, or give a query file whose name ends in it")
    if a.order not in ("strict", "loose"):
        parser.error(f"events come in strict or loose order, not {a.order}")
    if a.task == "trake" and len(a.event) < 2:
        parser.error("a chain is made of two events or more")
    if a.task in ("kis", "qa") and not any((getattr(a, box) or "").strip() for box in BOXES):
        parser.error("nothing to search for: all boxes are empty")
    return a


def answers(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """The result rows with ``sent``, what goes to the judge, and the columns of the file."""
    if a.task == "trake":
        encoder = load_encoder(a.encoder)
        events = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(encoder.encode_texts(a.event))], "query_id int, query_vector array<double>")
        steps = trake.Steps.of(a.order, a.min_gap_ms, a.max_gap_ms)
        rows = submission.trake(trake.trake(views.vectors(spark, a.data), events, len(a.event), steps, a.depth, a.rows, bool(a.spread)), a.frame_id_base)
        frames = [F.split("frames", ",")[i].alias(f"frame_{i + 1}") for i in range(len(a.event))]
        return rows.select("row", "video_id", *frames, "sent"), ["video_id", *(f"frame_{i + 1}" for i in range(len(a.event)))]
    index = bm25.build(views.lines(spark, a.data))
    generate = jobs.MODELS.get("translator")
    lanes = {"text": visual_lane(views.vectors(spark, a.data), lambda: load_encoder(a.encoder), translator(generate()) if generate else None)}
    lanes |= {box: keyword_lane(index, box) for box in BOXES[1:]}
    found = SearchEngine(lanes, a.rrf_k, a.depth, a.rows, tuple(a.spread) if a.spread else None).search(box_frame(spark, {1: {b: getattr(a, b) for b in BOXES}}))
    if a.task == "qa" and a.answer:
        return submission.qa(found, F.lit(a.answer), a.frame_id_base), ["video_id", "frame", "answer"]
    return submission.kis(found, a.frame_id_base), ["video_id", "frame"]


def _send(spark: SparkSession, a: argparse.Namespace, rows: DataFrame) -> int:
    chosen = rows.where(F.col("row") == a.submit).first()
    if chosen is None:
        print(f"there is no row {a.submit}")
        return 1
    if a.task == "qa" and (not (a.answer or "").strip() or "-" in a.answer):
        print("what is sent for a question has an answer, without a hyphen")
        return 1
    if not a.judge or not a.user:
        print("to send, give the judge's address and a user (judge.address, judge.user)")
        return 1
    judge = Judge(a.judge)
    try:
        judge.log_in(a.user, getpass.getpass(f"password of {a.user}: "))
        evaluation = judge.choose(a.evaluation, _pick)
        task = str(judge.current_task(evaluation).get("name") or "")
        if not a.yes and input(f"send {chosen.sent} for {task}? [y/N] ").strip().lower() != "y":
            print("nothing was sent")
            return 0
        answer = json.loads(chosen.sent) if a.task == "kis" else {"text": chosen.sent}
        verdict = send_once(judge, Ledger(spark, f"{a.data}/submissions"), evaluation, task, answer)
    except JudgeError as failed:
        print(failed)
        return 1
    print("sent before, and not again" if verdict is None else f"{verdict.verdict or 'no verdict'} {verdict.description}".strip())
    return 0


def _pick(names: list[str]) -> int:
    for i, name in enumerate(names):
        print(f"{i + 1}  {name}")
    return int(input("which evaluation? ")) - 1


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    if a.task == "list":
        print("\n".join(catalog.queries()))
        return 0
    spark = session()
    if a.task == "run":
        catalog.queries()[a.name](spark, a.data).show(50, truncate=60)
        return 0
    if a.task in ("preprocess", "build-index"):
        failures = jobs.preprocess(spark, a.data, a.videos or f"{a.data}/videos", a.settings, a.force) if a.task == "preprocess" else jobs.build_index(spark, a.data, a.settings, [a.name] if a.name else None, a.force)
        for failure in failures:
            print(failure, file=sys.stderr)
        return 1 if failures else 0
    try:
        rows, columns = answers(spark, a)
    except Refused as refused:
        print(refused, file=sys.stderr)
        return 2
    out = a.out or (f"{a.out_dir}/{a.stem}.csv" if a.out_dir else None)
    if out:
        print(f"{write_submission(out, rows, columns, submission.MAX_ROWS)} rows in {out}")
    elif a.submit is None:
        rows.orderBy("row").select("row", *columns).show(20, truncate=False)
    return _send(spark, a, rows) if a.submit is not None else 0


if __name__ == "__main__":
    sys.exit(main())
