"""Files of records: JSON Lines, CSV, query files, and single files that appear as a whole or not at all."""

from __future__ import annotations

import csv
import io
import json
import os
import posixpath
import uuid
from collections.abc import Iterable, Sequence
from contextlib import ExitStack
from pathlib import Path
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinequery.functions.text import composed

# How query files are named, how their event lines begin, and what may stand after an event's number.
TASKS = ("kis", "qa", "trake")
EVENT_OPENINGS = ("E", "Cảnh\\s*")
EVENT_MARKS = ":.)\\-–"

_EVENT = rf"(?iu)^\s*(?:{'|'.join(EVENT_OPENINGS)})\d+\s*[{EVENT_MARKS}]?\s*(\S.*)$"
_TASK = rf"(?i)-({'|'.join(TASKS)})$"
_LINE_ENDS = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


# -- scans


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a line, blank lines skipped, one file a video: ``video_id`` is the file's stem where the schema lacks it."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", "")
    return rows if "video_id" in rows.columns else rows.withColumn("video_id", stem)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def csv_list(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header; a missing one is an empty list."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, header=True, schema=schema)


def video_files(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """(video_id, path, length, modified) of the files below ``path``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("video_id"), "path", "length", F.col("modificationTime").alias("modified"))


def parse_query_text(files: DataFrame, name: str, content: str) -> DataFrame:
    """``found_task`` from the file name's end, ``text`` in composed form without byte order mark and outer space, ``events`` of the marked lines."""
    text = F.regexp_replace(F.regexp_replace(composed(F.col(content)), "^\ufeff", ""), r"(?U)^\s+|\s+$", "")
    task = F.lower(F.regexp_extract(F.col(name), _TASK, 1))
    events = F.filter(F.transform(F.split("text", _LINE_ENDS), lambda x: F.trim(F.regexp_extract(x, _EVENT, 1))), lambda x: x != "")
    return files.withColumn("text", text).withColumn("found_task", F.when(task != "", task)).withColumn("events", events)


def query_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, found_task, events) of one query file or a folder of them."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("name"), "value")
    return parse_query_text(whole, "name", "value").drop("value")


# -- sinks


def _place(address: str | Path) -> tuple[fs.FileSystem, str]:
    address = str(address)
    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), os.path.abspath(address))


def publish(address: str | Path, parts: Iterable[bytes]) -> None:
    """Write ``parts`` beside ``address``, in its file system, and move them there once all are stored.

    Until then readers see what was there before, and a failure leaves nothing behind. Works on the
    driver and in tasks, with local paths and with addresses.
    """
    system, path = _place(address)
    folder, name = posixpath.split(path)
    aside = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    system.create_dir(folder, recursive=True)
    with ExitStack() as undo:
        undo.callback(lambda: system.delete_file(aside) if system.get_file_info(aside).type == fs.FileType.File else None)
        with system.open_output_stream(aside) as out:
            for part in parts:
                out.write(part)
        if isinstance(system, fs.LocalFileSystem):
            with open(aside, "rb+") as stored:  # a full disk shows here
                os.fsync(stored.fileno())
        system.move(aside, path)
        undo.pop_all()


def _json(value: Any) -> bytes:
    return json.dumps(value, ensure_ascii=False).encode()


def write_json_lines(address: str | Path, records: Iterable[dict[str, Any]]) -> None:
    publish(address, (_json(record) + b"\n" for record in records))


def write_json(address: str | Path, value: Any) -> None:
    publish(address, [_json(value)])


def write_submission(address: str | Path, rows: DataFrame, columns: Sequence[str], most: int = 100) -> int:
    """The ordered result rows as one CSV file without header; more than ``most`` is an error."""
    found = rows.orderBy("row").select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a submission has {most} rows at most")
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(found)
    publish(address, [text.getvalue().encode()])
    return len(found)


def write_pictures(pictures: DataFrame, folder: str) -> None:
    """``(name, content)`` rows as files of a shared folder, written where the rows lie."""

    def store(rows: Iterable[Any]) -> None:
        for row in rows:
            publish(f"{folder}/{row.name}", [bytes(row.content)])

    pictures.select("name", "content").foreachPartition(store)
