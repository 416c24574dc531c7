"""Collections of vectors as Parquet: one an encoder, in buckets of videos, with a manifest a version.

A collection is a folder with a small description, data folders that are written once and never
changed, and manifests that say which data folders hold each bucket. A change writes new data and then,
in one step, the next manifest: readers see the collection before or after it, also when a job dies in
between. Replacing a video's vectors rewrites its bucket only. More videos want more buckets: ``rebucket``.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery import schemas
from cinequery.operators import vector_search
from cinequery.sources.tables import hadoop

#: Buckets of a new collection.
BUCKETS = 256
_COLUMNS = [c.split()[0] for c in schemas.VECTORS.split(", ")]


def resolve_uri(uri: str, root: str | Path) -> str:
    """An address as it is, a path relative to the data root."""
    return uri if "://" in uri or uri.startswith("/") else str(Path(root) / uri)


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, encoder: str):
        self.spark, self.name, self.path = spark, encoder, f"{root.rstrip('/')}/{encoder}"

    # -- the description, through the file system that holds the data

    def _file(self, name: str):
        return hadoop(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        system, path = self._file("_collection.json")
        return system.exists(path)

    def create(self, dim: int, buckets: int = BUCKETS) -> VectorStore:
        if self.exists():
            raise FileExistsError(f"collection {self.name!r} stands already")
        if dim < 1 or buckets < 1:
            raise ValueError("vectors have at least one number, and a collection one bucket")
        try:
            self._commit(0, {"buckets": buckets, "held": {}})
            self._write("_collection.json", {"dim": dim})
        except Exception:
            self.drop()
            raise
        return self

    def open(self) -> VectorStore:
        if not self.exists():
            raise FileNotFoundError(f"collection {self.name!r} was not built yet (step visual)")
        return self

    def drop(self) -> None:
        system, path = self._file("")
        system.delete(path, True)

    def _write(self, name: str, value: dict) -> None:
        """Written aside and renamed; an error where the name is taken."""
        system, path = self._file(name)
        _, aside = self._file(f"{name}.{uuid.uuid4().hex}")
        out = system.create(aside, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if system.exists(path) or not system.rename(aside, path):
            system.delete(aside, False)
            raise FileExistsError(f"collection {self.name}: {name} was written by another job")

    def _read(self, name: str) -> dict:
        system, path = self._file(name)
        data = system.open(path)
        try:
            return json.loads(bytes(data.readAllBytes()).decode())
        finally:
            data.close()

    @property
    def dim(self) -> int:
        return self._read("_collection.json")["dim"]

    # -- versions

    def _names(self, folder: str) -> list[str]:
        system, path = self._file(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def _latest(self) -> tuple[int, dict]:
        """Number and manifest of the newest version."""
        name = [n for n in self._names("manifests") if n.endswith(".json")][-1]
        return int(name.removesuffix(".json")), self._read(f"manifests/{name}")

    def _commit(self, version: int, manifest: dict) -> None:
        self._write(f"manifests/{version:012d}.json", manifest)

    def _store(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows as a new data folder; its folder of each bucket."""
        name = f"data/{uuid.uuid4().hex}"
        ready = rows.select(*_COLUMNS).withColumn("bucket", self._bucket(buckets))
        # By key within the bucket: a video of any size is written by many tasks.
        ready.repartitionByRange("bucket", "video_id", "keyframe_id").sortWithinPartitions("bucket", "video_id").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {n.removeprefix("bucket="): f"{name}/{n}" for n in self._names(name) if n.startswith("bucket=")}

    def _load(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schemas.VECTORS)
        return self.spark.read.schema(schemas.VECTORS).parquet(*(f"{self.path}/{f}" for f in folders))

    def vacuum(self) -> None:
        """Remove data that no longer counts. Only when nobody reads an older version."""
        version, manifest = self._latest()
        used = {f.split("/")[1] for held in manifest["held"].values() for f in held}
        for name in self._names("data"):
            if name not in used:
                system, path = self._file(f"data/{name}")
                system.delete(path, True)
        for name in self._names("manifests"):
            if name != f"{version:012d}.json":
                system, path = self._file(f"manifests/{name}")
                system.delete(path, False)

    def rebucket(self, buckets: int) -> None:
        version, _ = self._latest()
        self._commit(version + 1, {"buckets": buckets, "held": {b: [f] for b, f in self._store(self.rows(), buckets).items()}})

    # -- rows

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")

    def _checked(self, rows: DataFrame) -> DataFrame:
        """An error where a vector does not fit, naming both sizes."""
        dim = self.dim
        said = F.concat(F.lit("a vector of "), F.size("vector").cast("string"), F.lit(f" numbers does not fit collection {self.name}, which holds vectors of {dim}"))
        return rows.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector").cast("array<float>")).otherwise(F.raise_error(said)))

    def _ready(self, rows: DataFrame) -> DataFrame:
        """Checked rows; one without ``id`` gets that of its place, the same at every run."""
        if "id" not in rows.columns:
            rows = rows.withColumn("id", F.xxhash64("video_id", "keyframe_id", "frame_index"))
        return self._checked(rows.select(*_COLUMNS))

    def rows(self) -> DataFrame:
        return self._load([f for held in self._latest()[1]["held"].values() for f in held])

    def insert(self, rows: DataFrame) -> None:
        version, manifest = self._latest()
        for bucket, folder in self._store(self._ready(rows), manifest["buckets"]).items():
            manifest["held"].setdefault(bucket, []).append(folder)
        self._commit(version + 1, manifest)

    def replace_videos(self, rows: DataFrame, videos: DataFrame) -> None:
        """Drop all vectors of ``videos(video_id)`` and write ``rows``: an upsert by video that rewrites their buckets only."""
        version, manifest = self._latest()
        gone = videos.select("video_id").distinct()
        touched = {str(r.b) for r in gone.select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect()}  # at most one a bucket
        kept = self._load([f for bucket in sorted(touched) for f in manifest["held"].get(bucket, [])]).join(gone, "video_id", "left_anti")
        written = self._store(kept.select(*_COLUMNS).unionByName(self._ready(rows)), manifest["buckets"])
        held = {b: folders for b, folders in manifest["held"].items() if b not in touched}
        for bucket, folder in written.items():
            held.setdefault(bucket, []).append(folder)
        self._commit(version + 1, manifest | {"held": held})

    def delete_video(self, video_id: str) -> None:
        gone = self.spark.createDataFrame([(video_id,)], "video_id string")
        self.replace_videos(self.spark.createDataFrame([], schemas.VECTORS), gone)

    def keyframe_ids(self, video_id: str) -> DataFrame:
        return self._of(video_id).select("keyframe_id").distinct()

    def _of(self, video_id: str) -> DataFrame:
        found = self.rows()
        return found.where(F.col("video_id") == F.lit(video_id))

    def frames_of(self, video_id: str) -> DataFrame:
        """All frames of a video with their vectors, in order."""
        return self._of(video_id).orderBy("frame_index")

    def search(self, queries: DataFrame, limit: int, video_id: str | None = None) -> DataFrame:
        return vector_search.search(vector_search.usable_vectors(self.rows()), queries, limit, video_id)
