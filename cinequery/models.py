"""Where models plug in, and stand-ins that need none.

A model is a plain object made by a factory on each executor, once a task, and called with batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from fractions import Fraction
from typing import Any, NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Pictures and texts to unit float32 vectors of one length."""

    dim: int

    def encode_images(self, pictures: Sequence[bytes]) -> np.ndarray: ...

    def encode_texts(self, texts: Sequence[str]) -> np.ndarray: ...


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length, float32; a zero row stays."""
    vectors = np.asarray(vectors, np.float32)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


class HashEncoder:
    """Stand-in: the bytes decide the vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _one(self, raw: bytes) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(raw).digest()[:8], "big")
        return np.random.default_rng(seed).normal(size=self.dim)

    def encode_images(self, pictures: Sequence[bytes]) -> np.ndarray:
        return normalised(np.stack([self._one(bytes(p)) for p in pictures]))

    def encode_texts(self, texts: Sequence[str]) -> np.ndarray:
        return normalised(np.stack([self._one(t.encode()) for t in texts]))


# -- what reads videos and pictures


class Frame(NamedTuple):
    """A decoded frame: ``pts`` in units of ``time_base``, or None, and the grey picture."""

    index: int
    pts: int | None
    time_base: Fraction
    rate: Fraction
    grey: np.ndarray

    @property
    def time_ms(self) -> int:
        """Exact, half to even; from the frame number where there is no ``pts``."""
        return round((self.index / self.rate if self.pts is None else self.pts * self.time_base) * 1000)


class Decoder(Protocol):
    rate: Fraction

    def frames(self, path: str) -> Iterator[Frame]: ...


class ShotDetector(Protocol):
    def detect(self, frames: Iterator[Frame]) -> tuple[list[tuple[int, int]], int]:
        """First and last frame of each scene, and the number of frames seen."""


class PictureReader(Protocol):
    """Text (``text, score, box``) or objects (``label, score, box``) of each picture; boxes are shares of the picture."""

    def read(self, pictures: Sequence[bytes]) -> list[list[dict[str, Any]]]: ...


class Transcriber(Protocol):
    def transcribe(self, path: str) -> list[tuple[float, float, str]]:
        """Start, end (seconds of the track) and text of each segment."""


class ArrayDecoder:
    """Stand-in: a video is an ``.npy`` file of grey frames (n, height, width)."""

    def __init__(self, rate: str = "25", time_base: str = "1/12800"):
        self.rate, self.time_base = Fraction(rate), Fraction(time_base)

    def frames(self, path: str) -> Iterator[Frame]:
        for i, grey in enumerate(np.load(path.removeprefix("file:"), mmap_mode="r")):
            yield Frame(i, round(i / self.rate / self.time_base), self.time_base, self.rate, np.asarray(grey, np.uint8))


class CutDetector:
    """Stand-in: a scene ends where the mean change of grey levels is large."""

    def __init__(self, least: float = 30.0):
        self.least = least

    def detect(self, frames: Iterator[Frame]) -> tuple[list[tuple[int, int]], int]:
        starts, last, n = [0], None, 0
        for frame in frames:
            grey = frame.grey.astype(np.int16)
            if last is not None and np.abs(grey - last).mean() > self.least:
                starts.append(frame.index)
            last, n = grey, n + 1
        return [(a, b - 1) for a, b in zip(starts, [*starts[1:], n])] if n else [], n


class HashReader:
    """Stand-in: the picture's bytes decide the words or labels."""

    def __init__(self, field: str = "text", words: Sequence[str] = ("mot", "hai", "ba", "bon")):
        if not words:
            raise ValueError(f"nothing to look for: no {field} was named")
        self.field, self.words = field, list(words)

    def read(self, pictures: Sequence[bytes]) -> list[list[dict[str, Any]]]:
        marks = [hashlib.sha256(bytes(p)).digest() for p in pictures]
        return [[{self.field: self.words[m[i] % len(self.words)], "score": m[i + 8] / 255, "box": [0.0, 0.0, 1.0, 1.0]} for i in range(m[31] % 3)] for m in marks]


class HashTranscriber:
    """Stand-in: a segment a second for as long as the path's hash says."""

    def transcribe(self, path: str) -> list[tuple[float, float, str]]:
        mark = hashlib.sha256(path.rpartition("/")[2].encode()).digest()
        return [(float(i), i + 0.8, f"cau {mark[i]}") for i in range(1 + mark[31] % 4)]


def options(given: Mapping[str, Any], known: Sequence[str]) -> dict[str, Any]:
    """The settings that are set, so that a library's own defaults hold for the rest."""
    return {name: given[name] for name in known if given.get(name) is not None}


def device(name: str | None) -> tuple[str, int]:
    """Kind and number of a device: ``cuda:1`` is ("gpu", 1); none is the processor."""
    kind, _, number = (name or "cpu").partition(":")
    return ("gpu" if kind in ("cuda", "gpu") else kind), int(number or 0)


#: Encoders by name; a deployment adds its own.
ENCODERS: dict[str, Callable[[], Encoder]] = {"hash": HashEncoder}
#: What the offline jobs use, by role; a deployment puts its own in place of the stand-ins.
MODELS: dict[str, Callable[..., Any]] = {
    "decoder": ArrayDecoder,
    "shots": CutDetector,
    "ocr": HashReader,
    "objects": lambda words=("person", "car"): HashReader("label", words),
    "asr": HashTranscriber,
}


def load_encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"no encoder {name!r}; there are: {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name]()


def translator(generate: Callable[[str], str], source: str = "vi", target: str = "en") -> Callable[[str], str]:
    """A sequence model that marks languages as ``vi: ...`` as a function of plain texts."""
    return lambda text: generate(f"{source}: {text}").removeprefix(f"{target}:").strip()


def in_batches(rows: DataFrame, column: str, make: Callable[[], Callable[[list[Any]], Sequence[Any]]], into: str, kind: str, batch_size: int = 16) -> DataFrame:
    """``rows`` with ``into``: the model's outputs for ``column``, batch by batch, and ``error`` where a batch failed.

    A failing batch is tried row by row, so one bad input costs its own row only. Too few or too many
    outputs for a batch are an error.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{into}` {kind}", "error string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def outputs(items: list[Any]) -> list[Any]:
            found = list(model(items))
            if len(found) != len(items):
                raise ValueError(f"{len(found)} outputs for {len(items)} inputs")
            return found

        for frame in frames:
            results: list[Any] = []
            errors: list[str | None] = []
            for at in range(0, len(frame), batch_size):
                items = frame[column].iloc[at : at + batch_size].tolist()
                try:
                    results += outputs(items)
                    errors += [None] * len(items)
                except Exception:
                    for item in items:
                        try:
                            results += outputs([item])
                            errors.append(None)
                        except Exception as failed:
                            results.append(None)
                            errors.append(f"{type(failed).__name__}: {failed}")
            yield frame.assign(**{into: results, "error": errors})

    return rows.mapInPandas(run, schema)


def embed(pictures: DataFrame, column: str, encoder: str, batch_size: int = 16) -> DataFrame:
    """Pictures with their ``vector``."""
    return in_batches(pictures, column, lambda: lambda items: [v.tolist() for v in load_encoder(encoder).encode_images(items)], "vector", "array<float>", batch_size)


def embed_texts(texts: DataFrame, column: str, encoder: Callable[[], Encoder], translate: Callable[[str], str] | None = None, batch_size: int = 16) -> DataFrame:
    """Texts with their ``vector``; a text that cannot be encoded is an error, as its query would find nothing."""

    def make() -> Callable[[list[Any]], Sequence[Any]]:
        model = encoder()
        return lambda items: [v.tolist() for v in model.encode_texts([translate(t) for t in items] if translate else items)]

    done = in_batches(texts, column, make, "vector", "array<float>", batch_size)
    return done.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))).drop("error")
