"""Vectors of pictures and texts by any model, and what is done with them.

A model is made by a function that workers call once: it returns a function from a
batch (n, 3, size, size) of floats to (n, dim) vectors, and raises where it cannot run.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.hashing import vector_id
from ..operators.items import channel_of

Model = Callable[[np.ndarray], np.ndarray]
VECTORS = "path string, analysis_type string, vector array<float>, error string"
_loaded: dict[str, Model] = {}


@dataclass(frozen=True)
class Preparation:
    """How a picture becomes a model's input: side length, mean and deviation of each channel, and number type."""

    size: int = 224
    mean: tuple[float, float, float] = (0.5, 0.5, 0.5)
    deviation: tuple[float, float, float] = (0.5, 0.5, 0.5)
    half: bool = False

    def __call__(self, rgb: np.ndarray) -> np.ndarray:
        small = pixels.resize_bilinear(rgb, self.size, self.size) / 255.0
        out = ((small - self.mean) / self.deviation).transpose(2, 0, 1)
        return out.astype(np.float16 if self.half else np.float32)


def onnx_model(path: str, providers: Sequence[str] = ("CPUExecutionProvider",)) -> Callable[[], Model]:
    """Maker of a model from a file that every executor can read."""

    def make() -> Model:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=list(providers))
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0]

    return make


def model_folder(base: str, quantisation: str = "FP32") -> str:
    """Folder of a model: that of its full precision has no suffix."""
    return base + {"FP16": "_fp16", "INT8": "_int8"}.get(quantisation.upper(), "")


def model_ready(folder: str, reads_text: bool, quantisation: str = "FP32", vision: str = "visual.onnx", text: str = "text.onnx") -> bool:
    """Whether the files of a model are there: that for pictures, and that for texts if it reads them."""
    return all(os.path.isfile(os.path.join(model_folder(folder, quantisation), f)) for f in ([vision, text] if reads_text else [vision]))


def _model(name: str, make: Callable[[], Model]) -> Model:
    """One model a worker; another name lets the last one go."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = make()
    return _loaded[name]


def embed_pictures(pictures: DataFrame, items: DataFrame, name: str, make: Callable[[], Model], prepare: Preparation = Preparation(), batch: int = 256, ignore_solid: bool = True) -> DataFrame:
    """``path, analysis_type, vector, error`` for each wanted plane of a raster.

    Vectors have length one. A plane that cannot be prepared, or is a solid channel, has no vector but an
    error, and so have the items of a batch that the model fails on; a path without a raster has no row.
    """
    wanted = items.where(F.col("path").isNotNull()).groupBy("path").agg(F.collect_set("analysis_type").alias("types"))  # six types at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, np.ndarray]] = []

        def infer() -> Iterator[pa.RecordBatch]:
            if held:
                try:
                    v = pixels.unit_rows(np.asarray(_model(name, make)(np.stack([x for _, _, x in held]))))
                    yield _vectors([(p, t, row.astype(np.float32), None) for (p, t, _), row in zip(held, v)])
                except Exception as e:  # noqa: BLE001 - whatever a model raises is told by item
                    yield _vectors([(p, t, None, f"{type(e).__name__}: {e}") for p, t, _ in held])
                held.clear()

        for b in batches:
            for path, w, h, data, types in zip(*(b.column(c) for c in ("path", "width", "height", "data", "types"))):
                a = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(h.as_py(), w.as_py(), 4)
                for kind in sorted(types.as_py()):
                    try:
                        plane = pixels.channel_view(a, kind)
                        if ignore_solid and len(kind) == 1 and pixels.is_solid(plane):
                            raise ValueError("solid channel")
                        rgb = pixels.over_black(a) if kind == "Composite" else np.repeat(plane[..., None], 3, axis=-1)
                        held.append((path.as_py(), kind, prepare(rgb)))
                    except ValueError as e:
                        yield _vectors([(path.as_py(), kind, None, str(e))])
                    if len(held) >= batch:
                        yield from infer()
        yield from infer()

    return pictures.join(wanted, "path").mapInArrow(run, VECTORS)


def _vectors(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.list_(pa.float32()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "analysis_type", "vector", "error"])


def embed_text(text: str, tokenize: Callable[[str], np.ndarray], model: Model) -> list[float]:
    """The unit vector of one query, computed by the driver."""
    return pixels.unit_rows(np.asarray(model(tokenize(text)[None])))[0].tolist()


def fingerprints(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of the vector store: those with a vector, under their deterministic id, with their file's metadata where it is known."""
    ok = vectors.where(F.col("vector").isNotNull()).withColumn("channel", channel_of()).select("path", "channel", "vector")
    return ok.join(metadata.drop("channel"), "path", "left").withColumn("id", vector_id(F.col("path"), F.col("channel")))
