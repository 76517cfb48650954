"""Text to vectors: the embedders' interface, the hashing embedder, and vectors of chunks and queries.

An embedder is built in a Python worker from its name and kept there, so a model is loaded once a worker. No neural
model comes with the library: ``register`` takes a factory for one. The default is a feature hashing of
words, which needs no model and gives the same vectors everywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let, tally, totals
from tessera.functions.text import BLANKS
from tessera.operators.chunk import MODELS

Embedder = Callable[[list[str]], np.ndarray]
_factories: dict[str, Callable[[], Embedder]] = {}
_built: dict[str, Embedder] = {}
_GAPS = str.maketrans({c: " " for c in BLANKS})
AT_ONCE = 64  # texts that an embedder gets together


def hashed(dims: int) -> Embedder:
    """A lower-cased word's MD5 picks its place; counts are L2-normalised; a text without words is all zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        out, places = np.zeros((len(texts), dims)), {}
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().translate(_GAPS).split(" "):
                if word:
                    at = places.get(word)
                    if at is None:
                        at = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims
                    row[at] += 1
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm == 0, 1, norm)

    return embed


def register(model: str, factory: Callable[[], Embedder]) -> None:
    """``factory`` builds the model's embedder in a worker. It travels with the plan, so it must be picklable."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    _factories[model] = factory


def _embedder(model: str, factory: Callable[[], Embedder] | None, dims: int) -> Embedder:
    if model not in _built:
        _built.clear()  # one model a worker
        _built[model] = factory() if factory else hashed(dims)
    return _built[model]


def _run(model: str, factory, dims: int, at: int, name: str, kind):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                texts = [t or "" for t in part.column(at).to_pylist()]
                vectors = np.asarray(_embedder(model, factory, dims)(texts), kind)
                if vectors.shape != (len(texts), dims):
                    raise ValueError(f"{model} gave vectors of shape {vectors.shape}, not {(len(texts), dims)}")
                ends = np.arange(len(texts) + 1, dtype=np.int32) * dims
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))], [*part.schema.names, name])

    return run


def embed(texts: DataFrame, model: str = "all-MiniLM-L6-v2", text_col: str = "content", vector_col: str = "embedding", double: bool = False) -> DataFrame:
    """The rows with their text's vector (floats, or doubles); a null text is embedded as an empty one."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    shape = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + f", `{vector_col}` array<{'double' if double else 'float'}>"
    return texts.mapInArrow(_run(model, _factories.get(model), MODELS[model], texts.columns.index(text_col), vector_col, np.float64 if double else np.float32), shape)


def encode_query(query: str, model: str = "all-MiniLM-L6-v2") -> list[float]:
    """One query's vector, on the driver."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    factory = _factories.get(model)
    return [float(x) for x in np.asarray((factory() if factory else hashed(MODELS[model]))([query]), np.float32)[0]]


def hash_embed(docs: DataFrame, tokens: Column, id_col: str = "doc_id", dims: int = 384) -> DataFrame:
    """(id, bucket, weight): the hashing embedder's vectors as sparse rows. Each row is counted by itself, without a shuffle;
    a row without tokens gives none."""
    place = lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % dims
    words = tally(F.transform(tokens, F.lower))  # a word that comes again is hashed once
    bucket = F.transform(words, lambda x: F.struct(place(x["value"]).alias("value"), x["n"].cast("long").alias("n")))
    squares = lambda t: F.sqrt(F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["n"]).cast("double"))
    weighed = let(totals(bucket), lambda t: let(squares(t), lambda norm: F.transform(t, lambda x: F.struct(x["value"].alias("bucket"), F.round(x["n"] / norm, 6).alias("weight")))))
    return docs.select(id_col, F.explode(weighed).alias("x")).select(id_col, "x.*")
