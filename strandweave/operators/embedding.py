"""Embedding of texts by a pluggable model; without one, by hashing words.

A model is a callable from a list of texts to a matrix; it is made once a task by its loader.  Rows
are brought to unit length, and a row of zeros stays as it is.  A null text is an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HASHED_DIMS = 64


def hashed_words(texts: list[str], dims: int = HASHED_DIMS) -> np.ndarray:
    """Signed counts of words' MD5 buckets: the first eight hex digits give the place, the ninth the sign."""
    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts):
        for word in text.lower().split():
            digest = hashlib.md5(word.encode()).hexdigest()
            row[int(digest[:8], 16) % dims] += 1 if int(digest[8], 16) % 2 else -1
    return out


class Model(NamedTuple):
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    query_prefix: str = ""


#: Models by name; `register` adds others.
MODELS: dict[str, Model] = {"hashed": Model(lambda: hashed_words)}


def register(name: str, model: Model) -> None:
    if name in MODELS:
        raise ValueError(f"there is a model {name!r} already")
    MODELS[name] = model


def unit_rows(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1, lengths)


def embed(units: DataFrame, model: str = "hashed", as_query: bool = False) -> DataFrame:
    """id, model, vec of units (id, text); with `as_query` the model's prefix for queries stands before each text."""
    chosen = MODELS[model]
    prefix = chosen.query_prefix if as_query else ""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for part in parts:
            if part.num_rows:
                call = call or chosen.load()
                vectors = unit_rows(np.asarray(call([prefix + (t or "") for t in part.column("text").to_pylist()]), np.float64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([model] * part.num_rows), pa.array(list(vectors), pa.list_(pa.float64()))], names=["id", "model", "vec"])

    return units.select("id", "text").mapInArrow(encode, "id long, model string, vec array<double>")


def theme_seeds(themes: DataFrame, model: str = "hashed") -> DataFrame:
    """Free texts (id, text) as seeds: id, book_id and author (null, so that nothing is excluded), vec."""
    from pyspark.sql import functions as F

    return embed(themes, model, as_query=True).select("id", F.lit(None).cast("string").alias("book_id"), F.lit(None).cast("string").alias("author"), "vec")
