"""Column functions over arrays of numbers, and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.errors import EmbeddingError
from candlewick.functions.text import let

VECTOR = T.ArrayType(T.DoubleType())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return let(v, lambda v: let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def clamped(score: Column) -> Column:
    """From -1 to 1; NaN stays NaN."""
    return F.when(F.isnan(score), score).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def checked(score: Column, slack: float | None = None) -> Column:
    """clamped(), but raises for a score that is no number, and given a slack for one farther than that from -1 to 1."""
    wrong = F.isnan(score) if slack is None else F.isnan(score) | (F.abs(score) > 1 + slack)
    return F.when(wrong, F.raise_error(F.concat(F.lit("a score is out of range: "), score.cast("string")))).otherwise(clamped(score))


def percentile(ordered: Column, share: float) -> Column:
    """The percentile of an ordered array by linear interpolation between its neighbours; share from 0 to 1."""
    at = F.lit(float(share)) * (F.size(ordered) - 1)

    def between(at: Column) -> Column:
        low = F.get(ordered, F.floor(at).cast("int"))
        high = F.get(ordered, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return let(at, between)


class Embedder:
    """Maps texts to unit vectors. name tells indexes of different embedders apart."""

    name = "embedder"

    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of the texts, a row each, computed where it is called. No texts, or a model that fails, raise."""
        if not texts:
            raise EmbeddingError("there are no texts to encode")
        try:
            m = np.asarray(self.raw(texts), dtype="float64")
        except Exception as e:
            raise EmbeddingError(f"{type(e).__name__}: {e}") from e
        m = m.reshape(1, -1) if m.ndim == 1 else m
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norms > 0, norms, 1)

    def raw(self, texts: list[str]):
        """A matrix for some texts, of any length."""
        raise NotImplementedError

    def vector(self, text: Column) -> Column:
        raise NotImplementedError

    def vectors(self, texts: Column) -> Column:
        """Of an array of texts an array of vectors."""
        return F.transform(texts, self.vector)

    #: Whether vectors() may stand inside a lambda.
    native = True


class KeywordEmbedder(Embedder):
    """One dimension a topic, the number of its keywords that the lower-cased text contains, and one for length."""

    def __init__(self, topics: Sequence[Sequence[str]], length_weight: float = 0.001, name: str = "keywords"):
        self.topics, self.length_weight, self.name = topics, length_weight, name

    def vector(self, text: Column) -> Column:
        def counted(low: Column) -> Column:
            found = [sum((F.contains(low, F.lit(w)).cast("double") for w in words), F.lit(0.0)) for words in self.topics]
            return F.array(*found, F.length(text) * F.lit(self.length_weight))

        return unit(let(F.lower(text), counted))

    def raw(self, texts: list[str]):
        lowered = [x.lower() for x in texts]
        return [[*(sum(w in low for w in words) for words in self.topics), len(x) * self.length_weight] for x, low in zip(texts, lowered)]


class LookupEmbedder(Embedder):
    """Vectors of known texts; others are null, or an error in encode(). For small fixed vocabularies."""

    def __init__(self, known: dict[str, Sequence[float]], name: str = "lookup"):
        self.known, self.name = known, name

    def vector(self, text: Column) -> Column:
        if not self.known:
            return F.lit(None).cast(VECTOR)
        pairs = [x for k, v in self.known.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))]
        return unit(F.element_at(F.create_map(*pairs), text))

    def raw(self, texts: list[str]):
        return [self.known[x] for x in texts]


class ModelEmbedder(Embedder):
    """A model with encode(list of texts) that gives a matrix, run in Arrow batches; load is called once a worker."""

    native = False

    def __init__(self, load: Callable[[], object], name: str):
        self.load, self.name, self.model = load, name, None

    def __getstate__(self):
        return {"load": self.load, "name": self.name, "model": None}

    def raw(self, texts: list[str]):
        if self.model is None:
            self.model = self.load()
        return self.model.encode(texts)

    def _udf(self):
        encode = self.encode

        @F.pandas_udf(T.ArrayType(VECTOR))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                flat = [x for texts in batch if texts is not None for x in texts]
                found = iter(encode(flat).tolist() if flat else [])
                yield pd.Series([None if texts is None else [next(found) for _ in texts] for texts in batch], index=batch.index, dtype=object)

        return run

    def vectors(self, texts: Column) -> Column:
        return self._udf()(texts)

    def vector(self, text: Column) -> Column:
        return F.element_at(self.vectors(F.array(text)), 1)


def sentence_model(name: str) -> ModelEmbedder:
    """An embedder over a sentence-transformers model, which must be installed where the workers run."""

    def load():
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name)

    return ModelEmbedder(load, name)
