"""Model providers: what calls out of Spark, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Both calls keep the order of what they are given."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def complete(self, prompts: list[str]) -> list[str]: ...


class HashProvider:
    """A stand-in: vectors and answers that depend on the text alone."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in filter(None, re.split(r"[\x09-\x0D ]+", t.lower())):
                h = int(hashlib.md5(w.encode()).hexdigest()[:12], 16)
                v[h % self.dimensions] += 1 if h // self.dimensions % 2 else -1
            out.append((v / max(1.0, float(np.linalg.norm(v)))).tolist())
        return out

    def complete(self, prompts: list[str]) -> list[str]:
        return [hashlib.sha256(p.encode()).hexdigest()[:16] for p in prompts]


def embed(rows: DataFrame, provider: Provider, text: str = "content", vector: str = "embedding", batch: int = 50, calls: int | None = None) -> DataFrame:
    """Rows with the vectors that they lack, in the type of the column; each text is sent once, ``batch`` at a time, over at
    most ``calls`` tasks."""

    @F.pandas_udf(rows.schema[vector].dataType)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[list[float]] = []
            for k in range(0, len(s), batch):
                out += provider.embed(s.iloc[k : k + batch].fillna("").tolist())
            yield pd.Series(out, index=s.index)

    lacking = rows.where(F.col(vector).isNull())
    if calls:
        lacking = lacking.repartition(calls)
    return rows.where(F.col(vector).isNotNull()).unionByName(lacking.withColumn(vector, run(F.col(text))))


def complete(rows: DataFrame, provider: Provider, prompt: str = "prompt", answer: str = "answer", batch: int = 50) -> DataFrame:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[str] = []
            for k in range(0, len(s), batch):
                out += provider.complete(s.iloc[k : k + batch].tolist())
            yield pd.Series(out, index=s.index)

    return rows.withColumn(answer, run(F.col(prompt)))
