"""Pluggable text encoders and language models, with offline stand-ins."""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Turns texts into vectors of one width; it is sent to the tasks."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    """Answers a prompt; it is sent to the tasks."""

    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Character trigrams hashed to ``dim`` places with signs, to unit length."""

    dim: int = 384

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            low = f" {t.lower()} "
            for j in range(len(low) - 2):
                h = zlib.crc32(low[j : j + 3].encode("utf-8", "surrogatepass"))
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class CannedModel:
    """Replies with the first entry whose key the prompt holds; for tests and offline runs."""

    replies: tuple[tuple[str, str], ...] = ()
    otherwise: str = ""

    def __call__(self, prompt: str) -> str:
        return next((r for k, r in self.replies if k in prompt), self.otherwise)


def encode(texts: DataFrame, encoder: Encoder, batch: int = 256) -> DataFrame:
    """``texts(id, text)`` -> ``(id, embedding)``; a batch that fails is tried text by text, a text that fails has none."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            said = s.fillna("").tolist()
            out: list = []
            for i in range(0, len(said), batch):
                block = said[i : i + batch]
                try:
                    out += encoder(block).astype(np.float32).tolist()
                except Exception:  # noqa: BLE001  an encoder may fail in any way; its texts are retried alone
                    out += [_one(encoder, t) for t in block]
            yield pd.Series(out)

    return texts.select("id", vectors("text").alias("embedding"))


def _one(encoder: Encoder, text: str) -> list[float] | None:
    try:
        return encoder([text]).astype(np.float32)[0].tolist()
    except Exception:  # noqa: BLE001
        return None


#: What an overloaded service says.
RATE_LIMITS = ["rate limit", "429", "tpm", "too many requests", "quota exceeded", "limit exceeded"]


def is_rate_limit(error: str) -> bool:
    """Whether an error message speaks of too many requests."""
    low = error.lower()
    return any(s in low for s in RATE_LIMITS)


@dataclass(frozen=True)
class Retrying:
    """A model that is asked again when it fails: at once more slowly if it says it is overloaded."""

    model: Callable[[str], str]
    tries: int = 20
    pause: float = 2.0

    def __call__(self, prompt: str) -> str:
        for attempt in range(1, self.tries + 1):
            try:
                return self.model(prompt)
            except Exception as e:  # noqa: BLE001  a remote model may fail in any way
                if attempt == self.tries:
                    raise
                time.sleep(self.pause * (attempt if is_rate_limit(str(e)) else 1) * (1 + random.random() / 10))
        raise ValueError("no tries")


def ask(prompts: DataFrame, model: Model) -> DataFrame:
    """``prompts(id, prompt)`` -> ``(id, reply)``; a prompt that fails for good has a null reply and stops nothing."""

    @F.pandas_udf("string")
    def replies(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for p in s:
                try:
                    out.append(model(p or ""))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return prompts.select("id", replies("prompt").alias("reply"))


def prompt(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
