"""Text encoders: one per worker, batches of texts alike in length, explicit pooling of token vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("mean", "cls", "last_token")
#: Texts of a batch, and tokens with their padding, at most (one text may have more).
BATCH_ROWS, BATCH_TOKENS = 256, 65_536


class Encoder(Protocol):
    """What a model has to give: the number of a text's tokens, and for a batch the token vectors (texts x tokens x
    width) with their mask (1 for a token, 0 for padding)."""

    def length(self, text: str) -> int: ...

    def hidden(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]: ...


def pool(hidden: np.ndarray, mask: np.ndarray, mode: str) -> np.ndarray:
    """One vector per text: the mean over its tokens, its first token's (``cls``) or its last token's vector.

    Another mode, shapes that don't fit, a text without tokens, and for ``cls`` a masked first token are errors."""
    if mode not in MODES:
        raise ValueError(f"pooling must be one of {MODES}")
    if hidden.ndim != 3 or mask.ndim != 2 or hidden.shape[:2] != mask.shape:
        raise ValueError("token vectors and mask don't fit together")
    used = mask != 0
    if not used.any(1).all():
        raise ValueError("a text's mask is empty")
    if mode == "cls":
        if not used[:, 0].all():
            raise ValueError("a text's first token is masked")
        return hidden[:, 0]
    if mode == "last_token":
        return hidden[np.arange(len(hidden)), mask.shape[1] - 1 - used[:, ::-1].argmax(1)]
    return (hidden * used[:, :, None]).sum(1) / used.sum(1)[:, None]


class HashedTokens:
    """A stand-in for a model: a token's vector is drawn from its hash, with a little of the mean of those before it, so
    that order counts; a start token comes first, so no text is without tokens. Longer texts are cut to ``most`` tokens."""

    def __init__(self, width: int = 64, most: int = 512, padding: str = "right") -> None:
        self.width, self.most, self.padding, self.known = width, most, padding, {}

    def tokens(self, text: str) -> list[str]:
        return ["<start>", *text.lower().split()][: self.most]

    def length(self, text: str) -> int:
        return min(self.most, 1 + len(text.split()))

    def vector(self, token: str) -> np.ndarray:
        if token not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            raw = np.frombuffer(hashlib.shake_128(token.encode("utf-8")).digest(4 * self.width), "<u4")
            self.known[token] = raw / 2**31 - 1.0
        return self.known[token]

    def hidden(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self.tokens, texts))
        longest = max(map(len, split))
        out, mask = np.zeros((len(texts), longest, self.width)), np.zeros((len(texts), longest), np.int64)
        for k, tokens in enumerate(split):
            v = np.array(list(map(self.vector, tokens)))
            seen = np.cumsum(v, 0) - v
            at = slice(0, len(tokens)) if self.padding == "right" else slice(longest - len(tokens), longest)
            out[k, at], mask[k, at] = v + 0.25 * seen / np.maximum(np.arange(len(v)), 1)[:, None], 1
        return out, mask


def batches_of(lengths: list[int], rows: int = BATCH_ROWS, tokens: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Places of texts in batches, from the longest to the shortest; with padding a batch has up to ``tokens`` tokens."""
    held: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        if held and (len(held) == rows or lengths[held[0]] * (len(held) + 1) > tokens):
            yield held
            held = []
        held.append(k)
    if held:
        yield held


def encode_texts(df: DataFrame, text: str, make: Callable[[], Encoder] = HashedTokens, modes: tuple[str, ...] = ("mean",), normalise: bool = True, rows: int = BATCH_ROWS, tokens: int = BATCH_TOKENS) -> DataFrame:
    """Adds an array per mode, named by it: the pooled vector, of length 1 with ``normalise`` (zero vectors stay zero).

    Each distinct text is encoded once, null like an empty one, and joined back by its digest. ``make`` builds the encoder
    once per task, before its first batch; batches bring texts alike in length together."""
    for m in modes:
        if m not in MODES:
            raise ValueError(f"pooling must be one of {MODES}")
    keyed = df.withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256))
    once = keyed.groupBy("_h").agg(F.min(F.coalesce(text, F.lit(""))).alias("_t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            texts = part["_t"].tolist()
            for at in batches_of(list(map(model.length, texts)), rows, tokens):
                hidden, mask = model.hidden([texts[k] for k in at])
                out: dict[str, list] = {}
                for m in modes:
                    v = pool(hidden, mask, m).astype(np.float64)
                    if normalise:
                        n = np.sqrt((v * v).sum(1, keepdims=True))
                        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
                    out[m] = list(v)
                del hidden, mask
                yield pd.DataFrame({"_h": part["_h"].to_numpy()[at], **out})  # a batch's vectors are all that is held

    vectors = once.mapInPandas(run, "_h string, " + ", ".join(f"`{m}` array<double>" for m in modes))
    return keyed.join(vectors, "_h").drop("_h")
