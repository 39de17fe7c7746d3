"""Embeddings: a hashing embedder that needs no model, half precision, BLOBs."""

from __future__ import annotations

import hashlib
import hmac
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 384
VECTOR = T.ArrayType(T.FloatType())


def hashed(text: str | None, dims: int = DIMS) -> np.ndarray:
    """A unit vector from the words and letter triples of a text; alike texts have alike vectors."""
    out = np.zeros(dims)
    for word in (text or "").lower().split():
        for piece in [word, *(word[i : i + 3] for i in range(max(0, len(word) - 2)))]:
            h = zlib.crc32(piece.encode())
            out[h % dims] += 1 if h & 0x80000000 else -1
    size = np.linalg.norm(out)
    if size < 1e-12:
        out[0] = size = 1.0
    return (out / size).astype(np.float32)


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, dims: int = DIMS):
    """A column function from text to array<float>; load gives a model once for each worker, which takes texts in batches."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load() if load else lambda texts: [hashed(t, dims) for t in texts]
        for texts in batches:
            for some in sliced(texts):
                yield pa.array([np.asarray(v, np.float32) for v in model(some.to_pylist())], pa.list_(pa.float32()))

    return embed


#: Rows of an Arrow batch that become Python objects at a time.
SLICE = 128


def sliced(batch, rows: int = SLICE) -> Iterator:
    """An Arrow array in parts: what a worker holds beside the batch doesn't grow with the batch."""
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def half(vectors) -> Column:
    """Through half precision and back."""
    @F.arrow_udf(VECTOR)
    def rounded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for some in sliced(batch):
                yield pa.array([None if v is None else np.array(v, np.float32).astype(np.float16).astype(np.float32) for v in some.to_pylist()], pa.list_(pa.float32()))

    return rounded(vectors)


@F.pandas_udf(VECTOR)
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; a blob of another length than a multiple of four is null."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.StringType())
def _derived(passwords: pd.Series, salts: pd.Series, iterations: pd.Series) -> pd.Series:
    def made(password, salt, n):
        return None if password is None or salt is None else f"pbkdf2:{n}:{salt}:" + hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), int(n), 32).hex()

    return pd.Series([made(*x) for x in zip(passwords, salts, iterations, strict=True)], dtype=object)


def password_hash(password: Column, salt: Column, iterations: int = 600_000) -> Column:
    """pbkdf2:iterations:salt:key of a password and a salt in hexadecimal."""
    return _derived(password, salt, F.lit(iterations))


@F.pandas_udf(T.BooleanType())
def password_matches(passwords: pd.Series, stored: pd.Series) -> pd.Series:
    """Whether a password is the one that was stored; false for what can't be read. Keys are compared in constant time."""

    def same(password, kept):
        try:
            kind, iterations, salt, key = (kept or "").split(":")
            made = hashlib.pbkdf2_hmac("sha256", (password or "").encode(), bytes.fromhex(salt), int(iterations), len(key) // 2)
            return kind == "pbkdf2" and hmac.compare_digest(made, bytes.fromhex(key))
        except ValueError:
            return False

    return pd.Series([same(*x) for x in zip(passwords, stored, strict=True)])
