"""Embedding chunks: a callable for each batch, and a deterministic hash embedder."""

from __future__ import annotations

import hashlib
import json
import struct
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .history import missing_embeddings

DIM, BATCH, TIMEOUT = 384, 64, 300


class Failed(Exception):
    """The embedder gave no answer, or not one vector of the right size for each text."""


def sidecar(command: list[str], timeout: float = TIMEOUT) -> Callable[[list[str]], list[list[float]]]:
    """An embedder that is another program: JSON lines {id, text} in, {id, vector} out."""

    def ask(texts: list[str]) -> list[list[float]]:
        given = "".join(json.dumps({"id": str(i), "text": t}) + "\n" for i, t in enumerate(texts))
        try:
            done = subprocess.run(command, input=given, capture_output=True, text=True, timeout=timeout, check=True)
            rows = [json.loads(x) for x in done.stdout.splitlines() if x.strip()]
            found = {r["id"]: r["vector"] for r in rows}
            return [found[str(i)] for i in range(len(texts))]
        except subprocess.CalledProcessError as e:
            raise Failed(f"exit code {e.returncode}: {e.stderr.strip()[:800]}") from e
        except (OSError, subprocess.TimeoutExpired) as e:
            raise Failed(str(e)) from e
        except (ValueError, TypeError, KeyError) as e:
            raise Failed(f"not one line with id and vector for each text: {e!r}") from e

    return ask


def checked(vectors: list[list[float]], count: int, dim: int) -> list[list[float]]:
    if len(vectors) != count or any(len(v) != dim for v in vectors):
        raise Failed(f"{count} vectors of {dim} numbers were wanted")
    return vectors


def embed_query(query: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, dim: int = DIM, prefix: str = "") -> list[float]:
    """The vector of a query: its own prefix, no heading."""
    return checked((embedder or (lambda texts: [hash_vector(x, dim) for x in texts]))([prefix + query]), 1, dim)[0]


def pack_vector(values: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return values.map(lambda v: np.asarray(v, "<f4").tobytes())


def unpack_vector(values: pd.Series) -> pd.Series:
    return values.map(lambda b: np.frombuffer(b, "<f4").tolist())


def hash_vector(text: str, dim: int = DIM) -> list[float]:
    """A unit vector from SHA-256 blocks of the text and a counter."""
    raw = b"".join(hashlib.sha256(text.encode() + struct.pack(">I", i)).digest() for i in range(-(-dim // 8)))
    v = np.frombuffer(raw, ">u4")[:dim].astype(np.float64) / 0xFFFFFFFF * 2 - 1
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).astype(np.float32).tolist()


def embed(chunks: DataFrame, embeddings: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None, dim: int = DIM, model: str = "hash", batch: int = BATCH) -> DataFrame:
    """(embed_sha, model, dim, vec) for the chunks (embed_sha, input) that have no vector yet.

    A wrong number or size of vectors fails the task, which Spark tries again.
    """
    embedder = embedder or (lambda texts: [hash_vector(x, dim) for x in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = checked(embedder(part["input"].tolist()), len(part), dim)
                yield pd.DataFrame({"embed_sha": part["embed_sha"].to_numpy(), "model": model, "dim": dim, "vec": vectors})

    need = missing_embeddings(chunks, embeddings).select("embed_sha", "input")
    return need.mapInPandas(run, "embed_sha string, model string, dim int, vec array<float>")
