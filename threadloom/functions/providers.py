"""Model providers: what the engine asks of language and embedding models, and offline stand-ins.

A completion provider maps a prompt to a reply. Replies can be replayed from a table
keyed by the prompt's hash; what it does not hold goes to the provider. The offline
defaults are deterministic and make no claim to a model's quality.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Completion = Callable[[str], str]
WIDTH = 64


def with_retries(call: Completion, times: int = 2, wait: float = 1.0) -> Completion:
    def run(prompt: str) -> str:
        for i in range(times + 1):
            try:
                return call(prompt)
            except OSError:
                if i == times:
                    raise
                time.sleep(wait * 2**i)
        raise AssertionError

    return run


def rate_limited(call: Completion, per_second: float) -> Completion:
    """At most so many calls a second in each task."""
    last = [0.0]

    def run(prompt: str) -> str:
        pause = last[0] + 1 / per_second - time.monotonic()
        if pause > 0:
            time.sleep(pause)
        last[0] = time.monotonic()
        return call(prompt)

    return run


def complete(prompts: DataFrame, call: Completion, replay: DataFrame | None = None) -> DataFrame:
    """Adds ``reply`` to (id, prompt): replayed where ``replay`` (key, reply) holds the prompt's
    SHA-256, asked otherwise. A failed call has a null reply."""
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))
    keyed = keyed.join(replay, "key", "left") if replay is not None else keyed.withColumn("reply", F.lit(None).cast("string"))

    def run(batches):
        for b in batches:
            out = []
            for p, r in zip(b.column("prompt").to_pylist(), b.column("reply").to_pylist(), strict=True):
                try:
                    out.append(r if r is not None else call(p))
                except (OSError, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if c != "reply"} | {"reply": pa.array(out, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name != "reply")
    return keyed.mapInArrow(run, f"{schema}, reply string")


def offline_entities(text: str) -> list[str]:
    """Capitalised runs that do not start a sentence: a stand-in for entity extraction."""
    return list(dict.fromkeys(m[0] for m in re.finditer(r"(?<![.!?\n] )(?<!^)\b[A-Z]\w+(?: [A-Z]\w+)*", text)))


def offline_vector(text: str) -> np.ndarray:
    """Signed hashed word counts, scaled to length 1."""
    v = np.zeros(WIDTH)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % WIDTH] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(documents: DataFrame, vector: Callable[[str], np.ndarray] = offline_vector) -> DataFrame:
    """doc_id and embedding of each text; null texts count as empty."""

    def run(batches):
        for b in batches:
            v = [vector(t or "").astype(np.float32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "embedding": pa.array(v, pa.list_(pa.float32()))})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, embedding array<float>")
