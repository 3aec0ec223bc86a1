"""Model calls behind small interfaces, with deterministic offline defaults.

A client is a Python function over a pandas Series of texts. It runs in Arrow batches on the
workers with retries, so a remote service can take the place of the default.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_embedding(texts: pd.Series, dim: int = 64) -> list[np.ndarray]:
    """Signed feature hashing of words, unit length; zero for text without words."""
    out = []
    for text in texts:
        v = np.zeros(dim, np.float32)
        for w in re.findall(r"\w+", (text or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h >> 31 else -1
        n = float(np.linalg.norm(v))
        out.append(v / n if n else v)
    return out


def with_retry(call: Callable, tries: int = 3, wait: float = 1.0) -> Callable:
    def run(batch: pd.Series):
        for i in range(tries):
            try:
                return call(batch)
            except Exception:
                if i + 1 == tries:
                    raise
                time.sleep(wait * 2**i)

    return run


def embed(text: Column, client: Callable[[pd.Series], list] = hashed_embedding) -> Column:
    call = with_retry(client)

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(call(batch))

    return run(text)
