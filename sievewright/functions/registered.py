"""Functions for SQL: ``register`` puts them into a session's catalog."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import pe
from .hashing import murmur3


@F.pandas_udf("long")
def murmur3_signed(s: pd.Series) -> pd.Series:
    """Signed 32-bit MurmurHash3 (seed 0) of a text's UTF-8 bytes."""
    h = pd.Series(murmur3(pa.array(s, pa.string(), from_pandas=True)).view(np.int32).astype(np.int64), dtype="Int64")
    return h.mask(s.isna().to_numpy())


@F.pandas_udf("array<long>")
def byte_entropy_hist(b: pd.Series) -> pd.Series:
    return b.map(lambda x: pe.byte_entropy(np.frombuffer(x or b"", np.uint8)).tolist())


@F.udtf(returnType="name: string, virtual_address: long, raw_size: long, entropy: double")
class PeSections:
    """A row for each section of a file; none for what can't be read."""

    def eval(self, content: bytes):
        try:
            sections = pe.dissect(bytes(content or b""))["sections"]
        except pe.ParseError:
            return
        for s in sections:
            yield s["name"], s["virtual_address"], s["raw_size"], s["entropy"]


@F.pandas_udf("double")
def binom_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided p of k successes in n trials at one half; 1 without trials, null with a null one."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else binomial_p(int(a), int(b)) for a, b in zip(k, n, strict=True)], dtype=float)


def binomial_p(k: int, n: int) -> float:
    from math import exp, lgamma, log

    k = min(k, n - k)
    return min(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2)) for i in range(k + 1))) if n else 1.0


def register(spark: SparkSession) -> None:
    """murmur3_signed(text), binom_two_sided(k, n), byte_entropy_hist(binary) and the table function pe_sections(binary)."""
    spark.udf.register("murmur3_signed", murmur3_signed)
    spark.udf.register("byte_entropy_hist", byte_entropy_hist)
    spark.udf.register("binom_two_sided", binom_two_sided)
    spark.udtf.register("pe_sections", PeSections)
