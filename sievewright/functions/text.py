"""Columns over strings and bytes: printable runs, entropy, counters, names, digests, flags. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two printable classes in use (dissection, record statistics) and the shortest run.
DISSECT_RUN = "[\\x20-\\x7e]{5,}"
RECORD_RUN = "[\\x20-\\x7f]{5,}"
#: Counters over whole files.
COUNTERS = {"paths": "(?i)c:\\\\", "urls": "(?i)https?://", "registry": "HKEY_", "mz": "MZ"}


def latin(content: Column) -> Column:
    """Bytes as a string of the same length, one character a byte."""
    return F.decode(content, "ISO-8859-1")


def printable_runs(text: Column, pattern: str = DISSECT_RUN, most: int | None = None) -> Column:
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(runs, F.lit(1), F.lit(most)) if most else runs


def counters(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n_{name}") for name, p in COUNTERS.items()]


def norm_api(name: Column) -> Column:
    """One trailing A or W off, Zw as Nt, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[AW]$", ""), "^Zw", "Nt"))


def flag_names(value: Column, table: list[tuple[int, str]]) -> Column:
    """Names of the bits set in ``value``, in the table's order."""
    lut = F.array(*(F.struct(F.lit(bit).cast("long").alias("bit"), F.lit(name).alias("name")) for bit, name in table))
    return F.transform(F.filter(lut, lambda b: value.cast("long").bitwiseAND(b["bit"]) != 0), lambda b: b["name"])


def enum_name(value: Column, table: dict[int, str], other: Column) -> Column:
    lut = F.create_map(*(F.lit(x) for k, v in table.items() for x in (int(k), v)))
    return F.coalesce(F.try_element_at(lut, value.cast("int")), other)


def import_digest(imports: Column) -> Column:
    """md5 over ``library.function`` in order, lower case, one of each library ending taken off in turn; '' for none.

    ``imports``: array<struct<dll, functions>>, order counts.
    """
    stem = lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(d), "\\.dll$", ""), "\\.ocx$", ""), "\\.sys$", "")
    parts = F.flatten(F.transform(imports, lambda i: F.transform(i["functions"], lambda f: F.concat(stem(i["dll"]), F.lit("."), F.lower(f)))))
    return F.when(F.size(parts) > 0, F.md5(F.array_join(parts, ","))).otherwise("")


def hex_prefix_share(digest: Column, share: float) -> Column:
    """A fixed sample: rows whose digest's first 16 bits lie below ``share`` of their range."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") < int(share * 65536)


def char_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """key -> Shannon entropy in bits over the characters of ``text``, 0 for the empty text; counting in two narrow aggregations."""
    chars = df.select(key, F.explode_outer(F.split(text, "")).alias("c"))
    counts = chars.filter("c IS NULL OR c <> ''").groupBy(key, "c").agg(F.count("c").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n"))).alias("nlog"))
    return total.select(key, F.coalesce(F.log2("all") - F.col("nlog") / F.col("all"), F.lit(0.0)).alias("entropy"))
