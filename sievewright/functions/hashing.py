"""Signed feature hashing: standard 32-bit murmur3 with seed 0, and the vector blocks built on it.

Spark's own ``hash`` has another seed and treats the last bytes differently, so this is an Arrow kernel of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import sliced

#: The hash's constants.
_C1, _C2, _ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
_FINAL = ((16, 0x85EBCA6B), (13, 0xC2B2AE35))


def _scrambled(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(_C1)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(_C2)


def murmur3(values: pa.Array) -> np.ndarray:
    """Unsigned 32-bit MurmurHash3_x86_32 (seed 0) of the bytes of all strings or binaries; null as empty.

    All values take a step at a time, four bytes each, longest first, so that those still going are a slice.
    """
    wide = values.cast(pa.large_string() if pa.types.is_string(values.type) else pa.large_binary()).cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.concatenate([np.frombuffer(wide.buffers()[2] or b"", np.uint8), np.zeros(4, np.uint8)]) if len(wide) else np.zeros(4, np.uint8)
    size = np.diff(ends)
    order = np.argsort(-(size // 4), kind="stable")
    start, size = ends[:-1][order], size[order]
    blocks = size // 4
    h = np.zeros(len(size), np.uint32)
    word = lambda at: sum(data[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    for k in range(int(blocks[0]) if len(blocks) else 0):
        n = int(np.searchsorted(-blocks, -k, side="left"))
        x = h[:n] ^ _scrambled(word(start[:n] + 4 * k))
        h[:n] = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(_ADD)
    left = size % 4
    tail = word(start + 4 * blocks) & ((np.uint32(1) << (8 * left).astype(np.uint32)) - np.uint32(1))
    h ^= _scrambled(np.where(left > 0, tail, np.uint32(0)))
    h ^= size.astype(np.uint32)
    for shift, factor in _FINAL:
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    h ^= h >> np.uint32(16)
    out = np.empty(len(h), np.uint32)
    out[order] = h
    return out


def cells(tokens: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's cell, |h| mod width with h the signed hash, and its sign; each distinct token is hashed once."""
    coded = tokens.dictionary_encode()
    h = murmur3(coded.dictionary).view(np.int32).astype(np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    return (np.abs(h) % width)[code], np.where(h >= 0, 1.0, -1.0)[code]


#: Tokens that ``hashed_tokens`` turns into numpy arrays at a time, about; a row with more is taken alone.
TOKENS = 100_000


def _pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose lists in ``column`` hold ``most`` values together, one row at least."""
    ends = np.cumsum(np.nan_to_num(pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def hashed_tokens(df: DataFrame, tokens: str, width: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, cell and value: the cells that aren't 0 of each row's signed sums over its ``tokens`` (array of strings; nulls in it are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, "_tokens", TOKENS)):
            lists = batch.column("_tokens")
            row = np.repeat(np.arange(batch.num_rows), np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))
            flat = lists.flatten()
            seen = pa.compute.is_valid(flat).to_numpy(zero_copy_only=False)
            cell, sign = cells(flat.drop_null(), width)
            place, of = np.unique(row[seen] * width + cell, return_inverse=True)
            value = np.bincount(of, weights=sign, minlength=len(place))
            place, value = place[value != 0], value[value != 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{k}").take(pa.array(place // width)) for k in range(len(keep))), pa.array(place % width), pa.array(value)], [*(f"k{k}" for k in range(len(keep))), "cell", "value"])

    chosen = df.select(*(F.col(c).alias(f"k{k}") for k, c in enumerate(keep)), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("_tokens"))
    kinds = ", ".join(f"k{k} {f.dataType.simpleString()}" for k, f in enumerate(chosen.schema.fields[:-1]))
    out = chosen.mapInArrow(run, f"{kinds}, cell long, value double")
    return out.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "cell", "value")


#: Blocks of the hashed vector and their widths.
BLOCKS = {"histogram": 256, "byteentropy": 256, "strings": 104, "general": 10, "header": 62, "section": 255, "imports": 1280, "exports": 128, "datadirectories": 30}


#: Hashed parts in the order in which the kernel returns them, and their widths.
_HASHED = {"machine": 10, "coff": 10, "subsystem": 10, "dll": 10, "magic": 10, "s_size": 50, "s_entropy": 50, "s_vsize": 50, "entry": 50, "props": 50, "dlls": 256, "calls": 1024, "exports": 128}


def hashed_vectors(df: DataFrame, record: str, keep: list[str], entry_token: str = "name") -> DataFrame:
    """``keep`` columns and vector: the 2,381 numbers of a record, block after block. ``entry_token``: the entry section's name as one token, or its characters."""
    if entry_token not in ("name", "chars"):
        raise ValueError("entry_token is 'name' or 'chars'")
    r = F.col(record)
    num = lambda *c: F.array(*(x.cast("double") for x in c))
    doubles = lambda a: a.cast("array<double>")
    share = lambda h: F.transform(doubles(h), lambda x: x / F.greatest(F.aggregate(doubles(h), F.lit(0.0), lambda a, y: a + y), F.lit(1e-12)))
    st, g, coff, opt, secs = r["strings"], r["general"], r["header"]["coff"], r["header"]["optional"], r["section"]["sections"]
    entry = r["section"]["entry"]
    has = lambda s, p: F.array_contains(s["props"], p)
    count = lambda f: F.size(F.filter(secs, f))
    pair = lambda c: F.transform(secs, lambda s: F.struct(s["name"].alias("k"), s[c].cast("double").alias("v")))
    tokens = F.struct(
        F.array(coff["machine"]).alias("machine"), coff["characteristics"].alias("coff"), F.array(opt["subsystem"]).alias("subsystem"), opt["dll_characteristics"].alias("dll"), F.array(opt["magic"]).alias("magic"),
        pair("size").alias("s_size"), pair("entropy").alias("s_entropy"), pair("vsize").alias("s_vsize"),
        (F.array(entry) if entry_token == "name" else F.filter(F.split(entry, ""), lambda c: c != "")).alias("entry"),
        F.flatten(F.transform(F.filter(secs, lambda s: s["name"] == entry), lambda s: s["props"])).alias("props"),
        F.array_distinct(F.transform(r["imports"], lambda i: F.lower(i["dll"]))).alias("dlls"),
        F.flatten(F.transform(r["imports"], lambda i: F.transform(i["functions"], lambda f: F.concat(F.lower(i["dll"]), F.lit(":"), f)))).alias("calls"),
        r["exports"].alias("exports"),
    )
    dist = F.transform(doubles(st["printabledist"]), lambda x: x / F.greatest(st["printables"], F.lit(1)))
    versions = [opt[f"{m}_{v}_version"] for v in ("image", "linker", "operating_system", "subsystem") for m in ("major", "minor")]
    directories = F.flatten(F.transform(F.slice(r["datadirectories"], 1, 15), lambda d: num(d["size"], d["virtual_address"])))
    plain = {
        "p0": F.concat(
            share(r["histogram"]), share(r["byteentropy"]), num(st["numstrings"], st["avlength"], st["printables"]), dist, num(st["entropy"], st["paths"], st["urls"], st["registry"], st["MZ"]),
            num(*(g[c] for c in ("size", "vsize", "has_debug", "exports", "imports", "has_relocations", "has_resources", "has_signature", "has_tls", "symbols")), coff["timestamp"]),
        ),
        "p1": num(
            *versions, opt["sizeof_code"], opt["sizeof_headers"], opt["sizeof_heap_commit"], F.size(secs), count(lambda s: s["size"] == 0), count(lambda s: s["name"] == ""),
            count(lambda s: has(s, "MEM_READ") & has(s, "MEM_EXECUTE")), count(lambda s: has(s, "MEM_WRITE")),
        ),
        "p2": F.slice(F.concat(directories, F.array_repeat(F.lit(0.0), 30)), 1, 30),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All hashed parts of a batch in one crossing to Python: token lists count one each, section lists their value."""
        for batch in sliced(batches):
            parts = {c: np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, -1) for c in ("p0", "p1", "p2")}
            lists = dict(zip([f.name for f in batch.column("t").type], batch.column("t").flatten(), strict=True))
            for name, width in _HASHED.items():
                part = parts[name] = np.zeros((batch.num_rows, width))
                row = np.repeat(np.arange(batch.num_rows), np.nan_to_num(pa.compute.list_value_length(lists[name]).to_numpy(zero_copy_only=False)).astype(np.int64))
                flat = lists[name].flatten()
                keys, weight = (flat.field("k"), np.nan_to_num(flat.field("v").to_numpy(zero_copy_only=False).astype(float))) if name.startswith("s_") else (flat, 1.0)
                cell, sign = cells(keys.fill_null(""), width)
                np.add.at(part, (row, cell), sign * weight)
            order = ["p0", *list(_HASHED)[:5], "p1", *list(_HASHED)[5:], "p2"]
            out = np.concatenate([parts[c] for c in order], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))], [*keep, "vector"])

    chosen = df.select(*keep, tokens.alias("t"), *(c.alias(n) for n, c in plain.items()))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return chosen.mapInArrow(run, f"{kept}, vector array<double>")
