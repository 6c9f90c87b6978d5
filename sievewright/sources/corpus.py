"""A synthetic, inert corpus: files with valid headers and tables whose sections hold only filler. Nothing in them can run.

Each row is a pure function of (family, number), so that any executor can make any part of the corpus.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed
from .tables import sliced

#: Functions that no capability rule asks for.
_NEUTRAL = ["ReadFile", "CloseHandle", "HeapFree", "MulDiv", "Beep", "GetACP", "GetVersion", "GetSystemTime", "lstrlen", "SetFilePointer"]


def _families() -> dict[str, tuple[list[str], list[str], bool]]:
    """Family -> functions, texts, packed?

    One family for each high-risk capability rule, named by its technique and importing just what the rule asks for; ``dense``, which looks
    packed; and ``benign``, with windows and neutral functions only.
    """
    texts = lambda name: [f"{name} text number {k}" for k in range(4)]
    out = {"benign": ([*fixed.API_GROUPS["gui"][-6:], *_NEUTRAL[:4]], texts("plain"), False)}
    for r in fixed.RULES:
        if r.high_risk:
            name = r.attack_id.lower().replace(".", "_")
            out[name] = ([*r.all_of, *r.any_of, *_NEUTRAL[:2]], texts(name), False)
    out["dense"] = (["LoadLibraryA", "GetProcAddress"], texts("dense"), True)
    return out


FAMILIES = _families()


def _filler(seed: str, n: int, dense: bool = False) -> bytes:
    """n bytes from a chain of digests: all values if dense, else a few (low entropy)."""
    out = b"".join(hashlib.sha256(f"{seed}/{k}".encode()).digest() for k in range(n // 32 + 1))[:n]
    return out if dense else bytes(b & 0x83 for b in out)


class _Section:
    """Bytes laid out at growing offsets of one section, with the virtual address of each item."""

    def __init__(self, name: str, va: int, flags: int):
        self.name, self.va, self.flags, self.body = name, va, flags, bytearray()

    def put(self, data: bytes, align: int = 4) -> int:
        self.body += b"\0" * (-len(self.body) % align)
        at = self.va + len(self.body)
        self.body += data
        return at


def image(
    imports: dict[str, list[str]], texts: list[str], seed: str, wide: bool = False, packed: bool = False, exports: list[str] = [], dll: bool = False, certificate: bytes = b"", overlay: bytes = b"", delay: dict[str, list[str]] = {}  # noqa: B006
) -> bytes:
    """One file with an import table, strings and the given extras."""
    layout, ordinal = ("<Q", 1 << 63) if wide else ("<I", 1 << 31)
    code = _Section("UPX0" if packed else ".text", 0x1000, 0xE0000020 if packed else 0x60000020)
    code.put(_filler(seed, 0x1800 if packed else 0x600, packed))
    data = _Section(".rdata", 0x4000, 0x40000040)
    for t in texts:
        data.put(t.encode() + b"\0", 1)

    def thunks(functions: list[str]) -> int:
        refs = [ordinal | int(f[7:]) if f.startswith("ordinal") else data.put(b"\0\0" + f.encode() + b"\0", 2) for f in functions]
        return data.put(b"".join(struct.pack(layout, r) for r in [*refs, 0]), 8)

    rows = [struct.pack("<5I", t := thunks(f), 0, 0, data.put(d.encode() + b"\0", 1), t) for d, f in imports.items()]
    directories = [(0, 0)] * 16
    directories[1] = (data.put(b"".join(rows) + bytes(20)), 20 * len(rows) + 20)
    if delay:
        late = [struct.pack("<8I", 1, data.put(d.encode() + b"\0", 1), 0, 0, thunks(f), 0, 0, 0) for d, f in delay.items()]
        directories[13] = (data.put(b"".join(late) + bytes(32)), 32 * len(late) + 32)
    if exports:
        names = data.put(b"".join(struct.pack("<I", data.put(e.encode() + b"\0", 1)) for e in exports))
        directories[0] = (data.put(bytes(24) + struct.pack("<4I", len(exports), 0, names, 0)), 40)
    sections, at = [code, data], 0x400
    table = b""
    bodies = b""
    for s in sections:
        body = bytes(s.body) + bytes(-len(s.body) % 0x200)
        table += struct.pack("<8sIIIIIIHHI", s.name.encode(), len(s.body), s.va, len(body), at + len(bodies), 0, 0, 0, 0, s.flags)
        bodies += body
    if certificate:
        directories[4] = (at + len(bodies) + len(overlay), len(certificate))
    size = struct.pack("<HBBIII", 0x20B if wide else 0x10B, 14, 0, 0x600, 0x400, 0) + struct.pack("<II", 0x1000, 0x1000)
    size += struct.pack("<Q", 0x140000000) if wide else struct.pack("<II", 0x4000, 0x400000)
    size += struct.pack("<II6HIIIIHH", 0x1000, 0x200, 6, 0, 1, 0, 6, 0, 0, 0x8000, 0x400, 0, 2, 0x8160)
    size += struct.pack("<4Q" if wide else "<4I", 0x100000, 0x1000, 0x100000, 0x1000) + struct.pack("<II", 0, 16) + b"".join(struct.pack("<II", *d) for d in directories)
    coff = struct.pack("<HHIIIHH", 0x8664 if wide else 0x14C, len(sections), 1_600_000_000, 0, 0, len(size), 0x2102 if dll else 0x0102)
    head = b"MZ" + bytes(58) + struct.pack("<I", 0x40) + b"PE\0\0" + coff + size + table
    return head + bytes(at - len(head)) + bodies + overlay + certificate


def sample(family: str, k: int) -> bytes:
    functions, texts, packed = FAMILIES[family]
    seed = f"{family}-{k}"
    pick = hashlib.sha256(seed.encode()).digest()
    extra = [] if packed else [_NEUTRAL[(pick[0] + j) % len(_NEUTRAL)] for j in range(pick[1] % 3)]
    libraries: dict[str, list[str]] = {}
    for f in dict.fromkeys(functions + extra):
        libraries.setdefault(f"library{len(f) % 3}.dll", []).append(f)
    benign = family == "benign"
    return image(libraries, [*texts, f"own text {pick.hex()[:12]}"], seed, wide=bool(pick[2] & 1), packed=packed, dll=benign and pick[3] % 4 == 0, exports=["First", "Second"] if pick[4] % 3 == 0 else [])


def corpus(spark: SparkSession, n: int) -> DataFrame:
    """path, family, label, length, content: 3n benign files and n of each other family."""
    plan = [(f, k) for f in FAMILIES for k in range(3 * n if f == "benign" else n)]
    names = list(FAMILIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fam, num = [], []
            for i in batch.column("id").to_pylist():
                j = i - 3 * n
                fam.append(names[0] if j < 0 else names[1 + j // n])
                num.append(i if j < 0 else j % n)
            data = [sample(f, k) for f, k in zip(fam, num)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{f}/{f}_{k:04d}.exe.bin" for f, k in zip(fam, num)]), pa.array(fam), pa.array([int(f != "benign") for f in fam], pa.int32()), pa.array(list(map(len, data)), pa.int64()), pa.array(data, pa.binary())],
                ["path", "family", "label", "length", "content"],
            )

    return spark.range(len(plan)).mapInArrow(run, "path string, family string, label int, length long, content binary")
