"""The parser, records, features, tagging, policy and hashing on synthetic and damaged files."""

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.functions import fixed, hashing
from sievewright.functions import text as T
from sievewright.operators import features, policy, tagging
from sievewright.sources import corpus, files, pe, records


def test_report_round_trip():
    imports = {"KERNEL32.dll": ["CreateFileW", "ordinal7"], "a.sys.dll": ["f"]}
    for wide in (False, True):
        data = corpus.image(imports, ["hello world", "x"], "s", wide=wide, exports=["One", "Two"], dll=True, certificate=b"http://crl.example/ca" + bytes(11), overlay=b"o" * 100, delay={"late.dll": ["Later"]})
        r = pe.dissect(data)
        assert {i["dll"]: i["functions"] for i in r["imports"]} == imports and r["delay_imports"] == [{"dll": "late.dll", "functions": ["Later"]}]
        assert r["exports"] == ["One", "Two"] and r["is_dll"] and r["pe32plus"] == wide and r["entry_section"] == ".text" and not r["anomalies"]
        assert r["sha256"] == hashlib.sha256(data).hexdigest() and r["overlay_size"] == 100 and r["certificate"].startswith(b"http://crl")
        assert sum(r["histogram"]) == len(data)


@pytest.mark.parametrize("data", [b"", b"PK\3\4", b"MZ", b"MZ" + bytes(58) + b"\xff\xff\xff\x7f"])
def test_what_is_no_executable_is_an_error(data):
    with pytest.raises(pe.ParseError):
        pe.dissect(data)


def test_truncated_and_mutated_files_never_crash():
    rng, whole = random.Random(7), corpus.sample("t1105", 3)
    cases = [whole[: rng.randrange(len(whole))] for _ in range(100)]
    for _ in range(300):
        b = bytearray(whole)
        for _ in range(rng.randrange(1, 12)):
            b[rng.randrange(min(len(b), 0x900))] ^= 1 << rng.randrange(8)
        cases.append(bytes(b))
    for c in cases:
        try:
            pe.dissect(c)
        except pe.ParseError:
            pass


def test_byte_entropy_windows():
    assert pe.byte_entropy(np.zeros(0, np.uint8)).sum() == 0
    flat = pe.byte_entropy(np.zeros(4096, np.uint8))
    assert flat[0] == 3 * 2048 and flat.sum() == 3 * 2048
    spread = pe.byte_entropy(np.tile(np.arange(256, dtype=np.uint8), 8)).reshape(16, 16)
    assert spread[15].sum() == 2048


def plain_murmur(data):
    """MurmurHash3_x86_32 with seed 0, byte by byte as it is defined."""
    mask, h = 0xFFFFFFFF, 0
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for i in range(0, len(data), 4):
        k = turn(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h ^= k
        if i + 4 <= len(data):
            h = (turn(h, 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def test_murmur_and_hashing():
    known = {"": 0, "hello": 0x248BFA47, "abcd": 0x43ED676A, "hello, world": 0x149BBB7F, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    assert hashing.murmur3(pa.array(list(known))).tolist() == list(known.values())
    r = random.Random(1)
    texts = ["".join(r.choices("aé日😀 ", k=r.randint(0, 40))) for _ in range(500)] + ["x" * 10_000]
    assert hashing.murmur3(pa.array(texts)[3:]).tolist() == [plain_murmur(t.encode()) for t in texts[3:]]
    assert hashing.murmur3(pa.array([b"\xff\x00\x80", b"\xff\xff\xff\xff\x81"])).tolist() == [plain_murmur(b"\xff\x00\x80"), plain_murmur(b"\xff\xff\xff\xff\x81")]
    assert hashing.murmur3(pa.array([], pa.string())).tolist() == []


def test_hashed_tokens(spark):
    rows = [(1, ["a", "b", "a", None]), (2, []), (3, None), (None, ["ü" * 9]), (4, [f"t{i}" for i in range(300)])]
    got = {}
    for r in hashing.hashed_tokens(spark.createDataFrame([(*r, 5) for r in rows], "id long, t array<string>, cell int"), "t", 16, ["id"]).collect():
        got.setdefault(r["id"], {})[r["cell"]] = r["value"]
    for i, tokens in rows:
        want = {}
        for t in tokens or []:
            if t is not None:
                h = plain_murmur(t.encode())
                h -= (h >> 31) << 32
                want[abs(h) % 16] = want.get(abs(h) % 16, 0) + (1 if h >= 0 else -1)
        assert got.get(i, {}) == {k: v for k, v in want.items() if v}


def test_features_and_verdicts(spark):
    t = records.from_reports(pe.dissected(corpus.corpus(spark, 2))).withColumn("signals", policy.packing_signals(F.col("report")))
    rows = features.named_features(t, "record", "path", "family", "signals").collect()
    assert len(rows) == 18 and len(rows[0]) - 3 == features.N_FEATURES == 91
    for r in rows:
        assert (len(r["signals"]) >= 2) == (r["family"] == "dense") == bool(r["packer_section_name"])
        assert bool(r["high_risk_capabilities"]) == (r["family"] in {x.attack_id.lower().replace(".", "_") for x in fixed.RULES if x.high_risk})
        assert r["cap:run-key persistence string"] == 0
    sets = hashing.hashed_vectors(t, "record", ["path"]).collect()
    chars = {r["path"]: r["vector"] for r in hashing.hashed_vectors(t, "record", ["path"], "chars").collect()}
    for r in sets:
        assert len(r["vector"]) == sum(hashing.BLOCKS.values()) and abs(sum(r["vector"][:256]) - 1) < 1e-9
        assert sum(a != b for a, b in zip(r["vector"], chars[r["path"]])) <= 50
    with pytest.raises(ValueError):
        hashing.hashed_vectors(t, "record", ["path"], "other")


def test_parser_errors_are_rows(spark):
    df = spark.createDataFrame([("a", 2, bytearray(b"MZ")), ("b", 3, bytearray(corpus.sample("benign", 0))), ("c", 0, None)], "path string, length long, content binary")
    got = {r["path"]: (r["report"] is None, r["error"]) for r in pe.dissected(df).collect()}
    assert got["a"][0] and got["c"][0] and got["b"] == (False, None)


def test_scan_refuses_large_files_unread(spark, tmp_path):
    (tmp_path / "small.exe").write_bytes(corpus.sample("benign", 1))
    (tmp_path / "large.exe").write_bytes(bytes(200_000))
    (tmp_path / "note.txt").write_text("no")
    assert [r["path"].rsplit("/", 1)[1] for r in files.files(spark, str(tmp_path), most=100_000, limit=5).collect()] == ["small.exe"]
    assert [r["path"].rsplit("/", 1)[1] for r in files.refused(spark, str(tmp_path), 100_000).collect()] == ["large.exe"]


def test_tagging_evidence_and_certificates(spark):
    df = spark.createDataFrame([(["InternetOpenA", "InternetOpenUrlW", "URLDownloadToFileA"], ["http://a.test/x", "http://crl.ca.test/c.crl", "http://signed.test"], ["http://signed.test"])], "n array<string>, s array<string>, g array<string>")
    caps = {c["name"]: c for c in df.select(tagging.capabilities(fixed.RULES, F.col("n"), F.col("s"), F.col("g")).alias("c")).first()["c"]}
    assert caps["embedded URL"]["evidence"] == ["string 'http://a.test/x'"]
    assert caps["download file from internet"]["evidence"] == ["import InternetOpenUrlW", "import URLDownloadToFileA"]
    assert caps["HTTP client"]["attack_id"] == "T1071.001"


def test_names_flags_and_digest(spark):
    df = spark.range(1).select(
        T.norm_api(F.lit("ZwOpenA")).alias("n"), T.flag_names(F.lit(0x2102), fixed.COFF_FLAGS).alias("f"),
        T.import_digest(F.array(F.struct(F.lit("a.sys.dll").alias("dll"), F.array(F.lit("Fn")).alias("functions")))).alias("d"),
    )
    r = df.first()
    assert r["n"] == "ntopen" and r["f"] == ["EXECUTABLE_IMAGE", "CHARA_32BIT_MACHINE", "DLL"] and r["d"] == hashlib.md5(b"a.fn").hexdigest()


def test_string_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    blobs = [bytes(rng.choice(b"abcMZ:\\h\x7f\x00\xff HKEY_") for _ in range(400)) for _ in range(10)] + [b"", b"http://x C:\\dir c:\\ MZMZ"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, content binary")
    for r in df.select("i", records.string_statistics(F.col("content")).alias("s")).collect():
        runs = re.findall(rb"[\x20-\x7f]{5,}", blobs[r["i"]])
        joined = b"".join(runs)
        assert (r["s"]["numstrings"], r["s"]["printables"], r["s"]["MZ"]) == (len(runs), len(joined), blobs[r["i"]].count(b"MZ"))
        assert r["s"]["printabledist"] == np.bincount(np.frombuffer(joined, np.uint8) - 32, minlength=96).tolist()


def test_raw_records_and_second_format(spark, tmp_path):
    lines = [{"sha256": "a", "label": 1, "imports": {"K.dll": ["f", "g"]}}, {"sha256": "b", "label": -1}, {"sha256": "c", "label": -10}, {"sha256": 'd "label": -1', "label": 0}, {"sha256": "e"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    # Without blanks after the colon too.
    (tmp_path / "s.jsonl").write_text('{"sha256":"f","label":-1}\n')
    got = files.raw_records(spark, str(tmp_path / "*.jsonl")).orderBy("sha256").collect()
    assert [r["sha256"] for r in got] == ["a", "c", 'd "label": -1', "e"] and got[0]["imports"][0]["functions"] == ["f", "g"]
    v3 = (
        "sha256 string, label int, family string, week_id int, histogram array<long>, byteentropy array<long>, general struct<size:long>, exports array<string>, imports array<struct<dll:string,functions:array<string>>>, "
        "header struct<coff:struct<timestamp:long,machine:string,characteristics:array<string>,number_of_symbols:long>,optional:struct<subsystem:string,magic:int,dll_characteristics:array<string>,sizeof_image:long,"
        + ",".join(f"{m}_{v}_version:long" for v in ("image", "linker", "operating_system", "subsystem") for m in ("major", "minor"))
        + ",sizeof_code:long,sizeof_headers:long,sizeof_heap_commit:long>>, "
        "strings struct<numstrings:long,avlength:double,printabledist:array<long>,printables:long,entropy:double,string_counts:struct<file_path:long,url:long,registry_key:long,dos_msg:long>>, "
        "section struct<entry:string,sections:array<struct<name:string,size:long,entropy:double,vsize:long,props:array<string>>>>, datadirectories array<struct<name:string,size:long,virtual_address:long>>"
    )
    row = json.dumps({"sha256": "c", "week_id": 7, "header": {"coff": {"machine": "IMAGE_FILE_MACHINE_AMD64"}, "optional": {"magic": 0x20B, "sizeof_image": 9}}, "imports": [{"dll": "x.dll", "functions": ["x.dll:ordinal3", "y"]}], "datadirectories": [{"name": "SECURITY", "size": 4, "virtual_address": 1}]})
    df = spark.range(1).select(F.from_json(F.lit(row), v3).alias("r")).select("r.*")
    r = records.from_v3(df).first()
    assert r["header"]["coff"]["machine"] == "AMD64" and r["header"]["optional"]["magic"] == "PE32_PLUS" and r["general"]["vsize"] == 9 and r["general"]["has_signature"] == 1
    assert r["imports"][0]["functions"] == ["ordinal3", "y"] and r["datadirectories"][0]["name"] == "CERTIFICATE_TABLE" and len(r["histogram"]) == 256
    assert features.named_features(records.from_v3(df).select(F.struct("*").alias("record"))).count() == 1


def test_features_equal_plain_formulas(spark):
    """Features of every file of the corpus, and blocks of its vector, from the bytes and the report in plain Python."""
    t = records.from_reports(pe.dissected(corpus.corpus(spark, 1))).cache()
    got = {r["path"]: r for r in features.named_features(t, "record", "path").collect()}
    vectors = {r["path"]: r["vector"] for r in hashing.hashed_vectors(t, "record", ["path"]).collect()}
    plain = lambda n: (lambda x: "nt" + x[2:].lower() if x.startswith("Zw") else x.lower())(n[:-1] if n[-1:] in "AW" else n)
    for row in t.select("path", "content").collect():
        data, f, v = bytes(row["content"]), got[row["path"]], vectors[row["path"]]
        r, secs = pe.dissect(data), pe.dissect(data)["sections"]
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        share = counts[counts > 0] / len(data)
        names = [n for i in r["imports"] for n in i["functions"]]
        norm = {plain(n) for n in names}
        runs = re.findall(rb"[\x20-\x7f]{5,}", data)
        ents = [s["entropy"] for s in secs if s["raw_size"]] or [0.0]
        x, w = 0x20000000, 0x80000000
        want = {
            "size_kb": len(data) / 1024, "file_entropy": -(share * np.log2(share)).sum(), "n_sections": len(secs), "max_section_entropy": max(ents), "mean_section_entropy": sum(ents) / len(ents),
            "min_section_entropy": min(ents), "n_wx_sections": sum(bool(s["characteristics"] & x and s["characteristics"] & w) for s in secs), "n_exec_sections": sum(bool(s["characteristics"] & x) for s in secs),
            "n_dlls": len(r["imports"]), "n_imports": len(names), "n_exports": len(r["exports"]), "imports_tiny": len(names) <= 5, "is_dll": r["is_dll"], "is_x64": r["pe32plus"],
            "aslr": bool(r["dll_characteristics"] & 0x40), "dep": bool(r["dll_characteristics"] & 0x100), "code_ratio": r["header"]["sizeof_code"] / len(data), "vsize_to_size": r["size_of_image"] / len(data),
            "n_strings": len(runs), "avg_string_len": sum(map(len, runs)) / max(1, len(runs)), "n_embedded_mz": data.count(b"MZ"), "printable_ratio": sum(map(len, runs)) / len(data),
            "packer_section_name": any(s["name"].lower() in fixed.PACKER_SECTIONS for s in secs), "timestamp_suspicious": not 788918400 <= r["timestamp"] <= 1893456000,
            **{f"api_{k}": len(norm & {plain(n) for n in g}) for k, g in fixed.API_GROUPS.items()},
        }
        for k, y in want.items():
            assert abs(f[k] - float(y)) < 1e-9, (row["path"], k, f[k], y)
        assert np.allclose(v[:256], counts / len(data)) and np.allclose(v[256:512], pe.byte_entropy(np.frombuffer(data, np.uint8)) / max(1, pe.byte_entropy(np.frombuffer(data, np.uint8)).sum()))
