"""Reports and second-format records as first-format records: projections only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def string_statistics(content: Column) -> Column:
    """The strings block of a record from file bytes. Runs here include 0x7f, unlike those a report lists."""
    codes = F.sequence(F.lit(0x20), F.lit(0x7F))
    counted = lambda joined: F.transform(codes, lambda c: (F.length(joined) - F.length(F.replace(joined, F.chr(c), F.lit("")))).cast("long"))

    def block(s: Column, runs: Column, n: Column, dist: Column) -> Column:
        plogp = F.aggregate(dist, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0))
        paths, urls, registry, mz = (F.regexp_count(s, F.lit(p)).cast("long") for p in T.COUNTERS.values())
        return F.struct(
            F.size(runs).cast("long").alias("numstrings"), F.coalesce(F.try_divide(n, F.size(runs)), F.lit(0.0)).alias("avlength"), dist.alias("printabledist"), n.cast("long").alias("printables"),
            F.when(n > 0, F.log2(n.cast("double")) - plogp / n).otherwise(0.0).alias("entropy"), paths.alias("paths"), urls.alias("urls"), registry.alias("registry"), mz.alias("MZ"),
        )

    of_runs = lambda s, runs: _bound(F.array_join(runs, ""), lambda j: _bound(counted(j), lambda dist: block(s, runs, F.length(j), dist)))
    return _bound(T.latin(content), lambda s: _bound(T.printable_runs(s, T.RECORD_RUN), lambda runs: of_runs(s, runs)))


def from_reports(df: DataFrame) -> DataFrame:
    """``df`` (report, content) with record: the first format. Delay imports and the checksum are not part of it."""
    r = lambda name: F.col(f"report.{name}")
    dd = lambda i: F.get(r("data_directories"), F.lit(i))
    has = lambda i: ((dd(i)["virtual_address"] != 0) & (dd(i)["size"] != 0)).cast("long")
    hexed = F.concat(F.lit("0x"), F.lower(F.hex(r("machine"))))
    general = F.struct(
        r("size").alias("size"), r("size_of_image").alias("vsize"), has(6).alias("has_debug"), F.size(r("exports")).cast("long").alias("exports"),
        F.aggregate(r("imports"), F.lit(0).cast("long"), lambda a, i: a + F.size(i["functions"])).alias("imports"), has(5).alias("has_relocations"), has(2).alias("has_resources"),
        has(4).alias("has_signature"), has(9).alias("has_tls"), r("n_symbols").alias("symbols"),
    )
    coff = F.struct(r("timestamp").alias("timestamp"), T.enum_name(r("machine"), fixed.MACHINES, hexed).alias("machine"), T.flag_names(r("coff_characteristics"), fixed.COFF_FLAGS).alias("characteristics"))
    versions = [f"{m}_{v}_version" for v in ("image", "linker", "operating_system", "subsystem") for m in ("major", "minor")]
    optional = F.struct(
        T.enum_name(r("subsystem"), fixed.SUBSYSTEMS, r("subsystem").cast("string")).alias("subsystem"), T.flag_names(r("dll_characteristics"), fixed.DLL_FLAGS).alias("dll_characteristics"),
        F.when(r("pe32plus"), "PE32_PLUS").otherwise("PE32").alias("magic"), *(r(f"header.{c}").alias(c) for c in [*versions, "sizeof_code", "sizeof_headers", "sizeof_heap_commit"]),
    )
    sections = F.transform(
        r("sections"),
        lambda s: F.struct(s["name"].alias("name"), s["raw_size"].alias("size"), s["entropy"].alias("entropy"), s["virtual_size"].alias("vsize"), T.flag_names(s["characteristics"], fixed.SECTION_FLAGS).alias("props")),
    )
    names = F.array(*map(F.lit, fixed.DIRECTORIES))
    directories = F.zip_with(names, r("data_directories"), lambda n, d: F.struct(n.alias("name"), d["size"].alias("size"), d["virtual_address"].alias("virtual_address")))
    record = F.struct(
        r("sha256").alias("sha256"), r("histogram").alias("histogram"), r("byteentropy").alias("byteentropy"), string_statistics(F.col("content")).alias("strings"), general.alias("general"),
        F.struct(coff.alias("coff"), optional.alias("optional")).alias("header"), F.struct(r("entry_section").alias("entry"), sections.alias("sections")).alias("section"),
        r("imports").alias("imports"), r("exports").alias("exports"), directories.alias("datadirectories"),
    )
    return df.withColumn("record", F.when(F.col("report").isNotNull(), record))


def from_v3(df: DataFrame) -> DataFrame:
    """Second-format columns to the first format: other names, flags from directory sizes, counters by the nearest pattern, defaults for what is missing."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    directories = F.filter(F.coalesce("datadirectories", F.array().cast("array<struct<name:string,size:long,virtual_address:long>>")), lambda d: d["name"].isNotNull())
    names = F.create_map(*(F.lit(x) for kv in fixed.DIRECTORIES_V3.items() for x in kv))
    sized = lambda n: F.exists(directories, lambda d: (d["name"] == n) & (d["size"] > 0)).cast("long")
    imports = F.transform(
        F.coalesce("imports", F.array().cast("array<struct<dll:string,functions:array<string>>>")),
        lambda i: F.struct(i["dll"].alias("dll"), F.transform(i["functions"], lambda f: F.when(f.startswith(F.concat(i["dll"], F.lit(":ordinal"))), F.substring(f, F.length(i["dll"]) + 2, F.length(f))).otherwise(f)).alias("functions")),
    )
    machine = F.regexp_replace(c("header.coff.machine", ""), "^IMAGE_FILE_MACHINE_", "")
    subsystem = F.regexp_replace(c("header.optional.subsystem", ""), "^IMAGE_SUBSYSTEM_", "")
    magic = T.enum_name(F.col("header.optional.magic"), fixed.MAGICS, F.coalesce(F.col("header.optional.magic").cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    coff = F.struct(c("header.coff.timestamp", 0).alias("timestamp"), machine.alias("machine"), F.coalesce("header.coff.characteristics", none).alias("characteristics"))
    numbers = [f"{m}_{v}_version" for v in ("image", "linker", "operating_system", "subsystem") for m in ("major", "minor")] + ["sizeof_code", "sizeof_headers", "sizeof_heap_commit"]
    optional = F.struct(
        subsystem.alias("subsystem"), F.coalesce("header.optional.dll_characteristics", none).alias("dll_characteristics"), magic.alias("magic"), *(c(f"header.optional.{x}", 0).alias(x) for x in numbers)
    )
    exports = F.coalesce("exports", none)
    general = F.struct(
        c("general.size", 0).alias("size"), c("header.optional.sizeof_image", 0).alias("vsize"), sized("DEBUG").alias("has_debug"), F.size(exports).cast("long").alias("exports"),
        F.aggregate(imports, F.lit(0).cast("long"), lambda a, i: a + F.size(i["functions"])).alias("imports"), sized("BASERELOC").alias("has_relocations"), sized("RESOURCE").alias("has_resources"),
        sized("SECURITY").alias("has_signature"), sized("TLS").alias("has_tls"), c("header.coff.number_of_symbols", 0).alias("symbols"),
    )
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    counts = {"paths": "file_path", "urls": "url", "registry": "registry_key", "MZ": "dos_msg"}
    strings = F.struct(
        c("strings.numstrings", 0).alias("numstrings"), c("strings.avlength", 0.0).alias("avlength"), F.coalesce("strings.printabledist", zeros(96)).alias("printabledist"),
        c("strings.printables", 0).alias("printables"), c("strings.entropy", 0.0).alias("entropy"), *(c(f"strings.string_counts.{v}", 0).alias(k) for k, v in counts.items()),
    )
    moved = F.transform(directories, lambda d: F.struct(F.coalesce(F.try_element_at(names, d["name"]), d["name"]).alias("name"), d["size"].alias("size"), d["virtual_address"].alias("virtual_address")))
    section = F.struct(c("section.entry", "").alias("entry"), F.coalesce("section.sections", F.array().cast("array<struct<name:string,size:long,entropy:double,vsize:long,props:array<string>>>")).alias("sections"))
    return df.select(
        "sha256", "label", c("family", "").alias("avclass"), F.col("week_id").cast("string").alias("appeared"), F.coalesce("histogram", zeros(256)).alias("histogram"),
        F.coalesce("byteentropy", zeros(256)).alias("byteentropy"), strings.alias("strings"), general.alias("general"), F.struct(coff.alias("coff"), optional.alias("optional")).alias("header"),
        section.alias("section"), imports.alias("imports"), exports.alias("exports"), moved.alias("datadirectories"),
    )


def reduced(record: Column) -> Column:
    """A record without its character distribution and with 200 exports at most."""
    return record.withField("strings", record["strings"].dropFields("printabledist")).withField("exports", F.slice(record["exports"], 1, 200)).dropFields("histogram", "byteentropy")
