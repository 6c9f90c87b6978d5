"""Packing signals and the verdict policy, as CASE chains over report and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .tagging import strings

SUSPICIOUS_AT, MALICIOUS_AT = 0.3, 0.7
#: The sentences of a packed file's signals, in the order in which they are reported.
SIGNALS = (
    "packer section names: ",
    "high-entropy sections: ",
    "minimal import table with dynamic resolution (LoadLibraryA+GetProcAddress)",
    "entry point in writable+executable section ",
)


def packing_signals(report: Column) -> Column:
    """Up to four signals of a packed file as sentences; two of them count as packed."""
    secs = report["sections"]
    lower = F.array_distinct(F.transform(secs, lambda s: F.lower(s["name"])))
    known = F.array_sort(F.array_intersect(lower, strings(fixed.DISSECT_PACKER_SECTIONS)))
    dense = F.transform(F.filter(secs, lambda s: (s["entropy"] > 7.2) & (s["raw_size"] > 1024)), lambda s: s["name"])
    functions = F.array_distinct(F.flatten(F.transform(report["imports"], lambda i: i["functions"])))
    entry = F.get(F.filter(secs, lambda s: s["name"] == report["entry_section"]), F.lit(0))
    both = F.lit(0x20000000 | 0x80000000)
    listed = lambda a: F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))
    return F.array_compact(
        F.array(
            F.when(F.size(known) > 0, F.concat(F.lit(SIGNALS[0]), listed(known))),
            F.when(F.size(dense) > 0, F.concat(F.lit(SIGNALS[1]), listed(dense))),
            F.when((F.size(functions) <= 4) & F.array_contains(functions, "LoadLibraryA") & F.array_contains(functions, "GetProcAddress"), F.lit(SIGNALS[2])),
            F.when(entry["characteristics"].bitwiseAND(both) == both, F.concat(F.lit(SIGNALS[3]), entry["name"])),
        )
    )


def packed_by_features(packer_section: Column, dense_sections: Column, imports_tiny: Column) -> Column:
    """The other definition of packed, over named features."""
    return (packer_section > 0) | ((dense_sections > 0) & (imports_tiny > 0))


def verdict(df: DataFrame, score: Column, high_risk: Column, packed: Column, t_suspicious: Column | None = None, t_malicious: Column | None = None) -> DataFrame:
    """``df`` with verdict, floored (a capability raised it) and route (packed or suspicious). Missing thresholds fall back to 0.3 and 0.7."""
    low = F.coalesce(t_suspicious if t_suspicious is not None else F.lit(None).cast("double"), F.lit(SUSPICIOUS_AT))
    high = F.coalesce(t_malicious if t_malicious is not None else F.lit(None).cast("double"), F.lit(MALICIOUS_AT))
    by_score = F.when(score >= high, "MALICIOUS").when(score >= low, "SUSPICIOUS").otherwise("BENIGN")
    floored = (by_score == "BENIGN") & high_risk
    final = F.when(floored, "SUSPICIOUS").otherwise(by_score)
    return df.withColumns({"verdict": final, "floored": floored, "route": packed | (final == "SUSPICIOUS"), "score": F.round(score, 4)})


PACKED_NOTE = "packed: the static view is partial; run it in a sandbox"


def documented(df: DataFrame, top: int = 5) -> DataFrame:
    """Result of a triage from the columns of ``verdict`` and more: sha256, verdict, score, family, packed, route, capabilities, contributions, rules, notes.

    ``df`` needs verdict, floored, score, packed, nearest (closest family), techniques (of high risk), anomalies, signals, contributions, and
    rule, structural (rule texts, null without). A family and rules are given unless the verdict is BENIGN; notes are anomalies,
    signals, why the verdict was raised, and what packing means, in this order.
    """
    benign = F.col("verdict") == "BENIGN"
    raised = F.concat(F.lit("low score, but high-risk capabilities "), F.array_join(F.array_sort(F.array_distinct("techniques")), ", "), F.lit(": raised to SUSPICIOUS"))
    more = F.array_compact(F.array(F.when(F.col("floored"), raised), F.when(F.col("packed"), F.lit(PACKED_NOTE))))
    return df.withColumns({
        "family": F.when(~benign, F.col("nearest")), "notes": F.concat("anomalies", "signals", more), "rule": F.when(~benign, F.col("rule")), "structural": F.when(~benign, F.col("structural")),
        "contributions": F.slice("contributions", 1, top),
    }).drop("nearest", "anomalies", "signals")


def as_json(df: DataFrame, key: str) -> DataFrame:
    """key, document: each row as strict JSON; numbers that JSON can't hold become null."""
    safe = [F.when(~F.isnan(c.name) & (F.abs(c.name) < float("inf")), F.col(c.name)).alias(c.name) if c.dataType.typeName() in ("double", "float") else F.col(c.name) for c in df.schema.fields]
    return df.select(F.col(key), F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("document"))
