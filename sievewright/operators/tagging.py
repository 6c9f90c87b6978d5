"""Set rules over array columns: all of these, any of those, and a string or counter condition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_api


@dataclass(frozen=True)
class SetRule:
    name: str
    attack_id: str = ""
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    substrings: tuple[str, ...] = ()
    counter: str = ""
    high_risk: bool = False


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def holds(rule: SetRule, items: Column) -> Column:
    """The rule's set part: literals folded into the plan, no join."""
    c = F.lit(True)
    if rule.all_of:
        c = c & (F.size(F.array_except(strings(rule.all_of), items)) == 0)
    if rule.any_of:
        c = c & F.arrays_overlap(strings(rule.any_of), items)
    return c


def matching(rules: list[SetRule], items: Column) -> Column:
    """Names of the rules that hold, in the rules' order."""
    return F.array_compact(F.array(*(F.when(holds(r, items), F.lit(r.name)) for r in rules)))


#: URL prefixes of XML namespaces and certificate services, which are no network indicators.
NOT_NETWORK = "(?i)(schemas\\.(microsoft|xmlsoap|openxmlformats)\\.|www\\.w3\\.org/|crl\\.|ocsp\\.|\\.crl|\\.crt|/crl/|/pki/|aia\\.|certs?\\.)"


def string_hits(rule: SetRule, texts: Column, ignored: Column | None = None) -> Column:
    """Texts with one of the rule's substrings; for network rules those ignored or of public infrastructure don't count."""
    hit = F.filter(texts, lambda s: _any(s, rule.substrings))
    if rule.attack_id == "T1071.001":
        hit = F.filter(hit, lambda s: ~s.rlike(NOT_NETWORK) & (~F.array_contains(ignored, s) if ignored is not None else F.lit(True)))
    return hit


def _any(s: Column, parts: tuple[str, ...]) -> Column:
    c = F.lit(False)
    for p in parts:
        c = c | s.contains(p)
    return c


def capabilities(rules: list[SetRule], names: Column, texts: Column | None = None, ignored: Column | None = None, counts: dict[str, Column] | None = None) -> Column:
    """array<struct<name, attack_id, evidence>> of the rules that hold.

    ``names``: raw import names. Evidence: all required imports in order, then any-hits not named yet, then three strings at most or the counter.
    An import is shown in the first of its raw spellings. A rule on strings needs ``texts``, or a counter of its own in ``counts``.
    """
    pairs = F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.struct(norm_api(n).alias("k"), n.alias("n")))
    items = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    shown = lambda k: F.concat(F.lit("import "), F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["n"])
    found = []
    for r in rules:
        need, some = (tuple(sorted({_plain(x) for x in part})) for part in (r.all_of, r.any_of))
        ok = holds(SetRule(r.name, all_of=need, any_of=some), items)
        evidence = F.transform(F.array_distinct(F.concat(strings(need), F.array_intersect(strings(some), items))), shown)
        if r.substrings and texts is not None:
            hit = string_hits(r, texts, ignored)
            ok = ok & (F.size(hit) > 0)
            evidence = F.concat(evidence, F.transform(F.slice(hit, 1, 3), lambda s: F.concat(F.lit("string '"), s, F.lit("'"))))
        elif r.substrings:
            n = (counts or {}).get(r.counter)
            ok = ok & (n > 0) if n is not None else F.lit(False)
            evidence = F.concat(evidence, F.array(F.concat((n if n is not None else F.lit(0)).cast("string"), F.lit(f" '{r.counter}' string pattern(s)"))))
        found.append(F.when(ok, F.struct(F.lit(r.name).alias("name"), F.lit(r.attack_id).alias("attack_id"), evidence.alias("evidence"))))
    return F.array_compact(F.array(*found))


def _plain(name: str) -> str:
    name = name[:-1] if name[-1:] in ("A", "W") else name
    return ("Nt" + name[2:] if name.startswith("Zw") else name).lower()


def agreement(df: DataFrame, ours: Column, theirs: Column, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall against outside labels."""
    c = df.groupBy(*by).agg(F.count_if(ours & theirs).alias("tp"), F.count_if(ours & ~theirs).alias("fp"), F.count_if(~ours & theirs).alias("fn"))
    return c.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
