"""Triage of files in one plan: report, record, features, score, verdict, family, evidence and notes; and the linear model it scores by."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources import pe, records
from . import boosting, evaluation, features, models, policy, tagging

FORMAT = "sievewright-linear-1"


@dataclass
class LinearModel:
    """Weights over standardised features, one centroid for each family of flagged files, thresholds for 1 % and 0.1 % false positives."""

    columns: list[str]
    mu: list[float]
    sigma: list[float]
    weights: list[float]
    bias: float
    centroids: dict[str, list[float]] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"format": FORMAT, **asdict(self)}, allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> LinearModel:
        """The model of a JSON text; an error if it is something else or was fitted to other features than this package has."""
        d = json.loads(text)
        if d.pop("format", None) != FORMAT:
            raise ValueError("not a model of this package")
        m = cls(**d)
        if m.columns != feature_names():
            raise ValueError("the model was fitted to other features")
        return m


def feature_names() -> list[str]:
    return list(features.feature_columns(F.col("record")))


def examined(files: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, content, report, error, record and signals of every file; unreadable ones have an error and no report."""
    t = records.from_reports(pe.dissected(files))
    return t.withColumn("signals", policy.packing_signals(F.col("report"))).select(*keep, "content", "report", "error", "record", "signals")


def load_model(text: str) -> LinearModel | boosting.Boosted:
    """The model of a JSON text, of whichever kind it says it is; an error if it was fitted to other features than this package has."""
    d = json.loads(text)
    if not isinstance(d, dict) or d.get("format") != boosting.FORMAT:
        return LinearModel.from_json(text)
    m = boosting.Boosted.from_json(text)
    if m.columns != feature_names():
        raise ValueError("the model was fitted to other features")
    return m


def boosted(files: DataFrame, p: boosting.Params = boosting.Params()) -> boosting.Boosted:  # noqa: B008
    """A boosted model fitted to files (path, content, label), with its thresholds for 1 % and 0.1 % false positives."""
    f = features.named_features(examined(files, "path", "label").filter("error IS NULL"), "record", "path", "label")
    m = boosting.fit(f, F.col("label"), feature_names(), ["path"], p)[0]
    s = boosting.scored(f, [m]).select("label", "score")
    for name, fpr in (("fpr_1pct", 0.01), ("fpr_0.1pct", 0.001)):
        t = evaluation.threshold_for_fpr(s, "score", F.col("label") == 0, fpr).first()
        if t and t[0] is not None:
            m.thresholds[name] = float(t[0])
    return m


def _scored(t: DataFrame, m: LinearModel | boosting.Boosted) -> DataFrame:
    if isinstance(m, boosting.Boosted):
        c = boosting.contributions(t, m)
        c = c.withColumn("raw", models.sigmoid(F.col("margin"))).withColumn("contributions", models.attributions(m.columns, F.col("contributions"), 8))
        return c.withColumn("nearest", F.lit(None).cast("string")).drop("base", "margin")
    columns = F.array(*(F.col(f"`{c}`") for c in m.columns))
    numbers = lambda v: F.array(*map(F.lit, v))
    z = F.zip_with(F.zip_with(columns, numbers(m.mu), lambda a, b: a - b), numbers(m.sigma), lambda a, b: a / b)
    t = t.withColumn("z", z)
    t = t.withColumn("raw", models.linear_score(F.col("z"), m.weights, m.bias)).withColumn("contributions", models.linear_attributions(F.col("z"), m.columns, m.weights, 8))
    if not m.centroids:
        return t.withColumn("nearest", F.lit(None).cast("string"))
    far = lambda c: F.aggregate(F.zip_with("z", numbers(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return t.withColumn("nearest", F.array_min(F.array(*(F.struct(far(c).alias("d"), F.lit(f).alias("f")) for f, c in sorted(m.centroids.items()))))["f"])


def trained(files: DataFrame, most_families: int = 20) -> LinearModel:
    """A model fitted to files (content, family, label). Only aggregates reach the driver: moments, weights, centroids of the ``most_families`` largest families."""
    names = feature_names()
    f = features.named_features(examined(files, "family", "label").filter("error IS NULL"), "record", "family", "label")
    safe = [f"f{i}" for i in range(len(names))]
    f = f.select("family", F.col("label").cast("double").alias("label"), *(F.col(f"`{n}`").alias(s) for n, s in zip(names, safe)))
    moments = models.moments(f, safe)
    mu, sigma = moments.first()
    z = models.standardized(f, safe, moments)
    fitted = models.fit_logistic(z.select("label", models.array_to_vector("z").alias("features")), "label")
    m = LinearModel(names, list(mu), list(sigma), [float(w) for w in fitted.coefficients], float(fitted.intercept))
    m.centroids = {r["family"]: list(r["centroid"]) for r in models.centroids(z.filter("label = 1"), "z", "family", most_families).collect()}
    s = z.withColumn("score", models.linear_score(F.col("z"), m.weights, m.bias)).select("label", "score")
    for name, fpr in (("fpr_1pct", 0.01), ("fpr_0.1pct", 0.001)):
        t = evaluation.threshold_for_fpr(s, "score", F.col("label") == 0, fpr).first()
        if t and t[0] is not None:
            m.thresholds[name] = float(t[0])
    return m


def triaged(files: DataFrame, m: LinearModel | boosting.Boosted) -> DataFrame:
    """path, sha256, verdict, score, family, packed, route, capabilities, techniques, contributions, notes, error of every file (path, content).

    An unreadable file has its error and nothing else.
    """
    t = examined(files, "path")
    calls = F.flatten(F.transform(F.concat("report.imports", "report.delay_imports"), lambda i: i["functions"]))
    texts, ignored = T.printable_runs(T.latin(F.col("content")), most=fixed.MAX_STRINGS), T.printable_runs(T.latin(F.col("report.certificate")))
    t = t.withColumn("capabilities", tagging.capabilities(fixed.RULES, calls, texts, ignored))
    f = features.named_features(t.filter("error IS NULL"), "record", "path", "report", "signals", "capabilities")
    f = _scored(f, m).select("path", "report", "signals", "capabilities", "contributions", "nearest", "raw")
    risky = tagging.strings(tuple(r.attack_id for r in fixed.RULES if r.high_risk))
    f = f.withColumn("techniques", F.array_intersect(F.transform("capabilities", lambda c: c["attack_id"]), risky)).withColumn("packed", F.size("signals") >= 2)
    low, high = (F.lit(m.thresholds.get(k)).cast("double") for k in ("fpr_1pct", "fpr_0.1pct"))
    v = policy.verdict(f, F.col("raw"), F.size("techniques") > 0, F.col("packed"), low, high)
    none = F.lit(None).cast("string")
    d = policy.documented(v.withColumns({"anomalies": F.col("report.anomalies"), "rule": none, "structural": none}))
    d = d.select("path", F.col("report.sha256").alias("sha256"), "verdict", "score", "family", "packed", "route", "capabilities", "techniques", "contributions", "notes", none.alias("error"))
    bad = t.filter("error IS NOT NULL").select("path", "error")
    return d.unionByName(bad, allowMissingColumns=True)


def train_default(spark: SparkSession, n: int = 20) -> LinearModel:
    """A model of the synthetic corpus, for trying things out."""
    from ..sources import corpus

    return trained(corpus.corpus(spark, n))
