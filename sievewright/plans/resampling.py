"""Queries of resampled intervals, older stability index and ranks with intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, resampling
from ..sources.tables import table
from . import statistics
from .statistics import _BY_PART, _COLUMNS, _CUT, _LONG, _WEIGHT, _psi, _poisson_case

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Replicates of the intervals, and of ranks with intervals.
REPS, RANK_REPS = 1_000, 12


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_MODELS = {"m0": "value", "m1": "value + user_id % 7", "m2": "value - user_id % 5", "m3": "value * 2 - user_id % 3"}
_E = "e AS (SELECT event_id, event_type = 'error' AS y, date_part('day', ts) <= 15 AS early, " + ", ".join(f"{v} AS {k}" for k, v in _MODELS.items()) + " FROM events)"


def _mixed(source: str, name: str, x: str) -> str:
    """SQL: ``source`` with ``name``, the 32-bit hash of x."""
    (s1, f1), (s2, f2) = resampling._MIX
    source = f"(SELECT *, ({x})::UBIGINT AS {name}0 FROM {source})"
    source = f"(SELECT *, (xor({name}0, {name}0 >> {s1}) * {f1}::UBIGINT) & 4294967295 AS {name}1 FROM {source})"
    source = f"(SELECT *, (xor({name}1, {name}1 >> {s2}) * {f2}::UBIGINT) & 4294967295 AS {name}2 FROM {source})"
    return f"(SELECT * EXCLUDE ({name}0, {name}1, {name}2), xor({name}2, {name}2 >> 16) AS {name} FROM {source})"


def _resampled(rows: str, key: str, reps: int) -> str:
    """SQL: CTEs up to ``x``, the rows of ``rows`` (cls, ``key`` and others) by replicate with their weights w (above 0)."""
    placed = f"(SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {key}) - 1 AS place FROM {rows})"
    hashed = _mixed(_mixed(_mixed(placed, "ha", f"xor({resampling.SEED}::UBIGINT, cls::UBIGINT)"), "hb", "xor(ha, (place & 4294967295)::UBIGINT)"), "hc", "xor(hb, (place >> 32)::UBIGINT)")
    base = _mixed(f"(SELECT * FROM rs_rows JOIN rs_sizes USING (cls), (SELECT unnest(range({reps})) AS rep))", "hd", "xor(hc, rep::UBIGINT)")
    drawn = " + ".join(f"((hd >> 16) >= steps[{k}])::INT" for k in range(1, 13))
    missing = "(SELECT cls, rep, n, unnest(range(CASE WHEN d <= n THEN n - d ELSE n END)) AS j FROM rs_totals)"
    high = _mixed(_mixed(_mixed(missing, "ga", f"xor({resampling.EXTRA_SEED}::UBIGINT, cls::UBIGINT)"), "gb", "xor(ga, rep::UBIGINT)"), "gc", "xor(xor(gb, (j & 4294967295)::UBIGINT), (j >> 32)::UBIGINT)")
    low = _mixed(high, "gd", f"xor(gc, {resampling.EXTRA_SEED}::UBIGINT)")
    return f"""rs_rows AS (SELECT * EXCLUDE (ha, hb) FROM {hashed}),
rs_rates AS (SELECT cls, count(*) AS n, greatest(0.0, 1 - {resampling.MARGIN} / sqrt(count(*))) AS rate FROM {rows} GROUP BY cls),
rs_sizes AS (SELECT cls, n, list_transform(range(12), lambda k: least(65536, floor(list_sum(list_transform(range(k + 1), lambda i: exp(-rate) * pow(rate, i) / factorial(i::INT)::DOUBLE)) * 65536 + 0.5))::BIGINT) AS steps FROM rs_rates),
rs_base AS (SELECT * EXCLUDE (hc, hd, steps), {drawn} AS w0 FROM {base}),
rs_totals AS (SELECT cls, rep, any_value(n) AS n, sum(w0)::BIGINT AS d FROM rs_base GROUP BY cls, rep),
rs_more AS (SELECT cls, rep, floor((gc::DOUBLE * 1048576.0 + (gd >> 12)::DOUBLE) / 4503599627370496.0 * n)::BIGINT AS place, count(*) AS k FROM {low} GROUP BY ALL),
x AS (SELECT b.* EXCLUDE (w0, n, place), CASE WHEN d <= b.n THEN w0 ELSE 0 END + coalesce(k, 0) AS w FROM rs_base b JOIN rs_totals USING (cls, rep) LEFT JOIN rs_more USING (cls, rep, place))"""


def _curves(source: str, by: str, name: str) -> str:
    """SQL: ``name`` (by, auc, tpr_1, tpr_01) of rows (by, y, s, w) in ``source``."""
    return f"""c_{name} AS (SELECT {by}, s, coalesce(sum(w) FILTER (y), 0) AS pos, coalesce(sum(w) FILTER (NOT y), 0) AS neg FROM {source} WHERE w > 0 GROUP BY {by}, s),
q_{name} AS (SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY {by} ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n FROM c_{name}),
{name} AS (SELECT {by}, sum(neg * (tp - pos / 2)) / max(p) / max(n) AS auc, coalesce(max(tp) FILTER (fp / n <= 0.01), 0) / max(p) AS tpr_1, coalesce(max(tp) FILTER (fp / n <= 0.001), 0) / max(p) AS tpr_01 FROM q_{name} GROUP BY {by})"""


def _summary(draws: str, points: str, metrics: tuple[str, ...] = resampling.METRICS, mean: bool = False) -> str:
    one = lambda m: f"SELECT '{m}' AS metric, round((SELECT {m} FROM {points}), 9) AS point, {f'round(avg({m}), 9) AS mean, ' if mean else ''}round(quantile_cont({m}, 0.025), 9) AS low, round(quantile_cont({m}, 0.975), 9) AS high FROM {draws}"
    return " UNION ALL ".join(one(m) for m in metrics)


def _events(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "error").alias("y"), (F.dayofmonth("ts") <= 15).alias("early"))
    return e.withColumns({k: F.expr(v) for k, v in _MODELS.items()}).drop("value", "user_id")


def _rounded(df, *names):
    return df.select("metric", *(F.round(c, 9).alias(c) for c in names))


_ALL_OF = lambda names: ", ".join(f"avg({m}) AS {m}" for m in names)


#: Rows of ``e`` with their class: by verdict, and by test set and verdict.
_BY_Y, _BY_SET = "(SELECT *, y::INT AS cls FROM e)", "(SELECT *, y::INT + CASE WHEN early THEN 0 ELSE 2 END AS cls FROM e)"
_TURNS = "CASE WHEN rep % 2 = 0 THEN m0 ELSE m1 END AS s"


@query(f"""WITH {_E}, {_resampled(_BY_Y, 'event_id', REPS)}, xs AS (SELECT rep, y, w, {_TURNS} FROM x), {_curves('xs', 'rep', 'draws')},
z AS (SELECT 0 AS model, y, m0 AS s, 1 AS w FROM e UNION ALL SELECT 1, y, m1, 1 FROM e), {_curves('z', 'model', 'own')}, pt AS (SELECT {_ALL_OF(resampling.METRICS)} FROM own) {_summary('draws', 'pt')}""")
def bootstrap_roc(spark, d):
    return _rounded(resampling.bootstrap_roc(_events(spark, d), "event_id", "y", ["m0", "m1"], REPS), "point", "low", "high")


_SIGNED = ", ".join(f"sum(sign * {m}) AS {m}" for m in resampling.METRICS)


@query(f"""WITH {_E}, {_resampled(_BY_Y, 'event_id', REPS)}, xs AS (SELECT rep, 1 AS sign, y, w, {_TURNS} FROM x UNION ALL SELECT rep, -1, y, w, CASE WHEN rep % 2 = 0 THEN m2 ELSE m3 END FROM x),
{_curves('xs', 'rep, sign', 'each')}, draws AS (SELECT rep, {_SIGNED} FROM each GROUP BY rep),
z AS (SELECT 1 AS sign, 0 AS model, y, m0 AS s, 1 AS w FROM e UNION ALL SELECT 1, 1, y, m1, 1 FROM e UNION ALL SELECT -1, 2, y, m2, 1 FROM e UNION ALL SELECT -1, 3, y, m3, 1 FROM e),
{_curves('z', 'sign, model', 'own')}, pt AS (SELECT {', '.join(f'sum(sign * {m}) / 2 AS {m}' for m in resampling.METRICS)} FROM own) {_summary('draws', 'pt', mean=True)}""")
def paired_roc_difference(spark, d):
    return _rounded(resampling.paired_bootstrap(_events(spark, d), "event_id", "y", ["m0", "m1"], ["m2", "m3"], REPS), "point", "mean", "low", "high")


@query(f"""WITH {_E}, {_resampled(_BY_SET, 'event_id', REPS)}, xs AS (SELECT rep, CASE WHEN early THEN 1 ELSE -1 END AS sign, y, w, {_TURNS} FROM x), {_curves('xs', 'rep, sign', 'each')}, draws AS (SELECT rep, {_SIGNED} FROM each GROUP BY rep),
z AS (SELECT CASE WHEN early THEN 1 ELSE -1 END AS sign, 0 AS model, y, m0 AS s, 1 AS w FROM e UNION ALL SELECT CASE WHEN early THEN 1 ELSE -1 END, 1, y, m1, 1 FROM e),
{_curves('z', 'sign, model', 'own')}, pt AS (SELECT {', '.join(f'sum(sign * {m}) / 2 AS {m}' for m in resampling.METRICS)} FROM own) {_summary('draws', 'pt')}""")
def independent_roc_difference(spark, d):
    return _rounded(resampling.independent_bootstrap(_events(spark, d), "event_id", "y", "early", ["m0", "m1"], REPS), "point", "low", "high")


_RATES = "sum({w}) FILTER (y AND hit) / sum({w}) FILTER (y) AS recall, sum({w}) FILTER (NOT y AND hit) / sum({w}) FILTER (NOT y) AS fpr"


@query(f"""WITH {_E}, {_resampled(_BY_Y, 'event_id', REPS)}, xs AS (SELECT rep, y, w, CASE WHEN rep % 2 = 0 THEN m0 >= 60 ELSE m1 >= 66 END AS hit FROM x),
draws AS (SELECT rep, {_RATES.format(w='w')} FROM xs GROUP BY rep), z AS (SELECT 0 AS model, y, m0 >= 60 AS hit FROM e UNION ALL SELECT 1, y, m1 >= 66 FROM e),
own AS (SELECT model, {_RATES.format(w='1')} FROM z GROUP BY model), pt AS (SELECT avg(recall) AS recall, avg(fpr) AS fpr FROM own) {_summary('draws', 'pt', ('recall', 'fpr'))}""")
def bootstrap_threshold(spark, d):
    return _rounded(resampling.bootstrap_threshold(_events(spark, d), "event_id", "y", ["m0", "m1"], [60.0, 66.0], REPS), "point", "low", "high")


@query(f"""WITH e AS (SELECT event_id, (event_type = 'error')::INT AS f, 0 AS cls FROM events), {_resampled('e', 'event_id', REPS)}, s AS (SELECT rep, sum(w * f) / sum(w) AS rate FROM x GROUP BY rep)
SELECT (SELECT round(avg(f), 9) FROM e) AS rate, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high FROM s""")
def hash_bootstrap_ci(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return resampling.bootstrap_rate(e, "event_id", F.col("event_type") == "error", REPS).select(*(F.round(c, 9).alias(c) for c in ("rate", "low", "high")))


@query(f"""WITH e AS (SELECT event_id, (value > 60)::INT - (value > 90)::INT AS f, 0 AS cls FROM events), {_resampled('e', 'event_id', REPS)}, s AS (SELECT rep, sum(w * f) / sum(w) AS rate FROM x GROUP BY rep)
SELECT (SELECT round(avg(f), 9) FROM e) AS difference, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high FROM s""")
def paired_bootstrap_diff(spark, d):
    r = resampling.paired_difference(table(spark, d, "events").select("event_id", "value"), "event_id", F.col("value") > 60, F.col("value") > 90, REPS)
    return r.select(*(F.round(c, 9).alias(c) for c in ("difference", "low", "high")))


_FAMILY_RATES = "sum({w} * c) / sum({w}) AS macro, sum({w} * c * n) / sum({w} * n) AS pooled"
_FAMILIES = "f AS (SELECT split_part(p_brand, '#', 2)::BIGINT AS brand, avg((p_size > 25)::INT) AS c, count(*)::DOUBLE AS n, 0 AS cls FROM part GROUP BY p_brand)"


@query(f"""WITH {_FAMILIES}, {_resampled('(SELECT brand, c, n AS size, cls FROM f)', 'brand', 10_000)},
draws AS (SELECT rep, {_FAMILY_RATES.format(w='w')} FROM (SELECT rep, c, size AS n, w FROM x) GROUP BY rep), pt AS (SELECT {_FAMILY_RATES.format(w='1')} FROM f) {_summary('draws', 'pt', ('macro', 'pooled'))}""")
def family_bootstrap(spark, d):
    f = table(spark, d, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") > 25).cast("int")).alias("c"), F.count(F.lit(1)).alias("n"))
    f = f.withColumn("brand", F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("long"))
    return _rounded(resampling.family_bootstrap(f, "brand", F.col("c"), F.col("n"), 10_000), "point", "low", "high")


_LEGACY = """u AS (SELECT feature, value, bool_or(ref) AS own FROM v GROUP BY ALL), k AS (SELECT feature, count(*) FILTER (own) AS own, count(*) AS seen FROM u GROUP BY feature),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM v WHERE ref GROUP BY feature),
b AS (SELECT v.feature, ref, CASE WHEN own <= 10 AND seen < 64 THEN value::VARCHAR ELSE 'i' || len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) END AS bin FROM v JOIN k USING (feature) JOIN q USING (feature)),
bins AS (SELECT feature, value::VARCHAR AS bin FROM u JOIN k USING (feature) WHERE k.own <= 10 AND seen < 64 UNION ALL SELECT feature, 'i' || unnest(range(0, greatest(len(e) - 1, 1))) FROM q JOIN k USING (feature) WHERE NOT (own <= 10 AND seen < 64)),
c AS (SELECT feature, bin, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM b GROUP BY ALL),
s AS (SELECT feature, greatest(coalesce(a, 0) / sum(a) OVER (PARTITION BY feature), 1e-4) AS p, greatest(coalesce(b, 0) / sum(b) OVER (PARTITION BY feature), 1e-4) AS q FROM bins LEFT JOIN c USING (feature, bin))
SELECT feature, round(sum((q - p) * ln(q / p)), 9) AS psi FROM s GROUP BY feature"""


@query(f"WITH {_LONG}, {_LEGACY}")
def psi_legacy(spark, d):
    v = statistics._long(spark, d)
    return drift.psi(v, F.col("ref"), drift.legacy_bins(v.filter("ref"), v.filter("NOT ref"))).select("feature", F.round("psi", 9).alias("psi"))


@query(f"""WITH {_BY_PART.replace("SELECT l_returnflag AS part", "SELECT l_orderkey AS key, l_returnflag AS part").replace("v AS (SELECT ref,", "v AS (SELECT key, ref,")}, {_psi('feature', 'ref')},
r AS (SELECT feature, ref, key AS event_id, CASE WHEN atoms.i IS NOT NULL THEN 'a' || atoms.i ELSE 'i' || len(list_filter(coalesce(edges, []), lambda e: e <= v.value)) END AS bin, rep
  FROM v LEFT JOIN atoms USING (feature, value) LEFT JOIN edges USING (feature), (SELECT unnest(range({RANK_REPS})) AS rep)), x AS (SELECT *, {_poisson_case("(('0x' || substr(md5(event_id || ':' || rep), 1, 8))::BIGINT::DOUBLE / 4294967296.0)")} AS w FROM r),
rc AS (SELECT rep, feature, bin, coalesce(sum(w) FILTER (ref), 0) AS a, coalesce(sum(w) FILTER (NOT ref), 0) AS b FROM x GROUP BY ALL),
rs AS (SELECT rep, feature, greatest(coalesce(a, 0) / sum(a) OVER k, 1e-4) AS p, greatest(coalesce(b, 0) / sum(b) OVER k, 1e-4) AS q FROM (SELECT * FROM bins, (SELECT unnest(range({RANK_REPS})) AS rep)) LEFT JOIN rc USING (rep, feature, bin) WINDOW k AS (PARTITION BY rep, feature)),
rp AS (SELECT rep, split_part(feature, '/', 2) AS name, max(psi) AS psi FROM (SELECT rep, feature, sum((q - p) * ln(q / p)) AS psi FROM rs GROUP BY ALL) GROUP BY ALL),
w(name, weight) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _WEIGHT.items())}), k AS (SELECT name, row_number() OVER (PARTITION BY rep ORDER BY psi * weight DESC, name) AS rank FROM rp JOIN w USING (name))
SELECT name AS feature, round(quantile_cont(rank, 0.025), 6) AS rank_low, round(quantile_cont(rank, 0.975), 6) AS rank_high, round(avg((rank <= 2)::INT), 6) AS p_top FROM k GROUP BY name""")
def drift_rank_intervals(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("part"), F.expr(_CUT).alias("ref"), *_COLUMNS)
    li = li.withColumn("weights", drift.replicate_weights(F.col("key"), RANK_REPS))
    v = drift.long_form(li, _COLUMNS, ["key", "part", "ref", "weights"]).withColumn("feature", F.concat_ws("/", "part", "feature"))
    p = drift.resampled_psi(v, "key", "ref", drift.psi_bins(v.filter("ref")), RANK_REPS, weights="weights")
    p = p.groupBy("rep", F.split_part("feature", F.lit("/"), F.lit(2)).alias("feature")).agg(F.max("psi").alias("psi"))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in _WEIGHT.items() for x in kv)), F.col("feature"))
    r = drift.rank_intervals(p.withColumn("weighted", F.col("psi") * weight), 2)
    return r.select("feature", *(F.round(c, 6).alias(c) for c in ("rank_low", "rank_high", "p_top")))
