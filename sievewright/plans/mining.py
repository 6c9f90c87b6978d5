"""Queries of rule mining, rule evaluation, models, verdicts and the end-to-end triage of the synthetic corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, hashing
from ..operators import boosting, density, features, models, policy, reduction, rules, substrings, tagging
from ..sources import corpus, pe, records
from ..sources.tables import table, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Atoms: words of a document; the group is one language, the others are benign.
_TOKENS = "t AS (SELECT DISTINCT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS atom FROM documents), a AS (SELECT * FROM t WHERE length(atom) >= 4)"


def _atoms(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda w: F.length(w) >= 4)
    return rules.exploded(table(spark, d, "documents"), "doc_id", words, "lang")


def _sizes(spark, d, lang):
    r = table(spark, d, "documents").agg(F.count_if(F.col("lang") == lang).alias("n"), F.count_if(F.col("lang") != lang).alias("m")).first()
    return r["n"], r["m"]


@query(f"WITH {_TOKENS} SELECT lang, atom, count(DISTINCT doc_id) AS support FROM a GROUP BY ALL HAVING count(DISTINCT doc_id) >= 20")
def atom_support(spark, d):
    return _atoms(spark, d).groupBy("lang", "atom").agg(F.countDistinct("sample").alias("support")).filter("support >= 20")


def _mined_sql(lang: str, most: int = 8) -> str:
    return f"""n AS (SELECT count(*) FILTER (lang = '{lang}') AS ng, count(*) FILTER (lang <> '{lang}') AS nb FROM documents),
c AS (SELECT atom, count(DISTINCT doc_id) FILTER (lang = '{lang}') AS n_in, count(DISTINCT doc_id) FILTER (lang <> '{lang}') AS n_out FROM a GROUP BY atom),
m AS (SELECT atom, n_in, n_out, n_in / ng - 5 * n_out / greatest(nb, 1) AS worth FROM c, n WHERE n_in >= greatest(1, ceil(0.3 * ng)) AND n_out / greatest(nb, 1) <= 0.02),
p AS (SELECT *, row_number() OVER (ORDER BY worth DESC, atom)::INT AS place FROM m QUALIFY place <= {most})"""


def _mined(spark, d, lang="fr"):
    a, (n, m) = _atoms(spark, d), _sizes(spark, d, lang)
    group, benign = a.filter(F.col("lang") == lang), a.filter(F.col("lang") != lang)
    inside = rules.supported(group, n)
    # The others' texts are split once; only atoms that can be in a rule are kept of them.
    benign = written(rules.among(benign, inside).select("sample", "atom"))
    return rules.rarest(inside, benign, n, m, rate=0.02), group, benign, m


@query(f"WITH {_TOKENS}, {_mined_sql('fr')} SELECT atom, n_in, n_out, place FROM p")
def rare_atom_mining(spark, d):
    return _mined(spark, d)[0].select("atom", "n_in", "n_out", "place")


@query(f"""WITH {_TOKENS}, {_mined_sql('fr')}, h AS (SELECT doc_id, count(DISTINCT atom) AS hits FROM a JOIN p USING (atom) WHERE lang <> 'fr' GROUP BY doc_id),
s AS (SELECT unnest(range(1, (SELECT count(*) FROM p) + 1)) AS N), w AS (SELECT N, (SELECT count(*) FROM h WHERE hits >= N) AS wrong FROM s) SELECT min(N)::BIGINT AS threshold FROM w WHERE wrong = 0""")
def smallest_n_rule(spark, d):
    mined, _, benign, m = _mined(spark, d)
    return rules.smallest_n(mined, benign, m)


_SWEEP = {"r_fr": ("fr", 2, ["dans", "pour", "avec", "elle", "mais"]), "r_de": ("de", 2, ["einer", "eine", "nicht", "auch", "sich"]), "r_es": ("es", 3, ["para", "como", "pero", "quell", "mente"])}
_SWEEP_SQL = "r(rule, family, threshold, atom) AS (VALUES " + ", ".join(f"('{r}', '{f}', {n}, '{a}')" for r, (f, n, atoms) in _SWEEP.items() for a in atoms) + ")"


def _sweep(spark, d):
    atoms = spark.createDataFrame([(r, f, n, a) for r, (f, n, x) in _SWEEP.items() for a in x], "rule string, family string, threshold int, atom string")
    return rules.sweep(_atoms(spark, d), atoms.drop("family")), atoms.select("rule", "family").distinct()


@query(f"WITH {_TOKENS}, {_SWEEP_SQL} SELECT rule, doc_id AS sample FROM a JOIN r USING (atom) GROUP BY rule, doc_id, threshold HAVING count(DISTINCT atom) >= threshold")
def rule_sweep(spark, d):
    return _sweep(spark, d)[0]


@query(f"""WITH {_TOKENS}, {_SWEEP_SQL}, f AS (SELECT rule, family, doc_id FROM a JOIN r USING (atom) GROUP BY rule, family, doc_id, threshold HAVING count(DISTINCT atom) >= threshold),
s AS (SELECT doc_id, nullif(lang, 'en') AS of FROM documents), q AS (SELECT DISTINCT rule, family FROM r)
SELECT q.rule, q.family, count(f.doc_id) FILTER (of IS NULL) AS benign_hits, (SELECT count(*) FROM s WHERE of IS NULL) AS benign_total, count(*) FILTER (of = q.family) AS own_hits,
(SELECT count(*) FROM s WHERE of = q.family) AS own_total, count(*) FILTER (of <> q.family) AS cross_hits, round(1 - count(f.doc_id) FILTER (of IS NULL) / (SELECT count(*) FROM s WHERE of IS NULL), 9) AS specificity,
round(count(*) FILTER (of = q.family) / (SELECT count(*) FROM s WHERE of = q.family), 9) AS coverage FROM q LEFT JOIN f USING (rule) LEFT JOIN s USING (doc_id) GROUP BY q.rule, q.family""")
def specificity_coverage(spark, d):
    fired, names = _sweep(spark, d)
    samples = table(spark, d, "documents").select(F.col("doc_id").alias("sample"), F.nullif("lang", F.lit("en")).alias("family"))
    return rules.validated(fired, names, samples).withColumns({"specificity": F.round("specificity", 9), "coverage": F.round("coverage", 9)})


@query("""SELECT DISTINCT text AS s FROM benchmark WHERE length(text) >= 6 AND NOT EXISTS (SELECT 1 FROM documents WHERE contains(documents.text, benchmark.text))""")
def anti_substring(spark, d):
    """Whole benchmark texts that no document contains."""
    return substrings.absent_strings(table(spark, d, "benchmark").select(F.col("text").alias("s")).distinct(), table(spark, d, "documents").select("text"), "text")


_STRINGS_SQL = """g AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[a-zà-ÿA-ZÀ-ß]+')) AS w, substr(text, 1, 40) AS header FROM documents WHERE lang = 'fr' AND length(text) > 200),
o AS (SELECT doc_id, header, unnest(w) AS s FROM g), n AS (SELECT count(*) AS n FROM g),
c AS (SELECT s, count(DISTINCT doc_id) AS support FROM o WHERE length(s) >= 6 AND NOT contains(header, s) GROUP BY s HAVING count(DISTINCT doc_id) >= greatest(1, ceil(0.02 * (SELECT n FROM n)))),
a AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang IN ('de', 'en') AND contains(text, c.s))),
x AS (SELECT a.*, EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zà-ÿA-ZÀ-ß]+')) AS name FROM documents WHERE lang = 'es') t WHERE t.name = a.s) AS api FROM a),
k AS (SELECT s, support, row_number() OVER (ORDER BY support DESC, length(s) DESC, s)::INT AS place FROM x WHERE NOT api OR (SELECT count(*) FROM x WHERE NOT api) = 0 QUALIFY place <= 8)"""


def _string_candidates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", F.regexp_extract_all("text", F.lit("[a-zà-ÿA-ZÀ-ß]+"), F.lit(0)).alias("w"))
    group = docs.filter("lang = 'fr' AND length(text) > 200").select(F.col("doc_id").alias("sample"), F.col("w").alias("strings"), F.substring("text", 1, 40).alias("header"))
    names = docs.filter("lang = 'es'").select(F.explode("w").alias("name")).distinct()
    return rules.candidate_strings(group, docs.filter("lang IN ('de', 'en')").select("text"), names, support=0.02)


@query(f"WITH {_STRINGS_SQL} SELECT s, support, place FROM k")
def candidate_strings(spark, d):
    """Strings that tell one language's documents from two others', a fourth one's words standing for imported names."""
    return _string_candidates(spark, d)


@query(f"""WITH {_STRINGS_SQL} SELECT 'rule fr_words' || chr(10) || '{{' || chr(10) || '  strings:' || chr(10) || string_agg('    $s' || (place - 1) || ' = "' || s || '"', chr(10) ORDER BY place) || chr(10) || '  condition:' || chr(10) || '    uint16(0) == 0x5A4D and '
|| ceil(count(*) / 2)::INT || ' of them' || chr(10) || '}}' || chr(10) AS text, ceil(count(*) / 2)::INT AS threshold FROM k HAVING count(*) > 0""")
def synthesized_rule(spark, d):
    from ..functions import rule_text

    s = rules.synthesized(_string_candidates(spark, d))
    return s.select(rule_text.rendered(F.lit("fr words"), F.col("strings"), F.col("threshold").cast("string")).alias("text"), "threshold")


@query("""WITH k AS (SELECT l_orderkey, md5(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey)) AS key, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey),
c AS (SELECT f AS family, key, row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, key) AS r FROM k WHERE f <> 'N' GROUP BY f, key QUALIFY r <= 5)
SELECT family, arg_min(key, r) AS key FROM c WHERE key NOT IN (SELECT key FROM k WHERE f = 'N') GROUP BY family""")
def filtered_mode_rule(spark, d):
    """Each family's most common digest that no benign order has."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    k = table(spark, d, "lineitem").groupBy("l_orderkey").agg(line.alias("x"), F.min("l_returnflag").alias("family"))
    k = k.select("l_orderkey", "family", F.md5(F.array_join(F.transform("x", lambda s: s["l_partkey"].cast("string")), ",")).alias("key"))
    return rules.filtered_mode(k.filter("family <> 'N'"), k.filter("family = 'N'"))


@query("SELECT p_partkey, '\"' || replace(replace(p_name || '\\x\"' || p_size, '\\', '\\\\'), '\"', '\\\"') || '\"' AS quoted FROM part")
def rule_text_escape(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.quoted(F.concat("p_name", F.lit('\\x"'), F.col("p_size").cast("string"))).alias("quoted"))


@query("""WITH k AS (SELECT l_orderkey, md5(string_agg(l_partkey % 4, ',' ORDER BY l_linenumber, l_partkey)) AS key, min(l_returnflag) AS family FROM lineitem GROUP BY l_orderkey),
c AS (SELECT family, key, count(*) AS n, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, key) AS r FROM k GROUP BY family, key)
SELECT family, key, n, (SELECT count(*) FROM k WHERE k.key = c.key AND k.family <> c.family) AS others FROM c WHERE r = 1""")
def mode_key_rule(spark, d):
    """The rule of a family's most common digest, and how many rows of other families share it."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    k = table(spark, d, "lineitem").groupBy("l_orderkey").agg(line.alias("x"), F.min("l_returnflag").alias("family"))
    k = k.select("family", F.md5(F.array_join(F.transform("x", lambda s: (s["l_partkey"] % 4).cast("string")), ",")).alias("key"))
    c = k.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "key")))
    return c.filter("r = 1").select("family", "key", "n", (F.col("all") - F.col("n")).alias("others"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_W = [0.5, -0.25, 1.5, -2.0]
_Z_SQL = "m AS (SELECT " + ", ".join(f"avg({c}) AS mu{i}, stddev_pop({c}) AS sd{i}" for i, c in enumerate(_NUM)) + " FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"({c} - mu{i}) / sd{i} AS z{i}" for i, c in enumerate(_NUM)) + " FROM lineitem, m)"


@query(f"WITH {_Z_SQL} SELECT l_orderkey, l_linenumber, {', '.join(f'round(z{i}, 6) AS z{i}' for i in range(4))} FROM z")
def standardize(spark, d):
    li = table(spark, d, "lineitem")
    z = models.standardized(li.select("l_orderkey", "l_linenumber", *_NUM), _NUM, models.moments(li, _NUM))
    return z.select("l_orderkey", "l_linenumber", *(F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(4)))


_C = [f"({w}::DOUBLE) * z{i}" for i, w in enumerate(_W)]
_TOP = f"greatest({', '.join(f'abs({c})' for c in _C)})"


@query(f"""WITH {_Z_SQL} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-({' + '.join(_C)} - 0.1))), 6) AS score,
CASE {' '.join(f"WHEN abs({c}) = {_TOP} THEN '{n}'" for c, n in zip(_C, _NUM))} END AS top_feature, round(CASE {' '.join(f"WHEN abs({c}) = {_TOP} THEN {c}" for c in _C)} END, 6) AS contribution FROM z""")
def linear_score_topk_attrib(spark, d):
    li = table(spark, d, "lineitem")
    z = models.standardized(li.select("l_orderkey", "l_linenumber", *_NUM), _NUM, models.moments(li, _NUM))
    s = z.select("l_orderkey", "l_linenumber", F.round(models.linear_score(F.col("z"), _W, -0.1), 6).alias("score"), models.linear_attributions(F.col("z"), _NUM, _W, 2)[0].alias("a"))
    return s.select("l_orderkey", "l_linenumber", "score", F.col("a.feature").alias("top_feature"), F.round("a.contribution", 6).alias("contribution"))


_NEAREST_SQL = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), c AS (SELECT label AS g, i, avg(x) AS m FROM e GROUP BY label, i),
d AS (SELECT vec_id, e.label, g, sum((x - m) * (x - m)) AS dist FROM e JOIN c USING (i) GROUP BY vec_id, e.label, g), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, g) AS r FROM d)"""


def _nearest(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return models.nearest(e, "v", models.centroids(e, "v", "label"), "label")


@query(f"WITH {_NEAREST_SQL} SELECT vec_id, g AS nearest, round(dist, 6) AS distance FROM n WHERE r = 1")
def nearest_centroid(spark, d):
    return _nearest(spark, d).select("vec_id", "nearest", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_NEAREST_SQL}, t AS (SELECT label, g, count(*)::DOUBLE AS n FROM n WHERE r = 1 GROUP BY ALL), a AS (SELECT sum(n) AS n FROM t GROUP BY label), b AS (SELECT sum(n) AS n, max(n) AS m FROM t GROUP BY g),
s AS (SELECT (SELECT sum(n) FROM t) AS N, (SELECT sum(n * (n - 1) / 2) FROM t) AS p, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
(SELECT sum(n * ln(n)) FROM t) AS h, (SELECT sum(n * ln(n)) FROM a) AS ha, (SELECT sum(n * ln(n)) FROM b) AS hb, (SELECT sum(m) FROM b) AS pure),
x AS (SELECT *, pa * pb / (N * (N - 1) / 2) AS ex, ln(N) - ha / N AS ea, ln(N) - hb / N AS eb, ln(N) + (h - ha - hb) / N AS mi FROM s)
SELECT round((p - ex) / ((pa + pb) / 2 - ex), 6) AS ari, round(mi / ((ea + eb) / 2), 6) AS nmi, round(mi / ea, 6) AS homogeneity, round(mi / eb, 6) AS completeness, round(pure / N, 6) AS purity FROM x""")
def cluster_agreement(spark, d):
    return models.agreement(_nearest(spark, d), "label", "nearest").select(*(F.round(c, 6).alias(c) for c in ("ari", "nmi", "homogeneity", "completeness", "purity")))


@query("""WITH s AS (SELECT doc_id, length(text) % 100 / 100.0::DOUBLE AS score, toxic = 1 AS risky, quality = 0 AS packed FROM documents JOIN labels USING (doc_id)),
v AS (SELECT *, CASE WHEN score >= 0.7 THEN 'MALICIOUS' WHEN score >= 0.3 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS v FROM s)
SELECT doc_id, round(score, 4) AS score, CASE WHEN v = 'BENIGN' AND risky THEN 'SUSPICIOUS' ELSE v END AS verdict, v = 'BENIGN' AND risky AS floored, packed OR v = 'SUSPICIOUS' OR (v = 'BENIGN' AND risky) AS route FROM v""")
def verdict_policy(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    s = j.select("doc_id", (F.length("text") % 100 / 100.0).alias("score"), "toxic", "quality")
    return policy.verdict(s, F.col("score"), F.col("toxic") == 1, F.col("quality") == 0).select("doc_id", "score", "verdict", "floored", "route")


@query("""WITH s AS (SELECT doc_id, length(text) % 100 / 100.0::DOUBLE AS score, toxic = 1 AS risky, quality = 0 AS packed, lang, source FROM documents JOIN labels USING (doc_id)),
b AS (SELECT *, CASE WHEN score >= 0.7 THEN 'MALICIOUS' WHEN score >= 0.3 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS v FROM s)
SELECT doc_id, CASE WHEN v = 'BENIGN' AND risky THEN 'SUSPICIOUS' ELSE v END AS verdict, CASE WHEN v = 'BENIGN' AND NOT risky THEN NULL ELSE lang END AS family,
concat_ws('; ', 'from ' || coalesce(source, '?'), CASE WHEN v = 'BENIGN' AND risky THEN 'low score, but high-risk capabilities T1, T2: raised to SUSPICIOUS' END, CASE WHEN packed THEN 'packed: the static view is partial; run it in a sandbox' END) AS notes FROM b""")
def triage_document(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    s = j.select("doc_id", (F.length("text") % 100 / 100.0).alias("score"), "toxic", "quality", "lang", "source")
    v = policy.verdict(s, F.col("score"), F.col("toxic") == 1, F.col("quality") == 0)
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    more = {"packed": F.col("quality") == 0, "nearest": F.col("lang"), "techniques": F.array(F.lit("T2"), F.lit("T1"), F.lit("T2")), "anomalies": F.array(F.concat(F.lit("from "), F.coalesce("source", F.lit("?")))), "signals": nothing, "contributions": nothing, "rule": none, "structural": none}
    return policy.documented(v.withColumns(more)).select("doc_id", "verdict", "family", F.array_join("notes", "; ").alias("notes"))


@query("""WITH s AS (SELECT toxic = 1 AS theirs, regexp_matches(text, 'idiot|moron|trash') AS ours, lang FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (ours AND theirs) AS tp, count(*) FILTER (ours AND NOT theirs) AS fp, count(*) FILTER (NOT ours AND theirs) AS fn FROM s GROUP BY lang)
SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM c""")
def capability_agreement(spark, d):
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    a = tagging.agreement(s, F.col("text").rlike("idiot|moron|trash"), F.col("toxic") == 1, ["lang"])
    return a.withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


# Rows-only queries: models and the synthetic corpus, which SQL can't state.


def _labelled(spark, d):
    """Every row of lineitem, for fitting and for the result alike."""
    li = table(spark, d, "lineitem").select(*_NUM, (F.col("l_returnflag") == "R").cast("double").alias("label"), "l_orderkey", "l_linenumber")
    return models.assembled(li, _NUM)


@query()
def lr_fit(spark, d):
    m = models.fit_logistic(_labelled(spark, d), "label")
    return spark.createDataFrame([(n, float(w)) for n, w in zip([*_NUM, "(bias)"], [*m.coefficients, m.intercept])], "feature string, weight double")


_BOOSTED = boosting.Params(rounds=5, leaves=8, depth=3)


def _boosted(x):
    return boosting.fit(x, F.col("label"), _NUM, ["l_orderkey", "l_linenumber"], _BOOSTED)


@query()
def gbt_fit_score(spark, d):
    x = _labelled(spark, d)
    return boosting.scored(x, _boosted(x)).select("l_orderkey", "l_linenumber", "score")


@query()
def tree_shap_additivity(spark, d):
    x = _labelled(spark, d)
    c = boosting.contributions(x, _boosted(x)[0])
    return c.select("l_orderkey", "l_linenumber", F.abs(F.aggregate("contributions", F.col("base"), lambda a, y: a + y) - F.col("margin")).alias("gap"))


@query()
def gbt_ablation(spark, d):
    """Each feature left out in turn, and all amounts, with two seeds: eight refits and two full models in the same passes; a quarter of the orders is held out."""
    x = _labelled(spark, d)
    drops = {c: [c] for c in _NUM[:3]} | {"amounts": _NUM[:2]}
    p = boosting.Params(rounds=5, leaves=8, depth=3, row_share=0.8)
    a = boosting.ablation(x, F.col("label"), _NUM, ["l_orderkey", "l_linenumber"], drops, [1, 2], F.col("l_orderkey") % 4 == 0, p)
    return a.select("dropped", "seed", F.round("auc", 9).alias("auc"), F.round("difference", 9).alias("difference"))


@query()
def kmeans_pca(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return models.agreement(models.clustered(e, "v", 10, 20), "label", "cluster")


@query()
def embedding_svd(spark, d):
    """The largest singular values of all embeddings, centred and scaled, and their squares' share of the whole."""
    e = table(spark, d, "embeddings").select("embedding")
    found = reduction.svd(e, "embedding", 16, standardise=True)
    whole = e.agg(F.count(F.lit(1)) * F.max(F.size("embedding"))).first()[0] or 1
    return spark.createDataFrame([(k + 1, round(float(v), 6), round(float(v * v / whole), 9)) for k, v in enumerate(found.values)], "component int, value double, share double")


_REACH = 1.2


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y WHERE list_distance(x.v, y.v) <= {_REACH}),
dense AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 5), r(a, b) AS (SELECT a, a FROM dense UNION SELECT r.a, n.b FROM r JOIN n ON n.a = r.b JOIN dense ON dense.a = n.b),
named AS (SELECT a, min(b) AS name FROM r GROUP BY a), beside AS (SELECT n.a, min(name) AS name FROM n JOIN named ON named.a = n.b WHERE n.a NOT IN (SELECT a FROM dense) GROUP BY n.a)
SELECT vec_id, coalesce(named.name, beside.name, -1) AS cluster FROM v LEFT JOIN named ON named.a = vec_id LEFT JOIN beside ON beside.a = vec_id""")
def density_clusters(spark, d):
    """All embeddings by density: five neighbours within 1.2."""
    return density.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", _REACH, 5)


def _scrambled(k: str) -> str:
    """SQL: a block of murmur3 scrambled, as UBIGINT of 32 bits."""
    x = f"(({k} * 3432918353::UBIGINT) & 4294967295)"
    return f"(((({x} << 15) | ({x} >> 17)) & 4294967295) * 461845907::UBIGINT) & 4294967295"


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zà-ÿA-ZÀ-ß]+')) AS w FROM documents), t AS (SELECT DISTINCT w, hex(encode(w)) AS x, octet_length(encode(w)) AS n FROM w),
b AS (SELECT w, n, list_transform(range(4 * ((n + 3) // 4)), lambda i: CASE WHEN i < n THEN ('0x' || substr(x, (2 * i + 1)::INT, 2))::UBIGINT ELSE 0::UBIGINT END) AS b FROM t),
k AS (SELECT w, n, list_transform(range((n + 3) // 4), lambda i: b[4 * i + 1] | (b[4 * i + 2] << 8) | (b[4 * i + 3] << 16) | (b[4 * i + 4] << 24)) AS k FROM b),
s AS (SELECT w, n, list_transform(k, lambda v: {_scrambled('v')}) AS s FROM k),
h0 AS (SELECT w, n, list_reduce(list_prepend(0::UBIGINT, s[:n // 4]), lambda h, v: (((((xor(h, v) << 13) | (xor(h, v) >> 19)) & 4294967295) * 5 + 3864292196::UBIGINT) & 4294967295)) AS h, CASE WHEN n % 4 > 0 THEN s[n // 4 + 1] ELSE 0::UBIGINT END AS tail FROM s),
h1 AS (SELECT w, xor(xor(h, tail), n::UBIGINT) AS h FROM h0), h2 AS (SELECT w, (xor(h, h >> 16) * 2246822507::UBIGINT) & 4294967295 AS h FROM h1), h3 AS (SELECT w, (xor(h, h >> 13) * 3266489909::UBIGINT) & 4294967295 AS h FROM h2),
h4 AS (SELECT w, xor(h, h >> 16)::BIGINT AS u FROM h3), c AS (SELECT w, CASE WHEN u >= 2147483648 THEN 4294967296 - u ELSE u END % 1024 AS cell, CASE WHEN u >= 2147483648 THEN -1.0 ELSE 1.0 END AS sign FROM h4)
SELECT doc_id, cell, sum(sign)::DOUBLE AS value FROM w JOIN c USING (w) GROUP BY doc_id, cell HAVING sum(sign) <> 0""")
def hashed_documents(spark, d):
    """Every document's words as a signed hashed vector of 1,024 cells, those that aren't 0."""
    words = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[a-zà-ÿA-ZÀ-ß]+"), F.lit(0)).alias("words"))
    return hashing.hashed_tokens(words, "words", 1024, ["doc_id"])


_ENTROPY_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, h, n, unnest(range(0, CASE WHEN n < 256 THEN 1 ELSE (n - 256) // 128 + 1 END)) AS k FROM b WHERE n > 0),
p AS (SELECT doc_id, k, unnest(range(k * 128, least(k * 128 + 256, n))) AS i, h FROM w),
c AS (SELECT doc_id, k, substr(h, (2 * i + 1)::INT, 1) AS nibble, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT doc_id, k, least(floor(round(-sum(n / 256 * log2(n / 256)), 12) * 4), 15)::INT AS bin FROM c GROUP BY ALL),
s AS (SELECT doc_id, bin * 16 + strpos('0123456789ABCDEF', nibble) - 1 AS cell, sum(n)::BIGINT AS n FROM c JOIN e USING (doc_id, k) GROUP BY ALL)
SELECT doc_id, cell::BIGINT AS cell, n FROM s"""


@query(_ENTROPY_SQL)
def sliding_entropy_hist(spark, d):
    """Cells of the byte-entropy histogram of each document's UTF-8 bytes (windows of 256 in steps of 128), by the parser's own kernel."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            h = [pe.byte_entropy(np.frombuffer(x or b"", np.uint8), 256, 128).tolist() for x in b.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(h, pa.list_(pa.int64()))], ["doc_id", "hist"])

    h = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).mapInArrow(run, "doc_id long, hist array<long>")
    return h.select("doc_id", F.posexplode("hist").alias("cell", "n")).filter("n > 0").withColumn("cell", F.col("cell").cast("long"))


def _triaged(spark, d):
    """The synthetic corpus, read: it grows with the folder's tables (a benign file for each 160 parts or so, 27 at least). Reports and records are written once, as features name them hundreds of times."""
    n = max(9, table(spark, d, "part").count() // 500)
    c = written(records.from_reports(written(pe.dissected(corpus.corpus(spark, n)))))
    return c.filter("error IS NULL").withColumn("signals", policy.packing_signals(F.col("report")))


@query()
def pe_features(spark, d):
    return features.named_features(_triaged(spark, d), "record", "path", "family", "label")


@query()
def pe_vectors(spark, d):
    return hashing.hashed_vectors(_triaged(spark, d), "record", ["path"])


@query()
def pe_triage(spark, d):
    """Corpus -> report -> features -> logistic score -> verdict with capabilities and packing."""
    from ..functions import text as T

    t = _triaged(spark, d)
    names = F.flatten(F.transform(F.concat("report.imports", "report.delay_imports"), lambda i: i["functions"]))
    texts = T.printable_runs(T.latin(F.col("content")), most=fixed.MAX_STRINGS)
    ignored = T.printable_runs(T.latin(F.col("report.certificate")))
    t = written(t.withColumn("capabilities", tagging.capabilities(fixed.RULES, names, texts, ignored)).select("path", "family", "label", "signals", "capabilities", "record"))
    columns = ["file_entropy", "n_imports", "capability_count", "n_wx_sections", "printable_ratio"]
    # Written before the fit, which passes over its rows several times.
    x = models.assembled(written(features.named_features(t, "record", "path", "family", "label", "signals", "capabilities").select("path", "family", "label", "signals", "capabilities", *columns)), columns)
    m = models.fit_logistic(x.withColumn("label", F.col("label").cast("double")), "label")
    s = models.linear_score(F.array(*columns), [float(w) for w in m.coefficients], float(m.intercept))
    ids = tagging.strings(tuple(r.attack_id for r in fixed.RULES if r.high_risk))
    risky = F.arrays_overlap(F.transform("capabilities", lambda c: c["attack_id"]), ids)
    v = policy.verdict(x.withColumn("raw", s), F.col("raw"), risky, F.size("signals") >= 2)
    return v.select("path", "family", "score", "verdict", "floored", "route", (F.size("signals") >= 2).alias("packed"), F.transform("capabilities", lambda c: c["attack_id"]).alias("techniques"))


@query()
def pe_rules(spark, d):
    """Structural atoms of the corpus, mined per family against benign files, with the least N that hits no benign file."""
    from ..functions import text as T

    t = _triaged(spark, d)
    calls = F.flatten(F.transform("record.imports", lambda i: F.transform(F.filter(i["functions"], lambda f: (f != "") & ~f.startswith("ordinal") & ~f.isin(*fixed.COMMON_FUNCTIONS)), lambda f: F.concat(F.lit("imp:"), F.lower(i["dll"]), F.lit(":"), f))))
    secs = F.transform(F.filter("record.section.sections", lambda s: (s["name"] != "") & ~F.lower(s["name"]).isin(*fixed.ATOM_STANDARD_SECTIONS)), lambda s: F.concat(F.lit("sec:"), s["name"]))
    atoms = F.concat(calls, secs, F.array(F.concat(F.lit("imphash:"), T.import_digest(F.col("record.imports")))))
    a = rules.exploded(t, "path", atoms, "family").withColumn("family", F.when(F.col("family") != "benign", F.col("family")))
    best = rules.mined_by(a, order=[F.expr("NOT atom LIKE 'imphash:%'")])
    return rules.smallest_n_by(best, a.filter("family IS NULL").select("sample", "atom"))
