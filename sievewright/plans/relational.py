"""Queries of scans, projections, joins, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tagging
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity >= 25")
def scan_filter_project(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity >= 25")
    return li.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("""SELECT doc_id, len(r)::INT AS n_runs, r[1] AS first_run, coalesce(list_max(list_transform(r, lambda x: length(x))), 0)::INT AS longest
FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7e]{5,}') AS r FROM documents)""")
def printable_strings(spark, d):
    r = table(spark, d, "documents").select("doc_id", T.printable_runs(F.col("text")).alias("r"))
    longest = F.coalesce(F.array_max(F.transform("r", F.length)), F.lit(0))
    return r.select("doc_id", F.size("r").alias("n_runs"), F.get("r", F.lit(0)).alias("first_run"), longest.alias("longest"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)c:\\\\'))::BIGINT AS n_paths, len(regexp_extract_all(html, '(?i)https?://'))::BIGINT AS n_urls,
len(regexp_extract_all(html, 'HKEY_'))::BIGINT AS n_registry, len(regexp_extract_all(html, 'MZ'))::BIGINT AS n_mz FROM pages""")
def ioc_counters(spark, d):
    return table(spark, d, "pages").select("page_id", *T.counters(F.col("html")))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL),
e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM n GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(e, 0), 6) AS entropy FROM documents d LEFT JOIN e USING (doc_id)""")
def char_entropy(spark, d):
    return T.char_entropy(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("""WITH c AS (SELECT unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT c, count(*) AS n FROM c WHERE c <> '' GROUP BY c)
SELECT c, n, round(n / (SELECT sum(n) FROM n), 9) AS share FROM n ORDER BY n DESC, c LIMIT 40""")
def char_histogram_share(spark, d):
    n = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("s")))).select("c", "n", F.round(F.col("n") / F.col("s"), 9).alias("share")).orderBy(F.desc("n"), "c").limit(40)


_FLAGS = [(1, "RELOCS_STRIPPED"), (2, "EXECUTABLE_IMAGE"), (4, "LINE_NUMS_STRIPPED"), (8, "LOCAL_SYMS_STRIPPED")]


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_linenumber & 1 > 0 THEN 'RELOCS_STRIPPED' END, CASE WHEN l_linenumber & 2 > 0 THEN 'EXECUTABLE_IMAGE' END,
CASE WHEN l_linenumber & 4 > 0 THEN 'LINE_NUMS_STRIPPED' END, CASE WHEN l_linenumber & 8 > 0 THEN 'LOCAL_SYMS_STRIPPED' END) AS flags FROM lineitem""")
def flag_decode(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(T.flag_names(F.col("l_linenumber"), _FLAGS), ",").alias("flags"))


@query("""SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'I386' WHEN 1 THEN 'AMD64' WHEN 2 THEN 'ARM' ELSE '0x' || lower(hex(c_nationkey)) END AS machine FROM customer""")
def enum_decode(spark, d):
    hexed = F.concat(F.lit("0x"), F.lower(F.hex(F.col("c_nationkey"))))
    return table(spark, d, "customer").select("c_custkey", T.enum_name(F.col("c_nationkey"), {0: "I386", 1: "AMD64", 2: "ARM"}, hexed).alias("machine"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""SELECT l_orderkey, md5(string_agg('p' || l_linestatus || '.' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest FROM lineitem GROUP BY l_orderkey""".replace("'p' || l_linestatus", "lower(l_linestatus)"))
def import_digest(spark, d):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.col("l_linestatus"), F.lit(".DLL")).alias("dll"), F.array(F.col("l_partkey").cast("string")).alias("functions"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("imports"))
    return o.select("l_orderkey", T.import_digest(F.col("imports")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE ('0x' || substr(sha256(text), 1, 4))::INT < 32768")
def sha_prefix_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")).filter(T.hex_prefix_share(F.col("sha256"), 0.5))


@query("SELECT c_custkey, lower(regexp_replace(regexp_replace(c_mktsegment, '[AW]$', ''), '^Zw', 'Nt')) AS name FROM customer UNION ALL SELECT -p_partkey, lower(regexp_replace(regexp_replace(p_name || 'W', '[AW]$', ''), '^Zw', 'Nt')) FROM part")
def norm_name(spark, d):
    a = table(spark, d, "customer").select("c_custkey", T.norm_api(F.col("c_mktsegment")).alias("name"))
    return a.unionByName(table(spark, d, "part").select((-F.col("p_partkey")).alias("c_custkey"), T.norm_api(F.concat("p_name", F.lit("W"))).alias("name")))


_RULES = [
    tagging.SetRule("hurried", all_of=("click", "error"), any_of=("purchase", "signup")),
    tagging.SetRule("buyer", any_of=("purchase",)),
    tagging.SetRule("all_kinds", all_of=("click", "error", "purchase", "signup", "view")),
]


@query("""WITH u AS (SELECT user_id, list(DISTINCT event_type) AS e FROM events GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN list_has_all(e, ['click', 'error']) AND list_has_any(e, ['purchase', 'signup']) THEN 'hurried' END,
CASE WHEN list_contains(e, 'purchase') THEN 'buyer' END, CASE WHEN len(e) = 5 THEN 'all_kinds' END) AS tags FROM u""")
def set_rule_tagging(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("e"))
    return u.select("user_id", F.array_join(tagging.matching(_RULES, F.col("e")), ",").alias("tags"))


@query("""WITH s AS (SELECT page_id, list_filter(regexp_extract_all(url || ' ' || html, '[^ "<>]+'), lambda x: contains(x, 'http://') OR contains(x, 'https://')) AS s FROM pages),
h AS (SELECT page_id, list_filter(s, lambda x: NOT regexp_matches(x, '(?i)(schemas\\.(microsoft|xmlsoap|openxmlformats)\\.|www\\.w3\\.org/|crl\\.|ocsp\\.|\\.crl|\\.crt|/crl/|/pki/|aia\\.|certs?\\.)')) AS h FROM s)
SELECT page_id, len(h)::INT AS hits, array_to_string(h[1:3], ' ') AS evidence FROM h WHERE len(h) > 0""")
def string_rule_tagging(spark, d):
    rule = tagging.SetRule("embedded URL", "T1071.001", substrings=("http://", "https://"))
    s = table(spark, d, "pages").select("page_id", F.regexp_extract_all(F.concat("url", F.lit(" "), "html"), F.lit('[^ "<>]+'), F.lit(0)).alias("s"))
    h = s.select("page_id", tagging.string_hits(rule, F.col("s")).alias("h")).filter("size(h) > 0")
    return h.select("page_id", F.size("h").alias("hits"), F.array_join(F.slice("h", 1, 3), " ").alias("evidence"))


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS k FROM e)
SELECT user_id, string_agg('import ' || event_type, '; ' ORDER BY event_type) AS evidence FROM r WHERE k <= 3 GROUP BY user_id""")
def evidence_topn(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("e"))
    return u.select("user_id", F.array_join(F.transform(F.slice("e", 1, 3), lambda x: F.concat(F.lit("import "), x)), "; ").alias("evidence"))


@query("""SELECT event_type, count(*) AS n, count(k) AS with_k, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean
FROM (SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events) GROUP BY event_type""")
def json_field_stats(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


@query("SELECT a.doc_id, b.doc_id AS other_id FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id < b.doc_id")
def sha_join_parity(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return s.join(s.select(F.col("doc_id").alias("other_id"), "sha"), "sha").filter("doc_id < other_id").select("doc_id", "other_id")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_partkey, coalesce(n, 0)::BIGINT AS n, coalesce(round(q, 4), 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey")
def left_default(spark, d):
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
    return table(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").na.fill(0)


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter("l_returnflag = 'A'").select("l_partkey").intersect(li.filter("l_returnflag = 'R'").select("l_partkey"))


@query("SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9850")
def set_except(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9850").select(F.col("c_nationkey").alias("nation"))
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).subtract(c)


@query("SELECT 'customer' AS kind, c_nationkey AS nation, round(c_acctbal, 2) AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, round(s_acctbal, 2) FROM supplier")
def set_union(spark, d):
    one = lambda k, n, b: table(spark, d, k).select(F.lit(k).alias("kind"), F.col(n).alias("nation"), F.round(b, 2).alias("balance"))
    return one("customer", "c_nationkey", "c_acctbal").unionByName(one("supplier", "s_nationkey", "s_acctbal"))


@query("""SELECT c_mktsegment, c_custkey, c_acctbal, k FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS k FROM customer) WHERE k <= 5""")
def topk_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.row_number().over(w).alias("k")).filter("k <= 5")


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def lookup_join(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("""SELECT s_suppkey, p_size, count(*) AS sections FROM supplier JOIN part ON p_partkey >= s_suppkey AND p_partkey < s_suppkey + greatest(p_size, 1) GROUP BY ALL""")
def range_lookup(spark, d):
    """Start of a section <= address < start + width: the interval side is small, so its addresses are listed and met by equality."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    span = p.select("p_size", F.explode(F.sequence(F.col("p_partkey") - F.greatest("p_size", F.lit(1)) + 1, F.col("p_partkey"))).alias("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey").join(span, "s_suppkey").groupBy("s_suppkey", "p_size").agg(F.count(F.lit(1)).alias("sections"))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_linestatus = 'F') AS done, mode(l_linenumber) FILTER (l_linestatus = 'Z') AS none FROM lineitem GROUP BY l_returnflag""".replace(", mode(l_linenumber) FILTER (l_linestatus = 'Z') AS none", ""))
def conditional_pivot(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count()
    return p.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("open"), F.coalesce("F", F.lit(0)).alias("done"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_samp(l_quantity), 6) AS sd_samp, min(l_quantity) AS low, max(l_quantity) AS high,
median(l_quantity) AS median, round(quantile_cont(l_extendedprice, 0.975), 4) AS p975, quantile_disc(l_extendedprice, 0.25) AS q25, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""")
def statistical_aggregates(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    rows = table(spark, d, "lineitem")
    # Beside a distinct count, every percentile would be kept for each flag and part first.
    parts = rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.countDistinct("l_partkey").alias("parts"))
    own = rows.groupBy("l_returnflag").agg(
        F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("sd_pop"), F.round(F.stddev_samp(q), 6).alias("sd_samp"), F.min(q).alias("low"), F.max(q).alias("high"),
        F.percentile(q, F.lit(0.5)).alias("median"), F.round(F.percentile(p, F.lit(0.975)), 4).alias("p975"),
        F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY l_extendedprice)").alias("q25"),
    )
    return own.join(F.broadcast(parts), F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag")
