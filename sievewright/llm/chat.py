"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant: the speaker's
messages are what a model learns (the mask), all others' come as users with their names. System messages stay system messages.

A dialogue is one rendering however long it is. It comes in rows (``part``, ascending) of up to ``PART`` messages and about ``PART_CHARS`` characters (one message at least):
usual dialogues have one, a longer rendering is its parts one after the other, and mask offsets run through all of them. Places come from running sums, so no array is walked twice. A conversation with
more than a ``HOT``-th of all messages is dealt by ranges of its order and its ranges' sums are added up first, so it spreads over many tasks.

A marker can't be forged: in texts and names ``<``, any backslashes and ``|`` get one backslash more (``<|`` becomes ``<\\|``), which taking
one away undoes; in names ``|>`` and line ends are escaped too.

Defined results: a null role is the participant ``unknown``; null text is empty; null turns come first; messages of equal
turn are ordered by role, then text; repeated rows are one message; rows without ``conv_id`` form one conversation (null). A
conversation of system messages alone has no participant and gives no row. Other columns are not read; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Messages and characters of one row, at most.
PART, PART_CHARS = 20_000, 10_000_000
#: A conversation with more than this part of all messages (and more than ``PART``) is hot; there can be no more than so many.
HOT = 1_000
SYSTEM = "system"
_SYSTEM_HEAD, _OWN_HEAD, _TAIL = "<|system|>\n", "<|assistant|>\n", "<|end|>\n"
_ORDER = ["turn", "role", "text"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _user_head(role: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(escaped(role), "\n", r"\\n"), r"\|(\\*)>", r"|\\$1>")
    return F.concat(F.lit("<|user name="), name, F.lit("|>\n"))


def _placed(rows: DataFrame, within: list[str]) -> DataFrame:
    """Distinct messages with what comes before each inside ``within``: messages (``rank``), characters (``at``) and messages of the same role (``nth``)."""
    order, before = Window.partitionBy(*within).orderBy(*_ORDER), (Window.unboundedPreceding, -1)
    again = F.coalesce(F.lag(F.struct(*_ORDER)).over(order) == F.struct(*_ORDER), F.lit(False))
    rows = rows.withColumn("again", again).filter("NOT again").drop("again")
    running = {"rank": (order, F.lit(1)), "at": (order, F.col("size")), "nth": (Window.partitionBy(*within, "role").orderBy(*_ORDER), F.lit(1))}
    return rows.withColumns({k: F.coalesce(F.sum(v).over(w.rowsBetween(*before)), F.lit(0)).cast("long") for k, (w, v) in running.items()})


def _hot_placed(rows: DataFrame) -> DataFrame:
    """The same for hot conversations: by ranges of their order, with the sums of earlier ranges added."""
    ranged = rows.repartitionByRange("key", *_ORDER).withColumn("range", F.spark_partition_id())
    t = cut(_placed(cut(ranged), ["key", "range"]))
    earlier = lambda *by: Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = t.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    whole = whole.select("key", "range", *(F.coalesce(F.sum(v).over(earlier("key")), F.lit(0)).alias(f"more_{v}") for v in "ns"))
    own = t.groupBy("key", "role", "range").agg(F.count(F.lit(1)).alias("r")).select("key", "role", "range", F.coalesce(F.sum("r").over(earlier("key", "role")), F.lit(0)).alias("more_r"))
    t = t.join(whole, ["key", "range"]).join(own, ["key", "role", "range"])
    return t.withColumn("rank", F.col("rank") + F.col("more_n")).withColumn("at", F.col("at") + F.col("more_s")).withColumn("nth", F.col("nth") + F.col("more_r"))


def perspectives(turns: DataFrame, part: int = PART, hot: int = HOT, chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, speaker, n_messages, n_own, rendered, mask (array of [start, end) in characters of the whole rendering), masked_chars."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    t = turns.select("conv_id", key.alias("key"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counts = t.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    bound = F.greatest(F.lit(part), counts.agg(F.sum("n")).scalar() / hot)
    large = F.broadcast(counts.filter(F.col("n") > bound).select("key", F.lit(True).alias("large")))
    as_user = F.when(F.col("role") == SYSTEM, F.lit(_SYSTEM_HEAD)).otherwise(_user_head(F.col("role")))
    said = F.concat(escaped(F.col("text")), F.lit(_TAIL))
    t = t.withColumns({"head": as_user, "said": said}).withColumn("size", F.length("head") + F.length("said")).join(large, "key", "left")
    columns = ["key", "conv_id", "role", "head", "said", "rank", "at", "nth"]
    usual = _placed(t.filter("large IS NULL").drop("large"), ["key"]).select(*columns)
    placed = usual.unionByName(_hot_placed(t.filter("large").drop("large")).select(*columns)) if not large.isEmpty() else usual
    message = F.struct("rank", "role", "head", "said", "at", "nth")
    parts = placed.groupBy("key", "conv_id", (F.floor(F.col("rank") / part) + F.floor(F.col("at") / chars)).alias("part")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    speakers = t.filter(F.col("role") != SYSTEM).select("key", F.col("role").alias("speaker")).distinct()
    # A conversation's parts are apart from each other before they meet its speakers.
    r = parts.join(parts.select("key", "part").join(speakers, "key"), ["key", "part"])
    own = F.filter("messages", lambda m: m["role"] == F.col("speaker"))
    # Each of the speaker's own earlier messages has its head replaced, by one that is so much longer or shorter.
    shift = F.lit(len(_OWN_HEAD)) - F.length(_user_head(F.col("speaker")))
    start = lambda m: m["at"] + m["nth"] * shift + len(_OWN_HEAD)
    r = r.withColumn("mask", F.transform(own, lambda m: F.struct(start(m).alias("start"), (start(m) + F.length(m["said"]) - 1).alias("end"))))
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(F.when(m["role"] == F.col("speaker"), F.lit(_OWN_HEAD)).otherwise(m["head"]), m["said"])), "")
    return r.select(
        "conv_id", "part", "speaker", F.size("messages").cast("long").alias("n_messages"), F.size("mask").cast("long").alias("n_own"), rendered.alias("rendered"), "mask",
        F.aggregate("mask", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("masked_chars"),
    )


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumn("mask", mask)


OP6_SQL = rf"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw FROM conversations),
x AS (SELECT *, regexp_replace(raw, '<(\\*)\|', '<\\\1|', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw) - 1 AS rank,
             '<|user name=' || regexp_replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '\n'), '\|(\\*)>', '|\\\1>', 'g') || '|>' AS named FROM t),
y AS (SELECT *, coalesce(sum(CASE WHEN role = '{SYSTEM}' THEN 10 ELSE length(named) END + 1 + length(text) + 8) OVER (PARTITION BY conv_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
p AS (SELECT x.*, speaker, rank // {PART} + before // {PART_CHARS} AS part, CASE WHEN role = '{SYSTEM}' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE named END || chr(10) || text || '<|end|>' || chr(10) AS piece
      FROM y AS x JOIN s ON x.conv_id IS NOT DISTINCT FROM s.conv_id),
e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY rank ROWS UNBOUNDED PRECEDING) AS stop FROM p)
SELECT conv_id, part::BIGINT AS part, speaker, count(*) AS n_messages, count(*) FILTER (role = speaker) AS n_own,
       string_agg(piece, '' ORDER BY rank) AS rendered,
       coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || (stop - 1)::BIGINT, ',' ORDER BY rank) FILTER (role = speaker), '') AS mask,
       coalesce(sum(length(text) + 7) FILTER (role = speaker), 0)::BIGINT AS masked_chars
FROM e GROUP BY conv_id, part, speaker
"""
