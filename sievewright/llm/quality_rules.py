"""Quality rules: hard limits on document statistics, then gradient-boosted trees over them.

Statistics come from whole texts in one vectorised pass and are written once. The trees are fitted to all
labelled rows by histograms, with the score falling in symbols, repeated words and repeated lines; the threshold comes from held-out folds; scoring walks flat node arrays.

Defined results: null or empty texts have all statistics 0 and fail the base rule (fewer than 50 words). Without labelled rows of
both classes the verdict is the base rule's alone. Labels without quality or document are left out; of repeated labels
of an id the largest counts. Rows repeat as they come in; other columns are not read; tables without rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import as_bytes, blocks, cut, digest, discard, given_back, packed, passing, rows_without, table, unpacked
from .hashing import Block, mix

#: Labelled rows up to which the driver adds up histograms itself, from ten bytes a row; of more rows Spark does.
AT_ONCE = 200_000
#: Bins of a feature.
BINS = 48
#: Share of labelled good documents whose score the threshold must not exceed.
KEEP_GOOD = 0.998
#: Folds in which rows are held out to choose the threshold.
FOLDS = 4
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_bytes", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct_words")
#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Features, and +1 or -1 where the score may only rise or fall with one.
FEATURES = {
    "symbols_a_word": -1, "repeated_share": -1, "repeated_lines_share": -1, "log_words": 1, "chars_a_word": 0, "upper_share": -1,
    "digit_share": 0, "stops_a_word": 0, "distinct_share": 0, "words_a_line": 0,
}


def _flags(values: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _STOP = _flags(SYMBOLS), _flags(range(65, 91)), _flags(range(48, 58)), _flags(b".!?")


def statistics(docs: list[bytes]) -> dict[str, np.ndarray]:
    """BASE and EXTRA of whole texts (UTF-8)."""
    b = Block(docs)
    h, at = b.windows(3)
    covered = np.zeros(len(b.hash), bool)
    if len(h):
        _, inverse, count = np.unique(mix(h + b.doc[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        for k in range(3):
            covered[again + k] = True
    lines, repeated = b.repeated_lines()
    distinct = np.unique(mix(b.hash + b.doc.astype(np.uint64)), return_index=True)[1]
    lead = (b.raw & 0xC0) != 0x80
    return {
        "n_words": b.n_words, "word_chars": b.per_doc_bytes(lead & ~b.space), "n_symbols": b.per_doc_bytes(_SYMBOL[b.raw]), "n_dup_lines": repeated, "n_repeat_words": b.per_doc(covered),
        "n_bytes": b.doc_end - b.doc_start, "n_lines": lines, "n_upper": b.per_doc_bytes(_UPPER[b.raw]), "n_digits": b.per_doc_bytes(_DIGIT[b.raw]), "n_stops": b.per_doc_bytes(_STOP[b.raw]),
        "n_distinct_words": np.bincount(b.doc[distinct], minlength=len(docs)),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_lines"))
    return np.stack([s["n_symbols"] / words, s["n_repeat_words"] / words, s["n_dup_lines"] / lines, np.log1p(s["n_words"]), s["word_chars"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_stops"] / words, s["n_distinct_words"] / words, s["n_words"] / lines], axis=1).astype(float)


def document_statistics(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and ``others`` with BASE and EXTRA for every row of ``docs`` (doc_id, text)."""
    kept = ["doc_id", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            s = statistics(as_bytes(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(s[c].astype(np.int64)) for c in BASE + EXTRA)], [*kept, *BASE, *EXTRA])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, F.col("text").cast("binary").alias("text")).mapInArrow(given_back(run), ", ".join([*kinds, *(f"{c} long" for c in BASE + EXTRA)]))


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """x (FEATURES), y and fold for each labelled id with a document; of rows that share an id the smallest counts."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = stats.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*BASE, *EXTRA)).alias("s"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in BASE + EXTRA})
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in x.T), batch.column("y"), batch.column("fold")], [*FEATURES, "y", "fold"])

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return rows.select("s.*", "y", fold.alias("fold")).mapInArrow(run, ", ".join([*(f"{c} double" for c in FEATURES), "y double", "fold int"]))


def fit_rules(stats: DataFrame, labels: DataFrame, at_once: int = AT_ONCE, keep_good: float = KEEP_GOOD) -> tuple[boosting.FlatTrees, float] | None:
    """Trees and the score that a document must reach, from all labelled rows; None without rows of both classes.

    Bins of up to ``at_once`` rows (ten bytes each) come to the driver; of more rows only histograms do, and the trees are the same.
    The threshold is a quantile of scores that rows get from trees which have not seen them (``FOLDS`` folds); the trees returned have seen all.
    """
    rows = cut(_labelled(stats, labels))
    quantile = F.array(*map(F.lit, boosting.shares(BINS)))
    found = rows.groupBy("fold").agg(F.count(F.lit(1)), F.sum("y")).collect()
    n, good = (np.array([sum(r[k] for r in found if r[0] == f) for f in range(FOLDS)]) for k in (1, 2))
    if not 0 < good.sum() < n.sum():
        return None
    cuts = [np.unique(x) for x in rows.agg(*(F.percentile_approx(c, quantile, F.lit(10_000)) for c in FEATURES)).first()]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = boosting.coded(np.stack([batch.column(c).to_numpy() for c in FEATURES], 1), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("y"), batch.column("fold")], ["bins", "y", "fold"])

    binned, monotone = rows.mapInArrow(code, "bins binary, y double, fold int"), np.array(list(FEATURES.values()))
    # A fold without which a class is missing gets its scores from the trees that have seen all.
    without = [k for k in range(FOLDS) if 0 < (good.sum() - good[k]) < n.sum() - n[k]]
    seen = [(good.sum(), n.sum()), *((good.sum() - good[k], n.sum() - n[k]) if k in without else (good.sum(), n.sum()) for k in range(FOLDS))]
    models = [boosting.Growing(cuts, monotone, float(a / b)) for a, b in seen]
    place = int((1 - keep_good) * (int(good.sum()) - 1))
    if n.sum() <= at_once:
        t = binned.toArrow()
        x, y, fold = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(t.num_rows, -1), t.column("y").to_numpy(), t.column("fold").to_numpy()
        boosting.boost(models, boosting.Rows(x, y, fold, models, BINS))
    else:
        boosting.boost(models, passes := boosting.Passes(cut(binned.repartition(math.ceil(int(n.sum()) / boosting.CHUNK))), models, BINS))
    trees = [m.flat(coded=True) for m in models]
    blind = {k: trees[k + 1] if k in without else trees[0] for k in range(FOLDS)}

    def unseen(x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in range(FOLDS):
            out[fold == k] = blind[k].probability(x[fold == k])
        return out

    if n.sum() <= at_once:
        score = float(np.sort(unseen(x[y == 1], fold[y == 1]))[place])
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(unseen(x, batch.column("fold").to_numpy()))], ["score"])

        scores = cut(passes.rows.filter("y = 1").mapInArrow(given_back(run), "score double"))
        score = boosting.kth(scores, "score", place)
        discard(scores, passes.rows)
    discard(rows)
    return models[0].flat(), min(0.5, score)


def quality_rules(docs: DataFrame, labels: DataFrame, at_once: int = AT_ONCE, keep_good: float = KEEP_GOOD, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``others``, BASE, base_failed, score and kept for every row of ``docs``."""
    stats = cut(document_statistics(docs, *others))
    model = fit_rules(stats, labels, at_once, keep_good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in BASE + EXTRA})
            score = model[0].probability(x) if model else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *others, *BASE)), pa.array(score)], ["doc_id", *others, *BASE, "score"])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *others)]
    scored = stats.mapInArrow(given_back(run), ", ".join([*kinds, *(f"{c} long" for c in BASE), "score double"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    threshold = model[1] if model else 0.0
    return scored.select("doc_id", *others, *BASE, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def rules_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep. The verdict follows from the text alone, so texts are dropped by their digest, whatever the id.

    Null and empty texts go; repeated rows share their verdict. Other columns come through whatever their names; tables without rows give none.
    """
    key = digest(F.col("text"))
    with passing() as stay:
        judged = quality_rules(docs.select("doc_id", "text", key.alias("digest")), labels, others=("digest",))
        gone = cut(judged.filter("NOT kept").select("digest").distinct())
        stay.append(gone)
    return unpacked(rows_without(packed(docs, key=key), "key", gone))
