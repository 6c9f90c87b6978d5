"""MinHash near-duplicates by an inverted join over signature coordinates.

1. One pass over the texts makes each document's set of shingle hashes, a digest of the set, ``coords`` minima, and ``PLANES`` bits of
   every minimum. Documents with equal sets become one class, so a group of exact copies is one node from here on.
2. A class is posted under each pair (coordinate, value). Values posted once link nothing. Two classes of similarity ``threshold``
   agree in ``need`` coordinates but for odds of 0.8 in a million at the defaults (exact binomial tail, ``MISS`` at most), so a class with fewer
   shared values is taken to have no partner, and of two linked classes the ``shared - need + 1`` rarest shared values (the prefix) of each meet.
3. A posting list of a prefix links its members to its smallest one, the head: a list of n makes n - 1 candidates. Collisions are counted on
   the planes inside the join (unequal minima pass for equal once in ``2 ** PLANES``: a candidate more, never one less), and only pairs that
   reach ``need`` leave it. Lists of hot values are cut into sublists, whose heads meet the value's head.
4. Candidates tie members into cohorts. Members of a list outside its head's cohort are counted against the list's members of other cohorts,
   again inside the join, and only pairs of cohorts leave it. So two linked documents are in one cohort. This step compares
   all pairs of such members: prefixes keep those lists short, but nothing bounds them.
5. Only now full sets are made, for members of cohorts of two or more. Each member's best candidate is confirmed. Where confirmed links leave a
   cohort in several parts, the members outside the largest part meet all members block by block: a block's intersections are exact
   matrix products, and only a link that joins two parts leaves it. Of n members n' outside make n n' / BLOCK block rows.

All confirmations count whole 64-bit hashes. Defined results: null or wordless texts have no shingles, link with
nothing and stay; rows without ``doc_id`` are not linked and stay (component null); rows that share ``doc_id`` and text share
their outcome. Other columns are not read; tables without rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, as_bytes, blocks, cut, discard, given_back, likely_rows, meet, packed, passing, row_name, rows_without, table, unpacked
from .components import components, roots
from .hashing import Block, mix

COORDS = 48
#: Odds of missing a pair at the threshold, at most.
MISS = 1e-6
#: Bits of each coordinate that posting lists carry.
PLANES = 3
#: Members of a posting list, or of the group of one candidate, from which on it may be cut into sublists.
LIST = 1_000
#: Members of one block, and hashes of their sets, about, when the members of a cohort meet.
BLOCK, BLOCK_HASHES = 500, 1_000_000


def required_matches(coords: int, threshold: float, miss: float = MISS) -> int:
    """The most equal coordinates that a pair at the threshold has but for odds of ``miss`` (exact binomial tail)."""
    tail, need = 0.0, 0
    while need < coords:
        tail += math.comb(coords, need) * threshold**need * (1 - threshold) ** (coords - need)
        if tail > miss:
            break
        need += 1
    return max(1, need)


def _salts(coords: int) -> np.ndarray:
    return np.random.default_rng(97).integers(1, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Per salt the smallest upper half of hash times salt (as int32), for a set that isn't empty."""
    low = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, (hashes[at : at + 4096, None] * salts).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def planes(sig: np.ndarray) -> list[int]:
    """The lowest ``PLANES`` bits of a signature, one integer a bit (62 coordinates at most)."""
    return [int((((sig >> k) & 1).astype(np.int64) << np.arange(len(sig))).sum()) for k in range(PLANES)]


def signatures(docs: DataFrame, width: int, lower: bool, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null without words), sig and planes."""
    salts = _salts(coords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = Block(as_bytes(batch), lower).shingle_sets(width)
            sizes = [len(s) for s in sets]
            keys = [set_key(s) for s in sets]
            sigs = [None if not len(s) else signature(s, salts) for s in sets]
            bits = [None if s is None else planes(s) for s in sigs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sig", "planes"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(given_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key binary, sig array<int>, planes array<long>")


def set_key(hashes: np.ndarray) -> bytes | None:
    """128-bit digest of a set; None for the empty one."""
    return np.array([np.bitwise_xor.reduce(mix(hashes)), np.add.reduce(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))]).tobytes() if len(hashes) else None


def as_set(data: pa.Scalar) -> np.ndarray:
    """Sorted distinct hashes from their bytes."""
    return np.frombuffer(data.as_buffer(), np.uint64)


def _sets(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """rid, best and the set's hashes, for rows (rid, best, set_key, text) whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = Block(as_bytes(batch), lower).shingle_sets(width)
            mine = [k for k, (s, want) in enumerate(zip(sets, batch.column("set_key").to_pylist(), strict=True)) if set_key(s) == want]
            take = pa.array(mine, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(take), batch.column("best").take(take), pa.array([sets[k].tobytes() for k in mine], pa.binary())], ["rid", "best", "hashes"])

    return docs.select("rid", "best", "set_key", F.col("text").cast("binary").alias("text")).mapInArrow(given_back(run), "rid long, best long, hashes binary")


def linked(both, na, nb, percent: int):
    """Whether sets of these sizes and intersection are similar enough."""
    return 100 * both >= percent * (na + nb - both)


def _confirm(percent: int):
    """Candidates with full sets in, the links among them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            last, x = None, None
            for k, (ia, sa, sb) in enumerate(zip(batch.column("a").to_pylist(), batch.column("seta"), batch.column("setb"), strict=True)):
                if ia != last:
                    last, x = ia, as_set(sa)
                y = as_set(sb)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                if linked(int((x[at] == y).sum()), len(x), len(y), percent):
                    ok.append(k)
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact sizes of all intersections of two lists of sets, as products of slices of their incidence matrices.

    A hash that only one set has is in no intersection and gets no column.
    """
    _, place, times = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    column = np.cumsum(times > 1) - 1
    shared = times[place] > 1
    row, place = row[shared], column[place[shared]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int((times > 1).sum()), columns):
        low, high = np.searchsorted(place, [at, at + columns])
        m = np.zeros((len(a) + len(b), columns), np.float32)
        m[row[low:high], place[low:high] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def _settle(percent: int):
    """A block of members outside their cohort's main part against a block of all its members: pairs of parts that a link joins, a spanning forest of them."""

    def run(t: pa.Table) -> pa.Table:
        part, minor = (np.array(t.column(c).to_pylist()) for c in ("part", "minor"))
        sets = [as_set(x) for x in t.column("hashes").combine_chunks()]
        size = t.column("n").to_numpy()
        one, all_ = np.flatnonzero(minor), np.flatnonzero(~minor)
        links = ([], [])
        if len(one) and len(all_):
            both = intersections([sets[i] for i in one], [sets[j] for j in all_])
            ok = linked(both, size[one][:, None], size[all_], percent)
            names, code = np.unique(part, return_inverse=True)
            label = np.arange(len(names))
            for i, row in zip(one, ok, strict=True):
                met = np.unique(label[np.append(code[all_[row]], code[i])])
                if len(met) > 1:
                    links[0].extend([names[met[0]]] * (len(met) - 1))
                    links[1].extend(names[met[1:]])
                    label[np.isin(label, met)] = met[0]
        return pa.table({"u": pa.array(links[0], pa.int64()), "v": pa.array(links[1], pa.int64())})

    return run


def _similar(a: str, b: str, need: int, percent: int, coords: int) -> tuple[Column, Column]:
    """Collisions of two structs (n, planes), and whether these and the sizes allow a link."""
    differ = F.lit(0).cast("long")
    for k in range(PLANES):
        differ = differ.bitwiseOR(F.col(f"{a}.planes")[k].bitwiseXOR(F.col(f"{b}.planes")[k]))
    hits = F.lit(coords) - F.bit_count(differ)
    sizes = 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return hits, sizes & (hits >= need)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, lower: bool = True, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    with passing() as stay:
        signed = cut(signatures(docs, width, lower, coords))
        usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "planes")).alias("c"), F.count(F.lit(1)).alias("copies"))
        # Classes are numbered as they are written; ``least`` is the smallest id of a class's rows.
        classes = cut(classes.select("set_key", "copies", F.monotonically_increasing_id().alias("rid"), F.col("c.doc_id").alias("least"), F.col("c.n_shingles").alias("n"), "c.sig", "c.planes"))
        named = _components(docs, classes, width, round(100 * threshold), lower, coords, required_matches(coords, threshold))
        named = cut(classes.join(named, "rid", "left").select("set_key", "copies", "least", "part"))
        names = cut(named.filter("part IS NOT NULL").groupBy("part").agg(F.min("least").alias("found"), F.count(F.lit(1)).alias("many")))
        named = cut(meet(named, names, "part", "many", "left").select("set_key", "copies", F.coalesce("found", "least").alias("found")))
        stay += [signed, named]
    out = meet(signed.drop("sig", "planes"), named, "set_key", "copies", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components(docs: DataFrame, classes: DataFrame, width: int, percent: int, lower: bool, coords: int, need: int) -> DataFrame:
    """(rid, part) for classes with a candidate: the smallest rid of each linked group."""
    posts = coords * classes.count()
    posted = classes.select("rid", F.posexplode("sig")).select("rid", (F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))).alias("token"))
    counts = cut(posted.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    tokens = meet(posted, counts, "token", "many", total=posts).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("many", "token"))).alias("tokens")).filter(F.size("tokens") >= need)
    # A hot value's list is cut into sublists 1, 2, ...; others are sublist 0.
    bound = max(LIST, posts // HOT_KEYS)
    prefix = F.transform(
        F.slice("tokens", F.lit(1), F.size("tokens") - need + 1),
        lambda t: F.struct(t["token"].alias("token"), F.when(t["many"] > bound, 1 + F.pmod(F.xxhash64("rid"), F.ceil(t["many"] / bound))).otherwise(0).cast("int").alias("sub")),
    )
    listed = cut(tokens.select("rid", prefix.alias("prefix")).join(classes.select("rid", "n", "planes"), "rid"))
    discard(counts)

    def named_by(forest: DataFrame, name: str) -> DataFrame:
        r = roots(forest.toDF("parent", "node"))
        return cut(listed.select("rid").join(r.withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("root", "rid").alias(name)))

    def tied(groups: DataFrame, name: str, edges: DataFrame) -> DataFrame:
        """``groups`` (rid, name) with groups that ``edges`` between members' groups connect made one, by their smallest name."""
        merged = components(edges).toDF(name, "to")
        sizes = cut(groups.groupBy(name).agg(F.count(F.lit(1)).alias("of")).join(merged, name, "left"))
        return cut(meet(groups, sizes, name, "of", "left").select("rid", F.coalesce("to", name).alias(name)))

    def against_head(rows: DataFrame, *of: str) -> DataFrame:
        """Rows of posting lists with the head of theirs: one sort of a list, nothing collected."""
        return rows.withColumn("head", F.first(F.struct("rid", "n", "planes")).over(Window.partitionBy(*of).orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)))

    def candidates(rows: DataFrame) -> DataFrame:
        hits, ok = _similar("me", "head", need, percent, coords)
        return rows.filter("rid <> head.rid").withColumn("me", F.struct("n", "planes")).filter(ok).select(F.col("rid").alias("b"), hits.alias("hits"), F.col("head.rid").alias("a"))

    lists = listed.select("rid", "n", "planes", F.explode("prefix").alias("t")).select("rid", "n", "planes", "t.token", "t.sub")
    headed = against_head(lists, "token", "sub")
    subheads = against_head(headed.filter("sub > 0 AND rid = head.rid").drop("head"), "token")
    best = candidates(headed).unionByName(candidates(subheads)).groupBy("b").agg(F.max(F.struct("hits", (-F.col("a")).alias("less"))).alias("m"))
    best = cut(best.select((-F.col("m.less")).alias("a"), "b"))
    # A head is its list's smallest, so candidates and links are forests: each member has one parent, with a smaller id.
    cohorts = named_by(best, "cohort")

    # Members of a list outside its head's cohort meet the list's members of other cohorts.
    placed = cut(listed.join(cohorts, "rid"))
    across = _across(placed.select("rid", "cohort", F.struct("n", "planes").alias("me"), F.explode("prefix").alias("t")).select("rid", "cohort", "me", "t.token", "t.sub"), need, percent, coords)
    if not across.isEmpty():
        cohorts = tied(cohorts, "cohort", across)
    discard(placed)

    # Full sets of all members of cohorts of two or more. A doc_id may come in several rows; the text whose set is the class's is meant.
    grouped = cohorts.filter("rid <> cohort")
    members = cut(
        grouped.select("rid").union(grouped.select("cohort").distinct()).join(classes.select("rid", "n", "set_key", "least"), "rid").join(best.select(F.col("b").alias("rid"), F.col("a").alias("best")), "rid", "left")
    )
    texts = likely_rows(docs, "doc_id", members.select("least")).join(members.hint("merge"), F.col("doc_id") == F.col("least")).select("rid", "best", "set_key", "text").distinct()
    sets = cut(_sets(texts, width, lower))
    parts = named_by(_confirmed(sets, best, percent), "part")
    settled = cut(_settled(sets, parts, cohorts, members, percent))
    return parts if settled.isEmpty() else tied(parts, "part", settled)


def _across(placed: DataFrame, need: int, percent: int, coords: int) -> DataFrame:
    """Pairs (u, v) of cohorts with members that collide often enough in some posting list of ``placed`` (rid, cohort, me, token, sub)."""
    first = Window.partitionBy("token").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    cold = placed.filter("sub = 0").withColumn("main", F.first("cohort").over(first))
    # The cohort of a hot value's head; there are HOT_KEYS such values at most.
    hot = F.broadcast(placed.filter("sub > 0").groupBy("token").agg(F.min(F.struct("rid", "cohort")).alias("h"), F.max("sub").alias("subs")).select("token", "subs", F.col("h.cohort").alias("main")))
    warm = placed.filter("sub > 0").join(hot, "token")
    others = cold.select("*", F.lit(0).alias("subs")).unionByName(warm.select(cold.columns + ["subs"])).filter("cohort <> main")
    others = cut(others.select("token", F.explode(F.sequence(F.least("subs", F.lit(1)), "subs")).alias("sub"), F.col("rid").alias("a"), F.col("cohort").alias("ca"), "main", F.col("me").alias("x")))
    members = likely_rows(placed, "token", others.select("token").distinct()).select("token", "sub", F.col("rid").alias("b"), F.col("cohort").alias("cb"), F.col("me").alias("y"))
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    met = others.alias("o").join(members.alias("m"), (F.col("o.token") == F.col("m.token")) & (F.col("o.sub") == F.col("m.sub")) & apart & _similar("x", "y", need, percent, coords)[1])
    found = cut(met.select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct())
    discard(others)
    return found


def _confirmed(sets: DataFrame, best: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of ``best`` those that full sets confirm, as (u, v). A candidate of many is copied to several tasks."""
    centres = best.groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    bound = max(LIST, best.count() // HOT_KEYS)
    hot = F.broadcast(centres.filter(F.col("many") > bound).select("a", F.ceil(F.col("many") / bound).cast("int").alias("cuts")))
    b = sets.filter("best IS NOT NULL").select(F.col("best").alias("a"), F.col("rid").alias("b"), F.col("hashes").alias("setb")).join(hot, "a", "left")
    b = b.withColumn("cut", F.coalesce(F.pmod(F.xxhash64("b"), F.col("cuts")), F.lit(0)).cast("int")).drop("cuts")
    a = likely_rows(sets, "rid", centres.select("a")).select(F.col("rid").alias("a"), F.col("hashes").alias("seta")).join(hot, "a", "left")
    a = a.withColumn("cut", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("cuts") - 1, F.lit(0))))).drop("cuts")
    return cut(b.join(a.hint("merge"), ["a", "cut"]).select("a", "b", "seta", "setb").mapInArrow(given_back(_confirm(percent)), "a long, b long").toDF("u", "v"))


def _settled(sets: DataFrame, parts: DataFrame, cohorts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of parts of one cohort that a link joins: members outside a cohort's largest part meet all its members."""
    of = cut(members.select("rid", "n").join(parts, "rid").join(cohorts, "rid"))
    sizes = of.groupBy("cohort", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).groupBy("cohort").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.max(F.struct("c", "part", "n")).alias("m"), F.count(F.lit(1)).alias("several"))
    cuts = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / BLOCK_HASHES), F.lit(1))
    sizes = sizes.filter("several > 1").select("cohort", F.col("c").alias("many"), cuts(F.col("c"), F.col("n")).alias("blocks"), cuts(F.col("c") - F.col("m.c"), F.col("n") - F.col("m.n")).alias("minors"), F.col("m.part").alias("main"))
    open_ = cut(meet(of, cut(sizes), "cohort", "many"))
    full = likely_rows(sets.drop("best"), "rid", open_.select("rid")).join(open_.hint("merge"), "rid")
    at = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    member = full.select("cohort", spread("minors").alias("i"), at("blocks").alias("j"), F.lit(False).alias("minor"), "part", "n", "hashes")
    minor = full.filter("part <> main").select("cohort", at("minors").alias("i"), spread("blocks").alias("j"), F.lit(True).alias("minor"), "part", "n", "hashes")
    return member.unionByName(minor).groupBy("cohort", "i", "j").applyInArrow(_settle(percent), "u long, v long")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def near_stage(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies (five-word shingles, 0.8): of each component the row with the smallest id stays, null last.

    Rows are numbered by id and text, so null and repeated ids are rows like all others; exact repeats of a row share its outcome. Null and
    wordless texts stay. Any other columns, whatever their names, come through as they are; tables without rows give none.
    """
    number = row_name(F.col("doc_id"), F.col("text"))
    with passing() as stay:
        found = cut(near_duplicates(docs.select(number.alias("doc_id"), "text")).select(F.col("doc_id").alias("rid"), "component_id").distinct())
        # A component is named by a row of it, so its rows are those of another's name, and that one.
        others = found.filter("rid <> component_id")
        members = others.unionByName(others.groupBy("component_id").agg(F.first("component_id").alias("rid")))
        ids = likely_rows(docs.select("doc_id", number.alias("num")), "num", members.select("rid"))
        named = cut(members.join(ids.hint("merge"), F.col("rid") == F.col("num")).select("component_id", F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "rid").alias("m")))
        best = cut(named.groupBy("component_id").agg(F.min("m").alias("best"), F.count(F.lit(1)).alias("many")).select("component_id", F.col("best.rid").alias("stays"), "many"))
        gone = cut(meet(named, best, "component_id", "many").select(F.col("m.rid").alias("rid"), "stays").filter("rid <> stays").select("rid").distinct())
        stay.append(gone)
    return unpacked(rows_without(packed(docs, key=number), "key", gone))
