"""MinHash near-dedup with an LSH forest.

Documents with the same set of shingles form a class. Each class has 64 minimum hashes; each of 16 trees sorts all
classes by its own run of them (four of its own, then four of the next tree's). Neighbours in an order whose common
prefix is at least MIN_DEPTH long are candidates, and since only the nearest NEIGHBOURS count, the depth adapts: where
many classes share a prefix, it is the ones with longer common prefixes that stand next to each other. Orders are range
partitioned with the id as last key, so any number of equal signatures spreads over tasks; pairs over a partition's
border come from the partitions' ends.

Where over NEIGHBOURS + 1 classes share the first MIN_DEPTH hashes of a tree, neighbours aren't all. The classes of such
buckets that still hold several components are looked at exactly. First a prefix filter over all of them: a set goes
under those of its rarest shingles of which two similar sets must share one, and what meets no other component under any
leaves, so texts around one template that differ in the rest are never compared. Of what stays in a bucket, the members
that aren't yet in its largest component are compared with all, in blocks of CHUNK by CHUNK sets that lie in different
tasks; a block gives at most one link for each component it joins, so no list of pairs is made.

Recall: a pair at similarity 0.85 shares four given hashes with probability 0.52, so all 16 trees miss it with
probability 7e-6, before neighbours of neighbours; at 0.8, the pipeline's threshold, with 0.41 and 2e-4. The tests
compare with brute force.

Defined cases: null and empty texts have no shingles and are linked with nothing; rows with equal doc_id are one
document, and equal rows stay or go together; a null doc_id belongs to the class of its text, but never names a component (a class without any id has a
null component_id and its rows are kept); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as c
from lodestone.llm.components import forest

SHINGLE = 5
TREES, OWN, DEEP = 16, 4, 8
MIN_DEPTH = 4
NEIGHBOURS = 3
#: Sets on either side of a block of a crowded bucket.
CHUNK = 512
#: op10 links at THRESHOLD percent and above.
THRESHOLD = 85
_LOWER = c.BYTE_CODE.copy()
_LOWER[65:91] = c.BYTE_CODE[97:123]
_A = np.random.default_rng(7).integers(0, 2**63, TREES * OWN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    data, off = c.utf8(column)
    for i, j in c.cuts(off, 2 << 20):
        words, first = c.words_of(data[off[i] : off[j]], off[i : j + 1] - off[i], code=_LOWER)
        rolled = c.rolling(words, SHINGLE)
        for s, e in zip(first.tolist(), first[1:].tolist(), strict=False):
            if e - s >= SHINGLE:
                yield np.unique(rolled[s : e - SHINGLE + 1])
            else:
                yield c.rolling(words[s:e], e - s) if e > s else np.zeros(0, np.uint64)


def minhash(shingles: np.ndarray) -> bytes:
    low = np.full(len(_A), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(low, np.multiply.outer(_A, shingles[i : i + 4096]).min(1), out=low)
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, names, signs = [], [], []
        for u in shingle_sets(b.column(1)):
            sizes.append(len(u))
            names.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
            signs.append(minhash(u) if len(u) else None)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "at", "n_shingles", "name", "sign"])
        c.trim()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, at (the row's key), n_shingles, name (of the shingle set) and sign of every row."""
    return docs.select("doc_id", "text", c.row_key().alias("at")).mapInArrow(_sign, "doc_id long, at long, n_shingles long, name binary, sign binary")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a sorted partition; and, with the border's number, the first and last rows."""
    part, tail, head = TaskContext.get().partitionId(), None, None
    names = ["border", "tree", "key", "a", "b"]
    for b in batches:
        tree, key, rep = b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), "S32"), b.column(2).to_numpy()
        if tail is not None:
            tree, key, rep = (np.concatenate(x) for x in zip(tail, (tree, key, rep), strict=True))
        if head is None or len(head[0]) < NEIGHBOURS:
            head = tree[:NEIGHBOURS], key[:NEIGHBOURS], rep[:NEIGHBOURS]
        one, two = _near(tree, key, rep, 0 if tail is None else len(tail[0]))
        tail = tree[-NEIGHBOURS:], key[-NEIGHBOURS:], rep[-NEIGHBOURS:]
        none = pa.nulls(len(one), pa.int32())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(one), pa.binary()), pa.array(one), pa.array(two)], names)
    if tail is not None:
        for border, (tree, key, rep) in ((part - 1, head), (part, tail)):
            yield pa.RecordBatch.from_arrays([pa.array([border] * len(tree), pa.int32()), pa.array(tree), pa.array([k.ljust(32, b"\0") for k in key.tolist()], pa.binary()), pa.array(rep), pa.nulls(len(rep), pa.int64())], names)


def _near(tree: np.ndarray, key: np.ndarray, rep: np.ndarray, new: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller, larger) of rows at most NEIGHBOURS apart with a common prefix of MIN_DEPTH; the later one new."""
    front = np.frombuffer(key.tobytes(), np.uint8).reshape(-1, 32)[:, : 4 * MIN_DEPTH]
    one, two = [], []
    for d in range(1, NEIGHBOURS + 1):
        same = (tree[d:] == tree[:-d]) & (front[d:] == front[:-d]).all(1) & (rep[d:] != rep[:-d])
        same[: max(0, new - d)] = False
        at = np.flatnonzero(same)
        one.append(np.minimum(rep[at], rep[at + d]))
        two.append(np.maximum(rep[at], rep[at + d]))
    return np.concatenate(one), np.concatenate(two)


def _over_border(t: pa.Table) -> pa.Table:
    t = t.sort_by([("tree", "ascending"), ("key", "ascending"), ("a", "ascending")])
    one, two = _near(t["tree"].to_numpy(), np.frombuffer(b"".join(t["key"].to_pylist()), "S32"), t["a"].to_numpy())
    return pa.table({"a": one, "b": two})


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b) of classes (rep, sign) that are neighbours in some tree."""
    twice = F.concat("sign", "sign")
    rows = classes.select("rep", twice.alias("s")).select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "rep", "s")
    rows = rows.select("tree", F.expr(f"substring(s, tree * {4 * OWN} + 1, {4 * DEEP})").alias("key"), "rep")
    found = ordered(rows).mapInArrow(_neighbours, "border int, tree int, key binary, a long, b long")
    found = c.stored(found)
    over = found.where("border is not null").groupBy("border").applyInArrow(_over_border, "a long, b long")
    return found.where("border is null").select("a", "b").unionAll(over).distinct()


def ordered(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")


def _confirm(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            p = b.slice(i, 512)
            ok = []
            for x, y in zip(shingle_sets(p.column(2)), shingle_sets(p.column(3)), strict=True):
                both = np.concatenate([x, y])
                both.sort()
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(n > 0 and 100 * n >= threshold * (len(both) - n))
            yield p.select([0, 1]).filter(pa.array(ok))
        c.trim()


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _confirm(it, threshold), "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = list(shingle_sets(b.column(1)))
        off = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["rep", "body"])
        c.trim()


def _common(one: list[np.ndarray], two: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of one with all of two: products of 0/1 matrices, some shingles at a time."""
    both = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)), assume_unique=True)
    at = [[(k, np.searchsorted(both, u[np.isin(u, both, assume_unique=True)])) for k, u in enumerate(side)] for side in (one, two)]
    out = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, len(both), width):
        m = []
        for side, n in zip(at, (len(one), len(two)), strict=True):
            x = np.zeros((n, width), np.float32)
            for k, p in side:
                x[k, p[(p >= lo) & (p < lo + width)] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _compare(t: pa.Table, threshold: int) -> pa.Table:
    """Links (a, b) between the components of a block's sets that the links before them in the block don't give already."""
    side, comp = t["side"].to_numpy(), t["comp"].to_numpy()
    sets = [np.sort(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) for x in t["body"]]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found: list[tuple[int, int]] = []
    if len(one) and len(two):
        n = _common([sets[i] for i in one], [sets[i] for i in two])
        size = np.array([len(x) for x in sets])
        ok = (100 * n >= threshold * (size[one][:, None] + size[two][None, :] - n)) & (n > 0) & (comp[one][:, None] != comp[two][None, :])
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        i, j = np.nonzero(ok)
        for x, y in np.unique(np.stack([comp[one[i]], comp[two[j]]], 1), axis=0).tolist():
            a, b = sorted((find(x), find(y)))
            if a != b:
                root[b] = a
                found.append((x, y))
    return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})


def prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(bucket, rep) of sets (rep, body): a set of n shingles under the n - m + 1 rarest of them that any other set has, m
    being the least that two sets at the threshold share. Such sets have a bucket in common."""
    n = c.stored(sets.select(F.explode("body").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
    shared = sets.select("rep", F.size("body").alias("size"), F.explode("body").alias("s")).join(c.few(n), "s")
    one = shared.groupBy("rep").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "s"))).alias("all"))
    most = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") / 100).cast("int") + 1  # those that only this set has come first
    some = F.slice("all", 1, F.greatest(F.lit(0), most - (F.col("size") - F.size("all"))))
    return one.select("rep", F.explode(some).alias("x")).select(F.col("x.s").alias("bucket"), "rep")


def _mixed(held: DataFrame) -> DataFrame:
    """The buckets of held (bucket, rep, comp) with more than one component: how many reps, in the largest component, and
    which that is."""
    by = held.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("major"))
    return by.where("n > most")


def crowded(classes: DataFrame, comps: DataFrame, bodies: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between components (comps: rep, comp), found among the classes of all crowded buckets in which more
    than one component is left."""
    seats = classes.select("rep", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("rep", F.xxhash64("tree", F.expr(f"substring(sign, tree * {4 * OWN} + 1, {4 * MIN_DEPTH})")).alias("bucket"))
    many = c.stored(seats.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > NEIGHBOURS + 1).select("bucket"))
    held = c.stored(seats.join(c.few(many), "bucket").join(comps, "rep").select("bucket", "rep", "comp"))
    held = c.stored(held.join(_mixed(held).select("bucket"), "bucket", "left_semi"))
    sets = c.stored(bodies.join(held.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets, "rep long, body array<long>"))
    under = c.stored(prefixes(sets, threshold).join(comps, "rep").select("bucket", "rep", "comp"))
    able = under.join(_mixed(under).select("bucket"), "bucket", "left_semi").select("rep").distinct()
    held = c.stored(held.join(able, "rep", "left_semi"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    live = c.stored(_mixed(held).select("bucket", "major", chunks(F.col("n") - F.col("most")).alias("na"), chunks(F.col("n")).alias("nb")))
    held = c.stored(held.join(live, "bucket"))
    deal = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = held.where("comp <> major").select("bucket", deal(F.col("na")).alias("ca"), each("nb").alias("cb"), F.lit(0).alias("side"), "rep", "comp")
    two = held.select("bucket", each("na").alias("ca"), deal(F.col("nb")).alias("cb"), F.lit(1).alias("side"), "rep", "comp")
    return one.unionAll(two).join(sets, "rep").groupBy("bucket", "ca", "cb").applyInArrow(c.tidy(lambda t: _compare(t, threshold)), "a long, b long")


def components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, at, n_shingles, component_id and kept of every row of docs (doc_id, text); linked at threshold percent and above."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = c.stored(signatures(docs))
    classes = c.stored(signed.where("name is not null and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("sign").alias("sign")))
    pairs = c.stored(candidates(classes))
    wanted = c.stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    bodies = c.stored(docs.join(c.few(wanted), "doc_id", "left_semi"))
    _, tree = forest(pairs)
    labels, _ = forest(confirmed(tree, bodies, threshold))
    la, lb = (labels.select(F.col("v").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    apart = pairs.join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")).where("la <> lb")
    tried = tree.withColumn("tried", F.lit(True))
    apart = c.stored(apart.join(tried, ["a", "b"], "left_anti"))
    late = c.stored(confirmed(apart.select("a", "b"), bodies, threshold).join(apart, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
    reps = classes.select("name", "rep").join(labels, classes.rep == labels.v, "left").select("name", "rep", F.coalesce("label", "rep").alias("label"))
    if not late.isEmpty():
        again, _ = forest(late)
        reps = reps.join(again, reps.label == again.v, "left").select("name", "rep", F.coalesce(again.label, reps.label).alias("label"))
    reps = c.stored(reps)
    rest = c.stored(crowded(classes, reps.select("rep", F.col("label").alias("comp")), bodies, threshold).distinct())
    if not rest.isEmpty():
        last, _ = forest(rest)
        reps = reps.join(last, reps.label == last.v, "left").select("name", F.coalesce(last.label, reps.label).alias("label"))
    reps = reps.select("name", "label")
    out = signed.join(reps, "name", "left")
    named = F.coalesce("label", "doc_id")
    return out.select("doc_id", "at", "n_shingles", named.alias("component_id"), F.coalesce(F.col("doc_id") == named, named.isNull()).alias("kept"))


def keep(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, every column kept, of which each component keeps one."""
    return c.without(docs, components(docs, threshold).where("not kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(c.table(spark, sf_dir, "documents"), THRESHOLD).drop("at")
