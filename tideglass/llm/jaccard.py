"""Near copies by exact Jaccard: texts whose sets of 5-word shingles are alike by 0.8 or more.

SimHash at three bits reaches only almost equal texts, and no radius that a
multi-index can serve reaches a Jaccard of 0.8 (some ten bits of 64).  So
candidates come from MinHash, 48 bands of six values: a pair at 0.8 shares no
band with probability 5e-7.  Every candidate that decides anything is compared
shingle by shingle.  Equal sets collapse to one node before that.

Which candidates decide anything: first some bands' buckets are linked along
chains, in parts of ``SMALL`` nodes, so the members of a group of copies find
together.  Then only pairs of different groups are left.  In a bucket of SMALL
nodes or fewer they are all compared.  Larger buckets that share nodes make a cluster,
and its pairs come from a lossless join: let p be the shingles that over half
of a cluster's sets hold.  Of two sets x and y, at most min(|x&p|, |y&p|)
shingles of p are common, so a pair that reaches the bound either reaches it
within p, or shares one of the shingles outside p.  Of those, sorted by rarity
in the cluster, x need look up only as many as a partner may lack.  Sets that
hang together only through p, which make up a large group's pairs, are so
never met one by one.

Defined results: words are split at ASCII white space and A-Z are lower-cased;
fewer words than a shingle make one shingle; null, empty and white texts are
alike; of linked rows the one with the smallest doc_id (null last) stays; rows
equal in both doc_id and text count as one and share its result; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buckets, by_key, forget, held_tables, sliced, sweep, text_bytes, tidy, written
from .components import components
from .simhash import shingle_hashes

WORDS, LEAST = 5, 0.8
BANDS, DEPTH = 48, 6
#: Bands whose chains are tried before anything else, and the nodes of a bucket that are compared with each other.
FIRST, SMALL = 3, 64
#: Counts of shingles that a task holds before it hands them on.
COUNTED = 1 << 19

_RNG = np.random.default_rng(42)
_XOR, _ODD = (_RNG.integers(0, 2**64, (BANDS * DEPTH, 1), dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def bands(found: np.ndarray, block: int = 1024) -> list[int]:
    """One key for each band of the set's least values; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for at in range(0, len(found), block):
        np.minimum(least, ((found[None, at : at + block] ^ _XOR) * _ODD).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * DEPTH : (k + 1) * DEPTH].tobytes(), k) for k in range(BANDS)]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, node (of the shingle set), size, bands."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(x, words) for x in text_bytes(batch.column(2))]
            keys = [bands(x) for x in sets]
            ends = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed([k for x in keys for k in x])))
            nodes = _signed([xxhash.xxh64_intdigest(x.tobytes()) for x in sets])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(x) for x in sets], pa.int64()), listed], names=["doc_id", "mark", "node", "size", "bands"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, mark long, node long, size long, bands array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """node, found: the shingle set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1 << 20):
            sets = [shingle_set(x, words).view(np.int64) for x in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "found"])

    return rows.select("node", "text").mapInArrow(tidy(run), "node long, found array<long>")


def _pairs(least: float, chain: bool):
    """Rows (key, node, size, group) sorted by key -> pairs (a, b) of different groups whose sizes allow ``least``: neighbours, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, size, group in by_key(batches):
            cuts = np.flatnonzero(np.diff(key)) + 1
            for low, high in [(0, len(key))] if chain else zip([0, *cuts], [*cuts, len(key)], strict=True):
                i, j = (np.arange(low, high - 1), np.arange(low + 1, high)) if chain else (low + x for x in np.triu_indices(high - low, 1))
                ok = (key[i] == key[j]) & (group[i] != group[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
                if ok.any():
                    a, b = node[i[ok]], node[j[ok]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _need(x: F.Column, y: F.Column, least: float) -> F.Column:
    """Shingles that sets of these sizes must share."""
    return F.ceil(F.lit(least / (1 + least)) * (x + y) - 1e-9)


def _clusters(large: DataFrame) -> DataFrame:
    """Rows (key, node) of large buckets -> node, cluster: buckets that share nodes are one cluster."""
    first = large.groupBy("node").agg(F.min("key").alias("first"))
    # a node ties its buckets to the first of them; the number of distinct ties is that of buckets, at most times bands
    ties = large.join(first, "node").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    of = components(ties).withColumnRenamed("component", "cluster")
    return first.join(of, first["first"] == of["node"], "left").select(first["node"], F.coalesce("cluster", "first").alias("cluster"))


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, found) -> cluster, s, n: in how many of the sets that this task has seen since its last count a shingle is.

    What the sets of a group share is one row here, not one for each set; at most ``COUNTED`` rows are held.
    """

    def summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        cluster, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s, cluster))
        cluster, s, n = cluster[order], s[order], n[order]
        first = np.flatnonzero(np.concatenate([[len(s) > 0], (np.diff(cluster) != 0) | (np.diff(s) != 0)])[: len(s)])
        return [cluster[first], s[first], np.add.reduceat(n, first) if len(first) else n]

    def out(counts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in counts], names=["cluster", "s", "n"])

    held: list[list[np.ndarray]] = []
    for batch in sliced(batches):
        found, cluster = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
        s = found.flatten().to_numpy(zero_copy_only=False)
        held.append([np.repeat(cluster, found.value_lengths().to_numpy(zero_copy_only=False)), s, np.ones(len(s), np.int64)])
        if sum(len(x[1]) for x in held) > COUNTED:
            held = [summed(held)]
            if 2 * len(held[0][1]) > COUNTED:
                yield out(held.pop())
    if held:
        yield out(summed(held))


def _outlined(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (cluster, node, group, size) of clusters that hold several groups -> cluster, node, size, smallest (of the cluster), core (shingles in p), rare (the others, by rarity)."""
    own = members.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"))
    stats = written(own.groupBy("cluster").agg(F.sum("n").alias("nodes"), F.min("least").alias("smallest"), F.count(F.lit(1)).alias("groups")).where("groups > 1"))
    some = written(members.join(stats, "cluster").select("cluster", "node", "size", "smallest").join(sets, "node").select("cluster", "node", "size", "smallest", "found"))
    # counted before the shuffle; a table of its own, so that a shingle of many sets splits by size below, not by key
    often = written(some.select("cluster", "found").mapInArrow(tidy(_holders), "cluster long, s long, n long").groupBy("cluster", "s").agg(F.sum("n").alias("df")))
    # over half of the sets hold each shingle of p, so p has fewer than twice the shingles of the cluster's mean set
    p = often.join(stats, "cluster").where(2 * F.col("df") > F.col("nodes")).groupBy("cluster").agg(F.collect_list("s").alias("p"))
    rest = F.when(F.col("p").isNull(), F.col("found")).otherwise(F.array_except("found", "p"))
    cut = written(some.join(p, "cluster", "left").select("cluster", "node", "size", "smallest", rest.alias("rest")))
    told = cut.select("cluster", "node", F.explode("rest").alias("s")).join(often, ["cluster", "s"])
    rare = told.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("rare"))
    none = F.array().cast("array<struct<df: bigint, s: bigint>>")
    known = written(cut.join(rare, "node", "left").select("cluster", "node", "size", "smallest", (F.col("size") - F.size("rest")).alias("core"), F.coalesce("rare", none).alias("rare")))
    for table in (stats, some, often, cut):
        forget(table)
    return known


def _asking(known: DataFrame) -> DataFrame:
    """Rows with ``group`` -> the same with ``asks``: whether a node is outside the largest group of its cluster."""
    own = known.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"))
    main = written(own.groupBy("cluster").agg(F.max(F.struct("n", "group")).alias("most")).select("cluster", F.col("most.group").alias("main")))
    return known.join(main, "cluster").withColumn("asks", F.col("group") != F.col("main")).drop("main")


def _alike_in_size(least: float) -> F.Column:
    return F.least("size_x", "size_y") >= F.lit(least) * F.greatest("size_x", "size_y") - 1e-9


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _nearest(known: DataFrame, least: float) -> DataFrame:
    """Pairs of every asking set with that of its cluster's main group that lies nearest to p."""
    best = known.where("not asks").groupBy("cluster").agg(F.max_by(F.struct("node", "size"), F.struct(2 * F.col("core") - F.col("size"), F.col("node"))).alias("best"))
    best = written(best.select("cluster", F.col("best.node").alias("node_y"), F.col("best.size").alias("size_y")))
    return _ordered(known.where("asks").select("cluster", F.col("node").alias("node_x"), F.col("size").alias("size_x")).join(best, "cluster").where(_alike_in_size(least)))


def _possible(known: DataFrame, least: float) -> DataFrame:
    """All pairs of an asking set and one of another group of its cluster that can be alike."""
    side = lambda c, more: known.select("cluster", *[F.col(k).alias(f"{k}_{c}") for k in ("node", "group", "size", "core", *more)])
    x, y = side("x", ("asks", "rare", "smallest")).where("asks_x"), side("y", ())
    sized, both = _alike_in_size(least), _need(F.col("size_x"), F.col("size_y"), least)
    # the least that any partner could ask of x, hence how many of its rare shingles a partner may lack
    partner = F.greatest(F.ceil(F.lit(least) * F.col("size_x") - 1e-9), F.col("smallest_x"))
    asked = _need(F.col("size_x"), partner, least)
    looked = F.size("rare_x") + 1 - F.greatest(F.lit(1), asked - F.col("core_x"))
    probes = x.where(looked > 0).select("*", F.posexplode(F.slice("rare_x", 1, looked.cast("int"))).alias("at", "w")).withColumn("s", F.col("w.s"))
    probes = probes.select("cluster", "s", "node_x", "group_x", "size_x", "core_x", F.size("rare_x").alias("n_rare"), "at")
    index = known.select("cluster", F.col("node").alias("node_y"), F.col("group").alias("group_y"), F.col("size").alias("size_y"), F.col("core").alias("core_y"), F.explode("rare.s").alias("s"))
    lack = F.col("n_rare") - F.greatest(F.lit(1), both - F.least("core_x", "core_y"))
    met = (probes["cluster"] == index["cluster"]) & (probes["s"] == index["s"])
    rare = probes.join(index, met & (F.col("group_x") != F.col("group_y")) & sized & (F.col("at") <= lack))
    # pairs that can reach the bound within p are found by the few (size, core) that a cluster has
    kinds = written(y.groupBy("cluster", "size_y", "core_y").agg(F.count(F.lit(1)).alias("n")))
    able = x.where(F.col("core_x") >= asked)
    able = able.join(kinds, (able["cluster"] == kinds["cluster"]) & sized & (F.least("core_x", "core_y") >= both)).select(able["cluster"], "node_x", "group_x", "size_y", "core_y")
    within = able.join(y, ["cluster", "size_y", "core_y"]).where("group_x <> group_y")
    return _ordered(rare.select("node_x", "node_y").unionByName(within.select("node_x", "node_y")))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets' Jaccard is at least ``least``."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")
    both = both.select("a", "b", (F.size("fa") + F.size("fb")).alias("n"), F.size(F.array_intersect("fa", "fb")).alias("common"))
    return both.where(F.col("common") >= F.lit(least) * (F.col("n") - F.col("common")) - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, node) of every row; (node, component) of every node that a link reaches."""
    spark = docs.sparkSession
    bounded_batches(spark)
    before = held_tables()
    rows = _keyed(docs, id_col, text_col)
    table = written(_sketches(rows, words))
    nodes = table.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    keyed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1"))
    # a large bucket is dealt out in parts of about SMALL nodes, another way in each bucket
    part = F.xxhash64("node", "key") % F.ceil(F.col("nodes") / SMALL)
    met = written(keyed.join(shared, "key").withColumn("part", F.when(F.col("nodes") > SMALL, F.xxhash64("key", part)).otherwise(F.col("key"))))
    # one text of each node that has a candidate
    best = table.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("one")).select("node", "one.*")
    texts = rows.alias("r").join(best.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.mark") == F.col("b.mark"))).select("node", "text")
    sets = written(_sets(texts, words).dropDuplicates(["node"]))
    n = buckets(spark, met.count(), 500_000)

    def grouped(df: DataFrame, parts: DataFrame | None) -> DataFrame:
        return df.withColumn("group", F.col("node")) if parts is None else df.join(parts, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")

    def linked(pairs: DataFrame, parts: DataFrame | None) -> DataFrame:
        """Compare; the groups after the links that are found, each one of the groups before as a star."""
        links = _alike(pairs, sets, least)
        return components(links if parts is None else links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    def in_buckets(df: DataFrame, chain: bool) -> DataFrame:
        dealt = df.select("part", "node", "size", "group").repartition(n, "part").sortWithinPartitions("part", F.xxhash64("node", "part"))
        return dealt.mapInArrow(tidy(_pairs(least, chain)), "a long, b long").distinct()

    parts = linked(in_buckets(grouped(met.where(F.col("band") < FIRST), None), True), None)
    pairs = in_buckets(grouped(met.where(F.col("nodes") <= SMALL), parts), False)
    large = met.where(F.col("nodes") > SMALL).select("key", "node")
    if not large.take(1):
        parts = linked(pairs, parts)
    else:
        members = _clusters(written(large)).join(sets.select("node", F.size("found").alias("size")), "node")
        outlined = _outlined(written(grouped(members, parts)), sets)
        parts = linked(pairs.unionByName(_nearest(_asking(grouped(outlined, parts)), least)).distinct(), parts)
        parts = linked(_possible(written(_asking(grouped(outlined, parts))), least), parts)
    parts = written(parts)
    sweep(spark, before, table, parts)
    return table.select("doc_id", "mark", "node"), parts


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows that stay, with all their columns: no two of them are alike by ``least`` or more."""
    table, parts = near_copies(docs, id_col, text_col, words, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = table.groupBy("node").agg(F.min(order).alias("one"))
    winners = parts.join(best, "node").groupBy("component").agg(F.min_by("node", "one").alias("node")).select("node")
    lost = parts.select("node").join(winners, "node", "left_anti")
    stay = best.join(lost, "node", "left_anti").select(F.col("one.doc_id").alias("__id"), F.col("one.mark").alias("__mark"))
    same = lambda doc_id, mark, other: doc_id.eqNullSafe(other["__id"]) & (mark == other["__mark"])
    gone = table.join(stay, same(table["doc_id"], table["mark"], stay), "left_anti").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(gone, same(docs[id_col], F.xxhash64(docs[text_col]), gone), "left_anti")
