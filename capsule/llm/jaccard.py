"""Exact n-gram Jaccard self-join by partitioning the universe of shingles.

Two sets with similarity of at least t differ in at most H = (1 - t) / t * |smaller| shingles. Within a band of sizes the
universe is hashed into segments. A segment may be indexed exactly (worth one unit) or with its one-deletion
neighbourhood as well (two units: it then also meets segments that differ in one shingle). If the units exceed H, two
similar sets agree in at least one indexed segment: otherwise each segment would hold at least as many differences as
its units. `allocate` picks, for each band, how many segments get the neighbourhood by estimated cost (rows written and
chance agreements). A set takes part in its own band and in that below, where its smaller partners are.

Exact segments have units to spare: with U of them, similar sets agree in U - H at least, so it is enough to compare
the H + 1 rarest keys of either set, in an order that all sets share. A set leaves out its U - H - 1 most frequent keys,
which are those of passages that many documents have; one with more keys of its own than that has no partner at all.

Equal sets are one node, so copies cost one set of keys. Nodes that share a key are linked in a chain along the key, and
chains give candidate clusters. A cluster is checked in cells of two blocks of bounded size, each pair of nodes in exactly
one cell, by counting common shingles; a cell returns per node its links and one tree of links, never pairs. Links within
cells give the classes.

Defined cases. Null or empty text, or no word: an empty set, linked with nothing, class of its own. Fewer words than a
shingle has: the whole sequence is the only shingle. Repeated rows and equal texts: one class. Null doc_id: takes part;
a class's id is its smallest doc_id, null if all are. Empty table: empty result. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from capsule.llm.common import small, table
from capsule.llm.components import components
from capsule.llm.hashed import blocks, mixed, shingle_sets
from capsule.sources.staging import stage

#: Nodes and shingles that a block of a candidate cluster holds, about.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1 << 17
#: Assumed share of shingles that other documents have too, and the cost of a chance agreement in rows.
SHARED, CHANCE = 0.6, 100.0
#: Units to spare for each unit that exact segments need.
SPARE = 0.25


def bands(longest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Bands (smallest, largest) of set sizes; a set's partners are in its own band or one beside it."""
    out, low = [], 1
    while low <= longest:
        out.append((low, low * den // num))
        low = out[-1][1] + 1
    return out


def allocate(low: int, top: int, num: int, den: int) -> tuple[int, int, int] | None:
    """Segments, those of them with neighbourhood, and keys that a set may leave out (only without neighbourhoods);
    None if sets of the band have no partners but equal ones."""
    differences = (den - num) * top // num
    if not differences:
        return None
    need, size = differences + 1, (low + top) / 2

    def spare(near: int) -> int:
        return 0 if near else int(SPARE * need)

    def cost(near: int) -> float:
        segments = need + spare(near) - near
        g = size / segments
        plain = segments - near
        chance = max(0.0, plain * SHARED ** g - spare(near)) + near * SHARED ** max(0.0, g - 1)
        return plain + near * (1 + g) + CHANCE * chance
    near = min(range(need // 2 + 1), key=cost)
    return need + spare(near) - near, near, spare(near)


def keys(shingles: np.ndarray, band: int, segments: int, near: int) -> np.ndarray:
    """Keys under which a set is indexed in a band; the first `near` segments have the neighbourhood."""
    salted = mixed(shingles + np.uint64(band + 1))
    segment = (salted % np.uint64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    value, segment = salted[order], segment[order]
    sizes = np.bincount(segment, minlength=segments)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    stops = np.cumsum(sizes)
    sums = running[stops] - running[stops - sizes]
    salt = (np.arange(segments, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407) + np.uint64(band << 40)
    found = mixed(sums + salt)
    inner = segment < near
    if near and inner.any():
        found = np.concatenate((found, mixed(sums[segment[inner]] - value[inner] + salt[segment[inner]])))
    return found


def node(shingles: np.ndarray) -> int:
    """Identity of a set, as a signed 64-bit number with a free lowest bit."""
    total = mixed(np.add.reduce(mixed(shingles + np.uint64(7)), dtype=np.uint64).reshape(1) + np.uint64(len(shingles)))
    return int(total.astype(np.int64)[0]) & ~1


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    """Part of a batch, and the set of each of its rows."""
    for b in batches:
        for at, some in blocks(b["text"]):
            yield b.slice(at, len(some)), shingle_sets(some, n)


def nodes(docs: DataFrame, n: int) -> DataFrame:
    """Row per document: doc_id, n_shingles, node."""
    def run(batches):
        for part, sets in _sets(batches, n):
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([node(s) for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "node"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long")


def indexed(docs: DataFrame, n: int, num: int, den: int, longest: int) -> DataFrame:
    """Rows (key, entry): the index of all sets. An entry is a node in its own band, or plus one in the band below.
    Sets met before in a task are not written again."""
    all_bands = bands(longest, num, den)
    lows = np.array([low for low, _ in all_bands])
    plans = [allocate(low, top, num, den) for low, top in all_bands]

    def run(batches):
        seen = set()
        for _, sets in _sets(batches, n):
            found, owner = [], []
            for s in sets:
                who = node(s) if len(s) else None
                if who is None or who in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(who)
                own = int(np.searchsorted(lows, len(s), "right")) - 1
                for band in (own - 1, own):
                    if band >= 0 and plans[band]:
                        found.append(keys(s, band, *plans[band][:2]))
                        owner.append((who + own - band, len(found[-1])))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).astype(np.int64)),
                     pa.array(np.repeat(np.array([w for w, _ in owner], np.int64), [c for _, c in owner]))], ["key", "entry"])
    return docs.select("text").mapInArrow(run, "key long, entry long")


def shared(index: DataFrame) -> DataFrame:
    """Distinct rows (key, entry) of keys that at least two entries have."""
    along = Window.partitionBy("key").orderBy("entry")
    near = index.select("key", "entry", F.lag("entry").over(along).alias("before"), F.lead("entry").over(along).alias("after"))
    return near.where("before <> entry or after <> entry").select("key", "entry").distinct()


def rare_keys(index: DataFrame, members: DataFrame, num: int, den: int, longest: int) -> DataFrame:
    """Distinct rows (key, node) of the index once each entry has left out its most frequent keys."""
    hits = stage(shared(index), "shared-keys")
    all_bands = bands(longest, num, den)
    lows = F.array(*[F.lit(low) for low, _ in all_bands])
    spare = F.array(*[F.lit((allocate(low, top, num, den) or (0, 0, 0))[2]) for low, top in all_bands])
    sizes = members.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("size"))
    below = F.col("entry").bitwiseAND(1)
    band = F.size(F.filter(lows, lambda x: x <= F.col("size"))) - 1 - below
    most_frequent = Window.partitionBy("entry").orderBy(F.col("count").desc(), F.col("key").desc())
    return (hits.join(hits.groupBy("key").agg(F.count("*").alias("count")), "key")
            .withColumn("place", F.row_number().over(most_frequent))
            .withColumn("node", F.col("entry") - below).join(sizes, "node")
            .where(F.col("place") > F.get(spare, band.cast("int"))).select("key", "node"))


def chains(hits: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes that follow one another under a key."""
    before = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    return hits.select(before.alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def verify(batch: pa.Table, num: int, den: int) -> pa.Table:
    """Links between the nodes of a cell (pairs across its two blocks, or within its only one)."""
    two = batch["one"][0].as_py() != batch["other"][0].as_py()
    block, who = batch["block"].to_numpy(), batch["node"].to_numpy()
    copies = batch["copies"].to_numpy()
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in batch["shingles"]]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    holders = owner[order]
    stops = np.cumsum(np.bincount(token))
    starts = stops - np.bincount(token)
    first = np.concatenate(([0], np.cumsum(size)))
    root, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(sets)):
        mine = token[first[i]:first[i + 1]]
        lens = stops[mine] - starts[mine]
        at = np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        linked = den * common >= num * (size + size[i] - common)
        linked[i] = False
        if two:
            linked &= block != block[i]
        linked = np.flatnonzero(linked)
        links[i] = copies[linked].sum()
        for j in linked[linked > i]:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    kept = np.flatnonzero(links)
    return pa.table({"node": who[kept], "root": who[[top(i) for i in kept]] if len(kept) else who[:0], "links": links[kept]})


def sets_of(docs: DataFrame, members: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows (node, size, shingles) of the nodes in `wanted`; a task gives a node once. Documents are chosen by doc_id, then
    told apart by their sets, so repeated and null ids only cost their own number."""
    chosen = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("_id")).join(small(wanted), "node", "left_semi")
    chosen = stage(chosen, "chosen")

    def run(batches):
        seen = set()
        for b in batches:
            for _, some in blocks(b["text"]):
                sets = [(node(s), s) for s in shingle_sets(some, n) if len(s)]
                new = []
                for who, s in sets:
                    if who not in seen:
                        new.append((who, s))
                        if len(seen) < 500_000:
                            seen.add(who)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in new], pa.int64()), pa.array([len(s) for _, s in new], pa.int64()),
                                                  pa.array([s.tobytes() for _, s in new], pa.binary())], ["node", "size", "shingles"])
    some = docs.select("doc_id", "text").join(small(chosen.select("_id").distinct()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = some.mapInArrow(run, "node long, size long, shingles binary")
    return found.join(small(chosen.select("node")), "node", "left_semi")


def cells(docs: DataFrame, members: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    """Rows (cluster, one, other, block, node, copies, shingles): each node of a cluster in all cells of its block."""
    known = (members.where("n_shingles > 0").groupBy("node")
             .agg(F.count("*").alias("copies"), F.first("n_shingles").alias("size"))
             .join(clusters.withColumnRenamed("root", "cluster"), "node"))
    known = stage(known, "clustered")
    amount = known.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = stage(known.join(amount, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
                   .select("node", "copies", "cluster", "blocks", "block"), "wanted")
    sets = sets_of(docs, members, wanted.select("node"), n).drop("size").join(small(wanted), "node")
    return (sets.withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("one", F.least("block", "beside")).withColumn("other", F.greatest("block", "beside"))
            .drop("blocks", "beside"))


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Row per document of `docs` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    Sets of word n-grams whose similarity is num / den at least are linked. component_id is the smallest doc_id that
    links reach; n_links counts the other documents linked directly.
    """
    return classified(docs, n, num, den).drop("node", "root")


def classified(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of `jaccard_classes` with node and root, the class among nodes (null without shingles)."""
    members = stage(nodes(docs, n), "nodes")
    longest = members.agg(F.max("n_shingles")).first()[0] or 0
    index = indexed(docs, n, num, den, longest)
    candidates = stage(components(chains(rare_keys(index, members, num, den, longest))), "candidate-clusters")

    def check(batch: pa.Table) -> pa.Table:
        # a node whose doc_id is repeated may have come more than once
        seen = {x: i for i, x in enumerate(batch["node"].to_pylist())}
        return verify(batch.take(list(seen.values())) if len(seen) < batch.num_rows else batch, num, den)
    linked = stage(cells(docs, members, candidates, n).groupBy("cluster", "one", "other")
                   .applyInArrow(check, "node long, root long, links long"), "links")
    classes = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    one = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    one = (one.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
           .join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left"))
    one = stage(one, "one")
    least = one.groupBy("root").agg(F.min("first").alias("component_id"))
    one = one.join(least, "root").select("node", "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (members.join(small(stage(one, "classes")), "node", "left")
            .select("doc_id", "n_shingles", "node", "root",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links")))


def with_nodes(docs: DataFrame, n: int) -> DataFrame:
    """`docs` with `_node`."""
    def run(batches):
        for part, sets in _sets(batches, n):
            yield part.append_column("_node", pa.array([node(s) for s in sets], pa.int64()))
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_node", LongType())]))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) without those that have a document of smaller doc_id in their
    class. Rows that repeat a doc_id in a class stay once, that of the smallest text; a class without any doc_id stays
    whole. A doc_id that is null or repeated may stand in several classes: there, rows are told apart by their sets."""
    classes = stage(classified(docs, n, num, den).select("doc_id", "n_shingles", "component_id", "node", "root"), "classes-of-documents")
    gone = classes.where((F.col("n_shingles") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = stage(gone.select(F.col("doc_id").alias("_id"), F.col("node").alias("_gone")).distinct(), "gone")
    again = stage(classes.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 or _id is null").select("_id"), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    plain = docs.join(small(gone.select("_id").distinct()), same, "left_anti")
    if not again.limit(1).count():
        return plain
    odd = with_nodes(docs.join(small(again), same, "left_semi"), n)
    odd = odd.join(small(gone), same & (F.col("_node") == F.col("_gone")), "left_anti")
    roots = classes.where("n_shingles > 0 and doc_id is not null").join(small(again), F.col("doc_id") == F.col("_id"), "left_semi")
    roots = stage(roots.select(F.col("doc_id").alias("_id"), F.col("node").alias("_of"), F.col("root").alias("_root")).distinct(), "roots")
    odd = stage(odd.join(small(roots), (F.col("doc_id") == F.col("_id")) & (F.col("_node") == F.col("_of")), "left"), "odd")
    first = F.row_number().over(Window.partitionBy("doc_id", "_root").orderBy("text"))
    once = odd.where("_root is not null").withColumn("_place", first).where("_place = 1")
    return (plain.join(small(again), same, "left_anti").unionByName(odd.where("_root is null").select(docs.columns))
            .unionByName(once.select(docs.columns)))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by sets of 3-word shingles with a similarity of 0.9 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents"), 3, 9, 10)
