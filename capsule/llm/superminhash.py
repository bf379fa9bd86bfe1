"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

Every shingle has a random permutation of the signature's places and, in round j, offers j plus a fraction to the j-th place
of its permutation; a place keeps the least offer. Places of one shingle are thus never equal, which lowers the variance of
estimates against independent ranks, and a set is finished in the first round that leaves no place empty: a set of n shingles
takes about max(1, PLACES * ln(PLACES) / n) rounds. `signatures` runs the rounds for many sets side by side.

Bands of ROWS places are keys; two sets of similarity 0.8 miss all of them with a probability of 1e-11. Equal sets are one
node, so copies cost one signature. What shares a key is a candidate and is checked on full sets, in two steps, so that a
large group of near copies costs its size and not its square:

1. The smallest node of a key is its leader. Each other node is compared with its leaders, slices of one leader's nodes in
   tasks of their own. Links give classes by union-find.
2. Keys whose nodes without the leader still lie in several classes: the nodes outside the largest class of the key are
   compared with all nodes of the key, in cells of two blocks of bounded size.

Links of both steps give the classes. Pairs are never emitted; cells return a tree of links for each block.

Defined cases. Null or empty text, or no word: an empty set, linked with nothing, class of its own. Fewer words than a
shingle has: the whole sequence is the only shingle. Very long texts: signatures take CHUNK shingles at a time. Repeated
rows and equal texts: one class. Null doc_id: takes part; a class's id is its smallest doc_id, null if all are. Empty table:
empty result. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.llm.common import small, table
from capsule.llm.components import components
from capsule.llm.hashed import blocks, mixed, shingle_sets
from capsule.llm.jaccard import BLOCK_NODES, BLOCK_SHINGLES, node, sets_of, verify
from capsule.sources.staging import stage

#: Bands of a signature, and places in a band; shingles that go through the rounds at a time.
BANDS, ROWS, CHUNK = 48, 4, 1 << 17
#: Rounds whose swaps are looked through one by one; sets that need more get whole permutations.
FEW_ROUNDS = 5
#: Nodes that a leader is compared with in one task.
SLICE = 256


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signature of each set (row): least offers, the round in the upper bits; of an empty set, the greatest number."""
    least = np.full(len(sets) * places, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(every), CHUNK):
        key, owner = every[at:at + CHUNK], owners[at:at + CHUNK]
        waiting = np.zeros(len(sets), bool)
        waiting[owner] = True
        swaps: list[tuple[np.ndarray, np.ndarray]] = []  # place changed in a round, and what came there
        order = None
        for j in range(places):
            drawn = mixed(key + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            other = j + ((drawn >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
            if order is None:
                place, mine = other, np.full(len(key), j)
                for changed, now in swaps:
                    place, mine = np.where(changed == other, now, place), np.where(changed == j, now, mine)
                swaps.append((other, mine))
            else:
                row = np.arange(len(key))
                place = order[row, other].astype(np.int64)
                order[row, other] = order[row, j]
            offer = (mixed(drawn) >> np.uint64(16)) | np.uint64(j << 48)
            np.minimum.at(least, owner * places + place, offer)
            # later rounds offer more than this one: a set with no place left above it is finished
            some = np.flatnonzero(waiting)
            done = some[least.reshape(-1, places)[some].max(axis=1) < np.uint64((j + 1) << 48)]
            if len(done) == len(some):
                break
            if len(done):
                waiting[done] = False
                more = waiting[owner]
                key, owner = key[more], owner[more]
                swaps = [(x[more], y[more]) for x, y in swaps]
                order = None if order is None else order[more]
            if j == FEW_ROUNDS:
                order = np.tile(np.arange(places, dtype=np.uint16), (len(key), 1))
                for changed, now in swaps:
                    order[np.arange(len(key)), changed] = now
    return least.reshape(len(sets), places)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """Key of each band of each signature."""
    places = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), places.shape[:2])
    for i in range(places.shape[2]):
        key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + places[:, :, i])
    return key


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Row per document: doc_id, n_shingles, node, keys. Keys are null for empty sets and sets met before in the task."""
    def run(batches):
        seen = set()
        for b in batches:
            for at, some in blocks(b["text"]):
                sets = shingle_sets(some, n)
                nodes = [node(s) for s in sets]
                new = []
                for i, (s, who) in enumerate(zip(sets, nodes)):
                    if len(s) and who not in seen:
                        new.append(i)
                        if len(seen) < 500_000:
                            seen.add(who)
                keys = np.zeros((0, bands), np.uint64) if not new else band_keys(signatures([sets[i] for i in new], bands * rows), bands)
                sizes = np.zeros(len(sets), np.int64)
                sizes[new] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(keys.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(at, len(some)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), lists],
                    ["doc_id", "n_shingles", "node", "keys"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, keys array<long>")


def with_leader(t: pa.Table, num: int, den: int) -> pa.Table:
    """Nodes of a slice that are linked with its leader."""
    who, sets = t["node"].to_pylist(), [np.frombuffer(s.as_py(), np.uint64) for s in t["shingles"]]
    leader = t["leader"][0].as_py()
    own = sets[who.index(leader)]
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    common = np.add.reduceat(own[at] == every, np.cumsum(size) - size, dtype=np.int64)
    linked = den * common >= num * (size + len(own) - common)
    kept = [w for w, x in zip(who, linked) if x and w != leader]
    return pa.table({"a": pa.array(kept, pa.int64()), "b": pa.array([leader] * len(kept), pa.int64())})


def led(hits: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of nodes with the leaders of their keys."""
    stars = stage(hits.where("node <> leader").select("leader", "node").distinct(), "stars")
    slices = stage(stars.groupBy("leader").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "slices")
    rows = stars.join(small(slices), "leader").select("leader", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), "node")
    own = slices.select("leader", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("leader").alias("node"))
    cells = rows.unionByName(own).join(sets, "node")
    return cells.groupBy("leader", "slice").applyInArrow(lambda t: with_leader(t, num, den), "a long, b long")


def left_over(hits: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of the nodes that share a key, but neither class nor leader, found in cells of two blocks."""
    placed = hits.join(small(classes), "node", "left").withColumn("root", F.coalesce("root", "node"))
    led_ = F.col("node") != F.col("leader")
    keys = (placed.groupBy("key").agg(F.min(F.when(led_, F.col("root"))).alias("low"), F.max(F.when(led_, F.col("root"))).alias("high"),
                                      F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("content"), F.count("*").alias("n"))
            .where("low < high").groupBy("content", "n").agg(F.min("key").alias("key")).select("key"))
    placed = stage(placed.join(small(stage(keys, "open-keys")), "key", "left_semi")
                   .join(sets.select("node", "size").dropDuplicates(["node"]), "node").select("key", "node", "root", "size"), "left-over")
    main = (placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
            .agg(F.max_by("root", F.struct("n", "root")).alias("main")))
    sided = placed.join(main, "key").withColumn("rest", F.col("root") != F.col("main"))

    def amount(side):
        return F.greatest(F.lit(1), F.ceil(F.sum(side.cast("int")) / BLOCK_NODES), F.ceil(F.sum(F.when(side, F.col("size"))) / BLOCK_SHINGLES)).cast("int")
    blocks_ = sided.groupBy("key").agg(amount(F.col("rest")).alias("rests"), amount(~F.col("rest")).alias("mains"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    block = F.when(F.col("rest"), block).otherwise(F.col("rests") + block)
    last = F.when(F.col("rest"), F.col("rests") + F.col("mains")).otherwise(F.col("rests")) - 1
    cells = (sided.join(blocks_, "key").withColumn("block", block).withColumn("beside", F.explode(F.sequence(F.lit(0), last)))
             .select("key", F.least("block", "beside").alias("one"), F.greatest("block", "beside").alias("other"), "block", "node", F.lit(1).cast("long").alias("copies")))

    def check(t: pa.Table) -> pa.Table:
        first = {x: i for i, x in enumerate(t["node"].to_pylist())}
        found = verify(t.take(list(first.values())) if len(first) < t.num_rows else t, num, den)
        return pa.table({"a": found["node"], "b": found["root"]})
    return cells.join(sets.select("node", "shingles"), "node").groupBy("key", "one", "other").applyInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Row per document of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Sets of word n-grams whose similarity is num / den at least are linked. component_id is the smallest doc_id that links
    reach; kept tells whether that is the document's own.
    """
    members = stage(signed(docs, n, bands, rows), "signatures")
    each = members.select("node", F.explode("keys").alias("key"))
    leaders = stage(each.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("top")).where("leader < top").drop("top"), "leaders")
    hits = stage(each.join(small(leaders), "key").distinct(), "hits")
    sets = stage(sets_of(docs, members, hits.select("node").distinct(), n), "sets")
    links = stage(led(hits, sets, num, den), "led")
    more = stage(left_over(hits, stage(components(links), "first-classes"), sets, num, den), "more-links")
    classes = components(links.unionByName(more))
    one = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    one = stage(one.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "one")
    least = one.groupBy("root").agg(F.min("first").alias("component_id"))
    one = stage(one.join(least, "root").select("node", "component_id"), "classes")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (members.join(small(one), "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by sets of 2-word shingles with a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2, 4, 5)
