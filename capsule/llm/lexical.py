"""Ranked lexical search: all documents for each item, by dense blocked multiplication.

Items are taken in groups of bounded size. A group's distinct terms are its compact vocabulary. One pass over the documents
counts documents, terms and each vocabulary term's documents; a second one multiplies, for each block of documents, the
dense tile of their impacts with the tiles of the group's term counts. An impact is an integer, and a tile of the
vocabulary ends where an item's sum could reach 2**53, so products and partial sums are exact in float64; partial sums are
added as 64-bit integers. Each task keeps the best documents of each item, ordered by score and then doc_id, and two grouped
rankings (slices, then whole) merge what the tasks kept.

What reaches the driver is one group of items and its term counts; both are bounded by GROUP_ITEMS and GROUP_CHARS. More
items cost more passes over the documents.

Defined cases. Null or empty text, or no term: the document is never returned and does not count; an item without terms has
no rows. Very long texts: one at a time. Repeated rows of documents: each is ranked. Repeated rows of items: each has its
own ranking. Null doc_id: ranked last among equal scores. Empty tables: empty result. Other columns are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsule.llm.common import table
from capsule.llm.hashed import LOWER, Words, blocks

#: Items, and about how many characters of their texts, that are searched in one pass.
GROUP_ITEMS, GROUP_CHARS = 1024, 1 << 22
#: Terms in one tile of a group's vocabulary, and the bound of exact sums in float64.
TILE_TERMS, EXACT = 2048, 1 << 53
#: The saturated frequency of a term stays below this.
SATURATION = 1_000_000
SLICES = 32
_LAST = np.iinfo(np.int64).max

TERM = np.ones(256, bool)
TERM[:128] = False
TERM[48:58] = TERM[65:91] = TERM[97:123] = True


class Terms:
    """Hashes of the terms of some texts (bytes), and the text each is in."""

    def __init__(self, texts: list[bytes]):
        data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        edge = np.flatnonzero(np.diff(TERM[data], prepend=False))
        start, end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        self.hash = Words._hash(data.astype(np.uint64) + np.uint64(1), start, end)
        self.size = np.bincount(self.doc, minlength=len(texts))


class Group:
    """Some items: their ids, distinct term hashes in order, and for each item its terms (places) with repeats."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        terms = Terms([(t or "").encode() for _, t in items])
        self.vocabulary = np.unique(terms.hash)
        place = np.searchsorted(self.vocabulary, terms.hash)
        self.counts = [Counter() for _ in items]
        for item, term in zip(terms.doc.tolist(), place.tolist()):
            self.counts[item][term] += 1


def groups(items: DataFrame) -> Iterator[Group]:
    """The items, read in turn; one group is held at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if len(held) == GROUP_ITEMS or size >= GROUP_CHARS:
            yield Group(held)
            held, size = [], 0
    if held:
        yield Group(held)


def counted(texts: pa.Array, vocabulary: np.ndarray):
    """For each block of texts: index of its first, number of terms by text, and (text, term, frequency) of the terms
    that the vocabulary has."""
    for at, some in blocks(texts):
        terms = Terms(some)
        if len(vocabulary):
            place = np.minimum(np.searchsorted(vocabulary, terms.hash), len(vocabulary) - 1)
            known = vocabulary[place] == terms.hash
            both, tf = np.unique(terms.doc[known] * len(vocabulary) + place[known], return_counts=True)
            yield at, terms.size, both // len(vocabulary), both % len(vocabulary), tf
        else:
            none = np.empty(0, np.int64)
            yield at, terms.size, none, none, none


def statistics(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, documents of each vocabulary term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        df, totals = np.zeros(len(known), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for _, size, _, term, _ in counted(b["text"], known):
                df += np.bincount(term, minlength=len(known))
                totals += (np.count_nonzero(size), size.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], held))), pa.array(np.concatenate((totals, df[held])))], ["term", "n"])
    found = {r.term: r.n for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-2, 0), found.get(-1, 0), df


def tiles(group: Group, weight: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts by term and item): columns of the group's vocabulary, so cut that no item's sum over a tile reaches
    2**53. Repeats of a term beyond that bound stand in further columns of it."""
    holders: dict[int, list[tuple[int, int]]] = {}
    for item, own in enumerate(group.counts):
        for term, n in own.items():
            holders.setdefault(term, []).append((item, n))
    out, columns, bound = [], [], np.zeros(len(group.ids))

    def close():
        if columns:
            q = np.zeros((len(columns), len(group.ids)))
            for c, (_, some) in enumerate(columns):
                for item, n in some:
                    q[c, item] = n
            out.append((np.array([t for t, _ in columns]), q))
            columns.clear()
            bound[:] = 0
    for term in sorted(holders):
        left, most = holders[term], EXACT // 2 // (max(weight[term], 1) * SATURATION)
        while left:
            some = [(item, min(n, most)) for item, n in left]
            left = [(item, n - most) for item, n in left if n > most]
            at = [item for item, _ in some]
            add = np.array([float(n) * weight[term] * SATURATION for _, n in some])
            if len(columns) == TILE_TERMS or (bound[at] + add >= EXACT).any():
                close()
            columns.append((term, some))
            bound[at] += add
    close()
    return out


def best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int):
    """The first k rows of each column by score, highest first, then id."""
    if len(score) > k:
        # everything that ties with the k-th is kept for the ordering by id
        least = np.partition(score, len(score) - k, axis=0)[len(score) - k]
        rows = np.flatnonzero((score >= least).any(axis=1))
        score, ids, null = score[rows], ids[rows], null[rows]
    order = np.lexsort((ids, null, -score), axis=0)[:k]
    return tuple(np.take_along_axis(x, order, axis=0) for x in (score, ids, null))


def search_group(docs: DataFrame, group: Group, k: int) -> DataFrame:
    """Rows (item, doc_id, score): at least the k best documents of each item of the group."""
    n_docs, n_terms, df = statistics(docs, group.vocabulary)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df]
    shared = docs.sparkSession.sparkContext.broadcast((group.vocabulary, np.array(weight, np.int64), tiles(group, weight), len(group.ids)))

    def run(batches):
        vocabulary, w, parts, n_items = shared.value
        top = (np.zeros((0, n_items), np.int64), np.zeros((0, n_items), np.int64), np.zeros((0, n_items), bool))
        for b in batches:
            none = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            doc_id = b["doc_id"].fill_null(_LAST).to_numpy()
            for at, size, doc, term, tf in counted(b["text"], vocabulary):
                if not len(doc):
                    continue
                length = np.array([75 + 25 * n * n_docs // n_terms for n in size.tolist()], np.int64)
                impact = (w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[doc]))).astype(np.float64)
                score = np.zeros((len(size), n_items), np.int64)
                column = np.empty(len(vocabulary), np.int64)
                for terms, q in parts:
                    column.fill(-1)
                    column[terms] = np.arange(len(terms))
                    held = column[term]
                    dense = np.zeros((len(size), len(terms)))
                    dense[doc[held >= 0], held[held >= 0]] = impact[held >= 0]
                    if len(np.unique(terms)) < len(terms):
                        dense = dense[:, column[terms]]
                    score += (dense @ q).astype(np.int64)
                own = slice(at, at + len(size))
                ids = np.broadcast_to(doc_id[own, None], score.shape)
                null = np.broadcast_to(none[own, None], score.shape)
                top = best(*(np.concatenate(x) for x in zip(top, (score, ids, null))), k)
        score, ids, null = (x.T.ravel() for x in top)
        item = np.repeat(np.arange(n_items), len(top[0]))
        kept = score > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(item[kept]), pa.array(ids[kept], mask=null[kept]), pa.array(score[kept])], ["item", "doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each row of `items` (item_id, text) its k best documents (doc_id, text)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for group in groups(items.select("item_id", "text")):
        if not len(group.vocabulary):
            continue
        names = spark.createDataFrame([(i, name) for i, name in enumerate(group.ids)], f"item long, item_id {kind}")
        first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        near = (search_group(docs, group, k).withColumn("slice", F.spark_partition_id() % SLICES)
                .withColumn("place", F.row_number().over(Window.partitionBy("item", "slice").orderBy(*first))).where(F.col("place") <= k))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*first))).where(F.col("rank") <= k)
        found = found.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return found


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each item of `benchmark`."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
