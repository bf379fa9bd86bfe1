"""Document fingerprints of closed syncmers.

A text is cut into tokens: words, and of words longer than PIECE each sign, so that text without spaces is cut by its
content. Of all runs of K tokens those are anchors whose smallest inner run of S tokens (by hash; the first of equal ones)
stands at the start or the end. Whether a run is an anchor depends on its own tokens alone, so equal passages have equal
anchors wherever they stand. A text of fewer than FEW tokens also has the anchors of its signs, in runs of K_SIGNS; one
without any anchor has its whole sequence as its anchor.

A fingerprint is the list of its anchors' hashes in text order; `places` of two fingerprints match equal anchors.

Everything is built-in functions on arrays. Comparing each document with the next one sends, besides its text, only as
much of the next text as the edit takes; documents find their neighbour over id ranges, never in one task.

Defined cases. Null or empty text, or only white space: no anchors; two such texts have likeness 1, one with another 0.
Order of documents: doc_id, then a hash of the text; nulls last. Rows with equal doc_id and text are one document here
and give equal rows. A single document is its own next one. Empty table: empty result. Columns of the input stay, those
named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsule.llm.common import bind, small, table
from capsule.sources.staging import stage

K, S, PIECE = 6, 2, 24
FEW, K_SIGNS = 2 * K, 4
#: Bits kept of an anchor's hash in a fingerprint.
KEPT_BITS = (1 << 31) - 1


SIGN = r"[^\x20\x09-\x0D]"


def tokens(text: Column, pattern: str = rf"(?<!{SIGN}){SIGN}{{1,{PIECE}}}+(?!{SIGN})|{SIGN}") -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w))


def _from(a: Column, start: int) -> Column:
    """The array from its `start`-th element on (counted from 0)."""
    return F.slice(a, start + 1, F.greatest(F.size(a) - start, F.lit(0)))


def _with(a: Column, b: Column, join) -> Column:
    """join(a[i], b[i]) as far as both reach."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), join)


def _least(a: Column, n: int) -> Column:
    """Smallest of each n elements in a row, found by doubling."""
    if n == 1:
        return a
    half = n // 2
    return bind(_least(a, half), lambda m: _with(m, _from(m, half) if n == 2 * half else _from(_least(a, n - half), half), lambda x, y: F.least(x, y)))


def _closed(h: Column, k: int, s: int) -> Column:
    """Array of (at, hash): the closed runs of k of the hashes `h`."""
    inner, run = k - s, h

    def closed(m: Column) -> Column:
        """From the hashes of all inner runs."""
        runs = F.sequence(F.lit(0), F.size(m) - inner - 1)
        # leftmost smallest at the start: none smaller; at the end: all before it are larger
        before = lambda least: F.transform(runs, lambda i: F.when(
            (F.get(m, i) <= F.get(least, i + 1)) | (F.get(m, i + inner) < F.get(least, i)),
            F.struct(i.alias("at"), F.xxhash64(*[F.get(m, i + j) for j in (*range(0, inner, s), inner)]).alias("hash"))))
        return F.filter(bind(_least(m, inner), before), lambda x: x.isNotNull())
    for j in range(1, s):
        run = _with(run, _from(h, j), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(h) >= k, bind(run, closed)).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (at, hash): the anchors of a text in order, `at` counting tokens from 0 (signs, for anchors of signs)."""
    def whole(h: Column) -> Column:
        one = F.struct(F.lit(0).alias("at"), F.aggregate(h, F.size(h).cast("bigint"), lambda a, x: F.xxhash64(a, x)).alias("hash"))
        return F.when(F.size(h) > 0, F.array(one)).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))

    def found(h: Column) -> Column:
        signs = F.when(F.size(h) < FEW, bind(tokens(text, SIGN), lambda c: _closed(c, K_SIGNS, s)))
        every = F.concat(_closed(h, k, s), F.coalesce(signs, F.array().cast("array<struct<at:int,hash:bigint>>")))
        return bind(every, lambda x: F.when(F.size(x) > 0, x).otherwise(whole(h)))
    return bind(tokens(text), found)


def fingerprint(found: Column) -> Column:
    """The anchors' hashes, eight hexadecimal digits each, in text order."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def hashes(text: Column) -> Column:
    """The kept bits of the anchors' hashes in text order: array<int>, half the size to move."""
    return F.transform(anchors(text), lambda x: x["hash"].bitwiseAND(KEPT_BITS).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of the distinct anchors of two texts."""
    def share(x: Column, y: Column, common: Column) -> Column:
        every = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - common
        return F.when(every > 0, common / every).otherwise(F.lit(1.0))
    return bind(a, lambda x: bind(b, lambda y: bind(F.size(F.array_intersect(x, y)), lambda common: share(x, y, common))))


def places(a: Column, b: Column) -> Column:
    """Array of (at, other): places of equal anchors of two texts (`anchors`), each anchor of `a` with its first equal
    in `b`."""
    def match(m: Column) -> Column:
        return F.filter(F.transform(a, lambda x: F.struct(x["at"].alias("at"), F.get(F.transform(
            F.filter(m, lambda y: y["hash"] == x["hash"]), lambda y: y["at"]), F.lit(0)).alias("other"))),
            lambda p: p["other"].isNotNull())
    return bind(b, match)


def neighbours(keys: DataFrame) -> DataFrame:
    """`keys` (doc_id, digest, n_chars; distinct) with `next`: doc_id and digest of the following document in
    descending order, after the last the first.

    Keys are written in ranges; each range is sorted by itself and the ends of the ranges are joined.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest").asc()]
    ranged = stage(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    key = F.struct("doc_id", "digest")
    within = Window.partitionBy("range").orderBy(*order)
    place = F.row_number().over(within)
    starts = ranged.select("range", key.alias("key"), place.alias("place")).where("place = 1")
    every = Window.orderBy("range")
    ends = starts.select("range", F.coalesce(F.lead("key").over(every), F.first("key").over(every.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return (ranged.withColumn("next", F.lead(key).over(within)).join(F.broadcast(ends), "range")
            .withColumn("next", F.coalesce("next", "after")).drop("range", "after"))


def with_next(docs: DataFrame) -> DataFrame:
    """Row per document of `docs` (doc_id, text): doc_id, text, n_chars, head (the start of the next text that replaces
    the end of this one), next_hashes (anchors of the next text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("n_chars", F.length("text").cast("long")).withColumn("digest", F.xxhash64("text"))
    narrow = stage(rows.groupBy("doc_id", "digest").agg(F.first("n_chars").alias("n_chars")), "keys")
    pairs = stage(neighbours(narrow).select(
        F.col("next.doc_id").alias("_next"), F.col("next.digest").alias("_digest"), F.col("doc_id").alias("for_id"),
        F.col("digest").alias("for_digest"), F.expr("int(n_chars div 3)").alias("take")), "pairs")
    texts = rows.dropDuplicates(["doc_id", "digest"]) if narrow.count() < docs.count() else rows
    sent = (texts.join(small(pairs), F.col("doc_id").eqNullSafe(F.col("_next")) & (F.col("digest") == F.col("_digest")))
            .select("for_id", "for_digest", F.left("text", F.col("take")).alias("head"), hashes(F.col("text")).alias("next_hashes")))
    return (rows.join(sent, F.col("doc_id").eqNullSafe(F.col("for_id")) & (F.col("digest") == F.col("for_digest")))
            .select("doc_id", "text", "n_chars", "head", "next_hashes"))


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edit, and how like they are to each other and to the next document's."""
    docs = with_next(table(spark, sf_dir, "documents"))
    edited = F.concat(F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")), F.col("head"))
    return (docs.withColumn("edited", edited).drop("head")
            .withColumn("own", hashes(F.col("text"))).withColumn("changed", hashes(F.col("edited")))
            .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
                    fingerprint(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                    likeness(F.col("own"), F.col("next_hashes")).alias("near_next")))
