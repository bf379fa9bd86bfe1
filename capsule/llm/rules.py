"""Quality rules: plain counts, and the log-likelihood ratio of hashed n-grams between a trusted target and the corpus.

Every word and every pair of neighbouring words is hashed to one of BUCKETS buckets. Counts over all documents give the
raw multinomial, counts over the documents that are trusted (labelled good) the target; both are smoothed by one
occurrence a bucket. A document's score is the mean of log(target / raw) over its n-grams; it passes from a fixed
threshold on, with no chance involved.

Everything is built-in functions: the counts shuffle one row per bucket and task, the table of ratios has a fixed size
and enters the scan of the documents as a scalar, and scoring shuffles nothing.

Defined cases. Null or empty text: no words; base_failed, as it has fewer than ten. A text without n-grams has score 0.
Equal rows: equal results; each row counts for the corpus. No label, or none of a document in the table: the target is
flat after smoothing, and scores say how common a text's n-grams are not; with an empty target all scores are 0. Null
labels are not trusted. Columns of the input stay; input columns named like an added one are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.llm.common import bind, small, table, words
from capsule.sources.staging import stage

BUCKETS = 1 << 14
#: Mean log-likelihood ratio from which a document passes.
THRESHOLD = -0.1
WINDOW = 5


def _pairs(h: Column, other: Column, step: int) -> Column:
    """Hash of each element with the one `step` places on; as many as there are whole pairs."""
    return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))),
                      F.slice(other, step + 1, F.greatest(F.size(other) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def buckets(h: Column) -> Column:
    """Buckets of all words and pairs of neighbours, from the words' hashes."""
    return F.transform(F.concat(h, _pairs(h, h, 1)), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def repeated_words(h: Column) -> Column:
    """Words in windows of five that occur twice or more in the text."""
    def covered(g: Column) -> Column:
        at = F.sort_array(F.zip_with(g, F.sequence(F.lit(1), F.size(g)), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            # a window repeats if its neighbour in order of hash is equal
            like_next = F.zip_with(s, F.slice(s, 2, n), lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False)))
            like_last = F.concat(F.array(F.lit(False)), F.slice(like_next, 1, n - 1))
            marks = F.zip_with(like_next, like_last, lambda a, b: a | b)
            return F.sort_array(F.filter(F.zip_with(s, marks, lambda a, m: F.when(m, a["i"])), lambda i: i.isNotNull()))

        def length(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
        return bind(bind(at, places), length)

    def count(h: Column) -> Column:
        two = _pairs(h, h, 1)
        return bind(bind(two, lambda t: bind(_pairs(t, t, 2), lambda four: _windows(four, h))),
                    lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
    return bind(h, count)


def _windows(four: Column, h: Column) -> Column:
    last = F.slice(h, WINDOW, F.greatest(F.size(h) - WINDOW + 1, F.lit(0)))
    return F.zip_with(F.slice(four, 1, F.size(last)), last, lambda a, b: F.xxhash64(a, b))


def base_rules(docs: DataFrame) -> DataFrame:
    """`docs` (column text and any others) with `_hash`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_symbols = F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spaces = F.length(text) - F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return (docs.withColumn("_hash", word_hashes(F.col("text")))
            .withColumn("n_words", F.size("_hash").cast("long"))
            .withColumn("word_chars", (F.length(text) - spaces).cast("long"))
            .withColumn("n_symbols", n_symbols.cast("long"))
            .withColumn("n_dup_lines", bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("n_repeat_words", repeated_words(F.col("_hash")))
            .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: `ratios`, the log of target to raw for each bucket, in order. `docs` has doc_id and text, `labels`
    doc_id and quality."""
    trusted = stage(labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct(), "trusted")
    grams = (docs.join(small(trusted), F.col("doc_id") == F.col("_id"), "left")
             .select(F.col("_id").isNotNull().cast("long").alias("target"), F.explode(buckets(word_hashes(F.col("text")))).alias("bucket")))
    counts = stage(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")), "counts")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    raw_all, target_all = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target_all:
        ratio = F.lit(0.0)
    else:
        ratio = (F.log((F.coalesce("target", F.lit(0)) + 1) / F.lit(float(target_all + BUCKETS)))
                 - F.log((F.coalesce("raw", F.lit(0)) + 1) / F.lit(float(raw_all + BUCKETS))))
    return (every.join(counts, "bucket", "left").select("bucket", ratio.alias("ratio"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("ratios")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` (doc_id, text and any others) with the counts and base_failed, score and kept."""
    fixed = stage(ratios(docs, labels), "ratios")
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")

    def mean(b: Column) -> Column:
        total = F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(F.col("_ratios"), x))
        return F.when(F.size(b) > 0, total / F.size(b)).otherwise(F.lit(0.0))
    return (base_rules(docs.drop(*added)).withColumn("_ratios", fixed.select("ratios").scalar())
            .withColumn("score", bind(buckets(F.col("_hash")), mean)).drop("_hash", "_ratios")
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)))


def op9_quality_rules(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and verdict of every document; the target is what `labels.quality` marks as good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels"), threshold).drop("text")
