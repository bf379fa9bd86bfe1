"""Secret scans over a trigram inverted index.

Each rule's expression gives a Boolean trigram query. The index holds, for every trigram that some rule asks for, the
documents whose text has it; a posting list is kept per block of a bounded number of documents, so no list grows with
the corpus. A rule's postings are intersected within each block, and only its candidates are searched with its
expression; rules without a mandatory trigram search every text. All of it is built-in functions; texts are read twice
and are moved only if the candidates are too many to broadcast.

Spans count code points, end exclusive. Matches of one kind are leftmost and do not overlap; those whose secret part is
too short are dropped after matching.

Defined cases. Null text: as empty, no spans. Null or repeated doc_id: candidates are found by the hash of doc_id, which
rows with equal ids share; every row is searched in its own text. Spans of different kinds may overlap; equal starts go
by the order of the rules. Empty table: empty result. Columns of the input stay; input columns named like an added one
are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.llm.common import bind, small, table
from capsule.llm.trigrams import query
from capsule.sources.staging import stage

#: Documents in one block of the index, about.
BLOCK_DOCUMENTS = 4096
#: Elements of an array that are summed in a row, and characters of a text that are cut out at a time.
RUN, PIECE = 256, 1024


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group that holds the secret, and its least length.
    group: int = 0
    least: int = 0

    @property
    def plain(self) -> str:
        """The expression without possessive repetition, for engines that never go back; it has the same matches."""
        return re.sub(r"(?<=[*+?}])\+", "", self.pattern)


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # runs of 16 or more are whole runs: a run is never cut
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # a bounded head: a long run of the class is not searched again from each of its places
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,256}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # to its end line, or else over the base64 lines that follow; possessive, so that no line stays on a stack
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}[^-]++){0,16}+-----END [A-Z ]{0,20}PRIVATE KEY-----"
         r"|(?:[\x20\t\r\n]*+[A-Za-z0-9+/=]{20,}+)*+(?:[\r\n]+[A-Za-z0-9+/]{1,19}={1,2})?)"),
    Rule("url_password", r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9_.-]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE + MORE


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Rows (block, trigram, keys): hashes of the doc_ids of the block whose text has the trigram."""
    blocks = max(1, -(-docs.count() // BLOCK_DOCUMENTS))
    found = [F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]
    postings = (docs.select(F.xxhash64("doc_id").alias("key"), F.lower("text").alias("_low"))
                .select("key", F.explode(F.array(*found)).alias("trigram")).where("trigram is not null"))
    return (postings.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram")
            .agg(F.collect_set("key").alias("keys")))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (key, mask): for each document the rules (bits of mask) whose trigram query its postings satisfy."""
    none = F.array().cast("array<bigint>")

    def fold(parts: list[Column], join) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out

    def matching(clauses) -> Column:
        posting = lambda t: F.coalesce(F.col("by_trigram")[t], none)
        either = [fold([fold([posting(t) for t in sorted(grams)], F.array_intersect) for grams in clause], F.array_union)
                  for clause in clauses]
        return fold(either, F.array_intersect)
    asked = [(i, query(r.pattern)) for i, r in enumerate(rules)]
    hits = F.array(*[F.struct(F.lit(1 << i).alias("bit"), matching(q).alias("keys")) for i, q in asked if q])
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("by_trigram"))
    return (blocks.select(F.explode(hits).alias("hit")).select("hit.bit", F.explode("hit.keys").alias("key"))
            .groupBy("key").agg(F.bit_or("bit").alias("mask")))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Array of the sums (by `join`; of numbers from 0 on) of the first 1, 2, ... elements. Runs of RUN elements are summed
    by themselves, then the runs, so that no long array is copied for each element."""
    none = F.array().cast("array<int>")

    def sums(a: Column) -> Column:
        first = F.struct(F.lit(0).alias("sum"), none.alias("all"))

        def step(s: Column, x: Column) -> Column:
            return bind(join(s["sum"], x), lambda y: F.struct(y.alias("sum"), F.concat(s["all"], F.array(y)).alias("all")))
        return F.aggregate(a, first, step, lambda s: s["all"])

    def by_runs(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(RUN))
        runs = F.transform(starts, lambda i: sums(F.slice(v, i, RUN)))

        def joined(r: Column) -> Column:
            before = bind(sums(F.transform(r, lambda x: F.element_at(x, -1))), lambda t: F.transform(r, lambda x, i: F.when(i > 0, F.get(t, i - 1)).otherwise(0)))
            return F.flatten(F.zip_with(r, before, lambda x, b: F.transform(x, lambda y: join(b, y))))
        return F.when(F.size(v) > RUN, bind(runs, joined)).otherwise(sums(v))
    return bind(values, by_runs)


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, stop) of a rule's matches, from the texts between and of the matches."""
    pattern = F.lit(rule.pattern)

    def places(between: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
        secret = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else found
        steps = F.arrays_zip(F.transform(F.slice(between, 1, F.size(between) - 1), F.length).alias("gap"), found.alias("size"), secret.alias("secret"))

        def span(steps: Column) -> Column:
            stops = running(F.transform(steps, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
            spans = F.zip_with(steps, stops, lambda x, stop: F.struct((stop - x["size"]).alias("start"), stop.alias("stop"), x["secret"].alias("secret")))
            return F.filter(spans, lambda x: x["secret"] >= rule.least)
        return bind(steps, span)
    return bind(F.split(text, rule.pattern, -1), places)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`docs` (doc_id, text and any others) with `found`: array of (start, kind number, stop) in order."""
    queries = [query(r.pattern) for r in rules]
    asked = sorted({t for q in queries for clause in q for grams in clause for t in grams})
    docs = docs.drop("found", "_key", "_mask")
    text = F.coalesce(F.col("text"), F.lit(""))
    if asked:
        index = stage(build_index(docs.select("doc_id", "text"), asked), "postings")
        who = stage(candidates(index, rules), "candidates").select(F.col("key").alias("_key"), F.col("mask").alias("_mask"))
        marked = docs.join(small(who), F.xxhash64("doc_id") == F.col("_key"), "left")
    else:
        marked = docs.withColumn("_mask", F.lit(0))
    kept = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop"))
    kinds = []
    for i, (rule, q) in enumerate(zip(rules, queries)):
        chosen = F.col("_mask").bitwiseAND(1 << i) != 0 if q else text.rlike(rule.pattern)
        kinds.append(F.when(chosen, F.transform(spans_of(text, rule), kept(i))))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return marked.withColumn("found", F.sort_array(F.concat(*[F.coalesce(k, empty) for k in kinds]))).drop("_key", "_mask")


def written(found: Column, rules: Sequence[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """Text with every span, overlapping ones together, replaced by `mark`."""
    def masked(blocks: Column, spans: Column, stops: Column) -> Column:
        def piece(start: Column, stop: Column) -> Column:
            """Characters start..stop, from the blocks they are in."""
            first = F.floor(start / PIECE).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor((stop - 1) / PIECE).cast("int") - first + 1, F.lit(0))), "")
            return F.substring(held, F.pmod(start, F.lit(PIECE)) + 1, stop - start)

        def part(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(stops, i - 1)).otherwise(0)
            return F.when(x["start"] >= before, F.concat(piece(before, x["start"]), F.lit(mark))).otherwise("")
        return F.concat(F.array_join(F.transform(spans, part), ""), piece(F.element_at(stops, -1), F.length(text)))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    whole = bind(blocks, lambda b: bind(found, lambda s: bind(running(F.transform(s, lambda x: x["stop"]), F.greatest), lambda t: masked(b, s, t))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, digest of their spans, all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(written(base, RULES), 256).alias("base_sha256"), written(F.col("found"), RULES).alias("spans"))
