"""Language identification by fusing evidence with Bayes' rule.

A page's language gets a posterior from four sources: the likelihood of its text under hashed byte-trigram models, the
language its markup declares, the country suffix of its address, and a prior of its host. Host priors are the mean text
posteriors of the host's other pages, smoothed towards those of its domain, which are smoothed towards those of its
suffix, and these towards all pages. They come from grouped sums, one level from the other; a page's own text is taken
out of every level before it is used, so no evidence counts twice.

Trigram models are fitted on a bounded sample of documents with a known `lang` (parameter `rows`), everything else covers
all pages. The text is read once, in tasks; what is joined and grouped afterwards is a few numbers per page.

Defined cases. Null or empty page, or without letters: the text says nothing, the other sources decide; null address: the
host is null, one group of its own. A declared language that is not known says nothing. Ties go to the first language in
code order. Repeated rows: each is a page of its own. Empty table: empty result. No documents of a language: its model
is flat. Columns of the input stay; input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from capsule.llm.common import bind, small, table
from capsule.sources.staging import stage

LANGUAGES = ("de", "en", "es", "fr")
BITS = 15
#: Documents that the trigram models are fitted on at most.
TRAIN_ROWS = 8_000
#: Trigrams that count in full; those beyond are worth as much together (neighbouring trigrams are not independent).
FULL_TRIGRAMS = 200
#: Chance that declared markup names the right language, and that a country suffix does.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.6
#: Pages that a level's parent weighs as in smoothing.
PARENT_PAGES = 5.0

#: Languages by country suffix.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "ch": "de", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en",
                   "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "fr": "fr", "be": "fr"}

#: what is not read of a page, by the definition; `visible` leaves it out in linear time
_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]{1,10};")
_ENTITY = re.compile(rb"&[#\w]{1,10};")
_UNREAD = re.compile(rb"(?i)<(script|style)\b")
_CLOSING = {x: re.compile(rb"(?i)</" + x + rb"\s*>") for x in (b"script", b"style")}
_HTML = re.compile(rb"(?i)<html\b")
_LANG = re.compile(rb"(?i)\blang\s*=\s*[\"']?([a-z]+)")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SMALL = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_SMALL[65:91] += 32


def visible(html: bytes) -> bytes:
    """What a page shows: scripts, styles, comments, tags and entities are each a space. What is never closed is read on;
    that nothing closes it any more is remembered, so a page is read once."""
    out, done, at, missing = [], 0, html.find(b"<"), set()

    def end_of(what, find) -> int:
        stop = -1 if what in missing else find()
        if stop < 0:
            missing.add(what)
        return stop

    def closed(name: bytes) -> int:
        m = _CLOSING[name].search(html, at)
        return m.end() if m else -1
    while at >= 0:
        stop = -1
        if unread := _UNREAD.match(html, at):
            name = unread.group(1).lower()
            stop = end_of(name, lambda: closed(name))
        if stop < 0 and html.startswith(b"<!--", at):
            stop = end_of("-->", lambda: html.find(b"-->", at + 4)) + 3
            stop = stop if stop > 2 else -1
        if stop < 0:
            stop = html.find(b">", at + 1) + 1
            if not stop:
                break
        out.append(_ENTITY.sub(b" ", html[done:at]))
        done, at = stop, html.find(b"<", stop)
    return b" ".join([*out, _ENTITY.sub(b" ", html[done:])])


def declared_language(html: bytes) -> str | None:
    """The first lang attribute of an html tag."""
    at = 0
    while m := _HTML.search(html, at):
        stop = html.find(b">", m.end())
        at = stop if stop >= 0 else len(html)
        if found := _LANG.search(html, m.end(), at):
            return found.group(1).decode().lower()
    return None


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text, letters in small, runs of other signs as one space."""
    data = _SMALL[np.frombuffer(b" " + text + b" ", np.uint8)]
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
    d = data[kept].astype(np.uint32)
    if len(d) < 3:
        return np.empty(0, np.int64)
    h = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def train(docs: DataFrame, languages: Sequence[str] = LANGUAGES, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log probabilities [language, bucket] from documents (doc_id, text, lang), those of smallest hash of doc_id."""
    known = docs.where(F.col("lang").isin(*languages))
    nth = F.xxhash64("doc_id")
    chosen = known.select(F.col("doc_id").alias("_id"), nth.alias("n")).orderBy("n", "_id").limit(rows).select("_id").distinct()
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                seen.setdefault(lang, np.zeros(1 << BITS, np.int64))
                seen[lang] += np.bincount(trigrams((text or "").encode()), minlength=1 << BITS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])
    counts = texts.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n"))
    model = np.ones((len(languages), 1 << BITS))
    for lang, bucket, n in counts.collect():  # at most languages x buckets rows
        model[languages.index(lang), bucket] += n
    return np.log(model / model.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """`pages` (url, html and any others) with `text_score` (log likelihood by language) and `declared`."""
    held = pages.sparkSession.sparkContext.broadcast(model.astype(np.float32).tobytes())
    kept, n = pages.drop("text_score", "declared"), len(model)
    schema = StructType([*kept.schema.fields, StructField("text_score", ArrayType(DoubleType())), StructField("declared", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.frombuffer(held.value, np.float32).reshape(n, -1)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, scores, said = b.slice(at, 256), [], []
                for html in part.column(part.schema.get_field_index("html")).to_pylist():
                    raw = (html or "").encode()
                    found = trigrams(visible(raw))
                    total = logs[:, found].sum(axis=1, dtype=np.float64) if len(found) else np.zeros(n)
                    scores.append((total * min(1.0, FULL_TRIGRAMS / max(1, len(found)))).tolist())
                    said.append(declared_language(raw))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.list_(pa.float64())), pa.array(said, pa.string())],
                                                 schema.fieldNames())
    return kept.mapInArrow(run, schema)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return bind(F.transform(scores, lambda x: F.exp(x - top)), lambda e: bind(
        F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def _sums(df: DataFrame, by: Sequence[str], n: int, of: str, count: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(F.get(of, i)).alias(f"s{i}") for i in range(n)], F.sum(count).alias("pages")).select(
        *by, F.array(*[f"s{i}" for i in range(n)]).alias("sums"), "pages")


def host_levels(pages: DataFrame, n: int) -> DataFrame:
    """Row per host: sums of text posteriors and pages of the host, its domain, its suffix and of all pages. Each level is
    summed from the one below it."""
    host = _sums(pages, ["host", "domain", "suffix"], n, "own", F.lit(1))
    domain = _sums(host, ["domain", "suffix"], n, "sums", F.col("pages"))
    suffix = _sums(domain, ["suffix"], n, "sums", F.col("pages"))
    total = _sums(suffix, [], n, "sums", F.col("pages")).first()
    out = host.withColumnsRenamed({"sums": "host_sums", "pages": "host_pages"})
    for name, level, keys in (("domain", domain, ["domain", "suffix"]), ("suffix", suffix, ["suffix"])):
        level = level.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("sums").alias(f"{name}_sums"), F.col("pages").alias(f"{name}_pages"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(level, same).drop(*[f"_{k}" for k in keys])
    sums = [float(x or 0.0) for x in total["sums"]] if total else [0.0] * n
    return out.withColumns({"all_sums": F.array(*[F.lit(x) for x in sums]), "all_pages": F.lit(int((total and total["pages"]) or 0))})


def address(url: Column) -> dict[str, Column]:
    """Host of an address, its last two labels, and its last one; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.)?[^.]+$", 0), "suffix": F.regexp_extract(host, r"[^.]+$", 0)}


def identify(pages: DataFrame, model: np.ndarray, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """`pages` (url, html and any others, html left out) with host, declared, text_lang, lang and confidence."""
    n = len(languages)
    seen = text_evidence(pages.drop("host", "domain", "suffix", "own", "lang", "confidence", "text_lang"), model).drop("html")
    narrow = stage(seen.withColumns(address(F.col("url"))).withColumn("own", _softmax(F.col("text_score"))), "language-evidence")
    levels = stage(host_levels(narrow, n), "host-levels").withColumnRenamed("host", "_host").drop("domain", "suffix")
    both = narrow.join(small(levels), F.col("host").eqNullSafe(F.col("_host")))
    prior = F.array(*[F.lit(1.0 / n)] * n)
    for level in ("all", "suffix", "domain", "host"):
        parent = prior

        def smoothed(parent: Column, sums: Column, count: Column) -> Column:
            others = F.zip_with(sums, F.col("own"), lambda s, o: F.greatest(s - o, F.lit(0.0)))
            return F.zip_with(others, parent, lambda s, p: (s + PARENT_PAGES * p) / (count - 1 + PARENT_PAGES))
        prior = smoothed(parent, F.col(f"{level}_sums"), F.col(f"{level}_pages"))

    def says(value: Column, right: float) -> list[Column]:
        known = value.isin(*languages)
        return [F.when(known, F.when(value == x, F.log(F.lit(right))).otherwise(F.log(F.lit((1 - right) / (n - 1))))).otherwise(F.lit(0.0))
                for x in languages]
    country = F.coalesce(*[F.when(F.col("suffix") == k, F.lit(v)) for k, v in SUFFIX_LANGUAGE.items()])
    declared, suffix = says(F.coalesce("declared", F.lit("")), DECLARED_RIGHT), says(F.coalesce(country, F.lit("")), SUFFIX_RIGHT)
    score = bind(prior, lambda p: F.array(*[
        F.get("text_score", i) + F.log(F.get(p, i)) + declared[i] + suffix[i] for i in range(n)]))

    def best(p: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(p, F.array_max(p)).cast("int"))
    done = both.withColumn("_p", _softmax(score))
    return (done.withColumns({"text_lang": best(F.col("text_score")), "lang": best(F.col("_p")), "confidence": F.array_max("_p")})
            .drop("_p", "_host", "own", "domain", "suffix", "text_score", *[f"{x}_{y}" for x in ("all", "suffix", "domain", "host") for y in ("sums", "pages")]))


def op3_language_id(spark: SparkSession, sf_dir: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Language of every page."""
    model = train(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), LANGUAGES, rows)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return identify(pages, model).select("page_id", "host", "declared", "text_lang", "lang", "confidence")
