"""Tokens of two tokenizers aligned by their bytes, with counts of linked pairs over the whole corpus.

Both encodings cut the same bytes. Where both end is the end of a group; an A token and a B token are linked if they
share bytes. Texts are encoded once: neither tokenizer joins a single space before a sign with what stands before it (the
byte-level pattern splits there, and no piece of the other vocabulary spans it), so the words of a text are encoded alone and
a worker keeps those it has met; a text with other white space around its spaces is encoded whole. Ids are written, two
bytes each, and everything after that is array arithmetic on blocks of documents.

1. The first pass aligns the documents and counts linked pairs for each task. The distinct pairs are dealt by hash to parts
   of about PART_PAIRS, and each part gets a minimal perfect hash, built in a group of its own, with its keys in the order
   of their slots.
2. The counts of the tasks become dense vectors indexed by the hash, one vector a part and task. Vectors are summed in a
   tree, FAN at a time, so that no task ever holds more than FAN of them.
3. The second pass aligns the documents again and looks the counts up; a pair's key is verified at its slot.

The distinct pairs are fewer than the product of the vocabularies, but that may be too many for every worker. Parts are
therefore broadcast in slices of SLICE_PARTS parts (4 million pairs, about 50 MB); more pairs cost more second passes, whose
sums are added by row.

Defined cases. Null or empty text, or one whose joined token bytes differ from space + text: no tokens, zeros, groups '', and
nothing counted. Very long texts: encoded SPAN characters at a time, aligned in windows of WINDOW tokens. Repeated rows: each
gives a row and counts. Null doc_id: kept. Empty table: empty result. Other columns are not used.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsule.llm.common import table
from capsule.llm.hashed import mixed
from capsule.llm.perfect import PerfectHash, build
from capsule.sources.staging import stage

PART_PAIRS, SLICE_PARTS, FAN = 1 << 16, 64, 16
#: Words that a worker keeps, characters of a text that are encoded at a time, tokens that are aligned at a time.
KEPT, SPAN, WINDOW = 150_000, 1 << 22, 1 << 18
UNSEEN = -2
#: A space that does not stand alone before a sign: white space in the widest sense, or the end, follows it.
LOOSE = re.compile(r" (?:[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\Z)")


def byte_of_sign() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        sign = byte_of_sign()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        spec = json.loads(a)
        split = spec.get("pre_tokenizer") or {}
        regular = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not spec.get("normalizer")
        self.by_words = regular and not any(re.search("[^▁]▁| ", p) for p in pieces)
        self.quick = self._ranked(spec["model"], sign) if regular else None

    def _ranked(self, model: dict, sign: dict[str, int]):
        """The same encoding by ranks, where every merge makes the token of the next id."""
        import public_tokenizers
        import tiktoken
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if model["type"] != "BPE" or any(model["vocab"].get("".join(m)) != len(sign) + i for i, m in enumerate(parts)):
            return None
        ranks = {self.a_bytes[i]: i for t, i in model["vocab"].items() if i < len(sign) + len(parts)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick:
            return [self.quick.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def has_bytes(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))


class _Places(dict):
    """Places of words; unknown ones are given the next place and wait to be encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word):
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Ids of texts, from the ids of words met before."""

    def __init__(self, a: bytes, b: bytes):
        self.tokenizers = Tokenizers(a, b)
        self.clear()

    def clear(self):
        self.places, self.usable = _Places(), np.zeros(0, bool)
        self.ids = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]  # of all words, A and B
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]  # where each word's begin

    def _encode_new(self):
        t, words = self.tokenizers, self.places.new
        found = t.encode_a([" " + w for w in words]), t.b.encode(words, num_threads=1)
        good = [t.has_bytes(a, b, b" " + w.encode()) for w, a, b in zip(words, *found)]
        self.usable = np.concatenate((self.usable, np.array(good, bool)))
        for i, ids in enumerate(found):
            sizes = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.first[i] = np.concatenate((self.first[i], self.first[i][-1] + sizes))
            self.ids[i] = np.concatenate((self.ids[i], np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes[-1]))))
        words.clear()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes] | None]:
        """For each text its A and B ids as 16-bit numbers, or None."""
        t, short = self.tokenizers, []
        for text in texts:
            # runs of short texts by words share the encoding of new words
            if text and t.by_words and len(text) <= SPAN and not LOOSE.search(" " + text):
                short.append(text)
                if len(short) < 64:
                    continue
            yield from self._by_words(short, len(short))
            if not short or short[-1] is not text:
                yield self._one(text)
            short = []
        yield from self._by_words(short, len(short))

    def _one(self, text: str | None) -> tuple[bytes, bytes] | None:
        t = self.tokenizers
        if not text:
            return None
        if t.by_words and not LOOSE.search(" " + text):
            parts, at = [], 0
            while at <= len(text):
                stop = text.find(" ", at + SPAN)
                parts.append(text[at:stop if stop >= 0 else len(text)])
                at = stop + 1 if stop >= 0 else len(text) + 1
            found = [next(self._by_words([p], 1)) for p in parts]
            return None if None in found else tuple(b"".join(x) for x in zip(*found))
        a, b = t.encode_a([" " + text])[0], t.b.encode(text)
        return (np.array(a, np.uint16).tobytes(), np.array(b, np.uint16).tobytes()) if t.has_bytes(a, b, b" " + text.encode()) else None

    def _by_words(self, texts: list[str], n: int) -> Iterator[tuple[bytes, bytes] | None]:
        if not n:
            return
        if len(self.places) > KEPT:
            self.clear()
        words = [x.split(" ") for x in texts]
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if self.places.new:
            self._encode_new()
        stops = np.cumsum([len(w) for w in words])
        good = np.logical_and.reduceat(self.usable[at], np.concatenate(([0], stops[:-1])))
        out = []
        for ids, first in zip(self.ids, self.first):
            size = first[at + 1] - first[at]
            ends = np.cumsum(size)
            taken = ids[np.repeat(first[at] - (ends - size), size) + np.arange(ends[-1])]
            cut = [0, *ends[stops - 1].tolist()]
            out.append([taken[i:j].tobytes() for i, j in zip(cut, cut[1:])])
        for ok, a, b in zip(good, *out):
            yield (a, b) if ok else None


_kept: dict[str, Encoder] = {}


def encoder(files: tuple[bytes, bytes]) -> Encoder:
    """One for each Python worker and pair of files: later tasks find the words of earlier ones."""
    name = hashlib.sha256(files[0] + files[1]).hexdigest()
    if name not in _kept:
        _kept.clear()
        _kept[name] = Encoder(*files)
    return _kept[name]


def encoded(docs: DataFrame, files) -> DataFrame:
    """`key` of `docs` (key, text) with the ids `a` and `b`, null where the text has no tokens."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches):
        own = encoder(files.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = list(own.encode(part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([part["key"], *[pa.array([x and x[i] for x in ids], pa.binary()) for i in (0, 1)]], ["key", "a", "b"])
    return docs.select("key", "text").mapInArrow(run, f"key {kind}, a binary, b binary")


class Lengths:
    """Bytes of each token of A and B."""

    def __init__(self, files: tuple[bytes, bytes]):
        t = Tokenizers(*files)
        self.a, self.b = (np.array([len(x) for x in side], np.int64) for side in (t.a_bytes, t.b_bytes))
        self.width = len(self.b)


class Window:
    """Alignment of some texts side by side: `a`, `b` ids, `at_a`, `at_b` the text of each token; bytes agree text by text."""

    def __init__(self, lengths: Lengths, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray):
        self.a, self.b, self.at_a, self.at_b = a, b, at_a, at_b
        self.end_a, self.end_b = np.cumsum(lengths.a[a]), np.cumsum(lengths.b[b])
        ends = np.concatenate((self.end_a, self.end_b))
        ends.sort(kind="stable")
        new = np.ones(len(ends), bool)
        new[1:] = ends[1:] != ends[:-1]
        #: ends of links and of groups; places of a link's tokens
        self.ends = ends[new]
        self.cuts = ends[1:][~new[1:]]
        self.i, self.j = np.searchsorted(self.end_a, self.ends), np.searchsorted(self.end_b, self.ends)
        self.pairs = a[self.i].astype(np.uint64) * np.uint64(lengths.width) + b[self.j].astype(np.uint64)

    def sums(self, n: int, *of_links: np.ndarray) -> np.ndarray:
        """By text (0..n-1): A tokens, B tokens, groups, links, and the sums of values of the links."""
        link = self.at_a[self.i]
        group = self.at_a[np.searchsorted(self.end_a, self.cuts)]
        first = np.searchsorted(link, np.arange(n + 1))
        out = [np.bincount(x, minlength=n) for x in (self.at_a, self.at_b, group, link)]
        for values in of_links:
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
            out.append(total[first[1:]] - total[first[:-1]])
        return np.stack(out, axis=1)

    def groups(self, n: int) -> list[bytes]:
        """By text the groups, written out."""
        key = np.concatenate((2 * np.searchsorted(self.cuts, self.end_a), 2 * np.searchsorted(self.cuts, self.end_b) + 1))
        order = np.argsort(key, kind="stable")
        key, ids, text = key[order], np.concatenate((self.a, self.b))[order], np.concatenate((self.at_a, self.at_b))[order]
        signs, kept = _SIGNS[ids], _KEPT[ids]
        after = np.full(len(ids), ord(";"), np.uint8)
        after[:-1][key[1:] == key[:-1]] = ord(",")
        after[:-1][(key[1:] == key[:-1] + 1) & (key[1:] % 2 == 1)] = ord("|")
        signs[:, 5] = after
        last = np.searchsorted(text, np.arange(n), "right") - 1
        some = np.bincount(text, minlength=n) > 0
        kept[last[some], 5] = False
        written = signs[kept].tobytes()
        size = np.cumsum(kept.sum(axis=1))
        first = np.searchsorted(text, np.arange(n))
        start = np.where(first > 0, size[first - 1], 0)
        return [written[start[k]:size[last[k]]] if some[k] else b"" for k in range(n)]


# decimal digits of 0..65535 and which of them are written; the last place is for the sign that follows
_NUMBERS = np.arange(1 << 16)
_SIGNS = np.stack([*(_NUMBERS // 10 ** k % 10 + 48 for k in (4, 3, 2, 1, 0)), _NUMBERS * 0], axis=1).astype(np.uint8)
_KEPT = np.stack([*((_NUMBERS >= 10 ** k) | (k == 0) for k in (4, 3, 2, 1, 0)), _NUMBERS >= 0], axis=1)


def windows(lengths: Lengths, a: list[bytes], b: list[bytes], window: int | None = None) -> Iterator[tuple[int, int, Window, bool]]:
    """(first text, number of texts, window, whether it goes on with the text before): all texts, as many at a time as have
    about `window` tokens; a longer text is cut at ends of groups."""
    window, at = window or WINDOW, 0
    while at < len(a):
        stop, size = at, 0
        while stop < len(a) and (stop == at or size + len(a[stop]) + len(b[stop]) <= 2 * window):
            size += len(a[stop]) + len(b[stop])
            stop += 1
        x, y = (np.frombuffer(b"".join(s[at:stop]), np.uint16).astype(np.int64) for s in (a, b))
        n = stop - at
        if n > 1 or size <= 2 * window:
            if len(x):
                yield at, n, Window(lengths, x, y, *(np.repeat(np.arange(n), [len(t) // 2 for t in s[at:stop]]) for s in (a, b))), False
        else:
            step, more = window, False
            while len(x):
                # the part of both that ends with the last common end of this step
                end_x, end_y = np.cumsum(lengths.a[x[:step]]), np.cumsum(lengths.b[y[:step]])
                common = np.intersect1d(end_x, end_y, assume_unique=True)
                if not len(common):
                    step *= 2
                    continue
                i, j = np.searchsorted(end_x, common[-1]) + 1, np.searchsorted(end_y, common[-1]) + 1
                yield at, 1, Window(lengths, x[:i], y[:j], np.zeros(i, np.int64), np.zeros(j, np.int64)), more
                x, y, step, more = x[i:], y[j:], window, True
        at = stop


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    """Batches of at most 256 rows with their ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, [x or b"" for x in part["a"].to_pylist()], [x or b"" for x in part["b"].to_pylist()]


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with the sums of their times."""
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pair, which = np.unique(np.concatenate(pairs), return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, which, np.concatenate(times))
    return pair, n


def task_counts(ids: DataFrame, lengths) -> DataFrame:
    """Rows (pair, mix, n): the links of each task by pair, and the pair's hash."""
    def run(batches):
        pairs, times, held = [], [], 0
        for _, a, b in _parts(batches):
            for _, _, w, _ in windows(lengths.value, a, b):
                p, n = np.unique(w.pairs, return_counts=True)
                pairs.append(p)
                times.append(n)
                held += len(p)
                if held > 1 << 20:
                    p, n = _added(pairs, times)
                    pairs, times, held = [p], [n], 0
        pair, n = _added(pairs, times)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array((mixed(pair) >> np.uint64(1)).astype(np.int64)), pa.array(n)], ["pair", "mix", "n"])
    return ids.select("a", "b").mapInArrow(run, "pair long, mix long, n long")


def hashes(pairs: DataFrame, parts: int) -> DataFrame:
    """Row per part: its levels (words side by side, and how many each level has) and its pairs in the order of slots."""
    def run(t: pa.Table) -> pa.Table:
        keys = t["pair"].to_numpy().astype(np.uint64)
        levels = build(keys)
        order = np.argsort(PerfectHash(levels).slots(keys))
        return pa.table({"part": t["part"].slice(0, 1).cast(pa.int32()), "sizes": pa.array([np.array([len(x) for x in levels], np.int64).tobytes()]),
                         "words": pa.array([np.concatenate(levels).tobytes()]), "pairs": pa.array([keys[order].astype(np.uint32).tobytes()])})
    dealt = pairs.select("pair", F.pmod("mix", F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInArrow(run, "part int, sizes binary, words binary, pairs binary")


class Slice:
    """Hashes and keys of some parts; a pair's slot counts on from part to part."""

    def __init__(self, rows: list, parts: int):
        self.parts, self.part, self.first, self.n = parts, {}, {}, 0
        keys = []
        for r in sorted(rows, key=lambda r: r.part):
            words, sizes = np.frombuffer(r.words, np.uint64), np.frombuffer(r.sizes, np.int64)
            self.part[r.part] = PerfectHash(np.split(words, np.cumsum(sizes)[:-1]))
            self.first[r.part] = self.n
            keys.append(np.frombuffer(r.pairs, np.uint32))
            self.n += len(keys[-1])
        self.keys = np.concatenate(keys)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """Verified slots of pairs; -1 for those of other slices, UNSEEN for one that belongs here but is not a key."""
        part = ((mixed(pairs) >> np.uint64(1)) % np.uint64(self.parts)).astype(np.int64)
        out = np.full(len(pairs), -1, np.int64)
        for p in np.unique(part):
            if p in self.part:
                at = np.flatnonzero(part == p)
                slot = self.part[p].slots(pairs[at])
                known = (slot >= 0) & (self.keys[slot + self.first[p]] == pairs[at])
                out[at] = np.where(known, slot + self.first[p], UNSEEN)
        return out


def sums(counts: DataFrame, held) -> np.ndarray:
    """Counts of a slice's pairs by slot: dense vectors of the tasks, summed in a tree."""
    def run(batches):
        known: Slice = held.value
        total = np.zeros(known.n, np.int64)
        for batch in batches:
            slot = known.slots(batch["pair"].to_numpy().astype(np.uint64))
            if (slot == UNSEEN).any():
                raise ValueError("a pair of tokens that the first pass did not see")
            np.add.at(total, slot[slot >= 0], batch["n"].to_numpy()[slot >= 0])
        me, stops = TaskContext.get().partitionId(), [*list(known.first.values())[1:], known.n]
        for (part, start), stop in zip(known.first.items(), stops):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([me], pa.int32()), pa.array([total[start:stop].tobytes()])],
                                             ["part", "node", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in t["counts"])
        return pa.table({"part": t["part"].slice(0, 1), "node": t["node"].slice(0, 1), "counts": pa.array([total.tobytes()])})
    schema = "part int, node int, counts binary"
    level, tasks = counts.select("pair", "n").mapInArrow(run, schema), counts.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN)
        level = level.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("part", "node").applyInArrow(add, schema)
    total = np.zeros(held.value.n, np.int64)
    for r in level.toLocalIterator():
        n, start = np.frombuffer(r.counts, np.int64), held.value.first[r.part]
        total[start:start + len(n)] += n
    return total


def looked_up(ids: DataFrame, lengths, held, counts, highest, add_groups: bool) -> DataFrame:
    """Row per row of `ids` with the sums over the links whose pairs are in the slice."""
    kind = ids.schema["key"].dataType.simpleString()

    def run(batches):
        known, by_slot, top, side = held.value, counts.value, highest.value, lengths.value
        for batch, a, b in _parts(batches):
            rows, groups = np.zeros((batch.num_rows, 6), np.int64), [b""] * batch.num_rows
            for at, n, w, more in windows(side, a, b):
                pairs, which = np.unique(w.pairs, return_inverse=True)
                slot = known.slots(pairs)
                if (slot == UNSEEN).any():
                    raise ValueError("a pair of tokens that the first pass did not see")
                times = np.where(slot >= 0, by_slot[slot], 0)
                best = (slot >= 0) & (times == top[(pairs % np.uint64(side.width)).astype(np.int64)])
                rows[at:at + n] += w.sums(n, best[which], times[which])
                if add_groups:
                    for k, written in enumerate(w.groups(n), at):
                        groups[k] = groups[k] + b";" + written if more else written
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(c) for c in rows.T], pa.array([g.decode() for g in groups], pa.string())],
                                             ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
    return ids.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def tokenizer_files(a: str | None = None, b: str | None = None) -> tuple[bytes, bytes]:
    """Contents of the two vocabulary files."""
    import public_tokenizers
    return Path(a or public_tokenizers.path("byte_bpe_50k.json")).read_bytes(), Path(b or public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


class PairCounts:
    """Counts of linked pairs over encoded documents: slices as broadcasts, and the highest count of each B id."""

    def __init__(self, ids: DataFrame, lengths):
        context = ids.sparkSession.sparkContext
        counts = stage(task_counts(ids, lengths), "task-counts")
        pairs = stage(counts.select("pair", "mix").distinct(), "distinct-pairs")
        self.n_pairs, width = pairs.count(), lengths.value.width
        parts = -(-self.n_pairs // PART_PAIRS)
        built = stage(hashes(pairs, parts), "perfect-hashes") if parts else None
        self.highest, self.slices = np.zeros(width, np.int64), []
        for first in range(0, parts, SLICE_PARTS):
            held = Slice(built.where((F.col("part") >= first) & (F.col("part") < first + SLICE_PARTS)).collect(), parts)
            held = context.broadcast(held)
            times = sums(counts, held)
            np.maximum.at(self.highest, held.value.keys % width, times)
            self.slices.append((held, context.broadcast(times)))


def align(docs: DataFrame, files: tuple[bytes, bytes]) -> DataFrame:
    """Row per row of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    n_best counts the links whose pair has the highest count of its B id; count_sum adds the counts of all links;
    groups lists the ids of each group (`a1,a2|b1;a3|b2`)."""
    context = docs.sparkSession.sparkContext
    ids = stage(encoded(docs.select(F.col("doc_id").alias("key"), "text"), context.broadcast(files)), "ids")
    lengths = context.broadcast(Lengths(files))
    counts = PairCounts(ids, lengths)
    if not counts.slices:
        zeros = [F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        return ids.select(F.col("key").alias("doc_id"), *zeros, F.lit("").alias("groups"))
    highest = context.broadcast(counts.highest)
    if len(counts.slices) == 1:
        return looked_up(ids, lengths, *counts.slices[0], highest, True).withColumnRenamed("key", "doc_id")
    numbered = stage(ids.withColumnRenamed("key", "doc_id").withColumn("key", F.monotonically_increasing_id()), "numbered")
    parts = [looked_up(numbered.select("key", "a", "b"), lengths, *s, highest, i == 0) for i, s in enumerate(counts.slices)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    same = ("n_a", "n_b", "n_groups", "n_links", "groups")
    summed = every.groupBy("key").agg(*[F.max(c).alias(c) for c in same], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.select("doc_id", "key").join(summed, "key").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op13_token_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Every document's alignment of byte_bpe_50k (A) and piece_bpe_32k (B)."""
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_files(a, b))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return found.withColumn("groups_sha256", digest).drop("groups")
