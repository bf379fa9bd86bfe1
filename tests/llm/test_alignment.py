"""Alignment of two tokenizers, and perfect hashing."""

import hashlib
import random

import brute
import numpy as np
import pytest

from capsule.llm import alignment, perfect, queries

FILES = alignment.tokenizer_files()


@pytest.fixture(scope="module")
def plain():
    t = alignment.Tokenizers(*FILES)

    def run(rows):
        return brute.aligned(rows, lambda x: t.a.encode(x, add_special_tokens=False).ids, lambda x: t.b.encode(x), t.a_bytes, t.b_bytes)
    return run


def rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect()), key=str)


def odd_texts():
    rng = random.Random(5)
    pieces = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "!", "▁", "x1", "'s", "é", "é", "日本",
              "\U0001F642", "<s>", "<|endoftext|>", "<0x0A>", "ﬁ", "Ａ", "\x00", "\u200b", "12", "...", "Hello"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(1500)]
    texts += ["".join(rng.choices([" ", "\n", "a", "!", "\t", "\xa0", "\x1c"], k=7)) for _ in range(800)]
    return texts + [" ", "  ", "\n", " \n", "a ", "a  ", "\x85", "日本語" * 400]


def test_words_are_encoded_as_the_whole_text(monkeypatch, docs):
    own = alignment.Encoder(*FILES)
    t = own.tokenizers
    assert t.by_words and t.quick
    texts = odd_texts() + [x for _, x, _ in docs[1]]
    for span, kept in ((1 << 22, 1 << 20), (9, 50)):
        monkeypatch.setattr(alignment, "SPAN", span)
        monkeypatch.setattr(alignment, "KEPT", kept)
        found = list(own.encode(texts))
        assert len(found) == len(texts)
        for text, ids in zip(texts, found):
            if not text or "▁" in text:
                # a text with the sign that stands for a space never has its own bytes again
                assert ids is None
                continue
            a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            if t.has_bytes(a, b, b" " + text.encode()):
                assert [np.frombuffer(x, np.uint16).tolist() for x in ids] == [a, b], text
            else:
                assert ids is None


def test_alignment(spark, root, docs, plain):
    want = sorted(plain([(i, t) for i, t, _ in docs[1]]), key=str)
    assert rows(alignment.align(docs[0], FILES)) == want
    got = {r.doc_id: r for r in queries.QUERIES["op13_token_alignment"](spark, root).collect()}
    for i, *numbers, groups in want:
        r = got[i]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_alignment_of_odd_texts(spark, plain):
    texts = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (7, "again"), (7, "again"), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_a int, groups string").repartition(5)
    want = sorted(plain(texts), key=str)
    assert rows(alignment.align(df, FILES)) == want
    assert any(w[1] == 0 for w in want) and alignment.align(df.limit(0), FILES).count() == 0


def test_slices_change_nothing(spark, docs, monkeypatch):
    some = docs[0].repartition(6)
    want = rows(alignment.align(some, FILES))
    for name, value in (("PART_PAIRS", 1 << 10), ("SLICE_PARTS", 2), ("FAN", 2)):
        monkeypatch.setattr(alignment, name, value)
    ids = alignment.encoded(some.select(alignment.F.col("doc_id").alias("key"), "text"), spark.sparkContext.broadcast(FILES))
    assert len(alignment.PairCounts(ids, spark.sparkContext.broadcast(alignment.Lengths(FILES))).slices) > 2
    assert rows(alignment.align(some, FILES)) == want


def test_windows_change_nothing(docs):
    lengths = alignment.Lengths(FILES)
    ids = [x or (b"", b"") for x in alignment.Encoder(*FILES).encode([t for _, t, _ in docs[1]][:60] + [None, "日本語 の text"])]
    a, b = [x[0] for x in ids], [x[1] for x in ids]

    def run(window):
        total, groups, pairs = np.zeros((len(ids), 4), np.int64), [b""] * len(ids), []
        for at, n, w, more in alignment.windows(lengths, a, b, window):
            total[at:at + n] += w.sums(n)
            pairs.append(w.pairs)
            for k, g in enumerate(w.groups(n), at):
                groups[k] = groups[k] + b";" + g if more else g
        return total.tolist(), groups, np.concatenate(pairs).tolist()
    want = run(1 << 20)
    assert run(1) == want and run(7) == want and run(1000) == want


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
        levels = perfect.build(keys)
        held = perfect.PerfectHash(levels)
        assert held.n == n and sorted(held.slots(keys).tolist()) == list(range(n))
        assert sum(len(x) for x in levels) * 64 <= 4 * n + 64 * 40
