"""What a Python worker holds beside its rows stays small."""

import tracemalloc

import pyarrow as pa

from capsule.llm import bpe, classifier, hashed


def test_features_of_many_texts_take_blocks_of_bounded_size():
    texts = pa.array([" ".join(f"w{i * j % 977}" for j in range(300)) for i in range(3000)])
    whole = classifier.features([t.as_py().encode() for t in texts[:500]])
    found = []
    tracemalloc.start()
    for at, some in hashed.blocks(texts):
        some = classifier.features(some)
        found += some if at < 500 else []
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(t.as_py()) for t in texts) > 3 << 20 and most < 48 << 20
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole, found))


def test_the_table_of_pieces_stays_bounded():
    encoder = bpe.Encoder(*bpe.vocabulary_file())
    tracemalloc.start()
    for i in range(0, 300_000, 1000):
        encoder.update({f"piece {j}": b"\0" * 12 for j in range(i, i + 1000)})
        encoder.encode("a b")
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(encoder) <= 251_000 and held < 64 << 20
