"""A block of documents is put together in memory of a few numbers per word."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fairlead.llm import bytebpe


def test_reassembled_blocks_read_off_by_position_in_little_memory():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, *rng.integers(0, 6000, 996), 0, 1 << 20], np.int32)
    used = rng.integers(0, 50_000, int(counts.sum())).astype(np.uint32)
    place, sizes = rng.permutation(50_000).astype(np.uint32), rng.integers(0, 4, 50_000)
    flat = rng.integers(0, 1 << 16, int(sizes.sum())).astype("<u4")
    packed = {"places": [bytebpe._packed(place)], "sizes": [bytebpe._packed(sizes)], "ids": [bytebpe._packed(flat)]}
    docs = pa.array([[None, *range(1, len(counts))]], pa.list_(pa.int64()))
    blocks = pa.table({"doc_ids": docs, "counts": pa.array([counts.tolist()], pa.list_(pa.int32())), "places": pa.array([bytebpe._packed(used)], pa.binary())})
    tracemalloc.start()
    got = bytebpe._reassemble(pa.table(packed), blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 34 * len(used)  # 45 before

    of = dict(zip(place.tolist(), np.split(flat, np.cumsum(sizes)[:-1])))
    at = 0
    for r, (n, doc_id) in enumerate(zip(counts.tolist(), docs[0].as_py())):
        want = b"".join(of[w].tobytes() for w in used[at : at + n].tolist())
        assert (got["doc_id"][r].as_py(), got["n_tokens"][r].as_py(), got["ids"][r].as_py()) == (doc_id, len(want) // 4, want)
        at += n
