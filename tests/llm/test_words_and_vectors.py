"""Operators 11 to 13: the tokenizer library, brute force, and edge cases."""

import base64
import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from fairlead.llm import bytebpe, centroids, codes, workload
from fairlead.llm import vectors as vx

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    return workload.vocabulary(workload.MULTI_RANKS)


@pytest.fixture(scope="module")
def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts, spark, path, **more):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, block string")
    encoded = bytebpe.encode(docs, path, public_tokenizers.PATTERN, **more)
    return {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in bytebpe.decode(encoded, path).collect()}


def test_words_equal_the_library(spark, path, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in workload.op11_byte_bpe(spark, DATA).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = np.array(library.encode_ordinary(text or ""), "<u4")
        assert got.pop(doc_id) == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert not got


def test_words_edges(spark, path, library):
    texts = [None, "", " ", "\n\n  \t x", "É ß 😀 <|endoftext|> 漢字かな交じり文", "the the the", "the the the", "\x1c\x85  a", "q" * 40_000, "xqzj" * 50_000, "漢字" * 30_000, " " * 20_000 + "a", "'s'S I'LL don't", "1234567890 ²³"]
    got = ids(texts, spark, path, block_chars=1000)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == (library.encode_ordinary(text or ""), (text or "").encode()), i
    assert ids([], spark, path) == {}
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b")], "doc_id bigint, text string")
    assert sorted(str(r["doc_id"]) for r in bytebpe.encode(nulls, path, public_tokenizers.PATTERN).collect()) == ["5", "None", "None"]


def test_invalid_bytes_and_ids(spark, path):
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    encoded = bytebpe.encode(broken, path, public_tokenizers.PATTERN)
    assert bytes(bytebpe.decode(encoded, path).first()["decoded"]).decode() == "a�b"
    none = spark.sql("SELECT CAST(NULL AS BINARY) AS other")
    assert bytes(bytebpe.decode(none, path, "other").first()["decoded"]) == b""
    with pytest.raises(ValueError, match="no token"):
        bytebpe.Ranks(bytebpe.read_ranks(path)).bytes_of(np.array([10**6]))


def test_pretokens_merge_as_pairs_of_least_rank(path):
    """Against the plain definition: the leftmost pair of least rank, until none has a rank."""
    ranks = bytebpe.Ranks(bytebpe.read_ranks(path))
    rng = np.random.default_rng(3)
    for _ in range(300):
        word = bytes(rng.choice(list(b"aabehint \xc3\xa9"), rng.integers(1, 30)).astype(np.uint8))
        parts = [word[i : i + 1] for i in range(len(word))]
        while word not in ranks.rank:
            found = [(ranks.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks.rank]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks.rank[word]] if word in ranks.rank else [ranks.rank[p] for p in parts]
        assert ranks.ids(word) == want


def test_orchard_equals_brute_force():
    rng = np.random.default_rng(1)
    for k, dims, most in ((1, 3, 5), (2, 1, 3), (40, 64, 300), (17, 2, 4), (30, 3, 1 << 27)):
        centres = rng.integers(-most, most + 1, (k, dims))
        centres[-1] = centres[0]  # equal centroids
        rows = np.concatenate([rng.integers(-most, most + 1, (200, dims)), centres])
        all_ = np.stack([vx.squared(rows, c) for c in centres], axis=1)
        number, distance = centroids.Orchard(centres).nearest(rows)
        assert (number == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()


def test_orchard_looks_at_few_of_far_centroids():
    centres = np.arange(100, dtype=np.int64)[:, None] * 1000
    search = centroids.Orchard(centres)
    looked = []
    plain = vx.squared
    vx.squared = lambda a, b: looked.append(len(a)) or plain(a, b)
    try:
        number, _ = search.nearest(np.full((1, 1), 120))
    finally:
        vx.squared = plain
    assert number[0] == 0 and sum(looked) <= 3


@pytest.mark.parametrize("entries", [1, 2, 16, 64, 65, 200])
def test_slices_equal_brute_force(entries):
    rng = np.random.default_rng(entries)
    for width, most in ((1, 3), (8, 2), (8, 4000), (2, 1 << 27)):
        book = rng.integers(-most, most + 1, (entries, width))
        rows = np.concatenate([rng.integers(-most, most + 1, (300, width)), book])
        all_ = np.stack([vx.squared(rows, c) for c in book], axis=1)
        slices = codes.Slices(book)
        number, distance = slices.nearest(rows)
        assert (number == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
        # Candidates are the entries of the cube, no more and no fewer.
        radius = rng.integers(0, most + 1, len(rows))
        inside = (np.abs(rows[:, None] - book[None]) <= radius[:, None, None]).all(axis=2)
        masks = slices.candidates(rows, radius)
        told = np.stack([masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1) for e in range(entries)], axis=1).astype(bool)
        assert (told == inside).all()


VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, code string, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "d", "e") for i, v, label in rows], VECTORS)


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2, -0.3, 0.4], 1), (1, [0.1, 0.2, -0.3, 0.4], 1), (2, [0.5, 0.2, 0.3, 0.4], None), (None, [0.9, 0.9, 0.9, 0.9], None), (3, None, 1), (4, [], 1), (5, [1.0, None, 0.0, 0.0], 1), (6, [nan, 0.0, 0.0, 0.0], 1), (7, [inf, 0.0, 0.0, 0.0], 1), (8, [1.0, 2.0, 3.0], 1), (9, [3e38, -3e38, 0.0, 0.0], 2)]
    table = vectors(spark, rows)
    got = centroids.cluster(table, 40, 3, 256, 4).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "2", "9", "None"]
    assert {r["distance"] for r in got} == {0} and {r["inertia"] for r in got} == {0}
    one = centroids.cluster(table, 1, 3, 256, 4).collect()
    assert len({r["centroid_sha256"] for r in one}) == 1 and all(r["cluster"] == 0 for r in one)
    assert centroids.cluster(table.limit(0), 40, 5, 256, 4).count() == 0
    coded = codes.compress(table, 2, 16, 3, 4096).collect()
    assert sorted((str(r["vec_id"]), r["error"]) for r in coded) == [("1", 0), ("1", 0), ("2", 0), ("9", 0), ("None", 0)]
    assert all(len(r["code"]) == 4 for r in coded)
    few = codes.compress(table, 2, 1, 3, 4096).collect()
    by_label = {}
    for r in few:
        by_label.setdefault(r["vec_id"], (r["error"], r["label_error"]))
    assert by_label[2][1] == by_label[2][0] + by_label[None][0]  # null labels are one group
    assert codes.compress(table.limit(0), 2, 16, 3, 4096).count() == 0
    assert codes.compress(table.where("vec_id in (3, 5, 6)"), 2, 16, 3, 4096).count() == 0


def test_components_round_down(spark):
    table = vectors(spark, [(1, [-0.001, 0.001, -1.0, 0.999], 1)])
    assert table.select(vx.scaled("embedding", 256, 4).alias("v")).first()["v"] == [-1, 0, -256, 255]
    assert vx.largest(64) == 1 << 27 and 64 * (2 * vx.largest(64)) ** 2 <= 1 << 62
    assert 5 * (2 * vx.largest(5)) ** 2 <= 1 << 62 and math.isqrt(1) == 1


def plain_codes(rows, parts, entries, rounds):
    """rows (n, dims) in order of id."""
    n, dims = rows.shape
    width = dims // parts
    books = [rows[:entries, p * width : (p + 1) * width].copy() for p in range(parts)]
    for t in range(rounds + 1):
        found = [np.array([((x[None] - b) ** 2).sum(axis=1).argmin() for x in rows[:, p * width : (p + 1) * width]]) for p, b in enumerate(books)]
        if t < rounds:
            for p, book in enumerate(books):
                for e in range(len(book)):
                    own = rows[found[p] == e, p * width : (p + 1) * width]
                    if len(own):
                        book[e] = [int(s) // len(own) for s in own.sum(axis=0)]
    return ["".join(f"{found[p][i]:02x}" for p in range(parts)) for i in range(n)], books


def test_codes_equal_a_plain_fit(spark):
    rng = np.random.default_rng(8)
    values = rng.integers(-8, 9, (120, 6)) / 8
    table = vectors(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(values)]).repartition(5)
    want, books = plain_codes(np.floor(values * 16).astype(np.int64), 3, 5, 4)
    got = codes.compress(table, 3, 5, 4, 16).collect()
    assert {r["vec_id"]: r["code"] for r in got} == dict(enumerate(want))
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()}


@pytest.mark.parametrize("name", ["op12_centroids", "op13_vector_codes"])
def test_vector_queries_equal_sql(spark, name):
    from fairlead.workload.check import compare, connect

    assert compare(spark, connect(DATA), name, DATA, workload.queries(), workload.oracle_sql())[:2] == ("ok", 500)


def test_one_hot_label_and_vector(spark):
    rows = [(i, [0.5] * 8, 1) for i in range(3000)] + [(3000 + i, [i / 64] * 8, i) for i in range(40)]
    got = codes.compress(vectors(spark, rows), 8, 16, 2, 4096)
    assert got.count() == 3040 and got.where(F.col("label_error") < F.col("error")).count() == 0
    assert centroids.cluster(vectors(spark, rows), 4, 2, 256, 8).count() == 3040


def test_packed_places_come_back():
    places = np.array([0, 1, 70_000, 1 << 31, 5], np.uint32)
    assert bytebpe._unpacked(bytebpe._packed(places)).tolist() == places.tolist()
    assert pa.types.is_binary(bytebpe._binary(np.zeros(4, np.uint8), np.array([1, 4])).type)
