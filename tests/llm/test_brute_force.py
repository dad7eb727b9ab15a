"""Queries that SQL can't express, against plain brute force on the smallest tables."""

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fairlead.llm import bpe, decontaminate, lattice, packing, toxicity, workload
from fairlead.operators.scan import settle, steps_folder

SF_DIR = os.environ.get("FAIRLEAD_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in workload.table(spark, SF_DIR, "documents").collect()}


def shingle_set(text, n=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_groups(texts, percent):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    group = {k: k for k in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return sets, {k: root(k) for k in texts}


def test_near_duplicates(spark, texts):
    sets, groups = near_groups(texts, 85)
    got = {r["doc_id"]: r for r in workload.op3_minhash_groups(spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for k, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[k]), groups[k], groups[k] == k)
    assert any(k != g for k, g in groups.items())


def test_bpe_like_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(workload.vocabulary(workload.BYTE_BPE))
    got = {r["doc_id"]: r for r in workload.op4_bpe(spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def hits(text, windows):
    words = item_words(text)
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            found = windows.get(tuple(words[i : i + size]))
            if found:
                hit.update(range(i, i + size))
                items |= found
    return words, hit, items


def benchmark_windows(spark):
    windows = {}
    for r in workload.table(spark, SF_DIR, "benchmark").collect():
        words = item_words(r["text"] or "")
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(str(r["item_id"]))
    return windows


def test_decontamination(spark, texts):
    windows = benchmark_windows(spark)
    got = {r["doc_id"]: r for r in workload.op5_decontaminate(spark, SF_DIR).collect()}
    for k, text in texts.items():
        words, hit, items = hits(text, windows)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert any(r["contaminated"] for r in got.values())


def plain_marginal(word, pieces):
    """The forward recursion, one byte after the other; ``pieces``: (bytes, begins a word) -> log P."""
    by = pieces
    alpha = [by[b"", True]] + [None] * len(word)
    for j in range(1, len(word) + 1):
        parts = [by[word[:j], True]] if (word[:j], True) in by else []
        parts += [alpha[i] + by[word[i:j], False] for i in range(j) if (word[i:j], False) in by]
        alpha[j] = float(np.logaddexp.reduce(parts))
    return alpha[-1] / math.log(10)


def test_lattice_scores(spark, texts, monkeypatch):
    kept = {}
    real_fit = lattice.fit_pieces
    monkeypatch.setattr(lattice, "fit_pieces", lambda *a, **k: kept.update(fit=real_fit(*a, **k)) or kept["fit"])
    docs = workload.table(spark, SF_DIR, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in workload.op9_lattice_score(spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    tokens = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    train = [k for k in texts if not held[k]]
    counts = Counter(w for k in train for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    logs, pieces = kept["fit"], lattice.read_weights(workload.vocabulary(workload.PIECES))
    assert abs(np.exp(logs).sum() - 1) < 1e-9
    for k, r in got.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(tokens[k]), sum(w in counts for w in tokens[k]), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    kinds = {x: Counter(w for k in train if lang[k] == x for w in tokens[k]) for x in {lang[k] for k in train}}
    spelled = {}
    first = np.log([w for _, _, w in pieces]) - math.log(sum(w for _, _, w in pieces))
    fitted, given = ({(d, b): p for (d, b, _), p in zip(pieces, x)} for x in (logs, first))
    alone = {}
    for k in texts:
        parts = []
        for x, own in kinds.items():
            size = sum(own.values())
            share = lattice.DISCOUNT * (len(own) - 1) / size
            total = math.log10(sum(lang[d] == x for d in train) / len(train)) + math.log10(own[None] / size)
            for w in tokens[k][:-1]:
                if w not in spelled:
                    spelled[w] = plain_marginal(w, fitted)
                total += math.log10(max(0, own[w] - lattice.DISCOUNT) / size + share * 10 ** spelled[w])
            parts.append(total)
        for w in tokens[k][:-1]:
            if w not in alone:
                alone[w] = plain_marginal(w, given)
        assert got[k]["plain_score"] == pytest.approx(sum(alone[w] for w in tokens[k][:-1]), rel=1e-9)
        assert got[k]["score"] == pytest.approx(max(parts) + math.log10(sum(10 ** (p - max(parts)) for p in parts)), rel=1e-9)


def plain_likelihood(p, x, grade, weight, penalty):
    """log of the probability of every row's grade, by the definition; less the penalty."""
    m = x.shape[1]
    t1, t2 = p[m], p[m] + math.exp(p[m + 1])
    total = 0.0
    for row, g, w in zip(x, grade, weight):
        above1, above2 = (1 / (1 + math.exp(t - float(row @ p[:m]))) for t in (t1, t2))
        total += w * math.log({0: 1 - above1, 1: above1 - above2, 2: above2}[int(g)])
    return total - penalty * float(p[:m] @ p[:m]) / 2


def test_cumulative_link_is_the_most_likely_one():
    """Against the definition: no small step from the fitted model is more likely."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3))
    severity = x @ np.array([1.5, -1.0, 0.0]) + rng.logistic(size=150)
    grade = (severity > 0.3).astype(int) + (severity > 1.8)
    weight = np.full(150, 1 / 150)
    w, t = toxicity.cumulative_link(x, grade, weight, 3000, penalty=0.01)
    assert t[0] < t[1] and w[0] > 0.5 and w[1] < -0.3
    p = np.array([*w, t[0], math.log(t[1] - t[0])])
    best = plain_likelihood(p, x, grade, weight, 0.01)
    for i in range(len(p)):
        for step in (-0.03, 0.03):
            other = p.copy()
            other[i] += step
            assert plain_likelihood(other, x, grade, weight, 0.01) < best + 1e-7
    model = toxicity.Grades(np.zeros(0, np.uint64), np.zeros(0), t)
    chances = model.score(np.zeros(0, np.uint8), np.zeros(2, np.int64), model.table())[0]
    assert chances == pytest.approx([1 / (1 + math.exp(x)) for x in t])


def test_features_are_words_and_word_beginnings():
    from fairlead.llm import text as tx

    texts = ["Abcdefgh abcdefgz x", "", "éé-abcd ABCD"]
    data, offsets = tx.buffers(pa.array(texts))
    doc, value = toxicity.features(data, offsets, 0, 3)
    one = lambda w: int(tx.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), 0, 1, toxicity.WORD).hashes()[0])
    name = {}
    for w in (b"abcdefgh", b"abcdefgz", b"x", "éé".encode(), b"abcd"):
        name[one(w)] = (0, w)
        for n in toxicity.PREFIXES:
            name[int(tx.mix(np.array([one(w[:n])], np.uint64) + np.uint64(n))[0])] = (n, w[:n])
    got = Counter((int(d), name[int(v)]) for d, v in zip(doc, value))
    want = Counter()
    for d, text in enumerate(texts):
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()):
            want.update((d, (n, w[:n] if n else w)) for n in (0, *toxicity.PREFIXES))
    assert got == want


def test_toxic_texts_are_found(spark):
    """Held-out accuracy: fitted on labels of even ids, tried on odd ones."""
    larger = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    docs, labels = workload.table(spark, larger, "documents"), workload.table(spark, larger, "labels")
    got = {r["doc_id"]: r for r in toxicity.grade(docs, toxicity.train(docs, labels.where("doc_id % 2 = 0"))).collect()}
    test = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1").collect()}
    toxic = [k for k, t in test.items() if t]
    assert sum(got[k]["toxic"] for k in toxic) >= 0.7 * len(toxic)
    assert sum(got[k]["toxic"] for k, t in test.items() if not t) <= 0.02 * len(test)
    for r in got.values():
        assert 0 <= r["p_severe"] <= r["p_toxic"] <= 1
        assert r["expected_severity"] == pytest.approx(r["p_toxic"] + r["p_severe"])


def test_packing_is_lossless(spark, texts):
    import public_tokenizers

    packed = workload.op10_packing(spark, SF_DIR).cache()
    encode = packing.tiktoken_encoder(workload.vocabulary(workload.BYTE_RANKS), public_tokenizers.PATTERN)()
    parts = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r["doc_id"], {})[r["begin"]] = np.frombuffer(r["ids"], "<u2")
    assert set(parts) == set(texts)
    for k, text in texts.items():
        ids = np.concatenate([parts[k][b] for b in sorted(parts[k])])
        assert ids.tolist() == [*encode(text).tolist(), workload.END_OF_TEXT]
    for r in packed.collect():
        assert len(r["input_ids"]) == 2 * packing.ROW_TOKENS and r["cu_seqlens"][-1] == r["n_tokens"] <= packing.ROW_TOKENS
        positions = np.frombuffer(r["position_ids"], "<u4")
        for begin, a, b in zip(r["doc_begins"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[a:b].tolist() == list(range(begin, begin + b - a))


def test_pipeline(spark, texts):
    """What each stage keeps, by brute force over the stage's own input."""
    docs = workload.table(spark, SF_DIR, "documents")
    toxic = {r["doc_id"] for r in workload.op2_toxicity(spark, SF_DIR).collect() if r["toxic"]}
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF_DIR))
        left[name] = {r["doc_id"]: r["text"] if "text" in docs.columns else r for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    assert set(left["toxicity"]) == set(texts) - toxic
    last = {t: k for k, t in sorted(left["toxicity"].items())}
    assert left["exact dedup"] == {k: t for t, k in last.items()}
    _, groups = near_groups(left["exact dedup"], 80)
    assert left["near dedup"] == {k: left["exact dedup"][k] for k, g in groups.items() if k == g}
    windows = benchmark_windows(spark)
    assert left["decontamination"] == {k: t for k, t in left["near dedup"].items() if not hits(t, windows)[1]}
    model = bpe.Bpe(bpe.read_vocabulary(workload.vocabulary(workload.BYTE_BPE)))
    assert {k: bytes(r["ids"]) for k, r in left["bpe"].items()} == {k: model.encode(t) for k, t in left["decontamination"].items()}


def test_the_pipeline_leaves_its_result_only(spark):
    folder = steps_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    docs = corpus_pipeline.run(spark, SF_DIR)
    assert len(set(os.listdir(folder)) - before) == 1
    assert docs.count() > 50 and docs.where("n_tokens != length(ids) / 4").count() == 0


def test_packed_rows_as_files(spark, tmp_path):
    packed = workload.op10_packing(spark, SF_DIR)
    packing.write_packed(packed, f"{tmp_path}/packed")
    assert spark.read.parquet(f"{tmp_path}/packed").exceptAll(packed).count() == 0


def test_windows_of_short_items_and_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "x y three four z"), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "Three, four!"), (8, "one two three four"), (9, None), (10, "..."), (None, "y three")], "item_id bigint, text string")
    want = [(1, 4, [(0, 4)], ["7", "8"]), (2, 5, [(1, 4)], ["7"]), (3, 0, [], []), (4, 0, [], [])]
    for size in (1 << 20, 3):  # one block, and one for about every item
        got = decontaminate.mark(docs, items, block_words=size).orderBy("doc_id").collect()
        assert [(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in got] == want
    assert decontaminate.cut("One, two three!", [(0, 2)]) == " three!"
