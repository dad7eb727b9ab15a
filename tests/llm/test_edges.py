"""Nulls, empty and very long texts, ties and repeated rows, empty tables, further columns with clashing names."""

import hashlib
import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairlead.llm import bpe, chat, decontaminate, exact, lattice, minhash, packing, revisit, text, toxicity, urlrules, workload
import corpus_pipeline
from fairlead.operators.scan import settle

LONG = " ".join(f"w{i % 9973}x{i % 613}" for i in range(60_000))
WORDS = " ".join(f"word{i}" for i in range(60))
NAMES = "doc_id bigint, text string, lang string, kept string, component_id string, n_tokens string, digest string, kind string, n_chars bigint"
ROWS = [(1, WORDS, "en"), (2, WORDS, "en"), (2, WORDS, "en"), (3, WORDS + " end", None), (4, None, "fr"), (5, "", "de"), (6, " \n\t", None), (7, LONG, "en"), (None, WORDS, None), (None, None, None), (9, "É ß 😀 <|endoftext|> x", "xx")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", "c", "n", "d", "kind", 5) for r in ROWS], NAMES)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r[:1]))


def test_exact_copies(spark, docs, none):
    got = exact.mark_copies(docs, exact.fresh_index(spark, 4)).collect()
    assert len(got) == len(ROWS)
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(WORDS.encode()).hexdigest()]
    assert [(r["keep_id"], r["group_size"]) for r in same] == [(2, 4)] * 4
    assert sum(r["kept"] for r in same) == 2  # rows that share the largest id
    empty = [r for r in got if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(5, 3)}
    assert exact.mark_copies(none, exact.fresh_index(spark, 4)).count() == 0
    kept = exact.drop_copies(docs, exact.fresh_index(spark, 4))
    assert kept.columns == docs.columns and kept.count() == 6
    assert exact.drop_copies(none, exact.fresh_index(spark, 4)).count() == 0


def test_copies_of_an_earlier_batch_go(spark, docs):
    """Two batches against one index: what the first one kept is not kept again, but for its own row."""
    index = exact.fresh_index(spark, 4)
    first = exact.drop_copies(docs.where("doc_id in (1, 2)"), index)
    assert [r["doc_id"] for r in first.collect()] == [2]
    second = exact.drop_copies(docs.where("doc_id is null or doc_id in (1, 3, 5, 7)"), index)
    assert sorted(r["doc_id"] for r in second.collect()) == [3, 5, 7]
    again = exact.drop_copies(docs.where("doc_id = 2"), index)  # delivered once more
    assert [r["doc_id"] for r in again.collect()] == [2]
    assert index.files().count() == 4


def test_a_compacted_index_is_the_same(spark, docs):
    index = exact.fresh_index(spark, 4)
    rows = docs.select("doc_id", exact.digest().alias("digest"))
    for part in ("doc_id in (1, 2)", "doc_id in (3, 5)", "doc_id = 9"):
        index.add(rows.where(part))
    index.files().where("keep_id = 3").withColumn("keep_id", F.lit(8).cast("bigint")).write.insertInto(index.table)  # a second writer
    spark.catalog.refreshTable(index.table)
    assert index.files().count() == 5
    small = index.compact(exact.fresh_index(spark, 4).path + "-compact")
    assert {(r["keep_id"], r["batch_count"]) for r in small.files().collect()} == {(2, 3), (3, 1), (5, 1), (9, 1)}
    assert len(small.files().inputFiles()) <= 4
    got = exact.mark_copies(docs.where("doc_id in (1, 7)"), small).collect()
    assert {(r["doc_id"], r["kept"]) for r in got} == {(1, False), (7, True)}
    small.remove()


def test_the_broadcast_of_windows_is_bounded(spark):
    import pickle

    words = [f"word{i % 5000}" for i in range(60_000)]
    items = [(str(k), " ".join(words[k * 600 : k * 600 + 600])) for k in range(100)]
    phrases = decontaminate.Phrases(items)
    vocabulary = sum(len(w) + 40 for w in phrases.vocabulary)
    assert len(pickle.dumps(phrases)) < 40 * len(words) + vocabulary
    frame = spark.createDataFrame(items, "item_id string, text string")
    parts, count = decontaminate.blocks(frame, 10_000, "item_id", "text")
    sizes = {r["block"]: r["n"] for r in parts.groupBy("block").agg((F.count(F.lit(1)) * 600).alias("n")).collect()}
    assert count == 7 and sum(sizes.values()) == len(words) and max(sizes.values()) <= 2 * 10_000 and max(sizes) < count
    docs = spark.createDataFrame([(k, "x " + t[600:1400] + " y") for k, (_, t) in enumerate(items)], "doc_id bigint, text string")
    told = lambda df: sorted((r["doc_id"], [tuple(s) for s in r["spans"]], r["items"]) for r in df.collect())
    assert told(decontaminate.mark(docs, frame, block_words=10_000)) == told(decontaminate.mark(docs, frame))


def test_the_sample_of_labelled_texts_is_bounded(spark):
    assert toxicity.within([5, 9, 3, 1, 1], 9) == [True, False, True, True, False]
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * (1 + i % 5)) for i in range(60)] + [(7, "good good"), (9, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    models = [toxicity.train(docs.repartition(n), labels) for n in (1, 7)]
    assert (models[0].hashes == models[1].hashes).all() and (models[0].weights == models[1].weights).all()  # whatever the order of rows
    assert len(toxicity.train(docs, labels, sample_bytes=3).hashes) == 0

def test_the_index_outlives_its_session_table(spark, docs):
    index = exact.fresh_index(spark, 4)
    exact.mark_copies(docs.where("doc_id = 1"), index).collect()
    index.forget()
    again = exact.DigestIndex(spark, index.path, 4)
    got = {r["doc_id"]: r for r in exact.mark_copies(docs.where("doc_id in (2, 3)"), again).collect()}
    assert (got[2]["keep_id"], got[2]["kept"], got[3]["kept"]) == (1, False, True)
    assert again.files().count() == 2
    again.add(docs.select("doc_id", exact.digest().alias("digest")).where("doc_id in (1, 2, 3)"))
    assert again.files().count() == 2


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (7, 0), (9, 1), (9, 0), (None, 1), (77, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.grade(docs, model).count() == len(ROWS)
    assert toxicity.grade(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    untrained = toxicity.train(none, labels.limit(0))
    assert not any(r["toxic"] for r in toxicity.grade(docs, untrained).collect())
    assert toxicity.keep_clean(docs, untrained).count() == len(ROWS)


def test_near_copies(docs, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    want = [(1, 56, 1, True), (2, 56, 1, False), (2, 56, 1, False), (3, 57, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (None, 56, 1, False), (None, 0, None, True), (9, 1, 9, True)]
    assert [g for g in got if g[0] != 7] == sorted(want, key=str)
    assert [g[2:] for g in got if g[0] == 7] == [(7, True)]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_first_common_bound_loses_no_link():
    """A group whose members differ by few elements each, most of them unlinked with each other."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            words[at] = f"n{i}x{at}" if rng.random() < 0.8 else f"s{at}"
        texts.append(" ".join(words))
    from fairlead.workload.session import local_session

    spark = local_session("4", 4)
    from test_brute_force import near_groups

    _, groups = near_groups(dict(enumerate(texts)), 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 85).collect()}
    assert got == groups and 1 < len(set(groups.values())) < 120


def test_bpe(docs, none):
    path = workload.vocabulary(workload.BYTE_BPE)
    got = bpe.encode(docs, path, with_decoded=True).collect()
    assert len(got) == len(ROWS)
    assert sorted(r["decoded"] for r in got) == sorted(r[1] or "" for r in ROWS)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    assert bpe.encode(none, path).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[40_000:40_030])), (2, None), (3, "")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.mark(docs, items).collect()}
    assert [tuple(s) for s in got[7]["spans"]] == [(40_000, 40_030)] and got[4]["n_words"] == 0
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 1
    assert decontaminate.clean(none, items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("com", "/en/a/", "allow"), ("b.com", "/en/", "allow"), ("b.com", "/en/", "block"), (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    urls = [(1, "http://x.com/en/1"), (2, "http://X.COM/en/a/2?q#f"), (3, "http://z.b.com/en/"), (4, "http://xb.com/en/9"), (5, None), (6, "no url"), (7, "http://com"), (7, "http://com/en/"), (None, "ftp://a..com/en/x"), (8, "http://com.evil/en/"), (9, "http://x.com/en/a/" + "y" * 50_000)]
    pages = spark.createDataFrame([(*u, "a", "b") for u in urls], "page_id bigint, url string, rule string, host string")
    got = {(r["page_id"], r["host"]): (r["path"][:9], r["rule"], r["verdict"]) for r in urlrules.judge(pages, rules, rows_per_sweep=2).collect()}
    assert got[1, "x.com"] == ("/en/1", "com/en/", "block")
    assert got[2, "x.com"] == ("/en/a/2", "com/en/a/", "allow")
    assert got[3, "z.b.com"] == ("/en/", "b.com/en/", "block")
    assert got[4, "xb.com"] == ("/en/9", "com/en/", "block")
    assert got[5, ""] == got[6, ""] == ("", None, "allow")
    assert got[None, "a..com"] == ("/en/x", "com/en/", "block")
    assert got[8, "com.evil"] == ("/en/", None, "allow")
    assert got[9, "x.com"][1:] == ("com/en/a/", "allow")
    assert len(urlrules.judge(pages, rules).collect()) == len(urls)
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_chat_folding(spark):
    log = [(1, 1, "message", 1, "user", "hello"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "bad"), (1, 4, "message", 3, "user", "ugh"), (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "a<|im_end|>"), (1, 7, "delta", 2, None, "\\b"), (1, 8, "edit", 1, None, "hi\n"), (1, 9, "message", 4, None, None), (1, 10, "delta", 5, None, "no start"), (None, 1, "message", 1, "a\nb", "x")]
    events = spark.createDataFrame([(*e, "c") for e in log], "conv_id bigint, seq bigint, event string, message bigint, role string, text string, formatted string")
    done = chat.render(chat.fold(events)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    got = {r["conv_id"]: r for r in done.collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("user", "hi\n"), ("assistant", "a<|im_end|>\\b"), ("", "")]
    assert got[1]["l"] == "a<|im_end|>\\b" and got[1]["formatted"].count("<|im_end|>") == 3
    assert [tuple(t) for t in got[None]["t"]] == [("a\nb", "x")] and got[None]["l"] == ""
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_revisits(spark):
    rows = [(1, "response", "http://www.A.com:80/x#f", 10, {"etag": '"1"', "date": "d1", "server": "s"}, "p1"), (2, "revisit", "https://a.com/x", 20, {"etag": 'W/"1"', "date": "d2", "server": "t"}, None), (3, "revisit", "http://a.com/x", 10, None, None), (4, "revisit", None, 30, None, None), (5, "revisit", "http://a.com/x", 30, {"etag": '"2"'}, None), (6, "response", "http://a.com/x", 25, None, "p2"), (7, "revisit", "http://a.com/x", None, None, None), (8, "other", "http://a.com/x", 40, None, None), (9, "revisit", "http://a.com/x", 26, None, "p9")]
    records = spark.createDataFrame([(*r, "x", "y") for r in rows], "record_id bigint, kind string, url string, date bigint, headers map<string,string>, payload_digest string, outcome string, slice string")
    got = {r["record_id"]: r for r in revisit.resolve(records).collect()}
    assert {k: (r["ref_id"], r["outcome"]) for k, r in got.items()} == {2: (1, "resolved"), 3: (None, "unmatched"), 4: (None, "unmatched"), 5: (6, "unchecked"), 7: (None, "unmatched"), 9: (6, "mismatch")}
    assert got[2]["headers"] == {"etag": 'W/"1"', "date": "d2", "server": "s"} and got[2]["payload_digest"] == "p1"
    assert revisit.resolve(records.limit(0)).count() == 0


def test_long_words_walk_the_same_lattice(monkeypatch):
    pieces = lattice.Pieces(lattice.read_weights(workload.vocabulary(workload.PIECES)))
    logs = np.log(pieces.first_weights)
    words = pa.array([w.encode() for w in ["a", "the", "internationalization" * 9, "漢字かな交じり文" * 12, "é" * 70, "zq" * 90, "\x00\x01"]])
    want, counts = lattice.marginals(pieces, logs, words), lattice.expected_pieces(pieces, logs, words)
    for long, step in ((0, 1 << 16), (0, 1), (10**9, 1)):
        monkeypatch.setattr(lattice, "LONG_BYTES", long)
        monkeypatch.setattr(lattice, "WALK_BYTES", step)
        assert lattice.marginals(pieces, logs, words) == pytest.approx(want, rel=1e-12)
        assert lattice.expected_pieces(pieces, logs, words) == pytest.approx(counts, rel=1e-9, abs=1e-12)


def test_lattice_of_text_without_blanks(spark):
    """A word of a megabyte, and paragraphs of Chinese, of which each is a word."""
    rng = np.random.default_rng(2)
    line = bytes(rng.choice(list(b"abcdefghijklmnopqrstuvwxyz0123456789+/"), 1 << 20).astype(np.uint8)).decode()
    paragraphs = ["".join(chr(0x4E00 + x) for x in rng.integers(0, 3000, 700)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate([line, *paragraphs])], "doc_id bigint, text string, lang string")
    start = time.time()
    got = {r["doc_id"]: r for r in lattice.score(docs, workload.vocabulary(workload.PIECES)).collect()}
    assert time.time() - start < 60
    assert len(got) == 61 and got[0]["n_tokens"] == 2 and got[0]["plain_score"] < -(10**5)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["plain_score"]) for r in got.values())


def test_every_kind_counts(spark):
    """Ten kinds, one of them rare: a text is as likely as its own kind makes it, whatever the others."""
    docs = [(i, f"word{i % 10} other{i % 10}", f"k{i % 10}") for i in range(400)] + [(1000 + i, "seldom met", "rare") for i in range(2)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    path = workload.vocabulary(workload.PIECES)
    own = {r["doc_id"]: r["score"] for r in lattice.score(frame, path).collect()}
    together = {r["doc_id"]: r["score"] for r in lattice.score(frame, path, least_share=0.2).collect()}
    assert own[1000] > together[1000] + 0.3 and len(own) == 402
    with pytest.raises(ValueError, match="kinds"):
        lattice.score(frame.withColumn("lang", F.col("doc_id").cast("string")), path)


def test_lattice(docs, none):
    path = workload.vocabulary(workload.PIECES)
    got = lattice.score(docs, path, heavy=4).collect()
    assert len(got) == len(ROWS)
    assert all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    twice = [r for r in got if r["doc_id"] == 2]
    assert twice[0] == twice[1] and {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {1}
    # Words met by the join and words met by the broadcast add up alike.
    assert [r["score"] for r in sorted(lattice.score(docs, path).collect(), key=str)] == pytest.approx([r["score"] for r in sorted(got, key=str)])
    assert lattice.score(none, path).count() == 0
    assert lattice.score(docs.where("doc_id = 4").drop("lang"), path).count() == 1


def test_packing(docs, none):
    encode = lambda: lambda t: np.frombuffer(t.encode(), np.uint8)
    packed = packing.pack(docs, encode, 256, capacity=64)
    parts = {}
    for r in packing.unpack(packed).collect():
        parts.setdefault(r["doc_id"], []).append((r["begin"], np.frombuffer(r["ids"], "<u2")))
    assert np.concatenate([x for _, x in sorted(parts[7], key=lambda p: p[0])])[:-1].tolist() == list(LONG.encode())
    assert [x.tolist() for _, x in parts[4]] == [[256]]
    assert packing.pack(none, encode, 256).count() == 0
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 33, rng.integers(0, 60)).tolist()
        room, rows = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):  # the plain way
            fits = [r for r in range(len(room)) if room[r] >= sizes[k]]
            least = min((room[r] for r in fits), default=None)
            if least is None:
                room.append(32 - sizes[k])
                rows.append([k])
            else:
                at = next(r for r in fits if room[r] == least)
                room[at] -= sizes[k]
                rows[at].append(k)
        got = packing.best_fit(sizes, 32)
        assert sorted(map(sum, ([sizes[k] for k in r] for r in got))) == sorted(map(sum, ([sizes[k] for k in r] for r in rows)))


def test_words_do_not_cross_texts():
    import pyarrow as pa

    texts = ["ab", None, "cd ", "", " éF\x0bG", "x" * 5000]
    for limit in (1, 4, 1 << 20):
        data, offsets = text.buffers(pa.array(texts))
        seen = []
        for lo, hi in text.chunks(offsets, limit):
            words = text.words(data, offsets, lo, hi)
            seen += [(lo + int(d), bytes(words.text[a:b])) for d, a, b in zip(words.doc, words.start, words.end)]
        assert seen == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]


def test_pipeline_stages_take_anything(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            before, rows = rows, settle(stage(spark, rows, str(tmp_path)))
            assert name == "bpe" or rows.columns == before.columns
            assert rows.count() <= before.count()


def test_bands_follow_the_threshold():
    assert minhash.band_plan(80) == (45, 6)
    for percent in (10, 30, 50, 60, 70, 80, 85, 95, 99):
        count, rows = minhash.band_plan(percent)
        assert (1 - (percent / 100) ** rows) ** count <= minhash.MISS and count * rows <= minhash.SLOTS
    assert minhash.band_plan(100)[0] == 1
    with pytest.raises(ValueError, match="slots"):
        minhash.band_plan(1)


@pytest.mark.parametrize("percent", [50, 65, 90])
def test_groups_at_other_thresholds(spark, percent):
    """Chains of texts, each some words off the one before."""
    from test_brute_force import near_groups

    rng = np.random.default_rng(percent)
    texts = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(8):
            at = int(rng.integers(0, 55))
            words = [*words[:at], *[f"n{rng.integers(10**9)}" for _ in range(int(rng.integers(0, 12)))], *words[at + int(rng.integers(0, 10)) :]]
            texts.append(" ".join(words))
    _, groups = near_groups(dict(enumerate(texts)), percent)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), percent).collect()}
    assert got == groups and 12 <= len(set(groups.values())) < len(texts)


def template_pages(n, own):
    """Pages of 104 common words and own ones behind: similarity 100 / (100 + own shingles of both)."""
    common = " ".join(f"common{i}" for i in range(104))
    return [(k, common + " " + " ".join(f"p{k}x{i}" for i in range(own(k)))) for k in range(n)]


def test_pages_of_one_template_take_time_in_proportion(spark):
    """9 own shingles each: 0.847, never linked, and every page shares bands and elements with every other."""
    took = []
    for n in (1500, 6000):
        docs = spark.createDataFrame(template_pages(n, lambda k: 9), "doc_id bigint, text string").repartition(8)
        start = time.time()
        assert minhash.near_duplicates(docs, 85).where("kept").count() == n
        took.append(time.time() - start)
    assert took[1] < 4 * took[0] + 5, took


def test_pages_of_one_template_that_differ_in_size(spark, monkeypatch):
    from test_brute_force import near_groups

    monkeypatch.setattr(minhash, "CROWD", 8)
    pages = template_pages(150, lambda k: 8 + k % 9)
    _, groups = near_groups(dict(pages), 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(pages, "doc_id bigint, text string"), 85).collect()}
    assert got == groups and 1 < len(set(groups.values())) < 150
