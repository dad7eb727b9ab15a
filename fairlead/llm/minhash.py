"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

A document is the set of its distinct runs of five words; one with fewer words is one run, one without words
is empty and linked with nothing. SuperMinHash gives each element one random order of all slots: in rank j it
offers the value j + r to the slot that stands j-th in its order, and a slot keeps the least. Ranks are gone
through one by one for all elements, and a document stops at the rank that no slot can be lowered by any more.

Documents with equal sets are one class. Classes that share a band of the signature are candidates; a pair is
linked if the Jaccard similarity of the full sets reaches the threshold. A bucket's pairs are not all looked
at: first every class meets the one of most company among those it shares buckets with. What is linked then is
one component, and only classes of different components can still change the groups. The last round compares
those of them that a bound leaves over: elements are ordered (those that few classes hold first), and two
sets can reach the threshold only if their first common element stands early enough in both, by their sizes. So
no link between groups is lost, and a group of n near copies takes about n comparisons; so do n pages of one
template that are just not similar enough, since at a crowded key only sizes in reach of each other meet.

Defined results: documents are told apart by doc_id; rows with one doc_id share their links. Rows with a null
doc_id are no candidates and belong to no group unless a row with an id has the same set. A null text is empty.
Other columns are not needed, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm import text as tx
from fairlead.llm.groups import components
from fairlead.operators.scan import settle

SHINGLE = 5
#: Greatest chance that a pair at the threshold shares no band, and slots of a signature at most.
MISS, SLOTS = 1.2e-6, 270
#: Elements of fewer classes than this are ordered by their number.
RARE = 64
#: Rounds in which every class meets one centre.
CENTRE_ROUNDS = 2
#: Elements whose whole orders are kept in memory.
FEW = 8192
#: Sets at one key of the last round, beyond which they meet by their exact sizes.
CROWD = 256

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def band_plan(percent: int) -> tuple[int, int]:
    """Bands and rows of a signature: as many rows as SLOTS allow for bands that miss a pair at the threshold with a
    chance of MISS at most. (80 percent: 45 bands of 6 rows.)"""
    plans = []
    for rows in range(1, SLOTS + 1):
        same = (percent / 100) ** rows
        count = 1.0 if same >= 1 else math.log(MISS) / math.log1p(-same)
        if count > SLOTS or math.ceil(count) * rows > SLOTS:
            break
        plans.append((math.ceil(count), rows))
    if not plans:
        raise ValueError(f"a threshold of {percent} percent takes more than {SLOTS} slots")
    return plans[-1]


def shingles(words: tx.Words, n: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of n documents: (document, hash), sorted by both."""
    h, doc = words.hashes(), words.doc
    odd = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(size)]

    def run(first: np.ndarray, length: int) -> np.ndarray:
        total = np.full(len(first), np.uint64(length))
        for i in range(length):
            total = tx.mix(total + h[first + i]) * odd[i]
        return tx.mix(total)

    full = np.arange(max(0, len(h) - size + 1))
    full = full[doc[full] == doc[full + size - 1]] if len(full) else full
    docs, values = [doc[full]], [run(full, size)]
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    begins = np.cumsum(counts) - counts
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        docs.append(short)
        values.append(run(begins[short], length))
    doc, value = np.concatenate(docs).astype(np.int64), np.concatenate(values)
    by = np.lexsort((value, doc))
    doc, value = doc[by], value[by]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[fresh], value[fresh]


def _exchange(orders: np.ndarray, place: int, other: np.ndarray) -> np.ndarray:
    """Exchanges each row's values at ``place`` and at its ``other`` place; the one that comes to ``place``."""
    rows = np.arange(len(orders))
    taken = orders[rows, other]
    orders[rows, other] = orders[:, place]
    orders[:, place] = taken
    return taken


def super_minhash(doc: np.ndarray, element: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signatures (n, slots) of n sets of elements; a value holds its rank above 32 random bits."""
    best = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    swaps: list[np.ndarray] = []
    orders: np.ndarray | None = None  # every element's order, once few elements are left
    for rank in range(slots):
        drawn = tx.mix(element + np.uint64((rank + 1) * int(_GAMMA) % (1 << 64)))
        swap = (np.uint64(rank) + ((drawn & _LOW) * np.uint64(slots - rank) >> _32)).astype(np.int64)
        if orders is None and len(element) <= FEW:
            orders = np.tile(np.arange(slots, dtype=np.int16), (len(element), 1))
            for i, s in enumerate(swaps):
                _exchange(orders, i, s)
        if orders is not None:
            slot = _exchange(orders, rank, swap).astype(np.int64)
        else:
            # What stands at place ``swap`` after the exchanges of the ranks before: they are undone one by one.
            slot = swap
            for i in range(rank - 1, -1, -1):
                slot = np.where(slot == swaps[i], i, slot)
        np.minimum.at(best, doc * slots + slot, np.uint64(rank) << _32 | drawn >> _32)
        # A set goes on only while a slot's value is of a higher rank than this one.
        goes_on = (best.reshape(n, slots).max(axis=1, initial=0) >> _32 > rank)[doc]
        if not goes_on.any():
            break
        doc, element = doc[goes_on], element[goes_on]
        if orders is not None:
            orders = orders if goes_on.all() else orders[goes_on]
        else:
            swaps = [s[goes_on] for s in [*swaps, swap]]
    return best.reshape(n, slots)


def bands(signatures: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.broadcast_to(tx.mix(np.arange(1, count + 1, dtype=np.uint64)), (len(signatures), count))
    parts = signatures.reshape(len(signatures), count, rows)
    for i in range(rows):
        keys = tx.mix(keys * _GAMMA + parts[:, :, i])
    return keys.view(np.int64)


def _signed(size: int, count: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for lo, hi in tx.chunks(offsets):
                n = hi - lo
                doc, value = shingles(tx.words(data, offsets, lo, hi), n, size)
                sizes = np.bincount(doc, minlength=n)
                keys = np.stack([tx.per_document(value, doc, n), tx.per_document(tx.mix(value + _GAMMA), doc, n)], axis=1)
                signed = bands(super_minhash(doc, value, n, count * rows), count, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(sizes, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), pa.array(signed.ravel(), pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )

    return work


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for lo, hi in tx.chunks(offsets):
                doc, value = shingles(tx.words(data, offsets, lo, hi), hi - lo, size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], lists], names=["node", "elements"])

    return work


class Links:
    """Candidates of one run (bucket, node, n), and the links confirmed so far."""

    def __init__(self, members: DataFrame, sets: DataFrame, percent: int):
        self.members, self.sets, self.percent = members, sets, percent
        self.links: DataFrame | None = None
        self.seen: DataFrame | None = None
        self.groups: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> bool:
        """Compares pairs (u, v, nu, nv), u below v, on full sets; whether any is linked."""
        # A set that is too much smaller than the other can't reach the threshold.
        pairs = settle(self.unseen(pairs.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * self.percent).distinct()))
        a = self.sets.select(F.col("node").alias("u"), F.col("elements").alias("a"))
        b = self.sets.select(F.col("node").alias("v"), F.col("elements").alias("b"))
        both = pairs.join(b, "v").join(a, "u").select("u", "v", "nu", "nv", F.size(F.array_intersect("a", "b")).alias("common"))
        good = F.col("common") * 100 >= (F.col("nu") + F.col("nv") - F.col("common")) * self.percent
        links = settle(both.where(good).select("u", "v"))
        self.seen = pairs.select("u", "v") if self.seen is None else self.seen.unionByName(pairs.select("u", "v"))
        if links.isEmpty():
            return False
        self.links = links if self.links is None else self.links.unionByName(links)
        self.groups = components(self.links)
        return True

    def unseen(self, pairs: DataFrame) -> DataFrame:
        return pairs if self.seen is None else pairs.join(self.seen, ["u", "v"], "left_anti")

    def open_members(self) -> DataFrame:
        """Members with their component, of buckets that hold more than one."""
        m = self.members
        m = m.withColumn("component", F.col("node")) if self.groups is None else m.join(self.groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = m.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("bucket")
        return settle(m.join(several, "bucket").select("bucket", "node", "n", "company", "component"))

    def to_centres(self, members: DataFrame) -> DataFrame:
        """For every node one pair: with the node of most company in a bucket, if of another component."""
        best = members.groupBy("bucket").agg(F.max(F.struct("company", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))).alias("best"))
        pairs = members.join(best, "bucket").where("component <> best.cx").select("best.company", F.col("best.x").alias("x"), F.col("best.nx").alias("nx"), "node", "n")
        pairs = self.unseen(pairs.select("company", *_pair("x", "node", "nx", "n"), "node").distinct())
        return pairs.groupBy("node").agg(F.max(F.struct("company", "u", "v", "nu", "nv")).alias("p")).select("p.u", "p.v", "p.nu", "p.nv")

    def by_first_common(self, members: DataFrame) -> DataFrame:
        """Pairs of different components whose first common element may stand where it does."""
        percent = F.lit(self.percent)
        nodes = settle(self.sets.join(members.select("node", "n", "component").distinct(), "node"))
        # The order of elements: by how many classes hold them, in powers of two, up to RARE; then by hash.
        elements = nodes.select("node", F.explode("elements").alias("e"))
        holders = elements.groupBy("e").agg(F.min("node").alias("only"), F.count(F.lit(1)).alias("k")).where(F.col("k") < RARE)
        alone = holders.where("k = 1").select(F.col("only").alias("node"), F.lit(0).alias("level"), "e")
        few = elements.join(holders.where("k > 1").select("e", F.floor(F.log2("k")).cast("int").alias("level")), "e").select("node", "level", "e")
        rare = alone.unionByName(few).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "e"))).alias("rare"))
        rest = nodes.join(rare, "node", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<struct<level:int,e:bigint>>")))
        n = F.col("n")
        # The larger set's part in which the first common element must lie, and the smaller one's, which is shorter.
        long = n - F.ceil(percent * n / 100) + 1
        short = n - F.ceil(2 * percent * n / (100 + percent)) + 1
        common = F.transform(F.array_except("elements", F.col("rare.e")), lambda e: F.struct(F.lit(63).alias("level"), e.alias("e")))
        first = F.slice(F.concat("rare", common), F.lit(1), long.cast("int"))
        places = rest.select("node", "n", "component", short.alias("short"), F.posexplode(first).alias("at", "c")).where("c.level > 0")
        places = places.select("node", "n", "component", "short", F.col("at").cast("bigint").alias("at"), "c.e")
        kind = lambda size: F.floor(F.log(size) / F.lit(float(np.log(1.02)))).cast("int")
        # With this element the first common one at its place, the other set has at most so many elements.
        most = F.least(n, F.floor((100 + percent) * (n - F.col("at")) / percent) - n)
        least = F.ceil(percent * n / 100)
        entry = ["e", "at", "node", "n", "component"]
        larger = places.where(most >= least).select(*entry, F.explode(F.sequence(kind(least), kind(most))).alias("kind"), F.lit(True).alias("larger"))
        smaller = places.where("at < short").select(*entry, kind(n).alias("kind"), F.lit(False).alias("larger"))
        entries = settle(larger.unionByName(smaller)).withColumn("exact", F.lit(0).cast("bigint"))
        # Where many sets share a key, a larger one meets only the sizes that its place leaves: pages of one
        # template have their first common element where sizes alone tell whether they are similar enough.
        crowded = settle(entries.groupBy("e", "kind").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CROWD).select("e", "kind"))
        if not crowded.isEmpty():
            low, high = F.floor(F.pow(F.lit(1.02), "kind")) - 1, F.ceil(F.pow(F.lit(1.02), F.col("kind") + 1)) + 1
            first_size = F.greatest(F.when(F.col("larger"), least).otherwise(n), low).cast("bigint")
            last_size = F.least(F.when(F.col("larger"), most).otherwise(n), high).cast("bigint")
            near = entries.join(crowded, ["e", "kind"], "left_semi").where(first_size <= last_size)
            fine = near.withColumn("exact", F.explode(F.sequence(first_size, last_size))).where(kind(F.col("exact")) == F.col("kind"))
            entries = settle(entries.join(crowded, ["e", "kind"], "left_anti").unionByName(fine))
        # Larger sets meet smaller ones; at a key, those of its largest component needn't meet each other.
        key = ["e", "kind", "exact"]
        parts = entries.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("size"), F.max("larger").alias("some"), F.min("larger").alias("every"))
        main = parts.groupBy(*key).agg(F.max(F.struct("size", "component")).alias("h"), F.count(F.lit(1)).alias("components"), F.max("some").alias("some"), F.min("every").alias("every"))
        main = main.where("components > 1 and some and not every").select(*key, F.col("h.component").alias("cx"))
        met = entries.join(main, key).withColumn("main", F.col("component") == F.col("cx")).drop("cx")
        large = met.where("larger").select(*key, "main", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("component").alias("c"))
        sides = F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        small = met.where("not larger").withColumn("main", F.explode(sides))
        order = F.expr("component <> c and struct(n, node) < struct(nx, x)")
        # What follows the first common element in the shorter rest must still be enough.
        fit = order & (F.least(F.col("n") - F.col("at"), F.col("nx") - F.col("ax")) * (100 + percent) >= (F.col("n") + F.col("nx")) * percent)
        return large.join(small, [*key, "main"]).where(fit).select(*_pair("x", "node", "nx", "n"))


def _pair(u: str, v: str, nu: str, nv: str) -> list:
    low = F.col(u) < F.col(v)
    return [F.when(low, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in ((u, v, "u"), (v, u, "v"), (nu, nv, "nu"), (nv, nu, "nv"))]


def link_all(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Components (node, component) of the candidates ``members`` (bucket, node, n); None without any link."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    company = members.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("company"))
    links = Links(settle(members.join(company, "node")), sets, percent)
    for _ in range(CENTRE_ROUNDS):
        links.confirm(links.to_centres(links.open_members()))
    links.confirm(links.by_first_common(links.open_members()))
    return links.groups


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    ``percent``: least Jaccard similarity of linked documents; bands and rows follow from it (see band_plan).
    """
    count, rows = band_plan(percent)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = settle(texts.mapInArrow(_signed(size, count, rows), "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>"))
    classes = settle(signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")))
    buckets = classes.where("node is not null").select("node", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("c"), F.max("node").alias("d")).where("c < d").select("bucket")
    members = settle(buckets.join(shared, "bucket"))
    chosen = members.select(F.col("node").alias("doc_id")).distinct()
    # Candidates' texts meet their ids by a hash join, so that no text is sorted.
    sets = settle(texts.join(chosen.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(size), "node bigint, elements array<bigint>"))
    groups = link_all(members, sets, percent)
    found = classes.select("set_key", "node")
    found = found.withColumn("component", F.col("node")) if groups is None else found.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = settle(found.select("set_key", "component"))
    full = signed.where("n_shingles > 0").join(found, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which one of each group stays; rows with a null id stay."""
    copies = near_duplicates(docs, percent, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(copies, docs[id_col].cast("bigint") == copies["_copy"], "left_anti")
