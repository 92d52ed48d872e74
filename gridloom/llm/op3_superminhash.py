"""Near-duplicate groups by SuperMinHash: signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash gives every element one random permutation of the slots (Fisher-Yates) and the values r_j + j along it, r_j uniform in
[0, 1): all slots of an element are correlated, which lowers the variance, and a set's signature is done at level j as soon as no slot
is above j, so large sets stop after one or two levels. All of it is vectorised over the elements of many documents.

Texts with equal sets are one class from the start. Candidates share a band. In each bucket every class is first checked against one
hub, which keeps the work linear however large a group of copies is. What is left are buckets that still hold two components: there,
only pairs of different components are looked at, in pairs of blocks (see cross_blocks), and only those whose signatures leave a similarity of
0.8 possible are verified. Links are confirmed on the full sets of shingles, each as its 64-bit hash. Components come from local union-find inside partitions, then
minimum labels with pointer jumping. With 32 bands of 5 rows a pair of similarity 0.8 shares no band with probability 3e-6 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import FILE, ROW, attach, groups_of, materialize, plain_names, stored, with_address

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
BLOCK = 256
#: Least similarity of two signatures that is still verified: six standard deviations below 0.8 for 160 independent slots, whose variance is larger.
LEAST_ESTIMATE = 0.8 - 6 * (0.8 * 0.2 / SLOTS) ** 0.5
MIX1, MIX2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, hashes: WordHashes, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of word shingles after lower-casing A-Z; fewer words than size: the whole sequence; none: empty."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    x = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        x = mix(x * GOLDEN + h[i : n - k + 1 + i])
    x.sort()
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots, uint64: level in the top 8 bits) of sets given as elements with their owners (0 .. sets - 1)."""
    assert slots <= 255
    h = np.full(sets * slots, np.iinfo(np.uint64).max, np.uint64)
    perm, x, own = None, elements, owner.astype(np.int64)
    for j in range(slots):
        r = mix(x + np.uint64((j + 1) * int(GOLDEN) & (2**64 - 1)))
        pick = j + (((r >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(56)) | (mix(r + GOLDEN) >> np.uint64(8))
        if perm is None:
            slot = pick
        else:
            at = np.arange(len(x))
            slot = perm[at, pick].astype(np.int64)
            perm[at, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(h, own * slots + slot, value)
        top = h.reshape(sets, slots).max(1) >> np.uint64(56)
        go = (top > j)[own]
        if not go.any():
            break
        if perm is None:
            x, own = x[go], own[go]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
            at, first = np.arange(len(x)), pick[go]
            perm[at, first] = 0
            perm[:, 0] = first
        elif go.mean() < 0.7:
            x, own, perm = x[go], own[go], perm[go]
    return h.reshape(sets, slots)


def short_signature(h: np.ndarray) -> np.ndarray:
    """16 bits of each value: equal values stay equal, others agree once in 65,536."""
    return (mix(h) >> np.uint64(48)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        sets = [shingles(t or b"", hashes, size) for t in b.column("text").cast(pa.binary()).to_pylist()]
        prints, new, number = [], [], {}
        for s in sets:  # equal sets of a batch are signed once
            f = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            prints.append(f)
            if f is not None and f not in number:
                number[f] = len(number)
                new.append(s)
        signed: list[bytes] = []
        i = 0
        while i < len(new):  # some 30,000 elements at a time
            k, total = i, 0
            while k < len(new) and (k == i or total + len(new[k]) <= 30_000):
                total += len(new[k])
                k += 1
            part = new[i:k]
            own = np.repeat(np.arange(len(part)), [len(s) for s in part])
            sig = short_signature(superminhash(np.concatenate(part), own, len(part)))
            signed += [x.tobytes() for x in sig]
            i = k
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column(FILE), b.column(ROW), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([None if f is None else signed[number[f]] for f in prints], pa.binary())],
            names=["doc_id", FILE, ROW, "n_shingles", "fp", "sig"],
        )


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, SLOTS) for c in ("sig_a", "sig_b"))
            b = b.filter(pa.array((x == y).mean(1) >= LEAST_ESTIMATE))
        yield b.select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        held: dict[bytes, np.ndarray] = {}
        texts = {}
        keep = []
        for fa, ta, fb, tb in zip(*(b.column(c).to_pylist() for c in ("a", "text_a", "b", "text_b"))):
            for f, t in ((fa, ta), (fb, tb)):
                if f not in held:
                    held[f] = shingles(t or b"", hashes, size)
            x, y = held[fa], held[fb]
            keep.append(similar(x, y))
        texts.clear()
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def similar(x: np.ndarray, y: np.ndarray, percent: int = 80) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y| for sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def verified(pairs: DataFrame, texts: DataFrame, size: int = 2) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar; texts: fp, text of one member of each class."""
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(partial(_verify, size=size), "a binary, b binary")


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside a partition: edges from every node to the least node that it reaches here."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:  # bounded memory: what is known goes out, and the next links start anew
            yield _forest_batch(parent, find)
            parent.clear()
    yield _forest_batch(parent, find)


def _forest_batch(parent: dict, find) -> pa.RecordBatch:
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) for all nodes of edges (a, b binary), stored. Rounds grow with the log of the longest path."""
    forest = materialize(edges.mapInArrow(_local_forest, "a binary, b binary").distinct(), "forest")
    both = materialize(forest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(forest.select(F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = lower.select("node", "old", "component").join(labels.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").select("node", "old", F.least("component", "up").alias("component"))
        new = materialize(jump, "labels")
        changed = new.filter(F.col("old") != F.col("component")).limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels


def cross_blocks(held: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of held (stored: key, fp, hub, component) of the buckets with two components or more, dealt to pairs of blocks: columns bi, bj, own.

    The largest component of a bucket is its major one. Its members fall into blocks, and so do all others, the minor ones. A minor block
    meets itself, the later minor blocks and all major blocks, so each pair of different components meets exactly once, no task has more than two blocks,
    and a bucket of n members with m minor ones gives about n * m / block rows: n if there are a few.
    """
    parts = materialize(held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "bucket-parts")
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = materialize(mixed.select("key", F.col("top.component").alias("major"), "size", (F.col("size") - F.col("top.n")).alias("minors")), "mixed")
    rows = attach(held, mixed, "key", "size", unique=F.xxhash64("fp", "key")).filter(F.col("size").isNotNull())
    lower = F.ceil(F.col("minors") / block).cast("int")
    upper = F.ceil((F.col("size") - F.col("minors")) / block).cast("int")
    slot = lambda n: F.pmod(F.xxhash64("fp"), n.cast("long")).cast("int")
    is_minor = F.col("component") != F.col("major")
    rows = rows.withColumn("own", F.when(is_minor, slot(lower)).otherwise(lower + slot(upper))).withColumn("lower", lower).withColumn("upper", upper)
    pair = lambda i, j: F.struct(i.alias("bi"), j.alias("bj"))
    own = F.col("own")
    before = F.transform(F.sequence(F.lit(0), F.least(own, F.col("lower") - 1)), lambda i: pair(i, own))  # a minor block's own pair is in it
    after = F.transform(F.sequence(own, F.col("lower") + F.col("upper") - 1), lambda j: pair(own, j))
    tasks = F.when(own < F.col("lower"), F.array_union(before, after)).otherwise(before)
    return rows.select("key", "fp", "hub", "component", "own", F.explode(tasks).alias("task")).select("key", "fp", "hub", "component", "own", "task.bi", "task.bj")


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components between two blocks of one bucket whose signatures allow the similarity."""
    for t in groups_of(batches, ["key", "bi", "bj"]):
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        fps, comps, own = t.column("fp").to_pylist(), t.column("component").to_pylist(), t.column("own").to_numpy()
        hub = t.column("hub")[0].as_py()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(fps), SLOTS)
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        out = set()
        for i in left.tolist():
            if fps[i] == hub:  # it has been verified against all
                continue
            some = right[comp[right] != comp[i]]
            for k in some[(sig[some] == sig[i]).mean(1) >= LEAST_ESTIMATE].tolist():
                if fps[k] != hub:
                    out.add((min(fps[i], fps[k]), max(fps[i], fps[k])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], names=["a", "b"])


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and the row's address (__gl_file, __gl_row).

    Documents are linked if 100 * |A & B| >= 80 * |A | B| of their sets of shingles of size words; component_id is the least doc_id that links
    reach. Null or blank texts have an empty set and are linked with nothing: component_id is the own doc_id. Rows of equal texts are
    one class. kept is doc_id = component_id (two nulls count as equal); null ids lose to any other, and a component of null ids only
    has component_id null. kept_row tells one kept row per component even where a doc_id is repeated. Other columns are not read.
    """
    rows = with_address(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    signed = materialize(rows.select("doc_id", "text", FILE, ROW).mapInArrow(partial(_sign, size=size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FILE} long, {ROW} long, n_shingles long, fp binary, sig binary"), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    classes = materialize(signed.filter(F.col("fp").isNotNull()).groupBy("fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("members"), F.max("sig").alias("sig")), "classes")

    bands = classes.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("key"))
    buckets = materialize(bands.groupBy("key").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = materialize(attach(bands, buckets, "key", "n", unique=F.xxhash64("fp", "key")).filter(F.col("n").isNotNull()), "members")
    sigs = classes.select("fp", "sig")

    def close(pairs: DataFrame) -> DataFrame:
        with_sigs = pairs.join(sigs.select(F.col("fp").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("fp").alias("b"), F.col("sig").alias("sig_b")), "b")
        return with_sigs.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimates, "a binary, b binary")

    stars = materialize(close(members.filter(F.col("fp") != F.col("hub")).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()), "stars")
    named = members.select("fp").distinct()
    texts = materialize(_texts(rows, classes.join(named, "fp", "left_semi")), "texts")
    links = materialize(verified(stars, texts, size), "star-links")
    first = components(links)

    held = members.join(first.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    held = materialize(held.select("key", "fp", "hub", "component"), "held")
    spread = cross_blocks(held).join(sigs, "fp").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    rest = materialize(spread.mapInArrow(_cross_pairs, "a binary, b binary").distinct(), "cross")
    more = materialize(verified(rest, texts, size), "cross-links")
    final = components(links.unionByName(more)) if more.limit(1).count() else first

    group = classes.join(final.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    group = materialize(group.select("fp", "component", "first", "members"), "groups")
    least = group.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("parts"))
    least = materialize(least, "least")
    by_class = attach(group.select("fp", "component", "first", "members"), least, "component", "parts", unique=F.xxhash64("fp"))
    by_class = by_class.select("fp", F.coalesce("least", "first").alias("least"), "members", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"))
    by_class = materialize(by_class, "by-class")
    # a class of one member in a component of one class needs no join
    known = by_class.select("fp", "least", F.when(F.col("parts") > 1, F.greatest("members", F.lit(2))).otherwise(F.col("members")).cast("long").alias("size"))
    keyed = signed.drop("sig").withColumn("fp", F.coalesce("fp", F.encode(F.concat_ws(":", FILE, ROW), "UTF-8")))  # blank texts spread out
    out = attach(keyed, known, "fp", "size", unique=F.xxhash64(FILE, ROW))
    alone = F.col("size").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least.id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (alone | ((F.col("least.file") == F.col(FILE)) & (F.col("least.row") == F.col(ROW)))).alias("kept_row"),
        FILE,
        ROW,
    )


def _texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """fp, text of the first member of each class."""
    wanted = classes.select("fp", F.col("first.file").alias(FILE), F.col("first.row").alias(ROW))
    return rows.select("text", FILE, ROW).join(wanted, [FILE, ROW]).select("fp", F.col("text").cast("binary").alias("text"))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 2) -> DataFrame:
    """The rows of docs of which one stays per group, with all their columns; blank texts all stay."""
    docs = stored(docs)
    gone = near_groups(docs, text, doc_id, size).filter(~F.col("kept_row")).select(FILE, ROW)
    plain = plain_names(docs)
    return with_address(plain).join(gone, [FILE, ROW], "left_anti").select(*plain.columns).toDF(*docs.columns)


def op3_superminhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(FILE, ROW, "kept_row")
