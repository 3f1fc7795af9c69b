"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets confirm.

1. Every document's set of word shingles is hashed.  Equal sets are one node,
   however many documents share it.  A node has SAMPLES MinHash samples by one
   permutation (each bin's least hash; an empty bin copies the non-empty bin that
   comes first in its own random order), band keys of ROWS samples each, and an
   odd sketch: the samples folded into a bitmap of parities.
2. In each bucket of nodes with a band key in common, all are compared with one
   pivot: the node that shares most buckets.  Sketches' popcount of XOR, which
   estimates high similarities closely, screens; exact intersections of full
   sets confirm.  A node meets few pivots, so m near copies make a few m rows.
   The links' connected components get a root each.
3. Buckets whose members all have one root are done.  In the others nodes of
   different roots are compared by sketches, big buckets in pairs of blocks,
   each a task's worth; what may reach the threshold is joined into families,
   within which nodes of different roots are confirmed by exact intersections.
   Buckets with the same members are compared once.

Of a task's links only a spanning forest leaves it.  No bucket, family or
candidate is capped: where u nodes of a group of m are not settled by pivots,
blocks of b nodes make about m + (m + u) * u / b rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_names, heavy_keys, materialize, spread_join

#: MinHash samples, bits of a sketch, samples of a band, and the chance to miss a pair at the threshold that decides the number of bands.
SAMPLES, BITS, ROWS, MISS = 256, 512, 5, 1e-7
#: How far an estimate may lie below the threshold (over five standard errors), and the sizes of blocks in buckets and families.
MARGIN, BUCKET_BLOCK, FAMILY_BLOCK = 0.15, 1024, 512
#: Nodes of a bucket that one task compares with its pivot.
PIVOT_GROUP = 256
#: Columns of the exact product that are handled at once.
COLUMNS = 16_384

_RANDOM = np.random.default_rng(20240229)
_BIN_ORDER = _RANDOM.permuted(np.tile(np.arange(SAMPLES, dtype=np.int16), (SAMPLES, 1)), axis=1)  # [empty bin, bin]: rank
_EDGES = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(64 - SAMPLES.bit_length() + 1)
_SALT = _RANDOM.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of size words; all its words as one if it has fewer; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six ASCII spaces, alone
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return _mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[:len(h) - size + 1]
    for k in range(1, size):
        out = _mix(out + np.uint64(k)) + h[k:len(h) - size + 1 + k]
    return np.unique(_mix(out))


def samples(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash samples of a non-empty sorted set."""
    start = np.searchsorted(hashes, _EDGES)
    full = start < np.append(start[1:], len(hashes))
    out = hashes[np.minimum(start, len(hashes) - 1)]
    if not full.all():
        have = np.flatnonzero(full)
        out[~full] = out[have[_BIN_ORDER[np.flatnonzero(~full)][:, have].argmin(1)]]
    return out


def sketch(values: np.ndarray) -> bytes:
    """The odd sketch of MinHash samples."""
    at = _mix(values * _SALT) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def similarity(differing: int) -> float:
    """The similarity that a popcount of two sketches' XOR stands for."""
    share = min(2 * differing / BITS, 1 - 1e-9)
    return 1 + BITS / 2 * math.log(1 - share) / (2 * SAMPLES)


def most_differing(similarity_: float) -> int:
    """The largest popcount expected of pairs at a similarity."""
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - similarity_))))


def bands_for(threshold: float) -> int:
    """Bands so that a pair at the threshold is missed with a chance of at most MISS."""
    return min(SAMPLES // ROWS, math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS)))


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    rows = values[:bands * ROWS].reshape(bands, ROWS)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, text: str, size: int, bands: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set; null if empty), keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, keys, sketches = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, size)
                n.append(len(s))
                if not len(s):
                    digests.append(None), keys.append(None), sketches.append(None)
                    continue
                v = samples(s)
                digests.append(set_key(s)), keys.append(band_keys(v, bands)), sketches.append(np.frombuffer(sketch(v), np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(sketches, longs)], ["doc_id", "text_hash", "n_shingles", "digest", "keys", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>, sketch array<long>")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _name_of(doc_id: Column, digest: Column) -> Column:
    """A node's name: the doc_id, its sign bit turned so that names sort as doc_ids do, and the set's digest."""
    return F.concat(F.unhex(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), digest)


def _doc_of(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, digest, n_shingles, keys and sketch of every distinct set of features' rows, named by its smallest doc_id."""
    sets = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("n_shingles", "keys", "sketch")])
    return sets.select(_name_of(F.col("doc_id"), F.col("digest")).alias("node"), "digest", "n_shingles", "keys", "sketch")


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of their groups, the end included) of batches sorted by some columns; no group is cut."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for c in by:
            v = table.column(c).combine_chunks()
            v = np.array(v.to_pylist(), object) if pa.types.is_binary(v.type) else v.to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held)
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            held = table.slice(at[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(starts(table), table.num_rows)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(i, j) for a spanning forest of stars of a symmetric boolean matrix; j is the component's first index."""
    out, left = [], np.ones(len(linked), bool)
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i] = False
        front = linked[i] & left
        while front.any():
            left &= ~front
            found = np.flatnonzero(front)
            out += [(int(j), i) for j in found]
            front = linked[found].any(0) & left
    return out


def _star_rows(pairs: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def members_of(nodes: DataFrame) -> DataFrame:
    """key, m, node, n_shingles, sketch and degree of the nodes in buckets of m > 1; of buckets with the same members one stays.

    degree is the sum of a node's m: those of many near copies lead.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sums = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2")).where("m > 1")
    once = sums.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key", "m")
    own = keyed.join(once, "key").groupBy("node").agg(F.sum("m").alias("degree"), F.collect_list(F.struct("key", "m")).alias("at"))  # a row a band at most
    return own.join(nodes.select("node", "n_shingles", "sketch"), "node").select("node", "n_shingles", "sketch", "degree", F.explode("at").alias("at")).select("at.key", "at.m", "node", "n_shingles", "sketch", "degree")


def pivot_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """node, pivot, g and h: each bucket's member of the highest degree against its others, where sizes and sketches allow a link.

    (pivot, g, h) names a task's worth of pairs: a pivot's nodes are dealt over
    g groups, a power of two that follows the bucket's size.
    """
    pivots = materialize(members.groupBy("key").agg(F.max(F.struct("degree", "node", "n_shingles", "sketch")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("of_pivot"), F.col("p.sketch").alias("pivot_sketch")), "near-pivots")
    differing = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("pivot_sketch")[i])) for i in range(BITS // 64))
    near = (F.least("n_shingles", "of_pivot") >= threshold * F.greatest("n_shingles", "of_pivot") - 1e-9) & (differing <= most_differing(threshold - MARGIN))
    pairs = members.join(pivots, "key").where((F.col("node") != F.col("pivot")) & near).groupBy("node", "pivot").agg(F.max("m").alias("m"))
    groups = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("m") / PIVOT_GROUP)))).cast("long")
    return pairs.withColumn("g", groups).select("node", "pivot", "g", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("g")).alias("h"))


def pivot_links(texts: DataFrame, pairs: DataFrame, size: int, threshold_percent: int) -> DataFrame:
    """(a, b): the pairs (node, pivot) whose full sets are linked."""
    group = ["pivot", "g", "h"]
    items = pairs.select(*group, "node", F.lit(1).alias("role")).unionByName(pairs.select(*group).distinct().select(*group, F.col("pivot").alias("node"), F.lit(0).alias("role")))
    rows = items.join(texts, "node").repartition(*group).sortWithinPartitions(*group, "role", "node").select(*group, "role", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, last = None, None, None
        for b in batches:
            pairs = []
            for p, g, h, role, node, t in zip(*(b.column(k).to_pylist() for k in range(6))):
                if at != (p, g, h):
                    at, base, last = (p, g, h), None, None
                if (role == 0 and base is not None) or node == last:
                    continue  # a repeated row
                s = shingle_set(t, size)
                if not len(s) or set_key(s) != node[8:]:  # another text under the same doc_id
                    continue
                if role == 0:
                    base = s
                else:
                    last = node
                    if base is not None and exact_links([base, s], threshold_percent)[0, 1]:
                        pairs.append((node, p))
            if pairs:
                yield _star_rows(pairs)

    return rows.mapInArrow(run, "a binary, b binary")


def texts_of(docs: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """node and text of every node that shares a bucket: all that any later step compares, so all texts move once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return members.select("node").distinct().withColumn("doc_id", _doc_of(F.col("node"))).join(texts, "doc_id").select("node", "text")


def dealt(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (node, root and others) of groups with several roots, with own, x and y: the group's tasks are its pairs of blocks (x, y).

    Rows of one root need no comparison with each other.  In a group of more
    than block rows those of the commonest root go to blocks of their own, which
    meet the blocks of other roots alone; so as long as these are one block,
    every row of the commonest root goes to one task.
    """
    roots = rows.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"))
    tops = roots.groupBy(group).agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    tops = materialize(tops.select(group, F.col("top.root").alias("top"), F.when(F.col("m") <= block, 0).otherwise(F.ceil(F.col("top.n") / block)).cast("int").alias("tb"), F.ceil((F.col("m") - F.when(F.col("m") <= block, 0).otherwise(F.col("top.n"))) / block).cast("int").alias("ub")), "near-dealt")
    of_top = (F.col("tb") > 0) & (F.col("root") == F.col("top"))
    place = F.xxhash64("node", F.lit("block"))
    rows = rows.join(tops, group).withColumn("own", F.when(of_top, F.col("ub") + F.pmod(place, F.greatest("tb", F.lit(1)))).otherwise(F.pmod(place, F.col("ub"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ub") - 1 + F.when(of_top, 0).otherwise(F.col("tb")))))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "tb", "ub", "top")


def families(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): spanning stars of the members (key, node, n_shingles, sketch, root) of other roots that share a bucket and whose sketches may reach the threshold."""
    group = ["key", "x", "y"]
    rows = dealt(members, "key", BUCKET_BLOCK).withColumn("r", F.xxhash64("root"))
    rows = rows.repartition(*group).sortWithinPartitions(*group, "node").select(*group, "own", "node", "n_shingles", "sketch", "r")
    most, words = most_differing(threshold - MARGIN), BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _grouped(batches, group):
            node = table.column("node").to_pylist()
            bits = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
            size, own, root = (table.column(c).to_numpy() for c in ("n_shingles", "own", "r"))
            pairs = []
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                g, n, o, r = bits[a:z], size[a:z].astype(float), own[a:z], root[a:z]
                linked = r[:, None] != r[None]
                if o.min() != o.max():
                    linked &= o[:, None] != o[None]
                linked &= np.minimum(n[:, None], n[None]) >= threshold * np.maximum(n[:, None], n[None]) - 1e-9
                for k in range(0, z - a, 64):
                    linked[k:k + 64] &= np.bitwise_count(g[k:k + 64, None] ^ g[None]).sum(2, dtype=np.uint16) <= most
                pairs += [(node[a + i], node[a + j]) for i, j in forest(linked)]
            if pairs:
                yield _star_rows(pairs)

    return rows.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): root is the least node of the component.

    Labels fall to the least of the neighbours', then to their label's own; each
    round is written out, and rounds end when no label falls.  Labels of nodes
    with very many edges, and of labels that very many nodes have, are
    broadcast: they are few.
    """
    edges = edges.where("a != b")
    both = materialize(edges.unionAll(edges.select("b", "a")).distinct(), "edges")
    hubs = heavy_keys(both, "b")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    total = labels.count()
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "root"), "b", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        fallen = materialize(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        if fallen.where("old != root").isEmpty():
            discard(both, fallen)
            return labels
        up = fallen.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = materialize(spread_join(fallen, up, "root", "left", heavy_keys(fallen, "root", total)).select("node", F.coalesce("up", "root").alias("root")), "labels")
        discard(labels, fallen)
        labels = after


def exact_links(sets: list[np.ndarray], threshold_percent: int) -> np.ndarray:
    """The boolean matrix of pairs with 100 * intersection >= threshold_percent * union."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((m, m), np.int64)
    if m <= 6:
        for i in range(m):
            for j in range(i):
                if 100 * min(sizes[i], sizes[j]) >= threshold_percent * max(sizes[i], sizes[j]):
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort()
                    shared[i, j] = shared[j, i] = np.count_nonzero(both[1:] == both[:-1])
    else:
        hashes, doc = np.concatenate(sets), np.repeat(np.arange(m), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[order], doc[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        column = np.cumsum(new) - 1
        keep = np.bincount(column)[column] > 1
        column, doc = column[keep], doc[keep]
        if len(column):
            column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
            for a in range(0, int(column[-1]) + 1, COLUMNS):
                i, j = np.searchsorted(column, [a, a + COLUMNS])
                x = np.zeros((m, COLUMNS), np.float32)
                x[doc[i:j], column[i:j] - a] = 1
                shared += (x @ x.T).astype(np.int64)
    union = sizes[:, None] + sizes[None] - shared
    linked = 100 * shared >= threshold_percent * union
    np.fill_diagonal(linked, False)
    return linked


def confirmed(texts: DataFrame, members: DataFrame, size: int, threshold_percent: int) -> DataFrame:
    """(a, b): spanning stars of the exact links between members (node, family, root) of one family and different roots."""
    group = ["family", "x", "y"]
    rows = dealt(members, "family", FAMILY_BLOCK).withColumn("r", F.xxhash64("root")).join(texts, "node")
    rows = rows.repartition(*group).sortWithinPartitions(*group, "node").select(*group, "own", "node", "r", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _grouped(batches, group):
            node, own, root, texts = table.column("node").to_pylist(), table.column("own").to_numpy(), table.column("r").to_numpy(), table.column("text")
            pairs = []
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                sets, names, rows = [], [], []
                for k in range(a, z):
                    if names and names[-1] == node[k]:
                        continue  # a repeated row
                    s = shingle_set(texts[k].as_py(), size)
                    if len(s) and set_key(s) == node[k][8:]:  # else another text under the same doc_id
                        sets.append(s), names.append(node[k]), rows.append(k)
                if len(sets) < 2:
                    continue
                o, r = own[rows], root[rows]
                linked = exact_links(sets, threshold_percent) & (r[:, None] != r[None])
                if o.min() != o.max():
                    linked &= o[:, None] != o[None]
                pairs += [(names[i], names[j]) for i, j in forest(linked)]
            if pairs:
                yield _star_rows(pairs)

    return rows.mapInArrow(run, "a binary, b binary")


def linked_rows(docs: DataFrame, text: str = "text", size: int = 5, threshold_percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest and root (the name of the component's first node; null without one) of every row of docs."""
    threshold = threshold_percent / 100
    rows = materialize(features(docs, text, size, bands_for(threshold)), "near-features")
    nodes = materialize(nodes_of(rows), "near-nodes")
    members = materialize(members_of(nodes), "near-members")
    pairs = materialize(pivot_pairs(members, threshold), "near-pairs")
    texts = materialize(texts_of(docs, members, text), "near-texts")
    links = components(pivot_links(texts, pairs, size, threshold_percent))
    root = F.coalesce("root", "node").alias("root")
    left = materialize(members.where("m > 2").join(links, "node", "left").select("key", "node", "n_shingles", "sketch", root), "near-left")  # a pair has been compared
    family = components(families(left, threshold)).select("node", F.col("root").alias("family"))
    more = materialize(confirmed(texts, family.join(links, "node", "left").select("node", "family", root), size, threshold_percent), "near-more")
    found = materialize(nodes.select("node", "digest").join(links, "node", "left").select("digest", root), "near-found")
    if not more.isEmpty():
        of_a, of_b = (links.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        tops = components(more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = materialize(spread_join(found, tops, "root", "left", heavy_keys(found, "root")).select("digest", F.coalesce("top", "root").alias("root")), "near-found")
    discard(nodes, members, pairs, texts, left, more, links)
    rows = rows.select("doc_id", "text_hash", "n_shingles", "digest")
    return spread_join(rows, found, "digest", "left", heavy_keys(rows, "digest"))


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, threshold_percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    component_id is the smallest doc_id that links reach, the document's own
    included; kept says that it is the document's own.  Null, empty and blank
    texts have no shingles and no links.  Rows with a null doc_id take part
    only as copies of rows with one; others have no component_id and are kept.
    Other columns of docs, whatever their names, are not read.
    """
    component = F.coalesce(_doc_of(F.col("root")), "doc_id")
    rows = linked_rows(docs, text, size, threshold_percent)
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, threshold_percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one row for each group of near duplicates: that of the smallest doc_id.

    Rows of one doc_id and one text count as one and the first in the order of
    their columns' hash stays; of other texts under that doc_id each is judged
    as a document of its own.  Rows without shingles are no copies of each
    other unless doc_id and text are equal.  Rows with a null doc_id cannot be
    told apart and all stay.  Columns of any name are kept as they are.
    """
    rows = linked_rows(docs, text, size, threshold_percent).where("doc_id is not null")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    grouped = rows.where("root is not null").groupBy("root").agg(first).select("first.*")
    kept = grouped.unionByName(rows.where("root is null").select("doc_id", "text_hash").distinct())
    doc, hashed, rank = free_names(docs.columns, "doc", "hashed", "rank")
    kept = kept.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(hashed))
    own = docs.where("doc_id is not null").withColumn(doc, F.col("doc_id").cast("long")).withColumn(hashed, _text_hash(text))
    order = Window.partitionBy(doc, hashed).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
    once = own.join(kept, [doc, hashed], "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
    return once.unionByName(docs.where("doc_id is null"))
