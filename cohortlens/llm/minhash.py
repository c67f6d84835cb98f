"""Near-duplicate groups: b-bit MinHash signatures, a multi-index Hamming join, and a check on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scale import cut_lineage, small_side
from . import texts
from .components import components

WIDTH = 5  # words of a shingle
PERCENT = 75  # similarity of a link, in percent
CELLS = 4_096  # cells of bucket keys counted to find the hot ones
BUCKET_BLOCK = 8_192  # members of a bucket compared by sketch in one go
TASK_ROWS = 4_096  # documents a task takes; few rows are no reason to write files for every shuffle partition
LINK_BLOCK = 262_144  # shingles of a block of a cluster's members, compared by full sets in one go


@dataclass(frozen=True)
class Signature:
    """``chunks`` chunks of ``slots`` MinHash values of 16 bits; a chunk may differ in ``errors`` slots.

    A pair that differs in at most ``chunks * (errors + 1) - 1`` slots has, by pigeonhole, a chunk with at most ``errors``
    differences, so it meets in a bucket: that is a guarantee.  A pair at 75 % similarity differs in 13.5 of 54 slots on
    average; that it meets nowhere has probability 1e-7, and less for closer pairs.  Pairs that met are compared by their
    sizes and by a sketch of ``bins`` one-permutation values (within ``sigmas`` standard errors of the similarity) before
    the full sets decide.
    """

    chunks: int = 9
    slots: int = 6
    errors: int = 2
    seed: int = 7
    bins: int = 256
    sigmas: float = 5.5

    @property
    def size(self) -> int:
        return self.chunks * self.slots

    @property
    def guaranteed(self) -> int:
        return self.chunks * (self.errors + 1) - 1


def signature(grams: np.ndarray, config: Signature) -> np.ndarray:
    """MinHash values of a non-empty shingle set, 16 bits each."""
    random = np.random.default_rng(config.seed)
    flips = random.integers(0, 2**32, config.size, np.uint32)
    factors = random.integers(0, 2**31, config.size, np.uint32) * np.uint32(2) + np.uint32(1)
    folded = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    lowest = np.full(config.size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 1024):
        part = folded[at : at + 1024, None]
        np.minimum(lowest, ((part ^ flips) * factors).min(axis=0), out=lowest)
    return ((lowest ^ (lowest >> np.uint32(15))) & np.uint32(0xFFFF)).astype(np.uint16)


def bin_sketch(grams: np.ndarray, config: Signature) -> np.ndarray:
    """A byte of the smallest hash in each of ``bins`` equal ranges of hash values; 0 for an empty range."""
    bounds = (np.arange(config.bins, dtype=np.uint64) * np.uint64(2**64 // config.bins)).astype(np.uint64)
    first = np.searchsorted(grams, bounds)
    filled = first < np.append(first[1:], len(grams))
    sketch = np.zeros(config.bins, np.uint8)
    sketch[filled] = (grams[first[filled]] % np.uint64(255)).astype(np.uint8) + 1
    return sketch


def plausible(na, nb, ba, bb, config: Signature, percent: int) -> np.ndarray:
    """Which pairs of (size, bins) may be links: row by row, or one first row against many."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    keep = 100 * low >= percent * high  # even as a subset a smaller set could not reach the similarity
    rows = np.flatnonzero(keep)
    a, b = ba if ba.ndim == 1 else ba[rows], bb[rows]
    filled = ((a > 0) | (b > 0)).sum(axis=-1)
    share = ((a == b) & (a > 0)).sum(axis=-1) / np.maximum(filled, 1)
    # the filled bins are a sample without replacement of a union this large if the pair is at the similarity
    target = percent / 100
    union = np.maximum(((na + nb) / (1 + target))[rows], filled)
    error = np.sqrt(target * (1 - target) / np.maximum(filled, 1) * (union - filled) / np.maximum(union - 1, 1))
    keep[rows] = share >= target - config.sigmas * error - 2 / np.maximum(filled, 1)
    return keep


def chunk_keys(signatures: np.ndarray, config: Signature) -> np.ndarray:
    """Bucket keys of signatures [rows, slots]: per chunk one for every choice of slots that are allowed to differ."""
    rows = signatures.astype(np.uint64).reshape(len(signatures), config.chunks, config.slots)
    keys = []
    for chunk in range(config.chunks):
        for i, agreed in enumerate(combinations(range(config.slots), config.slots - config.errors)):
            value = np.full(len(rows), chunk * 1_000 + i + 1, np.uint64)
            for slot in agreed:
                value = texts.mix(value * np.uint64(0x9E3779B97F4A7C15) + rows[:, chunk, slot])
            keys.append(value)
    return np.stack(keys, axis=1).view(np.int64)


def _sketches(documents: DataFrame, config: Signature) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set and signature of every document, from its whole text."""

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        counts, digests, signs, bins = [], [], [], []
        for text in batch.column(1):
            grams = texts.shingles(text.as_py(), WIDTH)
            counts.append(len(grams))
            digests.append(texts.xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
            signs.append(signature(grams, config).tobytes() if len(grams) else None)
            bins.append(bin_sketch(grams, config).tobytes() if len(grams) else None)
        yield {"doc_id": batch.column(0), "n_shingles": counts, "digest": digests, "signature": signs, "bins": bins}

    schema = "doc_id long, n_shingles long, digest binary, signature binary, bins binary"
    return texts.map_batches(documents.select(F.col("doc_id").cast("long"), "text"), kernel, schema)


def _buckets(classes: DataFrame, config: Signature, tasks: int) -> DataFrame:
    """key, id of every class and bucket, buckets of one member left out, with the bucket's smallest id as hub.

    Keys fall into ``CELLS`` cells whose rows are counted first.  In a cell of ordinary size no bucket is large, so a window
    over the key serves; cells of more than twice the mean hold the buckets many classes share, which are counted by merged
    partial counts and joined back, dealt to as many tasks as they need.
    """

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), config.size)
        for at in range(0, len(ids), 2_000):
            keys = chunk_keys(signs[at : at + 2_000], config)
            yield {"key": keys.ravel(), "id": np.repeat(ids[at : at + 2_000], keys.shape[1])}

    keyed = texts.map_batches(classes.select("id", "signature"), kernel, "key long, id long")
    cell = F.pmod("key", F.lit(CELLS))
    counts = {r["cell"]: r["n"] for r in keyed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).coalesce(tasks).collect()}  # at most ``CELLS``
    hot = [c for c, n in counts.items() if n * CELLS > 2 * sum(counts.values())]
    bucket = Window.partitionBy("key")
    cool = keyed.where(~cell.isin(hot)).withColumn("n", F.count(F.lit(1)).over(bucket)).withColumn("hub", F.min("id").over(bucket))
    warm = keyed.where(cell.isin(hot))
    shared = warm.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"))
    both = cool.where("n > 1").select("key", "id", "hub").unionByName(warm.join(shared.where("n > 1"), "key").select("key", "id", "hub"))
    return both.coalesce(tasks)


_SKETCH = ["n", "bins"]


def _arrays(columns, config: Signature) -> list[np.ndarray]:
    """Sizes and bins of a batch as arrays."""
    n, bins = columns
    sizes = n.to_numpy(zero_copy_only=False) if isinstance(n, pa.Array) else n.to_numpy()
    return [sizes, np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(len(sizes), config.bins)]


def _within_reach(pairs: DataFrame, classes: DataFrame, config: Signature, percent: int, tasks: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bins let them be links."""
    side = lambda end: classes.select(F.col("id").alias(end), *[F.col(c).alias(c + end) for c in _SKETCH])
    sided = pairs.join(side("a"), "a").coalesce(tasks).join(side("b"), "b").coalesce(tasks)

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        (na, ba), (nb, bb) = (_arrays([batch.column(c + end) for c in _SKETCH], config) for end in "ab")
        near = plausible(na, nb, ba, bb, config, percent)
        yield {name: batch.column(name).to_numpy(zero_copy_only=False)[near] for name in "ab"}

    return texts.map_batches(sided, kernel, "a long, b long")


def _sets(ids: DataFrame, documents: DataFrame, tasks: int) -> DataFrame:
    """id and full shingle set of the documents in ``ids``, read again from their texts."""
    wanted = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(small_side(ids.distinct().coalesce(tasks)), "id", "left_semi")

    def sets(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"id": batch.column(0), "grams": [texts.shingles(t.as_py(), WIDTH).tobytes() for t in batch.column(1)]}

    return texts.map_batches(wanted, sets, "id long, grams binary")


def _confirm(pairs: DataFrame, documents: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.  Only documents in a pair are read again."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    grams = _sets(ids, documents, tasks)
    sided = pairs.join(grams.withColumnsRenamed({"id": "b", "grams": "gb"}), "b").coalesce(tasks)
    sided = sided.join(grams.withColumnsRenamed({"id": "a", "grams": "ga"}), "a").coalesce(tasks)

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        linked = np.zeros(batch.num_rows, bool)
        for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
            ga, gb = (np.frombuffer(x.as_py(), np.uint64) for x in (left, right))
            low, high = sorted((len(ga), len(gb)))
            if 100 * low < percent * high:  # even as a subset it could not reach the similarity
                continue
            common = low + high - len(np.unique(np.concatenate((ga, gb))))
            linked[i] = 100 * common >= percent * (low + high - common)
        yield {name: batch.column(i).to_numpy(zero_copy_only=False)[linked] for i, name in enumerate("ab")}

    return texts.map_batches(sided.select("a", "b", "ga", "gb"), kernel, "a long, b long").distinct().coalesce(tasks)


def _open_components(buckets: DataFrame, labels: DataFrame, classes: DataFrame, config: Signature, percent: int, tasks: int) -> DataFrame:
    """Pairs of components (a, b) that may be linked: some members share a bucket and their sketches allow a link.

    Buckets whose members are all connected are done.  In the others most members are often connected already: the others
    are compared among themselves, bucket by bucket, and with that largest component once, whatever number of buckets
    they share with it.  Comparing is by sketch, inside the task; components found close are one from there on, so a group
    of rows gives fewer pairs than it has members.  Groups are dealt out in pairs of blocks of ``BUCKET_BLOCK`` members, so
    no task holds more than two blocks, and a sketch moves once for each such pair.
    """
    labelled = buckets.select("key", "id").join(labels, F.col("id") == F.col("node"), "left")
    labelled = labelled.select("key", "id", F.coalesce("component", "id").alias("component")).coalesce(tasks)
    shares = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).coalesce(tasks)
    largest = shares.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count(F.lit(1)).alias("parts"))
    members = cut_lineage(labelled.join(largest.where("parts > 1").drop("parts"), "key").coalesce(tasks))
    few = members.where("component <> major")
    sketched = classes.select("id", *_SKETCH)

    among = few.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    among = among.where("low < high").select("key", _blocks("members").alias("blocks"))
    dealt = _block_pairs(few.drop("major").join(among, "key").coalesce(tasks).join(sketched, "id").coalesce(tasks), "key", "id")
    columns = ["key", "i", "j", "mine", "component", *_SKETCH]

    apart = few.select(F.col("major").alias("key"), "id", "component").distinct().coalesce(tasks)
    joined = members.where("component = major").select(F.col("major").alias("key"), "id").distinct().coalesce(tasks)
    count = lambda rows, name: rows.groupBy("key").agg(_blocks(F.count(F.lit(1))).alias(name))
    sizes = count(apart, "rows").join(count(joined, "columns"), "key")
    place = lambda n: F.pmod(F.xxhash64("key", "id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meet = lambda rows: rows.join(sizes, "key").coalesce(tasks).join(sketched, "id").coalesce(tasks)
    side = meet(apart).withColumns({"i": place("rows"), "j": each("columns")})
    side = side.withColumns({"j": -1 - F.col("j"), "mine": F.col("i")})  # blocks of the large component have numbers below 0
    core = meet(joined).withColumns({"j": -1 - place("columns"), "i": each("rows")})
    core = core.withColumns({"mine": F.col("j"), "component": F.col("key")})
    dealt = dealt.select(*columns).unionByName(side.select(*columns)).unionByName(core.select(*columns))
    schema, arrow = texts.schemas("a long, b long")

    def one(i, j, mine, comp, n, bins):
        """Pairs of components of one group of rows."""
        label = comp.copy()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        for row in left:
            other = right[right > row] if i == j else right
            other = other[label[other] != label[row]]
            if len(other) == 0:
                continue
            near = other[plausible(n[row], n[other], bins[row], bins[other], config, percent)]
            for found in near:
                if label[found] != label[row]:
                    yield min(comp[row], comp[found]), max(comp[row], comp[found])
                    label[label == label[found]] = label[row]

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            groups = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield _pairs(table.slice(0, last), groups[:last], np.concatenate(([0], cuts)))
            rest = table.slice(last)
        if rest is not None:
            groups = np.stack([rest.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            yield _pairs(rest, groups, np.array([0, rest.num_rows]))

    def _pairs(table, groups, cuts):
        found: set[tuple[int, int]] = set()
        if table.num_rows:
            mine, comp = table.column("mine").to_numpy(), table.column("component").to_numpy()
            n, bins = _arrays([table.column(c) for c in _SKETCH], config)
            for at, end in zip(cuts[:-1], cuts[1:]):
                found.update(one(groups[at, 1], groups[at, 2], *(x[at:end] for x in (mine, comp, n, bins))))
        columns = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(columns[:, k]) for k in (0, 1)], schema=arrow)

    keys = ["key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema).coalesce(tasks).distinct().coalesce(tasks)


def _blocks(members: Column | str) -> Column:
    return F.ceil((F.col(members) if isinstance(members, str) else members) / BUCKET_BLOCK).cast("int")


def _block_pairs(members: DataFrame, group: str, member: str) -> DataFrame:
    """Every member once per pair of blocks (i, j) of its group that holds its own block (``mine``); ``blocks`` tells how many."""
    block = F.pmod(F.xxhash64(group, member), F.col("blocks")).cast("int")
    dealt = members.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})


def _links_across(
    open_components: DataFrame, labels: DataFrame, classes: DataFrame, documents: DataFrame, percent: int, tasks: int
) -> DataFrame:
    """Links between the components that may be linked, decided on full shingle sets where both sets are at hand.

    Components that hang together over open pairs are a cluster.  A cluster's largest component is connected already: its
    blocks meet those of the other members, not one another, and the others meet in pairs of blocks.  Blocks are cut by
    shingles, so long texts make blocks of few members.  A task counts common shingles through an inverted index of its two
    blocks and reports a link only where it connects components that it has not connected yet, so links leave it, not pairs.
    """
    touched = components(open_components, tasks).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    known = labels.select(F.col("node").alias("id"), "component")
    alone = touched.select(F.col("component").alias("id"), "component").join(known.select("id"), "id", "left_anti").coalesce(tasks)
    sized = classes.groupBy("id").agg(F.sum("n").alias("shingles"))
    members = known.unionByName(alone).join(touched, "component").coalesce(tasks).join(sized, "id")
    members = cut_lineage(members.select("id", "component", "cluster", "shingles").coalesce(tasks))
    parts = members.groupBy("cluster", "component").agg(F.sum("shingles").alias("shingles")).coalesce(tasks)
    major = F.max_by("component", F.struct("shingles", "component")).alias("major")
    clusters = parts.groupBy("cluster").agg(major, F.max("shingles").alias("most"), F.sum("shingles").alias("all"))
    blocks = lambda shingles: F.greatest(F.ceil(shingles / LINK_BLOCK), F.lit(1)).cast("int")
    clusters = clusters.select("cluster", "major", blocks(F.col("most")).alias("cores"), blocks(F.col("all") - F.col("most")).alias("blocks"))
    members = members.drop("shingles").join(clusters, "cluster").coalesce(tasks)
    others = members.where("component <> major")
    among = _block_pairs(others, "cluster", "id")
    place = lambda n: F.pmod(F.xxhash64("cluster", "id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = others.withColumns({"i": place("blocks"), "j": each("cores")})
    side = side.withColumns({"j": -1 - F.col("j"), "mine": F.col("i")})  # blocks of the largest component have numbers below 0
    core = members.where("component = major").withColumns({"j": -1 - place("cores"), "i": each("blocks")}).withColumn("mine", F.col("j"))
    columns = ["cluster", "i", "j", "mine", "id", "component"]
    dealt = among.select(*columns).unionByName(side.select(*columns)).unionByName(core.select(*columns))
    dealt = dealt.join(_sets(members.select("id"), documents, tasks), "id").coalesce(tasks)

    def link(key, table):
        mine, ids, label = (table.column(c).to_numpy() for c in ("mine", "id", "component"))
        label, i, j = label.copy(), key[1].as_py(), key[2].as_py()
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        sizes = np.array([len(g) for g in sets])
        owners = np.repeat(np.arange(len(sets)), sizes)
        gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
        posted = owners[np.argsort(gram, kind="stable")]  # documents of each gram, gram by gram
        ends = np.cumsum(np.bincount(gram))
        starts, first = np.concatenate(([0], ends[:-1])), np.cumsum(sizes) - sizes
        a, b = [], []
        for row in np.flatnonzero(mine == i):
            other = mine == j
            other[: row + 1] &= i != j
            other &= (label != label[row]) & (100 * np.minimum(sizes, sizes[row]) >= percent * np.maximum(sizes, sizes[row]))
            if not other.any():
                continue
            mine_grams = gram[first[row] : first[row] + sizes[row]]
            widths = ends[mine_grams] - starts[mine_grams]
            at = np.arange(widths.sum()) + np.repeat(starts[mine_grams] - (np.cumsum(widths) - widths), widths)
            common = np.bincount(posted[at], minlength=len(sets))
            for found in np.flatnonzero(other & (100 * common >= percent * (sizes + sizes[row] - common))):
                if label[found] != label[row]:
                    a.append(ids[row])
                    b.append(ids[found])
                    label[label == label[found]] = label[row]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long").coalesce(tasks).distinct().coalesce(tasks)


def near_groups(documents: DataFrame, percent: int = PERCENT, config: Signature = Signature()) -> DataFrame:
    """Near-duplicate group of every document: doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * |intersection| >= percent * |union| of their distinct five-word shingles.
    Fewer than five words are one shingle; a document without words (null or empty text) is linked with nothing and is its own group.
    component_id is the smallest doc_id reachable over links, kept marks the document that carries it.  Equal sets are one
    class under their smallest doc_id and never pair among themselves.  Rows that share a doc_id count as one document
    that links with what any of them links with; rows without doc_id have no component and stay.  Other columns are ignored.

    The links are found in two rounds: every member of a bucket is checked against the bucket's smallest id, which
    connects a group of any size with a few pairs each; then components that share a bucket and are still apart, though
    their sketches allow a link, are compared member by member.  A pair left out is one already connected.

    Every step runs in as many tasks as the counted documents need (never more than the session's shuffle partitions).
    """
    return _near_groups(documents, percent, config)[0]


def _near_groups(documents: DataFrame, percent: int, config: Signature) -> tuple[DataFrame, int]:
    """(the groups, the tasks their steps ran in)."""
    sketches = cut_lineage(_sketches(documents, config))
    tasks = max(documents.sparkSession.sparkContext.defaultParallelism, 1 + sketches.count() // TASK_ROWS)
    named = sketches.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = cut_lineage(
        named.groupBy("digest", F.col("n_shingles").alias("n"), "signature", "bins").agg(F.min("doc_id").alias("id")).coalesce(tasks)
    )
    buckets = cut_lineage(_buckets(classes, config, tasks))
    spokes = buckets.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = cut_lineage(_within_reach(spokes.coalesce(tasks), classes, config, percent, tasks))
    links = cut_lineage(_confirm(first, documents, percent, tasks))
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    held = named.join(repeated, "doc_id", "left_semi").join(classes.select("id", "digest"), "digest")
    links = links.unionByName(held.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).coalesce(tasks))
    labels = components(links, tasks)
    still_open = cut_lineage(_open_components(buckets, labels, classes, config, percent, tasks))
    second = _links_across(still_open, labels, classes, documents, percent, tasks)
    joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)
    final = components(joined, tasks)
    owners = named.select("doc_id", "digest").distinct().coalesce(tasks).join(classes.select("id", "digest"), "digest")
    owners = owners.coalesce(tasks).join(final, F.col("id") == F.col("node"), "left").coalesce(tasks)
    placed = owners.groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    result = sketches.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    result = result.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
    return result.coalesce(tasks), tasks


def keep_one(documents: DataFrame, percent: int = PERCENT, config: Signature = Signature()) -> DataFrame:
    """The documents that stay, all columns: one of each near-duplicate group, and every row without doc_id."""
    groups, tasks = _near_groups(documents, percent, config)
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped_id")).distinct().coalesce(tasks)
    return documents.join(small_side(dropped), F.col("doc_id") == F.col("__dropped_id"), "left_anti")
