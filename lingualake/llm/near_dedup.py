"""Near-duplicate detection with SetSketch registers, bands of them, and verification on full sets.

A text's set is that of its five-word shingles. Its sketch holds, for each of REGISTERS hash functions,
the exponential minimum over the set, truncated to a power of BASE, so sketches merge by maximum and two
registers agree about as often as the sets overlap. Equal sets become one node. Nodes that agree in a
band of four registers share a bucket; a pair of similarity 0.75 misses all buckets with a probability
under 1e-6. Inside a bucket the nodes are compared by the joint likelihood of their registers, each only
with leaders that cover it, which splits the nodes into coarse groups without listing pairs. In a coarse
group the links are confirmed on full sets, read again for these nodes only.

Large buckets and groups are dealt out in chunks. Of a large group, first every node is compared with one
pivot; the nodes linked to it are connected and need not be compared among themselves, only with the
others, and chunk meets chunk in a task of its own.

Cases: a null or empty text, or one of white space, has no shingles and no links. Texts of under five words
have one shingle, all of their words. Rows without an id take no part, their component is null and they are
kept. Rows that share an id are one document with several texts. Repeated texts are one node. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, salted_left_join, staged, text_or_empty, with_flag
from .components import components
from .shingles import mixed, shingle_set

REGISTERS, ROWS = 144, 4
BASE, RATE, TOP = 1.12, 20.0, 255
#: Estimates from which pairs go on to verification, join a coarse group, and stand in for each other in it.
CLOSE, COARSE, COVERED = 0.55, 0.5, 0.85
#: Nodes in a chunk of a bucket or group.
CHUNK = 1000
NODE_BITS, KEY_BITS = 25, 27
_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of non-empty sets, one row each."""
    numbers, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    low = np.empty((len(sets), REGISTERS), np.float64)
    for k, factor in enumerate(_FACTORS):
        low[:, k] = np.minimum.reduceat(numbers * factor, starts)
    exponential = -np.log1p(-(low + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint8)


def _chance(x: np.ndarray) -> np.ndarray:
    """The probability that one register exceeds the other, by the share of elements only its set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likely_similarity(above: np.ndarray, below: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the counts of greater and smaller registers likeliest, given both sets' sizes."""
    share = (left / (left + right))[:, None]
    top = np.minimum(share / (1 - share), (1 - share) / share)
    grid = np.linspace(0, 1, 51)[None, :] * top
    up, down = _chance(share - (1 - share) * grid), _chance((1 - share) - share * grid)
    same = np.maximum(1 - up - down, 1e-12)
    equal = REGISTERS - above - below
    gain = above[:, None] * np.log(np.maximum(up, 1e-12)) + below[:, None] * np.log(np.maximum(down, 1e-12)) + equal[:, None] * np.log(same)
    return np.take_along_axis(grid, gain.argmax(1)[:, None], 1)[:, 0]


def _near(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of `many` sketches are likely to have similarity `least` with `one`, and their estimates."""
    agree = (many == one).sum(1)
    rows = np.flatnonzero(agree >= (least - 0.1) * REGISTERS)
    if not len(rows):
        return rows, np.zeros(0)
    above, below = (one > many[rows]).sum(1), (one < many[rows]).sum(1)
    found = likely_similarity(above, below, np.full(len(rows), float(size)), sizes[rows].astype(float))
    return rows[found >= least], found[found >= least]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text")
        for start in range(0, len(texts), 512):
            sets = [shingle_set(t) for t in texts[start : start + 512].to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            regs: list[bytes | None] = [None] * len(sets)
            if full:
                for k, row in zip(full, sketches([sets[k] for k in full]), strict=True):
                    regs[k] = row.tobytes()
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([ids[start : start + 512], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "digest", "regs"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingle_set(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["node", "set"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = REGISTERS // ROWS
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint32).reshape(-1, bands)
        keys = mixed(regs.astype(np.uint64) + (np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(32)))
        nodes = batch.column("node").take(pa.array(np.repeat(np.arange(len(regs)), bands)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), nodes], ["key", "node"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of equal keys in rows sorted by them, across batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(int(c[a]) for c in columns)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _registers(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=_LINKS)


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's chunk, coarse links (node, smallest node that it is connected to), and (leader, null) for each leader.

    A node that a leader covers stands for nothing of its own: what is linked to the node is coarsely
    linked to the leader, too.
    """
    out: list[tuple] = []
    for (key, _), table in _groups(batches, ["key", "chunk"]):
        nodes, sizes, regs = table.column("node").to_numpy(), table.column("n").to_numpy(), _registers(table)
        lead = np.empty(len(nodes), np.int64)
        count = 0
        root = list(range(len(nodes)))
        for k in range(len(nodes)):  # in order of nodes, so the smallest index is the smallest node
            rows, found = _near(regs[k], sizes[k], regs[lead[:count]], sizes[lead[:count]], COARSE)
            tops = {_top(root, k), *(_top(root, int(lead[r])) for r in rows)}
            for top in tops:
                root[top] = min(tops)
            if not (found >= COVERED).any():
                lead[count] = k
                count += 1
        out += [(key, int(nodes[k]), int(nodes[top])) for k in range(len(nodes)) if (top := _top(root, k)) != k]
        out += [(key, int(nodes[k]), None) for k in lead[:count]]
        if len(out) > 20_000:
            yield _covered(out)
            out = []
    yield _covered(out)


def _top(root: list[int], x: int) -> int:
    """The root of `x`, the way there halved."""
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _covered(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["key", "node", "leader"])


def _similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The sizes of intersection and union of two sorted distinct sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both, union = _similarity(a, b)
    return 100 * both >= 75 * union


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what full sets connect, of each task's nodes: between its two chunks, or inside the one."""
    for _, table in _groups(batches, ["group", "one", "two"]):
        nodes, chunk = table.column("node").to_numpy(), table.column("chunk").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        full = [k for k, s in enumerate(sets) if len(s)]
        nodes, chunk, sets = nodes[full], chunk[full], [sets[k] for k in full]
        sizes = np.array([len(s) for s in sets], np.int64)
        regs = sketches(sets) if len(sets) > 2 else None
        apart = len(set(chunk.tolist())) > 1
        root = list(range(len(nodes)))

        found = []
        for k in range(1, len(nodes)):
            if regs is None:
                rows = np.arange(k)
            else:
                rows, likely = _near(regs[k], sizes[k], regs[:k], sizes[:k], CLOSE)
                rows = rows[np.argsort(-likely, kind="stable")]
            for r in rows.tolist():
                if (not apart or chunk[r] != chunk[k]) and _top(root, r) != _top(root, k) and _linked(sets[r], sets[k]):
                    root[_top(root, r)] = _top(root, k)
                    found.append((int(nodes[r]), int(nodes[k])))
        if found:
            yield _pairs(found)


def _from_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similarity of each node with its group's pivot, whose row comes first."""
    group = pivot = None
    for batch in batches:
        out = []
        for g, salt, rank, node, raw in zip(*(batch.column(n).to_pylist() for n in ("group", "salt", "rank", "node", "set")), strict=True):
            own = np.frombuffer(raw, np.uint64)
            if rank == 0:
                group, pivot = (g, salt), own
            elif group == (g, salt):
                both, union = _similarity(pivot, own)
                out.append((g, node, 100 * both >= 75 * union, both / max(1, union)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.float64()))], ["group", "node", "linked", "similarity"])


def _coarse_links(nodes: DataFrame, multi: DataFrame) -> DataFrame:
    """Links (a, b) that put nodes of one bucket in one coarse group if they may be similar; `multi` has (key, node)."""
    rows = multi.join(nodes.select("node", "n", "regs"), "node")
    links = None
    while True:
        sizes = multi.groupBy("key").agg(F.count("*").alias("size"))
        dealt = salted_left_join(rows, sizes, "key", "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK)).cast("bigint"))
        sorted_rows = dealt.select("key", "chunk", "node", "n", "regs").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "node")
        covers = staged(sorted_rows.mapInArrow(_covers, "key bigint, node bigint, leader bigint"))
        found = covers.filter("leader is not null").select(F.col("node").alias("a"), F.col("leader").alias("b"))
        links = found if links is None else links.union(found)
        before = sizes.filter(F.col("size") > CHUNK)
        again = covers.filter("leader is null").select("key", "node").join(before.select("key", "size"), "key")
        fewer = staged(again.groupBy("key", "size").agg(F.count("*").alias("left")).filter((F.col("left") > 1) & (F.col("left") < F.col("size"))))
        stuck = staged(again.groupBy("key", "size").agg(F.count("*").alias("left")).filter((F.col("left") > 1) & (F.col("left") == F.col("size"))))
        if not stuck.isEmpty():  # nothing covers anything there: the bucket is one coarse group
            first = again.join(stuck.select("key"), "key", "left_semi")
            head = first.groupBy("key").agg(F.min("node").alias("b"))
            links = links.union(first.join(head, "key").select(F.col("node").alias("a"), "b"))
        if fewer.isEmpty():
            return links.distinct()
        multi = staged(again.join(fewer.select("key"), "key", "left_semi").select("key", "node"))
        rows = multi.join(nodes.select("node", "n", "regs"), "node")


def _exact_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) confirmed on full sets that connect all that such links connect; `groups` has (node, group), `sets` (node, set)."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"), F.min("node").alias("pivot"))
    placed = staged(groups.join(sizes, "group"))
    large = placed.filter(F.col("size") > CHUNK)
    salts = F.ceil(F.col("size") / CHUNK).cast("bigint")
    others = large.filter("node <> pivot").withColumns({"salt": F.pmod(F.xxhash64("node"), salts), "rank": F.lit(1)})
    pivots = large.filter("node = pivot").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).withColumn("rank", F.lit(0))
    columns = ("group", "salt", "rank", "node")
    star = others.select(*columns).unionByName(pivots.select(*columns)).join(sets, "node").repartition("group", "salt").sortWithinPartitions("group", "salt", "rank")
    measured = staged(star.mapInArrow(_from_pivot, "group bigint, node bigint, linked boolean, similarity double"))
    pivot_of = sizes.select("group", "pivot")
    starred = measured.filter("linked").join(pivot_of, "group").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    # Of a large group, the chunks of what the pivot didn't link come first; only they meet all chunks.
    joined = large.join(measured.select("node", "linked"), "node", "left").withColumn("core", F.coalesce("linked", F.lit(True)))
    counts = joined.groupBy("group").agg(F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("rest"), F.sum(F.when(F.col("core"), 1).otherwise(0)).alias("cores"))
    dealt = joined.join(counts, "group").filter("rest > 0")
    rest, cores = F.ceil(F.col("rest") / CHUNK).cast("bigint"), F.ceil(F.col("cores") / CHUNK).cast("bigint")
    chunk = F.when(F.col("core"), rest + F.pmod(F.xxhash64("node"), cores)).otherwise(F.pmod(F.xxhash64("node"), rest))
    dealt = dealt.withColumns({"chunk": chunk, "firsts": rest, "all": rest + cores})
    as_one = F.transform(F.sequence(F.lit(0).cast("bigint"), F.least("chunk", F.col("firsts") - 1)), lambda a: F.struct(a.alias("one"), F.col("chunk").alias("two")))
    as_two = F.when(F.col("chunk") < F.least(F.col("firsts"), F.col("all") - 1), F.transform(F.sequence(F.col("chunk") + 1, F.col("all") - 1), lambda b: F.struct(F.col("chunk").alias("one"), b.alias("two"))))
    tasks = F.array_distinct(F.concat(as_one, F.coalesce(as_two, F.array().cast("array<struct<one:bigint,two:bigint>>"))))
    spread = dealt.select("group", "node", "chunk", F.explode(tasks).alias("task")).select("group", "node", "chunk", "task.one", "task.two")
    zero = F.lit(0).cast("bigint")
    small = placed.filter(F.col("size").between(2, CHUNK)).select("group", "node", zero.alias("chunk"), zero.alias("one"), zero.alias("two"))
    work = small.unionByName(spread).join(sets, "node").repartition("group", "one", "two").sortWithinPartitions("group", "one", "two", "node")
    return work.mapInArrow(_confirm, "a bigint, b bigint").union(starred)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept): the smallest id that a document is linked to, through others or not."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    docs = staged(rows.mapInArrow(_sketch, "id bigint, n bigint, digest binary, regs binary"))
    nodes = staged(docs.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")))
    bands = nodes.select("node", "regs").mapInArrow(_bands, "key bigint, node bigint")
    shared = staged(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"))
    flagged = with_flag(bands, key_bitmap(shared, F.col("key"), KEY_BITS), F.col("key"), KEY_BITS, "met").filter("met").drop("met")
    multi = staged(flagged)
    groups = components(_coarse_links(nodes, multi)).withColumnRenamed("label", "group")
    groups = staged(groups)
    wanted = with_flag(rows, key_bitmap(groups, F.col("node"), NODE_BITS), F.col("id"), NODE_BITS, "wanted").filter("wanted").select("id", "text")
    sets = staged(wanted.mapInArrow(_sets, "node bigint, set binary"))
    linked = components(_exact_links(groups, sets))
    named = nodes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("label", "node").alias("component"))
    found = salted_left_join(docs.select("id", "n", "digest"), named, "digest", "id")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
