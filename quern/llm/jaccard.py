"""N-gram Jaccard join by PartEnum signatures, exact at 0.8.

Feature domain: 64-bit shingle hashes. Sizes fall into bands [l, 1.25 l); two linked sets (J >= 0.8) are of one band or
of neighbours, and both sign in the band of the larger. A band cuts the domain into first-level partitions of
``N2`` second-level ones each. Sets of sizes s and t that link differ in k = floor(min(s, t) / 4) features at most, so all but
floor(k / (K2 + 1)) first-level partitions differ in K2 features at most, and there some subset of N2 - K2 second-level
partitions is equal: the contents of each such subset are one signature.

Partitions have one order. A set enumerates them up to its m-th full one, m = floor(k / (K2 + 1)) + 1; a partition is full
if every subset has content, which needs K2 + 1 non-empty parts. Let x's last enumerated partition stand no later than
y's: of x's m full ones at least one differs in K2 features at most, and the equal subset, which has content, is enumerated by y
as well. A set without m full partitions enumerates all of them, and again its first k + 1 single features in hash order
(the finest partition of the domain), where it meets others like it. Empty contents are never signed. Sets of fewer
than four features link with equal ones only, and equal sets are one node.

Partitions of common features (a bounded list, found on a sample) come last, so that a passage which many documents share is
enumerated only by sets that consist of little else. The list changes cost, never the result.

Signatures that the same nodes share are one group. Within a group, bounds by size and by parity bitmaps, both exact, drop
most pairs. Of what is left, first a spanning forest is verified, closest pairs first; then, where a group still has several components, the
closest foreign neighbour of each node; then every pair of different components, in blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise
from .components import components
from .shingles import mix, parity, set_keys, shingle_sets

N2, K2 = 3, 1
SAMPLE_MOD, COMMON_AT, COMMON_MAX = 32, 8, 1 << 17
#: Bytes of texts whose sets are made together, and signatures that a task sorts together.
SLICE, FLUSH = 1 << 19, 1 << 19
#: Signatures of a bucket on average; a bucket is grouped at once.
BUCKET = 1 << 20
#: Nodes that hold one signature among those sorted together, from which they go on as a chunk of their own.
HOT = 256
#: Nodes that are compared at once.
BLOCK = 2048
#: Candidates of a node of which its forest is chosen.
NEAREST = 8

_SUBSETS = list(itertools.combinations(range(N2), N2 - K2))
_ODD = mix(np.arange(1, N2 + 1, dtype=np.uint64)) | np.uint64(1)
_HALF = np.uint64(26)


def bands(most: int) -> np.ndarray:
    """First sizes of the bands up to ``most`` and of one beyond."""
    out = [4]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out)


def signatures(features: np.ndarray, at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (uint64) of sorted sets that stand one after the other, and the number of the set of each; ``common`` is sorted."""
    sizes = np.diff(at)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] >= 4]
    if not len(order):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    features = np.concatenate([features[at[i] : at[i + 1]] for i in order])
    sizes = sizes[order]
    at = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    hashed = mix(features ^ np.uint64(0xA0761D6478BD642F))
    inner = ((hashed & np.uint64(0xFFFFFFFF)) * np.uint64(N2) >> np.uint64(32)).astype(np.int64)
    outer, content = hashed >> np.uint64(32), mix(features)
    halves = [((content >> h) & np.uint64((1 << 26) - 1)).astype(np.float64) for h in (np.uint64(0), _HALF)]
    late = np.zeros(len(features), np.int64)
    if len(common):
        late = (common[np.minimum(np.searchsorted(common, features), len(common) - 1)] == features).astype(np.int64)
    wanted = sizes // 4 // (K2 + 1) + 1
    short = np.zeros(len(sizes), bool)
    out, own = [], []
    starts = bands(int(sizes[-1]))
    for j, start in enumerate(starts.tolist()):
        # Sets of the band, and those of the one below that a partner can be in this one.
        a = np.searchsorted(sizes * 5 // 4, start)
        b = np.searchsorted(sizes, starts[j + 1]) if j + 1 < len(starts) else len(sizes)
        if a >= b:
            continue
        parts = start // 5 + 4
        x, y = at[a], at[b]
        cell = ((doc[x:y] - a) * (2 * parts) + late[x:y] * parts + (outer[x:y] * np.uint64(parts) >> np.uint64(32)).astype(np.int64)) * N2 + inner[x:y]
        low, high = (np.bincount(cell, weights=h[x:y], minlength=(b - a) * 2 * parts * N2).astype(np.uint64) for h in halves)
        held = (low * _ODD[0] + high).reshape(b - a, 2 * parts, N2)
        full = (held != 0).sum(2) > K2
        so_far = np.cumsum(full, 1)
        told = so_far - full < wanted[a:b, None]
        short[a:b] |= so_far[:, -1] < wanted[a:b]
        for number, subset in enumerate(_SUBSETS):
            # The columns of a subset are summed; no content at all stays 0.
            value = sum(held[:, :, q] * _ODD[q] for q in subset)
            d, part = np.nonzero(told & (value != 0))
            out.append(mix(value[d, part] ^ mix((np.uint64(j) << np.uint64(40)) + part.astype(np.uint64) * np.uint64(16) + np.uint64(number))))
            own.append(d + a)
    for d in np.flatnonzero(short).tolist():
        x = slice(at[d], at[d + 1])
        first = np.lexsort((hashed[x], late[x]))[: sizes[d] // 4 + 1]
        out.append(mix(content[x][first] + np.uint64(0x632BE59BD9B4E019)))
        own.append(np.full(len(first), d))
    return np.concatenate(out), order[np.concatenate(own)]


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a few hundred kilobytes of text (or one text) with their sets."""
    for batch in batches:
        until = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(batch):
            done = until[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(until, done + SLICE, side="right")))
            part = batch.slice(begin, end - begin)
            yield part, *shingle_sets([(x or "").encode("utf-8", "surrogatepass") for x in part["text"].to_pylist()])
            begin = end


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, features, at in _each_set(batches):
        bits = [parity(features[a:b]) if b - a >= 4 else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "row_hash": part["row_hash"], "n": pa.array(np.diff(at)), "key": pa.array(set_keys(features, at)), "bits": pa.array(bits, pa.binary())})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for _, features, at in _each_set(batches):
        new = [features[at[i] : at[i + 1]] for i, key in enumerate(set_keys(features, at).tolist()) if key not in seen and not seen.add(key)]
        if new:
            found, n = np.unique(np.concatenate(new), return_counts=True)
            yield pa.RecordBatch.from_pydict({"f": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})


_DEALT = "bucket int, kind int, sigs binary, keys binary, places binary"


def _row(bucket: int, kind: int, sigs: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()), "sigs": [sigs.tobytes()], "keys": [keys.tobytes()], "places": [places.tobytes()]})


def _dealt(sig: np.ndarray, own: np.ndarray, keys: np.ndarray, buckets: int, hot: int, block: int) -> Iterator[pa.RecordBatch]:
    """Signatures of the nodes ``keys`` by bucket: the lower 32 bits of each, the bucket's nodes and which of them holds it (kind 0).

    A signature of more than ``hot`` nodes goes as chunks (kind 2: its group's id, nodes) to buckets drawn by their content, and
    with its first node to its own bucket (kind 1).
    """
    order = np.argsort(sig)
    sig, own = sig[order], own[order]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    lengths = np.diff(np.append(starts, len(sig)))
    bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    kind = np.zeros(len(sig), np.int8)
    for a, n in zip(starts[lengths > hot].tolist(), lengths[lengths > hot].tolist(), strict=True):
        kind[a], kind[a + 1 : a + n] = 1, 2
        nodes, gid = np.sort(keys[own[a : a + n]]), _hot_id(int(bucket[a]), sig[a])
        for x in range(0, n, block):
            yield _row(int(mix(nodes[x : x + 1].view(np.uint64) ^ gid)[0] % np.uint64(buckets)), 2, np.array([gid]), nodes[x : x + block], nodes[:0])
    for k in (0, 1):
        s, o, b = sig[kind == k], own[kind == k], bucket[kind == k]
        cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True]))) if len(b) else np.zeros(1, np.int64)
        for x, y in itertools.pairwise(cuts.tolist()):
            here, place = np.unique(o[x:y], return_inverse=True)
            yield _row(int(b[x]), k, s[x:y].astype(np.uint32), keys[here], place.astype(np.uint16 if len(here) <= 1 << 16 else np.uint32))


def _sign(common, buckets: int, flush: int, hot: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.frombuffer(common.value, np.uint64)
        nodes: dict[int, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            sig, own = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return _dealt(sig, own, np.fromiter(nodes, np.int64, len(nodes)), buckets, hot, block)

        for _, features, at in _each_set(batches):
            keys = set_keys(features, at).tolist()
            new = [i for i, key in enumerate(keys) if key not in nodes and nodes.setdefault(key, len(nodes)) >= 0]
            if not new:
                continue
            ends = np.cumsum([at[i + 1] - at[i] for i in new])
            sig, own = signatures(np.concatenate([features[at[i] : at[i + 1]] for i in new]), np.concatenate(([0], ends)), late)
            held.append((sig, own + (len(nodes) - len(new))))
            size += len(sig)
            if size >= flush:
                yield from out()
                nodes.clear()
                held.clear()
                size = 0
        if size:
            yield from out()

    return run


def _by(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal ``names`` in sorted rows."""
    last, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[n].to_numpy(zero_copy_only=False) for n in names]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0), [True]))
        for x, y in itertools.pairwise(np.flatnonzero(new).tolist()):
            key = tuple(c[x] for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(x, y - x))
    if held:
        yield last, pa.Table.from_batches(held)


_GROUPS = "gid long, chunk long, nodes binary"


def _sum_of(nodes: np.ndarray) -> np.uint64:
    return mix(nodes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)


def _group(block: int):
    """Rows of a bucket together: chunks of nodes (sorted) that share a signature. ``gid`` is the signature where chunks of other
    tasks may belong to the same, else the hash of the nodes, and ``chunk`` is that of the chunk's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _by(batches, "bucket"):
            out: dict[tuple[int, int], bytes] = {}

            def tell(gid: np.uint64 | None, nodes: np.ndarray, out: dict = out) -> None:
                whole = _sum_of(nodes)
                for x in range(0, len(nodes), block):
                    piece = nodes[x : x + block]
                    chunk = whole if len(piece) == len(nodes) else _sum_of(piece)
                    out[int((whole if gid is None else gid).view(np.int64)), int(chunk.view(np.int64))] = piece.tobytes()

            entries = []
            for kind, sigs, keys, places in zip(*(rows[c].to_pylist() for c in ("kind", "sigs", "keys", "places")), strict=True):
                if kind == 2:
                    tell(np.frombuffer(sigs, np.uint64)[0], np.frombuffer(keys, np.int64))
                    continue
                sig = np.frombuffer(sigs, np.uint32)
                place = np.frombuffer(places, np.uint16 if len(places) == 2 * len(sig) else np.uint32)
                entries.append((sig, np.frombuffer(keys, np.int64)[place], kind))
            if entries:
                sig, key = (np.concatenate([e[i] for e in entries]) for i in (0, 1))
                hot = np.concatenate([np.full(len(e[0]), e[2], bool) for e in entries])
                order = np.argsort(sig)
                sig, key, hot = sig[order], key[order], hot[order]
                same = sig[1:] == sig[:-1]
                kept = np.concatenate(([False], same)) | np.concatenate((same, [False])) | hot
                sig, key, hot = sig[kept], key[kept], hot[kept]
                order = np.lexsort((key, sig))
                sig, key, hot = sig[order], key[order], hot[order]
                starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True]))) if len(sig) else np.zeros(1, np.int64)
                for x, y in itertools.pairwise(starts.tolist()):
                    nodes = key[x:y]
                    if nodes[0] != nodes[-1]:
                        tell(_hot_id(int(bucket), sig[x]) if hot[x:y].any() else None, nodes[np.concatenate(([True], nodes[1:] != nodes[:-1]))])
            if out:
                yield pa.RecordBatch.from_pydict({"gid": pa.array([k[0] for k in out], pa.int64()), "chunk": pa.array([k[1] for k in out], pa.int64()), "nodes": pa.array(list(out.values()), pa.binary())})

    return run


def _hot_id(bucket: int, sig: np.integer) -> np.uint64:
    """Of a signature, by its bucket and its lower 32 bits."""
    return mix(np.array([(bucket << 32) + (int(sig) & 0xFFFFFFFF)], np.uint64))[0]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch["nodes"]).to_numpy(zero_copy_only=False) // 8
        nodes = np.frombuffer(b"".join(batch["nodes"].to_pylist()), np.int64)
        yield pa.RecordBatch.from_pydict({c: pa.array(np.repeat(batch[c].to_numpy(), sizes)) for c in ("gid", "chunk")} | {"node": pa.array(nodes)})


class _Rows:
    """Nodes that are compared with each other: parity bitmaps at the shortest one's length."""

    def __init__(self, rows: pa.Table):
        self.node, self.root, self.n = (rows[c].to_numpy().astype(np.int64) for c in ("node", "root", "n"))
        bits = rows["bits"].to_pylist()
        lengths = np.array([len(x) for x in bits])
        width = int(lengths.min()) // 8
        self.bits = np.empty((len(bits), width), np.uint64)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            own = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1, width)
            self.bits[at] = np.bitwise_xor.reduce(own, axis=1)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By and by the pairs (x, y), each in both directions, of different roots that the bounds leave, and how far they are apart for their size.

        100 * both >= 80 * either is 9 * different <= sizes together, and no fewer features differ than bits or than the sizes do.
        """
        step = max(1, (1 << 19) // self.bits.size)
        for a in range(0, len(self.node), step):
            mine = slice(a, a + step)
            together = self.n[mine, None] + self.n[None]
            x, y = np.nonzero((self.root[mine, None] != self.root[None]) & (9 * np.abs(self.n[mine, None] - self.n[None]) <= together))
            apart = np.bitwise_count(self.bits[mine][x] ^ self.bits[y]).sum(1, dtype=np.int64) if len(x) else np.empty(0, np.int64)
            left = 9 * apart <= together[x, y]
            x, y = x[left], y[left]
            yield x + a, y, apart[left] / together[x, y]


_FOUND = "kind int, u long, v long"


def _found(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(u), kind, np.int32)), "u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: a spanning forest of its candidates, closest pairs first (kind 0), and the other candidates (kind 1), or
    the group's id (kind 2: u) if these are many or the group has more chunks.

    Forests of one task continue each other: what would join nodes that are joined already is left to kind 1 or 2.
    """
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for (gid, chunk), table in _by(batches, "gid", "chunk"):
        if len(above) > 1 << 18:
            above.clear()
        nodes = table["node"].to_pylist()
        several = gid != chunk
        if len({top(x) for x in nodes}) > 1:
            rows, edges, count = _Rows(table), [], 0
            for x, y, far in rows.near():
                count += len(x)
                # The closest few of each x; pairs come sorted by x.
                order = np.lexsort((far, x))
                x, y, far = x[order], y[order], far[order]
                if count > 4 * len(nodes):
                    first = np.searchsorted(x, x)
                    few = np.arange(len(x)) - first < NEAREST
                    x, y, far = x[few], y[few], far[few]
                edges.append((x, y, far))
            x, y, far = (np.concatenate([e[i] for e in edges]) for i in range(3))
            once = (x < y) | (count > 4 * len(nodes))
            order = np.argsort(far[once], kind="stable")
            u, v = rows.node[x[once][order]], rows.node[y[once][order]]
            taken = np.zeros(len(u), bool)
            for i, (p, q) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
                p, q = top(p), top(q)
                if p != q:
                    above[p] = q
                    taken[i] = True
            if taken.any():
                yield _found(0, u[taken], v[taken])
            several |= count > 4 * len(nodes)
            if not several and not taken.all():
                yield _found(1, u[~taken], v[~taken])
        else:
            several = True
        if several:
            yield _found(2, np.array([gid]), np.array([gid]))


def _foreign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, of each node the closest candidate of another root."""
    for _, table in _by(batches, "gid", "chunk"):
        rows = _Rows(table)
        for x, y, far in rows.near():
            order = np.lexsort((far, x))
            x, y = x[order], y[order]
            first = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
            if first.any():
                yield _found(0, rows.node[x[first]], rows.node[y[first]])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks (gid, i, j) all candidates of different roots."""
    for (_, i, j), table in _by(batches, "gid", "i", "j"):
        rows, own = _Rows(table), table["own"].to_numpy()
        for x, y, _ in rows.near():
            left = (x < y) & ((own[x] != own[y]) | (i == j))
            if left.any():
                yield _found(0, rows.node[x[left]], rows.node[y[left]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for _, features, at in _each_set(batches):
        keys = set_keys(features, at)
        new = [i for i, key in enumerate(keys.tolist()) if key not in seen and not seen.add(key)]
        if len(seen) > 1 << 16:
            seen.clear()
        if new:
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[new]), "features": pa.array([features[at[i] : at[i + 1]].view(np.int64) for i in new], pa.list_(pa.int64()))})


def _verified(pairs: DataFrame, rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(u, v) of those of ``pairs`` that link. Only texts of nodes in question are read into sets, in one scan."""
    nodes = pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()
    wanted = materialise(facts.join(nodes, "key").select("row_hash"), "wanted")
    sets = rows.join(wanted, "row_hash", "left_semi").select("text").mapInArrow(_sets, "key long, features array<long>")
    sets = materialise(sets.dropDuplicates(["key"]), "sets")
    held = pairs.select("u", "v")
    for side in "uv":
        held = held.join(sets.select(F.col("key").alias(side), F.col("features").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_u", "set_v"))
    held = held.select("u", "v", both.alias("both"), (F.size("set_u") + F.size("set_v")).alias("sizes"))
    return materialise(held.filter("100 * both >= 80 * (sizes - both)").select("u", "v"), "verified")


def _contracted(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (u, v: nodes) are added to ``labels``; only nodes with a link are in it."""
    if labels is None:
        return materialise(components(links), "labels")
    roots = links
    for side in "uv":
        roots = roots.join(labels.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(side, F.coalesce(f"root_{side}", side)).select("u", "v")
    new = materialise(components(roots), "roots")
    moved = labels.join(new.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return materialise(moved.union(new.join(labels, "node", "left_anti").select("node", "root")), "labels")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, row_hash, root) for each row of ``df``; every link between different sets is found.

    Null texts and texts without words have no shingles and link with nothing, not even each other; their component
    is their own id. A null id is no candidate for the smallest id of a component. Repeated rows are in one
    component. ``row_hash`` is that of id and text, ``root`` a number of the component (null without shingles). An empty input gives no rows. Other columns don't matter.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("row_hash"))
    profile = materialise(rows.mapInArrow(_profile, "doc_id long, row_hash long, n long, key long, bits binary"), "profile")
    some = profile.filter("n > 0").select("doc_id", "row_hash", "n", "key")
    # Of each node the smallest id, then of each component.
    least = some.groupBy("key").agg(F.min("doc_id").alias("least"))
    labels = find_components(rows, profile)
    if labels is not None:
        least = least.join(labels, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "least")
        least = materialise(least, "least")
        ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
        least = least.join(ids, "root").select("key", "component_id", "root")
    else:
        least = least.select("key", F.col("least").alias("component_id"), F.col("key").alias("root"))
    found = some.join(materialise(least, "component-ids"), "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row_hash", "root")
    none = F.lit(None).cast("long").alias("root")
    return found.unionByName(profile.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row_hash", none))


def surplus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_hash) of the rows that go when of each component the row with the smallest id stays, a null id coming last.

    Equal ids are told apart by the hash of id and text, so rows repeated in both stay or go together. Rows without shingles stay.
    """
    found = materialise(near_groups(df, id_col, text_col).filter("root is not null").select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash").alias("row")), "near-rows")
    stays = found.groupBy("root").agg(F.min("row").alias("first"))
    return found.join(stays, "root").filter("row.row_hash <> first.row_hash").select("row.row_hash")


def _members(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """(gid, chunk, node): nodes that share a signature."""
    spark = rows.sparkSession
    counted = rows.filter(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(SAMPLE_MOD)) == 0).select("text").mapInArrow(_features, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= COMMON_AT).orderBy(F.desc("n"), "f").limit(COMMON_MAX).select("f").collect()
    common = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    features = profile.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(-(-features // BUCKET), 1 << 30))
    dealt = rows.select("text").mapInArrow(_sign(spark.sparkContext.broadcast(common.tobytes()), buckets, FLUSH, HOT, BLOCK), _DEALT)
    groups = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_group(BLOCK), _GROUPS)
    return materialise(groups.dropDuplicates(["gid", "chunk"]).mapInArrow(_spread, "gid long, chunk long, node long"), "members")


def find_components(rows: DataFrame, profile: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes that link with others, or None where no two do."""
    members = _members(rows, profile)
    facts = materialise(profile.filter("n >= 4").groupBy("key").agg(F.min("row_hash").alias("row_hash"), F.min("n").alias("n"), F.min("bits").alias("bits")), "facts")
    known = facts.select(F.col("key").alias("node"), "n", "bits")

    def compared(held: DataFrame, how) -> DataFrame:
        by_chunk = held.select("gid", "chunk", "node", "root").join(known, "node").select("gid", "chunk", "node", "root", "n", "bits")
        return by_chunk.repartition("gid", "chunk").sortWithinPartitions("gid", "chunk").mapInArrow(how, _FOUND).distinct()

    def of_open(held: DataFrame) -> DataFrame:
        """Members of groups with several roots."""
        held = materialise(held.join(labels, "node", "left").select("gid", "chunk", "node", F.coalesce("root", "node").alias("root")), "held")
        apart = held.groupBy("gid").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("gid")
        return materialise(held.join(apart, "gid", "left_semi"), "open")

    found = materialise(compared(members.withColumn("root", F.col("node")), _forest), "found")
    seen = found.filter("kind = 0").select("u", "v").distinct()
    if seen.isEmpty():
        return None
    labels = _contracted(None, _verified(seen, rows, facts))
    dense = of_open(members.join(found.filter("kind = 2").select(F.col("u").alias("gid")).distinct(), "gid", "left_semi"))
    if not dense.isEmpty():
        closest = materialise(compared(dense, _foreign).select("u", "v").distinct().join(seen, ["u", "v"], "left_anti"), "closest")
        if not closest.isEmpty():
            labels = _contracted(labels, _verified(closest, rows, facts))
            seen = seen.union(closest)
            dense = of_open(dense.select("gid", "chunk", "node"))
    # What is left: the other candidates of the first turn, and every pair of different components in the dense groups.
    rest = found.filter("kind = 1").select("u", "v").union(_blocks(dense.select("gid", "node", "root").distinct(), known).select("u", "v")).distinct()
    for side in "uv":
        rest = rest.join(labels.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    rest = rest.filter("coalesce(root_u, u) <> coalesce(root_v, v)").select("u", "v")
    rest = materialise(rest.join(seen, ["u", "v"], "left_anti"), "rest")
    return labels if rest.isEmpty() else _contracted(labels, _verified(rest, rows, facts))


def _blocks(held: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates among all nodes (gid, node, root) of a group, compared block by block.

    A root of many nodes has blocks of its own, which needn't meet each other; the nodes of the other roots share blocks.
    """
    sizes = held.groupBy("gid", "root").agg(F.count(F.lit(1)).alias("c"))
    large = sizes.filter(F.col("c") >= BLOCK).select("gid", "root", F.ceil(F.col("c") / BLOCK).cast("int").alias("own_blocks"))
    small = sizes.filter(F.col("c") < BLOCK).groupBy("gid").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"))
    dealt = held.join(large, ["gid", "root"], "left").join(small, "gid", "left")
    some = F.xxhash64("node", "gid")
    pure = F.col("own_blocks").isNotNull()
    dealt = dealt.withColumn("of", F.when(pure, F.col("root"))).withColumn("own", F.when(pure, F.xxhash64("root", F.pmod(some, F.col("own_blocks")))).otherwise(F.pmod(some, F.col("blocks"))))
    dealt = materialise(dealt.select("gid", "node", "root", "of", "own"), "dealt")
    blocks = dealt.select("gid", "of", "own").distinct()
    i, j = (blocks.select("gid", F.col("of").alias(f"of_{x}"), F.col("own").alias(x)) for x in "ij")
    meet = i.join(j, "gid").filter((F.col("i") < F.col("j")) & (F.coalesce("of_i", "i") != F.coalesce("of_j", "j")) | (F.col("i") == F.col("j")) & F.col("of_i").isNull()).select("gid", "i", "j")
    ends = meet.select("gid", F.col("i").alias("own"), "i", "j").union(meet.filter("i <> j").select("gid", F.col("j").alias("own"), "i", "j"))
    each = dealt.select("gid", "own", "node", "root").join(ends, ["gid", "own"]).join(known, "node").select("gid", "i", "j", "own", "node", "root", "n", "bits")
    return each.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(_across, _FOUND).distinct()


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return near_groups(documents(spark, sf_dir)).drop("row_hash", "root")
