"""Similarity join on word shingles by vertical partitioning (operator 1).

A document's set is its distinct n-grams of SHINGLE words; two sets link when 100 * |intersection| >= 75 * |union|.

1. Equal sets are one node. All n-grams are counted, dealt out by hash ranges as arrays, and those in more than
   COMMON nodes get a place at the end of the global order, the more frequent the later; the rest are ordered by hash.
2. The global order is cut vertically into fragments: contiguous pieces, with cuts where the cumulative frequency of what
   is sent reaches equal shares. Each node sends the n-grams of its prefix (one more than it may
   lack of a partner's) to their fragments; there pairs of nodes that share n-grams, and whose sizes allow a link, are
   counted, and the partial overlaps are summed for each pair. Pairs whose prefixes have too little in common cannot link.
3. Sets of the remaining pairs are cut into PARTS contiguous fragments of the order, each of which counts the partial
   overlaps of its pairs by itself. They are summed for each pair, and the sum decides.
4. Where more than CROWD nodes share one n-gram of their prefixes no pairs are written: they are a crowd around its least
   node. All are compared with that one, which takes time in proportion to the crowd; those that link with it are of
   one component and need no more. The distance 1 - |intersection| / |union| is a metric, so a node farther from the
   middle than twice the distance of a link links with none of those; nodes in between are compared with those of
   them that are near enough, in blocks of BLOCK nodes by distance. The rest gets another middle, ROUNDS times. What has no
   middle near then is compared block by block, with a spanning forest of its links.
5. Components come from alternating stars over the links.

Only sums, candidates and sets of candidates move; nothing is collected but the common n-grams, at most MOST_COMMON
(the limit is raised to the next power of two until they are no more), and counts of nodes by size class. Sets are kept as 64-bit hashes of their n-grams.

Defined results: a null or blank text has an empty set, links with nothing and is a component of its own; a text of
fewer than SHINGLE words is one n-gram; ties and equal rows are equal nodes; a null id never names a component; a table
without rows gives none; other columns are not read by :func:`op1`, and :func:`keep_one` keeps them under any names; texts and sets are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, partitions, release, shared_dir, stored
from .components import components

SHINGLE = 5
#: A link: PER * intersection >= SHARE * union.
SHARE, PER = 75, 100
COMMON, MOST_COMMON = 16, 1_000_000
CROWD, BLOCK, ROUNDS = 64, 256, 4
#: Fragments of the order, at least, and n-grams of prefixes for each beyond that.
FRAGMENTS, FRAGMENT_ROWS = 64, 4_000_000
#: Fragments in which the overlap of two sets is counted (a power of two).
PARTS = 4
#: Bytes of the table for each range in which n-grams are counted.
RANGE_BYTES = 8 << 20
FLUSH = 2_000_000
MOST_WORDS = 300_000

_U = np.uint64
_SIX = np.dtype([("lo", "<u2"), ("hi", "<u4")])
_ENTRY = np.dtype([("gram", "<u8"), ("node", "<i8"), ("size", "<u2")])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _forget() -> None:
    """At the end of a task."""
    _WORDS.clear()
    release()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams. Only A-Z are lower-cased, only ASCII white space divides words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=_U)
    ids = np.fromiter(map(_WORDS.__getitem__, words), dtype=_U, count=len(words))
    width = min(SHINGLE, len(ids))
    h = np.full(len(ids) - width + 1, width, dtype=_U)
    for k in range(width):
        h = h * _U(0x9E3779B97F4A7C15) + ids[k : k + len(h)]
    h = _mixed(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def node_of(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    return n - (SHARE * n + PER - 1) // PER + 1


def links(both: int, a: int, b: int) -> bool:
    return PER * both >= SHARE * (a + b - both)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-SHARE * (a + b) // (PER + SHARE))


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int32)


def _cut(to: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Distinct values of a sorted array and the slices that hold them."""
    heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    return to[heads], list(zip(heads.tolist(), np.append(heads[1:], len(to)).tolist()))


_COUNTED = "range int, once binary, more binary, doc_id long, text_key long, n long, node long"
_COUNTED_ARROW = pa.schema([("range", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])
_FIRST = "doc_id long, text_key long, n long, node long, gram long, df long"
_FIRST_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("gram", pa.int64()), ("df", pa.int64())])
_MORE = np.dtype([("gram", _SIX), ("n", "<u4")])


def _six(grams48: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams48), dtype=_SIX)
    out["lo"], out["hi"] = grams48 & _U(0xFFFF), grams48 >> _U(16)
    return out


def _long(six: np.ndarray) -> np.ndarray:
    return (six["hi"].astype(_U) << _U(16)) | six["lo"].astype(_U)


def _count(ranges: int):
    """A row for each document, and its n-grams (the upper 48 bits) in blobs for each range, counted within the task."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate(held)
        grams.sort()
        heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff(np.append(heads, len(grams)))
        grams = grams[heads]
        to, slices = _cut(_range_of(grams << _U(16), ranges))
        once, more = [], []
        for a, b in slices:
            g, c = grams[a:b], counts[a:b]
            once.append(_six(g[c == 1]).tobytes())
            m = np.zeros(int((c > 1).sum()), dtype=_MORE)
            m["gram"], m["n"] = _six(g[c > 1]), c[c > 1]
            more.append(m.tobytes())
        n = len(to)
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(once, pa.binary()), pa.array(more, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(4))], schema=_COUNTED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            nodes, sizes = [], []
            for text in batch.column(2).to_pylist():
                grams = shingles(text or b"")
                node = node_of(grams) if len(grams) else None
                nodes.append(node)
                sizes.append(len(grams))
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(grams >> _U(16))
                    size += len(grams)
            n = len(nodes)
            to = pa.array([((x or 0) ^ (d or 0) * 0x9E3779B97F4A7C15) % ranges for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.int32())  # copies apart
            yield pa.RecordBatch.from_arrays([to, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], schema=_COUNTED_ARROW)
            if size > FLUSH:
                yield send(held)
                held, size = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            yield send(held)
        _forget()

    return run


def _sum_up(table: pa.Table) -> pa.Table:
    """Documents as they are; n-grams of the range that more than COMMON nodes have, with how many."""
    docs = table.filter(pa.compute.is_valid(table.column("n"))).select(["doc_id", "text_key", "n", "node"])
    out = [docs.append_column("gram", pa.nulls(docs.num_rows, pa.int64())).append_column("df", pa.nulls(docs.num_rows, pa.int64()))]
    once = [_long(np.frombuffer(b, dtype=_SIX)) for b in table.column("once").to_pylist() if b]
    more = [np.frombuffer(b, dtype=_MORE) for b in table.column("more").to_pylist() if b]
    if once or more:
        grams = np.concatenate([*once, *(_long(m["gram"]) for m in more)])
        counts = np.concatenate([np.ones(sum(map(len, once)), dtype=np.int64), *(m["n"].astype(np.int64) for m in more)])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        sums = np.add.reduceat(counts, heads)
        common = sums > COMMON
        g = grams[heads][common].astype(np.int64)
        out.append(pa.table([*(pa.nulls(len(g), pa.int64()) for _ in range(4)), pa.array(g), pa.array(sums[common])], schema=_FIRST_ARROW))
    return pa.concat_tables([t.cast(_FIRST_ARROW) for t in out])


def places(grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places in the global order: by rank (0: not common), then by hash."""
    return (ranks.astype(_U) << _U(56)) | (grams >> _U(8))


def cuts(by_size: list[tuple[int, int]], common: np.ndarray, ranks: np.ndarray, fragments: int) -> np.ndarray:
    """Where the global order is cut, so that each fragment gets a like share of prefixes: ``by_size`` has (n-grams of a set, nodes).

    The hashes of a set are even over the order, and its prefix is its first n-grams, so that up to the share x of the order
    a set of n has about min(prefix, n * x) of them (less what the spread of n * x takes over the prefix). Common n-grams follow, by the frequencies of their ranks.
    """
    grid = np.arange(1, 4097) / 4096
    upto = np.zeros(len(grid))
    for n, nodes in by_size:
        spread = np.sqrt(n * grid * (1 - grid) + 1e-9)
        upto += nodes * (n * grid - spread / 1.702 * np.logaddexp(0, 1.702 * (n * grid - prefix_length(n)) / spread))
    upto = np.maximum.accumulate(upto)
    share = np.arange(1, fragments) / fragments * (upto[-1] if len(by_size) else 1)
    rare = np.interp(share, np.concatenate([[0], upto]), np.concatenate([[0], grid])) * float(1 << 56) if len(by_size) else share
    edges = [np.unique(rare.astype(_U)), np.array([1 << 56], dtype=_U)]
    if len(common):
        order = np.argsort(places(common << _U(16), ranks), kind="stable")
        frequency = np.cumsum(np.exp2(ranks[order].astype(np.float64)))
        at = np.searchsorted(frequency, np.arange(1, fragments // 4) / (fragments // 4) * frequency[-1])
        edges.append(np.unique(places(common[order][np.minimum(at, len(order) - 1)] << _U(16), ranks[order][np.minimum(at, len(order) - 1)])))
    return np.concatenate(edges)


def _prefixes(edges: np.ndarray, common: np.ndarray, ranks: np.ndarray):
    """Entries of each node's prefix in blobs for each fragment; ``common`` (48 bits, sorted) come last, by ``ranks``."""

    def send(grams: list[np.ndarray], places_: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
        entries = np.zeros(sum(map(len, grams)), dtype=_ENTRY)
        lengths = [len(g) for g in grams]
        entries["gram"], entries["node"] = np.concatenate(grams), np.repeat(np.array(nodes, dtype=np.int64), lengths)
        entries["size"] = np.repeat(_size_codes(np.array(sizes)), lengths)
        to = np.searchsorted(edges, np.concatenate(places_), side="right")
        order = np.argsort(to, kind="stable")
        entries = entries[order]
        keys, slices = _cut(to[order])
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array([entries[a:b].tobytes() for a, b in slices], pa.binary())], ["range", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, where, nodes, sizes, size, seen = [], [], [], [], 0, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                g = shingles(text or b"")
                if not len(g):
                    continue
                node = node_of(g)
                if node in seen:
                    continue
                seen.add(node)
                place = g >> _U(8)
                if len(common):
                    short = g >> _U(16)
                    at = np.minimum(np.searchsorted(common, short), len(common) - 1)
                    late = common[at] == short
                    if late.any():
                        place = places(g, np.where(late, ranks[at], 0))
                        order = np.argsort(place, kind="stable")
                        g, place = g[order], place[order]
                n = len(g)
                grams.append(g[: prefix_length(n)])
                where.append(place[: prefix_length(n)])
                nodes.append(node)
                sizes.append(n)
                size += len(grams[-1])
            if size > FLUSH // 4:
                yield send(grams, where, nodes, sizes)
                grams, where, nodes, sizes, size = [], [], [], [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if grams:
            yield send(grams, where, nodes, sizes)
        _forget()

    return run


def _size_codes(sizes: np.ndarray) -> np.ndarray:
    return (np.log2(sizes) * 512).astype(np.uint16)


#: Codes of sizes that allow a link differ by no more.
_CODE_GAP = int(np.log2(PER / SHARE) * 512) + 2


def _partial_overlaps(table: pa.Table) -> pa.Table:
    """In one fragment: (a, b, n) for pairs that share n n-grams; (least, node, null) for each node of a crowd."""
    blobs = [np.frombuffer(b, dtype=_ENTRY) for b in table.column("entries").to_pylist() if b]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    if not blobs:
        return pa.Table.from_batches([], schema=schema)
    e = np.concatenate(blobs)
    e = e[np.lexsort((e["node"], e["gram"]))]
    e = e[np.concatenate([[True], (e["gram"][1:] != e["gram"][:-1]) | (e["node"][1:] != e["node"][:-1])])]
    heads = np.flatnonzero(np.concatenate([[True], e["gram"][1:] != e["gram"][:-1]]))
    sizes = np.diff(np.append(heads, len(e)))
    node, code = e["node"], e["size"].astype(np.int64)
    pairs, most = [], 1_000_000
    for k in range(2, CROWD + 1):
        starts = heads[sizes == k]
        if not len(starts):
            continue
        i, j = np.triu_indices(k, 1)
        for at in range(0, len(starts), max(1, 250_000 // len(i))):
            some = starts[at : at + max(1, 250_000 // len(i)), None]
            x, y = (some + i).ravel(), (some + j).ravel()
            fit = np.abs(code[x] - code[y]) <= _CODE_GAP
            pairs.append(np.stack([node[x[fit]], node[y[fit]]], axis=1))
            if sum(map(len, pairs)) > most:
                pairs = [_summed(pairs)]
                most = max(most, 2 * len(pairs[0]))
    out = []
    if pairs:
        found = _summed(pairs)
        out.append(pa.table([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2])], schema=schema))
    crowds = []
    for start, k in zip(heads[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist()):
        some = node[start : start + k]
        crowds.append(np.stack([np.full(k, some[0]), some], axis=1))
    if crowds:
        star = np.unique(np.concatenate(crowds), axis=0)
        out.append(pa.table([pa.array(star[:, 0]), pa.array(star[:, 1]), pa.nulls(len(star), pa.int64())], schema=schema))
    return pa.concat_tables(out) if out else pa.Table.from_batches([], schema=schema)


def _summed(pairs: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b) or (a, b, n) added up by pair."""
    rows = np.concatenate([p if p.shape[1] == 3 else np.concatenate([p, np.ones((len(p), 1), np.int64)], axis=1) for p in pairs])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    heads = np.flatnonzero(np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])) if len(rows) else np.zeros(0, np.int64)
    return np.concatenate([rows[heads, :2], np.add.reduceat(rows[:, 2], heads)[:, None]], axis=1) if len(rows) else rows


def _node_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, grams) of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array([shingles(t or b"").tobytes() for t in some.column(0).to_pylist()], pa.binary())], ["node", "grams"])
    _forget()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each node for each of its tasks: (task, part, side, node, grams). A task of pairs gets the fragments of the set apart."""
    for batch in batches:
        rows, size = [], 0
        for node, raw, tasks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            whole = raw.as_py()
            grams = np.frombuffer(whole, dtype=_U)
            bounds = (_bounds(grams) * 8).tolist()
            for t in tasks.as_py():
                if t["task"][0] == "p":
                    rows += [(t["task"], k, t["side"], node, whole[a:b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
                else:
                    rows.append((t["task"], 0, t["side"], node, whole))
                size += len(whole)
                if size > 16_000_000:
                    yield _set_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _set_batch(rows)
    release()


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["task", "part", "side", "node", "grams"])


def _bounds(grams: np.ndarray) -> np.ndarray:
    """Where each of PARTS fragments of the order begins in a sorted set, and the end."""
    return np.append(np.searchsorted(grams, np.arange(PARTS, dtype=_U) << _U(65 - PARTS.bit_length())), len(grams))


def partial_overlaps(sets: dict[int, np.ndarray], a: list[int], b: list[int]) -> np.ndarray:
    """Overlaps in one fragment of the pairs (a[i], b[i]) of ``sets``, by the n-grams that any two of the sets share."""
    if len(sets) == 2:
        x, y = sets.values()
        return np.full(len(a), len(np.intersect1d(x, y, assume_unique=True)))
    flat = np.concatenate(list(sets.values()))
    _, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    who, shared = np.repeat(np.arange(len(sets)), [len(x) for x in sets.values()]), seen[at] > 1
    column = np.cumsum(seen > 1) - 1
    number = {node: k for k, node in enumerate(sets)}
    rows, columns = np.array([number[x] for x in a]), np.array([number[x] for x in b])
    total, at, who = np.zeros(len(a), dtype=np.int64), column[at[shared]], who[shared]
    for start in range(0, int((seen > 1).sum()), 8192):
        mine = (at >= start) & (at < start + 8192)
        has = np.zeros((len(sets), 8192), dtype=bool)
        has[who[mine], at[mine] - start] = True
        for k in range(0, len(rows), 1024):
            total[k : k + 1024] += (has[rows[k : k + 1024]] & has[columns[k : k + 1024]]).sum(axis=1)
    return total


def _matrix(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Overlaps of two blocks of sets: partial counts of each fragment, summed."""
    total = np.zeros((len(rows), len(columns)), dtype=np.int64)
    bounds_r, bounds_c = [_bounds(s) for s in rows], [_bounds(s) for s in columns]
    for k in range(PARTS):
        parts_r = [s[b[k] : b[k + 1]] for s, b in zip(rows, bounds_r)]
        parts_c = [s[b[k] : b[k + 1]] for s, b in zip(columns, bounds_c)]
        flat_r, flat_c = np.concatenate(parts_r), np.concatenate(parts_c)
        shared = np.intersect1d(flat_r, flat_c)
        who_r, who_c = (np.repeat(np.arange(len(p)), [len(s) for s in p]) for p in (parts_r, parts_c))
        at_r, at_c = np.searchsorted(shared, flat_r), np.searchsorted(shared, flat_c)
        for start in range(0, len(shared), 4096):
            width = min(4096, len(shared) - start)
            inc = []
            for at, who, flat, n in ((at_r, who_r, flat_r, len(rows)), (at_c, who_c, flat_c, len(columns))):
                mine = (at >= start) & (at < start + width)
                mine[mine] = shared[at[mine]] == flat[mine]
                m = np.zeros((n, width), dtype=np.float32)
                m[who[mine], at[mine] - start] = 1
                inc.append(m)
            total += np.rint(inc[0] @ inc[1].T).astype(np.int64)
    return total


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


_PARTIAL = "a long, b long, na long, nb long, n long"


def _verify(table: pa.Table) -> pa.Table:
    """What the tasks of one bucket find. A task ``p...`` has one fragment of sets (side 0) and pairs (side 2) and gives
    partial overlaps; ``v...`` has nodes and their middle (side 1) and gives whole overlaps, summed over the fragments;
    ``c...`` has two blocks (sides 0, 1), or one, sums likewise and gives links, without ``n``."""
    tasks: dict[tuple, tuple[dict, dict, set]] = {}
    for task, part, side, node, raw, other, na, nb in zip(*(table.column(c).to_pylist() for c in ("task", "part", "side", "node", "grams", "other", "na", "nb"))):
        held = tasks.setdefault((task, part), ({}, {}, set()))
        if side == 2:
            held[2].add((node, other, na, nb))
        else:
            held[side][node] = np.frombuffer(raw, dtype=_U)
    found: list[tuple] = []
    for (task, _), (left, right, pairs) in tasks.items():
        if task[0] == "p":
            pairs = [p for p in pairs if p[0] in left and p[1] in left]
            if pairs:
                counts = partial_overlaps(left, [p[0] for p in pairs], [p[1] for p in pairs])
                found += [(*p, n) for p, n in zip(pairs, counts.tolist()) if n]
        elif left:
            rows = list(left)
            columns, sets = (list(right), list(right.values())) if right else (rows, list(left.values()))
            both = _matrix(list(left.values()), sets)
            if task[0] == "v":
                found += [(k, columns[0], len(left[k]), len(sets[0]), n) for k, n in zip(rows, both[:, 0].tolist())]
                continue
            n, m = np.array([len(left[k]) for k in rows]), np.array([len(s) for s in sets])
            hit = np.argwhere(PER * both >= SHARE * (n[:, None] + m[None, :] - both))
            found += [(a, b, None, None, None) for a, b in _forest([(rows[i], columns[j]) for i, j in hit.tolist() if rows[i] != columns[j]])]
    return pa.table([pa.array(c, pa.int64()) for c in (list(zip(*found)) or [()] * 5)], names=["a", "b", "na", "nb", "n"])


def _compared(sets: DataFrame, asked: DataFrame, at: str, wanted: DataFrame | None = None) -> DataFrame:
    """What :func:`_verify` finds in the tasks of ``asked`` (node, task, side), by ``sets`` (node, grams); written at ``at``."""
    spark = sets.sparkSession
    asked = stored(asked.groupBy("node").agg(F.collect_list(F.struct("task", "side")).alias("tasks")), f"{at}-asked")
    met = sets.join(asked, "node").select("node", "grams", "tasks")
    moved = met.agg(F.sum(F.octet_length("grams").cast("long") * F.size("tasks"))).first()[0] or 0
    dealt = met.mapInArrow(_sets, "task string, part int, side int, node long, grams binary")
    none = F.lit(None).cast("long")
    dealt = dealt.select("*", none.alias("other"), none.alias("na"), none.alias("nb"))
    if wanted is not None:
        dealt = dealt.unionByName(wanted, allowMissingColumns=True)
    buckets = max(partitions(spark), int(moved) // (32 << 20) + 1)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("task", "part"), F.lit(buckets)).cast("int"))
    found = stored(dealt.groupBy("bucket").applyInArrow(_verify, _PARTIAL), at)
    free_shuffles(spark)
    return found


def _blocked(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (star, node, ...) with ``block``: those of one star and ``by``, in parts of some BLOCK nodes."""
    counts = rows.groupBy("star", by).agg(F.count(F.lit(1)).alias("_c")).select(F.col("star").alias("_star"), F.col(by).alias("_by"), "_c")
    joined = rows.join(counts, (F.col("star") == F.col("_star")) & (F.col(by) == F.col("_by")))
    part = F.pmod(F.xxhash64("node"), F.expr(f"_c div {BLOCK} + 1"))
    return joined.withColumn("block", F.concat_ws("_", F.col(by).cast("string"), part.cast("string"))).drop("_star", "_by", "_c")


def _crowd_links(members: DataFrame, sets: DataFrame, at: str) -> list[DataFrame]:
    """Links (a, b) among the members (star, node, n) of each star: all links, or as many as make the same components."""
    links: list[DataFrame] = []
    union, n = F.col("na") + F.col("nb") - F.col("n"), F.col("n")
    active = stored(members, f"{at}-0")
    for k in range(ROUNDS):
        stars = active.groupBy(F.col("star").alias("_s")).agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        held = stored(active.drop("n").join(stars, F.col("star") == F.col("_s")).drop("_s"), f"{at}-held-{k}")
        if not held.limit(1).count():
            return links
        others = held.filter("node <> hub")
        task = F.concat(F.lit("v"), F.concat_ws("_", "star", F.pmod(F.xxhash64("node"), F.expr(f"size div {BLOCK} + 1"))))
        asked = others.select("node", task.alias("task"), F.lit(0).alias("side")).unionByName(others.select(F.col("hub").alias("node"), task.alias("task"), F.lit(1).alias("side")).distinct())
        found = _compared(sets, asked, f"{at}-middle-{k}").distinct()
        judged = others.join(found, (F.col("node") == F.col("a")) & (F.col("hub") == F.col("b"))).select(
            "star", "node", "hub", F.col("na").alias("size"), (PER * n >= SHARE * union).alias("near"), (PER * n >= (2 * SHARE - PER) * union).alias("between"), F.floor(40 * (union - n) / union).alias("band"),
        )
        judged = stored(judged, f"{at}-judged-{k}")
        links.append(judged.filter("near").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        fringe = judged.filter("between and not near")
        if fringe.limit(1).count():
            left, right = stored(_blocked(fringe, "band"), f"{at}-fringe-{k}"), stored(_blocked(judged.filter("near"), "band"), f"{at}-near-{k}")
            # By the triangle inequality a link is no longer than a quarter, ten bands; one more for what bands round off.
            i, j = left.select("star", F.col("block").alias("i"), F.col("band").alias("_i")).distinct(), right.select("star", F.col("block").alias("j"), F.col("band").alias("_j")).distinct()
            met = i.join(j, "star").filter(F.col("_j") >= F.col("_i") - (40 * (PER - SHARE) // PER + 1)).withColumn("task", F.concat(F.lit("c"), F.concat_ws("x", "star", "i", "j")))
            asked = left.join(met.select("star", F.col("i").alias("block"), "task"), ["star", "block"]).select("node", "task", F.lit(0).alias("side"))
            asked = asked.unionByName(right.join(met.select("star", F.col("j").alias("block"), "task"), ["star", "block"]).select("node", "task", F.lit(1).alias("side")))
            links.append(_compared(sets, asked, f"{at}-between-{k}").select("a", "b"))
        active = stored(judged.filter("not near").select("star", "node", F.col("size").alias("n")), f"{at}-{k + 1}")
    rest = stored(_blocked(active.withColumn("class", F.floor(F.log2("n") * 8)), "class"), f"{at}-rest")
    ends = rest.groupBy("star", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i, j = ends.select("star", F.col("block").alias("i"), F.col("low").alias("_i"), F.col("high").alias("_top")), ends.select("star", F.col("block").alias("j"), F.col("low").alias("_j"), F.col("high").alias("_other"))
    fits = (PER * F.col("_top") >= SHARE * F.col("_j")) & (PER * F.col("_other") >= SHARE * F.col("_i"))
    met = i.join(j, "star").filter((F.col("i") <= F.col("j")) & fits).withColumn("task", F.concat(F.lit("c"), F.concat_ws("x", "star", "i", "j")))
    asked = rest.join(met.select("star", F.col("i").alias("block"), "task"), ["star", "block"]).select("node", "task", F.lit(0).alias("side"))
    asked = asked.unionByName(rest.join(met.filter("i < j").select("star", F.col("j").alias("block"), "task"), ["star", "block"]).select("node", "task", F.lit(1).alias("side")))
    return [*links, _compared(sets, asked, f"{at}-blocks").select("a", "b")]


def _ranges(docs: DataFrame) -> int:
    """Ranges in proportion to the table: by the size that Spark knows of its files, else by the texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), size // RANGE_BYTES + 1)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and text_key (xxhash64 of the text) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("data"))
    ranges = _ranges(docs.select("text"))
    first = stored(keyed.mapInArrow(_count(ranges), _COUNTED).groupBy("range").applyInArrow(_sum_up, _FIRST), f"{at}/first")
    free_shuffles(spark)
    rows = first.filter("n is not null").drop("gram", "df")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.max("n").alias("n"))
    nodes = stored(nodes, f"{at}/nodes")

    counted = first.filter("gram is not null").select("gram", "df", F.floor(F.log2("df")).cast("int").alias("rank"))
    by_rank = sorted((r[0], r[1]) for r in counted.groupBy("rank").count().collect())
    total, lowest = 0, 0
    for rank, n in reversed(by_rank):
        if total + n > MOST_COMMON:
            lowest = rank + 1
            break
        total += n
    common = sorted((r[0], r[1]) for r in counted.filter(F.col("rank") >= lowest).select("gram", "rank").collect())
    grams, ranks = np.array([c[0] for c in common], dtype=_U), np.array([c[1] for c in common], dtype=np.int32)

    volume = nodes.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    fragments = FRAGMENTS
    while fragments * FRAGMENT_ROWS < volume:
        fragments *= 4
    size_class = F.floor(F.log2("n") * 8)
    by_size = [(int(r[0]), r[1]) for r in nodes.groupBy(size_class).agg(F.avg("n").alias("n"), F.count(F.lit(1)).alias("c")).select("n", "c").collect()]  # some 200 classes
    edges = cuts(by_size, grams, ranks, fragments)
    partial = keyed.select("data").mapInArrow(_prefixes(edges, grams, ranks), "range int, entries binary").groupBy("range").applyInArrow(_partial_overlaps, "a long, b long, n long")
    partial = stored(partial, f"{at}/partial")
    free_shuffles(spark)

    sizes = nodes.select("node", "n")
    pairs = partial.filter("n is not null").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    pairs = pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
    # Of the two the set whose prefix ends first has `shared` n-grams of it in common, and at most the rest besides.
    # (What n-grams of crowds add is not in `shared`: pairs of one crowd are compared anyway.)
    enough = F.expr(f"shared >= ({SHARE} * (na + nb) + {PER + SHARE - 1}) div {PER + SHARE} - ({SHARE} * greatest(na, nb) + {PER - 1}) div {PER} + 1")
    pairs = stored(pairs.filter((PER * F.least("na", "nb") >= SHARE * F.greatest("na", "nb")) & enough).select("a", "b", "na", "nb"), f"{at}/pairs")
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other"))
    label = ends.select("node", F.least("node", "other").alias("label"))
    tasks = pairs.join(label.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(label.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
    tasks = stored(tasks.select("a", "b", "na", "nb", F.concat(F.lit("p"), F.least("la", "lb").cast("string")).alias("task")), f"{at}/pair-tasks")
    of_pairs = tasks.select(F.col("a").alias("node"), "task").unionByName(tasks.select(F.col("b").alias("node"), "task")).distinct().withColumn("side", F.lit(0))
    crowds = partial.filter("n is null").select(F.col("a").alias("star"), F.col("b").alias("node")).distinct().join(sizes, "node").select("star", "node", "n")

    involved = of_pairs.select("node").unionByName(crowds.select("node")).distinct().join(nodes.select("node", "one"), "node")
    involved = stored(involved.select(F.col("node").alias("_node"), F.col("one.doc_id").alias("_id"), F.col("one.text_key").alias("_text")), f"{at}/involved")
    texts = keyed.join(involved.hint("shuffle_hash"), (F.col("text_key") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = stored(texts.select("data", "_node").mapInArrow(_node_sets, "node long, grams binary"), f"{at}/sets")
    free_shuffles(spark)

    wanted = tasks.select("task", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"), F.lit(2).alias("side"), F.col("a").alias("node"), F.col("b").alias("other"), "na", "nb")
    counts = _compared(sets, of_pairs.select("node", "task", "side"), f"{at}/overlaps", wanted)
    summed = counts.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n")).filter(PER * F.col("n") >= SHARE * (F.col("na") + F.col("nb") - F.col("n")))
    found = summed.select("a", "b")
    for some in _crowd_links(crowds, sets, f"{at}/crowd"):
        found = found.unionByName(some)
    found = stored(found, f"{at}/links")
    for name in ("partial", "sets", "overlaps"):
        discard(spark, f"{at}/{name}")

    roots = components(found, "a", "b", f"{at}/components")
    named = nodes.select("node", "least_id").join(roots, "node")
    named = named.join(named.groupBy("root").agg(F.min("least_id").alias("component")), "root").select("node", "component")
    known = stored(nodes.select("node", "least_id").join(named, "node", "left").select(F.col("node").alias("_node"), F.coalesce("component", "least_id").alias("_component")), f"{at}/classes")
    out = rows.join(known, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"), "text_key")


def op1(docs: DataFrame) -> DataFrame:
    return classes(docs).drop("text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each class the row of the least id stays, and of rows equal in id and text one; all columns stay."""
    spark = docs.sparkSession
    found = classes(docs.select("doc_id", "text")).filter("doc_id is null or component_id = doc_id").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).count()
    found = stored(found, f"{shared_dir(spark)}/kept")
    rows = docs.select(F.struct("*").alias("row"))
    id_, text = F.col("row")["doc_id"], F.xxhash64(F.col("row")["text"])

    def of(keys: DataFrame) -> DataFrame:
        return rows.join(keys.drop("count").hint("shuffle_hash"), id_.eqNullSafe(F.col("_id")) & (text == F.col("_text")), "left_semi")

    if not found.filter("count > 1").limit(1).count():
        return of(found).select("row.*")
    # Equal rows are put together before they are shuffled.
    again = of(found.filter("count > 1")).groupBy(id_.alias("_id"), text.alias("_text")).agg(F.first("row").alias("row"))
    return of(found.filter("count = 1")).unionByName(again.select("row")).select("row.*")
