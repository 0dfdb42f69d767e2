"""Communities of weighted graphs by local moves that raise modularity, in rounds over blocks of links.

Every half round, half of the nodes (by a hash that each pair of half rounds draws anew) look
at the communities of their neighbours as the half round before left them, and move to the
best. A graph goes on as long as a pair of half rounds raises its modularity; a pair that
doesn't is taken back. Many graphs (column graph) run in the same rounds, each for itself.

Nodes are dealt into blocks, each with all links of its nodes, which are dealt out once. A half
round is one job of three shuffles, whose rows hold packed columns of a block: parts of
communities' strengths and of graphs' modularity go to the block that adds them up and come back
(_sums), blocks send their nodes' communities to the blocks with links to them (_sent), and
blocks look at their links (_looked). A pair of blocks exchanges one row. Packed columns are
compressed, and a half round's table goes when the next one is written, so that disk holds one
half round's tables and shuffles, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.scratch import Rounds

_DIGITS = 9  # gains are compared to so many decimals, so that the order of sums doesn't decide
_LINKS, _MOST_LINKS, _BLOCKS = 1 << 18, 1 << 20, 256  # links of a block; of one where there are more blocks than _BLOCKS

_PACKED = "block int, kind int, peer int, n long, parts array<binary>"
# kinds of packed rows and the types of their columns
_STATE = 0  # n: nodes of graphs that go on. graph, node, strength, graph's strength, community, its strength, goes on, accepted community, community before the half round, graph's modularity
_LINKED = 1  # number of each node's links; in order of nodes: neighbour's place in what the block receives, weight
_WISHED = 2  # to block `block`: graph and number of the nodes that block `peer` has links to
_ROUTE = 3  # places of those nodes
_PART = 4  # to block `block`: graph, community, strength of the members in block `peer`
_PART_Q = 5  # to block `block`: graph, weight within communities, sum of strength times community's strength, graph's strength, each in block `peer`
_TOTAL = 6  # strengths of communities, in the order of the parts
_TOTAL_Q = 7  # modularities of graphs, in the order of the parts
_SEEN = 8  # community and its strength of each node of a route
_ENDS = 9  # some links of a block's nodes: graph, node, neighbour, weight, graph's strength
_TYPES = {_STATE: "qqddqd?qqd", _LINKED: "iid", _WISHED: "qq", _ROUTE: "i", _PART: "qqd", _PART_Q: "qddd", _TOTAL: "d", _TOTAL_Q: "d", _SEEN: "qd", _ENDS: "qqqdd"}
_RISING = {(_STATE, 1), (_WISHED, 1), (_ROUTE, 0)}  # kinds' columns that mostly rise: differences are stored
_PACKED_LINKS, _ZSTD = 1 << 20, pa.Codec("zstd", 1)  # links that a task deals out at once

Packed = tuple[int, int, int, int, list[np.ndarray]]


def _once(edges: DataFrame) -> DataFrame:
    """(graph, u, v, w), u < v, of edges (graph, src, dst, weight): parallel edges summed, weights of 0 or less
    and null ones count 1, loops and edges without an end go."""
    w = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    one = edges.where("src <> dst").select("graph", F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w"))
    return one.groupBy("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """The links of _once(edges), each from both ends."""
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return _once(edges).select("graph", ends.alias("e"), "w").select("graph", "e.u", "e.v", "w")


def xxhash64_longs(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """What Spark's xxhash64 gives for longs, from a seed or the hashes of the columns before (its first seed is 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda a, n: (a << np.uint64(n)) | (a >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.int64).view(np.uint64) + p5 + np.uint64(8)
        h = turned(h ^ (turned(x.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def moves_in(node: np.ndarray, half: int) -> np.ndarray:
    """Whether nodes may move in this half round."""
    return xxhash64_longs(np.full(len(node), half // 2), xxhash64_longs(node, 42)) % 2 == half % 2


def _compressed(x: np.ndarray, kind: int, nth: int) -> bytes:
    """The number of values, then their first bytes, second bytes and so on, compressed."""
    x = np.ascontiguousarray(x, np.dtype(_TYPES[kind][nth]))
    if (kind, nth) in _RISING and len(x):
        x = np.append(x[:1], np.diff(x))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + (_ZSTD.compress(planes, asbytes=True) if len(x) else b"")


def _expanded(b: pa.Buffer, kind: int, nth: int) -> np.ndarray:
    t, n = np.dtype(_TYPES[kind][nth]), int.from_bytes(b[:8].to_pybytes(), "little")
    if not n:
        return np.empty(0, t)
    planes = np.frombuffer(_ZSTD.decompress(b[8:], n * t.itemsize), np.uint8)
    x = np.ascontiguousarray(planes.reshape(t.itemsize, n).T).reshape(-1).view(t)
    return np.cumsum(x, dtype=t) if (kind, nth) in _RISING else x


def _row(block: int, kind: int, peer: int, columns: Iterable[np.ndarray], n: int = 0) -> Packed:
    return int(block), kind, int(peer), n, list(columns)


def _read(table: pa.Table) -> tuple[int, dict[int, list[tuple[int, list[np.ndarray]]]]]:
    """(block, kind -> its rows (peer, columns) by peer) of one block's packed rows."""
    out: dict[int, list[tuple[int, list[np.ndarray]]]] = {}
    for kind, peer, parts in zip(table["kind"].to_pylist(), table["peer"].to_pylist(), table["parts"], strict=True):
        out.setdefault(kind, []).append((peer, [_expanded(p.as_buffer(), kind, i) for i, p in enumerate(parts)]))
    for rows in out.values():
        rows.sort(key=lambda r: r[0])
    return table["block"][0].as_py(), out


def _packed(rows: Iterable[Packed]) -> pa.Table:
    rows = list(rows)
    parts = [[_compressed(c, r[1], i) for i, c in enumerate(r[4])] for r in rows]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.table([*columns, pa.array(parts, pa.list_(pa.binary()))], names=["block", "kind", "peer", "n", "parts"])


def _by_block(rows: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return rows.groupBy("block").applyInArrow(work, _PACKED)


def _split(peers: np.ndarray, columns: Iterable[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns' runs of one peer; peers ascend."""
    starts = np.flatnonzero(np.append(True, peers[1:] != peers[:-1])) if len(peers) else np.zeros(0, np.int64)
    columns = list(columns)
    for a, b in zip(starts, np.append(starts[1:], len(peers)), strict=False):
        yield int(peers[a]), [c[a:b] for c in columns]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in order of keys, the first one first, and where the runs of equal ones start."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _added(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else np.zeros(0)


def _concatenated(rows: list[tuple[int, list[np.ndarray]]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(columns for _, columns in rows), strict=True)]


def _block(g: np.ndarray, node: np.ndarray, blocks: int) -> np.ndarray:
    return xxhash64_longs(node, xxhash64_longs(g, 42)) % blocks


def _ends(batches: Iterator[pa.RecordBatch], blocks: int, mirrored: bool) -> Iterator[pa.RecordBatch]:
    """Links (gid, u, v, w, m2), from both ends if mirrored, packed for the block of their first end."""
    held, n = [], 0

    def flushed() -> Iterator[pa.RecordBatch]:
        g, u, v, w, m2 = (np.concatenate(c) for c in zip(*held, strict=True))
        if mirrored:
            g, u, v, w, m2 = np.append(g, g), np.append(u, v), np.append(v, u), np.append(w, w), np.append(m2, m2)
        block = _block(g, u, blocks)
        order = np.argsort(block, kind="stable")
        for to, columns in _split(block[order], [x[order] for x in (g, u, v, w, m2)]):
            yield from _packed([_row(to, _ENDS, 0, columns)]).to_batches()

    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows * (2 if mirrored else 1)
        if n >= _PACKED_LINKS:
            yield from flushed()
            held, n = [], 0
    if n:
        yield from flushed()


def _dealt(rows: pa.Table, blocks: int) -> pa.Table:
    """A block's state, where each node is a community, its links, and what it wishes to hear of others,
    from its nodes' links."""
    block, of = _read(rows)
    g, u, v, w, m2 = _concatenated(of.pop(_ENDS))
    bv = _block(g, v, blocks)
    order, starts = _runs(g, u, v)
    starts = starts[np.append(True, (np.diff(g[order[starts]]) != 0) | (np.diff(u[order[starts]]) != 0))]
    g, u, v, w, m2, bv = (x[order] for x in (g, u, v, w, m2, bv))
    k, node, graph = _added(w, starts), u[starts], g[starts]
    order, first = _runs(bv, g, v)  # neighbours by block: what is received comes in this order
    place = np.empty(len(g), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(g)))
    wished = order[first]
    none = np.full(len(node), -np.inf)
    degree = np.diff(starts, append=len(g))
    rows = [_row(block, _STATE, block, (graph, node, k, m2[starts], node, k, np.ones(len(node), bool), node, node, none), len(node)), _row(block, _LINKED, block, (degree, place, w))]
    return _packed(rows + [_row(peer, _WISHED, block, columns) for peer, columns in _split(bv[wished], (g[wished], v[wished]))])


def _routes(rows: pa.Table) -> pa.Table:
    """Where the nodes stand that other blocks wish to hear of."""
    block, of = _read(rows)
    graph, node = of[_STATE][0][1][:2]
    out = []
    for peer, (g, v) in of.get(_WISHED, []):
        order = np.lexsort((np.append(node, v), np.append(graph, g)))  # a node stands before the wish for it: lexsort is stable
        is_node = order < len(node)
        before = np.maximum.accumulate(np.where(is_node, np.arange(len(order)), 0))
        place = np.empty(len(order), np.int64)
        place[order] = order[before]
        out.append(_row(block, _ROUTE, peer, (place[len(node) :],)))
    return _packed(out)


def _held(graph: np.ndarray, c: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(adder, order, starts) of a block's nodes: runs of one community, by the block that adds it up."""
    adder = xxhash64_longs(c, graph) % blocks
    order, starts = _runs(adder, graph, c)
    return adder, order, starts


def _sums(rows: pa.Table, resolution: float) -> pa.Table:
    """To each block that sent parts, in their order: communities' strengths and graphs' modularities."""
    block, of = _read(rows)
    out = []
    for kind, reply in ((_PART, _TOTAL), (_PART_Q, _TOTAL_Q)):
        if kind not in of:
            continue
        columns = _concatenated(of[kind])
        order, starts = _runs(*columns[: 2 if kind == _PART else 1])
        if kind == _PART:
            total = _added(columns[2][order], starts)
        else:
            into, strengths, m2 = (c[order] for c in columns[1:])
            m2 = m2[starts]
            total = np.round(_added(into, starts) / m2 - resolution * _added(strengths, starts) / (m2 * m2), _DIGITS)
        every = np.empty(len(order))
        every[order] = np.repeat(total, np.diff(starts, append=len(order)))
        at = 0
        for peer, columns in of[kind]:
            out.append(_row(peer, reply, block, (every[at : at + len(columns[0])],)))
            at += len(columns[0])
    return _packed(out)


def _sent(rows: pa.Table, blocks: int) -> pa.Table:
    """The state with its communities' strengths, after taking back what raised no modularity, and what other blocks hear of it."""
    block, of = _read(rows)
    graph, node, k, m2, c, total, on, accepted, before, q = (x.copy() for x in of[_STATE][0][1])
    if _TOTAL in of:
        live = np.flatnonzero(on)
        _, order, starts = _held(graph[live], c[live], blocks)
        total[live[order]] = np.repeat(_concatenated(of[_TOTAL])[0], np.diff(starts, append=len(live)))
    if _TOTAL_Q in of:
        live = np.flatnonzero(on)
        order, starts = _runs(graph[live] % blocks, graph[live])
        new = np.empty(len(live))
        new[order] = np.repeat(_concatenated(of[_TOTAL_Q])[0], np.diff(starts, append=len(live)))
        risen = new > q[live]
        accepted[live[risen]], q[live[risen]] = before[live[risen]], new[risen]
        on[live[~risen]] = False
    out = [_row(block, _STATE, block, (graph, node, k, m2, c, total, on, accepted, before, q), int(on.sum()))]
    out += [_row(peer, _SEEN, block, (c[places], total[places])) for peer, (places,) in of[_ROUTE]]
    return _packed(out)


def _best(at: np.ndarray, place: np.ndarray, w: np.ndarray, seen: np.ndarray, seen_total: np.ndarray, state: list[np.ndarray], resolution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(into, gain, c) of every node: the weight of its links to its own community, and the largest gain of
    another one with the smallest number among equals; links are (at, place, w), neighbours (seen, seen_total)."""
    _, _, k, m2, own, *_ = state
    names, rank = np.unique(seen, return_inverse=True)
    key = at * len(names) + rank[place]  # in order of nodes, then of communities
    order, starts = _runs(key)
    first = order[starts]
    at, c, to_total, w = at[first], seen[place[first]], seen_total[place[first]], _added(w[order], starts)
    here = c == own[at]
    into = np.zeros(len(k))
    into[at[here]] = w[here]
    at, c, to_total, w = (x[~here] for x in (at, c, to_total, w))
    gain = np.round(w - resolution * k[at] * to_total / m2[at], _DIGITS)
    most, best = np.full(len(k), -np.inf), own.copy()
    if len(at):
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        most[at[start]] = np.maximum.reduceat(gain, start)
        top = np.flatnonzero(gain == most[at])[::-1]  # the smallest number is written last
        best[at[top]] = c[top]
    return into, most, best


def _looked(rows: pa.Table, half: int, blocks: int, resolution: float, only_gains: bool) -> pa.Table:
    """The state after this half round's moves, and the parts that its block has of communities and, before
    the first half round of a pair, of graphs' modularity."""
    block, of = _read(rows)
    state = of[_STATE][0][1]
    graph, node, k, m2, c, total, on, accepted, _, q = state
    degree, place, w = of[_LINKED][0][1]
    at = np.repeat(np.arange(len(degree)), degree)
    seen, seen_total = _concatenated(of[_SEEN])
    may = on & moves_in(node, half)
    looks = (on if half % 2 == 0 else may)[at]
    at, place, w = at[looks], place[looks], w[looks]
    into, gain, best = _best(at, place, w, seen, seen_total, state, resolution)
    stay = np.round(into - resolution * k * (total - k) / m2, _DIGITS)
    new = np.where(may & (gain > (np.maximum(stay, 0.0) if only_gains else stay)), best, c)
    out = [_row(block, _STATE, block, (graph, node, k, m2, new, total, on, accepted, c if half % 2 == 0 else accepted, q), int(on.sum()))]
    live = np.flatnonzero(on)
    adder, order, starts = _held(graph[live], new[live], blocks)
    first = order[starts]
    part = graph[live][first], new[live][first], _added(k[live][order], starts)
    out += [_row(peer, _PART, block, columns) for peer, columns in _split(adder[first], part)]
    if half % 2 == 0:
        order, starts = _runs(graph[live] % blocks, graph[live])
        some = live[order]
        first = some[starts]
        part = graph[first], _added(into[some], starts), _added((k * total)[some], starts), m2[first]
        out += [_row(peer, _PART_Q, block, columns) for peer, columns in _split(graph[first] % blocks, part)]
    return _packed(out)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for parts in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(_expanded(parts[i].as_buffer(), _STATE, i)) for i in (0, 1, 7)], names=["gid", "node", "c"])


def local_moves(links: DataFrame, resolution: float = 1.0, only_gains: bool = True, pairs: int | None = None, block_links: int | None = None) -> DataFrame:
    """(graph, node, community) of links (graph, u, v, w) that hold every edge both ways.

    A node moves to the neighbouring community of largest gain, into - resolution * k * total / m2
    (its own counts without itself), the smallest number among equals, if that is more than
    staying; with only_gains also more than 0. community is the smallest member. `pairs`
    bounds the pairs of half rounds; None goes on until no pair raises the modularity.
    block_links sets how many links a block has on average; any number gives the same communities.
    A node's links are all in its block, 16 bytes each there.
    """
    return _moved(links, False, resolution, only_gains, pairs, block_links).select("graph", "node", "community")


def _moved(links: DataFrame, mirrored: bool, resolution: float, only_gains: bool = True, pairs: int | None = None, block_links: int | None = None) -> DataFrame:
    """(graph, node, community, size) of local_moves; mirrored: links hold every edge once."""
    with Rounds(links.sparkSession) as rounds:
        links = rounds.keep(links.where("graph IS NOT NULL"))
        graphs = links.groupBy("graph").agg((F.sum("w") * (2 if mirrored else 1)).alias("m2"))
        graphs = rounds.keep(graphs.withColumn("gid", F.monotonically_increasing_id()))
        n = links.count() * (2 if mirrored else 1)
        blocks = max(1, -(-n // block_links) if block_links else max(min(-(-n // _LINKS), _BLOCKS), -(-n // _MOST_LINKS)))
        rows = links.join(graphs, "graph").select("gid", F.col("u").cast("long"), F.col("v").cast("long"), "w", "m2")
        ends = rows.mapInArrow(lambda batches: _ends(batches, blocks, mirrored), _PACKED)
        first = rounds.keep(_by_block(ends, lambda rows: _dealt(rows, blocks)), by="kind")
        rounds.drop(links)
        linked = first.where(F.col("kind") == _LINKED)
        routes = rounds.keep(_by_block(first.where(F.col("kind").isin(_STATE, _WISHED)), _routes))
        rounds.drop(first, f"kind={_WISHED}")
        state, half, parts = first, 0, first.where(F.lit(False))
        while True:
            sums = _by_block(parts, lambda rows: _sums(rows, resolution))
            sent = _by_block(state.where(F.col("kind") == _STATE).union(routes).union(sums), lambda rows: _sent(rows, blocks))
            now = half
            last, state = state, rounds.keep(_by_block(sent.union(linked), lambda rows: _looked(rows, now, blocks, resolution, only_gains)))
            rounds.drop(last, f"kind={_STATE}" if last is first else "")
            # the second half round's job has judged the pair before it
            if half % 2 and ((pairs and half > 2 * pairs) or not state.where(F.col("kind") == _STATE).agg(F.sum("n")).first()[0]):
                break
            parts, half = state.where(F.col("kind").isin(_PART, _PART_Q)), half + 1
        rounds.drop(first)
        rounds.drop(routes)
        out = state.where(F.col("kind") == _STATE).select("parts").mapInArrow(_members, "gid long, node long, c long")
        named = out.groupBy("gid", "c").agg(F.min("node").alias("community"), F.count("*").alias("size"))
        return rounds.result(out.join(named, ["gid", "c"]).join(graphs, "gid").select("graph", "node", "community", "size"), packed=True)


def detect(edges: DataFrame, resolution: float = 1.0, least: int = 1) -> DataFrame:
    """(graph, community, node, size): communities of edges (graph, src, dst, weight) with `least` members or more.

    A resolution over 1 gives more and smaller ones; 0 or less counts as 1. Nodes are longs.
    A graph without edges between different nodes has no communities. Null ends have no part.
    """
    found = _moved(_once(edges), True, resolution if resolution > 0 else 1.0)
    return found.where(F.col("size") >= least).select("graph", "community", "node", "size")


def summary_input(communities: DataFrame, edges: DataFrame, names: DataFrame, most_members: int, most_edges: int) -> DataFrame:
    """(graph, community, members, relations): what a summary of each community is written from.

    members: the names (graph, node, name) of the `most_members` members of most edges weight,
    heaviest first; relations: "name - name" of its `most_edges` heaviest inner edges.
    Ties go to smaller numbers. The limits are the feature: a summary has a bounded input.
    """
    with Rounds(edges.sparkSession) as rounds:  # each step is written, so that its shuffles go before the next one
        of = rounds.keep(communities.select("graph", "node", "community"))
        links = rounds.keep(_once(edges))
        at_u = rounds.keep(links.join(of.withColumnRenamed("node", "u"), ["graph", "u"]))
        rounds.drop(links)
        inner = rounds.keep(at_u.join(of.withColumnRenamed("node", "v"), ["graph", "v", "community"]).select("graph", "community", "u", "v", "w"))
        rounds.drop(at_u)
        title = lambda end: names.select("graph", F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
        at_u = rounds.keep(inner.join(title("u"), ["graph", "u"]))
        once = rounds.keep(at_u.join(title("v"), ["graph", "v"]))
        rounds.drop(at_u)
        relations = rounds.keep(_heaviest(once, most_edges, [F.desc(F.round("w", 6)), F.col("u"), F.col("v")], F.concat_ws(" - ", "u_name", "v_name")).withColumnRenamed("kept", "relations"))
        rounds.drop(once)
        ends = inner.select("graph", "community", F.explode(F.array("u", "v")).alias("node"), "w")
        strength = rounds.keep(ends.groupBy("graph", "community", "node").agg(F.round(F.sum("w"), 6).alias("k")))
        rounds.drop(inner)
        named = rounds.keep(of.join(strength, ["graph", "community", "node"], "left").join(names, ["graph", "node"]).fillna(0.0, ["k"]))
        rounds.drop(of)
        rounds.drop(strength)
        members = rounds.keep(_heaviest(named, most_members, [F.desc("k"), F.col("node")], F.col("name")).withColumnRenamed("kept", "members"))
        rounds.drop(named)
        none = F.array().cast("array<string>")
        return rounds.result(members.join(relations, ["graph", "community"], "left").withColumn("relations", F.coalesce("relations", none)), packed=True)


def _heaviest(rows: DataFrame, n: int, order: list[Column], what: Column) -> DataFrame:
    """(graph, community, kept): `what` of the n first rows of each community, in order."""
    nth = F.row_number().over(Window.partitionBy("graph", "community").orderBy(*order))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= n)
    kept = F.transform(F.array_sort(F.collect_list(F.struct("nth", what.alias("what")))), lambda x: x["what"])
    return first.groupBy("graph", "community").agg(kept.alias("kept"))
