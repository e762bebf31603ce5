"""Approximate nearest neighbours by inner product: a graph built by NN-descent, searched greedily.

Equal vectors are one node. A node's neighbours are those of the largest inner product with it, so a query's
own list is what its search starts from. The graph starts poorly, from small random hyperplane cells whose members are
compared with one another, and is built by NN-descent: in each round a node's neighbours, and nodes
it is a neighbour of, meet by Spark joins and are compared with one another; each keeps its ``degree`` best.
Rounds go on, at every size, until one changes less than a thousandth of all neighbours. Comparisons use components in
eight bits. A query starts from its own node and expands, hop by hop, the best nodes it has not expanded; what it has found is
scored again on the original vectors in double precision.

Recall of 20 neighbours, measured against brute force: see the README. Vectors that are null, zero or hold
null or non-finite components take no part, as queries or candidates. Vectors of one length are searched among
themselves, one graph for each length, as those of different lengths have no product. Rows with a null id are left out. Repeated rows (equal id and vector) count once; of
rows with one id and different vectors each counts. Equal scores are ranked by the smaller id.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import _shared, _text
from docloom.llm._packed import pack, unpack

#: Nodes of a cell that the start compares with one another; a larger cell is split.
CELL = 256
#: Nodes whose lists are merged, and whose neighbours are compared, together.
GROUP = 4096
#: Rounds end with one that changes less than this share of all neighbours.
SETTLED = 0.001


def _dest(ids: np.ndarray, groups: int) -> np.ndarray:
    return (_text.mix(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _best(u: np.ndarray, c: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best distinct candidates of each node, best first."""
    order = np.lexsort((c, u))
    u, c, s = u[order], c[order], s[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
    u, c, s = u[new], c[new], s[new]
    order = np.lexsort((c, -s, u))
    u, c, s = u[order], c[order], s[order]
    first = np.searchsorted(u, u, "left")
    ok = np.arange(len(u)) - first < most
    return u[ok], c[ok], s[ok]


def _matrix(codes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a scale and components in eight bits) as rows of numbers, and the scales.

    A vector's own scale does not change the order of its neighbours, so products take the other side's scale only;
    each vector has its own, so that large vectors do not cost small ones their digits.
    """
    raw, _ = _text.flat(codes)
    rows = raw.reshape(len(codes), -1)
    scale = np.ascontiguousarray(rows[:, :8]).view(np.float64)[:, 0]
    return np.ascontiguousarray(rows[:, 8:]).view(np.int8).astype(np.float32), scale


def _coded(dims: int, tables: int, bits: int, unit: float):
    """rep, code (its scale in multiples of ``unit``, the largest component, so that no product overflows) and cells of each vector."""
    planes = np.random.default_rng(7).standard_normal((tables, dims, max(bits, 1))).astype(np.float32)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, dims)
            x = x.astype(np.float64)
            largest = np.abs(x).max(1)
            x = (x / largest[:, None]).astype(np.float32)
            scale = np.maximum(largest / unit, 1e-300)
            raw = np.concatenate([scale[:, None].view(np.uint8), np.rint(x * 127).astype(np.int8).view(np.uint8)], 1)
            cells = np.stack([((x @ p) > 0) @ (1 << np.arange(p.shape[1])) if bits else np.zeros(len(x), np.int64) for p in planes], 1).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(cells.ravel()))
            yield pa.record_batch([batch.column("rep"), pa.array([r.tobytes() for r in raw], pa.binary()), lists], ["rep", "code", "cells"])

    return run


def _compare_cell(degree: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table["rep"].to_numpy()
        x, scale = _matrix(table["code"])
        us, cs, ss = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        k = min(degree, len(ids) - 1)
        for a in range(0, len(ids) if k > 0 else 0, 1024):
            s = (x[a : a + 1024] @ x.T) * scale
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            us.append(np.repeat(ids[a : a + 1024], k))
            cs.append(ids[at].ravel())
            ss.append(np.take_along_axis(s, at, 1).ravel())
        return _sent(np.concatenate(us), np.concatenate(cs), np.concatenate(ss), groups)

    return run


def _pairs(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _text.mix(_text.mix(u.astype(np.uint64)) + c.astype(np.uint64))


#: A group's nodes: ids, lengths of lists, neighbours, their scores, whether they are new, codes.
_NODES = (np.int64, np.int64, np.int64, np.float64, np.uint8, np.uint8)
#: Neighbours found: nodes, how many for each, neighbours, scores.
_FOUND = (np.int64, np.int64, np.int64, np.float64)
#: Edges by their ends: the neighbour, the node that has it, whether it is new there.
_EDGES = (np.int64, np.int64, np.uint8)
#: Members of pivots: pivot, place among the members, how it belongs; and of each member id, last score and code.
_MEMBERS = (np.int64, np.int64, np.uint8, np.int64, np.float64, np.uint8)
#: How a member belongs to a pivot: as its neighbour, as a node that has it as neighbour, by a new edge, as itself.
_OUT, _BACK, _NEW, _SELF = 1, 2, 4, 8

_MESSAGE = "dest int, old boolean, blob binary"


def _rows(dests: list[int], blobs: list[bytes], old: bool = False) -> pa.Table:
    return pa.table([pa.array(dests, pa.int32()), pa.array([old] * len(dests), pa.bool_()), pa.array(blobs, pa.binary())], ["dest", "old", "blob"])


def _dealt(dest: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and (group, from, to) in it."""
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    return order, [(int(dest[a]), a, b) for a, b in _text.runs(dest)]


def _sent(u: np.ndarray, c: np.ndarray, s: np.ndarray, groups: int) -> pa.Table:
    """Found neighbours, dealt to the groups of their nodes; rows of a node stand together."""
    order, runs = _dealt(_dest(u, groups))
    u, c, s = u[order], c[order], s[order]
    blobs = []
    for _, a, b in runs:
        of = np.array(_text.runs(u[a:b]), np.int64)
        blobs.append(pack(u[a:b][of[:, 0]], of[:, 1] - of[:, 0], c[a:b], s[a:b]))
    return _rows([g for g, _, _ in runs], blobs)


def _bare(groups: int):
    """Nodes without neighbours, dealt to their groups."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rep = batch.column("rep").to_numpy()
                code = _text.flat(pa.chunked_array([batch.column("code")]))[0].reshape(len(rep), -1)
                order, runs = _dealt(_dest(rep, groups))
                rep, code, none = rep[order], code[order], np.empty(0, np.int64)
                blobs = [pack(rep[a:b], np.zeros(b - a, np.int64), none, none.astype(np.float64), none.astype(np.uint8), code[a:b].ravel()) for _, a, b in runs]
                yield from _rows([g for g, _, _ in runs], blobs, True).to_batches()

    return run


def _nodes_of(table: pa.Table) -> list[np.ndarray]:
    """The nodes of a group, as _NODES with a row of codes for each."""
    parts = [unpack(b, *_NODES) for b, old in zip(table["blob"].to_pylist(), table["old"].to_pylist(), strict=True) if old]
    rep, sizes, ids, sims, new, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    return [rep, sizes, ids, sims, new, code.reshape(len(rep), -1)]


def _used(sizes: np.ndarray, new: np.ndarray, step: int) -> np.ndarray:
    """Which neighbours take part in a round: those that did before, and the ``step`` nearest new ones of each node."""
    count = np.concatenate([[0], np.cumsum(new, dtype=np.int64)])
    before = count[np.cumsum(sizes) - sizes]
    return (new == 0) | (count[1:] - np.repeat(before, sizes) <= step)


def _merge(degree: int, step: int):
    """The best of all that was found for each node, what of it is new, and how many it did not have before."""

    def run(table: pa.Table) -> pa.Table:
        rep, sizes, ids, sims, new, code = _nodes_of(table)
        new = new * ~_used(sizes, new, step)
        found = [unpack(b, *_FOUND) for b, old in zip(table["blob"].to_pylist(), table["old"].to_pylist(), strict=True) if not old]
        by = np.argsort(rep)
        u = np.concatenate([np.repeat(np.arange(len(rep)), sizes), *[np.repeat(by[np.searchsorted(rep, f[0], sorter=by)], f[1]) for f in found]])
        c, s = (np.concatenate([mine, *[f[i] for f in found]]) for i, mine in ((2, ids), (3, sims)))
        new = np.concatenate([new, np.full(len(c) - len(ids), 2, np.uint8)])
        # copies stand together, those that the node had first
        order = np.lexsort((c, -s, u))
        u, c, s, new = u[order], c[order], s[order], new[order]
        keep = np.ones(len(u), bool)
        keep[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
        for most in (2 * degree, degree):
            u, c, s, new = u[keep], c[keep], s[keep], new[keep]
            if most > degree:
                near = np.arange(len(u)) - np.searchsorted(u, u) < most
                u, c, s, new = u[near], c[near], s[near], new[near]
                # products of one pair may differ in their last digit
                order = np.lexsort((new, c, u))
                first = np.ones(len(u), bool)
                first[1:] = (u[order][1:] != u[order][:-1]) | (c[order][1:] != c[order][:-1])
                keep = np.zeros(len(u), bool)
                keep[order[first]] = True
            else:
                keep = np.arange(len(u)) - np.searchsorted(u, u) < most
        u, c, s, new = u[keep], c[keep], s[keep], new[keep]
        blob = pack(rep, np.bincount(u, minlength=len(rep)).astype(np.int64), c, s, (new > 0).astype(np.uint8), code.ravel())
        return pa.table([table["dest"].slice(0, 1), pa.array([True]), pa.array([blob], pa.binary()), pa.array([int((new == 2).sum())], pa.int64())], ["dest", "old", "blob", "fresh"])

    return run


def _asked(groups: int, step: int):
    """The edges of a round, dealt to the groups of the neighbours that they name."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                rep, sizes, ids, _, new, _ = unpack(blob, *_NODES)
                use = _used(sizes, new, step)
                u, c, new = np.repeat(rep, sizes)[use], ids[use], new[use]
                order, runs = _dealt(_dest(c, groups))
                u, c, new = u[order], c[order], new[order]
                yield from _rows([g for g, _, _ in runs], [pack(c[a:b], u[a:b], new[a:b]) for _, a, b in runs]).to_batches()

    return run


def _thinned(pivot: np.ndarray, member: np.ndarray, kind: np.ndarray, sample: int, k: int) -> np.ndarray:
    """Which of the members stay if each pivot takes ``sample`` new and ``sample`` old ones that it does not have as neighbours."""
    keep = np.ones(len(pivot), bool)
    back = np.flatnonzero((kind & (_OUT | _BACK)) == _BACK)
    place = _pairs(pivot[back], member[back] + k)
    order = back[np.lexsort((place, kind[back] & _NEW, pivot[back]))]
    new = np.ones(len(order), bool)
    new[1:] = (pivot[order][1:] != pivot[order][:-1]) | ((kind[order] & _NEW)[1:] != (kind[order] & _NEW)[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    keep[order[np.arange(len(order)) - first >= sample]] = False
    return keep


def _members(degree: int, groups: int, step: int, sample: int, k: int):
    """Each node of a group, with its code, to the groups of the nodes that it is compared at: once to each group."""

    def run(table: pa.Table) -> pa.Table:
        rep, sizes, ids, sims, new, code = _nodes_of(table)
        last = np.full(len(rep), -np.inf)
        full = sizes >= degree
        last[full] = sims[(np.cumsum(sizes) - 1)[full]]
        use = _used(sizes, new, step)
        owner, ids, new = np.repeat(np.arange(len(rep)), sizes)[use], ids[use], new[use]
        kind = (_BACK + _NEW * (new > 0)).astype(np.uint8)
        keep = _thinned(ids, rep[owner], kind, sample, k)
        parts = [(rep, np.arange(len(rep)), np.full(len(rep), _SELF, np.uint8)), (ids[keep], owner[keep], kind[keep])]
        by = np.argsort(rep)
        for blob, old in zip(table["blob"].to_pylist(), table["old"].to_pylist(), strict=True):
            if not old:
                c, u, new = unpack(blob, *_EDGES)
                parts.append((u, by[np.searchsorted(rep, c, sorter=by)], (_OUT + _NEW * (new > 0)).astype(np.uint8)))
        pivot, at, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, runs = _dealt(_dest(pivot, groups))
        pivot, at, kind = pivot[order], at[order], kind[order]
        blobs = []
        for _, a, b in runs:
            some, place = np.unique(at[a:b], return_inverse=True)
            blobs.append(pack(pivot[a:b], place.astype(np.int64), kind[a:b], rep[some], last[some], code[some].ravel()))
        return _rows([g for g, _, _ in runs], blobs)

    return run


def _local_join(groups: int, sample: int, k: int):
    """Of some nodes: new neighbours compared with one another and with the old ones; what is better than a neighbour's last."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(b, *_MEMBERS) for b in table["blob"].to_pylist()]
        shift = np.cumsum([0] + [len(x[3]) for x in parts])
        pivot, kind, ids, last = (np.concatenate([x[i] for x in parts]) for i in (0, 2, 3, 4))
        at = np.concatenate([x[1] + n for x, n in zip(parts, shift, strict=False)])
        raw = np.concatenate([x[5] for x in parts]).reshape(len(ids), -1)
        del parts
        scale = np.ascontiguousarray(raw[:, :8]).view(np.float64)[:, 0]
        codes = raw[:, 8:].view(np.int8)
        order = np.lexsort((at, pivot))
        pivot, at, kind = pivot[order], at[order], kind[order]
        first = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (at[1:] != at[:-1])]))
        pivot, at, kind = pivot[first], at[first], np.bitwise_or.reduceat(kind, first)
        keep = _thinned(pivot, ids[at], kind, sample, k)
        pivot, at, kind = pivot[keep], at[keep], kind[keep]
        # of a pivot: the new ones, the old ones, itself
        order = np.lexsort((np.where(kind & _SELF, 2, np.where(kind & _NEW, 0, 1)), pivot))
        pivot, at, kind = pivot[order], at[order], kind[order]
        fresh = np.concatenate([[0], np.cumsum((kind & _NEW) > 0)])
        us, cs, ss = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for a, b in _text.runs(pivot):
            n = int(fresh[b] - fresh[a])
            if not n:
                continue
            m = at[a:b]
            x = codes[m].astype(np.float32)
            s = x[:n] @ x.T
            # what the new ones find
            mine = s * scale[m]
            mine[np.arange(n), np.arange(n)] = -np.inf
            mine[(kind[a : a + n] & _BACK) > 0, -1] = -np.inf  # has the pivot
            i, j = np.nonzero(mine > last[m[:n], None])
            us.append(m[i])
            cs.append(m[j])
            ss.append(mine[i, j])
            # what the old ones find among the new
            theirs = s[:, n:] * scale[m[:n], None]
            theirs[(kind[a : a + n] & _OUT) > 0, -1] = -np.inf  # the pivot has it
            i, j = np.nonzero(theirs > last[m[n:]])
            us.append(m[n + j])
            cs.append(m[i])
            ss.append(theirs[i, j])
        u, c, s = np.concatenate(us), np.concatenate(cs), np.concatenate(ss)
        pair = (u << 32) | c
        order = np.argsort(pair)
        pair = pair[order]
        order = order[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(order) else order
        return _sent(ids[u[order]], ids[c[order]], s[order], groups)

    return run


def _listed(batches):
    """The lists of packed nodes as rows."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            rep, sizes, ids, sims, _, _ = unpack(blob, *_NODES)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.record_batch([pa.array(rep), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(sims))], ["rep", "ids", "sims"])


def build_graph(nodes: DataFrame, n: int, dims: int, degree: int = 64, tables: int = 3, sample: int = 64, rounds: int | None = None, step: int = 24) -> tuple[DataFrame, DataFrame]:
    """(rep, code) and the graph (rep, ids, sims; nearest first) of ``nodes`` (rep, vec), after ``rounds`` or when it is settled.

    A node brings its ``step`` nearest new neighbours into a round, others wait for the next; and at most ``sample`` new and
    ``sample`` old nodes of which it is a neighbour.
    """
    bits = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    groups = max(8, -(-n // GROUP))
    unit = nodes.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    coded = _shared.written(nodes.mapInArrow(_coded(dims, tables, bits, float(unit)), "rep long, code binary, cells array<long>"), "codes")
    codes = coded.select("rep", "code")
    spread = coded.select("rep", "code", F.posexplode("cells").alias("t", "cell"))
    sizes = spread.groupBy("t", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    dealt = spread.join(sizes, ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep", "t"), "parts"))
    found = dealt.groupBy("t", "cell", "part").applyInArrow(_compare_cell(degree, groups), _MESSAGE)
    state = codes.mapInArrow(_bare(groups), _MESSAGE)
    for k in itertools.count():
        graph = _shared.written(state.union(found).groupBy("dest").applyInArrow(_merge(degree, step), f"{_MESSAGE}, fresh long"), "graph")
        if k == rounds or (k and rounds is None and (graph.agg(F.sum("fresh")).first()[0] or 0) <= SETTLED * n * degree):
            break
        state = graph.select("dest", "old", "blob")
        members = state.union(state.mapInArrow(_asked(groups, step), _MESSAGE)).groupBy("dest").applyInArrow(_members(degree, groups, step, sample, k), _MESSAGE)
        found = members.groupBy("dest").applyInArrow(_local_join(groups, sample, k), _MESSAGE)
    return codes, graph.mapInArrow(_listed, "rep long, ids array<long>, sims array<double>")


def _score(most: int):
    """The best candidates of each query of a group by their codes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = left["q"].to_numpy(), left["c"].to_numpy()
        mine = right["q"].to_numpy()
        order = np.argsort(mine)
        if len(q):
            x, (y, scale) = _matrix(right["asked"])[0][order], _matrix(left["code"])
            s = np.einsum("ij,ij->i", x[np.searchsorted(mine[order], q)], y) * scale
            q, c, s = _best(q, c, s, most)
        else:
            s = np.empty(0)
        return pa.table([pa.array(q), pa.array(c), pa.array(s)], ["q", "c", "s"])

    return run


def search(queries: DataFrame, codes: DataFrame, graph: DataFrame, n_queries: int, beam: int = 64, width: int = 24, hops: int = 8) -> DataFrame:
    """(q, c): up to ``beam`` found nodes of each query node (column rep).

    A hop expands each query's ``width`` best nodes that are not expanded yet; the search ends when
    there are none, or after ``hops``.
    """
    group = F.pmod(F.xxhash64("q"), F.lit(max(8, -(-n_queries // 128)))).cast("int")
    asked = queries.select(F.col("rep").alias("q")).join(codes, F.col("q") == F.col("rep")).select(group.alias("g"), "q", F.col("code").alias("asked"))
    start = queries.join(graph, "rep").select(F.col("rep").alias("q"), "ids")
    frontier = start.select("q", F.explode(F.slice("ids", 1, width)).alias("c"))
    held = start.select("q", F.explode("ids").alias("c"))
    expanded = None
    for k in range(hops):
        near = frontier.join(graph.select(F.col("rep").alias("c"), "ids"), "c").select("q", F.explode("ids").alias("c"))
        seen = near.union(held).where("q <> c").distinct()
        rows = seen.join(codes.withColumnRenamed("rep", "c"), "c").select(group.alias("g"), "q", "c", "code")
        found = _shared.written(rows.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(_score(beam), "q long, c long, s double"), "found")
        held = found.select("q", "c")
        if k + 1 < hops:
            expanded = frontier if expanded is None else expanded.union(frontier)
            rank = Window.partitionBy("q").orderBy(F.desc("s"), "c")
            best = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= width).select("q", "c")
            frontier = _shared.cut(best.join(expanded, ["q", "c"], "left_anti"))
            if frontier.isEmpty():
                break
    return held


def _products(batches):
    """Inner products of pairs of vectors in double precision."""
    for batch in batches:
        n = batch.num_rows
        x, y = (batch.column(c).flatten().to_numpy().reshape(n, -1).astype(np.float64) if n else np.empty((0, 1)) for c in ("x", "y"))
        yield pa.record_batch([batch.column("q"), batch.column("c"), pa.array(np.einsum("ij,ij->i", x, y))], ["q", "c", "score"])


def nearest(vectors: DataFrame, is_query, id: str = "vec_id", vec: str = "embedding", k: int = 20, **graph_options) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` (a column) holds."""
    v = F.col(f"`{vec}`")
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id}`").alias("id"), v.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("ask")).where(usable & F.col("id").isNotNull())
    kind = dict(rows.dtypes)["id"]
    lengths = sorted(r["d"] for r in rows.groupBy(F.size("vec").alias("d")).count().collect())  # one row for each length
    if not lengths:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    return reduce(DataFrame.unionByName, [_nearest(rows.where(F.size("vec") == d), d, k, graph_options) for d in lengths])


def _nearest(rows: DataFrame, dims: int, k: int, graph_options: dict) -> DataFrame:
    """As nearest, for vectors (id, vec, ask) of one length."""
    keyed = rows.withColumn("h1", F.xxhash64("vec"))
    # a node is known by its vector's hash: different vectors may have the same ids
    members = _shared.written(keyed.select("id", F.col("h1").alias("rep"), "ask", "vec").distinct(), "members")
    # an id of several vectors is left out of its own answers as often
    most = k + (members.select("id", "rep").distinct().groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    nodes = _shared.written(members.groupBy("rep").agg(F.min("vec").alias("vec")), "nodes")
    codes, graph = build_graph(nodes, nodes.count(), dims, **graph_options)
    asked = _shared.cut(members.where("ask").select("rep").distinct())
    n_asked = asked.count()
    found = search(asked, codes, graph, n_asked)
    # a node's own copies are found with it; of many copies the smallest ids suffice
    pairs = found.union(asked.select(F.col("rep").alias("q"), F.col("rep").alias("c"))).distinct()
    both = pairs.join(nodes.select(F.col("rep").alias("q"), F.col("vec").alias("x")), "q").join(nodes.select(F.col("rep").alias("c"), F.col("vec").alias("y")), "c")
    scored = both.select("q", "c", "x", "y").mapInArrow(_products, "q long, c long, score double")
    by_id = Window.partitionBy("rep").orderBy("id")
    few = members.select("id", "rep").distinct().withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= most).select(F.col("rep").alias("c"), "id")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    named = scored.join(few, "c").withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= most).select("q", "id", "score")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = members.where("ask").select(F.col("id").alias("query_id"), F.col("rep").alias("q")).distinct()
    out = queries.join(named.withColumnRenamed("id", "vec_id"), "q").where("query_id <> vec_id")
    return out.withColumn("rank", F.row_number().over(by_query).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
