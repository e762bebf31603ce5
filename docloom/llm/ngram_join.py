"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A document's set holds the 64-bit hashes of its distinct shingles (of fewer words: one hash of all of
them). Documents with equal sets are one class, known by a 128-bit fingerprint, and share all answers.
Classes are joined exactly, by skipping what set relations already decide:

1. Posting lists by shingle count in how many classes each shingle occurs. Shingles of one class can
   be in no intersection; a class that shares fewer than 80 % of its set links with nothing.
2. The others index their prefix only: their rarest shingles, as many as any partner must share one of.
   A list is ordered by size and position; what size and position rule out for a class are blocks of it, which
   are skipped before any pair is made. Long lists are cut into parts, and parts meet two by two in
   different tasks.
3. Answers of similar sets are reused. First each class is compared with one centre, the class it shares
   most lists with. Classes that link there have its answers. Then only lists that still hold several
   components are read: each class is compared with a few classes of other components, what links is
   joined, then with more, and at last with all that are still apart. A pair with one centre is decided
   by what both share with the centre, where that suffices: they share at least what the centre cannot
   hold twice, and at most what they share of it and have outside it. No pair is compared twice.

Links that are verified along the way connect the same classes as all links do. Sets are compared
exactly, on their shared shingles.

4. Every link joins two classes of one component, so all links are counted there: a component's classes
   are dealt to blocks by size, and blocks whose sizes allow links are compared whole, as matrices. No
   row is made for a pair.

A document's links are the other documents whose sets have the similarity, those of equal sets included.

Null texts and texts without words have an empty set and no links. Repeated rows are linked as equal
documents. A null id takes part but is never a component's name, unless it stands alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import _shared, _text
from docloom.llm._packed import pack, unpack
from docloom.operators.components import connected_components

#: Shingles that are packed together before they are sent.
FLUSH = 1 << 20
BUCKETS_PER_PARTITION = 4
#: To how many others a class is compared in each round over the lists that hold several components; at last to all.
ROUNDS = (4, 64, None)
#: Classes of a list, or of a part of a long one, that are looked at together.
PART = 4096
#: Classes of a component that are compared with as many others at once, shingles of one matrix, and shingles sent to one task call.
BLOCK = 256
COLUMNS = 8192
SENT = 1 << 19
#: Rows of narrow tables that one task reads; small tables are read by few tasks.
ROWS_PER_TASK = 200_000
_U = np.uint64


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, sorted by row and hash."""
    data, offsets = _text.flat(texts)
    rows, hashes = [], []
    for first, last in _text.blocks(np.diff(offsets)):
        part = _text.LOWER[data[offsets[first] : offsets[last]]]
        s, e, row = _text.words(part, offsets[first : last + 1] - offsets[first])
        if not len(s):
            continue
        h = _text.Rolling(part).ranges(s, e)
        grams = _text.sequence_hash(h, width)
        ok = np.flatnonzero(row[: len(grams)] == row[width - 1 :]) if len(grams) else np.empty(0, np.int64)
        g, r = grams[ok], row[ok]
        count = np.bincount(row, minlength=last - first)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            begin = (np.cumsum(count) - count)[short]
            whole = [_text.mix(_text.sequence_hash(h[b : b + c], c)[0:1] ^ _U(c)) for b, c in zip(begin.tolist(), count[short].tolist(), strict=True)]
            g, r = np.concatenate([g, *whole]), np.concatenate([r, short])
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        hashes.append(g[new])
        rows.append(r[new] + first)
    return (np.concatenate(rows), np.concatenate(hashes)) if rows else (np.empty(0, np.int64), np.empty(0, _U))


def _fingerprints(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of mixed hashes for each set, and none for an empty one."""
    out = []
    for salt in (0x51ED270B, 0xA0761D6478BD642F):
        sums = np.concatenate([[_U(0)], np.cumsum(_text.mix(h ^ _U(salt)), dtype=_U)])
        edge = np.searchsorted(row, np.arange(n + 1))
        out.append(_text.mix(sums[edge[1:]] - sums[edge[:-1]]))
    return out[0], out[1]


def _postings(width: int, n_buckets: int):
    """Rows of (bucket, shingles of distinct classes, documents); documents ride along, dealt by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            ids, fp, fp2, n, h, at = [], [], [], [], [], []
            base = 0
            # the largest arrays of a task: rows are numbers of four bytes, and what is not needed any more is let go
            for i, row, hh, f1, f2 in held:
                ids.append(i)
                fp.append(f1)
                fp2.append(f2)
                n.append(np.bincount(row, minlength=len(i)))
                h.append(hh)
                at.append(row + np.uint32(base))
                base += len(i)
            held.clear()
            ids, fp, fp2, n = (np.concatenate(x) for x in (ids, fp, fp2, n))
            h, at = np.concatenate(h), np.concatenate(at)
            # equal sets of these documents send their shingles once
            first = np.zeros(len(ids), bool)
            first[np.unique(fp, return_index=True)[1]] = True
            ok = first[at]
            h, at = h[ok], at[ok]
            bucket = ((h >> _U(32)) % _U(n_buckets)).astype(np.uint32)
            home = _text.mix(ids.view(_U)) % _U(n_buckets)
            order = np.lexsort((h, bucket))
            h, at, bucket = h[order], at[order], bucket[order]
            del ok, order
            docs_order = np.argsort(home, kind="stable")
            home = home[docs_order].astype(np.int64)
            keys, blobs = [], []
            edges, d_edges = np.searchsorted(bucket, np.arange(n_buckets + 1)), np.searchsorted(home, np.arange(n_buckets + 1))
            for b in np.flatnonzero((np.diff(edges) > 0) | (np.diff(d_edges) > 0)).tolist():
                mine, d = slice(edges[b], edges[b + 1]), docs_order[d_edges[b] : d_edges[b + 1]]
                used, local = np.unique(at[mine], return_inverse=True)
                keys.append(b)
                blobs.append(pack(fp[used], n[used], np.diff(h[mine], prepend=_U(0)), local.astype(np.uint32), ids[d], n[d], fp[d], fp2[d]))
            return pa.record_batch([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                ids = part.column("_id").to_numpy().copy()  # a view would keep the whole batch
                row, h = shingle_sets(part.column("_text"), width)
                held.append((ids, row.astype(np.uint32), h, *_fingerprints(row, h, len(ids))))
                size += len(h) + len(ids)
                if size >= FLUSH:
                    yield flushed()
                    size = 0
            # the next batch does not wait beside this one
            batch = part = None
        if held:
            yield flushed()

    return run


_POSTING_TYPES = (_U, np.int64, _U, np.uint32, np.int64, np.int64, _U, _U)
_SHARED_TYPES = (_U, np.int64, np.uint32, _U, np.uint32, np.int64, np.int64, _U, _U)
_SETS = "kind int, fp long, fp2 long, n long, doc long, h array<long>"


def _shared_shingles(n_buckets: int):
    """Of one bucket: for each class, the shingles that other classes have too and in how many they are, to the class's bucket."""

    def run(table: pa.Table) -> pa.Table:
        fps, ns, hs, ats, docs = [], [], [], [], []
        base = 0
        for blob in table["blob"].to_pylist():
            fp, n, h, at, *doc = unpack(blob, *_POSTING_TYPES)
            fps.append(fp)
            ns.append(n)
            hs.append(np.cumsum(h, dtype=_U))
            ats.append(at.astype(np.int64) + base)
            docs.append(doc)
            base += len(fp)
        fp, n, h, at = (np.concatenate(x) for x in (fps, ns, hs, ats))
        fp, first, number = np.unique(fp, return_index=True, return_inverse=True)
        n = n[first]
        who = number[at]
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        h, who = h[new], who[new]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        df = np.bincount(group, minlength=1)[group] if len(h) else np.empty(0, np.int64)
        ok = df > 1
        h, who, df = h[ok], who[ok], df[ok]
        order = np.argsort(who, kind="stable")
        h, who, df = h[order], who[order], df[order]
        dest = ((fp[who] >> _U(32)) % _U(n_buckets)).astype(np.int64)
        order = np.argsort(dest, kind="stable")
        h, who, df, dest = h[order], who[order], df[order], dest[order]
        edges = np.searchsorted(dest, np.arange(n_buckets + 1))
        here = table["bucket"][0].as_py()
        riders = [np.concatenate(x) for x in zip(*docs, strict=True)]
        keys, blobs = [], []
        for b in range(n_buckets):
            mine = slice(edges[b], edges[b + 1])
            if edges[b] == edges[b + 1] and b != here:
                continue
            owner, count = np.unique(who[mine], return_counts=True)
            keys.append(b)
            blobs.append(pack(fp[owner], n[owner], count.astype(np.uint32), h[mine], df[mine].astype(np.uint32), *(riders if b == here else [x[:0] for x in riders])))
        return pa.table([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _gathered(percent: int):
    """Of one bucket: its documents (kind 0), and the classes that share enough of their sets (kind 1), rarest shingles first."""

    def run(table: pa.Table) -> pa.Table:
        parts, docs = [], []
        for blob in table["blob"].to_pylist():
            *part, a, b, c, d = unpack(blob, *_SHARED_TYPES)
            parts.append(part)
            docs.append((a, b, c, d))
        fp, n, count, h, df = (np.concatenate(x) for x in zip(*parts, strict=True))
        fp_of = np.repeat(fp, count)
        fp, first, total = np.unique(fp, return_index=True, return_inverse=True)
        n = n[first]
        m = np.bincount(total, count, minlength=len(fp)).astype(np.int64)
        stay = m >= -(-percent * n // 100)
        who = np.searchsorted(fp, fp_of)
        ok = stay[who] if len(who) else np.empty(0, bool)
        h, df, who = h[ok], df[ok], who[ok]
        order = np.lexsort((h, df, who))
        h, who = h[order], who[order]
        kept = np.flatnonzero(stay)
        ids, dn, dfp, dfp2 = (np.concatenate(x) for x in zip(*docs, strict=True))
        k0, k1 = len(ids), len(kept)
        offsets = np.concatenate([np.zeros(k0, np.int64), [0], np.cumsum(m[kept])]).astype(np.int32)
        return pa.table({
            "kind": pa.array(np.repeat([0, 1], [k0, k1]), pa.int32()),
            "fp": pa.array(np.concatenate([dfp, fp[kept]]).view(np.int64)),
            "fp2": pa.array(np.concatenate([dfp2, np.zeros(k1, _U)]).view(np.int64)),
            "n": pa.array(np.concatenate([dn, n[kept]])),
            "doc": pa.array(np.concatenate([ids, np.zeros(k1, np.int64)])),
            "h": pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64))),
        })

    return run


def _kept(df: DataFrame) -> DataFrame:
    """The same narrow rows without lineage, read by as many tasks as they need."""
    out = _shared.cut(df)
    return out.coalesce(max(8, out.count() // ROWS_PER_TASK))


def _needed(a, b, percent: int):
    """How many shingles sets of these sizes (numbers, arrays or columns) must share: 100 * i >= percent * (a + b - i)."""
    if isinstance(b, Column):
        return -F.floor(-percent * (a + b) / (100 + percent))
    return -(-percent * (a + b) // (100 + percent))


def _centres(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: for each class the first class (c) of one of its lists that size and position allow, the one it shares most lists with."""
    fits = F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos")) >= _needed(F.col("n"), F.col("c.n"), percent)
    count = lists.where("fp <> c.fp").where(fits).groupBy(F.col("fp").alias("a"), F.col("c.fp").alias("b")).agg(F.count("*").alias("c"))
    return count.groupBy("a").agg(F.max(F.struct("c", "b"))["b"].alias("b"))


def _units(lists: DataFrame, comp: DataFrame, n_buckets: int) -> DataFrame:
    """The lists with the components of their classes, long ones as pairs of parts, dealt to buckets."""
    of = lists.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("comp", F.coalesce("component", "fp"))
    dealt = of.withColumn("p", F.pmod(F.xxhash64("fp"), "parts")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1)
    unit = F.xxhash64("h", F.least("p", "q"), F.greatest("p", "q"))
    return dealt.select(unit.alias("unit"), side.alias("side"), "fp", "n", "pos", "comp", "centre", "shared", "n_centre").withColumn("bucket", F.pmod("unit", F.lit(n_buckets)).cast("int"))


def _across(percent: int, most: int | None):
    """Of some lists: pairs of classes in different components, from each class to at most ``most`` others.

    Which others is drawn from both fingerprints, so a class draws much the same ones in all its lists.
    The largest component of a list draws none; the others draw from it. ``links``: whether what both share with
    one centre says that they link; what it refutes is left out. One row more, without ``links``, says that a
    class had more others; where there is none, no later round can add a link.
    """

    def partners(size: int, place: int, sizes: np.ndarray, begin: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Of classes in the order of size and position: those that size and position allow, as blocks."""
        a, b = np.searchsorted(sizes, (-(-percent * size // 100), 100 * size // percent + 1))
        of = sizes[a:b]
        needed = _needed(size, of, percent)
        ok = needed <= size - place
        lo, hi = begin[a:b][ok], np.searchsorted(key, (of[ok] << 32) + of[ok] - needed[ok], "right")
        return _text.ragged(lo, np.maximum(hi - lo, 0))

    def run(table: pa.Table) -> pa.Table:
        unit, side, fp, n, pos, comp, centre, shared, n_centre = (table[c].to_numpy() for c in ("unit", "side", "fp", "n", "pos", "comp", "centre", "shared", "n_centre"))
        order = np.lexsort((pos, n, side, unit))
        draw = _text.mix(fp.astype(np.uint64))
        more = False
        left, right, told = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        for a, b in _text.runs(unit[order]):
            rows = order[a:b]
            whole = side[rows[0]] == 2
            k = 0 if whole else int((side[rows] == 0).sum())
            asked, others = (rows, rows) if whole else (rows[:k], rows[k:])
            if not len(asked) or not len(others) or (comp[rows] == comp[rows[0]]).all():
                continue
            if whole:  # pairs are found from the end that is not in the largest component
                names, count = np.unique(comp[rows], return_counts=True)
                asked = rows[comp[rows] != names[count.argmax()]]
            key = (n[others] << 32) + pos[others]
            sizes, begin = np.unique(n[others], return_index=True)
            for i in asked.tolist():
                j = others[partners(int(n[i]), int(pos[i]), sizes, begin, key)]
                j = j[comp[j] != comp[i]]
                # sets with one centre share at most what they share of it and have outside it, and at least what it cannot hold twice
                same, needed = (centre[j] == centre[i]) & (centre[j] != 0), _needed(n[i], n[j], percent)
                at_most = np.minimum(shared[j], shared[i]) + np.minimum(n[j] - shared[j], n[i] - shared[i])
                j = j[~same | (at_most >= needed)]
                if most is not None and len(j) > most:
                    more = True
                    j = j[np.argpartition(_text.mix(draw[j] ^ fp[i].astype(np.uint64)), most)[:most]]
                left.append(np.full(len(j), fp[i]))
                right.append(fp[j])
                told.append((centre[j] == centre[i]) & (centre[j] != 0) & (shared[j] + shared[i] - n_centre[i] >= _needed(n[i], n[j], percent)))
        l, r = np.concatenate(left), np.concatenate(right)
        pair, first = np.unique(np.stack([np.minimum(l, r), np.maximum(l, r)]), axis=1, return_index=True)
        a, b, links = [*pair[0].tolist(), *[0] * more], [*pair[1].tolist(), *[0] * more], [*np.concatenate(told)[first].tolist(), *[None] * more]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.bool_())})

    return run


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, shared: how many shingles each pair shares. Sets are fetched for both ends by one join, which splits a hot class."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
    size = lambda end: F.max(F.when(F.col("fp") == F.col(end), F.col("n")))
    both = ends.join(sets.select("fp", "n", "h"), "fp").groupBy("a", "b").agg(size("a").alias("na"), size("b").alias("nb"), F.collect_list("h").alias("h"))
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect(F.col("h")[0], F.col("h")[1])).alias("shared"))


def _overlaps(values: np.ndarray, count: np.ndarray, k: int, own: bool) -> np.ndarray:
    """How many values each of the first ``k`` sets shares with each of the others, or with each of all sets if ``own``."""
    row = np.repeat(np.arange(len(count)), count)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    out = np.zeros((k, k if own else len(count) - k), np.float32)
    last = column[-1] + 1 if len(column) else 0
    for first in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        m = np.zeros((len(count), min(COLUMNS, last - first)), np.float32)
        m[row[a:b], column[a:b] - first] = 1
        out += m[:k] @ (m if own else m[k:]).T
    return out.astype(np.int64)


def _counted(percent: int):
    """Of some pairs of blocks: how many documents each class links with there."""

    def run(table: pa.Table) -> pa.Table:
        unit, side, fp, n, docs = (table[c].to_numpy() for c in ("unit", "side", "fp", "n", "docs"))
        lists = table["h"].combine_chunks()
        values, count = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(count) - count
        order = np.lexsort((side, unit))
        linked = np.zeros(len(fp), np.int64)
        for a, b in _text.runs(unit[order]):
            rows = order[a:b]
            own = side[rows[0]] == 2
            k = len(rows) if own else int((side[rows] == 0).sum())
            x, y = rows[:k], rows if own else rows[k:]
            if not len(x) or not len(y):
                continue
            shared = _overlaps(np.concatenate([values[start[r] : start[r] + count[r]] for r in rows]), count[rows], k, own)
            ok = shared >= _needed(n[x][:, None], n[y][None, :], percent)
            if own:
                np.fill_diagonal(ok, False)
            else:
                linked[y] += docs[x] @ ok
            linked[x] += ok @ docs[y]
        return pa.table({"fp": pa.array(fp), "linked": pa.array(linked)})

    return run


def _link_counts(comp: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """fp, linked: how many documents of other classes each class (fp, docs) links with, by all pairs of its component."""
    # sizes of linked classes are in one band or in bands side by side
    width = math.log(max(100 / percent, 1.01)) * (1 + 1e-9)
    size = sets.select("fp", "n", F.size("h").alias("held"))
    nodes = comp.join(classes.groupBy("fp").agg(F.sum("docs").alias("docs")), "fp").join(size, "fp")
    nodes = _kept(nodes.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width)))
    sizes = _kept(nodes.groupBy("component", "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.sum("held").alias("mass")))
    blocks = sizes.select("component", "band", "mass", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    blocks = blocks.select("component", "band", "p", (F.col("mass") / F.col("parts")).alias("each"))
    left = blocks.select("component", "band", "p", "each", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band2"))
    right = blocks.select("component", F.col("band").alias("band2"), F.col("p").alias("p2"), F.col("each").alias("each2"))
    pairs = left.join(right, ["component", "band2"]).where("band < band2 OR p <= p2").withColumn("unit", F.xxhash64("component", "band", "p", "band2", "p2"))
    own = F.col("band").eqNullSafe(F.col("band2")) & (F.col("p") == F.col("p2"))
    one = pairs.select("unit", "component", "band", "p", F.when(own, 2).otherwise(0).alias("side"), "each")
    other = pairs.where(~own).select("unit", "component", F.col("band2").alias("band"), F.col("p2").alias("p"), F.lit(1).alias("side"), F.col("each2").alias("each"))
    sides = _kept(one.union(other))
    mass = sides.agg(F.sum("each")).first()[0] or 0
    tasks = max(16, math.ceil(mass / SENT))
    placed = nodes.join(sizes.select("component", "band", "parts"), ["component", "band"]).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts"))).drop("parts")
    dealt = placed.join(sides.drop("each"), ["component", "band", "p"]).select(F.pmod("unit", F.lit(tasks)).cast("int").alias("bucket"), "unit", "side", "fp", "n", "docs")
    dealt = dealt.join(sets.select("fp", "h"), "fp").select("bucket", "unit", "side", "fp", "n", "docs", "h")
    return dealt.groupBy("bucket").applyInArrow(_counted(percent), "fp long, linked long").groupBy("fp").agg(F.sum("linked").alias("linked"))


def link_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5, links_counted: bool = True) -> DataFrame:
    """id, n_shingles, component_id of each row of ``docs``, class_fp, the fingerprint of its set, and n_links, if they are counted."""
    n_buckets = max(16, BUCKETS_PER_PARTITION * _shared.input_partitions(docs))
    number, named_again = _shared.null_last(docs, id)
    rows = docs.select(number.alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    posted = rows.mapInArrow(_postings(width, n_buckets), "bucket int, blob binary")
    shared = posted.groupBy("bucket").applyInArrow(_shared_shingles(n_buckets), "bucket int, blob binary")
    table = _shared.written(shared.groupBy("bucket").applyInArrow(_gathered(percent), _SETS), "sets")
    members = table.where("kind = 0").select("doc", "n", "fp", "fp2")
    ceil_n = -(F.floor(F.lit(-percent) * F.col("n") / 100))
    # shingles of one class alone come before all others in its order
    sets = table.where("kind = 1").select("fp", "n", (F.col("n") - F.size("h")).alias("alone"), "h")
    prefix = F.greatest(F.col("n") - ceil_n + 1 - F.col("alone"), F.lit(0)).cast("int")
    lists = sets.where(prefix > 0).select("fp", "n", "alone", F.posexplode(F.slice("h", F.lit(1), prefix)).alias("i", "h")).select("fp", "n", (F.col("alone") + F.col("i")).alias("pos"), "h")
    links_of = lambda m: m.where((100 + percent) * F.col("shared") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = lists.groupBy("h").agg(F.min(F.struct("fp", "n", "pos")).alias("c"), F.ceil(F.count("*") / PART).alias("parts"))
    lists = _kept(lists.join(first, "h"))
    best = _kept(_measured(_centres(lists, percent), sets))
    tried = ordered(best)
    centred = best.select(F.col("a").alias("fp"), F.col("b").alias("centre"), F.col("shared").cast("long").alias("shared"), F.col("nb").alias("n_centre"))
    zero = F.lit(0).cast("long")  # no centre
    lists = _kept(lists.drop("c").join(centred, "fp", "left").withColumns({x: F.coalesce(x, zero) for x in ("centre", "shared", "n_centre")}))
    comp = connected_components(links_of(best))
    for most in ROUNDS:
        pairs = _units(lists, comp, n_buckets).groupBy("bucket").applyInArrow(_across(percent, most), "a long, b long, links boolean")
        known = pairs.withColumn("old", F.lit(False)).union(tried.select("a", "b", F.lit(False).alias("links"), F.lit(True).alias("old")))
        told = _kept(known.groupBy("a", "b").agg(F.max("links").alias("links"), F.max("old").alias("old")).where("NOT old").select("a", "b", "links"))
        more = _kept(links_of(_measured(told.where("NOT links"), sets)).union(told.where("links").select("a", "b")))
        if not more.isEmpty():
            # every class beside its component's name connects what the links so far connect
            comp = connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        if told.where("links IS NULL").isEmpty():
            break
        tried = tried.union(told.where("links IS NOT NULL").select("a", "b"))
    comp = comp.withColumnRenamed("node", "fp")
    # one small row for each class before components are named
    classes = members.where("n > 0").groupBy("fp", "fp2").agg(F.min("doc").alias("least"), F.count("*").alias("docs"))
    classes = _kept(classes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("fp", "fp2", "component_id", "docs")
    n_links = []
    if links_counted:
        counts = _link_counts(comp, classes.select("fp", "docs"), sets, percent)
        named = named.join(counts, "fp", "left").select("fp", "fp2", "component_id", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    out = members.join(named, ["fp", "fp2"], "left")
    component = F.when(F.col("n") == 0, named_again(F.col("doc"))).otherwise(named_again(F.col("component_id")))
    return out.select(named_again(F.col("doc")).alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("fp").alias("class_fp"), *n_links)
