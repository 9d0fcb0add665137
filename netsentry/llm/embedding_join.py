"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and split into blocks of
``BLOCK_DIMS`` coordinates. If cos(x, y) >= t then |x - y|^2 <= 2 - 2t, so in at
least one block the squared distance is within that block's share (in
proportion to its coordinates) of the total. In every block the vectors of a
label are range-joined under that budget: a grid over the block's leading
coordinates, cell side twice the block's radius; a vector stands in its home cell
and, per coordinate, in the next cell too if it is within the radius of it, so
any two vectors within the radius meet in exactly one cell (per coordinate the
larger of their home cells). A pair is verified by its exact cosine in the
first block whose budget it meets: the union over the blocks counts each pair
once.

Scale: the more vectors a label has, the more coordinates its grid uses, so
cells stay small; a cell of over ``CELL_ROWS`` rows is dealt into chunks that meet
pairwise, so no task gets an unbounded cell. Equal vectors of a label are
joined as one, with a count. Tasks give each vector's number of links and its
smallest linked neighbour chain (a spanning forest), never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components, and vectors without a label, link with nothing; so do
vectors of different widths. Equal vectors link. Repeated rows count as vectors
of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import staged
from netsentry.llm.components import components

BLOCK_DIMS = 8
CELL_ROWS = 2048
SEED = 7


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Equally wide lists as a matrix, without a Python object per number."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def block_bounds(width: int, dims: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    return [(lo, min(lo + dims, width)) for lo in range(0, width, dims)]


def budgets(width: int, least: float) -> np.ndarray:
    """Squared distance allowed in each block, with room for rounding."""
    return np.array([(2 - 2 * least) * (hi - lo) / width + 1e-9 for lo, hi in block_bounds(width)])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one. They are first scaled by a power of two, which changes no bit of a result but keeps the
    squares of very large and very small components inside double precision."""
    _, power = np.frexp(np.abs(vectors).max(1))
    vectors = np.ldexp(vectors, -power[:, None])
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def cell_rows(vectors: np.ndarray, n_label: np.ndarray, least: float):
    """(row, block, cell name, coordinates where the row is a guest) of all the
    cells that each row stands in."""
    width = vectors.shape[1]
    turned = unit(vectors) @ rotation(width)
    out_row, out_block, out_cell, out_guest = [], [], [], []
    grid = np.clip(np.ceil(np.log(np.maximum(n_label / CELL_ROWS, 1.0)) / math.log(2.5)).astype(int) + 2, 1, BLOCK_DIMS)
    for b, ((lo, hi), budget) in enumerate(zip(block_bounds(width), budgets(width, least))):
        radius = math.sqrt(budget)
        for g in np.unique(np.minimum(grid, hi - lo)).tolist():
            rows = np.flatnonzero(np.minimum(grid, hi - lo) == g)
            x = turned[rows, lo:lo + g] / (2 * radius)
            home = np.floor(x).astype(np.int64)
            near = x - home >= 0.5 - 1e-6
            for mask in range(1 << g):
                bits = (mask >> np.arange(g)) & 1
                here = np.flatnonzero(near[:, bits == 1].all(1))
                cells = home[here] + bits
                out_row.append(rows[here])
                out_block.append(np.full(len(here), b))
                out_cell += [",".join(map(str, c)) for c in cells.tolist()]
                out_guest.append(np.full(len(here), mask))
    return np.concatenate(out_row), np.concatenate(out_block), out_cell, np.concatenate(out_guest)


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row over the links."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def join_cell(block: int, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, guest: np.ndarray,
              side: np.ndarray, least: float, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Of one cell: links of each row (weighted by copies) and the smallest
    linked id. ``side``: chunk of each row; two chunks meet each other, one
    chunk meets itself."""
    order = np.argsort(ids, kind="stable")
    ids, copies, vectors, guest, side = ids[order], copies[order], vectors[order], guest[order], side[order]
    width = vectors.shape[1]
    u = unit(vectors)
    turned, bounds, allowed = u @ rotation(width), block_bounds(width), budgets(width, least)
    guests = ((guest[:, None] >> np.arange(BLOCK_DIMS)) & 1).astype(np.float64)
    two = side.min() != side.max()
    links, a_, b_ = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    squares = np.add.reduceat(turned * turned, [x for x, _ in bounds], axis=1)

    def fits(k: int, t: slice, rest: slice) -> np.ndarray:
        x, y = bounds[k]
        return squares[t, k, None] + squares[None, rest, k] - 2 * turned[t, x:y] @ turned[rest, x:y].T <= allowed[k]

    for lo in range(0, len(ids), tile):
        t, rest = slice(lo, min(lo + tile, len(ids))), slice(lo, len(ids))
        pair = fits(block, t, rest)
        pair &= (side[t, None] != side[None, rest]) if two else True
        pair &= np.arange(lo, len(ids)) > np.arange(len(ids))[t, None]
        if pair.mean() > 0.05:  # near copies, mostly: whole matrices are quicker than single pairs
            for k in range(block):
                pair &= ~fits(k, t, rest)
            pair &= guests[t] @ guests[rest].T == 0  # this cell is the larger home in every coordinate
            pair &= u[t] @ u[rest].T >= least
            links[t] += pair @ copies[rest]
            links[rest] += copies[t] @ pair
            a, b = np.nonzero(pair)
            a_.append(a + lo)
            b_.append(b + lo)
        else:
            a, b = np.nonzero(pair)
            for at in range(0, len(a), 1 << 15):
                i, j = a[at:at + (1 << 15)] + lo, b[at:at + (1 << 15)] + lo
                apart = np.add.reduceat((turned[i] - turned[j]) ** 2, [x for x, _ in bounds], axis=1)
                ok = (apart[:, :block] > allowed[:block]).all(1) & ((guests[i] * guests[j]).sum(1) == 0)
                ok[ok] = (u[i[ok]] * u[j[ok]]).sum(1) >= least
                np.add.at(links, i[ok], copies[j[ok]])
                np.add.at(links, j[ok], copies[i[ok]])
                a_.append(i[ok])
                b_.append(j[ok])
        if sum(map(len, a_)) > 1 << 20:  # keep a spanning forest only
            low = _least_linked(len(ids), np.concatenate(a_), np.concatenate(b_))
            a_, b_ = [np.arange(len(ids))], [low]
    low = _least_linked(len(ids), np.concatenate(a_), np.concatenate(b_))
    back = np.empty(len(ids), np.int64)
    back[order] = np.arange(len(ids))
    return links[back], ids[low][back]


def link_vectors(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept`` of each vector."""
    x = F.col(column)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("v"), F.col(label).alias("label"))
    good = (F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull()
            & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    tagged = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    named = tagged.select("vec_id", "good", "label", "v", *(F.when(F.col("good"), F.xxhash64(F.lit(s), "label", "v")).alias(f"k{s}") for s in (1, 2)))
    reps = staged(named.where("good").groupBy("k1", "k2", "label").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("v", "vec_id").alias("v"))
                  .withColumn("width", F.size("v")), "vectors")
    sizes = reps.groupBy("label", "width").agg(F.count("*").alias("n_label"))
    source = reps.join(sizes, ["label", "width"]).select(F.xxhash64("label", "width").alias("part"), "rep", "copies", "n_label", "v")

    def to_cells(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            widths = pc.list_value_length(t.column("v")).to_numpy()
            for w in np.unique(widths).tolist():
                s = t.filter(pa.array(widths == w))
                m = matrix(s.column("v"), w)
                row, block, cell, guest = cell_rows(m, s.column("n_label").to_numpy(), least)
                yield from pa.table({"part": s.column("part").take(row), "block": pa.array(block, pa.int32()), "cell": pa.array(cell, pa.string()),
                                     "guest": pa.array(guest, pa.int32()), "rep": s.column("rep").take(row), "copies": s.column("copies").take(row),
                                     "v": s.column("v").take(row)}).to_batches()

    cells = source.mapInArrow(to_cells, f"part long, block int, cell string, guest int, rep long, copies long, v {reps.schema['v'].dataType.simpleString()}")
    place = ["part", "block", "cell"]
    large = cells.groupBy(place).agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS).select(*place, F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("chunks"))
    dealt = (cells.join(large, place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
             .withColumn("side", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select(*place, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "guest", "rep", "copies", "v"))

    def meet(t: pa.Table) -> pa.Table:
        ids = t.column("rep").to_numpy()
        two = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        links, low = join_cell(t.column("block")[0].as_py(), ids, t.column("copies").to_numpy(), matrix(t.column("v"), len(t.column("v")[0])),
                               t.column("guest").to_numpy(), t.column("side").to_numpy() if two else np.zeros(len(ids), np.int64), least)
        keep = (links > 0) | (low != ids)
        return pa.table({"rep": ids[keep], "links": links[keep], "low": low[keep]})

    found = staged(dealt.groupBy(*place, "i", "j").applyInArrow(meet, "rep long, links long, low long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    classes = (reps.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
               .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    return (named.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"], "left")
            .select(F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col(key) == F.col("component_id")))
