"""Near-duplicate embeddings by lattice hashing, verified by cosine in double precision.

Each of TABLES tables projects unit vectors to eight dimensions by random orthonormal rows and
scales and shifts them; the nearest point of the E8 lattice names the cell. A vector is
indexed in its own cell and looks also into the PROBES neighbouring cells (of the 240 at
minimal distance) that lie nearest to it. Cells hold vectors of one label and length.

All vectors that lie in a cell or look into it meet there. A cell names the smallest of them as
its hub, and all that share a hub form a cluster, which is cut into blocks of about BLOCK members. A
pair of blocks is one task: one matrix product in double precision finds all links between
them. A pair that shares several hubs counts under the smallest alone. What a task returns is a
row for each member: how many others it is linked to, and a member that it reaches; links are never rows.

Rows with equal vectors and labels are one class; a class is hashed and compared once, and
copies count as links of each other, so no pairs among copies are made.

Defined results: a null label or a vector that is null, empty, zero or holds null or non-finite
components has n_links 0 and is its own component; vectors of different lengths never link; null ids are
counted as links of others, and have no part in a component's smallest id (null if no other is there, kept then);
repeated rows are vectors of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, components, python_ready, stored

#: At this scale 99.9 % of pairs at a cosine of just 0.93 in 64 dimensions meet in a table (4,000 random pairs); a coarser lattice finds no more and lists ten times the candidates.
TABLES, PROBES, SCALE = 10, 12, 3.0
#: Members of a block, about.
BLOCK = 1000


def _e8() -> np.ndarray:
    """The 240 shortest vectors of E8, by rule: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    out += [np.array([0.5 if k >> i & 1 else -0.5 for i in range(8)]) for k in range(256) if bin(k).count("1") % 2 == 0]
    return np.array(out)


MINIMAL = _e8()


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row, doubled, as whole numbers."""

    def d8(y: np.ndarray) -> np.ndarray:  # nearest point with an even sum
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) % 2)
        worst = np.abs(y[odd] - r[odd]).argmax(1)
        step = np.where(y[odd, worst] >= r[odd, worst], 1.0, -1.0)
        r[odd, worst] += step
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], b, a)).astype(np.int64)


def _frames(dim: int, tables: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(tables):
        q, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), max(dim, 8))))
        out.append(q[:8, :dim] * np.sqrt(dim / 8))
    return np.array(out), rng.random((tables, 8)) * 2


def cells(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each table its number, the own cell's key of each vector, and the keys of the probed neighbours."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    frames, shifts = _frames(vectors.shape[1], tables)
    mul = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(8)], np.uint64)

    def key(points: np.ndarray, t: int) -> np.ndarray:
        h = (points.astype(np.int64).view(np.uint64) * mul).sum(-1, dtype=np.uint64) + np.array([t + 1], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).view(np.int64)

    for t in range(tables):
        x = scale * unit @ frames[t].T + shifts[t]
        own = decode(x)
        rest = x - own / 2
        # |rest - v|^2 = |rest|^2 - 2 rest.v + 2: nearest neighbours have the largest rest.v
        order = np.argpartition(-(rest @ MINIMAL.T), probes - 1, axis=1)[:, :probes]
        near = own[:, None, :] + np.rint(2 * MINIMAL[order]).astype(np.int64)
        yield t, key(own, t), key(near, t)


def _rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column, flat, and where each row begins, with the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    at = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()), at - at[0]


def _cells_of(batches: Iterator[pa.RecordBatch], tables: int, probes: int, scale: float) -> Iterator[pa.RecordBatch]:
    """(node, cell, home) of batches (node, v, kind); kind is part of the cell, so other kinds never meet."""
    for b in batches:
        node, kind = b.column(0).to_numpy(), b.column(2).to_numpy()
        flat, at = _rows(b.column(1))
        size = np.diff(at)
        for dim in np.unique(size):
            pick = np.flatnonzero(size == dim)
            x = np.stack([flat[at[i] : at[i] + dim] for i in pick])
            x = x / np.abs(x).max(1, keepdims=True)
            for _, own, near in cells(x, tables, probes, scale):
                keys = np.concatenate([own ^ kind[pick], (near ^ kind[pick, None]).ravel()])
                who = np.concatenate([node[pick], np.repeat(node[pick], near.shape[1])])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(keys), pa.array(np.arange(len(keys)) < len(own))], names=["node", "cell", "home"])


def _shares(hubs: list[np.ndarray], hub: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do members a[i] and b[i] share a hub smaller than this one?"""
    owner = np.repeat(np.arange(len(hubs)), [len(h) for h in hubs])
    value = np.concatenate([*hubs, np.zeros(0, np.int64)])
    owner, value = owner[value < hub], value[value < hub]
    distinct, at, n = np.unique(value, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    bits = np.zeros((len(hubs), int((n > 1).sum())), bool)
    bits[owner[keep], column[at[keep]]] = True
    packed, out = np.packbits(bits, axis=1), np.zeros(len(a), bool)
    for i in range(0, len(a), 65_536) if bits.shape[1] else []:
        out[i : i + 65_536] = (packed[a[i : i + 65_536]] & packed[b[i : i + 65_536]]).any(1)
    return out


def _representatives(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member that the links (a, b) reach from it."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(threshold: float):
    def compare_all(rows: pa.Table) -> pa.Table:
        """compare() of each pair of blocks that lies in a task."""
        rows = rows.sort_by([(k, "ascending") for k in ("hub", "i", "j")]).combine_chunks()
        keys = np.stack([rows[k].to_numpy() for k in ("hub", "i", "j")])
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]])).tolist()
        return pa.concat_tables([compare(rows.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def compare(rows: pa.Table) -> pa.Table:
        """Of a pair of blocks of a cluster: node, others (copies among the members linked to it here and under no smaller hub), rep (a node it reaches)."""
        hub, i, j = (rows[k][0].as_py() for k in ("hub", "i", "j"))
        node, side, n, kind = (rows[k].to_numpy() for k in ("node", "mine", "n", "kind"))
        flat, at = _rows(rows["v"])
        hubs_flat, hubs_at = _rows(rows["hubs"])
        hubs = [hubs_flat[p:q] for p, q in zip(hubs_at[:-1], hubs_at[1:], strict=True)]
        left, right = [], []
        for k in np.unique(kind):
            same = np.flatnonzero(kind == k)
            for dim in np.unique(np.diff(at)[same]):
                mine = same[np.diff(at)[same] == dim]
                x = np.stack([flat[at[m] : at[m] + dim] for m in mine])
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                first, second = np.flatnonzero(side[mine] == i), np.flatnonzero(side[mine] == j)
                for start in range(0, len(first), 512):
                    p, q = np.nonzero(x[first[start : start + 512]] @ x[second].T >= threshold)
                    p, q = mine[first[start + p]], mine[second[q]]
                    apart = p < q if i == j else np.ones(len(p), bool)
                    left.append(p[apart])
                    right.append(q[apart])
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
        new = ~_shares(hubs, hub, a, b)
        a, b = a[new], b[new]
        others = np.zeros(len(node), np.int64)
        np.add.at(others, a, n[b])
        np.add.at(others, b, n[a])
        hit = np.flatnonzero(others > 0)
        return pa.table({"node": node[hit], "others": others[hit], "rep": node[_representatives(len(node), a, b)[hit]]}, schema=pa.schema([("node", pa.int64()), ("others", pa.int64()), ("rep", pa.int64())]))

    return compare_all


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    python_ready(rows.sparkSession)
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    sound &= F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    whole = F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    marked = given.select("vec_id", "v", F.when(F.coalesce(sound, F.lit(False)), whole).alias("key"), F.xxhash64("label", F.size("v")).alias("kind"))
    classes = marked.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.first("v").alias("v"), F.first("kind").alias("kind"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))

    found = stored(classes.select("node", "v", "kind").mapInArrow(lambda it: _cells_of(it, tables, probes, scale), "node long, cell long, home boolean"))
    # a cell that several vectors look into, and one of them lies in, names its smallest vector as its hub
    hub_of = found.groupBy("cell").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.max("home").alias("home")).where("hub <> last and home").select("cell", "hub")
    members = stored(found.select("node", "cell").join(hub_of, "cell").select("node", "hub").distinct())
    vectors = members.groupBy("node").agg(F.sort_array(F.collect_set("hub")).alias("hubs")).join(classes.select("node", "v", "n", "kind"), "node")
    big = stored(members.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select(F.col("hub").alias("of_hub"), F.ceil(F.col("size") / BLOCK).cast("int").alias("k")))
    n_big = big.limit(BROADCAST_IDS + 1).count()
    sized = members.join(F.broadcast(big) if n_big <= BROADCAST_IDS else big, F.col("hub") == F.col("of_hub"), "left").select("node", "hub", F.coalesce("k", F.lit(1)).alias("k"))
    dealt = sized.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("node", "hub", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).join(vectors, "node")
    # small clusters share tasks of about BLOCK members; a block of a large one is never dealt to several
    tasks = max(-(-sized.count() // BLOCK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(tasks)))
    linked = stored(dealt.groupBy("task").applyInArrow(_compare(threshold), "node long, others long, rep long"))

    others = linked.groupBy("node").agg(F.sum("others").alias("others"))
    labels = components(linked.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    grouped = classes.select("key", "node", "n", "low").join(others, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = stored(grouped.select("key", "n", "low", F.coalesce("others", F.lit(0)).alias("others"), "component"))
    # stored apart, so that an adaptive join may split the members of a large component
    lows = stored(grouped.groupBy("component").agg(F.min("low").alias("component_id")))
    by_key = grouped.join(lows, "component").select("key", (F.col("others") + F.col("n") - 1).alias("n_links"), F.col("component_id"))
    # rows that link with nothing get keys of their own, so they do not meet in one task
    out = marked.select("vec_id", F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("vec_id", "v"))).alias("key")).join(by_key, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull() & component.isNull()).alias("kept"))
