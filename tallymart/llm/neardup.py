"""Near-duplicate vectors by randomised-rotation binary codes.

Each unit vector is turned by a random rotation R; its code is the signs of the turned components, and beside it stands
the correction factor f = <s / sqrt(d), R v>, s being the signs as +1 and -1. For another vector q,
<s / sqrt(d), R q> / f estimates <v, q> without bias, with a deviation of at most
sqrt(1 - f^2) / f / sqrt(d - 1) for random rotations. Codes and factors are stored once a vector, and with them R v in a
byte a component, whose rounding widens the bound. Only these travel to where pairs are estimated. A pair whose
estimate plus ``sigmas`` deviations is below the threshold is dropped; all others, and only those, are computed again in double
precision, for which the vectors that have such pairs are fetched. Of the two estimates of a pair (either side as the code) both
must leave it open.

Pairs to estimate are those that share a cell of one of ``tables`` random partitions: a cell is the place and sign of
the largest component after a rotation, for ``hashes`` rotations together. At a cosine of 0.95 in 64 dimensions two
vectors share a given cell of three with probability 0.21, so that 40 tables miss one such pair in 14,000, and nearer
pairs less often; longer vectors share cells less often and get more tables (tables_for). The rotations are drawn from
fixed seeds: reruns agree.

Vectors that are equal component by component are one class before this. Cells of one vector are dropped before any
vector is shuffled. A cell of more than ``block`` vectors is cut into blocks, and each pair of blocks is a group of its
own, so that no task holds more than two blocks. Pairs aren't written: open ones are a bit each in a row of their first vector,
and a group gives each of its vectors the number of
links found and the first vector of its part; a pair that shares cells in several tables counts in the first only.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, a component of
their own. Vectors of different lengths don't link. Rows of equal vec_id are kept as rows of their own; a null vec_id
never names a component unless it is alone. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small, table, written

THRESHOLD, HASHES, BLOCK, SIGMAS = 0.95, 3, 1024, 6.0
_turns: dict[tuple, np.ndarray] = {}


def rotation(dims: int, seed: int) -> np.ndarray:
    key = dims, seed
    if key not in _turns:
        rng = np.random.default_rng([seed, dims])
        q, r = np.linalg.qr(rng.normal(size=(dims, dims)))
        _turns[key] = q * np.sign(np.diag(r))
    return _turns[key]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cells(vectors: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """The cell of each unit vector in each table, as a 64-bit value; also names the table and the length."""
    n, d = vectors.shape
    single = vectors.astype(np.float32)
    out = np.zeros((tables, n), np.uint64)
    for t in range(tables):
        key = np.full(n, d * 1000003 + t, np.uint64)
        for j in range(hashes):
            turned = single @ rotation(d, 1 + t * hashes + j).astype(np.float32)
            at = np.abs(turned).argmax(axis=1)
            sign = turned[np.arange(n), at] > 0
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (key >> np.uint64(29)) ^ (2 * at + sign).astype(np.uint64)
        out[t] = key
    return out.view(np.int64)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs after the rotation and the correction factor of each unit vector."""
    d = vectors.shape[1]
    turned = vectors @ rotation(d, 0)
    signs = np.where(turned >= 0, 1.0, -1.0)
    return np.packbits(signs > 0, axis=1), (signs * turned).sum(axis=1) / np.sqrt(d)


def rounded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turned vectors in a byte a component, and the step of each."""
    step = np.abs(turned).max(axis=1) / 127
    return np.rint(turned / step[:, None]).astype(np.int8), step


def open_pairs(bits, factor, small_turned, step, rows: slice, cols: slice, threshold: float, sigmas: float) -> np.ndarray:
    """Whether the codes leave the pair (i, j) open, i of rows and j of cols."""
    d = small_turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = small_turned.astype(np.float32) * step[:, None].astype(np.float32)
    slack = sigmas * np.sqrt(np.maximum(1 - factor**2, 0)) / np.sqrt(max(d - 1, 1)) + step.max() / 2 * np.sqrt(d) + 1e-5
    one = (signs[rows] @ turned[cols].T) / np.sqrt(d) + slack[rows, None] >= threshold * factor[rows, None]
    two = (turned[rows] @ signs[cols].T) / np.sqrt(d) + slack[None, cols] >= threshold * factor[None, cols]
    return one & two


def tables_for(dims: int) -> int:
    """So many tables that one pair in 10,000 at a cosine of 0.95 shares no cell of three rotations: 40 up to 64 dimensions, 60 at 384, 74 at 1,536."""
    return 40 + int(np.ceil(7.5 * max(0.0, np.log2(dims / 64))))


def arrays(column) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(part):
    """Of a batch with a list column last: the places and the matrix for each length."""
    n = part.column(part.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield at, arrays(part.column(part.num_columns - 1).take(pa.array(at)))


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(vec_id, k1, k2), the keys null for what can't link; classes(cid, least, n, k1, k2, v)."""
    v = F.col("embedding")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    key = lambda salt: F.when(F.coalesce(good, F.lit(False)), F.xxhash64(F.lit(salt), v))
    rows = embeddings.select("vec_id", key(0).alias("k1"), key(1).alias("k2"), F.col("embedding").alias("v"))
    same = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    return rows.drop("v"), written(same.withColumn("cid", F.monotonically_increasing_id()))


class Columns:
    """A table's columns as numpy arrays; lists and binaries as matrices of the rows asked for, which are of one length."""

    def __init__(self, table: pa.Table):
        self.plain, self.long = {}, {}
        for name, column in zip(table.column_names, table.columns):
            column = column.combine_chunks()
            if pa.types.is_list(column.type) or pa.types.is_binary(column.type):
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                data = column.values.to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) else np.frombuffer(column.buffers()[2] or b"", np.uint8)
                self.long[name] = offsets, data
            else:
                self.plain[name] = column.to_numpy()

    def __getitem__(self, name):
        return self.plain[name]

    def matrix(self, name: str, rows: slice) -> np.ndarray:
        offsets, data = self.long[name]
        return data[offsets[rows.start] : offsets[rows.stop]].reshape(rows.stop - rows.start, -1)

    def one(self, name: str, row: int) -> np.ndarray:
        offsets, data = self.long[name]
        return data[offsets[row] : offsets[row + 1]]


def by_group(parts, solve, schema: pa.Schema):
    """Of batches sorted by key, i and j: solve(columns, rows) of each complete group gives columns or None; one batch out for one in."""
    wait = None

    def solved(table, edges):
        columns = Columns(table)
        found = [x for s, e in zip(edges[:-1], edges[1:]) if (x := solve(columns, slice(int(s), int(e)))) is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(sum(x, []) if isinstance(x[0], list) else np.concatenate(x), f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    for part in parts:
        now = pa.Table.from_batches([part])
        wait = now if wait is None else pa.concat_tables([wait, now])
        k, i, j = (wait.column(c).to_numpy() for c in ("key", "i", "j"))
        new = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        if len(new):
            yield from solved(wait.slice(0, new[-1]), np.concatenate(([0], new)))
            wait = wait.slice(new[-1])
    if wait is not None and len(wait):
        yield from solved(wait, np.array([0, len(wait)]))


def near(embeddings: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, hashes: int = HASHES, block: int = BLOCK, sigmas: float = SIGMAS) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, n_links, component_id, kept. tables None: by length."""
    rows, classes = classes_of(embeddings)

    def emit(parts):
        for part in small(parts):
            cid = part.column(0).to_numpy()
            for at, matrix in by_length(part):
                n = tables or tables_for(matrix.shape[1])
                key = cells(unit(matrix), n, hashes)
                for t in range(0, n, 8):
                    few = key[t : t + 8]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(few.ravel()), pa.array(np.tile(cid[at], len(few))), pa.array(np.repeat(np.arange(t, t + len(few), dtype=np.int32), len(at)))],
                        ["key", "cid", "tab"],
                    )

    def encode(parts):
        for part in small(parts):
            cid = part.column(0).to_numpy()
            for at, matrix in by_length(part):
                v = unit(matrix)
                bits, factor = codes(v)
                turned, step = rounded(v @ rotation(v.shape[1], 0))
                columns = [pa.array(cid[at]), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(factor), pa.array([x.tobytes() for x in turned], pa.binary()), pa.array(step)]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "bits", "factor", "turned", "step"])

    coded = written(classes.select("cid", "v").mapInArrow(encode, "cid long, bits binary, factor double, turned binary, step double"))
    placed = classes.select("cid", "v").mapInArrow(emit, "key long, cid long, tab int")
    shared = written(placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    members = placed.join(shared, "key").withColumn("blocks", blocks).withColumn("own", own)
    members = members.select("key", "cid", "tab", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = lambda x: x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "cid")
    types = {"key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "own": pa.int32(), "cid": pa.int64(), "tab": pa.int32(), "place": pa.int32(), "cut": pa.int32(), "open": pa.binary()}
    opened = "key long, i int, j int, own int, cid long, tab int, place int, cut int, open binary"

    def estimate(c, rows):
        """One cell, or one pair of its blocks: its vectors that have open pairs; the first ones' rows have a bit for each second one."""
        i, j, own = c["i"][rows.start], c["j"][rows.start], c["own"][rows]
        cut = int((own == i).sum())
        left, right = (slice(0, len(own)),) * 2 if i == j else (slice(0, cut), slice(cut, len(own)))
        ok = open_pairs(c.matrix("bits", rows), c["factor"][rows], c.matrix("turned", rows).view(np.int8), c["step"][rows], left, right, threshold, sigmas)
        if i == j:
            ok = np.triu(ok, 1)
        first, second = ok.any(axis=1), ok.any(axis=0)
        has = np.zeros(len(own), bool)
        has[left] |= first
        has[right] |= second
        if not has.any():
            return None
        at = np.flatnonzero(has)
        packed = np.packbits(ok, axis=1)
        bits = [packed[p].tobytes() if p < len(packed) and first[p] else None for p in at]
        return *(c[x][rows][at] for x in ("key", "i", "j", "own", "cid", "tab")), at, np.full(len(at), 0 if i == j else cut), bits

    estimated = written(dealt(members.join(coded, "cid")).mapInArrow(lambda parts: by_group(parts, estimate, pa.schema(types)), opened))
    full = dealt(estimated.join(classes.select("cid", F.col("n").alias("weight"), "v"), "cid"))

    def solve(c, rows):
        """The open pairs of a cell or of a pair of its blocks, computed again."""
        cid, weight, place, tab = c["cid"][rows], c["weight"][rows], c["place"][rows], int(c["tab"][rows.start])
        vectors = unit(c.matrix("v", rows).astype(np.float64))
        where = np.full(int(place.max()) + 1, -1)
        where[place] = np.arange(len(cid))
        a, b = [], []
        for n in range(len(cid)):
            bits = c.one("open", rows.start + n)
            if len(bits):
                to = np.flatnonzero(np.unpackbits(bits))
                a.append(np.full(len(to), n))
                b.append(to)
        a, b = np.concatenate(a), where[np.concatenate(b) + c["cut"][rows.start]]
        cos = np.einsum("ij,ij->i", vectors[a], vectors[b])
        a, b = a[cos >= threshold], b[cos >= threshold]
        if len(a) and tab:
            used = np.unique(np.concatenate((a, b)))
            key = np.zeros((tab, len(cid)), np.int64)
            key[:, used] = cells(vectors[used], tab, hashes)
            fresh = np.ones(len(a), bool)
            for t in range(tab):
                fresh &= key[t, a] != key[t, b]
            a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        add = np.bincount(a, weight[b], len(cid)) + np.bincount(b, weight[a], len(cid))
        root = np.arange(len(cid))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        has = add > 0
        return cid[has], add[has].astype(np.int64), cid[root[has]]

    found = written(full.mapInArrow(lambda parts: by_group(parts, solve, pa.schema({x: pa.int64() for x in ("cid", "add", "root")})), "cid long, add long, root long"))
    links = found.groupBy("cid").agg(F.sum("add").alias("linked"))
    parts = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "k1", "k2", "least", "n").join(parts, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).drop("node")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    done = named.join(ids, "root").join(links, "cid", "left").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"
    )
    out = rows.join(done, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Without the method: all pairs. The sum runs in another order, which matters only within rounding of the threshold.
ORACLE = r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
      WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
