"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits meet: some value lies within r/2 bits of both. So every fingerprint
emits its ball, all values within half the radius; fingerprints with a value in common are compared.

Over all 64 bits, the ball of a radius of 4 has 2,081 values a fingerprint. To shuffle less, the balls are first taken
on the two 32-bit halves: of 4 differing bits one half holds at most 2, so that a ball of half of 2 (33 values) on each
half meets too. That finds the same pairs with 66 rows a fingerprint; each meeting pair is verified on all 64 bits.

Equal fingerprints are one class before any of this. A value in which more than ``dense`` fingerprints meet (a large
group of near copies) yields no pairs; its members emit their whole 64-bit balls instead. There, all fingerprints that
share a value are within the radius of each other, so that a link from each to the smallest of them loses no component.
Work thus stays in proportion to the fingerprints, however large the groups.

Null, empty and wordless texts have fingerprint zero and are linked like any other. Equal rows share a class; an empty
table gives an empty result.

``similar`` is the form for stages: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. At 0.8
SimHash's majority bits differ in about 15 % of places, so that balls of ten fingerprints find 0.71 of the pairs only. It takes the
least hashes of the set under each of 320 orders instead: of each one bit for a fingerprint, of which 10 % differ at 0.8, and ten at a time
as 45 bands, one of which at least is equal for 0.99 of such pairs. Texts that share a band are compared, first by fingerprints, then by
their exact similarity (see there). Unlike balls of 32 bits, bands of 64 don't meet by chance, however many the texts.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, table, written

WORDS, RADIUS, DENSE = 4, 4, 24
CHUNK = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Of ``similar``: words a shingle, least Jaccard similarity as a fraction's parts, longs of fingerprint bits.
SHINGLE, SHARE, LONGS = 5, (4, 5), 5
#: Bands for each long of fingerprint bits, and least hashes a band: 45 of ten find 0.99 of pairs at the share.
BANDS, LEAST = 9, 10
#: Longs of a sketch of a shingle set, and how many standard deviations sketches may be farther apart than those of sets at the share.
SKETCH, SIGMAS = 32, 5


def fingerprint(text: bytes | None, n: int = WORDS) -> int:
    """Bits set in over half the XXH64 (seed 42) of the n-word shingles, repeats included, as a signed 64-bit value."""
    words = (text or b"").lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends[n - 1 :] - 1).tolist() if len(words) >= n else [len(whole)]
    total, digest, view = np.zeros(64, np.int64), xxhash.xxh64_intdigest, memoryview(whole)
    for at in range(0, len(last), CHUNK):  # of a very long text, a part at a time
        h = np.fromiter((digest(view[s:e], 42) for s, e in zip(starts[at : at + CHUNK], last[at : at + CHUNK])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(last)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tkey (a hash of the text), fp long."""

    def run(parts):
        for part in parts:
            fp = [fingerprint(t.as_py()) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.int64())], ["doc_id", "tkey", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, tkey long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of at most radius of the bits."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(bits), r)]
    return np.array(out, np.uint64)


def emit(fps: DataFrame, bits: int, radius: int) -> DataFrame:
    """fps(fp) -> fp and a value of the ball of each block of so many bits; blocks are kept apart by their number."""
    masks = ball(bits, radius)

    def run(parts):
        for part in parts:
            fp = part.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 256):
                x = fp[at : at + 256]
                for block in range(64 // bits):
                    one = x if bits == 64 else (x >> np.uint64(block * bits)) & np.uint64((1 << bits) - 1)
                    key = (one[:, None] ^ masks[None, :]) | np.uint64(block << bits if bits < 64 else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(x, len(masks)).view(np.int64))], ["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def meetings(rows: DataFrame, radius: int, dense: int) -> DataFrame:
    """rows(key, fp), sorted by key in each partition -> pairs (a, b) within the radius; (a, null): a is in a dense key."""

    def run(parts):
        k0, f0, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def pairs(k, f):
            out, n = [], len(k)
            new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if n else np.zeros(0, int)
            length = np.diff(np.append(new, n))
            many = np.repeat(length > dense, length) | ((k == crowded) if crowded is not None else False)
            out.append((f[many], None))
            k, f = k[~many], f[~many]
            for d in range(1, dense):
                near = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else np.zeros(0, int)
                if not len(near):
                    break
                near = near[np.bitwise_count((f[near] ^ f[near + d]).view(np.uint64)) <= radius]
                out.append((f[near], f[near + d]))
            return out

        def batch(found):
            a = pa.concat_arrays([pa.array(x) for x, _ in found])
            b = pa.concat_arrays([pa.nulls(len(x), pa.int64()) if y is None else pa.array(y) for x, y in found])
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for part in parts:
            k = np.concatenate((k0, part.column(0).to_numpy()))
            f = np.concatenate((f0, part.column(1).to_numpy()))
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if len(k) - cut > dense:  # the last key is a dense one: pass it on now, so that no more than a few rows wait
                yield batch(pairs(k, f))
                crowded = k[-1]
                k0, f0 = k[:0], f[:0]
            else:
                yield batch(pairs(k[:cut], f[:cut]))
                if crowded is not None and crowded != k[-1]:
                    crowded = None
                k0, f0 = k[cut:], f[cut:]
        if len(k0):
            yield batch(pairs(k0, f0))

    return rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """fps(fp), distinct -> (a, b): pairs within the radius whose components are those of all such pairs."""
    if radius < 0 or radius % 4:
        raise ValueError(f"radius {radius}: balls on halves and dense values are exact for multiples of four only")
    half = emit(fps, 32, radius // 4).repartition("key").sortWithinPartitions("key")
    found = written(meetings(half, radius, dense))
    crowd = found.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    hub = emit(crowd, 64, radius // 2)
    # Written, so that adaptive execution can split a hot value: it does so only where neither side of the join is an aggregate.
    least = written(hub.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("key", "a"))
    # Spark takes both sides for as small as the table before the balls; neither may be broadcast.
    stars = hub.join(least.hint("merge"), "key").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return found.filter(F.col("b").isNotNull()).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tkey, fp, root (of the component), component_id: the smallest doc_id reachable by links."""
    fps = written(with_fingerprint(docs))
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(links(classes.select("fp"), radius, dense))
    grouped = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(ids, "root").select("fp", "root", "component_id"))  # so that a hot fingerprint's join is split
    return fps.join(named, "fp").select("doc_id", "tkey", "fp", "root", "component_id")


def signature(text: bytes | None, longs: int, n: int = SHINGLE) -> tuple[int, list[int], np.ndarray]:
    """A hash of the words, and of the set of n-word shingles the sketch, 64 bits a long, and the bands."""
    words = (text or b"").lower().split()
    node = xxhash.xxh64_intdigest(b" ".join(words), 7)
    least = least_hashes(shingles(words, n), longs)
    return node - (1 << 64 if node >> 63 else 0), bits_of(least).tolist(), bands(least, longs)


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """The distinct XXH64 of the n-word shingles (fewer words: the whole sequence), in order."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + n]), 42) for i in range(max(len(words) - n + 1, 1))), np.uint64))


@functools.lru_cache
def orders(longs: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    mix, odd = (rng.integers(0, 1 << 63, 64 * longs, np.uint64)[:, None] for _ in range(2))
    return mix, odd << np.uint64(1) | np.uint64(1)


def least_hashes(h: np.ndarray, longs: int) -> np.ndarray:
    """The least of distinct hashes under each of 64 * longs orders."""
    mix, odd = orders(longs)
    least = np.full(64 * longs, ~np.uint64(0))
    for at in range(0, len(h), 256):  # a part of a very long text at a time
        np.minimum(least, ((h[None, at : at + 256] ^ mix) * odd).min(axis=1), out=least)
    return least


def bits_of(least: np.ndarray) -> np.ndarray:
    return np.packbits((least * MIX >> np.uint64(63)).astype(np.uint8), bitorder="little").view(np.int64)


def sketch(h: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Of distinct hashes, one bit of the least under each of 64 * longs orders: two sets of similarity s differ in (1 - s) / 2 of them."""
    return bits_of(least_hashes(h, longs))


@functools.lru_cache
def picks(longs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each band the orders whose least hashes it takes, and a factor for each."""
    rng = np.random.default_rng(12)
    orders = np.array([rng.choice(64 * longs, LEAST, replace=False) for _ in range(BANDS * longs)])
    return orders, rng.integers(0, 1 << 63, orders.shape, np.uint64) << np.uint64(1) | np.uint64(1)


def bands(least: np.ndarray, longs: int) -> np.ndarray:
    """A value of 64 bits for each band: sets of similarity s have the same one with a probability of s ** LEAST."""
    which, odd = picks(longs)
    return (least[which] * odd).sum(axis=1, dtype=np.uint64).view(np.int64)


def with_signature(docs: DataFrame, longs: int, n: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tkey (a hash of the text), node (a hash of its words), w0, w1 and so on, bands."""
    names = [f"w{k}" for k in range(longs)]

    def run(parts):
        for part in parts:
            found = [signature(t.as_py(), longs, n) for t in part.column(2)]
            ws = [pa.array([w[k] for _, w, _ in found], pa.int64()) for k in range(longs)]
            keys = pa.array([b for _, _, b in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v for v, _, _ in found], pa.int64()), *ws, keys], ["doc_id", "tkey", "node", *names, "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(run, f"doc_id {kind}, tkey long, node long, " + ", ".join(f"{w} long" for w in names) + ", bands array<long>")


def gathered(rows: DataFrame) -> DataFrame:
    """rows(key, node), sorted in each partition -> key, node, hub (the key's smallest node) where a key has two nodes or more.

    Passes rows on as they come: of a key, however large, only the hub is held.
    """

    def run(parts):
        held = None  # key, hub, whether the hub's own row is out
        for part in parts:
            k, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            if not len(k):
                continue
            if held:
                k, n = np.append(held[0], k), np.append(held[1], n)
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            length = np.diff(np.append(starts, len(k)))
            hub, out = np.repeat(n[starts], length), np.repeat(length > 1, length)
            told = bool(length[-1] > 1 or (held and held[2] and len(starts) == 1))
            if held and held[2]:
                out[0] = False
            held = (k[-1], hub[-1], told)
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(n[out]), pa.array(hub[out])], ["key", "node", "hub"])

    return rows.mapInArrow(run, "key long, node long, hub long")


def close(ws: list[str], a: str, b: str, most: int) -> Column:
    """Whether the bits in the columns ws, with a and b before their names, differ in at most so many places."""
    differ = [F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in ws]
    return sum(differ[1:], differ[0]) <= most


def texts_of(docs: DataFrame, keys: DataFrame, make, kind: str) -> DataFrame:
    """keys(tkey), distinct -> tkey, h: what make gives for the text with that hash, read once."""

    def run(parts):
        for part in parts:
            made = [make(t.as_py().lower().split()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], ["tkey", "h"])

    texts = docs.select(F.xxhash64("text").alias("tkey"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(keys, "tkey", "left_semi")
    return written(texts.groupBy("tkey").agg(F.min("text").alias("text")).mapInArrow(run, f"tkey long, h {kind}"))


def sketch_limit(share: tuple[int, int], longs: int = SKETCH) -> int:
    """In how many bits the sketches of sets at the share differ at most, but for SIGMAS standard deviations (five: 3 in 10 million)."""
    far, bits = (1 - share[0] / share[1]) / 2, 64 * longs
    return int(bits * far + SIGMAS * (bits * far * (1 - far)) ** 0.5)


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, longs: int, n: int, share: tuple[int, int]) -> DataFrame:
    """Of pairs(a, b) those whose shingle sets have a Jaccard similarity of at least share.

    Pairs whose fingerprints differ in more bits than ``sketch_limit`` go first; that is five standard deviations away. Texts
    are read again for what is left only, and of each pair the sets have about the same length, so that sets carried to the
    pairs are no more than the texts that have a partner.
    """
    ws = [f"w{k}" for k in range(longs)]
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("tkey").alias(f"t{x}"), *[F.col(w).alias(f"{x}{w}") for w in ws])
    near = written(pairs.join(one("a"), "a").join(one("b"), "b").filter(close(ws, "a", "b", sketch_limit(share, longs))).select("a", "b", "ta", "tb"))
    keys = written(near.select(F.col("ta").alias("tkey")).unionByName(near.select(F.col("tb").alias("tkey"))).distinct())
    sets = texts_of(docs, keys, lambda words: shingles(words, n).view(np.int64), "array<long>")
    left = near.join(sets.select(F.col("tkey").alias("ta"), F.col("h").alias("ha")), "ta")
    both = left.join(sets.select(F.col("tkey").alias("tb"), F.col("h").alias("hb")), "tb")
    up, down = share
    common = F.size(F.array_intersect("ha", "hb"))
    return written(both.filter(common * (up + down) >= (F.size("ha") + F.size("hb")) * up).select("a", "b"))


def across(met: DataFrame, roots: DataFrame) -> DataFrame:
    """met(key, node, hub) -> key, node, hub, root, main (the key's largest root) of keys with several roots; keys in which the
    same nodes meet are looked at once."""
    rows = written(met.join(roots, "node", "left").select("key", "node", "hub", F.coalesce("root", "node").alias("root")))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    several = written(keys.filter("roots > 1").groupBy("n", "sum").agg(F.min(F.struct("key", "main")).alias("k")).select("k.key", "k.main"))
    return written(rows.join(several, "key"))


def similar(docs: DataFrame, longs: int = LONGS, n: int = SHINGLE, share: tuple[int, int] = SHARE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tkey, root: documents are of one root where links join them, a link being two texts whose
    sets of n-word shingles have a Jaccard similarity of share (4 / 5) or more.

    Texts with the same words (by a 64-bit hash) are one node; nodes with a band in common are compared. First, each band's
    smallest node with its other nodes: large groups come together by that. Then, in bands whose nodes are still of several roots,
    the nodes across roots are joined where sketches of their shingle sets (2,048 bits, made for these nodes only) are close: no
    pair that meets and could join two roots goes unlooked at, none inside a root is, and of a large group of texts that are less
    alike no rows come out but those near the share.

    Of pairs at exactly 0.8 the bands find 0.99, of those at 0.85 and more nearly all (``longs`` raises that: 45 rows a text at 5).
    Null, empty and wordless texts are one node; texts of fewer than n words link to those of the same words only.
    """
    ws = [f"w{k}" for k in range(longs)]
    signed = written(with_signature(docs, longs, n))
    nodes = written(signed.groupBy("node").agg(F.min("tkey").alias("tkey"), *[F.min(w).alias(w) for w in ws], F.min("bands").alias("bands")))
    met = written(gathered(nodes.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")))
    verify = lambda pairs: similar_pairs(pairs, nodes, docs, longs, n, share)
    stars = verify(met.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())

    rows = across(met, written(components(stars)))
    keys = written(rows.select("node").distinct().join(nodes.select("node", "tkey"), "node"))
    bits = texts_of(docs, keys.select("tkey").distinct(), lambda words: sketch(shingles(words, n)), "array<long>")
    ss = [f"s{k}" for k in range(SKETCH)]
    wide = written(keys.join(bits, "tkey").select("node", *[F.col("h")[k].alias(w) for k, w in enumerate(ss)]))
    rows = written(rows.join(wide, "node"))
    odd = rows.filter("root <> main").select("key", F.col("node").alias("x"), F.col("root").alias("rx"), *[F.col(w).alias(f"x{w}") for w in ss])
    cross = odd.join(rows, "key").filter("root <> rx AND (root = main OR x < node) AND least(x, node) <> hub").filter(close(ss, "x", "", sketch_limit(share)))
    more = verify(cross.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())
    roots = written(components(stars.unionByName(more)))
    named = written(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    return signed.join(named, "node").select("doc_id", "tkey", "root")


def keep_one(docs: DataFrame, groups=similar) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, of equal ids that with the smallest hash of its text; null
    ids come last. A document is its id and text: its equal rows stay with it, rows of the same id with another text don't. Rows
    without an id are documents of their own: of those with one text one stays (by a hash of its other columns).

    Only what goes is joined with the texts, which aren't shuffled where that is little; texts of several rows without an id are.
    """
    near = written(groups(docs.select("doc_id", "text")).select("doc_id", "tkey", "root"))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")
    first = written(near.groupBy("root").agg(F.min(own).alias("first")))
    gone = written(near.join(first, "root").filter(own != F.col("first")).select(F.col("doc_id").alias("_tm_id"), F.col("tkey").alias("_tm_key")).distinct())
    left = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_tm_id")) & (F.xxhash64(docs["text"]) == F.col("_tm_key")), "left_anti")
    again = written(near.filter("doc_id IS NULL").groupBy(F.col("tkey").alias("_tm_key")).agg(F.count("*").alias("n")).filter("n > 1").select("_tm_key"))
    if again.isEmpty():
        return left
    copy = left["doc_id"].isNull() & (F.xxhash64(left["text"]) == F.col("_tm_key"))
    rest = [c for c in docs.columns if c != "text"]
    by = F.xxhash64(*[c for c, kind in docs.dtypes if c != "text" and "map<" not in kind])
    ones = left.join(again, copy, "left_semi").groupBy("text").agg(F.min_by(F.struct(*rest), by).alias("_tm_row")).select("text", "_tm_row.*")
    return left.join(again, copy, "left_anti").unionByName(ones)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
