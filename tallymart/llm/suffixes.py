"""Removing repeated text by longest previous factors over suffix order.

A byte goes if it lies in ``least`` bytes that also start earlier, that is, if the longest previous factor at one of the
``least`` places up to it is that long. Suffixes are compared by their first ``least`` bytes.

Sorting the suffixes at every byte would shuffle the corpus a hundred times over. So first, suffixes that can't repeat
are ruled out, exactly:

1. Each window of ``least`` bytes has an anchor, the leftmost of its 32-byte grams with the smallest hash. Equal windows
   have equal anchors at the same place. Runs of windows with one anchor form a context: the bytes under all of them.
   One row a context is shuffled by the anchor's hash, about one for 32 bytes.
2. A context equal to an earlier one goes entirely; of equal contexts only the first is looked at further. A context
   whose anchor occurs in no other context holds no window that occurs elsewhere: nothing of it goes.
3. The windows of the other contexts (about one in twenty) are the suffixes left. They are put in suffix order with
   those of the same anchor; the longest previous factor of each follows from the suffixes at the previous and the next
   smaller position in that order, and each with one of full length goes.

Earlier means a smaller doc_id, or an earlier place in the same document; null ids come last. Strings are judged on the
input. Rows with equal doc_id and text count as one document and get equal results; rows with equal ids but other texts
are ordered by a hash of the text. Null text is empty; texts under ``least`` bytes stay whole. An empty table gives no rows.

Hot groups: a task leaves out the later copies that it sees itself, so that a string in a third of all documents comes
to a row a batch; anchors with over ``crowd`` contexts deal out their windows one by one, by a hash of the window.
Contexts and windows pass through tasks as sorted streams of which a batch is held. Hashes have 64 bits for anchors and
64 more for contexts; factors are compared as bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import before, small, table, written

LEAST, GRAM, CROWD = 100, 32, 4096
PIECE = 1 << 20
MUL, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ANCHORS = "anchor long, context long, doc long, t int, p long, q long"
_powers: dict[int, tuple] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte; powers of MUL and of its inverse up to n."""
    if n not in _powers:
        base = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        up = lambda x: np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, x, np.uint64)), dtype=np.uint64)
        _powers[n] = base, up(MUL), up(np.uint64(pow(int(MUL), -1, 1 << 64)))
    return _powers[n]


def gram_hash(values: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of all grams, by doubling; gram is a power of two."""
    h, mul, size = values, MUL, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h, mul, size = h[:-size] * mul + h[size:], mul * mul, size * 2
        h = h ^ (h >> np.uint64(32))
        h = h * STEP
    return h ^ (h >> np.uint64(29))


def first_least(h: np.ndarray, window: int) -> np.ndarray:
    """Place of the leftmost smallest value in each window, by doubling."""
    v, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < window:
        d = min(size, window - size)
        take = v[d:] < v[:-d]
        v, at, size = np.where(take, v[d:], v[:-d]), np.where(take, at[d:], at[:-d]), size + d
    return at


def contexts(data: np.ndarray, ends: np.ndarray, least: int, gram: int):
    """Of a stretch of bytes with the end of its document for each byte: (anchor hash, context hash, first window, place of
    the anchor in it, number of windows) as arrays."""
    n = len(data)
    if n < least:
        return None
    base, up, down = powers(PIECE + 2 * least)
    values = base[data]
    h = gram_hash(values, gram)
    at = first_least(h, least - gram + 1)
    starts = np.flatnonzero(np.arange(len(at)) + least <= ends[: len(at)])
    if not len(starts):
        return None
    a = at[starts]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(new, len(starts)))
    lo, a = starts[new], a[new]
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)))
        c = (upto[lo + count - 1 + least] - upto[lo]) * down[lo]
        c = (c ^ (c >> np.uint64(31))) * STEP + (a - lo).astype(np.uint64) * MUL + count.astype(np.uint64)
    return h[a].view(np.int64), c.view(np.int64), lo, a - lo, count


def joined(lo: np.ndarray, hi: np.ndarray, owner: np.ndarray):
    """Merges stretches of one owner that touch; an owner's come together and in order."""
    if not len(lo):
        return lo, hi, owner
    apart = np.cumsum(np.concatenate(([0], owner[1:] != owner[:-1]))).astype(np.int64) << 44  # owners' stretches never touch
    new = np.flatnonzero(np.concatenate(([True], (lo + apart)[1:] > np.maximum.accumulate(hi + apart)[:-1])))
    return lo[new], np.maximum.reduceat(hi, new), owner[new]


def anchored(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """docs(doc, t, data) -> ANCHORS. q >= 0: the context from byte p, with its anchor's place and its number of windows in q;
    q < 0: bytes p to -q go, as this batch has an earlier copy."""

    def run(parts):
        for part in small(parts, 2000):
            doc, t = part.column(0).to_numpy(), part.column(1).to_numpy()
            column = part.column(2)
            if not len(doc):
                continue
            length = np.array([x.as_buffer().size if x.is_valid else 0 for x in column], np.int64)
            if not length.sum():
                continue
            data = np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), np.uint8)
            end = np.cumsum(length)
            start = end - length
            found = []
            for at in range(0, len(data), PIECE):  # windows that start in the piece
                stop = min(len(data), at + PIECE + least - 1)
                owner = np.searchsorted(end, np.arange(at, stop), side="right")
                got = contexts(data[at:stop], end[owner] - at, least, gram)
                if got:
                    found.append((*got[:2], got[2] + at, *got[3:]))
            if not found:
                continue
            anchor, context, lo, place, count = (np.concatenate(x) for x in zip(*found))
            owner = np.searchsorted(end, lo, side="right")
            ids, rank = np.unique(np.rec.fromarrays([doc, t]), return_inverse=True)
            where = (rank[owner].astype(np.int64) << 40) | (lo - start[owner])
            order = np.lexsort((where, context, anchor))
            same = (anchor[order][1:] == anchor[order][:-1]) & (context[order][1:] == context[order][:-1])
            first = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
            own = np.empty(len(order), np.int64)
            own[order] = where[order][first]
            keep = np.zeros(len(order), bool)
            keep[order[np.concatenate(([True], ~same))]] = True
            gone = ~keep & (own != where)
            glo, ghi, gown = joined(lo[gone], lo[gone] + count[gone] + least - 1, owner[gone])
            kept_owner = owner[keep]
            p = np.concatenate((lo[keep] - start[kept_owner], glo - start[gown]))
            q = np.concatenate(((place[keep] << 16) | count[keep], -(ghi - start[gown])))
            both = np.concatenate((kept_owner, gown))
            spread = (gown.astype(np.uint64) * MUL + glo.astype(np.uint64) * STEP).view(np.int64)
            out = [np.concatenate((anchor[keep], spread)), np.concatenate((context[keep], np.zeros(len(glo), np.int64))), doc[both], t[both], p, q]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, types)], ["anchor", "context", "doc", "t", "p", "q"])

    return docs.mapInArrow(run, ANCHORS)


def split_copies(anchors: DataFrame, least: int) -> DataFrame:
    """ANCHORS -> ANCHORS: what goes (q < 0), and the first of equal contexts where an anchor has several (q >= 0)."""

    def run(parts):
        held, told = None, False  # the last context seen, and whether it has been passed on
        for part in parts:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns])
            passed, rows = rows[:, rows[5] < 0], rows[:, rows[5] >= 0]
            out = [passed]
            if held is not None:
                rows = np.concatenate((held, rows), axis=1)
            if rows.shape[1]:
                anchor, context, doc, t, p, q = rows
                n = len(anchor)
                new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
                new = new_anchor | np.concatenate(([True], context[1:] != context[:-1]))
                first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                again = ~new & ((doc != doc[first]) | (t != t[first]) | (p != p[first]))
                gone = rows[:, again].copy()
                gone[5] = -(gone[4] + (gone[5] & 0xFFFF) + least - 1)
                run_no = np.cumsum(new_anchor) - 1
                several = np.bincount(run_no, new)[run_no] > 1
                pick = new & several
                if held is not None and told:
                    pick[0] = False
                out += [gone, rows[:, pick]]
                last = first[-1]
                told = bool(several[last]) or (told and held is not None and last == 0)
                held = rows[:, last : last + 1]
            out = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(out)], part.schema.names)

    sorted_ = anchors.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "t", "p")
    return sorted_.mapInArrow(run, ANCHORS)


def with_bytes(rows: DataFrame, least: int) -> DataFrame:
    """rows(doc, t, data, found: anchor, crowded, p, q) -> key, crowded, doc, t, p, data: contexts by anchor, or windows by hash."""

    def run(parts):
        for part in parts:
            key, crowded, doc, t, p, data = [], [], [], [], [], []
            for d, tt, whole, found in zip(*(part.column(i) for i in range(4))):
                view, d, tt = memoryview(whole.as_buffer()), d.as_py(), tt.as_py()
                for x in found.as_py():
                    n = x["q"] & 0xFFFF
                    pieces = [(x["anchor"], x["p"], n)]
                    if x["crowded"]:
                        pieces = [(int(np.uint64(xxhash.xxh64_intdigest(view[i : i + least])).view(np.int64)), i, 1) for i in range(x["p"], x["p"] + n)]
                    for k, at, m in pieces:
                        key.append(k)
                        crowded.append(x["crowded"])
                        doc.append(d)
                        t.append(tt)
                        p.append(at)
                        data.append(bytes(view[at : at + m + least - 1]))
                    if len(key) >= 20000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((key, crowded, doc, t, p, data), types)], names)
                        key, crowded, doc, t, p, data = [], [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((key, crowded, doc, t, p, data), types)], names)

    names = ["key", "crowded", "doc", "t", "p", "data"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return rows.mapInArrow(run, "key long, crowded boolean, doc long, t int, p long, data binary")


def smaller_before(positions: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller position, -1 without one: pointers jump until none is left to."""
    to = np.arange(-1, len(positions) - 1)
    open_ = np.arange(len(positions))
    while len(open_):
        open_ = open_[to[open_] >= 0]
        open_ = open_[positions[to[open_]] > positions[open_]]
        to[open_] = to[to[open_]]
    return to


def longest_previous(suffixes: np.ndarray, positions: np.ndarray, stretch: int = 1 << 16) -> np.ndarray:
    """Of suffixes in order (rows of bytes, cut at a length) with their positions: the longest previous factor of each, cut likewise.

    It is the longer of the prefixes shared with the suffixes at the previous and the next smaller position in suffix order.
    """
    n, width = suffixes.shape
    before = smaller_before(positions)
    after = n - 1 - smaller_before(positions[::-1])[::-1]
    out = np.zeros(n, np.int64)
    for to, some in ((before, before >= 0), (after, after < n)):
        at = np.flatnonzero(some)
        for lo in range(0, len(at), stretch):
            mine = at[lo : lo + stretch]
            differ = suffixes[mine] != suffixes[to[mine]]
            shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            out[mine] = np.maximum(out[mine], shared)
    return out


def previous_factors(rows: DataFrame, least: int) -> DataFrame:
    """rows of with_bytes -> doc, t, p, q: the stretches with a previous factor of full length, q negative as in ANCHORS."""

    def solve(part):
        """Complete keys, in order of key, doc, t, p."""
        key, doc, t, p = (part.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "t", "p"))
        data = part.column("data").combine_chunks()
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        buffer = np.frombuffer(data.buffers()[2], np.uint8)
        n = np.diff(offsets) - least + 1
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        run_no = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))).astype(">u4")
        sort_key = np.empty((len(row), 4 + least + 4), np.uint8)
        sort_key[:, :4] = run_no[row].view(np.uint8).reshape(-1, 4)
        sort_key[:, 4 : 4 + least] = np.lib.stride_tricks.sliding_window_view(buffer, least)[offsets[row] + inside]
        sort_key[:, 4 + least :] = np.arange(len(row)).astype(">u4").view(np.uint8).reshape(-1, 4)  # rows are in order of position
        order = np.argsort(sort_key.view(f"S{sort_key.shape[1]}").ravel(), kind="stable")
        gone = np.zeros(len(row), bool)
        gone[order] = longest_previous(sort_key[order, : 4 + least], order) >= 4 + least
        place = p[row] + inside
        at = np.flatnonzero(gone)
        lo, hi, own = joined(place[at], place[at] + least, row[at])
        return pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(t[own].astype(np.int32)), pa.array(lo), pa.array(-hi)], ["doc", "t", "p", "q"])

    def run(parts):
        wait, seen = None, None
        for part in parts:
            now = pa.Table.from_batches([part])
            many = now.column("crowded").to_numpy()
            if many.any():  # windows of one hash are equal: all but the first go
                w = now.filter(pa.array(many))
                ids = np.stack([w.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "t", "p")])
                if seen is not None:
                    ids = np.concatenate((seen, ids), axis=1)
                new = np.concatenate(([True], ids[0][1:] != ids[0][:-1]))
                first = np.maximum.accumulate(np.where(new, np.arange(ids.shape[1]), 0))
                gone = ids[:, ~new & (ids[1:] != ids[1:, first]).any(axis=0)]
                seen = ids[:, first[-1] : first[-1] + 1]
                yield pa.RecordBatch.from_arrays([pa.array(gone[1]), pa.array(gone[2].astype(np.int32)), pa.array(gone[3]), pa.array(-(gone[3] + least))], ["doc", "t", "p", "q"])
                now = now.filter(pa.array(~many))
            wait = now if wait is None else pa.concat_tables([wait, now])
            if len(wait) < 500:
                continue
            k = wait.column("key").to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield solve(wait.slice(0, cut))
                wait = wait.slice(cut)
        if wait is not None and len(wait):
            yield solve(wait)

    return rows.repartition("key").sortWithinPartitions("key", "doc", "t", "p").mapInArrow(run, "doc long, t int, p long, q long")


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs(doc, t, data) -> doc, t, p, q: bytes p to -q of a document go. Stretches may overlap."""
    found = written(split_copies(anchored(docs, least, gram), least))
    left = found.filter("q >= 0")
    # Written, so that Spark knows how few these are and need not shuffle the contexts by anchor to mark them.
    crowded = written(left.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(F.col("anchor").alias("_anchor")))
    left = left.join(crowded, F.col("anchor") == F.col("_anchor"), "left").withColumn("crowded", F.col("_anchor").isNotNull())
    lists = left.groupBy("doc", "t").agg(F.collect_set(F.struct("anchor", "crowded", "p", "q")).alias("found"))
    near = docs.join(lists, ["doc", "t"]).dropDuplicates(["doc", "t"]).select("doc", "t", "data", "found")
    rest = written(previous_factors(with_bytes(near, least), least))
    return found.filter("q < 0").select("doc", "t", "p", "q").unionByName(rest)


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, doc, t, data. Ids that aren't whole numbers are ranked, over ranges of them."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        ids = before(docs.select("doc_id").distinct().filter("doc_id IS NOT NULL").withColumn("one", F.lit(1)), [F.col("doc_id")], doc="one")
        ids = ids.select(F.col("doc_id").alias("_id"), F.col("doc").cast("long").alias("doc"))
        place = docs.select("doc_id", "text").join(written(ids), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        place = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc"))
    return place.select(
        "doc_id", F.coalesce(F.col("doc"), F.lit((1 << 63) - 1)).alias("doc"), F.hash(F.coalesce("text", F.lit(""))).alias("t"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
    )


def without_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, data (the bytes left), n_bytes, n_removed, n_spans."""
    rows = keyed(docs)
    gone = repeats(rows.select("doc", "t", "data"), least, gram, crowd)
    lists = gone.groupBy("doc", "t").agg(F.collect_list(F.struct("p", "q")).alias("gone")).withColumnsRenamed({"doc": "_doc", "t": "_t"})
    both = rows.join(lists, (F.col("doc") == F.col("_doc")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "data", "gone")

    def run(parts):
        for part in parts:
            left, removed, spans = [], [], []
            for data, gone in zip(part.column(1), part.column(2)):
                view = memoryview(data.as_buffer())
                if not gone.is_valid:
                    left.append(view)
                    removed.append(0)
                    spans.append(0)
                    continue
                pairs = np.array([(x["p"], -x["q"]) for x in gone.as_py()], np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                lo, hi, _ = joined(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), int))
                edges = np.concatenate(([0], np.stack((lo, hi), axis=1).ravel(), [len(view)])).tolist()
                left.append(b"".join(view[s:e] for s, e in zip(edges[::2], edges[1::2])))
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
            length = [len(d.as_buffer()) for d in part.column(1)]
            columns = [part.column(0), pa.array([bytes(x) for x in left], pa.binary()), *(pa.array(x, pa.int64()) for x in (length, removed, spans))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "data", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, data binary, n_bytes long, n_removed long, n_spans long")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], least: int = LEAST) -> dict[int, tuple[int, int, int, str]]:
    """The same by a table of all windows, for small inputs."""
    seen, out = set(), {}
    for doc in sorted(texts):
        data = texts[doc]
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - least + 1):
            if (w := data[i : i + least]) in seen:
                gone[i : i + least] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = len(data), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest()
    return out
