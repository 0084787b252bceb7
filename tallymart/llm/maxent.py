"""Scoring text with a hashed maximum-entropy model, class-factored.

The probability of a token is that of its class given the tokens before it, times that of the token in its class.
The ``singles`` most frequent tokens are classes of their own; all others, unknown ones too, fall into ``shared`` classes
by hash. The class is a softmax over the sum of the weights of three hashed features: the token before (bigram), the
one before that (skip) and both together. In a shared class a token has (count + 1) of the class's total, one unknown
token included, which is what a softmax with only a feature of its own per token comes to.

Training is one pass of distributed gradient updates: each task takes adaptive-gradient steps over the training
documents it holds, starting at the classes' frequencies, and gives back the weights of the features that it saw; these
are averaged by feature, weighted by how often each task saw it. Counts cover all training documents and stay in a
table. What is sent to the workers has a fixed size: the weights (``features`` x classes) and at most
``frequent`` of the most frequent tokens with their counts. Rarer tokens are joined with the table by hash, once per document and token.

Null and empty texts have only the end token. A row's equal twin gets the same result. Without training documents every
count is 0 and the model gives base scores in a single class. An empty table gives no rows. Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, table, written

FREQUENT, SINGLES, SHARED, FEATURES, STEP, BATCH, PIECE = 1 << 17, 48, 16, 1 << 14, 0.1, 8192, 1024
END = b"\n"  # no token holds it
KNOWN_WORDS = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def digest(token: bytes) -> int:
    h = xxhash.xxh64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def tokens(text) -> list[bytes]:
    """text: an Arrow binary scalar. Of bytes, lower() and split() know ASCII only."""
    out = bytes(text.as_buffer()).lower().split() if text.is_valid else []
    out.append(END)
    return out


class Codes(dict):
    """Token to a small number, in order of first sight; forgets all when it has grown large."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, token):
        code = self[token] = len(self.hashes)
        self.hashes.append(digest(token))
        return code

    def forget_if_large(self) -> bool:
        if len(self) <= KNOWN_WORDS:
            return False
        self.clear()
        self.hashes.clear()
        return True


def token_counts(texts: DataFrame) -> DataFrame:
    """texts(data) -> h, n of all tokens."""

    def run(parts):
        held: Counter = Counter()

        def out():
            h = np.fromiter(map(digest, held), np.int64, len(held))
            n = np.fromiter(held.values(), np.int64, len(held))
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["h", "n"])

        for part in small(parts):
            for text in part.column(0):
                held.update(tokens(text))
            if len(held) > KNOWN_WORDS:
                yield from out()
                held.clear()
        yield from out()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Reader:
    """Turns batches of documents into arrays, one entry per token; what depends on a token alone is kept by its code."""

    def __init__(self, model: Model):
        self.model, self.codes = model, Codes()
        self.clear()

    def clear(self):
        self.h = np.zeros(0, np.int64)
        self.kind, self.often, self.log_count = self.model.look_up(self.h)

    def __call__(self, column):
        """codes, sizes (tokens by document) and features (3, tokens) of a column of texts."""
        if self.codes.forget_if_large():
            self.clear()
        words: list[bytes] = []
        sizes = []
        for text in column:
            more = tokens(text)
            sizes.append(len(more))
            words += more
        code = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        new = np.array(self.codes.hashes[len(self.h) :], np.int64)
        if len(new):
            self.h = np.concatenate((self.h, new))
            more = self.model.look_up(new)
            self.kind, self.often, self.log_count = (np.concatenate(x) for x in zip((self.kind, self.often, self.log_count), more))
            self.parts = feature_parts(np.append(self.h, 0), self.model.features)
        sizes = np.array(sizes, np.int64)
        none = len(self.h)  # before a document stand zeros
        one, two = np.full(len(code), none, np.int32), np.full(len(code), none, np.int32)
        one[1:], two[2:] = code[:-1], code[:-2]
        start = np.cumsum(sizes) - sizes
        one[start], two[start] = none, none
        two[start[sizes > 1] + 1] = none
        return code, sizes, features_of(self.parts, one, two, self.model.features)


def feature_parts(h: np.ndarray, features: int):
    """By token: its bigram and skip features and its two shares of a pair feature."""
    x, quarter = h.view(np.uint64), np.uint64(features // 4)
    with np.errstate(over="ignore"):
        a = ((x * MIX) >> np.uint64(33)) % quarter
        b = quarter + (((x + np.uint64(1)) * MIX) >> np.uint64(33)) % quarter
        left, right = (x * MIX) >> np.uint64(31), ((x * np.uint64(31) + np.uint64(7)) * MIX) >> np.uint64(31)
    return a.astype(np.uint16), b.astype(np.uint16), left.astype(np.uint32), right.astype(np.uint32)


def features_of(parts, one: np.ndarray, two: np.ndarray, features: int) -> np.ndarray:
    """(3, tokens): bigram, skip and pair features. features is a power of two of at most 65,536."""
    a, b, left, right = parts
    pair = (left[one] ^ right[two]) & np.uint32(features // 2 - 1)
    return np.stack((a[one], b[two], (pair + np.uint32(features // 2)).astype(np.uint16)))


class Model:
    """What the workers need; of fixed size."""

    def __init__(self, frequent_h, frequent_n, tokens_total, vocabulary, shared_totals, singles=SINGLES, shared=SHARED, features=FEATURES):
        order = np.argsort(frequent_h)
        self.h, self.n = frequent_h[order], frequent_n[order]
        self.total, self.vocabulary, self.features = tokens_total, vocabulary, features
        self.shared = shared
        top = np.arange(min(singles, len(frequent_h)))  # the most frequent come first
        self.single = np.full(len(self.h), -1, np.int16)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.single[place[top]] = top
        self.singles = len(top)
        self.classes = self.singles + shared
        mass = np.concatenate((frequent_n[top] + 1.0, np.asarray(shared_totals, float) + 1.0))
        self.bias = np.log(mass / mass.sum()).astype(np.float32)
        self.log_mass = np.concatenate((np.log10(frequent_n[top] + 1.0), np.log10(np.asarray(shared_totals, float) + 1.0)))
        self.weights = None

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, whether it is frequent, and log10(count + 1) where it is."""
        if not len(self.h):
            return (h.view(np.uint64) % np.uint64(self.shared)).astype(np.int64), np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        often = self.h[at] == h
        kind = (h.view(np.uint64) % np.uint64(self.shared)).astype(np.int64) + self.singles
        single = np.where(often, self.single[at], -1)
        return np.where(single >= 0, single, kind), often, np.where(often, np.log10(self.n[at] + 1.0), 0.0)

    def class_logs(self, f: np.ndarray, weights: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Log weights of the classes, the largest 0, into out: a stretch of rows at a time, so that it stays in the cache."""
        more = np.empty((min(PIECE, f.shape[1]), self.classes), np.float32)
        for at in range(0, f.shape[1], PIECE):
            g = f[:, at : at + PIECE]
            z, m = out[at : at + g.shape[1]], more[: g.shape[1]]
            np.take(weights, g[0], axis=0, out=z, mode="clip")
            for row in g[1:]:
                np.take(weights, row, axis=0, out=m, mode="clip")
                z += m
            z += self.bias
            z -= z.max(axis=1, keepdims=True)
        return out[: f.shape[1]]


def sums_by_id(ids: np.ndarray, p: np.ndarray, room: np.ndarray, few: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, how often each occurs, and the sum of its rows of p."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    rows = np.take(p, order, axis=0, out=room[: len(p)], mode="clip")
    start = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    n = np.diff(np.append(start, len(ids)))
    most_first = np.argsort(-n, kind="stable")
    start, n = start[most_first], n[most_first]
    g = rows[start]
    many = int(np.searchsorted(-n, -few, side="left"))  # of more than few
    for i in range(many):
        rows[start[i] : start[i] + n[i]].sum(axis=0, out=g[i])
    for k in range(1, few):
        upto = int(np.searchsorted(-n, -k, side="left"))  # of more than k
        if upto > many:
            g[many:upto] += rows[start[many:upto] + k]
    return ids[start], n, g


def train(texts: DataFrame, model: Model) -> np.ndarray:
    """texts(data): weights by one pass of gradient updates in each task, averaged by feature."""
    count, classes = model.features, model.classes

    def run(parts):
        weights = np.zeros((count, classes), np.float32)
        squares = np.full(count, 1e-2 * classes, np.float32)
        seen = np.zeros(count, np.int64)
        read, buffer, room = Reader(model), np.empty((BATCH, classes), np.float32), np.empty((BATCH, classes), np.float32)
        for part in small(parts):
            code, _, f = read(part.column(0))
            kind = read.kind[code]
            for at in range(0, len(code), BATCH):
                g_f, k = f[:, at : at + BATCH], kind[at : at + BATCH]
                p = model.class_logs(g_f, weights, buffer)
                np.exp(p, out=p)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(k)), k] -= 1
                for row in g_f:
                    ids, n, g = sums_by_id(row, p, room)
                    squares[ids] += np.einsum("ij,ij->i", g, g)
                    g *= (STEP / np.sqrt(squares[ids] / classes))[:, None]
                    weights[ids] -= g
                    seen[ids] += n
        ids = np.flatnonzero(seen)
        for at in range(0, len(ids), 4096):
            some = ids[at : at + 4096]
            weighted = weights[some].astype(np.float64) * seen[some, None]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), *(pa.array(weighted[:, i].astype(np.float32)) for i in range(classes))], names)

    names = ["f", "n", *(f"w{i}" for i in range(classes))]
    rows = texts.mapInArrow(run, "f long, n long, " + ", ".join(f"w{i} float" for i in range(classes)))
    means = rows.groupBy("f").agg(F.sum("n").alias("n"), *[(F.sum(f"w{i}") / F.sum("n")).cast("float").alias(f"w{i}") for i in range(classes)])
    found = means.drop("n").toPandas()  # at most features x classes
    weights = np.zeros((count, classes), np.float32)
    if len(found):
        weights[found["f"].to_numpy()] = found.drop(columns="f").to_numpy(np.float32)
    return weights


def most_frequent(counts: DataFrame, most: int):
    """At most so many of the most frequent tokens, in order: all whose count lies in the eighths of powers of two that fit.

    A top-k would send that many rows of each partition to the driver; here it gets a few hundred sums, then the rows.
    """
    step = F.floor(F.log2("n") * 8)
    upto, least = 0, None
    for at, rows in sorted(counts.groupBy(step.alias("at")).count().collect(), reverse=True):
        upto += rows
        if upto > most:
            break
        least = at
    found = counts.filter(step >= least if least is not None else F.lit(False)).toPandas()
    return found.sort_values(["n", "h"], ascending=[False, True])


def fit(docs: DataFrame, frequent: int = FREQUENT, singles: int = SINGLES, shared: int = SHARED, features: int = FEATURES) -> tuple[Model, DataFrame]:
    """docs(doc_id, text) -> the model, and the counts (h, n) of all training tokens as a written table."""
    texts = docs.filter(~held_out(F.col("doc_id"))).select(F.col("text").cast("binary").alias("data"))
    counts = written(token_counts(texts))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, frequent)
    h, n = top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    # The unsigned hash modulo a power of two is that of its low bits.
    by_class = counts.groupBy(F.col("h").bitwiseAND(F.lit(shared - 1)).alias("k")).agg(F.sum(F.col("n") + 1).alias("mass")).collect()
    totals = np.zeros(shared)
    for k, mass in by_class:
        totals[k] = mass
    np.subtract.at(totals, h[:singles].view(np.uint64) % np.uint64(shared), n[:singles] + 1.0)
    model = Model(h, n, int(total[0]), int(total[1]), totals, singles, shared, features)
    if model.total:
        model.weights = train(texts, model)
    else:
        model.weights = np.zeros((features, model.classes), np.float32)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score, perplexity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    floor = np.log10(model.total + model.vocabulary + 1.0)

    def run(parts):
        read, buffer = Reader(model), np.empty((BATCH, model.classes), np.float32)
        pair = pa.struct([("h", pa.int64()), ("n", pa.int32())])
        for part in small(parts):
            if not part.num_rows:
                continue
            code, sizes, f = read(part.column(2))
            h, k, often, log_count = read.h[code], read.kind[code], read.often[code], read.log_count[code]
            class_log = np.empty(len(code))
            for at in range(0, len(code), BATCH):
                z = model.class_logs(f[:, at : at + BATCH], model.weights, buffer)
                own = z[np.arange(len(z)), k[at : at + BATCH]]
                np.exp(z, out=z)
                class_log[at : at + BATCH] = (own - np.log(z.sum(axis=1))) / np.log(10)
            start = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, start)  # noqa: E731  every document has a token
            counted = total(log_count)
            base, full = counted - sizes * floor, total(class_log - model.log_mass[k]) + counted
            owner = np.repeat(np.arange(len(sizes)), sizes)[~often]
            rare = h[~often]
            order = np.lexsort((rare, owner))
            owner, rare = owner[order], rare[order]
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1])))) if len(rare) else np.zeros(0, int)
            times = np.diff(np.append(new, len(rare)))
            offsets = np.searchsorted(owner[new], np.arange(len(sizes) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rare[new]), pa.array(times.astype(np.int32))], fields=list(pair)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes), pa.array(total(often.astype(np.int64))), pa.array(base), pa.array(full), lists],
                ["rid", "doc_id", "n_tokens", "known", "base", "full", "rare"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("data"))
    part = written(rows.mapInArrow(run, f"rid long, doc_id {kind}, n_tokens long, known long, base double, full double, rare array<struct<h:long,n:int>>"))
    rare = part.select("rid", F.inline("rare")).join(counts.withColumnRenamed("n", "c"), "h")
    more = rare.groupBy("rid").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    more_known, extra = F.coalesce("more_known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    return part.drop("rare").join(more, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + more_known).alias("n_known"),
        (F.col("base") + extra).alias("base_score"), (F.col("full") + extra).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(docs)
    out = score(docs, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
