"""Line dedup, decontamination, quotations, mixing, language ID and vectors against brute force, with awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import decontam, langid, linededup, mixing, neardup, quotes

TEXTS = "doc_id long, text string"


def brute_lines(rows, window=3):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n") if text is not None else []
        full = [(i, s.strip(" ")) for i, s in enumerate(lines) if s.strip(" ")]
        gone, now = set(), []
        for at in range(len(full) - window + 1):
            run = tuple(s for _, s in full[at : at + window])
            if run in seen:
                gone.update(i for i, _ in full[at : at + window])
            seen.add(run)
            now.append(run)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone) if text is not None else None
    return out


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "a\nb"), (3, "a\nb"), (4, "x\n" * 50), (5, "\n\n \n")]
    for i in range(10, 120):
        lines = [f"line {rng.randrange(12)}" if rng.random() < 0.8 else "  " for _ in range(rng.randrange(1, 25))]
        rows.append((i, "\n".join(lines)))
    rows += [(130, "\n".join(f"u{i}" for i in range(400))), (131, "\n".join(f"u{i}" for i in range(390)) + "\nend")]
    docs = spark.createDataFrame(rows, TEXTS).repartition(3).withColumns({"gone": F.lit(1), "f": F.lit("x"), "_id": F.lit(2)})
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)


def brute_passages(rows, window=3, passage=50):
    """brute_lines, and runs of fewer lines with over so many words."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        full, gone = [(i, s.strip(" ")) for i, s in enumerate(lines) if s.strip(" ")], set()
        for at in range(len(full)):
            for k in range(1, window + 1):
                run = tuple(s for _, s in full[at : at + k])
                if len(run) == k and (k == window or sum(len(s.split()) for s in run) > passage):
                    if run in seen:
                        gone.update(i for i, _ in full[at : at + k])
                    seen.add(run)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_long_passages_of_one_or_two_lines(spark):
    rng = random.Random(4)
    long = [" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in (20, 26, 30, 31, 50, 51, 59, 137)]
    rows = [(0, ""), (1, long[6]), (2, long[6]), (3, "a\n" + long[4]), (4, long[4]), (5, long[2] + "\n\n" + long[3]), (6, "b\n" + long[2] + "\n" + long[3] + "\nc"), (7, long[5] + "\n" + long[5])]
    for i in range(10, 90):
        rows.append((i, "\n".join(rng.choice(long) if rng.random() < 0.3 else f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 6)))))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, TEXTS).repartition(3), passage=50).collect()}
    want = brute_passages(rows)
    assert got == want and want[2] == "" and want[4] == long[4] and want[6] == "b\nc" and want != brute_lines(rows)


def test_line_dedup_repeated_rows_and_empty(spark):
    text = "a\nb\nc\nd"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "z\n" + text)], TEXTS)
    got = sorted((r.doc_id or 9, r.text) for r in linededup.dedup_lines(docs).collect())
    assert got == [(1, text), (1, text), (2, "z"), (9, "")]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def brute_windows(docs, items):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for item, t in items:
        w = words(t)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= found
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["Aa", "b1", "ÄÖ", "ccc", "d", "Été", "x9", "zz"]) + rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.randrange(13, 40)))) for i in range(12)]
    items += [(20, items[0][1]), (21, items[1][1] + " tail"), (30, "Short item, three"), (31, "one"), (32, None), (33, "-- !"), (34, "aäb CdE"), (35, " ".join(items[2][1].split()[2:9])), (36, " ".join(items[5][1].split()[:12])), (37, "d d d d d")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "say ONE thing"), (4, "a short ITEM: three times short item three")]
    for i in range(10, 80):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items[:14])[1].split()
            at = rng.randrange(len(w))
            parts.append(", ".join(w[at : at + rng.randrange(8, 30)]).upper() if rng.random() < 0.3 else " ".join(w[at : at + rng.randrange(8, 30)]))
        docs.append((i, " ".join(parts)))
    docs += [(90, " ".join(items[3][1] for _ in range(300))), (91, "D, d " * 40), (92, "x " + " ".join(items[2][1].split()[2:9]) + " y")]
    d, b = spark.createDataFrame(docs, TEXTS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for some in (items, items[:14]):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(d, b.filter(F.col("item_id").isin([i for i, _ in some]))).collect()}
        assert got == brute_windows(docs, some)
    kept = {r.doc_id for r in decontam.drop_contaminated(d.withColumn("marks", F.lit(1)), b).collect()}
    assert kept == {k for k, v in brute_windows(docs, items).items() if not v[4]}
    assert decontam.contamination(d, b.limit(0)).filter("n_hit > 0").count() == 0 and decontam.contamination(d.limit(0), b).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow do you do?"),
        (1, 1, "assistant", "> Hello there.\nFine.\n> how do YOU do\nVery fine."),
        (1, 2, "user", ">> Hello there.\n> Fine.\nGood."),
        (1, 3, "user", None),
        (1, 4, "user", "> hello, there\n>\nBack to the first."),
        (2, 0, "user", "> Very fine.\nFrom elsewhere"),
        (2, 70, "user", "> nobody said this"),
        (None, 0, "user", "x"), (None, 1, "user", "> x\ny"),
    ]
    out = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    pick = {k: (r.reply_to, r.reply_conv, r.reply_kind, r.n_quoted, r.n_linked, r.text) for k, r in out.items()}
    assert pick == {
        (1, 0): (None, None, "first", 0, 0, "Hello there.\nHow do you do?"),
        (1, 1): (0, 1, "quoted", 2, 2, "Fine.\nVery fine."),
        (1, 2): (1, 1, "quoted", 2, 2, "Good."),
        (1, 3): (2, 1, "previous", 0, 0, ""),
        (1, 4): (0, 1, "quoted", 2, 1, "Back to the first."),
        (2, 0): (1, 1, "quoted elsewhere", 1, 1, "From elsewhere"),
        (2, 70): (0, 2, "previous", 1, 0, ""),
        (None, 0): (None, None, "first", 0, 0, "x"),
        (None, 1): (0, None, "quoted", 1, 1, "y"),
    }
    order = sorted((k for k in out if k[0] == 1), key=lambda k: ((out[k].order_key.reply_to is not None, out[k].order_key.reply_to), k[1]))
    assert all(out[k].reply_to is None or order.index((1, out[k].reply_to)) < order.index(k) for k in order)


def brute_quotes(rows):
    """Links, replies and reply order message by message, as the docstring has them: a passage, else its lines; the latest earlier
    message of the conversation, else the first message of all other conversations."""
    marks = lambda x: re.match(r"[ \t]*((>[ \t]*)*)", x).group(0)
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x[len(marks(x)) :].lower()).split())
    texts = {}
    for c, t, r, x in set(rows):
        texts.setdefault((c, t), []).append((r or "", x or ""))
    lines_of = {m: "\n".join(x for _, x in sorted(parts)).split("\n") for m, parts in texts.items()}

    def runs(m):
        found = [(k, [plain(x) for x in g]) for k, g in itertools.groupby(lines_of[m], lambda x: (marks(x).count(">"), plain(x) == ""))]
        return [(level, tuple(ps)) for (level, blank), ps in found if not blank]

    said = {}
    for m in lines_of:
        for level, ps in runs(m):
            for unit in {ps, *((p,) for p in ps)} if level == 0 else ():
                said.setdefault(unit, set()).add(m)

    def source(unit, c, t):
        here = [m for m in said.get(unit, ()) if m[0] == c and m[1] < t]
        return max(here) if here else min((m for m in said.get(unit, ()) if m[0] != c), default=None)

    out = {}
    for (c, t), lines in lines_of.items():
        found, n_linked = Counter(), 0
        for level, ps in runs((c, t)):
            if level:
                whole = source(ps, c, t)
                for m in [whole] * len(ps) if whole else filter(None, (source((p,), c, t) for p in ps)):
                    n_linked += 1
                    if level == 1:
                        found[m[0] == c, m] += 1
        before = max(((c2, t2) for c2, t2 in texts if c2 == c and t2 < t), default=(None, None))
        best = max(((k[0], n, k[1][1], k[1][0]) for k, n in found.items()), default=None)
        reply, conv = (best[2], best[3]) if best else (before[1], before[0])
        own = "\n".join(x for x in lines if ">" not in marks(x)).strip(" ")
        n_quoted = sum(">" in marks(x) for x in lines)
        out[c, t] = [reply, conv, n_quoted, n_linked, own, (reply if reply is not None and (not best or best[0]) else -1, t)]
    return {(c, t): (*x[:5], 1 + sum(y[5] < x[5] for (c2, _), y in out.items() if c2 == c)) for (c, t), x in out.items()}


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("a, b", [(1, 2), (2, 1)])
def test_quotes_of_later_words_are_linked_elsewhere(spark, a, b):
    """A quotes a line that A says only later and B says too: the link goes to B, whichever has the smaller id."""
    rows = [(a, 0, "user", "> the hot line"), (a, 1, "user", "The hot line."), (b, 5, "user", "the HOT line"), (b, 6, "user", "nothing")]
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_conv, r.reply_to, r.reply_kind) for r in quotes.reply_ordered(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[a, 0] == (1, b, 5, "quoted elsewhere")


def test_passages_go_before_lines(spark):
    rows = [
        (1, 0, "user", "yes\nI like it"), (1, 1, "user", "yes"), (1, 2, "user", "> yes\n> I like it\nThanks"), (1, 3, "user", "> yes\n> but why\n>> yes\n>> I like it"),
    ]
    got = {r.turn: (r.reply_to, r.n_linked) for r in quotes.reply_ordered(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (0, 2), 3: (1, 3)}


def test_rows_without_ids_stay_apart(spark):
    rows = [(None, None, "user", "one"), (None, None, "user", "two"), (None, None, "user", "two"), (7, None, "user", "> x"), (7, None, None, None), (7, 3, "user", "> three"), (None, 3, "user", "three")]
    got = sorted((r.conv_id or 0, r.turn or 0, r.text, r.n_linked) for r in quotes.reply_ordered(spark.createDataFrame(rows, TURNS)).collect())
    assert got == [(0, 0, "one", 0), (0, 0, "two", 0), (0, 3, "three", 0), (7, 0, "", 0), (7, 0, "", 0), (7, 3, "", 1)]


def test_quotes_against_brute_force(spark):
    rng = random.Random(21)
    phrases = [f"{a} {b}!" for a in ("Yes", "no", "Maybe ü", "see 1") for b in ("there", "so", "it is", "OK?")] + ["", "--", "Hot line."]
    rows = []
    for c in range(25):
        for t in sorted(rng.sample(range(200 if c == 3 else 12), 60 if c == 3 else rng.randrange(1, 9))):
            lines = []
            for _ in range(rng.randrange(0, 7)):
                deep = rng.choice([0, 0, 1, 1, 2, 3])
                lines.append(rng.choice(["> ", ">"]) * deep + (rng.choice(phrases).upper() if rng.random() < 0.3 else rng.choice(phrases)))
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(lines) if rng.random() < 0.95 else None))
    rows += rows[5:9]  # repeated rows
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumns({"key": F.lit(1), "conv": F.lit(2), "position": F.lit(3), "level": F.lit("x")})
    got = {(r.conv_id, r.turn): (r.reply_to, r.reply_conv, r.n_quoted, r.n_linked, r.text, r.position) for r in quotes.reply_ordered(docs).collect()}
    assert got == brute_quotes(rows) and sum(x[3] for x in got.values()) > 100
    assert quotes.reply_ordered(docs.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 80)), rng.choice(["a", "b", "b", "b", "b", "b", None, "tiny"] if i % 50 else ["tiny"])) for i in range(3000)]
    rows = [(i, t, s) if s != "tiny" or i % 20 == 0 else (i, t, "a") for i, t, s in rows] + [(5000, None, "empty"), (5001, "w w", "b"), (5001, "w w", "b"), (None, "w", "a"), *[(6000 + i // 2, "w " * 30, "b") for i in range(400)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total = sum(r["size"] for r in got)
    twins = {}
    for r in got:
        twins.setdefault((r.doc_id, r.source), set()).add(r.copies)
    assert all(len(x) == 1 for x in twins.values())  # equal rows are taken alike
    turns, last = mixing.in_order(mixing.queued(docs))
    rows_ = [(r.part, r.finish, r.sid, r.h, r.turn, r["size"]) for r in turns.collect()]
    assert last and [x[:5] for x in sorted(rows_)] == [(p, *x) for x, p in sorted((x[1:5], x[0]) for x in rows_)]  # parts are ranges
    assert sum(x[5] for x in rows_) == sum(r.taken for r in got)
    assert sum(r.taken for r in got) <= total
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert all(0 <= r.taken <= 3 * r["size"] and r.taken % max(r["size"], 1) == 0 for r in mine)
        assert mine[0].target <= 3 * mine[0].source_size + 1e-6 and abs(sum(r.taken for r in mine) - mine[0].target) <= 4 * 80
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-3
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.filter("doc_id = 5000")).collect()] == [0]


def test_targets_fill_up(spark):
    """Weights 5, 2, 1, 5: of 1,000, b and c fill up at three times their size, the rest goes to a and d by weight."""
    sizes = spark.createDataFrame([("a", 700), ("b", 10), ("c", 5), ("d", 285)], "source string, source_size long")
    got = {r.source: round(r.target, 6) for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 477.5, "b": 30.0, "c": 15.0, "d": 477.5}


def test_language_profiles(spark):
    rng = random.Random(6)
    parts = {"aa": ["bor", "kan", "tul"], "bb": ["éis", "oèu", "aié"], "cc": ["xyz", "qwo", "vvi"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(2, 40))), lang if i % 7 else None))
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "bor" * 50_000, None), (1004, "𝒳𐐷𐐷 ok", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({"score": F.lit(1), "share": F.lit(2), "count": F.lit(3), "at": F.lit(4)})
    model = langid.learn(docs)
    assert sorted(model) == ["aa", "bb", "cc"]
    got = {r.doc_id: r["_tm_lang"] for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang in rows if lang and i < 1000) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and got[1004].lang_pred != "und"
    assert {r.doc_id for r in langid.keep_known(docs, min_score=0.0).collect()} == {i for i, _, _ in rows} - {1000, 1001, 1002}
    assert {r.doc_id for r in langid.keep_known(docs).collect()} == {i for i, _, _ in rows} - {1000, 1001, 1002, 1004}  # 1004 is like no profile
    assert langid.predict(docs.limit(0), model).count() == 0
    assert {r["_tm_lang"].lang_pred for r in langid.predict(docs, langid.learn(docs.filter("lang IS NULL"))).collect()} == {"und"}


def plain_grams(text):
    """1- to 3-grams of a text by Counter: code, the most frequent first, of equal ones the smaller code."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = low.split(" ")
    flat = " ".join(["", *[w for w in words if w], ""])
    if not flat.strip():
        return Counter()
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return Counter(code(flat[i : i + n]) for n in (1, 2, 3) for i in range(len(flat) - n + 1) if flat[i : i + n] != " ")


def test_language_against_brute_force(spark, monkeypatch):
    """Profiles and out-of-place distances counted plainly; one language has few and short texts."""
    monkeypatch.setattr(langid, "STRETCH", 7)
    rng = random.Random(9)
    bits = {"aa": "abcdeé", "bb": "cdefgß", "few": "xyz"}
    rows = [(i, "".join(rng.choice(bits[g] + " .1") for _ in range(rng.randrange(0, 90))), g) for i in range(300) for g in [rng.choice(["aa", "bb"])]]
    rows += [(400, "xy zz", "few"), (401, "x", "few"), (402, "zyx yx", None), (403, None, "aa"), (404, "?! 7", "bb"), (405, "İA ΑΣ ΣΑΣ.Σ", None), (402, "zyx yx", None)]
    size = 30
    counts = {}
    for i, t, g in rows:
        if g and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(g, Counter()).update(plain_grams(t))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]
    profiles = {g: {code: k for k, code in enumerate(top(c))} for g, c in counts.items()}
    want = {}
    for i, t, _ in rows:
        own = top(plain_grams(t))
        far = {g: sum(abs(p[c] - k) if c in p else size for k, c in enumerate(own)) / size / len(own) for g, p in profiles.items()} if own else {}
        best = min(far, key=lambda g: (round(far[g], 9), g), default="und")
        want[i] = best, round(1 - far[best], 9) if far else 0.0
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.predict(docs, langid.learn(docs, size=size), size)
    assert {r.doc_id: (r["_tm_lang"].lang_pred, round(r["_tm_lang"].score, 9)) for r in got.collect()} == want and got.count() == len(rows)
    assert want[402][0] == "few"


@pytest.mark.parametrize("block", [8, 1024])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        rows.append((i, rng.normal(size=16).tolist()))
    base = rng.normal(size=16)
    for i in range(100, 160):
        rows.append((i, (base + rng.normal(size=16) * 0.08 * np.linalg.norm(base) / 4).tolist()))
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [float("inf")] + [1.0] * 15), (205, [None] + [1.0] * 15)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (302, [x * 1e30 for x in rows[5][1]]), (303, [1.0, 2.0]), (304, [2.0, 4.0]), (305, [1e-30, 2e-30])]
    got = {r.vec_id: r for r in neardup.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=block).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: float((a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()))
    links = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and cos(good[i], good[j]) >= 0.95} if i in good else set() for i, _ in rows}
    for i, _ in rows:
        todo, part = [i], {i}
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(part), i == min(part)), i
    assert neardup.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(400, 64))
    b = a + rng.normal(size=a.shape) * 0.5
    v = neardup.unit(np.concatenate((a, b)))
    bits, factor = neardup.codes(v)
    signs = np.unpackbits(bits, axis=1).astype(float) * 2 - 1
    estimate = (signs[:400] * (v[400:] @ neardup.rotation(64, 0))).sum(axis=1) / 8 / factor[:400]
    true = (v[:400] * v[400:]).sum(axis=1)
    assert abs((estimate - true).mean()) < 0.01
    slack = 6 * np.sqrt(1 - factor[:400] ** 2) / factor[:400] / np.sqrt(63)
    assert (np.abs(estimate - true) <= slack).all()


def test_codes_rule_out_most_pairs_and_no_link():
    """The rounded codes leave every link open and drop nearly all other pairs."""
    rng = np.random.default_rng(9)
    for d in (64, 384):
        base = rng.normal(size=(150, d))
        v = neardup.unit(np.concatenate((base, base + rng.normal(size=base.shape) * 0.3)))
        bits, factor = neardup.codes(v)
        turned, step = neardup.rounded(v @ neardup.rotation(d, 0))
        ok = neardup.open_pairs(bits, factor, turned, step, slice(0, 300), slice(0, 300), 0.95, 6.0)
        cos = v @ v.T
        assert ok[cos >= 0.95].all() and ok[cos < 0.3].mean() < 0.05


def test_cells_miss_few_pairs_at_any_length():
    """Recall of the cells at a cosine of exactly 0.95: the chance to share no cell, from the share of single cells that are shared."""
    rng = np.random.default_rng(10)
    for d in (16, 64, 384, 768):
        a = neardup.unit(rng.normal(size=(400, d)))
        b = rng.normal(size=a.shape)
        b = neardup.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
        n = neardup.tables_for(d)
        same = neardup.cells(a, n, 3) == neardup.cells(0.95 * a + np.sqrt(1 - 0.95**2) * b, n, 3)
        assert (1 - same.mean()) ** n < 4e-4 and same.any(axis=0).mean() > 0.99


def test_near_vectors_awkward_rows(spark):
    """Repeated and null ids, columns with the names used inside."""
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0]), (None, None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "cid", "n", "v", "root", "node")})
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in neardup.near(docs).collect())
    assert got == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
