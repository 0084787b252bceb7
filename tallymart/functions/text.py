"""Names as columns: keys, tokens, similarity. All are Column expressions; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hebrew final letters and the letters they fold to.
FINALS, FOLDED = "ךםןףץ", "כמנפצ"


def text_key(name: Column) -> Column:
    """Lower case, no vowel marks or quotes, letters, digits, % and inner dots only, final letters folded, single spaces."""
    c = F.regexp_replace(F.lower(name), "[֑-ׇ\"'`׳״]", "")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}%.]+", " ")
    c = F.regexp_replace(c, r"(?<!\p{N})\.|\.(?!\p{N})", " ")
    return F.trim(F.regexp_replace(F.translate(c, FINALS, FOLDED), " +", " "))


def tokens(key: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of a key in order, stop words left out."""
    words = F.filter(F.split(key, " "), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(s) for s in stop]).cast("array<string>")) if stop else F.array_distinct(words)


def percentage(name: Column) -> Column:
    """The first percentage in a name, null without one."""
    return F.nullif(F.regexp_extract(name, r"([0-9]+(?:\.[0-9]+)?) ?%", 1), F.lit("")).cast("double")


def char_score(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def set_score(both: Column, either: Column, fewer: Column, chars: Column, pa: Column, pb: Column) -> Column:
    """Half Jaccard, a quarter containment, a quarter characters; 0.6 of it where percentages conflict."""
    score = 0.5 * both / either + 0.25 * both / fewer + 0.25 * chars
    return F.when(pa.isNotNull() & pb.isNotNull() & (pa != pb), 0.6 * score).otherwise(score)


def similarity(a: Column, b: Column) -> Column:
    """Half Jaccard, a quarter containment, a quarter characters; 0.6 of it where percentages conflict; 0 to 1.

    Where a side has no token, half the character score.
    """
    ka, kb = text_key(a), text_key(b)
    ta, tb = tokens(ka), tokens(kb)
    both, either = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    fewer = F.least(F.size(ta), F.size(tb))
    score = set_score(both, either, fewer, char_score(ka, kb), percentage(a), percentage(b))
    score = F.when(fewer == 0, 0.5 * char_score(ka, kb)).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return F.when(a.isNotNull() & b.isNotNull(), score)


def head_word(key: Column, noise: tuple[str, ...] = ()) -> Column:
    """The first word that is neither noise nor a number."""
    return F.get(F.filter(F.split(key, " "), lambda w: ~w.rlike(r"^[\d.%]*$") & ~w.isin(*noise) if noise else ~w.rlike(r"^[\d.%]*$")), F.lit(0))


def group_id(members: Column) -> Column:
    """Stable id of a set of members: part of the digest of the sorted members."""
    return F.substring(F.sha1(F.array_join(F.array_sort(members), ",")), 1, 12)


def covers(a: Column, b: Column) -> Column:
    """Each word of one array begins, or is begun by, a word of the other."""
    return F.forall(a, lambda x: F.exists(b, lambda y: x.startswith(y) | y.startswith(x)))
