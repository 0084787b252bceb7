"""Names that begin a longer one, against all pairs."""

from tallymart.operators import audits


def test_untruncated_against_all_pairs(spark):
    """Names shorter than the common head, the empty one, null sources and names, equal names, letters outside ASCII."""
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "abcdx", "abd", "b", "bcde", "bcde", "é", "éab", "éabc", "éabcd", "zz", None]
    rows = [(s, t) for s in ("web", "forum", None) for t in texts if s != "forum" or t not in ("abcd", "abcde", "abcdx", "éabcd")]
    kept = lambda s, t: not any(s is not None and s == a and t is not None and b is not None and b.startswith(t) and len(b) > len(t) for a, b in rows)
    got = [tuple(r) for r in audits.untruncated(spark.createDataFrame(rows, "source string, name string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {r for r in rows if kept(*r)}
    assert audits.untruncated(spark.createDataFrame([("web", "")], "source string, name string")).count() == 1
