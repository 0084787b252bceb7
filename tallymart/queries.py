"""All queries of the retail operators, with their SQL."""

from .operators import audits, catalogue, classes, graph, history, joins, matcher, names, pricing, quality, records, retrieval, rules, search, setjoin, signatures, swaps, votes  # noqa: F401
from .plans import baskets, lines  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from .sources import feeds, files  # noqa: F401
from .streaming import alerts  # noqa: F401
