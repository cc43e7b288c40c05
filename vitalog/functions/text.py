"""Token and substring matching on text columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of letters, digits and underscores.
_TOKEN_CHAR = r"[\p{L}\p{N}_]"


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case tokens of a query, in order of appearance."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def _has_token(lowered: Column, token: str) -> Column:
    # The plain substring test is cheap and decides most rows; the pattern settles word borders.
    return lowered.contains(token) & lowered.rlike(rf"(?<!{_TOKEN_CHAR}){token}(?!{_TOKEN_CHAR})")


# A long text is lowered once per row: as the only element of an array it is bound to a variable
# that all the tests share.


def text_matches(text: Column, query: str) -> Column:
    """True when the text shares at least one token with the query, whatever the case."""
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(False)
    found = F.exists(F.array(F.lower(text)),
                     lambda t: reduce(lambda a, b: a | b, (_has_token(t, k) for k in tokens)))
    return F.coalesce(found, F.lit(False))


def token_scores(text: Column, query: str) -> Column:
    """One-element array with the number of distinct query tokens in the text."""
    return F.transform(F.array(F.lower(text)), lambda t: reduce(
        lambda a, b: a + b,
        (F.coalesce(_has_token(t, k).cast("int"), F.lit(0)) for k in query_tokens(query)),
        F.lit(0)))


def matched_tokens(text: Column, query: str) -> Column:
    """How many distinct query tokens the text holds (0 for a missing text)."""
    return F.element_at(token_scores(text, query), 1)


def attribute_contains(attrs: Column, query: str) -> Column:
    """True when any non-empty attribute value holds the query, whatever the case."""
    needle = query.lower()
    return F.coalesce(
        F.exists(F.map_values(attrs), lambda v: (v != "") & F.lower(v).contains(needle)),
        F.lit(False),
    )
