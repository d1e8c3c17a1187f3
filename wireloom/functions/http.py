"""HTTP start predicates over the ``payload`` column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom.functions.octets import latin1

# Request method tokens, response token, default ports and the headers whose values are never kept.
METHODS = ("GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "OPTIONS ", "PATCH ", "TRACE ", "CONNECT ")
RESPONSE = "HTTP/1."
PORTS = (80, 8080, 8000, 8888)
SENSITIVE = ("authorization", "cookie", "referer")

_TOKENS = "|".join([r"HTTP/1\.", *METHODS])


def starts_like_http(payload: Column | None = None) -> Column:
    text = latin1(F.col("payload") if payload is None else payload)
    return reduce(lambda a, b: a | b, [text.startswith(t) for t in (RESPONSE, *METHODS)])


def has_http_token(payload: Column | None = None) -> Column:
    return latin1(F.col("payload") if payload is None else payload).rlike(_TOKENS)


def likely_http(ports=PORTS) -> Column:
    """Port match, or a token anywhere in the payload."""
    return F.col("sport").isin(*ports) | F.col("dport").isin(*ports) | has_http_token()
