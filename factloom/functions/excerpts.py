"""Query-centred excerpts of long texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def excerpt_one(text: str | None, terms, limit: int = 3200, most: int = 8, gap: int = 240, around: int = 420) -> str:
    """Windows around hits of the terms, the longest terms first, merged where they meet; a short text stays whole.

    A hit within ``gap`` of one that is taken is left out; the first ``most`` are taken.
    """
    body = text or ""
    if len(body) <= limit:
        return body
    low, hits = body.lower(), []
    for term in sorted({t.lower() for t in (terms if terms is not None else ()) if t}, key=lambda t: (-len(t), t)):
        at = low.find(term)
        while at >= 0 and len(hits) < most:
            if all(abs(at - h) > gap for h in hits):
                hits.append(at)
            at = low.find(term, at + len(term))
    hits.sort()
    spans: list[list[int]] = []
    for at in hits:
        a, b = max(0, at - around), min(len(body), at + around)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return "\n\n".join(body[a:b].strip() for a, b in spans)[:limit] if spans else body[:limit]


@F.pandas_udf(T.StringType())
def excerpts(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([excerpt_one(t, w) for t, w in zip(text, terms, strict=True)], dtype=object)
