"""Dimensions, triage score, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"sender_authenticity": 0.25, "message_intent": 0.25, "destination_risk": 0.35, "payload_risk": 0.25}


def triage_score(dims: dict[str, Column], selected_links: Column | None = None, strongest: Column | None = None) -> Column:
    """The larger of the peak and the weighted blend, 10 more where two dimensions reach 12; at least 35 with a link and a strong category."""
    peak = F.greatest(*dims.values())
    blend = F.bround(reduce(lambda a, b: a + b, (dims[k] * F.lit(w) for k, w in WEIGHTS.items()))).cast("int")
    active = reduce(lambda a, b: a + b, ((dims[k] >= 12).cast("int") for k in WEIGHTS))
    score = F.least(F.lit(100), F.greatest(peak, blend + F.when(active >= 2, 10).otherwise(0)))
    if selected_links is not None and strongest is not None:
        score = F.greatest(score, F.when((selected_links > 0) & (strongest >= 15), 35).otherwise(0))
    return score.cast("int")


def confidence(findings: Column, states: Column) -> Column:
    """From the number of independent sources with points, and of evidence that was looked at (states: array<string>)."""
    observed = F.filter(findings, lambda f: (f["status"] == "observed") & (f["points"] > 0))
    sources = F.size(F.array_distinct(F.transform(observed, lambda f: F.split(f["source"], ":", 2)[0])))
    looked = F.size(F.filter(states, lambda s: s.isin("evaluated", "checked", "complete", "partial")))
    return F.when((sources >= 3) & (looked >= 3), "high").when((sources >= 2) | (looked >= 2), "moderate").otherwise("limited")
