"""Streaming forms: the case registry as keyed state, and document counts over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseweave.operators.privacy import CaseNames

OUTPUT = "case_id long, doc_id long, text string"
STATE = "phs array<string>, reals array<string>"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = CaseNames(dict(zip(*state.get, strict=True)) if state.exists else None)
    rows = pd.concat(list(frames)).sort_values(["ord", "doc_id"])
    texts = [names.rewrite(r.masked or "", {e["ph"]: e["value"] for e in r.entities}) for r in rows.itertuples()]
    state.update((list(names.known.keys()), list(names.known.values())))
    yield pd.DataFrame({"case_id": [key[0]] * len(rows), "doc_id": rows["doc_id"].to_numpy(), "text": texts})


def stream_registry(docs: DataFrame) -> DataFrame:
    """A stream of (case_id, doc_id, ord, masked, entities) to texts with the case's placeholders.

    A case's registry is its state and never expires; documents of one batch are read in order.
    """
    keyed = docs.select("case_id", "doc_id", "ord", "masked", "entities").groupBy("case_id")
    return keyed.applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a kind and window of event time; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
