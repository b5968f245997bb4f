"""Conversation memory as keyed streaming state: the last entries of each session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.operators.session import KEPT

OUT = "session string, ord long, role string, text string, n_history int, last_query string"


def remembered(entries: DataFrame, kept: int = KEPT) -> DataFrame:
    """entries (session, ord, role, text) with what memory held before each; memory keeps the last `kept` entries."""

    def step(key, batches, state: GroupState):
        held = [list(e) for e in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for r in rows.itertuples():
            asked = [t for role, t in held if role == "user" and t and t.strip()]
            out.append((key[0], r.ord, r.role, r.text, len(held), asked[-1].strip() if asked else None))
            held = (held + [[r.role, r.text]])[-kept:]
        state.update(([(a, b) for a, b in held],))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return entries.groupBy("session").applyInPandasWithState(step, OUT, "held array<struct<role:string,text:string>>", "append", GroupStateTimeout.NoTimeout)
