"""Episodes as a stream: each generation advances the state of its own episode."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import BUDGET, SEARCH_FAILURES
from ..sources.shipping import ship

OUTPUT = "episode string, termination string, searches long, executed long, repeated long, progressive long, no_progress long, unique_docs long, prediction string"
STATE = "turn long, searches long, executed long, repeated long, progressive long, no_progress long, keys array<string>, docs array<string>, done boolean"


def advance(turns: DataFrame, budget: int = BUDGET, idle: str | None = None) -> DataFrame:
    """One row for each episode of a stream of turns (episode, turn, kind, query_key, doc_keys, failure, content) when it
    ends, with the third protocol's rules as in ``operators.replay.replay``.

    The state holds counts and the keys that the episode has seen, which its budget bounds. Turns of an episode
    must come in their order, those of one batch in any; what is there again, or comes after the end, is passed
    over. With ``idle`` (``"1 hour"``) an episode that no turn has reached for so long ends as generation_budget and
    its state goes; else the state of ended episodes stays, so that late turns are known for what they are.
    """
    ship(turns.sparkSession)
    row = lambda *values: pd.DataFrame([values], columns=[c.split()[0] for c in OUTPUT.split(", ")])
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, searches, executed, repeated, progressive, no_progress, keys, docs, done = state.get if state.exists else (0, 0, 0, 0, 0, 0, [], [], False)
        keys, docs, end, said = list(keys), list(docs), None, None
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(key[0], "generation_budget", searches, executed, repeated, progressive, no_progress, len(docs), None)
            return
        rows = pd.concat(list(batches)).sort_values("turn")
        for r in rows.itertuples(index=False):
            if done or r.turn <= turn:
                continue
            turn = r.turn
            query = None if pd.isna(r.query_key) else r.query_key
            failure = None if pd.isna(r.failure) else r.failure
            if r.kind == "error":
                end = failure or "format_error"
            elif r.kind == "answer":
                end, said = "answer_after_search_budget" if searches >= budget else "answer", r.content
            elif searches >= budget:
                end = "search_limit"
            else:
                searches += 1
                if query is None:
                    end = "empty_search"
                elif query in keys:
                    repeated += 1
                    no_progress += 1
                elif failure:
                    end = failure
                    executed += failure in SEARCH_FAILURES[-2:]
                else:
                    keys.append(query)
                    executed += 1
                    new = [x for x in dict.fromkeys(r.doc_keys) if x not in docs]
                    docs += new
                    progressive += bool(new)
                    no_progress += not new
            done = end is not None
        state.update((turn, searches, executed, repeated, progressive, no_progress, keys, docs, done))
        if wait:
            state.setTimeoutDuration(wait)
        if end is not None:
            yield row(key[0], end, searches, executed, repeated, progressive, no_progress, len(docs), said)

    text = lambda c: F.col(c).cast("string").alias(c)
    t = turns.select("episode", F.col("turn").cast("long").alias("turn"), "kind", text("query_key"), F.transform("doc_keys", lambda x: x.cast("string")).alias("doc_keys"), text("failure"), text("content"))
    return t.groupBy("episode").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)
