"""Reply statuses as a stream: one small state per application."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as fv

OUTPUT = "application_id long, message_id string, sent_at timestamp, from_status string, to_status string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Apply the new messages of one application in date order; emit the real changes.

    Statuses only climb and end in a terminal one, so a late message cannot undo a change that was
    already reported; the state is the current status and nothing else.
    """
    (current,) = state.get if state.exists else (None,)
    rows = pd.concat(list(batches)).sort_values(["sent_at", "message_id"])
    changes = []
    for row in rows.itertuples(index=False):
        current = current or row.status
        target = fv.REPLY_STATUS.get(row.classification)
        if current in fv.TERMINAL_STATUSES or target is None or target == current:
            continue
        if fv.STATUS_RANK.get(target, -1) >= fv.STATUS_RANK.get(current, -1):
            changes.append((key[0], row.message_id, row.sent_at, current, target))
            current = target
    state.update((current,))
    yield pd.DataFrame(changes, columns=["application_id", "message_id", "sent_at", "from_status", "to_status"])


def status_changes(messages: DataFrame) -> DataFrame:
    """Changes as they happen. `messages` has application_id, status (at submission), message_id,
    sent_at and classification."""
    return messages.groupBy("application_id").applyInPandasWithState(
        _fold, OUTPUT, "status string", "append", GroupStateTimeout.NoTimeout
    )
