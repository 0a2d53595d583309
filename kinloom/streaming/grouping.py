"""Pages grouped by document as a keyed stateful stream.

Pages are handed on as they arrive; the state keeps one small entry per page number,
never the page texts. A group ends when all expected pages are there or no page came
for the timeout, but not while a page waits for a retry. Later pages of a finished
document are marked and ignored; the mark itself expires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.documents import CONTEXT_CHARS, MAX_RETRIES

TIMEOUT_SECONDS = 300
DONE_DAYS = 7  # how long a closed document stays closed, unless the caller says otherwise
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# kind: page (a new page), processed or failed (the outcome of an earlier one).
MESSAGES = "document_id string, message_id string, kind string, page_number int, total_pages int, text string, at timestamp"
EVENTS = (
    "document_id string, event string, page_number int, arrival_index long, duplicate boolean,"
    " retries int, unique_pages long, messages long, reason string, context string"
)
FIELDS = [f.split()[0] for f in EVENTS.split(", ")]
WAITING, RETRYING, PROCESSED, FAILED = "waiting", "retrying", "processed", "failed"


def _frame(events: list[dict]) -> pd.DataFrame:
    """Event rows as plain objects, None where a field is not set."""
    return pd.DataFrame([[e.get(f) for f in FIELDS] for e in events], columns=FIELDS, dtype=object)


class DocumentGroups(StatefulProcessor):
    """Emits one event row per message and one when a group closes."""

    def __init__(self, timeout_seconds: int = TIMEOUT_SECONDS, max_retries: int = MAX_RETRIES, max_chars: int = CONTEXT_CHARS, done_days: int = DONE_DAYS):
        self.done_ms = done_days * 24 * 3600 * 1000
        self.timeout_ms = timeout_seconds * 1000
        self.max_retries = max_retries
        self.max_chars = max_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "messages long, expected int, distinct_pages long, pending long")
        self.pages = handle.getMapState("pages", "page int", "state string, retries int")
        self.tail = handle.getValueState("tail", "text string")
        self.done = handle.getValueState("done", "flag boolean", self.done_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One micro-batch of one document; its size is capped by the source's trigger limit.
        batch = pd.concat(list(rows)).sort_values(["at", "message_id"], kind="stable")
        events = [self._take(key[0], row) for row in batch.to_dict("records")]
        if self.group.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            events += self._close_if_full(key[0])
        yield _frame(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = []
        if self.group.exists():
            if self.group.get()[3]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            else:
                events.append(self._close(key[0], "timeout_reached"))
        yield _frame(events)

    def close(self) -> None:
        pass

    # -- one message --------------------------------------------------------

    def _event(self, document: str, event: str, **fields) -> dict:
        return {"document_id": document, "event": event, **fields}

    def _take(self, document: str, row: dict) -> dict:
        page = None if pd.isna(row["page_number"]) else int(row["page_number"])
        if self.done.exists():
            return self._event(document, "late", page_number=page)
        if row["kind"] == "page":
            return self._add(document, page, row)
        return self._outcome(document, page, row["kind"])

    def _add(self, document: str, page: int | None, row: dict) -> dict:
        messages, expected, distinct, pending = self.group.get() if self.group.exists() else (0, None, 0, 0)
        duplicate = page is not None and self.pages.containsKey((page,))
        if page is not None and not duplicate:
            self.pages.updateValue((page,), (WAITING, 0))
            distinct += 1
        if not expected and not pd.isna(row["total_pages"]) and row["total_pages"]:
            expected = int(row["total_pages"])
        self.group.update((messages + 1, expected, distinct, pending))
        before = self.tail.get()[0] if self.tail.exists() else ""
        text = (row["text"] or "").strip()
        if text:
            self.tail.update(((f"{before}\n{text}" if before else text)[-self.max_chars :],))
        return self._event(
            document, "page", page_number=page, arrival_index=messages + 1, duplicate=duplicate, context=before
        )

    def _outcome(self, document: str, page: int | None, kind: str) -> dict:
        if page is None or not self.pages.containsKey((page,)):
            return self._event(document, "unknown_page", page_number=page)
        state, retries = self.pages.getValue((page,))
        messages, expected, distinct, pending = self.group.get()
        if kind == "failed":
            retries += 1
            after = RETRYING if retries < self.max_retries else FAILED
        else:
            after = PROCESSED
        pending += (after == RETRYING) - (state == RETRYING)
        self.pages.updateValue((page,), (after, retries))
        self.group.update((messages, expected, distinct, pending))
        return self._event(document, after, page_number=page, retries=retries)

    def _close_if_full(self, document: str) -> list[dict]:
        _, expected, distinct, pending = self.group.get()
        if expected and distinct >= expected and not pending:
            return [self._close(document, "all_pages_received")]
        return []

    def _close(self, document: str, reason: str) -> dict:
        messages, _, distinct, _ = self.group.get()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.group.clear()
        self.pages.clear()
        self.tail.clear()
        self.done.update((True,))
        return self._event(document, "closed", unique_pages=distinct, messages=messages, reason=reason)


def group_documents(
    stream: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """Event rows of a page stream shaped like MESSAGES."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=DocumentGroups(timeout_seconds, max_retries),
        outputStructType=EVENTS,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def pages_of_messages(parsed: DataFrame) -> DataFrame:
    """MESSAGES rows of parsed page messages."""
    return parsed.select(
        F.col("m.metadata.document_id").alias("document_id"),
        F.col("m.message_id").alias("message_id"),
        F.lit("page").alias("kind"),
        F.col("m.metadata.page_number").alias("page_number"),
        F.col("m.metadata.total_pages").alias("total_pages"),
        F.col("m.ocr_result.markdown_text").alias("text"),
        F.coalesce(F.col("m.timestamp").try_cast("timestamp"), F.current_timestamp()).alias("at"),
    )


def session_documents(stream: DataFrame, gap_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Idle-separated groups of a stream; the watermark bounds the open sessions."""
    window = F.session_window("at", f"{gap_seconds} seconds")
    return (
        stream.withWatermark("at", lateness)
        .groupBy("document_id", window.alias("session"))
        .agg(F.count("*").alias("messages"), F.min("at").alias("first_seen"), F.max("at").alias("last_updated"))
    )


def debounce(stream: DataFrame, key: str, quiet_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Last event per quiet-separated burst of a key."""
    return (
        stream.withWatermark("at", lateness)
        .groupBy(key, F.session_window("at", f"{quiet_seconds} seconds").alias("burst"))
        .agg(F.max_by("message_id", "at").alias("message_id"), F.max("at").alias("at"))
        .drop("burst")
    )
