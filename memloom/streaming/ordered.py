"""Token streams whose chunks come in any order: a stateful processor with a buffer by place and timers.

Chunks (stream_id, seq, chunk) wait until all before them have come, in whatever batches; a chunk that comes again is ignored.
What is contiguous is read as server-sent events. A stream that has said something and then pauses has its pending text
flushed as a partial row; its end flushes the rest. Where a chunk is lost, the stream waits `give_up_seconds` for it and then
goes on behind the gap; bytes of an event that the gap has cut are left out with it. An ended stream is remembered for
`remember_seconds`, so that late chunks don't begin it anew, and then forgotten: state doesn't grow with streams that ended.

Needs the RocksDB state store (STORE), as timers and keyed buffers do, and a trigger that goes on, such as processingTime: timers
fire with the next micro-batch. The batch twin is sse.accumulate().
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memloom.streaming.sse import parse_events

#: The session setting that timers and keyed buffers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUTPUT = "stream_id string, flush int, text string, final boolean"


class TokenStream(StatefulProcessor):
    def __init__(self, flush_seconds: float, give_up_seconds: float, remember_seconds: float, first: int = 0):
        self.flush_ms, self.give_up_ms, self.remember_ms, self.first = int(flush_seconds * 1000), int(give_up_seconds * 1000), int(remember_seconds * 1000), first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, rest string, pending string, flushes int, ended boolean, flush_at long, give_up_at long")
        self.waiting = handle.getMapState("waiting", "seq long", "chunk string")

    def _now(self, timers) -> int:
        return max(0, timers.getCurrentProcessingTimeInMs())

    def _read(self, state: list) -> bool:
        """Reads what is contiguous; whether the stream has said something."""
        said = False
        while not state[4] and self.waiting.containsKey((state[0],)):
            chunk = self.waiting.getValue((state[0],))[0]
            self.waiting.removeKey((state[0],))
            state[0] += 1
            deltas, ended, state[1] = parse_events(state[1] + chunk)
            state[2] += "".join(deltas)
            said, state[4] = said or bool(deltas), ended
        return said

    def _timed(self, state: list, place: int, at: int) -> None:
        """Moves one of the two timers; 0 is none. Both may have the same time, so a timer is dropped only if neither needs it."""
        was = state[place]
        state[place] = at
        if was and was not in (state[5], state[6]):
            self.handle.deleteTimer(was)
        if at:
            self.handle.registerTimer(at)

    def _flushed(self, key, state: list, final: bool) -> pd.DataFrame:
        out = pd.DataFrame({"stream_id": [key[0]], "flush": [state[3]], "text": [state[2]], "final": [final]})
        state[2], state[3] = "", state[3] + 1
        return out

    def _after(self, key, state: list, said: bool, now: int) -> Iterator[pd.DataFrame]:
        """What follows from reading: the end, or when to flush and when to give up a gap."""
        if state[4]:
            yield self._flushed(key, state, True)
            for seq in [k[0] for k in self.waiting.keys()]:
                self.waiting.removeKey((seq,))
            self._timed(state, 5, 0)
            self._timed(state, 6, now + self.remember_ms)
        else:
            if said:
                self._timed(state, 5, now + self.flush_ms)
            gap = any(True for _ in self.waiting.keys())
            if gap and (said or not state[6]):
                self._timed(state, 6, now + self.give_up_ms)
            elif not gap:
                self._timed(state, 6, 0)
        self.at.update(tuple(state))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.at.get()) if self.at.exists() else [self.first, "", "", 0, False, 0, 0]
        for frame in rows:
            for seq, chunk in zip(frame["seq"].tolist(), frame["chunk"].tolist(), strict=True):
                if seq >= state[0] and not state[4] and chunk is not None and not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (chunk,))
        if state[4]:
            return
        yield from self._after(key, state, self._read(state), self._now(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.at.exists():
            return
        state, at = list(self.at.get()), expiredTimerInfo.getExpiryTimeInMs()
        if at == state[5]:
            state[5] = 0
            if state[2]:
                yield self._flushed(key, state, False)
        if at == state[6]:
            state[6] = 0
            if state[4]:
                self.at.clear()
                return
            seqs = [k[0] for k in self.waiting.keys()]
            if seqs:
                state[0], state[1] = min(seqs), ""
                yield from self._after(key, state, self._read(state), self._now(timerValues))
                return
        self.at.update(tuple(state))

    def close(self) -> None:
        pass


def accumulate_ordered(chunks: DataFrame, flush_seconds: float = 8, give_up_seconds: float = 60, remember_seconds: float = 3600) -> DataFrame:
    """stream_id, flush, text, final of chunks (stream_id, seq from 0, chunk): a row for each pause and for the end of a stream, numbered by flush."""
    parts = chunks.selectExpr("cast(stream_id as string) as stream_id", "cast(seq as long) as seq", "chunk").where("stream_id IS NOT NULL AND seq IS NOT NULL")
    return parts.groupBy("stream_id").transformWithStateInPandas(TokenStream(flush_seconds, give_up_seconds, remember_seconds), OUTPUT, "append", "processingtime")


def text_of(spark: SparkSession, path: str, to: str, checkpoint: str, flush_seconds: float = 8, give_up_seconds: float = 60) -> None:
    """Reads what there is in a folder of chunks (Parquet), file by file, as a stream, and writes its rows to another; for catching up and for tests."""
    name, provider = STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        live = spark.readStream.schema("stream_id string, seq long, chunk string").option("maxFilesPerTrigger", 1).parquet(path)
        out = accumulate_ordered(live, flush_seconds, give_up_seconds).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint)
        query = out.outputMode("append").trigger(processingTime="0 seconds").start()
        try:
            there, read = spark.read.parquet(path).count(), {}
            while sum(read.values()) < there:  # such a query never idles, as timers may fire in any batch
                if not query.isActive:
                    raise query.exception() or RuntimeError("the stream ended early")
                read |= {p.batchId: p.numInputRows for p in query.recentProgress}
                time.sleep(0.2)
        finally:
            query.stop()
    finally:
        spark.conf.set(name, before)
