"""Trajectories kept as state: each batch of pairs yields the steps and tool results that it adds, and nothing else.

The state of a conversation is where it stands: requests so far, the longest count of user messages and of results in any
of them, its steps, the last agent step, and the step that last made each call. What a batch costs therefore follows what
it brings. Events are never changed later; folded by steps_of they equal the batch reconstruction of the same pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirespan.operators.trajectory import KEY, NOT_BLANK
from wirespan.sources.wire import USAGE

EVENT = f"""source_path string, adapter string, session_id string, kind string, step_index int, seq int, at int, ts double, role string, message string, reasoning string,
 tool_calls array<struct<id:string,name:string,args_json:string>>, usage {USAGE}, source_call_id string, content string"""
#: State lives in RocksDB, which transformWithState needs; its snapshots go to the query's checkpoint.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_NOT_BLANK = re.compile(NOT_BLANK, re.ASCII)


class Conversation(StatefulProcessor):
    """Turns the decoded pairs of a conversation into EVENT rows, of kind step or observation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "seq int, users int, results int, steps int, agent_step int")
        self.calls = handle.getMapState("calls", "call_id string", "step int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seq, users, results, steps, agent_step = self.cursor.get() if self.cursor.exists() else (0, 0, 0, 0, None)
        head = dict(zip(KEY, key, strict=True))
        blank = dict.fromkeys(("ts", "role", "message", "reasoning", "tool_calls", "usage", "source_call_id", "content"))
        event = lambda kind, step, at, **more: Row(**(head | {"kind": kind, "step_index": step, "seq": seq, "at": at} | blank | more))
        for turn in sorted(rows, key=lambda r: r.pair_index):
            for at, text in enumerate(turn.users[users:], users):
                if text is not None and _NOT_BLANK.search(text):
                    steps += 1
                    yield event("step", steps, at, ts=turn.ts, role="user", message=text, reasoning="")
            for at, result in enumerate(turn.results[results:], results):
                call_id = result["call_id"]
                maker = self.calls.getValue((call_id,))[0] if call_id and self.calls.containsKey((call_id,)) else agent_step
                if maker is not None:
                    yield event("observation", maker, at, source_call_id=call_id, content=result["text"])
            if turn.produced:
                steps += 1
                agent_step = steps
                for call in turn.tool_calls:
                    if call["id"]:
                        self.calls.updateValue((call["id"],), (steps,))
                yield event("step", steps, 1 << 30, ts=turn.ts, role="agent", message=turn.message, reasoning=turn.reasoning, tool_calls=turn.tool_calls, usage=turn.usage)
            seq, users, results = seq + 1, max(users, len(turn.users)), max(results, len(turn.results))
        self.cursor.update((seq, users, results, steps, agent_step))

    def close(self) -> None:
        pass


def events(records: DataFrame) -> DataFrame:
    """EVENT rows of decoded pairs, a stream or a table; pairs of a conversation must come in the order of its log, within
    a batch by pair_index. Only what steps need is sent to the state."""
    of = lambda items, kind, pick, role=None: F.transform(F.filter(items, lambda i: (i["kind"] == kind) & ((i["role"] == role) if role else F.lit(True))), pick)
    rows = records.select(
        *KEY, "pair_index", "ts", "usage", ((F.size("out_items") > 0) | F.col("usage").isNotNull()).alias("produced"),
        of("items", "message", lambda i: i["text"], "user").alias("users"), of("items", "tool_result", lambda i: F.struct(i["call_id"].alias("call_id"), i["text"].alias("text"))).alias("results"),
        F.array_join(of("out_items", "message", lambda i: i["text"]), "").alias("message"), F.array_join(of("out_items", "reasoning", lambda i: i["text"]), "").alias("reasoning"),
        of("out_items", "tool_call", lambda i: F.struct(i["call_id"].alias("id"), i["name"].alias("name"), i["args_json"].alias("args_json"))).alias("tool_calls"),
    )
    return rows.groupBy(*KEY).transformWithState(Conversation(), EVENT, "append", "none")


def steps_of(found: DataFrame) -> DataFrame:
    """Steps as trajectory.steps gives them, of all events so far of some conversations."""
    step = F.first(F.when(F.col("kind") == "step", F.struct("seq", "ts", "role", "message", "reasoning", "tool_calls", "usage")), ignorenulls=True).alias("step")
    results = F.array_sort(F.collect_list(F.when(F.col("kind") == "observation", F.struct("seq", "at", "source_call_id", "content")))).alias("results")
    rows = found.groupBy(*KEY, "step_index").agg(step, results)
    observations = F.when(F.size("results") > 0, F.transform("results", lambda x: F.struct(x["source_call_id"].alias("source_call_id"), x["content"].alias("content"))))
    return rows.select(*KEY, "step.*", "step_index", observations.alias("observations"))
