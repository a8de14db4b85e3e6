"""Hooks for models from outside: embeddings and answers come from functions that a caller passes in, in batches.

Nothing here calls a model by itself; without a hook the deterministic forms elsewhere are used.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as X

EmbedBatch = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def with_embeddings(rows: DataFrame, text: str, embed: EmbedBatch | None = None, dimensions: int = 384, at_once: int = 64) -> DataFrame:
    """rows with ``embedding array<double>``: from ``embed``, ``at_once`` texts at a time on the executors, or the 31-hash vectors.

    Null texts get null. A vector of other than ``dimensions`` numbers is an error of the hook's and fails the job.
    """
    if embed is None:
        return rows.withColumn("embedding", F.when(F.col(text).isNotNull(), X.hash_embedding(F.col(text), dimensions)))
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            given = [k for k, t in enumerate(texts) if t is not None]
            made: list = [None] * len(texts)
            for begin in range(0, len(given), at_once):
                some = given[begin : begin + at_once]
                for k, vector in zip(some, embed([texts[k] for k in some]), strict=True):
                    if len(vector) != dimensions:
                        raise ValueError(f"the hook gave {len(vector)} numbers instead of {dimensions}")
                    made[k] = [float(v) for v in vector]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, "embedding"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("embedding", ArrayType(DoubleType())))


@dataclass
class Reply:
    """What a completion hook says in one round: text, and tools to call as (name, arguments)."""

    content: str = ""
    calls: list[tuple[str, dict]] = field(default_factory=list)


Messages = list[dict]
Complete = Callable[[Sequence[Messages]], Sequence[Reply]]
Tool = Callable[[dict], str]
OUTPUT = "id string, answer string, rounds int, exhausted boolean, error string, evidence array<struct<tool_name: string, input: string, output: string, timestamp: string>>"
_EVIDENCE = pa.struct([(n, pa.string()) for n in ("tool_name", "input", "output", "timestamp")])
_OUTPUT = pa.schema([("id", pa.string()), ("answer", pa.string()), ("rounds", pa.int32()), ("exhausted", pa.bool_()), ("error", pa.string()), ("evidence", pa.list_(_EVIDENCE))])


def converse(tasks: DataFrame, complete: Complete, tools: Mapping[str, Tool] | None = None, system: str = "", most: int = 10, at_once: int = 64) -> DataFrame:
    """STR9, STR13: (id, answer, rounds, exhausted, error, evidence) of every task (id, prompt) after a bounded loop of answers and tool calls.

    Tasks run where they are, ``at_once`` together: each round asks the hook once for all that are open,
    calls the tools that it names and gives it their outputs. A task ends with a reply without calls, with
    an error of the hook's, or ``exhausted`` after ``most`` rounds with its last reply. An unknown tool is
    told to the hook and is no evidence; a tool that fails is evidence with its error. Null prompts count
    as empty; an empty table gives an empty result.
    """
    known = dict(tools or {})

    def call(name: str, arguments: dict) -> tuple[str, bool]:
        if name not in known:
            return json.dumps({"error": f"unknown tool {name!r}; known: {', '.join(sorted(known))}"}), False
        try:
            return known[name](arguments), True
        except Exception as problem:
            return json.dumps({"error": f"the tool failed: {problem}"}), True

    def settle(tasks: list[tuple[str, str | None]]) -> list[dict]:
        state = [{"id": i, "answer": None, "rounds": 0, "exhausted": False, "error": None, "evidence": []} for i, _ in tasks]
        talks = [[{"role": "system", "content": system}, {"role": "user", "content": prompt or ""}] for _, prompt in tasks]
        open_ = list(range(len(tasks)))
        for _ in range(most):
            if not open_:
                break
            try:
                replies = list(complete([talks[k] for k in open_]))
            except Exception as problem:
                for k in open_:
                    state[k]["rounds"] += 1
                    state[k]["error"] = str(problem)
                return state
            left = []
            for k, reply in zip(open_, replies, strict=True):
                state[k]["rounds"] += 1
                state[k]["answer"] = reply.content
                talks[k].append({"role": "assistant", "content": reply.content})
                for name, arguments in reply.calls:
                    output, counts = call(name, arguments)
                    talks[k].append({"role": "tool", "name": name, "content": output})
                    if counts:
                        now = datetime.datetime.now(datetime.timezone.utc).isoformat()
                        state[k]["evidence"].append({"tool_name": name, "input": json.dumps(arguments), "output": output, "timestamp": now})
                if reply.calls:
                    left.append(k)
            open_ = left
        for k in open_:
            state[k]["exhausted"] = True
        return state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for begin in range(0, len(rows), at_once):
                yield pa.RecordBatch.from_pylist(settle(rows[begin : begin + at_once]), schema=_OUTPUT)

    return tasks.select(F.col("id").cast("string").alias("id"), "prompt").mapInArrow(run, OUTPUT)
