"""Best-fit packing of token sequences under several capacities.

A sequence has room for `tokens` tokens, `documents` pieces and `attention` (the sum of the squared piece
lengths). Pieces come in decreasing length; each goes to the open sequence that can take it under every
capacity and has the smallest weighted norm of what is left (`rule="norm"`), or the largest weighted dot
product of piece and room (`rule="dot"`); if none can, a new one is opened.

Pieces of one length are alike, so the packing is found for the counts of lengths: sequences that are filled
alike form one run, and a step puts as many equal pieces as fit into every sequence of a run at once. The
driver gets at most `tokens` counts, however many documents there are. A step either uses up a length or
uses a run once for it, a length leaves at most three new runs, and a sequence holds at most about
sqrt(2 x tokens) different lengths (1 + 2 + ... <= tokens), so there are at most 3 x tokens x
sqrt(2 x tokens) steps: 1.1 million for 4,096 tokens, some 50 MB, whatever the input; thousands in practice.

In Spark: one pass cuts and encodes the texts and numbers the pieces of a length inside its task; the tasks'
counts give each task its first number for each length; a piece's length and number then tell its sequence
and its place there. No task sees more than its own rows, and hot lengths are spread over all tasks.

Defined results: null text is empty, so it is the end id alone; repeated rows are packed once each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as TK
from .common import materialise

TOKENS = 4096
END_ID = 1
RULES = ("norm", "dot")


class Plan:
    """Where the pieces of each length go: rows (length, first number, pieces per sequence, first
    sequence, offset), ordered by length and number."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))] if len(rows) else rows
        self.keys = (self.rows[:, 0] << 48) + self.rows[:, 1] if len(rows) else rows

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.rows[np.searchsorted(self.keys, (length << 48) + number, side="right") - 1]
        k = number - row[:, 1]
        return row[:, 3] + k // row[:, 2], row[:, 4] + (k % row[:, 2]) * length


def best_fit(
    counts: dict[int, int],
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
    rule: str = "norm",
) -> Plan:
    """Pack `counts` (pieces of each length) into as few sequences as best fit needs."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    room = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=np.int64)
    scale = np.array(weights) / room
    left = np.zeros((1024, 3), np.int64)  # what a sequence of each run has left
    runs = np.zeros((1024, 2), np.int64)  # first sequence, sequences
    used, opened, rows = 0, 0, []

    def add(rest, first, n):
        nonlocal left, runs, used
        if n and rest[0] > 0:
            if used == len(left):
                alive = left[:used, 0] > 0
                kept = int(alive.sum())
                left[:kept], runs[:kept] = left[:used][alive], runs[:used][alive]
                left[kept:], used = 0, kept
                if used > len(left) // 2:
                    left = np.concatenate([left, np.zeros_like(left)])
                    runs = np.concatenate([runs, np.zeros_like(runs)])
            left[used], runs[used] = rest, (first, n)
            used += 1

    for length in sorted(counts, reverse=True):
        todo, number = int(counts[length]), 0
        piece = np.array([length, 1, length * length], dtype=np.int64)
        if (piece > room).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            fits = np.flatnonzero((left[:used] >= piece).all(axis=1))
            if len(fits):
                if rule == "norm":
                    best = fits[np.argmin((((left[fits] - piece) * scale) ** 2).sum(axis=1))]
                else:
                    best = fits[np.argmax((left[fits] * scale * piece * scale).sum(axis=1))]
                rest, (first, n) = left[best].copy(), runs[best].copy()
                left[best] = 0
            else:
                rest, first = room.copy(), opened
                n = -(-todo // int((room // piece).min()))
                opened += n
            each = int((rest // piece).min())
            full = min(int(n), todo // each)
            after = int(first) + full
            offset = int(room[0] - rest[0])
            if full:
                rows.append((length, number, each, int(first), offset))
                add(rest - each * piece, first, full)
                todo, number = todo - full * each, number + full * each
            over = int(n) - full
            if over and 0 < todo < each:
                rows.append((length, number, each, after, offset))
                add(rest - todo * piece, after, 1)
                todo, number, after, over = 0, number + todo, after + 1, over - 1
            add(rest, after, over)
    return Plan(np.array(rows, dtype=np.int64).reshape(-1, 5))


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, __task int, __number bigint"


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    tokens: int = TOKENS,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """A row per piece: id, `piece`, `start`, `length`, `ids_crc32` (and `ids`), and the number of the
    piece among those of its length and task."""
    extra = ", ids array<int>" if keep_ids else ""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(PIECES + extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        enc = TK.encoder(tokenizer, False)
        for batch in batches:
            texts = batch.column(1)
            for a, b in TK.text_runs(texts):
                out = {"row": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
                for i, ids in enumerate(enc.encode(texts[a:b].to_pylist()), a):
                    ids = np.append(ids, np.uint32(end_id))
                    for k, s in enumerate(range(0, len(ids), tokens)):
                        part = ids[s : s + tokens]
                        for name, v in zip(out, (i, k, s, len(part), TK.crc32(part)), strict=False):
                            out[name].append(v)
                        if keep_ids:
                            out["ids"].append(part.astype(np.int32))
                length = np.array(out["length"], dtype=np.int64)
                order = np.argsort(length, kind="stable")
                values, firsts, sizes = np.unique(length[order], return_index=True, return_counts=True)
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(length)) - np.repeat(firsts, sizes) + np.repeat(seen[values], sizes)
                seen[values] += sizes
                cols = [
                    batch.column(0).take(pa.array(out["row"], pa.int64())),
                    pa.array(out["piece"], pa.int32()),
                    pa.array(out["start"], pa.int64()),
                    pa.array(length),
                    pa.array(out["crc"], pa.int64()),
                    pa.array(np.full(len(length), task, np.int32)),
                    pa.array(number),
                ]
                if keep_ids:
                    cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(id_col, text).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    tokens: int = TOKENS,
    end_id: int = END_ID,
    keep_ids: bool = False,
    **capacities,
) -> DataFrame:
    """A row per piece with its `sequence_id` and `offset`; `capacities` are those of `best_fit`."""
    spark = docs.sparkSession
    cut = materialise(cut_pieces(docs, tokenizer, id_col, text, tokens, end_id, keep_ids), "pieces")
    per_task = cut.groupBy("__task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = per_task.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most `tokens` rows
    plan = best_fit(
        dict(zip(counts["length"].to_pylist(), counts["n"].to_pylist(), strict=True)), tokens, **capacities
    )
    shared = spark.sparkContext.broadcast(plan)
    # A row per task and length, so a length has as many rows here as there are tasks.
    ahead = Window.partitionBy("length").orderBy("__task")
    base = per_task.select("__task", "length", (F.sum("n").over(ahead) - F.col("n")).alias("base"))
    numbered = cut.join(base, ["__task", "length"]).withColumn("number", F.col("base") + F.col("__number"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        s, o = shared.value.place(length.to_numpy(), number.to_numpy())
        return pa.StructArray.from_arrays([pa.array(s), pa.array(o)], ["sequence_id", "offset"])

    out = numbered.withColumn("at", place("length", "number"))
    more = ["ids"] if keep_ids else []
    return out.select(
        id_col, "piece", "start", "length", "ids_crc32", *more, "at.sequence_id", "at.offset"
    )
