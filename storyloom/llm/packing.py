"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens.  In every round (a window of ROUND tokens) a queue is served
its share; what rounding leaves over is its deficit and is carried to the next round.  After w
rounds a queue has been served ``floor(share * w + 1/2)`` tokens, at most all that it has, so the
state of the round-robin after any round is known without the rounds before it: a task lays out
its documents from the queue's totals and the document's place in its queue, and deficits carry
over windows and over partitions alike.  Rounds follow each other without gaps and are cut into
sequences; documents are cut where a round or a sequence ends, and only the last sequence of all
is not full.

The ids are encoded once and written to the shared folder; the layout reads them back.  Every
source has a queue of its own.  Up to QUEUES of them, each task works out the rounds from all
totals; beyond, queues and what each round serves are tables, joined to the documents.  Both ways
give the same layout.

Defined results: a null text is an empty one and holds the end id alone; a null source is a
source of its own; a null doc_id stays null.  Rows that repeat are packed one by one, and queues of
equal shares go in the order of their names.  A text of any length is cut into as many pieces as it
needs.  An empty table gives no pieces.  Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from storyloom.llm.bpe import encoder
from storyloom.llm.common import written
from storyloom.llm.ragged import PIECE_BYTES, column, give_back, with_ends

SEQUENCE = 1024
ROUND = 64 * SEQUENCE
#: Sources whose totals a task holds; more go by tables.
QUEUES = 1000
#: Rounds whose running totals are made together.
TOGETHER = 4096
#: Documents whose pieces are made at once.
LAID_OUT = 256
#: Bytes of text that are encoded at once: the words of a lot are encoded together, which takes a hundred times as much memory.
LOT_BYTES = 2 * PIECE_BYTES
END = 0


class Rounds:
    """Where the tokens of each queue go. totals and shares: by queue; shares are tokens a round, as fractions over one denominator."""

    def __init__(self, totals: list[int], shares: list[int], denominator: int):
        self.totals, self.shares, self.over = totals, shares, denominator
        self.known: dict[int, tuple[list[int], list[int]]] = {}

    def served(self, queue: int, rounds: int) -> int:
        return min(self.totals[queue], (2 * self.shares[queue] * rounds + self.over) // (2 * self.over))

    def first_round(self, queue: int, token: int) -> int:
        """The round that serves this token."""
        at = max(0, token * self.over // self.shares[queue] - 2)
        while self.served(queue, at + 1) <= token:
            at += 1
        return at

    def starts(self, at: int) -> list[int]:
        """Where in the output each queue starts in this round."""
        if at not in self.known:
            if len(self.known) > 64:
                self.known.clear()
            here = [self.served(q, at) for q in range(len(self.totals))]
            there = [self.served(q, at + 1) for q in range(len(self.totals))]
            place, out = sum(here), []
            for a, b in zip(here, there):
                out.append(place - a)
                place += b - a
            self.known[at] = out
        return self.known[at]

    def pieces(self, queue: int, start: int, length: int, sequence: int) -> list[tuple[int, int, int]]:
        """(start in the document, length, place in the output) of a document's pieces."""
        spans, token, end = [], start, start + length
        at = self.first_round(queue, start)
        while token < end:
            upto = max(token, min(end, self.served(queue, at + 1)))
            if upto > token:
                spans.append((token - start, upto - token, self.starts(at)[queue] + token))
            token, at = upto, at + 1
        return cut(spans, sequence)


def cut(spans: list[tuple[int, int, int]], sequence: int) -> list[tuple[int, int, int]]:
    """Spans of a document (start, length, place) cut where sequences end; neighbours within a sequence are one piece."""
    out = []
    for token, length, place in spans:
        end = token + length
        while token < end:
            n = min(end - token, sequence - place % sequence)
            if out and out[-1][2] + out[-1][1] == place and place % sequence:
                out[-1] = (out[-1][0], out[-1][1] + n, out[-1][2])
            else:
                out.append((token, n, place))
            token, place = token + n, place + n
    return out


def _encoded(docs: DataFrame, tokenizer: str, names: dict[str | None, int] | None, lot_bytes: int) -> DataFrame:
    """Documents with their ids, queue (a number by names, else the source's key), part (the task), and start within queue and part."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        give_back()
        enc = encoder(tokenizer)
        width = 2 if enc.vocabulary.size <= 1 << 16 else 4
        part, used = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            sources = batch.column(2).to_pylist()
            queues = [names[s] for s in sources] if names is not None else ["" if s is None else f"={s}" for s in sources]
            for row, end, ids, bounds in enc.batches(column(batch, "text"), lot_bytes):
                ids, bounds = with_ends(ids, bounds, END)
                raw, n = ids.astype(f"<u{width}").tobytes(), np.diff(bounds)
                starts = np.zeros(end - row, np.int64)
                for i, q in enumerate(queues[row:end]):
                    starts[i] = used[q]
                    used[q] += int(n[i])
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(queues[row:end], pa.int32() if names is not None else pa.string()), pa.array(np.full(end - row, part, np.int32)), pa.array(starts), pa.array(n), pa.array(np.full(end - row, width, np.int32)), blobs],
                    ["doc_id", "queue", "part", "start", "n", "width", "ids"],
                )

    return docs.select("doc_id", "text", "source").mapInArrow(run, f"doc_id {kind}, queue {'string' if names is None else 'int'}, part int, start long, n long, width int, ids binary")


def tempered(total: int, every: int, temper: float) -> int:
    """A queue's weight among all tokens: its part of them to this power, in millionths of millionths."""
    return max(1, round(1e12 * (total / max(1, every)) ** temper))


def _by_tables(placed: DataFrame, sums: DataFrame, targets: dict[str, float] | None, temper: float) -> DataFrame:
    """placed with spans: (start in the document, length, place in the output) by round, for any number of queues."""
    spark = placed.sparkSession
    queues = sums.groupBy("queue").agg(F.sum("sum").alias("total"))
    if targets is None and temper == 1:
        queues = queues.withColumn("weight", F.col("total"))
    elif targets is None:
        every = queues.agg(F.sum("total")).first()[0] or 0

        def weigh(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([tempered(t, every, temper) for t in batch.column(1).to_pylist()], pa.int64())], ["queue", "total", "weight"])

        queues = queues.select("queue", "total").mapInArrow(weigh, "queue string, total long, weight long")
    else:
        given = [("" if s is None else f"={s}", round(1e6 * t) or 1) for s, t in targets.items()]
        queues = queues.join(spark.createDataFrame(given, "queue string, weight long"), "queue", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
    queues = written(queues, "packing-queues")
    over = queues.agg(F.sum("weight")).first()[0] or 1

    def turns(batches, whole: bool):
        """The rounds that serve tokens start to end of a queue: (queue, start, round, first token, tokens)."""
        for batch in batches:
            out = [[] for _ in range(5)]
            for q, total, weight, start, end in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rounds, token = Rounds([total], [weight * ROUND], over), start
                while token < end:
                    at = rounds.first_round(0, token)
                    upto = rounds.served(0, at + 1) if whole else min(end, rounds.served(0, at + 1))
                    for values, v in zip(out, (q, start, at, token, upto - token)):
                        values.append(v)
                    token = upto
                    if len(out[0]) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(v, pa.int64()) for v in out[1:])], ["queue", "at", "round", "token", "n"])
                        out = [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(v, pa.int64()) for v in out[1:])], ["queue", "at", "round", "token", "n"])

    schema = "queue string, at long, round long, token long, n long"
    served = queues.repartition("queue").select("queue", "total", "weight", F.lit(0).cast("long").alias("start"), F.col("total").alias("end"))
    served = written(served.mapInArrow(lambda b: turns(b, True), schema), "packing-rounds")
    until = lambda by, order, value: F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rounds = served.groupBy("round").agg(F.sum("n").alias("n")).withColumn("bucket", F.floor(F.col("round") / TOGETHER))
    buckets = rounds.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", until([], "bucket", "n").alias("earlier"))
    rounds = rounds.withColumn("inside", until(["bucket"], "round", "n")).join(buckets, "bucket").select("round", (F.col("earlier") + F.col("inside")).alias("opens"))
    starts = served.withColumn("inside", until(["round"], "queue", "n")).join(rounds, "round")
    starts = starts.select("queue", "round", (F.col("opens") + F.col("inside") - F.col("token")).alias("shift"))
    # A document is known by its queue and its first token there.
    keys = placed.select("queue", (F.col("start") + F.col("before")).alias("first"), "n").join(queues, "queue")
    spans = keys.select("queue", "total", "weight", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end")).mapInArrow(lambda b: turns(b, False), schema)
    spans = spans.join(starts, ["queue", "round"]).groupBy("queue", "at").agg(F.sort_array(F.collect_list(F.struct((F.col("token") - F.col("at")).alias("start"), "n", (F.col("token") + F.col("shift")).alias("place")))).alias("spans"))
    return placed.withColumn("at", F.col("start") + F.col("before")).join(spans, ["queue", "at"])


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, with_ids: bool = False, temper: float = 1.0, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    targets: weights of sources in each window.  By default each source's part of all tokens to the power temper: at 1 all
    queues last to the end, below 1 small sources have more of each window than they have of the tokens, until they
    run dry.  A queue that runs dry leaves its time to the others.  lot_bytes changes no result, only memory and time.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sources = [r.source for r in docs.select("source").distinct().limit(QUEUES + 1).collect()]
    names = {s: i for i, s in enumerate(sorted(sources, key=lambda s: (s is not None, s)))} if len(sources) <= QUEUES else None
    encoded = written(_encoded(docs, tokenizer, names, lot_bytes), "packing-ids")
    # Written, so that Spark knows its size and broadcasts it rather than shuffle the ids, unless it is large.
    sums = written(encoded.groupBy("queue", "part").agg(F.sum("n").alias("sum")), "packing-sums")
    before = F.coalesce(F.sum("sum").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = encoded.join(sums.select("queue", "part", before.alias("before")), ["queue", "part"])
    columns = ["doc_id", "queue", "start", "n", "width", "ids", "before"]
    if names is None:
        placed = _by_tables(placed, sums, targets, temper).select(*columns, "spans")
        totals, shares, over = [], [], 1
    else:
        placed = placed.select(*columns)
        found = {r.queue: r["total"] for r in sums.groupBy("queue").agg(F.sum("sum").alias("total")).collect()}  # QUEUES rows at most
        totals = [found.get(q, 0) for q in range(len(names))]
        every = sum(totals)
        own = totals if temper == 1 else [tempered(t, every, temper) for t in totals]
        weights = own if targets is None else [round(1e6 * targets.get(s, 0)) or 1 for s in names]
        shares, over = [x * ROUND for x in weights], max(1, sum(weights))

    def laid_out(rounds: Rounds, rows: pa.RecordBatch) -> pa.RecordBatch:
        doc, queue, start, n, width, ids, base = (rows.column(i) for i in range(7))
        spans = rows.column(7).to_pylist() if names is None else None
        take, out, every = [], [[] for _ in range(6)], []
        for k, (q, s, b, size, w) in enumerate(zip(queue.to_pylist(), start.to_pylist(), base.to_pylist(), n.to_pylist(), width.to_pylist())):
            raw = np.frombuffer(ids[k].as_buffer(), f"<u{w}").astype("<u4")
            view = memoryview(raw).cast("B")
            every.append(raw)
            pieces = rounds.pieces(q, s + b, size, SEQUENCE) if spans is None else cut([(x["start"], x["n"], x["place"]) for x in spans[k]], SEQUENCE)
            for at, length, place in pieces:
                take.append(k)
                for values, v in zip(out, (at, length, zlib.crc32(view[4 * at : 4 * (at + length)]), size, place // SEQUENCE, place % SEQUENCE)):
                    values.append(v)
        columns = [doc.take(pa.array(take, pa.int64())), *(pa.array(v, pa.int64()) for v in out)]
        if with_ids:  # the pieces of a document follow each other, and so do their ids
            bounds = np.concatenate([[0], np.cumsum(out[1])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(every).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])

    def run(batches):
        rounds = Rounds(totals, shares, over)
        for batch in batches:
            for first in range(0, batch.num_rows, LAID_OUT):
                yield laid_out(rounds, batch.slice(first, LAID_OUT))

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return placed.mapInArrow(run, schema)
