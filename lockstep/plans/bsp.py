"""Supersteps over peers: user functions with messages, input rows, output rows, state and counters.

A peer is a number; its rows stream through one task, messages first and input after them, in the order of
the peer's numbers. Rows are dealt and sorted in chunks of some hundred, each one record, and what a peer queues
goes to a temporary file beyond some thousand items, so a task holds little of either. What a superstep leaves is one
written frame, from which the next one starts, so a run can be resumed at any superstep.
"""

from __future__ import annotations

import itertools
import pickle
import tempfile
from typing import Any, Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import written


#: Rows and bytes of a chunk, rows that are cut into chunks at a time, items that a peer's queue holds in memory.
CHUNK_ROWS, CHUNK_BYTES, PACKED, QUEUED = 256, 4096, 50_000, 10_000


class Queue:
    """Items in the order in which they came, the last in memory and those before in an unnamed temporary file."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.held, self.file, self.size = [], None, 0

    def append(self, item) -> None:
        self.held.append(item)
        self.size += 1
        if len(self.held) >= QUEUED:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file, pickle.HIGHEST_PROTOCOL)
            self.held = []

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.held


class Peer:
    """A peer's view of one superstep. Read ``messages`` before ``rows``."""

    def __init__(self, index: int, num_peers: int, superstep: int, state: dict, stream: Iterator[tuple[str, Any]]):
        self.index, self.num_peers, self.superstep, self.state = index, num_peers, superstep, state
        self._parts = itertools.groupby(stream, key=lambda x: x[0])
        self._held: tuple[str, Iterator] | None = None
        self.outgoing = Queue()
        self.output = Queue()
        self.counters: dict[str, int] = {}
        self.halted = False

    def _part(self, kind: str) -> Iterator:
        if self._held is None:
            self._held = next(self._parts, ("", iter(())))
        if self._held[0] != kind:
            return iter(())
        held, self._held = self._held[1], None
        return (x for _, x in held)

    def messages(self) -> Iterator:
        """Messages sent to this peer in the last superstep."""
        return self._part("a")

    def rows(self) -> Iterator:
        """The peer's input, from its beginning in each superstep."""
        for _ in self._part("a"):
            pass
        return self._part("b")

    def send(self, peer: int, message) -> None:
        self.outgoing.append((peer, message))

    def broadcast(self, message) -> None:
        for p in range(self.num_peers):
            self.send(p, message)

    def clear(self) -> None:
        """Drops what is queued for sending."""
        self.outgoing.clear()

    def write(self, *row) -> None:
        self.output.append(row)

    def increment(self, counter: str, by: int = 1) -> None:
        self.counters[counter] = self.counters.get(counter, 0) + by

    def halt(self) -> None:
        """Ends the run after this superstep."""
        self.halted = True


def run_supersteps(
    spark: SparkSession, steps: list[Callable[[Peer], None]], num_peers: int, message_type: str, output: str,
    rows: DataFrame | None = None, combine=None, persistent: bool = False, path: str | None = None, resume_at: int = 0,
    repeat: int = 1,
) -> tuple[DataFrame, dict[str, int]]:
    """(output rows, counters) of running ``steps`` one after the other, ``repeat`` times over.

    ``rows``: the input with a column peer; one without gets rows dealt by hash. ``combine``: an aggregate
    that reduces the messages from one sender to one receiver before they are shuffled. ``persistent``:
    messages that a step doesn't read come again in the next. ``path``: keeps each superstep's result there;
    ``resume_at`` k starts from the stored results of the supersteps before k.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField

    fields = StructType.fromDDL(output)
    made = StructType.fromDDL(f"kind string, peer int, source int, message {message_type}, state binary, name string, amount long").add(StructField("output", fields))
    work = steps * repeat
    if rows is not None and "peer" not in rows.columns:
        rows = rows.withColumn("peer", F.pmod(F.xxhash64(*rows.columns), F.lit(num_peers)).cast("int"))
    packed, arrow = None, None
    if rows is not None:
        values = [c for c in rows.columns if c != "peer"]
        rows = rows.select(F.col("peer").cast("int").alias("peer"), *values)
        arrow = to_arrow_schema(StructType(rows.schema.fields[1:]))
        packed = rows.mapInArrow(_chunks(arrow), "peer int, row binary").withColumn("kind", F.lit("b"))
    peers = spark.range(num_peers).select(F.col("id").cast("int").alias("peer"))
    outputs, counters = [], {}
    result = None
    for number, step in enumerate(work):
        place = f"{path.rstrip('/')}/superstep={number}" if path else None
        if number < resume_at:
            result = spark.read.schema(made).parquet(place)
        else:
            result = _superstep(step, number, num_peers, result, peers, packed, arrow, made, fields, combine, persistent, message_type, place)
        outputs.append(result.filter("kind = 'output'").select("output.*"))
        for r in result.filter("kind = 'count'").groupBy("name").agg(F.sum("amount").alias("n")).collect():
            counters[r["name"]] = counters.get(r["name"], 0) + r["n"]
        counters["supersteps"] = number + 1
        if result.filter("kind = 'halt'").limit(1).count():
            break
    out = outputs[0]
    for o in outputs[1:]:
        out = out.unionByName(o)
    return out, counters


def _superstep(step, number, num_peers, before, peers, packed, arrow, made, fields, combine, persistent, message_type, place):
    state = peers.withColumns({"kind": F.lit("0"), "state": F.lit(None).cast("binary")})
    if before is not None:
        kept = before.filter("kind = 'state'").select("peer", "state")
        state = peers.join(kept, "peer", "left").withColumn("kind", F.lit("0"))
    tagged = state.select("peer", "kind", "state", F.lit(None).cast(message_type).alias("message"))
    if before is not None:
        sent = before.filter("kind = 'message'")
        if combine is not None:
            sent = sent.groupBy("peer", "source").agg(combine(F.col("message")).alias("message"))
        tagged = tagged.unionByName(sent.select("peer", F.lit("a").alias("kind"), F.lit(None).cast("binary").alias("state"), "message"))
    if packed is not None:
        tagged = tagged.unionByName(packed, allowMissingColumns=True)
    else:
        tagged = tagged.withColumn("row", F.lit(None).cast("binary"))
    # A peer has a task of its own: by hash some tasks would get several, and some none.
    dealt = tagged.repartitionById(num_peers, "peer").sortWithinPartitions("peer", "kind")

    def run(batches):
        import pandas as pd

        def stream():
            for frame in batches:
                yield from frame[["peer", "kind", "state", "message", "row"]].itertuples(index=False, name=None)

        for index, own in itertools.groupby(stream(), key=lambda r: r[0]):
            first = next(own)
            held = pickle.loads(first[2]) if first[2] is not None else {}
            peer = Peer(int(index), num_peers, number, held, ((k, x) for _, k, _, m, r in own for x in ((m,) if k == "a" else _rows(r, arrow))))
            step(peer)
            out = iter(_results(peer, persistent, fields))
            while piece := list(itertools.islice(out, 10_000)):
                yield pd.DataFrame(piece, columns=made.names).astype(object)

    return written(dealt.mapInPandas(run, made), "superstep", place)


def _results(peer: Peer, persistent: bool, fields: StructType) -> Iterator[tuple]:
    """What a peer leaves, as rows of the superstep's frame."""
    for m in peer.messages() if persistent else ():
        yield "message", peer.index, peer.index, m, None, None, None, None
    yield "state", peer.index, None, None, pickle.dumps(peer.state), None, None, None
    for p, m in peer.outgoing:
        yield "message", p, peer.index, m, None, None, None, None
    for r in peer.output:
        yield "output", peer.index, None, None, None, None, None, dict(zip(fields.names, r, strict=True))
    for k, v in {**peer.counters, "messages_sent": len(peer.outgoing), "output_records": len(peer.output)}.items():
        yield "count", peer.index, None, None, None, k, v, None
    if peer.halted:
        yield "halt", peer.index, None, None, None, None, None, None


def _chunks(arrow):
    """Rows (peer, ...) as (peer, row): a peer's rows in chunks, each an Arrow batch of ``arrow`` in bytes."""
    import numpy as np
    import pyarrow as pa

    def cut(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        peers = table.column(0).to_numpy()
        order = np.argsort(peers, kind="stable")
        sorted_peers = peers[order]
        whole = pa.Table.from_arrays([c.cast(t.type) for c, t in zip(table.columns[1:], arrow, strict=True)], schema=arrow).take(pa.array(order)).combine_chunks().to_batches()
        size = int(max(1, min(CHUNK_ROWS, CHUNK_BYTES * table.num_rows // max(table.nbytes, 1))))
        ends = [*(np.flatnonzero(np.diff(sorted_peers)) + 1).tolist(), len(order)]
        start, to, data = 0, [], []
        for end in ends:
            for a in range(start, end, size):
                to.append(sorted_peers[a])
                data.append(whole[0].slice(a, min(size, end - a)).serialize().to_pybytes())
            start = end
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(data, pa.binary())], names=["peer", "row"])

    def run(batches):
        held, n, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= PACKED or size >= 8 << 20:
                yield cut(held)
                held, n, size = [], 0, 0
        if held:
            yield cut(held)

    return run


def _rows(chunk: bytes, arrow) -> list[dict]:
    import pyarrow as pa

    return pa.ipc.read_record_batch(pa.py_buffer(chunk), arrow).to_pylist()
