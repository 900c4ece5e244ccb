"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target proportions.

Every source is a queue of its documents' tokens. In each round a source earns its share of a window; it sends once
it has earned a quantum (or all it has left) and carries the rest as its deficit. What is sent, one source after the
other, is cut every ``window`` tokens.

To run in parallel, each queue is cut into quanta, and quantum k of a source falls due at (k + u) * quantum / share,
u being a fixed fraction of the source's own. Due times are cut into chunks; a chunk holds each source's
quanta due in it, about ``CHUNK_TOKENS`` tokens together at any size of the corpus, and starts with the deficit that the
source has run up against its share of all earlier chunks. Chunks are laid end to end: the window that one chunk
leaves open is filled by the next, so only the very last window can be short.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import running_before
from ..session import fits_broadcast, settle
from .common import bounded_batches, frugal, slices

QUANTUM = 128
CHUNK_TOKENS = 1 << 20
SLICE_BYTES = 4 << 20
#: Characters on which both tokenizer libraries split alike by any Unicode version.
PLAIN = 0x250


class Encoder:
    """Ids of texts as the ``tokenizers`` library gives them for its file, without added special tokens.

    With ``ranks``, the rank file of the same vocabulary, texts of characters below U+0250 go through the faster
    library, which gives the same ids; others, and texts with a special token's string, go through ``tokenizers``.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.size = self.slow.get_vocab_size(with_added_tokens=True)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def plain(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or ord(max(text)) < PLAIN) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [np.asarray(self.fast.encode_ordinary(t), np.uint32) if self.plain(t) else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(rest, self.slow.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.asarray(found.ids, np.uint32)
        return out


def _tokenise(path: str, ranks: str | None, pattern: str | None, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks, pattern)
        task, sent = TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in slices(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
                coded = pc.dictionary_encode(pc.fill_null(part.column("text"), ""))
                blobs = [np.append(ids, end_id).astype(kind) for ids in encoder.encode(coded.dictionary.to_pylist())]
                which = coded.indices.to_pylist()
                sizes, before = [len(blobs[k]) for k in which], []
                for source, n in zip(part.column("source").to_pylist(), sizes):
                    before.append(sent.get(source, 0))
                    sent[source] = before[-1] + n
                raw = [b.tobytes() for b in blobs]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("source"), pa.array([task] * len(which), pa.int32()), pa.array(before, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array([raw[k] for k in which], pa.binary()),
                ], ["doc_id", "source", "task", "before", "n", "ids"])

    return run


def _cuts(width: int, quantum: int, with_ids: bool) -> Column:
    """One struct per chunk that a document's tokens fall into: chunk, place in the queue, first token, tokens."""
    a, z = F.col("base") + F.col("before"), F.col("base") + F.col("before") + F.col("n")

    def edge(c: Column) -> Column:
        return F.ceil(c * F.col("rate") - F.col("u")) * quantum

    def chunk(token: Column) -> Column:
        return F.floor((F.floor(token / F.lit(quantum)) + F.col("u")) / F.col("rate"))

    def piece(c: Column) -> Column:
        lo, hi = F.greatest(a, edge(c)), F.least(z, edge(c + 1))
        parts = [c.alias("chunk"), lo.alias("place"), (lo - a).alias("start"), (hi - lo).alias("length")]
        if with_ids:
            parts.append(F.substring("ids", ((lo - a) * width + 1).cast("int"), ((hi - lo) * width).cast("int")).alias("ids"))
        return F.struct(*parts)

    reach = F.sequence(F.greatest(chunk(a) - 1, F.lit(0)), chunk(z - 1) + 1)
    # the outer form, which never meets an empty array here: for the inner one Spark computes the array twice
    return F.inline_outer(F.transform(F.filter(reach, lambda c: F.greatest(a, edge(c)) < F.least(z, edge(c + 1))), piece))


def _serve(window: int, quantum: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("source", "place", "start", "length", "ids", "rate", "u")}
        chunk, base = table.column("chunk")[0].as_py(), table.column("offset")[0].as_py()
        ids = [np.frombuffer(b, kind).astype("<u4") for b in columns["ids"]]
        queues: dict[str, list[int]] = {}
        for row in sorted(range(len(ids)), key=columns["place"].__getitem__):
            queues.setdefault(columns["source"][row], []).append(row)
        names = sorted(queues)
        earn, carry, left, head, used, served = [], [], [], [], [], []
        for name in names:
            rate, u = columns["rate"][queues[name][0]], columns["u"][queues[name][0]]
            earn.append(rate * quantum * window / CHUNK_TOKENS)
            carry.append(chunk * rate * quantum - math.ceil(chunk * rate - u) * quantum)
            left.append(sum(columns["length"][r] for r in queues[name]))
            head.append(0)
            used.append(0)
            served.append(0)

        def due(k: int, at_least: int) -> tuple[int, int]:
            owed = min(quantum, left[k]) - (carry[k] - served[k])
            return max(at_least, math.ceil(owed / earn[k]) - 1), k

        turns = [due(k, 0) for k in range(len(names))]
        heapq.heapify(turns)
        out, at = [], base
        while turns:
            turn, k = heapq.heappop(turns)
            deficit = carry[k] + (turn + 1) * earn[k] - served[k]
            send = min(left[k], max(min(quantum, left[k]), math.floor(deficit)))
            left[k] -= send
            served[k] += send
            while send:
                row = queues[names[k]][head[k]]
                take = min(send, columns["length"][row] - used[k], window - at % window)
                out.append((row, used[k], take, at))
                used[k] += take
                at += take
                send -= take
                if used[k] == columns["length"][row]:
                    head[k], used[k] = head[k] + 1, 0
            if left[k]:
                heapq.heappush(turns, due(k, turn + 1))
        rows, skip, take, place = (np.array(x, np.int64) for x in zip(*out))
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(rows)),
            "start": pa.array(np.array(columns["start"], np.int64)[rows] + skip), "length": pa.array(take),
            "ids": pa.array([ids[r][s:s + n].tobytes() for r, s, n, _ in out], pa.binary()),
            "doc_tokens": table.column("n").take(pa.array(rows)),
            "sequence_id": pa.array(place // window), "offset": pa.array(place % window),
        })

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, text: str = "text", id_col: str = "doc_id",
         source: str = "source", window: int = 1024, quantum: int = QUANTUM, end_id: int = 0, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, in windows.

    A document is its ids by the ``tokenizers`` file at ``tokenizer``, without added special tokens, then ``end_id``.
    A piece is ``length`` of them from ``start`` on (``ids``: little-endian unsigned 32-bit), standing at ``offset`` of
    window ``sequence_id``. Each id is in exactly one piece and each window but the last is full. Over any run of windows
    a source that still has tokens gets its share of them within a quantum or two. Shares are the sources' shares of all
    tokens; ``targets`` sets weights for named sources instead, as fractions of the whole, and when a queue runs dry
    the others share what it leaves.

    Defined results: very long texts are encoded whole and cut where sequences end;
    null and empty texts are the end id alone; a null source is a queue of its own; repeated rows are
    documents of their own with an equal id; an empty table gives no pieces; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    size = Encoder(tokenizer).size
    kind, width = ("<u2", 2) if max(size, end_id + 1) <= 1 << 16 else ("<u4", 4)
    name = F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), name.alias("source"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tokens = settle(rows.mapInArrow(frugal(_tokenise(tokenizer, ranks, pattern, end_id, kind)), f"doc_id {id_type}, source string, task int, before long, n long, ids binary"))

    by_task = settle(tokens.groupBy("source", "task").agg(F.sum("n").alias("n")))
    by_source = by_task.groupBy("source").agg(F.sum("n").alias("all"))
    total = by_task.agg(F.sum("n")).first()[0] or 0
    share = F.col("all") / F.lit(float(max(total, 1)))
    for key, weight in (targets or {}).items():
        share = F.when(F.col("source") == "+" + key, F.lit(float(weight))).otherwise(share)
    shares = settle(by_source.select("source", share.alias("share")))
    whole = shares.agg(F.sum("share")).first()[0] or 1.0
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))).drop("n")
    bases = settle(bases.join(shares, "source").select(
        "source", "task", "base", (F.col("share") / F.lit(whole) * F.lit(CHUNK_TOKENS / quantum)).alias("rate"),
        (F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("u")))
    table = F.broadcast(bases) if fits_broadcast(bases) else bases

    lean = tokens.select("source", "task", "before", "n").join(table, ["source", "task"]).select(_cuts(width, quantum, False))
    chunks = settle(lean.groupBy("chunk").agg(F.sum("length").alias("size")))
    offsets = running_before(chunks, ["chunk"], "size", "offset").select("chunk", "offset")
    placed = tokens.join(table, ["source", "task"]).select("doc_id", "source", "n", "rate", "u", _cuts(width, quantum, True))
    placed = placed.join(F.broadcast(offsets) if fits_broadcast(offsets) else offsets, "chunk")
    kind_out = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.groupBy("chunk").applyInArrow(_serve(window, quantum, kind), kind_out)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): the windows themselves, padded to ``window`` unless a power of two long."""
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts"))
    power = F.bit_count(F.col("n_tokens")) == 1
    pad = F.lit(pad_id.to_bytes(4, "little"))
    body = F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"])))
    fill = F.when(power, "").otherwise(F.repeat(F.hex(pad), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat(body, fill)).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
