"""Best-fit packing by hierarchical residuals.

Documents become token counts (plus one end token), those over the capacity are cut into full pieces
with the rest in front. Every partition packs its own pieces best-fit decreasing, and bins that are
nearly full are final. Underfull bins travel on as items: FAN_IN partitions merge and best-fit again, until
one is left, or neither partitions nor bins get fewer. A round's partitions hold a bounded number of bins, so no task holds all.

Edge cases: a null text is one end token; a byte that is no UTF-8 is read as U+FFFD; a null id stays null; rows that repeat an id are packed each;
extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytesx as X
from tessera.llm.bytebpe import encoder
from tessera.llm.scratch import stash
from tessera.llm.tasks import lean

ITEM = np.dtype([("id", "<i8"), ("none", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
AT_ONCE = 100_000  # items or bins that a task packs together
FAN_IN = 8
SLACK = 4  # free tokens of a bin that counts as full


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for a, b, buf, off in X.blocks(batch.column(1)):
                ids, ends = enc.block(buf, off)
                out = []
                for i in range(b - a):
                    raw = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    first = (len(raw) - 1) % capacity + 1
                    cuts = [0, *range(first, len(raw) + 1, capacity)]
                    out += [(a + i, k, s, e - s, zlib.crc32(raw[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                row, piece, start, length, crc = (np.array(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc.astype(np.int64))], ["id", "piece", "start", "length", "crc"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, crc): the documents' token sequences, cut where they exceed the capacity."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return texts.mapInArrow(lean(_pieces(vocabulary, capacity, end_id), "bytebpe"), "id long, piece int, start long, length long, crc long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: largest items first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        size = sizes[i]
        room = mask >> size
        if room:
            left = size + (room & -room).bit_length() - 1
            at = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
            bins[at].append(i)
        else:
            at, left = len(bins), capacity
            bins.append([i])
        rest = left - size
        if rest:
            free[rest].append(at)
            mask |= 1 << rest
    return bins


def _pack(capacity: int, first: bool, last: bool):
    """(fill, items), or in the first round pieces, -> (done, sequence, fill, items)."""

    def close(sizes, items):
        part = TaskContext.get().partitionId()
        done, seq, fill, out = [], [], [], []
        for b in best_fit(sizes, capacity):
            total = sum(sizes[i] for i in b)
            done.append(last or total > capacity - SLACK)
            fill.append(total)
            out.append(b"".join(items[i] for i in b))
            seq.append((part << 32) | close.number)
            close.number += 1
        return pa.RecordBatch.from_arrays([pa.array(done, pa.bool_()), pa.array(seq, pa.int64()), pa.array(fill, pa.int32()), pa.array(out, pa.binary())], ["done", "sequence", "fill", "items"])

    def run(batches):
        close.number = 0
        sizes, items = [], []
        for batch in _records(batches) if first else batches:
            sizes += batch.column(0).to_pylist()
            items += batch.column(1).to_pylist()
            if len(sizes) >= AT_ONCE:
                yield close(sizes, items)
                sizes, items = [], []
        if sizes:
            yield close(sizes, items)

    return run


def _records(batches):
    """Pieces as (fill, one packed item)."""
    for batch in batches:
        rec = np.zeros(batch.num_rows, ITEM)
        rec["id"] = batch.column(0).fill_null(0).to_numpy()
        rec["none"] = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for j, c in enumerate(("piece", "start", "length", "crc"), 1):
            rec[c] = batch.column(j).to_numpy()
        ends = (np.arange(batch.num_rows + 1) * ITEM.itemsize).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(3).cast(pa.int32()), pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(rec.tobytes())])], ["fill", "items"])


def _unpack(batches):
    for batch in batches:
        buf, off = X.strings(batch.column(1))
        rec = np.frombuffer(buf.tobytes(), ITEM)
        per = np.diff(off) // ITEM.itemsize
        ends = np.cumsum(rec["length"].astype(np.int64))
        before = ends - rec["length"]
        head = np.cumsum(per) - per
        seq = np.repeat(batch.column(0).to_numpy(), per)
        offset = before - np.repeat(before[head], per) if len(rec) else before
        yield pa.RecordBatch.from_arrays([pa.array(rec["id"].copy(), mask=rec["none"].copy()), pa.array(rec["piece"].copy()), *(pa.array(rec[c].astype(np.int64)) for c in ("start", "length", "crc")), pa.array(seq), pa.array(offset.astype(np.int64))], ["id", "piece", "start", "length", "crc", "sequence", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """(id, piece, start, length, crc) -> the same with sequence and offset."""
    shape, done = "done boolean, sequence long, fill int, items binary", []
    parts, left, number, last, before = None, pieces, 0, False, None
    while True:
        now = left.rdd.getNumPartitions() if parts is None else parts
        packed = stash(left.mapInArrow(lean(_pack(capacity, not number, last)), shape), f"round{number}")
        done.append(packed.where("done").select((F.col("sequence") + F.lit(number << 56)).alias("sequence"), "items"))
        if last:
            break
        under = packed.where("not done").count()
        if not under:
            break
        parts = max(1, -(-under // AT_ONCE), -(-now // FAN_IN))
        last = parts == 1 or (parts >= now and before is not None and under >= before)  # the last round deals anew what has not met, and ends all bins
        before = under
        left = packed.where("not done").select("fill", "items").repartition(parts)
        number += 1
    bins = done[0]
    for d in done[1:]:
        bins = bins.union(d)
    return bins.mapInArrow(lean(_unpack), "id long, piece int, start long, length long, crc long, sequence long, offset long")


def packed_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stash(token_pieces(docs, vocabulary, id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, capacity).select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")
