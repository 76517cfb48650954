"""Suffix dedup: every byte covered by a ``length``-byte string that also starts earlier goes.

A blockwise suffix sort over a difference cover that is chosen by content. A fixed cover (positions
modulo v) has 12 to 20 % of all positions, and two equal strings meet at a shift that depends on the
pair. Here a position is in the cover if the hash of its SEED-byte prefix is the smallest in some
``length``-byte string, so any two equal strings hold the same cover position at the same shift, and
about 2.7 % of the positions are in it.

1. Cover ranks. Each cover position is named by its prefix and by the bytes of all strings that it
   stands for. Names go to buckets, and one bucket at a time is sorted: a name's first holder keeps
   its bytes, its later holders are repeats as a whole (long ties end here, without comparing the
   suffixes further), a prefix with one name is unique.
2. Suffixes. Only where one prefix has several names (the edges of copies) are the strings themselves
   sorted, again one bucket at a time, by (hash of 96 bits, position): all but the first are repeats.
   What travels is a name's bytes, once, to its prefix's bucket; its strings are made there.
3. Repeats are joined to the texts and their union is cut out.

Tasks send each name once and mark their own further holders, so a passage that a third of the rows
hold costs one entry per task. A prefix with many names in a task is spread over the buckets, and its
strings go one by one to the buckets of their own hashes. The number of buckets follows the table's bytes.

Positions are ordered by (id, offset). Edge cases: a null text counts as empty; a null id sorts last;
rows that repeat an id (or have none) are told apart by their texts and come in the order of these texts' hashes, so each loses
its own repeats only; rows that repeat id and text are one document; texts under ``length`` bytes lose nothing; extra
columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytesx as X
from tessera.llm.rowkeys import numbered, repeats_ids
from tessera.llm.scratch import drop, partitions, stash
from tessera.llm.tasks import lean

SEED = 28
PIECE = 1 << 20  # bytes of a text handled at once
SPREAD = 32  # names of one prefix in a task from which they are dealt over all buckets
BUCKET = 32 << 20  # bytes of text whose cover goes to one bucket
AT_ONCE = 1 << 18  # strings that are sorted together
LAST_ID = (1 << 63) - 1
_LOW = np.uint64((1 << 22) - 1)


def _raw(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _pieces(column, length: int):
    """(rows, base, bytes, offsets): blocks of whole texts, or overlapping pieces of a long one."""
    for a, b, buf, off in X.blocks(column, PIECE):
        if b - a > 1 or len(buf) <= 2 * PIECE:
            yield np.arange(a, b), np.zeros(b - a, np.int64), buf, off
        else:
            for p in range(0, max(1, len(buf) - length + 1), PIECE):
                part = buf[p : p + PIECE + length - 1]
                yield np.array([a]), np.array([p]), part, np.array([0, len(part)])


def cover(buf: np.ndarray, off: np.ndarray, length: int):
    """(row, start in row, count - 1, prefix hash, name) of every cover position's run of strings."""
    rows = np.flatnonzero(np.diff(off) >= length)
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    roll = X.Rolling(buf)
    h = X.mix(roll.fixed(SEED))
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, size = length - SEED + 1, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    per = np.diff(off)[rows] - length + 1
    at = X.ranges(off[:-1][rows], per)
    row = np.repeat(rows, per)
    low = (m[at] & _LOW).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(at)) - 1
    s0, s1, p, row = at[begin], at[end], low[begin], row[begin]
    with np.errstate(over="ignore"):
        name = X.mix(roll.of(s0, s1 + length) + X.mix(((p - s0) * 256 + s1 - s0).astype(np.uint64)))
    return row, s0 - off[row], s1 - s0, h[p], name


def _heads(*keys: np.ndarray) -> np.ndarray:
    head = np.ones(len(keys[0]), bool)
    head[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return head


def _lead(head: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


_SENT = "bucket int, seed binary, name binary, id binary, off binary, len binary"


def _by_bucket(where, columns, buckets):
    o = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[o], np.arange(buckets + 1))
    return [(b, *(_raw(c[o[cut[b] : cut[b + 1]]]) for c in columns)) for b in range(buckets) if cut[b] < cut[b + 1]]


def _send_cover(length: int, buckets: int):
    most = max(1 << 19, 4 * buckets)  # entries sent together: a packed row holds several at any number of buckets

    def pack(turn, parts):
        seed, name, ids, off, ln = (np.concatenate(c) for c in zip(*parts, strict=True))
        o = np.lexsort((off, ids, name, seed))
        seed, name, ids, off, ln = seed[o], name[o], ids[o], off[o], ln[o]
        head = _heads(seed, name)
        lead = _lead(head)
        later = ~head & ((ids != ids[lead]) | (off != off[lead]))
        out = [(turn % buckets, None, None, _raw(ids[later]), _raw(off[later]), _raw(ln[later]))] if later.any() else []
        seed, name, ids, off, ln = seed[head], name[head], ids[head], off[head], ln[head]
        of = _heads(seed)
        begin = np.flatnonzero(of)
        names = np.repeat(np.diff(np.append(begin, len(seed))), np.diff(np.append(begin, len(seed))))
        many = names >= SPREAD
        ln = ln | (many * np.uint8(128)).astype(np.uint8)
        key = np.where(many & ~of, X.mix(seed ^ name), seed)
        return out + _by_bucket(((key >> np.uint64(13)) % np.uint64(buckets)).astype(np.int64), (seed, name, ids, off, ln), buckets)

    def emit(rows):
        types = (pa.int32(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "seed", "name", "id", "off", "len"])

    def run(batches):
        turn, parts, held = 0, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, base, buf, off in _pieces(batch.column(1), length):
                row, start, ln, seed, name = cover(buf, off, length)
                parts.append((seed, name, ids[rows[row]], (base[row] + start).astype(np.uint32), ln.astype(np.uint8)))
                held += len(row)
                if held > most:
                    if rows_out := pack(turn, parts):
                        yield emit(rows_out)
                    turn, parts, held = turn + 11, [], 0
        if held and (rows_out := pack(turn, parts)):
            yield emit(rows_out)

    return run


def _bucketwise(close, direct):
    """Reads packed rows sorted by bucket, one bucket at a time. Rows whose first packed column is null go to ``direct``."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for b, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    if held:
                        yield close(*(b"".join(c) for c in zip(*held, strict=True)))
                    now, held = b, []
                if cells[0] is None:
                    yield direct(*cells)
                else:
                    held.append(cells)
        if held:
            yield close(*(b"".join(c) for c in zip(*held, strict=True)))

    return run


def _marks(ids, off, ln, whole, hot=0) -> pa.RecordBatch:
    """mark: offset, number of strings less one, if the prefix is spread, and if all the strings are repeats."""
    mark = (off.astype(np.int64) << 9) | ((ln & 127).astype(np.int64) << 2) | (np.int64(1) * hot << 1) | whole
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mark)], ["id", "mark"])


def _rank(seed, name, ids, off, ln):
    seed, name, ids = np.frombuffer(seed, np.uint64), np.frombuffer(name, np.uint64), np.frombuffer(ids, np.int64)
    off, ln = np.frombuffer(off, np.uint32), np.frombuffer(ln, np.uint8)
    o = np.argsort(seed, kind="stable")
    s = seed[o]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:].copy()
    same |= ln[o] >= 128
    o = o[same]  # unique prefixes have nothing to sort
    o = o[np.lexsort((off[o], ids[o], name[o], seed[o]))]
    seed, name, ids, off, ln = seed[o], name[o], ids[o], off[o], ln[o]
    if not len(o):
        return _marks(ids, off, ln, np.zeros(0, np.int64))
    head, of = _heads(seed, name), _heads(seed)
    begin = np.flatnonzero(of)
    group = np.cumsum(of) - 1
    hot = np.maximum.reduceat(ln, begin) >= 128
    torn = (np.add.reduceat(head.astype(np.int64), begin) > 1) | hot
    lead = _lead(head)
    later = ~head & ((ids != ids[lead]) | (off != off[lead]))
    keep = later | (head & torn[group])
    return _marks(ids[keep], off[keep], ln[keep], later[keep].astype(np.int64), hot[group][keep].astype(np.int64))


def _direct_marks(_seed, _name, ids, off, ln):
    ids = np.frombuffer(ids, np.int64)
    return _marks(ids, np.frombuffer(off, np.uint32), np.frombuffer(ln, np.uint8), np.ones(len(ids), np.int64))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and list lengths of a list column; null counts as empty."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), n


_STRINGS = "bucket int, k1 binary, k2 binary, id binary, off binary, len binary, raw binary"
_OTHER = 0xD1342543DE82EF95


def _string_names(buf: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that name each string."""
    end = at + length
    return X.mix(X.Rolling(buf).of(at, end)), (X.Rolling(buf, _OTHER).of(at, end) >> np.uint64(32)).astype(np.uint32)


def _send_strings(length: int, buckets: int):
    """The strings of torn names: a name's bytes by its prefix, or, of spread prefixes, each string's hash by itself."""
    types = (pa.int32(), *[pa.binary()] * 6)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["bucket", "k1", "k2", "id", "off", "len", "raw"])

    def bucket_of(key):
        return ((key >> np.uint64(13)) % np.uint64(buckets)).astype(np.int64)

    def pack_runs(parts):
        seed, ids, off, ln = (np.concatenate([p[j] for p in parts]) for j in range(4))
        raw, size = np.concatenate([p[4] for p in parts]), ln.astype(np.int64) + length
        first = np.cumsum(size) - size
        where = bucket_of(seed)
        o = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[o], np.arange(buckets + 1))
        for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            at = o[cut[b] : cut[b + 1]]
            yield b, _raw(seed[at]), None, _raw(ids[at]), _raw(off[at]), _raw(ln[at]), _raw(raw[X.ranges(first[at], size[at])])

    def pack_strings(turn, parts):
        k1, k2, ids, off = (np.concatenate(c) for c in zip(*parts, strict=True))
        o = np.lexsort((off, ids, k2, k1))
        k1, k2, ids, off = k1[o], k2[o], ids[o], off[o]
        head = _heads(k1, k2)
        lead = _lead(head)
        later = ~head & ((ids != ids[lead]) | (off != off[lead]))
        if later.any():
            yield turn % buckets, None, None, _raw(ids[later]), _raw(off[later]), None, None
        for row in _by_bucket(bucket_of(k1[head]), (k1[head], k2[head], ids[head], off[head]), buckets):
            yield *row, None, None

    def run(batches):
        turn, runs, strings, held = 0, [], [], 0

        def send():
            out = [*(pack_runs(runs) if runs else ()), *(pack_strings(turn, strings) if strings else ())]
            runs.clear()
            strings.clear()
            return [emit(out)] if out else []

        for batch in batches:
            ids = batch.column(0).to_numpy()
            marks, per = _lists(batch.column(2))
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), per)
            torn = (marks & 1) == 0
            place = (owner[torn] << 32) | (marks[torn] >> 9)
            o = np.argsort(place)
            place, spread = place[o], ((marks[torn] >> 1) & 1)[o] > 0
            for rows, base, buf, off in _pieces(batch.column(1), length):
                row, start, ln, seed, _ = cover(buf, off, length)  # the same runs as at first, of which the torn ones are taken
                if not len(row) or not len(place):
                    continue
                mine = (rows[row] << 32) | (base[row] + start)
                at = np.minimum(np.searchsorted(place, mine), len(place) - 1)
                found = place[at] == mine
                row, start, ln, seed, hot = row[found], start[found], ln[found], seed[found], spread[at[found]]
                begin, ln = start + off[row], ln.astype(np.uint8)
                if (~hot).any():
                    r = ~hot
                    runs.append((seed[r], ids[rows[row[r]]], (base[row[r]] + start[r]).astype(np.uint32), ln[r], buf[X.ranges(begin[r], ln[r].astype(np.int64) + length)]))
                    held += np.count_nonzero(r) * 8
                if hot.any():
                    count = ln[hot].astype(np.int64) + 1
                    strings.append((*_string_names(buf, X.ranges(begin[hot], count), length), np.repeat(ids[rows[row[hot]]], count), X.ranges(base[row[hot]] + start[hot], count).astype(np.uint32)))
                    held += int(count.sum())
                if held > max(1 << 19, 4 * buckets):
                    yield from send()
                    turn, held = turn + 11, 0
        yield from send()

    return run


def _starts(ids, off) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(off.astype(np.int64))], ["id", "start"])


def _later(k1, k2, ids, off) -> pa.RecordBatch:
    o = np.lexsort((off, ids, k2, k1))
    k1, k2, ids, off = k1[o], k2[o], ids[o], off[o]
    head = _heads(k1, k2)
    lead = _lead(head)
    later = ~head & ((ids != ids[lead]) | (off != off[lead]))
    return _starts(ids[later], off[later])


def _sort_strings(length: int):
    """Per bucket: every string but the first of its kind."""

    def of_runs(cells):
        seed, _, ids, off, ln, raw = (b"".join(c) if c[0] is not None else None for c in zip(*cells, strict=True))
        seed, ids, off = np.frombuffer(seed, np.uint64), np.frombuffer(ids, np.int64), np.frombuffer(off, np.uint32)
        count, raw = np.frombuffer(ln, np.uint8).astype(np.int64) + 1, np.frombuffer(raw, np.uint8)
        size = count - 1 + length
        first = np.cumsum(size) - size
        o = np.argsort(seed, kind="stable")
        group = np.flatnonzero(_heads(seed[o]))
        total = np.concatenate([[0], np.cumsum(count[o])])
        # slices of whole prefixes, so that equal strings meet
        cuts = np.unique(np.append(group[np.searchsorted(total[group], np.arange(0, total[-1], AT_ONCE), "right") - 1], len(o)))
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = o[a:b]
            buf, where = raw[X.ranges(first[at], size[at])], np.cumsum(size[at]) - size[at]
            yield _later(*_string_names(buf, X.ranges(where, count[at]), length), np.repeat(ids[at], count[at]), X.ranges(off[at].astype(np.int64), count[at]))

    def of_strings(cells):
        k1, k2, ids, off = (b"".join(c) for c in list(zip(*cells, strict=True))[:4])
        yield _later(np.frombuffer(k1, np.uint64), np.frombuffer(k2, np.uint32), np.frombuffer(ids, np.int64), np.frombuffer(off, np.uint32))

    def run(batches):
        now, runs, strings = None, [], []
        for batch in batches:
            for b, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    for kind, held in ((of_runs, runs), (of_strings, strings)):
                        if held:
                            yield from kind(held)
                    now, runs, strings = b, [], []
                if cells[0] is None:
                    yield _starts(np.frombuffer(cells[2], np.int64), np.frombuffer(cells[3], np.uint32))
                else:
                    (strings if cells[1] is not None else runs).append(cells)
        for kind, held in ((of_runs, runs), (of_strings, strings)):
            if held:
                yield from kind(held)

    return run


def _cut(length: int, whole_chars: bool):
    """Union of the repeats of each text, and what is left; with ``whole_chars`` without the rest of a split code point."""

    def run(batches):
        for batch in batches:
            marks, per = _lists(batch.column(3))
            ends = np.concatenate([[0], np.cumsum(per)])
            starts, n_starts = _lists(batch.column(4))
            last = np.concatenate([[0], np.cumsum(n_starts)])
            for a, b, buf, off in X.blocks(batch.column(2)):
                edge = np.zeros(len(buf) + 1, np.int32)
                size = np.diff(off)

                def cover_up(row, s, e, edge=edge, off=off, size=size):
                    ok = e <= size[row]
                    np.add.at(edge, off[row[ok]] + s[ok], 1)
                    np.add.at(edge, off[row[ok]] + e[ok], -1)

                mark = marks[ends[a] : ends[b]]
                row = np.repeat(np.arange(b - a), per[a:b])
                whole = (mark & 1) == 1
                s = mark[whole] >> 9
                cover_up(row[whole], s, s + ((mark[whole] >> 2) & 127) + length)
                s = starts[last[a] : last[b]]
                cover_up(np.repeat(np.arange(b - a), n_starts[a:b]), s, s + length)
                gone = np.cumsum(edge[:-1]) > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                full = off[:-1][size > 0]
                head[full] = gone[full]
                total = np.concatenate([[0], np.cumsum(gone)])
                runs = np.concatenate([[0], np.cumsum(head)])
                if whole_chars and gone.any():
                    lead = (buf & 0xC0) != 0x80
                    lead[full] = True
                    gone = np.repeat(np.maximum.reduceat(gone, at := np.flatnonzero(lead)), np.diff(np.append(at, len(buf))))
                left = buf[~gone]
                new = (off - np.concatenate([[0], np.cumsum(gone)])[off]).astype(np.int64)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(new), pa.py_buffer(left)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(total[off])), pa.array(np.diff(runs[off])), kept], ["id", "same", "n_removed", "n_spans", "kept"])

    return run


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, whole_chars: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(id, same, n_removed, n_spans, kept) of the texts that lose bytes, and the stashed tables that it reads;
    ``same`` is xxhash64 of the text."""
    if not 64 <= length <= 155:
        raise ValueError("length must lie in 64..155 bytes")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # where ids repeat, numbers that follow (id, text) stand for them from here on
    rows = numbered(texts) if repeats_ids(texts) else None
    if rows is not None:
        texts = rows.select(F.col("key").alias("id"), "text")
    bytes_held = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(2 * partitions(docs.sparkSession), -(-bytes_held // BUCKET))
    sent = texts.where(F.octet_length("text") >= length).mapInArrow(lean(_send_cover(length, buckets)), _SENT)
    ranked = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_bucketwise(_rank, _direct_marks)), "id long, mark long")
    marks = stash(ranked, "marks")
    lists = marks.groupBy("id").agg(F.collect_list("mark").alias("marks"))
    hit = stash(texts.join(lists, "id").select("id", "text", "marks"), "hit", "id")  # by id, so that the repeats come to the texts
    drop(marks)
    torn = hit.where(F.exists("marks", lambda m: m.bitwiseAND(F.lit(1)) == 0))
    strings = torn.mapInArrow(lean(_send_strings(length, buckets)), _STRINGS)
    starts = stash(strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_sort_strings(length)), "id long, start long"), "starts")
    per = starts.groupBy("id").agg(F.collect_list("start").alias("starts"))
    both = hit.join(per, "id", "left").select("id", F.xxhash64("text").alias("same"), "text", "marks", "starts")
    cut = both.mapInArrow(lean(_cut(length, whole_chars)), "id long, same long, n_removed long, n_spans long, kept binary")
    lost = cut.where("n_removed > 0")
    if rows is None:
        return lost, [hit, starts]
    return lost.drop("same").withColumnRenamed("id", "key").join(rows.select("key", "id", "same"), "key").drop("key"), [hit, starts, rows]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("__own"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("__id"), F.xxhash64(text).alias("__same"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"),
    )
    found, read = removals(docs, id_col, text_col, length)
    lost = stash(found.select(F.col("id").alias("__id"), F.col("same").alias("__same"), "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha")), "lost")
    drop(*read)
    zero = F.lit(0).cast("long")
    return own.join(lost, ["__id", "__same"], "left").select(
        F.col("__own").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``docs`` with repeats cut out of the text (n_chars, where there is one, is counted anew); rows with nothing left go.
    A code point that a cut splits is dropped."""
    found, read = removals(docs, id_col, text_col, length, whole_chars=True)
    lost = stash(found.select(F.col("id").alias("__id"), F.col("same").alias("__same"), F.col("kept").cast("string").alias("__kept")), "lost")
    drop(*read)
    on = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)) == F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__same"))
    both = docs.join(lost, on, "left").where("__kept is null or __kept <> ''")
    new = {text_col: F.coalesce("__kept", text_col)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return both.withColumns(new).select(*docs.columns)
