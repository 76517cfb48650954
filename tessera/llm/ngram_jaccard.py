"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact at any size.

1. One pass turns each text into its set of word shingles (64-bit hashes) and keeps, per document,
   the set's size, a 128-bit sum that names the whole set, a 2048-bit bitmap and its tile keys.
2. Tiles. Sizes fall in bands [lo, hi). Two sets that reach the threshold t differ in at most
   d = (1 - t) / (1 + t) * 2 * hi shingles; a band deals every set's shingles into d + 1 + slack parts
   by hash, so two linked sets agree on more than ``slack`` parts. A tile key is (band, part, what the
   part holds). Sets with more than ``slack`` empty parts also get keys for those; no link can be lost.
   A document near a band's edge also takes the next band's keys.
3. A star. Each document's few smallest keys are shuffled packed and sorted per bucket; each task sends a key once
   and links its own further holders to the first, so a key that a third of the rows hold stays small.
4. Pairs: equal set names link at once; sizes and the bitmaps' Hamming distance bound the
   overlap from above; what is left is decided by intersecting the sorted arrays. Components of these links.
5. Torn tiles. All keys go packed with their ids and components, once, to their buckets, where a tile whose holders are in
   one component has nothing left to say; of a large component's holders a task sends one, and the others follow for the
   keys that need them. In the other tiles, holders are compared across components, blockwise, by bitmap. As long as that gives
   links, each holder hands on only its nearest of another component, so that groups of near copies grow together and
   their pairs are never listed; holders without any such partner leave; then every pair that is left is decided, by a
   bitmap that grows with the set and then exactly.

Edge cases: null and empty texts have an empty set and link with nothing; fewer than ``k`` words make
one shingle; a row without an id has no component; rows that repeat an id are one document with the links of all
their texts, and each has its own set's size; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytesx as X
from tessera.llm.components import BROADCAST_NODES, ROWS, components
from tessera.llm.rowkeys import numbered, repeats_ids
from tessera.llm.scratch import drop, partitions, stash
from tessera.llm.tasks import lean

WORDS = 32  # 64-bit words of a bitmap
TILE = 1024  # members of one side of a compared tile
EARLY = 6  # keys of a document in the star
BROADCAST_IDS = 1_000_000  # up to so many counted ids (8 bytes each) are broadcast; more are shuffled
BUCKET = 4 << 20  # bytes of keys that go to one bucket
KEY = 6  # bytes of a key that are sent beside its bucket
HOLDERS = 16  # ids of one component that a batch sends for one key; of more it sends the first and a mark
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower sizes of the bands, differences allowed and parts of each."""
    lo = [1]
    while lo[-1] < 1 << 40:
        lo.append(max(lo[-1] + 1, lo[-1] * 3 // 2))
    hi = np.array(lo[1:]) - 1
    d = (100 - percent) * 2 * hi // (100 + percent)
    return np.array(lo), d, d + 1 + np.where(d > 0, np.maximum(2, d // 6), 0)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle): the distinct shingles of every row, sorted."""
    buf = X.LOWER[buf]
    start, end, row = X.word_bounds(buf, off)
    h = X.mix(X.Rolling(buf).of(start, end))
    n, weights = len(h), _WEIGHTS[:k] if k <= len(_WEIGHTS) else np.resize(_WEIGHTS, k) * np.arange(1, 2 * k, 2, dtype=np.uint64)
    per = np.bincount(row, minlength=len(off) - 1)
    with np.errstate(over="ignore"):
        m = max(0, n - k + 1)
        s = np.zeros(m, np.uint64)
        for j in range(k):
            s += h[j : j + m] * weights[j]
        same = row[:m] == row[k - 1 : k - 1 + m]
        rows, s = row[:m][same], s[same]
        few = (per > 0) & (per < k)
        if few.any():
            at = np.flatnonzero(few[row])
            nth = at - np.searchsorted(row, row[at])
            short = np.zeros(len(off) - 1, np.uint64)
            np.add.at(short, row[at], h[at] * weights[nth])
            short += per.astype(np.uint64)
            rows, s = np.concatenate([rows, np.flatnonzero(few)]), np.concatenate([s, short[few]])
    s = X.mix(s)
    order = np.lexsort((s, rows))
    rows, s = rows[order], s[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (rows[1:] != rows[:-1])
    return rows[fresh], s[fresh]


def _tile_keys(rows, s, sizes, level, use, parts, slack):
    """Keys of the rows in ``use`` at their ``level``: (row, key)."""
    p = np.where(use, parts[level], 0)
    base = np.concatenate([[0], np.cumsum(p)])
    mine = use[rows]
    r, h = rows[mine], s[mine]
    with np.errstate(over="ignore"):
        part = X.mix(h + np.uint64(0x51ED270B9F7A3C11)) % p[r].astype(np.uint64)
        at = base[r] + part.astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, at, X.mix(h * np.uint64(0x2545F4914F6CDD1D)))
        count = np.bincount(at, minlength=base[-1])
        owner = np.repeat(np.arange(len(p)), p)
        no = np.arange(base[-1]) - base[owner]
        empty = np.bincount(owner[count == 0], minlength=len(p))
        keep = (count > 0) | (empty > slack[level])[owner]
        key = X.mix(total + X.mix((level[owner] * (1 << 32) + no).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return owner[keep], key[keep]


def _features(k: int, percent: int):
    lo, d, parts = bands(percent)
    slack = parts - d - 1

    def run(batches):
        for batch in batches:
            for a, b, buf, off in X.blocks(batch.column(1)):
                rows, s = shingle_sets(buf, off, k)
                n = b - a
                sizes = np.bincount(rows, minlength=n)
                sums = np.zeros((2, n), np.uint64)
                bits = np.zeros((n, 64 * WORDS), bool)
                with np.errstate(over="ignore"):
                    np.add.at(sums[0], rows, s)
                    np.add.at(sums[1], rows, X.mix(s ^ np.uint64(0x6A09E667F3BCC909)))
                bits[rows, (s >> np.uint64(20)).astype(np.int64) % (64 * WORDS)] = True
                bitmap = np.packbits(bits, axis=1).view(np.int64)
                level = np.maximum(0, np.searchsorted(lo, sizes, "right") - 1)
                some = sizes > 0
                r1, k1 = _tile_keys(rows, s, sizes, level, some, parts, slack)
                r2, k2 = _tile_keys(rows, s, sizes, level + 1, some & (sizes * 100 // percent >= lo[level + 1]), parts, slack)
                r, key = np.concatenate([r1, r2]), np.concatenate([k1, k2])
                key = key[np.argsort(r, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])
                keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(key.view(np.int64)))
                columns = [batch.column(0)[a:b], pa.array(sizes.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64))]
                columns += [pa.array(np.ascontiguousarray(bitmap[:, j])) for j in range(WORDS)]
                yield pa.RecordBatch.from_arrays([*columns, keys], ["id", "n", "s1", "s2", *(f"b{j}" for j in range(WORDS)), "keys"])

    return run


def _raw(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys and how many each row has."""
    per = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), per


def _by_bucket(key: np.ndarray, other: np.ndarray, buckets: int):
    """(bucket, keys, others), packed."""
    where = (key >> np.uint64(11)) % np.uint64(buckets)
    o = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[o], np.arange(buckets + 1, dtype=np.uint64))
    return [(b, _raw(key[o[cut[b] : cut[b + 1]]]), _raw(other[o[cut[b] : cut[b + 1]]])) for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist()]


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.int32(), *[pa.binary()] * (len(names) - 1))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _send(buckets: int):
    """Packs (key, id) of each set's smallest keys by bucket. A key's further holders in a batch, and copies of a whole set, are linked here to the first holder."""

    def run(batches):
        turn = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = np.lexsort((ids, *(batch.column(j).to_numpy() for j in (1, 2, 3))))
            name = [batch.column(j).to_numpy()[order] for j in (1, 2, 3)]
            head = np.ones(len(order), bool)
            head[1:] = np.any([x[1:] != x[:-1] for x in name], axis=0)
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            copies, kept = order[~head], order[head]
            key, per = _lists(batch.column(4))
            first = np.cumsum(per) - per
            key, per = key[X.ranges(first[kept], per[kept])], per[kept]
            row = np.repeat(np.arange(len(kept)), per)
            o = np.lexsort((key, row))
            early = np.arange(len(o)) - np.repeat(np.cumsum(per) - per, per) < EARLY
            key, doc = key[o[early]], ids[kept[row[o[early]]]]
            o = np.lexsort((doc, key))
            key, doc = key[o], doc[o]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            size = np.diff(np.append(begin, len(key)))
            led = np.repeat(doc[begin], size)
            own = doc != led
            out = [(turn % buckets, b"", _raw(ids[copies]), _raw(ids[lead[~head]])), (turn % buckets, _raw(key[own]), _raw(doc[own]), _raw(led[own]))]
            out += [(*r, None) for r in _by_bucket(key[begin], doc[begin], buckets)]
            turn += 7
            out = [r for r in out if r[2]]
            if out:
                yield _packed(out, ["bucket", "keys", "ids", "leads"])

    return run


def _meet(batches):
    """Per bucket: every holder of a key that at least two hold, with the first, and on how many keys; what was linked before
    passes, copies with 0."""

    def rows(doc, lead):
        o = np.lexsort((lead, doc))
        doc, lead = doc[o], lead[o]
        begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (lead[1:] != lead[:-1]))[: len(doc)])
        return pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(lead[begin]), pa.array(np.diff(np.append(begin, len(doc))))], ["id", "lead", "count"])

    def close(keys, docs):
        key, doc = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(docs), np.int64)
        o = np.lexsort((doc, key))
        key, doc = key[o], doc[o]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        led = np.repeat(doc[begin], np.diff(np.append(begin, len(key))))
        return rows(doc[doc != led], led[doc != led])

    now, keys, docs = None, [], []
    for batch in batches:
        for at in range(batch.num_rows):  # a row holds many keys, so rows are taken from the batch one at a time
            b, k, i, lead = (c[at].as_py() for c in batch.columns)
            if b != now:
                if keys:
                    yield close(keys, docs)
                now, keys, docs = b, [], []
            if lead is None:
                keys.append(k)
                docs.append(i)
            elif k:
                yield rows(np.frombuffer(i, np.int64), np.frombuffer(lead, np.int64))
            else:
                doc = np.frombuffer(i, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.frombuffer(lead, np.int64)), pa.array(np.zeros(len(doc), np.int64))], ["id", "lead", "count"])
    if keys:
        yield close(keys, docs)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in four bytes each where that is enough for all."""
    return _raw(x.astype("<u4") if x.max() < 1 << 32 else x)


def _widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n else np.int64).astype(np.int64)


def _send_tiles(buckets: int):
    """Packs (key, id, component, if there are more) by bucket. Of a key's holders in one component a batch sends HOLDERS at most; of more only the
    first goes, marked. Of a key six bytes go: buckets hold a set number of keys, so that hardly two meet there, and two that
    do only make a tile that is compared for nothing. Ids go as the difference to the least one and components as the
    difference to the id, in four bytes where that is enough."""

    def run(batches):
        for batch in batches:
            ids, comp = (batch.column(j).to_numpy() for j in (0, 1))
            key, per = _lists(batch.column(2))
            rank = np.lexsort((ids, comp))
            first = np.cumsum(per) - per
            key, row = key[X.ranges(first[rank], per[rank])], np.repeat(rank, per[rank])
            bucket = (key >> np.uint64(11)) % np.uint64(buckets)
            o = np.lexsort((key, bucket))
            key, row, bucket = key[o], row[o], bucket[o]
            doc, comp = ids[row], comp[row]
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (comp[1:] != comp[:-1]))[: len(key)])
            size = np.diff(np.append(begin, len(key)))
            more = np.repeat(size > HOLDERS, size)
            sent = ~more
            sent[begin] = True
            key, doc, comp, more, bucket = key[sent], doc[sent], comp[sent], more[sent], bucket[sent]
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                at = slice(cut[i], cut[i + 1])
                least = doc[at].min()
                gaps = _narrow((doc[at] - comp[at]).view(np.uint64))
                out.append((i, _raw(key[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]), least.tobytes() + _narrow((doc[at] - least).view(np.uint64)), gaps, _raw(more[at])))
            if out:
                yield _packed(out, ["bucket", "keys", "ids", "gaps", "more"])

    return run


def _unpacked(keys: bytes, ids: bytes, gaps: bytes, more: bytes) -> tuple[np.ndarray, ...]:
    n = len(keys) // KEY
    key = np.zeros((n, 8), np.uint8)
    key[:, :KEY] = np.frombuffer(keys, np.uint8).reshape(n, KEY)
    doc = np.frombuffer(ids, np.int64, 1) + _widened(ids[8:], n)
    return key.view("<u8")[:, 0], doc, doc - _widened(gaps, n), np.frombuffer(more, bool)


def _torn(batches):
    """Per bucket: the sent holders of the keys whose holders are in several components. A key is the short one and its bucket from here on."""

    def close(bucket, cells):
        key, doc, comp, more = (np.concatenate(c) for c in zip(*cells, strict=True))
        o = np.lexsort((doc, comp, key))
        key, doc, comp, more = key[o], doc[o], comp[o], more[o]
        new = np.append(True, key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        torn = np.repeat(comp[begin] != comp[begin + size - 1], size)
        torn &= new | np.append(True, doc[1:] != doc[:-1])
        key = (key[torn] << np.uint64(16)) | np.uint64(bucket & 0xFFFF)
        return pa.RecordBatch.from_arrays([pa.array(doc[torn]), pa.array(key.view(np.int64)), pa.array(comp[torn]), pa.array(more[torn])], ["id", "key", "comp", "more"])

    now, held = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            b, *cells = (x[at].as_py() for x in batch.columns)
            if b != now:
                if held:
                    yield close(now, held)
                now, held = b, []
            held.append(_unpacked(*cells))
    if held:
        yield close(now, held)


def _wide_bitmap(s: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, four or more a shingle."""
    size = 1 << max(11, (4 * len(s)).bit_length())
    bits = np.zeros(size, bool)
    bits[(s >> np.uint64(16)).astype(np.int64) % size] = True
    return np.packbits(bits).tobytes()


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for a, b, buf, off in X.blocks(batch.column(1)):
                rows, s = shingle_sets(buf, off, k)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))]).astype(np.int64)
                wide = pa.array([_wide_bitmap(s[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(ends)), wide, pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(8 * ends), pa.py_buffer(s)]).cast(pa.binary())], ["id", "n", "wide", "set"])

    return run


def _may(percent: int):
    """(pair, wide, wide, sizes' sum): keeps the pairs whose wide bitmaps, folded to the shorter length, allow enough overlap."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y, total in zip(*batch.columns[-3:-1], batch.columns[-1].to_numpy(), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                while len(a) != len(b):
                    a, b = (a, b) if len(a) > len(b) else (b, a)
                    a = a[: len(a) // 2] | a[len(a) // 2 :]
                ham = int(np.bitwise_count(a ^ b).sum())
                keep.append((100 + percent) * ((int(total) - ham) // 2) >= percent * int(total))
            yield batch.select(batch.schema.names[:-3]).filter(pa.array(keep, pa.bool_()))

    return run


def _exact(percent: int):
    """(pair, set, set): keeps the pairs whose sorted arrays overlap enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*batch.columns[-2:], strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int(np.count_nonzero(b[at] == a))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    return run


def _tiles(percent: int, nearest: bool):
    """Rows sorted by (key, x, y): pairs of side x with side y from different components that bitmaps and sizes allow,
    with their components and Hamming distance. ``nearest``: only the nearest for each row of the tile."""
    far = np.int64(1 << 62)

    def found(ids, comp, p, q, ham):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[p], ids[q], comp[p], comp[q], ham)], ["a", "b", "ca", "cb", "ham"])

    def pairs(key, side, ids, comp, n, bits):
        x, y = key[1], key[2]
        left = np.flatnonzero(side == x)
        right = left if x == y else np.flatnonzero(side == y)
        best = np.full(len(right), far)  # distance and place of the nearest on the left
        for i in range(0, len(left), 64):
            p = left[i : i + 64]
            total = n[p][:, None] + n[right][None, :]
            ham = np.zeros(total.shape, np.int64)
            for j in range(WORDS):
                ham += np.bitwise_count((bits[j][p][:, None] ^ bits[j][right][None, :]).view(np.uint64))  # of a signed number it would count the magnitude's bits
            small = np.minimum(n[p][:, None], n[right][None, :])
            ok = (comp[p][:, None] != comp[right][None, :]) & (100 * small >= percent * (total - small)) & ((100 + percent) * ((total - ham) // 2) >= percent * total)
            if not nearest:
                u, v = np.nonzero(ok)
                yield found(ids, comp, p[u], right[v], ham[u, v])
                continue
            if not ok.any():
                continue
            ham = np.where(ok, ham << 32, far)
            at = np.argmin(ham, axis=1)
            u = np.flatnonzero(ham[np.arange(len(p)), at] < far)
            yield found(ids, comp, p[u], right[at[u]], ham[u, at[u]] >> 32)
            if x != y:
                best = np.minimum(best, (ham + np.where(ok, p[:, None], 0)).min(axis=0))
        v = np.flatnonzero(best < far)
        if len(v):
            yield found(ids, comp, right[v], best[v] & 0xFFFFFFFF, best[v] >> 32)

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            c = [t.column(j).to_numpy() for j in range(t.num_columns)]
            edge = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])) + 1
            cut = [0, *edge.tolist()]
            for a, b in zip(cut, cut[1:], strict=False):
                yield from pairs((c[0][a], c[1][a], c[2][a]), c[3][a:b], c[4][a:b], c[5][a:b], c[6][a:b], [v[a:b] for v in c[7:]])
            held = t.slice(cut[-1])
        if held is not None and held.num_rows:
            c = [held.column(j).to_numpy() for j in range(held.num_columns)]
            yield from pairs((c[0][0], c[1][0], c[2][0]), c[3], c[4], c[5], c[6], c[7:])

    return run


def _asked(listed: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids``, which come of a stashed table with counted rows (two ids a row at most), for a semi join: few go to the rows, many are shuffled."""
    few = _few(listed, ids)
    return ids.distinct() if few is ids else few


def _few(counted: DataFrame, rows: DataFrame, seen: str = "rows") -> DataFrame:
    """``rows``, of which there are at most two to a row of the stashed ``counted`` (to one that ``seen`` counts), marked for broadcast if that bounds them well enough."""
    return F.broadcast(rows) if 2 * counted.seen[seen] <= BROADCAST_IDS else rows


def _ends(pairs: DataFrame) -> DataFrame:
    return _asked(pairs, pairs.select(F.explode(F.array("a", "b")).alias("id")))


def _bounded(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(a, b) -> those with equal set names, and those whose sizes and bitmaps allow a link."""
    bit_cols = [f"b{j}" for j in range(WORDS)]
    small = stash(named.select("id", "n", "s1", "s2", *bit_cols).join(_ends(pairs), "id", "left_semi"), "small")
    a, b = (small.select(*(F.col(c).alias(f"{c}_{s}") for c in small.columns)) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))
    total, less = F.col("n_a") + F.col("n_b"), F.least("n_a", "n_b")
    ham = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bit_cols[1:]), F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
    same = F.expr("n_a = n_b and s1_a = s1_b and s2_a = s2_b")
    bound = (less * 100 >= (total - less) * percent) & (F.floor((total - ham) / 2) * (100 + percent) >= total * percent)
    judged = stash(both.select("a", "b", same.alias("same"), bound.alias("may")).where("same or may"), "judged", rows=ROWS)
    drop(small)
    return judged


def _decide(pairs: DataFrame, unsure: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``unsure``, rows of the stashed ``pairs``, that link: by bitmaps that grow with the set, then exactly. Columns beside a and b are kept."""
    shape = ", ".join(f"{c} long" for c in unsure.columns)
    ids = _asked(pairs, unsure.select(F.explode(F.array("a", "b")).alias("id")))
    sets = stash(texts.join(ids, "id", "left_semi").mapInArrow(lean(_sets(k)), "id long, n long, wide binary, set binary"), "sets")
    wide_a, wide_b = (sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}")) for s in "ab")
    close = unsure.join(wide_a, "a").join(wide_b, "b").select(*unsure.columns, "wide_a", "wide_b", (F.col("n_a") + F.col("n_b")).alias("total"))
    close = stash(close.mapInArrow(lean(_may(percent)), shape), "close", rows=ROWS)
    full = sets.select("id", "set").join(_ends(close), "id", "left_semi")
    met = close.join(full.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    linked = stash(met.select(*unsure.columns, "x", "y").mapInArrow(lean(_exact(percent)), shape), "linked", rows=ROWS)
    drop(sets, close)
    return linked


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(sizes: id, n; groups: node, component) for the documents whose shingle sets link at ``percent`` Jaccard."""
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = every.where("id is not null")
    shape = "id long, n long, s1 long, s2 long, " + ", ".join(f"b{j} long" for j in range(WORDS)) + ", keys array<long>"
    features = lambda rows: rows.mapInArrow(lean(_features(k, percent)), shape)
    if not repeats_ids(known):
        feats, groups = _grouped(known, features, k, percent)
        sizes = stash(feats.select("id", "n").union(features(every.where("id is null")).select("id", "n")), "sizes")
        drop(feats)
        return sizes, groups
    rows = numbered(known)
    first = rows.groupBy("id").agg(F.min("key").alias("b"))
    one = rows.select("id", F.col("key").alias("a")).join(first, "id").where("a <> b").select("a", "b")  # rows of one id belong together
    feats, groups = _grouped(rows.select(F.col("key").alias("id"), "text"), features, k, percent, one)
    drop(feats)
    of = rows.select("key", "id")
    node = groups.join(of.withColumnRenamed("key", "node").withColumnRenamed("id", "own"), "node")
    both = node.join(of.withColumnRenamed("key", "component").withColumnRenamed("id", "to"), "component")  # the least key has the least id
    named = stash(both.select(F.col("own").alias("node"), F.col("to").alias("component")).distinct(), "groups")
    drop(rows)
    return stash(features(every).select("id", "n"), "sizes"), named


def _grouped(texts: DataFrame, features: Callable[[DataFrame], DataFrame], k: int, percent: int, known_links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the stashed features of all rows, groups) for texts whose ids differ."""
    spark = texts.sparkSession
    bit_cols = [f"b{j}" for j in range(WORDS)]
    # by id, so that what later asks for some ids' keys or bitmaps is sent to them and not they to it
    feats = stash(features(texts).repartition(partitions(spark), "id"), "features", "id")
    named = feats.where("n > 0")
    held = named.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-8 * held // BUCKET))
    sent = named.select("id", "s1", "s2", "n", "keys").mapInArrow(lean(_send(buckets)), "bucket int, keys binary, ids binary, leads binary")
    met = stash(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_meet), "id long, lead long, count long"), "met")

    # copies inside a batch are linked already; the first of each batch meet those of the others here, one row a batch and set
    copies = met.where("count = 0").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    heads = named.select("id", "n", "s1", "s2").join(copies.select(F.col("a").alias("id")), "id", "left_anti")
    lone = stash(heads.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("holders")), "lone")
    equal = heads.join(lone.where("holders > 1"), ["n", "s1", "s2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # two leads an id bring most of a group together; what they miss shows up as a torn tile
    leads = met.where("count > 0").groupBy("id", "lead").agg(F.sum("count").alias("count")).groupBy("id").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("most"), F.min("lead").alias("least"))
    star = stash(leads.select(F.col("id").alias("a"), F.explode(F.array_distinct(F.array("most", "least"))).alias("b")), "star", rows=ROWS)
    judged = _bounded(star, named, percent)
    linked = _decide(judged, judged.where("not same").select("a", "b"), texts, k, percent)
    links = linked.union(judged.where("same").select("a", "b")).union(copies).union(equal)
    groups = components(links if known_links is None else links.union(known_links))
    drop(star, judged, linked, met)

    # equal sets are compared once, so the first of each stands for all in tiles
    own = groups.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    first = named.select("id", "keys").join(lone.select(F.col("rep").alias("id")), "id", "left_semi")
    first = first.join(own, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "keys")
    sent = first.mapInArrow(lean(_send_tiles(buckets)), "bucket int, keys binary, ids binary, gaps binary, more binary")
    torn = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_torn), "id long, key long, comp long, more boolean")
    member = stash(torn, "members", rows=ROWS, more="count_if(more)")
    if member.seen["more"]:  # large components' further holders of torn keys; only these components' rows are looked at again
        asked = member.where("more").select("key", "comp").distinct()
        again = first.join(_few(member, asked.select("comp").distinct(), "more"), "comp", "left_semi").select("id", "comp", F.explode("keys").alias("key"))
        short, bucket = F.col("key").bitwiseAND(F.lit((1 << 8 * KEY) - 1)), F.shiftrightunsigned("key", 11) % buckets
        again = again.withColumn("key", F.shiftleft(short, 16).bitwiseOR(bucket.bitwiseAND(F.lit(0xFFFF)))).join(_few(member, asked, "more"), ["key", "comp"]).distinct()
        rest = member.join(_few(member, asked, "more"), ["key", "comp"], "left_anti")
        whole = stash(rest.select("id", "key", "comp").union(again.select("id", "key", "comp")), "members", rows=ROWS)
        drop(member)
        member = whole
    drop(lone)
    small = stash(named.select("id", "n", *bit_cols).join(_asked(member, member.select("id")), "id", "left_semi"), "small")
    merged, nearest = None, True  # merged: what became of the components since
    while member.seen["rows"]:
        tile = member.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        tile = tile.groupBy("who", "size").agg(F.min("key").alias("key"))  # tiles with the same holders are compared once
        sides = _few(member, tile.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("sides")))
        side = member.join(sides, "key").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
        dealt = side.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).join(small, "id")
        dealt = dealt.select("key", F.least("side", "o").alias("x"), F.greatest("side", "o").alias("y"), "side", "id", "comp", "n", *bit_cols)
        found = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lean(_tiles(percent, nearest)), "a long, b long, ca long, cb long, ham long")
        if nearest:
            best = F.min_by(F.struct("b", "ca", "cb"), F.struct("ham", "b")).alias("best")
            found = found.groupBy("a").agg(best).select("a", "best.*")
        ordered = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "ca", "cb")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        cross = stash(found.select(ordered.alias("p")).select("p.*").distinct(), "cross", rows=ROWS)
        if not cross.seen["rows"]:
            drop(cross)
            break  # no pair is left
        more = _decide(cross, cross, texts, k, percent)  # tiles have looked at sizes and bitmaps, and their sets differ
        linked = more.seen["rows"] > 0
        if linked:
            joined, before = more.select(F.col("ca").alias("a"), F.col("cb").alias("b")), merged
            if before is not None:
                joined = joined.union(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
            merged = components(joined)
            if before is not None:
                drop(before)
        if not nearest:
            drop(cross, more)
            break
        # components only grow together: a holder without a partner in this round has none in a later one
        left = member.join(_ends(cross), "id", "left_semi")
        kept = stash(_renamed(left, merged, "comp") if linked else left, "members", rows=ROWS), stash(small.join(_ends(cross), "id", "left_semi"), "small")
        drop(member, small, cross, more)
        member, small = kept
        nearest = linked
    drop(member, small)
    if merged is None:
        return feats, groups
    # a component that had one row, and so no row in the groups, comes with its own
    new = merged.join(groups.select("node"), "node", "left_anti").select("node", "component")
    whole = stash(_renamed(groups, merged, "component").select("node", "component").union(new), "groups")
    drop(groups, merged)
    return feats, whole


def _renamed(rows: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """``rows`` with the components in ``column`` replaced by what they were merged into."""
    to = merged.select(F.col("node").alias(column), F.col("component").alias("__to"))
    to = F.broadcast(to) if merged.seen["rows"] <= BROADCAST_NODES else to
    return rows.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).select(*rows.columns)


def ngram_jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    sizes, groups = jaccard_links(docs, id_col, text_col, k, percent)
    own = sizes.select("id", F.col("n").alias("n_shingles"))
    return own.join(groups.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the document with the smallest id stays."""
    sizes, groups = jaccard_links(docs, id_col, text_col, k, percent)
    gone = stash(groups.where("node <> component").select(F.col("node").alias("__gone")), "gone")
    drop(sizes, groups)
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
