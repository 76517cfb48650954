"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (a mark for every space and one in front) and cut into marked words; no piece has a mark
behind another character, so the best segmentation of a text is that of its words. A block's distinct new
words are sorted, which walks their trie depth-first: forward scores and open vocabulary matches of a
common prefix stay on the stack and are used again. Words already known to a worker are looked up by hash.

The best segmentation has the largest sum of the vocabulary's piece scores; ties go to the longest last piece.
A character that no piece holds becomes its UTF-8 byte pieces, at 10 under the lowest score. Decoding maps ids to
bytes, marks to spaces, and drops the first space. Control and unknown pieces decode to nothing.

Edge cases: null and empty texts have no ids; a byte that is no UTF-8 is read as U+FFFD; a mark character in the text itself is encoded as bytes, so every
valid text comes back; rows with a repeated or null id are encoded each; extra columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytesx as X
from tessera.llm import tasks
from tessera.llm.tasks import lean

MARK = "▁"
MOST = 1 << 19  # words that a worker remembers
_loaded: dict[str, Pieces] = tasks.caches.setdefault("pieces", {})


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.trie: dict = {}
        self.byte_id = [0] * 256
        raw, low = [], 0.0
        for i in range(sp.get_piece_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(text[3:5], 16)] = i
                raw.append(bytes([int(text[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                score = sp.get_score(i)
                low = min(low, score)
                node = self.trie
                for c in text.replace(MARK, " "):
                    node = node.setdefault(c, {})
                node[""] = (i, score)
                raw.append(text.replace(MARK, " ").encode())
        self.unknown = low - 10
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        used = {c for t in raw if len(t) > 1 for c in t} | {r[0] for i, r in enumerate(raw) if len(r) == 1 and i not in set(self.byte_id)}
        self.alone = np.array([b < 128 and b not in used for b in range(256)])  # ASCII that only byte pieces hold
        self._forget()

    def _forget(self):
        self.hashes, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of the words, which are sorted and distinct."""
        trie, unknown, byte_id = self.trie, self.unknown, self.byte_id
        best, back, opened = [0.0], [None], [[]]  # by depth: score, (start, ids) of the last piece, open matches (start, node)
        before, out = "", []
        for word in words:
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del best[depth + 1 :], back[depth + 1 :], opened[depth + 1 :]
            for j in range(depth, len(word)):
                c = word[j]
                top, by, live = best[j] + unknown, None, []
                for start, node in opened[j]:  # the earliest start comes first and wins ties
                    node = node.get(c)
                    if node is not None:
                        live.append((start, node))
                        hit = node.get("")
                        if hit is not None and (by is None and best[start] + hit[1] >= top or best[start] + hit[1] > top):
                            top, by = best[start] + hit[1], (start, (hit[0],))
                node = trie.get(c)
                if node is not None:
                    live.append((j, node))
                    hit = node.get("")
                    if hit is not None and (by is None and best[j] + hit[1] >= top or best[j] + hit[1] > top):
                        top, by = best[j] + hit[1], (j, (hit[0],))
                best.append(top)
                back.append(by or (j, tuple(byte_id[b] for b in c.encode())))
                opened.append(live)
            ids, j = [], len(word)
            while j:
                j, last = back[j]
                ids.append(last)
            out.append([i for last in reversed(ids) for i in last])
            before = word
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        order = sorted(range(len(words)), key=lambda i: words[i])
        ids = self.segment([words[i].decode() for i in order])
        count = np.array([len(i) for i in ids], np.int64)
        at = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.array([x for i in ids for x in i], np.uint32)])
        h = np.concatenate([self.hashes, hashes[order]])
        o = np.argsort(h, kind="stable")
        self.hashes, self.at, self.count = h[o], np.concatenate([self.at, at])[o], np.concatenate([self.count, count])[o]

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, one after the other, and their row offsets."""
        n, some = len(off) - 1, np.diff(off) > 0
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        buf = np.insert(buf, off[:-1][some], 32)
        off = off + np.concatenate([[0], np.cumsum(some)])
        prev = np.concatenate([[0], buf[:-1]])
        alone = self.alone[buf] & (buf != 32)
        start = ((buf == 32) & (prev != 32)) | alone | np.concatenate([[False], alone[:-1]])
        start[off[:-1][some]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(buf))
        row = np.searchsorted(off, begin, "right") - 1
        with np.errstate(over="ignore"):
            h = X.mix(X.Rolling(buf).of(begin, end) + (end - begin).astype(np.uint64))
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == distinct[known]
        if not known.all():
            if len(self.hashes) + np.count_nonzero(~known) > MOST:
                self._forget()
                known[:] = False
            miss, raw = np.flatnonzero(~known), buf.tobytes()
            self._learn(distinct[miss], [raw[begin[i] : end[i]] for i in at[miss]])
            place = np.searchsorted(self.hashes, distinct)
        count = self.count[place][inverse]
        ids = self.flat[X.ranges(self.at[place][inverse], count)]
        per = np.bincount(row, weights=count, minlength=n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def decode_block(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their offsets."""
        size = self.size[ids]
        buf = self.raw[X.ranges(self.first[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[off]
        some = np.flatnonzero(np.diff(ends) > 0)
        lead = some[buf[ends[some]] == 32]
        keep = np.ones(len(buf), bool)
        keep[ends[lead]] = False
        cut = np.zeros(len(off), np.int64)
        cut[lead + 1] = 1
        return buf[keep], ends - np.cumsum(cut)


def _encode(path: str):
    def run(batches):
        p = pieces(path)
        for batch in batches:
            for a, b, buf, off in X.blocks(batch.column(1)):
                ids, ends = p.encode_block(buf, off)
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(crc, pa.int64()), batch.column(1)[a:b]], ["id", "ids", "ids_crc32", "text"])

    return run


def _decode(path: str):
    def run(batches):
        p = pieces(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                n = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = part.column(1).flatten().to_numpy()
                buf, ends = p.decode_block(ids.astype(np.int64), np.concatenate([[0], np.cumsum(n)]))
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "bytes"])

    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>), ids_crc32 (of the ids as little-endian 32-bit numbers) and the text."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return texts.mapInArrow(lean(_encode(vocabulary), "pieces"), "id long, ids array<int>, ids_crc32 long, text string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the text that the ids stand for; a byte that is no UTF-8 becomes U+FFFD."""
    first = encoded.columns
    ordered = encoded.select(first[0], ids_col, *[c for c in first[1:] if c != ids_col])
    shape = ", ".join(f"`{n}` {t}" for n, t in ordered.dtypes)
    return ordered.mapInArrow(lean(_decode(vocabulary), "pieces"), shape + ", bytes binary").select(*first, F.expr("make_valid_utf8(cast(bytes as string))").alias("decoded"))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_crc32 and same (the decoded text equals the text)."""
    both = decode(encode(docs, vocabulary, id_col, text_col), vocabulary)
    return both.select(id_col, F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))
