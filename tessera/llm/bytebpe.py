"""Token ids of a byte-level BPE vocabulary (a tokenizers JSON file) for whole blocks of texts.

A text is cut at white space into chunks that the vocabulary's pattern never joins. Chunks are hashed
block-wise; a distinct chunk is encoded once per worker and its ids are gathered for every place. The
merges run in tiktoken over the file's own vocabulary (ids are ranks there), which gives the ids that
tokenizers gives. Texts with unusual white space or with a special token's string go to tokenizers whole."""

from __future__ import annotations

import json
import re

import numpy as np

from tessera.llm import bytesx as X
from tessera.llm import tasks

#: Fixed value: the pattern that the vocabulary is made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST = 1 << 19  # chunks that a worker remembers
ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_loaded: dict[str, Encoder] = tasks.caches.setdefault("bytebpe", {})


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the rest follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        to_byte = _bytes_of_chars()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        self.merges = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line = self.merges.encode_ordinary("\n")[0]
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes, chunks: list[bytes]) -> None:
        if len(self.hashes) + len(hashes) > MOST:
            self._forget()
        texts = [c.decode() for c in chunks]
        blank = [t.isspace() for t in texts]
        ids = np.array(self.merges.encode_ordinary("\n".join(t for t, b in zip(texts, blank, strict=True) if not b)), np.uint32)
        cut = np.flatnonzero(ids == self.line)
        first, end = np.concatenate([[0], cut + 1]), np.append(cut, len(ids))
        spaces = [np.array(self.merges.encode_ordinary(t), np.uint32) for t, b in zip(texts, blank, strict=True) if b]
        start, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        blank = np.array(blank, bool)
        if (~blank).any():
            start[~blank], count[~blank] = first, end - first
        size = np.array([len(s) for s in spaces], np.int64)
        start[blank] = len(ids) + np.cumsum(size) - size
        count[blank] = size
        start += len(self.flat)
        self.flat = np.concatenate([self.flat, ids, *spaces])
        h = np.concatenate([self.hashes, hashes])
        o = np.argsort(h, kind="stable")
        self.hashes, self.first, self.count = h[o], np.concatenate([self.first, start])[o], np.concatenate([self.count, count])[o]

    def block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, one after the other, and their row offsets."""
        n = len(off) - 1
        raw = buf.tobytes()
        odd = np.zeros(n, bool)
        if ODD.search(raw) or any(s in raw for s in self.special):
            odd = np.array([bool(ODD.search(x := raw[a:b])) or any(s in x for s in self.special) for a, b in zip(off, off[1:], strict=False)])
        if len(buf):
            ws = X.SPACE[buf]
            head = np.zeros(len(buf), bool)
            head[off[:-1][np.diff(off) > 0]] = True
            prev = np.concatenate([[False], ws[:-1]])
            word = ~ws & (head | prev)
            start = head | (ws & ~prev) | (word & np.concatenate([[True], buf[:-1] != 32]))
            back = np.flatnonzero(word & ~head) - 1
            start[back] = True
            begin = np.flatnonzero(start)
            end = np.append(begin[1:], len(buf))
            row = np.searchsorted(off, begin, "right") - 1
            keep = ~odd[row]
            begin, end, row = begin[keep], end[keep], row[keep]
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
                miss = np.flatnonzero(~known)
                self._learn(distinct[miss], [raw[begin[i] : end[i]] for i in at[miss]])
                place = np.searchsorted(self.hashes, distinct)
            first, count = self.first[place][inverse], self.count[place][inverse]
            ids = self.flat[X.ranges(first, count)]
            per = np.bincount(row, weights=count, minlength=n).astype(np.int64)
        else:
            ids, per = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if odd.any():
            ends = np.concatenate([[0], np.cumsum(per)])
            parts = []
            for i in range(n):
                if odd[i]:
                    own = np.array(self.whole.encode(raw[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                    per[i] = len(own)
                else:
                    own = ids[ends[i] : ends[i + 1]]
                parts.append(own)
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(per)])
