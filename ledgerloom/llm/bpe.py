"""Token ids of whole texts with a public tokenizer file, by way of a table of text pieces.

A text is cut where the tokenizer's own pre-tokenisation cuts as well, so the ids of the
pieces, one after the other, are the ids of the text. Cutting, look-up and joining are array
operations over the UTF-8 bytes of many texts; pieces met for the first time go through the
tokenizers library. Pieces are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import _WS, KEPT, word_hashes

#: Pieces that one Python worker remembers at most (about 60 MB); then it starts anew.
TABLE_PIECES = 1_200_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTERS = re.compile(rf"[{_LETTER}]+")
# kinds of bytes: 0 white space, 1 letters (ASCII, and the two bytes of À to ÿ), 2 others
_KIND = np.full(256, 2, np.uint8)
_KIND[_WS] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3] = 1
_KIND[0x80:0xC0] = 1
#: Bytes that keep their whole run between white space in one piece: the apostrophe, the
#: separators among the control bytes, and lead bytes of all characters but À to ÿ.
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[0x27, 0x1C, 0x1D, 0x1E, 0x1F, 0x7F]] = True
_SPECIAL[0xC0:] = True
_SPECIAL[0xC3] = False
_RARE = np.zeros(256, bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _other_space(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space outside ASCII, or a separator among the control bytes."""
    lead = np.flatnonzero(_RARE[raw])
    if not len(lead):
        return lead
    a, b, c = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)], raw[np.minimum(lead + 2, len(raw) - 1)]
    hit = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0) & (c == 0x8E))
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, lead[hit], side="right") - 1)


class _Table:
    """Ids of pieces by hash: open addressing in arrays."""

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.zeros(1 << bits, np.int32)
        self.n = 0
        self.at = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, "<u4")
        self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if it is not there. No piece hashes to 0."""
        out = np.full(len(h), -1, np.int32)
        todo, q = np.arange(len(h)), h
        slot = (h & self.mask).astype(np.int64)
        while len(todo):
            k = self.keys[slot]
            hit = k == q
            out[todo[hit]] = self.slots[slot[hit]]
            go = ~hit & (k != 0)
            todo, q, slot = todo[go], q[go], (slot[go] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """New pieces (distinct hashes)."""
        n, m = len(h), self.n
        size = np.array([len(x) // 4 for x in ids], np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")
        while m + n > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[m : m + n] = size
        self.at[m : m + n] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += n
        todo, slot = np.arange(n), (h & self.mask).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            win = free[first]
            self.keys[slot[win]], self.slots[slot[win]] = h[todo[win]], m + todo[win]
            rest = np.ones(len(todo), bool)
            rest[win] = False
            todo, slot = todo[rest], (slot[rest] + 1) & int(self.mask)


class PieceEncoder:
    """encode(texts) -> one array of unsigned 32-bit ids for each text.

    Special tokens' strings in a text are ordinary text; no special token is added. kind:
    'byte' (byte-level, white space kept) or 'word' (white space dropped), found from the
    file's pre-tokenizer; other files encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        norm = json.dumps(spec.get("normalizer"))
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None:
            self.kind = "byte"
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and pre["pretokenizers"][0].get("invert") and '"Replace"' in norm and "\\\\s+" in norm:
            self.kind = "word"
        else:
            self.kind = "whole"
        self.table = _Table()
        # ids that close a word (word kind) or open one (byte kind): where joint words part
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
        edge = [i for t, i in vocab.items() if (t.endswith("</w>") if self.kind == "word" else t.startswith("Ġ"))]
        self.edge[edge] = True
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each piece is asked for once

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joint(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters (byte kind: each after a space), encoded as one text
        and parted at the ids that only stand at a word's edge."""
        text = " ".join(words) if self.kind == "word" else "".join(words)
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        cut = (np.concatenate([[0], at + 1]) if self.kind == "word" else np.append(at, len(ids))) * 4
        if len(cut) != len(words) + 1 or cut[-1] != 4 * len(ids) or cut[0]:
            return self._direct(words)
        data, cut = ids.tobytes(), cut.tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        skip = 1 if self.kind == "byte" else 0
        simple = [i for i, x in enumerate(pieces) if (not skip or x[0] == " ") and _LETTERS.fullmatch(x, skip)]
        out: list[bytes] = [b""] * len(pieces)
        plain = np.zeros(len(pieces), bool)
        plain[simple] = True
        for which, how in ((simple, self._joint), (np.flatnonzero(~plain).tolist(), self._direct)):
            for k in range(0, len(which), 2048):
                some = which[k : k + 2048]
                for i, x in zip(some, how([pieces[i] for i in some]), strict=True):
                    out[i] = x
        return out

    def cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends) of the pieces of the rows; white space is dropped (word kind)
        or kept (byte kind) as the tokenizer does."""
        byte = self.kind == "byte"
        if not byte:  # lower-case ASCII and À to Þ, as the normalizer will
            raw = _LOWER[raw]
            after = np.flatnonzero(raw[:-1] == 0xC3) + 1
            b = raw[after]
            up = after[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
            raw[up] += 32
        n = len(raw)
        kind = _KIND[raw]
        odd = _SPECIAL[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        odd[lead[(raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7)]] = True  # × and ÷
        space = kind == 0
        first = np.zeros(n, bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        new = np.empty(n, bool)  # a run of white space or of other bytes begins
        new[0] = True
        new[1:] = space[1:] != space[:-1]
        new |= first
        begin = np.empty(n, bool)
        begin[0] = True
        begin[1:] = kind[1:] != kind[:-1]
        begin |= first
        if odd.any():  # no cut inside a run with a special byte
            runs = np.flatnonzero(new)
            bad = np.add.reduceat(odd, runs, dtype=np.int32) > 0
            begin &= new | ~np.repeat(bad, np.diff(np.append(runs, n)))
        if byte:
            # the last white space before other bytes stands alone, or, if a space, with them
            last = np.zeros(n, bool)
            last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
            begin |= last
            join = np.flatnonzero(last & (raw == 32)) + 1
            begin[join] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        if not byte:
            words = ~space[starts]
            starts, ends = starts[words], ends[words]
        return raw, starts, ends

    def encode_utf8(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and the n + 1 offsets of the rows."""
        n = len(offsets) - 1
        if self.kind == "whole":
            got = self._direct([raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)])
            return np.frombuffer(b"".join(got), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in got], dtype=np.int64)])
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64)
        if self.kind == "byte":
            whole = _other_space(raw, offsets)
            if len(whole):
                return self._mixed(raw, offsets, whole)
        raw, starts, ends = self.cut(raw, offsets)
        h = word_hashes(raw, starts, ends, lower=False) | np.uint64(1)
        at = self.table.find(h)
        if (at < 0).any():
            self._learn(raw, starts, ends, h, at)
            at = self.table.find(h)
            if (at < 0).any():  # the table started anew
                self._learn(raw, starts, ends, h, at)
                at = self.table.find(h)
        t = self.table
        size = t.size[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(total[-1]) + np.repeat(t.at[at] - total[:-1], size)
        return t.ids[where], total[np.searchsorted(starts, offsets)]

    def _mixed(self, raw, offsets, whole):
        """Rows with white space outside ASCII are encoded whole, those between by pieces."""
        parts, sizes, at = [], [], 0
        for i in [*whole.tolist(), len(offsets) - 1]:
            ids, rows = self.encode_utf8(raw[offsets[at] : offsets[i]], offsets[at : i + 1] - offsets[at])
            parts.append(ids)
            sizes.append(np.diff(rows))
            if i < len(offsets) - 1:
                ids = np.frombuffer(self._direct([raw[offsets[i] : offsets[i + 1]].tobytes().decode()])[0], "<u4")
                parts.append(ids)
                sizes.append(np.array([len(ids)]))
            at = i + 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def _learn(self, raw, starts, ends, h, at) -> None:
        missing = np.flatnonzero(at < 0)
        new, first = np.unique(h[missing], return_index=True)
        i = missing[first]
        if self.table.n + len(new) > TABLE_PIECES and self.table.n:
            self.table = _Table()
        data = raw.tobytes()
        self.table.add(new, self._ids_of([data[a:b].decode() for a, b in zip(starts[i].tolist(), ends[i].tolist(), strict=True)]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        data = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int64)
        ids, rows = self.encode_utf8(np.frombuffer(b"".join(data), np.uint8), offsets)
        return [ids[a:b] for a, b in zip(rows, rows[1:], strict=False)]


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder of the file; its table outlives a task that keeps the path."""
    if path not in KEPT:
        KEPT[path] = PieceEncoder(path)
    return KEPT[path]


def public_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
