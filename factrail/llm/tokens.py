"""Token ids of whole texts by the tokenizers library, with a per-query memory of chunks.

The byte-level pre-tokenizer never joins what stands on both sides of (a) a word's end and the white space after it or
(b) an ASCII letter and ASCII punctuation other than the apostrophe, so a text's ids are the ids of the chunks between such
places, in order. Natural text repeats its chunks, so each Python worker encodes a chunk once and takes repeats from a
direct-mapped table of fixed size. Nothing else of the text matters to a chunk's ids, and no text is cut short.
Strings of special tokens in a text are chunks of their own and get the special id, as the library's plain call gives it;
with ``plain`` they are ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np

from factrail.llm.blocks import hash_spans

SLOTS = 1 << 22
#: Remembered ids for each slot.
POOL = 4
#: Longer chunks are encoded each time and not remembered.
REMEMBERED_BYTES = 64
RUN = 1000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True
_MARK = _PLAIN & ~_LETTER
_MARK[48:58] = False
_MARK[39] = False
_LEAD2 = np.zeros(256, bool)
_LEAD2[0xC3:0xE0] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    n = len(data)
    cut = np.zeros(n, bool)
    space = _SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = _PLAIN[data[:-1]]
    before[2:] |= _HIGH[data[1:-1]] & _LEAD2[data[:-2]]
    cut |= space & before
    cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of blocks of texts. One per worker and query: a new query starts with an empty memory."""

    current: tuple[str, Encoder] | None = None

    def __init__(self, vocabulary: str, plain: bool = False, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(names.values()) + 1, bool)
        self.blank[[i for name, i in names.items() if name[0] in "\u0120\u010a"]] = True
        self.slots = slots
        self.keys = np.zeros(slots, np.uint64)
        self.at = np.zeros(slots, np.int32)
        self.length = np.zeros(slots, np.int32)
        self.pool = np.zeros(1 << 20, np.int32)
        self.used = 0

    @classmethod
    def of(cls, query: str, vocabulary: str, plain: bool = False, slots: int = SLOTS) -> Encoder:
        if cls.current is None or cls.current[0] != query:
            cls.current = None
            cls.current = (query, cls(vocabulary, plain, slots))
        return cls.current[1]

    def _starts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Chunk starts with every special token of a row as a chunk of its own; of two that overlap, the earlier counts."""
        starts = chunk_starts(offsets, data)
        raw = data.tobytes() if self.special else b""
        found = []
        for name in self.special:
            at = raw.find(name)
            while at >= 0:
                found.append((at, at + len(name)))
                at = raw.find(name, at + 1)
        if not found:
            return starts
        cuts, reach = [], 0
        for lo, hi in sorted(found):
            inside = np.searchsorted(offsets, lo, side="right") == np.searchsorted(offsets, hi, side="left")
            if lo >= reach and inside:
                starts = starts[(starts < lo) | (starts >= hi)]
                cuts += [lo, hi] if hi < len(data) else [lo]
                reach = hi
        return np.union1d(starts, np.array(cuts, starts.dtype))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks. Chunks whose only white space is one leading space or line feed are encoded in runs: in
        those every chunk begins with the only token that starts with white space."""
        data = np.frombuffer(raw, np.uint8)
        blanks = np.concatenate(([0], np.cumsum(_SPACE[data])))
        safe = np.zeros(len(data), bool)
        safe[:] = _PLAIN[data]
        safe[1:] |= _HIGH[data[1:]] & _LEAD2[data[:-1]]
        plain = ((data[starts] == 32) | (data[starts] == 10)) & (blanks[ends] - blanks[starts] == 1) & (ends - starts > 1) & safe[ends - 1]
        inner = np.flatnonzero(plain)
        lengths = np.zeros(len(starts), np.int64)
        parts = []
        pieces = [raw[a:b] for a, b in zip(starts[inner].tolist(), ends[inner].tolist())]
        runs = [b"".join(pieces[i : i + RUN]).decode("utf-8", "replace") for i in range(0, len(pieces), RUN)]
        ids, _ = self._each(runs)
        head = np.flatnonzero(self.blank[ids])
        if len(head) != len(inner):
            raise ValueError("chunks of a run can't be told apart")
        lengths[inner] = np.diff(np.append(head, len(ids)))
        parts.append(ids)
        rest = np.flatnonzero(~plain)
        ids, lengths[rest] = self._each([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])
        parts.append(ids)
        # back to the order of the chunks
        order = np.concatenate((inner, rest))
        place = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        out = np.empty(int(lengths.sum()), np.int32)
        n = lengths[order]
        out[np.repeat(place[order] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(len(out))] = np.concatenate(parts)
        return out, lengths

    def _remember(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > POOL * self.slots:
            self.keys[:] = 0
            self.used = 0
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        first = self.used
        self.pool[first : first + len(ids)] = ids
        self.used += len(ids)
        return first

    def block(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each row)."""
        rows = len(offsets) - 1
        starts = self._starts(offsets, data)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, side="right") - 1
        h = hash_spans(data, starts, ends, fold=False)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        hit = self.keys[slot] == h
        at = self.at[slot].astype(np.int64)
        length = self.length[slot].astype(np.int64)
        pool = self.pool
        if not hit.all():
            miss = np.flatnonzero(~hit)
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[one]
            ids, lengths = self._encode(data.tobytes(), starts[new], ends[new])
            first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            pool = np.concatenate((pool[: self.used], ids))
            base = self.used
            at[miss] = base + first[back]
            length[miss] = lengths[back]
            short = np.flatnonzero(ends[new] - starts[new] <= REMEMBERED_BYTES)
            taken = np.repeat(first[short] - np.concatenate(([0], np.cumsum(lengths[short])))[:-1], lengths[short]) + np.arange(int(lengths[short].sum()))
            at_first = self._remember(ids[taken])
            place = slot[new[short]]
            self.keys[place] = h[new[short]]
            self.length[place] = lengths[short]
            self.at[place] = at_first + np.concatenate(([0], np.cumsum(lengths[short])))[:-1]
        before = np.concatenate(([0], np.cumsum(length)))
        out = pool[np.repeat(at - before[:-1], length) + np.arange(int(before[-1]))]
        return out, np.bincount(row, weights=length, minlength=rows).astype(np.int64)


def byte_entries(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes, in order, for
    the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    names = tokenizer.get_vocab()
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(of[c] for c in name)
    return out


def ended_rows(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to every row; (ids, row boundaries)."""
    bounds = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.empty(int(bounds[-1]), np.int32)
    out[bounds[1:] - 1] = end_id
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def encoded(batches: Iterator, position: int, query: str, vocabulary: str, end_id: int):
    """(first row, batch, ids with end ids, row boundaries) of every block of a stream of Arrow batches."""
    from factrail.llm.blocks import text_blocks

    encoder = Encoder.of(query, vocabulary)
    for batch in batches:
        for lo, offsets, data in text_blocks(batch.column(position)):
            ids, bounds = ended_rows(*encoder.block(offsets, data), end_id)
            yield lo, batch, ids, bounds
