"""Token-ID output: whole corpora as Re-Pair compressed id shards, with random access.

``write_token_files`` encodes every text, ends each with ``end_id`` and stores ids in ascending id
order.  A shard is a byte string of whole documents (below); shards are rows of a Parquet table, so
Spark's committer makes them whole or absent and any store that Spark writes will do.

Re-Pair by rounds: a round counts all neighbouring id pairs of the shard, gives the frequent ones
nonterminals and replaces their occurrences, where two overlap the more frequent; then the next round
counts again, until no pair is frequent.  No rule crosses a document's end.  A rule is stored as its
two symbols and the length of its expansion, so a reader finds any token by running sums and expands
only what it needs.

Shard layout, little-endian: magic ``VRP2``; nine uint32: bits of a symbol (16 at least), documents,
first nonterminal, rules, rounds, symbols, has-null flag, tokens, 0; then rules of each round (uint32),
left and right symbols of the rules (as symbols below), expansion lengths (uint32), document ids (int64), null
marks (uint8, only with the flag), symbols before each document (uint32, one more than documents),
tokens of each document (uint32), symbols: the low 16 bits of all, then each higher bit of all.

Encoding meets each distinct piece once per Python worker (64-bit hashes, at most ``CACHE`` pieces
kept): the tokenizer drops white space and never joins across it, so the pieces' ids in order are
those of the whole text.  Where a probe shows that it also parts ASCII letters and digits from
punctuation, and ignores case, pieces end there and fold A-Z.  Slices that hold one of its special
tokens are cut at white space alone.  Pieces of letters up to U+00FF go straight to the tokenizer's
model, where probes show that all else leaves them as they are but for case.  A tokenizer that keeps
white space needs ``whole=True``.

Defined cases: null and empty texts give just the end id; a null id sorts first; rows of equal ids
are ordered by a hash of the text; repeated rows are each written; an empty table gives no rows; a
text longer than a shard has a shard of its own.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .scratch import bounded

SHARD_TOKENS = 1 << 20
CACHE = 1_500_000
#: A pair becomes a rule where it has so many uses: a rule is stored in 8 bytes, a use spares 2.
LEAST_USES = 8
_HEAD = struct.Struct("<4s9I")
#: ASCII letters and digits 1, ASCII punctuation but the apostrophe 2, all else 0.
_CLASS = bytes([1 if chr(i).isalnum() else 2 if 0x20 < i < 0x7F and chr(i) != "'" else 0 for i in range(128)] + [0] * 128)
#: 0 for the bytes of letters up to U+00FF, whose only lead byte is C3 (signs U+00D7 and U+00F7 left out), and these letters in lower case.
_ODD = np.array([not (chr(i).isalpha() if i < 0x80 else i == 0xC3 or i < 0xC0 and i not in (0x97, 0xB7)) for i in range(256)], np.int64)
_LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A or 0x80 <= i <= 0x9E else i for i in range(256))


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + length[i] - 1 of all i, one after another."""
    total = np.cumsum(length)
    return np.repeat(start - (total - length), length) + np.arange(int(total[-1]) if len(total) else 0)


@dataclass
class Grammar:
    seq: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sizes: list[int]
    first: int


def _by_key(key: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the keys, of ``bits`` bits, sorted; their places ``at``; where each key starts among them, and their end)."""
    low = int(at.max()).bit_length()
    if bits + low <= 64:  # key and place in one number: numbers sort several times faster than places
        both = np.sort((key << np.uint64(low)) | at.view(np.uint64))
        key, at = both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).view(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, at = key.take(order), at.take(order)
    return key, at, np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


class _Rules:
    """The rules so far; what a round does wherever its pairs stand."""

    def __init__(self, first: int, least: int):
        self.left, self.right, self.sizes, self.free, self.least = [], [], [], first, least

    def ranks(self, at: np.ndarray, x: np.ndarray, y: np.ndarray, follows, rank: np.ndarray) -> np.ndarray:
        """Sets the rank of all places ``at``, of pairs (x, y): 0 where a pair is rare.  The places that don't count.

        The most frequent pair has the highest rank.  Equals are in no order, else along a repeated passage
        just one pair a round would be highest.
        """
        self.width = self.free.bit_length()
        key = (x.astype(np.uint64) << np.uint64(self.width)) | y
        none = np.uint64((1 << 2 * self.width) - 1)  # no symbol has all bits
        # of a run of one symbol every other place counts
        spare = same = np.flatnonzero(x == y)
        if len(same):
            run = at[same]
            place = np.arange(len(run))
            head = np.concatenate(([True], run[1:] != follows(run[:-1])))
            odd = (place - np.maximum.accumulate(np.where(head, place, 0))) & 1 == 1
            spare = run[odd]
            key[same[odd]] = none
        key, at, start = _by_key(key, at, 2 * self.width)
        count = np.diff(start)
        uses = count.copy()
        if len(spare):
            uses[-1] = 0
        often = np.flatnonzero(uses >= self.least)
        by = (uses[often].astype(np.uint64) << np.uint64(32)) | ((often.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))
        often = often[np.argsort(by)]
        mine = np.zeros(len(uses), np.int32)
        mine[often] = np.arange(1, len(often) + 1)
        rank[at] = np.repeat(mine, count)
        self.pairs = key[start[often]]
        return spare

    def add(self, ranks: np.ndarray) -> np.ndarray:
        """New symbols for the ranks of the places to replace; 0 where too few have a rank."""
        chosen = np.flatnonzero(np.bincount(ranks, minlength=len(self.pairs) + 1) >= self.least)
        symbol = np.zeros(len(self.pairs) + 1, np.uint32)
        symbol[chosen] = np.arange(self.free, self.free + len(chosen), dtype=np.uint32)
        pairs = self.pairs[chosen - 1]
        self.left.append((pairs >> np.uint64(self.width)).astype(np.uint32))
        self.right.append((pairs & np.uint64((1 << self.width) - 1)).astype(np.uint32))
        self.sizes.append(len(chosen))
        self.free += len(chosen)
        return symbol.take(ranks)


def re_pair(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST_USES) -> Grammar:
    """ids: tokens; ends: marks of the documents' last tokens; first: the first free symbol.

    Goes on until no pair has ``least`` occurrences that don't overlap.  Counts of pairs without a new
    symbol only fall, so a round looks at what stands beside a new symbol and at what was frequent before.
    While that is much, what a round replaces is closed up; then symbols are linked.
    """
    rules = _Rules(first, least)
    seq, last = ids.astype(np.uint32), ends.astype(bool)
    last[-1:] = True
    at = np.flatnonzero(~last)
    while 8 * len(at) > len(seq):
        rank = np.zeros(len(seq) + 2, np.int32)
        own = rank[1:-1]
        spare = rules.ranks(at, seq.take(at), seq.take(at + 1), lambda i: i + 1, own)
        if not len(rules.pairs):
            at = at[:0]
            break
        best = np.flatnonzero((own > rank[:-2]) & (own > rank[2:]))
        new = rules.add(own.take(best))
        some = np.flatnonzero(new)
        best, new = best[some], new[some]
        seq[best] = new
        last[best] = last[best + 1]
        look = own > 0
        look[spare] = True
        alive = np.ones(len(seq), bool)
        alive[best + 1] = False
        rest = np.flatnonzero(alive)
        seq, last, look = seq.take(rest), last.take(rest), look.take(rest)
        place = best - np.arange(len(best))
        look[place] = True
        look[np.maximum(place - 1, 0)] = True
        at = np.flatnonzero(look & ~last)

    n = len(seq)
    none = n  # the place before the first and after the last symbol of a document
    seq = np.append(seq, np.uint32(0))
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    edge = np.flatnonzero(last)
    after[edge] = after[n] = none
    before = np.append(before, none)
    before[0] = before[edge + 1] = none
    rank, alive = np.zeros(n + 1, np.int32), np.ones(n + 1, bool)
    alive[none] = False
    while len(at):
        other = after.take(at)
        spare = rules.ranks(at, seq.take(at), seq.take(other), after.take, rank)
        if not len(rules.pairs):
            break
        mine = rank.take(at)
        best = np.flatnonzero((mine > rank.take(before.take(at))) & (mine > rank.take(other)))
        rank[at] = 0
        new = rules.add(mine.take(best))
        some = np.flatnonzero(new)
        best, new = best[some], new[some]
        place, gone = at[best], other[best]
        seq[place] = new
        alive[gone] = False
        far = after[gone]
        after[place], before[far] = far, place
        before[none] = none
        at = np.sort(np.concatenate((at[mine > 0], spare, place, before.take(place))))
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        at = at[alive.take(at) & (after.take(at) != none)]
    empty = [np.zeros(0, np.uint32)]
    return Grammar(seq[alive], np.concatenate(rules.left or empty), np.concatenate(rules.right or empty), rules.sizes, first)


def expansions(first: int, left: np.ndarray, right: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, start, length): symbol s stands for flat[start[s] : start[s] + length[s]]."""
    start, length = np.arange(first + len(left)), np.ones(first + len(left), np.int64)
    flat, done = np.arange(first, dtype=np.uint32), 0
    for n in sizes:  # rules of a round use symbols of earlier rounds only
        a, b = left[done : done + n].astype(np.int64), right[done : done + n].astype(np.int64)
        both = np.stack([a, b], axis=1).ravel()
        new = flat[_spread(start[both], length[both])]
        own = slice(first + done, first + done + n)
        length[own] = length[a] + length[b]
        start[own] = len(flat) + np.cumsum(length[own]) - length[own]
        flat = np.concatenate([flat, new])
        done += n
    return flat, start, length


def _pack_symbols(seq: np.ndarray, bits: int) -> bytes:
    return b"".join([seq.astype("<u2").tobytes(), *(np.packbits((seq >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(16, bits))])


def _unpack_symbols(blob: memoryview, n: int, bits: int) -> np.ndarray:
    seq, pos, plane = np.frombuffer(blob, "<u2", n).astype(np.uint32), 2 * n, -(-n // 8)
    for b in range(16, bits):
        seq |= np.unpackbits(np.frombuffer(blob, np.uint8, plane, pos), count=n).astype(np.uint32) << np.uint32(b)
        pos += plane
    return seq


def pack_shard(ids: np.ndarray, n_tokens: np.ndarray, doc_ids: list, vocabulary: int, **options) -> bytes:
    """The shard of these documents: ``ids`` of all, ``n_tokens`` of each."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(n_tokens) - 1] = True
    g = re_pair(ids, ends, vocabulary, **options)
    _, _, length = expansions(g.first, g.left, g.right, g.sizes)
    per = length[g.seq]
    # symbols before each document: its first token starts a symbol
    at = np.searchsorted(np.cumsum(per), np.concatenate(([0], np.cumsum(n_tokens))), side="right") if len(g.seq) else np.zeros(len(n_tokens) + 1)
    at[0], at[-1] = 0, len(g.seq)
    bits = max(16, (g.first + len(g.left) - 1).bit_length())
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    parts = [_HEAD.pack(b"VRP2", bits, len(doc_ids), g.first, len(g.left), len(g.sizes), len(g.seq), int(nulls.any()), len(ids), 0)]
    parts += [np.array(g.sizes, "<u4").tobytes(), _pack_symbols(g.left, bits), _pack_symbols(g.right, bits), length[g.first :].astype("<u4").tobytes()]
    parts += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls.tobytes() if nulls.any() else b""]
    parts += [at.astype("<u4").tobytes(), np.asarray(n_tokens).astype("<u4").tobytes(), _pack_symbols(g.seq, bits)]
    return b"".join(parts)


class Shard:
    """A packed shard, opened for reading."""

    def __init__(self, blob: bytes):
        magic, bits, docs, self.first, rules, rounds, symbols, nulls, self.n, _ = _HEAD.unpack_from(blob)
        if magic != b"VRP2":
            raise ValueError("not a token shard")
        pos = _HEAD.size

        def take(dtype, count):
            nonlocal pos
            out = np.frombuffer(blob, dtype, count, pos)
            pos += out.nbytes
            return out

        def symbol_run(count):
            nonlocal pos
            out = _unpack_symbols(memoryview(blob)[pos:], count, bits)
            pos += 2 * count + (bits - 16) * -(-count // 8)
            return out

        self.sizes = take("<u4", rounds).tolist()
        self.left, self.right = symbol_run(rules), symbol_run(rules)
        self.length = np.concatenate([np.ones(self.first, np.int64), take("<u4", rules)])
        ids = take("<i8", docs).tolist()
        empty = take("u1", docs) if nulls else np.zeros(docs, np.uint8)
        self.doc_ids = [None if e else i for i, e in zip(ids, empty)]
        self.at, self.n_tokens = take("<u4", docs + 1), take("<u4", docs)
        self.seq = symbol_run(symbols)
        self._flat = None

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids that the symbols a .. b - 1 stand for."""
        if self._flat is None:
            self._flat = expansions(self.first, self.left, self.right, self.sizes)
        flat, start, length = self._flat
        s = self.seq[a:b]
        return flat[_spread(start[s], length[s])]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.at[i]), int(self.at[i + 1]))

    def window(self, i: int, start: int, stop: int) -> np.ndarray:
        """Tokens start .. stop - 1 of document i; expands only the symbols that hold them."""
        a, b = int(self.at[i]), int(self.at[i + 1])
        total = np.concatenate(([0], np.cumsum(self.length[self.seq[a:b]])))
        x = max(0, int(np.searchsorted(total, start, side="right")) - 1)
        y = int(np.searchsorted(total, stop, side="left"))
        return self.tokens(a + x, a + y)[start - total[x] : stop - total[x]]


class _Slots:
    """64-bit keys -> their numbers in order of addition, by open addressing; all lookups of a call at once."""

    def __init__(self):
        self.n, self.bits = 0, 16
        self.keys, self.slot = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where absent.  Keys are not 0."""
        mask = np.uint64(len(self.keys) - 1)
        cell = (keys & mask).astype(np.intp)
        there = self.keys.take(cell)
        out = np.where(there == keys, self.slot.take(cell), np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        cell = cell[left]
        while len(left):
            cell = (cell + 1) & int(mask)
            there = self.keys.take(cell)
            hit = there == keys[left]
            out[left[hit]] = self.slot.take(cell[hit])
            on = np.flatnonzero(~hit & (there != 0))
            left, cell = left[on], cell[on]
        return out

    def _put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        cell, left = (keys & np.uint64(len(self.keys) - 1)).astype(np.intp), np.arange(len(keys))
        while len(left):
            free = self.keys[cell] == 0
            self.keys[cell[free]] = keys[left[free]]
            mine = self.keys[cell] == keys[left]  # of several that want a cell one has got it
            self.slot[cell[mine]] = slots[left[mine]]
            left, cell = left[~mine], (cell[~mine] + 1) & (len(self.keys) - 1)

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys, none there yet."""
        if 5 * (self.n + len(keys)) > 2 * len(self.keys):
            held = np.flatnonzero(self.keys)
            old, slots = self.keys[held], self.slot[held]
            while 5 * (self.n + len(keys)) > 2 * len(self.keys):
                self.bits += 1
                self.keys = np.zeros(1 << self.bits, np.uint64)
            self.slot = np.zeros(1 << self.bits, np.int32)
            self._put(old, slots)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)


class Encoder:
    """Ids of a slice's documents, through a cache of pieces."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary = max(vocabulary.values()) + 1
        # ids that end a run of letters, where the vocabulary marks them
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.vocabulary, bool)
        for token, i in vocabulary.items():
            self.closes[i] = bool(suffix) and token.endswith(suffix)
        # a piece of one id that no other piece has, to part many pieces in one text
        mark, plain = self._plain("\x01"), self._plain("ab cd!")
        self.mark = mark[0] if len(mark) == 1 and self._plain("ab cd! \x01 \x01 ab cd!") == plain + mark * 2 + plain else None
        plain = self._plain
        self.fold = plain("ABcD Ef") == plain("abcd ef")
        self.cuts = all(plain(a + b) == plain(a) + plain(b) for a, b in (("ab", ".,"), ("(", "cd"), ("a7", "-"), ("$", "9"), ("x", "|"), ("<", "i")))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model behind a plain split at blanks, for words of lower-case letters up to U+00FF, which the
        # full tokenizer leaves as they are; only where all letters and many words show that it does
        self.short = Tokenizer.from_str(tokenizer_json)
        self.short.normalizer = normalizers.Sequence([])
        self.short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [*"abcdefghijklmnopqrstuvwxyz", *(chr(i) for i in range(0xDF, 0x100) if i != 0xF7)]
        probe = letters + [x + y for x in letters for y in letters] + ["".join(letters[i * k % len(letters)] for i in range(2, 12)) for k in range(1, 200)]
        lower = " ".join(probe)
        upper = "".join(chr(ord(c) - 32) if c not in " ßÿ" else c for c in lower)
        self.plain = bool(suffix) and self.fold and self._plain(lower) == self._plain(upper) == self._short(lower) and int(self.closes[self._short(lower)].sum()) == len(probe)
        self._clear()

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _short(self, text: str) -> list[int]:
        return self.short.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self):
        self.slots = _Slots()
        self.flat, self.start, self.length, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def _letters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many of each), of words of letters."""
        n = ends - starts + 1
        at = np.cumsum(n) - 1
        text = np.full(int(n.sum()), 32, np.uint8)
        inside = np.ones(len(text), bool)
        inside[at] = False
        text[inside] = data[_spread(starts, n - 1)]
        ids = np.array(self._short(text.tobytes().translate(_LOWER).decode()), np.uint32)
        return ids, np.diff(np.concatenate(([-1], np.flatnonzero(self.closes[ids]))))

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many of each)."""
        text = " \x01 ".join(pieces)
        if self.mark is not None and text.count("\x01") == len(pieces) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(pieces) - 1:
                return ids[ids != self.mark], np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.concatenate([np.array(x, np.uint32) for x in got]), np.array([len(x) for x in got])

    def _add(self, keys: np.ndarray, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, words: bool) -> None:
        size = ends - starts
        first = np.cumsum(size) - size
        # pieces of letters alone
        odd = np.add.reduceat(_ODD[data[_spread(starts, size)]], first) if words and self.plain else np.ones(len(keys))
        for kind in (True, False):
            own = np.flatnonzero((odd == 0) == kind)
            for part in np.split(own, range(5_000, len(own), 5_000)) if len(own) else ():
                a, b = starts[part], ends[part]
                if kind:
                    new, n = self._letters(data, a, b)
                else:
                    new, n = self._ids([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist())])
                k, total = self.slots.n, len(new)
                while self.used + total > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                while k + len(n) > len(self.start):
                    self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
                self.flat[self.used : self.used + total] = new
                self.start[k : k + len(n)] = self.used + np.cumsum(n) - n
                self.length[k : k + len(n)] = n
                self.slots.add(keys[part])
                self.used += total

    def encode(self, off: np.ndarray, data: np.ndarray, end_id: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each ended by ``end_id``; how many of each)."""
        docs = len(off) - 1
        if whole:
            texts = [data[a:b].tobytes().decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            got = [np.array([*e.ids, end_id], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(got), np.array([len(x) for x in got])
        if self.slots.n > CACHE:
            self._clear()
        raw, cut = data.tobytes(), None
        free = not any(x in raw for x in self.special)
        if free and self.cuts:
            kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
            cut = np.concatenate(([False], (kind[1:] ^ kind[:-1]) == 3))
        w = tb.words(off, data, tb.NOT_SPACE, tb.FOLDED if free and self.fold else tb.EXACT, cut)
        keys = w.hashes | np.uint64(1)  # not 0, at the cost of one bit
        slot = self.slots.find(keys)
        far = np.flatnonzero(slot < 0)
        if len(far):
            missing, at = np.unique(keys[far], return_index=True)
            at = far[at]
            self._add(missing, data, raw, w.starts[at], w.ends[at], free)
            slot[far] = self.slots.find(keys[far])
        n = self.length.take(slot)
        ids = self.flat.take(_spread(self.start.take(slot), n))
        before = np.concatenate(([0], np.cumsum(n)))[w.first]
        count = np.diff(before) + 1
        out = np.full(len(ids) + docs, end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(count) - 1] = False
        out[inside] = ids
        return out, count


_ENCODERS: dict[int, Encoder] = {}


def _write(tokenizer_json, end_id: int, shard_tokens: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.keep()
        text = tokenizer_json.value
        key = zlib.crc32(text.encode())
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(text)
        enc, part = _ENCODERS[key], TaskContext.get().partitionId()
        shard, start, held, ids, counts, names = 0, 0, 0, [], [], []

        def flush():
            nonlocal shard, start, held, ids, counts, names
            all_ids, n = np.concatenate(ids), np.concatenate(counts)
            row = [[part], [shard], [names[0]], [len(names)], [start], [len(all_ids)], [pack_shard(all_ids, n, names, enc.vocabulary)]]
            shard, start, held, ids, counts, names = shard + 1, start + len(all_ids), 0, [], [], []
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "shard", "first_doc", "n_docs", "start", "n_tokens", "data"])

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for i, j, off, data in tb.slices(batch.column(1), tb.SLICE_BYTES // 2):
                got, n = enc.encode(off, data, end_id, whole)
                ids.append(got)
                counts.append(n)
                names.extend(rows[i:j])
                held += len(got)
                if held >= shard_tokens:
                    yield flush()
        if names:
            yield flush()
        tb.release()

    return run


_SCHEMA = "part int, shard int, first_doc long, n_docs int, start long, n_tokens long, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write shards to ``path``, in ascending id order within and across parts."""
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the corpus
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    rows.mapInArrow(_write(tokenizer, end_id, shard_tokens, whole), _SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _read(offsets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.keep()
        for batch in batches:
            for part, start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = Shard(blob.as_buffer())
                raw = memoryview(np.ascontiguousarray(s.tokens(0, len(s.seq)), "<u4")).cast("B")
                n = s.n_tokens.astype(np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(at + start + offsets.value[part]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        tb.release()

    return run


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, all decoded from the shards."""
    files = bounded(spark).read.schema(_SCHEMA).parquet(path)
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one number for each write task
    offsets, run = {}, 0
    for part in sorted(totals):
        offsets[part] = run
        run += totals[part]
    return files.select("part", "start", "data").mapInArrow(_read(spark.sparkContext.broadcast(offsets)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            s = Shard(blob.as_buffer())
            for i, doc in enumerate(s.doc_ids):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([s.document(i).astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return spark.read.schema(_SCHEMA).parquet(path).select("data").mapInArrow(_ids, "doc_id long, ids array<int>")
