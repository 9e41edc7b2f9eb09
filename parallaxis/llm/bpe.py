"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

The words (pieces of the pre-tokenizer's pattern) of all documents are counted, pre-aggregated in each task.
The most frequent ones are merged once, on the driver, and compiled into a minimal acyclic automaton that
shares prefixes and suffixes; the outputs on its arcs add up to the word's number, under which its ids are
stored. The file is sent to every executor with SparkContext.addFile and memory-mapped there, so its pages
are shared by an executor's workers. Words that it lacks are merged exactly. Which words are in the lexicon
changes the time, never the ids.

Null texts count as empty: no ids, and decoding gives the empty text. Very long pieces are merged with a heap
(n log n). Repeated rows each get their row, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import contextlib
import gc
import heapq
import json
import mmap
import os
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, pick, resident, text_batches, written

#: Words in the lexicon, most frequent first; a bound on what is collected and sent.
LEXICON_WORDS = 40_000
#: Longer words stay out of the lexicon.
LEXICON_WORD_BYTES = 64
#: A task adds up the counts of its runs of texts when they have so many pieces, and passes them on if half as many are different;
#: a worker's memos have at most so many entries.
COUNTED_AT_ONCE, MEMO_WORDS, MEMO_CHUNKS = 800_000, 150_000, 400_000

#: Fixed value: the pre-tokenizer's pattern for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space of Python or of the pattern, as RE2 (Arrow's regular expressions) has it in a class.
SPACE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]"
#: A space next to other white space.
ODD_SPACE = f" {SPACE}|{SPACE} "
#: Chunks that are sure to be one piece of the pattern with the space before them: letters of old blocks only.
ONE_WORD = r"\A[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha()) + r"]+\z"


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable, else a character from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            table[chr(extra)] = b
            extra += 1
    return table


def flat(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words in a row, and where each one's begin and end."""
    _, ends, raw = words.buffers()
    at = np.frombuffer(ends, dtype=np.int64, count=len(words) + 1, offset=8 * words.offset) if len(words) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def listed(values: pa.Array | pa.ChunkedArray) -> list:
    """The same as to_pylist(), in a fraction of its time."""
    return values.to_numpy(zero_copy_only=False).tolist() if isinstance(values, pa.Array) else values.to_numpy().tolist()


class PairTable:
    """Ranks of pairs of ids for whole arrays: two hash tables, each key in one of them (cuckoo hashing)."""

    BITS = 17
    MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, rank: dict[int, int], none: int):
        bits = max(self.BITS, len(rank).bit_length() + 1)
        self.shift, self.none = np.uint64(64 - bits), none
        self.keys = np.full((2, 1 << bits), np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ranks = np.full((2, 1 << bits), none, dtype=np.int32)
        every = np.fromiter(rank, dtype=np.uint64, count=len(rank))
        value = np.fromiter(rank.values(), dtype=np.int64, count=len(rank))
        at = [self._place(every, t).tolist() for t in (0, 1)]
        holder: list[dict[int, int]] = [{}, {}]
        for i in range(len(every)):
            side = 0
            for _ in range(500):
                out = holder[side].get(at[side][i])
                holder[side][at[side][i]] = i
                if out is None:
                    break
                i, side = out, 1 - side
            else:
                raise ValueError("the pairs can't be placed")
        for t in (0, 1):
            places, rows = np.array(list(holder[t]), dtype=np.int64), np.array(list(holder[t].values()), dtype=np.int64)
            self.keys[t, places], self.ranks[t, places] = every[rows], value[rows]

    def _place(self, keys: np.ndarray, t: int) -> np.ndarray:
        return ((keys * self.MULTIPLIERS[t]) >> self.shift).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        h = self._place(keys, 0)
        out = np.where(self.keys[0, h] == keys, self.ranks[0, h], self.none)
        h = self._place(keys, 1)
        return np.where(self.keys[1, h] == keys, self.ranks[1, h], out)


class ByteBpe:
    """Merges and ids out of a tokenizer file."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, back = spec["model"], _byte_chars()
        raw = lambda token: bytes(back[c] for c in token)
        vocab = {t: i for t, i in model["vocab"].items()}
        self.token = {i: raw(t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.byte = [0] * 256
        for t, i in vocab.items():
            if len(t) == 1:
                self.byte[back[t]] = i
        #: Rank of a pair of ids, packed into one int; id that a merge of that rank makes.
        self.rank, self.made = {}, []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[(vocab[a] << 32) | vocab[b]] = r
            self.made.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: PairTable | None = None
        self.token_bytes: pa.Array | None = None
        self.table = [self.token.get(i, b"") for i in range(max(self.token) + 1)]

    def merge(self, word: bytes) -> list[int]:
        ids = [self.byte[b] for b in word]
        if len(ids) > 100:
            return self._merge_long(ids)
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank((a << 32) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i, new = ranks.index(best), made[best]
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1] << 32) | new, none)
            if i < len(ranks):
                ranks[i] = rank((new << 32) | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank, made = len(ids), self.rank.get, self.made
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j, new = after[i], made[best]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank((new << 32) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[after[i]]))
            if (p := before[i]) >= 0 and (r := rank((ids[p] << 32) | new)) is not None:
                heapq.heappush(heap, (r, p, ids[p], new))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def merge_many(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's begin and end), none empty. Each round merges the first best pair of
        every word that still has one, so it is the same as merge() for each of them."""
        if self.pairs is None:
            self.pairs, self.byte_ids, self.made_ids = PairTable(self.rank, len(self.made)), np.array(self.byte, dtype=np.int32), np.array([*self.made, -1], dtype=np.int32)
            every = np.arange(1 << 16)
            self.byte_ranks = self.pairs.of(self.byte_ids[every >> 8], self.byte_ids[every & 255])
        raw, at = flat(words)
        lengths, none = np.diff(at), len(self.made)
        ids, owner = self.byte_ids[raw], np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        rank = np.full(len(ids), none, dtype=np.int32)
        rank[:-1] = self.byte_ranks[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        rank[at[1:] - 1] = none
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths, least = np.diff(np.r_[starts, len(ids)]), np.minimum.reduceat(rank, starts)
            best = np.repeat(least, lengths)
            over = best == none
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
            hit = np.flatnonzero((rank == best) & ~over)
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]] if len(hit) else hit
            ids[hit] = self.made_ids[best[hit]]
            over[hit + 1] = True  # with the words that are done, the second halves go
            kept = np.flatnonzero(~over)
            at = np.searchsorted(kept, hit)  # where the merged pairs are then
            ids, owner, rank = ids[kept], owner[kept], rank[kept]
            for i in (at, at - 1):
                i = i[(i >= 0) & (i + 1 < len(ids))]
                same = owner[i] == owner[i + 1]
                rank[i[~same]] = none
                i = i[same]
                rank[i] = self.pairs.of(ids[i], ids[i + 1])
            if len(rank):
                rank[-1] = none
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        by = np.argsort(owner, kind="stable")
        return ids[by].astype(np.int32), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]

    def parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id, "") of a special token or (None, text), in the order of the text."""
        if self.at_special is None or not any(s in text for s in self.special):
            yield None, text
            return
        for k, piece in enumerate(self.at_special.split(text)):
            if k % 2:
                yield self.special[piece], ""
            elif piece:
                yield None, piece

    def plain(self, texts: pa.Array) -> pa.Array:
        """Whether a text may be cut at its spaces: if it has no special token and no space next to other white space.

        No piece of the pattern goes on across a space that has no white space beside it, and none looks back, so the
        text's pieces are those of its first chunk and of every other one with a space before it."""
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        return pc.invert(odd)

    def cut(self, texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray]:
        """Of each text its head: the first chunk, or all of one that isn't plain; the other chunks of all texts; and where
        chunks of each text, its head with them, begin and end, and which of them are heads."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = self.plain(texts)
        parts = pc.split_pattern(pc.if_else(plain, texts, ""), " ")
        chunks, at = parts.flatten(), np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))]
        head = np.zeros(len(chunks), dtype=bool)
        head[at[:-1]] = True
        heads = listed(pc.if_else(plain, chunks.filter(pa.array(head)), texts))
        return heads, chunks.filter(pa.array(~head)), at, head

    def texts_of(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts whose ids begin and end at such places, made from the ids alone: their tokens' bytes in a row."""
        if self.token_bytes is None:
            self.token_bytes = pa.array(self.table, pa.large_binary())
        raw, ends = flat(self.token_bytes.take(pa.array(ids)))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends[at]), pa.py_buffer(raw)])
        try:
            return found.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no characters
            return pa.array([t.decode("utf-8", "replace") for t in found.to_pylist()], pa.string())

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def build_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The file of a minimal acyclic transducer from words to their ids.

    Words are added in byte order; when a word leaves a branch, the branch's states are final and each is
    replaced by an equal state that exists already (equal: same finality and arcs). An arc's output is the
    number of words that come before those behind it, so a word's outputs add up to its place in order.
    """
    order = sorted(words)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the last word: finality, frozen arcs
    last = b""

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    def cut(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(state)))

    for word in order:
        same = len(os.path.commonprefix([word, last]))
        cut(same)
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        last = word
    cut(0)
    root = freeze(path[0])
    behind = []  # words behind each state; arcs only lead to states that were frozen before
    for final, arcs in frozen:
        behind.append(final + sum(behind[t] for _, t in arcs))
    start, label, target, output = [0], bytearray(), [], []
    for final, arcs in frozen:
        out = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            output.append(out)
            out += behind[t]
        start.append(len(label))
    ids_at = np.cumsum([0, *(len(words[w]) for w in order)])
    ids = [i for w in order for i in words[w]]
    arrays = [np.array(x, dtype="<u4") for x in (start, target, output, ids_at, ids)]
    final = bytes(f for f, _ in frozen)
    head = np.array([root, len(frozen), len(label), len(order), len(ids)], dtype="<u4").tobytes()
    return b"PXLEX\0\0\0" + head + b"".join(a.tobytes() for a in arrays) + final + bytes(label)


class Lexicon:
    """The transducer of build_lexicon over a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        self.root, states, arcs, self.words, n_ids = view[8:28].cast("I")
        at = 28
        found = []
        for n in (states + 1, arcs, arcs, self.words + 1, n_ids):
            found.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.start, self.target, self.output, self.ids_at, self.ids = found
        self.final, self.labels = at, at + states
        self.arcs: np.ndarray | None = None

    def find(self, word: bytes) -> list[int] | None:
        state, number, find, base = self.root, 0, self.map.find, self.labels
        for k in range(len(word)):
            arc = find(word[k : k + 1], base + self.start[state], base + self.start[state + 1]) - base
            if arc < 0:
                return None
            number += self.output[arc]
            state = self.target[arc]
        if not self.map[self.final + state]:
            return None
        return self.ids[self.ids_at[number] : self.ids_at[number + 1]].tolist()

    def packed(self, number: int) -> bytes:
        return self.ids[self.ids_at[number] : self.ids_at[number + 1]].tobytes()

    def find_many(self, words: list[bytes] | pa.LargeBinaryArray) -> np.ndarray:
        """The number of each word, -1 of those that aren't there: all words take a step at a time."""
        if self.arcs is None:
            start = np.array(self.start, dtype=np.int64)
            labels = np.frombuffer(self.map, dtype=np.uint8, count=len(self.target), offset=self.labels)
            self.arcs = np.repeat(np.arange(len(start) - 1), np.diff(start)) * 256 + labels
            self.to, self.out = np.array(self.target, dtype=np.int64), np.array(self.output, dtype=np.int64)
        found = np.full(len(words), -1)
        if not len(self.arcs) or not len(words):
            return found
        raw, at = flat(words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary()))
        lengths, at = np.diff(at), at[:-1]
        live, state, number = np.arange(len(words)), np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        finals = np.frombuffer(self.map, dtype=np.uint8, count=len(self.start) - 1, offset=self.final)
        for k in range(int(lengths.max()) + 1):
            ended = lengths[live] == k
            full = ended & (finals[state] == 1)
            found[live[full]] = number[full]
            live, state, number = live[~ended], state[~ended], number[~ended]
            if not len(live):
                break
            q = state * 256 + raw[at[live] + k]
            arc = np.minimum(np.searchsorted(self.arcs, q), len(self.arcs) - 1)
            ok = self.arcs[arc] == q
            live, state, number = live[ok], self.to[arc[ok]], number[ok] + self.out[arc[ok]]
        return found


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for reference cycles: the many small objects that are made here have none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Encoder:
    """Encodes texts with memos of words and of chunks (words with a space before them and what follows), both bounded:
    one that is full is emptied. What a run of texts has and the memos lack is looked up and merged all at once."""

    def __init__(self, bpe: ByteBpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _packed(self, words: pa.Array) -> list[bytes]:
        """Packed ids of words, from the lexicon or merged."""
        words = words.cast(pa.large_binary())
        size, out = pc.binary_length(words).to_numpy(), np.empty(len(words), dtype=object)
        short, long = np.flatnonzero(size <= LEXICON_WORD_BYTES), np.flatnonzero(size > LEXICON_WORD_BYTES)
        number = self.lexicon.find_many(words.take(pa.array(short)))
        known, rest = number >= 0, short[number < 0]
        out[short[known]] = list(map(self.lexicon.packed, number[known].tolist()))
        if len(rest):
            ids, at = self.bpe.merge_many(words.take(pa.array(rest)))
            data, at = ids.tobytes(), (4 * at).tolist()
            out[rest] = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        out[long] = [array("i", self.bpe.merge(w)).tobytes() for w in listed(words.take(pa.array(long)))]
        return out.tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and end)."""
        with uncollected():
            return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split, words = self.bpe.split, set()
        heads, others, at, head = self.bpe.cut(texts)
        plans = [[(special, split(part)) for special, part in self.bpe.parts(text)] for text in heads]
        for plan in plans:
            for _, pieces in plan:
                words.update(pieces)
        coded = others.dictionary_encode()
        chunks = listed(coded.dictionary)
        if len(self.chunks) + len(chunks) > MEMO_CHUNKS:
            self.chunks = {c: self.chunks[c] for c in chunks if c in self.chunks}
        new = [i for i, c in enumerate(chunks) if c not in self.chunks]
        asked = coded.dictionary.take(pa.array(new, pa.int64()))
        one = pc.match_substring_regex(asked, ONE_WORD)
        whole = asked.filter(one)
        pieces = {c: split(" " + c) for c in listed(asked.filter(pc.invert(one)))}
        for p in pieces.values():
            words.update(p)
        if len(self.words) + len(words) > MEMO_WORDS:
            self.words = {w: self.words[w] for w in words if w in self.words}
        fresh = list(words.difference(self.words))
        packed = self._packed(pa.concat_arrays([pa.array(fresh, pa.string()), pc.binary_join_element_wise("", whole, " ")]))
        self.words.update(zip(fresh, packed, strict=False))
        self.chunks.update(zip(listed(whole), packed[len(fresh) :], strict=True))
        word, chunk = self.words.__getitem__, self.chunks
        for c, p in pieces.items():
            chunk[c] = b"".join(map(word, p))
        values = list(map(chunk.__getitem__, chunks))
        for plan in plans:
            values.append(b"".join([array("i", [special]).tobytes() if special is not None else b"".join(map(word, p)) for special, p in plan]))
        place = np.empty(len(head), dtype=np.int64)
        place[head] = len(chunks) + np.arange(len(heads))
        place[~head] = coded.indices.to_numpy()
        raw, ends = flat(pa.array(values, pa.large_binary()).take(pa.array(place)))
        return raw.view(np.int32), ends[at] // 4


def _worker_bpe(file: str) -> ByteBpe:
    return resident(("bpe", hash(file)), lambda: ByteBpe(file))


def _worker_encoder(file: str, name: str) -> Encoder:
    return resident(("bpe", name), lambda: Encoder(ByteBpe(file), Lexicon(SparkFiles.get(name))))


def _runs(texts: pa.Array, most: int = 4 << 20) -> Iterator[slice]:
    """Slices of texts with about so many bytes each, or one text."""
    size = np.nan_to_num(np.array(pc.binary_length(texts), dtype=float))
    first, n = 0, 0.0
    for i, b in enumerate(size):
        n += b
        if n >= most:
            yield slice(first, i + 1)
            first, n = i + 1, 0.0
    if first < len(size):
        yield slice(first, len(size))


def added_up(counts: list[pa.Table]) -> pa.Table:
    """word, n: the sum of several such tables."""
    return pa.TableGroupBy(pa.concat_tables(counts), "word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def counted(batches: Iterable[pa.RecordBatch], bpe: ByteBpe) -> Iterator[pa.RecordBatch]:
    """word, n of the texts in the first column; a word has a row each time that counts are passed on."""
    seen, counts, size = Counter(), [], 0

    def passed_on() -> pa.Table:
        nonlocal counts, size
        chunks = added_up([pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), *counts])
        one = pc.match_substring_regex(chunks["word"], ONE_WORD)
        with uncollected():
            for chunk, n in zip(*map(listed, chunks.filter(pc.invert(one)).columns), strict=True):
                for word in bpe.split(" " + chunk):
                    seen[word] += n
        whole = chunks.filter(one)
        words = pa.table({"word": pc.binary_join_element_wise("", whole["word"], " "), "n": whole["n"]})
        others = pa.table({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        counts, size = [], 0
        return added_up([words, others]).combine_chunks()

    for batch in batches:
        for some in _runs(batch.column(0)):
            heads, others, _, _ = bpe.cut(batch.column(0)[some])
            with uncollected():
                for head in heads:
                    for special, part in bpe.parts(head):
                        if special is None:
                            seen.update(bpe.split(part))
            found = pc.value_counts(others)
            counts.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            size += len(found)
            if size + len(seen) > COUNTED_AT_ONCE:
                counts = [added_up(counts)]
                size = len(counts[0])
                if size + len(seen) > COUNTED_AT_ONCE // 2:
                    yield from passed_on().to_batches()
    yield from passed_on().to_batches()


def count_words(docs: DataFrame, tokenizer: str) -> DataFrame:
    """word, n over all documents. Every task adds up its own words before they are shuffled."""
    file = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted(batches, _worker_bpe(file.value))

    return text_batches(pick(docs, "text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def make_lexicon(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words, at most so many, and gives their file to all executors; returns its name there."""
    spark = docs.sparkSession
    # words seen once are no frequent ones; the others are few enough to write
    counted = written(count_words(docs, tokenizer).where((F.octet_length("word") <= LEXICON_WORD_BYTES) & (F.col("n") > 1)), "words")
    level = F.floor(F.log2("n") * 32)
    steps = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most 32 * 64 rows
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    frequent = [] if least is None else [r["word"].encode() for r in counted.where(level >= least).select("word").collect()]
    bpe = ByteBpe(tokenizer)
    data = build_lexicon({w: bpe.merge(w) for w in frequent})
    path = fresh_path(spark, "lexicon")  # in the shared folder; every executor gets its copy from there
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, lexicon: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and, if asked for, decoded: the text made from the ids alone.

    tokenizer: the content of the tokenizer's file; lexicon: what make_lexicon returned.
    """
    file = docs.sparkSession.sparkContext.broadcast(tokenizer)
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(file.value, lexicon)
        for batch in batches:
            for some in _runs(batch.column(1)):
                ids, at = encoder.encode(batch.column(1)[some])
                columns = {"doc_id": batch.column(0)[some], "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))}
                if decoded:
                    columns["decoded"] = encoder.bpe.texts_of(ids, at)
                yield pa.RecordBatch.from_pydict(columns)

    return text_batches(pick(docs, "doc_id", "text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text out of doc_id, ids. Null ids count as none."""
    file = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(file.value)
        for batch in batches:
            texts = [bpe.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded for all documents, with a lexicon of their own frequent words."""
    tokenizer = read_tokenizer(path)
    return encode(docs, tokenizer, make_lexicon(docs, tokenizer), decoded=True)


def digests(encoded: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the kept columns, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select(
        "doc_id",
        *kept,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
