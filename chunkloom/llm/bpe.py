"""BPE encoding by a tokenization automaton, decoding by its arc labels.

The automaton reads tokens; its state is the token read last. It starts as the universal automaton of the base symbols
(every symbol may follow every symbol) and takes the merges in order of priority. The gadget of a merge (a, b) -> ab

  1. copies the state of b as the state of ab (what may follow ab is what may follow b),
  2. takes the arc b away from the state of a (a then b is always written ab from here on),
  3. gives every state that has an arc a an arc ab (ab may stand wherever a may), if a had an arc b to take.

After the last merge a text has exactly one path, which is its BPE encoding. The arcs are a bit table, a bit row of
states for each token; tokens with equal arcs share a row until one of them loses an arc, so step 3 shares a row, step 2
copies a shared one, and step 1 copies one bit column.

A word is encoded by running the table over it from the left: for every end position there is exactly one token whose
arc leaves the state reached at its start. Texts are split into words a slice at a time by the classes of their
characters; each distinct word of a slice runs once, and a bounded table keeps words for the next slices.

The automaton is compiled once, on the driver, and broadcast (some 30 MB, whatever the input). What a worker holds besides
is bounded: WORDS words with their ids, and a few arrays for each slice.

Defined results: null text is the empty text, which has no tokens; an empty table gives an empty result; very long texts
are encoded whole, in pieces that end with a blank or a digit, where a word always ends; special tokens that stand in a
text become their ids, as in the library's default; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm._common import in_small_batches, slices, table, tidy

END = "</w>"
#: The characters that the library's patterns take as white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words kept with their ids, in each Python worker (some 40 bytes each).
WORDS = 300_000
#: Characters of text that are split at a time.
SLICE = 500_000
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_SAFE = re.compile(f"[0-9{_WHITE}]")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: Latin-1's visible characters stand for themselves, others are dealt from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def kinds_of_characters() -> np.ndarray:
    """For each code point whether it is white space, a letter, a number or something else."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        if (k := unicodedata.category(chr(c))[0]) == "L":
            out[c] = _LETTER
        elif k == "N":
            out[c] = _NUMBER
    out[list(map(ord, _WHITE))] = _SPACE
    return out


class TokenTable:
    """Symbol strings to tokens by sorted 64-bit polynomial hashes behind a bit filter; words that end a word hash a closing symbol too."""

    FILTER = 20
    STEP = np.uint64(0x9E3779B97F4A7C15)
    CLOSE = np.uint64(257)
    _ODD = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, tokens: list[str], symbols: list[str]):
        byte_of = {c: b for b, c in enumerate(symbols)}
        hashes = np.zeros(len(tokens), np.uint64)
        for k, t in enumerate(tokens):
            h = 0
            for c in t.removesuffix(END):
                h = (h * int(self.STEP) + byte_of[c] + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = (h * int(self.STEP) + int(self.CLOSE)) & 0xFFFFFFFFFFFFFFFF if t.endswith(END) else h
        self.tokens = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.tokens]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two tokens have one hash")
        self.maybe = np.zeros(1 << self.FILTER, bool)
        self.maybe[self._slot(hashes)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * self._ODD) >> np.uint64(64 - self.FILTER)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h that hold a token's hash, those tokens)"""
        at = np.flatnonzero(self.maybe[self._slot(h)])
        h = h[at]
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        right = self.hashes[place] == h
        return at[right], self.tokens[place[right]]


class Automaton:
    """Compiled merges. Tokens are numbered in the order in which they got their arcs (base symbols, then merges);
    `arcs` has a bit for each (row, state), tokens with equal arcs share a `row`, and tokens that end a word have no state."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        self.special = special
        made = dict.fromkeys(a + b for a, b in merges)
        if len(made) < len(merges):
            raise ValueError("two merges give one token: the automaton has a gadget for each token")
        base = [t for t in vocab if t not in made]
        tokens = [*base, *made]
        number = {t: k for k, t in enumerate(tokens)}
        self.ids = np.array([vocab[t] for t in tokens], np.int32)
        self.longest = max(len(t.removesuffix(END)) for t in tokens)
        self.state = np.full(len(tokens), -1, np.int32)
        goes_on = [k for k, t in enumerate(tokens) if not t.endswith(END)]
        self.state[goes_on] = np.arange(len(goes_on))
        self.start = len(goes_on)  # the state before the first token, which no arc leads to
        self._compile(len(base), [(number[a], number[b]) for a, b in merges])
        self.table = TokenTable(tokens, byte_symbols())
        self.kinds = kinds_of_characters()
        labels = [""] * (max((*vocab.values(), *special.values()), default=-1) + 1)
        for t, i in (*vocab.items(), *special.items()):
            labels[i] = t
        self.labels = pa.array([f"{t} ".encode() for t in labels], pa.binary())
        self.decimals = pa.array([b"%d " % i for i in range(len(labels))], pa.binary())

    def _compile(self, n_base: int, merges: list[tuple[int, int]]) -> None:
        state, width = self.state, self.start // 8 + 1
        first = np.append(state[:n_base][state[:n_base] >= 0], self.start)
        rows = np.zeros((1024, width), np.uint8)  # first the row of all base symbols, then the row without arcs
        np.bitwise_or.at(rows[0], first >> 3, (1 << (first & 7)).astype(np.uint8))
        row, sharing, used = np.zeros(len(state), np.int32), [n_base, 0], 2
        for n, (a, b) in enumerate(merges, n_base):
            if (s := int(state[n])) >= 0:
                sb = int(state[b])
                rows[:used, s >> 3] |= ((rows[:used, sb >> 3] >> (sb & 7)) & 1) << (s & 7)
            sa, of_b = int(state[a]), int(row[b])
            if not rows[of_b, sa >> 3] >> (sa & 7) & 1:  # a is never followed by b, and ab is never made
                row[n] = 1
                continue
            if sharing[of_b] > 1:
                if used == len(rows):
                    rows = np.concatenate((rows, np.zeros_like(rows)))
                rows[used] = rows[of_b]
                sharing[of_b] -= 1
                sharing.append(1)
                row[b] = of_b = used
                used += 1
            rows[of_b, sa >> 3] &= ~(1 << (sa & 7)) & 0xFF
            row[n] = row[a]
            sharing[row[a]] += 1
        self.row, self.arcs = row, rows[:used].copy()

    @classmethod
    def read(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, text: str) -> Automaton:
        d = json.loads(text)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        return cls(d["model"]["vocab"], merges, {t["content"]: t["id"] for t in d["added_tokens"]})

    def encode_long(self, word: bytes, block: int = 1 << 14) -> list[int]:
        """The one path over a long word: tokens are looked up for all places of a block together, arcs end by end."""
        n, table, state, row, arcs = len(word), self.table, self.state, self.row, self.arcs
        data = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        token, came = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        for low in range(0, n, block):
            high, first = min(n, low + block), max(0, low - self.longest + 1)
            h, starts, lengths, tokens = np.zeros(high - first, np.uint64), [], [], []
            with np.errstate(over="ignore"):
                for length in range(1, min(self.longest, high - first) + 1):
                    h = h[: high - first - length + 1] * table.STEP + data[first + length - 1 : high]
                    last = h[-1:] * table.STEP + table.CLOSE if high == n else h[-1:]  # a token at the word's end closes it
                    at, k = table.find(np.append(h[:-1], last))
                    starts.append(at + first)
                    lengths.append(np.full(len(at), length))
                    tokens.append(k)
            start, length, k = np.concatenate(starts), np.concatenate(lengths), np.concatenate(tokens)
            end = start + length
            order = np.lexsort((start, end))
            order = order[end[order] > low]
            for s, e, t in zip(start[order].tolist(), end[order].tolist(), k[order].tolist(), strict=True):
                if token[e] < 0:
                    of = int(state[token[s]]) if s else self.start
                    if arcs[row[t], of >> 3] >> (of & 7) & 1:
                        token[e], came[e] = t, s
        out, at = [], n
        while at:
            out.append(int(self.ids[token[at]]))
            at = came[at]
        return out[::-1]

    def _encode_equal(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of tokens, ids one word after the other) of words of one length, a row of bytes each."""
        w, n = b.shape
        table, b = self.table, b.T.astype(np.uint64) + np.uint64(1)
        token, came = np.full((n + 1, w), -1, np.int32), np.zeros((n + 1, w), np.int8)
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        with np.errstate(over="ignore"):
            h = np.zeros((n, w), np.uint64)
            for length in range(1, min(n, self.longest) + 1):
                h = h[: n - length + 1] * table.STEP + b[length - 1 :]
                closed = np.concatenate((h[:-1], h[-1:] * table.STEP + table.CLOSE)).ravel()
                at, k = table.find(closed)
                cuts = np.searchsorted(at, np.arange(n - length + 2) * w)
                for s in range(n - length + 1):
                    if cuts[s + 1] > cuts[s]:
                        found[s, s + length] = at[cuts[s] : cuts[s + 1]] - s * w, k[cuts[s] : cuts[s + 1]]
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                if (pair := found.get((start, end))) is None:
                    continue
                at, k = pair
                s = self.state[token[start, at]] if start else self.start
                right = (token[end, at] < 0) & ((self.arcs[self.row[k], s >> 3] >> (s & 7)) & 1 > 0)
                at = at[right]
                token[end, at], came[end, at] = k[right], start
        used, at = np.zeros((w, n + 1), bool), np.full(w, n)
        every = np.arange(w)
        while len(every):
            used[every, at] = True
            at = came[at, every]
            every, at = every[at > 0], at[at > 0]
        return used.sum(axis=1), self.ids[token.T[used]]

    def encode_words(self, words: pa.Array, most: int = 48, together: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of tokens, ids one word after the other) of words, a binary array; those of a length run together."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
        lengths, counts = np.diff(offsets), np.zeros(len(words), np.int64)
        pieces, of = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        by_length = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[by_length], prepend=-1, append=-1)) if len(words) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(lengths[by_length[a]])
            for lo in range(a, b, together):
                which = by_length[lo : min(b, lo + together)]
                if n > most:
                    for i in which.tolist():
                        ids = self.encode_long(data[offsets[i] : offsets[i + 1]].tobytes())
                        counts[i] = len(ids)
                        pieces.append(np.array(ids, np.int32))
                elif n:
                    counts[which], ids = self._encode_equal(data[offsets[which][:, None] + np.arange(n)])
                    pieces.append(ids)
                of.append(which)
        flat, of = np.concatenate(pieces), np.concatenate(of)
        place = np.cumsum(counts[of]) - counts[of]
        start = np.empty(len(words), np.int64)
        start[of] = place
        return counts, flat[spread(start, counts)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of each i, counts[i] of them, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Words:
    """Words with their ids, by sorted 64-bit hashes; emptied when it would hold more than `most`."""

    def __init__(self, automaton: Automaton, most: int = WORDS):
        self.automaton, self.most = automaton, most
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.at, self.n, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        lengths = np.diff(offsets)
        h = lengths.astype(np.uint64)
        with np.errstate(over="ignore"):
            live = np.arange(len(words))
            for i in range(int(lengths.max(initial=0))):
                live = live[lengths[live] > i]
                h[live] = (h[live] ^ data[offsets[live] + i]) * np.uint64(0x9E3779B97F4A7C15)
                h[live] ^= h[live] >> np.uint64(29)
        return h

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(where each word's ids start in `flat`, how many there are); distinct words of at most a slice."""
        h = self._hashes(words)
        place = np.searchsorted(self.hashes, h)
        new = np.flatnonzero(self.hashes[np.minimum(place, len(self.hashes) - 1)] != h) if len(self.hashes) else np.arange(len(h))
        if len(new):
            if len(self.hashes) + len(new) > self.most:
                self._empty()
                new = np.arange(len(h))
            counts, flat = self.automaton.encode_words(words.take(pa.array(new)))
            at = (np.cumsum(counts) - counts + len(self.flat)).astype(np.int32)
            order = np.argsort(h[new])
            place = np.searchsorted(self.hashes, h[new][order])
            self.flat = np.concatenate((self.flat, flat))
            self.at, self.n = np.insert(self.at, place, at[order]), np.insert(self.n, place, counts[order].astype(np.int32))
            self.hashes = np.insert(self.hashes, place, h[new][order])
        place = np.searchsorted(self.hashes, h)
        return self.at[place].astype(np.int64), self.n[place].astype(np.int64)


class Encoder:
    """Splits, encodes and decodes whole texts with an automaton."""

    def __init__(self, automaton: Automaton, words: int = WORDS):
        self.automaton, self.known = automaton, Words(automaton, words)
        self.cut = re.compile("(" + "|".join(map(re.escape, automaton.special)) + ")") if automaton.special else None

    def words(self, segments: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(the words of all segments, a binary array; how many words each segment has)"""
        plain = [(s if s.isascii() else unicodedata.normalize("NFC", s).replace("\u03a3", "\u03c3")).lower() for s in segments]
        joined = "\n".join([*plain, ""])
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        codes = data if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.automaton.kinds[codes]
        edge = np.empty(len(codes), bool)
        edge[:1] = True
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(codes))
        word = kind[starts] != _SPACE
        starts, ends = starts[word], ends[word]
        starts, ends = self._contracted(codes, kind, starts, ends)
        bounds = np.cumsum([len(p) + 1 for p in plain])
        counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
        if len(data) > len(codes):
            offset = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)))
            starts, ends = offset[starts], offset[ends]
        lengths = ends - starts
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[spread(starts, lengths)])]), counts

    @staticmethod
    def _contracted(codes: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gives an apostrophe that is a word of its own the s, t, m, d, re, ve or ll that the next word begins with."""
        mark = np.flatnonzero((codes[starts] == 0x27) & (ends - starts == 1))
        mark = mark[mark + 1 < len(starts)]
        mark = mark[(starts[mark + 1] == ends[mark]) & (kind[ends[mark]] == _LETTER)]
        if not len(mark):
            return starts, ends
        first = codes[ends[mark]]
        second = np.where(ends[mark + 1] - ends[mark] > 1, codes[np.minimum(ends[mark] + 1, len(codes) - 1)], 0)
        pair = lambda a, b: (first == ord(a)) & (second == ord(b))
        take = np.where(np.isin(first, list(map(ord, "stmd"))), 1, np.where(pair("r", "e") | pair("v", "e") | pair("l", "l"), 2, 0))
        ends, starts = ends.copy(), starts.copy()
        ends[mark] += take
        starts[mark + 1] += take
        left = starts < ends
        return starts[left], ends[left]

    def _flat(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of tokens of segments, their ids one after the other)"""
        words, counts = self.words(segments)
        if not len(words):
            return np.zeros(len(segments), np.int64), np.zeros(0, np.int32)
        coded = words.dictionary_encode()
        at, n = self.known.find(coded.dictionary)
        code = coded.indices.to_numpy()
        n_of = n[code]
        sums = np.concatenate(([0], np.cumsum(n_of)))
        to = np.cumsum(counts)
        return sums[to] - sums[to - counts], self.known.flat[spread(at[code], n_of)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of tokens of texts, their ids one after the other)"""
        segments, of, specials = [], [], []  # special tokens: segments before them, id, text
        for i, text in enumerate(texts):
            parts = self.cut.split(text) if self.cut and self.cut.search(text) else (text,)
            for j, part in enumerate(parts):
                if j % 2:
                    specials.append((len(segments), self.automaton.special[part], i))
                    continue
                at = 0
                while at < len(part) or not at:
                    end = m.end() if len(part) - at > SLICE and (m := _SAFE.search(part, at + SLICE)) else len(part)
                    segments.append(part[at:end] if at or end < len(part) else part)
                    of.append(i)
                    at = max(end, 1)
        counts, flat = [], []
        for a, b in slices(segments, SLICE):
            c, f = self._flat(segments[a:b])
            counts.append(c)
            flat.append(f)
        counts, ids = np.concatenate(counts) if counts else np.zeros(0, np.int64), np.concatenate(flat) if flat else np.zeros(0, np.int32)
        n = np.bincount(of, counts, len(texts)).astype(np.int64) if of else np.zeros(len(texts), np.int64)
        if specials:
            before = np.concatenate(([0], np.cumsum(counts)))
            ids = np.insert(ids, before[[s for s, _, _ in specials]], [k for _, k, _ in specials])
            np.add.at(n, [i for _, _, i in specials], 1)
        return n, ids

    def emitted(self, counts: np.ndarray, ids: np.ndarray, labels: pa.Array, block: int = 1 << 20) -> Iterator[Iterator[memoryview]]:
        """For each text the bytes of its ids' labels, joined by spaces, in blocks of tokens."""
        ends = np.cumsum(counts)
        if len(ids) <= block:
            taken = labels.take(pa.array(ids))
            data, at = memoryview(taken.buffers()[2] or b""), np.frombuffer(taken.buffers()[1], np.int32)
            yield from ([data[at[e - n] : at[e] - 1]] if n else [] for e, n in zip(ends.tolist(), counts.tolist(), strict=True))
            return
        for e, n in zip(ends.tolist(), counts.tolist(), strict=True):

            def blocks(e: int = e, n: int = n) -> Iterator[memoryview]:
                for lo in range(e - n, e, block):
                    hi = min(e, lo + block)
                    taken = labels.take(pa.array(ids[lo:hi]))
                    size = int(np.frombuffer(taken.buffers()[1], np.int32)[hi - lo])
                    yield memoryview(taken.buffers()[2])[: size - (hi == e)]

            yield blocks()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.automaton.labels[i].as_py()[:-1].decode() for i in ids])


def _sha256(blocks: Iterator[memoryview]) -> str:
    h = hashlib.sha256()
    for b in blocks:
        h.update(b)
    return h.hexdigest()


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and of `ids` (array<int>) and `decoded` (string) those in keep. Rows leave a
    worker a slice at a time, so its memory doesn't follow the size of Arrow's batches; its words go with the broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.read(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        encoder = vars(automaton).setdefault("encoder", None) or Encoder(automaton)
        automaton.encoder = encoder  # lives as long as this broadcast does in this worker
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, SLICE):
                counts, ids = encoder.encode(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array(counts)]
                columns += [pa.array([_sha256(x) for x in encoder.emitted(counts, ids, labels)]) for labels in (automaton.decimals, automaton.labels)]
                for k in keep:
                    if k == "ids":
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids)))
                    else:
                        columns.append(pa.array([b"".join(x).decode("utf-8", "surrogatepass") for x in encoder.emitted(counts, ids, automaton.labels)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs.select(id_col, text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {'array<int>' if k == 'ids' else 'string'}" for k in keep))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
