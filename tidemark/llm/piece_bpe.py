"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut before each run of spaces and around line ends: no piece crosses such
a cut (this is checked against the vocabulary when it is loaded), so that every
stretch, a "word", is merged by itself.  The words of a batch that are not yet known are
laid out as flat numpy arrays of symbols.  Each round finds every word's best pair
(a segmented minimum of the pair ranks), merges its occurrences leftmost first all at
once, and compacts the arrays, until no pair is left.  The library merges one pair at
a time; both agree unless a merge creates a pair that ranks no worse than the
merged one, and a word in which that happens is encoded again pair by pair.

Defined cases: a null text is empty; an empty text has no ids; characters outside the
vocabulary become byte pieces; decoding gives U+FFFD for byte pieces that are not UTF-8;
rows that repeat are each encoded; other columns are kept by the operator, but for those of the names that it gives.
Words are remembered by 64-bit hashes: two words of one hash would share their ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import table
from .textscan import Index, Store, U64, flat, hashes, mix, pieces

SPACE = "▁"
WORD = re.compile(r"[ ▁]*[^ ▁\n]+|[ ▁]+|\n")
NONE = np.iinfo(np.int64).max
#: A number for each byte value, for hashes, and the bytes of the mark that stands for a space.
PLAIN, MARK = mix(np.arange(256, dtype=U64), 11), SPACE.encode()
#: Bytes of text read at a time, so that the arrays stay in the processor's cache.
SLICE = 1 << 19


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return out, at


def fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive stretches."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Vocabulary:
    """Pieces, scores and kinds of a model file, and the ranks of all pairs that merge."""

    def __init__(self, path: str):
        self.pieces, scores, self.kinds = [], [], []
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    own = dict(fields(value))
                    self.pieces.append(own[1].decode())
                    scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                    self.kinds.append(own.get(3, 1))
                elif number == 3:
                    norm = dict(fields(value))
                    if norm.get(2) or norm.get(4, 1):
                        raise ValueError("only models that leave the text as it is are supported")
        if 4 in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 5)}
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in self.id):
            raise ValueError("a piece crosses the cuts between words")
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.id.values()}, reverse=True))}
        # Symbols: pieces by their ids, then single characters that are only parts of pieces.
        self.symbol = dict(self.id)
        for p in self.id:
            for c in p:
                self.symbol.setdefault(c, len(self.pieces) + len(self.symbol))
        self.base = max(self.symbol.values()) + 2
        keys, ranks, merged = [], [], []
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    ranks.append(order[scores[i]])
                    merged.append(i)
        at = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64)[at] for x in (keys, ranks, merged))
        self._table()
        self.ranks = np.append(self.ranks, NONE)  # the place -1 is no pair
        self.pair = {k: (r, m) for k, r, m in zip(keys, ranks, merged, strict=True)}
        self.char = {c: i for c, i in self.symbol.items() if len(c) == 1}
        self.bytes = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _table(self) -> None:
        """An open-addressed hash table of the pairs, and the symbol of each code point (-1 for none)."""
        self.bits = max(4, int(len(self.keys) * 3).bit_length())
        self.slot_key, self.slot_at = np.full(1 << self.bits, -2, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        left, place = np.arange(len(self.keys)), self._place(self.keys)
        while len(left):
            free = self.slot_key[place] == -2
            _, first = np.unique(place, return_index=True)
            fits = np.zeros(len(left), dtype=bool)
            fits[first] = True
            fits &= free
            self.slot_key[place[fits]], self.slot_at[place[fits]] = self.keys[left[fits]], left[fits]
            left, place = left[~fits], (place[~fits] + 1) & ((1 << self.bits) - 1)
        self.of_point = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each pair stands in the tables of ranks and merges, -1 where it does not merge."""
        place = self._place(keys)
        seen = self.slot_key[place]
        out = np.where(seen == keys, self.slot_at[place], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != -2))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.slot_key[place[open_]]
            same = seen == keys[open_]
            out[open_[same]] = self.slot_at[place[open_[same]]]
            open_ = open_[~same & (seen != -2)]
        return out

    def _pairs(self, word: np.ndarray, symbol: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Where the pairs that begin at the places left stand in the tables, -1 where there is none within a word."""
        right = np.minimum(left + 1, len(symbol) - 1)
        a, b = symbol[left], symbol[right]
        ok = (right > left) & (word[left] == word[right]) & (a >= 0) & (b >= 0)
        out = np.full(len(left), -1, dtype=np.int64)
        out[ok] = self.find(a[ok] * self.base + b[ok])
        return out

    def _ids(self, symbols, chars: str) -> list[int]:
        """Ids of merged symbols; those outside the vocabulary (-1 - position) become bytes."""
        out: list[int] = []
        for s in symbols:
            if 0 <= s < len(self.pieces):
                out.append(s)
            else:
                c = chars[-1 - s] if s < 0 else next(c for c, i in self.char.items() if i == s)
                out += [self.byte[b] for b in c.encode()]
        return out

    def slow(self, word: str) -> list[int]:
        """One pair at a time: best score first, then leftmost."""
        s = [self.char.get(c, -1 - i) for i, c in enumerate(word)]
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i):
            if i >= 0 and after[i] < len(s) and s[i] >= 0 and s[after[i]] >= 0 and (hit := self.pair.get(s[i] * self.base + s[after[i]])):
                heapq.heappush(heap, (hit[0], i, s[i], s[after[i]]))

        live = [True] * len(s)
        for i in range(len(s) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not live[i] or s[i] != a or after[i] >= len(s) or s[after[i]] != b:
                continue
            j = after[i]
            s[i], live[j] = self.pair[a * self.base + b][1], False
            after[i] = after[j]
            if after[j] < len(s):
                before[after[j]] = i
            push(before[i])
            push(i)
        return self._ids([x for x, ok in zip(s, live, strict=True) if ok], word)

    def merge_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words (spaces already replaced), how many each has)."""
        return self.merge_points(np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4"), np.array([len(w) for w in words], dtype=np.int64))

    def merge_points(self, points: np.ndarray, lengths: np.ndarray, block: int = 16384) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has) of the words' code points and lengths; in blocks whose arrays stay in the processor's cache."""
        if not len(lengths):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(lengths) > block:
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            parts = [self.merge_points(points[cuts[a] : cuts[min(a + block, len(lengths))]], lengths[a : a + block]) for a in range(0, len(lengths), block)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        n_words, lead = len(lengths), np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(n_words), lengths)
        symbol = self.of_point[points].astype(np.int64)
        place = np.arange(len(points)) - np.repeat(lead, lengths)
        symbol = np.where(symbol < 0, -1 - place, symbol)
        last = np.full(n_words, -1, dtype=np.int64)
        wrong = np.zeros(n_words, dtype=bool)
        done_word, done_symbol = [], []
        at = self._pairs(word, symbol, np.arange(len(symbol)))
        while len(symbol):
            rank = self.ranks[at]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            ids = word[starts]
            going = best < NONE
            wrong[ids[going & (best <= last[ids])]] = True
            last[ids] = best
            # Words without a pair are done and leave the arrays.
            sizes = np.diff(np.append(starts, len(word)))
            live = np.repeat(going & ~wrong[ids], sizes)
            done_word.append(word[~live])
            done_symbol.append(symbol[~live])
            take = (rank == np.repeat(best, sizes)) & live
            # Leftmost first: of adjacent candidates every second one, counted from the start of their run.
            where = np.flatnonzero(take)
            if len(where):
                fresh = np.append(True, np.diff(where) > 1)
                run = np.arange(len(where)) - np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[run % 2 == 0]
                symbol[where] = self.merged[at[where]]
                live[where + 1] = False
            word, symbol, at = word[live], symbol[live], at[live]
            # Only the pairs that a merged symbol is part of have changed.
            now = (np.cumsum(live) - 1)[where]
            changed = np.concatenate([now, now[now > 0] - 1])
            at[changed] = self._pairs(word, symbol, changed)
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        cuts = np.searchsorted(word[order], np.arange(n_words + 1))
        symbol = symbol[order]
        odd = (symbol < 0) | (symbol >= len(self.pieces))
        special = np.unique(np.concatenate([np.searchsorted(cuts, np.flatnonzero(odd), side="right") - 1, np.flatnonzero(wrong)]))
        sizes = np.diff(cuts)
        if not len(special):
            return symbol, sizes
        text = lambda i: points[lead[i] : lead[i] + lengths[i]].astype("<u4").tobytes().decode("utf-32-le")
        own = {int(i): self.slow(text(i)) if wrong[i] else self._ids(symbol[cuts[i] : cuts[i + 1]].tolist(), text(i)) for i in special}
        keep = np.ones(n_words, dtype=bool)
        keep[special] = False
        new = sizes.copy()
        new[special] = [len(own[int(i)]) for i in special]
        start = np.cumsum(new) - new
        out = np.empty(int(new.sum()), dtype=np.int64)
        out[np.repeat(start[keep], sizes[keep]) + _within(sizes[keep])] = symbol[np.repeat(keep, sizes)]
        for i, ids in own.items():
            out[start[i] : start[i] + len(ids)] = ids
        return out, new

    def merge(self, words: list[str]) -> list[list[int]]:
        flat, sizes = self.merge_flat(words)
        values, ends = flat.tolist(), np.cumsum(sizes).tolist()
        return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if words else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        known: dict[str, list[int]] = {}
        cut = [split(t) for t in texts]
        fresh = list(dict.fromkeys(w for c in cut for w in c))
        known.update(zip(fresh, self.merge([w.replace(" ", SPACE) for w in fresh]), strict=True))
        return [[i for w in c for i in known[w]] for c in cut]

    def decode(self, ids) -> str:
        text = b"".join(self.bytes[i] for i in ids)
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", errors="replace")


def split(text: str) -> list[str]:
    """The words of a text, with the space that the library puts in front."""
    return WORD.findall(" " + text) if text else []


_LOADED: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of piece_bpe.split for all texts at once: (bytes, start and end of each word, its hash, words of each text)."""
    spaced, offsets = flat(texts)
    n = len(offsets) - 1
    data = np.concatenate([[np.uint8(32)], spaced[:-1]]) if n else spaced  # the space goes in front of each text
    gap = data == 32
    mark = np.flatnonzero(data == MARK[0])
    mark = mark[mark + 2 < len(data)]
    mark = mark[(data[mark + 1] == MARK[1]) & (data[mark + 2] == MARK[2])]
    for k in range(3):
        gap[mark + k] = True
    line = data == 10
    opens = line.copy()
    opens[1:] |= line[:-1] | (gap[1:] & ~gap[:-1])
    opens[offsets[:-1]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))[: len(start)]
    first = np.searchsorted(start, offsets)
    many, empty = np.diff(first), np.diff(offsets) == 1
    if empty.any():
        keep = np.ones(len(start), dtype=bool)
        keep[first[:-1][empty]] = False
        many, start, end = np.where(empty, 0, many), start[keep], end[keep]
    return data, start, end, hashes(data, start, end, PLAIN), many


class Encoder:
    """Subword ids of words, remembered by 64-bit hashes of the words; the texts become one flat array of ids.

    A worker process keeps its encoder from task to task.
    """

    MOST = 1 << 20

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.clear()

    def clear(self) -> None:
        self.index, self.flat, self.start, self.length = Index(), Store(np.int32), Store(np.int64), Store(np.int32)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each word of all texts, words of each text)."""
        data, start, end, h, many = _cut(texts)
        out = self.index.get(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            distinct, first = np.unique(h[new], return_index=True)
            if self.index.size + len(distinct) > self.MOST:
                self.clear()
                distinct, first, new = *np.unique(h, return_index=True), np.arange(len(h))
            self._learn(data, start[new[first]], end[new[first]], distinct)
            out[new] = self.index.get(h[new])
        return out.astype(np.int64), many

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        sizes = end - start
        own = data[np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)]
        points = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        ids, n = self.vocabulary.merge_points(np.where(points == 32, ord(SPACE), points), np.add.reduceat((own & 0xC0) != 0x80, np.cumsum(sizes) - sizes, dtype=np.int64))
        self.index.add(h, np.arange(len(h)) + self.start.used)
        self.start.extend(self.flat.used + np.cumsum(n) - n)
        self.length.extend(n)
        self.flat.extend(ids)

    def _flat(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.flat.flat[np.repeat(self.start.flat[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        at, many = self.words(texts)
        n = self.length.flat[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        return self._flat(at, n), np.diff(ends[np.concatenate([[0], np.cumsum(many)])])


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _digests(path: str):
    def run(batches):
        encoder = encoder_of(path)
        name = [str(i) for i in range(len(encoder.vocabulary.pieces))]
        for batch in batches:
            for piece in pieces(batch, most=SLICE):
                ids, many = encoder.ids(piece.column("text"))
                every, ids_sha, text_sha, at = ids.tolist(), [], [], 0
                for n in many.tolist():
                    own = every[at : at + n]
                    at += n
                    ids_sha.append(hashlib.sha256(",".join([name[i] for i in own]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(encoder.vocabulary.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(many, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, column: str = "ids", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """docs with an array of the ids of each text, and, where decoded names a column, the text that they decode to; columns of these names are replaced."""
    where = path or default_path()
    docs = docs.drop(*[c for c in (column, decoded) if c and c != "text"])
    extra = [StructField(column, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    rest = [f.name for f in docs.schema]

    def run(batches):
        encoder = encoder_of(where)
        for batch in batches:
            for piece in pieces(batch, most=SLICE):
                ids, many = encoder.ids(piece.column("text"))
                ends = np.concatenate([[0], np.cumsum(many)])
                columns = [*(piece.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    every = ids.tolist()
                    columns.append(pa.array([encoder.vocabulary.decode(every[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*rest, *(f.name for f in extra)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra]))


def op7(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"))
