"""SentencePiece encoding and decoding for merge-type vocabularies (operator 7).

Encoding keeps an agenda of adjacent symbol pairs ordered by score, the leftmost first among equals; the
best pair is merged and its two new neighbours join the agenda, until no pair is a piece. No piece holds
a space symbol after another character, so words merge independently. The new words of an Arrow batch are
merged together: words of one length share an agenda, a row of pair costs each, and every round merges each row's
best pair. Very long words have an agenda of their own, a heap. A worker keeps the words it has seen. In every
batch the sentencepiece library encodes all new words and decodes all ids too, and must agree, else the task fails.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import pieces
from attestry.llm.common import map_arrow

#: Words that a worker keeps; those that came first stay, as they are the frequent ones.
CACHED = 500_000
#: Words of more symbols have an agenda of their own.
TOGETHER = 64
NEVER = np.float32(np.inf)
_SLOTS = 20


class Merges:
    """Which pairs of symbols are pieces: what they merge to and at which cost. Symbols are piece ids, then other characters."""

    def __init__(self, v: pieces.Vocabulary):
        self.n_pieces = len(v.pieces)
        symbols = dict(v.ids)
        for c in sorted({c for p in v.ids for c in p}):
            symbols.setdefault(c, len(v.pieces) + len(symbols))
        self.first_other = max(symbols.values(), default=0) + len(v.pieces) + 1  # characters of no piece follow
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.first_other
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.char_of = {i: s for s, i in symbols.items() if len(s) == 1 and i >= self.n_pieces}
        found = {}
        for p, i in v.ids.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    found[self._key(a, b)] = (i, -v.scores[i])
        keys = np.array(sorted(found), np.int64)
        joint, cost = np.array([found[k][0] for k in keys.tolist()], np.int64), np.array([found[k][1] for k in keys.tolist()], np.float32)
        # one slot a hash; keys that find theirs taken are looked up in a sorted list
        slot = self._slot(keys)
        _, own = np.unique(slot, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), own)
        self.keys, self.at, self.shared = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, np.int32), np.zeros(1 << _SLOTS, bool)
        self.keys[slot[own]], self.at[slot[own]], self.shared[slot[rest]] = keys[own], own, True
        self.rest, self.rest_at = keys[rest], rest
        self.joint, self.cost = np.append(joint, -1), np.append(cost, NEVER)

    @staticmethod
    def _key(a, b):
        return a << 24 | b

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair merges to (-1: nothing) and its cost."""
        keys = self._key(a, b)
        slot = self._slot(keys)
        at = np.where(self.keys[slot] == keys, self.at[slot], -1)
        again = np.flatnonzero((at < 0) & self.shared[slot])
        if len(again):
            place = np.minimum(np.searchsorted(self.rest, keys[again]), len(self.rest) - 1)
            at[again] = np.where(self.rest[place] == keys[again], self.rest_at[place], -1)
        return self.joint[at], self.cost[at]

    def merge(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of equally many symbols, merged until no pair is a piece: (row numbers, their symbols) by number of symbols left."""
        out, row = [], np.arange(len(symbols))
        if symbols.shape[1] == 1:
            return [(row, symbols)]
        joint, cost = (x.reshape(len(symbols), -1) for x in self.look(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()))
        while True:
            n, width = symbols.shape
            best = cost.argmin(axis=1)
            live = cost[np.arange(n), best] < NEVER
            if not live.all():
                out.append((row[~live], symbols[~live]))
                row, symbols, joint, cost, best = row[live], symbols[live], joint[live], cost[live], best[live]
                n = len(row)
                if not n:
                    return out
            each = np.arange(n)
            symbols[each, best] = joint[each, best]
            keep = np.ones((n, width), bool)
            keep[each, best + 1] = False
            symbols = symbols[keep].reshape(n, width - 1)
            if width == 2:
                out.append((row, symbols))
                return out
            pairs = np.ones((n, width - 1), bool)
            pairs[each, best] = False
            joint, cost = joint[pairs].reshape(n, width - 2), cost[pairs].reshape(n, width - 2)
            for shift in (-1, 0):  # the pairs that end and begin with the merged symbol
                at = best + shift
                there = np.flatnonzero((at >= 0) & (at < width - 2))
                if len(there):
                    j, c = self.look(symbols[there, at[there]], symbols[there, at[there] + 1])
                    joint[there, at[there]], cost[there, at[there]] = j, c


class _Known(dict):
    """Number of each word; an unknown one gets the next number."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Codec:
    """Words are named by their text without the first space symbol; those that begin with a line end never have one."""

    def __init__(self, data: bytes, check: bool = True):
        v = self.vocabulary = pieces.parse(data)
        if not v.splits:
            raise ValueError("a piece holds a space symbol after another character")
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.rank = {p: (-v.scores[i], i) for p, i in v.ids.items()}
        self.merges = Merges(v)
        # a line end starts a word of its own if no piece holds one
        self.lines = not any("\n" in p for p in v.ids)
        self.segment = re.compile(f"{pieces.SPACE}+[^{pieces.SPACE}\n]*|\n[^{pieces.SPACE}\n]*" if self.lines else f"{pieces.SPACE}+[^{pieces.SPACE}]*")
        self.unused = {i for i, t in enumerate(v.types) if t == pieces.UNUSED}
        self.controls = {i for i, t in enumerate(v.types) if t == pieces.CONTROL}
        self.starts = np.array([p.startswith(pieces.SPACE) for p in v.pieces])
        self.surface = [self._surface(i) for i in range(len(v.pieces))]
        self.known = _Known()
        #: ids of all known words in a row, and where each word's begin
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _text(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "surrogateescape")
            return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text)

    def _surface(self, i: int) -> bytes:
        kind, piece = self.vocabulary.types[i], self.vocabulary.pieces[i]
        if kind == pieces.BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == pieces.CONTROL:
            return b""
        if kind == pieces.UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(pieces.SPACE, " ").encode()

    def words(self, text: str) -> list[str]:
        """Words of a text."""
        if self.lines and text[0] != " " and "  " not in text and pieces.SPACE not in text:
            return text.replace("\n", " \n").split(" ")
        return [s if s[0] == "\n" and self.lines else s[1:] for s in self.segment.findall(pieces.escaped(text))]

    def escaped(self, word: str) -> str:
        return word if self.lines and word[:1] == "\n" else pieces.SPACE + word

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        texts = [self.escaped(w) for w in words]
        size = np.array([len(t) for t in texts])
        rows, symbols, count = [], [], np.zeros(len(texts), np.int64)
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            if n > TOGETHER or self.unused:
                for i in own.tolist():
                    got = self._merge_long(texts[i])
                    rows.append(np.full(len(got), i))
                    symbols.append(np.array(got, np.int64))
                continue
            codes = np.frombuffer("".join([texts[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            for row, left in self.merges.merge(self.merges.of_char[codes].reshape(-1, n)):
                row, ids = self._emitted(np.repeat(own[row], left.shape[1]), left.ravel())
                rows.append(row)
                symbols.append(ids)
        if not rows:
            return np.zeros(0, np.int64), count
        row, ids = np.concatenate(rows), np.concatenate(symbols)
        return ids[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(texts))

    def _emitted(self, row: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as they are; characters that are none as their bytes, or as one unknown piece."""
        other = np.flatnonzero(symbols >= self.merges.n_pieces)
        if not len(other):
            return row, symbols
        v = self.vocabulary
        values, which = np.unique(symbols[other], return_inverse=True)
        spelled = []
        for s in values.tolist():
            c = self.merges.char_of.get(s) or chr(s - self.merges.first_other)
            spelled.append([v.byte_ids[b] for b in c.encode("utf-8", "replace")] if v.byte_fallback else [v.unk])
        size = np.ones(len(symbols), np.int64)
        size[other] = np.array([len(x) for x in spelled])[which]
        out, at = np.repeat(symbols, size), np.cumsum(size) - size
        for i, ids in enumerate(spelled):
            places = at[other[which == i]]
            for j, x in enumerate(ids):
                out[places + j] = x
        return np.repeat(row, size), out

    def _merge_long(self, text: str) -> list[int]:
        symbols = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []  # cost, left symbol, right symbol, joint length
        rank, parts = self.rank, {}

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                joint = symbols[a] + symbols[b]
                got = rank.get(joint)
                if got is not None:
                    heapq.heappush(agenda, (got[0], a, b, len(joint)))
                    if got[1] in self.unused:
                        parts[joint] = (symbols[a], symbols[b])

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one of them has changed since
            symbols[a] += symbols[b]
            symbols[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[int] = []
        for s in symbols:
            if s:
                self._emit(s, parts, out)
        return out

    def _emit(self, symbol: str, parts: dict, out: list[int]) -> None:
        got = self.rank.get(symbol)
        if got is not None and got[1] in self.unused and symbol in parts:
            for part in parts[symbol]:
                self._emit(part, parts, out)
        elif got is not None:
            out.append(got[1])
        elif self.vocabulary.byte_fallback:
            out.extend(map(self.vocabulary.byte_ids.__getitem__, symbol.encode("utf-8", "replace")))
        else:
            out.append(self.vocabulary.unk)

    def _learn(self, first: int) -> None:
        """Merge the words numbered first and above, hold them against the library and keep their ids."""
        words = list(self.known)[first:] if first < len(self.known) // 2 else list(reversed([w for w, _ in zip(reversed(self.known), range(len(self.known) - first))]))
        ids, count = self.merged(words)
        if self.library is not None:
            self._check(words, ids, count)
        low = int(self.ends[-1])
        if low + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[:low], np.zeros(max(len(ids), len(self.ids)), np.int32)))
        self.ids[low : low + len(ids)] = ids
        self.ends = np.concatenate((self.ends, low + np.cumsum(count)))

    def _check(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        # the library adds a first space symbol; a word that has none, or nothing else, is encoded behind a line end
        behind = [w == "" or self.lines and w[0] == "\n" for w in words]
        asked = [("x\n " if w == "" else f"x{w}") if b else w.replace(pieces.SPACE, " ") for w, b in zip(words, behind)]
        got = self.library.encode(asked, num_threads=1)
        heads = [self.library.encode("x\n"), self.library.encode("x")]
        for i in np.flatnonzero(behind).tolist():
            head = heads[words[i] != ""]
            if got[i][: len(head)] != head:
                raise ValueError(f"the library does not part {asked[i]!r} before its last word")
            got[i] = got[i][len(head) :]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        if (sizes != count).any() or (np.fromiter(chain.from_iterable(got), np.int64, int(sizes.sum())) != ids).any():
            ends = np.cumsum(count)
            w = next(i for i in range(len(words)) if got[i] != ids[ends[i] - count[i] : ends[i]].tolist())
            raise ValueError(f"the library encodes {words[w]!r} as {got[w]}, the agenda as {ids[ends[w] - count[w] : ends[w]].tolist()}")

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        before = len(self.known)
        words = [self.words(t) if t else [] for t in texts]
        n_words = np.array([len(w) for w in words], np.int64)
        number = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        if len(self.known) > before:
            self._learn(before)
        start, size = self.ends[:-1][number], np.diff(self.ends)[number]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[np.cumsum(n_words)]
        if len(self.known) > max(CACHED, before):  # only what came first is kept
            for _ in range(len(self.known) - before):
                self.known.popitem()
            self.ends = self.ends[: before + 1]
        count = np.diff(upto, prepend=0)
        if not self.vocabulary.byte_fallback and len(flat):  # unknown pieces in a row are one
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != self.vocabulary.unk) | (flat[:-1] != self.vocabulary.unk)
            new[(upto - count)[count > 0]] = True
            count = np.diff(np.concatenate(([0], np.cumsum(new)))[upto], prepend=0)
            flat = flat[new]
        return flat, count

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        flat, count = self.encode_flat(texts)
        ends = np.cumsum(count).tolist()
        return [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no valid UTF-8, also across a control piece, give one replacement character each."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if not self.controls.isdisjoint(ids):
            runs = [b""]
            for i in ids:
                if i in self.controls:
                    runs.append(b"")
                else:
                    runs[-1] += self.surface[i]
            text = "".join(map(self._text, runs))
        else:
            text = self._text(raw)
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if first is not None and self.starts[first] else text

    def decode_flat(self, flat: np.ndarray, count: np.ndarray) -> list[str]:
        """Text of the ids of each text, none of them a control piece; held against the library."""
        ids, upto = flat.tolist(), np.cumsum(count).tolist()
        each = [ids[a:b] for a, b in zip([0, *upto], upto)]
        starts, surface = self.starts, self.surface.__getitem__
        out = [self._text(b"".join(map(surface, x)))[int(starts[x[0]]) :] if x else "" for x in each]
        if self.library is not None:
            theirs = self.library.decode(each, num_threads=1)
            if theirs != out:
                raise ValueError(f"the library decodes {next(x for x, a, b in zip(each, theirs, out) if a != b)[:50]} otherwise")
        return out


#: The codec of a worker process, so that its words serve the tasks that come after.
_CODECS: dict[tuple[bytes, bool], Codec] = {}


def codec_of(data: bytes, check: bool) -> Codec:
    name = hashlib.sha256(data).digest(), check
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(data, check)
    return _CODECS[name]


def encode_decode(df: DataFrame, text: str = "text", model_path: str | None = None, check: bool = True, keep: list | None = None) -> DataFrame:
    """df with ids (array<int>, no begin or end ids) and decoded (string) of a whole text column.

    Null and empty texts give no ids and an empty text. Repeated rows are encoded alike; an empty table
    gives an empty table; other columns, whatever their names, are kept. Very long texts are one row each,
    worked word by word. keep limits the columns carried. The vocabulary file goes once to each executor.
    """
    data = df.sparkSession.sparkContext.broadcast(open(model_path or pieces.default_path(), "rb").read())

    def make():
        codec = codec_of(data.value, check)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            flat, count = codec.encode_flat(batch.column(0).to_pylist())
            offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(codec.decode_flat(flat, count), pa.string())]

        return run

    out = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return map_arrow(df, [F.col(f"`{text}`")], make, out, keep)
