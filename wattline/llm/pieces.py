"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are written one after another and indexed by a suffix array.
Every piece of the vocabulary is looked up by binary search; its range of the array holds
all its occurrences. These edges, put in order of position, are then relaxed: by best sum
of scores for a unigram model, and by best next merge for a byte-pair model.

A model whose pieces never continue after a space boundary (usual) is applied word by word, and words that a
task has met before are not matched again; memory for them is bounded.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as S

from wattline.llm import text as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_LONG = 128
_KNOWN_IDS = 4_000_000
_NEVER = -np.inf
_ONE, _NONE = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())


@dataclass
class Vocabulary:
    """Pieces with plain spaces, their scores, and the piece of each byte (or -1)."""

    pieces: list[str]
    scores: np.ndarray
    plain: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    kind: str
    by_words: bool

    @classmethod
    def build(cls, pieces: list[str], scores: list[float], kind: str = "bpe", byte_ids: list[int] | None = None, unknown: int = 0, special: set[int] = frozenset()) -> Vocabulary:
        texts = [p.replace(SPACE, " ") for p in pieces]
        plain = np.array([bool(t) and i not in special and i != unknown for i, t in enumerate(texts)])
        crossing = any(plain[i] and any(a != " " and b == " " for a, b in zip(t[:-1], t[1:], strict=True)) for i, t in enumerate(texts))
        return cls(texts, np.array(scores, float), plain, np.array(byte_ids if byte_ids else [-1] * 256), unknown, kind, not crossing)

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        """From a SentencePiece model file that adds a space in front and keeps all others."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        byte_ids = [-1] * 256
        special = set()
        for i in ids:
            if model.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
            if model.is_byte(i) or model.is_control(i) or model.is_unused(i):
                special.add(i)
        return cls.build(pieces, [model.get_score(i) for i in ids], kind, byte_ids, model.unk_id(), special)


def suffix_array(codes: np.ndarray, bits: int, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in order of the next ``length`` codes, and the codes at those places packed in words."""
    per = 64 // bits
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(length + per, np.uint64)))
    packed = np.zeros(len(codes) + length, np.uint64)
    for j in range(per):
        packed = (packed << np.uint64(bits)) | padded[j : j + len(packed)]
    words = [packed[k : k + len(codes)] for k in range(0, length, per)]
    order = np.lexsort(words[::-1])
    return order, [w[order] for w in words]


def _bound(words: list[np.ndarray], keys: list[np.ndarray], after: bool) -> np.ndarray:
    """The first place of each key in the sorted words, or the first place after it."""
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(words[0]), np.int64)
    for _ in range(len(words[0]).bit_length()):
        open_ = low < high
        middle = np.minimum((low + high) // 2, len(words[0]) - 1)
        less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for w, k in zip(words, keys, strict=True):
            here = w[middle]
            less |= same & (here < k)
            same &= here == k
        right = open_ & (less | same if after else less)
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


class Matcher:
    """Occurrences of a vocabulary's pieces in texts of code points."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        own = np.flatnonzero(vocabulary.plain)
        pieces = [vocabulary.pieces[i] for i in own]
        self.ids = own
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        self.points = np.zeros((len(pieces), self.longest), np.uint32)
        for i, p in enumerate(pieces):
            self.points[i, : len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(self.points)

    def edges(self, points: np.ndarray) -> np.ndarray:
        """``table[place, length - 1]``: the piece that starts there with that length, or -1."""
        table = np.full((len(points), self.longest), -1, np.int32)
        used = np.intersect1d(np.unique(points), self.alphabet[self.alphabet > 0])
        if not len(used):
            return table
        bits = 8 if len(used) < 255 else 16 if len(used) < 65535 else 32
        codes = np.searchsorted(used, points)
        codes = np.where(used[np.minimum(codes, len(used) - 1)] == points, codes + 1, 0)
        order, words = suffix_array(codes, bits, self.longest)
        spot = np.searchsorted(used, self.points)
        known = used[np.minimum(spot, len(used) - 1)] == self.points
        inside = np.arange(self.longest) < self.lengths[:, None]
        rows = np.flatnonzero((known | ~inside).all(1))
        first = np.where(inside, spot + 1, 0)[rows].astype(np.uint64)
        last = np.where(inside, spot + 1, (1 << bits) - 1)[rows].astype(np.uint64)
        per, bounds = 64 // bits, []
        for side, after in ((first, False), (last, True)):
            # Places beyond the longest piece are packed too, so the keys are filled up to whole words.
            wide = np.full((len(rows), len(words) * per + per), 0 if not after else (1 << bits) - 1, np.uint64)
            wide[:, : self.longest] = side
            keys = []
            for k in range(len(words)):
                key = np.zeros(len(rows), np.uint64)
                for j in range(per):
                    key = (key << np.uint64(bits)) | wide[:, k * per + j]
                keys.append(key)
            bounds.append(_bound(words, keys, after))
        low, counts = bounds[0], bounds[1] - bounds[0]
        ranges = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        table[order[ranges], np.repeat(self.lengths[rows], counts) - 1] = np.repeat(self.ids[rows], counts)
        return table


def _merge_long(table: np.ndarray, scores: np.ndarray, start: int, end: int) -> list[int]:
    """Starts of the symbols of one long word after all merges, best first, with a heap."""
    longest = table.shape[1]
    following = {i: i + 1 for i in range(start, end)}
    previous = {i + 1: i for i in range(start, end)}
    heap: list[tuple[float, int, int]] = []

    def push(i: int) -> None:
        j = following.get(i, end)
        if j < end:
            k = following[j]
            piece = table[i, k - i - 1] if k - i <= longest else -1
            if piece >= 0:
                heapq.heappush(heap, (-scores[piece], i, k))

    for i in range(start, end):
        push(i)
    while heap:
        _, i, k = heapq.heappop(heap)
        j = following.get(i)
        if j is None or j >= end or following.get(j) != k:
            continue
        del following[j]
        following[i] = k
        previous[k] = i
        push(i)
        if i > start:
            push(previous[i])
    return sorted(following)


def merged(table: np.ndarray, scores: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the symbols of all words: again and again each word's best merge, leftmost first."""
    longest = table.shape[1]
    flat = table.ravel()
    sizes = np.diff(borders)
    done_starts, done_ends = [], []
    for w in np.flatnonzero(sizes > _LONG):
        starts = _merge_long(table, scores, int(borders[w]), int(borders[w + 1]))
        done_starts.append(np.array(starts))
        done_ends.append(np.array([*starts[1:], borders[w + 1]]))
    short = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    word = np.repeat(short, sizes[short])
    start = np.repeat(borders[short] - np.cumsum(sizes[short]) + sizes[short], sizes[short]) + np.arange(len(word))
    end = start + 1
    while len(word):
        pair = np.full(len(word), _NEVER)
        wide = end[1:] - start[:-1] if len(word) > 1 else np.zeros(0, np.int64)
        fit = np.flatnonzero((word[1:] == word[:-1]) & (end[1:] - start[:-1] <= longest)) if len(wide) else np.zeros(0, np.int64)
        piece = flat[start[fit] * longest + wide[fit] - 1]
        good = piece >= 0
        pair[fit[good]] = scores[piece[good]]
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.maximum.reduceat(pair, heads)
        counts = np.diff(np.append(heads, len(word)))
        going = np.repeat(best > _NEVER, counts)
        if not going.all():
            done_starts.append(start[~going])
            done_ends.append(end[~going])
        hits = np.flatnonzero(going & (pair == np.repeat(best, counts)))
        hits = hits[np.concatenate(([True], word[hits][1:] != word[hits][:-1]))] if len(hits) else hits
        end[hits] = end[hits + 1]
        going[hits + 1] = False
        word, start, end = word[going], start[going], end[going]
    starts = np.concatenate(done_starts) if done_starts else np.zeros(0, np.int64)
    ends = np.concatenate(done_ends) if done_ends else np.zeros(0, np.int64)
    order = np.argsort(starts)
    return starts[order], (ends - starts)[order]


def best_paths(table: np.ndarray, scores: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of each word's best path, all words one place at a time.

    A place that no piece starts at alone may be crossed at ten below the lowest score.
    """
    longest = table.shape[1]
    low = scores.min(initial=0.0) - 10
    sizes = np.diff(borders)
    best = np.full(len(table) + len(sizes) + 1, _NEVER)
    shift = borders[:-1] + np.arange(len(sizes))
    best[shift] = 0
    back = np.zeros(len(best), np.int64)
    for place in range(1, int(sizes.max(initial=0)) + 1):
        own = np.flatnonzero(sizes >= place)
        to = shift[own] + place
        for n in range(1, min(longest, place) + 1):
            piece = table[borders[own] + place - n, n - 1]
            step = np.where(piece >= 0, scores[piece], low if n == 1 else _NEVER)
            new = best[to - n] + step
            better = new > best[to]
            best[to[better]] = new[better]
            back[to[better]] = n
    starts, lengths = [], []
    at = sizes.copy()
    while (left := np.flatnonzero(at > 0)).size:
        n = back[shift[left] + at[left]]
        at[left] -= n
        starts.append(borders[left] + at[left])
        lengths.append(n)
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    order = np.argsort(starts)
    return starts[order], lengths[order]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of ranges, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Encoder:
    """Encodes and decodes columns of texts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.matcher = Matcher(vocabulary)
        self.hashes, self.first, self.counts, self.ids = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int32))
        pieces = [p.encode("utf-8", "surrogatepass") if ok else b"" for p, ok in zip(vocabulary.pieces, vocabulary.plain, strict=True)]
        for byte, i in enumerate(vocabulary.byte_ids):
            if i >= 0:
                pieces[i] = bytes([byte])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)
        self.piece_first = np.cumsum(self.piece_sizes) - self.piece_sizes

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words one after another, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        # A code point that no text holds stands between words, so that no edge crosses.
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        begins = np.cumsum(sizes + 1) - sizes
        points[np.append(begins - 1, len(points) - 1)] = 0xFFFFFFFF
        inner = _spread(begins, sizes)
        table = self.matcher.edges(points)[inner]
        borders = np.concatenate(([0], np.cumsum(sizes)))
        relax = merged if self.vocabulary.kind == "bpe" else best_paths
        starts, lengths = relax(table, self.vocabulary.scores, borders)
        ids = table[starts, lengths - 1]
        word = np.searchsorted(borders, starts, side="right") - 1
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            if (self.vocabulary.byte_ids < 0).any():
                ids[unknown] = self.vocabulary.unknown
            else:
                point = points[inner[starts[unknown]]]
                raw = [chr(p).encode("utf-8", "surrogatepass") for p in point.tolist()]
                many = np.ones(len(ids), np.int64)
                many[unknown] = [len(r) for r in raw]
                wide, word = np.repeat(ids, many), np.repeat(word, many)
                wide[wide < 0] = self.vocabulary.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
                ids = wide
        return ids.astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a space before each text, starts and ends of words, and words by text."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
        some = pc.binary_length(texts)
        texts = pc.if_else(pc.greater(some, 0), pc.binary_join_element_wise(_ONE, texts, _NONE), texts)
        data, borders = T.utf8(texts)
        space = data == 32
        head = np.zeros(len(data) + 1, bool)
        head[borders] = True
        cut = head[:-1].copy()
        if self.vocabulary.by_words:
            cut[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(cut)
        return data, starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, borders)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the border of each."""
        data, starts, ends, first = self._words(texts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        hashes, at, which = np.unique(T.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.ids) > _KNOWN_IDS:
                self.hashes, self.first, self.counts, self.ids = (x[:0] for x in (self.hashes, self.first, self.counts, self.ids))
                new = np.arange(len(hashes))
            raw = data.tobytes()
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            ids, counts = self._encode_words(words)
            spot = np.searchsorted(self.hashes, hashes[new])
            self.hashes = np.insert(self.hashes, spot, hashes[new])
            self.first = np.insert(self.first, spot, len(self.ids) + np.cumsum(counts) - counts)
            self.counts = np.insert(self.counts, spot, counts)
            self.ids = np.concatenate((self.ids, ids))
        place = np.searchsorted(self.hashes, hashes)[which]
        counts = self.counts[place]
        ends_of = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[_spread(self.first[place], counts)], ends_of[first]

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> pa.Array:
        """The text of each run of ids, without the space in front; bytes that are no UTF-8 are replaced."""
        sizes = self.piece_sizes[ids]
        data = self.piece_bytes[_spread(self.piece_first[ids], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[borders]
        full = ends[1:] > ends[:-1]
        begin = ends[:-1].copy()
        begin[full] += data[begin[full]] == 32
        keep = np.ones(len(data), bool)
        keep[ends[:-1][begin > ends[:-1]]] = False
        offsets = np.concatenate(([0], np.cumsum(ends[1:] - begin)))
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])])
        try:
            return out.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.large_string())


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", ids_col: str = "token_ids", check: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text; ``check`` names a flag: the ids decode to the text again.

    Ids are those of the SentencePiece library for the model. Null and empty texts have no ids. The
    space mark U+2581 counts as a space, as it does there. Columns that clash with the new ones are replaced.
    """
    vocabulary = vocabulary or Vocabulary.load()
    new = [ids_col, *([check] if check else [])]
    rest = [c for c in docs.columns if c not in new]
    at = rest.index(text_col)

    def work(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(at)
            for low, high in T.slices(texts):
                part = batch.slice(low, high - low)
                ids, borders = encoder.encode(part.column(at))
                columns = [pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32()))]
                if check:
                    plain = pc.replace_substring(pc.fill_null(part.column(at), "").cast(pa.large_string()), SPACE, " ")
                    columns.append(pc.equal(encoder.decode(ids, borders), plain))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*rest, *new])

    schema = docs.select(*rest).schema.add(ids_col, S.ArrayType(S.IntegerType()))
    return docs.select(*rest).mapInArrow(work, schema.add(check, S.BooleanType()) if check else schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with the text of each list of ids; null lists give the empty text."""
    vocabulary = vocabulary or Vocabulary.load()
    rest = [c for c in tokens.columns if c != text_col]
    at = rest.index(ids_col)

    def work(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            lists = batch.column(at)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            values = np.asarray(pc.list_flatten(lists), np.int64)
            texts = encoder.decode(values, np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*rest, text_col])

    return tokens.select(*rest).mapInArrow(work, tokens.select(*rest).schema.add(text_col, S.StringType()))
