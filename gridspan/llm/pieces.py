"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Words of equal length advance together, one character a step: the hashes of all
substrings that end there probe the sorted hashes of the pieces, and vectorised maxima
keep the best way to every place as a backpointer. A unigram model takes the greatest
sum of scores. For a merge (BPE) model that sum isn't what SentencePiece computes; there
a way is only open if its last two pieces are ones that the merges would leave side by
side, which leaves exactly one way to each place: the merges' own result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .hashing import BASE, mix

SPACE = "▁"
#: Words that a worker keeps encoded (met more than once, and met once of late), and
#: remembered pairs of pieces (a power of two).
CACHE_WORDS, RECENT_WORDS = 300_000, 150_000
PAIRS = 1 << 20
#: Characters of a batch of words.
BATCH = 1 << 18
#: Documents encoded together, and their characters, if one hasn't more.
DOCS, CHARS = 400, 1 << 21
#: Longer words are cut where no piece can lie across.
LONG = 64
NO_LIMIT = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        at += n
        yield key >> 3, data[at - n : at]


def is_bpe(model: bytes) -> bool:
    """trainer_spec.model_type: 2 is BPE, 1 (also if absent) unigram; others aren't supported."""
    spec = dict(_fields(model)).get(2, b"")  # of a repeated field the last value counts
    kind = dict(_fields(spec)).get(3, 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return kind == 2


def _powers(n: int) -> np.ndarray:
    steps = np.full(n + 1, BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Codec:
    """A model's pieces as sorted hashes by length, and words already encoded."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bpe = is_bpe(model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        names = [sp.id_to_piece(i) for i in range(n)]
        self.dtype = "<u2" if n < 1 << 16 else "<u4"
        self.unknown = sp.unk_id()
        bytes_of = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else None
        self.surface = [b"" if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.surface[self.unknown] = " ⁇ ".encode()
        self.prefixed = sp.normalize("a").startswith(SPACE)
        pieces = {names[i]: i for i in range(n) if not special[i]}
        self.scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
        # pieces by rank: single characters, which no merge makes, before merges in their order
        order = sorted(pieces, key=lambda p: (len(p) > 1, -self.scores[pieces[p]], pieces[p]))
        rank = {p: r for r, p in enumerate(order)}
        if self.bpe:
            order = self._merges(order, rank)
        self.ids = np.array([pieces[p] for p in sorted(rank, key=rank.get)], np.int64)
        self.rank_scores = self.scores[self.ids]
        self.unknown_score = self.scores[list(pieces.values())].min(initial=0.0) - 10
        self.by_length = {}
        for length in sorted({len(p) for p in order}):
            some = [p for p in order if len(p) == length]
            h = self._hashes(np.array([[ord(c) for c in p] for p in some], np.uint32).reshape(len(some), length))
            keys = h[:, length] - h[:, 0] * _powers(length)[length]
            at = np.argsort(keys)
            if len(keys) > 1 and (np.diff(keys[at]) == 0).any():
                raise ValueError("two pieces have the same hash")
            codes = np.array([[ord(c) for c in p] for p in some], np.uint32).reshape(len(some), length)
            self.by_length[length] = (keys[at], np.array([rank[p] for p in some], np.int64)[at], codes[at])
        self.longest = max(self.by_length, default=1)
        self.split_words = not any(SPACE in p.lstrip(SPACE) for p in order)
        self.words: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.characters = frozenset("".join(order))
        self.neighbours = frozenset(p[i : i + 2] for p in order for i in range(len(p) - 1))
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    @staticmethod
    def _hashes(codes: np.ndarray) -> np.ndarray:
        """Prefix polynomials: column e is the hash of the first e characters."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        terms = mix(codes.astype(np.uint64) + np.uint64(0x51ED270B)) | np.uint64(1)
        for e in range(codes.shape[1]):
            out[:, e + 1] = out[:, e] * np.uint64(BASE) + terms[:, e]
        return out

    # merge models

    def _merges(self, order: list[str], rank: dict[str, int]) -> list[str]:
        """Split every piece at its last merge; returns the pieces that merges can reach."""
        n = len(order)
        self.left, self.right = np.arange(n), np.arange(n)
        merged: dict[tuple[int, int], int] = {}

        def fits(a: int, b: int) -> bool:
            limit = NO_LIMIT
            while True:
                if merged.get((a, b), NO_LIMIT) < limit:
                    return False
                if a > b:
                    limit, x = a, int(self.right[a])
                    if x != a:
                        a = x
                        continue
                    limit, x = b + 1, int(self.left[b])
                    if x == b:
                        return True
                    b = x
                else:
                    limit, x = b + 1, int(self.left[b])
                    if x != b:
                        b = x
                        continue
                    limit, x = a, int(self.right[a])
                    if x == a:
                        return True
                    a = x

        reached, ranks = [], set()
        for r, p in enumerate(order):
            found = len(p) == 1
            for cut in range(1, len(p)):
                a, b = rank.get(p[:cut]), rank.get(p[cut:])
                if a in ranks and b in ranks and fits(a, b):
                    self.left[r], self.right[r] = a, b
                    merged[a, b] = r
                    found = True
                    break
            if found:
                reached.append(p)
                ranks.add(r)
        keys = np.array([a * n + b for a, b in merged], np.int64)
        at = np.argsort(keys)
        self.merge_keys, self.merge_ranks, self.n_ranks = keys[at], np.array(list(merged.values()), np.int64)[at], n
        return reached

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave these neighbours apart, for pairs of ranks: undo merges from
        the last one, and see that none across the border came before."""
        a, b = a.copy(), b.copy()
        limit, out, live = np.full(len(a), NO_LIMIT), np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n_ranks + y
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            crossed = (self.merge_keys[at] == key) & (self.merge_ranks[at] < limit[live])
            out[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            nx, ny = self.right[x], self.left[y]
            cut_x = (nx != x) & ((x > y) | (ny == y))  # the later merge of both, if it is one
            cut_y = ~cut_x & (ny != y)
            limit[live[cut_x]], limit[live[cut_y]] = x[cut_x], y[cut_y] + 1
            a[live[cut_x]], b[live[cut_y]] = nx[cut_x], ny[cut_y]
            live = live[cut_x | cut_y]
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n_ranks + b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) & (PAIRS - 1)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            distinct, where = np.unique(key[new], return_inverse=True)
            fits = self._side_by_side(distinct // self.n_ranks, distinct % self.n_ranks)[where]
            out[new] = fits
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = key[new], fits
        return out

    # both kinds

    def _ways(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers of words in the rows of codes: the rank of the last piece of every
        prefix (-1: an unknown character) and its length."""
        n, length = codes.shape
        hashes, powers = self._hashes(codes), _powers(self.longest)
        last, size = np.full((n, length + 1), -1, np.int64), np.ones((n, length + 1), np.int64)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        for e in range(1, length + 1):
            if not self.bpe:
                best[:, e] = best[:, e - 1] + self.unknown_score
            open_rows = np.arange(n)
            for k in sorted((k for k in self.by_length if k <= e), reverse=True):
                keys, ranks, spelled = self.by_length[k]
                probe = hashes[open_rows, e] - hashes[open_rows, e - k] * powers[k]
                at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == probe)
                hit = hit[(codes[open_rows[hit], e - k : e] == spelled[at[hit]]).all(1)]  # the hash is no proof
                rows, piece = open_rows[hit], ranks[at[hit]]
                if not len(rows):
                    continue
                if self.bpe:
                    before = last[rows, e - k]
                    fits = (before < 0) | (e == k)
                    check = np.flatnonzero(~fits)
                    if len(check):
                        fits[check] = self._fits(before[check], piece[check])
                    rows, piece = rows[fits], piece[fits]
                    last[rows, e], size[rows, e] = piece, k
                    done = np.zeros(n, bool)
                    done[rows] = True
                    open_rows = open_rows[~done[open_rows]]
                    if not len(open_rows):
                        break
                else:
                    score = best[rows, e - k] + self.rank_scores[piece]
                    better = score > best[rows, e]
                    rows, piece = rows[better], piece[better]
                    best[rows, e], last[rows, e], size[rows, e] = score[better], piece, k
        return last, size

    def _learn(self, words: list[str]) -> None:
        words.sort(key=len)
        start = 0
        while start < len(words):
            # equal lengths up to 32 characters; longer words go with up to an eighth longer ones
            length, stop = len(words[start]), start
            most = length if length <= 32 else length + length // 8
            while stop < len(words) and len(words[stop]) <= most and (stop - start) * most < BATCH:
                stop += 1
            some = words[start:stop]
            width = len(some[-1])
            joined = "".join(w.ljust(width, "\0") for w in some)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), width)
            last, size = self._ways(codes)
            at = np.array([len(w) for w in some])
            tokens = []  # from the last piece back
            places = []
            rows = np.arange(len(some))
            while (at > 0).any():
                tokens.append(np.where(at > 0, last[rows, at], -2))
                places.append(at)
                at = np.where(at > 0, at - size[rows, at], 0)
            table = np.array(tokens[::-1]).T
            where = np.array(places[::-1]).T
            odd = (table == -1).any(1)
            known = np.where(table >= 0, self.ids[np.maximum(table, 0)], 0).astype(self.dtype)
            keep = table != -2
            flat, counts = known[keep], keep.sum(1)
            ends = np.cumsum(counts) * flat.itemsize
            blob, begins = flat.tobytes(), ends - counts * flat.itemsize
            for i, (w, a, b) in enumerate(zip(some, begins.tolist(), ends.tolist(), strict=True)):
                self.words[w] = self._with_unknown(w, table[i], where[i]) if odd[i] else blob[a:b]
            start = stop

    def _with_unknown(self, word: str, ranks: np.ndarray, ends: np.ndarray) -> bytes:
        out: list[int] = []
        for r, e in zip(ranks.tolist(), ends.tolist(), strict=True):
            if r >= 0:
                out.append(int(self.ids[r]))
            elif r == -1 and self.byte_ids:
                out += [self.byte_ids[b] for b in word[e - 1].encode("utf-8", "surrogatepass")]
            elif r == -1 and (not out or out[-1] != self.unknown):
                out.append(self.unknown)
        return np.array(out, self.dtype).tobytes()

    def _cut(self, text: str) -> list[str]:
        """Words, each with the spaces before it."""
        text = self.library.normalize(text)
        if not self.split_words:
            return [text] if text else []
        head, *rest = text.split(SPACE)
        out, spaces = [head] if head else [], SPACE
        for word in rest:
            if word:
                out.append(spaces + word)
                spaces = SPACE
            else:
                spaces += SPACE
        if len(spaces) > 1:
            out.append(spaces[1:])
        return out

    def _apart(self, word: str) -> list[str]:
        """A word cut between any two neighbours that no piece holds, so that a text without
        spaces is many short words instead of one long row."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.neighbours), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, recent = self.words, self.recent
        cut = [self._cut(t) for t in texts]
        new = {w for words in cut for w in words if w not in known}
        for w in [w for w in new if w in recent]:
            known[w] = recent.pop(w)
        new.difference_update(known)
        before = len(known)
        lines = {w: w.split("\n") for w in new if "\n" in w} if self.byte_ids and "\n" not in self.characters else {}
        todo = {p for parts in lines.values() for p in parts if p and p not in known} | (new - lines.keys())
        long = {w: self._apart(w) for w in todo if len(w) > LONG} if self.byte_ids else {}
        self._learn(list({p for parts in long.values() for p in parts if p not in known} | (todo - long.keys())))
        for w, parts in long.items():
            known[w] = b"".join(map(known.__getitem__, parts))
        if lines:  # an unknown character: no piece reaches over it
            end = self._with_unknown("\n", np.array([-1]), np.array([1]))
            for w, parts in lines.items():
                known[w] = end.join(known[p] if p else b"" for p in parts)
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), self.dtype) for words in cut]
        for w in [*islice(reversed(known), len(known) - before)]:  # met once; rare words don't fill the memory
            recent[w] = known.pop(w)
        if len(recent) > RECENT_WORDS:
            self.recent = dict(islice(recent.items(), len(recent) - RECENT_WORDS // 2, None))
        if len(known) > CACHE_WORDS:
            self.words = dict(islice(known.items(), CACHE_WORDS // 2))
        return out

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefixed and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(id_col, ids, n_tokens, round_trip) for every row: the ids of the whole text, and
    whether they decode to it.

    ids is an array of integers, or packed as unsigned little-endian integers of 2 bytes (4
    if the model has more than 65536 pieces). Null and empty texts have no ids; repeated
    rows and null ids stay; other columns aren't read. model is a path that every
    executor has.
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in parts:
            for some in slices(part, "text", DOCS, CHARS):
                texts = some.column("text").to_pylist()
                ids = own.encode(texts)
                same = [own.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                lengths = np.array([len(x) for x in ids], np.int64)
                if packed:
                    column = pa.array([x.tobytes() for x in ids], pa.binary())
                else:
                    column = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column("id"), column, pa.array(lengths), pa.array(same, pa.bool_())], ["id", "ids", "n_tokens", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(encode, f"id {kind}, ids {'binary' if packed else 'array<int>'}, n_tokens long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) from (id_col, ids); null ids give a null text."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in parts:
            texts = [None if x is None else own.decode(np.asarray(x, np.int64)) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), packed=True)
    return rows.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "round_trip")
