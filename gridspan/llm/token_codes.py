"""Token ids as directly addressable codes: any token can be read without block decoding.

An id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id and a bitmap
of those that go on; level 1 holds the next chunk of just these, and so on. A rank
directory (ones before every 512th bit) leads from a position to its place one level up.
A table of segments, each a run of documents in id order, is the file format; Spark
writes it as Parquet and commits it. The levels lie in the files as they are, neither
compressed nor in a dictionary, so a token is read from its bytes without decoding others.
"""

from __future__ import annotations

import gc
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, staged, text_or_empty

END_ID = 0
RANK_BITS = 512
SEGMENT_SCHEMA = (
    "shard string, segment int, first_hash long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, "
    "levels array<struct<chunks:binary,more:binary,ranks:binary>>"
)
_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SEGMENT_ARROW = pa.schema([("shard", pa.string()), ("segment", pa.int32()), ("first_hash", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("levels", pa.list_(_LEVEL))])
#: Words that a worker keeps encoded: met more than once, and met once of late.
CACHE_WORDS, RECENT_WORDS = 400_000, 200_000
#: A word of Latin letters with its space: one piece for every byte-level pattern.
PLAIN_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
#: Between a character that is neither white space nor part of it and a white space.
SAFE_CUT = re.compile(r"(?<=[!-~¡-ɏ])(?=\s)")
#: A segment ends with the document that makes it so many documents, or bytes of text.
SEGMENT_DOCS, SEGMENT_BYTES = 400, 1 << 21
#: Places of the token stream that a lookup puts in one cell.
CELL = 1 << 20
MARKS = '.,!?;:%&*$#|()"-'


def pack(ids: np.ndarray) -> list[dict]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8))).reshape(-1, RANK_BITS // 8)
        ones = np.bitwise_count(blocks).sum(1, dtype=np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append({"chunks": (rest & 255).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def unpack(levels: Iterable) -> np.ndarray:
    out = None
    for level in reversed(list(levels)):
        low = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        if out is not None:
            more = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(low), bitorder="little").astype(bool)
            low[more] |= out << 8
        out = low
    return np.zeros(0, np.uint32) if out is None else out


def token_at(levels: Iterable, place: int) -> int:
    """One id, read through the rank directories."""
    value, shift = 0, 0
    for level in levels:
        value |= level["chunks"][place] << shift
        more, byte = level["more"], place >> 3
        if not more[byte] >> (place & 7) & 1:
            break
        block = place // RANK_BITS
        inside = np.frombuffer(more[block * RANK_BITS // 8 : byte], np.uint8)
        partial = int(more[byte]) & ((1 << (place & 7)) - 1)
        place = int(np.frombuffer(level["ranks"], "<u4")[block]) + int(np.bitwise_count(inside).sum()) + partial.bit_count()
        shift += 8
    return value


class Encoder:
    """A tokenizer with the ids of words it has met. Words are cut only where the
    tokenizer's own pattern always cuts, so ids equal those of the whole text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4"
        self.words: dict[str, bytes | None] = {}
        self.recent: dict[str, bytes | None] = {}
        # what the model spells a byte as, if the byte-level pattern is all that comes before it
        self.byte_level = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        odd = iter(range(256, 512))
        self.alphabet = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(odd) for b in range(256)}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = line[0] if len(line) == 1 else -1

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """As _encoded, for words without a line break that don't end in white space: many
        become the lines of one text, as a line break between them is a token by itself."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            breaks = np.flatnonzero(ids == self.line_break)
            if len(breaks) != len(some) - 1:
                out += self._encoded(some)
                continue
            blob, size = ids.tobytes(), ids.itemsize
            starts, ends = [0, *((breaks + 1) * size).tolist()], [*(breaks * size).tolist(), len(blob)]
            out += [blob[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    def _learn(self, words: set[str]) -> None:
        """None for a word that ends in white space: what follows may change its ids."""
        known, cuts, cores = self.words, {}, {}
        for w in words:
            core = w.rstrip(MARKS)
            if w[-1].isspace():
                known[w] = None
            elif core and core != w and core[-1].isalpha():
                cuts[w] = (core, w[len(core) :])
            else:
                cores[w] = None
        for core, tail in cuts.values():
            for x in (core, tail):
                if known.get(x) is None:
                    cores[x] = None
        if self.byte_level:  # one piece of the pattern: the model alone is asked
            ids_of, spell, code = self.tokenizer.model.tokenize, self.alphabet, "H" if self.dtype == "<u2" else "I"
            for w in [w for w in cores if PLAIN_WORD(w)]:
                known[w] = array(code, [x.id for x in ids_of(w.encode().decode("latin-1").translate(spell))]).tobytes()
                del cores[w]
        plain = [w for w in cores if "\n" not in w and not w[:2].isspace()]
        known.update(zip(plain, self._encoded_words(plain), strict=True))
        others = [w for w in cores if w not in known]
        known.update(zip(others, self._encoded(others), strict=True))
        for w, (core, tail) in cuts.items():
            known[w] = known[core] + known[tail]

    def _prepare(self, new: set[str]) -> int:
        """Unknown words known; returns how many were before. Words met again come from recent."""
        known, recent = self.words, self.recent
        again = [w for w in new if w in recent]
        for w in again:
            known[w] = recent.pop(w)
        new.difference_update(again)
        before = len(known)
        self._learn(new)
        return before

    def _forget(self, before: int) -> None:
        """Words met for the first time are kept apart, so that rare ones don't fill the memory."""
        known, recent = self.words, self.recent
        for w in [*islice(reversed(known), len(known) - before)]:
            recent[w] = known.pop(w)
        if len(recent) > RECENT_WORDS:
            self.recent = dict(islice(recent.items(), len(recent) - RECENT_WORDS // 2, None))
        if len(known) > CACHE_WORDS:
            self.words = dict(islice(known.items(), CACHE_WORDS // 2))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        gc.disable()  # nothing here is cyclic, and there are many small objects
        try:
            return self._batch(texts)
        finally:
            gc.enable()

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        cut: list[list[str] | None] = []
        first: list[list[bytes | None]] = []
        new: set[str] = set()
        get = self.words.get
        for t in texts:
            parts = None
            if "\0" not in t and not any(s in t for s in self.special):
                parts = t.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
                if not parts[0]:
                    del parts[0]
            ids = [*map(get, parts or ())]
            cut.append(parts)
            first.append(ids)
            if None in ids:
                new.update([w for w, x in zip(parts, ids, strict=True) if x is None and w not in self.words])
        before = self._prepare(new)
        get, out = self.words.get, []
        for t, parts, found in zip(texts, cut, first, strict=True):
            ids = None
            if parts is not None:
                last = parts.pop() if parts and parts[-1] in (" ", "\n") else None
                if last:
                    found.pop()
                if None in found:
                    found = [*map(get, parts)]
                if None not in found:
                    ids = b"".join(found) + (self._encoded([last])[0] if last else b"")
                elif not any(s in t for s in self.special):
                    safe = [p for p in SAFE_CUT.split(t) if p]
                    ids = b"".join(self._encoded(safe))
            if ids is None:
                ids = self._encoded([t])[0]
            out.append(np.frombuffer(ids, self.dtype))
        self._forget(before)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text (null: empty), append end_id, and write segments to path.

    Documents are in ascending order of id, nulls first, repeated ids in the order of
    their texts' hashes; a segment never leaves its shard, one range of ids. Only id_col
    and text_col are read. No rows, no segments.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc, segment = uuid.uuid4().hex, encoder(vocabulary), 0
        for part in parts:
            for some in slices(part, "text", SEGMENT_DOCS, SEGMENT_BYTES):
                ids = [np.append(x, np.array([end_id], x.dtype)) for x in enc(some.column("text").to_pylist())]
                lengths = [len(x) for x in ids]
                row = {"shard": shard, "segment": segment, "first_hash": some.column("h")[0].as_py(), "doc_ids": some.column("id").to_pylist(), "doc_tokens": lengths, "n_tokens": sum(lengths), "levels": pack(np.concatenate(ids))}
                yield pa.RecordBatch.from_pylist([row], SEGMENT_ARROW)
                segment += 1

    ranged.mapInArrow(encode, SEGMENT_SCHEMA).write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, segment, start): ids before each segment. Running sums within a shard are
    distributed; over the shards, one row for every writing task, they are one small window."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("shard", "segment", "n_tokens", "first_hash", F.get("doc_ids", F.lit(0)).alias("id"))
    shards = table.groupBy("shard").agg(F.sum("n_tokens").alias("total"), F.min(F.struct("segment", "id", "first_hash")).alias("first"))
    before = F.sum("total").over(Window.orderBy(F.col("first.id").asc_nulls_first(), "first.first_hash", F.col("total").desc()).rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    inner = table.select("shard", "segment", F.coalesce(inside, F.lit(0)).alias("inside"))
    starts = inner.join(shards, "shard").select("shard", "segment", (F.col("before") + F.col("inside")).alias("start"))
    return staged(starts, "segment-starts")  # as a table it has a size, by which Spark may broadcast it


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before), n_tokens and
    ids (with the end id), decoded from the segments."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path).join(segment_starts(spark, path), ["shard", "segment"])

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                row = part.slice(at, 1).to_pylist()[0]
                ids, lengths = unpack(row["levels"]), np.asarray(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                cut = [ids[b - n : b].astype("<u4").tobytes() for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return table.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def fetch_tokens(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """(place, id) of some places in the whole token stream; only segments that hold one
    of them are read, and only the bytes that lead to a token are looked at."""
    starts = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("shard", "segment", "n_tokens").join(segment_starts(spark, path), ["shard", "segment"])
    wanted = spark.createDataFrame([(int(p), int(p) // CELL) for p in places], "place long, cell long").distinct()
    cells = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("n_tokens") - 1) / CELL)))
    at = wanted.join(starts.withColumn("cell", cells), "cell").filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_tokens")))
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("shard", "segment", "levels").join(at.select("shard", "segment", "place", "start"), ["shard", "segment"])

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [{"place": r["place"], "id": token_at(r["levels"], r["place"] - r["start"])} for r in part.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("place", pa.int64()), ("id", pa.int64())]))

    return table.mapInArrow(pick, "place long, id long")


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(x) for x in ids.to_pylist()], pa.int64())

    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))
