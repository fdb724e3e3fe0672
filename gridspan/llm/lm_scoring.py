"""Log probabilities of texts under a smoothed trigram model of the corpus.

The model is cut into parts by the middle word of a triple, so no task holds all of it and
its size is that of the corpus. Blocks of documents send each distinct triple once to the
part that it belongs to; the part counts what training documents sent, builds its trie
(ngram_trie.py), looks up every triple that any block sent, and sends two small codes back.

    p(c | a, b) = (n(abc) + MU_PAIR p(c | b)) / (n(ab) + MU_PAIR)
    p(c | b)    = (n(bc) + MU_WORD p(c)) / (n(b) + MU_WORD)
    p(c)        = (n(c) + 0.1) / (N + 0.1 (V + 1))

A word so frequent that its triples would fill several parts is spread over them by the word
before; its pairs (b, c) are then counted in parts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged
from .hashing import PRINTED, hashed_spans, mix
from .ngram_trie import MU_WORD, Trie, probabilities, quantised

#: Tokens of a block of documents, if one isn't longer, and bytes of text read at a time.
BLOCK_TOKENS, TEXT_BYTES = 1 << 19, 1 << 19
#: Parts of the model and of the lexicon at least, and tokens or words for one beyond that.
LEAST_PARTS, PART_TOKENS = 256, 1 << 19
#: A word is spread if it has the tokens of more than so many parts.
SPREAD = 4
#: The end of a document, as a word; and what stands before its first.
END, BEGIN = 0, 0
#: Triples whose word in the middle isn't spread, pairs of spread words, triples of spread words.
TRIPLES, PAIRS, SPREAD_TRIPLES = 1, 2, 3

_BLOCK = "block long, n_words long, n_tokens long, doc_ids array<long>, sizes array<int>, held array<boolean>, words binary, uses binary, tokens binary"
_ROUTED = "block long, doc_ids array<long>, sizes array<int>, held array<boolean>, end int, parts binary, tokens binary"
_LEXICON = "block long, part int, ids binary, counts binary, n long, v long"
_ASKED = "part int, block long, kind int, b binary, a binary, c binary, n binary"
_ANSWER = "block long, part int, kind int, p binary, weight binary"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _packed(a: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).data)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def _table(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _blocks(texts: DataFrame, block_tokens: int) -> DataFrame:
    """(id, held, text) to blocks of documents: their distinct words as hashes, the most used
    first, how often training documents use each, and all tokens as places in that list."""

    def row(number: int, ids: list, held: list, sizes: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.concatenate(sizes)
        ends = np.cumsum(sizes + 1) - 1
        every = np.full(ends[-1] + 1, END, np.uint64)
        is_word = np.ones(len(every), bool)
        is_word[ends] = False
        every[is_word] = np.concatenate(hashes)
        words, of, uses = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(-uses, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        tokens = place[of]
        learned = ~np.repeat(np.array(held, bool), sizes + 1)
        uses = np.bincount(tokens[learned], minlength=len(words)).astype(np.uint32)
        return _table(_BLOCK, [[number], [len(words)], [len(tokens)], [ids], [(sizes + 1).astype(np.int32)], [held], [words[order].tobytes()], [_packed(uses)], [_packed(tokens)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held_back = TaskContext.get().partitionId() << 32, ([], [], [], [])
        for batch in batches:
            for part in slices(batch, "text", 1 << 16, TEXT_BYTES):
                texts = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                starts, _, hashes = hashed_spans(b"\n".join(texts).lower(), PRINTED)
                bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
                sizes = np.diff(np.searchsorted(starts, bounds))
                for kept, new in zip(held_back, (part.column("id").to_pylist(), part.column("held").to_pylist(), [sizes], [hashes]), strict=True):
                    kept.extend(new)
                if sum(map(len, held_back[3])) >= block_tokens:
                    yield row(number, *held_back)
                    number, held_back = number + 1, ([], [], [], [])
        if held_back[0]:
            yield row(number, *held_back)

    return texts.mapInArrow(cut, _BLOCK)


def _lexicon(blocks: DataFrame, parts: int) -> DataFrame:
    """For each block and part of the lexicon the ids (from 1, in a part the most used first)
    and training counts of the block's words in it; n and v sum counts and count words, once a part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, uses in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "uses")), strict=True):
                words, uses = np.frombuffer(words, np.uint64), _unpacked(uses, np.uint32)
                for p, at in _dealt((words % np.uint64(parts)).astype(np.int64)):
                    yield _table("part int, block long, words binary, uses binary", [[p], [block], [words[at].tobytes()], [_packed(uses[at])]])

    def count(asked: pa.Table) -> pa.Table:
        part = asked.column("part")[0].as_py()
        lists = [np.frombuffer(w, np.uint64) for w in asked.column("words").to_pylist()]
        words, of = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.bincount(of, np.concatenate([_unpacked(u, np.uint32) for u in asked.column("uses").to_pylist()]), len(words)).astype(np.uint64)
        ids = np.empty(len(words), np.uint64)
        ids[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(words), dtype=np.uint64) * np.uint64(parts) + np.uint64(part + 1)
        cuts = np.split(of, np.cumsum([len(x) for x in lists])[:-1])
        sums = [[int(counts.sum()), *[0] * (len(lists) - 1)], [int((counts > 0).sum()), *[0] * (len(lists) - 1)]]
        return pa.Table.from_batches([_table(_LEXICON, [asked.column("block").to_pylist(), [part] * len(lists), [_packed(ids[x]) for x in cuts], [_packed(counts[x]) for x in cuts], *sums])])

    asked = blocks.select("block", "words", "uses").mapInArrow(ask, "part int, block long, words binary, uses binary")
    return asked.groupBy("part").applyInArrow(count, _LEXICON)


def _routed(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks with the part of the lexicon that each word is in, instead of its hash; end is the place of END."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                yield _table(_ROUTED, [[row["block"]], [row["doc_ids"]], [row["sizes"]], [row["held"]], [int(np.flatnonzero(words == END)[0])], [_packed((words % np.uint64(parts)).astype(np.uint32))], [row["tokens"]]])

    return blocks.select("block", "doc_ids", "sizes", "held", "words", "tokens").mapInArrow(route, _ROUTED)


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with the places where it does, in ascending order."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=False):
        yield int(part[order[a]]), order[a:b]


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row of small numbers, in ascending order, and the row that each is."""
    key = columns[0].astype(np.uint64)
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    for c, width in zip(columns[1:], bits[1:], strict=True):
        if bits[0] + width > 64:  # number the rows so far
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            bits[0] = len(key).bit_length()
        key = key << np.uint64(width) | c.astype(np.uint64)
        bits[0] += width
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    return first, of


class _Block:
    """A block with its words' ids and counts: its distinct triples, and the parts they go to."""

    def __init__(self, row: dict, lexicon: list[dict], parts: int, total: int, spread: int) -> None:
        part, self.tokens = _unpacked(row["parts"], np.uint32).astype(np.int64), _unpacked(row["tokens"], np.uint32)
        ids, counts = np.zeros((2, len(part) + 1), np.uint64)  # BEGIN comes first
        given = {x["part"]: x for x in lexicon}
        for p, at in _dealt(part):
            ids[at + 1], counts[at + 1] = _unpacked(given[p]["ids"], np.uint64), _unpacked(given[p]["counts"], np.uint64)
        counts[BEGIN] = counts[1 + row["end"]]
        self.counts = counts
        self.sizes = np.array(row["sizes"], np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        c = self.tokens.astype(np.int64) + 1
        b, a = np.concatenate([[BEGIN], c[:-1]]), np.concatenate([[BEGIN, BEGIN], c[:-2]])[: len(c)]
        b[starts] = a[starts] = BEGIN
        second = starts[self.sizes > 1] + 1
        a[second] = BEGIN
        first, self.of = _distinct(b, a, c)
        self.b, self.a, self.c = b[first], a[first], c[first]
        learned = ~np.repeat(np.array(row["held"], bool), self.sizes)
        self.n = np.bincount(self.of[learned], minlength=len(first)).astype(np.uint32)
        self.ids, self.parts = ids, parts
        often = counts * np.uint64(parts) > np.uint64(spread * total)
        self.salts = np.where(often, counts * np.uint64(parts) // np.uint64(max(1, 2 * total)) + np.uint64(1), np.uint64(1))
        self.spread = often[self.b]

    def asked(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(part, kind, places of triples) of every part that is asked. Of a pair one triple stands for all."""
        b, a, c = self.ids[self.b], self.ids[self.a], self.ids[self.c]
        salt = mix(a) % self.salts[self.b]
        to = (mix(b * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(self.parts)).astype(np.int64)
        for kind, some in ((TRIPLES, np.flatnonzero(~self.spread)), (SPREAD_TRIPLES, np.flatnonzero(self.spread))):
            for p, at in _dealt(to[some]):
                yield p, kind, some[at]
        some = np.flatnonzero(self.spread)
        first, self.pair_of = _distinct(self.b[some], self.c[some])
        self.pair_n = np.bincount(self.pair_of, self.n[some], len(first)).astype(np.uint32)
        self.pairs = some[first]
        to = (mix(b[self.pairs] * np.uint64(0x9E3779B97F4A7C15) ^ mix(c[self.pairs])) % np.uint64(self.parts)).astype(np.int64)
        for p, at in _dealt(to):
            yield p, PAIRS, at


def _answers(blocks: DataFrame, lexicon: DataFrame, parts: int, total: int, spread: int) -> DataFrame:
    """For each block, part and kind what the part knows of the triples or pairs that the block
    sent: codes of p and weight, as Trie gives them; of pairs p is how often they occur, over total."""

    def ask(block: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            x = _Block(row, words.to_pylist(), parts, total, spread)
            for p, kind, at in x.asked():
                n, at = (x.pair_n[at], x.pairs[at]) if kind == PAIRS else (x.n[at], at)
                a = x.ids[x.a[at]] if kind != PAIRS else np.zeros(len(at), np.uint64)
                out.append((p, row["block"], kind, _packed(x.ids[x.b[at]]), _packed(a), _packed(x.ids[x.c[at]]), _packed(n)))
        return pa.Table.from_batches([_table(_ASKED, list(zip(*out, strict=True)) or [[]] * 7)])

    def answer(asked: pa.Table) -> pa.Table:
        out = []
        for kind in (TRIPLES, PAIRS, SPREAD_TRIPLES):
            rows = [x for x in asked.to_pylist() if x["kind"] == kind]
            if not rows:
                continue
            b, a, c = (np.concatenate([_unpacked(x[k], np.uint64) for x in rows]) for k in "bac")
            n = [_unpacked(x["n"], np.uint32) for x in rows]
            cuts = np.cumsum([len(x) for x in n])[:-1]
            local = [np.unique(v, return_inverse=True)[1] for v in (b, a, c)]
            first, of = _distinct(*local)
            del local
            n = np.bincount(of, np.concatenate(n), len(first))
            b, a, c = (v[first].astype(np.int64) for v in (b, a, c))
            if kind == PAIRS:
                p, weight = n / max(1, total), np.zeros(len(n))
            else:
                seen = n > 0
                p, weight = Trie(b[seen], a[seen], c[seen], n[seen], kind == TRIPLES)(b, a, c)
            for x, mine, left in zip(rows, np.split(quantised(p)[of], cuts), np.split(quantised(weight)[of], cuts), strict=True):
                out.append((x["block"], x["part"], kind, _packed(mine), b"" if kind == PAIRS else _packed(left)))
        return pa.Table.from_batches([_table(_ANSWER, list(zip(*out, strict=True)))])

    asked = blocks.groupBy("block").cogroup(lexicon.groupBy("block")).applyInArrow(ask, _ASKED)
    return asked.groupBy("part").applyInArrow(answer, _ANSWER)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, least_parts: int = LEAST_PARTS, part_tokens: int = PART_TOKENS, spread: int = SPREAD) -> DataFrame:
    """For each row of docs doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score: log10 probabilities of the whole text and its end under single words and under the
    trigram model, both learned from the rows that held_out (a boolean column; null: held
    out) leaves.

    Null texts are empty and have one token, their end. Repeated rows count as often as they
    occur, other columns aren't read, null ids stay. An empty table gives an empty one; without
    training documents every token has the probability 1. Words are known by 64-bit hashes. A
    text is held whole by one task, with some 200 bytes a token.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(True)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = staged(_blocks(texts, block_tokens), "blocks")
    tokens, words = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts, lexicon_parts = max(least_parts, tokens // part_tokens), max(least_parts, words // part_tokens)
    lexicon = staged(_lexicon(blocks, lexicon_parts), "lexicon")
    total, distinct = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    blocks = _routed(blocks, lexicon_parts)
    answers = _answers(blocks, lexicon, parts, total, spread)

    def score(block: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        given = given.to_pylist()
        for row in block.to_pylist():
            x = _Block(row, [g for g in given if not g["kind"]], parts, total, spread)
            known = {(g["part"], g["kind"]): g for g in given if g["kind"]}
            p, weight, pair = np.zeros(len(x.n)), np.zeros(len(x.n)), None
            for to, kind, at in x.asked():
                found = known[to, kind]
                if kind == PAIRS:
                    pair = np.zeros(len(x.pairs)) if pair is None else pair
                    pair[at] = probabilities(_unpacked(found["p"], np.uint16)) * total
                else:
                    p[at], weight[at] = probabilities(_unpacked(found["p"], np.uint16)), probabilities(_unpacked(found["weight"], np.uint16))
            counts = x.counts.astype(np.float64)
            base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
            lowest = 10 ** base[x.c] * MU_WORD
            if pair is not None:
                lowest[x.spread] += pair[x.pair_of]
            tokens = np.log10(p + weight * lowest / (counts[x.b] + MU_WORD))[x.of]
            starts = np.cumsum(x.sizes) - x.sizes
            of = x.tokens.astype(np.int64) + 1
            sums = lambda v: np.add.reduceat(v, starts)
            out.append(_table(_SCORE, [row["doc_ids"], row["held"], x.sizes, sums((x.counts[of] > 0).astype(np.int64)), np.full(len(starts), total), sums(base[of]), sums(tokens)]))
        return pa.Table.from_batches(out or [_table(_SCORE, [[]] * 7)])

    none = F.lit(None).cast("binary")
    replies = answers.select("block", "part", "kind", "p", "weight", none.alias("ids"), none.alias("counts"))
    replies = replies.union(lexicon.select("block", "part", F.lit(0).alias("kind"), none, none, "ids", "counts"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, _SCORE)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
