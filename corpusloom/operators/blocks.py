"""The indexed tokens of whole documents, numbered, counted and grouped in blocks by the Python workers.

The JVM finds the runs of a text; what a run stands for is told once for each different run of a block, and the rest is arithmetic on arrays. What
is shuffled are the texts; no token is a row before its document is done. A worker holds one batch of rows and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.words import STOP_WORDS, stem
from ..runtime import ship
from .tokens import LONGEST, runs

BLOCK = 1 << 19  # tokens of a block; of one document there may be more
KNOWN = 1 << 18  # runs whose term a worker keeps
PACK = 1 << 20  # postings that are packed at once
_known: dict[str, tuple[str | None, str | None]] = {}
_stops = frozenset(STOP_WORDS)


def told(run: str) -> tuple[str | None, str | None]:
    """The term that is indexed for a run and the word that feeds the n-grams, or None; as tokens.listed has them."""
    if "://" in run or "@" in run:
        return (run if len(run.encode()) <= LONGEST else None), None
    if "." in run:
        return None, None
    token = run.lower()
    digits = run.isdigit() if run.isascii() else all(map(str.isdecimal, run))
    if digits:
        return None, None
    if run.isalpha() if run.isascii() else not any(map(str.isdecimal, run)):
        if token in _stops:
            return None, None
        term = stem(token)
        return (term if len(term.encode()) <= LONGEST else None), token
    return (token if len(token.encode()) <= LONGEST else None), None


def _coded(flat: pa.Array, which: int) -> tuple[np.ndarray, pa.Array]:
    """A number for each run, -1 for those that stand for nothing, and what the numbers mean."""
    encoded = flat.dictionary_encode()
    if len(_known) > KNOWN:
        _known.clear()
    numbers: dict[str, int] = {}
    table = np.empty(len(encoded.dictionary), np.int32)
    for k, run in enumerate(encoded.dictionary.to_pylist()):
        both = _known.get(run)
        if both is None:
            both = _known[run] = told(run)
        value = both[which]
        table[k] = -1 if value is None else numbers.setdefault(value, len(numbers))
    code = table[encoded.indices.to_numpy()] if len(flat) else np.empty(0, np.int32)
    return code, pa.array(numbers, pa.string())


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about a block of tokens, one row at least."""
    for b in batches:
        ends, at = np.cumsum(_sizes(b.column("runs"))), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            yield b.slice(at, to - at)
            at = to


def _begins(ids: pa.Array) -> np.ndarray:
    """Whether a row is the first of its document."""
    a, b = ids[1:], ids[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
    return np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)]) if len(ids) else np.empty(0, bool)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, which are sorted by document, in blocks of whole documents."""
    held: list[pa.RecordBatch] = []
    tokens = 0
    for piece in _pieces(batches):
        held.append(piece)
        tokens += int(_sizes(piece.column("runs")).sum())
        if tokens >= BLOCK:
            whole = pa.concat_batches(held)
            cut = int(np.flatnonzero(_begins(whole.column("doc_id")))[-1])
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
            tokens = int(_sizes(held[0].column("runs")).sum()) if cut else 0  # a long document is put together at each further block only
    if held:
        yield pa.concat_batches(held)


class _Block:
    """Of whole documents: ids, and for each indexed token its row, document, term and place in the document."""

    def __init__(self, b: pa.RecordBatch):
        code, self.terms = _coded(b.column("runs").flatten(), 0)
        begins = _begins(b.column("doc_id"))
        number = np.cumsum(begins) - 1
        self.ids = b.column("doc_id").take(pa.array(np.flatnonzero(begins)))
        self.row = np.repeat(np.arange(b.num_rows), _sizes(b.column("runs")))[code >= 0]
        self.code = code[code >= 0]
        self.doc = number[self.row]
        n = np.bincount(self.doc, minlength=len(self.ids))
        self.pos = np.arange(len(self.doc)) - (np.cumsum(n) - n)[self.doc]

    def grouped(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of tokens by document, term and place, and where in it the documents' terms begin."""
        key = self.doc * len(self.terms) + self.code
        order = np.argsort(key, kind="stable")
        key = key[order]
        return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)

    def named(self, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """doc_id and term of tokens."""
        return self.ids.take(pa.array(self.doc[at])), self.terms.take(pa.array(self.code[at]))


def _mapped(passages: DataFrame, f, schema: str, whole: bool = True) -> DataFrame:
    """f: a record batch to another, over blocks of whole documents, or else of any rows."""
    ship(passages.sparkSession)
    p = passages.select("doc_id", "ord", "type", "text")
    if whole:
        p = p.repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    p = p.select("doc_id", "ord", "type", runs(F.col("text")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _documents(batches):
            out = f(b)
            for at in range(0, out.num_rows, BLOCK // 8):
                yield out.slice(at, BLOCK // 8)

    return p.mapInArrow(run, schema) if whole else p.mapInArrow(f, schema)


def _key(passages: DataFrame) -> str:
    return passages.schema["doc_id"].dataType.simpleString()


def positioned(passages: DataFrame) -> DataFrame:
    """doc_id, type, term, pos of every indexed token."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _Block(b)
        ids, terms = x.named(np.arange(len(x.doc)))
        return pa.record_batch([ids, b.column("type").take(pa.array(x.row)), terms, pa.array(x.pos.astype(np.int32))], ["doc_id", "type", "term", "pos"])

    return _mapped(passages, f, f"doc_id {_key(passages)}, type string, term string, pos int")


def term_counts(passages: DataFrame) -> DataFrame:
    """doc_id, term, tf."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _Block(b)
        order, begin = x.grouped()
        return pa.record_batch([*x.named(order[begin]), pa.array(np.diff(begin, append=len(order)))], ["doc_id", "term", "tf"])

    return _mapped(passages, f, f"doc_id {_key(passages)}, term string, tf bigint")


def document_frequencies(passages: DataFrame) -> DataFrame:
    """term, df: summed up over the documents of a block first."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _Block(b)
        order, begin = x.grouped()
        n = np.bincount(x.code[order[begin]], minlength=len(x.terms))
        return pa.record_batch([x.terms, pa.array(n)], ["term", "n"])

    return _mapped(passages, f, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def postings(passages: DataFrame, most: int) -> DataFrame:
    """doc_id, term, tf, positions: of those the first most."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _Block(b)
        order, begin = x.grouped()
        tf = np.diff(begin, append=len(order))
        kept = order[np.arange(len(order)) - np.repeat(begin, tf) < most]
        offsets = np.concatenate([[0], np.cumsum(np.minimum(tf, most))]).astype(np.int32)
        at = pa.StructArray.from_arrays([pa.array(x.pos[kept].astype(np.int32)), b.column("type").take(pa.array(x.row[kept]))], ["i", "type"])
        return pa.record_batch([*x.named(order[begin]), pa.array(tf.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), at)], ["doc_id", "term", "tf", "positions"])

    return _mapped(passages, f, f"doc_id {_key(passages)}, term string, tf int, positions array<struct<i:int,type:string>>")


def first_words(passages: DataFrame) -> DataFrame:
    """word, doc_id, place: of each part of the passages the least document with a word, and there the least place: ord * 2^32 + its number among the passage's different words."""
    key = _key(passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, found = None, {}

        def out() -> pa.RecordBatch:
            firsts = list(found.values())
            return pa.record_batch([pa.array(found, pa.string()), pa.array([x[1] for x in firsts], kind), pa.array([x[2] for x in firsts], pa.int64())], ["word", "doc_id", "place"])

        for b in _pieces(batches):
            kind = b.column("doc_id").type
            code, words = _coded(b.column("runs").flatten(), 1)
            row = np.repeat(np.arange(b.num_rows), _sizes(b.column("runs")))[code >= 0]
            code = code[code >= 0]
            first = np.sort(np.unique(row * len(words) + code, return_index=True)[1])
            row, code = row[first], code[first]
            n = np.bincount(row, minlength=b.num_rows)
            place = (b.column("ord").to_numpy(zero_copy_only=False).astype(np.int64)[row] << 32) + np.arange(len(row)) - (np.cumsum(n) - n)[row]
            by_id = np.empty(b.num_rows, np.int64)
            by_id[pc.sort_indices(b.column("doc_id")).to_numpy()] = np.arange(b.num_rows)
            ids = b.column("doc_id")
            # equal ids get one number, so that the place decides among them
            order = np.argsort(by_id)
            by_id[order] = np.cumsum(_begins(ids.take(pa.array(order)))) - 1 if len(order) else by_id
            best = np.lexsort((place, by_id[row], code))
            best = best[np.concatenate([[True], code[best][1:] != code[best][:-1]])] if len(best) else best
            for w, i, p in zip(words.take(pa.array(code[best])).to_pylist(), ids.take(pa.array(row[best])).to_pylist(), place[best].tolist()):
                this = i is None, i, p
                if (known := found.get(w)) is None or this < known:
                    found[w] = this
            if len(found) > KNOWN:
                yield out()
                found = {}
        if found:
            yield out()

    return _mapped(passages, run, f"word string, doc_id {key}, place bigint", whole=False)


def packed(postings: DataFrame) -> DataFrame:
    """Postings with a part (int) as few rows of part and compressed postings, for a shuffle."""
    ship(postings.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, [("part", "ascending"), ("term", "ascending")])).combine_chunks()
            part = t["part"].to_numpy()
            t = t.drop_columns("part")
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = []
            for a, z in zip(begin, np.append(begin[1:], len(part))):
                sink = pa.BufferOutputStream()
                pq.write_table(t.slice(a, z - a), sink, compression="zstd", write_statistics=False)
                blobs.append(sink.getvalue().to_pybytes())
            return pa.record_batch([pa.array(part[begin], pa.int32()), pa.array(blobs, pa.binary())], ["part", "body"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return postings.mapInArrow(run, "part int, body binary")


def unpacked(packed: DataFrame, schema: StructType) -> DataFrame:
    """The postings of packed ones; schema: as they were, without the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("body"):
                yield from pq.ParquetFile(pa.BufferReader(body.as_buffer())).iter_batches()

    return packed.mapInArrow(run, schema)
