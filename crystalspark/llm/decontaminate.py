"""Benchmark decontamination with a broadcast set of test n-grams.

Benchmark items become windows of ``n`` normalised words (an item of fewer
words, but not none, is one window). The windows go to every task as arrays of
64-bit rolling hashes over word numbers with the exact words beside them;
documents are scanned once, a hash hit is verified word by word, and hit words
merge into spans that can be cut out or condemn the document.

The broadcast is bounded: the benchmark's bytes are summed first, and above
``block_bytes`` (4 MB: at most two million words and windows, 24 bytes each
beside the vocabulary) it is split into blocks by hash, each scanned in a pass
of its own that merges its hits with those of the passes before it. Passes
therefore grow with the benchmark, not with the documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crystalspark.llm.common import free_name, raw

#: A word: ASCII digits, lower-case letters and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLANK = bytes(i if chr(i).isdigit() and i < 128 or 97 <= i < 123 or i >= 128 else 32 for i in range(256))
_BASE = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes, ASCII letters in lower case."""
    return text.lower().translate(_BLANK).split()


class WindowSet:
    """Windows of a block of benchmark items, ready to scan word lists.

    The block's words stand in one array of word numbers; each window is its
    hash, its start there and its item, in order of the hashes.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        line, found, at = [np.empty(0, dtype=np.int32)], {}, 0
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], dtype=np.int32)
            size = min(n, len(ids))
            if size:
                line.append(ids)
                found.setdefault(size, []).append((np.arange(at, at + len(ids) - size + 1), k))
                at += len(ids)
        self.line, self.tables = np.concatenate(line), {}
        for size, runs in sorted(found.items()):
            starts = np.concatenate([r for r, _ in runs])
            owners = np.repeat([k for _, k in runs], [len(r) for r, _ in runs]).astype(np.int32)
            hashes = self.rolling([self.line[starts + k] for k in range(size)], size)
            order = np.argsort(hashes, kind="stable")
            self.tables[size] = hashes[order], starts[order], owners[order]

    @classmethod
    def of(cls, state: dict) -> WindowSet:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    @staticmethod
    def rolling(columns, size: int) -> np.ndarray:
        total = np.zeros(len(columns[0]), dtype=np.uint64)
        for k in range(size):
            total = total * np.uint64(_BASE) + (columns[k].astype(np.uint64) + np.uint64(1))
        return total

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (first, past last) of hit words, and the items found."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        hits, items = np.zeros(len(ids) + 1, dtype=np.int64), set()
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        for size, (hashes, starts, owners) in self.tables.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[: len(unknown) - size])
            if not len(at):
                continue
            rolled = self.rolling([ids[at + k] for k in range(size)], size)
            low, high = np.searchsorted(hashes, rolled), np.searchsorted(hashes, rolled, side="right")
            seen: dict[bytes, bool] = {}
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                window = ids[p : p + size]
                hit = seen.get(window.tobytes())
                if hit is None:  # the hash agrees; compare the words
                    same = (self.line[starts[a:b, None] + np.arange(size)] == window).all(axis=1)
                    hit = seen[window.tobytes()] = bool(same.any())
                    items.update(self.names[k] for k in np.unique(owners[a:b][same]) if self.names[k] is not None)
                hits[p] += hit
                hits[p + size] -= hit
        covered = np.diff(np.concatenate(([0], (np.cumsum(hits)[:-1] > 0).astype(np.int8), [0])))
        return list(zip(np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist())), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, text[last:]])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         block_bytes: int = 4 << 20, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (word positions, end exclusive) and items (sorted as strings).

    With ``keep_text`` the column ``text`` is the text without its hit spans;
    otherwise it is dropped. Null and empty texts have no words and no hits;
    null or empty items have no windows; an item with a null id marks words but
    is not listed; items with one id count once. An empty benchmark hits
    nothing. Every input row returns once; columns of ``docs`` named like the
    added ones are replaced.
    """
    added = ["n_words", "n_hit", "spans", "items"]
    source = benchmark.select(F.col(item_id).cast("string").alias("item"), raw(item_text).alias("body"))
    total = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    span = "array<struct<first:int,last:int>>"
    df = docs.drop(*added).withColumn(text, raw(text))
    df = df.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        part = source.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block) if blocks > 1 else source
        windows = WindowSet([(r.item, bytes(r.body)) for r in part.collect()], n)
        shared = docs.sparkSession.sparkContext.broadcast(windows.__dict__)
        finish = keep_text and block == blocks - 1
        df = df.mapInArrow(_pass(shared, text, finish), df.schema)
    return df.withColumn(text, F.col(text).cast("string")) if keep_text else df.drop(text)


def _pass(shared, text: str, finish: bool):
    def run(batches):
        windows = WindowSet.of(shared.value)
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            bodies, n_words, n_hit, spans, items = [], [], [], [], []
            for body, old, found in zip(columns[text].to_pylist(), columns["spans"].to_pylist(), columns["items"].to_pylist()):
                words = words_of(body)
                new, names = windows.scan(words)
                new = merge(new + [(x["first"], x["last"]) for x in old]) if old else new
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in new))
                spans.append([{"first": a, "last": b} for a, b in new])
                items.append(sorted(names | set(found)))
                bodies.append(cut(body, new) if finish else body)
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))}
            if finish:
                columns[text] = pa.array(bodies, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with their hit spans cut out (``remove="spans"``).

    All columns return as they were, whatever their names; null texts stay
    null; repeated rows each count; a very long text is scanned whole. An empty
    table or benchmark removes nothing.
    """
    none = free_name(docs.columns, "none")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others, F.col(text).isNull().alias(none)).alias("row"), F.col(text).alias("text"))
    marked = scan(packed, benchmark, keep_text=True, **options)
    if remove != "spans":
        marked = marked.where("n_hit = 0")  # whose texts nothing was cut from
    row = F.col("row")
    body = F.when(~row[none], F.col("text")).cast(dict(docs.dtypes)[text])
    return marked.select(*[body.alias(c) if c == text else row[c].alias(c) for c in docs.columns])
