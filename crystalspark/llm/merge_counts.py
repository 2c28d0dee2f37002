"""Token counts of a byte-level BPE, without producing ids.

A text is cut into words as the tokenizer's file says. Each word starts as a
linked list of its bytes; a heap holds the ranks of all adjacent pairs that the
merge table knows, and the lowest one (the leftmost among equals) is merged
until none is left. The count is the number of bytes minus the number of
merges, in O(n log n) of the word's length, so one long run of letters costs no
more than many short ones. Counts of words met before come from a bounded cache
that lives as long as the Python worker.

The merge table has a fixed size (50,000 pairs for the tokenizer in use) and
travels to the tasks as a broadcast; documents are never shuffled.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crystalspark.llm.common import worker_state

#: Words of the byte-level pre-tokenizer (fixed value).
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for Latin-1 texts: classes written out, the commonest alternative first (those that start alike keep their order).
LATIN_WORD = re.compile(
    r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)
#: A place where a word always ends: a letter before a blank that a letter follows.
CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")
#: Characters of a text that are cut into words at once; words in each half of a worker's cache; longer words are not kept.
SEGMENT, CACHE, LONGEST = 1 << 20, 600_000, 64
#: Bits of a heap entry that hold the place in the word.
_PLACE, _MASK = 40, (1 << 40) - 1


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_table(tokenizer_json: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Pairs in order of their rank, and the special strings, of a byte-level BPE without normaliser; any other kind raises."""
    config = json.loads(tokenizer_json)
    model, before = config["model"], config["pre_tokenizer"] or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    quiet = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    added = config.get("added_tokens", [])
    known = (
        model["type"] == "BPE" and not any(model.get(k) for k in quiet) and config["normalizer"] is None
        and {k: before.get(k) for k in plain} == plain and not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not known:
        raise ValueError("only byte-level BPE without normaliser, prefix space and stripping special tokens is counted")
    byte = byte_alphabet()
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    return [(bytes(byte[c] for c in a), bytes(byte[c] for c in b)) for a, b in pairs], [x["content"] for x in added]


class Merges:
    """The merge table by symbol: bytes are 0 to 255, each new symbol has the next number (they never leave this module)."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        number = {bytes([b]): b for b in range(256)}
        self.made = [number.setdefault(a + b, len(number)) for a, b in pairs]
        #: For a left symbol, the rank of each right one; the last entry, empty, is that of symbols that are gone (-1).
        self.right: list[dict[int, int]] = [{} for _ in range(len(number) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.right[number[a]][number[b]] = rank

    def count(self, word: bytes) -> int:
        """Symbols that are left of a word when no known pair is adjacent any more."""
        n, right, made = len(word), self.right, self.made
        heap = [r << _PLACE | i for i, (a, b) in enumerate(zip(word, word[1:])) if (r := right[a].get(b)) is not None]
        if not heap:
            return n
        heapify(heap)
        several = list if n <= LONGEST else _packed
        symbol, after, before = several([*word, -1]), several(range(1, n + 2)), several(range(-1, n))
        left = n
        while heap:
            entry = heappop(heap)
            i, rank = entry & _MASK, entry >> _PLACE
            j = after[i]
            if right[symbol[i]].get(symbol[j]) != rank:  # one of the two has been merged since
                continue
            left -= 1
            both = symbol[i] = made[rank]
            symbol[j] = -1
            k = after[i] = after[j]
            before[k] = i
            r = right[both].get(symbol[k])
            if r is not None:
                heappush(heap, r << _PLACE | i)
            h = before[i]
            r = right[symbol[h]].get(both)
            if r is not None:
                heappush(heap, r << _PLACE | h)
        return left


def _packed(values) -> array:
    return array("q", values)


class WordCounts(dict):
    """Token counts by word; an unknown word is merged, or taken from the older half."""

    def __init__(self, merges: Merges, old: dict):
        self.merges, self.old = merges, old

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.merges.count(word.encode())
        if len(word) <= LONGEST:
            self[word] = n
        return n


class Counter:
    """Counts whole texts; special strings inside a text are one token each, as the library takes them by default."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], special: list[str]):
        self.counts = WordCounts(Merges(pairs), {})
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None

    def __call__(self, text: str) -> int:
        if len(self.counts) > CACHE:
            self.counts.old = {}
            self.counts = WordCounts(self.counts.merges, self.counts)
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self._words(segment) for part in parts for segment in segments(part))

    def _words(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, words_of(text)))


def segments(text: str):
    """The text in runs of about SEGMENT characters that end where a word ends in any case."""
    start = 0
    while len(text) - start > SEGMENT:
        found = CUT.search(text, start + SEGMENT)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def words_of(text: str) -> list[str]:
    """Words of a text. Characters that this Python's Unicode tables do not know are left to the library, whose tables may be older or newer."""
    try:
        text.encode("latin-1")
        return LATIN_WORD.findall(text)
    except UnicodeEncodeError:
        pass
    if any(unicodedata.category(c) == "Cn" for c in set(text)):
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
    return WORD.findall(text)


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``.

    Null and empty texts have no bytes and no tokens. A very long text is
    counted whole, in segments. Rows with a null id and repeated rows each
    return; an empty table returns none. Other columns are not read, so
    clashing names cannot meet.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    table, name = merge_table(raw), sha256(raw.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches):
        state = worker_state()
        count = state.get(("merges", name)) or state.setdefault(("merges", name), Counter(*shared.value))
        for batch in batches:
            n = pa.array((count(x.as_py()) for x in batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
