"""Removal of long repeated substrings by column-wise multi-document construction.

A byte goes when some ``length``-byte string that covers it also starts
anywhere else in the collection, its own document included.

Building one Burrows-Wheeler transform over whole documents takes a round per
byte of the longest one and can't be split over machines. So texts first give
*pieces*: of every ``length`` bytes, the ``gram``-byte string with the least
hash is an anchor, and a piece is the text around an anchor that a
``length``-byte string holding it can reach. Equal strings hold equal anchors
at equal offsets, so every repeat shows within the pieces of one anchor, and
these are aligned. Anchors met once have no repeat and leave here; identical
pieces count once.

The different pieces of an anchor are the collection of one construction
(:class:`ColumnwiseBuilder`): from the last column to the first, each round
puts one symbol of every piece in front of its suffix, updates the sorted
order, the transform (the symbol before each suffix, in that order) and the
common prefixes of neighbours. Suffixes of different columns never need
comparing, as equal strings are aligned; each round therefore keeps its own
column's segment. Pieces, order, prefixes and transform live in external files
that are read and written in sequence, a block of columns at a time. A suffix
whose common prefix with a neighbour reaches ``length`` is a repeat. (Only the
order and the prefixes carry over to the next round; the transform is a
product of the construction that nothing here reads.)

An anchor with more than ``HOT`` different pieces is split: a string of
``length`` bytes that two pieces share reaches x bytes before the anchor and at
least ``reach - x`` after it, so for some i both pieces agree in the i * step
bytes before it and the ``reach - (i + 1) * step`` bytes after it. Pieces that
agree so form a group each; groups that are still large are split by a finer
step.

Texts are named by a 64-bit hash and their length; equal texts are one text
that counts several times. The texts are kept in a table bucketed by that
name, so the two later passes that need them move no text.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crystalspark.llm.common import delete, materialise, new_path, raw, shared_dir

#: Bytes of an anchor.
GRAM = 160
#: Starts of a long text looked at in one go; pieces of one construction.
SEGMENT, PIECES = 1 << 20, 1 << 15
#: Different pieces of an anchor that are compared without a split, so few that a corpus of any size splits about the same share of
#: its pieces; how many times that a group may hold before it is split again; parts of the reach that the splits step by.
HOT, FINER, SPLITS = 64, 4, (4, 8)
#: Columns between two writes of the external files.
COLUMNS = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        have = cache[base] = np.multiply.accumulate(steps)
    return have[:n]


def _byte_values() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int, values: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of every ``gram`` bytes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * _powers(_BASE, n), out=sums[1:])
    h = (sums[gram:] - sums[: n - gram + 1]) * _powers(_INVERSE, n - gram + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _slide(values: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = least(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text: bytes, length: int, gram: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text of at least ``length`` bytes.

    An anchor has the least hash of some ``length`` bytes around it; of equal
    ones all are taken, so the choice depends on those bytes alone.
    """
    width, n = length - gram + 1, len(text)
    data, places, hashes = np.frombuffer(text, dtype=np.uint8), [], []
    for at in range(0, n, SEGMENT):
        low, high = max(0, at - width), min(n, at + SEGMENT + length)
        if high - low < length:
            continue
        h = gram_hashes(data[low:high], gram, values)
        smallest = _slide(h, width, np.minimum)
        padded = np.concatenate([np.zeros(width - 1, np.uint64), smallest, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_slide(padded, width, np.maximum) == h)
        chosen = chosen[(chosen + low >= at) & (chosen + low < at + SEGMENT)]
        places.append(chosen + low)
        hashes.append(h[chosen])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


class ColumnwiseBuilder:
    """Transform and common prefixes of aligned pieces, one column a round, over external files."""

    def __init__(self, folder: str, columns: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.columns, self.count = columns, 0
        self.rows = self.fs.open_output_stream(f"{self.root}/pieces")

    def add(self, piece: bytes, column: int) -> None:
        """A piece whose first byte stands in ``column``; columns it lacks hold symbol 0."""
        row = np.zeros(self.columns, dtype="<u2")
        row[column : column + len(piece)] = np.frombuffer(piece, dtype=np.uint8).astype(np.uint16) + 1
        self.rows.write(row.tobytes())
        self.count += 1

    def _block(self, low: int, high: int) -> np.ndarray:
        """Columns low to high of all pieces, from one pass over their file."""
        out = np.empty((high - low, self.count), dtype=np.uint16)
        step = max(1, (4 << 20) // (2 * self.columns))
        with self.fs.open_input_stream(f"{self.root}/pieces") as f:
            for at in range(0, self.count, step):
                n = min(step, self.count - at)
                out[:, at : at + n] = np.frombuffer(f.read(n * 2 * self.columns), dtype="<u2").reshape(n, self.columns)[:, low:high].T
        return out

    def _save(self, name: str, array: np.ndarray) -> None:
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(array.tobytes())

    def _load(self, name: str, dtype: str) -> np.ndarray:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return np.frombuffer(f.read(), dtype=dtype)

    def rounds(self, groups: np.ndarray):
        """Yield (column, order, prefixes) from the last column to the first.

        ``groups`` is the sorted group of each piece, as numbers from 0;
        suffixes sort within it. ``prefixes[k]`` is what order[k] shares with
        order[k - 1] (0 across groups).
        """
        self.rows.close()
        m, groups = self.count, groups.astype(np.uint16 if not len(groups) or groups[-1] < 1 << 16 else np.int64)
        self._save("order", np.arange(m, dtype="<i4"))
        self._save("prefixes", np.zeros(m, dtype="<u2"))
        with self.fs.open_output_stream(f"{self.root}/transform") as transform:
            for low in range((self.columns - 1) // COLUMNS * COLUMNS, -1, -COLUMNS):
                block = self._block(low, min(low + COLUMNS, self.columns))
                order, prefixes = self._load("order", "<i4"), self._load("prefixes", "<u2")
                for k in range(len(block) - 1, -1, -1):
                    symbols = block[k][order]
                    transform.write(symbols.astype("<u2").tobytes())  # what stands before each sorted suffix
                    place = np.argsort(symbols, kind="stable")
                    place = place[np.argsort(groups[place], kind="stable")]
                    first, shared = symbols[place], np.zeros(m, dtype=np.uint16)
                    same = np.flatnonzero((first[1:] == first[:-1]) & (groups[1:] == groups[:-1]) & (first[1:] > 0)) + 1
                    if len(same):
                        p, q = place[same - 1], place[same]
                        least = prefixes[q].copy()
                        far = np.flatnonzero(q - p > 1)
                        if len(far):
                            bounds = np.stack([p[far] + 1, q[far] + 1], axis=1).ravel()
                            least[far] = np.minimum.reduceat(np.append(prefixes, np.uint16(0)), bounds)[::2]
                        # before the first round suffixes are empty and share nothing
                        shared[same] = least + np.uint16(1)
                    order, prefixes = order[place], shared
                    yield low + k, order, prefixes
                self._save("order", order.astype("<i4"))
                self._save("prefixes", prefixes.astype("<u2"))

    def close(self) -> None:
        self.rows.close()
        self.fs.delete_dir(self.root)


def found_ranges(builder: ColumnwiseBuilder, groups: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Column range (first, past last; -1, -1 if none) of each piece of the builder that a string of another piece of its group repeats.

    ``groups`` is sorted. The strings all hold the anchor and so overlap: their
    union is one range.
    """
    reach = length - gram
    first, last = np.full(builder.count, -1), np.full(builder.count, -1)
    for column, order, shared in builder.rounds(np.unique(groups, return_inverse=True)[1]):
        if column > reach:
            continue
        long = shared >= length
        if long.any():
            hit = order[long | np.append(long[1:], False)]
            first[hit] = column
            fresh = hit[last[hit] < 0]
            last[fresh] = column + length
    return np.stack([first, last], axis=1)


def repeated_ranges(folder: str, pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> np.ndarray:
    """``found_ranges`` of (group, column of the first byte, bytes), sorted by group."""
    builder = ColumnwiseBuilder(folder, 2 * length - gram)
    try:
        for _, column, piece in pieces:
            builder.add(piece, column)
        return found_ranges(builder, np.array([g for g, _, _ in pieces]), length, gram)
    finally:
        builder.close()


def _texts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """(key, size, body zstd, copies) of every distinct text, bucketed by key."""
    spark = docs.sparkSession
    rows = docs.select(raw(text).alias("raw"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = batch.column("raw").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(b) for b in bodies], pa.int64()), pa.array([press.compress(b) for b in bodies], pa.binary())], names=["key", "size", "body"]
            )

    packed = rows.select(F.xxhash64("raw").alias("key"), "raw").mapInArrow(pack, "key long, size long, body binary")
    distinct = packed.groupBy("key", "size").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = distinct.repartition(parts, "key")
    distinct.write.bucketBy(parts, "key").option("path", new_path(spark, name)).option("compression", "uncompressed").saveAsTable(name)
    return spark.table(name)


def _occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, size, copies, place, anchor, piece) of every anchor; ``piece`` hashes the text around it and its side lengths."""
    reach = length - gram

    def run(batches):
        values, press = _byte_values(), zstandard.ZstdDecompressor()
        for batch in batches:
            keys, sizes, copies = (batch.column(c).to_pylist() for c in ("key", "size", "copies"))
            for at, body in enumerate(batch.column("body").to_pylist()):
                if sizes[at] < length:
                    continue
                body = press.decompress(body)
                places, hashes = anchors(body, length, gram, values)
                for low in range(0, len(places), 1 << 16):
                    part = places[low : low + (1 << 16)]
                    digests = np.fromiter(
                        (xxhash.xxh3_64_intdigest(body[max(0, p - reach) : p + length], seed=min(p, reach)) for p in part.tolist()), dtype=np.uint64, count=len(part)
                    )
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, keys[at])), pa.array(np.full(n, sizes[at])), pa.array(np.full(n, copies[at])), pa.array(part.astype(np.int64)), pa.array(hashes[low : low + n].view(np.int64)), pa.array(digests.view(np.int64))],
                        names=["key", "size", "copies", "place", "anchor", "piece"],
                    )

    return texts.mapInArrow(run, "key long, size long, copies long, place long, anchor long, piece long")


def _compare(met: DataFrame, folder: str, length: int, gram: int) -> DataFrame:
    """(anchor, piece, low, high) relative to the anchor, from (group, anchor, piece, place, bytes) sorted by group within partitions."""
    reach = length - gram

    def flush(builder, rows):
        try:
            found = found_ranges(builder, np.array([g for g, _, _ in rows], dtype=np.int64), length, gram)
        finally:
            builder.close()
        keep = np.flatnonzero(found[:, 0] >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([rows[i][2] for i in keep], pa.int64()), pa.array(found[keep, 0] - reach, pa.int64()), pa.array(found[keep, 1] - reach, pa.int64())],
            names=["anchor", "piece", "low", "high"],
        )

    def run(batches):
        builder, rows = None, []
        for batch in batches:
            for g, a, piece, place, body in zip(*(batch.column(c).to_pylist() for c in ("group", "anchor", "piece", "place", "bytes"))):
                if len(rows) >= PIECES and rows[-1][0] != g:
                    yield flush(builder, rows)
                    builder, rows = None, []
                if builder is None:
                    builder = ColumnwiseBuilder(f"{folder}/{uuid.uuid4().hex}", reach + length)
                builder.add(body, reach - min(place, reach))
                rows.append((g, a, piece))
        if rows:
            yield flush(builder, rows)

    return met.mapInArrow(run, "anchor long, piece long, low long, high long")


def _context_groups(fetched: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(group, anchor, piece): for each of ``parts`` splits of the reach, the hash of a piece's bytes just before and after the anchor.

    A piece that is too short for a split has no group there.
    """
    reach = length - gram
    step = -(-reach // parts)

    def run(batches):
        for batch in batches:
            groups, anchors_, pieces = [], [], []
            for a, piece, place, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "place", "bytes"))):
                at = min(place, reach)
                for i in range(parts):
                    before, after = i * step, max(0, reach - (i + 1) * step)
                    if before <= at and at + gram + after <= len(body):
                        groups.append(xxhash.xxh3_64_intdigest(body[at - before : at + gram + after], seed=i))
                        anchors_.append(a)
                        pieces.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(groups, dtype=np.uint64).view(np.int64)), pa.array(anchors_, pa.int64()), pa.array(pieces, pa.int64())], names=["group", "anchor", "piece"])

    return fetched.mapInArrow(run, "group long, anchor long, piece long")


def _split(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(group, anchor, piece, place, bytes) of the wanted pieces of hot anchors, dealt into groups that all pairs with a common string share.

    Pieces alone in all their groups share nothing; their bytes are read where they are grouped and not moved.
    """
    todo, done = wanted, None
    for level, parts in enumerate(SPLITS):
        last = level == len(SPLITS) - 1
        keyed = materialise(_context_groups(_fetch(texts, todo, length, gram), parts, length, gram), "repeats-groups")
        sizes = materialise(keyed.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1"), "repeats-sizes")
        fit = keyed.join(sizes if last else sizes.where(F.col("_n") <= FINER * HOT), "group").drop("_n")
        done = fit if done is None else done.union(fit)
        large = sizes.where(F.col("_n") > FINER * HOT)
        if last or large.isEmpty():
            break
        todo = wanted.join(keyed.join(large, "group").select("anchor", "piece").distinct(), ["anchor", "piece"])
    done = materialise(done, "repeats-dealt")
    used = wanted.join(done.select("anchor", "piece").distinct(), ["anchor", "piece"])
    return done.join(_fetch(texts, used, length, gram), ["anchor", "piece"]).select("group", "anchor", "piece", "place", "bytes")


def _fetch(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, piece, place, bytes) of the wanted (key, size, anchor, piece, place)."""
    reach = length - gram
    lists = wanted.groupBy("key", "size").agg(F.collect_list(F.struct("anchor", "piece", "place")).alias("at"))

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for body, at in zip(batch.column("body").to_pylist(), batch.column("at").to_pylist()):
                body = press.decompress(body)
                for low in range(0, len(at), 4096):
                    part = at[low : low + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[c] for x in part], pa.int64()) for c in ("anchor", "piece", "place")] + [pa.array([body[max(0, x["place"] - reach) : x["place"] + length] for x in part], pa.binary())],
                        names=["anchor", "piece", "place", "bytes"],
                    )

    return texts.join(lists, ["key", "size"]).select("body", "at").mapInArrow(run, "anchor long, piece long, place long, bytes binary")


def repeats(texts: DataFrame, length: int = 400, gram: int = GRAM) -> DataFrame:
    """(key, size, low, high): ranges of bytes that repeat; together they cover all such bytes."""
    spark, reach = texts.sparkSession, length - gram
    seen = materialise(_occurrences(texts, length, gram), "repeats-seen")
    # written, so that the join deals out both sides itself and Spark can split a common anchor
    shared = materialise(seen.groupBy("anchor").agg(F.sum("copies").alias("_n")).where("_n > 1").select("anchor"), "repeats-shared")
    met = materialise(seen.join(shared, "anchor"), "repeats-met")
    _drop(seen)
    pieces = met.groupBy("anchor", "piece").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "size", "place")).alias("one"))
    pieces = materialise(pieces, "repeats-pieces")
    several = materialise(pieces.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1"), "repeats-several")
    # a piece met twice repeats as a whole and still has to be compared with
    wanted = lambda which: pieces.join(several.where(which).select("anchor"), "anchor").select("one.*", "anchor", "piece")
    names = ["group", "anchor", "piece", "place", "bytes"]
    compared = _fetch(texts, wanted(F.col("_n") <= HOT), length, gram).withColumn("group", F.col("anchor")).select(*names)
    if not several.where(F.col("_n") > HOT).isEmpty():
        compared = compared.union(_split(texts, materialise(wanted(F.col("_n") > HOT), "repeats-hot"), length, gram))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    compared = compared.repartition(parts, "group").sortWithinPartitions("group", "anchor", "piece")
    folder = f"{shared_dir(spark)}/repeats-build"
    ranges = materialise(_compare(compared, folder, length, gram), "repeats-ranges").groupBy("anchor", "piece").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    marked = pieces.select("anchor", "piece", (F.col("n") > 1).alias("whole")).join(ranges, ["anchor", "piece"], "left").where("whole OR low IS NOT NULL")
    marked = materialise(marked, "repeats-marked")
    side, end = F.least(F.col("place"), F.lit(reach)), F.least(F.col("size") - F.col("place"), F.lit(length))
    low = F.when(F.col("whole"), -side).otherwise(F.col("low")) + F.col("place")
    high = F.when(F.col("whole"), end).otherwise(F.col("high")) + F.col("place")
    return met.join(marked, ["anchor", "piece"]).where(~F.col("whole") | (side + end >= length)).select("key", "size", low.alias("low"), high.alias("high"))


def _drop(df: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id", gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, kept BINARY.

    Null text is empty; texts shorter than ``length`` lose nothing; repeated
    rows are copies of each other and lose everything they can. What is kept
    may end inside a character and is returned as bytes. An empty table returns
    no rows; other columns are dropped.
    """
    spark, name = docs.sparkSession, f"repeats_texts_{uuid.uuid4().hex}"
    if docs.isEmpty():
        schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)[doc_id]}, {schema}")
    texts = _texts(docs, text, name)
    spans = repeats(texts, length, gram).groupBy("key", "size").agg(F.collect_set(F.struct("low", "high")).alias("spans"))

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, counts, digests, kept = [], [], [], []
            for body, ranges in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                body, end, parts, n = press.decompress(body), 0, [], 0
                for low, high in sorted((x["low"], x["high"]) for x in ranges or ()):
                    if low > end or not n:
                        parts.append(body[end:low])
                        n += 1
                    end = max(end, high)
                parts.append(body[end:])
                left = b"".join(parts)
                removed.append(len(body) - len(left))
                counts.append(n)
                digests.append(sha256(left).hexdigest())
                kept.append(left)
            columns = [batch.column("key"), batch.column("size"), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests)]
            names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_text else []), names=names + ["kept"] * keep_text)

    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    done = materialise(texts.join(spans, ["key", "size"], "left").select("key", "size", "body", "spans").mapInArrow(run, schema), "repeats-done")
    _drop(texts)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(raw(text)).alias("key"), F.octet_length(raw(text)).cast("long").alias("n_bytes"))
    return rows.join(done, ["key", "n_bytes"]).drop("key")
