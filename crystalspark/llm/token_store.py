"""A content-addressed store of token ids.

Texts become id streams that end with ``end_id``. A rolling (gear) hash over
the ids cuts each stream into chunks, so that equal passages give equal chunks
wherever they stand. The store is a folder of three Parquet tables:

``chunks/``    address BINARY (SHA-256 of the ids), n_ids, ids BINARY
               (little-endian unsigned 16-bit, or 32-bit for vocabularies
               beyond that); each distinct chunk is stored once
``recipes/``   part, place, offset, doc_id, n_tokens, root BINARY, chunks
               ARRAY<BINARY>, in ascending doc_id order; ``place`` counts the
               documents and ``offset`` the ids before it in its part
``manifest/``  part, start, documents, tokens, root: the ids of all parts
               before, the Merkle root over each recipe part's document roots,
               and the root of these as part -1

A document's root is the Merkle root of its chunk addresses. Reading back
recomputes every chunk's address from its bytes and every root from the
addresses; anything that differs raises. Documents are rebuilt from chunks, or
summed up by combining the chunks' crc32 values in recipe order, which moves
a few bytes a chunk instead of the ids.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.llm.common import delete, materialise, new_path, worker_state

#: Ids: at least, on average beyond that, at most in a chunk; ids the rolling hash sees.
LEAST, MEAN, MOST, SPAN = 64, 512, 4096, 32
#: Words in each half of a worker's cache.
CACHE = 400_000


def _gear(ids: np.ndarray) -> np.ndarray:
    """A pseudorandom 32-bit value for each id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last SPAN ids asks for a cut."""
    h, step = _gear(ids), 1
    while step < SPAN:  # sum of gear << distance over the last SPAN ids, by doubling
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
        step *= 2
    return np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1


def cut_points(n: int, marks: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream of n ids with the given marks, the last being n.

    Chunks hold at least LEAST ids (but for the last), more than SPAN: marks of
    streams that were hashed in a row are therefore those of each on its own.
    """
    ends, last = [], 0
    while n - last > LEAST:
        k = int(np.searchsorted(marks, last + LEAST))
        last = min(int(marks[k]) if k < len(marks) else n, last + MOST, n)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Merkle root; leaf and inner hashes differ by a prefix byte, an odd node moves up."""
    level = [sha256(b"\0" + x).digest() for x in leaves] or [sha256(b"\0").digest()]
    while len(level) > 1:
        level = [sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Words(dict):
    """Packed ids by lower-case word; an unknown word is encoded, or taken from the older half."""

    def __init__(self, tokenizer, dtype: str, old: dict):
        self.model, self.old, self.kind = tokenizer.model.tokenize, old, "H" if dtype == "<u2" else "I"

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = [t.id for p in PIECE.findall(word) for t in self.model(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))]
            packed = struct.pack(f"<{len(ids)}{self.kind}", *ids)
        self[word] = packed
        return packed


class Encoder:
    """Ids of whole texts by the tokenizers library, word by word.

    A tokenizer that lower-cases, splits by ``PIECE`` and never looks beyond a
    piece gives a text the ids of its words between white space in turn, so
    words met before come from a cache. Its two bounded halves outlive the task:
    when the younger is full it becomes the older. Texts beyond Latin-1, with
    control characters or with the name of a special token, and tokenizers of
    another kind, are encoded whole.
    """

    def __init__(self, path: str, end_id: int, dtype: str):
        from tokenizers import Tokenizer

        state = worker_state().setdefault(("ids", path, dtype), {})
        if not state:
            tokenizer = Tokenizer.from_file(path)
            config = json.loads(tokenizer.to_str())
            added = [x["content"].lower() for x in config.get("added_tokens", [])]
            state |= {"tokenizer": tokenizer, "plain": splits_like_this(config), "added": added, "words": Words(tokenizer, dtype, {})}
        self.state, self.dtype = state, dtype
        self.end = np.array([end_id], dtype=dtype).tobytes()

    def plain(self, text: str) -> bool:
        if not self.state["plain"] or _CONTROL.search(text):
            return False
        if "<" in text and any(x in text.lower() for x in self.state["added"]):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, the end id last."""
        plain = [self.plain(t) for t in texts]
        whole = iter(self.state["tokenizer"].encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        words = self.state["words"]
        if len(words) > CACHE:
            words.old = {}
            words = self.state["words"] = Words(self.state["tokenizer"], self.dtype, words)
        get = words.__getitem__
        return [(b"".join(map(get, t.lower().split())) if p else np.array(next(whole).ids, dtype=self.dtype).tobytes()) + self.end for t, p in zip(texts, plain)]


def is_wide(tokenizer_path: str, end_id: int = 1) -> bool:
    """Whether ids of a tokenizer go beyond 16 bits."""
    from tokenizers import Tokenizer

    return max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab().values()]) > 0xFFFF


#: Pieces of a lower-case Latin-1 text: the splitting pattern of the tokenizer, its classes written out and
#: the commonest first (alternatives that start alike keep their order).
PIECE = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\s\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]")
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def splits_like_this(config: dict) -> bool:
    """Whether a tokenizer normalises and splits as ``Encoder`` does for Latin-1 texts."""
    normal = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": pattern} and not splits[1]["use_regex"]


def encode_chunks(docs: DataFrame, tokenizer_path: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", wide: bool | None = None) -> DataFrame:
    """(doc_id, n_tokens, root, chunks ARRAY<STRUCT<address, n, ids>>) of every row; null text is empty. ``wide``: 32-bit ids; by the vocabulary if not given."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dtype = "<u4" if (is_wide(tokenizer_path, end_id) if wide is None else wide) else "<u2"
    width = np.dtype(dtype).itemsize

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_path, end_id, dtype)
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            packed = encoder.encode(batch.column("text").to_pylist())
            lengths = [len(p) // width for p in packed]
            starts = np.concatenate(([0], np.cumsum(lengths)))
            marks = cut_marks(np.frombuffer(b"".join(packed), dtype=dtype))
            slices = np.searchsorted(marks, starts, side="right")
            roots, addresses, sizes, blobs, offsets = [], [], [], [], [0]
            for k, (blob, n) in enumerate(zip(packed, lengths)):
                last, first = 0, len(addresses)
                for end in cut_points(n, marks[slices[k] : slices[k + 1]] - starts[k]):
                    piece = blob[last * width : end * width]
                    addresses.append(sha256(piece).digest())
                    sizes.append(end - last)
                    blobs.append(piece)
                    last = end
                roots.append(merkle(addresses[first:]))
                offsets.append(len(addresses))
            pieces = pa.StructArray.from_arrays([pa.array(addresses, pa.binary()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["address", "n", "ids"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)],
                names=["doc_id", "n_tokens", "root", "chunks"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, root binary, chunks array<struct<address:binary,n:int,ids:binary>>")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Encode ``docs`` and write the store under ``path``.

    Rows with a null id come first; rows that share an id lie side by side,
    ordered by their roots. Null and empty texts are the end id alone, and a
    very long text is one recipe of many chunks. Repeated rows each have a
    recipe. Columns other than id and text are not read, whatever their names.
    An empty table writes empty tables and a manifest of one row.
    """
    spark = docs.sparkSession
    encoded = materialise(encode_chunks(docs, tokenizer_path, **options), "store-encoded")
    pieces = encoded.select(F.explode("chunks").alias("c")).select("c.*")
    stored = pieces.groupBy("address").agg(F.first("n").alias("n_ids"), F.first("ids").alias("ids"))
    stored.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = encoded.select("doc_id", "n_tokens", "root", F.col("chunks.address").alias("chunks"))
    # ranges keep the order between files, the sort keeps it inside them
    ranged = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").select(F.spark_partition_id().alias("part"), "*")
    kind = dict(recipes.dtypes)["doc_id"]

    def number(batches):
        place = offset = 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            upto = offset + np.cumsum(n)
            extra = [pa.array(np.arange(place, place + len(n))), pa.array(upto - n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("part"), *extra, *batch.columns[1:]], names=["part", "place", "offset", *batch.schema.names[1:]])
            place, offset = place + len(n), int(upto[-1]) if len(n) else offset

    numbered = ranged.mapInArrow(number, f"part int, place long, offset long, doc_id {kind}, n_tokens long, root binary, chunks array<binary>")
    numbered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark, path).coalesce(1).write.parquet(f"{path}/manifest")
    for f in {x.rsplit("/", 1)[0] for x in encoded.inputFiles()}:
        delete(spark, f)


def _roots(lists: DataFrame, schema: str) -> DataFrame:
    """Replace the column ``leaves``, ordered (at, root) pairs, by their Merkle root; the other columns stay as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("leaves")
            roots = pa.array([merkle([x["root"] for x in leaves]) for leaves in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([roots if i == at else c for i, c in enumerate(batch.columns)], names=["root" if n == "leaves" else n for n in batch.schema.names])

    return lists.mapInArrow(run, schema)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Merkle roots of the recipe parts, in blocks of 4096 documents, and of all parts; computed from recipes alone."""
    rows = spark.read.parquet(f"{path}/recipes").select("part", "place", "n_tokens", "root")
    leaves = lambda at: F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "root"))).alias("leaves")
    blocks = rows.groupBy("part", F.floor(F.col("place") / 4096).alias("block")).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), leaves("place"))
    blocks = _roots(blocks, "part int, block long, documents long, tokens long, root binary")
    parts = _roots(blocks.groupBy("part").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), leaves("block")), "part int, documents long, tokens long, root binary")
    # one row a recipe file
    parts = materialise(parts.select("part", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), "documents", "tokens", "root"), "store-parts")
    whole = parts.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), leaves("part"))
    whole = _roots(whole, "documents long, tokens long, root binary").select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("start"), "documents", "tokens", "root")
    return parts.union(whole)


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless the recipes give the manifest's starts, counts and roots. Its rows number one a recipe file."""
    names = ["start", "documents", "tokens", "root"]
    stored = spark.read.parquet(f"{path}/manifest").select("part", F.struct(*names).alias("have"))
    again = _manifest(spark, path).select("part", F.struct(*names).alias("want"))
    if not stored.join(again, "part", "full").where(~F.col("have").eqNullSafe(F.col("want"))).isEmpty():
        raise ValueError(f"{path}: recipes differ from the manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, root, chunks), with ``start`` over all parts."""
    starts = spark.read.parquet(f"{path}/manifest").where("part >= 0").select("part", F.col("start").alias("_first"))
    # the manifest has one row a recipe file
    return spark.read.parquet(f"{path}/recipes").join(F.broadcast(starts), "part").select("doc_id", (F.col("_first") + F.col("offset")).alias("start"), "n_tokens", "root", "chunks")


def _advance(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each crc32 becomes when its bytes are followed by as many zero bytes, without the final inversions."""
    matrix = np.array([0xEDB88320, *[1 << i for i in range(31)]], dtype=np.uint32)  # one zero bit

    def times(vectors: np.ndarray) -> np.ndarray:
        out = np.zeros_like(vectors)
        for bit in range(32):
            out ^= matrix[bit] * ((vectors >> np.uint32(bit)) & np.uint32(1))
        return out

    for _ in range(3):
        matrix = times(matrix)
    crcs, left = crcs.astype(np.uint32), zeros.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        crcs[odd] = times(crcs[odd])
        matrix, left = times(matrix), left >> 1
    return crcs


def crc_join(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each run of byte strings joined, from theirs and their sizes; ``first``: where each run starts."""
    if not len(first):
        return np.empty(0, dtype=np.int64)
    ends = np.append(first[1:], len(crcs))
    upto = np.cumsum(sizes)
    after = np.repeat(upto[ends - 1], ends - first) - upto
    return np.bitwise_xor.reduceat(_advance(crcs, after), first).astype(np.int64)


def unpack(blob: bytes, n: int) -> np.ndarray:
    """The n ids of a chunk; its size tells their width."""
    return np.frombuffer(blob, dtype="<u4" if len(blob) == 4 * n else "<u2")


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(address, n, crc) of every stored chunk, read from its bytes; crc32 is over the ids as little-endian unsigned 32 bits."""

    def run(batches):
        for batch in batches:
            crcs, sizes = [], []
            for address, n, blob in zip(batch.column("address").to_pylist(), batch.column("n_ids").to_pylist(), batch.column("ids").to_pylist()):
                ids = unpack(blob, n)
                if sha256(blob).digest() != address or len(ids) != n:
                    raise ValueError(f"chunk {address.hex()} does not match its address")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], names=["address", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("address", "n_ids", "ids").mapInArrow(run, "address binary, n int, crc long")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of every document, from the store's files, verified."""
    verify_manifest(spark, path)
    recipes = _recipes(spark, path)
    steps = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("pos", "address"))
    met = steps.join(chunk_sums(spark, path), "address", "left")
    lists = met.groupBy("doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "address", "n", "crc"))).alias("steps"))
    kind = dict(recipes.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            steps_ = batch.column("steps")
            if isinstance(steps_, pa.ChunkedArray):
                steps_ = steps_.combine_chunks()
            flat, bounds = steps_.flatten(), np.concatenate(([0], np.cumsum(steps_.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            if flat.field("crc").null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            addresses, sizes = flat.field("address").to_pylist(), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(sizes)))
            if (np.diff(upto[bounds]) != batch.column("n_tokens").to_numpy(zero_copy_only=False)).any():
                raise ValueError("a document does not match its length")
            for k, root in enumerate(batch.column("root").to_pylist()):
                if merkle(addresses[bounds[k] : bounds[k + 1]]) != root:
                    raise ValueError("a document does not match its root")
            crcs = crc_join(flat.field("crc").to_numpy(zero_copy_only=False), 4 * sizes, bounds[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(np.diff(bounds).astype(np.int32))], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])

    return lists.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, n_chunks int")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids ARRAY<INT>) of every document, rebuilt from its chunks and verified against its root."""
    recipes = _recipes(spark, path)
    steps = recipes.select("doc_id", "start", "root", F.posexplode("chunks").alias("pos", "address")).join(spark.read.parquet(f"{path}/chunks"), "address", "left")
    lists = steps.groupBy("doc_id", "start", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "address", "n_ids", "ids"))).alias("steps"))
    kind = dict(recipes.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            rebuilt = []
            for root, steps_ in zip(batch.column("root").to_pylist(), batch.column("steps").to_pylist()):
                if any(s["ids"] is None or sha256(s["ids"]).digest() != s["address"] for s in steps_) or merkle([s["address"] for s in steps_]) != root:
                    raise ValueError("a document does not match its root")
                rebuilt.append(np.concatenate([unpack(s["ids"], s["n_ids"]) for s in steps_]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(rebuilt, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return lists.mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")


def store_and_sum(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write a store in the shared folder and return what reading it back gives."""
    path = new_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_path, **options)
    return read_sums(docs.sparkSession, path)
