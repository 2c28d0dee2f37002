"""Vector codes by product quantisation with delta-maintained Lloyd rounds.

Vectors become integers, ``floor(4096 x)``, and are cut into equal parts, each
with a codebook of its own. A round assigns every part to its nearest entry and
moves each entry to the floor of its parts' mean.

Two things persist between rounds, both as tables in the shared folder: every
vector's previous assignment (beside the vector, in blocks of packed rows) and
the running integer sums and counts of all entries. A round reads the blocks,
assigns with the new codebooks and writes the blocks with their new codes and,
in a column of their own, what changed: for each part whose assignment moved, a
minus at the old entry and a plus at the new one, summed within the block. Only
that column is read and shuffled afterwards; the sums it adds up to join the
running ones. Vectors are never shuffled. Once the codebooks stand still, the
remaining rounds are skipped.

What the driver holds are the codebooks: parts x entries x width integers.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crystalspark.llm.common import delete, materialise

#: Vectors in a block, the factor that turns components into integers, the code of a vector not assigned yet.
BLOCK, SCALE, NONE = 2048, 4096, 255
#: Rows of label totals that may be broadcast, and the salts of a label beyond that.
BROADCAST_ROWS, SALTS = 200_000, 32


def limit(width: int) -> int:
    """Components up to this size keep squared distances of whole vectors below 2^62."""
    return int((2**60 / max(1, width)) ** 0.5)


def pack(vectors: DataFrame, seeds: int, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Blocks (width, ids, labels, data, codes, seeds, delta) of the finite vectors, of one width each.

    ``data`` is little-endian 64-bit, or 32-bit where that holds every component
    of the block; ``seeds`` are the smallest distinct ids of the block, each
    with the smallest of its vectors. Null vectors and vectors with null or
    non-finite components are dropped. Vectors with a component beyond
    ``limit`` go to blocks without data.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    schema = (
        f"width int, ids array<{kinds[vec_id]}>, labels array<{kinds[label]}>, data binary, codes binary, "
        f"seeds array<struct<id:{kinds[vec_id]},v:array<long>>>, delta array<struct<part:int,entry:int,n:long,total:array<long>>>"
    )

    def run(batches):
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            v = batch.column("v")
            lengths = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy()), -1)
            flat = v.values.slice(v.offsets[0].as_py(), v.offsets[-1].as_py() - v.offsets[0].as_py()).to_numpy(zero_copy_only=False)
            starts = v.offsets.to_numpy() - v.offsets[0].as_py()
            for width in np.unique(lengths[lengths >= 0]).tolist():
                at = np.flatnonzero(lengths == width)
                x = flat[starts[at][:, None] + np.arange(width)].reshape(len(at), width)
                finite = np.isfinite(x).all(axis=1)  # nulls are NaN here
                at, q = at[finite], np.floor(x[finite] * SCALE)
                fits = (np.abs(q) <= limit(width)).all(axis=1)
                for held in (fits, ~fits):
                    if held.any():
                        yield _block(width, batch, at[held], q[held].astype(np.int64) if held is fits else None, seeds)

    return rows.mapInArrow(run, schema)


def _block(width: int, batch: pa.RecordBatch, at: np.ndarray, q: np.ndarray | None, seeds: int) -> pa.RecordBatch:
    ids, labels = batch.column("id").take(pa.array(at)), batch.column("label").take(pa.array(at))
    first: dict = {}
    if q is not None:
        for k, name in enumerate(ids.to_pylist()):
            if name is not None and (name not in first or q[k].tolist() < q[first[name]].tolist()):
                first[name] = k
    chosen = sorted(first)[:seeds]
    vectors = pa.array([q[first[x]].tolist() for x in chosen], pa.list_(pa.int64()))
    pairs = pa.StructArray.from_arrays([pa.array(chosen, ids.type), vectors], names=["id", "v"])
    small = q is not None and (not q.size or np.abs(q).max() < 2**31)
    data = None if q is None else q.astype("<i4" if small else "<i8").tobytes()
    delta = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([width], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(ids)], labels), pa.array([data], pa.binary()),
            pa.nulls(1, pa.binary()), pa.ListArray.from_arrays([0, len(chosen)], pairs), pa.nulls(1, delta),
        ],
        names=["width", "ids", "labels", "data", "codes", "seeds", "delta"],
    )


def unpack(data: bytes, n: int, width: int, parts: int) -> np.ndarray:
    """(n, parts, width of a part) integers of a block."""
    size = len(data) // (n * width) if width else 4
    return np.frombuffer(data, dtype=f"<i{size}").reshape(n, parts, width // parts).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower one) and squared distance of each row of x, exact in integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * max(1, x.shape[1]) * most * most < 2**53 else np.int64  # whole numbers either way
    x, book = x.astype(kind), book.astype(kind)
    far = (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)
    at = far.argmin(axis=1)
    return at.astype(np.uint8), far[np.arange(len(x)), at].astype(np.int64)


def _steps(books: np.ndarray, width: int):
    """A round over blocks: new codes, and what they change in the sums."""
    parts, entries = books.shape[:2]
    empty: list = []

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            codes, deltas = [], []
            for w, ids, data, old in zip(*(columns[c] for c in ("width", "ids", "data", "codes"))):
                if w.as_py() != width or not data.is_valid:
                    codes.append(None)
                    deltas.append(empty)
                    continue
                n = len(ids)
                x = unpack(data.as_py(), n, width, parts)
                before = np.frombuffer(old.as_py(), np.uint8).reshape(n, parts) if old.is_valid else np.full((n, parts), NONE, np.uint8)
                after, delta = np.empty((n, parts), np.uint8), []
                for p in range(parts):
                    after[:, p] = nearest(x[:, p], books[p])[0]
                    moved = np.flatnonzero(after[:, p] != before[:, p])
                    if not len(moved):
                        continue
                    total, count = np.zeros((entries, x.shape[2]), np.int64), np.zeros(entries, np.int64)
                    known = moved[before[moved, p] != NONE]
                    for sign, rows, entry in ((-1, known, before[known, p]), (1, moved, after[moved, p])):
                        np.add.at(total, entry, sign * x[rows, p])
                        np.add.at(count, entry, sign)
                    touched = np.union1d(before[known, p], after[moved, p])
                    delta += [{"part": p, "entry": int(e), "n": int(count[e]), "total": total[e].tolist()} for e in touched]
                codes.append(after.tobytes())
                deltas.append(delta)
            columns["codes"] = pa.array(codes, pa.binary())
            columns["delta"] = pa.array(deltas, batch.schema.field("delta").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _coded(books: np.ndarray, width: int):
    """Rows (id, label, code, error) of the blocks by the final codebooks."""
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for w, ids, labels, data in zip(*(columns[c] for c in ("width", "ids", "labels", "data"))):
                n = len(ids)
                code, error = pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())
                if w.as_py() == width and data.is_valid and books.shape[1]:
                    x = unpack(data.as_py(), n, width, parts)
                    found = [nearest(x[:, p], books[p]) for p in range(parts)]
                    packed = np.stack([f[0] for f in found], axis=1).tobytes().hex()
                    code = pa.array([packed[k : k + 2 * parts] for k in range(0, len(packed), 2 * parts)])
                    error = pa.array(np.sum([f[1] for f in found], axis=0), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, code, error], names=["vec_id", "label", "code", "error"])

    return run


def fit(blocks: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[np.ndarray, DataFrame]:
    """Codebooks (parts, entries, width of a part) after ``rounds`` rounds, and the blocks with their last assignment.

    The width coded is the commonest one that ``parts`` divides (the larger of
    equals); the first entries are the parts of the smallest distinct ids of
    that width. With fewer ids there are fewer entries, without any no codebook.
    """
    if entries >= NONE:
        raise ValueError(f"at most {NONE - 1} entries fit a code")
    eligible = blocks.where("data IS NOT NULL").where(F.col("width") % parts == 0)
    widths = eligible.groupBy("width").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("width"))
    width = (widths.first() or {"width": 0})["width"]
    seeds = eligible.where(F.col("width") == width).select(F.inline("seeds")).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    books = np.array([r.v for r in seeds], dtype=np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    sums = None
    for _ in range(rounds if len(seeds) else 0):
        last, blocks = blocks, materialise(blocks.mapInArrow(_steps(books, width), blocks.schema), "lloyd-blocks")
        drop(last)
        moved = blocks.select(F.inline("delta")).select("part", "entry", "n", F.posexplode("total").alias("at", "total")).withColumn("total", F.col("total").cast("decimal(38,0)"))
        every = moved if sums is None else moved.unionByName(sums)
        old, sums = sums, materialise(every.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).coalesce(1), "lloyd-sums")
        before = books.copy()
        for r in sums.where("n > 0").collect():  # parts x entries x width of a part
            books[r.part, r.entry, r.at] = int(r.total) // r.n
        if old is not None:
            drop(old)
        if (books == before).all():  # so would be all rounds to come
            break
    if sums is not None:
        drop(sums)
    return books, blocks


def drop(written: DataFrame) -> None:
    """Delete a table written by ``materialise``."""
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        delete(written.sparkSession, folder)


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, joined by commas."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every finite vector.

    Rows whose vector is null or holds null or non-finite components are
    dropped. Repeated rows each return; the smallest vector of a repeated id
    seeds the codebooks, and null ids seed none. Vectors of another length than
    the commonest that ``parts`` divides, or with a component beyond
    ``limit``, return without code and error and move no entry. Null labels
    count as one label. An empty table returns no rows. Other columns are not
    read, whatever their names.
    """
    kinds = dict(vectors.dtypes)
    blocks = materialise(pack(vectors, entries, vec_id, embedding, label), "lloyd-blocks")
    books, blocks = fit(blocks, parts, entries, rounds)
    width = books.shape[0] * books.shape[2] if books.size or books.shape[1] else -1
    coded = materialise(blocks.mapInArrow(_coded(books, width), f"vec_id {kinds[vec_id]}, label {kinds[label]}, code string, error long"), "lloyd-coded")
    drop(blocks)
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "lloyd-labels")
    found = coded.join(*_by_label(coded, totals), "left")
    return found.select(coded["vec_id"], coded["label"], "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _by_label(coded: DataFrame, totals: DataFrame) -> tuple[DataFrame, Column]:
    """Totals to join, and on what: broadcast while their counted rows are few, else salted, so that a hot label spreads."""
    same = coded["label"].eqNullSafe(totals["label"])
    if totals.count() <= BROADCAST_ROWS:
        return F.broadcast(totals), same
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted, coded["label"].eqNullSafe(salted["label"]) & (F.pmod(F.xxhash64(coded["vec_id"], coded["code"]), F.lit(SALTS)) == salted["_salt"])


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in SQL, for vectors of one length: a query a round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS (
  SELECT row_no, part, arg_min(entry, far * {entries} + entry) AS entry, min(far) AS far FROM (
    SELECT x.row_no, x.part, c.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, c.v)])::BIGINT AS far
    FROM piece x JOIN c{k} c ON x.part = c.part
  ) GROUP BY row_no, part
)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (
  SELECT part, entry, list(mean ORDER BY place) AS v FROM (
    SELECT part, entry, place, ((sum(y) - (((sum(y) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS mean FROM (
      SELECT a.part, a.entry, unnest(x.v) AS y, generate_subscripts(x.v, 1) AS place FROM a{k} a JOIN piece x ON a.row_no = x.row_no AND a.part = x.part
    ) GROUP BY part, entry, place
  ) GROUP BY part, entry
),
c{k + 1} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row_no, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
piece AS (
  SELECT row_no, vec_id, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS v
  FROM kept, (SELECT unnest(range({parts})) AS part)
),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT part, entry, v FROM piece JOIN seed USING (vec_id)),
{",".join(steps)},
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT row_no, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY row_no)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row_no), book
"""
