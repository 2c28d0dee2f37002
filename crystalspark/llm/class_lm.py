"""Brown class-based bigram scoring.

p(text) is the product over its tokens (words, then one end) of
p(class | class before) * p(token | class). Classes come from exchange
clustering, in two steps. The core, words with at least ``SHARE`` of all training
tokens (at most 1 / SHARE words, whatever the corpus) and one unit per group of
words that end alike, moves word by word on the driver to the class that most
raises the likelihood of the training bigrams, until nothing moves. Then every
other word that occurs at least ``LEAST`` times moves at once, on the executors:
its neighbours' classes are counted over all training texts, and it joins the
class that most raises the likelihood beside the core's class bigrams (to first
order, as one rare word changes them little). Only rarer and unknown words keep
the class of their ending. The number of classes grows with the corpus.

The word table (word, count, class) stays distributed: its most frequent words,
``COMMON`` at most, travel to every task, the rest meet their documents in a
join, one row per document and word. Class bigrams are then
counted anew over the classes so found; transitions are smoothed towards the
class shares, and a class gives unknown words the mass of its words met once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crystalspark.llm.common import materialise, raw

SHARE, COMMON = 1 / 2048, 1 << 18
GROUPS, SWEEPS, LEAST = 256, 12, 3
#: Classes: the fourth root of the training tokens, within these bounds.
LEAST_CLASSES, MOST_CLASSES = 48, 250
#: Words and neighbours a task holds before it hands them on.
HELD, CODES = 500_000, 4_000_000
#: Weight of the class shares in a transition, in tokens.
MU = 8.0
#: Marks an unknown word's class in a row's sequence.
NEW = 256


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case; the end token is b"" and not part of this list."""
    return text.lower().split()


def ending(word: bytes) -> int:
    """The group of a word: by its last two bytes."""
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 7) % GROUPS


class Numbers(dict):
    """Numbers words as they come; ``table`` has the values that ``describe`` returns for each."""

    def __init__(self, describe):
        self.describe, self.words, self.fresh, self.rows = describe, [], [], None

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        self.fresh.append(self.describe(word))
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def table(self, end: tuple) -> np.ndarray:
        """The values as rows, and ``end`` as the last, which -1 names."""
        if self.fresh or self.rows is None:
            new = np.array([*self.fresh, end], dtype=float)
            self.rows = new if self.rows is None else np.concatenate([self.rows[:-1], new])
            self.fresh = []
        return self.rows


def frequent_words(docs: DataFrame) -> DataFrame:
    """(word, c): all tokens under the empty word, and counts of words that are frequent in a task's share of the texts."""

    def run(batches):
        held: Counter = Counter()
        n = 0

        def out():
            often = [w for w, c in held.items() if c >= n * SHARE / 4]
            batch = pa.RecordBatch.from_arrays([pa.array([b"", *often], pa.binary()), pa.array([n, *[held[w] for w in often]], pa.int64())], names=["word", "c"])
            held.clear()
            return batch

        for batch in batches:
            for body in batch.column("raw").to_pylist():
                words = tokens(body)
                held.update(words)
                n += len(words) + 1
                if len(held) > HELD:
                    yield out()
                    n = 0
        if n:
            yield out()

    return docs.select("raw").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _line(numbers: Numbers, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts in a row, -1 for each text's end, and where each text starts."""
    parts = [numbers.of(tokens(b)) for b in bodies]
    end = np.array([-1])
    line = np.concatenate([x for p in parts for x in (p, end)]) if parts else np.empty(0, np.int64)
    return line, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)


def _slices(batches, n: int = 512):
    return (b.slice(at, n) for b in batches for at in range(0, b.num_rows, n))


def unit_bigrams(docs: DataFrame, units: dict[bytes, int]) -> DataFrame:
    """(code, n): bigrams of units, code = before * size + after; unit 0 is the end, the last GROUPS are the groups."""
    size = 1 + len(units) + GROUPS
    base = 1 + len(units)

    def run(batches):
        total = np.zeros(size * size, dtype=np.int64)
        numbers = Numbers(lambda w: (units.get(w) or base + ending(w),))
        for batch in _slices(batches):
            line, _ = _line(numbers, batch.column("raw").to_pylist())
            unit = numbers.table((0,))[line, 0].astype(np.int64)
            total += np.bincount(np.append(0, unit[:-1])[: len(unit)] * size + unit, minlength=size * size)
            if len(numbers) > HELD:
                numbers = Numbers(numbers.describe)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    return docs.select("raw").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = LEAST_CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit by exchange clustering of a unit bigram matrix; unit 0 keeps class 0 for itself."""
    size = len(pairs)
    label = np.zeros(size, dtype=np.int64)
    if size == 1:
        return label
    rest = np.argsort(-(pairs.sum(axis=0)[1:] + pairs.sum(axis=1)[1:]), kind="stable") + 1
    label[rest] = 1 + np.arange(size - 1) % (classes - 1)
    onehot = np.zeros((size, classes))
    onehot[np.arange(size), label] = 1
    n = onehot.T @ pairs @ onehot
    for _ in range(sweeps):
        moved = 0
        for w in rest:
            row, column, own = pairs[w].astype(float), pairs[:, w].astype(float), float(pairs[w, w])
            row[w] = column[w] = 0
            if not row.any() and not column.any() and not own:
                continue
            r, c, a = np.bincount(label, row, classes), np.bincount(label, column, classes), label[w]
            n[a] -= r
            n[:, a] -= c
            n[a, a] -= own
            wide, tall = _f(n + r) - _f(n), _f(n + c[:, None]) - _f(n)
            d = np.diag(n)
            gain = wide.sum(axis=1) - np.diag(wide) + tall.sum(axis=0) - np.diag(tall) + _f(d + r + c + own) - _f(d)
            out, into = n.sum(axis=1) + c, n.sum(axis=0) + r  # what other words' margins get back wherever w goes
            gain -= _f(out + r.sum() + own) - _f(out) + _f(into + c.sum() + own) - _f(into)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            label[w] = b
            n[b] += r
            n[:, b] += c
            n[b, b] += own
            moved += a != b
        if not moved:
            break
    return label


def neighbours(docs: DataFrame, units: dict[bytes, int], unit_class: np.ndarray, classes: int) -> DataFrame:
    """(word, packed) of words outside the core: how often each class stands before (code: class) and after (code: classes + class).

    ``packed`` holds code + 512 * count as little-endian 32-bit numbers.
    """
    base = 1 + len(units)

    def run(batches):
        fresh = lambda: Numbers(lambda w: (int(unit_class[units[w]]), 1) if w in units else (int(unit_class[base + ending(w)]), 0))
        numbers, held, n = fresh(), [], 0

        def out():
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            word = codes // (2 * classes)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            packed = (codes % (2 * classes) + 512 * counts).astype("<u4")
            offsets = (4 * np.append(first, len(codes))).astype(np.int32)
            words = pa.array([numbers.words[k] for k in word[first].tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])], names=["word", "packed"])

        for batch in _slices(batches):
            line, _ = _line(numbers, batch.column("raw").to_pylist())
            facts = numbers.table((0, 1))[line]
            kind, at = facts[:, 0].astype(np.int64), np.flatnonzero(facts[:, 1] == 0)
            before, after = np.append(0, kind[:-1])[: len(kind)], np.append(kind[1:], 0)
            held.append(np.concatenate([line[at] * (2 * classes) + before[at], line[at] * (2 * classes) + classes + after[at]]))
            n += 2 * len(at)
            if n > CODES or len(numbers) > HELD:
                if n:
                    yield out()
                numbers, held, n = fresh(), [], 0
        if n:
            yield out()

    return docs.select("raw").mapInArrow(run, "word binary, packed binary")


def join_classes(met: DataFrame, pairs: np.ndarray, group_class: np.ndarray) -> DataFrame:
    """(word, c, class) from ``neighbours``: a word moves to the class that most raises the likelihood beside the class bigrams ``pairs``."""
    classes = len(pairs)
    log = lambda x: np.log(x + 0.5)
    gain = np.vstack([log(pairs) - log(pairs.sum(axis=0)), log(pairs.T) - log(pairs.sum(axis=1))])  # by code and class
    gain[:, 0] = -1e300  # the end keeps its class for itself
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parts, "word").sortWithinPartitions("word")

    def choose(words: list[bytes], packed: list[bytes]):
        fresh = [i == 0 or words[i] != words[i - 1] for i in range(len(words))]
        of = np.repeat(np.cumsum(fresh) - 1, [len(p) // 4 for p in packed])
        values = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
        names = [w for w, f in zip(words, fresh) if f]
        code, times = values % 512, values // 512
        total = np.bincount(of, np.where(code < classes, times, 0), minlength=len(names)).astype(np.int64)
        chosen = np.array([group_class[ending(w)] for w in names], dtype=np.int32)
        often = np.flatnonzero(total >= LEAST)
        place = np.full(len(names), -1)
        place[often] = np.arange(len(often))
        at = place[of]
        counts = np.bincount(at[at >= 0] * 2 * classes + code[at >= 0], times[at >= 0], minlength=len(often) * 2 * classes)
        chosen[often] = np.argmax(counts.reshape(-1, 2 * classes) @ gain, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(total), pa.array(chosen)], names=["word", "c", "class"])

    def run(batches):
        words, packed = [], []
        for batch in _slices(batches, 8192):
            words += batch.column("word").to_pylist()
            packed += batch.column("packed").to_pylist()
            cut = len(words) - 1
            while cut > 0 and words[cut - 1] == words[-1]:  # the last word may go on in the next batch
                cut -= 1
            if cut > 0:
                yield choose(words[:cut], packed[:cut])
                words, packed = words[cut:], packed[cut:]
        if words:
            yield choose(words, packed)

    return dealt.mapInArrow(run, "word binary, c long, class int")


@dataclass
class ClassModel:
    """What every task needs to score: all of it bounded by SHARE, COMMON, GROUPS and MOST_CLASSES."""

    common: dict[bytes, tuple[int, int]]  #: word -> (class, count)
    group_class: np.ndarray
    classes: int
    total: int  #: training tokens
    distinct: int  #: distinct training tokens
    ends: int  #: training texts


def fit(train: DataFrame) -> tuple[ClassModel, DataFrame]:
    """Classes of the training rows' ``raw`` texts, and the table (word, c, class) of the words outside the core."""
    often = materialise(frequent_words(train), "lm-frequent")
    total = int(often.where(F.col("word") == b"").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    classes = min(MOST_CLASSES, max(LEAST_CLASSES, round(total**0.25)))
    core = often.where((F.col("c") >= total * SHARE) & (F.col("word") != b"")).select("word").toArrow()  # at most 1 / SHARE
    units = {w: i + 1 for i, w in enumerate(sorted(core.column("word").to_pylist()))}
    size = 1 + len(units) + GROUPS
    pairs = np.zeros(size * size, dtype=np.int64)
    found = unit_bigrams(train, units).toArrow()
    pairs[found.column("code").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(size, size)
    label = exchange(pairs, classes)
    onehot = np.zeros((size, classes))
    onehot[np.arange(size), label] = 1
    group_class, counts = label[1 + len(units) :], pairs.sum(axis=0)
    words = materialise(join_classes(neighbours(train, units, label, classes), onehot.T @ pairs @ onehot, group_class), "lm-words")
    bits, least, room = F.length(F.bin("c")), None, COMMON
    for r in sorted(words.groupBy(bits.alias("bits")).count().collect(), reverse=True):  # one row a power of two
        room -= r["count"]
        if room < 0:
            break
        least = 1 << (r.bits - 1)
    common = words.where(F.lit(False) if least is None else F.col("c") >= least).toArrow()  # at most COMMON
    known = {w: (k, c) for w, k, c in zip(*(common.column(x).to_pylist() for x in ("word", "class", "c")))}
    known |= {w: (int(label[i]), int(counts[i])) for w, i in units.items()}
    ends = int(counts[0])
    return ClassModel(known, group_class, classes, total, words.count() + len(units) + (ends > 0), ends), words


def _partial(rows: DataFrame, model: ClassModel, keep: list[str]) -> DataFrame:
    """Rows with their tokens: classes of common words, -1 - k for the k-th of the row's other words, which are listed with their times.

    ``base`` and ``logs`` sum log10 of the common words' counts, plus one and as they are.
    """
    state = rows.sparkSession.sparkContext.broadcast(dict(vars(model)))
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep) + ", n_tokens long, n_known long, base double, logs double, line binary, words array<binary>, groups array<int>, times array<int>"

    def run(batches):
        s = state.value
        common, group_class = s["common"], s["group_class"].tolist()

        def describe(w):
            k, c = common.get(w, (-1, 0))
            return (k, log10(c + 1), log10(c), 0) if c else (-1, 0.0, 0.0, group_class[ending(w)])

        numbers = Numbers(describe)
        for batch in _slices(batches):
            line, starts = _line(numbers, batch.column("raw").to_pylist())
            facts, n = numbers.table((0, 0, 0, 0))[line], batch.num_rows
            of, kind, inside = np.repeat(np.arange(n), np.diff(starts)), facts[:, 0].astype(np.int32), line >= 0
            other = np.flatnonzero(kind < 0)
            width = len(numbers.words) + 1
            pairs, inverse, times = np.unique(of[other] * width + line[other], return_inverse=True, return_counts=True)
            row, word = pairs // width, pairs % width
            first = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)  # where each row's other words start
            kind[other] = -1 - (inverse - first[of[other]])
            distinct, place = np.unique(word, return_inverse=True)
            words = pa.array([numbers.words[i] for i in distinct.tolist()], pa.binary()).take(pa.array(place))
            groups = pa.array(numbers.rows[word, 3].astype(np.int32))
            known = np.bincount(of[inside & (kind >= 0)], minlength=n)
            base, logs = np.bincount(of, facts[:, 1], minlength=n), np.bincount(of, facts[:, 2], minlength=n)
            ends = (4 * (starts - np.arange(n + 1))).astype(np.int32)  # without the ends
            lines = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(kind[inside].astype("<i4"))])
            lists = [pa.ListArray.from_arrays(pa.array(first), x) for x in (words, groups, pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.diff(starts)), pa.array(known), pa.array(base), pa.array(logs), lines, *lists], names=[*keep, "n_tokens", "n_known", "base", "logs", "line", "words", "groups", "times"])
            if len(numbers) > HELD:
                numbers = Numbers(describe)

    return rows.select("raw", *keep).mapInArrow(run, schema)


def _sequences(done: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with ``line`` as classes throughout, 16 bits each; unknown words' classes have NEW added. ``found`` lists (at, class, known)."""
    same = [*keep, "n_tokens", "n_known", "base", "logs"]
    schema = ", ".join(f"{c} {dict(done.dtypes)[c]}" for c in same) + ", line binary"

    def run(batches):
        for batch in _slices(batches):
            bodies, found = batch.column("line").to_pylist(), batch.column("found")
            sizes = np.array([len(x) // 4 for x in bodies], dtype=np.int64)
            kind = np.frombuffer(b"".join(bodies), dtype="<i4").astype(np.int64)
            counts = np.array(pc.fill_null(pc.list_value_length(found), 0), dtype=np.int64)
            first, flat = np.cumsum(counts) - counts, found.flatten()
            of, place = np.zeros(counts.sum() + 1, dtype=np.int64), np.repeat(first, counts) + flat.field("at").to_numpy(zero_copy_only=False)
            of[place] = flat.field("class").to_numpy(zero_copy_only=False) + np.where(flat.field("known").to_numpy(zero_copy_only=False), 0, NEW)
            kind = np.where(kind < 0, of[np.where(kind < 0, np.repeat(first, sizes) - 1 - kind, 0)], kind)
            ends = (2 * np.append(0, np.cumsum(sizes))).astype(np.int32)
            lines = pa.Array.from_buffers(pa.binary(), len(bodies), [None, pa.py_buffer(ends), pa.py_buffer(kind.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in same], lines], names=[*same, "line"])

    return done.select(*same, "line", "found").mapInArrow(run, schema)


def class_bigrams(rows: DataFrame, classes: int) -> np.ndarray:
    """Class bigrams of the rows' sequences, ends included as class 0. At most MOST_CLASSES squared numbers reach the driver."""

    def run(batches):
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            line = np.frombuffer(b"".join(x + b"\0\0" for x in batch.column("line").to_pylist()), dtype="<u2").astype(np.int64) % NEW
            total += np.bincount(np.append(0, line[:-1])[: len(line)] * classes + line, minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    found = rows.select("line").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(classes, classes)


def probabilities(pairs: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of: p(class | class before); what a known word's count is multiplied by; p(unknown word | class). ``once``: words of a class met once."""
    mass = pairs.sum(axis=0)
    share = (mass + 1) / (pairs.sum() + len(pairs))
    new = np.minimum((once + 0.5) / (mass + 1), 0.5)
    new[0] = 0.5 / (mass[0] + 1)  # the end is the only token of its class
    return np.log10((pairs + MU * share) / (pairs.sum(axis=1, keepdims=True) + MU)), np.log10((1 - new) / np.maximum(mass, 1)), np.log10(new)


def score(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``train`` picks the rows to learn from; with none of them every token is
    unknown. Null text is empty and has the end token alone; repeated rows
    count each time. An empty table returns no rows; other columns are dropped.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw(text).alias("raw"), F.coalesce(train, F.lit(False)).alias("train"))
    model, words = fit(rows.where("train"))
    keep = ["row", "doc_id", "train"]
    done = materialise(_partial(rows.withColumn("row", F.monotonically_increasing_id()), model, keep), "lm-partial")
    others = done.select("row", F.posexplode(F.arrays_zip("words", "groups", "times")).alias("at", "x")).select("row", "at", F.col("x.words").alias("word"), F.col("x.groups").alias("group"), F.col("x.times").alias("t"))
    others, held = others.join(words, "word", "left"), F.col("c").isNotNull()
    sums = others.groupBy("row").agg(
        F.sum(F.when(held, F.col("t")).otherwise(0)).alias("k_"), F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("b_"), F.sum(F.when(held, F.col("t") * F.log10("c")).otherwise(0.0)).alias("s_"),
        F.collect_list(F.struct("at", F.coalesce("class", "group").alias("class"), held.alias("known"))).alias("found"),  # one row's own words
    )
    both = done.drop("words", "groups", "times").join(sums, "row", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("k_", F.lit(0)), "base": F.col("base") + F.coalesce("b_", F.lit(0.0)), "logs": F.col("logs") + F.coalesce("s_", F.lit(0.0))})
    lines = materialise(_sequences(both, keep), "lm-lines")
    pairs = class_bigrams(lines.where("train"), model.classes)
    once = np.zeros(model.classes)
    for r in words.where("c = 1").groupBy("class").count().collect():  # one row a class
        once[r["class"]] = r["count"]
    transition, known, unknown = probabilities(pairs, once)
    emission = np.concatenate([known, np.zeros(NEW - model.classes), unknown])
    low, ends = float(np.log10(model.total + model.distinct + 1)), model.ends
    given = docs.sparkSession.sparkContext.broadcast((transition, emission))

    def run(batches):
        steps, of = given.value
        for batch in batches:
            n, logs = batch.column("n_tokens").to_numpy(zero_copy_only=False), batch.column("logs").to_numpy(zero_copy_only=False)
            scores = []
            for line in batch.column("line").to_pylist():
                kind = np.frombuffer(line, dtype="<u2").astype(np.int64)
                at = np.concatenate(([0], kind % NEW, [0]))
                scores.append(of[kind].sum() + steps[at[:-1], at[1:]].sum() + of[0])
            base = batch.column("base").to_numpy(zero_copy_only=False) + np.log10(ends + 1) - low * n
            total = np.array(scores) + logs + np.log10(max(ends, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(batch.column("n_known").to_numpy(zero_copy_only=False) + (ends > 0)), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = lines.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
