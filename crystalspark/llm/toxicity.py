"""Toxicity of texts after noisy-channel deobfuscation.

Tokens that look disguised (letters mixed with look-alike digits or signs,
letters drawn out, letters set apart) become a lattice: at each place the
letters that a writer may have meant, or nothing, with a channel cost. A
Viterbi search under a character trigram model, counted over all documents,
picks the cheapest reading. Restored words and their beginnings feed a
logistic regression.

The classifier is fitted on at most ``SAMPLE`` labelled rows, drawn by hash;
the character model covers every document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crystalspark.llm.common import free_name, materialise, raw, worker_state

#: Labelled rows that fit the classifier, at most; its inputs; documents that an input has to be in.
SAMPLE, INPUTS, LEAST = 12_000, 2500, 4
#: Letters of the longest word looked for in letters set apart.
LONGEST = 16
#: Words a task remembers.
CACHE = 300_000
#: What a sign may stand for (fixed values: common leetspeak and look-alikes).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c",
    "{": "c", "€": "e", "£": "l", "¢": "c", "§": "s", "¡": "i", "×": "x", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "т": "t", "м": "m", "н": "h", "к": "k", "в": "b",
}
#: Signs that are left out when they stand among letters.
FILLERS = set(".-_*~^'`´·•/\\,:;#%&=?\"")
#: Channel costs, in nats: a look-alike meant, a sign left out, a drawn-out letter kept once or twice, a gap meant as one.
MEANT, LEFT_OUT, ONCE, TWICE, GAP = 0.7, 0.4, 0.5, 1.2, 2.0
_SIZE = 28
_LETTER = re.compile(r"[^\W\d_]")
#: Three letters in a row, or a letter beside a sign or digit beside a letter.
_ODD = re.compile(r"([^\W\d_])\1\1|[^\W\d_][^\w\s]+[^\W_]|[^\W\d_]_+[^\W_]|[^\W_][0-9]|[0-9][^\W_]|[0-9@$!|+(<{€£¢§¡×][^\W\d_]|[^\W\d_][0-9@$|+(<{€£¢§¡×!]|[Ͱ-ӿ]|[​-‏⁠﻿­]")
_APART = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")


def symbol(c: str) -> int:
    """0: edge or sign, 1 to 26: a to z, 27: another letter."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _symbols() -> np.ndarray:
    """``symbol`` of every code point, built once a worker."""
    state = worker_state()
    if "symbols" not in state:
        state["symbols"] = np.fromiter((symbol(chr(i)) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    return state["symbols"]


def character_counts(docs: DataFrame) -> DataFrame:
    """(code, n): symbol trigrams of the ``raw`` texts."""

    def run(batches):
        total, table = np.zeros(_SIZE**3, dtype=np.int64), _symbols()
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            line = "".join("  " + body.decode("utf-8", "replace").lower() for body in batch.column("raw").to_pylist()) + " "
            s = table[np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)].astype(np.int32)
            total += np.bincount((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:], minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    return docs.select("raw").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> np.ndarray:
    """-log p(c | a, b) as [a, b, c], trigrams backed by bigrams and single symbols. At most 28**3 rows reach the driver."""
    found = character_counts(docs).toArrow()
    n = np.zeros(_SIZE**3)
    n[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return smooth(n.reshape(_SIZE, _SIZE, _SIZE))


def smooth(n: np.ndarray) -> np.ndarray:
    two, one = n.sum(axis=0), n.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + _SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return -np.log((n + 5 * p2) / (n.sum(axis=2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each place of a lower-case token and their costs; a run of one character is one place."""
    places, k, letters = [], 0, [i for i, c in enumerate(token) if _LETTER.match(c) or c in LOOKALIKES and c not in "!|+(<{"]
    first, last = (letters[0], letters[-1]) if letters else (0, -1)
    while k < len(token):
        run = k + 1
        while run < len(token) and token[run] == token[k]:
            run += 1
        c, n = token[k], run - k
        options = []
        if c == "\t":
            options = [("", 0.0), (" ", GAP)]
        elif c in LOOKALIKES:
            for x in LOOKALIKES[c]:
                options.append((x, MEANT + (ONCE if n > 1 else 0)))
                if n == 2:
                    options.append((x + x, MEANT))
            if not c.isalpha():
                options.append((" " if c.isdigit() else "", 2.5 if c.isdigit() else LEFT_OUT if not first < k < last else 1.5))
        elif c.isalpha():
            options = [(c * n, 0.0)] if n < 3 else [(c, ONCE), (c + c, TWICE)]
        elif c in FILLERS or not c.isalnum():
            options = [("", LEFT_OUT if first < k < last else 0.0)] + ([(" ", GAP)] if first < k < last else [])
        else:
            options = [(" ", 0.0)]
        places.append(options)
        k = run
    return places


def decode(token: str, model: list) -> str:
    """The cheapest reading of a token; ``model`` is -log p nested as [a][b][c]. Time and memory grow with its length."""
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}  # cost and the chain of readings
    for options in lattice(token):
        after: dict[tuple[int, int], tuple] = {}
        for (a, b), (cost, chain) in states.items():
            for reading, price in options:
                x, y, total = a, b, cost + price
                for c in reading:
                    s = symbol(c)
                    total += model[x][y][s]
                    x, y = y, s
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (chain, reading))
        states = after
    chain = min(((cost + model[a][b][0], k, chain) for k, ((a, b), (cost, chain)) in enumerate(states.items())), default=(0.0, 0, None))[2]
    parts = []
    while chain is not None:
        chain, reading = chain
        parts.append(reading)
    return "".join(reversed(parts)).strip()


def restore_word(word: str, model: list) -> str:
    """A lower-case word as it was meant; plain words stay, edge signs go."""
    if _INVISIBLE.search(word):
        word = _INVISIBLE.sub("", word)
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).lower()
    bare = word.strip("".join(FILLERS) + "()[]{}<>«»“”„|+")
    if _ODD.search(bare):
        return decode(bare, model)
    return bare.strip("!$@")


def apart(text: str) -> list[str]:
    """Runs of single characters set apart, as tokens with tabs for wide gaps."""
    return ["".join("\t" + c if gap else c for gap, c in zip([False] + [len(g) > 1 for g in re.findall(r"[ \t]+", m.group())], re.split(r"[ \t]+", m.group()))) for m in _APART.finditer(text)]


def restore(text: str, model: list) -> str:
    """The whole text with disguised words restored, in lower case."""
    low = text.lower()
    low = _APART.sub(lambda m: decode(apart(m.group())[0], model), low)
    return re.sub(r"\S+", lambda m: restore_word(m.group(), model), low)


def inputs_of(word: str) -> list[str]:
    """Inputs that a restored word gives: each of its words, and their beginnings."""
    out = []
    for w in word.split():
        out.append("=" + w)
        out += [w[:k] for k in (4, 5, 6) if len(w) >= k]
    return out


def inputs_of_run(reading: str) -> list[str]:
    """Inputs of a run of letters set apart: words may lie anywhere in it."""
    s = reading.replace(" ", "")
    return ["=" + s[i : i + k] for k in range(3, LONGEST + 1) for i in range(len(s) - k + 1)] + [x for i in range(len(s)) for x in (s[i : i + 4], s[i : i + 5], s[i : i + 6])]


class Reader:
    """The set of inputs of a text; words met before come from a bounded cache."""

    def __init__(self, model: list, wanted: dict[str, int] | None = None):
        self.model, self.wanted, self.cache = model, wanted, {}

    def pick(self, names: list[str]) -> tuple:
        if self.wanted is None:
            return tuple(names)
        return tuple({self.wanted[x] for x in names if x in self.wanted})

    def __call__(self, text: str) -> set:
        low, out, cache = text.lower(), set(), self.cache
        for w in set(low.split()):
            found = cache.get(w)
            if found is None:
                if len(cache) > CACHE:
                    cache.clear()
                found = cache[w] = self.pick(inputs_of(restore_word(w, self.model)))
            if found:
                out.update(found)
        for run in apart(low):
            reading = decode(run, self.model).replace(" ", "")
            for at in range(0, len(reading), 1 << 12):  # pieces overlap by a word's length
                out.update(self.pick(inputs_of_run(reading[max(0, at - LONGEST) : at + (1 << 12)])))
        return out


@dataclass
class Classifier:
    letters: list  #: character model, nested lists
    inputs: dict[str, int]
    weights: np.ndarray
    bias: float

    def state(self) -> tuple:
        return self.letters, self.inputs, self.weights, self.bias


def logistic(rows: list[list[int]], labels: np.ndarray, size: int, penalty: float = 0.08, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression over sets of inputs, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    of = np.array([i for r in rows for i in r], dtype=np.int64)
    per = np.bincount(at, minlength=len(rows)) if len(rows) else np.zeros(0)
    rate = 1.0 / (0.25 * max(1.0, float(per.max(initial=0)) + 1) * max(1, np.bincount(of, minlength=size).max(initial=0)) ** 0.5 * max(1, len(rows)) ** 0.5 + penalty)
    w, b, vw, vb = np.zeros(size), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))), np.zeros(size), 0.0
    for step in range(steps):
        momentum = step / (step + 3)
        lw, lb = w + momentum * vw, b + momentum * vb
        z = np.bincount(at, lw[of], minlength=len(rows)) + lb
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        nw = lw - rate * (np.bincount(of, error[at], minlength=size) + penalty * lw)
        nb = lb - rate * error.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Classifier:
    """Learn from rows of ``labels`` that ``learn`` (over doc_id) picks, at most ``SAMPLE`` by hash.

    Rows without an id or label, and labels without a document, teach nothing;
    an id with several labels teaches each; null texts are empty; very long
    texts are read whole. With no label, or labels of one kind only, the model
    is its bias. Only the id and label of ``labels`` and the id and text of
    ``docs`` are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw(text).alias("raw"))
    letters = character_model(rows).tolist()
    named = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = named.where(learn).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(SAMPLE)
    # at most SAMPLE small rows
    texts = materialise(rows.join(F.broadcast(chosen), "doc_id").repartition(8 * spark.sparkContext.defaultParallelism), "toxicity-sample")
    shared = spark.sparkContext.broadcast(letters)

    def count(batches):
        read, seen, bad = Reader(shared.value), Counter(), Counter()
        for batch in batches:
            for body, y in zip(batch.column("raw").to_pylist(), batch.column("label").to_pylist()):
                found = read(body.decode("utf-8", "replace"))
                seen.update(found)
                if y:
                    bad.update(found)
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[x] for x in names], pa.int64()), pa.array([bad[x] for x in names], pa.int64())], names=["name", "n", "bad"])

    total, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Classifier(letters, {}, np.zeros(0), float(np.log((toxic + 0.5) / (total - toxic + 0.5))) if total else 0.0)
    sums = texts.mapInArrow(count, "name string, n long, bad long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= LEAST)
    share = toxic / total
    excess = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    # the inputs that stand out most; INPUTS rows reach the driver
    best = sums.where(F.col("bad") > F.col("n") * (share + (1 - share) / 2)).orderBy(excess.desc(), "name").limit(INPUTS).select("name").collect()
    inputs = {r.name: i for i, r in enumerate(best)}
    given = spark.sparkContext.broadcast((letters, inputs))

    def mark(batches):
        read = Reader(*given.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([sorted(read(b.decode("utf-8", "replace"))) for b in batch.column("raw").to_pylist()], pa.list_(pa.int32()))], names=["label", "inputs"]
            )

    marked = texts.mapInArrow(mark, "label int, inputs array<int>").toArrow()  # at most SAMPLE rows
    w, b = logistic(marked.column("inputs").to_pylist(), marked.column("label").to_numpy().astype(float), len(inputs))
    return Classifier(letters, inputs, w, b)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", name: str = "score", keep_restored: str | None = None) -> DataFrame:
    """``docs`` with ``name``, the probability of label 1 for the restored text, and optionally that text.

    Null and empty texts score by the bias alone; every input row returns once;
    columns named like the added ones are replaced. The text stays.
    """
    rows = docs.drop(name, *([keep_restored] if keep_restored else []))
    body = free_name(rows.columns, "raw")
    rows = rows.withColumn(body, raw(text))
    schema = rows.drop(body).schema.add(name, "double")
    if keep_restored:
        schema = schema.add(keep_restored, "string")
    given = docs.sparkSession.sparkContext.broadcast(classifier.state())

    def run(batches):
        letters, inputs, weights, bias = given.value
        read = Reader(letters, inputs)
        for batch in batches:
            bodies = [b.decode("utf-8", "replace") for b in batch.column(body).to_pylist()]
            z = np.array([bias + weights[sorted(read(b))].sum() if inputs else bias for b in bodies])
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != body]
            columns.append(pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64()))
            if keep_restored:
                columns.append(pa.array([restore(b, letters) for b in bodies], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
