"""LM scoring with a hidden Markov model: Baum-Welch counts summed over partitions, exact scaled forward likelihoods."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"  # no word holds white space, so this token is the end alone
SUFFIX, CLASSES = 4, 4096


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words and one end."""
    return [*text.translate(_LOWER).split(), END]


def class_of(word: bytes) -> int:
    """Words without a symbol of their own share a class by the hash of their last bytes."""
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


def _raw(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def count_tokens(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """(word binary, n) over all rows of ``texts(text)``; tasks count first and hand on when they hold ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(_raw(text)))
                if len(counts) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What tasks know of the training tokens.

    ``words`` are those of a share of 1/``known`` of the tokens or more, so at most ``known``, with their ``counts``; the
    first ``symbols`` of them (a share of 1/``own`` or more, and the end) have symbols of their own. All others
    share CLASSES classes, of which class_n and class_v count the tokens and the words.
    """

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    symbols: int
    class_n: np.ndarray
    class_v: np.ndarray

    @property
    def size(self) -> int:
        return self.symbols + CLASSES

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def symbol_of(self) -> np.ndarray:
        return np.array([i if i < self.symbols else self.symbols + class_of(w) for i, w in enumerate(self.words)], np.int32)

    def symbol_n(self) -> np.ndarray:
        return np.concatenate((self.counts[: self.symbols], self.class_n)).astype(float)


def vocabulary(counts: DataFrame, known: int = 1 << 20, own: int = 1 << 16) -> Vocabulary:
    """From all of ``counts``; at most ``known`` words and CLASSES classes reach the driver."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total:
        return Vocabulary(0, 0, [], np.zeros(0, np.int64), 0, np.zeros(CLASSES), np.zeros(CLASSES))
    often = counts.where((F.col("n") * known >= total) | (F.col("word") == F.lit(END))).toArrow()
    rows = sorted(zip(often.column("n").to_pylist(), often.column("word").to_pylist(), strict=True), key=lambda r: (r[1] != END, -r[0], r[1]))
    symbols = sum(1 for n, w in rows if n * own >= total or w == END)
    suffix = F.crc32(F.expr(f"substring(word, greatest(length(word) - {SUFFIX - 1}, 1), {SUFFIX})")) % CLASSES
    by = counts.where((F.col("n") * own < total) & (F.col("word") != F.lit(END))).groupBy(suffix.cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, n, v in by:
        class_n[c], class_v[c] = n, v
    return Vocabulary(total, distinct, [w for _, w in rows], np.array([n for n, _ in rows], np.int64), symbols, class_n, class_v)


@dataclass(frozen=True)
class HMM:
    """start [K], move [K, K] (row to column) and emit [K, symbols]: probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    history: tuple[float, ...] = ()  # the training texts' log10 likelihood by the model that each round began with


class _Steps:
    """Sequences laid out by time, longest first, so that step t is the slice of those that last beyond t."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        flat = np.concatenate([sequences[i] for i in self.order])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        within = np.arange(len(flat)) - np.repeat(starts, lengths)
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[self.at[within] + np.repeat(np.arange(len(lengths)), lengths)] = flat


def likelihoods(model: HMM, sequences: list[np.ndarray], most: int = 1 << 18) -> np.ndarray:
    """log10 probabilities of whole sequences of symbols (one at least each), by the scaled forward recursion; emissions are looked up for about ``most`` symbols at a time."""
    steps, emit, a = _Steps(sequences), np.ascontiguousarray(model.emit.T), None
    at, logs, t = steps.at, np.zeros(len(sequences)), 0
    while t < len(steps.active):
        end = max(t + 1, int(np.searchsorted(at, at[t] + most, "right")) - 1)
        e = emit[steps.symbols[at[t] : at[end]]]
        scales = np.empty(len(e))
        bounds = (at[t : end + 1] - at[t]).tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            a = (model.start if a is None else a[: hi - lo] @ model.move) * e[lo:hi]
            scale = scales[lo:hi] = a.sum(axis=1)
            a /= scale[:, None]
        within = np.arange(len(e)) - np.repeat(at[t:end] - at[t], steps.active[t:end])
        logs += np.bincount(within, np.log10(scales), len(sequences))
        t = end
    back = np.empty(len(sequences))
    back[steps.order] = logs
    return back


def expected_counts(model: HMM, sequences: list[np.ndarray], span: int = 1024, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's sums over whole sequences (single precision inside): starts, moves, emissions [K, symbols], log10 likelihood.

    Memory is bounded: where there are over ``most`` symbols, the forward recursion keeps its state at every ``span``-th
    step, and the backward one makes the steps between anew.
    """
    steps, emit, move, first = _Steps(sequences), np.ascontiguousarray(model.emit.T, np.float32), model.move.astype(np.float32), model.start.astype(np.float32)
    k, at, last = len(move), steps.at.tolist(), len(steps.active)
    span = span if len(steps.symbols) > most else last

    def forward(a: np.ndarray | None, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the state before step ``lo``: emissions, states and scales up to step ``hi``."""
        e, base = emit[steps.symbols[at[lo] : at[hi]]], at[lo]
        states, scales = np.empty_like(e), np.empty(len(e), np.float32)
        for t in range(lo, hi):
            i, j = at[t] - base, at[t + 1] - base
            a = np.multiply(first if a is None else a[: j - i] @ move, e[i:j], out=states[i:j])
            s = scales[i:j] = a.sum(axis=1)
            a /= s[:, None]
        return e, states, scales

    begins, entry = list(range(0, last, span)), [None]
    for lo in begins[:-1]:
        _, states, _ = forward(entry[-1], lo, lo + span)
        entry.append(states[at[lo + span - 1] - at[lo] :].copy())
    moves, emitted, starts, log, ahead = np.zeros((k, k)), np.zeros((model.emit.shape[1], k)), np.zeros(k), 0.0, np.zeros((0, k), np.float32)
    for lo, a in zip(reversed(begins), reversed(entry), strict=True):
        hi = min(lo + span, last)
        e, states, scales = forward(a, lo, hi)
        log += float(np.log10(scales, dtype=np.float64).sum())
        e /= scales[:, None]
        for t in range(hi - 1, lo - 1, -1):
            i, j = at[t] - at[lo], at[t + 1] - at[lo]
            n = len(ahead)
            own = states[i:j]
            moves += own[:n].T @ ahead
            full = ahead @ move.T
            if n < j - i:  # sequences that end here
                full = np.concatenate((full, np.ones((j - i - n, k), np.float32)))
            ahead = e[i:j] * full
            own *= full  # turns into the posterior
        states /= states.sum(axis=1, keepdims=True)
        symbols = steps.symbols[at[lo] : at[hi]]
        for i in range(k):
            emitted[:, i] += np.bincount(symbols, states[:, i], model.emit.shape[1])
        if lo == 0:
            starts = states[: at[1]].sum(axis=0, dtype=float)
    return starts, moves * model.move, emitted.T, log


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[list[np.ndarray]]:
    """Sequences of about ``most`` symbols at a time, over batches, so that long ones are handled side by side."""
    own, n = [], 0
    for batch in batches:
        for row in batch.column(0):
            own.append(np.frombuffer(row.as_buffer(), np.int32))
            n += len(own[-1])
            if n > most:
                yield own
                own, n = [], 0
    if own:
        yield own


def _groups(sequences: list[np.ndarray], most: int = 400_000, long: int = 2048) -> Iterator[list[int]]:
    """Indexes of sequences of alike lengths, of about ``most`` symbols; those of over ``long`` symbols are one group, as each step costs the same for few and many."""
    order, own, n = sorted(range(len(sequences)), key=lambda i: -len(sequences[i])), [], 0
    for i in order:
        if own and n + len(sequences[i]) > most and len(sequences[i]) <= long:
            yield own
            own, n = [], 0
        own.append(i)
        n += len(sequences[i])
    if own:
        yield own


def encode(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(ids binary): the symbols (32-bit) of every row of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = vocab.symbol_of().tolist()
        known = {w: symbols[i] for i, w in enumerate(vocab.words)}
        base = vocab.symbols
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = words_of(_raw(text))
                ids = [known.get(w, -1) for w in words]
                if -1 in ids:
                    ids = [base + class_of(w) if i < 0 else i for i, w in zip(ids, words, strict=True)]
                out.append(np.array(ids, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "ids binary")


def train(texts: DataFrame, vocab: Vocabulary, states: int = 12, rounds: int = 4, prior: float = 50.0) -> HMM:
    """Baum-Welch over all rows of ``texts(text, doc_id)``, whole sequences each.

    States begin as the smoothed words of the ``states`` documents of the lowest hashes, moves as staying 9 times of 10.
    In each of ``rounds`` tasks sum expected counts over their documents; Spark sums tasks' counts by symbol.
    Emissions are smoothed by ``prior`` words of the overall frequencies. The model's ``history`` has the texts'
    likelihood before each round, which rises.
    """
    unigram = (vocab.symbol_n() + 0.5) / (vocab.symbol_n() + 0.5).sum()
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    emit = np.tile(unigram, (states, 1))
    if not vocab.total:
        return HMM(np.full(states, 1 / states), move, emit)
    ids = materialize(encode(texts, vocab), "symbols")
    few = encode(texts.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(states), vocab).collect()
    for k, row in enumerate(few):
        own = np.bincount(np.frombuffer(row["ids"], np.int32), minlength=vocab.size)
        emit[k] = (own + prior * unigram) / (own.sum() + prior)
    model = HMM(np.full(states, 1 / states), move, emit)
    columns = [f"k{i}" for i in range(states)]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: HMM = model) -> Iterator[pa.RecordBatch]:
            starts, moves, emitted, log = np.zeros(states), np.zeros((states, states)), np.zeros((states, vocab.size)), 0.0
            for sequences in _gathered(batches):
                for group in _groups(sequences):
                    a, b, c, d = expected_counts(model, [sequences[i] for i in group])
                    starts += a
                    moves += b
                    emitted += c
                    log += d
            some = np.flatnonzero(emitted.sum(axis=0) > 0)
            rows = np.concatenate((np.full((states, 1), log), starts[:, None], moves.T, emitted[:, some]), axis=1)
            index = np.concatenate((np.arange(-2 - states, 0), some))
            yield pa.RecordBatch.from_arrays([pa.array(index), *(pa.array(r) for r in rows)], ["symbol", *columns])

        sums = ids.mapInArrow(run, "symbol long, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        symbol = sums.column("symbol").to_numpy() + states + 2
        table = np.zeros((states + 2 + vocab.size, states))
        table[symbol] = np.stack([sums.column(c).to_numpy() for c in columns], axis=1)
        # sums in another order differ in the last bits
        starts, moves, emitted = table[1], table[2 : states + 2].T, table[states + 2 :].T
        model = HMM(
            (starts + 1 / states) / (starts.sum() + 1),
            (moves + 1 / states) / (moves.sum(axis=1, keepdims=True) + 1),
            (emitted + prior * unigram) / (emitted.sum(axis=1, keepdims=True) + prior),
            (*model.history, float(table[0, 0])),
        )
    return model


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: HMM) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text.

    A text's probability: that of its symbols by the model, and for words without a symbol of their own their
    smoothed share of their class. Tasks know the counts of ``vocab.words``; other words are joined with
    ``counts``, once a document and word.
    """
    n0, v0 = vocab.total, vocab.distinct
    base = float(np.log10(n0 + 0.5 * (v0 + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, symbol, at, row_id = vocab.index(), vocab.symbol_of(), vocab.symbols, TaskContext.get().partitionId() << 40
        log_c = np.log10(vocab.counts + 0.5)
        log_class = np.log10(vocab.class_n + 0.5 * (vocab.class_v + 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                sequences, columns = [], ([], [], [], [], [], [])
                for text in batch.column(1):
                    words = words_of(_raw(text))
                    found = np.array([index.get(w, -1) for w in words], np.int64)
                    known = found >= 0
                    other = [words[i] for i in np.flatnonzero(~known).tolist()]
                    ids = np.empty(len(words), np.int32)
                    ids[known] = symbol[found[known]]
                    ids[~known] = [at + class_of(w) for w in other]
                    shared = ids >= at
                    log_known = float(log_c[found[known]].sum())
                    log_shared = float(log_c[found[known & shared]].sum() - log_class[ids[shared] - at].sum())
                    sequences.append(ids)
                    rest = Counter(other)
                    for to, x in zip(columns, (row_id, len(words), int(known.sum()), log_known, log_shared, [{"word": w, "k": k} for w, k in rest.items()]), strict=True):
                        to.append(x)
                    row_id += 1
                logs = np.zeros(len(sequences))
                for group in _groups(sequences, 500_000):
                    logs[group] = likelihoods(model, [sequences[i] for i in group])
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(logs)], ["doc_id", "row", "n", "known", "log_known", "log_shared", "rest", "logs"])

    schema = "doc_id long, row long, n long, known long, log_known double, log_shared double, rest array<struct<word binary, k long>>, logs double"
    scored = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "scored")
    rest = scored.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k")
    met = rest.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_rest"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rest_known"))
    log_rest = F.coalesce("log_rest", F.lit(0.0))
    return scored.join(met, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        (F.col("log_known") + log_rest - F.col("n") * F.lit(base)).alias("base_score"),
        (F.col("logs") + F.col("log_shared") + log_rest).alias("score"),
    )


def fold(parts: int):
    """crc32(doc_id as text) modulo ``parts``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1(docs: DataFrame, states: int = 12, rounds: int = 4) -> DataFrame:
    """Learns from rows whose fold of 5 is not 1 and scores all; the contract's columns.

    Null texts are empty: their end alone; a very long text is one sequence, in memory that grows with its tokens alone.
    Other columns play no part. A null doc_id is neither learned from nor held out; repeated rows count each
    time; with nothing to learn from all tokens are unknown; no rows give no rows.
    """
    learned = docs.where(fold(5) != 1).select("doc_id", F.col("text").cast("string").alias("text"))
    counts = materialize(count_tokens(learned), "counts")
    vocab = vocabulary(counts)
    model = train(learned, vocab, states, rounds)
    out = score(docs, counts, vocab, model)
    return out.select("doc_id", F.coalesce(fold(5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
