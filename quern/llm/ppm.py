"""LM scoring by prediction by partial matching over bytes.

The pretrained model is a trie of byte contexts of order 0 to 3, given as counts of 4-grams of symbols (256 bytes and
one mark, which stands before the start of a text and ends it). Escape estimation is method C: in a context with
total t and d distinct symbols, a symbol of count n has n / (t + d) and the escape d / (t + d). After an escape the
symbols seen in the longer context are excluded from the shorter one, from its counts and from its distinct
symbols. Below order 0, the symbols never seen are equally likely. A context that training never saw is skipped
without cost.

Since the symbols of a context are among those of its suffix, what is excluded depends on the context alone. So
the trie unfolds to one row of log probabilities for each context, and a text is scored by looking up, for each
position, the row of its longest known context. ``adaptive_code_length`` runs the same model on one text from
nothing, learning as it goes.

What is broadcast is bounded: where contexts are left out of it, the positions whose three symbols aren't a context of
the broadcast part are scored by joins of their grams with the whole counts. The bound divides the work only.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import besides, documents, lower_ascii, materialise, words_of
from .stringkernel import remainder

ORDER, SYMBOLS, MARK = 3, 257, 256
#: Bounds of what is broadcast: contexts and symbols-in-context of each order, and words with their counts.
MAX_CONTEXTS, MAX_GRAMS, MAX_WORDS = 1 << 16, 1 << 20, 1 << 17
_BITS = 9
_CHUNK = 1 << 22


def gram_codes(data: bytes) -> np.ndarray:
    """A code of 36 bits for each symbol of a text and its end: three symbols before it and itself."""
    s = np.full(len(data) + ORDER + 1, MARK, np.int64)
    s[ORDER : ORDER + len(data)] = np.frombuffer(data, np.uint8)
    n = len(data) + 1
    return (s[:n] << 27) | (s[1 : n + 1] << 18) | (s[2 : n + 2] << 9) | s[3 : n + 3]


class CountTrie:
    """The model as nested counts, one symbol at a time: for adaptive lengths and as the plain form of ``Unfolded``."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def log10(self, before: tuple[int, ...], symbol: int) -> float:
        gone: set[int] = set()
        total = 0.0
        for k in range(self.order, -1, -1):
            context = before[len(before) - k :]
            if context not in self.counts:
                continue
            seen = self.counts[context]
            left = {s: n for s, n in seen.items() if s not in gone}
            escape = len(left) if len(seen) < SYMBOLS else 0
            among = sum(left.values()) + escape
            if symbol in left:
                return total + math.log10(left[symbol] / among)
            if escape:
                total += math.log10(escape / among)
            gone |= set(seen)
        return total - math.log10(SYMBOLS - len(gone))

    def add(self, before: tuple[int, ...], symbol: int, n: int = 1) -> None:
        for k in range(self.order + 1):
            self.counts[before[len(before) - k :]][symbol] += n


def _walk(text: str | None, order: int) -> Iterator[tuple[tuple[int, ...], int]]:
    symbols = [MARK] * order + list((text or "").encode("utf-8", "surrogatepass")) + [MARK]
    for i in range(order, len(symbols)):
        yield tuple(symbols[i - order : i]), symbols[i]


def adaptive_code_length(text: str | None, order: int = ORDER) -> float:
    """Bits of a text under a model that starts empty and learns each symbol after coding it."""
    trie, bits = CountTrie(order), 0.0
    for before, symbol in _walk(text, order):
        bits -= trie.log10(before, symbol) / math.log10(2)
        trie.add(before, symbol)
    return bits


class Unfolded:
    """The trie as arrays: ``state`` gives for three symbols the row of the longest known context, ``log10`` its row of 257.

    ``grams``: for each order 0 to 3 the arrays (code of context and symbol in 9-bit fields, count).
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        used = np.unique(np.append(grams[0][0] & 511, MARK))
        w = len(used) + 1  # symbols that never occur share the last number and stand in no context
        self.number = np.full(512, w - 1, np.int32)
        self.number[used] = np.arange(len(used))
        self.state = np.zeros((w, w, w), np.int32)
        rows, base = [], 0
        below = np.full((1, SYMBOLS), -math.log10(SYMBOLS), np.float32)
        parent_table, parent_known = None, None
        for order, (codes, counts) in enumerate(grams):
            context, at = np.unique(codes >> _BITS, return_inverse=True)
            if not len(context) and order:
                break
            symbol = codes & 511
            after = np.empty((max(len(context), 1), SYMBOLS), np.float32)  # log10 after an escape from the context
            table = np.zeros_like(after)
            np.add.at(table, (at, symbol), counts.astype(np.float32))
            out = np.empty_like(after)
            suffix = np.searchsorted(parent_known, context & ((1 << _BITS * (order - 1)) - 1)) if order else None
            for i in range(0, len(table), 4096):
                t = table[i : i + 4096].astype(np.float64)
                seen = t > 0
                if order:
                    left = np.where(seen, 0, parent_table[suffix[i : i + 4096]])
                    whole = (parent_table[suffix[i : i + 4096]] > 0).all(1, keepdims=True)
                    after[i : i + 4096] = self._share(left, whole, below[suffix[i : i + 4096]])
                else:
                    after[i : i + 4096] = -np.log10(np.maximum(SYMBOLS - seen.sum(1, keepdims=True), 1))
                out[i : i + 4096] = self._share(t, seen.all(1, keepdims=True), after[i : i + 4096])
            for c, row in zip(context.tolist(), range(base, base + len(context)), strict=True):
                where = [self.number[c >> (_BITS * k) & 511] for k in range(order - 1, -1, -1)]
                self.state[(slice(None),) * (ORDER - order) + tuple(where)] = row
            rows.append(out)
            base += len(out)
            below, parent_table, parent_known = after, table, context
            self.longest = base - len(out) if order == ORDER else base  # the first row of a whole context, or none
        self.log10 = np.concatenate(rows)

    @staticmethod
    def _share(counts: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of count / (total + escape) where there is a count, else of the escape and ``rest``."""
        distinct = (counts > 0).sum(1, keepdims=True)
        escape = np.where(whole, 0, distinct)
        among = np.maximum(counts.sum(1, keepdims=True) + escape, 1)
        away = np.log10(np.where(escape > 0, escape / among, 1))
        return np.where(counts > 0, np.log10(np.maximum(counts, 1) / among), away + rest)

    def score(self, data: bytes, others: list[np.ndarray] | None = None) -> float:
        """Sum over the text. With ``others``, grams whose context of three symbols isn't here go there, not into the sum."""
        total = 0.0
        for at in range(0, len(data) + 1, _CHUNK):
            # The last symbols of the piece before are this one's context; the mark ends the last piece only.
            piece = data[max(0, at - ORDER) : at + _CHUNK]
            lead = at - max(0, at - ORDER)
            s = np.full(ORDER + len(piece) - lead + (at + _CHUNK > len(data)), MARK, np.int64)
            s[ORDER - lead : ORDER - lead + len(piece)] = np.frombuffer(piece, np.uint8)
            n = self.number[s]
            rows = self.state[n[:-3], n[1:-2], n[2:-1]]
            logs = self.log10[rows, s[ORDER:]]
            if others is not None:
                away = rows < self.longest
                others.append(((s[:-3] << 27) | (s[1:-2] << 18) | (s[2:-1] << 9) | s[3:])[away])
                logs = logs[~away]
            total += float(logs.sum(dtype=np.float64))
        return total


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int64()), "n": pa.array(n, pa.int64())})

    held, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            held.append(gram_codes((text.as_py() or "").encode("utf-8", "surrogatepass")))
            size += len(held[-1])
            if size >= _CHUNK:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def _bounded(grams: DataFrame, floor: int) -> tuple[tuple[np.ndarray, np.ndarray], int | None]:
    """Counts of one order, of all contexts or of those with the largest totals that keep within the bounds.

    Also the least size class kept (None where nothing is), from ``floor`` on: that of the order below, so that a context's
    suffix is kept as well.
    """
    contexts = grams.groupBy(F.shiftright("code", _BITS).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    sized = contexts.withColumn("size", F.floor(F.log2("total")))
    kept = rows = 0
    least = None
    for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("contexts"), F.sum("rows").alias("rows")).orderBy(F.desc("size")).collect():
        kept, rows = kept + r["contexts"], rows + r["rows"]
        if kept > MAX_CONTEXTS or rows > MAX_GRAMS:
            break
        least = r["size"]
    else:
        least = 0
    least = None if least is None else max(least, floor)
    if least:
        large = sized.filter(F.col("size") >= least).select("context")
        grams = grams.withColumn("context", F.shiftright("code", _BITS)).join(large, "context", "left_semi")
    found = grams.select("code", "n").collect() if least is not None else []
    return (np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)), least


def _of_order(top: DataFrame, order: int) -> DataFrame:
    """(code, n) of one order from the grams of the highest."""
    fields = F.col("code").bitwiseAND(F.lit((1 << _BITS * (order + 1)) - 1))
    return top.groupBy(fields.alias("code")).agg(F.sum("n").alias("n"))


def _train(texts: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], DataFrame, bool]:
    """The counts of each order within the bounds, all counts of the highest order (code, n), and whether none is left out."""
    counted = texts.select("text").mapInArrow(_count_grams, "code long, n long")
    top = materialise(counted.groupBy("code").agg(F.sum("n").alias("n")), "grams")
    out, least = [], 0
    for order in range(ORDER + 1):
        if least is None:
            out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        grams, least = _bounded(_of_order(top, order), least)
        out.append(grams)
    return out, top, least == 0


def train(texts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gram counts of each order from all rows of ``texts`` (column text; null counts as empty), within the bounds."""
    return _train(texts)[0]


def gram_logs(codes: DataFrame, top: DataFrame) -> DataFrame:
    """(code, log10) of distinct grams (column code) under all counts ``top``, by joins; native.

    The symbols of a context are among those of its suffix. So what is left of the suffix after an escape has the
    difference of their distinct symbols, and its total without the counts there of the context's symbols (``gone``).
    """
    grams = [materialise(_of_order(top, k), f"grams-{k}") for k in range(ORDER)] + [top]
    found = codes.select("code")
    for k in range(ORDER, -1, -1):
        part = grams[k].withColumn("context", F.shiftright("code", _BITS))
        stats = [F.sum("n").alias(f"t{k}"), F.count(F.lit(1)).alias(f"d{k}")]
        if k:
            short = F.col("code").bitwiseAND(F.lit((1 << _BITS * k) - 1))
            part = part.withColumn("short", short).join(grams[k - 1].select(F.col("code").alias("short"), F.col("n").alias("under")), "short")
            stats.append(F.sum("under").alias(f"gone{k}"))
        contexts = part.groupBy("context").agg(*stats).withColumnRenamed("context", f"c{k}")
        own = F.col("code").bitwiseAND(F.lit((1 << _BITS * (k + 1)) - 1))
        found = found.withColumn(f"g{k}", own).withColumn(f"c{k}", F.shiftright(own, _BITS))
        found = found.join(contexts, f"c{k}", "left").join(grams[k].select(F.col("code").alias(f"g{k}"), F.col("n").alias(f"n{k}")), f"g{k}", "left")
    log = -F.log10(F.lit(float(SYMBOLS)) - F.coalesce("d0", F.lit(0)))
    for k in range(ORDER + 1):
        none = F.lit(0)
        d, gone, above = F.col(f"d{k}"), F.coalesce(f"gone{k + 1}", none) if k < ORDER else none, F.coalesce(f"d{k + 1}", none) if k < ORDER else none
        escape = F.when(d < SYMBOLS, d - above).otherwise(0)
        among = F.col(f"t{k}") - gone + escape
        away = F.when(escape > 0, F.log10(escape / among)).otherwise(0.0)
        log = F.when(d.isNull(), log).when(F.col(f"n{k}").isNotNull(), F.log10(F.col(f"n{k}") / among)).otherwise(away + log)
    return found.select("code", log.alias("log10"))


_built: dict[str, tuple] = {}


def _here(shared: Broadcast, name: str) -> tuple:
    """The unfolded model of a broadcast, built once in each Python worker."""
    if name not in _built:
        _built.clear()
        grams, words, whole = shared.value
        _built[name] = Unfolded(grams), words, whole
    return _built[name]


def _score(shared: Broadcast, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs, whole = _here(shared, name)
        for batch in batches:
            n_tokens, n_known, base, score, tails, others = [], [], [], [], [], []
            for text in batch["text"]:
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                words = data.lower().split()
                found = [logs[w] for w in words if w in logs]
                n_tokens.append(len(words) + 1)
                n_known.append(len(found))
                base.append(math.fsum(found))
                tails.append([w for w in words if w not in logs] if len(found) < len(words) else [])
                away: list[np.ndarray] | None = None if whole else []
                score.append(model.score(data, away))
                if away is not None:
                    others.append(np.unique(np.concatenate(away), return_counts=True))
            rest = [c for c in batch.schema.names if c != "text"]
            columns = {c: batch[c] for c in rest} | {"n_tokens": pa.array(n_tokens, pa.int64()), "n_top": pa.array(n_known, pa.int64()), "base_top": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())}
            columns["tail"] = pa.array(tails, pa.list_(pa.binary()))
            if not whole:
                columns |= {c: pa.array([x[k] for x in others], pa.list_(pa.int64())) for k, c in enumerate(("codes", "times"))}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def score_texts(df: DataFrame, train_on: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df`` with n_tokens, n_known, train_tokens, base_score and score for every row.

    Learns from all rows of ``train_on`` (column text). Null texts count as empty: one token, the end. Repeated rows
    get equal results. With nothing to learn from, the base is log10 of 0.5 / 0.5 for each token and the model knows
    the alphabet alone. An empty ``df`` gives no rows. Columns of ``keep`` named like an output, or like one that this makes on its way, are
    left out.
    """
    spark = df.sparkSession
    keep = besides(keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_top", "base_top", "tail", "codes", "times", "n_rare", "base_rare", "score_away", "text", "__row")
    grams, counts, whole = _train(train_on)
    lowered = train_on.select(F.explode(words_of(lower_ascii(F.col("text")))).alias("word")).select(F.col("word").cast("binary"))
    words = materialise(lowered.groupBy("word").agg(F.count(F.lit(1)).alias("c")), "words")
    ends = train_on.count()
    sizes = words.groupBy(F.floor(F.log2("c")).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("tokens")).orderBy(F.desc("size")).collect()
    total, distinct = ends + sum(r["tokens"] for r in sizes), (ends > 0) + sum(r["n"] for r in sizes)
    below = total + 0.5 * (distinct + 1)
    many, least = 0, 64
    for r in sizes:
        many += r["n"]
        if many > MAX_WORDS:
            break
        least = r["size"]
    top = {bytes(r["word"]): math.log10((r["c"] + 0.5) / below) for r in words.filter(F.floor(F.log2("c")) >= least).collect()}
    shared = spark.sparkContext.broadcast((grams, top, whole))
    rows = df.select(*keep, F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    away = "" if whole else ", codes array<bigint>, times array<bigint>"
    scored = materialise(rows.mapInArrow(_score(shared, uuid.uuid4().hex), f"{kept}, n_tokens long, n_top long, base_top double, score double, tail array<binary>{away}"), "scored")
    rare = words.filter(F.floor(F.log2("c")) < least)
    tail = scored.select("__row", F.explode("tail").alias("word")).join(rare, "word", "left")
    tail = tail.groupBy("__row").agg(F.count("c").alias("n_rare"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))).alias("base_rare"))
    end = math.log10((ends + 0.5) / below)
    zero = F.lit(0)
    if not whole:
        held = scored.select("__row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("__row", F.col("x.codes").alias("code"), "x.times")
        logs = materialise(gram_logs(materialise(held.select("code").distinct(), "codes"), counts), "gram-logs")
        sums = held.join(logs, "code").groupBy("__row").agg(F.sum(F.col("times") * F.col("log10")).alias("score_away"))
        scored = scored.join(sums, "__row", "left").withColumn("score", F.col("score") + F.coalesce("score_away", F.lit(0.0)))
    return scored.join(tail, "__row", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", zero) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0)) + end).alias("base_score"),
        "score",
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    return score_texts(docs.withColumn("held_out", held), docs.filter(~held).select("text"), ["doc_id", "held_out"])
