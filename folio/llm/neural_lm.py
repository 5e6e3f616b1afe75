"""Language-model scores: a log-bilinear network over word classes, trained with noise-contrastive estimation.

The words of all training documents are counted. The most frequent ones and the end of a text are outputs of the
network by themselves; all others fall into classes by their last two bytes. The network predicts the output of a
token from the CONTEXT tokens before it: their vectors, weighed by place, are added up, and the sum times all output
vectors gives, after normalising, a probability of each output. A word of a class then has its share of the class,
(c + 1) / (occurrences + words of the class + 1), so each class leaves one share to words never seen. The
probabilities of all words and of the unseen words of each class sum to one.

Every training document takes part: each task passes over its own with stochastic gradients from the parameters of
the round before, and the parameters of all tasks are averaged, weighed by tokens. A first round over an eighth of the
documents gives all tasks a common start.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, written

#: Outputs: words (the end of a text among them), classes of one ending each, and classes of hashed endings.
WORDS, ENDINGS, HASHED = 224, 128, 32
OUTPUTS = WORDS + ENDINGS + HASHED
WIDTH, CONTEXT = 32, 2
#: Passes over training documents: each over those whose hash leaves no rest; the last is over all.
ROUNDS = (8, 1)
BATCH, NOISE, SHARE, RATE = 1024, 32, 16.0, 0.15
#: Words whose counts are sent to all tasks, at most; counts of rarer words are joined.
KNOWN = 131_072
#: Words counted in a task before they are handed on, and parameters averaged at once.
HELD, MEAN = 400_000, 32
#: Bytes of a long text that are looked at at once, and tokens that are scored at once.
STRETCH, TOKENS = 1 << 22, 1 << 15
#: The end of a text; no word is empty.
END = b""


def tokens_of(raw: bytes) -> Iterator[list[bytes]]:
    """ASCII-lower-cased words of a text in order, in lists of bounded size: a long text is taken in stretches that end between words."""
    raw, at = raw.lower(), 0
    while at < len(raw):
        end = raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def held_out(id_col: str):
    """True for the seventh of rows that nothing is learnt from: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learnt, kept = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = [*(learnt.keys() | kept.keys())]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([learnt[w] for w in words], pa.int64()), pa.array([learnt[w] + kept[w] for w in words], pa.int64())], ["word", "c", "n"])

    for batch in batches:
        for raw, held in zip(batch.column(0), batch.column(1).to_pylist()):
            into = kept if held else learnt
            for part in tokens_of(raw.as_py() or b""):
                into.update(part)
            into[END] += 1
            if len(learnt) + len(kept) > HELD:
                yield out()
                learnt.clear(), kept.clear()
    yield out()


class Codes(dict):
    """word -> place among the known words; of any other word -1 less its output."""

    def __init__(self, words: list[bytes], endings: dict[bytes, int]):
        super().__init__(zip(words, range(len(words))))
        self.endings = endings

    def __missing__(self, word: bytes) -> int:
        return -1 - self.output(word)

    def output(self, word: bytes) -> int:
        ending = word[-2:]
        found = self.endings.get(ending)
        return WORDS + ENDINGS + zlib.crc32(ending) % HASHED if found is None else found

    def __reduce__(self):
        return (Codes, ([*self], self.endings))


@dataclass
class Vocabulary:
    """What is counted over all training documents; its size is bounded, whatever the table."""

    codes: Codes
    output: np.ndarray  # of the known words
    count: np.ndarray
    weight: np.ndarray  # occurrences of each output
    types: np.ndarray  # words of each class; 0 for words that are outputs themselves
    n: int
    v: int

    def outputs(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.output[np.maximum(codes, 0)], -1 - codes)

    def of(self, raw: bytes) -> tuple[np.ndarray, Counter]:
        """(codes of a text, its end included; words that are not known with their numbers)."""
        codes, rare, known = [], Counter(), self.codes
        for part in tokens_of(raw):
            c = np.fromiter([known[w] for w in part], np.int64, len(part))
            codes.append(c)
            rare.update(part[i] for i in np.flatnonzero(c < 0).tolist())
        return np.append(np.concatenate(codes) if codes else np.empty(0, np.int64), self.codes[END]), rare


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, c: occurrences in training documents, n: in all documents)."""
    n, v = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_size = counts.where(F.col("word") != END).groupBy(F.floor(8 * F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()  # some hundred rows
    least, room = None, KNOWN
    for row in by_size:
        room -= row["count"]
        if room < 0:
            break
        least = row["size"]
    often = counts.where(F.floor(8 * F.log2("n")) >= least).where(F.col("word") != END) if least is not None else counts.limit(0)
    known = sorted(((bytes(r["word"]), r["c"]) for r in often.select("word", "c").collect()), key=lambda r: (-r[1], r[0]))
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    known = [(END, ends), *known]
    weight, types = np.zeros(OUTPUTS), np.zeros(OUTPUTS, np.int64)
    own = known[:WORDS]
    weight[: len(own)] = [c for _, c in own]
    by_ending = {bytes(r["ending"]): [r["c"], r["types"]] for r in counts.where("c > 0").groupBy(F.substring("word", -2, 2).alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()}  # two bytes: 65793 rows at most
    for word, c in own:
        if c:
            by_ending[word[-2:]][0] -= c
            by_ending[word[-2:]][1] -= 1
    best = sorted(by_ending, key=lambda e: (-by_ending[e][0], e))[:ENDINGS]
    codes = Codes([w for w, _ in known], {e: WORDS + i for i, e in enumerate(best)})
    for ending, (c, k) in by_ending.items():
        weight[codes.output(ending)] += c
        types[codes.output(ending)] += k
    output = np.array([i if i < len(own) else codes.output(w) for i, (w, _) in enumerate(known)], np.int64)
    return Vocabulary(codes, output, np.array([c for _, c in known], np.int64), weight, types, n, v)


@dataclass
class Network:
    """Vectors of inputs and outputs, weights of the places before a token, and what each output has by itself."""

    r: np.ndarray
    q: np.ndarray
    place: np.ndarray
    b: np.ndarray
    seen: int = field(default=0)

    @staticmethod
    def new(weight: np.ndarray) -> Network:
        rng = np.random.default_rng(12)
        noise = noise_of(weight)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return Network(small(OUTPUTS + 1, WIDTH), small(OUTPUTS, WIDTH), np.ones((CONTEXT, WIDTH), np.float32), np.log(noise).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.place, self.b]

    def packed(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64).tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> Network:
        flat = np.frombuffer(raw, np.float64).astype(np.float32)
        shapes = [(OUTPUTS + 1, WIDTH), (OUTPUTS, WIDTH), (CONTEXT, WIDTH), (OUTPUTS,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return Network(*(x.reshape(s).copy() for x, s in zip(np.split(flat, ends[:-1]), shapes)))

    def predicted(self, context: np.ndarray) -> np.ndarray:
        return sum(self.r[c] * p for c, p in zip(context, self.place))

    def log_sums(self, context: np.ndarray) -> np.ndarray:
        """Natural logarithms of what normalises each context over all outputs, by one matrix product for many contexts; sums that overflow are taken again below their largest part."""
        found, one = np.empty(context.shape[1]), np.ones(OUTPUTS, np.float32)
        q = np.ascontiguousarray(np.column_stack([self.q, self.b]).T)
        for lo in range(0, len(found), 512):
            some = slice(lo, lo + 512)
            h = self.predicted(context[:, some])
            s = np.column_stack([h, np.ones(len(h), np.float32)]) @ q
            with np.errstate(over="ignore"):
                z = np.exp(s, out=s) @ one
            if np.isfinite(z).all() and z.all():
                found[some] = np.log(z)
            else:
                s = h.astype(np.float64) @ self.q.T + self.b
                top = s.max(1, keepdims=True)
                found[some] = top[:, 0] + np.log(np.exp(s - top).sum(1))
        return found

    def log_probabilities(self, context: np.ndarray, output: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all outputs."""
        own = (self.predicted(context).astype(np.float64) * self.q[output]).sum(1) + self.b[output]
        return own - self.log_sums(context)


@dataclass
class Table:
    """A network's log probabilities as sums of few numbers a token: what each place before it gives each output, and what normalises each context.

    There are (OUTPUTS + 1) ** CONTEXT contexts, so each is normalised once for all tokens that follow it.
    """

    given: np.ndarray  # place, input, output; what an output has by itself goes with the nearest place
    sums: np.ndarray

    @staticmethod
    def of(net: Network) -> Table:
        given = np.stack([(net.r * p).astype(np.float64) @ net.q.T for p in net.place])
        given[0] += net.b
        every = np.arange((OUTPUTS + 1) ** CONTEXT)
        return Table(given, net.log_sums(np.stack(np.unravel_index(every, (OUTPUTS + 1,) * CONTEXT))))

    def log_probabilities(self, context: np.ndarray, output: np.ndarray) -> np.ndarray:
        return sum(g[c, output] for g, c in zip(self.given, context)) - self.sums[np.ravel_multi_index(tuple(context), (OUTPUTS + 1,) * CONTEXT)]


def noise_of(weight: np.ndarray) -> np.ndarray:
    """The distribution of noise: how often each output occurs, and a little for those that do not."""
    return (weight + 0.5) / (weight + 0.5).sum()


def contexts(output: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The outputs of the CONTEXT tokens before each token, nearest first; OUTPUTS stands for what lies before a text."""
    within = ragged(np.zeros(len(sizes), np.int64), sizes)
    found = np.full((CONTEXT, len(output)), OUTPUTS, np.int64)
    for j in range(1, CONTEXT + 1):
        found[j - 1, j:] = np.where(within[j:] >= j, output[:-j], OUTPUTS)
    return found


def _scattered(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by their places."""
    cells = at[:, None] * WIDTH + np.arange(WIDTH)
    return np.bincount(cells.ravel(), rows.ravel(), size * WIDTH).reshape(size, WIDTH).astype(np.float32)


def gradients(net: Network, context: np.ndarray, output: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> list[np.ndarray]:
    """Of the mean noise-contrastive loss: data against SHARE noise outputs a token, which the outputs `noise` stand for."""
    h = sum((net.r * p).take(c, 0) for c, p in zip(context, net.place))
    own, against = net.q.take(output, 0), net.q[noise]
    shift, each = np.float32(np.log(SHARE)), np.float32(SHARE / len(noise))
    # Of data: -log of its odds against the noise; of noise: -log of the odds against it.
    data = np.einsum("ij,ij->i", h, own) + (net.b - log_noise)[output] - shift
    other = h @ against.T + (net.b[noise] - log_noise[noise] - shift)
    g = (1 / (1 + np.exp(np.minimum(data, 60)))) / -np.float32(len(output))
    gn = each / (1 + np.exp(np.minimum(-other, 60))) / np.float32(len(output))
    dh = g[:, None] * own + gn @ against
    dq = _scattered(g[:, None] * h, output, OUTPUTS)
    np.add.at(dq, noise, gn.T @ h)
    db = np.bincount(output, g, OUTPUTS) + np.bincount(noise, gn.sum(0), OUTPUTS)
    # What each place passes back to each input, from which the gradients of inputs and of places follow.
    back = [_scattered(dh, c, OUTPUTS + 1) for c in context]
    return [sum(x * p for x, p in zip(back, net.place)), dq, np.stack([(net.r * x).sum(0) for x in back]), db.astype(np.float32)]


class Trainer:
    """Stochastic gradients, each parameter with a rate of its own that falls with its gradients so far."""

    def __init__(self, net: Network, weight: np.ndarray):
        self.net, self.noise = net, noise_of(weight)
        self.log_noise, self.ends = np.log(self.noise).astype(np.float32), np.cumsum(self.noise)
        self.past = [np.full_like(p, 1e-6) for p in net.parts()]
        self.rng = np.random.default_rng(12)

    def learn(self, context: np.ndarray, output: np.ndarray) -> None:
        for lo in range(0, len(output), BATCH):
            some = slice(lo, lo + BATCH)
            noise = np.minimum(np.searchsorted(self.ends, self.rng.random(NOISE)), OUTPUTS - 1)
            for p, past, g in zip(self.net.parts(), self.past, gradients(self.net, context[:, some], output[some], noise, self.log_noise)):
                past += g * g
                p -= np.float32(RATE) * g / np.sqrt(past)
        self.net.seen += len(output)


def _gathered(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[tuple[list[dict], list[np.ndarray], list[Counter]]]:
    """Rows, their codes and their rare words, by about TOKENS tokens."""
    rows, codes, rare, total = [], [], [], 0
    for batch in batches:
        others = batch.drop_columns(["text"]).to_pylist()
        for row, raw in zip(others, batch.column("text")):
            c, r = words.of(raw.as_py() or b"")
            rows.append(row), codes.append(c), rare.append(r)
            total += len(c)
            if total >= TOKENS:
                yield rows, codes, rare
                rows, codes, rare, total = [], [], [], 0
    if rows:
        yield rows, codes, rare


def _trained(words, net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(Network.unpacked(net.value), words.value.weight)
        for _, codes, _ in _gathered(batches, words.value):
            output = words.value.outputs(np.concatenate(codes))
            trainer.learn(contexts(output, np.array([len(c) for c in codes])), output)
        if trainer.net.seen:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "seen": trainer.net.seen, "p": trainer.net.packed()}])

    return run


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    weight = pdf["seen"].to_numpy(np.float64)
    total = sum(w * np.frombuffer(p, np.float64) for w, p in zip(weight, pdf["p"]))
    return pd.DataFrame({"part": [int(pdf["part"].min()) // MEAN], "seen": [int(weight.sum())], "p": [(total / weight.sum()).tobytes()]})


def fit(documents: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rounds: tuple[int, ...] = ROUNDS) -> Network:
    """The network after passes over training documents, see ROUNDS. Parameters are averaged in groups of MEAN tasks until MEAN are left."""
    context = documents.sparkSession.sparkContext
    net, shared = Network.new(words.weight).packed(), context.broadcast(words)
    rows = documents.where(~held_out(id_col)).select(F.col(text_col).cast("string").cast("binary").alias("text"))
    parts = rows.rdd.getNumPartitions()
    for every in rounds:
        found, left = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(_trained(shared, context.broadcast(net)), "part long, seen long, p binary"), parts
        while left > MEAN:
            found = found.groupBy(F.floor(F.col("part") / MEAN).alias("group")).applyInPandas(_mean, "part long, seen long, p binary")
            left = -(-left // MEAN)
        last = found.collect()
        if not last:
            continue
        net = bytes(_mean(pd.DataFrame([r.asDict() for r in last]))["p"][0])
    return Network.unpacked(net)


def _scored(words, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, network = words.value, table.value
        number = TaskContext.get().partitionId() << 33
        log_count, log_all = np.log10(known.count + 1.0), np.log10(known.n + known.v + 1.0)
        share = np.where(np.arange(OUTPUTS) < WORDS, 0.0, np.log10(known.weight + known.types + 1))
        for rows, codes, rare in _gathered(batches, known):
            sizes, flat = np.array([len(c) for c in codes]), np.concatenate(codes)
            output, starts = known.outputs(flat), np.cumsum(sizes) - sizes
            counted = np.where(flat >= 0, log_count[np.maximum(flat, 0)], 0.0)
            model = network.log_probabilities(contexts(output, sizes), output) / np.log(10) - share[output] + np.where(output < WORDS, 0.0, counted)
            base, score = np.add.reduceat(counted - log_all, starts), np.add.reduceat(model, starts)
            seen = np.add.reduceat((flat >= 0) & (known.count[np.maximum(flat, 0)] > 0), starts, dtype=np.int64)
            out = [r | {"row": number + i, "n_tokens": int(n), "n_known": int(k), "base": float(x), "model": float(s), "rare": [*m], "times": [*m.values()]} for i, (r, n, k, x, s, m) in enumerate(zip(rows, sizes, seen, base, score, rare))]
            number += len(rows)
            yield pa.RecordBatch.from_pylist(out, _SCORED)

    return run


_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, in decimal logarithms.

    Null and empty texts are their end alone. Rows are scored one by one: repeated rows and ids stay as they are; a row
    without an id is learnt from and is scored. Without training documents every word is one never seen. Base: each
    word's (c + 1) / (N + V + 1) over words and ends of training documents. Other columns are not looked at.

    Counts of at most KNOWN frequent words go to all tasks; those of rarer ones are joined, and what they add to the
    score, log10(c + 1), is the same for model and base.
    """
    rows = documents.select(F.col(text_col).cast("string").cast("binary").alias("text"), held_out(id_col).alias("held_out"))
    counts = written(rows.mapInArrow(_counts, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    words = vocabulary(counts)
    context = documents.sparkSession.sparkContext
    net = fit(documents, words, id_col, text_col)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    scored = written(rows.mapInArrow(_scored(context.broadcast(words), context.broadcast(Table.of(net))), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>, times array<long>"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    more = rare.join(counts.where("c > 0").select("word", "c"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("found"))
    whole, none = scored.drop("rare", "times").join(more, "row", "left"), F.lit(0)
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", none)).alias("n_known"), F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none)).alias("base_score"), (F.col("model") + F.coalesce("more", none)).alias("score"),
    )
