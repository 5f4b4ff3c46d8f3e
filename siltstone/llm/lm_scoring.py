"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class of word | context) * P(word | class, context).

* Classes come from the corpus: words that make up at least 1/1024 of it stand
  for themselves, all others are pooled by their ending; the pooled units are
  clustered by the units that precede and follow them.
* P(class | context) is a softmax over the sum of the weights of hashed
  features: the unit before, the unit before that (a skip), and the pair of
  both. It is trained by distributed gradient updates in `ROUNDS` rounds: every
  partition runs adaptive minibatch steps over all its training tokens from the
  shared weights, and each weight takes the mean of the partitions' updates,
  weighted by the tokens that touched its feature.
* P(word | class, context) has a bias feature for each word, in closed form from
  the training counts (half a count for an unseen word in each class), and a
  hashed bigram feature for each pair of words that the training documents hold
  at least twice. A token has one bigram feature at most, so the weights that
  meet the discounted counts have a closed form too: one update, grouped by
  context, reaches the optimum. What a context's bigrams leave over goes to all
  other words of the class in proportion to their biases.

The tables of words and bigrams grow with the corpus and stay distributed:
tokens are sent to the range of their context, met with its features there, and
sums come back by document. Words with at least 1/2**22 of the tokens, and
bigrams and contexts with at least 1/2**20, are sent to the tasks instead, so no
range depends on how frequent one of them is.

Defined cases: null text = empty text (one end token); a null id is scored and
never trained on; repeated rows count and are scored as often as they occur;
an empty table gives an empty result; without training rows every word is
unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import changes, grow, ranges, shrink
from siltstone.llm._store import discard, read_table, settle
from siltstone.llm._text import LOWER, Words, chunks, crc_remainder, mix, prefix_hash, span_hash

HEAD_SHARE, OWN_SHARE, ENDINGS, CLASSES = 1 << 22, 1024, 256, 16
SLOTS = 1 << 14
KINDS = 3
BATCH, RATE, ROUNDS = 16_384, 0.4, 2
HOT_SHARE, DISCOUNT, BLOCK_TOKENS, COUNT_TOKENS = 1 << 20, 0.75, 1_500_000, 4_000_000
END, BOS = 0, 1  # units; the end token's word key is 0
FLUSH_TOKENS = 2_000_000
SLICES = 32


def _numbers(batch, column: str):
    return crc_remainder(batch.column(column).to_pylist())


class Tokens:
    """The tokens of a chunk, an end token after each document's words."""

    def __init__(self, chunk):
        low = LOWER[chunk.data]
        words = Words(chunk)
        n = len(chunk)
        self.counts = words.counts() + 1
        self.docs = np.repeat(np.arange(n), self.counts)
        at = np.arange(len(words)) + words.docs()
        self.key = np.zeros(len(words) + n, dtype=np.int64)
        self.key[at] = span_hash(prefix_hash(low), words.start, words.end).view(np.int64)
        self.ending = np.zeros(len(words) + n, dtype=np.int16)
        size = words.end - words.start
        last = [np.where(size > i, low[np.maximum(words.end - 1 - i, 0)], 0).astype(np.uint64) for i in range(3)]
        self.ending[at] = (mix(last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)) % np.uint64(ENDINGS)).astype(np.int16)
        self.is_end = np.ones(len(self.key), dtype=bool)
        self.is_end[at] = False


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush():
        key, ending = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        word, first, n = np.unique(key, return_index=True, return_counts=True)
        held.clear()
        return pa.record_batch([pa.array(word), pa.array(ending[first]), pa.array(n.astype(np.int64))], names=["key", "ending", "n"])

    for batch in batches:
        remainder = _numbers(batch, "doc_id")
        for chunk in chunks(batch.column("text")):
            tokens = Tokens(chunk)
            part = remainder[chunk.lo : chunk.hi][tokens.docs]
            mine = (part != 1) & (part >= 0)
            held.append((tokens.key[mine], tokens.ending[mine]))
            size += int(mine.sum())
            if size >= FLUSH_TOKENS:
                yield flush()
                size = 0
    if held:
        yield flush()


class Lexicon:
    """Words with units of their own, and the frequent words' counts. Bounded by the shares above."""

    def __init__(self, own: np.ndarray, head: np.ndarray, head_counts: np.ndarray):
        self.own, self.head, self.head_counts = own, head, head_counts
        self.size = 2 + ENDINGS + len(own)

    def units(self, tokens: Tokens) -> np.ndarray:
        out = tokens.ending.astype(np.int32) + 2
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, tokens.key), len(self.own) - 1)
            out = np.where(self.own[at] == tokens.key, 2 + ENDINGS + at, out).astype(np.int32)
        out[tokens.is_end] = END
        return out

    def counts(self, key: np.ndarray) -> np.ndarray:
        """Training counts of frequent words, -1 for others."""
        if not len(self.head):
            return np.full(len(key), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.head, key), len(self.head) - 1)
        return np.where(self.head[at] == key, self.head_counts[at], -1)


def contexts(tokens: Tokens, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that, BOS before a document's start."""
    place = np.arange(len(units)) - np.repeat(np.cumsum(tokens.counts) - tokens.counts, tokens.counts)
    one, two = np.full(len(units), BOS, dtype=np.int32), np.full(len(units), BOS, dtype=np.int32)
    one[1:], two[2:] = units[:-1], units[:-2]
    one[place < 1] = BOS
    two[place < 2] = BOS
    return one, two


def features(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Hashed slots of the n-gram and skip features."""
    a, b = one.astype(np.uint64), two.astype(np.uint64)
    keys = (a * np.uint64(3), b * np.uint64(3) + np.uint64(1), (a << np.uint64(24) | b) * np.uint64(3) + np.uint64(2))
    return [(mix(k + np.uint64(0x9E37)) % np.uint64(SLOTS)).astype(np.int16) for k in keys]


def log_softmax(weights: np.ndarray, bias: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    z = weights[0][slots[0]]
    for k in range(1, KINDS):
        z += weights[k][slots[k]]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _slices(values: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(values.reshape(-1), SLICES)
    return pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([p.astype(np.float64).tobytes() for p in parts], pa.binary())], names=["slice", "part"])


SLICE = "slice int, part binary"


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(part.as_py(), dtype=np.float64) for part in table.column("part"))
    return pa.table({"slice": table.column("slice").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def add_up(rows: DataFrame, size: int, tasks: int) -> np.ndarray:
    """The sum of all tasks' arrays, in two steps, each of which adds up about the square root of the tasks' number."""
    groups = max(1, int(tasks**0.5))
    some = rows.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups))).groupBy("slice", "group").applyInArrow(_add, SLICE)
    found = sorted(some.groupBy("slice").applyInArrow(_add, SLICE).collect(), key=lambda r: r.slice)
    return np.concatenate([np.frombuffer(bytes(r.part), dtype=np.float64) for r in found]) if found else np.zeros(size)


def _follow(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        total = np.zeros(lex.size * lex.size, dtype=np.int64)
        seen = 0
        for batch in batches:
            remainder = _numbers(batch, "doc_id")
            for chunk in chunks(batch.column("text")):
                tokens = Tokens(chunk)
                part = remainder[chunk.lo : chunk.hi][tokens.docs]
                mine = (part != 1) & (part >= 0)
                units = lex.units(tokens)
                one, _ = contexts(tokens, units)
                total += np.bincount(one[mine].astype(np.int64) * lex.size + units[mine], minlength=len(total))
                seen += int(mine.sum())
        if seen:
            yield _slices(total)

    return run


def cluster(table: np.ndarray, classes: int = CLASSES, rounds: int = 20) -> np.ndarray:
    """A class for each unit: k-means on the square roots of what precedes and follows it; the end token has class 0."""
    n = table.sum(axis=0)
    after = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
    before = (table / np.maximum(n, 1)).T
    x = np.sqrt(np.concatenate((after, before), axis=1)).astype(np.float32)
    centre = [int(np.argmax(n[2:]) + 2)]
    nearest = ((x - x[centre[0]]) ** 2).sum(axis=1)
    for _ in range(min(classes - 1, len(x) - 2) - 1):
        centre.append(int(np.argmax(np.where(np.arange(len(x)) > 1, nearest * n, -1))))
        nearest = np.minimum(nearest, ((x - x[centre[-1]]) ** 2).sum(axis=1))
    middle = x[centre]
    for _ in range(rounds):
        kind = np.argmin((middle**2).sum(axis=1)[None, :] - 2 * x @ middle.T, axis=1)
        for c in range(len(middle)):
            if (weight := n * (kind == c)).sum() > 0:
                middle[c] = (weight @ x) / weight.sum()
    out = kind + 1
    out[END], out[BOS] = 0, 0
    return out.astype(np.int16)


def _train(lexicon, kinds, start):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, kind = lexicon.value, kinds.value
        first, bias0 = start.value
        weights, bias = first.copy(), bias0.copy()
        squares, bias_squares = np.full_like(weights, 1e-4), np.full_like(bias, 1e-4)
        touched, seen = np.zeros((KINDS, SLOTS)), 0
        for batch in batches:
            remainder = _numbers(batch, "doc_id")
            for chunk in chunks(batch.column("text")):
                tokens = Tokens(chunk)
                part = remainder[chunk.lo : chunk.hi][tokens.docs]
                mine = np.flatnonzero((part != 1) & (part >= 0))
                units = lex.units(tokens)
                one, two = contexts(tokens, units)
                slots, target = features(one[mine], two[mine]), kind[units[mine]]
                for at in range(0, len(mine), BATCH):
                    here = [s[at : at + BATCH] for s in slots]
                    y = target[at : at + BATCH]
                    g = np.exp(log_softmax(weights, bias, here))
                    g[np.arange(len(y)), y] -= 1
                    for k in range(KINDS):
                        order = np.argsort(here[k], kind="stable")
                        s = here[k][order]
                        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                        step = np.add.reduceat(g[order], head, axis=0) / BATCH
                        row = s[head]
                        touched[k][row] += np.diff(np.append(head, len(s)))
                        squares[k][row] += step * step
                        weights[k][row] -= RATE * step / np.sqrt(squares[k][row])
                    step = g.sum(axis=0) / BATCH
                    bias_squares += step * step
                    bias -= RATE * step / np.sqrt(bias_squares)
                seen += len(mine)
        if seen:
            yield _slices(np.concatenate((((weights - first) * touched[:, :, None]).reshape(-1), (bias - bias0) * seen, touched.reshape(-1), [seen])))

    return run


class Model:
    """What scoring needs; its size does not depend on the corpus beyond the lexicon's bound."""

    def __init__(self, lexicon: Lexicon, kinds: np.ndarray, weights: np.ndarray, bias: np.ndarray, total: int, types: int, class_mass: np.ndarray):
        self.lexicon, self.kinds, self.weights, self.bias = lexicon, kinds, weights, bias
        self.total, self.types, self.class_mass = total, types, class_mass


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the settled counts of all training words (key, ending, n) and the settled bigram features."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = settle(texts.mapInArrow(_count, "key long, ending short, n long").groupBy("key").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "counts")
    row = counts.agg(F.sum("n").alias("total"), F.count("*").alias("types")).first()
    total, types = row.total or 0, row.types
    head = counts.filter(F.col("n") * HEAD_SHARE >= total).select("key", "n").toArrow()
    key, n = head.column("key").to_numpy(), head.column("n").to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    own = key[(n * OWN_SHARE >= total) & (key != 0)]
    lexicon = Lexicon(own, key, n)
    lex = spark.sparkContext.broadcast(lexicon)

    tasks = texts.rdd.getNumPartitions()
    table = add_up(texts.mapInArrow(_follow(lex), SLICE), lexicon.size**2, tasks)
    kinds = cluster(table.reshape(lexicon.size, lexicon.size))
    by_ending = {r.ending: (r.n, r.types) for r in counts.filter("key <> 0").groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}
    own_rows = {r.key: r for r in counts.filter((F.col("n") * OWN_SHARE >= total) & (F.col("key") != 0)).collect()}
    mass, kinds_of = np.zeros(CLASSES), np.zeros(CLASSES)
    left = {e: list(v) for e, v in by_ending.items()}
    for i, k in enumerate(own.tolist()):
        r = own_rows[k]
        left[r.ending][0] -= r.n
        left[r.ending][1] -= 1
        mass[kinds[2 + ENDINGS + i]] += r.n
        kinds_of[kinds[2 + ENDINGS + i]] += 1
    for e, (m, t) in left.items():
        mass[kinds[2 + e]] += m
        kinds_of[kinds[2 + e]] += t
    ends = total - int(mass.sum())
    mass[0] += ends
    kinds_of[0] += 1 if ends else 0

    weights, bias = np.zeros((KINDS, SLOTS, CLASSES), dtype=np.float32), np.log((mass + 1) / (mass.sum() + CLASSES)).astype(np.float32)
    shared = spark.sparkContext.broadcast(kinds)
    for _ in range(ROUNDS):
        start = spark.sparkContext.broadcast((weights, bias))
        found = add_up(texts.mapInArrow(_train(lex, shared, start), SLICE), weights.size + CLASSES + KINDS * SLOTS + 1, tasks)
        step, bias_step, touched, seen = np.split(found, np.cumsum((weights.size, CLASSES, KINDS * SLOTS)))
        weights = (weights + step.reshape(weights.shape) / np.maximum(touched, 1).reshape(KINDS, SLOTS, 1)).astype(np.float32)
        bias = (bias + bias_step / max(seen[0], 1)).astype(np.float32)
    model = Model(lexicon, kinds, weights, bias, total, types, np.log10(mass + 0.5 * (kinds_of + 1)))
    return model, counts, bigrams(texts, counts, model)


START = 0x5EED


def context_id(before: np.ndarray) -> np.ndarray:
    """28 bits of the word before."""
    return mix(before + np.uint64(0xB16)) >> np.uint64(36)


def bigram_keys(tokens: Tokens, kinds: np.ndarray) -> np.ndarray:
    """The hashed bigram feature of each token: 28 bits of its context, 4 of its class, 32 of its word; 0 for end tokens."""
    before = np.zeros(len(tokens.key), dtype=np.uint64)
    before[1:] = tokens.key[:-1].view(np.uint64)
    before[np.cumsum(tokens.counts) - tokens.counts] = START
    key = context_id(before) << np.uint64(36) | kinds.astype(np.uint64) << np.uint64(32) | tokens.key.view(np.uint64) & np.uint64(0xFFFFFFFF)
    key[tokens.is_end] = 0
    return key.view(np.int64)


COUNTED = "range int, often boolean, keys binary, counts binary"


def _bigram_counts(model, count: int):
    """Each distinct bigram of some million training tokens to the range of its context; those of words with units of their own, as one context may be in every text, to ranges of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        often = np.unique(context_id(np.append(m.lexicon.own.view(np.uint64), np.uint64(START)))).astype(np.int64)
        held: list[np.ndarray] = []

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            is_often = np.isin(key >> 36 & 0xFFFFFFF, often)
            place = _place(key, is_often, count)
            order = np.lexsort((is_often, place))  # keys stay in order
            key, n, is_often, place = key[order], n[order], is_often[order], place[order]
            cut = changes(place, is_often).tolist()
            out = [(int(place[lo]), bool(is_often[lo]), key[lo:hi].tobytes(), shrink(n[lo:hi])) for lo, hi in zip(cut, [*cut, len(key)][1:], strict=True)]
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["range", "often", "keys", "counts"])

        for batch in batches:
            remainder = _numbers(batch, "doc_id")
            for chunk in chunks(batch.column("text")):
                tokens = Tokens(chunk)
                part = remainder[chunk.lo : chunk.hi][tokens.docs]
                held.append(bigram_keys(tokens, m.kinds[m.lexicon.units(tokens)])[(part != 1) & (part >= 0) & ~tokens.is_end])
                if sum(map(len, held)) >= COUNT_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return run


def _add_bigrams(table: pa.Table) -> pa.Table:
    """(key, context, n) of a range: bigrams that occur twice, and their contexts' counts; of a frequent word's contexts a part of the count."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]]
    for often in (False, True):
        rows = table.filter(pc.equal(table.column("often"), often)).to_pylist()
        if not rows:
            continue
        key, n = np.concatenate([np.frombuffer(x["keys"], dtype=np.int64) for x in rows]), np.concatenate([grow(x["counts"]) for x in rows])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        start = changes(key)
        key, n = key[start], np.add.reduceat(n, start)
        first = changes(key >> 32)
        twice = n > 1
        context = np.add.reduceat(n, first)
        wanted = np.ones(len(first), dtype=bool) if often else np.add.reduceat(twice.astype(np.int64), first) > 0
        for column, values in zip(out, ((key[twice], (key >> 32)[first][wanted]), (np.zeros(int(twice.sum()), bool), np.ones(int(wanted.sum()), bool)), (n[twice], context[wanted])), strict=True):
            column += values
    return pa.table([pa.array(np.concatenate(c)) for c in out], names=["key", "context", "n"])


def bigrams(texts: DataFrame, counts: DataFrame, model: "Model") -> DataFrame:
    """Settled (key, context, n, value): for a bigram what it adds to its word's log10 probability, for a context what it adds to other words'."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    count = ranges(model.total, texts.sparkSession)
    sent = texts.mapInArrow(_bigram_counts(shared, count), COUNTED)
    seen = settle(sent.groupBy("range").applyInArrow(_add_bigrams, "key long, context boolean, n long"), "bigram-counts")
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    words = counts.filter("key <> 0").groupBy(low("key").alias("word")).agg(F.sum("n").alias("in_all"))
    mass = F.array(*[F.lit(float(x)) for x in model.class_mass])
    pairs = seen.filter(~F.col("context")).select("key", "n", F.shiftright("key", 32).alias("of"), low("key").alias("word")).join(words, "word")
    pairs = pairs.withColumn("bias", F.log10(F.col("in_all") + 0.5) - F.get(mass, F.col("of").bitwiseAND(F.lit(15)).cast("int")))
    pairs = pairs.join(seen.filter("context").groupBy(F.col("key").alias("of")).agg(F.sum("n").alias("of_n")), "of").withColumn("share", (F.col("n") - DISCOUNT) / F.col("of_n"))
    pairs = settle(pairs.select("key", "of", "n", "of_n", "bias", "share"), "bigram-shares")
    rest = pairs.groupBy("of").agg(F.first("of_n").alias("n"), F.log10((1 - F.sum("share")) / (1 - F.sum(F.pow(F.lit(10.0), "bias")))).alias("value"))
    out = settle(pairs.select("key", F.lit(False).alias("context"), "n", (F.log10("share") - F.col("bias")).alias("value")).unionByName(rest.select(F.col("of").alias("key"), F.lit(True).alias("context"), "n", "value")), "bigrams")
    discard(seen, pairs)
    return out


class Hot:
    """Features with at least 1/2**20 of the training tokens: at most 2**20 bigrams and as many contexts."""

    def __init__(self, table: pa.Table):
        self.sets = []
        for context in (False, True):
            mine = table.filter(pc.equal(table.column("context"), context)).sort_by("key")
            self.sets.append((mine.column("key").to_numpy(), mine.column("value").to_numpy()))

    def find(self, keys: np.ndarray, context: bool) -> tuple[np.ndarray, np.ndarray]:
        return _look_up(*self.sets[context], keys)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], 0.0)


def _place(key: np.ndarray, hot_context: np.ndarray, count: int) -> np.ndarray:
    """The range of a bigram: that of its context, or its own if the context is frequent."""
    return (mix(np.where(hot_context, key, key >> 32).view(np.uint64)) % np.uint64(count)).astype(np.int32)


SENT = "range int, block long, keys binary, doc binary, size binary, ids binary"
SUMS = "block long, doc binary, sums binary"


def _send(model, hot, count: int):
    """Each token's bigram to its range; what frequent features add is summed here and comes along with the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, frequent = model.value, hot.value
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        rows: list[np.ndarray] = []
        tokens_held = docs_held = 0

        def flush():
            nonlocal block, tokens_held, docs_held
            key, doc = (np.concatenate([h[i] for h in held]) for i in range(2))
            ids = np.concatenate(rows)
            is_hot, value = frequent.find(key, False)
            of_hot, rest = frequent.find(key >> 32, True)
            own = np.bincount(doc, weights=np.where(is_hot, value, np.where(of_hot, rest, 0.0)), minlength=len(ids))
            key, doc, of_hot = key[~is_hot], doc[~is_hot], of_hot[~is_hot]
            place = _place(key, of_hot, count)
            order = np.lexsort((doc, place))
            key, doc, place = key[order], doc[order], place[order]
            starts = changes(place, doc)
            size, cut, out = np.diff(np.append(starts, len(key))), changes(place[starts]).tolist(), []
            for a, b in zip(cut, [*cut, len(starts)][1:], strict=True):
                lo, hi = starts[a], starts[b] if b < len(starts) else len(key)
                out.append((int(place[lo]), block, key[lo:hi].tobytes(), shrink(np.diff(doc[starts[a:b]], prepend=0)), shrink(size[a:b]), None))
            out.append((block % count, block, b"", shrink(np.zeros(0, np.int64)), shrink(np.zeros(0, np.int64)), np.stack((ids, own.view(np.int64))).tobytes()))
            held.clear()
            rows.clear()
            tokens_held = docs_held = 0
            block += 1
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])

        for batch in batches:
            row = batch.column("row").to_numpy()
            for chunk in chunks(batch.column("text")):
                tokens = Tokens(chunk)
                words = ~tokens.is_end
                held.append((bigram_keys(tokens, m.kinds[m.lexicon.units(tokens)])[words], tokens.docs[words] + docs_held))
                rows.append(row[chunk.lo : chunk.hi])
                docs_held += len(chunk)
                tokens_held += len(tokens.key)
                if tokens_held >= BLOCK_TOKENS:
                    yield flush()
        if rows:
            yield flush()

    return run


def _to_ranges(hot, count: int):
    """The features that are not frequent, at their ranges; a bigram of a frequent context without what the sender has added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value
        for batch in batches:
            key, context, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "context", "value"))
            of = np.where(context, key, key >> 32)
            of_hot, rest = frequent.find(of, True)
            keep = ~np.where(context, of_hot, frequent.find(key, False)[0])
            place = _place(np.where(context, key << 32, key), of_hot & ~context, count)
            yield pa.record_batch([pa.array(x[keep]) for x in (place, key, context, value - np.where(context, 0.0, rest))], names=["range", "key", "context", "value"])

    return run


def _meet(sent: pa.Table, features_: pa.Table) -> pa.Table:
    """The tokens of a range meet its features; sums by block and document."""
    sets = []
    for context in (False, True):
        mine = features_.filter(pc.equal(features_.column("context"), context)).sort_by("key")
        sets.append((mine.column("key").to_numpy(), mine.column("value").to_numpy()))
    out = []
    for row in sent.to_pylist():
        if row["ids"] is not None:
            out.append((row["block"], None, row["ids"]))
        key = np.frombuffer(row["keys"], dtype=np.int64)
        if not len(key):
            continue
        found, value = _look_up(*sets[0], key)
        _, rest = _look_up(*sets[1], key >> 32)
        start = np.cumsum(grow(row["size"])) - grow(row["size"])
        out.append((row["block"], row["doc"], np.add.reduceat(np.where(found, value, rest), start).astype(np.float32).tobytes()))
    kinds = (pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], names=["block", "doc", "sums"])


def _per_row(table: pa.Table) -> pa.Table:
    ids = total = None
    parts = []
    for row in table.to_pylist():
        if row["doc"] is None:
            ids, own = np.frombuffer(row["sums"], dtype=np.int64).reshape(2, -1)
            total = own.view(np.float64).copy()
        else:
            parts.append((np.cumsum(grow(row["doc"])), np.frombuffer(row["sums"], dtype=np.float32)))
    for doc, sums in parts:
        total[doc] += sums
    return pa.table({"row": pa.array(ids), "bigrams": pa.array(total)})


def bigram_sums(texts: DataFrame, model, table: DataFrame, tokens: int, total: int) -> DataFrame:
    """(row, bigrams): what the bigram features add to each document's score."""
    spark = texts.sparkSession
    frequent = Hot(table.filter(F.col("n") * HOT_SHARE >= total).select("context", "key", "value").toArrow())
    hot, count = spark.sparkContext.broadcast(frequent), ranges(tokens, spark)
    sent = texts.mapInArrow(_send(model, hot, count), SENT)
    at_range = table.select("key", "context", "value").mapInArrow(_to_ranges(hot, count), "range int, key long, context boolean, value double")
    sums = settle(sent.groupBy("range").cogroup(at_range.groupBy("range")).applyInArrow(_meet, SUMS), "bigram-sums")
    return sums.groupBy("block").applyInArrow(_per_row, "row long, bigrams double")


PARTS = "row long, doc_id long, held_out boolean, n_tokens long, known long, words double, classes double, key long, times long"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            remainder, ids, rows = _numbers(batch, "doc_id"), batch.column("doc_id"), batch.column("row").to_numpy()
            for chunk in chunks(batch.column("text")):
                n = len(chunk)
                tokens = Tokens(chunk)
                units = m.lexicon.units(tokens)
                slots, kind = features(*contexts(tokens, units)), m.kinds[units]
                chosen = np.empty(len(units))
                for at in range(0, len(units), BATCH):
                    p = log_softmax(m.weights, m.bias, [s[at : at + BATCH] for s in slots])
                    chosen[at : at + BATCH] = p[np.arange(len(p)), kind[at : at + BATCH]]
                value = chosen / np.log(10) - m.class_mass[kind]
                count = m.lexicon.counts(tokens.key)
                frequent = count >= 0
                add = lambda x, keep=slice(None): np.bincount(tokens.docs[keep], weights=x[keep], minlength=n)  # noqa: B023, E731
                words = add(np.log10(np.maximum(count, 0) + 0.5), frequent)
                known = np.bincount(tokens.docs[frequent], minlength=n)
                rare = ~frequent
                pair = np.stack([tokens.docs[rare], tokens.key[rare]], axis=1)
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[order]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(pair, axis=0) != 0).any(axis=1)))) if len(pair) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(pair)))
                r = rows[chunk.lo : chunk.hi]
                none = lambda k, t: pa.nulls(k, t)
                names = [x.split()[0] for x in PARTS.split(", ")]
                yield pa.record_batch([pa.array(r), ids.slice(chunk.lo, n), pa.array(remainder[chunk.lo : chunk.hi] == 1), pa.array(tokens.counts.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(words), pa.array(add(value)), none(n, pa.int64()), none(n, pa.int64())], names=names)
                if len(first):
                    k = len(first)
                    yield pa.record_batch([pa.array(r[pair[first, 0]]), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64()), pa.array(pair[first, 1]), pa.array(times.astype(np.int64))], names=names)

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, table: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = settle(texts.mapInArrow(_score(shared), PARTS), "scores")
    added = bigram_sums(texts, shared, table, parts.agg(F.sum("n_tokens")).first()[0] or 0, model.total)
    rare = parts.filter("key is not null").select("row", "key", "times").join(counts.select("key", "n"), "key", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(n + 0.5)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    rows = parts.filter("key is null").drop("key", "times").join(rare, "row", "left").join(added, "row", "left")
    words = F.col("words") + F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * float(np.log10(model.total + 0.5 * (model.types + 1)))).alias("base_score"), (words + F.col("classes") + F.coalesce("bigrams", F.lit(0.0))).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
