"""A maximum-entropy language model with hashed features and a class-factored softmax.

A token's probability is that of its class given the two words before it, times that of the token within its class
given the same two words. Both factors are softmaxes whose logits are sums of a log count and weight rows for the word
before, the word two before (a skip feature) and the pair of both, hashed into tables that grow with the square root of
the vocabulary; in the second factor they are hashed together with the class. Frequent words are classes of their own,
all others are classed by how they end.

The words of a class are too many for one softmax, so the second factor is a product down a tree: at each of its nodes
the most frequent words left are outcomes of their own, the others are dealt to `GROUPS` groups by their hash, which are
the nodes of the next level. The tree deepens with the vocabulary. Words that share one of its last groups divide the
group's probability by their counts.

Every task runs one pass of AdaGrad over its rows, with one rate for each row of the weights. The model's weights are
those of the tasks, each row averaged by how often the tasks met it, so that what few tasks saw counts in full however
many there are. Tokens are counted over the whole corpus, and rows meet the counts of their rarer words in a join: only
a fixed number of the most frequent words, the class sums and the weight tables are sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import id_and_text, slices, written

END = ""  # no word is empty
OWN_CLASS, SUFFIX_CLASSES = 15, 16
CLASSES = 1 + OWN_CLASS + SUFFIX_CLASSES  # a power of two, which `across` needs
OWN_WORDS, GROUPS = 24, 8  # outcomes of a node within a class, as many as classes
MOST_LEVELS, GROUP_WORDS = 6, 1 << 10
EMPTY = -30.0  # bias of an outcome that stands for no word
LEAST_PAST, MOST_PAST = 1 << 10, 1 << 18
BLOCKS = 64
RATE, FIRST_SQUARES, BATCH = 0.6, 0.1, 1 << 13
ONES, LEAST_SUM = np.ones(CLASSES, dtype=np.float32), 1e-30
LAYERS = 8  # so often a row's values are added one by one
LONG = 64  # bytes of a word
SLICE = 1 << 20  # bytes of text whose features a worker holds at a time
START_HASH = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """The tokens of a batch: `code` points into `words`; document k has the tokens from first[k] on, the end last."""

    words: pa.Array
    code: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(self.code))))


def tokens_of(texts: pa.Array) -> Tokens:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    words = pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)])
    counts = np.bincount(doc, minlength=len(texts)) + 1
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    code = np.full(int(counts.sum()), len(words) - 1, dtype=np.int64)
    inside = np.ones(len(code), dtype=bool)
    inside[first + counts - 1] = False
    code[inside] = coded.indices.to_numpy()
    return Tokens(words, code, first)


def classes_of(words: pa.Array, own: pa.Array) -> np.ndarray:
    """0 for the end, 1 on for the words of `own`, else by the last two bytes."""
    raw = words.cast(pa.binary())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, dtype=np.int64)
    data, length = np.frombuffer(data or b"", dtype=np.uint8), np.diff(offsets)
    ends = np.zeros((len(words), 2), dtype=np.int64)
    for k in (1, 2):
        has = length >= k
        ends[has, k - 1] = data[offsets[1:][has] - k]
    by_suffix = 1 + OWN_CLASS + ((ends[:, 0] * 257 + ends[:, 1]) * 40503 >> 4) % SUFFIX_CLASSES
    found = pc.fill_null(pc.index_in(words, value_set=own), -1).to_numpy()
    return np.where(length == 0, 0, np.where(found >= 0, found + 1, by_suffix))


def hashes_of(words: pa.Array) -> np.ndarray:
    """64 bits of each word, eight bytes at a time of all words at once; words of more than `LONG` bytes are hashed alone."""
    raw = words.cast(pa.large_binary())
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    base, length = ends[0], np.diff(ends)
    padded = np.concatenate([np.frombuffer(data or b"", dtype=np.uint8)[base : ends[-1]], np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))  # those that start at each byte
    found = length.astype(np.uint64) * START_HASH
    at = np.flatnonzero((length > 0) & (length <= LONG))
    for k in range(0, LONG, 8):
        left = length[at] - k
        part = eights[ends[at] - base + k]
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        found[at] = mixed(found[at] ^ part)
        at = at[left > 8]
        if not len(at):
            break
    for k in np.flatnonzero(length > LONG).tolist():
        found[k] = xxhash.xxh64_intdigest(raw[k].as_py())
    return mixed(found)


def mixed(bits: np.ndarray) -> np.ndarray:
    """Every bit depends on all bits; one to one."""
    bits = bits ^ bits >> np.uint64(32)
    bits *= np.uint64(0x9FB21C651E98DF25)
    bits ^= bits >> np.uint64(29)
    bits *= np.uint64(0xC2B2AE3D27D4EB4F)
    bits ^= bits >> np.uint64(32)
    return bits


def levels_of(n_words: int) -> int:
    """Levels of the tree, the classes being the first: its last groups hold `GROUP_WORDS` words on average at most."""
    levels = 2
    while levels < MOST_LEVELS and SUFFIX_CLASSES * GROUPS ** (levels - 1) * GROUP_WORDS < n_words:
        levels += 1
    return levels


@dataclass
class Tree:
    """What a word's outcomes are: a slot is CLASSES x node + outcome, the root being node 0."""

    levels: int
    own: pa.Array  # words with an outcome of their own, those of the root first
    level: np.ndarray  # of each
    outcome: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The first node of each level; behind them, the number of nodes."""
        return np.cumsum([0, 1, *(SUFFIX_CLASSES * GROUPS**k for k in range(self.levels - 1))])

    def slots(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """By level, the slot of each word there, or -1 below an outcome of its own."""
        found = pc.fill_null(pc.index_in(words, value_set=self.own), -1).to_numpy()
        level, outcome = np.append(self.level, self.levels)[found], np.append(self.outcome, 0)[found]
        classes = classes_of(words, self.own[:OWN_CLASS])
        slots = np.full((self.levels, len(words)), -1, dtype=np.int64)
        slots[0] = classes
        at = np.flatnonzero(classes > OWN_CLASS)
        within = classes[at] - 1 - OWN_CLASS  # number of the node in its level
        for k in range(1, self.levels):
            group = (hashes[at] >> np.uint64(3 * k) & np.uint64(GROUPS - 1)).astype(np.int64)
            here = (found[at] >= 0) & (level[at] == k)
            slots[k, at] = CLASSES * (self.first[k] + within) + np.where(here, outcome[at], OWN_WORDS + group)
            at, within = at[~here], (within * GROUPS + group)[~here]
        return slots


def tree_of(frequent: pa.Array, n_words: int) -> Tree:
    """`frequent` from the most frequent word down: each takes an outcome of its own as high up as one is free."""
    levels = levels_of(n_words)
    bare = Tree(levels, frequent[:OWN_CLASS], np.zeros(len(frequent[:OWN_CLASS]), dtype=np.int64), np.arange(1, 1 + len(frequent[:OWN_CLASS])))
    nodes = bare.slots(frequent, hashes_of(frequent)) // CLASSES
    taken: dict[int, int] = {}
    places = [(w, 0, 1 + w) for w in range(len(bare.own))]
    for w, path in enumerate(nodes.T[len(bare.own) :].tolist(), len(bare.own)):
        for k in range(1, levels):
            used = taken.get(path[k], 0)
            if used < OWN_WORDS:
                taken[path[k]] = used + 1
                places.append((w, k, used))
                break
    which, level, outcome = np.array(places, dtype=np.int64).reshape(-1, 3).T
    return Tree(levels, frequent.take(pa.array(which)), level, outcome)


def masses_of(tree: Tree, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By slot: the bias, and log10 of the counts plus one of the words that divide it by counts.

    `leaves` holds these sums without the one unknown word in each last group, which counts less in the biases: all
    unknown words of a class as much as one.
    """
    first, shape = tree.first, (int(tree.first[-1]), CLASSES)
    last = np.zeros(shape)
    last[first[-2] :, OWN_WORDS:] = 1
    log_mass = np.log10(np.maximum(leaves.reshape(shape) + last, 1))
    mass = leaves.reshape(shape) + last / GROUPS ** (tree.levels - 1)
    for k in range(tree.levels - 1, 0, -1):
        inner = mass[first[k] : first[k + 1]].sum(axis=1)
        if k == 1:
            mass[0, 1 + OWN_CLASS :] = inner
        else:
            mass[first[k - 1] : first[k], OWN_WORDS:] = inner.reshape(-1, GROUPS)
    with np.errstate(divide="ignore"):
        bias = np.maximum(np.log(mass / mass.sum(axis=1, keepdims=True)), EMPTY)
    return bias.astype(np.float32), log_mass.reshape(-1)


def past_rows(n_words: int, per_root: int = 8) -> int:
    """Rows for the word before, as many for the one two before, half of all are the pairs': a power of two, at least
    `per_root` times the root of the vocabulary. As many rows again are those within classes. The end of the range,
    256 MB of weights, stands for a billion words.
    """
    wanted = per_root * math.isqrt(max(n_words, 1))
    return min(max(1 << (wanted - 1).bit_length(), LEAST_PAST), MOST_PAST)


def contexts_of(tokens: Tokens, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes per token: the word before, the one two before, the pair."""
    by_token = hashes[tokens.code]
    one, two = np.empty_like(by_token), np.empty_like(by_token)
    one[1:], two[2:] = by_token[:-1], by_token[:-2]
    one[tokens.first] = START_HASH
    two[tokens.first] = START_HASH
    second = tokens.first + 1
    two[second[second < len(two)]] = START_HASH
    return one, two, (one * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (two >> np.uint64(3))


def rows_of(contexts: tuple[np.ndarray, np.ndarray, np.ndarray], past: int) -> np.ndarray:
    one, two, pair = contexts
    size = np.uint64(past)
    return np.stack([
        one % size, size + (two >> np.uint64(7)) % size, np.uint64(2 * past) + (pair >> np.uint64(11)) % np.uint64(2 * past),
    ]).astype(np.int64)


def features_of(tokens: Tokens, past: int) -> np.ndarray:
    """Three rows of the weight table per token: the word before, the one two before, the pair."""
    return rows_of(contexts_of(tokens, hashes_of(tokens.words)), past)


def inner_features(contexts: tuple[np.ndarray, np.ndarray, np.ndarray], slots: np.ndarray, code: np.ndarray, past: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token and level within its class: the token, its slot, and three rows of the table's second half."""
    at, met = [], []
    for level in slots[1:]:
        slot = level[code]
        inside = np.flatnonzero(slot >= 0)
        at.append(inside)
        met.append(slot[inside])
    at, met = np.concatenate(at), np.concatenate(met)
    salt = (met // CLASSES).astype(np.uint64) * START_HASH
    bits, rows = past.bit_length() - 1, np.empty((3, len(at)), dtype=np.int64)
    for k, (context, more) in enumerate(zip(contexts, (0, 0, 1), strict=True)):
        mixed = (context[at] ^ salt) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
        rows[k] = (mixed >> np.uint64(64 - bits - more)).astype(np.int64) + (4 + k) * past
    return at, met, rows


def across(combine: np.ufunc, values: np.ndarray) -> np.ndarray:
    """A column of each row's values combined, by halves: numpy's own reductions of short rows take several times as long."""
    while values.shape[1] > 1:
        half = values.shape[1] // 2
        values = combine(values[:, :half], values[:, half:])
    return values


def logits_of(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """By class, the largest of each row 0."""
    logits = weights.take(rows[0], axis=0)
    logits += weights.take(rows[1], axis=0)
    logits += weights.take(rows[2], axis=0)
    logits += bias
    logits -= across(np.maximum, logits)
    return logits


def bias_at(bias: np.ndarray, node: np.ndarray | None, at: int) -> np.ndarray:
    """The bias of a batch that starts at a place: that of its nodes, without any that of the root."""
    if node is None:
        return bias if bias.ndim == 1 else bias[0]
    return bias.take(node[at : at + BATCH], axis=0)


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = logits_of(weights, bias, rows)
    logits -= np.log(across(np.add, np.exp(logits)))
    return logits


def sums_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, how often each stands in `rows`, and the sums of the values that stand with it.

    `rows` may hold several runs as long as `values`, which then stand with each of them.
    """
    n = len(rows)
    bits = max(n - 1, 1).bit_length()
    packed = rows << bits
    packed |= np.arange(n)
    packed.sort()  # by row and place; sorting numbers is faster than sorting places by their numbers
    ordered, order = packed >> bits, (packed & ((1 << bits) - 1)) % max(len(values), 1)
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    times = np.diff(np.append(start, n))
    sums = values.take(order[start], axis=0)
    several = np.flatnonzero(times > 1)  # most rows stand there once and need no sum
    if len(several):
        several = several[np.argsort(-times[several], kind="stable")]
        begin, left = start[several], times[several]
        own = sums.take(several, axis=0)
        for k in range(1, LAYERS):
            m = int(np.searchsorted(-left, -k, side="left"))  # the k-th next of all rows that have one
            if not m:
                break
            own[:m] += values.take(order[begin[:m] + k], axis=0)
        m = int(np.searchsorted(-left, -LAYERS, side="left"))
        if m:
            rest = left[:m] - LAYERS
            first = np.cumsum(rest) - rest
            among = np.arange(int(rest.sum())) + np.repeat(begin[:m] + LAYERS - first, rest)
            own[:m] += np.add.reduceat(values.take(order[among], axis=0), first, axis=0)
        put(sums, several, own)
    return ordered[start], times, sums


def put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """`table[rows] = values`, each row moved as one item, which takes half the time."""
    item = np.dtype((np.void, table.strides[0]))
    table.view(item)[:, 0][rows] = values.view(item)[:, 0]


def shares_of(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class, each row's exponentials, their sums, and the logits of the labels, all up to a factor of the row.

    The largest logit is taken off only in a batch where exponentials without that leave the range: it costs as much as
    the sums.
    """
    at = np.arange(len(label)), label
    logits = weights.take(rows[0], axis=0)
    logits += weights.take(rows[1], axis=0)
    logits += weights.take(rows[2], axis=0)
    logits += bias
    found = logits[at]
    with np.errstate(over="ignore"):
        sums = np.exp(logits, out=logits) @ ONES
    if len(sums) and not LEAST_SUM < sums.min() <= sums.max() < 1 / LEAST_SUM:
        logits = logits_of(weights, bias, rows)
        found = logits[at]
        sums = np.exp(logits, out=logits) @ ONES
    return logits, sums, found


class Trainer:
    """AdaGrad over sparse batches, from zero weights, with one rate for each row. `bias` is that of all tokens, or by node."""

    def __init__(self, bias: np.ndarray, rows: int):
        self.bias = bias
        self.weights = np.zeros((rows, CLASSES), dtype=np.float32)
        self.squares = np.full(rows, FIRST_SQUARES, dtype=np.float32)  # of whole rows
        self.seen = np.zeros(rows)  # how often each row was met

    def learn(self, rows: np.ndarray, label: np.ndarray, node: np.ndarray | None = None) -> None:
        for at in range(0, len(label), BATCH):
            some, y = rows[:, at : at + BATCH], label[at : at + BATCH]
            error, sums, _ = shares_of(self.weights, bias_at(self.bias, node, at), some, y)
            error *= (1 / sums)[:, None]
            error[np.arange(len(y)), y] -= 1
            which, times, gradient = sums_by_row(some.ravel(), error)
            self.seen[which] += times
            squares = self.squares[which] + (gradient * gradient) @ ONES
            self.squares[which] = squares
            gradient *= (RATE / np.sqrt(squares))[:, None]
            put(self.weights, which, self.weights.take(which, axis=0) - gradient)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all tokens, the end being the empty word; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            tokens = tokens_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([tokens.words.cast(pa.string()), pa.array(np.bincount(tokens.code, minlength=len(tokens.words)))], ["word", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").where("n > 0")
    return written(parts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Model:
    """What tasks get: bounded by `most_frequent`, the classes and the tables, which have 8 x `MOST_PAST` rows at most."""

    frequent: pa.Array
    frequent_n: np.ndarray
    own: pa.Array
    tree: Tree
    log_mass: np.ndarray  # by slot, log10 of the counts plus one
    bias: np.ndarray  # of the classes
    inner_bias: np.ndarray  # by node
    weights: np.ndarray
    past: int  # rows of the word before
    n_tokens: int
    n_words: int


def learn(docs: DataFrame, trained: Column, text_col: str = "text", most_frequent: int = 1 << 16) -> tuple[Model, DataFrame]:
    """The model of the rows for which `trained` holds, and their (word, n)."""
    train = docs.where(trained)
    counts = word_counts(train, text_col)
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Whole bins of counts, from the highest down, as long as they hold `most_frequent` words at most.
    words = counts.where("word <> '' AND length(word) <= 64").withColumn("bin", F.floor(F.log2("n") * 8).cast("int"))
    bins = sorted(words.groupBy("bin").count().collect(), reverse=True)
    sizes = np.cumsum([size for _, size in bins])
    lowest = next((b for (b, _), size in zip(bins[::-1], sizes[::-1], strict=True) if size <= most_frequent), None)
    top = [] if lowest is None else sorted(((r[0], r[1]) for r in words.where(F.col("bin") >= lowest).select("word", "n").collect()), key=lambda r: (-r[1], r[0]))
    frequent, frequent_n = pa.array([r[0] for r in top], pa.string()), np.array([r[1] for r in top], dtype=np.int64)
    own = frequent[:OWN_CLASS]

    tree = tree_of(frequent, n_words)
    n_slots = int(tree.first[-1]) * CLASSES

    def slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(n_slots, dtype=np.int64)
        for batch in batches:
            words = batch.column("word")
            slots = tree.slots(words, hashes_of(words))
            leaf = slots[(slots >= 0).sum(axis=0) - 1, np.arange(len(words))]
            mass += np.bincount(leaf, weights=batch.column("n").to_numpy() + 1, minlength=n_slots).astype(np.int64)
        slot = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(mass[slot])], ["slot", "mass"])

    leaves = np.zeros(n_slots)
    for k, n in counts.mapInArrow(slot_sums, "slot long, mass long").groupBy("slot").agg(F.sum("mass")).collect():
        leaves[k] = n
    inner_bias, log_mass = masses_of(tree, leaves)
    bias = inner_bias[0]

    past = past_rows(n_words)
    rows = 8 * past
    shape = (rows // BLOCKS, CLASSES)

    def train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(inner_bias, rows)
        for batch in slices(batches, SLICE):
            tokens = tokens_of(batch.column("text"))
            hashes = hashes_of(tokens.words)
            slots, contexts = tree.slots(tokens.words, hashes), contexts_of(tokens, hashes)
            trainer.learn(rows_of(contexts, past), slots[0][tokens.code])
            _, slot, inner = inner_features(contexts, slots, tokens.code, past)
            trainer.learn(inner, slot % CLASSES, slot // CLASSES)
        # Only rows that were met, a block at a time: neither the worker nor the JVM holds the table once more.
        for block, (seen, weights) in enumerate(zip(np.split(trainer.seen, BLOCKS), np.split(trainer.weights, BLOCKS), strict=True)):
            met = np.flatnonzero(seen)
            if len(met):
                columns = [pa.array([x.tobytes()], pa.binary()) for x in (met.astype(np.int32), seen[met], weights[met])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *columns], ["block", "met", "seen", "weights"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, met = None, None, None
        done = []
        for batch in batches:
            for b, *columns in zip(batch.column("block").to_pylist(), *batch.columns[1:], strict=True):
                if b != block:
                    if block is not None:
                        done.append((block, (total / np.maximum(met, 1)).astype(np.float32).tobytes()))
                    block, total, met = b, np.zeros(shape), np.zeros((shape[0], 1))
                row, times, w = (np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(columns, (np.int32, np.float64, np.float32), strict=True))
                total[row] += w.reshape(-1, CLASSES) * times[:, None]
                met[row, 0] += times
        if block is not None:
            done.append((block, (total / np.maximum(met, 1)).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int32()), pa.array([w for _, w in done], pa.binary())], ["block", "weights"])

    parts = train.select(F.col(text_col).cast("string").alias("text")).mapInArrow(train_task, "block int, met binary, seen binary, weights binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(average, "block int, weights binary").collect()
    weights = np.zeros((BLOCKS, *shape), dtype=np.float32)
    for block, w in merged:
        weights[block] = np.frombuffer(w, dtype=np.float32).reshape(shape)
    return Model(frequent, frequent_n, own, tree, log_mass, bias, inner_bias, weights.reshape(rows, CLASSES), past, n_tokens, n_words), counts


def class_scores(model: Model, tokens: Tokens) -> np.ndarray:
    """Per document: the sum of log10 of the probabilities of the token's class and of its outcomes within it, over the
    mass of the last.
    """
    hashes = hashes_of(tokens.words)
    slots, contexts = model.tree.slots(tokens.words, hashes), contexts_of(tokens, hashes)

    def found(rows: np.ndarray, label: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        log_p = np.empty(len(label))
        for at in range(0, len(label), BATCH):
            y = label[at : at + BATCH]
            _, sums, found = shares_of(model.weights, bias_at(model.inner_bias, node, at), rows[:, at : at + BATCH], y)
            log_p[at : at + BATCH] = found - np.log(sums)
        return log_p

    log_p = found(rows_of(contexts, model.past), slots[0][tokens.code])
    at, slot, inner = inner_features(contexts, slots, tokens.code, model.past)
    log_p += np.bincount(at, weights=found(inner, slot % CLASSES, slot // CLASSES), minlength=len(log_p))
    leaf = slots[(slots >= 0).sum(axis=0) - 1, np.arange(len(tokens.words))]
    return np.add.reduceat(log_p / math.log(10) - model.log_mass[leaf][tokens.code], tokens.first)


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row, with n_tokens, n_known, train_tokens, base_score and score.

    `base_score` is the log10 probability under the add-one unigram, `score` under the model, both of the whole text;
    a null text is its end alone. Rows are independent and keep repeats; an empty table gives an empty one. Rarer
    words meet their counts in a join by word, so nothing that grows with the vocabulary is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        n_of = np.append(model.frequent_n, 0)
        for batch in slices(batches, SLICE, "_text"):
            tokens = tokens_of(batch.column("_text"))
            at = pc.fill_null(pc.index_in(tokens.words, value_set=model.frequent), -1).to_numpy()
            doc, n_docs = tokens.doc, batch.num_rows
            known = (at >= 0)[tokens.code]
            log_n = np.where(at >= 0, np.log10(n_of[at] + 1), 0)[tokens.code]
            rare = np.flatnonzero(~known)
            pairs, times = np.unique(doc[rare] * len(tokens.words) + tokens.code[rare], return_counts=True)
            of, which = pairs // len(tokens.words), pairs % len(tokens.words)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_docs))]).astype(np.int32)
            items = pa.StructArray.from_arrays([tokens.words.cast(pa.string()).take(pa.array(which)), pa.array(times.astype(np.int64))], ["word", "times"])
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in keep], pa.array(np.arange(row, row + n_docs)), pa.array(np.diff(np.append(tokens.first, len(doc)))),
                pa.array(np.add.reduceat(known.astype(np.int64), tokens.first)), pa.array(np.add.reduceat(log_n, tokens.first)),
                pa.array(class_scores(model, tokens)), pa.ListArray.from_arrays(offsets, items)],
                [*keep, "_row", "_tokens", "_known", "_log_n", "_class", "_rare"])
            row += n_docs

    source = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)
    rows = written(source.mapInArrow(run, (
        f"{kinds}, _row long, _tokens long, _known long, _log_n double, _class double, _rare array<struct<word:string,times:bigint>>")), "scored")
    rare = rows.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.times")
    met = rare.join(counts, "word").groupBy("_row").agg(
        F.sum("times").alias("_rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_rare_log_n"))
    log_n = F.col("_log_n") + F.coalesce("_rare_log_n", F.lit(0.0))
    return rows.drop("_rare").join(met, "_row", "left").select(
        *keep, F.col("_tokens").alias("n_tokens"), (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (log_n - F.col("_tokens") * F.lit(math.log10(model.n_tokens + model.n_words + 1))).alias("base_score"),
        (log_n + F.col("_class")).alias("score"))
