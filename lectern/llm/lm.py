"""Language-model scores by a weighted backoff automaton.

An n-gram model, smoothed by Dirichlet priors: the probability of a word after a context mixes the context's counts with
`prior` counts dealt by the shorter context's probabilities, down to single tokens, of which unseen ones share one class.
Contexts are states; a state has an arc for each word seen after it, and a failure arc, with the weight left for other words, to
the state of the shorter context. A text is read once from left to right: the state is carried on, and weights of arcs and failure
arcs are added up.

Counts cover the whole training corpus and never meet in one place: each block of documents asks hash shards for the counts of
the n-grams that it holds, a length at a time, and builds the part of the automaton that its own texts can reach. A state for two
words or more exists if they occur twice in training, and only n-grams behind a state are asked for. The automaton reads many pieces
of text at once; a piece that starts within a text reads the words before it first, which fixes its state.

Defined results: null and empty texts are the end token alone; the crc32 of a null id is that of the empty string (held out);
repeated rows count each; with no training rows every token is unseen; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, NOT_SPACE, NULL_ID, mix, null_id, window_hashes, word_hashes, words
from lectern.llm.exchange import Batch, Block, Sums, exchange, over_blocks, per_block, store, summed_stats

BLOCK_BYTES = 3 << 20
ADD = 0.1
#: Counts that contexts of one word, two, and so on give to the shorter ones' probabilities; n-grams are longer by one than the longest context.
PRIORS = (1000.0, 50.0, 5.0, 1.0)
END = mix(np.array([1], np.uint64))[0]
#: Tokens that one cursor reads.
LANE = 256


def held_out(doc_id: int) -> bool:
    """crc32 of the id as text, modulo 10, is 0."""
    return zlib.crc32(b"" if doc_id == NULL_ID else str(doc_id).encode()) % 10 == 0


class Tokens:
    """Token hashes of a block, one end token behind each text, and each text's first token."""

    def __init__(self, block: Block):
        data = LOWER[block.data]
        s, e, first = words(data, block.bounds, NOT_SPACE)
        h = word_hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)
        self.hashes = np.insert(h, first[1:], END)
        self.first = first + np.arange(len(first))
        self.held_out = np.array([held_out(i) for i in block.ids.tolist()], bool)
        self.doc = np.repeat(np.arange(len(block.ids)), np.diff(self.first))
        self.trained = ~self.held_out[self.doc]

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Last places of n-grams inside texts, and their hashes."""
        if len(self.hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - size + 1] == self.doc[size - 1 :])
        return at + size - 1, window_hashes(self.hashes, size)[at]


class Level:
    """A block's n-grams of one length: their last places, their number at each place (-1: not asked for), and the training count of each."""

    def __init__(self, t: Tokens, at: np.ndarray, numbers: np.ndarray, counts: np.ndarray):
        self.at, self.counts = at, counts.astype(np.int64)
        self.number = np.full(len(t.hashes), -1, np.int32)
        self.number[at] = numbers

    def count(self, place: np.ndarray) -> np.ndarray:
        """Training counts of the n-grams that end there; 0 where none was asked for."""
        n = self.number[place]
        return np.where(n >= 0, self.counts[n], 0) if len(self.counts) else np.zeros(len(n), np.int64)


def behind_states(t: Tokens, contexts: Level, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Last places and hashes of n-grams whose words but the last are a state."""
    at, hashes = t.grams(size)
    some = contexts.count(at - 1) > 1
    return at[some], hashes[some]


def levels_of(t: Tokens, had: list[list[np.ndarray]]) -> list[Level]:
    """Levels from the answers to the questions of tokens and pairs, triples, and so on."""
    if not had:
        return []
    at, pairs = t.grams(2)
    n = len(t.hashes)
    back = np.unique(np.concatenate([t.hashes, pairs]), return_inverse=True)[1]
    counts = had[0][0] if had[0] else np.zeros(0, np.uint64)
    levels = [Level(t, np.arange(n), back[:n], counts), Level(t, at, back[n:], counts)]
    for size, got in enumerate(had[1:], 3):
        at, hashes = behind_states(t, levels[-1], size)
        levels.append(Level(t, at, np.unique(hashes, return_inverse=True)[1], got[0] if got else np.zeros(0, np.uint64)))
    return levels


class ShortGrams(Sums):
    """How often the block's tokens and pairs stand in training; and the numbers of training tokens and of distinct ones."""

    def ask(self, block, had):
        t = Tokens(block)
        at, pairs = t.grams(2)
        keys, back = np.unique(np.concatenate([t.hashes, pairs]), return_inverse=True)
        one, two = back[: len(t.hashes)], back[len(t.hashes) :]
        counts = np.bincount(one[t.trained], minlength=len(keys)) + np.bincount(two[t.trained[at]], minlength=len(keys))
        token = np.zeros(len(keys), np.uint8)
        token[one] = 1
        return Batch(keys, [counts.astype(np.uint32), token])

    def answer(self, batch, who):
        (counts, token), back = self.totals(batch)
        tokens = counts[token > 0]
        return [counts[back]], [int(tokens.sum()), int((tokens > 0).sum())]


class LongGrams(Sums):
    """How often n-grams behind states stand in training."""

    def __init__(self, size: int):
        self.size = size

    def ask(self, block, had):
        t = Tokens(block)
        at, hashes = behind_states(t, levels_of(t, had)[-1], self.size)
        keys, back = np.unique(hashes, return_inverse=True)
        return Batch(keys, [np.bincount(back[t.trained[at]], minlength=len(keys)).astype(np.uint32)])


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach.

    N-grams of all lengths are numbered in one row. A number is that of a state (of the words as a context) and of an arc (for the
    last word, from the state of those before it). `number[k]` holds at each place the one of k + 1 words that end there, so that the
    arc for the next word is found without a search.
    """

    def __init__(self, t: Tokens, levels: list[Level], total: int, kinds: int, priors: Sequence[float]):
        self.longest = len(levels)
        base = np.cumsum([0, *[len(x.counts) for x in levels]])
        n_places = len(t.hashes)
        self.number = np.stack([np.where(x.number >= 0, x.number + b, -1) for x, b in zip(levels, base[:-1], strict=True)]).astype(np.int64) if n_places else np.zeros((len(levels), 0), np.int64)
        counts = np.concatenate([x.counts for x in levels])
        self.counts = levels[0].count(np.arange(n_places))
        self.single = (self.counts + ADD) / (total + ADD * (kinds + 1))
        self.arc = counts > 0
        self.weight, self.fail = np.zeros(len(counts)), np.zeros(len(counts))
        self.next = np.zeros(len(counts), np.int64)  # words of the state that an arc leads to
        is_state = np.zeros((len(levels), n_places), bool)
        p = self.single
        for k, x in enumerate(levels):
            number = self.number[k][x.at]
            if k:
                contexts, prior = levels[k - 1].count(x.at - 1), priors[k - 1]
                new = p.copy()
                new[x.at] = (x.count(x.at) + prior * p[x.at]) / (contexts + prior)
                p = new
            else:
                self.arc[number] = True
            self.weight[number] = np.log10(p[x.at])
            if k < len(levels) - 1:
                self.fail[number] = np.log10(priors[k] / (x.count(x.at) + priors[k]))
                is_state[k, x.at] = (x.count(x.at) > (k > 0)) & (t.hashes[x.at] != END)
            goal = np.zeros(len(x.at), np.int64)
            for j in range(min(k, len(levels) - 2), -1, -1):
                goal = np.where((goal == 0) & is_state[j, x.at], j + 1, goal)
            self.next[number] = goal

    def step(self, state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states (as numbers of words) and weights on the way, over failure arcs where a state has no arc for the word at the place."""
        weight, goal = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left, words_ = np.arange(len(state)), state
        while len(left):
            at = place[left]
            n = self.number[words_, at]
            hit = (n >= 0) & self.arc[n]
            weight[left[hit]] += self.weight[n[hit]]
            goal[left[hit]] = self.next[n[hit]]
            left, words_, at = left[~hit], words_[~hit], at[~hit]
            weight[left] += self.fail[self.number[words_ - 1, at - 1]]
            words_ = words_ - 1
        return goal, weight

    def read(self, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text; first: its first token, and the end."""
        lanes = -(-np.diff(first) // LANE)
        doc = np.repeat(np.arange(len(lanes)), lanes)
        start = first[doc] + LANE * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + LANE, first[doc + 1])
        before = self.longest - 1
        at, state, total = np.maximum(start - before, first[doc]), np.zeros(len(doc), np.int64), np.zeros(len(doc))
        for _ in range(LANE + before):
            live = np.flatnonzero(at < stop)
            if not len(live):
                break
            state[live], weight = self.step(state[live], at[live])
            total[live] += np.where(at[live] >= start[live], weight, 0.0)
            at[live] += 1
        return np.bincount(doc, weights=total, minlength=len(lanes))


FIELDS = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def score(docs: DataFrame, priors: Sequence[float] = PRIORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    priors: one for each length of contexts, so that four make a model of five words.
    """
    corpus = store(docs, BLOCK_BYTES, id_col, text_col)
    counts = [exchange(corpus, ShortGrams())]
    total, kinds = summed_stats(counts[0], 2)
    for size in range(3, len(priors) + 2):
        counts.append(exchange(corpus, LongGrams(size), counts))

    def fn(block: Block, had):
        t = Tokens(block)
        machine = Automaton(t, levels_of(t, had), total, kinds, priors)
        add = lambda x: np.bincount(t.doc, weights=x, minlength=len(block.ids))
        known = add((machine.counts > 0).astype(float)).astype(np.int64)
        return block.ids, t.held_out, np.diff(t.first), known, np.full(len(block.ids), total), add(np.log10(machine.single)), machine.read(t.first)

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return over_blocks(corpus, counts, per_block(fn, pa.schema(FIELDS)), fields).withColumn("doc_id", null_id(F.col("doc_id")))
