"""Operator 8, token counts by trie-shared dynamic programming.

The tokens of a pre-token (a run without ASCII white space) are those of its
best segmentation under a unigram model. The distinct pre-tokens of a shard are
put in a trie; forward scores of the model are computed once for each prefix
that pre-tokens share, and each terminal stores its count. Documents add up
the counts of their pre-tokens. Nothing is shuffled, and a shard's trie is
bounded, so it runs alike on any number of documents.

The model is fitted to the corpus (no tokenizer is trained: the pieces are those
of a public vocabulary, and only their log-probabilities are learned). By Zipf's
law a piece of rank r starts at -ln(r + 2) but for a constant; then each round
segments distinct pre-tokens over the same tries, counts the pieces used, each
as often as its pre-token occurs, and takes smoothed shares as the new
probabilities (Viterbi training, an EM with the best segmentation alone). All
rounds read all distinct pre-tokens of the corpus, which are counted once,
before the shuffle, and kept sorted; the driver gets one number a piece.
A character that no piece covers falls back to one token for each of its UTF-8
bytes, each at the score of an unknown. Ties are won by the shorter last piece.

Nulls, ties and odd texts: a null or blank text has no tokens; repeated rows
count alike; texts of any length are read whole, in pieces; a pre-token of more
than ``LONG`` bytes is scored alone and not kept; an empty table
gives no rows, and a corpus without a pre-token scores all pieces alike.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigscan.llm.common import tidied, word_parts
from sigscan.session import discard, materialize, partitions_for, ship

#: Counts that a worker keeps (one more part of texts may come on top), and the longest pre-token that is kept.
KEPT, LONG = 1_000_000, 256
#: Rounds of training before the last, and what is added to each piece's count.
ROUNDS, SMOOTH = 2, 0.5
#: Bytes of the table of distinct pre-tokens that a task of a round segments.
ROUND_BYTES = 8 << 20
#: Stands before every pre-token, as in the vocabulary's pieces.
MARK = "▁"


class Vocabulary:
    """Pieces with log-probabilities, as a trie of dictionaries: node[""] is the rank of the piece that ends there."""

    def __init__(self, pieces_by_rank: list[str]):
        self.root: dict = {}
        for rank, piece in enumerate(pieces_by_rank):
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node.setdefault("", rank)
        self.use(-np.log(np.arange(len(pieces_by_rank)) + 2.0))

    def use(self, scores: np.ndarray) -> Vocabulary:
        """Take ``scores`` as the log-probabilities, by rank."""
        self.scores = scores.tolist()
        self.unknown = min(self.scores, default=0.0) - 10
        return self

    @staticmethod
    def sentencepiece(path: str) -> Vocabulary:
        """The ordinary pieces of a sentencepiece model file, best first."""
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        return Vocabulary([p.id_to_piece(i) for i in range(len(p)) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))])


class Forward:
    """Forward scores along the current path of the trie of pre-tokens; moving to the next pre-token keeps the shared prefix.

    Pre-tokens are visited in sorted order, which is the trie's depth-first
    order: ``word`` is the path, and entry k of each list belongs to its prefix
    of k characters.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = ""
        self.score, self.count, self.open, self.last = [0.0], [0], [[(vocabulary.root, 0)]], [(0, -1)]
        self.steps = 0

    def tokens(self, word: str) -> int:
        """Tokens of the best segmentation of ``word``."""
        old, k = self.word, 0
        for a, b in zip(old, word, strict=False):
            if a != b:
                break
            k += 1
        del self.score[k + 1 :], self.count[k + 1 :], self.open[k + 1 :], self.last[k + 1 :]
        self.word = word
        self.steps += len(word) - k
        score, count, root, scores, unknown = self.score, self.count, self.v.root, self.v.scores, self.v.unknown
        for end in range(k + 1, len(word) + 1):
            c = word[end - 1]
            # pieces begun at each earlier place that may go on; the latest begins last
            live, best, tokens, last = [], -math.inf, 0, None
            for node, begin in self.open[end - 1]:
                nxt = node.get(c)
                if nxt is not None:
                    live.append((nxt, begin))
                    piece = nxt.get("")
                    if piece is not None and (s := score[begin] + scores[piece]) >= best:
                        best, tokens, last = s, count[begin] + 1, (begin, piece)
            if (s := score[end - 1] + unknown * (n := len(c.encode("utf-8", "replace")))) > best:
                best, tokens, last = s, count[end - 1] + n, (end - 1, -1)
            live.append((root, end))
            score.append(best)
            count.append(tokens)
            self.open.append(live)
            self.last.append(last)
        return count[-1]

    def pieces(self) -> list[int]:
        """Ranks of the pieces of the current path's best segmentation, last first, without its unknowns."""
        out, end = [], len(self.word)
        while end:
            end, piece = self.last[end]
            if piece >= 0:
                out.append(piece)
        return out


class Counter:
    """Counts of pre-tokens, kept across documents and shards of a worker."""

    def __init__(self, vocabulary: Vocabulary, kept: int = KEPT):
        self.v, self.kept, self.cache = vocabulary, kept, {}

    def learn(self, words: list[bytes]) -> list[int]:
        """Counts of distinct pre-tokens: new ones go into a trie, whose terminals store them."""
        counts = [self.cache.get(w) for w in words]
        if None not in counts:
            return counts
        if len(self.cache) > self.kept:
            self.cache.clear()
        f = Forward(self.v)
        for text, k in sorted((MARK + words[k].decode("utf-8", "replace"), k) for k, n in enumerate(counts) if n is None):
            n = counts[k] = f.tokens(text) if words[k] else 0
            if len(words[k]) <= LONG:
                self.cache[words[k]] = n
        return counts

    def shard(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for row, lens, code, distinct in word_parts(texts):
            ends = np.concatenate([[0], lens.cumsum()])
            n = np.array(self.learn(distinct), np.int64)[code] if len(code) else np.zeros(0, np.int64)
            real = np.array([w != b"" for w in distinct], bool)[code] if len(code) else np.zeros(0, bool)
            for out, each in ((words, real), (tokens, n)):
                out[row : row + len(lens)] += np.diff(np.concatenate([[0], each.cumsum()])[ends])
        return words, tokens


#: What a worker keeps across tasks: vocabularies by file, and the counter of the last file and scores.
_VOCABULARIES: dict[str, Vocabulary] = {}
_COUNTERS: dict[tuple[str, bytes], Counter] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.sentencepiece(path)
    return _VOCABULARIES[path]


def counter(path: str, scores: np.ndarray) -> Counter:
    """The worker's counter for a vocabulary file and scores."""
    key = path, scores.tobytes()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(_vocabulary(path).use(scores))
    _COUNTERS[key].v.use(scores)
    return _COUNTERS[key]


def pretokens(docs: DataFrame) -> DataFrame:
    """(word, n): distinct pre-tokens of all rows and how often they occur."""
    ship(docs.sparkSession)

    @tidied
    def run(batches):
        for b in batches:
            for _, _, code, distinct in word_parts(b.column(0)):
                n = np.bincount(code, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n"))


def step(words: DataFrame, vocabulary: str, scores: np.ndarray) -> np.ndarray:
    """New log-probabilities: smoothed shares of the pieces in the best segmentations of ``words`` (word, n)."""
    ship(words.sparkSession)
    sent = words.sparkSession.sparkContext.broadcast(scores)

    @tidied
    def run(batches):
        v = _vocabulary(vocabulary).use(sent.value)
        used = [0] * len(v.scores)
        for b in batches:
            f = Forward(v)
            for text, n in sorted((MARK + w.decode("utf-8", "replace"), n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                f.tokens(text)
                for piece in f.pieces():
                    used[piece] += n
        found = np.array(used, np.int64)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["piece", "n"])

    got = words.select("word", "n").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    n = np.full(len(scores), SMOOTH)
    for r in got:
        n[r.piece] += r.n
    return np.log(n / n.sum())


def fit(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities of the vocabulary's pieces, by rank, fitted to all rows: each round segments all distinct pre-tokens."""
    counted = materialize(pretokens(docs), "pretokens")
    # dealt and sorted once, so that a round reads files alone and neighbours share their prefixes
    words = materialize(counted.repartition(partitions_for(counted, ROUND_BYTES), "word").sortWithinPartitions("word"), "words")
    discard(counted)
    scores = prior(vocabulary)
    for _ in range(rounds + 1):
        scores = step(words, vocabulary, scores)
    discard(words)
    return scores


def prior(vocabulary: str) -> np.ndarray:
    """Zipf's law over the ranks of the pieces: the scores before training."""
    return -np.log(np.arange(len(_vocabulary(vocabulary).scores)) + 2.0)


def count_tokens(docs: DataFrame, vocabulary: str, scores: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row; ``scores`` as :func:`fit` gives them, by default those before training."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(prior(vocabulary) if scores is None else scores)

    @tidied
    def run(batches):
        c = counter(vocabulary, sent.value)
        for b in batches:
            words, n = c.shard(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n)], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
