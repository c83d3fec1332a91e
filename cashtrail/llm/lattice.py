"""Language-model scoring by subword lattice likelihood.

A word's probability is the sum over all its segmentations into pieces of an existing public vocabulary, by a forward recursion
in log space. Piece weights are the vocabulary's own scores (ranks, as a Zipf law) for a few pseudo tokens, plus the counts of
the pieces in all distinct training words. A text's probability joins this open model with the training counts of whole words:
P(word) = (c + V x lattice(word)) / (N + V), V types and N tokens of the training texts, so a word never seen costs its
spelling. Words are scored once per distinct word of the corpus; the most frequent ones (a bounded list) are looked up
inside the scan, all others by a join on the word, so no hot word is ever shuffled per document.

Defined results: a null or blank text is one end token; equal and repeated texts score equally, row by row; a null id counts
as empty text for the fold; without any training text words score by the lattice alone; an empty table gives no rows;
characters outside the vocabulary go by their bytes; columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .common import holdout, packed, text_of

VOCABULARY = "piece_bpe_32k.model"
PSEUDO_TOKENS = 1_000.0             # weight of the vocabulary's own scores
FREQUENT_WORDS = 50_000             # bound of the list looked up inside the scan
BYTE_SHARE = 1e-4                   # share of the prior left to the 256 byte pieces
SPACE = "▁"


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, as bytes."""
    return text.encode().lower().split()


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces, and their prior: probability falls with the rank that the file's scores state."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    prior = np.array([0.0 if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else 1.0 / (2.0 - sp.get_score(i)) for i in range(size)])
    prior *= (1 - BYTE_SHARE) / prior.sum()
    prior[[i for i in range(size) if sp.is_byte(i)]] = BYTE_SHARE / 256
    return pieces, prior


class Lattice:
    """All segmentations of a word, weighted by log probabilities of pieces."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.automaton, self.bytes, self.single = ahocorasick.Automaton(), [-math.inf] * 256, set()
        for piece, log in zip(pieces, logs.tolist(), strict=True):
            if piece.startswith("<0x") and piece.endswith(">"):
                self.bytes[int(piece[3:5], 16)] = log
            elif log > -math.inf:
                self.automaton.add_word(piece, (len(piece), log))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the word after its space mark."""
        s = SPACE + word
        log1p, exp, none = math.log1p, math.exp, -math.inf
        forward = [0.0] + [none] * len(s)
        spelled = {i: sum(self.bytes[b] for b in c.encode()) for i, c in enumerate(s) if c not in self.single}
        done = 0
        for last, (length, log) in self.automaton.iter(s):
            if spelled:
                for i in range(done, last + 1):             # characters without a piece of their own, up to here
                    if i in spelled and i < last + 1 - length + 1:
                        self._add(forward, i + 1, forward[i] + spelled.pop(i))
                done = max(done, last + 1 - length + 1)
            v, old = forward[last + 1 - length] + log, forward[last + 1]
            forward[last + 1] = v if old == none else none if v == none and old == none else (
                old + log1p(exp(v - old)) if old >= v else v + log1p(exp(old - v)))
        for i in sorted(spelled):
            self._add(forward, i + 1, forward[i] + spelled[i])
        return forward[-1]

    @staticmethod
    def _add(forward: list[float], at: int, v: float) -> None:
        old = forward[at]
        m = max(v, old)
        forward[at] = m if m == -math.inf or min(v, old) == -math.inf else m + math.log1p(math.exp(min(v, old) - m))


_models: dict[bytes, Lattice] = {}


def _lattice(pieces: list[str], logs: np.ndarray) -> Lattice:
    """One per Python worker and set of weights."""
    key = logs.tobytes()
    if key not in _models:
        _models.clear()
        _models[key] = Lattice(pieces, logs)
    return _models[key]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in training rows and in all; ``rows``: text, held_out."""
    @F.arrow_udf("array<struct<word:binary,n:long>>")
    def counted(texts: pa.Array) -> pa.Array:
        words, counts, at = [], [], [0]
        for t in texts.to_pylist():
            c = Counter(tokens(t))
            words += c.keys()
            counts += c.values()
            at.append(len(words))
        pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)

    each = rows.select("held_out", F.inline(counted("text")))
    return each.groupBy("word").agg(F.sum(F.when(~F.col("held_out"), F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("n"))


def piece_weights(counts: DataFrame, path: str) -> np.ndarray:
    """Log probabilities of the pieces: prior plus the pieces of all distinct training words.

    Each word counts once however often it occurs: the lattice speaks for words not seen, which are like rare ones.
    """
    pieces, prior = vocabulary(path)
    size = len(pieces)

    def segmented(batches):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(size)
        for b in batches:
            ids = sp.encode([w.decode() for w in b["word"]], num_threads=1)
            flat = np.fromiter((i for one in ids for i in one), np.int64)
            total += np.bincount(flat, minlength=size)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"piece": there, "n": total[there]})

    got = counts.filter("c > 0").select("word").mapInPandas(segmented, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(size)
    found[got["piece"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    found[prior == 0] = 0
    weight = found + PSEUDO_TOKENS * prior
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


def scored_words(counts: DataFrame, path: str, tokens_: int, types: int) -> DataFrame:
    """(word, n, known, base, score): log10 under the base and under the model."""
    pieces, _ = vocabulary(path)
    logs = piece_weights(counts, path)

    @F.arrow_udf("double")
    def lattice(words: pa.Array) -> pa.Array:
        model = _lattice(pieces, logs)
        return pa.array([model.log_probability(w.decode()) for w in words.to_pylist()], pa.float64())

    backoff = max(types, 1)
    spelled = counts.withColumn("p", lattice("word"))
    # log10((c + K p) / (N + K)); for c = 0 in logarithms, as p may be too small for a double
    known = F.log10((F.col("c") + backoff * F.exp("p")) / float(tokens_ + backoff))
    unknown = F.col("p") / math.log(10) + math.log10(backoff / (tokens_ + backoff))
    return spelled.select("word", "n", (F.col("c") > 0).alias("known"), base_log(F.col("c"), tokens_, types).alias("base"),
                          F.when(F.col("c") > 0, known).otherwise(unknown).alias("score"))


def base_log(c: Column, tokens_: int, types: int) -> Column:
    return F.log10((c + 0.5) / float(tokens_ + 0.5 * (types + 1)))


def report(docs: DataFrame, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """One row per document with token counts, base score and model score."""
    path = public_tokenizers.path(vocabulary_file)
    rows = packed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), (holdout(F.col("row.doc_id")) == 1).alias("held_out"), text_of().alias("text"))
    counts = written(word_counts(rows), "words")
    ends = rows.filter(~F.col("held_out")).count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    words = written(scored_words(counts, path, n, v), "scores")
    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).collect()
    table = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]): (r["known"], r["base"], r["score"]) for r in top})
    end_base = math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
    end_score = math.log10((ends or 0.5) / (n + max(v, 1)))

    shape = "array<struct<word:binary,c:long,n_tokens:long,n_known:long,base:double,score:double>>"
    kind = pa.list_(pa.struct([("word", pa.binary()), ("c", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]))

    @F.arrow_udf(shape)
    def looked_up(texts: pa.Array, uids: pa.Array) -> pa.Array:
        """Sums over frequent words as one row with a key of its own (no word has a blank), and the rest by word."""
        frequent, columns, at = table.value, ([], [], [], [], [], []), [0]
        for t, uid in zip(texts.to_pylist(), uids.to_pylist(), strict=True):
            found = Counter(tokens(t))
            known, base, score, rest = int(ends > 0), end_base, end_score, []
            for w, c in found.items():
                hit = frequent.get(w)
                if hit is None:
                    rest.append((w, c))
                else:
                    known += c * hit[0]
                    base += c * hit[1]
                    score += c * hit[2]
            for column, value in zip(columns, (b" %d" % uid, 0, found.total() + 1, known, base, score), strict=True):
                column.append(value)
            columns[0].extend(w for w, _ in rest)
            columns[1].extend(c for _, c in rest)
            for column, nought in zip(columns[2:], (0, 0, 0.0, 0.0), strict=True):
                column.extend([nought] * len(rest))
            at.append(len(columns[0]))
        arrays = [pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(arrays, [f.name for f in kind.value_type]))

    uid = rows.withColumn("uid", F.monotonically_increasing_id())
    each = uid.select("uid", "doc_id", "held_out", F.inline(looked_up("text", "uid")))
    rare = words.select("word", F.col("known").cast("long").alias("k"), F.col("base").alias("b"), F.col("score").alias("s"))
    joined = each.join(rare, "word", "left")
    part = lambda own, of_word: F.sum(F.col(own) + F.coalesce(F.col("c") * F.col(of_word), F.lit(0))).alias(own)
    return joined.groupBy("uid", "doc_id", "held_out").agg(F.sum("n_tokens").alias("n_tokens"), part("n_known", "k"), part("base", "b"), part("score", "s")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
