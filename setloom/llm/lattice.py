"""Language-model scores: the marginal probability of a text over all segmentations of its words.

A word's lattice has an arc for every piece of an existing public vocabulary and, if training texts hold the word, one
arc over the whole of it. The vocabulary's own scores are ranks, which a Zipf law turns into log probabilities; ROUNDS of
expectation-maximisation over all distinct training words, each word once, refine them, as the ranks come from texts of
other languages (rounds=0 takes the scores as they are). The whole-word arc has its discounted relative frequency, and the
discounted mass goes to the pieces, so a word's probability is a sum over all its segmentations. The sums run forward in
log space. Texts of several languages are a mixture: each language has word frequencies of its own, which fall back on
those of all, and a text's probability is summed over the languages it may be in; its own language is no input.

Texts are read once. A task replaces words by numbers of its own chunk's word list; word lists are summed into one table
of words, which grows with the corpus and stays distributed; each word gets its probability once; the probabilities go
back to the chunks that asked for them. Only the pieces' scores, as many as the vocabulary has, are broadcast.

Defined results: null or empty text is the end token alone; null doc_id counts as held out; null lang is of the last
component; repeated rows count as often as they occur, and rows of equal text and lang have equal scores; a text or word of
any length counts whole; of equally frequent languages the smaller name goes first; columns of other names are ignored;
without training texts all pieces keep their first scores; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import uuid
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

VOCABULARY = "byte_bpe_50k.tiktoken"
FOLDS = 10
#: Taken off counts where the counts of counts tell nothing.
DISCOUNT = 0.75
#: Components of the mixture; languages beyond the most frequent share the last, so each is one column of the words' table.
COMPONENTS = 8
ROUNDS = 3
#: Bytes of text whose words share one list in a task's memory.
CHUNK = 32 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces a lower-case word can hold, and first scores: log of 1 / (rank + 3), not yet normalised.

    A piece with a leading space is that piece at a word's start; the better rank of the two counts. All bytes are pieces.
    """
    ranks: dict[bytes, int] = {}
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        for line in lines:
            code, rank = line.split()
            piece = base64.b64decode(code).lstrip(b" ")
            if piece and not set(piece) & set(b" \t\n\r\x0b\x0cABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                ranks[piece] = min(int(rank), ranks.get(piece, 1 << 30))
    last = max(ranks.values(), default=0)
    for b in range(256):
        ranks.setdefault(bytes([b]), last + 1)
    pieces = sorted(ranks)
    return pieces, -np.log(np.array([ranks[p] + 3.0 for p in pieces]))


class Lattice:
    """Sums over all segmentations of many words at a time; words of equal length go together."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        """logs: a row of log scores for each place a piece can have: whole word, first, inner, last."""
        self.logs = logs
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        longest = int(sizes.max(initial=0))
        self.powers = [np.uint64(pow(int(MULTIPLIER), k, 1 << 64)) for k in range(longest + 1)]
        self.by_size = []
        for size in range(1, longest + 1):
            at = np.flatnonzero(sizes == size)
            if len(at):
                chars = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, size)
                hashes = self.prefix(chars)[size]
                order = np.argsort(hashes)
                self.by_size.append((size, hashes[order], at[order]))

    @staticmethod
    def prefix(chars: np.ndarray) -> np.ndarray:
        """Rolling hashes of all prefixes: row j has that of the first j characters."""
        out = np.zeros((chars.shape[1] + 1, len(chars)), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(chars.shape[1]):
                out[j + 1] = out[j] * MULTIPLIER + (chars[:, j].astype(np.uint64) + np.uint64(1))
        return out

    def arcs(self, chars: np.ndarray):
        """For each end: (start, rows, pieces) of the arcs that end there."""
        heads = self.prefix(chars)
        with np.errstate(over="ignore"):
            for end in range(1, chars.shape[1] + 1):
                found = []
                for size, hashes, ids in self.by_size:
                    if size > end:
                        break
                    part = heads[end] - heads[end - size] * self.powers[size]
                    at = np.searchsorted(hashes, part)
                    at[at == len(hashes)] = 0
                    rows = np.flatnonzero(hashes[at] == part)
                    if len(rows):
                        found.append((end - size, rows, ids[at[rows]]))
                yield end, found

    def forward(self, chars: np.ndarray, keep: list | None = None) -> np.ndarray:
        """alpha[j]: log of the summed weight of all segmentations of the first j characters."""
        last = chars.shape[1]
        alpha = np.full((last + 1, len(chars)), -np.inf)
        alpha[0] = 0
        for end, found in self.arcs(chars):
            for start, rows, ids in found:
                alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.logs[place(start, end, last), ids])
            if keep is not None:
                keep.append((end, found))
        return alpha

    def expected(self, chars: np.ndarray, counts: np.ndarray) -> None:
        """Adds how often each piece is used in each place, in expectation over the words' segmentations."""
        kept: list = []
        last = chars.shape[1]
        alpha = self.forward(chars, kept)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for end, found in reversed(kept):
            for start, rows, ids in found:
                at = place(start, end, last)
                through = self.logs[at, ids] + beta[end, rows]
                share = np.exp(alpha[start, rows] + through - alpha[-1, rows])
                counts[at] += np.bincount(ids, share, counts.shape[1])
                beta[start, rows] = np.logaddexp(beta[start, rows], through)

    @staticmethod
    def groups(words: list[bytes]):
        """(places, characters) of words of equal length, in blocks of bounded size."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        edge = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(order)]):
            size = int(sizes[order[a]])
            step = max(1, 400_000 // max(size, 1))
            for at in range(a, b, step):
                places = order[at : min(at + step, b)]
                yield places, np.frombuffer(b"".join(words[i] for i in places), np.uint8).reshape(len(places), size)

    def log_weights(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for places, chars in self.groups(words):
            out[places] = self.forward(chars)[-1]
        return out


def place(start: int, end: int, last: int) -> int:
    """0: the whole word, 1: its first piece, 2: an inner one, 3: its last."""
    return (2 if start else 1) if end < last else (3 if start else 0)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Log probabilities, none zero: a word begins with a whole or a first piece, then come inner ones up to a last."""
    counts = counts + 0.01
    return np.log(counts) - np.log(np.repeat([counts[:2].sum(), counts[2:].sum()], 2))[:, None]


def discounts(n: list[int]) -> list[float]:
    """What to take off counts of 1, 2, and 3 or more, from the numbers of words with counts 1 to 4 (Chen and Goodman)."""
    if min(n) <= 0:
        return [DISCOUNT] * 3
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) for k in (1, 2, 3)]


def chunks(docs: DataFrame, folds: int, k: int) -> DataFrame:
    """Rows of two kinds: a document with its words' numbers, and a word of a chunk with its counts in training texts.

    docs has doc_id, text and comp, the number of its component of the mixture.
    """
    counts = [f"c{i}" for i in range(k)]
    names = ["chunk", "doc_id", "n", "held", "comp", "data", "idx", "word", *counts]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int32(), pa.string(), *[pa.int64()] * k]

    def rows(size, **have):
        return pa.RecordBatch.from_arrays([pa.array(have[n], t) if n in have else pa.nulls(size, t) for n, t in zip(names, kinds)], names)

    class Chunk:
        def __init__(self):
            self.key = uuid.uuid4().int >> 65
            self.known: dict = {}
            self.docs: list[tuple] = []
            self.train: list[list] = [[] for _ in range(k)]
            self.size = 0

        def add(self, doc_id, text, comp):
            raw = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)
            words, known = raw.split(), self.known
            new = [w for w in dict.fromkeys(words) if w not in known]
            known.update(zip(new, range(len(known), len(known) + len(new))))
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            held = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0
            if not held:
                self.train[comp].append(ids.astype(np.int32))
            step = np.diff(np.sort(ids), prepend=0)
            narrow = not len(step) or int(step.max()) < 1 << 16
            self.docs.append((doc_id, len(words), held, comp, step.astype("<u2" if narrow else "<u4").tobytes()))
            self.size += len(raw)

        def out(self):
            for at in range(0, len(self.docs), 2000):
                ids, sizes, held, comp, data = zip(*self.docs[at : at + 2000])
                yield rows(len(ids), chunk=[self.key] * len(ids), doc_id=ids, n=sizes, held=held, comp=comp, data=data)
            size = len(self.known)
            if not size:
                return
            c = [np.bincount(np.concatenate([np.zeros(0, np.int32), *t]), minlength=size) for t in self.train]
            words = pa.array(list(self.known), pa.binary()).cast(pa.string())
            for at in range(0, size, 50_000):
                part = words.slice(at, 50_000)
                upto = at + len(part)
                yield rows(len(part), chunk=np.full(len(part), self.key), idx=np.arange(at, upto, dtype=np.int32), word=part, **{n: x[at:upto] for n, x in zip(counts, c)})

    def run(batches):
        now = Chunk()
        for batch in batches:
            for doc_id, text, comp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                now.add(doc_id, text.as_py(), comp)
                if now.size >= CHUNK:
                    yield from now.out()
                    now = Chunk()
        yield from now.out()

    schema = "chunk long, doc_id long, n long, held boolean, comp int, data binary, idx int, word string, " + ", ".join(f"{n} long" for n in counts)
    return docs.select("doc_id", "text", "comp").mapInArrow(run, schema)


def score_documents(docs: DataFrame, folds: int = FOLDS, rounds: int = ROUNDS, path: str | None = None) -> DataFrame:
    """doc_id, text, lang -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    langs = [r.lang for r in docs.filter("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(COMPONENTS - 1).collect()]
    k = len(langs) + 1
    comp = F.lit(k - 1)
    for i, lang in enumerate(langs):
        comp = F.when(F.col("lang") == lang, F.lit(i)).otherwise(comp)
    names = [f"c{i}" for i in range(k)]
    seen = materialize(chunks(docs.select("doc_id", "text", F.coalesce(comp, F.lit(k - 1)).alias("comp")), folds, k), "lattice-chunks")
    asked = seen.filter("word IS NOT NULL").select(F.col("chunk").alias("list"), "idx", "word", *names)
    texts = seen.filter("n IS NOT NULL").select("chunk", "doc_id", "n", "held", "comp", "data")
    words = asked.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    words = materialize(words.withColumn("c", sum((F.col(n) for n in names), F.lit(0).cast("long"))), "lattice-words")

    facts = []
    for n in ["c", *names]:
        facts += [F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_n"), F.count(F.when(F.col(n) > 0, 1)).alias(f"{n}_v")]
        facts += [F.count(F.when(F.col(n) == i, 1)).alias(f"{n}_{i}") for i in (1, 2, 3, 4)]
    facts = words.agg(*facts).first()
    ends = {r.comp: r["count"] for r in texts.filter("NOT held").groupBy("comp").count().collect()}  # a row for each component
    n_docs = sum(ends.values())

    class Level:
        """Discounted frequencies of one component, or of all."""

        def __init__(self, name: str, n_ends: int):
            n1, n2 = facts[f"{name}_1"], facts[f"{name}_2"]
            self.off = np.array([0.0, *discounts([facts[f"{name}_{i}"] for i in (1, 2, 3, 4)])])
            self.size = facts[f"{name}_n"] + n_ends + 1
            self.rest = float(self.off[1] * n1 + self.off[2] * n2 + self.off[3] * (facts[f"{name}_v"] - n1 - n2)) / self.size
            self.ends = n_ends

        def seen(self, c: np.ndarray) -> np.ndarray:
            return (c - self.off[np.minimum(c, 3)]) / self.size

    every = Level("c", n_docs)
    parts = [Level(n, ends.get(i, 0)) for i, n in enumerate(names)]
    n_train, kinds = facts["c_n"] + n_docs, facts["c_v"] + (n_docs > 0)

    pieces, first = vocabulary(path)
    logs = normalised(np.exp(first - np.logaddexp.reduce(first))[None, :] * len(pieces) * np.array([[0.2], [0.8], [0.5], [0.5]]))
    for _ in range(rounds if facts["c_v"] else 0):
        model = spark.sparkContext.broadcast((pieces, logs))  # as large as the vocabulary

        def count(frames, model=model):
            own = Lattice(*model.value)
            counts = np.zeros(model.value[1].shape)
            for frame in frames:
                for _, chars in Lattice.groups([w.encode() for w in frame["word"]]):
                    own.expected(chars, counts)
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"piece": at.astype(np.int32), "used": counts.ravel()[at]})

        used = words.filter("c > 0").select("word").mapInPandas(count, "piece int, used double").groupBy("piece").agg(F.sum("used").alias("used"))
        counts = np.zeros(logs.size)
        for r in used.collect():  # at most four rows for each piece
            counts[r.piece] = r.used
        logs = normalised(counts.reshape(logs.shape))

    # half a count each goes to an unseen word and to the end, so neither is ever impossible
    p_end = (every.ends + 0.5) / every.size
    ends_log = np.log([(part.ends + (part.rest * part.size + 1) * p_end) / part.size for part in parts])
    prior = np.log([(part.ends + 0.5) / (n_docs + 0.5 * k) for part in parts])
    model = spark.sparkContext.broadcast((pieces, logs))
    ps = [f"p{i}" for i in range(k)]

    def weigh(frames):
        own = Lattice(*model.value)
        for frame in frames:
            sub = own.log_weights([w.encode() for w in frame["word"]])
            with np.errstate(divide="ignore"):
                whole = np.logaddexp(np.log(every.seen(frame["c"].to_numpy())), math.log(every.rest + 0.5 / every.size) + sub)
                for part, n, p in zip(parts, names, ps):
                    frame[p] = np.logaddexp(np.log(part.seen(frame[n].to_numpy())), math.log(part.rest + 1 / part.size) + whole)
            yield frame[["word", "c", *ps]]

    weighed = words.mapInPandas(weigh, "word string, c long, " + ", ".join(f"{p} double" for p in ps))
    answers = asked.select("list", "idx", "word").join(weighed, "word").select("list", "idx", "c", *ps)
    below = n_train + 0.1 * (kinds + 1)

    def base(c):
        return np.log10((c + 0.1) / below)

    def give(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        size = int(right["idx"].max()) + 1 if len(right) else 0
        p, b, known = np.zeros((size, k)), np.zeros(size), np.zeros(size, np.int64)
        at = right["idx"].to_numpy()
        if size:
            p[at], b[at], known[at] = right[ps].to_numpy(), base(right["c"].to_numpy()), right["c"].to_numpy() > 0
        out = []
        for n, data in zip(left["n"], left["data"]):
            ids = np.cumsum(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64))
            out.append((int(known[ids].sum()), float(b[ids].sum()), float(np.logaddexp.reduce(p[ids].sum(axis=0) + ends_log + prior)) / math.log(10)))
        n_known, bases, scores = zip(*out)
        end = int(n_docs > 0)
        return pd.DataFrame({"doc_id": left["doc_id"].astype("Int64"), "held_out": left["held"].astype(bool), "n_tokens": left["n"] + 1, "n_known": np.array(n_known, np.int64) + end, "train_tokens": np.full(len(left), n_train, np.int64), "base_score": np.array(bases, float) + float(base(n_docs)), "score": np.array(scores, float)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("chunk").cogroup(answers.groupBy("list")).applyInPandas(give, schema)


def op2_lattice(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the lattice model, and under additive smoothing of whole tokens."""
    return score_documents(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string", lang="string"))
