"""Toxicity by a weighted finite-state pattern grammar.

Five machines read a clause word by word. Each is a weighted finite-state transducer that rewrites one kind of letter and
hands on the rest: threats (an intent, a harm and a target become a threat), reported speech, negation, and the target,
which works from both sides and so is a pair of machines, one for each direction. compose() makes one machine of those
that read forward; the lexicon before them turns words into letters: learned insults, seeded harms, intents, targets,
negations and verbs of report. What comes out are weighted events: a plain insult, one aimed at a target, one negated,
one reported, a threat. The events' weights are fitted on the same rows as the insults, so a score is that of matched
clauses, not of words alone.

A stem that ordinary words share by chance acts from the second of its words on.

Defined results: null or empty text has no event and gets the base score; a text of any length is scanned whole; rows
without a label, and labels without a document, teach nothing; of several labels of one document the largest counts; of
several stems at one place the longest counts, and of equal scores neither goes first, as nothing is ordered; repeated
rows are scored each; columns of other names are ignored; without training rows of both kinds only the seeds act; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, materialize, pick, release

#: Most labelled training rows the classifier is fitted on: those of the smallest hashes of doc_id.
MOST_ROWS = 20_000
#: Tasks that read the sample.
PARTS = 48
#: Clean texts a stem may be in, as a share of the toxic texts it is in; how much likelier it must be in a toxic text.
MIXED, LEAD = 0.25, 25
#: The same share for stems beyond the cover.
PURE = 0.02
#: Share of toxic texts that a stem beyond the cover must be in.
COMMON = 0.02
#: Prefix lengths that may become a stem.
STEMS = (4, 5, 6, 7)
#: Fixed seed words of the grammar, lower case, in English, German, French and Spanish.
INTENTS = frozenset("will gonna going shall werde wird vais vas va voy vas".split())
HARMS = frozenset("kill hurt murder shoot stab töte töten umbringen verletzen erschieße tuer tuerai frapper matar mataré herir".split())
#: Threats of several words that the machine of intent, harm and target does not read.
THREATS = ("i will find you", "you will die", "bring dich um", "mach dich fertig")
TARGETS = frozenset("you your yours u he they him her them du dich dir dein ihr euch sie tu te toi ton vous votre tú ti tus usted ustedes él ella".split())
NEGATIONS = frozenset("not no never nobody isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says say told called calls wrote quoted sagt sagte nannte schrieb dit disait appelle écrit dice dijo llamó escribió".split())
#: Letters that the lexicon gives to words, and those that the machines write.
OTHER, INSULT, INTENT, HARM, TARGET, NEGATION, REPORT, AIMED, NEGATED, REPORTED, THREAT = range(11)
#: Events of a clause, and the letter of each.
EVENTS = ("plain", "aimed", "negated", "reported", "threat")
EVENT_OF = {INSULT: 0, AIMED: 1, NEGATED: 2, REPORTED: 3, THREAT: 4}
#: Words that a negation, a target or an intent reaches over.
REACH = 3

CLAUSE = re.compile(r"[.!?;\n]+")
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Machine:
    """A weighted finite-state transducer that reads and writes a letter a step.

    arcs: (state, letter) -> (next state, letter written, weight); a letter without an arc is written as it came and
    leads to the state that otherwise has for this one. States are any hashable values.
    """

    def __init__(self, start, arcs: dict, otherwise: dict):
        self.start, self.arcs, self.otherwise = start, arcs, otherwise

    def step(self, state, letter: int):
        return self.arcs.get((state, letter)) or (self.otherwise[state], letter, 0.0)

    def run(self, letters: list[int]) -> tuple[list[int], list[float]]:
        """Letters written, and the weight of each step."""
        state, out, weights = self.start, [], []
        for x in letters:
            state, y, w = self.step(state, x)
            out.append(y)
            weights.append(w)
        return out, weights


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that does in one step what first and then second do: states are pairs, weights add up."""
    start = (first.start, second.start)
    arcs, otherwise, open_, seen = {}, {}, [start], {start}
    while open_:
        a, b = state = open_.pop()
        for x in range(THREAT + 1):
            na, y, w1 = first.step(a, x)
            nb, z, w2 = second.step(b, y)
            arcs[state, x] = ((na, nb), z, w1 + w2)
            if (na, nb) not in seen:
                seen.add((na, nb))
                open_.append((na, nb))
        otherwise[state] = state  # never asked for: there is an arc for each letter
    return Machine(start, arcs, otherwise)


def counter(letter: int, rewrite: dict[int, tuple[int, float]]) -> Machine:
    """After letter, the letters of rewrite become others for the next REACH words."""
    arcs = {(k, letter): (REACH, letter, 0.0) for k in range(REACH + 1)}
    for k in range(1, REACH + 1):
        arcs |= {(k, x): (k - 1, y, w) for x, (y, w) in rewrite.items()}
    return Machine(0, arcs, {k: max(0, k - 1) for k in range(REACH + 1)})


def machines() -> dict[str, Machine]:
    """By name; all but target_after read forward, in this order. A weight is added to the log of a match's own."""
    # an intent, within reach a harm, within reach a target: the target's step writes the threat
    states = [("", 0)] + [(kind, k) for kind in ("i", "h") for k in range(1, REACH + 1)]
    arcs = {(s, INTENT): (("i", REACH), INTENT, 0.0) for s in states}
    arcs |= {(("i", k), HARM): (("h", REACH), HARM, 0.0) for k in range(1, REACH + 1)}
    arcs |= {(("h", k), TARGET): (("", 0), THREAT, 0.0) for k in range(1, REACH + 1)}
    threat = Machine(("", 0), arcs, {s: (s[0], s[1] - 1) if s[1] > 1 else ("", 0) for s in states})
    report = Machine(0, {(0, REPORT): (1, REPORT, 0.0), (1, INSULT): (1, REPORTED, 0.0), (1, THREAT): (1, REPORTED, 0.0)}, {0: 0, 1: 1})
    negation = counter(NEGATION, {INSULT: (NEGATED, 0.0), THREAT: (NEGATED, 0.0)})
    target = counter(TARGET, {INSULT: (AIMED, 0.0)})
    return {"threat": threat, "report": report, "negation": negation, "target_before": target, "target_after": target}


FORWARD = ("threat", "report", "negation", "target_before")


class Grammar:
    """Machines over clauses; stems of insults are (text, kind, weight); kinds: word, prefix, again. without: machines left out.

    A stem of kind again is a prefix that is no insult until a text has two different words with it.
    """

    def __init__(self, stems: list[tuple[str, str, float]], weights: list[float] | None = None, bias: float = -4.0, without: tuple[str, ...] = ()):
        self.stems, self.bias = stems, bias
        self.weights = weights or [1.0, 1.2, 0.6, 0.5, 3.0]
        self.scan = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for stem, kind, weight in stems:
            entries.setdefault(stem, []).append((INSULT, kind, weight))
        for phrase in THREATS:
            entries.setdefault(phrase, []).append((THREAT, "word", 1.0))
        for word in sorted(HARMS):  # a clause without insult or harm has no event, so only these are searched for
            entries.setdefault(word, []).append((HARM, "word", 1.0))
        for stem, kinds in entries.items():
            self.scan.add_word(stem, (len(stem), kinds))
        self.scan.make_automaton()
        every = machines()
        chosen = [every[n] for n in FORWARD if n not in without] or [Machine(0, {}, {0: 0})]
        self.forward = chosen[0]
        for machine in chosen[1:]:
            self.forward = compose(self.forward, machine)
        self.backward = None if "target_after" in without else every["target_after"]

    def matches(self, low: str) -> list[tuple[int, int, int, float]]:
        """(start, end, letter, weight) of the longest match at each start; a match begins and, if whole, ends a word."""
        best: dict[int, tuple[int, int, int, float]] = {}
        shared: dict[str, list[tuple[int, int, int, float]]] = {}
        n = len(low)
        for last, (size, kinds) in self.scan.iter(low):
            start = last - size + 1
            if start and low[start - 1].isalpha():
                continue
            ends = last + 1 == n or not low[last + 1].isalpha()
            for letter, kind, weight in kinds:
                if kind == "again":
                    shared.setdefault(low[start : last + 1], []).append((start, last + 1, letter, weight))
                elif (ends or kind == "prefix") and (start not in best or best[start][1] <= last + 1):
                    best[start] = (start, last + 1, letter, weight)
        for found in shared.values():
            words: set[str] = set()
            for hit in found:
                word = LETTERS.match(low, hit[0])
                new = word is not None and word.group() not in words
                if new:
                    if words and hit[0] not in best:
                        best[hit[0]] = hit
                    words.add(word.group())
        return [best[k] for k in sorted(best)]

    def events(self, text: str | None) -> np.ndarray:
        """Summed weight of each event over the matched clauses."""
        out = np.zeros(len(EVENTS))
        low = (text or "").lower()
        found = self.matches(low)
        if not found:
            return out
        k = 0
        while k < len(found):
            start = found[k][0]
            left = max((low.rfind(c, 0, start) for c in ".!?;\n"), default=-1) + 1
            right = CLAUSE.search(low, found[k][1])
            right = right.start() if right else len(low)
            clause = []
            while k < len(found) and found[k][0] < right:
                clause.append(found[k])
                k += 1
            self.transduce(low, left, right, clause, out)
        return out

    def letters(self, low: str, left: int, right: int, found: list) -> tuple[list[int], list[float]]:
        """A clause's words as letters, and the weight of each."""
        hits = {m[0]: m for m in found}
        out, weights, upto = [], [], left
        for m in LETTERS.finditer(low, left, right):
            word, start = m.group(), m.start()
            hit = hits.get(start)
            if hit:
                out.append(hit[2])
                weights.append(hit[3])
                upto = hit[1]
            elif start >= upto:  # not inside a match of several words
                kind = NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else INTENT if word in INTENTS else OTHER
                out.append(kind)
                weights.append(1.0)
        return out, weights

    def transduce(self, low: str, left: int, right: int, found: list, out: np.ndarray) -> None:
        """One clause through the composed machine, then through the one that reads backward; events add up in out."""
        letters, weights = self.letters(low, left, right, found)
        letters, extra = self.forward.run(letters)
        if self.backward is not None:
            back, more = self.backward.run(letters[::-1])
            letters, extra = back[::-1], [a + b for a, b in zip(extra, more[::-1])]
        for letter, w, x in zip(letters, weights, extra):
            if letter in EVENT_OF:
                out[EVENT_OF[letter]] += w * math.exp(x)

    def score(self, text: str | None) -> float:
        x = self.bias + float(np.dot(np.log1p(self.events(text)), self.weights))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def features(words: str) -> set[str]:
    """Of a text's distinct words: the words, with a space behind, their prefixes, and with a plus those of two words."""
    out = set()
    for w in words.split(" "):
        n = len(w)
        if n > 2:
            out.add(f"{w} ")
            for k in STEMS:
                if n <= k:
                    break
                stem = w[:k]
                if stem in out:
                    out.add(f"{stem}+")
                else:
                    out.add(stem)
    return out


def sign_of(text: str) -> int:
    """The smallest hash of a text's runs of five words, which near copies share."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))), default=0)


def signatures(words: list[str], signs: list[int], wanted: set[str]) -> dict[str, set[int]]:
    out: dict[str, set[int]] = {}
    for own, sign in zip(words, signs):
        for f in features(own) & wanted:
            out.setdefault(f, set()).add(sign)
    return out


def unlike(feature: str, words: list[str], signs: list[int], most: int = 12) -> bool:
    """Do texts with the feature differ in most of their words? Near copies share theirs by descent."""
    stem = feature.strip(" +")
    having = {sign: own for own, sign in zip(words, signs) if stem in own and feature in features(own)}
    picked = [having[k] for k in sorted(having)]
    picked = [set(own.split(" ")) for own in picked[:: max(1, len(picked) // most)]]
    pairs = sorted(len(a & b) / max(1, len(a | b)) for i, a in enumerate(picked) for b in picked[:i])
    return bool(pairs) and pairs[len(pairs) // 2] <= 0.5


def record(text: str | None) -> tuple[int, int, str]:
    """What learning needs of a text: its hash, its sign, its distinct words."""
    raw = text or ""
    digest = hashlib.blake2b(raw.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True), sign_of(raw), " ".join(sorted(set(words_of(raw))))


def learn_stems(records: list[tuple[int, int, str, int]]) -> list[tuple[str, str, float]]:
    """Words and word prefixes that mark toxic texts; a record and its label for each text.

    A feature counts once for each signature, which near copies mostly share, so that a group of copies cannot vouch for a
    word of its own. First a greedy cover of the toxic texts by features that few clean texts have, then all features that
    are common among them and whose lead over the base rate is beyond chance.
    """
    kept: dict[int, tuple[int, str, int]] = {}
    for key, sign, words, toxic in records:
        kept[key] = (sign, words, max(toxic, kept[key][2] if key in kept else 0))
    kinds = [[(sign, words) for _, (sign, words, toxic) in sorted(kept.items()) if toxic == kind] for kind in (1, 0)]
    if not all(kinds):
        return []
    signs = [[sign for sign, _ in kinds[0]], list(range(len(kinds[1])))]  # each clean text speaks against a feature
    bad, fine = [[words for _, words in k] for k in kinds]
    shared = Counter(f for own in bad for f in features(own))
    often = {f for f, n in shared.items() if n > 1}
    # most candidates go by one look at how many clean texts have them; signatures are gathered for the rest alone
    clean = Counter(f for own in fine for f in features(own) & often)
    often = {f for f in often if clean[f] <= max(2, 0.3 * shared[f])}
    pos, seen = signatures(bad, signs[0], often), signatures(fine, signs[1], often)
    n_pos, n_neg = len(set(signs[0])), len(set(signs[1]))
    neg = Counter({f: len(s) for f, s in seen.items()})
    rate = n_pos / (n_pos + n_neg)

    def weight(f) -> float:
        return math.log((len(pos[f]) + 0.5) / (n_pos + 1)) - math.log((neg[f] + 0.5) / (n_neg + 1))

    def pure(f) -> bool:
        p = len(pos[f])
        return p >= 2 and neg[f] <= MIXED * p and neg[f] * n_pos * LEAD <= p * n_neg

    good = [f for f in pos if pure(f)]
    chosen: dict = {}
    open_ = set(signs[0])
    # a feature's gain only falls while the cover grows, so the best is known once its renewed gain still leads
    heap = [(2 * neg[f] - len(pos[f]), f[-1] == " ", -len(f), f) for f in good]
    heapq.heapify(heap)
    while open_ and heap:
        _, word, size, f = heap[0]
        gain = len(pos[f] & open_) - 2 * neg[f]
        if heap[0][0] != -gain:
            heapq.heapreplace(heap, (-gain, word, size, f))
            continue
        if gain < max(2, 0.002 * n_pos):
            break
        heapq.heappop(heap)
        chosen[f] = weight(f)
        open_ -= pos[f]
    # as many features as there are may each be pure by chance; ask for less than one such in a thousand
    least = math.ceil(math.log(max(len(pos), 1) * 1000) / -math.log(max(rate, 1e-6)) if rate < 1 else 10**9)
    beyond = {f for f in good if f not in chosen and len(pos[f]) >= max(4, least, COMMON * n_pos) and neg[f] <= PURE * len(pos[f])}
    for f in sorted(beyond, key=lambda f: (len(f), f)):
        if not any(f[:k] in chosen or f"{f[:k]}+" in chosen for k in range(1, len(f))) and unlike(f, bad, signs[0]):
            chosen[f] = weight(f)
    # a prefix that nearly always goes on in one way is that longer prefix or word
    for f in [f for f in chosen if f[-1] != " "]:
        again = f[-1] == "+"
        longer = [g for g in pos if (g[-1] == "+") == again and g.startswith(f.rstrip("+")) and len(pos[g]) >= 0.98 * len(pos[f]) and neg[g] <= neg[f]]
        best = max(longer, key=lambda g: (len(g), g))
        if best != f:
            del chosen[f]
            chosen[best] = weight(best)
    # a longer feature under a chosen prefix that says as much adds nothing; one word of a shared stem says nothing
    prefixes = {f: w for f, w in chosen.items() if f[-1] not in " +"}
    prefixes |= {f[:-1]: 99.0 for f in chosen if f[-1] == "+"}
    kinds_of = {" ": "word", "+": "again"}
    out = [(f.rstrip(" +"), kinds_of.get(f[-1], "prefix"), w) for f, w in chosen.items() if not any(prefixes.get(f[:k], -9.0) >= w - 0.7 for k in range(1, len(f) - (f[-1] == "+")))]
    return sorted(out)


def fit(rows: list[tuple[str | None, int]]) -> Grammar:
    """The grammar learned from texts and their labels."""
    grammar = Grammar(learn_stems([(*record(t), y) for t, y in rows]))
    return weighted(grammar, np.array([grammar.events(t) for t, _ in rows]).reshape(-1, len(EVENTS)), np.array([y for _, y in rows], dtype=float))


def weighted(grammar: Grammar, events: np.ndarray, y: np.ndarray) -> Grammar:
    """The grammar with its events' weights by penalised logistic regression."""
    n_pos = y.sum()
    if not 0 < n_pos < len(y):
        return grammar
    x = np.hstack([np.log1p(events), np.ones((len(y), 1))])
    prior = np.array([*grammar.weights, 0.0])  # what is seldom seen stays near its seed weight
    pull = np.array([0.05] * len(EVENTS) + [1e-3])
    beta = prior.copy()
    beta[-1] = math.log((n_pos + 1) / (len(y) - n_pos + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (p - y) + pull * (beta - prior)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), grad)
        size = float(np.abs(step).max())
        beta -= step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    beta[: len(EVENTS)] = np.maximum(beta[: len(EVENTS)], 0.0)
    return Grammar(grammar.stems, beta[: len(EVENTS)].tolist(), float(beta[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = MOST_ROWS) -> DataFrame:
    """text, toxic of at most `most` labelled documents outside the held-out fold, by hash of doc_id: a bounded sample."""
    ids = pick(labels, doc_id="long", toxic="int").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    ids = ids.filter(F.pmod(crc("doc_id"), F.lit(folds)) != 0).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    wanted = ids.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(most)
    found = pick(docs, doc_id="long", text="string").join(F.broadcast(wanted), "doc_id")  # at most `most` rows of two numbers
    return found.select("text", "toxic")


def learned(rows: DataFrame) -> Grammar:
    """The grammar learned from text, toxic. Texts stay with the tasks: the driver gets their records and their events."""
    rows = materialize(rows.repartition(PARTS), "toxicity-sample")

    def records(batches):
        for batch in batches:
            found = [record(t.as_py()) for t in batch.column(0)]
            key, sign, words = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sign, pa.int64()), pa.array(words, pa.string()), batch.column(1)], ["key", "sign", "words", "toxic"])

    kind = "key long, sign long, words string, toxic int"
    grammar = Grammar(learn_stems([tuple(r) for r in rows.mapInArrow(records, kind).collect()]))  # of MOST_ROWS rows
    stems = rows.sparkSession.sparkContext.broadcast(grammar.stems)

    def events(batches):
        own = Grammar(stems.value)
        for batch in batches:
            found = [own.events(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["events", "toxic"])

    found = rows.mapInArrow(events, "events array<double>, toxic int").collect()  # of MOST_ROWS rows
    release(rows)
    return weighted(grammar, np.array([r.events for r in found]).reshape(-1, len(EVENTS)), np.array([r.toxic for r in found], dtype=float))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, text -> doc_id, score."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((grammar.stems, grammar.weights, grammar.bias))  # bounded by MOST_ROWS

    def run(batches):
        own = Grammar(*model.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MOST_ROWS) -> DataFrame:
    """docs without the rows whose score is threshold or more; columns as they came."""
    names = docs.columns
    grammar = learned(training_rows(docs, labels, most=most))
    model = docs.sparkSession.sparkContext.broadcast((grammar.stems, grammar.weights, grammar.bias))
    at = names.index("text") if "text" in names else [n.lower() for n in names].index("text")

    def run(batches):
        own = Grammar(*model.value)
        for batch in batches:
            keep = [own.score(t.as_py()) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return inner.mapInArrow(run, inner.schema).toDF(*names)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from the labelled rows outside the held-out fifth."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, learned(training_rows(docs, labels)))
    held = (F.pmod(crc("doc_id"), F.lit(5)) == 0).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
