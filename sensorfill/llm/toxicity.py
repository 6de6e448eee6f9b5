"""Toxicity by a weighted grammar of finite-state transducers.

A lexical transducer turns the words of a clause into classes: insult, threat, target,
intent, negation, reported speech. Scope transducers, composed into one machine, then
mark insults and threats that are negated, reported, intended or aimed at somebody. A
document is scored by its matched clauses, not by single words: the same insult counts
by the kind of clause in which it stands.

The insults and their weights are learned from labelled texts, as words and word
beginnings that are far more frequent in toxic texts; so are the weights of the kinds of
clauses. The learning sample is bounded by ``max_train``; nothing else is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorfill.llm.common import stored

#: Labelled documents used for learning, at most (about; a hash decides).
MAX_TRAIN = 20_000
#: A beginning of a word counts as a candidate from so many toxic training texts on.
MIN_TEXTS = 3
#: Word beginnings of these lengths are candidates, besides whole words.
PREFIXES = range(3, 11)

INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT = 1, 2, 4, 8, 16, 32
AIMED, INTENDED, NEGATED, REPORTED = 64, 128, 256, 512

# Fixed words of the classes, in English, German, French and Spanish.
TARGETS = """you your yours he she they him her them people everyone this these those
    du dich dir ihr euch sie er dieser diese dieses tu te toi vous il elle ils elles ce cet cette
    tú usted ustedes vosotros él ella ellos ellas este esta estos estas""".split()
INTENTS = "will gonna shall must should going werde werden wird vais va vamos voy".split()
NEGATIONS = """not no never nobody none neither nor cannot don isn aren wasn nicht kein keine nie
    niemals pas jamais aucun ne ni nunca jamás tampoco""".split()
REPORTS = """said says say saying called calls claimed claims wrote writes reported quoted
    allegedly sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió""".split()
THREATS = """kill killing hurt murder strangle stab shoot
    töten umbringen erschießen tuer frapper matar golpear""".split()
THREAT_WEIGHT = 2.0

#: A class word's mark reaches so many words on.
REACH = {AIMED: 6, INTENDED: 4, NEGATED: 4, REPORTED: 12}

#: Kinds of matched clauses and what they weigh before anything is learned.
KINDS = {
    "insult": 1.0,
    "aimed insult": 1.2,
    "reported insult": 0.4,
    "negated insult": 0.3,
    "threat": 0.3,
    "aimed or intended threat": 1.0,
    "reported threat": 0.2,
    "negated threat": 0.1,
}
BIAS = -3.0

CLAUSE = re.compile(r"[^.!?;\n]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Scope:
    """A transducer: after a symbol of class ``opener``, insults and threats within
    ``reach`` symbols get ``mark``. Its state is how many symbols it still reaches."""

    opener: int
    mark: int
    reach: int

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        if symbol & self.opener:
            return self.reach, symbol
        if state and symbol & (INSULT | THREAT):
            symbol |= self.mark
        return max(0, state - 1), symbol


class Composed:
    """Transducers one after another, as one machine; its arcs are made when first used."""

    def __init__(self, *parts: Scope):
        self.parts, self.arcs = parts, {}

    def _arc(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
        after = []
        for part, s in zip(self.parts, state):
            s, symbol = part.step(s, symbol)
            after.append(s)
        return tuple(after), symbol

    def run(self, symbols: Iterable[int]) -> list[int]:
        state, out = (0,) * len(self.parts), []
        for symbol in symbols:
            arc = self.arcs.get((state, symbol))
            if arc is None:
                arc = self.arcs[state, symbol] = self._arc(state, symbol)
            state, marked = arc
            out.append(marked)
        return out


def kind_of(symbol: int) -> int:
    """The number of the kind of clause that a marked symbol stands for."""
    threat = 4 * bool(symbol & THREAT)
    if symbol & NEGATED:
        return threat + 3
    if symbol & REPORTED:
        return threat + 2
    return threat + bool(symbol & (AIMED | INTENDED if threat else AIMED))


class Grammar:
    """The lexicon and the machines; made once per task from a plain table."""

    def __init__(self, insults: dict[str, float]):
        """``insults``: weight by beginning of a word, or by whole word with ``$``."""
        import ahocorasick

        self.weight = dict(insults)
        self.longest = max((len(x) for x in insults), default=0)
        self.classes = {
            w: c
            for c, words in (
                (TARGET, TARGETS),
                (INTENT, INTENTS),
                (NEGATION, NEGATIONS),
                (REPORT, [*REPORTS, *'"“”„«»']),
                (THREAT, THREATS),
            )
            for w in words
        }
        self.finder = ahocorasick.Automaton()
        for x in [*(x.rstrip("$") for x in insults), *THREATS]:
            self.finder.add_word(x, len(x))
        self.finder.make_automaton()
        self.forward = Composed(
            Scope(NEGATION, NEGATED, REACH[NEGATED]),
            Scope(REPORT, REPORTED, REACH[REPORTED]),
            Scope(INTENT, INTENDED, REACH[INTENDED]),
            Scope(TARGET, AIMED, REACH[AIMED]),
        )
        self.backward = Composed(Scope(TARGET, AIMED, REACH[AIMED]))

    def insult(self, word: str) -> float:
        """The lexical transducer's weight of a word as an insult; 0 if it is none."""
        whole = self.weight.get(word + "$", 0.0)
        starts = [self.weight.get(word[:n], 0.0) for n in range(1, min(len(word), self.longest) + 1)]
        return max(whole, *starts) if starts else whole

    def clause(self, clause: str, found: np.ndarray) -> None:
        """Add the weights of a clause's matches to ``found``, by kind."""
        tokens = TOKEN.findall(clause)
        weights = [self.insult(t) for t in tokens]
        symbols = [INSULT if w else self.classes.get(t, 0) for t, w in zip(tokens, weights)]
        marked = self.backward.run(self.forward.run(symbols)[::-1])[::-1]
        for symbol, weight in zip(marked, weights):
            if symbol & (INSULT | THREAT):
                found[kind_of(symbol)] += weight or THREAT_WEIGHT

    def features(self, text: str) -> np.ndarray:
        """Weight found in each kind of clause, of a whole text, on a log scale."""
        low, found = text.lower(), np.zeros(len(KINDS))
        if len(self.finder) and low:
            # Clauses without any lexicon entry cannot match and are not parsed.
            hits = [
                end
                for end, size in self.finder.iter(low)
                if end < size or not low[end - size].isalpha()
            ]
            at = 0
            if hits:
                for m in CLAUSE.finditer(low):
                    while at < len(hits) and hits[at] < m.start():
                        at += 1
                    if at == len(hits):
                        break
                    if hits[at] < m.end():
                        self.clause(m.group(), found)
        return np.log1p(found)


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    weights: tuple[float, ...]  # one for each kind, then the bias

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5. A null id
    is not held out (and has no label to learn from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of labelled rows that are not held out, about ``max_train`` at most;
    of near copies with the same label one stays."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    # The labels used are bounded by max_train, so they may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    signed = stored(rows.mapInArrow(_sign, "text string, toxic boolean, s0 long, s1 long, s2 long"), "train")
    # The least of each group stays, not the first: rows have no order.
    least = F.min(F.struct(F.xxhash64("text").alias("at"), "text", "s0", "s1", "s2")).alias("row")
    for sign in ("s0", "s1", "s2"):
        signed = signed.groupBy("toxic", F.col(sign).alias("of")).agg(least).select("toxic", "row.*")
    return stored(signed.select("text", "toxic"), "train")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three signatures of each text, its least hashes of three words in a row: copies
    share them, and near copies most. Many copies would pass for evidence."""
    odd = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    for batch in batches:
        signs = [[], [], []]
        for text in batch.column(0).to_pylist():
            words = (text or "").lower().encode().split()
            hashes = np.fromiter(
                (xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))),
                dtype=np.uint64,
            )
            for sign, x in zip(signs, odd):
                sign.append((hashes * x).min())
        columns = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in signs]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["text", "toxic", "s0", "s1", "s2"])


def _beginnings(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in PREFIXES if n <= len(w))
    return out


def _count(rows: DataFrame, only: frozenset[str] | None) -> dict[str, int]:
    """Texts that have each beginning of a word; of the candidates ``only``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for text in batch.column(0).to_pylist():
                found = _beginnings(text or "")
                seen.update(found if only is None else found & only)
            yield pa.RecordBatch.from_pydict(
                {"start": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())}
            )

    counts = rows.select("text").mapInArrow(run, "start string, n long").groupBy("start").agg(F.sum("n").alias("n"))
    # Both calls are on the bounded sample; candidates are those frequent in toxic texts.
    return {r.start: r.n for r in counts.where(F.col("n") >= (MIN_TEXTS if only is None else 1)).collect()}


def _evidence(a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Likelihood ratio statistic of being in ``a`` toxic and ``b`` clean texts; 0 where
    that speaks for clean."""
    p, q = a / n_toxic, b / n_clean
    both = (a + b) / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(a > 0, a * np.log(p / both), 0) + np.where(b > 0, b * np.log(q / both), 0))
    return np.where(p > 8 * q, ratio, 0.0)


def _holders(rows: DataFrame, starts: list[str]) -> list[list[int]]:
    """For each toxic text of the bounded sample, the candidates it has."""
    place = {x: i for i, x in enumerate(starts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [place[x] for x in _beginnings(text or "") if x in place]
                for text in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["held"])

    return [r.held for r in rows.select("text").mapInArrow(run, "held array<int>").collect()]


def choose_insults(
    starts: list[str], clean: dict[str, int], held: list[list[int]], n_clean: int, need: float
) -> dict[str, float]:
    """Beginnings of words that mark toxic texts, with their log odds.

    They are taken by their evidence, of equals the longest. Longer forms of one taken
    say nothing more. A shorter form must have enough evidence in the texts that its
    longer forms do not have.
    """
    n_toxic = len(held)
    texts_of: dict[int, set[int]] = {}
    for i, found in enumerate(held):
        for x in found:
            texts_of.setdefault(x, set()).add(i)

    def evidence(a, b):
        return float(_evidence(np.array([a]), np.array([b]), n_toxic, n_clean)[0])

    ranked = []
    for i, x in enumerate(starts):
        # A whole word counts as shorter than the beginning with the same letters.
        size = len(x) - 1.5 if x.endswith("$") else len(x)
        ratio = evidence(len(texts_of.get(i, ())), clean.get(x, 0))
        ranked.append((-round(ratio, 6), -size, x, i))
    chosen: dict[str, int] = {}
    for _, _, x, i in sorted(ranked):
        stem = x.rstrip("$")
        if any(stem.startswith(c) for c in chosen if not c.endswith("$")) or stem + "$" in chosen:
            continue
        longer = [j for c, j in chosen.items() if c.startswith(stem)]
        new = texts_of.get(i, set()).difference(*(texts_of[j] for j in longer))
        if evidence(len(new), clean.get(x, 0)) >= need:
            chosen[x] = i
    odds = {
        x: math.log((len(texts_of[i]) + 0.5) / (n_toxic + 1))
        - math.log((clean.get(x, 0) + 0.5) / (n_clean + 1))
        for x, i in chosen.items()
    }
    return {x: max(1.0, min(v, 6.0)) for x, v in odds.items()}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, drawn towards the weights of ``KINDS``."""
    prior = np.array([*KINDS.values(), BIAS])
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def _with_features(insults: dict[str, float]):
    def features(texts: pa.Array, grammar: Grammar) -> np.ndarray:
        rows = [grammar.features(t or "") for t in texts.to_pylist()]
        return np.array(rows).reshape(len(rows), len(KINDS))

    return features, insults


def learn(train: DataFrame) -> Model:
    """The model from (text, toxic) rows. Without labels of both kinds it has no insults."""
    toxic_rows, clean_rows = train.where("toxic"), train.where("not toxic")
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    insults: dict[str, float] = {}
    if n.get(True) and n.get(False):
        toxic = _count(toxic_rows, None)
        clean = _count(clean_rows, frozenset(toxic))
        # The level of the test allows for the number of candidates.
        need = 2 * math.log(max(len(toxic), 1))
        a = np.array(list(toxic.values()))
        b = np.array([clean.get(x, 0) for x in toxic])
        marks = _evidence(a, b, n[True], n[False]) >= need
        starts = [x for x, m in zip(toxic, marks) if m]
        insults = choose_insults(starts, clean, _holders(toxic_rows, starts), n[False], need)
    features, lexicon = _with_features(insults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            x = features(batch.column(0), grammar)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"]
            )

    rows = train.select("text", "toxic").mapInArrow(run, "x array<double>, toxic boolean").collect()
    # In one order, so that sums of doubles agree.
    rows.sort(key=lambda r: (r.toxic, r.x))
    if not rows:
        return Model({}, (*KINDS.values(), BIAS))
    x = np.array([r.x for r in rows]).reshape(len(rows), len(KINDS))
    return Model(insults, _fit(x, np.array([r.toxic for r in rows], dtype=float)))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the toxicity of each whole text, between 0 and 1. Null is an empty text; an
    empty text has the score of a text without any match."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    features, lexicon = _with_features(model.insults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            scores = pa.array(model.score(features(batch.column(text), grammar)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def trained(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model learned from the labelled documents of ``docs`` that are not held out."""
    return learn(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = with_score(docs.select("doc_id", "text"), trained(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.5 or more go; all others stay as they are."""
    name = "_toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    scored = with_score(docs, trained(spark, docs, sf_dir), name=name)
    return scored.where(F.col(name) < 0.5).drop(name)
