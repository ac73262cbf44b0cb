"""Toxicity (operator 5): a weighted finite-state pattern grammar.

The words' transducer turns a clause into symbols: insult, threat, target, negation, reported speech, other. A transducer of
threats reads these first, holding a verb back until it is seen whom it hits: "I will kill you" is a threat, "you will kill
time" none. Four weighted transducers read what it writes: one weighs insults and threats, the others what came before
them: a target raises, a negation or reported speech lowers. They are composed into one machine, whose weights are the
products of theirs. A document's features are sums over matched clauses, and a
logistic model of these gives its score. Insult words and stems, with weights, and the model are fitted on labelled rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_pass, text_udf, texts, written

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n|]+")



def _forms(stems: str, endings: str) -> frozenset[str]:
    """Each stem with each ending; a dash stands for none."""
    return frozenset(s + ("" if e == "-" else e) for s in stems.split() for e in endings.split())


# Closed classes of the grammar in English, German, French and Spanish, verbs with their usual endings.
TARGETS = frozenset("you your yours yourself yourselves u ur they them their he him his she her du dich dir dein deine deiner ihr euch euer eure sie ihn ihm ihnen tu toi te ton ta tes vous votre vos il elle ils elles lui eux usted ustedes tú ti tus vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not no never nobody nothing none neither nor without isn aren wasn weren don doesn didn won cannot nicht kein keine keiner keinen nie niemals ohne weder ne pas jamais sans aucun aucune personne nunca jamás sin ningún ninguna tampoco".split())
REPORTS = frozenset("said says say told tells called calls quote quoted quotes wrote writes claimed claims sagte sagt schrieb schreibt nannte behauptet behauptete dit disait écrit écrivait appelle appelait prétend dijo dice escribió escribe llamó llama afirma afirmó".split())
THREATS = (
    _forms("kill hurt punish beat shoot stab burn strangl murder destroy smash crush", "- s e es ed ing")
    | _forms("töt verletz bestraf schlag erschieß verbrenn vernicht zerstör", "e en est et st t")
    | _forms("tu frapp brûl bless étrangl", "e er es ez erai era erons ons ent")
    | _forms("mat golpe quem castig destroz", "o ar aré ará aremos as a an")
    | frozenset("umbringen umbringe détruire détruirai punir punirai destruir destruiré herir heriré".split())
)

# Who speaks, and the verbs that say what somebody is about to do, in the same languages.
AGENTS = frozenset("i we ill well im ich wir je j nous yo nosotros".split())
MODALS = frozenset("will ll would shall gonna going should can could want werde werden wird wirst werdet will wollen soll sollte vais vas va allons allez vont veux veut voy vas vamos van quiero quiere".split())
HELPERS = frozenset("am are is be to a zu".split())

#: Letters of the stems that may stand for all words that begin with them.
STEMS = range(4, 8)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Weights of the grammar's arcs.
TARGETED, NEGATED, REPORTED, REACH = 1.25, 0.5, 0.6, 3


@dataclass
class Model:
    """insults: weight by word, or by stem with a trailing "*". weights: of the features, the first for none."""

    insults: dict[str, float]
    weights: list[float]
    mean: list[float]
    scale: list[float]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        return cls(**json.loads(text))


@dataclass(frozen=True)
class Transducer:
    """A weighted transducer over the symbols, which it passes on as they are: start, and by (state, symbol) the next state and a weight."""

    start: Hashable
    arcs: dict[tuple[Hashable, int], tuple[Hashable, float]]

    def weights(self, symbols: Iterable[int]) -> Iterator[float]:
        state = self.start
        for symbol in symbols:
            state, weight = self.arcs[state, symbol]
            yield weight


def compose(*machines: Transducer) -> Transducer:
    """The machine that passes symbols through all of them: its states are tuples of theirs, as far as they can be reached, its weights products."""
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            steps = [m.arcs[s, symbol] for m, s in zip(machines, state, strict=True)]
            after = tuple(s for s, _ in steps)
            arcs[state, symbol] = after, math.prod(w for _, w in steps)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(start, arcs)


SYMBOLS = range(6)
#: Insults and threats are what is scored.
SCORED = Transducer(0, {(0, s): (0, 1.0 if s in (INSULT, THREAT) else 0.0) for s in SYMBOLS})
#: A target before it raises an insult; a threat without somebody whom it threatens is none.
TARGETING = Transducer(False, {(seen, s): (seen or s == TARGET, TARGETED if seen else 0.0 if s == THREAT else 1.0) for seen in (False, True) for s in SYMBOLS})
#: A negation lowers what stands up to REACH words behind it; the state counts the words that it still reaches.
NEGATING = Transducer(0, {(left, s): (REACH if s == NEGATION else max(0, left - 1), NEGATED if left else 1.0) for left in range(REACH + 1) for s in SYMBOLS})
#: What somebody is said to have said weighs less.
REPORTING = Transducer(False, {(seen, s): (seen or s == REPORT, REPORTED if seen else 1.0) for seen in (False, True) for s in SYMBOLS})
CLAUSES = compose(SCORED, TARGETING, NEGATING, REPORTING)


def numbered(machine: Transducer) -> list[list[tuple[int, float]]]:
    """The machine as a table: by number of the state, the start's first, and symbol, the next state's number and the weight."""
    states = sorted({s for s, _ in machine.arcs}, key=lambda s: (s != machine.start, repr(s)))
    number = {s: k for k, s in enumerate(states)}
    return [[(number[machine.arcs[s, symbol][0]], machine.arcs[s, symbol][1]) for symbol in SYMBOLS] for s in states]


TABLE = numbered(CLAUSES)
#: The words' own transducer: the symbol of a word that is no insult.
CLASS = {**dict.fromkeys(REPORTS, REPORT), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(THREATS, THREAT)}
FEATURES = ("rate", "sum", "most", "clauses", "share")


def govern(symbols: list[int], words: list[str]) -> list[tuple[int, int]]:
    """The symbols as the transducer of threats writes them, each with the place of the word whose weight it has.

    A verb is held back for up to REACH words. If one of them is a target, and the speaker stands up to REACH words before
    the verb, modals and their helpers not counted (agent, modal, verb, object), the target is written before the verb. If
    none is, and a target with a modal right behind it stands there, the target is who acts, and the verb is no threat. All
    else is written as it was read.
    """
    out: list[tuple[int, int]] = []
    moved: set[int] = set()
    for i, symbol in enumerate(symbols):
        if symbol != THREAT:
            out.append((OTHER if i in moved else symbol, i))
            continue
        hit = next((k for k in range(i + 1, min(len(symbols), i + 1 + REACH)) if symbols[k] == TARGET and k not in moved), None)
        before, left = [], REACH
        for k in range(i - 1, -1, -1):
            left -= words[k] not in MODALS and words[k] not in HELPERS
            if left < 0:
                break
            before.append(k)
        if hit is not None and any(words[k] in AGENTS for k in before):
            out += [(TARGET, hit), (THREAT, i)]
            moved.add(hit)
        elif hit is None and any(k and words[k] in MODALS and symbols[k - 1] == TARGET for k in before):
            out.append((OTHER, i))
        else:
            out.append((THREAT, i))
    return out


class Grammar:
    """Scores texts by clauses."""

    def __init__(self, insults: dict[str, float]):
        self.words = {w: v for w, v in insults.items() if w[-1] != "*"}
        self.stems = {w[:-1]: v for w, v in insults.items() if w[-1] == "*"}
        self.lengths = sorted({len(w) for w in self.stems})
        self.memory: dict[str, float] = {}
        self.clean: set[str] = set()  # words that are known to be no insults

    def insult(self, word: str) -> float:
        """The word's weight as an insult: its own, or the largest of its stems."""
        known = self.memory.get(word)
        if known is None:
            known = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word))])
            if len(self.memory) < 100_000:
                self.memory[word] = known
        return known

    def clause(self, words: list[str]) -> float:
        """The sum over its words of the composed machine's weights times those of the insults; a threat weighs as much as a middling one."""
        if not THREATS.isdisjoint(words):
            return self._governed(words)
        row, total, insult, symbol = TABLE[0], 0.0, self.insult, CLASS.get
        for word in words:
            weight = insult(word)
            after, factor = row[INSULT if weight else symbol(word, OTHER)]
            if factor:
                total += factor * weight
            row = TABLE[after]
        return total

    def _governed(self, words: list[str]) -> float:
        """The same of a clause with words of threats, through their transducer."""
        weights = [self.insult(w) for w in words]
        symbols = [INSULT if v else CLASS.get(w, OTHER) for w, v in zip(words, weights, strict=True)]
        row, total = TABLE[0], 0.0
        for symbol, i in govern(symbols, words):
            after, factor = row[symbol]
            total += factor * (weights[i] or 3.0)
            row = TABLE[after]
        return total

    def features(self, text: str) -> list[float]:
        """Of the clauses' scores: per 100 words, in all, the largest, matched clauses, their share; logarithms of 1 more. An empty text has zeros."""
        low = text.lower()
        distinct = set(WORD.findall(low))
        new = distinct - self.clean
        bad = {w for w in new if self.insult(w)}
        if len(self.clean) < 200_000:
            self.clean |= new - bad
        if not bad and (THREATS.isdisjoint(distinct) or TARGETS.isdisjoint(distinct)):
            return [0.0] * len(FEATURES)
        n = clauses = 0
        scores = []
        for part in CLAUSE.split(low):
            if words := WORD.findall(part):
                n, clauses = n + len(words), clauses + 1
                if score := self.clause(words):
                    scores.append(score)
        if not scores:
            return [0.0] * len(FEATURES)
        total = sum(scores)
        return [math.log1p(x) for x in (100 * total / n, total, max(scores), len(scores), 100 * len(scores) / clauses)]


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic of labelled ids, as a table of at most `most` rows: those of the smallest hashes of doc_id, few enough to broadcast.

    An id that docs repeats counts once, with its largest text; one that labels repeats is toxic if any of them says so.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic"), "sample")


def _occurrences(toxic_sample: DataFrame) -> DataFrame:
    """term, toxic, n, docs: words and stems of the sample, how often and in how many documents."""

    def make():
        def work(batch):
            out = {"term": [], "toxic": [], "n": []}
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen: dict[str, int] = {}
                for w in WORD.findall(text.lower()):
                    seen[w] = seen.get(w, 0) + 1
                terms = dict(seen)
                for w, k in seen.items():
                    for n in STEMS:
                        if len(w) >= n:
                            terms[f"{w[:n]}*"] = terms.get(f"{w[:n]}*", 0) + k
                out["term"] += terms
                out["n"] += terms.values()
                out["toxic"] += [toxic] * len(terms)
            return out

        return work

    return text_pass(toxic_sample, ["text", "toxic"], make, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def learn_insults(sample: DataFrame, ratio: float = 8.0, least_docs: int = 5) -> dict[str, float]:
    """Words and stems at least `ratio` times as frequent among the words of toxic rows as of others, with the logarithm of that as their weight.

    All that stand in `least_docs` toxic rows are taken; the sample's bound is theirs too.
    """
    terms = _occurrences(sample)
    words = {r.toxic: r.n for r in terms.filter("term not like '%*'").groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if not words.get(1) or not words.get(0):
        return {}
    by = terms.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("docs"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    weight = F.log((F.col("bad") / float(words[1])) / ((F.col("good") + 1) / float(words[0])))
    rows = by.filter(F.col("docs") >= least_docs).withColumn("w", weight).filter(F.col("w") >= math.log(ratio)).collect()
    found = {r.term: r.w for r in rows}
    # A longer stem, or a word, that its shorter stem covers about as well adds nothing.
    return {t: w for t, w in found.items() if not any(found.get(f"{t[:n]}*", 0.0) >= w - 1.0 for n in STEMS if n < len(t.rstrip("*")))}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the first column is not penalised."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep * w
        move = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), gradient)
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """A model of labels.toxic. At most `most` labelled ids, by hash of doc_id, are learnt from; their features meet on the driver.

    The sample is written once, so the corpus is read once. Repeated ids and labels: see _sample(). Without rows of both labels, the model gives every text the score 0.01.
    """
    sample = _sample(docs, labels, most)
    insults = learn_insults(sample)
    if not insults:
        return Model({}, [-4.6] + [0.0] * len(FEATURES), [0.0] * len(FEATURES), [1.0] * len(FEATURES))
    names = ", ".join(f"{n} double" for n in FEATURES)

    def make():
        grammar = Grammar(insults)

        def work(batch):
            rows = [grammar.features(t) for t in texts(batch.column(0))]
            return {"toxic": batch.column(1), **dict(zip(FEATURES, zip(*rows, strict=True), strict=True))}

        return work

    rows = np.array(text_pass(sample, ["text", "toxic"], make, f"toxic int, {names}").collect(), float)
    rows = rows[np.lexsort(rows.T)]  # sums of floats come out the same whatever the order of tasks
    mean, scale = rows[:, 1:].mean(axis=0), rows[:, 1:].std(axis=0) + 1e-6
    x = np.column_stack([np.ones(len(rows)), (rows[:, 1:] - mean) / scale])
    return Model(insults, _fit(x, rows[:, 0]).tolist(), mean.tolist(), scale.tolist())


def _scores(grammar: Grammar, model: Model, batch: list[str]) -> np.ndarray:
    x = np.array([grammar.features(t) for t in batch]).reshape(-1, len(FEATURES))
    z = model.weights[0] + (x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for each row of df.

    Only the text counts. A null or empty text matches nothing and scores like any text without a match. Repeated rows
    and null ids each get a row; texts are read whole.
    """

    def make():
        grammar = Grammar(model.insults)

        def work(batch):
            return {"doc_id": batch.column(0), "score": _scores(grammar, model, texts(batch.column(1)))}

        return work

    return text_pass(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ["doc_id", "text"], make, "doc_id long, score double")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of df whose text scores below the limit; no row moves."""

    def make():
        grammar = Grammar(model.insults)
        return lambda text: _scores(grammar, model, [t or "" for t in text])

    scored = text_udf("double", make)
    small_batches(df.sparkSession)
    return df.filter(scored(F.col(text_col).cast("string")) < limit)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no model learns from: the CRC-32 of doc_id as text is divisible by 5. A null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
