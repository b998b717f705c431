"""Toxicity: a weighted grammar of finite-state transducers over clauses.

A text is cut into clauses. Each token of a clause becomes a symbol (insult,
threat, target, negation, reporting word or other); three transducers, composed
into one machine, rewrite insult and threat symbols by what precedes them in
the clause: addressed to somebody, negated, or reported speech. A clause
matches when the machine writes at least one insult or threat; only matched
clauses count. A text's score is the logistic of the weights of the written
symbols of all its matched clauses.

The insult lexicon is a fixed seed list of words and word stems learned from
labelled rows (stems that repeat in toxic texts and hardly in others, chosen
greedily by the toxic texts they newly explain); the symbol weights are fitted
on the same rows, starting from fixed prior weights. Labelled rows used: the
``SAMPLE`` rows with the smallest hash of their id among the labels passed in;
the caller leaves held-out rows out. Language, source and id are no inputs.

Null and empty texts match nothing and get the score of no matches. Without
labelled rows the seed lexicon and the prior weights are used. Repeated rows
each get their row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import documents, per_text, query
from ctxrec.sources.tables import read_table

SAMPLE = 8000
MAX_STEMS = 200
STEM_CANDIDATES = 4000
STEM_SIZES = range(4, 9)

SEED_INSULTS = ("idiot idiots moron morons loser losers stupid pathetic worthless scum trash clown clowns disgusting "
                "imbecile fool dumb dumbass bastard vermin filth garbage pig cretin degenerate freak creep jerk "
                "dummkopf trottel abschaum arschloch versager connard imbécile ordure salaud raclure "
                "imbécil estúpido estúpida basura escoria cabrón").split()
THREATS = ("kill hurt destroy crush punish beat stab shoot burn hang strangle töten umbringen vernichten tuer frapper "
           "détruire matar golpear destruir").split()
TARGETS = ("you your yours you're youre ya u he she they his her their him them who these those this that du dich dir "
           "dein ihr euch euer sie er tu te toi ton ta vous votre il elle ils ce cette tú ti usted ustedes su ellos "
           "ese esa").split()
NEGATIONS = ("not no never nobody none neither nor without isn't aren't wasn't weren't don't doesn't didn't won't "
             "nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin").split()
REPORTING = ("said says say told tells called calls quote quoted quotes wrote writes claimed claims reported according "
             "alleged sagte sagt nannte behauptete laut dit disait appelé selon dijo dice llamó según").split()

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)
ADDRESSED, NEGATED, REPORTED = 1, 2, 4
#: a symbol is base * 8 + flags
Symbol = int
#: written symbols that weigh: insults, then threats, with each set of flags
WRITTEN = [base * 8 + flags for base in (INSULT, THREAT) for flags in range(8)]

_CLAUSE = re.compile(r"[.!?;\n\r|]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass
class Transducer:
    """Deterministic: arcs[(state, symbol)] = (next state, written symbol); a
    symbol without an arc is copied and leads to ``default[state]``."""
    arcs: dict[tuple[int, Symbol], tuple[int, Symbol]] = field(default_factory=dict)
    default: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: Symbol) -> tuple[int, Symbol]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, state), symbol)


def marker(trigger: int, flag: int, reach: int | None) -> Transducer:
    """Writes ``flag`` on insults and threats up to ``reach`` tokens after a
    ``trigger`` symbol (None: up to the end of the clause)."""
    last = reach or 1
    machine = Transducer(default={s: max(s - 1, 0) if reach else s for s in range(last + 1)})
    for state in range(last + 1):
        for flags in range(8):
            machine.arcs[(state, trigger * 8 + flags)] = (last, trigger * 8 + flags)
            if state:
                for base in (INSULT, THREAT):
                    machine.arcs[(state, base * 8 + flags)] = (machine.default[state], base * 8 + (flags | flag))
    return machine


def compose(machines: list[Transducer]) -> tuple[list[list[int]], list[list[Symbol]]]:
    """The machines one after the other as two tables over (state, base):
    next state and written symbol. Only reachable states are made."""
    states: dict[tuple[int, ...], int] = {(0,) * len(machines): 0}
    work, to, out = [(0,) * len(machines)], [], []
    for at in work:  # grows while it is read
        row_to, row_out = [], []
        for base in range(6):
            symbol, nxt = base * 8, []
            for m, s in zip(machines, at):
                s, symbol = m.step(s, symbol)
                nxt.append(s)
            key = tuple(nxt)
            if key not in states:
                states[key] = len(states)
                work.append(key)
            row_to.append(states[key])
            row_out.append(symbol)
        to.append(row_to)
        out.append(row_out)
    return to, out


GRAMMAR = compose([marker(TARGET, ADDRESSED, 4), marker(NEGATION, NEGATED, 3), marker(REPORT, REPORTED, None)])
#: prior weight of each written symbol: an addressed insult weighs most, negated and reported ones little
PRIOR = np.array([(1.5 if s // 8 == INSULT else 1.0) + (0.7 if s & ADDRESSED else 0.0)
                  - (1.2 if s & NEGATED else 0.0) - (1.0 if s & REPORTED else 0.0) for s in WRITTEN])
PRIOR_BIAS = -2.5


class Lexicon:
    """Symbols of tokens, and a pattern that finds texts with any trigger."""

    def __init__(self, stems: list[str]):
        self.stems = sorted(stems)
        self.words: dict[str, int] = {}
        for base, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING), (THREAT, THREATS),
                            (INSULT, SEED_INSULTS)):
            self.words |= dict.fromkeys(words, base)
        whole = "|".join(map(re.escape, sorted({*SEED_INSULTS, *THREATS})))
        begin = "|".join(map(re.escape, self.stems)) or "(?!)"
        self.trigger = re.compile(rf"(?<![^\W\d_])(?:(?:{whole})(?![^\W\d_])|(?:{begin}))")
        self.stem = re.compile(begin)

    def symbol(self, token: str) -> int:
        found = self.words.get(token)
        if found is not None:
            return found
        if self.stem.match(token):
            return INSULT
        return NEGATION if token.endswith(("n't", "n’t")) else OTHER


def written(text: str | None, lexicon: Lexicon) -> Counter:
    """Symbols the grammar writes over all matched clauses of a text."""
    low, found = (text or "").lower(), Counter()
    if not lexicon.trigger.search(low):
        return found
    to, out = GRAMMAR
    for clause in _CLAUSE.split(low):
        if not lexicon.trigger.search(clause):
            continue
        state = 0
        for token in _TOKEN.findall(clause):
            base = lexicon.symbol(token)
            symbol = out[state][base]
            state = to[state][base]
            if base >= INSULT:
                found[symbol] += 1
    return found


def features(found: Counter) -> list[float]:
    """log(1 + count) of each written symbol, then whether several insults came."""
    total = sum(found.values())
    return [math.log1p(found.get(s, 0)) for s in WRITTEN] + [float(total >= 2), float(total >= 1)]


@dataclass
class Model:
    stems: list[str]
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        lexicon = Lexicon(self.stems)
        nothing = 1 / (1 + math.exp(-self.bias))
        out = np.full(len(texts), nothing)
        for i, t in enumerate(texts):
            found = written(t, lexicon)
            if found:
                out[i] = 1 / (1 + math.exp(-float(np.clip(self.bias + np.dot(features(found), self.weights), -60, 60))))
        return out


def prior_model() -> Model:
    return Model([], np.concatenate((PRIOR, [1.0, 0.0])), PRIOR_BIAS)


def learn_stems(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """Word beginnings that repeat in the toxic texts of ``rows`` (_id, _text,
    _label; toxic texts that the seed list explains left out) and hardly in the
    clean ones. Greedy: the stem that newly explains most, the longest of equals."""
    words = F.filter(F.split(F.lower("_text"), r"[^\p{L}]+"), lambda w: F.length(w) >= min(STEM_SIZES))
    least = max(3, n_toxic // 50)
    per_doc = (rows.select("_id", "_label", F.explode(words).alias("w"))
               .select("_id", "_label", F.explode(F.array_distinct(F.transform(
                   F.array(*map(F.lit, STEM_SIZES)), lambda k: F.substring(F.col("w"), F.lit(1), k)))).alias("stem"))
               .groupBy("stem", "_id", "_label").count().where("count >= 2"))
    found = (per_doc.groupBy("stem").agg(
        F.collect_set(F.when(F.col("_label") == 1, F.col("_id"))).alias("toxic"),
        F.sum((F.col("_label") == 0).cast("int")).alias("clean"))
        .where((F.size("toxic") >= least) & (3 * F.col("clean") <= F.size("toxic"))
               & (F.size("toxic") * n_clean >= 20 * n_toxic * (F.col("clean") + 1)))
        .orderBy(F.size("toxic").desc(), F.length("stem").desc(), "stem").limit(STEM_CANDIDATES).collect())
    stems: list[str] = []
    sets = [(r["stem"], set(r["toxic"]), r["clean"]) for r in found]
    covered: set = set()
    while len(stems) < MAX_STEMS:
        gain, _, stem, ids = max(((len(ids - covered) - clean, len(stem), stem, ids) for stem, ids, clean in sets),
                                 key=lambda g: g[:3], default=(0, 0, "", set()))
        if gain < least:
            break
        stems.append(stem)
        covered |= ids
    return stems


def fit_weights(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic regression, pulled towards the prior weights; Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    start = np.concatenate((prior, [bias]))
    w, pull = start.copy(), np.concatenate((np.full(len(prior), 1.0), [0.01]))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + pull * (w - start)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Model from at most SAMPLE of the labelled rows."""
    pick = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
            .orderBy(F.xxhash64("_id"), "_id", "_label").limit(SAMPLE))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(pick, "_id")
            .checkpoint())
    labelled = per_text(rows, "hits long", lambda texts: [[sum(written(t, Lexicon([])).values()) for t in texts]],
                        "_id", "_text", ("_label",)).checkpoint()
    size = {(r["_label"], r["hit"]): r["count"]
            for r in labelled.groupBy("_label", (F.col("hits") > 0).alias("hit")).count().collect()}
    toxic, clean = ({h: size.get((y, h), 0) for h in (True, False)} for y in (1, 0))
    if not sum(toxic.values()) or not sum(clean.values()):
        return prior_model()
    known = labelled.where("_label = 1 and hits > 0").select("_id")
    stems = learn_stems(rows.join(known, "_id", "left_anti"), max(toxic[False], 1), sum(clean.values()))
    names = [f"f{i}" for i in range(len(WRITTEN) + 2)]

    def measure(texts):
        lexicon = Lexicon(stems)
        return list(zip(*(features(written(t, lexicon)) for t in texts))) or [[] for _ in names]

    found = per_text(rows, ", ".join(f"{n} double" for n in names), measure, "_id", "_text", ("_label",)).toPandas()
    found = found.sort_values(["_id", "_label", *names], ignore_index=True)
    prior = prior_model()
    weights, bias = fit_weights(found[names].to_numpy(), found["_label"].to_numpy(float), prior.weights, prior.bias)
    return Model(stems, weights, bias)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """id, ``extra`` columns, ``score`` (0 to 1) and ``predicted`` of every text."""
    def judge(texts):
        score = model.score(texts)
        return [score, (score >= 0.5).astype(np.int32)]

    return per_text(docs, "score double, predicted int", judge, id_col, text_col, extra)


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def trained(spark, docs: DataFrame, sf_dir: str) -> Model:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    return fit(docs, labels)


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    """Every document's toxicity score."""
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
