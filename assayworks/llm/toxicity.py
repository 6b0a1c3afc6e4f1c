"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers read a clause as word classes and its end. The negation transducer marks what
stands shortly after a negation, the report transducer what is said to be another's words. The insult
transducer tells insults that someone is called, that are all a clause says, or that are merely in it;
the threat transducer finds acts meant for someone, named before or after them. They are composed into
one machine, whose transitions carry weights. Isolated words have no score: matched clauses do.

The word lists start from fixed English seeds. Training rows add words and stems to the insults, which
then count wherever they stand, and give the transitions of every kind of match their weight.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayworks.llm.common import SLICE_BYTES, mix, slices, written

#: At most so many training rows of each class (1 and 0) are used, the first by a hash of the id.
FIT_TOXIC, FIT_CLEAN = 3000, 6000
#: A learned insult is in at least so many unlike toxic rows, which are such a share of all its rows;
#: one that is taken although others explain its rows has to have the higher share.
LEAST_ROWS, LEAST_PRECISION, SURE_PRECISION = 3, 0.85, 0.97
#: A stem is the start of at least so many different words.
LEAST_WORDS = 3
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Marks the class of a word whose stem insults only together with another word of it, at most so many words away.
PAIR, NEAR = "&", 32
NEGATION_REACH = 3

#: Word classes: insults of the seeds and taught ones, threats, who may be meant (the one spoken to, others as
#: objects, her, others as subjects, the speaker), subject and copula in one, copulas, what intends, what
#: leads up to an insult, negations, reports, anything else, and the end of a clause.
INSULT, TAUGHT, THREAT, YOU, THEM, HER, THEY, ME, YOURE, COPULA, INTENT, LEAD, NEGATION, REPORT, OTHER, END = "ILTYVHSWQBMDNRO$"
ALPHABET = INSULT + TAUGHT + THREAT + YOU + THEM + HER + THEY + ME + YOURE + COPULA + INTENT + LEAD + NEGATION + REPORT + OTHER + END
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless trash disgusting clown dumb fool fools "
            "imbecile garbage filth vermin coward cowards creep jerk bastard bastards bitch asshole retard ugly",
    THREAT: "kill hurt destroy beat stab shoot burn punch strangle murder attack crush hunt",
    YOU: "you u ya yourself yourselves",
    THEM: "him himself them themselves",
    HER: "her herself",
    THEY: "he she they",
    ME: "i we",
    YOURE: "you're they're he's she's you’re they’re he’s she’s",
    COPULA: "are is was were be",
    INTENT: "will shall must should gonna going want wanna let's i'll we'll he'll she'll they'll i'd we'd let’s i’ll we’ll he’ll she’ll they’ll i’d we’d",
    LEAD: "a an the such what so very really just total complete absolute utter little big",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot",
    REPORT: "said says say called calls wrote writes quoted quote reported claims claimed alleged according told",
}
#: Belief about the share of toxic rows among rows whose strongest match is of a kind, held as PRIOR_ROWS rows.
PRIORS = {"aimed insult": 0.97, "insult": 0.9, "aimed threat": 0.8, "reported insult": 0.15, "negated insult": 0.5,
          "reported threat": 0.05, "negated threat": 0.05, "nothing": 0.01, "mentioned insult": 0.05}
PRIOR_ROWS = 10
#: What a fitted model starts from: a negated insult alone accuses nobody either, unless training rows say so.
FITTED_PRIORS = PRIORS | {"negated insult": 0.15}
#: Their words are ordinary ones that reports are full of: a text counts each of these kinds once, however long it is.
ONCE = ("reported threat", "negated threat", "mentioned insult")

WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSES = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Transducer:
    """State and input symbol to next state and output symbol; a missing input passes unchanged."""

    start: int
    moves: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, alphabet: str) -> tuple[Transducer, str]:
    """The machine that feeds what ``first`` writes to ``second``, and the symbols it can write."""
    number = {(first.start, second.start): 0}
    todo, moves, written_symbols = [(first.start, second.start)], {}, set()
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            a, middle = first.step(state[0], symbol)
            b, out = second.step(state[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            moves[number[state], symbol] = number[a, b], out
            written_symbols.add(out)
    return Transducer(0, moves), "".join(sorted(written_symbols))


def negation_transducer() -> Transducer:
    """Writes i and t for insults and threats at most NEGATION_REACH words after a negation."""
    moves = {}
    for left in range(NEGATION_REACH + 1):
        for symbol in ALPHABET:
            out = {INSULT: "i", TAUGHT: "i", THREAT: "t"}.get(symbol, symbol) if left else symbol
            moves[left, symbol] = max(0, left - 1), out
        moves[left, NEGATION] = NEGATION_REACH, OTHER
    return Transducer(0, moves)


def report_transducer() -> Transducer:
    """Writes 1 and 2 for insults and threats after a word that reports."""
    return Transducer(0, {(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER), (1, INSULT): (1, "1"), (1, TAUGHT): (1, "1"), (1, THREAT): (1, "2")})


def insult_transducer() -> Transducer:
    """Writes 3 for an insult that someone is called, m for one that a clause mentions, L for a taught
    one anywhere, and X at the end of a clause that says nothing but an insult."""
    bare, whole, you, they, called, plain = range(6)
    moves = {}
    for state in (bare, whole, you, they, called, plain):
        for symbol in (*ALPHABET, "i", "t", "1", "2"):
            out, to = symbol, {YOU: you, THEM: they, HER: they, THEY: they, YOURE: called}.get(symbol, plain)
            if symbol in (INSULT, TAUGHT):
                to = {bare: whole, whole: whole, you: you, called: called}.get(state, plain)
                out = "3" if state in (you, called) else "m" if symbol == INSULT else TAUGHT
            elif symbol == LEAD and state != they:
                to = state
            elif symbol == COPULA and state in (you, they):
                to = called
            elif symbol == END and state == whole:
                out = "X"
            moves[state, symbol] = to, out
    return Transducer(bare, moves)


def threat_transducer() -> Transducer:
    """Writes 4 for an act that is meant for someone.

    After a word of intent its object may follow, at most one word between, or end the clause as her
    or she does; or the clause ends with the act, and who is meant stood before its subject. At the start of
    a clause, as an order, it needs the one spoken to, or another at the clause's end.
    """
    moves: dict = {}
    # Whether a clause has begun, what it intends, and whether someone, and then a subject, was named;
    # then how it goes on after an act: not, ordered, intended, the same one word later, or only with its end.
    plain, ordered, meant, later, ends = range(5)
    for begun in (0, 1):
        for intent in (0, 1):
            for named in (0, 1, 2):
                for after in (plain, ordered, meant, later, ends):
                    for symbol in (*ALPHABET, "i", "t", "1", "2", "3", "m", "X"):
                        out, go = symbol, plain
                        if after == ends:
                            out = "4" if symbol in (END, "X") else symbol
                        elif after in (meant, later) and symbol in (YOU, THEM) or after == ordered and symbol == YOU:
                            out = "4"
                        elif after != plain and symbol in (HER, THEM):
                            go = ends
                        elif after == meant and symbol in (LEAD, OTHER):
                            go = later
                        elif after == meant and symbol == END and named == 2:
                            out = "4"
                        elif symbol == THREAT and (intent or not begun):
                            go = meant if intent else ordered
                        who = 1 if symbol == YOU and not named else 2 if symbol in (THEY, ME) and named else named
                        moves[(begun, intent, named, after), symbol] = (1, int(intent or symbol == INTENT), who, go), out
    return Transducer((0, 0, 0, plain), moves)


def grammar() -> Transducer:
    """Negation, then report, insult and threat, over one clause and its end."""
    whole, symbols = negation_transducer(), ALPHABET
    for part in (report_transducer(), insult_transducer(), threat_transducer()):
        whole, _ = compose(whole, part, symbols)
    return whole


#: What the composed machine writes for a match. A threat meant for nobody is no match.
KINDS = {"3": "aimed insult", "X": "insult", TAUGHT: "insult", "4": "aimed threat", "1": "reported insult", "i": "negated insult",
         "2": "reported threat", "t": "negated threat", "m": "mentioned insult"}


@dataclass
class Model:
    words: dict[str, str] = field(default_factory=dict)
    stems: dict[str, str] = field(default_factory=dict)
    pairs: set[str] = field(default_factory=set)
    """Stems that insult only where two words of them stand near each other."""
    weights: dict[str, float] = field(default_factory=dict)
    """How likely a row is toxic given one match of a kind."""

    def kind_of(self, word: str) -> str:
        found = self.words.get(word)
        if found is None:
            for length in STEM_LENGTHS:
                found = self.stems.get(word[:length]) if len(word) >= length else None
                if found:
                    break
        if found is None and self.pairs:
            found = next((f"{PAIR}{word[:k]}" for k in STEM_LENGTHS if len(word) > k and word[:k] in self.pairs), None)
        return found or OTHER


def beside(words: list[str], groups_of: dict[str, list[str]]) -> dict[str, set[int]]:
    """For each group the places of its words that have another word of it at most NEAR places away.

    However long a text is, a word only meets its neighbours.
    """
    found: dict[str, set[int]] = {}
    for step in (1, -1):
        # Of each group the word met last, its place, and where the last word unlike it was.
        met: dict[str, tuple[str, int, int | None]] = {}
        for place in range(len(words))[::step]:
            word = words[place]
            for group in groups_of.get(word, ()):
                last, at, unlike = met.get(group, (word, place, None))
                if last != word:
                    unlike = at
                if unlike is not None and abs(place - unlike) <= NEAR:
                    found.setdefault(group, set()).add(place)
                met[group] = word, place, unlike
    return found


def seeded() -> Model:
    model = Model()
    for symbol, words in SEEDS.items():
        model.words.update(dict.fromkeys(words.split(), symbol))
    model.weights = dict(PRIORS)
    return model


class Reader:
    """Finds the matched clauses of texts; remembers the class of words it has met, up to a bound."""

    REMEMBERED = 100_000

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        machine = grammar()
        self.start = machine.start
        # Transitions that write a match carry its kind and weight, all others none.
        self.moves = {(state, symbol): (to, KINDS.get(out), model.weights.get(KINDS.get(out), 0.0))
                      for (state, symbol), (to, out) in machine.moves.items()}

    def matches(self, text: str | None) -> dict[str, int]:
        """Matched clauses of each kind; a clause counts for the heaviest transition on its path."""
        words = WORDS.findall((text or "").lower())
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        known, kind_of = self.known, self.model.kind_of
        fresh = set(words).difference(known)
        known.update((w, kind_of(w)) for w in fresh)
        found: dict[str, int] = {}
        distinct = {w: known[w] for w in set(words) if known[w] != OTHER}
        paired = Counter(kind for kind in distinct.values() if kind[0] == PAIR)
        several = {w: [kind] for w, kind in distinct.items() if paired[kind] > 1}
        near = set().union(*beside(words, several).values()) if several else set()
        kinds = {w: kind for w, kind in distinct.items() if kind[0] != PAIR}
        if not near and not {INSULT, TAUGHT, THREAT} & set(kinds.values()):
            return found
        place = -1
        for clause in CLAUSES.split((text or "").lower()):
            state, best = self.start, (0.0, "")
            symbols = []
            for word in WORDS.findall(clause):
                place += 1
                symbols.append(TAUGHT if place in near else kinds.get(word, OTHER))
            for symbol in (*symbols, END) if symbols else ():
                state, kind, weight = self.moves[state, symbol]
                if kind:
                    best = max(best, (weight, kind))
            if best[1]:
                found[best[1]] = found.get(best[1], 0) + 1
        return found

    def score(self, found: dict[str, int]) -> float:
        clean = 1 - self.model.weights["nothing"]
        for kind, n in found.items():
            clean *= (1 - self.model.weights[kind]) ** (1 if kind in ONCE else n)
        return min(1.0, max(0.0, 1 - clean))


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _rows_of(reader, columns, schema_names):
    def run(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for low, high in slices(batch, lengths, SLICE_BYTES):
                part = batch.slice(low, high - low)
                made = reader(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *made], names=[*columns, *schema_names])
    return run


def _terms(texts):
    """Words, stems and stems of two near words of each text, and three minhashes that near copies share."""
    terms, hashes = [], [[], [], []]
    for text in texts:
        words = WORDS.findall((text or "").lower())
        mine = set(words)
        stems = Counter(w[:k] for w in mine for k in STEM_LENGTHS if len(w) > k)
        several = {w: [w[:k] for k in STEM_LENGTHS if len(w) > k and stems[w[:k]] > 1] for w in mine}
        terms.append([*mine, *[f"{stem}*" for stem in stems], *[f"{stem}**" for stem in beside(words, several)]])
        pairs = np.array([xxhash.xxh64_intdigest(a + " " + b) for a, b in zip(words, words[1:], strict=False)] or [0], np.uint64)
        for i in range(3):
            hashes[i].append(int(mix(pairs + np.uint64(i + 1)).min() >> np.uint64(1)))
    return [pa.array(terms, pa.list_(pa.string())), *[pa.array(h, pa.int64()) for h in hashes]]


def explaining(rows_of: dict[str, set], explained: set) -> list[str]:
    """Terms, one after the other the one with the most rows that neither ``explained`` nor those before it explain."""
    explained, taken = set(explained), []

    # A single word needs one row more than a stem, which several words speak for.
    def gain(term: str) -> int:
        return len(rows_of[term] - explained) - (not term.endswith("*"))

    def later(term: str) -> tuple[int, ...]:
        return (*[-ord(c) for c in term], 1)

    # Gains only shrink, so a term that keeps its place when it is counted anew is the best.
    queue = [(-gain(t), len(t), later(t), t) for t in rows_of]
    heapq.heapify(queue)
    while queue and -queue[0][0] >= LEAST_ROWS:
        before, length, order, term = heapq.heappop(queue)
        now = gain(term)
        if now < -before:
            heapq.heappush(queue, (-now, length, order, term))
        else:
            explained |= rows_of[term]
            taken.append(term)
    return taken


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_toxic: int = FIT_TOXIC, most_clean: int = FIT_CLEAN) -> Model:
    """Insults and weights learned from labelled rows that are not held out.

    At most ``most_toxic`` and ``most_clean`` rows are used. Rows that share a minhash with
    another of their class count once, so that copies of a document prove nothing more. Terms whose
    rows are toxic beyond chance are taken, then others while each explains toxic rows that those
    before it and the seeds don't. Without rows the seeds stay.
    """
    model = seeded()
    model.weights = dict(FITTED_PRIORS)
    known = (
        labels.select("doc_id", F.col(label).alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        known.where("toxic = 1").orderBy(*by_hash).limit(most_toxic)
        .unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(most_clean))
    )
    # At most most_toxic + most_clean ids: small enough for every task, whatever the size of the corpus.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    terms = written(sample.mapInArrow(
        _rows_of(_terms, ["doc_id", "toxic", "text"], ["terms", "h0", "h1", "h2"]),
        "doc_id long, toxic int, text string, terms array<string>, h0 long, h1 long, h2 long"), "toxicity-terms")
    unlike = terms
    for h in ("h0", "h1", "h2"):
        least = unlike.groupBy("toxic", h).agg(F.min("doc_id").alias("doc_id"))
        unlike = unlike.join(least.select("doc_id").distinct(), "doc_id", "left_semi")
    unlike = written(unlike.select("doc_id", "toxic", "text", "terms"), "toxicity-unlike")
    shares = unlike.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    counted = (
        unlike.select("toxic", F.explode("terms").alias("term")).groupBy("term")
        .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(f"bad >= {LEAST_ROWS} AND bad >= {LEAST_PRECISION} * n")
    )
    # A stem stands for several words; else the word itself is the better term.
    words = unlike.where("toxic = 1").select(F.explode("terms").alias("word")).where("NOT endswith(word, '*')").distinct()
    stems = words.select(F.explode(F.array(*[
        F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit(mark))) for k in STEM_LENGTHS for mark in ("*", "**")])).alias("term"))
    varied = stems.groupBy("term").agg(F.count("*").alias("words")).where(f"words >= {LEAST_WORDS}")
    usable = counted.join(varied, "term", "left").where("words IS NOT NULL OR NOT endswith(term, '*')")
    # Every usable term of at most most_toxic rows: bounded, whatever the size of the corpus.
    usable = written(usable.select("term", "bad", "n"), "toxicity-usable")
    candidates = [(r.term, r.bad, r.n) for r in usable.orderBy(F.desc("bad"), "term").collect()]
    # So many toxic rows and hardly a clean one come by chance less than once in a thousand fits.
    sure = math.log(1e-9) / math.log(max(1e-9, min(0.999, (shares.bad or 0) / max(shares.n, 1))))
    taken = [term for term, bad, n in candidates if bad >= sure and bad >= SURE_PRECISION * n]
    rows_of: dict[str, set] = {}
    explained: set = set()
    if candidates:
        seeds = [w for w, symbol in model.words.items() if symbol == INSULT]
        wanted = usable.select("term").unionByName(unlike.sparkSession.createDataFrame([(w,) for w in seeds], "term string")).distinct()
        held = unlike.where("toxic = 1").select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(wanted), "term", "left_semi")
        for r in held.groupBy("term").agg(F.collect_set("doc_id").alias("ids")).collect():
            rows_of[r.term] = set(r.ids)
        # Seeds that the rows bear out insult wherever they stand.
        taken += [term for term, _, _ in candidates if term in seeds and term not in taken]
        explained = set().union(*[rows_of.pop(w, set()) for w in seeds], *[rows_of.get(t, set()) for t in taken])
    taken += explaining(rows_of, explained)
    for term in taken:
        if term.endswith("**"):
            model.pairs.add(term[:-2])
        elif term.endswith("*"):
            model.stems[term[:-1]] = TAUGHT
        else:
            model.words[term] = TAUGHT

    def strongest(texts):
        reader = Reader(model)
        found = [reader.matches(t) for t in texts]
        return [pa.array([max(f, key=lambda k: FITTED_PRIORS[k]) if f else "nothing" for f in found])]

    kinds = unlike.mapInArrow(_rows_of(strongest, ["toxic"], ["kind"]), "toxic int, kind string")
    for r in kinds.groupBy("kind").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect():
        model.weights[r.kind] = (r.bad + FITTED_PRIORS[r.kind] * PRIOR_ROWS) / (r.n + PRIOR_ROWS)
    return model


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from ``threshold`` on) and matched_clauses.

    Only the text is read. Every row gets a score, repeated ones the same; a null or empty text
    matches nothing and gets the weight of no match. Whole texts are read, however long.
    """
    columns = [c for c in docs.columns if c not in ("score", "predicted", "matched_clauses")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    readers: dict[str, Reader] = {}

    def scored(texts):
        reader = readers.get("one") or readers.setdefault("one", Reader(model))
        found = [reader.matches(t) for t in texts]
        scores = [reader.score(f) for f in found]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                pa.array([sum(f.values()) for f in found], pa.int64())]

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(
        _rows_of(scored, columns, ["score", "predicted", "matched_clauses"]),
        f"{schema}, score double, predicted int, matched_clauses long")
