"""Toxicity: Levenshtein automata over a lexicon trie, weighed by the context of each hit."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.text import WORD, Memo, by_size, crc_mod, held
from gridfolio.session import written

#: Labelled rows that the lexicon and the weights are fitted on, and characters of their texts, both in expectation; more
#: are not collected.
FIT_ROWS = 8_000
FIT_CHARS = 40_000_000
#: States that an automaton remembers before it begins anew.
STATES = 50_000
#: Words that a document counts for at least when its hits are set against its length.
LEAST_WORDS = 20
#: Words on either side of a hit that are its context.
WINDOW = 6
#: Chosen by hand, not learned: words that report speech, in the languages of the labels. The labels show no quoted abuse to learn them from.
REPORTING = frozenset(
    "said says wrote called calls quoted quote reported allegedly so-called term word "
    "dit disait appelle mot terme sagte sagt schrieb nannte genannt wort zitat "
    "dijo dice llama palabra escribió".split()
)
#: Chosen by hand as well: words that address the reader.
ADDRESS = frozenset("you your you're yourself u ur tu toi vous votre ton ta du dich dein deine ihr euch tú usted vos te".split())
#: Quotation marks that open, that close, and that do either by their neighbours.
OPENING, CLOSING, EITHER = "«“„‹‘", "»”›’", "\"'`“‘»‹«›"
#: Characters on either side of a hit within which the marks of a quotation are looked for.
REACH = 40


def edits(length: int) -> int:
    """Edits that a misspelling of a term of so many letters may have."""
    return 0 if length < 4 else 1 if length < 9 else 2


#: Chosen by hand: digits that stand for letters.
DISGUISES = str.maketrans("013457", "oieast")


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the words from ``start`` to ``end`` stand between an opening and a closing mark, both within REACH.

    A mark between two letters is an apostrophe. One that can do either opens before a word and closes after one;
    the nearest mark on each side decides.
    """
    letter = lambda i: 0 <= i < len(text) and text[i].isalnum()

    def role(i: int) -> str:
        before, after = letter(i - 1), letter(i + 1)
        if before and after:
            return ""
        c = text[i]
        if c in EITHER:
            # After the end of a sentence a mark closes as well.
            before = before or (i > 0 and text[i - 1] in ".,!?;:)…")
            return "both" if before == after else "close" if before else "open"
        return "open" if c in OPENING else "close" if c in CLOSING else ""

    left = next((r for i in range(start - 1, max(-1, start - 1 - REACH), -1) if (r := role(i))), "")
    right = next((r for i in range(end, min(len(text), end + REACH)) if (r := role(i))), "")
    return left in ("open", "both") and right in ("close", "both")


def undisguised(word: str) -> str:
    """A word with digits as the letters they look like and runs of three or more of one letter as one."""
    if not word.isdigit() and any(c.isdigit() for c in word):
        word = word.translate(DISGUISES)
    return re.sub(r"(.)\1{2,}", r"\1", word)


class LexiconAutomaton:
    """The product of a lexicon trie with the Levenshtein automata of its terms, made deterministic as it is used.

    An edit is a letter put in, left out or changed, or two neighbours swapped. A state is a set of (trie node,
    edits so far, swapped letter still owed); ``step`` is memoised, so that scanning a word costs one
    dictionary lookup a letter and stops at the letter where no term is in reach. Stems accept any ending
    and may have one edit, but a word that only begins a stem isn't a misspelling of it.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        for entry, store in [(t, self.term) for t in terms] + [(s, self.stem) for s in stems]:
            node = 0
            for c in entry:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.children[node][c] = nxt
                node = nxt
            store[node] = entry
        self.most = max([edits(len(t)) for t in terms] + [1] * bool(stems), default=0)
        self._begin()

    def _begin(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._closure({(0, 0, "")}))

    def _closure(self, items: set) -> frozenset:
        """Adds what is reached by leaving out letters of a term; keeps the fewest edits for each place."""
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, e, owed = todo.pop()
            if best.get((node, owed), 99) <= e:
                continue
            best[node, owed] = e
            if e < self.most and not owed:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        return frozenset((node, e, owed) for (node, owed), e in best.items())

    def _state(self, items: frozenset) -> int:
        at = self.number.get(items)
        if at is None:
            at = self.number[items] = len(self.states)
            self.states.append(items)
            self.moves.append({})
        return at

    def step(self, state: int, char: str) -> int:
        to = self.moves[state].get(char)
        if to is None:
            nxt = set()
            for node, e, owed in self.states[state]:
                if owed:
                    # The second of two swapped letters must follow.
                    if owed == char:
                        nxt.add((node, e, ""))
                    continue
                for c, child in self.children[node].items():
                    if c == char:
                        nxt.add((child, e, ""))
                    elif e < self.most:
                        nxt.add((child, e + 1, ""))
                        if char in self.children[child]:
                            nxt.add((self.children[child][char], e + 1, c))
                if e < self.most:
                    nxt.add((node, e + 1, ""))
            to = self.moves[state][char] = self._state(self._closure(nxt))
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest entry in reach and its distance, a stem counted without its ending. Ties: alphabetical."""
        if len(self.states) > STATES:
            self._begin()
        state = self.start
        found: set[tuple[int, str]] = set()
        for i, char in enumerate(word):
            state = self.step(state, char)
            items = self.states[state]
            if not items:
                break
            if self.stem and i >= 2:
                for node, e, owed in items:
                    if node in self.stem and not owed:
                        if e == 0:
                            return self.stem[node] + "*", 0
                        if e == 1 and not self.stem[node].startswith(word):
                            found.add((1, self.stem[node] + "*"))
        found |= {(e, self.term[node]) for node, e, owed in self.states[state] if not owed and node in self.term and e <= edits(len(self.term[node]))}
        return (min(found)[1], min(found)[0]) if found else None


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    #: Ordinary words in reach of an entry.
    clean: frozenset = frozenset()
    #: Of entries with rare words around them: the chance that a word in reach is a misspelling and no other word.
    trust: dict = field(default_factory=dict)
    #: Probability that a document is toxic without any hit.
    base: float = 0.01
    #: Logistic weights of a document with hits: bias, quotation, address, hits by length.
    weights: tuple = (1.0, -7.0, 0.5, 2.0)


class Hits(list):
    """The hits of a text, and how many words it has."""

    n_words = 0


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial, by its first terms; enough for k above the mean."""
    if k <= 0:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, math.exp(log)
    for i in range(k, n + 1):
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p)
        if term < total * 1e-9:
            break
    return min(1.0, total)


def _significant(df1: Counter, df0: Counter, rate: float, precision: float) -> dict[str, float]:
    """Entries that toxic documents have more often than chance, with the number of testable entries held against them."""
    frequent = Counter(df1[w] + df0[w] for w in df1)
    at_least, running = {}, 0
    for n in sorted(frequent, reverse=True):
        running += frequent[n]
        at_least[n] = running
    out = {}
    for w, a in df1.items():
        n = a + df0[w]
        if a >= 3 and a >= precision * n and _tail(a, n, rate) * at_least[n] <= 0.2:
            out[w] = a / n
    return out


def train(rows: list[tuple[str, int]]) -> ToxicityModel:
    """Learn the lexicon from (text, toxic) rows by significance, then the weights of hits and their contexts.

    Without rows of both labels the lexicon is empty and every document gets the base probability.
    """
    n1 = sum(int(y) for _, y in rows)
    if not n1 or n1 == len(rows):
        return ToxicityModel(base=min(0.99, max(0.01, n1 / len(rows))) if rows else 0.01)
    rate = n1 / len(rows)
    df = (Counter(), Counter())
    pre = (Counter(), Counter())
    for text, y in rows:
        own = {w for w in WORD.findall((text or "").lower()) if len(w) >= 3 and not w.isdigit()}
        df[int(y)].update(own)
        pre[int(y)].update({w[:k] for w in own for k in range(4, min(9, len(w)))})
    lexicon = _significant(df[1], df[0], rate, 0.8)
    candidates = _significant(pre[1], pre[0], rate, 0.95)
    # Copies of a toxic document would make any of its words significant: only uses with different neighbours count.
    used = ({}, {})
    for text, y in rows:
        found = WORD.findall((text or "").lower())
        for i, w in enumerate(found):
            for entry in [w] * (w in lexicon) + [w[:k] + "*" for k in range(4, min(9, len(w))) if w[:k] in candidates]:
                used[int(y)].setdefault(entry, set()).add((found[i - 1] if i else "", found[i + 1] if i + 1 < len(found) else ""))
    fewer = [Counter({e: len(v) for e, v in side.items()}) for side in used]
    for y in (0, 1):
        for w in lexicon:
            df[y][w] = min(df[y][w], fewer[y][w])
        for s in candidates:
            pre[y][s] = min(pre[y][s], fewer[y][s + "*"])
    lexicon = {w: v for w, v in _significant(df[1], df[0], rate, 0.8).items() if w in lexicon}
    candidates = {s: v for s, v in _significant(pre[1], pre[0], rate, 0.95).items() if s in candidates}
    stems: list[str] = []
    for s in sorted(candidates, key=lambda s: (len(s), s)):
        endings = [w for w in df[1] if w.startswith(s)]
        if len(endings) >= 4 and max(df[1][w] for w in endings) < 0.7 * pre[1][s] and not any(s.startswith(x) or x.startswith(s) for x in stems):
            while longer := [t for t in candidates if len(t) == len(s) + 1 and t.startswith(s) and pre[1][t] >= 0.95 * pre[1][s]]:
                s = longer[0]
            stems.append(s)
    terms = sorted(lexicon)
    automaton = LexiconAutomaton(terms, stems)
    clean = set()
    once = (Counter(), Counter())
    for w in df[0].keys() | df[1].keys():
        hit = automaton.match(w)
        if hit and hit[1]:
            # A word unseen so far is as likely an ordinary one as words seen once are (Good and Turing).
            if df[0][w] + df[1][w] == 1:
                once[df[1][w]][hit[0]] += 1
            if df[0][w] and df[1][w] <= 2 * rate * (df[0][w] + df[1][w]):
                clean.add(w)
    trust = {t: (once[1][t] + 1) / (once[1][t] + once[0][t] + 1) for t in once[0]}
    model = ToxicityModel(terms, stems, frozenset(clean), trust)
    scorer = Scorer(model)
    x, y, without = [], [], [0, 0]
    for t, label in rows:
        f = scorer.features(t)
        if f is None:
            without[int(label)] += 1
        else:
            x.append(f[1:])
            y.append(int(label))
    model.base = min(0.45, (without[1] + 0.5) / (sum(without) + 1.0))
    model.weights = _logistic(np.array(x).reshape(len(x), 3), np.array(y, dtype=float), np.array(model.weights))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 60) -> tuple:
    """Newton steps for a logistic fit that is drawn to ``prior``, which also stands where there is no evidence."""
    w = prior.astype(float).copy()
    if not len(y):
        return tuple(w)
    a = np.hstack([np.ones((len(x), 1)), x])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + strength * (w - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return tuple(w)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = LexiconAutomaton(model.terms, model.stems)
        self.memo = Memo(self._look)

    def _look(self, word: str):
        if word in self.model.clean:
            return None
        hit = self.automaton.match(word)
        if hit is None and (plain := undisguised(word)) != word:
            hit = self.automaton.match(plain)
            hit = (hit[0], 1) if hit and hit[1] == 0 else None
        return hit

    def hits(self, text: str) -> Hits:
        """Every hit with its place, distance and whether its context is quotation or address."""
        low = text.lower()
        memo = self.memo
        found, out = WORD.findall(low), Hits()
        out.n_words = len(found)
        if not any(map(memo.__getitem__, set(found))):
            return out
        found = list(WORD.finditer(low))
        for i, m in enumerate(found):
            hit = memo[m[0]]
            if not hit:
                continue
            near = [x[0] for x in found[max(0, i - WINDOW) : i + WINDOW + 1]]
            told = any(w in REPORTING for w in near)
            out.append(
                {
                    "start": m.start(), "end": m.end(), "term": hit[0], "distance": hit[1],
                    "quoted": float(quoted(low, m.start(), m.end())) + 0.5 * float(told), "address": float(any(w in ADDRESS for w in near)),
                }
            )
        return out

    def trust(self, hit: dict) -> float:
        """The chance that a hit is the term or a misspelling of it."""
        return self.model.trust.get(hit["term"], 1.0) ** hit["distance"]

    def features(self, text: str | None, hits: Hits | None = None) -> list[float] | None:
        """Of the strongest hit its trust (1 if exact), quotation and address, and how many hits there are for the text's length.

        Words that only look like a term turn up by chance in any long text, while abuse has many hits for its length.
        The last number is the logarithm of the trusted hits in a thousand words, 0 at ten. None without a hit.
        """
        hits = self.hits(text or "") if hits is None else hits
        if not hits:
            return None
        top = min(hits, key=lambda h: (h["distance"] > 0, h["quoted"], -self.trust(h), -h["address"], h["distance"]))
        often = 1000 * sum(map(self.trust, hits)) / max(LEAST_WORDS, hits.n_words)
        return [self.trust(top), top["quoted"], top["address"], math.log((often + 0.1) / 10.1)]

    def score(self, hits: Hits) -> float:
        """Base probability without a hit; else the chance that its hits are abuse."""
        f = self.features(None, hits)
        if f is None:
            return self.model.base
        z = float(np.dot(self.model.weights, [1.0, *f[1:]]))
        abuse = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return f[0] * abuse + (1 - f[0]) * self.model.base


def fit(docs: DataFrame, labels: DataFrame, train_on=None, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> ToxicityModel:
    """Fit on about ``rows`` labelled documents with ``chars`` characters at most, chosen by a hash of id and text.

    Both numbers bound what is collected: where all labelled texts have more, a smaller share is chosen. A document with
    several labels counts as toxic if one of them says so; rows that repeat id and text count once. Rows with a null
    id or label are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").alias("y")).where("i is not null and y is not null")
    if train_on is not None:
        known = known.where(train_on(F.col("i")))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("i")), F.lit(2**31)) < int(rows / total * 2**31))
    # The sample is bounded by ``rows``, so it may be broadcast: the texts are filtered where they are read.
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).join(F.broadcast(known), "i")
    texts = written(texts.distinct(), "toxicity-sample")
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.length("t"))).first()
    share = min(1.0, rows / max(1, n), chars / max(1, size or 0))
    # A little above the expectation of ``rows`` is chance, far above it many texts of one id.
    if n > 1.2 * rows or (size or 0) > chars:
        texts = texts.where(F.pmod(F.xxhash64(F.lit("text"), "i", "t"), F.lit(2**31)) < int(share * 2**31))
    return train([(r["t"], r["y"]) for r in texts.orderBy("i").select("t", "y").toLocalIterator()])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, score, hits [(start, end, term, distance, quoted)].

    A null or empty text has no hit and gets the base score. Whole texts are read; other columns are not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        scorer = _scorer(shared)
        for pdf in by_size(batches, "text"):
            hits = [scorer.hits(t or "") for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].to_numpy(),
                    "score": [scorer.score(h) for h in hits],
                    "hits": [[{k: x[k] for k in ("start", "end", "term", "distance", "quoted")} for x in h] for h in hits],
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double, hits array<struct<start:int,end:int,term:string,distance:int,quoted:double>>")


def _scorer(shared) -> Scorer:
    return held(hash(shared.value), lambda: Scorer(pickle.loads(shared.value)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Fit on the labels outside the held-out fold and score all documents: doc_id, held_out, score, predicted, n_hits.

    A row without an id is in no fold: it is never learned from, and its held_out is false.
    """
    model = fit(docs, labels, lambda i: crc_mod(i, folds) != held_out)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("hits").cast("long").alias("n_hits"),
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns and types.

    Each row is scored where it is read, so no join and no shuffle is needed, and rows with null or repeated
    ids are decided each by its own text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        scorer = _scorer(shared)
        return pd.Series([scorer.score(scorer.hits(t or "")) for t in texts])

    return docs.where(scored(F.col(text_col)) < threshold)
