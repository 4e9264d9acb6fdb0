"""Language identification of mixed-language text: script ranges, word scores, Viterbi spans."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.text import by_size, crc_mod, unpickled
from gridfolio.session import written

#: First and last code point of the script ranges that are told apart.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF)),
}
#: Labelled documents a language that the model is fitted on, in expectation; more are not collected.
FIT_DOCUMENTS = 1500
#: Characters of them.
FIT_CHARS = 8_000_000
#: What a change of language between two words costs, in nats.
SWITCH = 6.0
#: Lengths of the letter n-grams, and the rows of the hashed table that holds their scores.
ORDERS = (2, 3, 4, 5)
BITS = 19
#: No single word counts for more, in nats.
WORST = 8.0
#: Characters scored at once.
CHUNK = 1_000_000
_NAMES = [*SCRIPTS, "other"]
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(8)], dtype=np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and the number of its script."""
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    script = np.full(0x110000, len(_NAMES) - 1, dtype=np.int8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            script[lo : hi + 1] = i
    return letter, script


LETTER, SCRIPT = _tables()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-case texts with 0 for all that is no letter, the starts of words, and words per text."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer(("\n" + "\n".join(low) + "\n" * max(ORDERS)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = LETTER[raw]
    points = np.where(letter, raw, 0).astype(np.uint64)
    starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.cumsum([len(t) + 1 for t in low])
    upto = np.searchsorted(starts, ends, "right") if len(ends) else np.zeros(0, dtype=np.int64)
    return points, starts, np.diff(upto, prepend=0)


def gram_rows(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The table row of the n-gram that starts at each place, and whether it lies in one word and its two ends.

    A 0 at either end is the word's boundary; one inside would span two words.
    """
    n = len(points) - order + 1
    h = np.full(n, order, dtype=np.uint64)
    whole = np.ones(n, dtype=bool)
    for k in range(order):
        h += (points[k : n + k] + np.uint64(1)) * _FACTORS[k]
        if 0 < k < order - 1:
            whole &= points[k : n + k] > 0
    if order == 2:
        whole &= (points[:n] > 0) | (points[1 : n + 1] > 0)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64), whole


@dataclass
class LanguageModel:
    """Log odds of hashed letter n-grams for each language, and the scripts that a language is written in."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray

    def word_scores(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores (words x languages) with the best language of a word at 0 and the others at -WORST at least.

        The script of a word narrows the candidates: a language that isn't written in it gets -WORST. A word in
        a script that no language uses scores 0 for all.
        """
        if not len(starts):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        at = np.zeros((len(points), len(self.langs)), dtype=np.float32)
        for order in ORDERS:
            rows, whole = gram_rows(points, order)
            at[: len(rows)] += self.table[np.where(whole, rows, 1 << BITS)]
        total = np.add.reduceat(at, starts - 1, axis=0) / len(ORDERS)
        total -= total.max(1, keepdims=True)
        allowed = self.scripts[SCRIPT[points[starts].astype(np.int64)]]
        total = np.where(allowed, np.maximum(total, -WORST), -WORST)
        total[~allowed.any(1)] = 0
        return total.astype(np.float32)


def train(rows: list[tuple[str, str]]) -> LanguageModel:
    """Fit on (text, lang) rows. Without rows the model has no language and predicts ``und``."""
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    counts = np.zeros((len(ORDERS), k, 1 << BITS), dtype=np.float32)
    scripts = np.zeros((len(_NAMES), k))
    for i, lang in enumerate(langs):
        own = [t or "" for t, x in rows if x == lang]
        for part in chunks(own):
            points, starts, _ = codes(part)
            scripts[:, i] += np.bincount(SCRIPT[points[starts].astype(np.int64)], minlength=len(_NAMES))
            for o, order in enumerate(ORDERS):
                at, whole = gram_rows(points, order)
                counts[o, i] += np.bincount(at[whole], minlength=1 << BITS)
    table = np.zeros(((1 << BITS) + 1, k), dtype=np.float32)
    if k:
        seen = counts.sum((0, 1)) > 1
        for o in range(len(ORDERS)):
            part = counts[o].T[seen]
            share = np.log((part + 0.5) / (part.sum(0) + 1.0))
            # The order with most of a row's count decides it; rows are rarely shared.
            main = counts[:, :, seen].sum(1).argmax(0) == o
            table[np.flatnonzero(seen)[main]] = (share - share.mean(1, keepdims=True))[main]
    allowed = scripts >= 0.01 * np.maximum(1, scripts.sum(0))
    return LanguageModel(langs, table, allowed)


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[list[str]]:
    part: list[str] = []
    total = 0
    for t in texts:
        part.append(t)
        total += len(t)
        if total >= size:
            yield part
            part, total = [], 0
    if part:
        yield part


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word for texts laid end to end in ``scores`` (words x languages).

    All texts advance by one word together, longest first, so that the work per step is one array operation.
    Staying costs nothing and any change costs ``switch``, so a step needs only the best state before it.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    k = scores.shape[1]
    back = np.zeros((len(scores), k), dtype=np.int16)
    label = np.zeros(len(scores), dtype=np.int16)
    live = int((sizes > 0).sum())
    state = np.zeros((live, k), dtype=np.float32)
    own = np.arange(k, dtype=np.int16)
    alive = [live]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        alive.append(live)
        at = starts[:live] + t
        now = state[:live]
        if t:
            best = now.argmax(1)
            jump = now[np.arange(live), best] - switch
            stay = now >= jump[:, None]
            back[at] = np.where(stay, own, best[:, None])
            now = np.where(stay, now, jump[:, None])
        state[:live] = now + scores[at]
    if not len(sizes) or not sizes[0]:
        return label
    here = state.argmax(1).astype(np.int16)
    for t in range(int(sizes[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:live] + t
        label[at] = here[:live]
        here[:live] = back[at, here[:live]]
    return label


def fit(docs: DataFrame, train_on=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = FIT_DOCUMENTS, chars: int = FIT_CHARS) -> LanguageModel:
    """Fit on a bounded sample: about ``documents`` whole texts of each language with ``chars`` characters at most, chosen by a hash of the text.

    Both numbers bound what is collected: where the texts of a language have more, a smaller share of them is chosen. Equal texts of a
    language count once, whatever their ids. ``train_on`` restricts the rows that may be learned from. Rows with a null language are left out.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    if train_on is not None:
        rows = rows.where(train_on(F.col("i")))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = written(_share(rows, "sample", {lang: documents / n for lang, n in sizes.items()}).select("t", "l").distinct(), "language-sample")
    # Texts of which there are many copies make the share of different texts larger than that of rows, and long ones count for more.
    held = {r["l"]: (r["n"], r["size"]) for r in part.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("size")).collect()}
    less = {lang: min(documents / n if n > 1.2 * documents else 1.0, chars / max(1, size)) for lang, (n, size) in held.items()}
    part = _share(part, "text", less)
    return train([(r["t"], r["l"]) for r in part.orderBy("l", F.xxhash64("t"), "t").toLocalIterator()])


def _share(rows: DataFrame, name: str, shares: dict[str, float]) -> DataFrame:
    """The rows whose text hashes low: a share of the rows of each language."""
    cut = F.lit(0).cast("long")
    for lang, share in shares.items():
        cut = F.when(F.col("l") == lang, F.lit(min(2**31, int(share * 2**31)))).otherwise(cut)
    return rows.where(F.pmod(F.xxhash64(F.lit(name), "t"), F.lit(2**31)) < cut)


def spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, spans [(start word, words, lang)].

    lang_pred is the language whose spans hold the most letters (ties: the alphabetically first) and score their
    share of the letters; ``und`` and 0 for a null text or one without a letter, or a model without languages.
    Whole texts are scored, however long; repeated rows give repeated results; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        own: LanguageModel = unpickled(shared)
        k = max(1, len(own.langs))
        for pdf in by_size(batches, "text", 8_000_000):
            scores, letters, sizes = [], [], []
            for part in chunks([t or "" for t in pdf["text"]]):
                points, starts, words = codes(part if own.langs else [""] * len(part))
                scores.append(own.word_scores(points, starts))
                letters.append(np.add.reduceat((points > 0).astype(np.int32), starts) if len(starts) else np.zeros(0, dtype=np.int32))
                sizes.append(words)
            sizes, letters = np.concatenate(sizes), np.concatenate(letters)
            label = viterbi(np.concatenate(scores), sizes, switch)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            share = np.bincount(doc * k + label, weights=letters, minlength=len(sizes) * k).reshape(len(sizes), k)
            total = share.sum(1)
            best = share.argmax(1)
            cuts = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])) if len(label) else np.zeros(0, dtype=np.int64)
            ends = np.append(cuts[1:], len(label))[: len(cuts)]
            found_spans: list[list[dict]] = [[] for _ in sizes]
            first = np.cumsum(sizes) - sizes
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                d = int(doc[a])
                found_spans[d].append({"start": a - int(first[d]), "words": b - a, "lang": own.langs[label[a]]})
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].to_numpy(),
                    "lang_pred": [own.langs[b] if t else "und" for b, t in zip(best, total, strict=True)],
                    "score": np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0),
                    "spans": found_spans,
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>")


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Fit on the documents outside the held-out fold and label all of them: doc_id, held_out, lang_pred, score, n_spans.

    A row without an id is in no fold: it is never learned from, and its held_out is false.
    """
    model = fit(docs, lambda i: crc_mod(i, folds) != held_out)
    return spans(docs, model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans")
    )
