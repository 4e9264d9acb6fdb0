"""Best-fit packing of tokenised documents by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import json
import pickle
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, islice
from operator import ge
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.llm.text import by_size, give_back, held, small_batches, unpickled
from gridfolio.session import written

CAPACITY = 4096
END_ID = 1
#: Nodes that one completion search may visit before the best filling so far is taken. It bounds the time of a
#: search, not the documents: all of them are packed.
NODES = 4000
#: Nodes that the branch and bound may visit in all where the greedy packing misses the lower bound. It bounds the
#: time of the driver, not the pieces, and is the same for all tables.
SEARCH = 400_000
#: Fillings that one of its nodes branches over, and different lengths up to which a node is bounded by lower_bound.
FILLINGS = 200
BOUNDED = 48
#: Words whose ids a worker remembers from one task to the next, about 200 bytes each.
KEPT_WORDS = 100_000
#: Rows of one length that are numbered together, and groups of them whose sizes are summed together.
ROWS_PER_SALT = 256
SALTS_PER_BLOCK = 4096


def _classes() -> np.ndarray:
    """For code points of plain text: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x2100, 3, dtype=np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 0 if chr(c).isspace() else {"L": 1, "N": 2}.get(kind, 3)
    return out


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, laid end to end."""
    # Places fit 32 bits, which halves what is moved; only very large arrays need more.
    kind = np.int32 if len(values) < 2**31 and sizes.sum() < 2**31 else np.int64
    upto = np.cumsum(sizes) - sizes
    at = np.repeat((starts - upto).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return values[at]


class _Runs:
    """Runs of numbers kept end to end in one array that grows."""

    def __init__(self, dtype: str):
        self.values, self.ends = np.zeros(1 << 16, dtype=dtype), np.zeros(1 << 16, dtype=np.int64)
        self.used = self.n = 0

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + len(ends) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[self.used : self.used + len(values)] = values
        self.ends[self.n + 1 : self.n + 1 + len(ends)] = self.used + ends
        self.used += len(values)
        self.n += len(ends)

    def cut(self, n: int) -> None:
        """Keep the first ``n`` runs."""
        self.n, self.used = n, int(self.ends[n])
        self.values, self.ends = self.values[: max(1, self.used)].copy(), self.ends[: n + 1].copy()

    def bounds(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.ends[number]
        return begin, self.ends[number + 1] - begin


class PieceEncoder:
    """Token ids of whole texts, the same as the library gives them, with the ids of each word remembered.

    A vocabulary of this kind splits a text into words and encodes each by itself, so a word needs to be encoded once. Words
    of a batch are found, hashed and looked up in arrays, and compared with the words that their hash stands for. That is
    done for texts of Latin letters and common
    punctuation; any other text, one with a special token's opening, and one with an apostrophe that may begin
    a contraction go through the library as a whole. So does every text where the file describes another normaliser,
    word split or mark of word ends than the ones known here.
    """

    PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]*")
    CONTRACTION = re.compile("'[stmdrvl]", re.I)
    CLASSES = _classes()
    #: What a tokenizer file says that works this way.
    NORMALISERS = ("NFC", "Replace", "Lowercase")
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        about = json.loads(self.tokenizer.to_str())
        # The vocabulary marks the last token of a word by its suffix.
        suffix = about["model"].get("end_of_word_suffix")
        self.known = bool(suffix) and self._known(about)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items() if self.known else ():
            self.last[i] = token.endswith(suffix)
        self.factors = np.random.default_rng(1).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def _known(self, about: dict) -> bool:
        normalisers = tuple(n["type"] for n in (about["normalizer"] or {}).get("normalizers", []))
        splits = [p["pattern"].get("Regex") for p in (about["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        return about["model"]["type"] == "BPE" and normalisers == self.NORMALISERS and splits == [self.SPLIT]

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.spelling = _Runs("<u4"), _Runs("<u4")

    def keep(self, n: int) -> None:
        """Forget all but the first ``n`` words: those that come first are the frequent ones."""
        if len(self.number) > n:
            self.number = dict(islice(self.number.items(), n))
            self.ids.cut(n)
            self.spelling.cut(n)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        """Encode different words as one text, which the marks of last tokens cut into words again."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        n = len(self.number)
        self.ids.add(ids, ends)
        self.spelling.add(np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4"), np.cumsum([len(w) for w in words]))
        self.number.update(zip(hashes, range(n, n + len(words)), strict=True))

    def _plain(self, low: list[str]) -> list[bytes] | None:
        """The ids of plain lower-case texts, laid end to end with blanks between; None if two words share a hash."""
        joined = " " + " ".join(low) + " "
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kind = self.CLASSES[codes]
        # A run of one class is a word, but each number is one by itself.
        edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)]))
        size = np.diff(np.append(edge, len(codes)))
        while len(self.factors) < size.max():
            more = np.random.default_rng(len(self.factors)).integers(1, 2**63, len(self.factors), dtype=np.uint64)
            self.factors = np.concatenate([self.factors, more * np.uint64(2) + np.uint64(1)])
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(edge.astype(np.int32), size)
        hashed = np.add.reduceat((codes + np.uint64(1)) * self.factors[place], edge)
        word = kind[edge] > 0
        first, size, hashed = edge[word], size[word], hashed[word]
        code, different = pd.factorize(hashed)
        known = different.tolist()
        missing = [i for i, h in enumerate(known) if h not in self.number]
        if len(self.number) + len(missing) > self.limit:
            self.keep(KEPT_WORDS)
            missing = [i for i, h in enumerate(known) if h not in self.number]
        at = np.zeros(len(known), dtype=np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]
        for k in range(0, len(missing), 50_000):
            part = missing[k : k + 50_000]
            self._learn([known[i] for i in part], [joined[first[at[i]] : first[at[i]] + size[at[i]]] for i in part])
        numbers = np.fromiter(map(self.number.__getitem__, known), dtype=np.int64, count=len(known))
        # The words of the batch are compared with the first of their hash, and those with the remembered ones.
        begin, long = self.spelling.bounds(numbers)
        if (size != size[at][code]).any() or (long != size[at]).any():
            return None
        own, other = _gather(codes, first, size), _gather(codes, first[at][code], size)
        if (own != other).any() or (_gather(codes, first[at], long) != _gather(self.spelling.values, begin, long)).any():
            return None
        begin, count = self.ids.bounds(numbers[code])
        raw = _gather(self.ids.values, begin, count).tobytes()
        upto = np.concatenate([[0], np.cumsum(count)])
        cuts = 4 * upto[np.searchsorted(first, np.cumsum([1] + [len(t) + 1 for t in low]))]
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, without special tokens of the library's own."""
        low = [t.replace("Σ", "σ").lower() for t in texts]
        plain = [self.known and "<|" not in t and bool(self.PLAIN.fullmatch(t)) and not self.CONTRACTION.search(t) for t in low]
        fast = self._plain([t for t, p in zip(low, plain, strict=True) if p]) if any(plain) else None
        if fast is None:
            plain, fast = [False] * len(texts), []
        ready = iter(fast)
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [next(ready) if p else whole(t) for t, p in zip(texts, plain, strict=True)]


def encoder(path: str) -> PieceEncoder:
    return held(("encoder", path), lambda: PieceEncoder(path))


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary).

    A document is the ids of its text (null: empty) and ``end_id``; only one longer than ``capacity`` is cut.
    """

    def run(batches):
        own = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in by_size(batches, "text", 1_000_000):
            out = []
            for doc_id, ids in zip(pdf["doc_id"], own.encode([t or "" for t in pdf["text"]]), strict=True):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), part)[: len(columns)])
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
        # A worker that waits for its next task holds a bounded number of words.
        own.keep(KEPT_WORDS)
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, schema)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs.

    The largest of: the sum bound; for each threshold the large items plus what small ones overflow; and for each
    k the items of which a sequence holds k at most, by their number.
    """
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for a in [k for k in sizes if k <= capacity // 2] + [0]:
        alone = sum(counts[k] for k in sizes if k > capacity - a)
        large = {k: counts[k] for k in sizes if capacity // 2 < k <= capacity - a}
        room = sum((capacity - k) * n for k, n in large.items())
        small = sum(k * counts[k] for k in sizes if a <= k <= capacity // 2)
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    # Items of more than capacity / (k + 1): any k + 1 of them don't fit.
    several, at = 0, len(sizes)
    for k in range(1, capacity + 1):
        while at and sizes[at - 1] * (k + 1) > capacity:
            at -= 1
            several += counts[sizes[at]]
        best = max(best, -(-several // k))
        if not at:
            break
    return best


def _best_fit(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Always the largest item that still fits, as often as it can be taken: one step a size, not one an item."""
    out: list[int] = []
    i = bisect_right(sizes, room)
    while i and room:
        size = sizes[i - 1]
        n = min(counts.get(size, 0), room // size)
        out += [size] * n
        room -= size * n
        i = bisect_right(sizes, room, 0, i - 1)
    return out


def completion(sizes: list[int], counts: dict[int, int], room: int, nodes: int = NODES) -> list[int]:
    """The filling of ``room`` with the least waste among the undominated ones, larger items first.

    The incumbent is best fit, which takes no nodes. The search goes through sizes with their multiplicities, most
    of the largest first, on a stack of its own; a branch is pruned when even all the items it may still take would
    waste as much as the incumbent. An exact fill ends the search, since nothing dominates it, and of exact fills
    the first has the fewest and largest items.
    """
    best = _best_fit(sizes, counts, room)
    best_waste = room - sum(best)
    within = list(accumulate(k * max(0, counts.get(k, 0)) for k in sizes))
    visited = 0
    # Of each level: the room before it, the size it takes, and how many of them.
    levels: list[list[int]] = []
    room_left, i = room, bisect_right(sizes, room) - 1
    while best_waste and visited <= nodes:
        if i >= 0 and room_left - within[i] < best_waste:
            size = sizes[i]
            n = min(counts.get(size, 0), room_left // size)
            if n > 0:
                visited += 1
                levels.append([room_left, i, n])
                room_left -= size * n
                if room_left < best_waste:
                    best, best_waste = [sizes[j] for _, j, m in levels for _ in range(m)], room_left
                i = bisect_right(sizes, room_left, 0, i) - 1
            else:
                i -= 1
        elif levels:
            # One item less of the last size; without any, the next smaller size takes its place.
            level = levels[-1]
            level[2] -= 1
            i = level[1] - 1
            if level[2]:
                visited += 1
                room_left = level[0] - sizes[level[1]] * level[2]
                i = bisect_right(sizes, room_left, 0, i + 1) - 1
            else:
                room_left = levels.pop()[0]
        else:
            break
    return best


def _greedy(counts: dict[int, int], capacity: int, nodes: int) -> list[tuple[tuple[int, ...], int]]:
    left = {k: n for k, n in counts.items() if n > 0}
    sizes = sorted(left)
    out = []
    while sizes:
        top = sizes[-1]
        left[top] -= 1
        filling = completion(sizes, left, capacity - top, nodes)
        left[top] += 1
        pattern = Counter([top, *filling])
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                sizes.pop(bisect_right(sizes, k) - 1)
        out.append((tuple(sorted(pattern.elements(), reverse=True)), times))
    return out


def _fillings(sizes: list[int], left: dict[int, int], room: int, slack: int, nodes: int) -> tuple[list[tuple[tuple[int, int], ...]], int, bool]:
    """Maximal fillings of ``room`` as (size, times), least waste first, without those that another one dominates.

    Only those that waste ``slack`` at most count. Also gives the nodes visited, and whether that were all.
    """
    found: list[tuple[tuple[int, int], ...]] = []
    within = list(accumulate(k * left[k] for k in sizes))
    visited = 0
    levels: list[list[int]] = []
    room_left, i = room, bisect_right(sizes, room) - 1
    while visited <= nodes and len(found) < FILLINGS:
        if i >= 0 and room_left - within[i] <= slack:
            visited += 1
            n = min(left[sizes[i]], room_left // sizes[i])
            levels.append([room_left, i, n])
            room_left -= sizes[i] * n
            i = bisect_right(sizes, room_left, 0, i) - 1
            continue
        if i < 0 and room_left <= slack:
            own = tuple((sizes[j], m) for _, j, m in levels if m)
            taken = dict(own)
            if all(left[k] <= taken.get(k, 0) for k in sizes[: bisect_right(sizes, room_left)]):
                found.append(own)
        # One item less of the last size that has one.
        while levels and not levels[-1][2]:
            levels.pop()
        if not levels:
            break
        visited += 1
        level = levels[-1]
        level[2] -= 1
        room_left = level[0] - sizes[level[1]] * level[2]
        i = bisect_right(sizes, room_left, 0, level[1]) - 1
    whole = visited <= nodes and len(found) < FILLINGS
    items = {f: [k for k, m in f for _ in range(m)] for f in found}
    kept: list[tuple[tuple[int, int], ...]] = []
    for f in sorted(items, key=lambda f: (-sum(items[f]), len(items[f]), [-x for x in items[f]])):
        if not any(len(items[g]) == len(items[f]) and all(map(ge, items[g], items[f])) for g in kept):
            kept.append(f)
    return kept, visited + len(sizes) // 8, whole


def _search(counts: dict[int, int], capacity: int, bins: int, bound: int, budget: int) -> list[tuple[tuple[int, ...], int]] | None:
    """Branch and bound for a packing into fewer than ``bins`` sequences; None if none was found.

    A node packs the largest length left: into each of its undominated patterns, as often as the lengths and the
    waste that is still allowed permit, or half as often, and so on down to once, so that any multiplicity can be
    reached. All but the first choice are discrepancies; they are allowed one, two, four ... at a time.
    """
    rng = Random(1)
    code = {k: rng.getrandbits(96) for k in sorted(counts)}
    total = sum(k * n for k, n in counts.items())
    left = {k: n for k, n in counts.items() if n > 0}
    best: list[tuple[tuple[int, ...], int]] | None = None
    limit, spent, allowed, whole = bins, 0, 1, False
    while limit > bound and spent < budget and not whole:
        whole = True
        seen: dict[int, tuple[int, int]] = {}
        chosen: list[tuple[tuple[tuple[int, int], ...], int, int]] = []
        key = sum(code[k] * n for k, n in left.items())
        used, waste, rest, discrepancies = 0, 0, total, allowed

        def choices() -> list[tuple[tuple[tuple[int, int], ...], int, int]]:
            """Pattern, times and discrepancies of what may be done next, the first choice last."""
            nonlocal spent, whole
            slack = (limit - 1) * capacity - total - waste
            if slack < 0 or used + -(-rest // capacity) >= limit:
                return []
            before = seen.get(key)
            if before and before[0] <= used and before[1] >= discrepancies:
                return []
            seen[key] = (used, discrepancies)
            sizes = sorted(left)
            if len(sizes) <= BOUNDED:
                spent += len(sizes)
                if used + lower_bound(left, capacity) >= limit:
                    return []
            top = sizes[-1]
            left[top] -= 1
            fillings, visited, all_of_them = _fillings(sizes, left, capacity - top, slack, min(NODES, budget - spent))
            left[top] += 1
            spent += visited
            whole &= all_of_them
            out, fewer = [], []
            for f in fillings:
                own = Counter(dict(f))
                own[top] += 1
                pattern = tuple(sorted(own.items(), reverse=True))
                lost = capacity - sum(k * m for k, m in pattern)
                times = min(min(left[k] // m for k, m in pattern), slack // lost if lost else total)
                out.append((pattern, times, min(1, len(out))))
                while times > 1:
                    times //= 2
                    fewer.append((pattern, times, 1))
            return [*out, *fewer][::-1]

        def apply(pattern: tuple[tuple[int, int], ...], times: int) -> None:
            """Take the pattern out of what is left, or put it back for a negative number of times."""
            nonlocal key, used, waste, rest
            size = 0
            for k, m in pattern:
                n = left.get(k, 0) - m * times
                if n:
                    left[k] = n
                else:
                    del left[k]
                key -= code[k] * m * times
                size += k * m
            used += times
            rest -= size * times
            waste += (capacity - size) * times

        stack = [choices()]
        while stack and spent < budget:
            if stack[-1]:
                pattern, times, cost = stack[-1].pop()
                if cost > discrepancies:
                    whole = False
                    continue
                # What is allowed shrinks with each packing that is found.
                lost = capacity - sum(k * m for k, m in pattern)
                if lost * times > (limit - 1) * capacity - total - waste:
                    continue
                apply(pattern, times)
                chosen.append((pattern, times, cost))
                discrepancies -= cost
                if not rest:
                    best, limit = [(tuple(k for k, m in p for _ in range(m)), n) for p, n, _ in chosen], used
                    if limit <= bound:
                        return best
                stack.append(choices() if rest else [])
            else:
                stack.pop()
                if chosen:
                    pattern, times, cost = chosen.pop()
                    apply(pattern, -times)
                    discrepancies += cost
        while chosen:
            pattern, times, _ = chosen.pop()
            apply(pattern, -times)
        allowed *= 2
    return best


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) with how often each is used; together they hold all pieces.

    A pattern is the best completion of the largest length left, and is used as often as its lengths allow, so
    the number of steps follows the number of different lengths, at most ``capacity``, and not the number of
    documents. Whatever the size, a result that misses the lower bound is the incumbent of a branch and bound.
    """
    out = _greedy(counts, capacity, nodes)
    bins, bound = sum(n for _, n in out), lower_bound(counts, capacity)
    if bins > bound:
        out = _search(counts, capacity, bins, bound, SEARCH) or out
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces a sequence, and first offset of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for size, n in sorted(Counter(pattern).items(), reverse=True):
            runs.setdefault(size, []).append((used[size], sequence, n, offset))
            used[size] += n * times
            offset += n * size
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (doc_id, piece, length, ...) its sequence_id and offset. ``pieces`` is read twice: pass a written table.

    Only the histogram of lengths reaches the driver, ``capacity`` numbers at most. A piece finds its place by
    its rank among the pieces of its length; ranks are counted in salted groups of about ROWS_PER_SALT rows.
    """
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}
    places = _places(solve(counts, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(pickle.dumps(places))
    salts = pieces.sparkSession.createDataFrame([(k, max(1, -(-n // ROWS_PER_SALT))) for k, n in counts.items()], "length long, salts long")
    # One row a length, ``capacity`` at most: small enough to broadcast whatever the number of documents.
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # Ranks begin after all earlier blocks of salts, and after the earlier salts of the block.
    sizes = sizes.withColumn("block", F.expr(f"salt div {SALTS_PER_BLOCK}"))
    blocks = sizes.groupBy("length", "block").agg(F.sum("n").alias("rows"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length", "block", F.coalesce(F.sum("rows").over(earlier("length", "block")), F.lit(0)).alias("from"))
    inside = sizes.withColumn("within", F.coalesce(F.sum("n").over(earlier("length", "block", "salt")), F.lit(0)))
    bases = inside.join(blocks, ["length", "block"]).select("length", "salt", (F.col("from") + F.col("within")).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(own) - 1)

    def run(batches):
        table = unpickled(shared)
        for pdf in batches:
            sequence = np.zeros(len(pdf), dtype=np.int64)
            offset = np.zeros(len(pdf), dtype=np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                first, base, each, start = table[int(size)]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                i = ranks[rows] - first[at]
                sequence[rows] = base[at] + i // each[at]
                offset[rows] = start[at] + i % each[at] * size
            yield pdf.assign(sequence_id=sequence, offset=offset).drop(columns=["rank"])

    columns = [c for c in pieces.columns if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids")
    return ranked.select(*columns, "rank").mapInPandas(run, f"{schema}, sequence_id long, offset long").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    A null or empty text is the end id alone. Rows that repeat an id are packed each for itself. An empty table
    gives no rows; columns other than the id and the text are not read. Texts are encoded where they are read
    and never shuffled: the written table holds about 40 bytes a piece.
    """
    with small_batches(docs.sparkSession):
        pieces = written(cut(docs, tokenizer_path, capacity, end_id, with_ids=False), "pieces")
    return pack(pieces, capacity)
