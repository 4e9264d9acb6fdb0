"""SentencePiece BPE in numpy: all words of a batch are merged together, round by round, and ids are decoded by gathering bytes."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.fim import chunks, gather, string_array, text_buffers
from gridfolio.llm.text import give_back, held

#: The sign that stands for a blank, what an unknown id is shown as, and what replaces a byte that is no text.
BLANK, UNKNOWN, REPLACEMENT = "▁", " ⁇ ", "�"
#: Numbers of the fields of a model file, its piece types and its model type.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
NORMAL, IS_UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Bytes of text whose words are merged together; a longer text is worked on alone, whole.
CHUNK_BYTES = 4_000_000
#: Symbols of a word from which it is finished pair by pair with a heap where a round would merge one pair of it only.
LONG_WORD = 256
NEVER = np.iinfo(np.int32).max


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


class PieceModel:
    """The tables of a model file, and the batch algorithms over them.

    A symbol is the id of a piece or, for a character that is no piece, OTHER + its code point. Only models are
    read whose results follow from these tables: BPE with byte fallback, no normalisation but the sign for blanks, no
    pieces that users defined or that are unused. Others are refused.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        raw = [dict(_fields(v)) for k, v in fields if k == PIECES]
        self.pieces = [p[1].decode() for p in raw]
        kinds = np.array([p.get(3, NORMAL) for p in raw])
        scores = np.array([np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0] for p in raw])
        trainer, normalizer, denormalizer = (dict(x for k, v in fields if k == part for x in _fields(v)) for part in (TRAINER, NORMALIZER, DENORMALIZER))
        plain = not normalizer.get(2) and not denormalizer.get(2) and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1 and normalizer.get(3, 1) == 1 and not trainer.get(24)
        if trainer.get(3) != BPE or not trainer.get(35) or not plain or np.isin(kinds, (USER_DEFINED, UNUSED)).any():
            raise ValueError("the model isn't a BPE model with byte fallback and without normalisation")
        self.end_id = next(i for i, p in enumerate(self.pieces) if kinds[i] == CONTROL and p == trainer.get(47, b"</s>").decode())
        self.unknown_shown = trainer.get(44, UNKNOWN.encode()).decode()
        self.kinds = kinds
        self.other = len(self.pieces)
        normal = np.flatnonzero(kinds == NORMAL)
        self._merges(normal, scores)
        self._characters(normal)
        by_value = sorted((int(self.pieces[i][3:5], 16), i) for i in np.flatnonzero(kinds == BYTE))
        self.byte_ids = np.array([i for _, i in by_value], dtype=np.int32)
        # What decoding shows of each id, and its decimal number, as bytes laid end to end.
        shown = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for value, i in by_value:
            shown[i] = bytes([value])
        for i in np.flatnonzero(kinds == CONTROL):
            shown[i] = b""
        for i in np.flatnonzero(kinds == IS_UNKNOWN):
            shown[i] = self.unknown_shown.encode()
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(s) for s in shown])
        self.shown_begin = np.cumsum(self.shown_size) - self.shown_size
        self.leading = np.array([p.startswith(BLANK) for p in self.pieces]) & (kinds == NORMAL)

    def _merges(self, normal: np.ndarray, scores: np.ndarray) -> None:
        """Which pairs of symbols make which piece, sorted by pair; the rank of a piece; and which pieces are safe.

        A piece is safe if no other has its rank and every merge with it as a part ranks after it: after one pair that makes
        it, the next best pair of a word is another that makes it, if there is one, so all of them may be merged at once.
        """
        known = {self.pieces[i]: int(i) for i in normal}
        symbol = {c: self.other + ord(c) for p in known for c in p} | known
        rank = np.full(self.other, NEVER, dtype=np.int64)
        rank[normal] = np.unique(-scores[normal], return_inverse=True)[1]
        made = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, piece = (np.array(x, dtype=np.int64) for x in zip(*made, strict=True))
        order = np.argsort(left << 21 | right)
        self.pair, self.makes = (left << 21 | right)[order], piece[order].astype(np.int32)
        self.rank = rank.astype(np.int32)
        after = np.full(self.other, NEVER, dtype=np.int64)
        for part in (left, right):
            inside = part < self.other
            np.minimum.at(after, part[inside], rank[piece[inside]])
        shared = np.bincount(rank[normal]) > 1
        self.safe = (after > rank) & ~np.append(shared, True)[np.minimum(rank, len(shared))]

    def _characters(self, normal: np.ndarray) -> None:
        """The symbol of every character, and which neighbours stand together in some piece.

        No merge joins two characters that stand together in no piece, so a text falls into words there that are encoded each by itself.
        """
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.other
        inside = sorted({c for i in normal if len(self.pieces[i]) > 1 for c in self.pieces[i]})
        self.class_of = np.zeros(0x110000, dtype=np.int16)
        self.class_of[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.together = np.zeros((len(inside) + 1, len(inside) + 1), dtype=bool)
        for i in normal:
            p = self.pieces[i]
            if len(p) == 1:
                self.symbol[ord(p)] = i
            at = self.class_of[[ord(c) for c in p]]
            self.together[at[:-1], at[1:]] = True

    def _best(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the merge of each pair of symbols; NEVER where there is none."""
        key = left.astype(np.int64) << 21 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = self.pair[at] == key
        piece = np.where(there, self.makes[at], 0)
        return np.where(there, self.rank[piece], NEVER).astype(np.int32), piece

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after all merges, and how many each word has left.

        A round finds the least rank of each word and merges the leftmost pair of that rank, or all of them from the left where the
        piece is safe. Words without a pair are put aside, so that later rounds are over fewer symbols.
        """
        words = np.arange(len(sizes))
        word = np.repeat(words, sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        symbols = symbols.copy()
        rank, piece = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], piece[inner] = self._best(symbols[inner], symbols[inner + 1])
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(word)))
            least = np.minimum.reduceat(rank, begin)
            open_ = least != NEVER
            if not open_.all():
                # Compaction: what is finished leaves the arrays.
                ended = np.repeat(~open_, size)
                done.append((word[ended], symbols[ended]))
                symbols, word, rank, piece = (x[~ended] for x in (symbols, word, rank, piece))
                continue
            hit = np.flatnonzero(rank == np.repeat(least, size))
            first = np.concatenate([[True], word[hit][1:] != word[hit][:-1]])
            safe = self.safe[piece[hit]]
            # Of neighbours that share a symbol the leftmost is merged, then every second.
            new_run = first | np.concatenate([[True], np.diff(hit) > 1])
            run = np.flatnonzero(new_run)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            slow = ~safe[first] & (size > LONG_WORD)
            if slow.any():
                for w, b, n in zip(word[begin[slow]].tolist(), begin[slow].tolist(), size[slow].tolist(), strict=True):
                    own = self._finish(symbols[b : b + n])
                    done.append((np.full(len(own), w), own))
                ended = np.repeat(slow, size)
                symbols, word, rank, piece = (x[~ended] for x in (symbols, word, rank, piece))
                continue
            at = hit[np.where(safe, place % 2 == 0, first)]
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, rank, piece = (x[keep] for x in (symbols, word, rank, piece))
            # Only pairs with a new symbol have a new rank.
            new = moved[at]
            touched = np.zeros(len(word) + 1, dtype=bool)
            touched[new] = touched[new - 1] = True
            changed = np.flatnonzero(touched[:-1])
            rank[changed] = NEVER
            changed = changed[changed + 1 < len(word)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], piece[changed] = self._best(symbols[changed], symbols[changed + 1])
        if not done:
            return symbols, sizes
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(sizes))

    def _finish(self, symbols: np.ndarray) -> np.ndarray:
        """One long word, pair by pair: the best rank first, then the leftmost."""
        own, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, piece = self._best(symbols[:-1], symbols[1:])
        queue = [(r, i, own[i], own[i + 1], p) for i, (r, p) in enumerate(zip(rank.tolist(), piece.tolist(), strict=True)) if r != NEVER]
        heapify(queue)
        memo: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int) -> None:
            j = after[i]
            if i < 0 or j >= n:
                return
            pair = own[i], own[j]
            if pair not in memo:
                r, p = self._best(np.array(pair[:1]), np.array(pair[1:]))
                memo[pair] = int(r[0]), int(p[0])
            r, p = memo[pair]
            if r != NEVER:
                heappush(queue, (r, i, *pair, p))

        while queue:
            _, i, left, right, p = heappop(queue)
            j = after[i]
            if own[i] != left or j >= n or own[j] != right:
                continue
            own[i], own[j] = p, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s in own if s >= 0], dtype=np.int32)

    def _ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols of words; a character that is no piece becomes its bytes."""
        other = symbols >= self.other
        if not other.any():
            return symbols.astype(np.int32), sizes
        raw = "".join(map(chr, (symbols[other] - self.other).tolist())).encode("utf-8", "surrogatepass")
        raw = np.frombuffer(raw, np.uint8)
        many = np.diff(np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw)))
        count = np.ones(len(symbols), dtype=np.int64)
        count[other] = many
        out = np.repeat(np.where(other, 0, symbols), count).astype(np.int32)
        out[np.repeat(other, count)] = self.byte_ids[raw]
        upto = np.concatenate([[0], np.cumsum(count)])
        return out, np.diff(upto[np.concatenate([[0], np.cumsum(sizes)])])

    def _different(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its spelling, and a word of each spelling: by a hash that is checked."""
        factors = np.random.default_rng(1).integers(1, 2**63, int(size.max()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
        code, seen = pd.factorize(np.add.reduceat((codes + np.uint64(1)) * factors[place], begin))
        chosen = np.zeros(len(seen), dtype=np.int64)
        chosen[code[::-1]] = np.arange(len(code))[::-1]
        one = chosen[code]
        if (size != size[one]).any() or (gather(codes, begin[one], size) != codes).any():
            return np.arange(len(size)), np.arange(len(size))
        return code, chosen

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch with an end id each, laid end to end, and where they end."""
        lead = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        length = np.diff(lead[offsets])
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        # A text that isn't empty begins with a sign for a blank.
        there = length > 0
        at = (np.cumsum(length) - length)[there]
        codes = np.insert(codes, at, ord(BLANK))
        codes[codes == ord(" ")] = ord(BLANK)
        text_begin = at + np.arange(len(at))
        counts = np.zeros(len(length), dtype=np.int64)
        ids = np.zeros(0, dtype=np.int32)
        if len(codes):
            kind = self.class_of[codes]
            edge = np.concatenate([[True], ~self.together[kind[:-1], kind[1:]]])
            edge[text_begin] = True
            begin = np.flatnonzero(edge)
            size = np.diff(np.append(begin, len(codes)))
            code, chosen = self._different(codes, begin, size)
            own, left = self.merge(self.symbol[gather(codes, begin[chosen], size[chosen])], size[chosen])
            own, left = self._ids(own, left)
            starts = np.cumsum(left) - left
            ids = gather(own, starts[code], left[code])
            upto = np.concatenate([[0], np.cumsum(left[code])])
            word = np.searchsorted(begin, np.append(text_begin, len(codes)))
            counts[there] = np.diff(upto[word])
        ends = np.cumsum(counts)
        return np.insert(ids, ends, self.end_id), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts of id lists laid end to end, and where they end. Ids that the model doesn't have raise IndexError."""
        size = self.shown_size[ids]
        begin = self.shown_begin[ids]
        # The sign for a blank that a text begins with isn't shown: the first id that isn't a control one loses it.
        seen = np.concatenate([[0], np.cumsum(self.kinds[ids] != CONTROL)])
        first = np.searchsorted(seen[1:], seen[ends[:-1]] + 1)
        first = first[first < ends[1:]]
        first = first[self.leading[ids[first]]]
        begin[first] += 1
        size[first] -= 1
        data = gather(self.shown, begin, size)
        upto = np.concatenate([[0], np.cumsum(size)])[ends]
        byte = self.kinds[ids] == BYTE
        # Bytes with a control id between them don't belong together, although nothing is shown between them.
        parted = np.flatnonzero((self.kinds[ids[:-1]] == CONTROL) & byte[1:])
        parted = set((np.searchsorted(ends, parted, side="right") - 1).tolist())
        if byte.any() and (parted or not _is_text(data.tobytes())):
            return self._repaired(ids, ends, data, upto, byte, parted)
        return data, upto

    def _repaired(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, upto: np.ndarray, byte: np.ndarray, parted: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Byte ids that together are no text become the sign of replacement, each by itself."""
        out = []
        for k in range(len(ends) - 1):
            raw = data[upto[k] : upto[k + 1]].tobytes()
            if k in parted or not _is_text(raw):
                raw = self._shown_slowly(ids[ends[k] : ends[k + 1]], byte[ends[k] : ends[k + 1]])
            out.append(raw)
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in out])]).astype(np.int64)

    def _shown_slowly(self, ids: np.ndarray, byte: np.ndarray) -> bytes:
        edge = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
        out, first = [], True
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
            raw = b"".join(self.shown[self.shown_begin[i] : self.shown_begin[i] + self.shown_size[i]].tobytes() for i in ids[lo:hi].tolist())
            if byte[lo]:
                raw = _readable(raw)
            elif first:
                told = [i for i in ids[lo:hi].tolist() if self.kinds[i] != CONTROL]
                raw = raw[1:] if told and self.leading[told[0]] else raw
            first = first and not byte[lo] and not (self.kinds[ids[lo:hi]] != CONTROL).any()
            out.append(raw)
        return b"".join(out)


def _readable(raw: bytes) -> bytes:
    """Whole characters as they are, every other byte as the sign of replacement."""
    out, at = [], 0
    while at < len(raw):
        size = next((n for n in range(1, 5) if at + n <= len(raw) and _is_text(raw[at : at + n])), 0)
        out.append(raw[at : at + size] if size else REPLACEMENT.encode())
        at += size or 1
    return b"".join(out)


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def model(path: str) -> PieceModel:
    return held(("pieces", path), lambda: PieceModel(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, ids (array of int): the ids of the whole text and an end id, as the library gives them.

    Null text: empty, so the end id alone. Repeated rows and null ids give a row each; an empty table gives none; other columns are
    not read. No shuffle: equal words of a batch are merged once, and a batch is bounded in bytes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        own = model(model_path)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                part = offsets[lo : hi + 1]
                ids, ends = own.encode(data[part[0] : part[-1]], part - part[0])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], names=["doc_id", "ids"])
        give_back()

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``text``: what the library's decode gives for their ids; null ids give null, an empty list the empty text."""
    columns = [c for c in encoded.columns if c != "text"]
    fields = encoded.select(*columns).schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def run(batches):
        own = model(model_path)
        for batch in batches:
            lists = batch.column(ids_col)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            for lo, hi in chunks(ends, CHUNK_BYTES):
                part = ends[lo : hi + 1]
                data, upto = own.decode(ids[part[0] : part[-1]], part - part[0])
                texts = string_array(data, upto)
                if lists.null_count:
                    told = lists.slice(lo, hi - lo).is_valid()
                    texts = pa.compute.if_else(told, texts, pa.scalar(None, texts.type))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in columns], texts], names=[*columns, "text"])
        give_back()

    return encoded.select(*columns).mapInArrow(run, schema)


def digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens with SHA-256 of the decimal ids, joined by blanks, and of the decoded text."""
    ids = F.sha2(F.array_join("ids", " "), 256)
    return decode(encoded, model_path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
