"""Fill-in-middle transformation: one numpy kernel over the UTF-8 buffers of a whole Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the three parts, as bytes of the text.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = pa.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
#: Bytes of text that the kernel works on at once; a longer text is worked on alone, whole.
CHUNK_BYTES = 4_000_000


def _byte_classes() -> np.ndarray:
    """For each byte: 0 inside a character, 1 an ASCII letter, 2 the beginning of any other character."""
    out = np.full(256, 2, dtype=np.uint8)
    out[0x80:0xC0] = 0
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = 1
    return out


BYTE_CLASS = _byte_classes()
_INITIAL = np.isin(np.arange(256), np.frombuffer(b"PSM", np.uint8))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the places where its texts begin and end."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield begin, end
        begin = end


def gather(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``source`` that begin at ``begin``, laid end to end."""
    kind = np.int32 if len(source) < 2**31 and size.sum() < 2**31 else np.int64
    at = np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size)
    at += np.arange(len(at), dtype=kind)
    return source[at]


def _upto(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place."""
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts contain a mark."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    if len(data) >= 3:
        at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & _INITIAL[data[1:-1]])
        row = np.searchsorted(offsets, at, side="right") - 1
        out[row[at + 2 < offsets[row + 1]]] = True
    return out


def transform(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, plain_percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars and the bytes and ends of the outputs of all texts of a batch; ``h`` is 4 numbers a text."""
    begin, end = offsets[:-1], offsets[1:]
    kind = BYTE_CLASS[data]
    first = np.zeros(len(data), dtype=bool)
    first[begin[begin < end]] = True
    # A letter begins a token where the byte before it is none, any other character always does.
    after_letter = np.concatenate([[False], kind[:-1] == 1])[: len(kind)] & ~first
    units = _upto((kind == 2) | ((kind == 1) & ~after_letter))
    base = units[begin]
    n = units[end] - base
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    # Token k of a text begins where the running count first passes its base and k; the place after the last one is the text's end.
    low, high = (np.searchsorted(units[1:], base + k + 1) for k in (np.minimum(a, b), np.maximum(a, b)))
    plain = (n == 0) | _marked(data, offsets) | (h[:, 2] % 100 >= 100 - plain_percent)
    form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm_percent, SPM, PSM))
    chars = _upto(kind != 0)
    marks = len(data) + 3 * np.arange(3)
    source = np.concatenate([data, np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)])
    # Six runs an output: a mark before each of prefix, suffix and middle; a plain one is one run.
    parts = {"P": (marks[0], begin, low), "S": (marks[1], high, end), "M": (marks[2], low, high)}
    starts, sizes = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for code, order in ((PSM, "PSM"), (SPM, "SPM")):
        rows = form == code
        for i, name in enumerate(order):
            mark, lo, hi = parts[name]
            starts[rows, 2 * i], sizes[rows, 2 * i] = mark, 3
            starts[rows, 2 * i + 1], sizes[rows, 2 * i + 1] = lo[rows], (hi - lo)[rows]
    starts[plain, 0], sizes[plain, 0] = begin[plain], (end - begin)[plain]
    out = gather(source, starts.ravel(), sizes.ravel())
    return n, form, chars[low] - chars[begin], chars[high] - chars[low], out, np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])


def string_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string array of the bytes ``data``, cut at ``ends``."""
    wide = ends[-1] >= 2**31
    kind = pa.large_string() if wide else pa.string()
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row per row: doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain), output.

    A text is cut into tokens, runs of ASCII letters or any other single character, and two token places of it are drawn from the
    hash of ``seed`` and its id. psm gives ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm begins with the suffix. Texts that are
    empty or contain a mark stay plain, and so do ``plain_percent`` of all; of the others ``spm_percent`` become spm.

    Null text: empty, so plain. Null id: drawn as an id without digits. Repeated rows give repeated results; an empty table gives
    none; other columns are not read. There is no shuffle: each row is made from itself alone.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *drawn)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            h = np.stack([batch.column(f"h{i}").to_numpy() for i in range(4)], axis=1)
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                own = offsets[lo : hi + 1]
                n, form, prefix, middle, out, ends = transform(data[own[0] : own[-1]], own - own[0], h[lo:hi], plain_percent, spm_percent)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), FORMS.take(pa.array(form)), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), string_array(out, ends)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Each mark stands in it once, since a text with one stays plain."""
    after = lambda text, mark: F.substring_index(text, mark.decode(), -1)
    before = lambda text, mark: F.substring_index(text, mark.decode(), 1)
    middle = after(output, MIDDLE)
    head = before(output, MIDDLE)
    psm = F.concat(before(after(head, PREFIX), SUFFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, before(after(head, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars with SHA-256 of the output and of the text rebuilt from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
