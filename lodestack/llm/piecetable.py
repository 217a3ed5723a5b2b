"""Fill-in-the-middle by piece tables.

A document is a list of descriptors ``(buffer, start, end)`` over two immutable buffers, its own UTF-8 bytes
(0) and the sentinels (1). Cutting splits a descriptor and moves no text. A form is a permutation of the six
pieces P, S, M, prefix, middle, suffix; the inverse permutation of the pieces found in an output gives the text
back. Hashes and outputs are streamed from descriptors.

The plan of a document depends on its id and text alone, so reruns and any partitioning agree; the work is
row-local and shuffles nothing. Null text counts as empty; empty texts, texts that hold a sentinel and the rows
that the rate leaves out stay plain. A null id is planned as an empty string of digits. Repeated rows give
repeated, equal rows; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import kernel as K

SENTINELS = b"<P><S><M>"
TEXT, MARKS = 0, 1
_NAMES = ("<P>", "<S>", "<M>")
#: Places of the pieces P, S, M, prefix, middle, suffix in the output of each form.
ORDERS = {"psm": (0, 3, 1, 5, 2, 4), "spm": (1, 5, 0, 3, 2, 4)}


class Piece(NamedTuple):
    """A run of bytes of one buffer."""

    buffer: int
    start: int
    end: int


_SENTINEL_PIECES = [Piece(MARKS, k, k + 3) for k in (0, 3, 6)]


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    """The first ``at`` bytes of a piece, and the rest."""
    if not 0 <= at <= piece.end - piece.start:
        raise ValueError(f"{at} lies outside {piece}")
    return Piece(piece.buffer, piece.start, piece.start + at), Piece(piece.buffer, piece.start + at, piece.end)


def arranged(pieces: Sequence[Piece], order: Sequence[int]) -> list[Piece]:
    return [pieces[k] for k in order]


def inverse(order: Sequence[int]) -> tuple[int, ...]:
    """The permutation that undoes ``order``."""
    back = [0] * len(order)
    for place, k in enumerate(order):
        back[k] = place
    return tuple(back)


def stream(pieces: Sequence[Piece], buffers: Sequence[memoryview | bytes]) -> Iterator[memoryview]:
    """The bytes of the pieces in turn, uncopied."""
    for p in pieces:
        yield memoryview(buffers[p.buffer])[p.start : p.end]


def digest(pieces: Sequence[Piece], buffers: Sequence[memoryview | bytes]) -> str:
    """SHA-256 of what the pieces spell."""
    state = hashlib.sha256()
    for run in stream(pieces, buffers):
        state.update(run)
    return state.hexdigest()


def found_pieces(output: memoryview | bytes, form: str) -> list[Piece]:
    """The pieces of an output in its own order: descriptors over the output as text buffer.

    A sentinel begins with a character that can't end one, and the text held none, so each is found once.
    """
    raw = bytes(output)
    marks = [raw.index(SENTINELS[3 * k : 3 * k + 3]) for k in ORDERS[form] if k < 3]
    pieces = []
    for at, to in zip(marks, [*marks[1:], len(raw)], strict=True):
        pieces += [Piece(TEXT, at, at + 3), Piece(TEXT, at + 3, to)]
    return pieces


def restored_pieces(output: memoryview | bytes, form: str) -> list[Piece]:
    """Descriptors over an output that spell the text it was made from."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    return arranged(found_pieces(output, form), inverse(ORDERS[form]))[3:]


def _tokens(text: K.Text) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where tokens end, and the first of each document (one more).

    A token is a word with the white space before it; white space at a document's end is one more.
    """
    w = K.words(text)
    size = np.diff(text.offsets)
    last = np.where(np.diff(w.first) > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w) else 0, text.offsets[:-1])
    tail = (last < text.offsets[1:]) & (size > 0)
    ends = np.concatenate([w.end, text.offsets[1:][tail]])
    doc = np.concatenate([w.doc, np.flatnonzero(tail)])
    order = np.lexsort((ends, doc))
    return ends[order], np.searchsorted(doc[order], np.arange(len(text) + 1))


def _plan(seed: int, doc_id, n: int, rate: int, spm: int) -> tuple[str, int, int]:
    """Form, and after how many tokens prefix and middle end."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "plain" if h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm", low, high


_SHAPE = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, output string, "
    "pieces array<struct<buffer: int, start: long, end: long>>"
)


def _transformed(seed: int, rate: int, spm: int):
    piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for text in K.slices(batch.column(1)):
                ids = batch.column(0).slice(text.first, len(text)).to_pylist()
                ends, first = _tokens(text)
                points = K.code_points(text)
                data = memoryview(text.data)
                rows = [[] for _ in range(7)]
                for i, doc_id in enumerate(ids):
                    begin, end = int(text.offsets[i]), int(text.offsets[i + 1])
                    own, n = data[begin:end], int(first[i + 1] - first[i])
                    form, low, high = _plan(seed, doc_id, n, rate, spm)
                    if form != "plain":
                        raw = bytes(own)
                        if not raw or any(SENTINELS[k : k + 3] in raw for k in (0, 3, 6)):
                            form = "plain"
                    pieces, prefix, middle = [Piece(TEXT, 0, end - begin)], None, None
                    if form != "plain":
                        a, b = (int(ends[first[i] + k - 1]) - begin if k else 0 for k in (low, high))
                        left, rest = cut(pieces[0], a)
                        mid, right = cut(rest, b - a)
                        prefix, middle = int(points[begin + a] - points[begin]), int(points[begin + b] - points[begin + a])
                        pieces = arranged([*_SENTINEL_PIECES, left, mid, right], ORDERS[form])
                    buffers = (own, SENTINELS)
                    values = (n, form, prefix, middle, digest(pieces, buffers), b"".join(stream(pieces, buffers)).decode(), [p._asdict() for p in pieces])
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(piece))
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "output", "pieces"]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names=names)

    return run


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Every row's form, output text and descriptors.

    ``rate`` percent of the rows are cut; ``spm`` percent of these put the suffix first, the rest the prefix.
    Columns: ``doc_id, n`` (tokens), ``form, prefix_chars, middle_chars`` (code points; null where plain),
    ``output_sha256, output, pieces`` (buffer 0 is the text, 1 the sentinels).
    """
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(_transformed(seed, rate, spm), _SHAPE)


def restored(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with ``restored``, the text that an output of that form was made from; other columns stay."""
    frame = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "restored"])
    at_output, at_form = frame.columns.index(output), frame.columns.index(form)

    def run(batches):
        for batch in batches:
            outputs, forms = batch.column(at_output), batch.column(at_form)
            texts = []
            for value, kind in zip(outputs, forms.to_pylist(), strict=True):
                raw = memoryview(value.as_buffer()) if value.is_valid else b""
                texts.append(b"".join(stream(restored_pieces(raw, kind or "plain"), (raw, SENTINELS))).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])

    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField("restored", StringType())]))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
