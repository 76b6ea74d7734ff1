"""The byte view.

Offsets in this library are byte offsets.  Spark string functions count
characters, so text is handled in its Latin-1 view: every byte becomes
exactly one character (lossless through ``encode(.., 'ISO-8859-1')``), and
``length``, ``substring``, ``split`` and regular expressions become
byte-accurate.  Binary columns are sliced with ``substring`` on
``BinaryType`` (O(len), no character walk).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf8_bytes(text) -> Column:
    """string -> binary (UTF-8 encoded bytes)."""
    return F.encode(_c(text), "UTF-8")


def latin1(body) -> Column:
    """binary -> Latin-1 view string (one character per byte)."""
    return F.decode(_c(body), "ISO-8859-1")


def from_latin1(view) -> Column:
    """Latin-1 view -> binary."""
    return F.encode(_c(view), "ISO-8859-1")


def text_view(text) -> Column:
    """UTF-8 string -> Latin-1 byte view."""
    return latin1(utf8_bytes(text))


def display(view) -> Column:
    """Byte view -> readable UTF-8 string (invalid sequences replaced)."""
    return F.make_valid_utf8(F.encode(_c(view), "ISO-8859-1").cast("string"))


def n_bytes(body) -> Column:
    return F.octet_length(_c(body))


def chars(view) -> Column:
    """Latin-1 view -> array of one-byte strings."""
    v = _c(view)
    return F.when(F.length(v) == 0, F.array().cast("array<string>")).otherwise(F.split(v, ""))


def byte_values(view) -> Column:
    """Latin-1 view -> array<int> of byte values 0..255 (PRJ8 without padding)."""
    return F.transform(chars(view), lambda ch: F.ascii(ch))


def space_bytes(view) -> Column:
    """PRJ7: newline bytes become spaces (both map to the <SPACE> id 32)."""
    return F.translate(_c(view), "\n", " ")


def repair_utf8(view, mark: str | None = None) -> Column:
    """PRJ15: byte view -> valid UTF-8 text; invalid sequences become U+FFFD
    or ``mark`` (the tokenizer input uses '*')."""
    txt = display(view)
    if mark is not None:
        txt = F.replace(txt, F.lit("�"), F.lit(mark))
    return txt
