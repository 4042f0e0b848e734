"""Oversized texts cut into pieces at natural boundaries, by one regular expression over bytes.

A text is turned into a string of one character a byte, so that bounded quantifiers count bytes. The
expression's alternatives are ordered by the strength of the boundary; each takes as much as the limit
allows, and the last takes whole characters only. A second, lookback expression takes from the end of
each core what the next piece repeats. All of it is SQL string and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece, and of its overlap with the one before.
LIMIT, OVERLAP = 2048, 128
#: The encoding of one character a byte.
BYTES = "ISO-8859-1"

# Marks that end a sentence and closing marks, as the bytes of UTF-8.
_END = r"(?:[.!?]|ã\u0080\u0082|ï¼[\u0081\u009f\u008e]|à¥¤|Ø\u009f|Û\u0094|â\u0080¦)"
_CLOSE = r"(?:[\"')\]]|â\u0080[\u0099\u009d]|Â»|ã\u0080[\u008d\u008f\u0091])"
_SPACE = r"(?:[ \t\n\r]|Â |ã\u0080\u0080)"
_WHOLE = r"(?![\u0080-¿])"


def core_pattern(limit: int) -> str:
    """Takes the next core of at most ``limit`` bytes: the rest if it fits, else up to the strongest boundary in the latter half of the room (a word end anywhere), else whole characters."""
    half = max(1, limit // 2)
    # One less than the limit is left for the boundary itself where it has a length of its own.
    at_most = lambda room, low=half: f".{{{min(low, limit - room)},{limit - room}}}"
    return "(?s)" + "|".join(
        [
            rf".{{1,{limit}}}\z",
            rf"{at_most(2)}\n\n",
            rf"{at_most(4)}\r\n\r\n",
            rf"{at_most(1)}\n",
            rf"{at_most(7)}{_END}{_CLOSE}?{_SPACE}",
            rf"{at_most(3)}(?:ã\u0080\u0082|ï¼[\u0081\u009f])",
            rf"{at_most(3, 1)}{_SPACE}",
            rf".{{1,{limit}}}{_WHOLE}",
        ]
    )


def overlap_pattern(overlap: int) -> str:
    """Takes from a core's end at most ``overlap`` bytes, from the start of a word on if there is one, else whole characters."""
    return rf"(?s)(?:(?<=[ \n\t])(?![ \n\t]).{{1,{overlap}}}\z)|(?:{_WHOLE}.{{1,{overlap}}}\z)"


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """ARRAY<STRUCT<text, overlap_bytes>> of a text's pieces in order.

    A text of at most ``limit`` bytes, the empty one included, is one piece; null gives null. Each piece
    but the first begins with ``overlap_bytes`` bytes repeated from the one before; without them the pieces
    in order are the text. No piece is longer than ``limit`` bytes or cuts a character.
    """
    raw = F.decode(F.encode(text, "UTF-8"), BYTES)
    back = lambda c: F.decode(F.encode(c, BYTES), "UTF-8")
    cores = F.regexp_extract_all(raw, F.lit(core_pattern(limit - overlap)), F.lit(0))
    # The pairs (core before, core) come from the array and itself moved by one.
    moved = F.concat(F.array(F.lit("")), F.slice(cores, 1, F.greatest(F.size(cores) - 1, F.lit(0))))
    held = lambda before: F.lit("") if not overlap else F.regexp_extract(F.right(before, F.lit(overlap + 1)), overlap_pattern(overlap), 0)
    both = F.zip_with(moved, cores, lambda before, core: F.struct(back(F.concat(held(before), core)).alias("text"), F.length(held(before)).alias("overlap_bytes")))
    one = F.array(F.struct(text.alias("text"), F.lit(0).alias("overlap_bytes")))
    return F.when(F.octet_length(text) <= limit, one).otherwise(both)


def split_oversized(df: DataFrame, text: str, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keep, chunk_ordinal, piece, overlap_bytes, pieces_total): the pieces of every non-null text, numbered from 0.

    Repeated rows give their pieces repeatedly; null texts give none. Nothing is shuffled.
    """
    held = df.where(F.col(text).isNotNull()).select(*keep, pieces(F.col(text), limit, overlap).alias("_pieces"))
    each = held.select(*keep, F.size("_pieces").alias("pieces_total"), F.posexplode("_pieces").alias("chunk_ordinal", "_p"))
    return each.select(*keep, "chunk_ordinal", F.col("_p.text").alias("piece"), F.col("_p.overlap_bytes").alias("overlap_bytes"), "pieces_total")
