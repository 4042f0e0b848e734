"""The reference shapes of chunking and word pieces, for embedding records."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a text stays whole, bytes of a chunk, bytes repeated, and most chunks of a text.
THRESHOLD, TARGET, OVERLAP, MOST = 2048, 1024, 128, 512

# The bytes of UTF-8 as characters of one byte each, so that quantifiers count bytes.
_BYTES = "ISO-8859-1"
_WHOLE = r"(?![\u0080-¿])"
_BLANK = r"[ \t\r\u000b\f]|Â[\u0085\u00a0]|á\u009a\u0080|â\u0080[\u0080-\u008a¨©¯]|â\u0081\u009f|ã\u0080\u0080"
#: A place after a line end, or after the first white space that follows a closing mark.
_BOUNDARY = rf"(?<=\n|[.!?](?:{_BLANK}))"


def one_byte_each(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), _BYTES)


def chunk_spans(text: Column, raw: Column, threshold: int = THRESHOLD, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> Column:
    """ARRAY<STRUCT<byte_start, byte_end>> of a text's chunks; null if there would be more than ``most``, or for a null text.

    A text of at most ``threshold`` bytes is one chunk, an empty one none. Else one expression parts it into
    cores, each as long as the target leaves room for and ending at a boundary where one lies beyond the
    overlap's length, and each chunk is a core with what stands before it: at least ``overlap`` bytes, back
    to a boundary if the target has room. Chunks begin and end with whole characters. ``raw``, a column of
    its own so that it is worked out once, is the text with one character for each byte.
    """
    room = target - 2 * overlap  # what is left is for the bytes repeated, which go back to a boundary or a whole character
    cut = rf"(?s).{{1,{room}}}\z|.{{{min(overlap + 1, room)},{room}}}{_BOUNDARY}|.{{1,{room}}}{_WHOLE}"
    cores = F.regexp_extract_all(raw, F.lit(cut), F.lit(0))

    def with_lead(core: Column) -> Column:
        size, start = core["size"], core["start"]
        seen = F.substring(raw, F.greatest(start - (target - size), F.lit(0)) + 1, F.least(start, target - size))
        by_boundary = F.length(F.regexp_extract(seen, rf"(?s)^.*{_BOUNDARY}(.{{{overlap},}})\z", 1))
        by_character = F.length(F.regexp_extract(F.right(seen, F.lit(overlap + 3)), rf"(?s){_WHOLE}(.{{{overlap},{overlap + 3}}})\z", 1))
        lead = F.when(start == 0, 0).when(by_boundary > 0, by_boundary).otherwise(by_character)
        return F.struct((start - lead).alias("byte_start"), (start + size).alias("byte_end"))

    first = F.array().cast("array<struct<start:int,size:int>>")
    placed = F.aggregate(cores, first, lambda done, c: F.array_append(done, F.struct(F.when(F.size(done) == 0, 0).otherwise(F.element_at(done, -1)["start"] + F.element_at(done, -1)["size"]).alias("start"), F.length(c).alias("size"))))
    whole = F.filter(F.array(F.struct(F.lit(0).alias("byte_start"), F.octet_length(text).alias("byte_end"))), lambda s: s["byte_end"] > 0)
    return F.when(F.octet_length(text) <= threshold, whole).when(F.size(cores) <= most, F.transform(placed, with_lead))


def chunked(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, byte_start, byte_end, too_many) of every non-null text, numbered from 0.

    A text of more than MOST chunks is refused: it gives one row with too_many and neither number nor bytes.
    Repeated rows give their chunks repeatedly. Nothing is shuffled.
    """
    held = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), one_byte_each(F.col(text)).alias("_raw"))
    held = held.select(key, chunk_spans(F.col("_text"), F.col("_raw")).alias("_spans"))
    each = held.select(key, F.col("_spans").isNull().alias("too_many"), F.posexplode_outer("_spans").alias("ordinal", "_s"))
    return each.select(key, "ordinal", "_s.byte_start", "_s.byte_end", "too_many").where(F.col("too_many") | F.col("ordinal").isNotNull())


def flat_words(text: str) -> list[str]:
    """Lower-cased, accent-stripped words and single marks, as word pieces cut them."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    spaced = "".join(f" {c} " if unicodedata.category(c)[0] in "PS" or "一" <= c <= "鿿" else " " if c.isspace() else c if unicodedata.category(c)[0] != "C" else "" for c in flat)
    return spaced.split()


def word_pieces(text: str, vocabulary: dict[str, int], unknown: str = "[UNK]") -> list[str]:
    """Greedy longest pieces of lower-cased, accent-stripped words and single marks; words beyond 100 characters are unknown."""
    out = []
    for word in flat_words(text):
        pieces, at = [], 0
        while at < len(word) <= 100:
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in vocabulary:
                    pieces.append(piece)
                    at = end
                    break
            else:
                break
        out += pieces if len(word) <= 100 and at == len(word) else [unknown]
    return out


def static_embedding(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """(id, vector): the normalised mean of the vectors of each id's known tokens. tokens: (id, token, n); table: (token, vector).

    Tokens without a vector don't count; ids without any known token, or whose mean has no direction, have no row.
    """
    each = tokens.join(table, "token").select("id", "n", F.posexplode("vector").alias("d", "x"))
    mean = each.groupBy("id", "d").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    whole = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("v"))
    whole = whole.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("size > 0")
    return whole.select("id", F.transform("v", lambda x: x / F.col("size")).alias("vector"))
