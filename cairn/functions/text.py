"""Text functions: normal form, fingerprints, escaping, detectors, decay."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that normalisation drops, and white space that it trims.
DROPPED = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff"
BLANKS = "\t\u000b\u000c\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and marks of scripts written without blanks between words, as ranges for a character class: Thai, Lao, Burmese, Khmer, kana, Han.
DENSE = "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u1780-\u17d3\u3005-\u3007\u3041-\u309f\u30a1-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003134f"
# Letters, digits and marks of all other scripts; the negated classes say "a letter, but none of those". Valid for RE2 as well.
_START, _NEXT = rf"[^\P{{L}}{DENSE}]|\p{{N}}", rf"[^\P{{L}}{DENSE}]|\p{{N}}|[^\P{{M}}{DENSE}]"
#: A word: a run of a dense script, or a run of letters and digits of the others with their marks.
WORD = rf"[{DENSE}]+|(?:{_START})(?:{_NEXT})*"
#: Days after which importance has halved.
HALF_LIFE_DAYS = 30

# Forms of credentials, most telling first. They are also valid for RE2.
DETECTORS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "cloud_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "forge_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "url_password": r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@",
    "assignment": r"(?i)\b(?:password|passwd|secret|api_?key|token)\s*[:=]\s*[^\s]{8,}",
}


@F.pandas_udf(T.StringType())
def _composed(column: pd.Series) -> pd.Series:
    return column.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """The text in normal form C; texts of ASCII alone are."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(_composed(text))


def _visible(text: Column) -> Column:
    kept = F.regexp_replace(text, f"[{DROPPED}]", "")
    return F.when(F.octet_length(kept) == F.length(kept), kept).otherwise(_composed(kept))


def normal_form(text: Column) -> Column:
    """Drops invisible characters, composes (NFC), and trims the end of every line and of the text. Null stays null.

    Composition has no built-in; texts of ASCII alone skip it.
    """
    return F.regexp_replace(F.regexp_replace(_visible(text), f"[{BLANKS}]+\\n", "\n"), f"[{BLANKS}\\n]+\\z", "")


def fingerprint(scope: Column, kind: Column, text: Column) -> Column:
    """Equal for equal scope, kind and normal form."""
    return F.sha2(F.concat_ws("\u001f", scope, kind, normal_form(text)), 256)


def detected(text: Column) -> Column:
    """The name of the first detector that finds a credential, or null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(DETECTORS.items()):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def escaped(text: Column) -> Column:
    """Text in which no mark-up delimiter can occur: &, < and > as JSON escapes."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("\\u0026")), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def decayed(base: Column, last_used: Column, now: Column) -> Column:
    """Importance after the seconds since its last use; use in the future counts as now."""
    passed = F.greatest(now - last_used, F.lit(0)) / (HALF_LIFE_DAYS * 86400.0)
    return base.cast("double") * F.pow(F.lit(0.5), passed)


def sentence_list(text: Column) -> Column:
    """Plain sentences: cut after line ends, and after the first white space that follows a full stop, question or exclamation mark."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s|\n", "$1\u0001"), "\u0001"), lambda s: F.length(F.trim(s)) > 0)


def words(text: Column) -> Column:
    """Lower-case words of every script, for lexical retrieval: composed runs of letters, digits and their marks.

    Runs of a script without blanks between words give their overlapping pairs of characters, and a run of one gives that one. Null stays null.
    """
    low = F.lower(_visible(text))
    runs = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    dense = lambda r: r.rlike(f"^[{DENSE}]{{2}}")
    mixed = F.flatten(F.transform(runs(WORD), lambda r: F.when(dense(r), pairs(r)).otherwise(F.array(r))))
    return F.when(text.rlike(f"[{DENSE}]"), mixed).otherwise(runs(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"))
