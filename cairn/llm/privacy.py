"""Personal data in free text, found by weak supervision and replaced by typed placeholders.

Patterns propose spans. Labelers (the form itself, words around it, name lists, and lists learned from the
corpus) vote yes, no or nothing on each. The patterns of votes are counted over all texts; expectation
maximisation over these counts, begun at the majority of the votes, estimates how reliable each labeler is
and how likely each pattern is a true span. A logistic classifier of the votes, the words around a span
and its shape is trained on these likelihoods, with votes left out at random so that it learns the words,
and decides every span; overlapping spans go to the likelier one. Counts by pattern and a bounded sample of
spans reach the driver; learned names do if they are few by count, else texts are joined to their table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.skew import hot_keys, salted_lookup
from cairn.session import materialise, spread

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
#: A word is learned as a name if it stands beside a known one at least so often, and in at least this share of its places.
LEARN_LEAST, LEARN_SHARE = 3, 0.3
#: Up to so many learned names every task holds the list; more stay a table that texts are joined to.
LEARN_HELD = 100_000
ROUNDS = 60
#: A labeler that votes is taken to be right in this share of cases before anything is seen; the belief weighs as much as this share of the spans, and as 50 spans at least.
BELIEF, BELIEF_WEIGHT, BELIEF_LEAST = 0.8, 0.05, 50
#: The classifier is fitted to at most about so many spans of a kind, picked by hash.
SAMPLE_SPANS = 20_000
#: Places of the hashed features of words and shapes, and the share of votes left out in the fit.
PLACES, LEFT_OUT = 4096, 0.35

# Forms and words around them.
_AT, _DOT = r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?)", r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?{_AT}(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z0-9]+", re.I)
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9_/.-])(?:"
    r"(?P<card>[A-Z]{3}-\d{6}-[A-Z](?![A-Za-z0-9]))|(?P<insurance>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![a-z0-9]))|(?P<passport>[A-Z]{2} ?\d{7}(?!\d))"
    r"|(?P<world>\+\d{1,3}[ .-]?(?:\(0?\d{0,4}\)[ .-]?)?\d{1,5}(?:(?:[ .-](?!0\d{4}))?\d{1,5}){1,5}(?!\d))|(?P<dialled>00\d{2}[ .-]\d{1,5}(?:[ .-]\d{2,5}){1,4}(?!\d))"
    r"|(?P<american>(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d))|(?P<pairs>0\d(?:[ .]\d{2}){4}(?!\d))|(?P<area>\(0\d{2,4}\) ?\d{3,6}(?:[ -]\d{2,4})?(?!\d))|(?P<national>0\d{2,4} \d{3,6}(?: \d{3,4})?(?!\d)|0\d{9,10}(?!\d))"
    r"|(?P<social>\d{3}-\d{2}-\d{4}(?![\d-]))|(?P<spaced>\d{3} \d{2} \d{4}(?!\d))|(?P<tax>\d{2} \d{3} \d{3} \d{3}(?!\d))|(?P<bare>\d{9,11}(?!\d))"
    r"|(?P<other>\d{4}-\d{1,3}-\d{4}|\d{2}-\d{2,3}-\d{2}|\d{4}\.\d{2}\.\d{2,3}|\d \d{3} \d{3})(?!\d))"
)
_EXTENSION = re.compile(r" ?(?:ext\.?|x|extension) ?\d{1,5}", re.I)
_IDENTITY = frozenset({"card", "insurance", "passport", "social", "spaced", "tax"})
_CALLS = re.compile(r"(?:\bcall|\bphone|\btel\b|\btelephone|tél|téléphone|teléfono|telefon|\bmobile|\bcell|\bfax|\bsms|\bcontact|\bnumber|nummer|numer|numéro|número|zadzwoń|anruf|rufen|llamar|appeler)\W{0,4}(?:\S+[,/] ?)?$", re.I)
_PAPERS = re.compile(r"(?:social security|\bssn|national insurance|\bni\b|passport|travel document|\btax|taxpayer|\bvat|identity card|card of identity|\bid\b|national id|identity number|personalausweis|steuer|pesel|dowód|\bnif\b|\bdni\b|carte d.identité|pasaporte)[\w .:#º-]{0,16}\W{0,3}$", re.I)
_OTHERS = re.compile(r"(?:ticket|order|build|digest|range|offset|\bref|version|invoice|batch|serial|sku|\blot|\brow)\W{0,3}(?:no\.? ?)?$", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞĀ-Ž][\w’'-]*"
_WAYS = r"(?:Street|Lane|Road|Close|Avenue|Terrace|Drive|Court|Square|Crescent|Boulevard|Gardens|Grove|Mews|Place|Way|Walk|Row|Hill|Park|Quay|(?:St|Ln|Rd|Cl|Ave|Av|Ter|Terr|Dr|Ct|Sq|Cres|Blvd|Pl)\b\.?)"
_HOUSE = r"\d{1,4} ?[a-zA-Z]?(?![\w])"
_STREET = re.compile(
    rf"(?<![\w/.-])(?:{_HOUSE},? (?:{_CAP} ){{1,3}}{_WAYS}(?!\w)|(?:{_CAP} ){{1,2}}{_WAYS},? {_HOUSE}"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|quater|[a-z]))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)(?: (?:de la|de l[’']|des|du|de|d[’']))? ?{_CAP}"
    rf"|{_CAP}(?:straße|strasse|gasse|weg|platz|allee|ring|damm|ufer|str\.) ?{_HOUSE}|(?:{_CAP} ){{1,2}}(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee) {_HOUSE}"
    rf"|(?:ul|al|pl|os)\. ?{_CAP}(?: {_CAP})? \d{{1,4}}[a-zA-Z]?(?:/\d{{1,4}})?|(?:ulica|ulicy|aleja|osiedle) {_CAP} \d{{1,4}}[a-zA-Z]?(?:/\d{{1,4}})?"
    rf"|(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Via|Viale|Piazza|Rua|Rue) ?(?:de(?: la| los| las|l)? )?{_CAP}(?: {_CAP})?,? (?:n\.º ?)?\d{{1,4}}[a-zA-Z]?(?!\w))"
)
_WAY_WORD = re.compile(rf"(?<!\w)(?:{_CAP} ){{1,2}}{_WAYS}(?!\w)")
_LIVES = re.compile(r"(?:\blives? at|\blive in|wohnt in|habite|mieszka|vive en|adres|address|adresse|anschrift|dirección|\bat|\bto|,)\W{0,3}$", re.I)
_TOWN = re.compile(r",? ?(?:\d{2}-\d{3}|\d{4,5})?,? ?" + _CAP)

_WORD = re.compile(r"[^\W\d_]+(?:[-’'](?!s\b)[^\W\d_]+)*")
_GAP, _COMMA = re.compile(r"[  \t]{1,3}(?:[^\W\d_]\.[  ]{1,2})?"), re.compile(r",[  ]{1,2}")
_INITIAL = re.compile(r"(?<![\w.])([^\W\d_])\.[  ]{0,2}(?:[^\W\d_]\.[  ]{0,2})?$")
_CALLED = re.compile(r"(?:\bnamed|\bcalled|\bname(?: is)?:?|\bwith|señora?|herrn?|frau|pani?|mme|mlle|\bm(?:r|s|rs|iss)\b\.?|\bdr\.?|\bprof\.?|\bsr(?:a)?\.?|\bhr\.?|\bfr\.?|\bby|\bcontact|\bfrom:?|\bcc:?)[  ]{1,2}$", re.I)
_SAID = re.compile(r"(?:['’]s?\b| said| wrote| asked| reviewed| signed| who|, \d| \(|;| <)")
# Titles and function words that begin no name.
_COMMON = re.compile(r"(?:The|An?|In|On|At|From|To|No|Was|La|Le|El|Das|Der|Die|Frau|Herr|Pani?|Mme|Mlle|Mr|Ms|Mrs|Miss|Dr|Prof|Hr|Fr|Sr|Sra|Dra)\b")


class Names:
    """Known given and family names, from the list and learned, with the words that are no names."""

    def __init__(self, listed: list[tuple[str, str]], learned: list[tuple[str, str]] = ()):
        import ahocorasick

        self.kinds: dict[str, tuple[str, bool]] = {name.lower(): (kind, False) for name, kind in learned}
        self.kinds |= {name.lower(): (kind, True) for name, kind in listed}
        self.automaton = ahocorasick.Automaton()
        for name in self.kinds:
            self.automaton.add_word(name, name)
        if self.kinds:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, str, bool]]:
        """(start, end, kind, listed) of known names that begin at a word's start, the longest at each place."""
        if not self.kinds:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at: dict[int, tuple[int, str]] = {}
        for last, name in self.automaton.iter(low):
            start = last + 1 - len(name)
            if start and (text[start - 1].isalpha() and not (text[start - 1].islower() and text[start].isupper()) or text[start - 1] in "_@"):
                continue
            if start not in at or last >= at[start][0]:
                at[start] = (last + 1, name)
        return [(start, end, *self.kinds[name]) for start, (end, name) in sorted(at.items())]


def _alpha(text: str, at: int) -> bool:
    return at < len(text) and (text[at].isalnum() or text[at] == "_") and text[at].isascii()


Span = tuple[str, int, int, str]


def _names(text: str, names: Names, taken: list[tuple[int, int]]) -> Iterator[Span]:
    """Proposals of person names around known ones; the votes are one letter a labeler: y, n or -."""
    inside = lambda a: any(s <= a < e for s, e in taken)
    known = [k for k in names.found(text) if not inside(k[0])]
    starts = {k[0]: k for k in known}
    ends = {k[1]: k for k in known}
    for start, end, kind, listed in known:
        glued = _alpha(text, end)
        # an initial before a family name
        if kind == "family" and (m := _INITIAL.search(text, max(0, start - 8), start)):
            a = m.start()
            gap = len(text[max(0, a - 3) : a]) - len(text[max(0, a - 3) : a].rstrip())
            if gap and (first := ends.get(a - gap)) and first[2] == "given":
                continue  # the middle initial of a full name
            title = m[1] == "M" and re.match(r" et (?:Mme|M\.)", text[end : end + 8]) is not None
            yield _name(text, a, end, "i", "y" if listed else "l", "n" if title else "-")
        after = _GAP.match(text, end) if not glued else None
        if after and (other := starts.get(after.end())):
            pair = {kind, other[2]}
            yield _name(text, start, other[1], "y" if listed else "l", "y" if other[3] else "l", "-" if len(pair) == 2 else "n")
        elif after and (w := _WORD.match(text, after.end())) and w[0][0].isupper() and text[start].isupper():
            yield _name(text, start, w.end(), "y" if listed else "l", "u", "-")
        comma = _COMMA.match(text, end) if not glued and kind == "family" else None
        if comma and (other := starts.get(comma.end())) and other[2] == "given":
            follows = _GAP.match(text, other[1])
            full = follows and (third := starts.get(follows.end())) and third[2] == "family"
            yield _name(text, start, other[1], "y" if listed else "l", "y" if other[3] else "l", "n" if full else "-")
        elif comma and (w := _WORD.match(text, comma.end())) and w[0][0].isupper() and text[start].isupper():
            yield _name(text, start, w.end(), "y" if listed else "l", "c", "-")
        if text[start].isupper() and (m := re.search(rf"({_CAP})[  ]{{1,2}}(?:[^\W\d_]\.[  ]{{1,2}})?$", text[max(0, start - 30) : start])):
            a = max(0, start - 30) + m.start(1)
            if a not in starts and (a == 0 or not (text[a - 1].isalnum() or text[a - 1] == "_")):
                yield _name(text, a, end, "u", "y" if listed else "l", "-")


def _name(text: str, start: int, end: int, first: str, second: str, clash: str) -> Span:
    lead, said = _CALLED.search(text[max(0, start - 24) : start]), _SAID.match(text[end : end + 12])
    common = "n" if first != "i" and _COMMON.match(text, start, end) else "-"
    return "person_name", start, end, first + second + clash + common + ("y" if lead else "-") + ("y" if said else "-")


def propose(text: str, names: Names) -> list[Span]:
    """(kind, start, end, votes) of every span that may be personal data."""
    out: list[Span] = []
    low = text.lower()
    if "@" in text or "at]" in low or "at)" in low or "at}" in low or "at>" in low:
        for m in _EMAIL.finditer(text):
            last = re.split(r"[.\])}> ]", m[0])[-1]
            named = "y" if last.isalpha() and len(last) >= 2 else "n"
            cue = "y" if re.search(r"(?:mail|write to|contact|\bcc|\bfrom|\bto|:|<)\W{0,2}$", text[max(0, m.start() - 14) : m.start()], re.I) else "-"
            version = "n" if re.search(r"@\d+(?:\.\d+)*$", m[0]) else "-"
            out.append(("email", m.start(), m.end(), "y" + named + cue + version))
    taken = [(s, e) for _, s, e, _ in out]
    for m in _NUMBER.finditer(text):
        form, start, end = m.lastgroup, m.start(), m.end()
        if any(s <= start < e for s, e in taken):
            continue
        before = text[max(0, start - 40) : start].rstrip("(")
        papers, calls, others = (("y" if p.search(before) else "-") for p in (_PAPERS, _CALLS, _OTHERS))
        digits = sum(c.isdigit() for c in m[0])
        if form in _IDENTITY or (form in ("bare", "other") and papers == "y"):
            strong = "s" if form in ("card", "insurance", "social") else "l" if papers == "y" else "n"
            out.append(("identity_number", start, end, f"{strong}{papers}{'n' if others == 'y' else '-'}{'-' if form != 'other' else 'n'}"))
        else:
            fits = "y" if form not in ("bare", "other") and 9 <= digits <= 15 else "n"
            if ext := _EXTENSION.match(text, end):
                end = ext.end()
            out.append(("phone", start, end, f"{fits}{calls}{'n' if others == 'y' else '-'}{'n' if papers == 'y' else '-'}"))
    taken = [(s, e) for _, s, e, _ in out]
    for m in _STREET.finditer(text):
        start = m.start()
        while cut := _FALSE_START.match(text, start, m.end()):
            start = cut.end()
        if any(s <= start < e for s, e in taken):
            continue
        cue, town = _LIVES.search(text[max(0, start - 14) : start]), _TOWN.match(text[m.end() : m.end() + 24])
        out.append(("street_address", start, m.end(), "y" + ("y" if cue else "-") + ("y" if town else "-") + "-"))
    held = [(s, e) for k, s, e, _ in out if k == "street_address"]
    out += [("street_address", m.start(), m.end(), "n---") for m in _WAY_WORD.finditer(text) if not any(s < m.end() and m.start() < e for s, e in held)]
    named = _names(text, names, [(s, e) for k, s, e, _ in out if k != "street_address" or (s, e) in held])
    # beside a word that is no known name only words around it can tell
    return out + [n for n in named if "y" in n[3][4:] or not set(n[3][:2]) & {"u", "c"}]


_FALSE_START = re.compile(r"(?:From|To|At|In|The|I|Address|Adresse|Adres|Anschrift|Dirección|Live|Lives)\b:? (?=\S)")


def _learn(batches: Iterator[pd.DataFrame], listed: list[tuple[str, str]]) -> Iterator[pd.DataFrame]:
    """Counts of capitalised words: all places, and those beside a listed name, by the part they would play."""
    names = Names(listed)
    for batch in batches:
        seen: Counter = Counter()
        for text in batch["text"]:
            if not isinstance(text, str) or not any(c.isupper() for c in text):
                continue
            for m in _WORD.finditer(text):
                if len(m[0]) > 2 and m[0][0].isupper() and not m[0].isupper():
                    seen[m[0].lower(), "all"] += 1
            taken = [m.span() for m in _EMAIL.finditer(text)] if "@" in text or "at" in text else []
            for kind, start, end, votes in _names(text, names, taken):
                if votes[0] == "u" or votes[1] in "uc" or votes[0] == "i":
                    words = _WORD.findall(text[start:end])
                    if not (text[start].isupper() and votes[3] == "-" and words):
                        continue
                    w = words[0] if votes[0] == "u" else words[-1]
                    other = (words[-1] if votes[0] == "u" else words[0]).lower()
                    if votes[0] != "i" and other in names.kinds and len(w) > 2 and not w.isupper():
                        comma = votes[1] == "c"
                        if votes[0] == "u" and names.kinds[other][0] == "given":
                            seen[w.lower(), "lead"] += 1  # a word that stands before full names, as titles do
                        part = "given" if names.kinds[other][0] == "family" else "family"
                        if comma and part != "given" or votes[1] == "u" and part != "family" or votes[0] == "u" and part != "given":
                            continue
                        seen[w.lower(), part] += 1
        if seen:
            yield pd.DataFrame([(w, p, n) for (w, p), n in seen.items()], columns=["word", "part", "n"])


def learned_names(texts: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    """(word, kind) of words that stand beside listed names often enough to be names themselves, and not before full names."""
    counts = texts.mapInPandas(lambda b: _learn(b, listed), "word STRING, part STRING, n BIGINT").groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p) for p in ("all", "given", "family", "lead")])
    beside = F.col("given") + F.col("family")
    known = sorted({n.lower() for n, _ in listed})  # a fixed table
    fine = counts.where((beside >= LEARN_LEAST) & (beside >= LEARN_SHARE * F.col("all")) & (F.col("lead") < beside) & ~F.col("word").isin(known))
    return fine.select("word", F.when(F.col("given") > F.col("family"), "given").otherwise("family").alias("kind"))


def _with_known(texts: DataFrame, learned: DataFrame) -> DataFrame:
    """texts with ``known``: the learned names among the words of each text, by a join of the distinct words of distinct texts."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:[-’'](?!s\b)\p{L}+)*"), F.lit(0)))
    hashed = texts.withColumn("_hash", F.xxhash64("text"))
    each = hashed.where(F.col("text").isNotNull()).groupBy("_hash").agg(F.first("text").alias("text")).select("_hash", F.explode(found).alias("word"))
    held = each.join(learned, "word").groupBy("_hash").agg(F.collect_list(F.struct("word", "kind")).alias("known"))  # at most the words of one text
    hot = hot_keys(hashed.select("_hash"), "_hash")
    return salted_lookup(hashed, held, "_hash", hot).drop("_hash")


_VALUES = "yn-lucis"
#: Votes for, and votes against.
_FOR, _AGAINST = "ysli", "nuc"


def _estimate(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """How likely each pattern of votes is a true span: expectation maximisation over labelers taken as independent, from the majority of their votes on.

    The one belief put in is the same for all labelers: who votes is right more often than not. It keeps the
    two classes what they are where one of them is rare.
    """
    votes, n = [p for p, _ in patterns], np.array([c for _, c in patterns], float)
    width = max(map(len, votes))
    balance = np.array([sum(v in _FOR for v in p) - sum(v in _AGAINST for v in p) for p in votes], float)
    likely = 1 / (1 + np.exp(-balance))
    one_hot = np.array([[v == x for i, v in enumerate(p) for x in _VALUES] for p in votes], float)
    sides = [(BELIEF / len(_FOR), (1 - BELIEF) / len(_FOR)) if x in _FOR else ((1 - BELIEF) / len(_AGAINST), BELIEF / len(_AGAINST)) if x in _AGAINST else (0, 0) for x in _VALUES]
    weighs = max(BELIEF_WEIGHT * n.sum(), BELIEF_LEAST)
    belief = np.array(sides * width) * weighs
    silent = np.array([x == "-" for x in _VALUES] * width)
    for _ in range(ROUNDS):
        weight = n[:, None] * np.stack([likely, 1 - likely], 1)
        rates = one_hot.T @ weight + belief
        rates[silent] = 0
        rates = rates.reshape(width, len(_VALUES), 2)
        rates = np.log(rates / rates.sum(1, keepdims=True) + 1e-9).reshape(-1, 2)
        rates[silent] = 0  # who does not vote says nothing
        score = one_hot @ rates + np.log(weight.sum(0) + weighs)
        new = 1 / (1 + np.exp(np.clip(score[:, 1] - score[:, 0], -40, 40)))
        if np.abs(new - likely).max() < 1e-6:
            break
        likely = new
    return dict(zip(votes, new))


def _around(text: str, start: int, end: int) -> str:
    """What the classifier sees of a span besides its votes: the two words before, the word after, the characters beside, and the shape."""
    before = re.findall(r"\w+", text[max(0, start - 32) : start].lower())
    after = re.findall(r"\w+", text[end : end + 20].lower())
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text[start:end][:32]))
    return "|".join([" ".join(before[-2:]), before[-1] if before else "", after[0] if after else "", text[max(0, start - 2) : start], text[end : end + 2], shape])


class Judge:
    """A logistic classifier of one kind: one weight for each vote of each labeler, and hashed ones for what is around."""

    def __init__(self, width: int, weights: np.ndarray):
        self.width, self.weights, self.held = width, weights, {}

    @staticmethod
    def places(width: int, votes: str, around: str) -> list[int]:
        base = width * len(_VALUES)
        own = [i * len(_VALUES) + _VALUES.index(v) for i, v in enumerate(votes)]
        return own + [base + zlib.crc32(f"{i} {x}".encode()) % PLACES for i, x in enumerate(around.split("|", 5)) if x] + [base + PLACES]

    def likely(self, votes: str, around: str) -> float:
        key = votes, around
        if (known := self.held.get(key)) is None:
            if len(self.held) > 100_000:
                self.held.clear()
            known = self.held[key] = 1 / (1 + np.exp(-min(40.0, max(-40.0, float(self.weights[self.places(self.width, votes, around)].sum())))))
        return known

    @classmethod
    def fit(cls, spans: list[tuple[str, str]], likely: dict[str, float], seed: int = 3) -> "Judge":
        """Fits to spans (votes, around) with the likelihoods of their votes; each span also comes with votes left out."""
        width = max(map(len, likely))
        size = width * len(_VALUES) + PLACES + 1
        rng = np.random.default_rng(seed)
        rows, places, target = [], [], []
        for votes, around in spans:
            for share in (0.0, LEFT_OUT):
                seen = "".join("-" if v != "-" and rng.random() < share else v for v in votes)
                own = cls.places(width, seen, around)
                rows += [len(target)] * len(own)
                places += own
                target.append(likely[votes])
        rows, places, target = np.array(rows), np.array(places), np.array(target)
        weights, slope, n = np.zeros(size), np.zeros(size), len(target)
        for _ in range(150):  # gradient steps scaled by what each place has moved so far
            score = np.bincount(rows, weights[places], n)
            loss = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - target
            step = np.bincount(places, loss[rows], size) / n + 1e-5 * weights
            slope += step**2
            weights -= 0.5 * step / (np.sqrt(slope) + 1e-6)
        return cls(width, weights)


def spans(spark: SparkSession, texts: DataFrame, names: DataFrame, with_text: bool = False) -> DataFrame:
    """(memory_id, kind, char_start, char_end[, text]): the personal data of each text, in Unicode characters from 0.

    texts: (memory_id, text); names: (name, name_kind), a small fixed table. Null and empty texts have
    none, and repeated rows give repeated spans. Spans of one text don't overlap. Without any names only
    the other kinds are found.
    """
    listed = [(r[0], r[1]) for r in names.where("name IS NOT NULL AND name_kind IN ('given', 'family')").select("name", "name_kind").distinct().collect()]
    table = materialise(spark, learned_names(texts.select("text"), listed), "names")
    few = table.count() <= LEARN_HELD
    learned = [(r["word"], r["kind"]) for r in table.collect()] if few else []
    shared = spark.sparkContext.broadcast((listed, learned))  # the fixed list, and at most LEARN_HELD names
    given = texts.select("memory_id", "text") if few else _with_known(texts.select("memory_id", "text"), table)

    def proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Names(*shared.value)
        for batch in batches:
            found = []
            for i, t in enumerate(batch["text"]):
                if not few and isinstance(t, str):
                    known = batch["known"].iloc[i]
                    own = Names(listed, [(k["word"], k["kind"]) for k in known] if known is not None else [])
                found.append([{"kind": k, "start": s, "end": e, "votes": v, "around": _around(t, s, e)} for k, s, e, v in (propose(t, own) if isinstance(t, str) else [])])
            keep = [bool(f) for f in found] if not with_text else [True] * len(found)
            if any(keep):
                yield batch[keep].assign(proposals=[f for f, k in zip(found, keep) if k])[[c for c in ("memory_id", "text") if c == "memory_id" or with_text] + ["proposals"]]

    one = "proposals ARRAY<STRUCT<kind: STRING, start: INT, end: INT, votes: STRING, around: STRING>>"
    id_type = texts.schema["memory_id"].dataType.simpleString()
    held = materialise(spark, spread(spark, given, "memory_id").mapInPandas(proposed, f"memory_id {id_type}, " + "text STRING, " * with_text + one), "proposals")
    each = held.select(F.explode("proposals").alias("p")).select("p.kind", "p.votes", "p.around")
    by_kind: dict[str, list[tuple[str, int]]] = {}
    for kind, votes, n in each.groupBy("kind", "votes").count().collect():  # bounded by the patterns of a few votes
        by_kind.setdefault(kind, []).append((votes, n))
    share = F.lit(0.0)
    for kind, patterns in by_kind.items():
        share = F.when(F.col("kind") == kind, min(1.0, SAMPLE_SPANS / sum(n for _, n in patterns))).otherwise(share)
    picked = each.where(F.pmod(F.xxhash64("kind", "votes", "around"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("votes", "around"), "around", "votes").limit(SAMPLE_SPANS * len(KINDS))
    sample: dict[str, list[tuple[str, str]]] = {}
    for kind, votes, around in picked.collect():
        sample.setdefault(kind, []).append((votes, around))
    judges = spark.sparkContext.broadcast({kind: Judge.fit(sample.get(kind, []), _estimate(sorted(patterns))) for kind, patterns in by_kind.items()})

    def decided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.drop(columns="proposals").assign(spans=[_choose(p, judges.value) for p in batch["proposals"]])

    schema = f"memory_id {id_type}, " + "text STRING, " * with_text + "spans ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>"
    return held.mapInPandas(decided, schema)


def _choose(proposals: list[dict], judges: dict[str, Judge]) -> list[dict]:
    """The spans that the classifier takes, the likelier before the longer, none overlapping."""
    rated = sorted(((-judges[p["kind"]].likely(p["votes"], p["around"]), p["start"] - p["end"], p["start"], p["kind"], p["end"]) for p in proposals))
    out: list[dict] = []
    for score, _, start, kind, end in rated:
        if score < -0.5 and not any(o["start"] < end and start < o["end"] for o in out):
            out.append({"kind": kind, "start": start, "end": end})
    return sorted(out, key=lambda o: o["start"])


def redact(found: DataFrame) -> DataFrame:
    """(memory_id, redacted, replaced): each text with a placeholder like [EMAIL] for each span, all else unchanged."""

    @F.pandas_udf("string")
    def put(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans):
            if isinstance(t, str):
                parts, at = [], 0
                for s in found:
                    parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = s["end"]
                t = "".join(parts) + t[at:]
            out.append(t if isinstance(t, str) else None)
        return pd.Series(out)

    return found.select("memory_id", put("text", "spans").alias("redacted"), F.size("spans").alias("replaced"))
