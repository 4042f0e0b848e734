"""Sentence units in many languages and scripts, by a linear-chain model over characters.

Each character is tagged as the last of a unit or as inside one. Only characters that can close a unit
(a closing mark with its quotes and brackets, or a blank beside a letter of a script without closing
marks) may carry the first tag; all others are inside with certainty, so the best path over all
characters is found on the candidates alone. A state holds the tag of the candidate before, whether the
unit under way began with an opening quote, and whether it holds a letter or digit yet: without one it
can't end. The weights of features (forms and words on both sides, pairs of them, and transitions) are
fitted by a structured perceptron on a bounded sample of weakly labelled text, and they alone decide.

No labelled sentences exist, so labels come from three sources: line ends that are joined up again for
the fit (true ends by the layout), ordered rules at the marks within lines, and, for scripts without
closing marks, text stripped of its punctuation, whose blanks and joined lines give both tags.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import spread

#: At most about so many texts are fitted to, each of them whole.
SAMPLE_TEXTS = 1500
#: Rounds over the sample at most; a round without a mistake is the last.
EPOCHS = 12
#: In the fit a wrong tag scores so much more, so that the weights keep that distance.
MARGIN = 2.0
#: Candidates at most so many characters apart are linked: the tag of one bears on the next.
NEAR = 6
#: Tokens whose classes and weights a task remembers; beyond that it starts anew.
REMEMBERED = 200_000

# Abbreviations, lower case, without their last stop.
#: A name follows.
TITLES = frozenset("dr mr ms mrs prof sr sra dra m mme mlle hr fr herr st gen col capt lt rev hon mgr inż डॉ श्री प्रो د".split())
#: The sentence goes on, whatever follows.
INNER = frozenset("e.g i.e cf vs z.b d.h u.a o.ä p.ej p.ex np tzn tj wg zob por por ca bzw env approx ok resp vgl ggf inkl evtl ej ex tel ext ul al pl".split())
#: The sentence goes on if a number follows.
COUNTED = frozenset("no nr nos vol vols p pp pg pág págs fig figs sec secs ch art arts abs ziff rys str s r n.º n.o num nº ca env approx ok ed eq tab taf lfd".split())
#: The sentence may end here or go on; what follows tells.
OPEN = frozenset("etc usw itd itp inc ltd co corp jr sr al hrs hr min sek proc a.m p.m u.s e.u u.k ph.d m.d b.a m.a bros dept est mm".split())
#: Single small letters that are abbreviations in two steps (z. B., d. h., p. ej.).
STEPS = frozenset("z b d h u p o i a".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split())

#: Scripts whose blanks end units, and closing marks of the others: Latin, CJK, Arabic, Devanagari, Khmer, Burmese, Ethiopic, Armenian, Tibetan.
_BARE = "ก-๎ກ-ໝ"
_SIGN = r"\.{2,}|…+|[.!?。！？｡．؟۔।॥‼⁇⁈⁉។៕။።፧፨։།༎]+"
_SIGNS = re.compile(_SIGN)
_MARK = re.compile(rf"{_SIGN}|(?<=[{_BARE}]) +(?=\S)|(?<=\S) +(?=[{_BARE}])")
_CLOSED = re.compile(rf"(?:{_SIGN})[\"'”’»›)\]」』】〕）｣]*$")
_SURE = frozenset("!?！？؟‼⁇⁈⁉፧")
#: The sort of a single mark; of several it follows from the first.
_SORTS = {".": "stop", "…": "dots"} | {c: "sure" for c in _SURE} | {c: "script" for c in "。｡．۔।॥។៕።༎།։"}
_CLOSERS = frozenset("\"'”’»›)]」』】〕）｣")
_OPENERS = frozenset("\"'“‘«‹„‚(（[「『【〔｢¿¡")
_ON = frozenset(",;:，、；：—–-/%،؛")
_PARTICLES = frozenset("とはがをにでのもへや")
_BREAK = re.compile(r"\r\n|[\n\r\x85\u2028\u2029]")
_BLANK_LINE = re.compile(r"(?>\r\n|[\n\r\x85\u2028\u2029])[^\S\n\r\x85\u2028\u2029]*(?:(?>\r\n|[\n\r\x85\u2028\u2029])[^\S\n\r\x85\u2028\u2029]*)+")
_LOG = re.compile(r"\s*\[?\d{4}[-/.]\d{2}[-/.]\d{2}(?:[T ]|\b)")
_HEAD = re.compile(r"\s*(?:(?:[-*•–—>#]+|\(?(?:\d{1,4}(?:\.\d{1,3})*|[A-Za-z])[.)]|\[[^\]\n]{1,24}\])\s+)*(?:[\w.-]{1,24}:\s)?")
_TOKEN = re.compile(r"[^\s(\[{\"“„«‘「『（:,;]+$")
_NEXT = re.compile(r"\S+")
_GLUED = re.compile(r"^.*[^\W\d_]{2}[.!?][)\"'”’»]*(?=[A-Z])")
_STEP = re.compile(r"[A-Z]\.(?:\W|$)")
_IDENTIFIER = re.compile(r"^[a-z][\w-]*[_./:=@\d(][\w./:=@(\"-]*")


def spans(text: str, layout: str | None) -> Iterator[tuple[int, int]]:
    """[start, end) of each stretch of text that no unit crosses: lines, or paragraphs of wrapped texts."""
    at = 0
    for m in (_BLANK_LINE if layout == "wrapped" else _BREAK).finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _before(token: str, ahead: str) -> tuple[str, str]:
    """The kind of a token before a mark, and the token in lower case. ``ahead``: a digit that stands before a token of one letter."""
    if not token:
        return "none", ""
    low = token.lower().rstrip(".")
    if low in TITLES and not token.isupper():
        return "title" if len(token) > 1 or not token.isascii() else "initial", low
    if len(token) == 1 and token.isalpha() and token.isascii():
        if token.isupper():
            return "initial", low
        return ("unit" if ahead else "step" if low in STEPS else "counted" if low in COUNTED else "word"), low
    if _DOTTED.fullmatch(token):
        return ("open" if low in OPEN else "inner" if low in INNER else "acronym"), low
    if low in OPEN:
        return "open", low
    if low in INNER:
        return "inner", low
    if low in COUNTED:
        return "counted", low
    if token[-1].isdigit():
        return ("ordinal" if len(token) <= 2 and token.isdigit() else "number"), low
    return "word", low


def _after(token: str) -> tuple[str, str]:
    """The kind of what follows, by its token, and the token without marks in lower case."""
    if not token:
        return "end", ""
    c, low = token[0], token.lower().strip(".,;:!?")[:12]
    if c.isdigit():
        return "digit", "0"
    if c in _OPENERS:
        return "opener", c
    if c in _ON:
        return "on", c
    if c.islower():
        return ("identifier" if _IDENTIFIER.match(token) and not _PLAIN.match(token) else "lower"), low
    if c.isupper() or c.istitle():
        return "upper", low
    return ("letter" if c.isalpha() else "other"), c


#: (end of the unit, start of the next, what features follow from, the same if the unit began with an opener, word before, near the one before, a letter or digit since then)
Candidate = tuple[int, int, tuple, tuple, str, bool, bool]


def _side(c: str) -> str:
    return "bare" if _THAI.match(c) else "digit" if c.isdigit() else "letter" if c.isalpha() else "other"


class Reader:
    """Finds candidates in lines; what follows from a token alone is remembered, as tokens repeat."""

    def __init__(self) -> None:
        self.prev: dict[str, tuple[str, str, str, bool]] = {}
        self.next: dict[str, tuple[str, str, str]] = {}
        self.linked = False

    def _prev(self, line: str, at: int) -> tuple[str, str, str, bool]:
        """(kind, token in lower case, what its features follow from, whether it ends with a letter or digit) of the token before a mark."""
        before = line[max(0, at - 24) : at]
        if not before:
            return "none", "", "", False
        if before[-1].isspace():
            return "gap", "", "", False
        token = before.rsplit(None, 1)[-1]
        if not token.isalnum():
            token = _TOKEN.search(token)
            token = _GLUED.sub("", token[0]) if token else ""
        ahead = before[:-1].rstrip()[-1:] if len(token) == 1 else ""
        held = f"{token} {ahead}" if ahead.isdigit() else token
        if (known := self.prev.get(held)) is None:
            if len(self.prev) > REMEMBERED:
                self.prev.clear()
            kind, low = _before(token, held[2:] if len(token) == 1 else "")
            tail = f"ending {low[-2:]} {len(low) if len(low) < 5 else 5} {token[-1:].isupper()}" if kind in ("word", "number", "ordinal") else f"word {low}"
            known = self.prev[held] = kind, low, tail, low[-1:].isalnum()
        return known

    def _next(self, token: str) -> tuple[str, str, str]:
        """(kind, token in lower case, its first letters if it is a small word) of what follows."""
        if len(self.next) > REMEMBERED:
            self.next.clear()
        kind, low = _after(token.split(None, 1)[0])
        known = self.next[token] = kind, low, low[:4] if kind == "lower" else ""
        return known

    def candidates(self, line: str, bare: bool = True) -> list[Candidate]:
        """Each place within a line where a unit may end; the end of the line itself is none. ``bare``: it may hold letters of scripts without closing marks."""
        self.linked = False  # does any candidate bear on another?
        found: list[Candidate] = []
        german = seen = last = counted = straight = 0
        head, size, quoted, low_quoted, after = -1, len(line), '"' in line, "„" in line, self.next.get
        before = self.prev.__getitem__
        for m in (_MARK if bare else _SIGNS).finditer(line):
            at, end = m.span()
            if at < seen:
                continue
            mark = line[at]
            if mark == " ":
                key = ("blank", _side(line[at - 1]), _side(line[end]), line[at - 1], line[end])
                near = at - last <= NEAR and bool(found)
                self.linked |= near
                found.append((at, end, key, key, "", near, True))
                last = seen = end
                continue
            if quoted:
                straight += line.count('"', counted, at)
            if low_quoted:
                german += line.count("„", counted, at) - line.count("“", counted, at) * (german > 0)
            closed = ""
            while end < size:
                c = line[end]
                if c == " " and line[end + 1 : end + 2] != "»":
                    break
                if c not in _CLOSERS:
                    if c in "\u0020\u00a0\u202f" and line[end + 1 : end + 2] == "»":
                        closed, end = closed + "»", end + 2
                        continue
                    if c == "“" and (german > 0 or not line[end + 1 : end + 2].isalnum()):
                        closed, end, german = closed + c, end + 1, max(0, german - 1)
                        continue
                    break
                if (c == '"' and straight % 2 == 0) or (c == "'" and line[end + 1 : end + 2].isalnum()):
                    break
                straight += c == '"'
                closed, end = closed + c, end + 1
            counted = end
            start = end
            while start < size and line[start].isspace():
                start += 1
            seen = start if start > end else end
            if start >= size:
                break
            window = at - 24 if at > 24 else 0
            space = line.rfind(" ", window, at)
            token = line[space + 1 : at] if space >= 0 or not window else ""
            prev, low, tail, lettered = before(token) if len(token) > 1 and token in self.prev else self._prev(line, at)
            space = line.find(" ", start, start + 40)
            token = line[start:space] if space > 0 else line[start : start + 40]
            kind, following, first = after(token) or self._next(token)
            if start > end:
                gap = "gap"
            else:
                gap = "none"
                if kind == "upper" and _STEP.match(token):
                    kind = "step"
            sign = m[0]
            sort = _SORTS.get(sign) or ("dots" if mark in ".…" else "sure" if any(c in _SURE for c in sign) else "script")
            if head < 0:
                head = _HEAD.match(line).end()
            if end <= head:
                where, prev, low, tail = "head", "marker", "0", ""
            else:
                where = "in"
            particle = kind == "letter" and following in _PARTICLES
            month = False
            if prev == "ordinal":
                month, first = following in MONTHS, following[:4]
            lettered = lettered or any(map(str.isalnum, line[last:end]))
            near = at - last <= NEAR and bool(found)
            if closed:
                close = "bracket" if closed[-1] in ")]）】〕" else "quote"
                key = (sort, prev, kind, gap, close, where, particle, month, tail, first)
                whole = (sort, prev, kind, gap, close + "-whole", where, particle, month, tail, first)
                self.linked = True
            else:
                key = whole = (sort, prev, kind, gap, "open", where, particle, month, tail, first)
                if near or not lettered:
                    self.linked = True
            found.append((end, start, key, whole, low, near, lettered))
            last = start
        return found


def features(key: tuple) -> tuple[str, ...]:
    """The features of a candidate: single forms and pairs of them (none of all together), the word before with what kind follows, its last letters and shape, and the word after."""
    if key[0] == "blank":
        _, left, right, before, after = key
        return "blank", f"left {left}", f"right {right}", f"sides {left} {right}", f"char before {before}", f"char after {after}"
    sort, prev, kind, gap, close, where, particle, month, tail, first = key
    return (
        f"end {sort} {gap}", f"at {where}", f"next {kind} {gap}", f"mark {sort} {kind}", f"both {prev} {kind}", f"prev {prev} {gap}", f"glued {sort} {prev}" if gap == "none" else f"apart {sort} {prev}", f"close {close} {sort}", f"closed {close} {kind}", f"after {close} {prev}",
        f"particle {particle} {close != 'open'}", f"month {month}", f"{tail} {kind}", f"first {first} {prev}" if first else f"first {kind}",
    )


def _rule(sort: str, prev: str, low: str, kind: str, gap: str, close: str, where: str, particle: bool, month: bool) -> bool:
    """One of the labelers of the fit: does a unit end at a mark within a line, by ordered rules? Decoding does not use it."""
    if where == "head" or kind == "on":
        return False
    if sort == "script" or (sort == "sure" and kind == "letter"):
        return not (close != "open" and particle)
    if gap == "none":
        if kind == "letter":
            return prev not in ("title", "initial", "step", "inner")
        if kind == "upper":
            return prev in ("word", "open", "number", "ordinal", "unit", "gap") or sort != "stop" or close != "open"
        return kind == "opener" and sort != "stop" and prev != "none"
    if sort == "dots":
        return kind != "lower"
    if sort == "sure":
        return not (close != "open" and kind in ("lower", "identifier"))
    if close.startswith("quote"):
        return kind not in ("lower", "identifier") or not close.endswith("-whole")
    if close.startswith("bracket"):
        return close.endswith("-whole") or prev == "word" and kind != "lower" or kind not in ("lower", "digit") and prev not in ("inner", "counted")
    if prev in ("title", "initial", "inner", "step"):
        return False
    if prev == "counted":
        return kind != "digit" and not (low in ("ca", "env", "approx", "ok", "fig", "vol", "pp", "sec", "pág", "rys", "abs") or kind == "lower")
    if prev in ("open", "acronym"):
        return kind not in ("lower", "on") and not (kind in ("digit", "identifier") and low != "etc" and low != "usw" and low != "itd")
    if prev == "ordinal" and month:
        return False
    return True


def _opens(line: str) -> bool:
    """Whether a line's text, after markers and labels, begins with an opening quote or bracket."""
    return line[_HEAD.match(line).end() :][:1] in _OPENERS


Weights = dict[str, float]
#: Transitions: from the tag of a near candidate before (True: it ended a unit) to an end.
LINKS = {True: "link end", False: "link inside"}


class Model(Reader):
    """The weights with the sums that follow from a class or a token alone, each worked out once."""

    def __init__(self, weights: Weights) -> None:
        super().__init__()
        self.weights = weights
        self.gains: dict[tuple, float] = {}
        self.forget()

    def forget(self) -> None:
        """To be called when weights have changed."""
        self.gains.clear()
        self.links = {tag: self.weights.get(name, 0.0) for tag, name in LINKS.items()}

    def gain(self, key: tuple) -> float:
        """What an end at a candidate scores; inside scores nothing."""
        held = self.gains.get(key)
        if held is None:
            if len(self.gains) > REMEMBERED:
                self.gains.clear()
            held = self.gains[key] = sum(self.weights.get(f, 0.0) for f in features(key))
        return held

    def decode(self, line: str, found: list[Candidate], gold: list[bool] | None = None, against: list[bool] | None = None) -> list[bool]:
        """The tags of the best path: with ``gold`` of the best that agrees with it, with ``against`` of the best that gains by each tag that differs."""
        opener = _opens(line)
        # state: (tag of the candidate before, unit began with an opener, unit holds a letter or digit)
        best: dict[tuple[bool, bool, bool], tuple[float, tuple | None]] = {(False, opener, False): (0.0, None)}
        for i, (_, start, key, whole, _, near, lettered) in enumerate(found):
            new: dict[tuple[bool, bool, bool], tuple[float, tuple | None]] = {}
            label = gold[i] if gold else None
            plain = self.gain(key)
            opened = self.gain(whole) if whole is not key else plain
            opens = line[start] in _OPENERS
            if against:
                plain, opened = (x + (-MARGIN if against[i] else MARGIN) for x in (plain, opened))
            for (tag, began, held), (score, path) in best.items():
                held = held or lettered
                if label is not True or not held:
                    state = (False, began, held)
                    if state not in new or score > new[state][0]:
                        new[state] = (score, (False, path))
                if held and label is not False:
                    ends = score + (opened if began else plain) + (self.links[tag] if near else 0.0)
                    state = (True, opens, False)
                    if state not in new or ends > new[state][0]:
                        new[state] = (ends, (True, path))
            if not new:  # no path agrees with the labels
                return self.decode(line, found)
            best = new
        path = max(best.values(), key=lambda b: b[0])[1]
        tags = []
        while path is not None:
            tags.append(path[0])
            path = path[1]
        return tags[::-1]


def _features(line: str, found: list[Candidate], tags: list[bool]) -> Iterator[str]:
    """The features of a path: those of every candidate that it tags as an end."""
    began, before = _opens(line), False
    for (_, start, key, whole, _, near, _), tag in zip(found, tags):
        if tag:
            yield from features(whole if began else key)
            if near:
                yield LINKS[before]
            began = line[start] in _OPENERS
        before = tag


def _joined(text: str, layout: str | None) -> Iterator[tuple[str, set[int]]]:
    """(line, places of known ends) for the fit: lines that close with a mark are put together again.

    Lines of scripts without closing marks come as they are and, for joining, stripped of their punctuation; there every
    line end counts.
    """
    line, ends = "", set()
    for a, b in spans(text, layout):
        part = text[a:b].translate(_FLAT).strip()
        if not part or _LOG.match(part):
            continue
        bare = _THAI.search(part) is not None
        if bare:
            yield part, set()
            part = _STRIP.sub("", part).strip()
        free = not _HEAD.match(part).end()
        if line and part and free and (_THAI.match(line[-1]) and _THAI.match(part[0]) or _CLOSED.search(line) and not part[0].islower()):
            ends.add(len(line) + 1)
            line += " " + part
        else:
            if line:
                yield line, ends
            line, ends = part, set()
    if line:
        yield line, ends


def _labels(line: str, found: list[Candidate], ends: set[int]) -> list[bool | None]:
    """A tag for each candidate: True at a known end; elsewhere by the ordered rules."""
    out, began = [], _opens(line)
    for _, start, key, whole, low, _, _ in found:
        if start in ends:
            tag = True
        elif key[0] == "blank":
            tag = key[1:3] == ("bare", "bare")
        else:
            own = whole if began else key
            tag = _rule(*own[:2], low, *own[2:8])
        out.append(tag)
        if tag:
            began = line[start] in _OPENERS
    return out


def fit(texts: list[tuple[str, str | None]]) -> Weights:
    """Averaged weights of a structured perceptron over the weakly labelled lines of the texts."""
    chains, reader = [], Reader()
    for text, layout in texts:
        for line, ends in _joined(text, layout):
            if found := reader.candidates(line):
                chains.append((line, found, _labels(line, found, ends)))
    model, sums, step = Model({}), defaultdict(float), 0
    for _ in range(EPOCHS):
        wrong = 0
        for line, found, labels in chains:
            step += 1
            tags = model.decode(line, found, against=labels)
            if tags == labels or (gold := model.decode(line, found, labels)) == tags:
                continue
            wrong += 1
            for path, by in ((gold, 1.0), (tags, -1.0)):
                for f in _features(line, found, path):
                    model.weights[f] = model.weights.get(f, 0.0) + by
                    sums[f] += by * step
            model.forget()
        if not wrong:
            break
    return {f: w - sums[f] / (step + 1) for f, w in model.weights.items()}


_FLAT = {ord(c): " " for c in "\n\r\x85\u2028\u2029"}
_THAI = re.compile(f"[{_BARE}]")
_STRIP = re.compile(r"[^\w\s฀-๿຀-໿]")
_DOTTED = re.compile(r"(?:[A-Za-z]\.)+[A-Za-z]")
_PLAIN = re.compile(r"[a-z]+(?:[.:]?$|[.!?][A-Z])")


def starts(text: str | None, layout: str | None, model: Model) -> list[int]:
    """The starts of a text's units in Unicode characters; null and blank texts have none."""
    out: list[int] = []
    text = text or ""
    bare = not text.isascii() and _THAI.search(text) is not None
    for a, b in spans(text, layout):
        line = text[a:b]
        if layout == "wrapped":
            line = line.translate(_FLAT)
        rest = line.lstrip()
        if not rest:
            continue
        out.append(a + len(line) - len(rest))
        if layout != "wrapped" and rest[0] in "[0123456789" and _LOG.match(line):
            continue
        if found := model.candidates(line, bare):
            if model.linked:
                out += [a + c[1] for c, tag in zip(found, model.decode(line, found)) if tag]
            else:  # no candidate bears on another, so the best of each is the best path
                gain = model.gain
                out += [a + c[1] for c in found if gain(c[2]) > 0]
    return out


def model(docs: DataFrame) -> Weights:
    """Fits the weights to a sample of docs (text, layout), picked by hash, at most about SAMPLE_TEXTS."""
    n = docs.count()
    share = min(1.0, SAMPLE_TEXTS / max(1, n))
    picked = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)))
    rows = picked.select("text", "layout").orderBy(F.xxhash64("text"), "layout").limit(SAMPLE_TEXTS).collect()
    return fit([(r[0], r[1]) for r in rows])


def split(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", with_text: bool = True) -> DataFrame:
    """(doc_id, char_start[, ordinal, sentence]): the units of every text, numbered from 0 in order.

    docs has text and layout (flow, lines or wrapped; null or unknown means flow). Null, empty and blank
    texts have no units. Repeated rows give repeated units. Units end before the white space between them.
    Other columns are ignored; nothing is shuffled unless files are fewer than cores.
    """
    weights = spark.sparkContext.broadcast(model(docs))  # a few thousand features at most
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, char_start BIGINT" + ", ordinal INT, sentence STRING" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights.value)
        for batch in batches:
            texts, layouts = batch.column("text").to_pylist(), batch.column("layout").to_pylist()
            found = [starts(t, layout, own) for t, layout in zip(texts, layouts)]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            out = {"doc_id": batch.column("doc_id").take(rows), "char_start": pa.array([a for f in found for a in f], pa.int64())}
            if with_text:
                out["ordinal"] = pa.array([i for f in found for i in range(len(f))], pa.int32())
                out["sentence"] = pa.array([t[a:b].rstrip() for t, f in zip(texts, found) for a, b in zip(f, [*f[1:], len(t or "")])], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return spread(spark, docs.select(F.col(doc_id).alias("doc_id"), "text", "layout"), "doc_id").mapInArrow(cut, schema)
