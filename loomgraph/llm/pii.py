"""Personal data with offset-preserving deobfuscation (operator 8).

Plain patterns give the base spans. A text with signs of disguise then goes
through transducers: look-alike letters and digits become ASCII, invisible
characters go, spelled digits become digits, and at/dot disguises become "@"
and ".". Each writes, beside its output, the source span of every output
character, so that identifiers found in the normalised text map back to the
characters of the source. Added spans never replace base ones.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import slices, small_batches, table, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# The base patterns, each read in time linear in the text: an e-mail address is found from its "@",
# an address of numbers within a whole run of dotted numbers, and what is repeated is never given back.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+: an "@" with a name before it and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end(), "email"
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[Span]:
    """Matches of [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), from left to right: four by four in a run of dotted numbers."""
    for m in _NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, end, "ip"
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, leftmost and not overlapping within a kind, by start and kind."""
    out = [*_emails(text), *_addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Look-alikes of ASCII characters: Cyrillic, Greek, full-width and other forms.
_PAIRS = (
    "аaеeоoрpсcхxуyіiјjѕsһhԁdԛqԝwкkмmтtвbнnгrАAВBЕEКKМMНHОOРPСCТTХXУYІIЈJЅSЗ3"
    "αaεeοoρpνvιiκkτtυuχxΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
    "ɑaɡgıiℓl⁺+＋+﹢+＠@﹫@．.。.․.﹒.‐-‑-‒-–-—-―-−-－-﹣-（(）)        　 "
)
_LOOKS = {ord(_PAIRS[k]): _PAIRS[k + 1] for k in range(0, len(_PAIRS), 2)}
_LOOKS |= {0xFF10 + k: chr(48 + k) for k in range(10)} | {0xFF21 + k: chr(65 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
_LOOKS |= {base + k: chr(48 + k) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
_LOOKS |= {base + k: chr(48 + k) for base in (0x2080,) for k in range(10)} | {0x245F + k: chr(48 + k) for k in range(1, 10)} | {0x24EA: "0", 0x2070: "0", 0xB9: "1", 0xB2: "2", 0xB3: "3"} | {0x2070 + k: chr(48 + k) for k in range(4, 10)}
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, 0x200E, 0x200F], "")
_CHARS = _LOOKS | _HIDDEN
_ODD_CHAR = re.compile("[" + "".join(map(re.escape, map(chr, _CHARS))) + "]")

# Spelled digits: English, German, French, Spanish.
_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_SPELL = "|".join(sorted(_WORDS, key=len, reverse=True))
_SPOKEN_DOT = "dot|point|punkt|punto"
#: What runs of digits are made of; between two of these a run has at most two separators.
_ITEM = re.compile(rf"(?<![^\W_])(?:(?P<word>{_SPELL})|(?P<dot>{_SPOKEN_DOT})|(?P<plus>plus))(?![^\W_])|(?P<digits>[0-9]++)|(?P<sign>\+)", re.I)
_SEPARATORS = frozenset(" ,.()-")
_SOME_SPELLED = re.compile(rf"(?<![^\W_])(?:{_SPELL})(?![^\W_])[ ,.-]{{1,2}}(?:{_SPELL})(?![^\W_])", re.I)

_DOT = r"(?:dot|punkt|punto|point)"
#: A bare "at" before a name with plain dots counts only with one of these ends: else "at home.Then" would.
_ENDS = r"\.(?:com|org|net|edu|gov|info|biz|io|co|eu|de|fr|es|it|nl|uk|us)(?![A-Za-z0-9-])"
_AT = re.compile(r"[ ]?(?:\[|\(|\{|<)[ ]?(?:at|@|arroba|ät|chez|arobase)[ ]?(?:\]|\)|\}|>)[ ]?", re.I)
_DOTS = re.compile(rf"[ ]?(?:\[|\(|\{{|<)[ ]?(?:{_DOT}|\.)[ ]?(?:\]|\)|\}}|>)[ ]?", re.I)
#: What makes digits before it the end of a name; words that are no beginning of one.
_FOLLOWS = re.compile(rf"[ ]?(?:@|(?:\[|\(|\{{|<)[ ]?(?:at|@|arroba|ät|chez|arobase|{_DOT}|\.)[ ]?(?:\]|\)|\}}|>))|(?:[ ]+|_)(?:at|arroba|arobase|{_DOT})(?:[ ]+|_)", re.I)
_NO_NAMES = frozenset("at is to on or and mail email e-mail me write contact".split())
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])[ ]+@[ ]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ ]+(?=[A-Za-z0-9-]+[ ]?\.[ ]?[A-Za-z])")
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:[ ]+|_)(?:at|arroba|arobase)(?:[ ]+|_)(?=[A-Za-z0-9-]+(?:(?:[ ]+|_){_DOT}(?:[ ]+|_)[A-Za-z0-9-]+|(?:\.[A-Za-z0-9-]+)*{_ENDS}))", re.I)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:[ ]+|_){_DOT}(?:[ ]+|_)(?=[A-Za-z0-9])", re.I)
_SPACED_DOT = re.compile(r"(?<=[A-Za-z0-9])[ ]+\.[ ]+(?=[A-Za-z0-9])")
_SOME_AT = re.compile(rf"[\[({{<][ ]?(?:at|@|arroba|ät|chez|arobase|{_DOT}|\.)[ ]?[\])}}>]|[A-Za-z0-9] +@|@ +[A-Za-z0-9]|(?<![^\W]){_DOT}(?![^\W_])|_{_DOT}_|(?<![^\W_])(?:at|arroba|arobase)(?![^\W_])[ _]+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_ENDS}", re.I)


class Tape:
    """A text that maps back to the one it was rewritten from, and so to the source."""

    __slots__ = ("begins", "parent", "pieces", "text")

    def __init__(self, text: str, parent: "Tape | None" = None, begins: list[int] | None = None, pieces: list[tuple[int, int, bool]] | None = None):
        self.text, self.parent, self.begins, self.pieces = text, parent, begins, pieces

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Tape":
        """Replace spans, in order and apart; each new character stands for its whole span."""
        if not edits:
            return self
        text, begins, pieces, size, at = [], [], [], 0, 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            for part, piece in ((self.text[at:a], (at, a, True)), (new, (a, b, False))):
                if part:
                    text.append(part)
                    begins.append(size)
                    pieces.append(piece)
                    size += len(part)
            at = b
        return Tape("".join(text), self, begins, pieces)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of the characters from a to b."""
        tape = self
        while tape.parent is not None:
            first, last = bisect_right(tape.begins, a) - 1, bisect_right(tape.begins, b - 1) - 1
            begin, _, same = tape.pieces[first]
            a_ = begin + a - tape.begins[first] if same else begin
            begin, end, same = tape.pieces[last]
            b_ = begin + b - tape.begins[last] if same else end
            a, b, tape = a_, b_, tape.parent
        return a, b


def _look_alikes(t: Tape) -> Tape:
    return t.rewrite([(m.start(), m.end(), _CHARS[ord(m[0])]) for m in _ODD_CHAR.finditer(t.text)])


def _runs(text: str) -> Iterator[list[re.Match]]:
    """Runs of spelled and plain digits, with a sign before them and spoken dots among them; one spelled digit at least and two items."""
    run: list[re.Match] = []

    def whole() -> list[re.Match]:
        while run and run[-1].lastgroup not in ("word", "digits"):
            run.pop()
        while run and run[0].lastgroup == "dot":
            run.pop(0)
        spelled = sum(x.lastgroup == "word" for x in run)
        return run if spelled and sum(x.lastgroup in ("word", "digits") for x in run) > 1 else []

    for m in _ITEM.finditer(text):
        if run and (m.lastgroup in ("plus", "sign") or m.start() - run[-1].end() > 2 or not _SEPARATORS.issuperset(text[run[-1].end() : m.start()])):
            if out := whole():
                yield out
            run = []
        run.append(m)
    if out := whole():
        yield out


def _spelled(t: Tape, names: bool = False) -> Tape:
    """Runs of spelled digits as digits: blanks and commas between digits go, spoken dots become dots.

    With names, digits before a disguised "@" or "." join the word before them:
    they are the end of a name.
    """
    edits, text = [], t.text
    for run in _runs(text):
        begin, end = run[0].start(), run[-1].end()
        if names and begin > 1 and text[begin - 1] == " " and text[begin - 2] in _LOCAL and _FOLLOWS.match(text, end):
            if text[:begin].rsplit(None, 1)[-1].lower() not in _NO_NAMES:
                edits.append((begin - 1, begin, ""))
        at = begin
        for k, x in enumerate(run):
            dots = x.lastgroup == "dot" or k and run[k - 1].lastgroup in ("dot", "plus")
            edits += [(j, j + 1, "") for j in range(at, x.start()) if text[j] in " ," or dots and text[j] == " "]
            if x.lastgroup == "word":
                edits.append((x.start(), x.end(), str(_WORDS[x[0].lower()])))
            elif x.lastgroup in ("dot", "plus"):
                edits.append((x.start(), x.end(), "." if x.lastgroup == "dot" else "+"))
            at = x.end()
    return t.rewrite(edits)


def _at_dot(t: Tape) -> Tape:
    for pattern, new in ((_AT, "@"), (_DOTS, "."), (_BARE_AT, "@"), (_SPACED_AT, "@")):
        t = t.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(t.text)])
    edits = []
    for m in _BARE_DOT.finditer(t.text):
        edits.append((m.start(), m.end(), "."))
    t = t.rewrite(edits)
    # blanks around a dot go only right of an "@": elsewhere they end sentences
    edits = [(m.start(), m.end(), ".") for m in _SPACED_DOT.finditer(t.text) if "@" in t.text[max(0, m.start() - 64) : m.start()].rsplit(" ", 1)[-1]]
    return t.rewrite(edits)


class _Apart:
    """Spans that do not overlap, in order."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.begins, self.ends = [], []
        for a, b in spans:
            self.begins.append(a)
            self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.begins, b)
        return not k or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.begins, a)
        self.begins.insert(k, a)
        self.ends.insert(k, b)


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and kind; offsets are code points, end exclusive.

    The transducers run alone and one after the other (a name can end in
    spelled digits before a disguised "@"); of added spans that overlap, the
    longest stays.
    """
    base = base_spans(text)
    odd = not text.isascii() and bool(_ODD_CHAR.search(text))
    if not (odd or _SOME_AT.search(text) or _SOME_SPELLED.search(text)):
        return base, base
    tape = _look_alikes(Tape(text)) if odd else Tape(text)
    own = {kind: _Apart(s[:2] for s in base if s[2] == kind) for kind in KINDS}
    more: set[Span] = set()
    for t in dict.fromkeys((tape, _at_dot(tape), _spelled(tape), _at_dot(_spelled(tape, names=True)))):
        if t.text != text:
            for a, b, kind in base_spans(t.text):
                a, b = t.source(a, b)
                if own[kind].free(a, b):
                    more.add((a, b, kind))
    found, taken = [], _Apart()
    for a, b, kind in sorted(more, key=lambda s: (s[0] - s[1], s[0], KINDS.index(s[2]))):
        if taken.free(a, b):
            taken.add(a, b)
            found.append((a, b, kind))
    return base, sorted(base + found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base counts by kind, digest of the base spans, all spans, how many the deobfuscation added.

    A null text counts as empty (no spans, the digest of ""); repeated rows give
    repeated results; other columns are left aside.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in slices(batches, 512):
            rows = []
            for text in texts_of(batch, "text"):
                base, both = find_spans(text)
                n = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(both), len(both) - len(base)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def redact_column(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all columns stay, null texts stay null."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, 512):
            texts = [t if t is None else redact(t, find_spans(t)[1]) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
