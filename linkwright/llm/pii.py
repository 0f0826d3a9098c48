"""Personal data: plain identifiers, and disguised ones found on a normalised copy whose spans map back to the source.

Transducers rewrite a text and carry, for every character they write, the source characters it came from: homoglyphs and
invisible characters, character references, spelled digits, then at/dot disguises. Identifiers found on the result map back
through that table. All patterns bound the white space they take, so a text of any length costs linear time.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# possessive digit runs keep these linear; starting inside a run could match nothing that its start doesn't
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _emails(text: str) -> list[Span]:
    """The leftmost matches of the address pattern, looked for around each @ (the local part can't hold one)."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Base spans: per kind leftmost and non-overlapping, those that fail their test dropped; by start, then kind."""
    found = _emails(text)
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters and signs of other scripts drawn like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ᴏ": "o", "․": ".", "。": ".", "‐": "-", "‑": "-",
}
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
# Digit words by language.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
# Endings that let bare words and spaced signs stand for a disguise; those that are English words need a bracket or
# a plain sign beside them.
ENDINGS = frozenset("com org net edu gov mil info biz name pro io co dev app ai xyz online shop store site tech cloud blog news email page "
                    "uk de fr es eu ca au ch nl se pl dk fi ie nz cz gr hu pt br mx jp cn kr ru ua tr za tv museum at it us in no be is me".split())
WORD_ENDINGS = frozenset("at it us in no be is me name pro page store news email".split())
# Words before "at" or a spaced sign that name no mailbox.
NOT_NAMES = frozenset("a about all also am an and are available back be bought buy by call contact found free get go going he her here him hosted i is it join just "
                      "live look looked looking looks located me meet met more my new not now of off on online only or order our out page posted price published read "
                      "register s see sell shop show site sold stay store t that the their them then there they this to up us visit was we website were what where "
                      "with work working works you your".split())

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGITS = re.compile(rf"(?i)\b(?:(?:{_WORD})\b[\s,-]{{1,3}}){{2}}(?:{_WORD})\b")
_ITEM = re.compile(rf"(?i)(?P<plus>\bplus\b|\+)|(?:\b(?P<times>double|triple)[\s-]{{1,2}})?(?:\b(?P<word>{_WORD})\b|(?P<num>[0-9]+))|(?P<dot>\bdot\b)")
_GAP = re.compile(r"[\s,-]{0,3}")
_OPEN, _CLOSE = r"[\[({<]{1,2}[ \t]{0,2}", r"[ \t]{0,2}[\])}>]{1,2}"
_ENTITY = re.compile(r"(?i)&(?:#0{0,4}64|#x0{0,4}40|commat);|&(?:#0{0,4}46|#x0{0,4}2e|period);")
_HIDDEN_DOT = rf"[ \t]{{0,3}}{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}[ \t]{{0,3}}|[ \t]{{1,3}}dot[ \t]{{1,3}}|[ \t]{{1,2}}\.[ \t]{{1,2}}"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_SPLIT = re.compile(rf"(?i)(\.|{_HIDDEN_DOT})")
_ADDRESS = re.compile(
    rf"(?i)(?<=[A-Za-z0-9])(?:(?P<bracket>[ \t]{{0,3}}{_OPEN}(?:at|@|arroba){_CLOSE}[ \t]{{0,3}})|(?P<bare>[ \t]{{1,3}}at[ \t]{{1,3}}|[ \t]{{0,3}}@[ \t]{{1,3}})|@)"
    rf"(?P<domain>{_LABEL}(?:(?:\.|{_HIDDEN_DOT}){_LABEL}){{1,5}})")
_JOINED = re.compile(r"(?i)(?<=[A-Za-z0-9])([_-])at\1([A-Za-z0-9]{1,63}(?:\1dot\1[A-Za-z0-9]{1,63}){1,5})")
_BEFORE = re.compile(rf"(?i)[A-Za-z0-9._%+-]+(?:(?:{_HIDDEN_DOT})[A-Za-z0-9_%+-]+){{0,4}}\Z")
_SPACED = re.compile(r"(?<![^\s])(?:[A-Za-z0-9][ \t]){2,30}[A-Za-z0-9]\Z")
_QUAD = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_HIDDEN_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")
_FOREIGN = re.compile("[" + re.escape("".join(HOMOGLYPHS) + INVISIBLE) + "①-⓿⁰-₟！-～\U0001d400-\U0001d7ff]")
_REACH = 160  # characters before a sign that its local part may take

Edit = tuple[int, int, str]


class Mapped:
    """A text and, for each of its characters, the source span [lo, hi) it stands for."""

    def __init__(self, text: str, lo: list[int] | None = None, hi: list[int] | None = None):
        self.text = text
        self.lo = list(range(len(text))) if lo is None else lo
        self.hi = list(range(1, len(text) + 1)) if hi is None else hi

    def rewritten(self, edits: list[Edit]) -> Mapped:
        """Each (a, b, new) puts new in the place of text[a:b]; what is written stands for that place's whole source. Edits are
        in order and don't overlap."""
        if not edits:
            return self
        text, lo, hi, last = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[last:a], new]
            lo += self.lo[last:a] + [self.lo[a]] * len(new)
            hi += self.hi[last:a] + [self.hi[b - 1]] * len(new)
            last = b
        return Mapped("".join(text) + self.text[last:], lo + self.lo[last:], hi + self.hi[last:])


def _letters(text: str) -> list[Edit]:
    """Homoglyphs, invisible characters and compatibility forms."""
    out = []
    for m in _FOREIGN.finditer(text):
        c = m[0]
        plain = "" if c in INVISIBLE else HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
        if plain.isascii():
            out.append((m.start(), m.end(), plain))
    return out


def _entities(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "@" if m[0].rstrip(";").endswith(("64", "40", "mat", "MAT")) else ".") for m in _ENTITY.finditer(text)]


def _run_edits(text: str, run: list[re.Match]) -> list[Edit]:
    """Digits for a run of number items, if three digit words stand in a row in it or three spelled dots part it."""
    while run and run[-1]["dot"]:
        run.pop()
    if not run or not (sum(m["dot"] is not None for m in run) >= 3 or _DIGITS.search(text, run[0].start(), run[-1].end())):
        return []
    out, last = [], run[0].start()
    for m in run:
        if m.start() > last:
            out.append((last, m.start(), ""))
        digits = m["num"] if m["word"] is None else str(DIGIT_WORDS[m["word"].lower()])
        new = "." if m["dot"] else "+" if m["plus"] else digits[:1] * (3 if m["times"].lower() == "triple" else 2) + digits[1:] if m["times"] else digits
        if new != m[0]:
            out.append((m.start(), m.end(), new))
        last = m.end()
    return out


def _numbers(text: str) -> list[Edit]:
    """Spelled digits: runs of digit words, numbers, spelled dots between them and a leading plus, up to three signs apart."""
    out, run = [], []
    for m in _ITEM.finditer(text):
        follows = run and not m["plus"] and not (m["dot"] and (run[-1]["dot"] or run[-1]["plus"])) and _GAP.fullmatch(text, run[-1].end(), m.start())
        if not follows:
            out += _run_edits(text, run)
            run = []
            if m["dot"]:
                continue
        run.append(m)
    return out + _run_edits(text, run)


def _domain(text: str, lo: int, hi: int, bracket: bool, bare: bool) -> tuple[int, list[Edit]]:
    """Where the domain in text[lo:hi] ends (lo if none does) and the edits of its dots; labels too many at its end go."""
    parts = _SPLIT.split(text[lo:hi])
    labels, dots = parts[0::2], parts[1::2]
    while len(labels) > 1:
        end, dot = labels[-1].lower(), dots[-1]
        sure = bracket or any(d.strip()[:1] in "[({<" for d in dots if d.strip())
        plain = dot == "." or dot.strip()[:1] in "[({<"
        if end.isalpha() and len(end) > 1 and (sure and plain or not bare and plain or end in ENDINGS and (plain or end not in WORD_ENDINGS)):
            break
        labels.pop()
        dots.pop()
    if len(labels) < 2:
        return lo, []
    edits, at = [], lo
    for label, dot in zip(labels, [*dots, ""]):
        at += len(label)
        if dot and dot != ".":
            edits.append((at, at + len(dot), "."))
        at += len(dot)
    return at, edits


def _addresses(text: str) -> list[Edit]:
    """At and dot disguises of addresses; whether one counts depends on its own surroundings alone."""
    out, at = [], 0
    while m := _ADDRESS.search(text, at):
        at = m.start() + 1
        bracket, bare = m["bracket"] is not None, m["bare"] is not None
        end, dots = _domain(text, m.start("domain"), m.end("domain"), bracket, bare)
        if end == m.start("domain") or not (bracket or bare or dots):
            continue
        begin = max(0, m.start() - _REACH, out[-1][1] if out else 0)
        before = text[begin : m.start()]
        if spaced := _SPACED.search(before):
            local = [(begin + i, begin + i + 1, "") for i in range(spaced.start(), spaced.end()) if before[i] in " \t"]
        elif named := _BEFORE.search(before):
            local = [(begin + named.start() + d.start(), begin + named.start() + d.end(), ".") for d in _SPLIT.finditer(named[0]) if d[0] != "."]
            word = re.split(r"[ \t]", named[0])[-1].lower()
            if bare and word in NOT_NAMES and not any(text[a:b].strip()[:1] in ("[", "(", "{", "<") for a, b, _ in dots):
                continue
        else:
            continue
        sign = (m.start(), m.start("domain"), "@")
        out += [*local, *([sign] if text[sign[0] : sign[1]] != "@" else []), *dots]
        at = end
    return out


def _joined_addresses(text: str) -> list[Edit]:
    out = []
    for m in _JOINED.finditer(text):
        labels = re.split(rf"(?i){m[1]}dot{m[1]}", m[2])
        if labels[-1].lower() in ENDINGS:
            out.append((m.start(), m.end(), "@" + ".".join(labels)))
    return out


def _quads(text: str) -> list[Edit]:
    return [(m.start() + d.start(), m.start() + d.end(), ".") for m in _QUAD.finditer(text) for d in _SPLIT.finditer(m[0]) if d[0] != "."]


def _hides_dots(low: str) -> bool:
    return "dot" in low or any(x in low for x in ("[.", "(.", "{.", "<.", " . ", "[ .", "( .", "punkt", "punto", "point", "\t"))


def normalised(text: str) -> Mapped | None:
    """The rewritten text, or None where no transducer has anything to rewrite. The checks before each one only spare work:
    each holds wherever the transducer has an edit."""
    m = Mapped(text) if not text.isascii() and _FOREIGN.search(text) else None
    if m:
        m = m.rewritten(_letters(text))
    for may, edits in (
        (lambda t: "&" in t, _entities),
        (lambda t: _DIGITS.search(t) or t.lower().count("dot") >= 3, _numbers),
        (lambda t: _hides_dots(t.lower()), _quads),
        (lambda t: "_at_" in (low := t.lower()) or "-at-" in low, _joined_addresses),
        (lambda t: True, _addresses),
    ):
        now = m.text if m else text
        if may(now) and (found := edits(now)):
            m = (m or Mapped(text)).rewritten(found)
    return m


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """Base spans and those that only the normalised text shows: of spans of a kind none that lies within a base one."""
    base = identifiers(text) if base is None else base
    m = normalised(text)
    if m is None or m.text == text:
        return base
    out = list(base)
    for kind, a, b in identifiers(m.text):
        lo, hi = m.lo[a], m.hi[b - 1]
        if not any(k == kind and s <= lo and hi <= e for k, s, e in base):
            out.append((kind, lo, hi))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for b in batches:
        out = [[] for _ in range(7)]
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            base = identifiers(text or "")
            row = [doc_id, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_spans(text or "", base))]
            for c, x in zip(out, row):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(out)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Null counts as empty; a text without spans has the empty string's digest and an empty spans. Null and repeated
    doc_ids keep their rows, an empty table gives none, other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first, then the longest."""
    if not text or not (spans := all_spans(text)):
        return text
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
            last = b
        elif b > last:
            last = b
    return "".join(out) + text[last:]


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def mask_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span of personal data becomes its kind's name; n_chars follows where it is a column.

    Null and empty texts stay as they are, as do null and repeated doc_ids, repeated rows and all other columns whatever their
    names; an empty table gives an empty one.
    """
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            texts = [masked(t) for t in b.column(names.index("text")).to_pylist()]
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array([None if t is None else len(t) for t in texts], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
