"""PII surrogates: detected entities get keyed, type-consistent replacements.

Detection finds e-mail addresses, phone numbers, IPv4 addresses, payment card numbers, national
ids of the form 3-2-4, IBANs, access keys and assigned secrets, and names after a title. An
entity's identity ignores format (case of an address, punctuation of a number), so all mentions in
all documents share one replacement (coreference), written in the format of each mention. A
replacement is drawn by a keyed hash: digits become digits, letters become letters of the same
case and script, separators and fixed parts stay, IPv4 parts stay valid, card numbers (found by
their check digit) pass it again, and names are built from syllables of the same script with a
given-name ending that fits the gender of the title.

Distinctness is checked over the corpus: the distinct entities get replacements, and those that
two entities share, or that equal a real entity, are drawn again, until no collision is left; the
smallest entity keeps a contested replacement. Texts that no pattern can match are not shuffled;
the others meet the replacements of their own entities in one join.

Defined cases: a null text stays null, an empty one empty; a document without entities is
unchanged; repeated rows get equal results; rows without id are treated like any other; overlapping
matches go to the earlier and then the longer one; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import chunks, documents, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Titles with the gender they carry.
TITLES = {
    "Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f",
    "Señor": "m", "Señora": "f", "Sr.": "m", "Sra.": "f", "Monsieur": "m", "Madame": "f", "Mme": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
# Syllables of invented names and endings of given names by script and gender.
SYLLABLES = {
    "LATIN": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve".split(),
    "CYRILLIC": "ба бе бо ва ве да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то".split(),
    "GREEK": "βα βε δα δε κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}
GIVEN_ENDING = {"LATIN": {"m": "n", "f": "ia"}, "CYRILLIC": {"m": "н", "f": "ия"}, "GREEK": {"m": "ος", "f": "ία"}}

# Each kind has a cheap mark in the text; only the surroundings of a mark meet the full pattern.
DIGITS = re.compile(r"\d[\d .()\-]*")
NUMBERS = re.compile(
    r"(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d.]*\d)"
    r"|(?<![\d\-])(?P<card>[3-6]\d{3}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,4}(?:\d{3})?)(?![\d\-]*\d)"
    r"|(?<![\d\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d\-]*\d)"
    r"|(?<![\d+])(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}"
    r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)")
MAIL_RIGHT = re.compile(r"[^\W_][\w\-]*(?:\.[\w\-]+)*\.[^\W\d_]{2,}")
SETTING = re.compile(r"[:=]\s*[\"']?(?=[A-Za-z0-9+/_\-]{8})")
SECRET_NAME = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)$")
SECRET = re.compile(r"[A-Za-z0-9+/_\-]+")
KEY_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
KEY = re.compile(r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})\b")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
NAME = regex.compile(
    r"(?<!\p{L})(?P<title>" + "|".join(regex.escape(t) for t in sorted(TITLES, key=len, reverse=True))
    + r")\s(?P<name>\p{Lu}\p{L}+(?:[ \-]\p{Lu}\p{L}+){0,2})")
LETTERS = regex.compile(r"\p{L}+")
#: Every entity has one of these characters or a title in its text. Patterns take decimal digits of
#: every script; those the JVM does not know yet are unassigned to it.
MARKS = r"[\p{Nd}\p{Cn}@=:]"
#: Shortest texts that all titles and key marks contain one of.
STEMS = ("Mr", "Ms", "Miss", "Herr", "Frau", "Se\u00f1or", "Sr", "Monsieur", "Madame", "Mme", "Госпо", "Κύριος",
         "Κυρία", *KEY_MARKS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def identity(kind: str, mention: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "ssn", "phone"):
        return "".join(c for c in mention if c.isdigit())
    if kind == "iban":
        return mention.replace(" ", "")
    return mention.lower() if kind == "email" else mention


def mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, kind, identity)`` of everything that looks like an entity; may overlap."""
    at = text.find("@")
    while at >= 0:
        left, right = at, MAIL_RIGHT.match(text, at + 1)
        while right and left and (text[left - 1].isalnum() or text[left - 1] in "_.%+-"):
            left -= 1
        if right and left < at:
            yield left, right.end(), "email", text[left:right.end()]
        at = text.find("@", at + 1)
    for island in DIGITS.finditer(text):
        for m in NUMBERS.finditer(text, max(0, island.start() - 2), min(len(text), island.end() + 2)):
            if m.lastgroup != "card" or luhn(identity("card", m[0])):  # else some other long number
                yield *m.span(m.lastgroup), m.lastgroup, m[m.lastgroup]
    for m in SETTING.finditer(text):
        end = m.start()
        while end and text[end - 1].isspace():
            end -= 1
        if SECRET_NAME.search(text[max(0, end - 16):end]):
            value = SECRET.match(text, m.end())
            yield *value.span(), "secret", value[0]
    if any(mark in text for mark in KEY_MARKS):
        for m in KEY.finditer(text):
            yield *m.span(), "key", m[0]
    for m in IBAN.finditer(text):
        if not text[m.start() - 1:m.start()].isalnum():
            yield *m.span(), "iban", m[0]
    if any(title in text for title in TITLES):
        for m in NAME.finditer(text):
            yield *m.span("name"), "name", f"{TITLES[m['title']]} {m['name']}"


def words_of_names(people: list[tuple[int, str]]) -> list[tuple[int, str, str, str]]:
    """``(start, word, kind, identity)`` of every word of the names (start, gender and name) of a text.
    The last word is the family name; a single word after a title is one too, unless a full name of
    the same text has it as a given name."""
    words = []
    for start, who in people:
        last = who.rindex(" ") + 1
        words += [(start + m.start() - 2, m[0], who[0], last == 2, m.start() >= last)
                  for m in LETTERS.finditer(who, 2)]
    given = {word.capitalize() for _, word, _, single, last in words if not single and not last}
    family = {word.capitalize() for _, word, _, single, last in words if last and not single}
    family |= {word.capitalize() for _, word, _, single, _ in words if single} - given
    out = []
    for at, word, gender, single, last in words:
        plain = word.capitalize()
        own = plain in family if single else last
        out.append((at, word, "family", plain) if own else (at, word, "given", f"{gender} {plain}"))
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions that stand, in order: the earlier one, then the longer one. Names are cut into their
    words; further mentions of these words are entities as well (of two kinds the family name, of two
    genders that of the first mention)."""
    out, people, end = [], [], 0
    for a, b, kind, what in sorted(mentions(text), key=lambda m: (m[0], -m[1])):
        if a >= end:
            end = b
            if kind == "name":
                people.append((a, what))
            else:
                out.append((a, b, kind, identity(kind, what)))
    if not people:
        return out
    words = words_of_names(people)
    out = sorted(out + [(at, at + len(word), kind, who) for at, word, kind, who in words])
    alone: dict[str, tuple[str, str]] = {}
    for kind in ("family", "given"):
        for _, word, own, who in words:
            if own == kind and len(word) > 2:
                for form in (word, word.capitalize(), word.upper()):
                    alone.setdefault(form, (kind, who))
    starts, more = [a for a, *_ in out], []
    for m in LETTERS.finditer(text) if alone else ():
        if m[0] in alone:
            at = bisect.bisect_right(starts, m.start())
            if (not at or out[at - 1][1] <= m.start()) and (at == len(out) or m.end() <= starts[at]):
                more.append((*m.span(), *alone[m[0]]))
    return sorted(out + more)


class Draw:
    """Keyed stream of choices for one entity and attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.h = hashlib.blake2b("\x1f".join(parts).encode(), key=key, digest_size=64)
        self.pool, self.turn = int.from_bytes(self.h.digest(), "big"), 0
        self.left = 512

    def pick(self, n: int) -> int:
        if self.left < 64:
            self.turn += 1
            self.h.update(self.turn.to_bytes(4, "big"))
            self.pool, self.left = int.from_bytes(self.h.digest(), "big"), 512
        self.pool, out = divmod(self.pool, n)
        self.left -= n.bit_length()
        return out


def script_of(ch: str) -> str:
    return unicodedata.name(ch, "LATIN").split()[0]


#: First letter and number of letters of the alphabets that letters are drawn from.
ALPHABET = {"LATIN": ("a", 26), "CYRILLIC": ("а", 32), "GREEK": ("α", 17)}


def alike(text: str, draw: Draw, hexadecimal: bool = False) -> str:
    """Digits for digits, letters for letters of the same case and script; all else stays."""
    out = []
    for ch in text:
        if ch.isdigit():
            out.append(str(draw.pick(10)))
        elif ch.isalpha():
            first, n = ("a", 6) if hexadecimal else ALPHABET.get(script_of(ch), ALPHABET["LATIN"])
            new = chr(ord(first) + draw.pick(n))
            out.append(new.upper() if ch.isupper() else new)
        else:
            out.append(ch)
    return "".join(out)


def surrogate(kind: str, who: str, key: bytes, attempt: int) -> str:
    """Replacement of an identity; equal input gives equal output on every machine."""
    draw = Draw(key, kind, who, str(attempt))
    # A format that stays contested is too small for its entities: make room.
    more = "".join(str(draw.pick(10)) for _ in range(attempt // 16))
    if kind == "email":
        local, _, domain = who.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{alike(local, draw)}{more}@{alike(host, Draw(key, 'host', domain))}.{top}"
    if kind == "ip":
        return ".".join(str(draw.pick(254) + 1) for _ in range(4))
    if kind == "card":
        body = who[0] + "".join(str(draw.pick(10)) for _ in who[1:-1]) + more
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "phone":
        country = max(0, len(who) - 10)
        return who[:country] + str(2 + draw.pick(8)) + alike(who[country + 1:], draw) + more
    if kind == "secret":
        return alike(who, draw, all(c in "0123456789abcdef" for c in who)) + more
    if kind == "key":
        head = 4 if who[:4].isupper() else who.index("_" if "_" in who else "-") + 1
        return who[:head] + alike(who[head:], draw) + more
    if kind == "iban":
        return who[:2] + alike(who[2:], draw) + more
    if kind in ("given", "family"):
        word = who[2:] if kind == "given" else who
        script = script_of(word[0])
        script = script if script in SYLLABLES else "LATIN"
        new = "".join(SYLLABLES[script][draw.pick(len(SYLLABLES[script]))] for _ in range(2 + draw.pick(2) + attempt // 16))
        return new.capitalize() + (GIVEN_ENDING[script][who[0]] if kind == "given" else "")
    return alike(who, draw) + more


def write(kind: str, mention: str, new: str) -> str:
    """The replacement in the format of one mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(new)
        out = "".join(next(chars, "") if c.isalnum() else c for c in mention)
        return out + "".join(chars)
    return new.upper() if kind in ("given", "family") and len(mention) > 1 and mention.isupper() else new


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = [(h, kind, who) for h, text in zip(batch.column("text_hash").to_pylist(),
                                                  batch.column("text").to_pylist(), strict=True)
                for kind, who in dict.fromkeys((k, w) for *_, k, w in entities(text))]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                                          pa.array(cols[2], pa.string())], ["text_hash", "kind", "who"])


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, who, new`` with a replacement of its own for every distinct entity."""

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, who, attempt = (batch.column(c).to_pylist() for c in ("kind", "who", "attempt"))
            new = [surrogate(k, w, key, a) for k, w, a in zip(kind, who, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("who"), batch.column("attempt"), pa.array(new, pa.string())],
                ["kind", "who", "attempt", "new"])

    # A replacement reads like a name without the gender of the title.
    found = found.withColumn("plain", F.when(F.col("kind") == "given", F.expr("substring(who, 3)"))
                                   .otherwise(F.col("who")))
    real = found.select("kind", F.col("plain").alias("new")).distinct()
    shape = "kind string, who string, attempt int, new string"
    given = save(found.select("kind", "who", F.lit(0).alias("attempt")).mapInArrow(draw, shape), "surrogates")
    while True:
        # The entity that drew first keeps a contested replacement, then the smaller one.
        owner = given.groupBy("kind", "new").agg(F.min(F.struct("attempt", "who")).alias("o"))
        checked = (given.join(owner, ["kind", "new"])
                   .join(real.withColumn("taken", F.lit(True)), ["kind", "new"], "left")
                   .withColumn("again", F.col("taken").isNotNull() | (F.col("o.who") != F.col("who"))))
        checked = save(checked.select("kind", "who", "attempt", "new", "again"), "checked")
        if checked.where("again").isEmpty():
            return checked.select("kind", "who", "new")
        given = save(checked.where("not again").select("kind", "who", "attempt", "new").unionByName(
            checked.where("again").select("kind", "who", (F.col("attempt") + 1).cast("int").alias("attempt"))
            .mapInArrow(draw, shape)), "surrogates")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, entities`` of every document: the text with replacements, and where each
    stands in it (kind, start, end). ``key`` is the secret that makes replacements unpredictable."""
    secret = hashlib.sha256(key.encode()).digest()
    own = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    possible = F.col("text").rlike(MARKS)
    for stem in STEMS:
        possible = possible | F.col("text").contains(stem)
    possible = F.coalesce(possible, F.lit(False))
    found = save(own.where(possible).select("text_hash", "text")
                 .mapInArrow(_found, "text_hash long, kind string, who string").distinct(), "mentions")
    given = assign(found.select("kind", "who").distinct(), secret)
    per_text = (found.join(given, ["kind", "who"]).groupBy("text_hash")
                .agg(F.collect_list(F.struct("kind", "who", "new")).alias("given")))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, marks = [], []
            for text, given in zip(batch.column("text").to_pylist(), batch.column("given").to_pylist(), strict=True):
                new = {(g["kind"], g["who"]): g["new"] for g in given or ()}
                out, spans, at, size = [], [], 0, 0
                for a, b, kind, who in entities(text) if new else ():
                    if a < at:
                        continue
                    put = write(kind, text[a:b], new[(kind, who)])
                    out += [text[at:a], put]
                    size += a - at
                    spans.append({"kind": kind, "start": size, "end": size + len(put)})
                    size += len(put)
                    at = b
                texts.append("".join([*out, text[at:]]) if out else text)
                marks.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()),
                 pa.array(marks, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "text", "entities"])

    kinds = "array<struct<kind:string,start:long,end:long>>"
    changed = (own.where(possible).join(per_text, "text_hash", "left").select("doc_id", "text", "given")
               .mapInArrow(apply, f"doc_id long, text string, entities {kinds}"))
    same = own.where(~possible).select("doc_id", "text", F.expr(f"cast(array() as {kinds})").alias("entities"))
    return changed.unionByName(same)
