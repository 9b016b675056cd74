"""Surrogates for personal data: detected entities get keyed replacements of their own type and format.

E-mail addresses, phone numbers, IPv4 addresses, card numbers, social security numbers, IBANs and titled names are found. A replacement
moves each character within its class (digits, vowels or consonants of one script and case) by a keyed, non-zero amount that depends on
the type and on all that precedes it, so it is a bijection on entities of one type and format: equal entities get equal surrogates
anywhere in the corpus (coreference), different ones different surrogates (distinctness). What must keep a form moves within the values
of that form: given names within the list of their gender and script, and other given names to names outside the lists; the middle
group 555, a leading 0 and country codes stay and the others move among the others. Card and IBAN numbers keep their check digits right
if they were. Mail hosts move to reserved ones: those of example.com, .net and .org stay there, all others go below .example, so that
no surrogate is somebody's mailbox. Names count with a title, or untitled if a listed given name and a second name stand together.
Separators, letter case, scripts of digits and leading zeros of an IPv4 address do not change an entity (``same``). The maps need no
look at other entities, so nothing is gathered; ``collisions`` checks a corpus by grouping its entities by surrogate.

Null texts stay null, empty ones empty; repeated rows get equal texts; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetrail.llm import shared
from pyspark.sql import types as T

KEY = "surrogates-1"

#: Given names by gender and script; a name moves within its own list.
NAMES = {
    "female latin": "Mary Anna Emma Olivia Sophia Maria Laura Julia Sarah Alice Clara Helen Ruth Nina Eva Lucia Carmen Elena Marie Claire".split(),
    "male latin": "John James Robert Michael William David Thomas Peter Paul Mark Daniel Henry George Carlos Luis Hans Karl Jean Pierre Luc".split(),
    "female cyrillic": "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split(),
    "male cyrillic": "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
}
_NAME_LIST = {n: (k, i) for k, names in NAMES.items() for i, n in enumerate(names)}

_CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
)
_CLASS_OF = {c: (k, i) for k, chars in enumerate(_CLASSES) for i, c in enumerate(chars)}

_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Г-н|г-н|Г-жа|г-жа|Господин|господин|Госпожа|госпожа"
_NAME = "[A-ZÀ-ÞА-ЯЁ][a-zß-ÿа-яё]+"
_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,254}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|0[1-9](?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{6,8})(?![\w-]))"
    rf"|(?P<person>(?<!\w)(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(_NAME_LIST)}) {_NAME}))"
)


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 if k % 2 else 2)
        total += d - 9 * (d > 9)
    return -total % 10


#: Country codes of two digits; 1 and 7 have one, all others three. None starts another, so the digits alone tell the code.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _digits_of(text: str) -> str:
    digits = re.sub(r"\D", "", text)
    return digits if digits.isascii() else "".join(str(int(c)) for c in digits)


def _country(digits: str) -> int:
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3


def same(kind: str, text: str) -> str:
    """One form for all spellings of an entity, or of a surrogate."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "phone":
        return ("+" if text[0] == "+" else "") + _digits_of(text)
    if kind in ("card", "ssn"):
        return _digits_of(text)
    return text.replace(" ", "") if kind == "iban" else text.replace(".", "").lower() if kind == "person" else text.lower()


class Surrogates:
    """Replacements under one key."""

    def __init__(self, key: str = KEY):
        self.key = key.encode()

    def _number(self, *what: str) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(what).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()[:8], "big")

    def moved(self, kind: str, text: str, fixed: int = 0) -> str:
        """Each character moves within its class by 1 or more; the first ``fixed`` stay. Lower and upper case move alike."""
        out, shape = [], "".join(str(_CLASS_OF[c.lower()][0]) if c.lower() in _CLASS_OF else c for c in text)
        for k, c in enumerate(text):
            if k < fixed or c not in _CLASS_OF:
                out.append(c)
                continue
            of, i = _CLASS_OF[c]
            chars = _CLASSES[of]
            by = 1 + self._number(kind, shape, text[:k].lower()) % (len(chars) - 1)
            out.append(chars[(i + by) % len(chars)])
        return "".join(out)

    def _stepped(self, x: int, n: int, *what: str) -> int:
        """x of 0 to n - 1 moves by 1 or more."""
        return (x + 1 + self._number(*what) % (n - 1)) % n

    def _digits(self, kind: str, text: str, moved: str) -> str:
        digits = iter(moved)
        return "".join(next(digits) if c.isdigit() else c for c in text)

    def email(self, text: str) -> str:
        """Hosts below example.com, .net or .org keep these; all others get .example after them, one more where they end so already."""
        name, _, host = text.rpartition("@")
        labels = host.split(".")
        if labels[-2].lower() == "example" and labels[-1].lower() in ("com", "net", "org"):
            keep = 2
        else:
            ends = 0
            while ends < len(labels) - 1 and labels[-1 - ends].lower() == "example":
                ends += 1
            keep = min(ends + 1, len(labels) - 1)
            labels = [*labels, "example"]
            keep += 1
        moved, rest = labels[:-keep], labels[-keep:]
        return self.moved("email", f"{name}@{'.'.join(moved)}") + ("." if moved else "") + ".".join(rest)

    def ip(self, text: str) -> str:
        parts, out = [int(x) for x in text.split(".")], []
        for k, x in enumerate(parts):
            low, high = (1, 223) if k == 0 and 1 <= x <= 223 else (0, 255) if k else (224, 255) if x else (0, 0)
            n = high - low + 1
            out.append(low + (x - low + 1 + self._number("ip", str(k), *map(str, parts[:k])) % (n - 1)) % n if n > 1 else x)
        return ".".join(map(str, out))

    def card(self, text: str) -> str:
        digits = _digits_of(text)
        body = self.moved("card", digits[:-1], fixed=1)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        return self._digits("card", text, body + str((luhn(body) + off) % 10))

    def ssn(self, text: str) -> str:
        return self._digits("ssn", text, self.moved("ssn", _digits_of(text)))

    def iban(self, text: str) -> str:
        """The country stays; the check digits are as far from the right ones as they were."""
        whole = text.replace(" ", "")
        right = lambda account: 98 - int("".join(str(int(c, 36)) for c in account + whole[:2]) + "00") % 97
        account = self.moved("iban", whole[4:])
        check = (right(account) + int(whole[2:4]) - right(whole[4:])) % 100
        letters = iter(f"{whole[:2]}{check:02d}{account}")
        return "".join(c if c == " " else next(letters) for c in text)

    def phone(self, text: str) -> str:
        """The country code and a first 0 stay. Of ten digits, a first 1 stays too, 2 to 9 move among themselves, and 555 in the middle stays."""
        digits = _digits_of(text)
        country = _country(digits) if text[0] == "+" else 0
        rest = digits[country:]
        out = list(self.moved("phone", rest, fixed=1))
        first = int(rest[0]) if rest else 0
        if len(rest) == 10:
            if first >= 2:
                out[0] = str(2 + self._stepped(first - 2, 8, "phone", "area"))
            middle = int(rest[3:6])
            if middle != 555:
                middle = self._stepped(middle - (middle > 555), 999, "phone", "middle", rest[:3])
                middle += middle >= 555
            out[3:6] = f"{middle:03d}"
        elif first:
            out[0] = str(1 + self._stepped(first - 1, 9, "phone", "first", str(len(rest))))
        return self._digits("phone", text, digits[:country] + "".join(out))

    def person(self, text: str) -> str:
        names = text.split(" ")
        out = [] if names[0] in _NAME_LIST else [names.pop(0)]
        for k, n in enumerate(names):
            kind, i = _NAME_LIST.get(n, (None, 0))
            if kind and k == 0:
                names_of = NAMES[kind]
                out.append(names_of[self._stepped(i, len(names_of), "given", kind)])
            else:
                new = self.moved("name", n)
                while k == 0 and new in _NAME_LIST:  # walks on to a name outside the lists, whose names are taken
                    new = self.moved("name", new)
                out.append(new)
        return " ".join(out)

    def replace(self, text: str, seen: dict[tuple[str, str], str]) -> tuple[str, list[str]]:
        """(text with surrogates, kinds found); seen gathers (kind, entity) -> surrogate."""
        kinds: list[str] = []

        def one(m: re.Match) -> str:
            kind, whole = m.lastgroup, m.group()
            if kind == "card":
                digits = re.sub(r"\D", "", whole)
                if len(digits) != 16 and luhn(digits[:-1]) != int(digits[-1]):
                    return whole
            kinds.append(kind)
            key = (kind, whole)
            if key not in seen:
                seen[key] = getattr(self, kind)(whole)
            return seen[key]

        return _FIND.sub(one, text), kinds


def surrogates(docs: DataFrame, key: str = KEY, text: str = "text", kinds_name: str = "pii_kinds") -> DataFrame:
    """docs with the text replaced, and pii_kinds array<string> (or another name): the kind of each replaced entity, in order; a column of
    that name in docs is replaced. A narrow job."""
    kept = docs.drop(kinds_name)
    schema = T.StructType([*kept.schema.fields, T.StructField(kinds_name, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            at, seen, texts, kinds = batch.schema.get_field_index(text), {}, [], []
            for t in batch.column(at):
                new, found = (None, []) if (t := t.as_py()) is None else make.replace(t, seen)
                texts.append(new)
                kinds.append(found)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], names=schema.names)

    return kept.mapInArrow(shared.tidy(run), schema)


def collisions(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """(kind, surrogate, entities) of the surrogates that stand for two entities or more anywhere in docs: none, unless a map is no bijection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            seen: dict[tuple[str, str], str] = {}
            for t in batch.column(0).to_pylist():
                if t is not None:
                    make.replace(t, seen)
            rows = sorted({(kind, same(kind, whole), same(kind, new)) for (kind, whole), new in seen.items()})
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["kind", "entity", "surrogate"])

    found = docs.select(text).mapInArrow(shared.tidy(run), "kind string, entity string, surrogate string").distinct()
    return found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("entities")).where("entities > 1")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in text, and n_chars after it where that column exists; all other columns stay, whatever their names."""
    kinds = shared.free_name(docs, "pii_kinds")
    out = surrogates(docs, key, kinds_name=kinds)
    if "n_chars" in docs.columns:
        changed = F.when(F.size(kinds) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.drop(kinds)
