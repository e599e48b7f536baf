"""Personal data: detected entities get keyed surrogates of their own type and shape.

Every kind of value is written as a number in the range of all values of its shape (digits stay
digits, vowels stay vowels, check digits are recomputed) and moved by a keyed permutation of that
range without fixed points. So equal values get equal surrogates wherever they stand (coreference),
different values get different ones (distinctness), no table of values is needed, and the result
doesn't depend on partitions. Given names move within the names of their gender and script; other
words of names keep the ending that shows a gender.

Every shape's range is closed: what may not come out of it (unissued numbers, listed endings, given
names and titles) may not go in either and has a range of its own, so the surrogates of two shapes
never meet. ``with_surrogates`` still checks the whole corpus for surrogates that two values share
(``collisions``) before it replaces anything, moves all but one of them on, and says so in the row.

Names are found by a list of given names, by titles, and by what stands before them (salutations,
"my name is", "Contact:"), given names that no list has included; a name's words are found again in
the rest of the text.

Defined results: a null text stays null; a text without entities stays as it is; values that overlap
are taken in the order of KINDS, then leftmost; repeated rows get equal results; a name without any
letter of the classes (LETTERS) keeps it; columns of the input keep their names and order, and added
ones replace any of the same name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "name")

#: Fixed given names by script and gender.
GIVEN = {
    ("latin", "f"): """
        Alice Amelia Amy Anna Astrid Barbara Beatriz Brigitte Camille Carmen Charlotte Chloé Claire Clara Diana Elena Elizabeth Emily Emma Eva Fatima Giulia Grace
        Hannah Heidi Helen Ines Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Lena Linda Lisa Lucía Margaret Maria Marie Mary Mia Monika Nancy
        Nicole Olivia Patricia Petra Rachel Sabine Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria""".split(),
    ("latin", "m"): """
        Alexander Andreas Antoine Antonio Benjamin Bernd Carlos Charles Christian Daniel David Diego Edward Eric Fernando Florian Frank François George Günther Hans
        Henri Jack James Jan Javier Jean Jesús John Jorge José Juan Jürgen Klaus Lars Louis Luca Luis Marco Mark Martin Matteo Michael Miguel Mohammed Nicolas Noah
        Oliver Pablo Paul Peter Philippe Pierre Richard Robert Stefan Steven Thomas Walter William Wolfgang""".split(),
    ("cyrillic", "f"): "Анастасия Анна Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παύλος".split(),
}
#: Fixed titles that a surname follows.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Herrn Monsieur Madame Mme Señor Señora Sr Sra".split()
#: Fixed words between a given name and a surname.
PARTICLES = "van von zu de den der del della di da la le du dos el bin al ibn".split()
#: Fixed phrases that a name of two words or more follows.
CUES = """
Dear|Contact|Name|From|Author|Signed|Sincerely|Regards|[Mm]y name is|named|signed by|written by|Liebe|Lieber|Sehr geehrter|Sehr geehrte|Hallo|Ansprechpartner|[Mm]ein Name ist
[Ii]ch heiße|Cher|Chère|Bonjour|[Jj]e m'appelle|Estimado|Estimada|Querido|Querida|Hola|[Mm]e llamo|[Mm]i nombre es|Уважаемый|Уважаемая|Дорогой|Дорогая|[Мм]еня зовут|Αγαπητέ|Αγαπητή|[Μμ]ε λένε
"""
#: Fixed classes of letters that stand for each other.
LETTERS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâãäåéèêëíìîïóòôõöøúùûü", "çñšžčćđłńśźżřťďğş", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ",
)
#: Fixed endings of names that show the gender; none ends another.
ENDINGS = ("a", "ski", "ова", "ева", "ина", "ская", "ский", "ов", "ев", "ин")
#: Fixed country codes of one digit and of two; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

CLASS = {c: group for group in LETTERS for c in group}


def number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


class Permutation:
    """A keyed permutation of 0..n-1 that leaves no number where it is (unless n is 1)."""

    def __init__(self, key: bytes, name: str, n: int) -> None:
        self.key, self.name, self.n = key, name, n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.shift = number(key, name, n, "shift") % max(n - 1, 1) + 1

    def round(self, i: int, x: int) -> int:
        return number(self.key, self.name, self.n, i, x) & self.mask

    def walk(self, x: int, rounds: range) -> int:
        """A Feistel network over a range of bits, repeated until it ends below n."""
        while True:
            left, right = x >> self.half, x & self.mask
            if rounds.step > 0:
                for i in rounds:
                    left, right = right, left ^ self.round(i, right)
            else:
                for i in rounds:
                    left, right = right ^ self.round(i, left), left
            x = left << self.half | right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        if self.n <= 1:
            return x
        y = (self.walk(x, range(8)) + self.shift) % self.n
        return self.walk(y, range(7, -1, -1))


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def ending_of(name: str) -> str:
    return next((e for e in ENDINGS if name.endswith(e) and len(name) > len(e) + 2), "")


class Left:
    """The numbers of a shape that are left out: those of texts with a tail (no tail ends another, and
    two more letters stand before it), and of fixed texts without one."""

    def __init__(self, groups: list[str | None], text: str, tails: tuple[str, ...], fixed: tuple[str, ...]) -> None:
        self.tails = [n for t in tails if len(text) > len(t) + 2 and (n := self.number(groups[-len(t) :], text[-len(t) :], t))]
        self.fixed = sorted(n[0] for t in fixed if len(t) == len(text) and (n := self.number(groups, text, t)))

    @staticmethod
    def number(groups: list[str | None], text: str, other: str) -> tuple[int, int] | None:
        """(number, count of numbers) of another text of the same shape, if it is one."""
        value, total = 0, 1
        for group, c, o in zip(groups, text, other, strict=True):
            if group and o.lower() in group and o.isupper() == c.isupper():
                value, total = value * len(group) + group.index(o.lower()), total * len(group)
            elif group or c != o:
                return None
        return value, total

    def below(self, n: int) -> int:
        return sum((n - at + every - 1) // every for at, every in self.tails if n > at) + bisect_left(self.fixed, n)

    def back(self, rank: int) -> int:
        """The number with so many before it that aren't left out."""
        n = rank
        while (m := rank + self.below(n + 1)) != n:
            n = m
        return n


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes, further: dict[tuple[str, str], int] | None = None) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.further = further or {}
        self.of = lru_cache(maxsize=100_000)(self.make)
        self.permutation = lru_cache(maxsize=10_000)(lambda name, n: Permutation(self.key, name, n))

    def reshaped(self, kind: str, text: str, tails: tuple[str, ...] = (), fixed: tuple[str, ...] = ()) -> str:
        """Letters and digits moved together within the texts of the same shape, of which those with
        one of the tails and the fixed ones are left out."""
        groups, value, total = [], 0, 1
        for c in text:
            group = "0123456789" if c in "0123456789" else CLASS.get(c.lower())
            groups.append(group)
            if group:
                value = value * len(group) + group.index(c.lower())
                total *= len(group)
        out_of = Left(groups, text, tails, fixed)
        move = self.permutation(f"{kind}:{'.'.join(g[0] if g else c for g, c in zip(groups, text, strict=True))}", total - out_of.below(total))
        value, out = out_of.back(move(value - out_of.below(value))), []
        for c, group in zip(reversed(text), reversed(groups), strict=True):
            if group:
                value, at = divmod(value, len(group))
                c = group[at].upper() if c.isupper() else group[at]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, kind: str, text: str, new: str) -> str:
        """``text`` with its digits replaced in order."""
        it = iter(new)
        return re.sub("[0-9]", lambda _: next(it), text)

    def make(self, kind: str, text: str) -> str:
        new = getattr(self, f"_{kind}")(text)
        for _ in range(self.further.get((kind, text), 0)):
            new = getattr(self, f"_{kind}")(new)
        return new

    def _email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        return f"{self.reshaped('local', local)}@{'.'.join([*(self.reshaped('label', x) for x in labels[:-1]), labels[-1]])}"

    def _card(self, text: str) -> str:
        d = re.sub("[^0-9]", "", text)
        body = d[0] + str(self.permutation(f"card{len(d)}", 10 ** (len(d) - 2))(int(d[1:-1]))).zfill(len(d) - 2)
        return self.digits("card", text, body + str(luhn(body)))

    def _iban(self, text: str) -> str:
        raw = text.replace(" ", "")
        it = iter(self.iban_of(raw))
        return "".join(c if c == " " else next(it) for c in text)

    def iban_of(self, raw: str) -> str:
        """Check digits of 00, 01 and 99 say the same as 97, 98 and 02; bodies that have such a second
        form are moved among themselves for it, so that it stays one."""
        check = lambda body: 98 - mod97(raw[:2] + "00" + body)
        second = int(raw[2:4]) != check(raw[4:])
        body = self.reshaped("iban2" if second else "iban", raw[4:])
        while second and check(body) not in OTHER_CHECK:
            body = self.reshaped("iban2", body)
        return f"{raw[:2]}{OTHER_CHECK[check(body)] if second else check(body):02d}{body}"

    def _ip(self, text: str) -> str:
        """Addresses of a special range stay in it; the others stay outside of all."""
        n = int.from_bytes(bytes(map(int, text.split("."))), "big")
        within = lambda n: next((r for r in SPECIAL if r[0] <= n < r[0] + r[1]), None)
        if own := within(n):
            m = own[0] + self.permutation(f"ip{own}", own[1])(n - own[0])
        else:
            move = self.permutation("ip", 1 << 32)
            m = move(n)
            while within(m):
                m = move(m)
        return ".".join(map(str, m.to_bytes(4, "big")))

    def _ssn(self, text: str) -> str:
        """Numbers that could be issued become such numbers; the others stay among the others."""
        d = text.replace("-", "")
        if issued(d):
            area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
            n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            n, serial = divmod(self.permutation("ssn", 898 * 99 * 9999)(n), 9999)
            area, group = divmod(n, 99)
            area += 1 + (area >= 665)
            return self.digits("ssn", text, f"{area:03d}{group + 1:02d}{serial + 1:04d}")
        move = self.permutation("ssn-unissued", 10**9)
        n = move(int(d))
        while issued(f"{n:09d}"):
            n = move(n)
        return self.digits("ssn", text, f"{n:09d}")

    def _phone(self, text: str) -> str:
        """The country code stays, and so does a 0 or 1 where an area or a subscriber number begins;
        other digits there go on not to be 0 or 1."""
        code = country_code(text)
        rest = text[len(code) :]
        d = re.sub("[^0-9]", "", rest)
        groups = ["0123456789" if i not in (0, 3) else c if c in "01" else "23456789" for i, c in enumerate(d)]
        value, total = 0, 1
        for c, group in zip(d, groups, strict=True):
            value, total = value * len(group) + group.index(c), total * len(group)
        value, out = self.permutation(f"phone{code}:{len(d)}:{groups[0]}:{groups[min(3, len(d) - 1)]}", total)(value), []
        for group in reversed(groups):
            value, at = divmod(value, len(group))
            out.append(group[at])
        return code + self.digits("phone", rest, "".join(reversed(out)))

    def _name(self, text: str) -> str:
        return " ".join(self.given(w) if w in NAME_OF else w if w in PARTICLES or w.rstrip(".") in TITLES else self.surname(w) for w in text.split(" "))

    def given(self, name: str) -> str:
        pool, at = NAME_OF[name]
        return GIVEN[pool][self.permutation(f"given{pool}", len(GIVEN[pool]))(at)]

    def surname(self, name: str) -> str:
        ending = ending_of(name)
        stem = name[: len(name) - len(ending)]
        return self.reshaped("surname", stem, () if ending else ENDINGS, STEMS[ending]) + ending


TITLE_SET = frozenset(TITLES)
NAME_OF = {name: (pool, i) for pool, names in GIVEN.items() for i, name in enumerate(names)}
#: Words that surnames don't become, by ending and without it.
STEMS = {e: tuple(sorted(w[: len(w) - len(e)] for w in {*NAME_OF, *TITLES} if ending_of(w) == e)) for e in ("", *ENDINGS)}
#: Fixed special ranges of addresses, as their first one and size: this network, private, loopback,
#: link-local, private, private, multicast, reserved.
SPECIAL = [(a << 24 | b << 16, 1 << 32 - bits) for a, b, bits in ((0, 0, 8), (10, 0, 8), (127, 0, 8), (169, 254, 16), (172, 16, 12), (192, 168, 16), (224, 0, 4), (240, 0, 4))]
#: Second forms of check digits.
OTHER_CHECK = {97: 0, 98: 1, 2: 99}
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
UPPER, LOWER = ("".join(c for c in map(chr, range(0x41, 0x530)) if c.isalpha() and test(c)) for test in (str.isupper, str.islower))
CAPITAL = rf"(?:[{UPPER}]['’])?[{UPPER}][{LOWER}]+(?:[-'’]?[{UPPER}][{LOWER}]+)*"
#: Fixed shapes of the kinds.
PATTERNS = {
    "email": re.compile(r"""(?:\w[\w.%+'-]{0,63}|"[^"@\n]{1,60}")@(?:[\w-]+\.)+[^\W\d_]{2,24}(?!\w)"""),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    "ip": re.compile(rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "phone": re.compile(
        r"(?<![0-9A-Za-z+])(?:"
        r"(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}"  # ten digits in three groups
        r"|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}"  # with a country code
        r"|\(?0[0-9]{1,4}\)?[ ./-][0-9]{3,8}(?:[ .-][0-9]{2,6})?"  # with a trunk prefix
        r")(?![0-9A-Za-z])"
    ),
}
DIGITS = re.compile(r"[0-9][0-9 .()-]{5}")
CAPITALISED = re.compile(rf"(?<!\w){CAPITAL}(?!\w)")
BETWEEN = re.compile(rf" (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}")
#: The phrases, with both cases of a bracketed beginning.
PHRASES = tuple(v for cue in re.split(r"[|\n]", CUES.strip()) for v in ([c + cue[4:] for c in cue[1:3]] if cue[0] == "[" else [cue]))


def introduced(text: str, at: int) -> bool:
    """Whether a phrase that a name follows stands right before a place, with a comma or colon at most."""
    before = text[max(0, at - 24) : at]
    head = before.rstrip()
    if head == before:
        return False
    head = head[:-1] if head[-1:] in (":", ",") else head
    return head.endswith(PHRASES) and any(head.endswith(p) and not (head[-len(p) - 1 : -len(p)] or " ").isalnum() for p in PHRASES)


def issued(digits: str) -> bool:
    """Whether a social security number of nine digits could have been issued."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def country_code(text: str) -> str:
    """The country code of a number that begins with +, set apart or not."""
    d = re.sub("[^0-9]", "", text[:12]) if text.startswith("+") else ""
    return "+" + next((d[:n] for n in (1, 2) if d[:n] in CODES), d[:3]) if d else ""


def valid(kind: str, text: str) -> bool:
    if kind == "card":
        d = re.sub("[^0-9]", "", text)
        return luhn(d[:-1]) == int(d[-1])
    if kind == "iban":
        return mod97(text.replace(" ", "")) == 1
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in text) <= 15 and not re.fullmatch(r"[0-9]{4}[ .-][0-9]{2}[ .-][0-9]{2}", text)
    return True


def valid_part(kind: str, m: re.Match) -> tuple[int, int] | None:
    """The match, or for a card the longest part of it that is one: other numbers may stand beside."""
    if valid(kind, m[0]):
        return m.span()
    if kind == "card":
        runs = [r.span() for r in re.finditer("[0-9]+", m[0])]
        parts = [(runs[i][0], runs[j][1]) for i in range(len(runs)) for j in range(i, len(runs))]
        good = [(a, b) for a, b in parts if 13 <= sum(c.isdigit() for c in m[0][a:b]) <= 19 and valid(kind, m[0][a:b])]
        if good:
            a, b = max(good, key=lambda s: s[1] - s[0])
            return m.start() + a, m.start() + b
    return None


def name_spans(text: str) -> Iterator[tuple[int, int]]:
    """Given names and a surname, title and surname, words that a phrase introduces, and each of their
    words again where it stands alone."""
    known: set[str] = set()
    words = [(m.start(), m.end(), m[0]) for m in CAPITALISED.finditer(text)]
    titles, after = [], 0  # words before ``after`` belong to the name before
    for i, (a, b, word) in enumerate(words):
        if word in TITLE_SET:
            titles.append(i)
            continue
        given = word in NAME_OF
        if i < after or i + 1 == len(words) or not BETWEEN.fullmatch(text, b, words[i + 1][0]) or not (given or introduced(text, a)):
            continue
        last = i + 1
        while last + 1 < len(words) and words[last][2] in NAME_OF and BETWEEN.fullmatch(text, words[last][1], words[last + 1][0]):
            last += 1
        after = last + 1
        known.update(w for _, _, w in words[i:after])
        yield a, words[last][1]
    for i in titles:
        if i + 1 == len(words) or text[words[i][1] : words[i + 1][0]] not in (" ", ". "):
            continue
        a, b, word = words[i + 1]
        known.add(word)
        if i + 2 < len(words) and word in NAME_OF and text[b : words[i + 2][0]] == " ":
            b = words[i + 2][1]
            known.add(words[i + 2][2])
        yield a, b
    known -= TITLE_SET
    if known:
        for a, b, word in words:
            if word in known:
                yield a, b


def gaps(taken: list[tuple[int, int, str]], n: int) -> Iterator[tuple[int, int]]:
    last = 0
    for a, b, _ in taken:
        if a > last:
            yield last, a
        last = b
    if n > last:
        yield last, n


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), disjoint and in order. Each kind is looked for in what the kinds before
    it have left, so a value is not lost to another that it stands beside."""
    taken: list[tuple[int, int, str]] = []
    if "@" in text:
        at, last = text.find("@"), 0
        while at >= 0:  # look around each sign instead of at every word
            m = next((m for m in PATTERNS["email"].finditer(text, max(last, at - 64), min(len(text), at + 256)) if m.start() < at < m.end()), None)
            if m:
                last = m.end()
                taken.append((m.start(), last, "email"))
            at = text.find("@", max(at + 1, last))
    if DIGITS.search(text):
        for kind in KINDS[1:-1]:
            found = [(*span, kind) for a, b in gaps(taken, len(text)) for m in PATTERNS[kind].finditer(text, a, b) if (span := valid_part(kind, m))]
            if found:
                taken = sorted(taken + found)
    names: list[tuple[int, int]] = []
    for a, b in sorted(set(name_spans(text)), key=lambda s: (s[0], -s[1])):
        if not names or a >= names[-1][1]:
            names.append((a, b))
    if names:
        at = 0
        held = list(taken)
        for a, b in names:
            while at < len(held) and held[at][1] <= a:
                at += 1
            if at == len(held) or held[at][0] >= b:
                taken.append((a, b, "name"))
        taken.sort()
    return taken


def replace(text: str, to: Surrogates) -> tuple[str, list[tuple[int, int, str]]]:
    found, out, last = entities(text), [], 0
    if not found:
        return text, found
    for a, b, kind in found:
        out += [text[last:a], to.of(kind, text[a:b])]
        last = b
    return "".join([*out, text[last:]]), found


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The rows with texts replaced, and ``n_entities``, ``entity_kinds`` (sorted, with counts) and
    ``n_collisions``: how many of them had to be moved on because another value had their surrogate."""
    further = resolved(docs, key, text_col)

    @F.pandas_udf("text string, n_entities int, entity_kinds string, n_collisions int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        to = Surrogates(key, further)
        for texts in batches:
            rows = []
            for t in texts:
                if t is None:
                    rows.append((None, 0, "", 0))
                    continue
                new, found = replace(t, to)
                kinds = [k for _, _, k in found]
                moved = sum((k, t[a:b]) in further for a, b, k in found) if further else 0
                rows.append((new, len(found), ",".join(f"{k}:{kinds.count(k)}" for k in sorted(set(kinds))), moved))
            yield pd.DataFrame(rows, columns=["text", "n_entities", "entity_kinds", "n_collisions"])

    names = [c for c in docs.columns if c.lower() not in ("n_entities", "entity_kinds", "n_collisions", "_run")]
    out = docs.select(*names, run(text_col).alias("_run"))
    return out.select(*(F.col("_run.text").alias(c) if c == text_col else F.col(c) for c in names), "_run.n_entities", "_run.entity_kinds", "_run.n_collisions")


def entity_table(docs: DataFrame, key: bytes, text_col: str = "text", further: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """Distinct (kind, value, surrogate) of the corpus."""

    @F.pandas_udf("array<struct<kind:string,value:string,surrogate:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        to = Surrogates(key, further)
        for texts in batches:
            yield pd.Series([[{"kind": k, "value": v, "surrogate": to.of(k, v)} for k, v in sorted({(k, t[a:b]) for a, b, k in entities(t)})] if t else [] for t in texts])

    # explode would filter empty arrays first and look for entities twice
    return docs.select(F.explode_outer(run(text_col)).alias("e")).where("e is not null").select("e.*").distinct()


def collisions(docs: DataFrame, key: bytes, text_col: str = "text", further: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(kind, surrogate, values, first) of surrogates that more than one value got. None are expected:
    each shape's map is one to one, and shapes have ranges of their own."""
    found = entity_table(docs, key, text_col, further)
    return found.groupBy("kind", "surrogate").agg(F.count("value").alias("values"), F.min("value").alias("first")).where("values > 1")


def resolved(docs: DataFrame, key: bytes, text_col: str = "text") -> dict[tuple[str, str], int]:
    """How many times more a value's surrogate is moved so that no two values of the corpus share one.
    The least of those that meet keeps its own; the driver holds only the others."""
    further: dict[tuple[str, str], int] = {}
    while met := [tuple(r) for r in collisions(docs, key, text_col, further).select("kind", "surrogate", "first").collect()]:
        first = {(k, s): v for k, s, v in met}
        shared = entity_table(docs, key, text_col, further).where(F.struct("kind", "surrogate").isin([F.struct(F.lit(k), F.lit(s)) for k, s in first]))
        for r in shared.collect():
            if r.value != first[r.kind, r.surrogate]:
                n = further.get((r.kind, r.value), 0) + 1
                while Surrogates(key, {(r.kind, r.value): n}).of(r.kind, r.value) == r.value:
                    n += 1
                further[r.kind, r.value] = n
    return further
