"""Surrogates for personal data.

Detected entities are replaced by others of their type: each letter by a letter
of its script and case, each digit by a digit, separators as they stand, with
check digits of cards and accounts and address ranges kept valid; names after a title or that begin with a
known given name (a parameter), and the same names alone in the same document, by names of that gender and script
(a given name's gender is what its titles, or its list, in all documents tell). A replacement depends on a key and on the entity
alone (digits of a phone however it is written, an address in any case, each
part of a name), so all its mentions in all documents agree.

Addresses, cards and phones are looked for one after another, each between what
is found already, so entities that stand next to each other do not hide each
other.

Distinct entities of a shape go through a keyed permutation of all strings of
that shape, so they cannot meet, but one may land on another real entity; names
come from lists and may meet. So the distinct entities of the corpus are
checked against each other's surrogates, and those in conflict try again with
another key until none is left; from the twelfth attempt on (names: the
twenty-fifth) they grow by a character each time, so an end is certain. Names of
scripts without a list change letter by letter. Only the entities that had to try again, and
given names whose gender another title tells, are remembered; the others are replaced where they stand.

Cases: a null text stays null and has no entities; copies are replaced alike;
an entity of no letters and digits to change is left; an empty table gives no
rows; documents without an entity come back unchanged; other columns stay away.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator, Mapping
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "phone", "card", "ip", "name", "iban", "id")
#: Entities that had to try again or change gender, up to which they are broadcast (under 50 MB).
BROADCAST_ENTITIES = 200_000

#: Titles and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Mme": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f"}
#: Given names and surnames for surrogates, by script and gender.
NAMES = {
    ("latin", "f"): "Anna Berta Clara Dora Elsa Frieda Greta Hanna Irma Jutta Klara Lena Marta Nora Olga Paula Rosa Selma Thea Vera",
    ("latin", "m"): "Albert Bruno Carl David Emil Franz Georg Hugo Ivan Jonas Karl Ludwig Martin Norbert Oskar Paul Rolf Simon Tobias Viktor",
    ("latin", "n"): "Alex Bente Chris Dominique Eike Finn Gerrit Jona Kim Luca Maxime Nicola Robin Sascha Toni",
    ("latin", "s"): "Adler Brandt Castel Dumont Engel Ferrer Garnier Huber Ibanez Jansen Keller Lambert Moreno Navarro Olsen Petit Quintana Romero Santos Thoma Urban Vidal Weber Zimmer",
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Ирина Лидия Мария Нина Ольга",
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Иван Кирилл Лев Максим Павел",
    ("cyrillic", "n"): "Саша Женя Валя",
    ("cyrillic", "s"): "Бондар Гринь Кравчук Лысенко Мельник Ткач Шевчук Яременко",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
#: Beginnings and ends of surnames for surrogates; every beginning goes with every end.
SURNAMES = {
    "latin": ("Ash Brad Brom Chat Craw Dray Dun Farn Glad Hal Hart Hol Kirk Lang Marl Nor Oak Pen Rad Shel Stan Thorn Wake Whit Wood", "bury by combe croft dale den field ford ham hurst ley man mere more shaw stead stone ton well wick worth"),
    "cyrillic": ("Бел Вол Гор Дуб Зим Кар Лес Мор Пол Род Сав Тар", "енко инчук ачук еняк иняк овец"),
}
for _script, (_begins, _ends) in SURNAMES.items():
    NAMES[_script, "s"] += [a + b for a in _begins.split() for b in _ends.split()]
#: Given names that tell a name without a title, if a capitalised word follows; none is a word of its own. Callers may give others.
GIVEN = {
    "f": "Amanda Amy Andrea Angela Ann Anna Anne Barbara Betty Carol Catherine Christine Cynthia Deborah Debra Diane Donna Dorothy Elizabeth Emily Evelyn Hannah Helen Jane Janet Jennifer Jessica Julia Julie Karen Kathleen Kimberly Laura Linda Lisa Margaret Maria Marie Martha Mary Megan Melissa Michelle Nancy Nicole Olivia Pamela Patricia Rachel Rebecca Ruth Sandra Sarah Sharon Sophia Stephanie Susan Teresa Theresa Virginia",
    "m": "Aaron Adam Alan Albert Alexander Andrew Anthony Arthur Benjamin Brian Carl Charles Christopher Daniel David Dennis Donald Douglas Edward Eric Gary George Gregory Harold Henry James Jason Jeffrey Jeremy John Jonathan Joseph Joshua Justin Keith Kenneth Kevin Kyle Larry Lawrence Matthew Michael Nathan Nicholas Patrick Paul Peter Philip Richard Robert Roger Ronald Ryan Samuel Scott Stephen Steven Thomas Timothy Walter William Zachary",
}
GIVEN = {name: gender for gender, names in GIVEN.items() for name in names.split()}
#: Alphabets within which characters change; those of other scripts are ranges of Unicode.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâäèéêëìíîïòóôöùúûüñçß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω",
    *("".join(map(chr, range(a, z + 1))) for a, z in ((0x561, 0x586), (0x5D0, 0x5EA), (0x641, 0x64A), (0x915, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))),
)
#: Attempts after which an entity also grows by a character an attempt: however many entities there are, their share of all strings of a shape then falls tenfold each time, so some attempt is free.
GROWS_AFTER = 11
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}

_LATIN, _CYRILLIC = re.compile("[a-zà-öø-ÿß]"), re.compile("[а-яё]")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,63}")
_LOCAL = re.compile(r"[\w.%+-]")
#: Where numbers can be: all that the patterns below find lies inside one of these.
_NUMBERS = re.compile(r"[+(\d][\d .()+-]{5,}\d")
_IP = re.compile(r"(?<![\w.+])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)(?!\w)")
_CARD = re.compile(r"(?<![\w.+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)")
_OWN_CARD = re.compile(r"(?<!\d-)" + _CARD.pattern)
_PHONE = re.compile(r"(?<![\w.+])(?:(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ ]?\d{3,4}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,4}(?:[ .-]\d{3,4}){2}|[2-9]\d{2}-\d{4}(?!-\d)|(?<!\d[-.])[2-9]\d{9}(?![-.]\d))(?!\w)")
#: National numbers of persons in groups of 3, 2 and 4 digits, and account numbers of a country, check digits and groups.
_ID = re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_TITLED = re.compile(r"\b(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b\.?[ ]((?:[^\W\d_a-zß-öø-ÿа-я][\w'-]+)(?: [^\W\d_a-zß-öø-ÿа-я][\w'-]+){0,2})")
#: A capitalised word before another, and what stands after a given name: perhaps a second one, and a surname.
_CAPITAL = re.compile(r"\b[A-Z][a-zà-öø-ÿß]+(?= [^\W\d_a-zß-öø-ÿ])")
_SURNAME = re.compile(r" ([A-ZÀ-ÖØ-Þ][\w'-]*[a-zß-öø-ÿ][\w'-]*)")
_HEX = frozenset("0123456789abcdefABCDEF")
#: First groups of addresses in use: global, local to a link or a site, of many hosts.
_IN_USE = re.compile(r"[23][0-9a-f]{3}|fe[89ab][0-9a-f]|f[cdf][0-9a-f]{2}")
#: Where a name ends that has 's, or an apostrophe or dash of no word after it.
_POSSESSIVE = re.compile(r"(?:'[sS]|['-]+)(?= |$)")

#: Words, and what names' words are made of.
_WORD, _PIECE = re.compile(r"\w+"), re.compile(r"\w+|['-]")


def _digits(number: str) -> str:
    return "".join(c for c in number if c.isdigit())


def _address(text: str, start: int, end: int) -> int:
    return end if all(int(x) <= 255 for x in text[start:end].split(".")) else 0


def _long_addresses(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Addresses of eight groups of hex digits, or of fewer with :: where the first group is one in use (so that a::b in code is none)."""
    at = text.find(":")
    while at >= 0:
        start, stop = at, at + 1
        while start and at - start < 5 and text[start - 1] in _HEX:
            start -= 1
        while stop < len(text) and stop - start < 41 and (text[stop] == ":" or text[stop] in _HEX):
            stop += 1
        end = stop - (text[stop - 1] == ":" and text[stop - 2] != ":")
        if text.count(":", start, end) > 1 and not (start and (text[start - 1].isalnum() or text[start - 1] in "_:")) and not (text[stop : stop + 1].isalnum() or text[stop : stop + 1] in ("_", ".")[: 1 + text[stop + 1 : stop + 2].isdigit()]):
            try:
                first = ipaddress.IPv6Address(text[start:end]).exploded[:4]
            except ValueError:
                first = ""
            if first and ("::" not in text[start:end] or _IN_USE.match(first)):
                yield start, end, "ip", ""
        at = text.find(":", stop)


def _named(text: str, given: Mapping[str, str]) -> Iterator[tuple[int, int, str, str]]:
    """Known given names with the surname after them."""
    resume = 0
    for m in _CAPITAL.finditer(text):
        if m.start() < resume or m.group() not in given:
            continue
        last = _SURNAME.match(text, m.end())
        if last and last.group(1) in given:
            last = _SURNAME.match(text, last.end()) or last
        if last:
            own = _POSSESSIVE.search(text, m.end(), last.end())
            resume = own.start() if own else last.end()
            yield m.start(), resume, "name", given[m.group()]


def _valid_card(text: str, start: int, end: int) -> int:
    return end if _luhn(_digits(text[start:end])) == 0 else 0


def _remainder(account: str) -> int:
    """What check digits make 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _phone(text: str, start: int, end: int) -> int:
    return end if 7 <= len(_digits(text[start:end])) <= 15 else 0


def _phone_before(text: str, start: int, end: int) -> int:
    """Where a phone ends whose match ran on into a further number: before a separator, so that it has 15 digits at most and doesn't part the next number."""
    for stop in range(end, start, -1):
        if _phone(text, start, stop) and not (text[stop : stop + 1] in (".", "-") and text[stop + 1 : stop + 2].isdigit()) and not text[stop : stop + 1].isdigit() and _PHONE.fullmatch(text, start, stop):
            return stop
    return 0


#: In this order each looks between what is found already; the function gives where the entity ends, 0 if there is none.
_PASSES = (("ip", _IP, _address), ("id", _ID, lambda text, start, end: end), ("card", _OWN_CARD, _valid_card), ("phone", _PHONE, _phone), ("card", _OWN_CARD, lambda text, start, end: end), ("phone", _PHONE, _phone_before), ("card", _CARD, lambda text, start, end: end))


def _numbers(text: str, start: int, stop: int) -> list[tuple[int, int, str, str]]:
    """Addresses, cards and phones in a part of a text that holds no other characters than theirs."""
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, ending in _PASSES:
        at = start
        for limit, after in [*((x[0], x[1]) for x in sorted(found)), (stop + 2, 0)]:  # two more characters for what must not follow
            while m := pattern.search(text, at, limit):
                if end := ending(text, m.start(), m.end()):
                    found.append((m.start(), end, kind, ""))
                # A phone that ran on is left whole for the later pass, which finds where it ends.
                at = end or (m.end() if ending is _phone else m.start() + 1)
            at = after
    return found


def detect(text: str, given: Mapping[str, str] = MappingProxyType({})) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of entities, in order, without overlaps; the gender is "" but for names. given: genders ("f", "m", "n") of given names that need no title."""
    found = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1)
        if m and start < at:
            found.append((start, m.end(), "email", ""))
        at = text.find("@", at + 1)
    for m in _IBAN.finditer(text):
        if _remainder(m.group().replace(" ", "")) == 1:
            found.append((*m.span(), "iban", ""))
    found += _long_addresses(text)
    for m in _NUMBERS.finditer(text):
        found += _numbers(text, m.start(), m.end())
    for m in _TITLED.finditer(text):
        own = _POSSESSIVE.search(m.group(2))
        found.append((m.start(2), m.start(2) + own.start() if own else m.end(2), "name", TITLES[m.group(1)]))
    out = _between(_apart(found), _named(text, given))
    # Words of these names without a title: what each is (surname, or a given name by gender) goes into the gender, after "=".
    known: dict[str, str] = {}
    for a, b, kind, gender in out:
        if kind == "name":
            for sub, word in parts(kind, gender, text[a:b]):
                if known.get(word, "n") == "n" or sub == "name_s":
                    known[word] = sub[-1]
    if not known:
        return out
    tree, key_of = _spellings(known, text, out)
    taken = iter([*out, (len(text), len(text), "", "")])
    more, x, resume = [], next(taken), 0
    for m in _WORD.finditer(text):
        if m.start() < resume or not (stop := _longest(tree, text, m.start())):
            continue
        start, words = m.start(), [text[m.start() : stop]]
        while len(words) < 3 and text[stop : stop + 1] == " " and (end := _longest(tree, text, stop + 1)):
            words.append(text[stop + 1 : end])
            stop = end
        resume = stop
        while x[1] <= start:
            x = next(taken, (len(text) + 1, len(text) + 2, "", ""))
        if stop <= x[0]:
            more.append((start, stop, "name", "=" + "".join(known[key_of[w]] for w in words)))
    return sorted(out + more)


def _spellings(known: dict[str, str], text: str, found: list[tuple[int, int, str, str]]) -> tuple[dict, dict[str, str]]:
    """How known words may be written (as found names write them, in title case, in capitals) as a tree of pieces, and the known word of each."""
    key_of = {w: w.lower() for a, b, kind, _ in found if kind == "name" for w in text[a:b].split(" ") if w.lower() in known}
    for k in known:
        for w in (k.title(), k.upper(), k[:1].upper() + k[1:]):
            key_of.setdefault(w, k)
    tree: dict = {}
    for w in key_of:
        node = tree
        for piece in _PIECE.findall(w):
            node = node.setdefault(piece, {})
        node[""] = True
    return tree, key_of


def _longest(tree: dict, text: str, at: int) -> int:
    """Where the longest word of the tree that stands here ends, 0 if none does."""
    node, end = tree, 0
    while (m := _PIECE.match(text, at)) and (node := node.get(m.group())) is not None:
        at = m.end()
        if "" in node and not _WORD.match(text, at):
            end = at
    return end


def _apart(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """In order, without those that overlap an earlier one."""
    out, last = [], 0
    for x in sorted(found):
        if x[0] >= last:
            out.append(x)
            last = x[1]
    return out


def _between(out: list[tuple[int, int, str, str]], more: Iterable[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Finds with those of more, in order, that overlap none of them."""
    starts, new = [x[0] for x in out], []
    for x in more:
        i = bisect.bisect_left(starts, x[1])
        if not i or out[i - 1][1] <= x[0]:
            new.append(x)
    return sorted(out + new) if new else out


def parts(kind: str, gender: str, mention: str) -> list[tuple[str, str]]:
    """(sub-kind, normal form) of what a mention names; a name has one for each of its words, the last a surname if it has several."""
    if kind == "name":
        words = mention.split(" ")
        kinds = gender[1:] if gender.startswith("=") else gender * (len(words) - 1) + "s"
        return [(f"name_{k}", w.lower()) for k, w in zip(kinds, words)]
    if kind == "email":
        return [(kind, mention.lower())]
    if kind == "iban":
        return [(kind, mention.replace(" ", ""))]
    if kind == "ip":
        return [(kind, ipaddress.IPv6Address(mention).exploded if ":" in mention else mention)]
    return [(kind, _digits(mention))]


def permuted(values: list[int], bases: list[int], key: bytes) -> list[int]:
    """A keyed permutation of all vectors under these bases: halves take turns at shifting each other."""
    v, half = list(values), max(1, len(values) // 2)
    for turn in range(8):
        own, other = (range(half), v[half:]) if turn % 2 == 0 else (range(half, len(v)), v[:half])
        shifts = hashlib.blake2b(repr((turn, other, bases)).encode(), key=key, digest_size=64).digest()
        for k, i in enumerate(own):
            v[i] = (v[i] + shifts[k % 64] + 251 * shifts[(k + 7) % 64]) % bases[i]
    return v


def surrogate(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The attempt-th surrogate of a normal form."""
    own = hashlib.blake2b(f"{kind}:{attempt}".encode(), key=key, digest_size=32).digest()
    script = "cyrillic" if _CYRILLIC.search(value) else "latin" if _LATIN.search(value) else ""
    if kind.startswith("name") and script:
        names, draw = NAMES[script, kind[-1]], hashlib.blake2b(value.encode(), key=own, digest_size=32).digest()
        count = min(8, 1 + attempt // 3)
        more = "".join(_permuted_letters("a" * (attempt - 24), own, range(attempt - 24))) if attempt > 24 else ""
        return "-".join([*(names[int.from_bytes(draw[4 * k : 4 * k + 4]) % len(names)] for k in range(count)), *([more + value] if more else [])]).lower()
    grown = max(0, attempt - GROWS_AFTER)
    if kind == "ip" and ":" in value:
        groups = [int(x, 16) for x in value.split(":")]
        own_groups = [i for i, x in enumerate(groups) if x]  # what is zero stays, so that :: can
        for i, x in zip(own_groups, permuted([groups[i] - 1 for i in own_groups], [65535] * len(own_groups), own)):
            groups[i] = x + 1
        return ":".join(f"{x:04x}" for x in groups) + ("%" + "1" * grown if grown else "")
    if kind == "ip":
        octets = permuted([int(x) for x in value.split(".")], [256] * 4, own)
        return ".".join(map(str, octets)) + (":" + "1" * grown if grown else "")
    value = "x" * grown + value if kind == "email" else value + value[-1:] * grown if kind.startswith("name") else value + "0" * grown
    fixed = len(value) - value.rfind(".") if kind == "email" else 0  # the top domain stays
    places = [i for i in range(4 if kind == "iban" else 0, len(value) - fixed - (kind == "card")) if value[i].lower() in _PLACE]
    out = _permuted_letters(value, own, places)
    if kind == "card":
        # As far from a valid check digit as the original is: valid numbers stay valid.
        out[-1] = str((_luhn(value) - _luhn("".join(out[:-1]) + "0")) % 10)
    if kind == "iban":
        out[2:4] = "00"
        out[2:4] = f"{98 - _remainder(''.join(out)):02}"
    return "".join(out)


def _permuted_letters(value: str, key: bytes, places) -> list[str]:
    """The characters of a value, those at some places changed within their alphabets and case."""
    at = [_PLACE[value[i].lower()] for i in places]
    out = list(value)
    for i, (a, _), x in zip(places, at, permuted([x for _, x in at], [len(a) for a, _ in at], key)):
        out[i] = a[x].upper() if value[i].isupper() and len(a[x].upper()) == 1 else a[x]
    return out


def _luhn(digits: str) -> int:
    """The Luhn sum modulo 10: 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) % 10 + int(c) // 5 for i, c in enumerate(reversed(digits))) % 10


def written(kind: str, mention: str, replaced: list[str]) -> str:
    """The surrogate in the mention's own format: its separators and its case."""
    if kind == "ip":
        return _long_written(mention, replaced[0]) if ":" in mention else replaced[0]
    if kind == "name":
        return " ".join(r.upper() if w.isupper() and len(w) > 1 else r.title() for w, r in zip(mention.split(" "), replaced))
    if kind == "email":
        return "".join(r.upper() if c.isupper() else r for c, r in zip(mention, replaced[0])) if len(mention) == len(replaced[0]) else replaced[0]
    digits = iter(replaced[0])
    return "".join(next(digits) if c.isdigit() or (kind == "iban" and c != " ") else c for c in mention) + "".join(digits)


def _long_written(mention: str, replaced: str) -> str:
    """Each group where the mention has it, as wide at least and in its case."""
    address, _, more = replaced.partition("%")
    groups, head, tail = address.split(":"), mention.partition("::")[0].split(":"), mention.partition("::")[2].split(":")
    as_wide = lambda old, new: f"{int(new, 16):0{len(old)}x}" if old else ""
    out = ":".join(map(as_wide, head, groups))
    if "::" in mention:
        out += "::" + ":".join(map(as_wide, tail, groups[-len(tail) :]))
    return (out.upper() if mention != mention.lower() else out) + (more and "%" + more)


def _entities(given: Mapping[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            new = []
            for text in batch.column("text").to_pylist():
                for a, b, kind, gender in detect(text, given) if text else ():
                    new.extend(p for p in parts(kind, gender, text[a:b]) if p not in seen)
                    if len(seen) < 1 << 19:
                        seen.update(new[-3:])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.string()), pa.array([v for _, v in new], pa.string())], ["kind", "value"])

    return run


def _tries(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), batch.column("attempt").to_pylist())
            out = pa.array([surrogate(k, v, key, n) for k, v, n in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], ["kind", "value", "attempt", "surrogate"])

    return run


def agreed(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt, surrogate for each distinct entity: no surrogate twice within a kind, and none that is an entity."""
    real = entities.select("kind", F.col("value").alias("surrogate"))
    start = entities.withColumn("attempt", F.lit(0))
    settled, attempt = None, 0
    while True:
        tried = staged(start.mapInArrow(_tries(key), "kind string, value string, attempt int, surrogate string"), "tried")
        first = tried.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        good = tried.join(first, ["kind", "surrogate", "value"], "left_semi").join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            good = good.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = staged(good.select("kind", "value", "attempt", "surrogate"), "good")
        settled = good if settled is None else settled.unionByName(good)
        left = staged(tried.join(good, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "left")
        if left.isEmpty():
            return settled
        start, attempt = left, attempt + 1


_RESULT = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)


def _replace(key: bytes, shared, given: Mapping[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        retried = shared.value if shared else {}
        for batch in batches:
            out, counts = [], []
            own = batch.column("_retried").to_pylist() if "_retried" in batch.schema.names else [None] * batch.num_rows
            for text, more in zip(batch.column("text").to_pylist(), own):
                tries = {(r["kind"], r["value"]): (r["to"], r["attempt"]) for r in more} if more else retried
                n, at, pieces = dict.fromkeys(KINDS, 0), 0, []
                for a, b, kind, gender in detect(text, given) if text else ():
                    replaced = [surrogate(to, v, key, n_try) for k, v in parts(kind, gender, text[a:b]) for to, n_try in (tries.get((k, v), (k, 0)),)]
                    pieces += [text[at:a], written(kind, text[a:b], replaced)]
                    at, n[kind] = b, n[kind] + 1
                out.append("".join([*pieces, text[at:]]) if pieces else text)
                counts.append(n)
            columns = [batch.column("doc_id"), pa.array(out, pa.string()), *[pa.array([n[k] for n in counts], pa.int64()) for k in KINDS]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    return run


def _mentions(given: Mapping[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *p) for i, text in zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist()) if text for a, b, kind, g in detect(text, given) for p in parts(kind, g, text[a:b])]
            found = sorted(set(found))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["_key", "kind", "value"])

    return run


def one_gender(entities: DataFrame) -> DataFrame:
    """kind, value, to: the kind of each given name by all its mentions, the gender that titles tell; that of Dr if they tell none or both."""
    given = entities.filter("kind IN ('name_f', 'name_m', 'name_n')")
    told = given.groupBy("value").agg(F.max(F.col("kind") == "name_f").alias("f"), F.max(F.col("kind") == "name_m").alias("m"))
    to = told.select("value", F.when(F.col("f") & ~F.col("m"), "name_f").when(F.col("m") & ~F.col("f"), "name_m").otherwise("name_n").alias("to"))
    return given.join(to, "value").select("kind", "value", "to")


def replaced(docs: DataFrame, key: bytes, broadcast: int = BROADCAST_ENTITIES, given: Mapping[str, str] = GIVEN) -> DataFrame:
    """doc_id, text with surrogates, and how many entities of each kind it had."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    entities = staged(docs.select("text").mapInArrow(_entities(given), "kind string, value string").distinct(), "entities")
    genders = staged(one_gender(entities), "genders")
    as_found = entities.join(genders, ["kind", "value"], "left").select("kind", "value", F.coalesce("to", "kind").alias("to"))
    attempts = agreed(as_found.select(F.col("to").alias("kind"), "value").distinct(), key).filter("attempt > 0").select(F.col("kind").alias("to"), "value", "attempt")
    retried = as_found.join(attempts, ["to", "value"], "left").select("kind", "value", "to", F.coalesce("attempt", F.lit(0)).alias("attempt")).filter("attempt > 0 OR kind <> to")
    retried = staged(retried, "retried")
    if retried.count() <= broadcast:
        table = {(r["kind"], r["value"]): (r["to"], r["attempt"]) for r in retried.collect()}
        return docs.mapInArrow(_replace(key, spark.sparkContext.broadcast(table), given), _RESULT)
    # Too many to broadcast: each document gets its own, by a hash of its text, with which equal texts agree.
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    mentions = keyed.select("_key", "text").mapInArrow(_mentions(given), "_key long, kind string, value string").distinct()
    own = mentions.join(retried, ["kind", "value"]).groupBy("_key").agg(F.collect_list(F.struct("kind", "value", "to", "attempt")).alias("_retried"))
    return keyed.join(own, "_key", "left").select("doc_id", "text", "_retried").mapInArrow(_replace(key, None, given), _RESULT)
