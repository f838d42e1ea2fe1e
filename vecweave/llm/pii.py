"""Personal data replaced by keyed surrogates of the same kind, format, script and gender.

A value's surrogate is a function of a secret key, the value's canonical form and an attempt
number, 0 unless the collision check says otherwise. The same value therefore gets the same
surrogate in every document (coreference), without a table of all values. Names are drawn from
syllables; every other kind is a keyed permutation of its format's values (a Feistel network over
the format's letters and digits), so surrogates of one format differ by construction.

The check runs over the distinct values of all documents: no two values may share a surrogate, and
no surrogate may be a value that occurs. Losers get the next attempt, a draw, until none is left; only
they, a handful among millions, have to be handed to the tasks that rewrite the texts. In a
format of which more than a quarter of all possible values occurs (seven-digit phones in a web
corpus) the second rule cannot be kept for long: such formats keep the permutation, and a
surrogate there may be a value that occurs, never one that another value got.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.llm.components import stored

# Titles by the gender they tell, and given-name syllables to build surrogates from.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr"),
    "n": ("Dr", "Prof"),
}
_ONSET = ("b", "br", "d", "dr", "f", "g", "gl", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "tr", "v", "w", "z")
_VOWEL = ("a", "e", "i", "o", "u")
_END = {"f": ("a", "ia", "ella", "ina"), "m": ("o", "us", "ard", "ek"), "n": ("is", "en", "al", "or"), "s": ("son", "berg", "ley", "ner")}
# Scripts whose letters are replaced within the script; other letters stay letters of a-z.
_RANGES = (("а", "я"), ("α", "ω"), ("ぁ", "ん"), ("一", "龥"))
MAX_ROUNDS = 32
# Values that lost a collision are handed to all tasks up to this number, else joined.
MAX_SENT = 100_000

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
# In the order in which they are tried.
_PARTS = {
    "email": r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+)",
    "secret": r"(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b)\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[^\s\"',;]{6,}))",
    "key": r"(?P<key>\b(?:(?:AKIA|ASIA)[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{30,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})\b)",
    "ip6": r"(?=[0-9A-Fa-f:])(?P<ip6>(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){6}(?=\d{1,3}\.)\d{1,3}"
    r"|(?=(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![\w:]))[0-9A-Fa-f:]*::[0-9A-Fa-f:]*)(?:(?:\.\d{1,3}){3})?(?![\w:]))",
    "number": r"(?=[0-9+(A-Z])(?:(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<![\d-])3[47]\d\d(?P<gap>[ -])\d{6}(?P=gap)\d{5}(?!\d)|(?<![\d.-])\d{13,19}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3,4}[ .-]\d{4}|(?<=\d[ .-])\d{6,12})(?!\d)"
    # After "+" or a trunk 0 (and no date) the number of digits decides, however they are grouped.
    r"|(?<!\w)\+\d(?:[ ./()-]{0,2}\d){7,14}(?!\d)|(?<![\w+.,:/-])(?!\d\d?[./-]\d\d?[./-]\d{4}(?!\d))0\d(?:[ ./()-]{0,2}\d){7,13}(?!\d)"
    r"|(?<![\w.,+-])[2-9]\d{9}(?!\w|[.,-]\d)|\+\d{8,14}(?!\d)|(?<![\w.-])\d{3}-\d{4}(?![\d-])))",
    "name": rf"(?P<title>\b(?:{_TITLE})\b)\.? (?P<name>[^\W\d_a-z][\w'-]+(?: [^\W\d_a-z][\w'-]+)?)",
}
_KINDS = ("email", "key", "ip6", "ip", "iban", "ssn", "card", "phone")
_SECRETS = ("password", "passwd", "pwd", "secret", "token", "api")
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "rk_live_", "eyJ")
_DIGIT = re.compile("[0-9]")


@lru_cache
def _pattern(parts: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(_PARTS[p] for p in parts))


def _parts(text: str) -> tuple[str, ...]:
    """The parts of the pattern that the text can match at all, told by plain searches."""
    low = text.lower()
    digit = _DIGIT.search(text) is not None
    held = {
        "email": "@" in text,
        "secret": any(w in low for w in _SECRETS),
        "key": any(k in text for k in _KEY_STARTS),
        "ip6": digit and ("::" in text or text.count(":") >= 6),
        "number": digit,
        "name": any(t in text for t in _GENDER),
    }
    return tuple(p for p in _PARTS if held[p])


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical form)`` of each entity, in order, never overlapping."""
    parts = _parts(text)
    found = []
    for m in _pattern(parts).finditer(text) if parts else ():
        held = m.groupdict()
        if held.get("name"):
            gender, at = _GENDER[m["title"]], m.start("name")
            names = m["name"].split(" ")
            for i, part in enumerate(names):
                found.append((at, at + len(part), f"name_{'s' if i == len(names) - 1 else gender}", part.casefold()))
                at += len(part) + 1
        elif held.get("secret"):
            found.append((*m.span("value"), "secret", m["value"]))
        else:
            kind = next(k for k in _KINDS if held.get(k))
            value = held[kind]
            canon = _exploded(value) if kind == "ip6" else value.lower() if kind == "email" else value if kind in ("ip", "key") else re.sub(r"[\W_]", "", value)
            found.append((*m.span(kind), kind, canon))
    return found


def _exploded(value: str) -> str:
    try:
        return ipaddress.IPv6Address(value).exploded
    except ValueError:
        return value.lower()


class Draw:
    """A stream of numbers from the key and a value."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.seed, self.block, self.left = key, "\x1f".join(map(str, of)).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.left < n << 64:
            piece = hashlib.blake2b(self.seed + b"\x1f%d" % self.block, key=self.key, digest_size=64).digest()
            self.block, self.left, self.value = self.block + 1, 1 << 512, int.from_bytes(piece, "big")
        self.value, out = divmod(self.value, n)
        self.left //= n
        return out

    def pick(self, of):
        return of[self.below(len(of))]


def _letter(c: str, draw: Draw) -> str:
    if c.isascii() or not c.isalpha():
        out = chr(97 + draw.below(26))
    else:
        low = unicodedata.normalize("NFD", c.lower())[0]
        span = next(((ord(a), ord(b)) for a, b in _RANGES if a <= low <= b), (97, 122))
        out = chr(span[0] + draw.below(span[1] - span[0] + 1))
    return out.upper() if c.isupper() else out


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


FEISTEL_ROUNDS = 8
# A format is crowded when more than this share of its values occurs.
CROWDED = 0.25
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _classes(kind: str, canon: str) -> list[tuple[int, int]]:
    """For each character the first code point and the size of the class it stays in; size 1 keeps it."""
    keep = {"iban": 4, "card": 1}.get(kind, 0)
    tail = 0
    if kind == "key":
        keep = next((len(k) for k in _KEY_STARTS if canon.startswith(k)), 0)
    if kind == "phone" and len(canon) > 10:
        keep = len(canon) - 10  # the country code
    if kind == "phone" and canon[0] == "0":
        keep = max(keep, 1)  # the trunk prefix
    if kind == "email":
        tail = len(canon) - canon.rindex(".")
    if kind == "card":
        tail = 1  # the check digit follows from the others
    out = []
    for i, c in enumerate(canon):
        if i < keep or i >= len(canon) - tail:
            out.append((ord(c), 1))
        elif kind == "phone" and len(canon) == 10 and i == 0:
            out.append((ord("2"), 8) if c in "23456789" else (ord(c), 1))
        elif kind == "phone" and i == 0 and c in _DIGITS:
            out.append((ord("1"), 9))
        elif c in _DIGITS:
            out.append((48, 10))
        elif c.isascii() and c.isalpha():
            out.append((65 if c.isupper() else 97, 26))
        elif c.isalpha() and len(c.lower()) == len(c.upper()) == 1:
            span = next(((ord(x), ord(y)) for x, y in _RANGES if x <= c <= y), None)
            out.append((span[0], span[1] - span[0] + 1) if span else (ord(c), 1))
        else:
            out.append((ord(c), 1))
    return out


def _space_of(kind: str, canon: str) -> tuple[str, float]:
    """The format of a value, and how many values have it. Names share one space that grows with attempts."""
    if kind.startswith("name_"):
        return "name", float("inf")
    if kind == "ip6":
        return "ip6", 2.0**128
    if kind == "ip":
        known = [254 if 1 <= int(o) <= 254 else 1 for o in canon.split(".")]
        return "ip:" + ".".join("x" if n > 1 else o for n, o in zip(known, canon.split("."))), float(np.prod(known))
    held = _classes(kind, canon)
    room = 1.0
    for _, size in held:
        room = min(room * size, 1e300)
    extra = ""
    if kind == "card":
        extra = str((int(canon[-1]) - int(_check_digit(canon[:-1]))) % 10)
    if kind == "iban":
        extra = str((int(canon[2:4]) - _iban_check(canon)) % 100)
    return kind + ":" + extra + ":" + "".join(f"{chr(at)}{size}" for at, size in held), room


def permuted(key: bytes, tweak: str, digits: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of all digit strings of these sizes: two halves, each moved by a function of the other."""
    free = [i for i, n in enumerate(sizes) if n > 1]
    if not free:
        return digits
    halves = [free[: (len(free) + 1) // 2], free[(len(free) + 1) // 2 :]]
    value, room = [], []
    for half in halves:
        v, n = 0, 1
        for i in half:
            v, n = v * sizes[i] + digits[i], n * sizes[i]
        value.append(v)
        room.append(n)
    for turn in range(FEISTEL_ROUNDS):
        here, other = turn % 2, 1 - turn % 2
        said = f"{tweak}\x1f{turn}\x1f{value[other]}".encode()
        drawn = int.from_bytes(b"".join(hashlib.blake2b(said + b"\x1f%d" % i, key=key, digest_size=64).digest() for i in range(room[here].bit_length() // 384 + 1)), "big")
        value[here] = (value[here] + drawn) % room[here]
    out = list(digits)
    for half, v in zip(halves, value):
        for i in reversed(half):
            v, out[i] = divmod(v, sizes[i])
    return out


def _check_digit(body: str) -> str:
    return next(last for last in _DIGITS if _luhn(body + last))


def _iban_check(canon: str) -> int:
    """The check digits that an IBAN's country and body ask for."""
    moved = canon[4:] + canon[:2] + "00"
    return 98 - int("".join(str(int(c, 36)) for c in moved.upper())) % 97


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The replacement of a canonical form, itself in canonical form."""
    if attempt == 0 and not kind.startswith("name_"):
        return _permutation(key, kind, canon)
    draw = Draw(key, kind, canon, attempt)
    if kind.startswith("name_"):
        if any(a <= c <= b for c in canon for a, b in _RANGES):
            return "".join(_letter(c, draw) for c in canon)
        body = "".join(draw.pick(_ONSET) + draw.pick(_VOWEL) for _ in range(2 + attempt // 4))
        return body + draw.pick(("l", "n", "r", "t")) + draw.pick(_END[kind[-1]])
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ip6":
        return ":".join(f"{draw.below(1 << 16):04x}" for _ in range(8))
    out = "".join(chr(at + draw.below(size)) for at, size in _classes(kind, canon))
    if kind == "email":
        return "".join(chr(97 + draw.below(26)) for _ in range(attempt // 4)) + out
    return _checked(kind, canon, out)


def _permutation(key: bytes, kind: str, canon: str) -> str:
    tweak = f"{kind}\x1f{_space_of(kind, canon)[0]}"
    if kind == "ip":
        octets = [int(o) for o in canon.split(".")]
        sizes = [254 if 1 <= o <= 254 else 1 for o in octets]
        moved = permuted(key, tweak, [o - 1 if n > 1 else o for o, n in zip(octets, sizes)], sizes)
        return ".".join(str(o + 1 if n > 1 else o) for o, n in zip(moved, sizes))
    if kind == "ip6":
        parts = [int(p, 16) for p in canon.split(":")] if canon.count(":") == 7 and "." not in canon else None
        if parts is None:
            return ":".join(f"{Draw(key, kind, canon).below(1 << 16):04x}" for _ in range(8))
        return ":".join(f"{p:04x}" for p in permuted(key, tweak, parts, [1 << 16] * 8))
    held = _classes(kind, canon)
    sizes = [n for _, n in held]
    moved = permuted(key, tweak, [ord(c) - at for c, (at, _) in zip(canon, held)], sizes)
    return _checked(kind, canon, "".join(chr(at + d) for (at, _), d in zip(held, moved)))


def _checked(kind: str, canon: str, out: str) -> str:
    """Check digits as far from the right ones as they were in the original: right ones stay right."""
    if kind == "card":
        off = int(canon[-1]) - int(_check_digit(canon[:-1]))
        return out[:-1] + str((int(_check_digit(out[:-1])) + off) % 10)
    if kind == "iban":
        off = int(canon[2:4]) - _iban_check(canon)
        return f"{out[:2]}{(_iban_check(out) + off) % 100:02d}{out[4:]}"
    return out


def render(original: str, canon: str) -> str:
    """A canonical surrogate in the format of the original: its separators, and its case for names."""
    if original.isupper() and not canon[:1].isdecimal() and len(original) > 1:
        canon = canon.upper()
    elif original[:1].isupper() and original[1:].islower() and canon.islower():
        canon = canon[:1].upper() + canon[1:]
    plain = [c for c in original if c.isalnum()]
    if len(plain) == len(original) or len(plain) != len(canon) or any(not c.isalnum() for c in canon):
        return canon
    rest = iter(canon)
    return "".join(next(rest) if c.isalnum() else c for c in original)


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with every entity replaced, and the kinds replaced."""
    entities = find_entities(text)
    if not entities:
        return text, []
    out, at = [], 0
    for start, end, kind, canon in entities:
        out += [text[at:start], render(text[start:end], surrogate(key, kind, canon, attempts.get((kind, canon), 0)))]
        at = end
    return "".join([*out, text[at:]]), [e[2] for e in entities]


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, canon`` of all documents, each once; copies meet within a batch first."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(e[2], e[3]) for t in batch.column(0) if t.is_valid for e in find_entities(t.as_py())}
            kinds, canons = zip(*sorted(found)) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(canons, pa.string())], names=["kind", "canon"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(extract, "kind string, canon string").distinct()


def resolve_collisions(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, canon, attempt`` of the values whose attempt is not 0.

    Names of all kinds share one space, as a given name may be another's surname. Values of crowded
    formats stay at 0. What is left after ``MAX_ROUNDS`` goes back to 0 with its whole format,
    whose surrogates then differ as a permutation's do.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b["kind"].to_pylist(), b["canon"].to_pylist(), b["attempt"].to_pylist()))
            formats = [_space_of(k, c) for k, c, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [b["kind"], b["canon"], b["attempt"], pa.array([surrogate(key, *r) for r in rows], pa.string()),
                 pa.array([f for f, _ in formats], pa.string()), pa.array([n for _, n in formats], pa.float64())],
                names=["kind", "canon", "attempt", "s", "format", "room"],
            )

    schema = "kind string, canon string, attempt int, s string, format string, room double"
    space = F.when(F.col("kind").startswith("name_"), "name").otherwise(F.col("kind"))
    values = stored(entities.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema).withColumn("space", space), "surrogates")
    crowded = values.groupBy("format").agg(F.count("*").alias("n"), F.first("room").alias("room")).filter(F.col("n") > CROWDED * F.col("room"))
    crowded = stored(crowded.select("format"), "crowded")
    real = values.select(F.col("space").alias("_space"), F.col("canon").alias("_canon")).distinct()
    for _ in range(MAX_ROUNDS):
        first = values.groupBy("space", "s").agg(F.min(F.struct("attempt", "kind", "canon")).alias("w"), F.count("*").alias("n"))
        shared = first.filter("n > 1").select(F.col("space").alias("_sp"), F.col("s").alias("_s"), "w")
        losers = values.join(shared, (F.col("space") == F.col("_sp")) & (F.col("s") == F.col("_s"))).filter(
            (F.col("kind") != F.col("w.kind")) | (F.col("canon") != F.col("w.canon"))
        ).select("kind", "canon")
        clashing = values.join(real, (F.col("space") == F.col("_space")) & (F.col("s") == F.col("_canon")), "left_semi").join(crowded, "format", "left_anti")
        again = stored(losers.union(clashing.select("kind", "canon")).distinct(), "losers")
        if again.isEmpty():
            break
        moved = values.join(again, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        moved = moved.mapInArrow(draw, schema).withColumn("space", space)
        values = stored(values.join(again, ["kind", "canon"], "left_anti").unionByName(moved), "surrogates")
    else:
        stuck = values.join(again, ["kind", "canon"], "left_semi").filter("space <> 'name'").select("format").distinct()
        values = values.join(stuck, "format", "left_anti")
    return values.filter("attempt > 0").select("kind", "canon", "attempt")


def replace_pii(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with entities in ``text`` replaced, and ``_kinds`` added.

    ``_kinds`` lists the kind of each entity in order. A null text stays null with no entity;
    empty texts, repeated rows and any other columns pass through. Documents are not shuffled
    unless more than ``MAX_SENT`` values lost a collision.
    """
    lost = stored(resolve_collisions(distinct_entities(docs, text), key), "lost")
    names = docs.columns
    at = [c.lower() for c in names].index(text.lower())
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    few = lost.limit(MAX_SENT + 1).count() <= MAX_SENT
    if few:
        sent = {(r.kind, r.canon): r.attempt for r in lost.collect()}
        rows = plain.withColumn("_lost", F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int>>"))
    else:
        sent = {}
        rows = _with_lost(plain, f"_c{at}", lost)
    shared = docs.sparkSession.sparkContext.broadcast(sent)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts = shared.value
        for batch in batches:
            out, kinds, column = [], [], batch.column(at)
            own = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                t = column[i].as_py()
                mine = own[i].as_py()
                a = {(r["kind"], r["canon"]): r["attempt"] for r in mine} if mine else attempts
                t, k = (None, []) if t is None else rewrite(t, key, a)
                out.append(t)
                kinds.append(k)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "_kinds"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", _kinds array<string>"
    return rows.mapInArrow(replace, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "_kinds")


def _with_lost(plain: DataFrame, text: str, lost: DataFrame) -> DataFrame:
    """``_lost``: the text's own values that lost a collision, found by a join on the values."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, e[2], e[3]) for h, t in zip(batch["_h"].to_pylist(), batch["t"].to_pylist()) for e in find_entities(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["_h", "kind", "canon"])

    hashed = plain.withColumn("_h", F.sha2(F.col(text), 256))
    mine = hashed.select("_h", F.col(text).alias("t")).mapInArrow(extract, "_h string, kind string, canon string").distinct()
    mine = mine.join(lost, ["kind", "canon"]).groupBy("_h").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_lost"))
    return hashed.join(mine, "_h", "left").drop("_h")
