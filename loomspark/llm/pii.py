"""Personal data replaced by surrogates of the same type, format, script and gender.

An entity is a kind and a canonical spelling, so that a phone number written in two ways, or a surname after two
titles, is one entity and has one surrogate throughout the corpus. A surrogate is drawn by a keyed hash of entity and
attempt, letter for letter and digit for digit; card and account numbers keep their issuer or country, and have
check digits that fit if those of the original do. Entities whose surrogates collide, with each other's or with an
entity of the corpus, draw again, all but one, until none do; what is drawn from grows with the attempts, so that
this ends for any number of entities. Nearly all keep the first draw, which any task can make by itself: only the
others are looked up.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import sliced, through_table

#: Entities that drew again, up to which they are broadcast; beyond, they are joined to the documents that have them.
BROADCAST = 200_000
#: The key where the session's configuration sets none under ``KEY_SETTING``. Who knows the key can tell whose a surrogate
#: is, so that an installation sets its own.
DEFAULT_KEY = b"an installation sets its own key"
KEY_SETTING = "spark.loomspark.pii.key"

#: Titles before a name, by gender.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "Signora", "Lady", "Dame", "Госпожа"],
    "m": ["Mr", "Mister", "Herr", "Señor", "Monsieur", "Signor", "Sir", "Lord", "Господин"],
    "n": ["Prof", "Professor", "Dr", "Doctor", "Mx"],
}
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alba Anna Berta Carla Clara Daria Elena Emma Erika Flora Greta Hanna Irene Julia Karin Laura Lena Livia Maria Marta Mina Nadia Nora Olga Paula Petra Rita Rosa Sara Sofia Tina Vera".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carl David Emil Erik Felix Franz Georg Hugo Ivan Jakob Jonas Karl Leo Lukas Marco Martin Max Nils Oskar Otto Paul Peter Ralf Robert Simon Theo Victor Walter".split(),
    ("latin", "n"): "Alex Andrea Billie Charlie Dana Eden Jamie Jordan Jules Kim Luca Morgan Noa Quinn Robin Sam Sascha Taylor Toni Wil".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Инна Лидия Мария Нина Ольга Раиса Софья Татьяна".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Максим Олег Павел Роман".split(),
    ("cyrillic", "n"): "Женя Саша Валя Никита Шура Слава".split(),
}
#: Syllables of surnames by script.
SYLLABLES = {
    "latin": "bal ber bor dal den dor fal fen gar gel hal hen hol kar kel kor lan len lor mar mel mor nar nel nor pal per por ral ren ros sal sel sor tal tel tor val ver vol wal wen wor zan zel zor".split(),
    "cyrillic": "бал бер вал вер гор дал ден зор кал кор лан лен мар мел нор пал пер рал рен сал сер тал тор фал хол чер".split(),
}
#: Capitalised words that follow a title or stand within a heading and are no names.
NO_NAMES = set(
    "a an and are as at but by for from has have he her his how i if in is it its me my no not of on or our she so than that the their them then there they this to was we were what when where which who why will with you your "
    "academy america avenue award bridge bug cathedral chairman chancellor church club college committee company council court cup day director editor engineer general god governor hall high home hospital hotel house island judge justice "
    "king lady library lord luck madam manager market mayor minister museum officer palace park place president président presidente präsident президент prince princess prize queen rings river road school secretary sir speaker square station street teacher theatre tower university universe world "
    "das dem den der des die ein eine für im in ist mit und vom von zu zum zur le la les du des un une et est pour dans de del el los las y en por para con il lo gli e di da и в на не что он она это как но".split()
)
#: How given names end that are made of syllables, by script and gender.
ENDING = {("latin", "f"): "a", ("latin", "m"): "o", ("latin", "n"): "i", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ор", ("cyrillic", "n"): "и"}
NAME = r"[A-ZÀ-ÞĀ-ŽА-ЯЁ][\w'’-]*"
#: A phone number ends before an address, a card, a social security number or another phone number.
NO_OTHER = r"(?!(?:\d{1,3}\.){3}\d|\d{4}([ -])\d{4}\2\d{4}\2\d{4}|\d{3}-\d{2}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})"
PATTERNS: list[tuple[str, Callable[[str], bool], re.Pattern]] = [
    ("secret", lambda t: "assw" in t or "ASSW" in t, re.compile(r"(?i)\b(?:password|passwd|passwort)\s*[=:]\s*[\"']?(?P<v>[^\s\"']{5,}\w)")),
    ("token", lambda t: "=" in t or ":" in t, re.compile(r"(?i)\b(?:token|secret|api[_-]?key)\b\s*[=:]\s*[\"']?(?P<v>[\w+/-]{16,})")),
    ("access", lambda t: "AKIA" in t, re.compile(r"\b(?P<v>AKIA[0-9A-Z]{16})\b")),
    ("email", lambda t: "@" in t, re.compile(r"(?P<v>[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})")),
    ("iban", lambda t: True, re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?)\b")),
    ("phone", lambda t: "+" in t, re.compile(rf"(?P<v>\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:[ .-]?{NO_OTHER}\d{{2,4}}){{2,4}})(?!\d)")),
    ("phone", lambda t: True, re.compile(r"(?<![\w+.-])(?P<v>(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])")),
    ("card", lambda t: True, re.compile(r"(?<![\w.-])(?P<v>\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3[47]\d{2}([ -]?)\d{6}\3\d{5}|3(?:0[0-5]|[689]\d)\d([ -])\d{6}\4\d{4})(?![\w-])")),
    ("ssn", lambda t: "-" in t, re.compile(r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("ip", lambda t: "." in t, re.compile(r"(?<![\w.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)")),
    ("ipv6", lambda t: t.count(":") > 1, re.compile(r"(?i)(?<![\w:.])(?P<v>(?:[\da-f]{1,4}:){7}[\da-f]{1,4}|(?:[\da-f]{1,4}(?::[\da-f]{1,4}){0,5})?::[\da-f]{1,4}(?::[\da-f]{1,4}){0,5}|[\da-f]{1,4}(?::[\da-f]{1,4}){0,6}::)(?![\w:]|\.\d)")),
]
NEED_DIGITS = {"iban", "phone", "card", "ssn", "ip"}
TWO_DIGITS = re.compile(r"\d")
TITLE = rf"(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\b"
TITLED = re.compile(rf"\b(?P<t>{TITLE}(?:\.? {TITLE})*)\.? (?P<v>{NAME}(?: {NAME}){{0,2}})")
WORD = re.compile(r"(?<![\w-])[\w-]+(?:['’][\w-]+)*")
POSSESSIVE = re.compile(r"['’]s$")
TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


class Found:
    """Entities found so far, in order and apart from each other."""

    def __init__(self):
        self.entities: list[tuple[int, int, str, str]] = []

    def add(self, new: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
        """Add those that overlap none found before; returns them. new: in order, and apart from each other."""
        starts, ends = [x for x, *_ in self.entities], [x for _, x, *_ in self.entities]
        fresh = [e for e in new if (k := bisect.bisect_right(ends, e[0])) == len(starts) or starts[k] >= e[1]]
        if fresh:
            self.entities = sorted(self.entities + fresh)  # two sorted runs: merged in one pass
        return fresh


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical spelling) of each entity, in order; where two overlap, that of the earlier pattern."""
    found = Found()
    digits = TWO_DIGITS.search(text) is not None
    for kind, likely, pattern in PATTERNS:
        if (kind in NEED_DIGITS and not digits) or not likely(text):
            continue
        found.add([(*m.span("v"), kind, canonical(kind, m["v"])) for m in pattern.finditer(text) if IS.get(kind, has_sign)(m["v"])])
    if any(t in text for t in TITLE_GENDER):
        titled, names = [], {}  # of the document, with their kinds
        for m in TITLED.finditer(text):
            at, words = m.start("v"), m["v"].split(" ")
            gender = next((g for t in re.findall(r"\w+", m["t"]) if (g := TITLE_GENDER[t]) != "n"), "n")
            words = words[: next((k for k, w in enumerate(words) if POSSESSIVE.sub("", w).lower() in NO_NAMES), len(words))]
            for k, whole in enumerate(words):
                word = POSSESSIVE.sub("", whole)
                kind = f"surname:{script_of(word)}" if k == len(words) - 1 else f"given:{script_of(word)}:{gender}"
                titled.append((at, at + len(word), kind, word.lower()))
                at += len(whole) + 1
        for a, b, kind, _ in found.add(titled):
            if b - a > 1:
                names.setdefault(text[a:b], kind)
                names.setdefault(text[a:b].upper(), kind)
        names = without_common(names, text)
        found.add([(a, b, names[text[a:b]], text[a:b].lower()) for a, b in mentions_of(names, text)] if names else [])
    return found.entities


def without_common(names: dict[str, str], text: str) -> dict[str, str]:
    """Names but those whose word the text has more often in lower case: there it is a common word, which only a title
    makes a name."""
    lower, spelt = Counter(), Counter()
    known = {n.lower() for n in names} if names else set()
    for m in WORD.finditer(text) if names else ():
        word = POSSESSIVE.sub("", m[0])
        if (key := word.lower()) in known:
            (lower if word == key else spelt)[key] += 1
    return {n: kind for n, kind in names.items() if lower[n.lower()] <= spelt[n.lower()]}


def mentions_of(names: dict[str, str], text: str) -> Iterator[tuple[int, int]]:
    """Where the names stand as words of their own; of those that begin in one place, the longest."""
    for m in WORD.finditer(text):
        parts = [0, *(k for k, c in enumerate(m[0]) if c in "'’"), len(m[0])]
        begin = 0
        while begin < len(parts) - 1:
            a = parts[begin] + (begin > 0)
            end = next((e for e in range(len(parts) - 1, begin, -1) if m[0][a : parts[e]] in names), 0)
            if end:
                yield m.start() + a, m.start() + parts[end]
            begin = end or begin + 1


def has_sign(value: str) -> bool:
    """Whether there is a letter or digit to replace: lines to be filled in have none."""
    return any(c.isalnum() for c in value)


def is_card(value: str) -> bool:
    """Whether it is of a card issuer and its check digit fits; one in ten other numbers of 16 digits is, too."""
    digits = canonical("card", value)
    return digits[0] in "23456" and card_sum(digits) % 10 == 0


def is_ipv6(value: str) -> bool:
    """Whether it is an address with a number; words of code that look like one, as add::face, are none."""
    try:
        return any(c.isdigit() for c in value) and int(ipaddress.IPv6Address(value)) > 0
    except ValueError:
        return False


IS = {"card": is_card, "ipv6": is_ipv6}


def canonical(kind: str, value: str) -> str:
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    return value.lower() if kind in ("email", "token") else value


def card_sum(digits: str) -> int:
    """The checksum of a card number: 0 modulo 10 if its last digit fits the others."""
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))


def iban_remainder(value: str) -> int:
    """1 if the check digits of an account number fit the others."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


class Draw:
    """Numbers drawn one after the other for an entity, by a keyed hash."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.pool, self.n = hashlib.blake2b(key).digest(), f"{kind}\0{value}\0{attempt}".encode(), 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < 1 << 32:
            self.pool = int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key).digest(), "big")
            self.n, self.left = self.n + 1, 1 << 512
        self.pool, x = divmod(self.pool, n)
        self.left //= n
        return x

    def like(self, text: str, digits: str = "0123456789") -> str:
        """Letters for letters of the same script and case, digits for digits, other signs as they are."""
        out = []
        for c in text:
            pool = digits if c.isdigit() else letters_like(c) if c.isalpha() else c
            out.append(pool[self.below(len(pool))])
        return "".join(out)


@cache
def letters_like(c: str) -> str:
    """The letters from which one for ``c`` is drawn: plain ones for Latin and Cyrillic, else those of the same script
    and case among the 128 code points around it."""
    plain = "абвгдежзиклмнопрстуфхцчшэюя" if "Ѐ" <= c <= "ӿ" else "abcdefghijklmnopqrstuvwxyz" if "LATIN" in unicodedata.name(c, "LATIN") else ""
    if plain:
        return plain.upper() if c.isupper() else plain
    script, begin = unicodedata.name(c).split(" ")[0], ord(c) & ~127
    near = map(chr, range(begin, begin + 128))
    return "".join(x for x in near if x.isalpha() and unicodedata.category(x) == unicodedata.category(c) and unicodedata.name(x, " ").split(" ")[0] == script)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical surrogate of an entity at an attempt. From attempt 8 on surrogates get longer, names from attempt
    2, so that there are always enough."""
    draw = Draw(key, kind, value, attempt)
    more = max(0, attempt - 7)
    digits = "".join(str(draw.below(10)) for _ in range(more))
    letters = "".join(letters_like("a")[draw.below(26)] for _ in range(more))
    if kind == "email":
        box, _, domain = value.rpartition("@")
        labels = domain.split(".")
        host = ".".join([Draw(key, "domain", domain, 0).like(".".join(labels[:-1])), labels[-1]])
        return f"{draw.like(box)}{letters}@{host}"
    if kind == "ip":  # four numbers do for four thousand million addresses; then those of the newer kind
        return ".".join(str(draw.below(254) + 1) for _ in range(4)) if not more else ":".join(f"{draw.below(0xFFFF) + 1:04x}" for _ in range(8))
    if kind == "ipv6":  # groups of zeros stay
        return ":".join(f"{draw.below(0xFFFF) + 1:04x}" if g != "0000" or more else g for g in value.split(":"))
    if kind == "phone":
        keep = max(0, len(value) - 10)  # of a country code
        return value[:keep] + draw.like(value[keep:]) + digits
    if kind == "card":
        keep = 2 if value[0] == "3" else 1  # of an issuer
        body = value[:keep] + draw.like(value[keep:-1]) + digits
        return body + str(-card_sum(body + "0") % 10)
    if kind == "iban":
        body = draw.like(value[4:]) + digits
        fits = iban_remainder(value) == 1
        return value[:2] + (f"{98 - iban_remainder(value[:2] + '00' + body):02d}" if fits else draw.like(value[2:4])) + body
    if kind == "access":
        return value[:4] + draw.like(value[4:]) + letters.upper()
    if kind in ("token", "secret") and re.fullmatch(r"[0-9a-fA-F]+", value):
        upper = value.upper() == value and value.lower() != value
        hexed = "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(value) + more))
        return hexed.upper() if upper else hexed
    if kind.startswith("given:"):
        _, script, gender = kind.split(":")
        names, ends = GIVEN[script, gender], SYLLABLES[script]
        name = names[draw.below(len(names))].lower()
        return name if attempt < 2 else "".join(ends[draw.below(len(ends))] for _ in range(attempt)) + ENDING[script, gender]
    if kind.startswith("surname:"):
        parts = SYLLABLES[kind.split(":")[1]]
        return "".join(parts[draw.below(len(parts))] for _ in range(3 + max(0, attempt - 3)))
    return draw.like(value) + digits


def rendered(kind: str, original: str, spelt: str) -> str:
    """The surrogate in the format of a mention: its separators, its case."""
    if kind in ("card", "ssn", "phone", "iban"):
        signs = iter(spelt)
        return "".join([next(signs) if c.isalnum() else c for c in original] + [*signs])
    if kind == "ipv6":
        if "::" in original:
            spelt = ipaddress.IPv6Address(spelt).compressed
        elif min(map(len, original.split(":"))) < 4:
            spelt = ":".join(f"{int(g, 16):x}" for g in spelt.split(":"))
        return spelt.upper() if original.upper() == original and original.lower() != original else spelt
    if kind == "email" or kind == "token" or kind.startswith(("given:", "surname:")):
        if original.isupper() and any(c.isalpha() for c in original):
            return spelt.upper()
        if kind.startswith(("given:", "surname:")):
            return "-".join(x.capitalize() for x in spelt.split("-"))
    return spelt


def replaced(text: str, key: bytes, again: Callable[[str, str], str | None]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of what was replaced; again: the surrogates of entities that redrew."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for a, b, kind, value in found:
        out += [text[at:a], rendered(kind, text[a:b], again(kind, value) or surrogate(key, kind, value, 0))]
        at = b
    return "".join([*out, text[at:]]), [kind for *_, kind, _ in found]


ENTITY = pa.schema([("kind", pa.string()), ("value", pa.string())])
DRAWN = pa.schema([("kind", pa.string()), ("value", pa.string()), ("attempt", pa.int32()), ("surrogate", pa.string())])


def entity_table(docs: DataFrame) -> DataFrame:
    """kind, value: the distinct entities of the corpus."""

    def distinct(batches):
        for batch in sliced(batches):
            found = sorted({(kind, value) for t in batch.column(0).to_pylist() if t for *_, kind, value in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], schema=ENTITY)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(distinct, "kind string, value string").distinct()


def drawn(table: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt, surrogate of each row of kind, value, attempt."""

    def draw(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], schema=DRAWN)

    return table.select("kind", "value", F.col("attempt").cast("int")).mapInArrow(draw, "kind string, value string, attempt int, surrogate string")


def surrogate_table(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt, surrogate of each entity: no two of a kind share a surrogate, and none is an entity.

    In each round the least of those that drew a surrogate keeps it, unless it is an entity or was kept before; the
    others draw again. Rounds after the first are over the losers alone, and go on until there are none.
    """
    known = through_table(entity_table(docs), "entities")
    real = known.select("kind", F.col("value").alias("surrogate"))
    kept, losing, attempt = None, known, 0
    while True:
        table = through_table(drawn(losing.withColumn("attempt", F.lit(attempt)), key), "surrogates")
        taken = real if kept is None else real.union(kept.select("kind", "surrogate"))
        free = table.groupBy("kind", "surrogate").agg(F.min("value").alias("keeper")).join(taken, ["kind", "surrogate"], "left_anti")
        marked = table.join(free, ["kind", "surrogate"], "left").withColumn("keeps", F.coalesce(F.col("keeper") == F.col("value"), F.lit(False)))
        marked = through_table(marked.select("kind", "value", "attempt", "surrogate", "keeps"), "drawn")
        own = marked.filter("keeps").drop("keeps")
        kept = own if kept is None else kept.union(own)
        losing, attempt = marked.filter("not keeps").select("kind", "value"), attempt + 1
        if losing.isEmpty():
            return kept


def session_key(spark: SparkSession) -> bytes:
    return setting.encode() if (setting := spark.conf.get(KEY_SETTING, None)) else DEFAULT_KEY


def pseudonymised(docs: DataFrame, key: bytes | None = None, broadcast: int = BROADCAST, counts: str | None = None) -> DataFrame:
    """``docs`` with the entities in column text replaced; other columns, and rows without entities, are unchanged.

    key: of the keyed draws; without one, what the session's ``KEY_SETTING`` says.

    counts: a further column of this name has the number of entities replaced; a column of ``docs`` of the same name
    gives way to it. Null text stays null, with none; empty text stays empty, and very long text is read whole. Repeated
    rows are replaced alike, each in its place; an empty table gives no rows.
    """
    spark, docs = docs.sparkSession, docs.drop(counts) if counts else docs
    key = key or session_key(spark)
    again = surrogate_table(docs, key).filter("attempt > 0").select("kind", "value", "surrogate")
    own_names, at = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *([T.StructField(counts, T.IntegerType())] if counts else [])])

    def changed(batch: pa.RecordBatch, lookups: Iterator[dict]) -> pa.RecordBatch:
        texts, n = [], []
        for text, lookup in zip(batch.column(at).to_pylist(), lookups):
            new, kinds = replaced(text, key, lambda kind, value, lookup=lookup: lookup.get((kind, value))) if text else (text, [])
            texts.append(new)
            n.append(len(kinds))
        columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns[: len(own_names)])]
        names = [*own_names, *([counts] if counts else [])]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(n, pa.int32())] if counts else [])], names)

    rows = again.limit(broadcast + 1).count()
    if rows <= broadcast:
        shared = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["surrogate"] for r in again.collect()})

        def replace(batches):
            for batch in sliced(batches):
                yield changed(batch, iter([shared.value] * batch.num_rows))

        return docs.mapInArrow(replace, schema)

    def mentions(batches):
        for batch in sliced(batches):
            rows = sorted({(d, *e[2:]) for d, t in zip(*(c.to_pylist() for c in batch.columns)) if t for e in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))], ["digest", "kind", "value"])

    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    of = docs.select(digest.alias("digest"), F.col("text").cast("string").alias("text")).mapInArrow(mentions, "digest binary, kind string, value string").distinct()
    own = of.join(again, ["kind", "value"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("redrawn"))
    whole = docs.select(F.struct("*").alias("row"), digest.alias("digest")).join(own, "digest", "left").select("row.*", F.col("redrawn"))

    def replace_with(batches):
        for batch in sliced(batches):
            lookups = ({(x["kind"], x["value"]): x["surrogate"] for x in r or ()} for r in batch.column(len(own_names)).to_pylist())
            yield changed(batch, lookups)

    return whole.mapInArrow(replace_with, schema)
