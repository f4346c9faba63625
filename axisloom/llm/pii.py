"""Personal data and secrets become keyed surrogates of the same type, format, script and gender.

One pattern finds every entity; the text is split there and put together again with surrogates between. All of it is
built-in expressions; only rows in which the pattern matches do more than one search.

Structured entities (mail addresses, phone, card, bank account and social numbers, IPv4 and IPv6 addresses, secrets and
tokens) go through a keyed permutation that keeps the class of each character in place: equal entities get equal surrogates in the whole
corpus (letter case and separators don't matter to mail addresses and numbers), and different ones stay different
because a permutation can't collide. The permutation is a Feistel cipher there, one turn of one character, and the same cipher
back: such a one has no fixed points, so a surrogate is never its original. Numbers of 13 to 19 digits are cards if their Luhn
digit is right, and stay so; account numbers keep their country and whether their check digits are right, addresses their octet range, mail addresses
their top-level domain, phones their country code.

Names are found after a title, or where they begin with a known given name; within that text their parts are names
wherever else they stand alone. Each part of a name has one surrogate in the whole corpus, whatever stands before it. Known given names are rotated
within their list, so gender and script stay (no collisions); other parts become syllables of their script from a keyed hash. Before that is used,
`syllables` looks at all different name parts of the corpus and takes the smallest count of syllables for which no two
parts share a surrogate and no surrogate is another's original or a known given name.

Null texts stay null, empty ones empty; texts without entities stay as they are. Repeated rows and ties get equal
surrogates. Columns besides the text pass untouched (n_chars, where there is one, follows the text).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved

#: The key of tests and examples; a deployment passes its own.
KEY = "axisloom"
ROUNDS = 6

# Alphabets, within which a character is replaced.
DIGITS = "0123456789"
HEX = "0123456789abcdef"
LATIN = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"

# Titles and given names by gender and script, and syllables by script.
TITLES = {"m": "Mr Sir Herr Monsieur Señor Don Signor Г-н".split(), "f": "Mrs Ms Miss Madam Frau Madame Señora Doña Signora Г-жа".split(), "n": "Dr Prof Professor Mx".split()}
GIVEN = {
    ("m", "latin"): "James John Robert Michael David William Thomas Daniel Peter Paul Hans Karl Jürgen Pierre Jean Luc Carlos José Miguel Antonio".split(),
    ("f", "latin"): "Mary Anna Maria Elizabeth Susan Sarah Laura Emily Julia Claire Marie Sophie Ingrid Heike Carmen Lucía Elena Isabel Teresa Rosa".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge ko ka la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se so ta te ti to va vi wa zo".split(),
    "cyrillic": "ба бе во ва га го да до же за ка ко ла ле ма мо на но па по ра ро са со та то".split(),
    "greek": "βα γο δα κα κο λα λο μα νο πα ρα σα τα το".split(),
}

_NOT_IN = r"(?<![\p{L}\p{N}._%+\-])"
_CAPITAL = r"\p{Lu}(?:\p{Ll}+|['’]\p{Lu}\p{Ll}+)(?:['’\-]\p{Lu}\p{Ll}+)*"
_EMAIL = _NOT_IN + r"[\p{L}\p{N}._%+\-]{1,64}+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
_SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
_PHONE = r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
_SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ADDRESS = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)"
_CARD = r"(?<!\d)\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\d)"
_ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_TOKEN = r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,1000}\.[A-Za-z0-9_\-]{8,4000}\.[A-Za-z0-9_\-]{8,1000}"
_GROUP = "[0-9A-Fa-f]{1,4}"
_SIX = rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,5}})(?![0-9A-Za-z:])"
_GIVEN = "|".join(x for names in GIVEN.values() for x in names)
_TITLE = "|".join(x for names in TITLES.values() for x in names)
_NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? {_CAPITAL}(?: {_CAPITAL})?|(?:{_GIVEN}) {_CAPITAL})"
#: Each group of alternatives stands behind a look at one character, so that most places cost a few comparisons.
PATTERN = rf"(?=[0-9a-fAgs]){_SECRET}|(?=e){_TOKEN}|{_EMAIL}|(?=[\d+(])(?:{_PHONE}|{_SOCIAL}|{_ADDRESS}|{_CARD})|(?=[0-9A-Fa-f]){_SIX}|(?=[A-Z]){_ACCOUNT}|(?=\p{{Lu}}){_NAME}"
_NAMED = rf"(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})\.? \p{{Lu}}"
#: What every entity holds; a quick look that most texts end at. Of phones with a plus the first two characters, of cards
#: the first eight digits, of other numbers five characters without a blank, of all others how they begin.
_HINT = rf"@|\+\d|\d{{4}}[ \-]?\d{{4}}|\d[\d.\-()]{{4}}|(?<![0-9a-z])[0-9a-f]{{32}}|AKIA|sk-|gh[pousr]_|eyJ|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}} ?[A-Z0-9]{{4}}|{_NAMED}"


def _let(value: Column, of) -> Column:
    """of(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _number(key: str, *parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _shifted(c: Column, by: Column, alphabets: list[str]) -> Column:
    out = c
    for a in alphabets:
        at = F.position(c, F.lit(a))
        out = F.when((F.length(c) > 0) & (at > 0), F.substr(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))).cast("int") + 1, F.lit(1))).otherwise(out)
    return out


def _feistel(text: Column, alphabets: list[str], tag: str, key: str, back: bool = False) -> Column:
    """A keyed permutation of the strings with the same classes of characters in the same places, or its inverse."""
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text)).alias("b"))

    def moved(what: Column, by_what: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), F.length(what).cast("string"), by_what).cast("binary"), 512)
        by = lambda s, i: F.conv(F.substr(s, F.pmod(i, F.lit(42)) * 3 + 1, F.lit(3)), 16, 10).cast("int") * (-1 if back else 1)
        return _let(stream, lambda s: F.array_join(F.transform(F.split(what, ""), lambda c, i: _shifted(c, by(s, i), alphabets)), ""))

    def turn(x: Column, r: Column) -> Column:
        if back:
            return F.struct(moved(x["b"], x["a"], r).alias("a"), x["a"].alias("b"))
        return F.struct(x["b"].alias("a"), moved(x["a"], x["b"], r).alias("b"))

    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, rounds)), start, turn, lambda x: F.concat(x["a"], x["b"]))


def permuted(text: Column, alphabets: list[str], tag: str, key: str) -> Column:
    """A keyed permutation without fixed points (but strings without any character of the alphabets): there, one turn of the first such character, and back."""
    step = _number(key, F.lit(tag), F.lit("turn"))

    def turned(chars: Column) -> Column:
        first = F.array_position(F.transform(chars, lambda c: F.lit("".join(alphabets)).contains(c) & (F.length(c) > 0)), F.lit(True))
        by = lambda c: F.coalesce(*[F.when(F.lit(a).contains(c), step % (len(a) - 1) + 1) for a in alphabets])
        return F.array_join(F.transform(chars, lambda c, i: F.when(i + 1 == first, _shifted(c, by(c), alphabets)).otherwise(c)), "")

    there = _let(F.split(_feistel(text, alphabets, tag, key), ""), turned)
    return _let(there, lambda t: _feistel(t, alphabets, tag, key, True))


def _relaid(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced, in order, by `digits`."""
    nth = lambda i: F.length(F.regexp_replace(F.substr(form, F.lit(1), i + 1), r"\D", ""))
    return _let(digits, lambda d: F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike(r"^\d$"), F.substr(d, nth(i), F.lit(1))).otherwise(c)), ""))


def _luhn(body: Column) -> Column:
    """Luhn check digit of a string of digits."""
    n = F.length(body)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = F.aggregate(F.transform(F.split(body, ""), lambda c, i: F.when(F.length(c) == 0, F.lit(0)).when(F.pmod(n - i, F.lit(2)) == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)
    return F.pmod(-value, F.lit(10))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        off = F.substr(d, F.length(d), F.lit(1)).cast("int") - _luhn(body)
        return _let(permuted(body, [DIGITS], "card", key), lambda new: F.concat(new, F.pmod(_luhn(new) + off, F.lit(10)).cast("string")))

    return _relaid(m, _let(_digits(m), of))


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .\-(]))?", 0)
    tail = F.substr(m, F.length(head) + 1, F.length(m))
    return F.concat(head, _relaid(tail, permuted(_digits(tail), [DIGITS], "phone", key)))


def _address(m: Column, key: str) -> Column:
    """An IPv4 address as two halves of 16 bits: there, a turn of one half, and back."""
    o = F.split(m, r"\.")
    pair = lambda i: F.element_at(o, i).cast("long") * 256 + F.element_at(o, i + 1).cast("long")
    start = F.struct(pair(1).alias("a"), pair(3).alias("b"))
    by = lambda r, v: _number(key, F.lit("address"), r, v)
    turn = lambda x, r: F.struct(x["b"].alias("a"), F.pmod(x["a"] + by(r, x["b"]), F.lit(65536)).alias("b"))
    back = lambda x, r: F.struct(F.pmod(x["b"] - by(r, x["a"]), F.lit(65536)).alias("a"), x["a"].alias("b"))
    low = lambda v: F.pmod(v, F.lit(256)).cast("string")
    high = lambda v: F.floor(v / 256).cast("string")
    there = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda x: F.struct(F.pmod(x["a"] + by(F.lit("turn"), F.lit("")) % 65535 + 1, F.lit(65536)).alias("a"), x["b"].alias("b")))
    return _let(there, lambda t: F.aggregate(F.array(*map(F.lit, range(ROUNDS - 1, -1, -1))), t, back, lambda x: F.concat_ws(".", high(x["a"]), low(x["a"]), high(x["b"]), low(x["b"]))))


def _remainder(account: Column) -> Column:
    """What an account number (country, check digits, body) leaves modulo 97, with the first four characters put last and letters as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5), F.length(account)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.position(c, F.lit(DIGITS + LATIN.upper())) - 1
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: F.length(c) > 0), F.lit(0), lambda n, c: F.pmod(F.when(value(c) > 9, n * 100).otherwise(n * 10) + value(c), F.lit(97)).cast("int"))


def _account(m: Column, key: str) -> Column:
    """Country stays; the body is permuted; check digits move as far as the right ones do."""
    plain = F.regexp_replace(m, " ", "")
    right = lambda country, body: 98 - _remainder(F.concat(country, F.lit("00"), body))

    def of(p: Column) -> Column:
        country, body = F.substr(p, F.lit(1), F.lit(2)), F.substr(p, F.lit(5), F.length(p))
        check = F.substr(p, F.lit(3), F.lit(2)).cast("int")
        return _let(permuted(body, [DIGITS, LATIN.upper()], "account", key), lambda new: F.concat(country, F.lpad(F.pmod(check + right(country, new) - right(country, body), F.lit(100)).cast("string"), 2, "0"), new))

    nth = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), " ", ""))
    return _let(_let(plain, of), lambda d: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when((c != " ") & (F.length(c) > 0), F.substr(d, nth(i), F.lit(1))).otherwise(c)), ""))


def _token(m: Column, key: str) -> Column:
    return F.concat(F.lit("eyJ"), permuted(F.substr(m, F.lit(4), F.length(m)), [DIGITS, LATIN, LATIN.upper()], "token", key))


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    name, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    top = F.regexp_extract(domain, r"\.[a-z]+$", 0)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    new = F.concat(permuted(name, [DIGITS, LATIN, ACCENTED, CYRILLIC, GREEK], "name", key), F.lit("@"), permuted(host, [DIGITS, LATIN], "host", key), top)
    cased = lambda new: F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike(r"^\p{Lu}$"), F.upper(F.substr(new, i + 1, F.lit(1)))).otherwise(F.substr(new, i + 1, F.lit(1))))
    return F.array_join(_let(new, cased), "")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def spelled(word: Column, n: int, key: str) -> Column:
    """A made-up name of n syllables in the script of `word`, by a keyed hash of its lower-case form."""
    script = _script(word)

    def of(name: str) -> Column:
        parts = SYLLABLES[name]
        take = [F.element_at(F.array(*map(F.lit, parts)), (F.pmod(_number(key, F.lit("part"), F.lit(i), F.lower(word)), F.lit(len(parts))) + 1).cast("int")) for i in range(n)]
        return F.initcap(F.concat(*take))

    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def _part(word: Column, n: int, key: str) -> Column:
    """Surrogate of one part of a name: a known given name within its list, else syllables."""
    out = spelled(word, n, key)
    for (gender, script), names in GIVEN.items():
        step = _number(key, F.lit(gender + script)) % (len(names) - 1) + 1
        at = F.array_position(F.array(*map(F.lit, names)), word)
        out = F.when(at > 0, F.element_at(F.array(*map(F.lit, names)), (F.pmod(at - 1 + step, F.lit(len(names))) + 1).cast("int"))).otherwise(out)
    return out


_TITLED = rf"^((?:{_TITLE})\.? )?(.*)$"


def _name(m: Column, n: int, key: str) -> Column:
    """The title stays; each part has one surrogate, whatever stands before it."""
    parts = F.split(F.regexp_extract(m, _TITLED, 2), " ")
    return F.concat(F.regexp_extract(m, _TITLED, 1), F.array_join(F.transform(parts, lambda w: _part(w, n, key)), " "))


def kind(m: Column) -> Column:
    """The kind of an entity; null for a number that looks like a card's and isn't."""
    full = lambda p: m.rlike(rf"^(?:{p})$")
    card = F.when(_let(_digits(m), lambda d: _luhn(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)).cast("int")), "card")
    out = F.when(m.contains("@"), "mail").when(full(_SECRET), "secret").when(full(_TOKEN), "token").when(full(_ADDRESS), "address").when(full(_SOCIAL), "social").when(full(_PHONE), "phone")
    return out.when(full(_CARD), card).when(full(_SIX), "address6").when(full(_ACCOUNT), "account").otherwise("name")


def surrogate(m: Column, n: int = 3, key: str = KEY) -> Column:
    return _let(kind(m), lambda k: _by_kind(m, k, n, key))


def _by_kind(m: Column, k: Column, n: int, key: str) -> Column:
    secret = F.when(m.rlike("^[0-9a-f]+$"), permuted(m, [HEX], "hex", key)).otherwise(F.concat(F.substring(m, 1, 4), permuted(F.substr(m, F.lit(5), F.length(m)), [DIGITS, LATIN, LATIN.upper()], "secret", key)))
    out = F.when(k.isNull(), m).when(k == "mail", _email(m, key)).when(k == "secret", secret).when(k == "token", _token(m, key)).when(k == "address", _address(m, key)).when(k == "card", _card(m, key))
    out = out.when(k == "social", _relaid(m, permuted(_digits(m), [DIGITS], "social", key))).when(k == "phone", _phone(m, key))
    return out.when(k == "address6", permuted(F.lower(m), [HEX], "address6", key)).when(k == "account", _account(m, key)).otherwise(_name(m, n, key))


def pattern(text: Column) -> Column:
    """The pattern for one text: PATTERN, and the parts of the names in it where they stand alone."""
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_NAME), 0), lambda m: F.split(F.regexp_extract(m, _TITLED, 2), " ")))
    alone = lambda w: F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(w, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(text.rlike(_NAMED), _let(F.array_sort(F.array_distinct(F.filter(names, lambda w: F.length(w) > 1))), lambda w: F.when(F.size(w) > 0, alone(w)).otherwise(F.lit(PATTERN)))).otherwise(F.lit(PATTERN))


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    found = F.regexp_extract_all(text, pattern(text), F.lit(0))
    return F.when(text.rlike(_HINT), F.filter(found, lambda m: kind(m).isNotNull())).otherwise(F.array().cast("array<string>"))


def syllables(docs: DataFrame, key: str = KEY, least: int = 3) -> int:
    """The smallest count of syllables for which all name parts of the corpus keep distinct, new surrogates."""
    text = F.col("text")
    found = docs.where(text.rlike(_NAMED))
    found = found.select(F.explode(F.regexp_extract_all(text, F.lit(_NAME), 0)).alias("m"))
    parts = found.select(F.explode(F.split(F.regexp_extract("m", _TITLED, 2), " ")).alias("w")).where(F.length("w") > 0)
    parts = saved(parts.select(F.lower("w").alias("w")).distinct())
    for n in count(least):  # every syllable has a hash of its own, so any two parts differ at some count
        made = parts.select("w", F.lower(spelled(F.col("w"), n, key)).alias("s"))
        twice = made.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
        taken = made.join(parts.select(F.col("w").alias("s")), "s", "left_semi")
        known = made.where(F.col("s").isin([x.lower() for names in GIVEN.values() for x in names]))
        if twice.isEmpty() and taken.isEmpty() and known.isEmpty():
            return n


def replaced(docs: DataFrame, key: str = KEY, n: int | None = None) -> DataFrame:
    """`docs` with surrogates in the text; n_chars, where there is one, counts the new text."""
    n = syllables(docs, key) if n is None else n
    text, new = F.col("text"), free_name(docs, "new")

    def put(p: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: surrogate(m, n, key))
        return F.array_join(F.zip_with(F.split(text, p, F.lit(-1)), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    mine = free_name(docs, "pattern")
    out = docs.withColumn(mine, F.when(text.rlike(_HINT), pattern(text)))
    out = out.withColumn(new, F.when(F.col(mine).isNull(), text).otherwise(put(F.col(mine))))
    out = out.withColumn("text", F.col(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, n_entities, kinds, text) of every row: how many entities, their kinds (sorted, comma-joined), the new text."""
    n = syllables(docs, key)
    found = docs.select("doc_id", "text", entities(F.col("text")).alias("found"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", kind))), ",")
    return replaced(found.select("doc_id", "text", F.coalesce(F.size("found"), F.lit(0)).alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds")), key, n).select("doc_id", "n_entities", "kinds", "text")
