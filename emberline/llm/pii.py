"""Personal data: keyed surrogates of the same type, script and format (operator 1). DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let, written

# Given names by language, each (female, male), and words that come before a name. Syllables and letters of surrogates.
GIVEN_NAMES = {
    "en": ("Mary Linda Susan Karen Lisa Nancy Emily Sarah Emma Julia Laura Jennifer Jessica Elizabeth Margaret Rachel Hannah Olivia Charlotte Helen", "John James Robert Michael William David Thomas Peter Paul Daniel Mark George Richard Charles Joseph Matthew Andrew Edward Brian Kevin"),
    "de": ("Anna Ursula Ingrid Greta Sabine Monika Petra Heike Katharina Johanna", "Hans Karl Heinrich Wolfgang Stefan Jürgen Klaus Dieter Matthias Florian"),
    "fr": ("Marie Claire Camille Sophie Nathalie Isabelle Juliette Chloé Amélie Élise", "Jean Pierre Louis Antoine Jacques François Michel Philippe Nicolas Olivier"),
    "es": ("Carmen Lucia Lucía Elena Isabel Pilar Sofia Sofía Maria María Marta Teresa", "Carlos Jose José Miguel Pablo Javier Alejandro Fernando Diego Manuel"),
    "ru": ("Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия", "Иван Пётр Сергей Андрей Дмитрий Алексей Александр Михаил Николай Владимир"),
}
FEMALE = " ".join(f for f, _ in GIVEN_NAMES.values())
MALE = " ".join(m for _, m in GIVEN_NAMES.values())
HONORIFICS = r"Mr\. |Mrs\. |Ms\. |Dr\. |Mr |Mrs |Ms |Dr |Herr |Frau |Monsieur |Madame |Mme |Señor |Señora |Sr\. |Sra\. "
PARTICLES = "van von de der den la del di da"
LATIN = "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mi na ne no ra re ri sa se si ta te to va ve vi".split()
CYRILLIC = "ба бе бо да де до фа га го ка ке ко ла ле ло ма ме ми на не но ра ре ри са се си та те то ва ве ви зо".split()

#: Entities broadcast at most.
MOST_FREQUENT = 10_000

_GIVEN = "|".join((FEMALE + " " + MALE).split())
_NAME = r"\p{Lu}\p{Ll}{1,30}"
_NEXT = rf"[ -](?:(?:{'|'.join(PARTICLES.split())}) ){{0,2}}{_NAME}"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d)"
#: A number in a row of numbers is no phone.
_ALONE, _DONE = r"(?<![\w.+-])(?<!\d[ \t,;|])", r"(?![\w-]|[ \t.,;|]\d)"
_PHONES = (
    r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}",  # an international prefix
    r"\(\d{2,5}\)[ .-]?\d{3,8}(?:[ .-]\d{2,6}){0,2}",  # an area in brackets
    r"(?:1[ .-])?[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4}",  # North America
    r"(?=0[1-9](?:[ ./-]?\d){7,11}(?!\d))(?!\d{1,2}[./-]\d{1,2}[./-]\d{2,4}(?!\d))0\d{1,4}[ ./-]\d{2,8}(?:[ .-]\d{2,4}){0,4}",  # a trunk zero
    r"(?=\d)(?<=(?i:\b(?:tel|phone|fax|mobile|cell|call|telefon|teléfono|tél|тел))[.:]{0,2} {0,2})\d{2,5}(?:[ ./-]?\d{2,4}){1,5}",  # a word that announces it
)
#: Type -> pattern, in order of precedence. Quantifiers are bounded, so no text makes a match expensive.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,80}\b|\bsk-[A-Za-z0-9]{16,80}\b|(?<=[=:]\s{0,3}[\"']?)(?<=\b(?:password|passwd|secret|token|api_key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_/+\-]{6,128}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]\d)(?!\d)",
    "ip6": r"(?<![\w:])(?=[0-9A-Fa-f:]{0,40}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.-])(?:\d{13,19}|(?<!\d )\d{4} \d{4} \d{4} \d{1,7}(?! \d)|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": rf"(?=\d)(?<=(?i:\b(?:born|dob|birth|birthday|geboren|geb\.|née? le|nacid[oa] el|родил(?:ся|ась)))(?: (?:on|am|the))?:? {{0,2}}){_DATE}",
    "phone": rf"(?=[\d+(]){_ALONE}(?:{'|'.join(_PHONES)}){_DONE}",
    "name": rf"\b(?=\p{{Lu}})(?:(?:{_GIVEN})(?:{_NEXT}){{1,3}}|(?<=\b(?:{HONORIFICS})){_NAME}(?:{_NEXT}){{0,2}})(?!\p{{L}})",
}
# Between a mark and its escape there is no character that a pattern takes for part of a word.
_MARK, _ESCAPE = "\x01\x02", "\x01\x03"
#: What every entity holds: a digit, an at sign, two capitalised words of one name, a short title, a key's prefix or an assigned
#: value. A text without any of these has no entity, and the costly patterns don't run on it.
_NEEDED = rf"[0-9@]|{_NAME}{_NEXT}|(?:Mr|Mrs|Ms|Dr|Sr|Sra)\.? \p{{Lu}}|AKIA|ASIA|gh[pousr]_|sk-|[=:]\s{{0,3}}[\"']?[A-Za-z0-9_/+\-]{{6}}"
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def cut(text: Column) -> Column:
    """The text in pieces: plain text at even places, entities at odd ones. One linear pass finds the entities; a name is cut
    into its words, and every further occurrence of these words in the text, in capitals too, is an entity as well."""
    marked = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit(_ESCAPE)), f"({_ANY})", f"{_MARK}$1{_MARK}")
    return let(F.split(marked, _MARK), lambda parts: let(name_words(parts), lambda names: F.transform(_recut(parts, names), lambda x: F.replace(x, F.lit(_ESCAPE), F.lit("\x01")))))


_RUN = rf"^{_NAME}(?:{_NEXT})*$"


def name_words(parts: Column) -> Column:
    """The distinct words of the names among the entities of a text in pieces."""
    return F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda x, i: (i % 2 == 1) & x.rlike(_RUN)), lambda x: F.regexp_extract_all(x, F.lit(f"({_NAME})"), 1))))


def _recut(parts: Column, names: Column) -> Column:
    known = F.array_join(F.concat(names, F.transform(names, F.upper)), "|")
    again = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?=\p{Lu})("), known, F.lit(r")(?![\p{L}\p{N}_])"))
    marked = lambda x, pattern: F.split(F.regexp_replace(x, pattern, F.lit(f"{_MARK}$1{_MARK}")), _MARK)

    def pieces(x: Column, i: Column) -> Column:
        words = let(marked(x, F.lit(f"({_NAME})")), lambda p: F.slice(p, F.lit(2), F.size(p) - 2))  # a name begins and ends with a word
        return F.when(i % 2 == 0, marked(x, again)).when(x.rlike(_RUN), words).otherwise(F.array(x))

    return F.when(F.size(names) > 0, F.flatten(F.transform(parts, pieces))).otherwise(parts)


def _odd(parts: Column) -> Column:
    return F.array_distinct(F.filter(parts, lambda x, i: i % 2 == 1))


def luhn(digits: Column) -> Column:
    """Whether a number's check digit holds."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 1).otherwise(2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def iban_rest(bare: Column) -> Column:
    """An account number modulo 97, its country and check digits last; 1 if they hold."""
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    put = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), put)


def date_of(v: Column) -> Column:
    """The day that a spelling names; null if there is none. Of days and months that fit both ways, the first is the month
    between slashes and the day between dots."""
    day = lambda f: F.try_to_timestamp(v, F.lit(f)).cast("date")
    return F.when(v.rlike(r"^\d{4}-"), day("yyyy-MM-dd")).when(v.contains("."), day("d.M.yyyy")).otherwise(F.coalesce(day("M/d/yyyy"), day("d/M/yyyy")))


def kind_of(v: Column) -> Column:
    """The type of an entity by its own shape; null if its check fails, so that it is none. What was found behind a name of a
    secret is one if it has no other shape."""
    given = v.isin(*_GIVEN.split("|"))
    bare = F.regexp_replace(v, r"\D", "")
    digits = F.length(bare)
    years = v.rlike(r"^(?:(?:19|20)\d\d[ -]){3}(?:19|20)\d\d$")
    return (
        F.when(v.contains("@"), "email")
        .when(v.rlike(f"^(?:{PATTERNS['ip']})$"), "ip")
        .when(v.rlike(f"^(?:{PATTERNS['ip6']})$"), "ip6")
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(v.rlike(f"^{_DATE}$"), F.when(date_of(v).between("1900-01-01", "2079-06-05"), "date"))
        .when(v.rlike(r"^[\d +().-]+$") & (v.startswith("+") | v.contains("(")), F.when(digits.between(8, 15), "phone"))
        .when(v.rlike(r"^\d[\d -]+$") & digits.between(13, 19), F.when(~years & (luhn(bare) | v.rlike(r"^[2-6]\d{15}$")), "card"))
        .when(v.rlike(r"^[\d +()./-]+$"), F.when(digits.between(7, 15), "phone"))
        .when(v.rlike(f"^(?:{PATTERNS['iban']})$"), F.when(iban_rest(F.replace(v, F.lit(" "))) == 1, "iban"))
        .when(given, F.when(v.isin(*FEMALE.split()), "given_f").otherwise("given_m"))
        .when(v.rlike(rf"^{_NAME}$"), "surname")
        .otherwise("secret")
    )


def canonical(v: Column, kind: Column) -> Column:
    """One form of an entity's spellings: letters without case in addresses and names, characters without spacing in numbers.
    Of a number with an international prefix and one without, the last ten digits count."""
    bare = F.regexp_replace(v, r"[^\p{L}\p{N}]", "")
    return F.when(kind == "phone", F.when(F.length(bare) > 10, F.substr(bare, F.length(bare) - 9)).otherwise(bare)).when(kind.isin("card", "ssn", "iban"), bare).when(kind == "secret", v).when(kind == "date", date_of(v).cast("string")).otherwise(F.lower(v))


def _stream(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """256 bytes of key stream (array<int>) for an entity."""
    hexes = F.concat(*[F.sha2(F.concat_ws("|", F.lit(f"{key}{i}"), kind, norm, attempt.cast("string")), 512) for i in range(4)])
    return let(hexes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.conv(F.substr(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))


def _pick(choices: str | list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), F.pmod(n, F.lit(len(choices))))


def _like(text: Column, stream: Column, salt: int = 0) -> Column:
    """Letters and digits by others of their class, other characters as they are. Hexadecimal text stays hexadecimal."""
    put = lambda is_hex: lambda c, i: (
        F.when(c.rlike("[0-9]"), _pick("0123456789", F.get(stream, F.pmod(i + salt, F.lit(256)))))
        .when(is_hex, _pick("abcdef", F.get(stream, F.pmod(i + salt, F.lit(256)))))
        .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", F.get(stream, F.pmod(i + salt, F.lit(256)))))
        .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", F.get(stream, F.pmod(i + salt, F.lit(256)))))
        .otherwise(c)
    )
    return let(text.rlike("^[0-9a-f]+$") & text.rlike("[0-9]"), lambda is_hex: F.array_join(F.transform(F.split(text, ""), put(is_hex)), ""))


def _luhn_ended(digits: Column) -> Column:
    """The digits with the last one set so that the card number's check holds."""
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    each = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _iban_ended(bare: Column) -> Column:
    """The account number with check digits that hold instead of 00."""
    return F.concat(F.substr(bare, F.lit(1), F.lit(2)), F.lpad((98 - iban_rest(bare)).cast("string"), 2, "0"), F.substr(bare, F.lit(5)))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str, domain: Column | None = None) -> Column:
    """The canonical surrogate of a canonical entity. domain: that of an address's domain."""
    return let(_stream(kind, norm, attempt, key), lambda s: _made(kind, norm, s, F.lit(None).cast("string") if domain is None else domain))


def shifted_date(day: Column, key: str) -> Column:
    """Another day of 1900-01-01 to 2079-06-05, by a keyed one-to-one map of its 65,536 days: two days never share one."""
    n = int(hashlib.sha256(f"{key}|date".encode()).hexdigest(), 16)
    a, b = n % 16384 * 4 + 3, n // 65536 % 32768 * 2 + 1  # a - 1 is even and b odd: no day stays itself
    return F.date_add(F.lit("1900-01-01").cast("date"), ((F.datediff(day, F.lit("1900-01-01").cast("date")) * F.lit(a).cast("bigint") + b) % 65536).cast("int"))


def _made(kind: Column, norm: Column, stream: Column, of_domain: Column) -> Column:
    cyrillic = norm.rlike(r"\p{IsCyrillic}")

    def syllables(first: int, n: int) -> Column:
        at = [F.get(stream, F.lit(first + i)) for i in range(n)]
        return F.when(cyrillic, F.concat(*[_pick(CYRILLIC, x) for x in at])).otherwise(F.concat(*[_pick(LATIN, x) for x in at]))

    local = F.substring_index(norm, "@", 1)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(F.get(stream, i) * 256 + F.get(stream, i + 4), F.lit(254))).cast("string")), ".")
    suffix = F.regexp_extract(norm, "(ова|ева|ина|ская|ов|ев|ин|ский)$", 1)
    return (
        F.when(kind == "email", F.concat(_like(local, stream), F.lit("@"), of_domain))
        .when(kind == "domain", F.concat(_like(F.lpad(F.lit("a"), 8, "a"), stream), F.lit(".example")))  # a zone that nobody can register
        .when(kind == "ip", octets)
        .when(kind == "ip6", F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), _like(F.lit("0a0a"), stream, 4 * i)) for i in range(6)]))
        .when(kind == "card", _luhn_ended(F.concat(F.substr(norm, F.lit(1), F.lit(1)), _like(F.substr(norm, F.lit(2)), stream))))
        .when(kind == "iban", let(F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lit("00"), _like(F.substr(norm, F.lit(5)), stream)), _iban_ended))
        .when(kind == "phone", let(F.regexp_extract(norm, "^0?", 0), lambda zero: F.concat(zero, _pick("23456789", F.get(stream, F.lit(255))), _like(F.substr(norm, F.length(zero) + 2), stream))))
        .when(kind == "secret", F.concat(F.regexp_extract(norm, "^(AKIA|ASIA|gh[pousr]_|sk-)", 1), _like(F.regexp_replace(norm, "^(AKIA|ASIA|gh[pousr]_|sk-)", ""), stream)))
        .when(kind == "given_f", F.concat(syllables(0, 4), F.when(cyrillic, "на").otherwise("na")))
        .when(kind == "given_m", F.concat(syllables(0, 4), F.when(cyrillic, "н").otherwise("n")))
        .when(kind == "surname", F.concat(syllables(0, 5), F.when(suffix != "", suffix).when(cyrillic, "р").otherwise("r")))
        .otherwise(_like(norm, stream))
    )


def formatted(v: Column, kind: Column, made: Column) -> Column:
    """The canonical surrogate in the spelling of an occurrence: its separators, its prefix, its case."""
    bare = F.regexp_replace(v, r"[^\p{L}\p{N}]", "")
    extra = F.greatest(F.length(bare) - F.length(made), F.lit(0))
    filling = F.concat(F.substr(bare, F.lit(1), extra), made)
    step = lambda filling: lambda a, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(a["out"], F.substr(filling, a["i"] + 1, F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i")))
    spelled = let(filling, lambda f: F.aggregate(F.split(v, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step(f))["out"])
    titled = F.concat(F.upper(F.substr(made, F.lit(1), F.lit(1))), F.substr(made, F.lit(2)))
    upper = (v == F.upper(v)) & (v != F.lower(v))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spelled).when(kind.startswith("given") | (kind == "surname"), F.when(upper & (F.length(v) > 1), F.upper(made)).otherwise(titled)).when((kind == "email") & upper, F.upper(made)).when(kind == "date", _dated(v, made.cast("date"))).otherwise(made)


def _dated(v: Column, day: Column) -> Column:
    month_first = F.try_to_timestamp(v, F.lit("M/d/yyyy")).isNotNull()
    return F.when(v.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd")).when(v.contains("."), F.date_format(day, "dd.MM.yyyy")).when(month_first, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, made) for distinct (kind, norm): no surrogate is an entity of the corpus or stands for two, but for dates,
    which a one-to-one map of days moves. The domains of addresses get distinct surrogates first."""
    norm = F.col("norm")
    of_address = F.substring_index("norm", "@", -1)
    domains = written(entities.where("kind = 'email'").select(F.lit("domain").alias("kind"), of_address.alias("norm")).distinct())
    addressed = entities.where("kind <> 'date'").withColumn("at", F.when(F.col("kind") == "email", of_address))
    if not domains.isEmpty():
        made = _drawn(domains.withColumn("domain", F.lit(None).cast("string")), key).select(norm.alias("at"), F.col("made").alias("domain"))
        addressed = addressed.where("at is null").withColumn("domain", F.lit(None).cast("string")).unionByName(addressed.where("at is not null").join(made, "at"))
    else:
        addressed = addressed.withColumn("domain", F.lit(None).cast("string"))
    dates = entities.where("kind = 'date'").select("kind", "norm", shifted_date(norm.cast("date"), key).cast("string").alias("made"))
    return _drawn(written(addressed.select("kind", "norm", "domain")), key).union(dates)


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, made) for distinct (kind, norm, domain).

    All draw a surrogate; of those with the same one, the least keeps it, and it must not be an entity itself. The others
    draw again until none is left. Each round is an aggregation over the drawn surrogates.
    """
    real = entities.select("kind", F.col("norm").alias("made"))
    settled, pending, attempt = None, entities, 0
    while True:
        drawn = pending.select("kind", "norm", "domain", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key, F.col("domain")).alias("made"))
        least = drawn.groupBy("kind", "made").agg(F.min("norm").alias("least"))
        free = least.join(real, ["kind", "made"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        held = written(drawn.join(free, ["kind", "made"], "left").select("kind", "norm", "domain", "made", F.coalesce(F.col("least") == F.col("norm"), F.lit(False)).alias("won")))
        won = held.where("won").select("kind", "norm", "made")
        settled = won if settled is None else settled.union(won)
        pending, attempt = held.where("not won").select("kind", "norm", "domain"), attempt + 1
        if pending.isEmpty():
            return settled
        assert attempt < 64, "the types' surrogates are used up"


def with_made(typed: DataFrame, made: DataFrame, counts: DataFrame) -> DataFrame:
    """typed (kind, norm, ...) with made. Entities that stand in a ten-thousandth of all rows or more, so ten thousand at
    most, are broadcast; the others are joined by their key."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") >= max(1000, total / MOST_FREQUENT)).select("kind", "norm")
    hot = F.broadcast(written(made.join(often, ["kind", "norm"], "left_semi")))
    first = typed.join(hot, ["kind", "norm"], "left")
    return first.where("made is not null").unionByName(first.where("made is null").drop("made").join(made, ["kind", "norm"]))


def pseudonymized(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and n_entities, the number of entities replaced in each row.

    Entities: e-mail addresses, secrets, IPv4 and IPv6 addresses, IBANs and card numbers whose check holds (16 digits of a
    card network's range also without), social security numbers, dates of birth, phone numbers with a prefix, brackets, a
    national plan or a word that announces them, and names that follow a known given name or a form of address. Each word
    of a name found is replaced wherever it stands in that text, in capitals too. Other dates, years and rows of numbers stay.
    A surrogate depends on the key, the type and the canonical entity, so every spelling of an entity gets the same one in
    every document; it keeps type, case, script, gender and separators, and checks hold. No two entities share one, and
    none is an entity of the corpus (per type; dates of birth are moved one to one within 1900 to 2079).

    Null texts stay null with 0 entities. Rows with the same id and text get the same; any id, null too, is carried along.
    Texts without entities don't move; the others are joined with their own surrogates, in one row a document, so the time
    of one text grows with its pieces times its distinct entities. Columns of other names are carried along; a column
    n_entities is replaced. An empty table stays empty.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    whole = F.struct(*[F.col(c) for c in names]).alias("_row")
    hit = F.coalesce(F.col(text_col).rlike(_NEEDED) & F.col(text_col).rlike(_ANY), F.lit(False))
    found = written(docs.where(hit).select(whole, cut(F.col(text_col)).alias("_parts"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_at")))
    titles = let(_odd(F.col("_parts")), lambda odd: F.transform(odd, lambda v: F.struct(v.alias("v"), F.when(v.rlike(r"^\p{Lu}{2,31}$") & F.array_contains(odd, F.initcap(v)), F.initcap(v)).otherwise(v).alias("t"))))
    here = found.select("_at", F.explode(titles).alias("e")).select("_at", "e.*").distinct()
    typed = here.withColumn("kind", kind_of(F.col("t"))).where("kind is not null").withColumn("norm", canonical(F.col("t"), F.col("kind"))).drop("t")
    typed = written(typed)
    counts = written(typed.groupBy("kind", "norm").agg(F.count("*").alias("n")))
    made = distinct_surrogates(counts.select("kind", "norm"), key)
    spelled = with_made(typed, made, counts).select("_at", "v", formatted(F.col("v"), F.col("kind"), F.col("made")).alias("s"))
    maps = spelled.groupBy("_at").agg(F.map_from_entries(F.collect_list(F.struct("v", "s"))).alias("_map"))
    joined = found.join(maps, "_at", "left")
    said = F.transform("_parts", lambda x, i: F.when(i % 2 == 1, F.element_at("_map", x)))
    text = F.array_join(F.zip_with("_parts", "_said", lambda x, s: F.coalesce(s, x)), "")
    changed = joined.withColumn("_said", said).select("_row", text.alias("_text"), F.size(F.filter("_said", lambda s: s.isNotNull())).alias("n_entities"))
    changed = changed.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names], "n_entities")
    return changed.union(docs.where(~hit).select(*names, F.lit(0).alias("n_entities")))
