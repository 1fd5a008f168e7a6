"""Personal data in texts replaced by keyed surrogates of the same kind.

Mentions are found by pattern: e-mail and IPv4 addresses, IBANs, social security, payment card and
phone numbers, and names after one title or several, with any initials, given names and particles that they have. The words of a name found so are
replaced wherever else they stand in that document, with a title or without. A mention's canonical form stands for the entity it
refers to (case, spaces and separators don't count; a phone number of ten digits is the same with and without the country code 1), so
that all its mentions in all documents get one surrogate (coreference). Given names and surnames are entities of their own, so that
a person keeps the surname where only that is mentioned, and so are the two sides of an e-mail address: addresses of one domain stay so. An initial becomes another letter. The surrogate comes from
a keyed hash of the canonical form and keeps what can be seen of it: lengths and places of letters
and digits, country codes, the check digit of a card number, octet lengths of an address, capitals of an address, for names
the script and the gender of the title, for Cyrillic surnames its ending: the two forms of one surname are one entity. It is written in the form of the mention.

Surrogates are checked for collisions over the whole corpus: one that equals another entity's, or a real entity, is
drawn anew with the next attempt, longer from the sixth one on, until all of them differ (distinctness). Entities of a form that is so full that
MOST_ATTEMPTS draws don't place them get x and twenty hexadecimal digits instead.

Nulls: a null text stays null; a null doc_id is of no account. Equal texts change alike, so repeated
rows stay repeated. Very long texts are changed whole. Ties: of entities that draw one surrogate the least keeps it. An empty table gives no rows. All columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, checkpoint, text_key

#: Titles and the gender they tell, and particles of names.
MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "Señor", "Sr", "Don", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Señorita", "Sra", "Doña", "Madame", "Mademoiselle", "Mme", "Mlle", "Госпожа")
EITHER = ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Rev", "Capt", "Доктор", "Профессор")
PARTICLES = ("von", "van", "de", "del", "der", "den", "di", "da", "la", "le", "du", "dos", "bin", "ibn", "al", "zu")
#: What surrogate names are made of.
LATIN = ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "pa", "ra", "se", "ti", "va", "zo", "lin", "mar")
CYRILLIC = ("ба", "де", "фи", "го", "ка", "ле", "ми", "но", "па", "ра", "се", "ти", "ва", "зо", "лин", "мар")
ENDINGS = {"latin": {"m": "en", "f": "a", "n": "i"}, "cyrillic": {"m": "ов", "f": "а", "n": "ий"}}
#: Feminine forms of Cyrillic surnames.
FEMININE = r"(?:ов|ев|ёв|ин|ын)а$|[сц]кая$"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_FIRSTS = "".join(sorted({t[0] for t in MALE + FEMALE + EITHER}))
#: By first letter, so that most places of a text are passed over at once.
_TITLES = "|".join(f"{c}(?:{'|'.join(sorted((t[1:] for t in MALE + FEMALE + EITHER if t[0] == c), key=len, reverse=True))})" for c in _FIRSTS)
_TITLED = rf"(?:(?:{_TITLES})\.? )+"
_NAME = r"\p{Lu}(?:\p{Ll}+|['’]\p{Lu}\p{Ll}+)(?:-\p{Lu}\p{Ll}+)*"
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}(?:{_NAME}|\p{{Lu}}\.)"
#: Draws in an entity's own form.
MOST_ATTEMPTS = 40
#: Where two match at one place, the first counts. ANY tries them by the character that they begin with.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+(-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+(])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "person": rf"(?=[{_FIRSTS}])(?<!\p{{L}}){_TITLED}{_PART}(?: {_PART}){{0,6}}",
}
_BY_FIRST = {r"[0-9+(]": ("ip", "ssn", "card", "phone"), r"\p{Lu}": ("iban", "person")}
ANY = "|".join([f"(?:{PATTERNS['email']})", *(f"(?={first})(?:{'|'.join(f'(?:{PATTERNS[n]})' for n in names)})" for first, names in _BY_FIRST.items())])
#: What every text that holds a mention has; fast to look for.
MAYBE = rf"[@0-9]|(?=[{_FIRSTS}])(?:{_TITLES})\.? "
PERSON = PATTERNS["person"]
_NAMES = "array<struct<kind:string,canon:string,mention:string,after:string,gender:string>>"


def kind_of(mention: Column) -> Column:
    """The type of a mention that ANY has found; look-arounds hold at its ends. Null for a word of a name."""
    out = None
    for name, pattern in PATTERNS.items():
        fits = mention.rlike(f"^(?:{pattern})$")
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _first(pattern: tuple[str, ...], titles: Column) -> Column:
    return titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(sorted(pattern, key=len, reverse=True))})(?!\p{{L}})")


def _part(kind: Column | str, canon: Column, mention: Column, after: Column | str, gender: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("kind"), canon.alias("canon"), mention.alias("mention"), lit(after).alias("after"), lit(gender).alias("gender"))


def _surname(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(word), r"(ов|ев|ёв|ин|ын)а$", "$1"), r"([сц]к)ая$", "$1ий")


def _canon_of_name(kind: Column, word: Column, gender: Column) -> Column:
    return F.when(kind == "given", F.concat(gender, F.lit(":"), F.lower(word))).otherwise(_surname(word))


def _initial(word: Column, secret: str) -> Column:
    """Another letter of the same alphabet, and the point."""
    by, code = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{secret}\x00"), word), 256), 1, 6), 16, 10).cast("int"), F.ascii(word)
    turned = lambda first, n: F.char(first + F.pmod(code - first + 1 + F.pmod(by, F.lit(n - 1)), F.lit(n)))
    cyrillic = F.element_at(F.array(*(F.lit(chr(c)) for c in range(0x410, 0x430))), F.pmod(F.instr(F.lit("".join(map(chr, range(0x410, 0x430)))), F.substring(word, 1, 1)) + F.pmod(by, F.lit(31)), F.lit(32)) + 1)
    return F.concat(F.when(word.rlike(r"^\p{IsCyrillic}"), cyrillic).otherwise(turned(65, 26)), F.lit("."))


def parts_of_name(mention: Column, secret: str) -> Column:
    """The titles, particles and initials of a titled name, as they are to be written (kind keep), and its given names and surname."""
    titles = F.regexp_extract(mention, f"^({_TITLED})", 1)
    gender = F.when(_first(FEMALE, titles), "f").when(_first(MALE, titles), "m").otherwise("n")
    words = F.split(F.substr(mention, F.length(titles) + 1), " ")

    def one(w: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        after = F.when(last, "").otherwise(" ")
        kind = F.when(last, "surname").otherwise("given")
        kept = F.when(w.rlike(r"^\p{Ll}"), w).when(w.rlike(r"^\p{Lu}\.$"), _initial(w, secret))
        return F.when(kept.isNotNull(), _part("keep", F.lit(""), kept, after, gender)).otherwise(_part(kind, _canon_of_name(kind, w, gender), w, after, gender))

    return F.concat(F.array(_part("keep", F.lit(""), titles, "", gender)), F.transform(words, one))


def names_in(text: Column, secret: str) -> Column:
    """The given names and surnames that stand after titles in a text, as parts."""
    of = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), lambda m: parts_of_name(m, secret)))
    named = F.transform(F.filter(of, lambda x: (x["kind"] != "keep") & (F.length(x["mention"]) > 1)), lambda x: _part(x["kind"], x["canon"], x["mention"], "", x["gender"]))
    return F.array_sort(F.array_distinct(named))


def parts_of(kind: Column, mention: Column, names: Column, secret: str) -> Column:
    """Array of struct(kind, canon, mention, after, gender): what a mention is made of. ``names`` are those of its document."""
    at, domain = F.substring_index(mention, "@", 1), F.substring_index(mention, "@", -1)
    email = F.array(_part("mailbox", F.lower(at), at, "@"), _part("domain", F.lower(domain), domain, ""))
    # a word may be a given name here and a surname there; surnames come last in the order
    bare = F.slice(F.filter(names, lambda x: x["mention"] == mention), -1, 1)
    return F.when(kind == "person", parts_of_name(mention, secret)).when(kind == "email", email).when(kind.isNull(), bare).otherwise(F.array(_part(kind, canonical(kind, mention), mention, "")))


def canonical(kind: Column, mention: Column) -> Column:
    return (
        F.when(kind == "phone", F.regexp_replace(_digits(mention), "^1([0-9]{10})$", "$1"))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )


def _byte(digest: Column, i: Column) -> Column:
    """Number i of the digest's 32 bytes, over and over."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(text: Column, digest: Column, offset: int = 0) -> Column:
    """Letters for letters and digits for digits, by the digest."""

    def letter(first: str, n: int, b: Column) -> Column:
        return F.char(F.lit(ord(first)) + F.pmod(b, F.lit(n)))

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i + offset) + i
        return F.when(c.rlike("[0-9]"), letter("0", 10, b)).when(c.rlike("[a-z]"), letter("a", 26, b)).when(c.rlike("[A-Z]"), letter("A", 26, b)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that a valid card number has at 0 modulo 10."""
    return F.pmod(
        F.aggregate(
            F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int"))), F.lit(0), lambda a, x: a + x
        ),
        F.lit(10),
    )


def _name(word: Column, digest: Column, offset: int, ending: Column, extra: Column) -> Column:
    """A capitalised word of three syllables, more with each attempt past the fifth."""
    cyrillic = word.rlike(r"\p{IsCyrillic}")
    table = F.when(cyrillic, F.array(*map(F.lit, CYRILLIC))).otherwise(F.array(*map(F.lit, LATIN)))
    syllables = F.transform(F.sequence(F.lit(0), F.lit(2) + extra), lambda i: F.get(table, F.pmod(_byte(digest, i + offset), F.lit(16))))
    return F.initcap(F.concat(F.array_join(syllables, ""), ending))


def surrogate(kind: Column, canon: Column, secret: str, attempt: int) -> Column:
    """The canonical form of the entity's surrogate."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(secret), kind, canon, F.lit(str(attempt))), 256)
    if attempt >= MOST_ATTEMPTS:
        return F.concat(F.lit("x"), F.substring(digest, 1, 20))
    longer = F.substring(digest, 50, max(0, attempt - 5)) if attempt > 5 else F.lit("")
    mailbox = F.concat(_shaped(canon, digest), longer)
    domain = F.concat(_shaped(F.regexp_replace(canon, r"\.[a-z]+$", ""), digest, 11), longer, F.lit(".example"))
    octet = lambda c, i: (
        F.when(F.length(c) == 3, (100 + F.pmod(_byte(digest, i), F.lit(156))).cast("string")).when(F.length(c) == 2, (10 + F.pmod(_byte(digest, i), F.lit(90))).cast("string")).otherwise(F.pmod(_byte(digest, i), F.lit(10)).cast("string"))
    )
    any_octet = lambda c, i: (_byte(digest, i)).cast("string")
    ip = F.array_join(F.transform(F.split(canon, r"\."), octet if attempt < 6 else any_octet), ".")
    card = _shaped(canon, digest)
    head = F.substring(card, F.lit(1), F.length(card) - 1)
    checked = F.concat(head, F.pmod(10 - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    iban = F.concat(F.substring(canon, 1, 2), _shaped(F.substring(canon, F.lit(3), F.length(canon)), digest))
    name, gender = F.substring(canon, F.lit(3), F.length(canon)), F.substring(canon, 1, 1)
    by_gender = lambda e: F.when(gender == "f", e["f"]).when(gender == "m", e["m"]).otherwise(e["n"])
    ending = F.when(name.rlike(r"\p{IsCyrillic}"), by_gender(ENDINGS["cyrillic"])).otherwise(by_gender(ENDINGS["latin"]))
    extra = F.lit(max(0, attempt - 5))
    given = F.concat(gender, F.lit(":"), F.lower(_name(name, digest, 1, ending, extra)))
    surname = F.lower(_name(canon, digest, 9, F.when(canon.rlike(r"\p{IsCyrillic}"), ENDINGS["cyrillic"]["m"]).otherwise(""), extra))
    code = F.greatest(F.length(canon) - 10, F.lit(0))  # a phone number's country code stays
    phone = F.concat(F.substring(canon, F.lit(1), code), _shaped(F.substring(canon, code + 1, F.length(canon)), digest))
    return F.when(kind == "mailbox", mailbox).when(kind == "domain", domain).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "card", F.when(_luhn(canon) == 0, checked).otherwise(card)).when(kind == "iban", iban).when(kind == "given", given).when(kind == "surname", surname).otherwise(_shaped(canon, digest))


def rendered(kind: Column, mention: Column, core: Column, gender: Column) -> Column:
    """The surrogate in the form of the mention: separators, spaces, country code, capitals of an address and the gender of a surname stay."""
    chars = F.split(mention, "")
    n = F.length(core)

    def fill(pattern: str) -> Column:
        of = F.transform(chars, lambda c: c.rlike(pattern).cast("int"))  # counted from the right
        total = F.aggregate(of, F.lit(0), lambda a, x: a + x)
        start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))

        def step(acc: Column, c: Column) -> Column:
            hit = c.rlike(pattern)
            at = n - total + acc["n"]
            return F.struct(F.concat(acc["s"], F.when(hit & (at >= 0), F.substring(core, at + 1, F.lit(1))).otherwise(c)).alias("s"), (acc["n"] + hit.cast("int")).alias("n"))

        return F.aggregate(chars, start, step, lambda acc: acc["s"])

    feminine = core.rlike(r"\p{IsCyrillic}") & ((gender == "f") | F.lower(mention).rlike(FEMININE))
    surname = F.concat(F.initcap(core), F.when(feminine, "а").otherwise(""))
    capitals = (mention == F.upper(mention)) & (mention != F.lower(mention))
    address = F.when(capitals, F.upper(core)).otherwise(core)
    own = (
        F.when(kind.isin("phone", "card", "ssn"), fill("[0-9]")).when(kind == "iban", fill("[A-Z0-9]")).when(kind == "given", F.initcap(F.substring(core, F.lit(3), n))).when(kind == "surname", surname)
        .when(kind.isin("mailbox", "domain"), address).otherwise(core)
    )
    return F.when(kind == "keep", mention).when(core.rlike("^x[0-9a-f]{20}$"), core).otherwise(own)


def assign_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """kind, canon and core: a surrogate for each of the distinct entities, none of them twice, none a real entity."""
    pending = entities = checkpoint(entities.distinct())
    done: DataFrame | None = None
    attempt = 0
    while not pending.isEmpty():
        drawn = pending.withColumn("core", surrogate(F.col("kind"), F.col("canon"), secret, attempt))
        taken = entities.select("kind", F.col("canon").alias("core"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "core"))
        free = drawn.join(taken, ["kind", "core"], "left_anti")
        fixed = checkpoint(free.groupBy("kind", "core").agg(F.min("canon").alias("canon")).select("kind", "canon", "core"))
        pending = checkpoint(pending.join(fixed, ["kind", "canon"], "left_anti"))
        done = fixed if done is None else done.unionByName(fixed)
        attempt += 1
    return done if done is not None else entities.withColumn("core", F.lit(""))


def _pattern(names: Column) -> Column:
    """ANY and, if a document has names, their words; of two words that begin alike the longer one comes first."""
    words = F.array_join(F.sort_array(F.array_distinct(F.transform(F.coalesce(names, F.array().cast(_NAMES)), lambda x: x["mention"])), asc=False), "|")
    also = lambda w: F.concat(F.lit(rf"{ANY}|(?<!\p{{L}})(?:"), w, F.lit(r")(?!\p{L})"))
    return F.get(F.transform(F.array(words), lambda w: F.when(w == "", F.lit(ANY)).otherwise(also(w))), F.lit(0))


def replace_private_data(docs: DataFrame, secret: str = "tickwarden", count: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts; ``count`` names a column for the number of mentions. Other columns may have any names."""
    names, docs = [*docs.columns, *([count] if count else [])], aside(docs, "__pii")
    found = F.col("text").isNotNull() & F.col("text").rlike(MAYBE) & F.col("text").rlike(ANY)
    clean = docs.where(~found).withColumns({count: F.lit(0)} if count else {})
    hits = docs.where(found).withColumn("__pii_key", text_key()).withColumn("__pii_names", F.when(F.col("text").rlike(PERSON), names_in(F.col("text"), secret)))
    mentions = hits.select("__pii_key", "__pii_names", F.regexp_extract_all("text", _pattern(F.col("__pii_names")), F.lit(0)).alias("m")).dropDuplicates(["__pii_key"])
    mentions = mentions.select("__pii_key", "__pii_names", F.posexplode("m").alias("at", "mention"))
    mentions = mentions.withColumn("parts", parts_of(kind_of(F.col("mention")), F.col("mention"), F.col("__pii_names"), secret))
    mentions = checkpoint(mentions.select("__pii_key", "at", F.posexplode("parts").alias("part", "entity")).select("__pii_key", "at", "part", "entity.*"))
    named = F.col("kind") != "keep"
    known = assign_surrogates(mentions.where(named).select("kind", "canon"), secret)
    cored = mentions.where(named).join(known, ["kind", "canon"]).unionByName(mentions.where(~named).withColumn("core", F.lit("")))
    part = F.struct("part", F.concat(rendered(F.col("kind"), F.col("mention"), F.col("core"), F.col("gender")), F.col("after")).alias("by"))
    by = cored.groupBy("__pii_key", "at").agg(F.array_join(F.array_sort(F.collect_list(part))["by"], "").alias("by"))  # the parts of one mention
    texts = by.groupBy("__pii_key").agg(F.array_sort(F.collect_list(F.struct("at", "by")))["by"].alias("__pii_by"))
    whole = F.array_join(F.transform(F.arrays_zip(F.split("text", _pattern(F.col("__pii_names")), -1).alias("part"), F.col("__pii_by").alias("by")), lambda x: F.concat(x["part"], F.coalesce(x["by"], F.lit("")))), "")
    changed = hits.join(texts, "__pii_key")
    out = changed.select(*(whole.alias("text") if c == "text" else F.col(c) for c in docs.columns), *([F.size("__pii_by").alias(count)] if count else []))
    return clean.unionByName(out).toDF(*names)
