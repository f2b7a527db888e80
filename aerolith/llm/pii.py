"""Surrogates for personal data: keyed, of the same type, format and script, distinct and coreferent.

All of it is DataFrame expressions. One pass of one pattern cuts a text into what is clear and what is
a mention; each mention has a type and a normal form, and equal normal forms share one surrogate everywhere.
Surrogates come from a keyed digest; those that meet another surrogate or any original are drawn
again, and grow when a format has no room left. In the clear parts of a text, names that an honorific has
told there are found again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import fresh, settle, workspace
from aerolith.llm.quality import row_hash

#: Honorifics by the gender that they tell.
HONORIFICS = {
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Sir", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Lady", "Госпожа"),
    "n": ("Dr", "Prof"),
}
#: Given names for surrogates, by script and gender.
GIVEN = {
    ("latin", "m"): ("Albert", "Bruno", "Conrad", "Dario", "Edgar", "Felix", "Gregor", "Hugo"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna"),
    ("latin", "n"): ("Alex", "Charlie", "Jamie", "Kim", "Robin", "Sam", "Taylor", "Toni"),
    ("cyrillic", "m"): ("Борис", "Виктор", "Глеб", "Денис", "Иван", "Максим", "Олег", "Фёдор"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Юлия"),
    ("cyrillic", "n"): ("Женя", "Саша", "Валя", "Слава"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Πέτρος", "Σταύρος"),
    ("greek", "f"): ("Ελένη", "Μαρία", "Σοφία", "Χριστίνα"),
    ("greek", "n"): ("Φάνη", "Ζωή"),
}
#: Letters that family names are put together from.
FAMILY = {"latin": (tuple("bdfgklmnprstvwz"), tuple("aeiou")), "cyrillic": (tuple("бвгдзклмнпрст"), tuple("аеиоу")), "greek": (tuple("βγδζκλμνπρστφχ"), tuple("αειο"))}
#: Scripts by a class of Java's patterns: the first of a run of letters, and how many there are.
SCRIPTS = {
    "IsCyrillic": (0x430, 32), "IsGreek": (0x3B1, 17), "IsHan": (0x4E00, 20_000), "IsHiragana": (0x3042, 82), "IsKatakana": (0x30A2, 82), "IsHangul": (0xAC00, 11_172), "IsArabic": (0x628, 19),
    "IsHebrew": (0x5D0, 27), "IsDevanagari": (0x915, 37), "IsThai": (0xE01, 46), "IsArmenian": (0x561, 38), "IsGeorgian": (0x10D0, 33),
}
#: Countries whose account numbers are IBANs.
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK".split()

LOCAL = r"[\p{L}\p{M}\p{N}._%+\-]"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A capitalised word, with an apostrophe before a capital only (so no possessive), or a few letters of a script without case.
NAME_WORD = r"(?:\p{Lu}(?:[\p{L}\p{M}\-]|['’](?=\p{Lu}))+|[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]{1,6}+)"
#: What may stand before a word of a name: lower-case particles and initials.
PARTICLE = r"(?:van(?: de[rn]?)?|von(?: und zu| de[rmn])?|de(?: l[ao]s?)?|del|della|dei|di|da|dos?|du|ter|ten|bin|ibn|al|el|y)"
BEFORE = rf"(?:(?:{PARTICLE}|\p{{Lu}}\.?) )*+"
TITLES = [x for v in HONORIFICS.values() for x in v]
HEX = "[0-9a-fA-F]{1,4}"
IP6 = rf"{HEX}(?::{HEX}){{7}}|(?=[0-9a-fA-F:]*\d)(?:{HEX}(?::{HEX}){{0,6}}::(?:{HEX}(?::{HEX}){{0,6}})?|::{HEX}(?::{HEX}){{1,6}})"
#: What counts as a mention, the first that fits; each starts where no longer one could.
PATTERNS = {
    "email": rf"(?<!{LOCAL}){LOCAL}++@[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+)+",
    "hex": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(IBAN_COUNTRIES)})\d{{2}}(?=(?: ?[A-Z]*\d){{10}})(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:{IP6})(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d.\-])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{1,7}(?![\d\-])",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.? {BEFORE}{NAME_WORD}(?: {BEFORE}{NAME_WORD})*+",
    # among capitals only, two words are taken for the name: where it ends cannot be seen
    "shouted": rf"(?<![\p{{L}}])(?:{'|'.join(x.upper() for x in TITLES)})\.? (?:\p{{Lu}}\.? )?[\p{{Lu}}\-]{{2,}}+(?: [\p{{Lu}}\-]{{2,}}+)?(?![\p{{L}}])",
}
INITIALS = "".join(sorted({x[0] for x in TITLES}))
#: What a mention starts with, looked at before anything else.
STARTS = {"hex": "[0-9a-fA-F]", "iban": "[A-Z]{2}[0-9]", "ip6": "[0-9a-fA-F]{0,4}:", "ip": "[0-9]", "phone": "[0-9(+]", "ssn": "[0-9]", "card": "[0-9]", "name": f"[{INITIALS}]", "shouted": rf"[{INITIALS}]\p{{Lu}}"}
#: A text without a digit, an @ or one of these holds no mention.
TITLED = rf"(?=[{INITIALS}])(?:{'|'.join(TITLES + [x.upper() for x in TITLES])})\.? (?:\p{{Lu}}|\p{{Lo}}|{PARTICLE} )"
#: A code point that is no character: it stands around mentions while a text is cut.
MARK = "\ufdd0"


def any_pattern(digits: bool = True, at: bool = True) -> str:
    """All that may be a mention in a text with (or without) digits and @."""
    kinds = [k for k in PATTERNS if (at or k != "email") and (digits or k in ("email", "name", "shouted"))]
    return "|".join(f"(?={STARTS[k]})(?:{PATTERNS[k]})" if k in STARTS else f"(?:{PATTERNS[k]})" for k in kinds)


def has_digits(text: Column) -> Column:
    return text.rlike("[0-9]")


def kind_of(m: Column) -> Column:
    """Type of a mention that the common pattern has found."""
    kind = F.when(m.contains("@"), "email").when(m.rlike(r"^[0-9a-fA-F]{32,}$"), "hex").when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
    kind = kind.when(m.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F]*:[0-9a-fA-F:]*$"), "ip6").when(m.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]"), "iban")
    kind = kind.when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(m.rlike(r"^\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}$"), "card")
    kind = kind.when(m.startswith("+"), "phone_intl").when(m.rlike(r"^[(\d]"), "phone")
    for gender, titles in HONORIFICS.items():
        kind = kind.when(m.rlike(rf"(?iu)^(?:{'|'.join(titles)})\.? "), f"name_{gender}")
    return kind


def merged(kind: Column) -> Column:
    """Names are one kind whatever gender their honorific tells."""
    return F.when(kind.startswith("name"), "name").otherwise(kind)


def bare_name(m: Column) -> Column:
    """A name's mention without its honorific."""
    return F.regexp_replace(m, r"^\S+ ", "")


def normal_form(m: Column, kind: Column) -> Column:
    """What mentions of one thing have in common."""
    return (
        F.when(kind.isin("email", "hex", "ip6"), F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind.startswith("name"), F.lower(bare_name(m)))
        .otherwise(F.regexp_replace(m, r"[^0-9]", ""))
    )


def stream(seed: Column, n: Column) -> Column:
    """At least n bytes of keyed digest as hexadecimal."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.shiftright(n.cast("int"), 5)), lambda j: F.sha2(F.concat_ws("|", seed, j.cast("string")).cast("binary"), 256)), "")


def byte_at(digest: str, i: int | str) -> str:
    """SQL: byte i (from 0) of a hexadecimal digest."""
    return f"CAST(conv(substring({digest}, ({i}) * 2 + 1, 2), 16, 10) AS INT)"


def pick(names: tuple[str, ...], byte: str) -> str:
    """SQL: one of the names, by a byte."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"get(array({listed}), {byte} % {len(names)})"


def disguised(text: str, digest: str) -> Column:
    """Digits for digits and letters for letters of the same script, all else as it is (columns by their names)."""
    b, other = byte_at(digest, "i"), byte_at(digest, "if(i > 0, i - 1, i + 1)")
    latin = f"substring('abcdefghijklmnopqrstuvwxyz', {b} % 26 + 1, 1)"
    # letters of a run of code points, by two bytes
    far = " ".join(f"WHEN c rlike r'^\\p{{{script}}}$' THEN decode(unhex(lpad(hex({first} + ({b} * 251 + {other}) % {n}), 4, '0')), 'UTF-16BE')" for script, (first, n) in SCRIPTS.items())
    one = f"""CASE WHEN c BETWEEN '0' AND '9' THEN CAST({b} % 10 AS STRING) WHEN c BETWEEN 'a' AND 'z' OR c BETWEEN 'A' AND 'Z' THEN {latin} WHEN c < '\u0080' THEN c
        WHEN c rlike r'^\\p{{IsLatin}}$' THEN {latin} {far} WHEN c rlike r'^\\p{{L}}$' THEN {latin} ELSE c END"""
    return F.expr(f"array_join(transform(split({text}, ''), (c, i) -> {one}), '')")


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes the digits and it valid."""
    step = lambda a, c: F.struct((a["s"] + F.when(a["i"] % 2 == 1, c.cast("int")).when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).alias("s"), (a["i"] + 1).alias("i"))
    total = F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), step, lambda a: a["s"])
    return ((10 - total % 10) % 10).cast("string")


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an account number: 98 less the remainder by 97, letters being 10 to 35."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("^[0-9]$"), 48).otherwise(55)
    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97)
    return F.lpad((98 - left).cast("string"), 2, "0")


def _name(gender: str, extra: int) -> str:
    """SQL: a lower-case name of the script of norm, with a given name if it has more than a word; family names that are the same stay so.

    _g and _f are digests of its first and last word, _b is the name disguised.
    """

    def of(script: str) -> str:
        consonants, vowels = FAMILY[script]
        sounds = ", ".join(pick(s, byte_at("_f", 2 * i + j)) for i in range(min(4 + extra, 15)) for j, s in enumerate((consonants, vowels)))
        return f"concat(if(contains(norm, ' '), concat(lower({pick(GIVEN[script, gender], byte_at('_g', 0))}), ' '), ''), {sounds})"

    by_script = " ".join(f"WHEN norm rlike r'^[^\\p{{L}}]*\\p{{Is{script.capitalize()}}}' THEN {of(script)}" for script in FAMILY)
    return f"CASE {by_script} ELSE _b END"


#: Draws before a surrogate grows by a letter, a digit or a syllable, and after which it grows by one more.
ROOM = 6


def surrogates(entities: DataFrame, secret: str, draw: int) -> DataFrame:
    """entities (kind, norm) with shape: the surrogate of a draw, a longer one after every ROOM draws.

    Digests and what is made of them letter by letter are columns of their own, so each is made once.
    """
    kind, norm, extra = F.col("kind"), F.col("norm"), draw // ROOM
    seed = F.concat_ws("|", F.lit(secret), merged(kind), F.lit(str(draw)))
    n = F.char_length(norm)
    at, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    head, top = F.regexp_replace(domain, r"\.[^.]+$", ""), F.substring_index(domain, ".", -1)
    words = F.split(norm, " ")
    # what is disguised: the local part, the account number after its check digits, or all
    body = F.when(kind == "email", F.concat(at, F.repeat(F.regexp_extract(at, r"[\p{L}\d]", 0), F.lit(extra))))
    body = body.when(kind == "iban", F.concat(F.substring(norm, F.lit(5), n), F.lit("0" * extra)))
    body = body.when(kind.startswith("name"), F.concat(norm, F.repeat(F.substring(F.element_at(words, -1), 1, 1), F.lit(extra)))).otherwise(F.concat(norm, F.lit("0" * extra)))
    digest = lambda *parts: F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    df = entities.select("*", stream(F.concat_ws("|", seed, norm), n + extra).alias("_w"), F.when(kind == "email", stream(F.concat_ws("|", F.lit(secret), F.lit("domain"), domain), F.char_length(head))).alias("_d"), digest(seed, F.element_at(words, 1)).alias("_g"), digest(seed, F.element_at(words, -1)).alias("_f"), body.alias("_b"), head.alias("_h"))
    whole = F.col("_w")
    wanted = ~kind.isin("hex", "ip", "ip6") & ~(kind.startswith("name") & norm.rlike(r"^[^\p{L}]*[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"))
    df = df.withColumn("_b", F.lower("_b")).withColumn("_b", F.when(wanted, disguised("_b", "_w"))).withColumn("_h", F.when(kind == "email", disguised("_h", "_d")))
    # a card ends in the digit that makes it valid
    df = df.withColumn("_b", F.when(kind == "card", F.concat(F.substring(norm, 1, 1), F.substring("_b", F.lit(2), n + extra - 2))).when(kind == "iban", F.upper("_b")).otherwise(F.col("_b")))
    body, country, length = F.col("_b"), F.substring(norm, 1, 2), n + extra
    # addresses that are never given out: 240.0.0.0/4; once they are short, any
    octets = [F.expr(byte_at("_w", i)) for i in range(4)]
    octets[0] = octets[0] % 16 + 240 if draw < 4 * ROOM else octets[0] % 255 + 1
    groups = F.concat(F.lit("fd"), F.substring(whole, F.lit(3), n))
    six = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(groups, i + 1, F.lit(1)))), "")
    # a short address has room for few others: it becomes one with more digits
    six = F.when((n >= 10) & F.lit(draw < ROOM), six).otherwise(F.concat(F.lit("fd"), F.substring(whole, 3, 2), *[F.concat(F.lit(":"), F.substring(whole, 5 + 4 * i, 4)) for i in range(min(1 + extra, 5))], F.lit("::"), F.substring(whole, 29, 4)))
    shape = (
        F.when(kind == "email", F.concat(body, F.lit("@"), F.col("_h"), F.lit("."), top))
        .when(kind == "hex", F.substring(whole, F.lit(1), n))
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "ip6", six)
        .when(kind == "iban", F.concat(country, iban_check(country, body), body))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(body, F.lit(2), length)))
        .when(kind == "card", F.concat(body, luhn_digit(body)))
        .when(kind == "phone_intl", F.concat(F.substring(norm, 1, 1), F.substring(body, F.lit(2), length)))
    )
    for gender in HONORIFICS:
        shape = shape.when(kind == f"name_{gender}", F.expr(_name(gender, extra)))
    return df.select("kind", "norm", shape.otherwise(body).alias("shape"))


def name_cased(mention: Column, shape: Column) -> Column:
    return F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(shape)).otherwise(F.initcap(shape))


def rendered(m: Column, kind: Column, shape: Column) -> Column:
    """The surrogate in the format of the mention: its case, or its separators around the digits; what it is longer stands at the end."""
    cased = F.when((F.upper(m) == m) & (F.lower(m) != m), F.upper(shape)).otherwise(shape)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    # an account number has letters among its digits
    slot = lambda c: c.rlike(r"^\d$") | ((kind == "iban") & c.rlike("^[A-Z]$"))

    def step(a: Column, c: Column) -> Column:
        return F.struct(F.concat(a["out"], F.when(slot(c), F.substring(shape, a["k"], F.lit(1))).otherwise(c)).alias("out"), (a["k"] + slot(c).cast("int")).alias("k"))

    filled = F.aggregate(F.split(m, ""), start, step, lambda a: F.concat(a["out"], F.substring(shape, a["k"], F.char_length(shape))))
    named = F.concat(F.regexp_extract(m, r"^\S+ ", 0), name_cased(bare_name(m), shape))
    return F.when(kind.isin("email", "hex", "ip6"), cased).when(kind == "ip", shape).when(kind.startswith("name"), named).otherwise(filled)


def surrogate_table(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, norm) with a surrogate each: no two share one in a kind, none is any entity's own normal form.

    Draws go on until all have one; as they grow longer, a few more rounds serve any number of entities.
    """
    entities = settle(entities.select("kind", "norm").distinct())
    family = F.regexp_replace("kind", "_.*$", "")
    originals = entities.select(family.alias("family"), F.col("norm").alias("shape")).distinct()
    open_, done, draw = entities, None, 0
    while True:
        drawn = settle(surrogates(open_, secret, draw).withColumn("family", family))
        free = drawn.join(originals, ["family", "shape"], "left_anti")
        if done is not None:
            free = free.join(done.select("family", "shape"), ["family", "shape"], "left_anti")
        # the least entity keeps a surrogate that several have drawn
        won = free.groupBy("family", "shape").agg(F.min(F.struct("kind", "norm")).alias("e")).select("family", "shape", F.col("e.kind").alias("kind"), F.col("e.norm").alias("norm"))
        done = settle(won if done is None else done.unionByName(won))
        open_ = settle(entities.join(done.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if open_.isEmpty():
            return done.select("kind", "norm", "shape")
        draw += 1


def cut(text: Column) -> Column:
    """A text as clear parts and mentions by turns, clear ones at both ends, by one pass of the pattern that it needs."""

    def one(pattern: str) -> Column:
        return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    # a text that holds the mark itself is cut in two passes
    pattern = any_pattern()
    pieces, found = F.split(text, pattern, -1), F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    slow = F.flatten(F.zip_with(pieces, found, lambda a, b: F.array(a, b)))
    out = F.when(text.contains(MARK), F.slice(slow, F.lit(1), F.size(slow) - 1)).when(text.contains("@"), one(pattern))
    return out.when(has_digits(text), one(any_pattern(at=False))).otherwise(one(any_pattern(False, False)))


def _turns(parts: Column, odd: bool) -> Column:
    """Mentions (odd) or clear parts of a cut text."""
    return F.filter(parts, lambda _, i: i % 2 == int(odd))


def replace_entities(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with surrogates in the text, and a column n_entities (mentions replaced, long).

    Other columns stay. Null texts stay null and hold no mentions. Repeated rows are rewritten alike.
    An empty table gives an empty result. The same secret gives the same surrogates
    (unless new originals take one up, or new mentions of a name tell another gender).
    A name is one entity under all its honorifics, in any case; its gender is the one they tell. Where a text
    names somebody with an honorific, the whole name and its last word are replaced in the rest of the text too.
    """
    h, parts, swaps, own, count = fresh(docs, "_row", "_parts", "_swaps", "_own", "n_entities")
    gated = F.coalesce(docs[text].contains("@") | has_digits(docs[text]) | docs[text].rlike(TITLED), F.lit(False))
    held = docs.where(gated).withColumn(h, row_hash(docs[key], docs[text])).withColumn(parts, cut(docs[text])).drop(text)
    # written, so that the pattern runs once over each text
    path = workspace(docs.sparkSession, "cut")
    held.toDF(*[f"c{i}" for i in range(len(held.columns))]).write.mode("overwrite").parquet(path)
    held = docs.sparkSession.read.parquet(path).toDF(*held.columns)
    mentions = held.select(F.col(h).alias("row"), F.explode(F.array_distinct(_turns(F.col(parts), True))).alias("m"))
    mentions = settle(mentions.distinct().withColumn("kind", kind_of(F.col("m"))).withColumn("norm", normal_form(F.col("m"), F.col("kind"))))
    # a name's mentions tell one gender, or none or both: then it is neutral
    told = mentions.groupBy(merged(F.col("kind")).alias("kind"), "norm").agg(F.bool_or(F.col("kind") == "name_m").alias("m"), F.bool_or(F.col("kind") == "name_f").alias("f"))
    kind = F.when(F.col("kind") != "name", F.col("kind")).when(F.col("m") & ~F.col("f"), "name_m").when(F.col("f") & ~F.col("m"), "name_f").otherwise("name_n")
    table = surrogate_table(told.select(kind.alias("kind"), "norm"), secret).withColumn("kind", merged(F.col("kind")))
    mentions = settle(mentions.withColumn("kind", merged(F.col("kind"))).join(table, ["kind", "norm"]))
    swapped = mentions.select("row", "m", rendered(F.col("m"), F.col("kind"), F.col("shape")).alias("s"))
    # names without their honorific: whole, and the last word, as they stand there and in capitals
    name, last = bare_name(F.col("m")), F.element_at(F.split(bare_name(F.col("m")), " "), -1)
    family = F.element_at(F.split("shape", " "), -1)
    bare = mentions.where("kind = 'name'").select("row", F.explode(F.array(*[F.struct(v.alias("m"), x.alias("shape")) for f in (lambda c: c, F.upper) for v, x in ((f(name), F.col("shape")), (f(last), family))])).alias("v")).select("row", "v.*")
    bare = bare.where(F.char_length("m") > 2).groupBy("row", "m").agg(F.min("shape").alias("shape"))
    bare = bare.select("row", "m", name_cased(F.col("m"), F.col("shape")).alias("s"))
    longest = F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct(F.char_length("m").alias("n"), "m")))), lambda x: F.concat(F.lit(r"\Q"), x["m"], F.lit(r"\E"))), "|")
    again = bare.groupBy("row").agg(F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), longest, F.lit(r")(?![\p{L}\p{M}\p{N}])")).alias(own))
    by_row = swapped.unionByName(bare).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("m", "s"))).alias(swaps)).join(again, "row", "left").withColumnRenamed("row", h)
    joined = held.join(by_row, h, "left")
    finer = F.flatten(F.transform(parts, lambda p, i: F.when((i % 2 == 0) & ~p.contains(MARK), F.split(F.regexp_replace(p, F.col(own), F.lit(f"{MARK}$0{MARK}")), MARK, -1)).otherwise(F.array(p))))
    joined = joined.withColumn(parts, F.when(F.col(own).isNotNull(), finer).otherwise(F.col(parts)))
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.col(swaps)[p], p)).otherwise(p)), "")
    rewritten = joined.withColumn(text, F.when(F.col(swaps).isNull(), F.array_join(parts, "")).otherwise(whole)).withColumn(count, F.expr(f"size(`{parts}`) div 2").cast("long"))
    untouched = docs.where(~gated).withColumn(count, F.lit(0).cast("long"))
    return rewritten.select(*docs.columns, count).unionByName(untouched)
