"""Personal data replaced by keyed surrogates, with DataFrame expressions only.

Entities are found by one pattern, and put in a normal form that is the same however an entity
is written.  Every distinct (kind, normal form) gets a surrogate from a keyed digest: digits for
digits, letters of the same script, case and place, addresses for addresses, names of the same
gender.  Spark checks that no two normal forms of a kind share a surrogate and that none equals a
real one; those that collide are drawn again.  Texts are then put together from the pieces between the
entities and the surrogates in the entity's own format.  Only texts with an entity are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.llm.common import store

# Words that announce a secret, and forms of address by gender.
SECRET_WORDS = "api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd|auth"
MALE = ("Mr", "Herr", "Herrn", "Sr", "Señor", "Monsieur", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof")
# Small words inside family names.
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "zu", "bin", "ibn", "al", "el", "y", "e")
#: One word of a name: McDonald, Anne-Marie, O'Neil, D’Arcy; an initial only before a further word.
NAME_WORD = r"(?:\p{Lu}\.(?= \p{L})|\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+)"

#: Kind -> pattern, tried in this order at each place.  No pattern holds a capturing group.
KINDS: dict[str, str] = {
    "secret": rf"(?i:\b(?:{SECRET_WORDS})\b[\"']?\s{{0,3}}[:=]\s{{0,3}}(?:\"[^\"\n]{{6,}}+\"|'[^'\n]{{6,}}+'|[A-Za-z0-9_\-+/=.]{{8,}}+))"
              r"|\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})\b"
              r"|(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "mac": r"(?<![\p{L}\p{N}:])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\p{L}\p{N}:])",
    # Eight groups, or fewer with one gap and a digit: words around a double colon are names in program text.
    "ipv6": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
            r"|(?=[A-Fa-f:]*+[0-9])(?!(?:[0-9A-Fa-f]{0,4}:){9})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?"
            r"|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}))(?![\p{L}\p{N}:]|\.[0-9])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    # With a country's number; 3-3-4; pairs after a zero; an area with a zero and blocks of three to eight.
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
             r"|0[1-9](?:[ .-][0-9]{2}){4}|(?:0[1-9][0-9]{1,4}[ /-]|\(0[1-9][0-9]{0,4}\) ?)[0-9]{3,8}(?:[ -][0-9]{2,6}){0,3})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.-])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5})(?![\p{L}\p{N}])",
    "name": rf"\b(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\b\.? {NAME_WORD}(?: (?:(?:{'|'.join(PARTICLES)}) )*+{NAME_WORD})*+",
}
PATTERN = "|".join(KINDS.values())
#: Forms of address of which no other one is the beginning.
STEMS = tuple(t for t in MALE + FEMALE + NEUTRAL if not any(t != o and t.startswith(o) for o in MALE + FEMALE + NEUTRAL))

#: Beginnings of keys that may hold neither a digit nor a sign.
KEY_HEADS = ("AKIA", "ghp_", "sk-", "xox")

# Letters to draw from, by what they replace.
DIGITS, SMALL, LARGE, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdef"
SCRIPTS = {
    r"^[à-öø-ÿ]": "àâäçèéêëîïôöùûüñáíóú", r"^[À-ÖØ-Þ]": "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜÑÁÍÓÚ", r"^[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", r"^[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    r"^[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω", r"^[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"^\p{IsHan}": "山川田中村木林森石井上下大小高松竹梅花星空海河湖天地人日月水火土金",
    r"^\p{IsArabic}": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"^\p{IsHebrew}": "אבגדהוזחטיכלמנסעפצקרשת",
}
SYLLABLES = {"Latin": "ba be bo da de do fa fe ga go ka ke ko la le li lo ma me mi mo na ne no ra re ri ro sa se ta to".split(),
             "Cyrillic": "ба бе бо да де до фа фе га го ка ке ко ла ле ли ло ма ме ми мо на не но ра ре ри ро са се та то".split()}
ENDINGS = {"Latin": {"m": ["n", "s", "r", "k"], "f": ["a", "ia", "ina", "ella"], "n": ["l", "m"]},
           "Cyrillic": {"m": ["н", "с", "р", "к"], "f": ["а", "ия", "ина", "елла"], "n": ["л", "м"]}}
ROUNDS = 40


def is_kind(entity: Column) -> Column:
    """The kind whose pattern the whole entity matches, the first in order."""
    tests = [(k, entity.rlike(f"^(?:{p})$")) for k, p in KINDS.items()]
    out = F.when(tests[0][1], tests[0][0])
    for kind, test in tests[1:]:
        out = out.when(test, kind)
    return out.otherwise("secret")


def may_hold(text: Column) -> Column:
    """False where a text has none of the characters or forms of address that an entity needs: cheap plain searches."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in STEMS + KEY_HEADS], text.rlike("[0-9@:=]"))


SECRET_HEAD = rf"(?is)^((?:(?:{SECRET_WORDS})[\"']?\s{{0,3}}[:=]\s{{0,3}})?[\"']?)(.*?)([\"']?)$"
TITLE = rf"^((?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? )(.*)$"


def gender(entity: Column) -> Column:
    starts = lambda words: entity.rlike(rf"^(?:{'|'.join(words)})\b")
    return F.when(starts(MALE), "m").when(starts(FEMALE), "f").otherwise("n")


def all_groups(address: Column) -> Column:
    """An IPv6 address in lower case with its eight groups, without zeros before them."""
    side = lambda k: F.filter(F.split(F.coalesce(F.get(F.split(F.lower(address), "::"), F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(side(0)) - F.size(side(1))))
    return F.array_join(F.transform(F.concat(side(0), gap, side(1)), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def normal_form(kind: Column, entity: Column) -> Column:
    """The same for all spellings of an entity: digits only, lower case, without quotes, spaces or form of address."""
    value = F.regexp_extract(entity, SECRET_HEAD, 2)
    country = F.regexp_extract(entity, r"^\+([0-9]{1,3})(?=[ .(-])", 1)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (F.when(kind.isin("ssn", "card"), digits)
            .when(kind == "phone", F.concat(F.when(country != "", F.concat(F.lit("+"), country, F.lit(" "))).otherwise(""),
                                            F.substring(digits, F.length(country) + 1, F.length(digits))))
            .when(kind == "secret", F.when(value.rlike("^[0-9A-Fa-f]+$"), F.lower(value)).otherwise(value))
            .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
            .when(kind == "name", F.concat(gender(entity), F.lit(" "), F.lower(F.regexp_extract(entity, TITLE, 2))))
            .when(kind == "mac", F.replace(F.lower(entity), F.lit("-"), F.lit(":")))
            .when(kind == "ipv6", all_groups(entity))
            .otherwise(F.lower(entity)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it inside other functions."""
    return F.transform(F.array(value), use)[0]


def noise(seed: Column, length: Column) -> Column:
    """An array of at least ``length`` bytes (0 to 255) that a keyed digest gives."""
    # Block by block, as a place in a long string is found by counting from its start.
    block = lambda s, k: bound(F.sha2(F.concat(s, F.lit("|"), k.cast("string")).cast("binary"), 512), lambda h: F.transform(
        F.sequence(F.lit(0), F.least(F.lit(63), length - k * 64)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return bound(seed, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(length / 64).cast("int")), lambda k: block(s, k))))


def pick(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))


def redrawn(value: Column, seed: Column, hexadecimal: Column | bool = False) -> Column:
    """Every digit, letter and letter of a known script replaced by one of its sort; all else stays."""
    small = F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal

    def one(c: Column, b: Column) -> Column:
        out = F.when(c.rlike("^[0-9]"), pick(DIGITS, b)).when(c.rlike("^[a-z]"), F.when(small, pick(HEX, b)).otherwise(pick(SMALL, b)))
        out = out.when(c.rlike("^[A-Z]"), pick(LARGE, b))
        for script, alphabet in SCRIPTS.items():
            out = out.when(c.rlike(script), pick(alphabet, b))
        return out.otherwise(c)

    # The array of bytes is the longer one; where no letter is left there is nothing to write.
    return F.array_join(F.zip_with(F.split(value, ""), noise(seed, F.length(value)), lambda c, b: F.when(c.isNotNull(), one(c, b))), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits as the card check takes them: every second from the right is doubled."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)


def mod_97(account: Column) -> Column:
    """An account number as the check of its country takes it: the first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    code = F.filter(F.transform(F.split(moved, ""), lambda c: F.when(c != "", F.ascii(c))), lambda c: c.isNotNull())
    return F.aggregate(code, F.lit(0), lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))


def invented_name(norm: Column, seed: Column) -> Column:
    """As many words as the name has: given names with an ending of its gender, and a family name that hangs on the family
    name alone.  Initials stay initials, particles stay."""
    words = F.split(F.substring(norm, F.lit(3), F.length(norm)), " ")
    sex = F.substring(norm, F.lit(1), F.lit(1))
    attempt = F.substring_index(seed, "|", -1)
    family_seed = F.concat(F.split(seed, "\\|", 2)[0], F.lit("|family|"), F.element_at(words, -1),
                           F.when((F.size(words) == 1) & (attempt != "0"), F.concat(F.lit("|"), attempt)).otherwise(""))

    def spoken(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        say = lambda b, n: F.initcap(F.array_join(F.transform(F.slice(b, 1, n), lambda x: F.get(syllables, x % len(SYLLABLES[script]))), ""))
        family = say(noise(family_seed, F.lit(8)), 5)

        def given(b: Column) -> Column:
            end = reduce(lambda out, k: out.when(sex == k, F.get(F.array(*map(F.lit, ENDINGS[script][k])), F.get(b, F.lit(7)) % len(ENDINGS[script][k]))),
                         "mf", F.when(sex == "n", F.get(F.array(*map(F.lit, ENDINGS[script]["n"])), F.get(b, F.lit(7)) % 2)))
            return F.concat(say(b, 3), end)

        def word(w: Column, i: Column) -> Column:
            own = F.concat(seed, F.when(i == 0, "").otherwise(F.concat(F.lit("|"), i.cast("string"))))
            initial = bound(noise(own, F.lit(8)), lambda b: F.concat(F.upper(F.substring(F.get(syllables, F.get(b, F.lit(0)) % len(SYLLABLES[script])), 1, 1)), F.lit(".")))
            return F.when(w.isin(*PARTICLES), w).when(w.endswith("."), initial).otherwise(bound(noise(own, F.lit(8)), given))

        return F.array_join(F.concat(F.transform(F.slice(words, F.lit(1), F.size(words) - 1), word), F.array(family)), " ")

    return F.when(norm.rlike(r"[\u0400-\u04ff]"), spoken("Cyrillic")).otherwise(spoken("Latin"))


def surrogate(kind: Column, norm: Column, key: str, attempt: int) -> Column:
    """The normal form of the replacement; ``attempt`` draws anew."""
    secret = F.sha2(F.lit(key).cast("binary"), 256)
    seed = F.concat(secret, F.lit("|"), kind, F.lit("|"), norm, F.lit(f"|{attempt}"))
    domain = F.substring_index(norm, "@", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)) - 1)
    email = F.concat(redrawn(F.substring_index(norm, "@", 1), seed), F.lit("@"),
                     redrawn(labels, F.concat(secret, F.lit("|domain|"), domain)), F.lit(".example"))
    ip = F.array_join(F.transform(F.slice(noise(seed, F.lit(4)), 1, 4), lambda b: (b % 254 + 1).cast("string")), ".")
    country = F.regexp_extract(norm, r"^(\+[0-9]+ )?", 1)
    phone = F.concat(country, redrawn(F.substring(norm, F.length(country) + 1, F.length(norm)), seed))
    drawn = F.concat(F.substring(norm, F.lit(1), F.lit(1)), redrawn(F.substring(norm, F.lit(2), F.length(norm)), seed))
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(luhn_sum(norm) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(drawn)
    land = F.substring(norm, F.lit(1), F.lit(2))

    def checked(rest: Column) -> Column:
        digits = F.lpad((98 - mod_97(F.concat(land, F.lit("00"), F.substring(rest, F.lit(3), F.length(rest))))).cast("string"), 2, "0")
        return F.concat(land, F.when(mod_97(norm) == 1, digits).otherwise(F.substring(rest, F.lit(1), F.lit(2))), F.substring(rest, F.lit(3), F.length(rest)))

    iban = bound(redrawn(F.substring(norm, F.lit(3), F.length(norm)), seed), checked)
    hexadecimal = kind.isin("mac", "ipv6") | (kind == "secret") & norm.rlike("^[0-9a-f]+$")
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "iban", iban).when(kind == "name", invented_name(norm, seed)).otherwise(redrawn(norm, seed, hexadecimal)))


def in_format(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate written as the entity was: its spaces, brackets, quotes, form of address and capitals."""
    shown = F.when(kind == "phone", F.regexp_replace(made, "[^0-9]", "")).otherwise(made)
    place = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    filled = bound(shown, lambda s: F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(
        c.rlike(r"^[\p{L}\p{N}]"), F.substring(s, place(i), F.lit(1))).otherwise(c)), ""))
    value = F.regexp_extract(entity, SECRET_HEAD, 2)
    large = lambda of: (of == F.upper(of)) & (of != F.lower(of))
    secret = F.concat(F.regexp_extract(entity, SECRET_HEAD, 1), F.when(large(value) & value.rlike("^[0-9A-F]+$"), F.upper(made)).otherwise(made),
                      F.regexp_extract(entity, SECRET_HEAD, 3))
    return (F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "secret", secret)
            .when(kind == "name", F.concat(F.regexp_extract(entity, TITLE, 1), F.when(large(F.regexp_extract(entity, TITLE, 2)) & (F.length(F.regexp_extract(entity, TITLE, 2)) > 1), F.upper(made)).otherwise(made)))
            .when(kind == "mac", F.when(large(entity), F.upper(F.replace(made, F.lit(":"), F.substring(entity, 3, 1)))).otherwise(F.replace(made, F.lit(":"), F.substring(entity, 3, 1))))
            .when(large(entity), F.upper(made)).otherwise(made))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, code (hash of the text), at (number of the entity in its text), kind, entity, norm."""
    text = F.col(text_col)
    found = docs.where(may_hold(text)).select(F.col(id_col).cast("string").alias("doc"), F.xxhash64(text).alias("code"),
                                                  F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("at", "entity"))
    return found.withColumn("kind", is_kind(F.col("entity"))).withColumn("norm", normal_form(F.col("kind"), F.col("entity")))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, norm, made: one surrogate for each distinct normal form, distinct in its kind and unlike any real one."""
    open_ = store(found.select("kind", "norm").distinct(), "entities")
    real = open_.select("kind", F.col("norm").alias("made"))
    settled: DataFrame | None = None
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # drawing is the work here, so it is spread
    for attempt in range(ROUNDS):
        drawn = open_.repartition(tasks).withColumn("made", surrogate(F.col("kind"), F.col("norm"), key, attempt))
        taken = real if settled is None else real.unionByName(settled.select("kind", "made"))
        first = F.row_number().over(Window.partitionBy("kind", "made").orderBy("norm")) == 1
        clash = drawn.withColumn("first", first).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "made"], "left")
        judged = store(clash.select("kind", "norm", "made", (F.col("first") & F.col("taken").isNull()).alias("good")), "surrogates")
        good = judged.where("good").drop("good")
        settled = good if settled is None else settled.unionByName(good)
        open_ = judged.where("not good").select("kind", "norm")
        if open_.isEmpty():
            return settled
    raise RuntimeError("some kinds of entity have too few free surrogates")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All rows and columns with personal data in the text replaced; ``count_col`` adds the number of replacements.

    The same entity becomes the same surrogate in every row, whatever its spelling, and different
    entities different ones.  Texts, addresses and names of any length are read whole.  Null and empty texts stay; rows repeated with the same id and text get
    the same result; ids may be null or repeated with other texts.  An empty table gives no rows.
    ``text_col`` must be a column; all others pass through untouched, whatever their names.
    """
    names = docs.columns
    found = store(entities(docs, id_col, text_col), "found")
    made = surrogates(found, key)
    written = found.join(made, ["kind", "norm"]).groupBy("doc", "code").agg(
        F.array_sort(F.collect_set(F.struct("at", in_format(F.col("kind"), F.col("entity"), F.col("made")).alias("new")))).alias("new"))
    text = F.col(text_col)
    touched = F.coalesce(may_hold(text) & text.rlike(PATTERN), F.lit(False))
    n = [] if count_col is None else [F.lit(0).cast("long").alias(count_col)]
    clean = docs.where(~touched).select(*names, *n)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.where(touched).select(row.alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.xxhash64(text).alias("code"))
    written = written.withColumn("doc", F.coalesce("doc", F.lit("")))
    both = keyed.join(written, ["doc", "code"])
    pieces = F.split(F.col("row")[text_col], PATTERN, -1)
    whole = F.array_join(F.zip_with(pieces, "new", lambda p, s: F.concat(p, F.coalesce(s["new"], F.lit("")))), "")
    dirty = both.select(*[whole.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names],
                        *([] if count_col is None else [F.size("new").cast("long").alias(count_col)]))
    return clean.unionByName(dirty)
