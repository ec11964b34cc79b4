"""Surrogates for personal data (DataFrame functions only).

Entities are found by patterns in whole texts; full names that stand with a title or a common
given name anywhere in the corpus are found without one too. Every distinct part of an entity
(a family name, a given name, a host, a number) gets a replacement from an HMAC under the
caller's key, of its own type, format, script and, for given names, gender. The same part is
replaced alike wherever it stands, two parts never get the same replacement, and none gets
what is itself one of the corpus: collisions are found by aggregates and drawn again, longer
each time, so drawing ends.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

#: Titles by gender; fixed values.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
NEUTRAL = ("Dr", "Prof", "Mx")
#: Common given names by gender; fixed values. With a family name after them they need no title.
MALE_GIVEN = (
    "Alexander Andrew Anthony Antonio Brian Carlos Charles Christopher Daniel David Dmitri Donald Edward Fernando François Frank George Hans Henry Ivan "
    "James Jean Johann John Jorge Joseph José Juan Jürgen Kenneth Klaus Luis Manuel Matthew Michael Miguel Mohammed Nicolas Paul Pedro Peter Philippe "
    "Pierre Richard Robert Sergei Stefan Steven Thomas Vladimir Walter William Wolfgang Иван Сергей Дмитрий Николай Владимир"
).split()
FEMALE_GIVEN = (
    "Anna Barbara Carmen Catherine Charlotte Christine Claudia Deborah Elena Elizabeth Emily Emma Fatima Françoise Gabriele Helen Irina Isabel Jennifer "
    "Jessica Julia Karen Katharina Laura Linda Lisa Lucia Margaret Maria Marie Mary Michelle Monika Nancy Natalia Nathalie Olga Patricia Petra Pilar "
    "Rebecca Sabine Sandra Sarah Sophie Susan Svetlana Tatiana Ursula Анна Елена Мария Ольга Татьяна"
).split()
TITLE = f"(?:{'|'.join(x for t in (*MALE, *FEMALE, *NEUTRAL) for x in (t, t.upper()) if x not in ('DON', 'MS', 'SR', 'MX'))})\\.?"
WORD = "\\p{Lu}[\\p{L}'’-]*\\p{L}"
#: What may stand between the first and the last word of a name, and stays where it is but for an initial's letter; fixed values.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "bin", "ibn")
INITIAL = "\\p{Lu}\\."
BETWEEN = f"(?:{INITIAL}|{'|'.join(PARTICLES)})"
#: In lower case, a word of a name that is no part to replace.
NO_PART = f"^(?:\\p{{L}}\\.|{'|'.join(PARTICLES)})$"
START, END = "(?<![\\p{L}\\p{N}])", "(?![\\p{L}\\p{N}])"
HEX = "[0-9A-Fa-f]{1,4}"
#: Patterns by type, in the order in which they are tried. Fixed values.
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++@(?:[\\p{L}\\p{N}-]+\\.)+\\p{L}{2,}+",
    "iban": f"{START}[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{END}",
    "phone": "(?<![\\p{L}\\p{N}+])(?:(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\)|\\d{2,4})[ .-]\\d{3,4}[ .-]\\d{3,4}|\\+\\d{1,3}[ .-]?(?:\\(\\d{1,4}\\)|\\d{1,4})(?:[ .-]?\\d{2,4}){2,4})(?![\\p{L}\\p{N}]|[ .-]\\d)",
    "card": f"{START}\\d{{4}}(?:(?: \\d{{4}}){{3}}|(?:-\\d{{4}}){{3}}|\\d{{12}}){END}",
    "ssn": "(?<![\\p{L}\\p{N}-])\\d{3}-\\d{2}-\\d{4}(?![\\p{L}\\p{N}-])",
    "ip": "(?<![\\p{L}\\p{N}.])(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?![\\p{L}\\p{N}]|\\.\\d)",
    "ip6": f"(?<![\\p{{L}}\\p{{N}}:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{2,6}}(?::{HEX}){{1,5}})(?![\\p{{L}}\\p{{N}}:])",
    "name": f"{START}(?:{TITLE} (?:{INITIAL} ?)*{WORD}(?:(?: {BETWEEN})* {WORD}){{0,2}}|(?:{'|'.join((*MALE_GIVEN, *FEMALE_GIVEN))})(?:-{WORD})?(?: {BETWEEN})* {WORD})",
}
#: Numbers that only a word before them tells: kind to (words, number). Fixed values.
TOLD = {
    "phone": ("(?:[Pp]hone|[Tt]el(?:efon|éfono|éphone|ephone)?|[Cc]all|[Mm]obile|[Ff]ax|[Aa]nrufen|[Ll]lamar)", "\\d{3}[ .-]\\d{4}"),
    "ssn": ("(?:SSN|ssn|[Ss]ocial [Ss]ecurity(?: [Nn]umber)?)", "\\d{9}"),
    "passport": ("(?:[Pp]assport|[Rr]eisepass|[Pp]asaporte|[Pp]asseport)(?: [Nn]umber| [Nn]o| [Nn]r)?", "[A-Z]{0,2}\\d{6,9}"),
}
#: The number is looked at before the words, which stand behind it: few places hold such a number.
ANY = "|".join((*PATTERNS.values(), *[f"(?={number}(?![\\p{{L}}\\p{{N}}]|[.-]\\d))(?<={words}\\.?[:#]? ?){number}" for words, number in TOLD.values()]))
#: Two capitalised words side by side, wherever they begin.
PAIR = f"{START}(?=({WORD} {WORD}){END})"
#: Three, of which the middle one may be an initial or a particle.
TRIPLE = f"{START}(?=({WORD} (?:{BETWEEN}|{WORD}) {WORD}){END})"
#: Country codes of telephone numbers; none begins another.
COUNTRY = "^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:21|22|23|24|25|26|28|29|35|37|38|42|50|59|67|68|69|80|83|85|87|88|89|96|97|99)\\d)"
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}
NUMBERS = ("phone", "card", "ssn", "iban")
#: Numbers keep their length for so many draws; after so many rounds what still collides gets a digest, which can't.
PLAIN_TRIES, ROUNDS = 8, 24


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string under ``key``, as lower-case hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    padded = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(padded(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(padded(0x5C), inner), 256)


def kind_of(value: Column) -> Column:
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], *[F.when(value.rlike(f"^{p}$"), F.lit(k)) for k, (_, p) in TOLD.items()], F.lit("name"))


def canonical(kind: Column, value: Column) -> Column:
    """What makes two spellings the same entity: digits of numbers, with the + of phones; lower case of the rest; names without their title."""
    bare = F.regexp_replace(F.lower(value), "[^\\p{L}\\p{N}]", "")
    bare = F.when((kind == "phone") & value.startswith("+"), F.concat(F.lit("+"), bare)).otherwise(bare)
    return F.when(kind.isin(*NUMBERS), bare).when(kind == "name", F.lower(untitled(value))).otherwise(F.lower(value))


def untitled(name: Column) -> Column:
    return F.regexp_replace(name, f"^{TITLE} ", "")


def gender(value: Column) -> Column:
    has = lambda words, end: value.rlike(f"^(?:{'|'.join(words)}){end} ")
    titled = lambda words: has([x for t in words for x in (t, t.upper())], "\\.?")
    given = lambda words: has(words, "(?:-[^ ]+)?")
    return F.when(titled(FEMALE), "f").when(titled(MALE), "m").when(titled(NEUTRAL), "n").when(given(FEMALE_GIVEN), "f").when(given(MALE_GIVEN), "m").otherwise("n")


def numbers(key: bytes, seed: Column, n: Column) -> Column:
    """n numbers of 0 to 65535 from a keyed hash of ``seed``."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), lambda b: hmac_hex(key, F.concat_ws("|", seed, b.cast("string"))))
    digits = F.array_join(blocks, "")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def _by_script(text: Column, of) -> Column:
    return F.when(text.rlike("\\p{IsCyrillic}"), of("cyrillic")).when(text.rlike("\\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _pick(letters: str, x: Column) -> Column:
    return F.substring(F.lit(letters), x % F.lit(len(letters)) + 1, F.lit(1))


def reletter(key: bytes, text: Column, seed: Column) -> Column:
    """Every letter by one of its script, every digit by a digit, the rest as it is; lower case."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    drawn = numbers(key, seed, F.greatest(F.size(chars), F.lit(1)))
    return F.array_join(
        F.zip_with(
            chars,
            drawn,
            lambda c, x: F.when(c.isNull(), "")
            .when(c.rlike("\\p{N}"), _pick("0123456789", x))
            .when(c.rlike("\\p{IsCyrillic}"), _pick(CYRILLIC, x))
            .when(c.rlike("\\p{IsGreek}"), _pick(GREEK, x))
            .when(c.rlike("\\p{L}"), _pick(LATIN, x))
            .otherwise(c),
        ),
        "",
    )


def invented(key: bytes, part: Column, vowel: Column, seed: Column, attempt: Column) -> Column:
    """A name of two or three syllables, one more a further attempt, in the script of ``part``; it ends in a vowel or in a consonant."""
    x = numbers(key, seed, attempt * 2 + 9)

    def of(s: str) -> Column:
        syllables = F.transform(F.sequence(F.lit(1), attempt + 2 + F.get(x, F.lit(0)) % 2), lambda i: F.concat(_pick(CONSONANTS[s], F.get(x, i * 2 - 1)), _pick(VOWELS[s], F.get(x, i * 2))))
        last = _pick(CONSONANTS[s], F.element_at(x, -1))
        return F.concat(F.array_join(syllables, ""), last, F.when(vowel, VOWELS[s][0]).otherwise(""))

    return _by_script(part, of)


def luhn(digits: Column) -> Column:
    """Sum of a digit string by the rule of card numbers, doubling every second digit from the right but one."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    value = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def surrogate(key: bytes, kind: Column, part: Column, sex: Column, attempt: Column) -> Column:
    """Replacement of a part, in canonical form."""
    seed = F.concat_ws("|", kind, part, sex, attempt.cast("string"))
    named = F.when(kind == "local", F.substring_index(part, "@", 1)).otherwise(part)
    drawn_name = reletter(key, F.concat(named, F.repeat(_by_script(named, lambda s: F.lit(VOWELS[s][0])), attempt)), seed)
    # numbers that go on colliding grow by zeros, which are drawn like their digits
    number = F.concat(part, F.repeat(F.lit("0"), F.greatest(attempt - PLAIN_TRIES, F.lit(0))))
    drawn = reletter(key, number, seed)
    rest = F.length(number)
    body = F.concat(F.substring(number, F.lit(1), F.lit(1)), F.substring(drawn, F.lit(2), rest - 2))
    check = (F.lit(10) - luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(luhn(part) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(F.concat(F.substring(number, F.lit(1), F.lit(1)), F.substring(drawn, F.lit(2), rest)))
    iban = F.concat(F.substring(number, F.lit(1), F.lit(2)), F.substring(drawn, F.lit(3), rest))
    code = F.regexp_extract(part, COUNTRY, 0)
    phone = F.concat(code, F.substring(drawn, F.length(code) + 1, rest))
    x = numbers(key, seed, F.lit(16))
    byte = lambda i: (F.get(x, F.lit(i)) % 256).cast("string")
    octet = F.split(part, "\\.")
    first, second = F.get(octet, F.lit(0)), F.get(octet, F.lit(1))
    # addresses of private networks stay private
    head = F.when(first.isin("10", "127"), F.concat_ws(".", first, byte(1))).when((first == "192") & (second == "168"), F.lit("192.168"))
    head = head.when((first == "172") & second.cast("int").between(16, 31), F.concat(F.lit("172."), (F.get(x, F.lit(1)) % 16 + 16).cast("string")))
    ip = F.concat_ws(".", head.otherwise(F.concat_ws(".", (F.get(x, F.lit(0)) % 223 + 1).cast("string"), byte(1))), byte(2), byte(3))
    group = lambda i: F.lower(F.hex(F.get(x, F.lit(i)).cast("long")))
    ip = F.when(attempt > PLAIN_TRIES, F.concat_ws(":", F.lit("2001:db8"), *[group(i) for i in range(6)])).otherwise(ip)
    chars = F.filter(F.split(part, ""), lambda c: c != "")
    ip6 = F.array_join(F.zip_with(chars, numbers(key, seed, F.size(chars)), lambda c, v: F.when(c == ":", c).otherwise(_pick("0123456789abcdef", v))), "")
    ip6 = F.when(attempt > PLAIN_TRIES, F.concat_ws(":", *[group(i) for i in range(8, 16)])).otherwise(ip6)
    vowel = F.when(sex == "f", True).when(sex == "m", False).otherwise(part.rlike("[aeiouyáéíóúаеиоуыэюяαειουωη]$"))
    name = invented(key, part, vowel, seed, attempt)
    return (
        F.when(kind.isin("host", "local"), drawn_name).when(kind.isin("family", "given"), name).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ip6", ip6).otherwise(drawn)
    )


def parts_of(kind: Column, entity: Column, sex: Column) -> Column:
    """The parts of an entity that are replaced, each with the scope within which replacements differ."""
    part = lambda scope, k, p, s: F.struct(scope.alias("scope"), F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), p.alias("part"), s.alias("sex"))
    domain, none = F.substring_index(entity, "@", -1), F.lit("n")
    host = F.regexp_extract(domain, "^(.*)\\.[^.]*$", 1)
    words = F.filter(F.split(entity, " "), lambda w: ~w.rlike(NO_PART))
    family = part(F.lit("family"), "family", F.element_at(words, -1), none)
    given = part(F.lit("given"), "given", F.get(words, F.lit(0)), sex)
    middle = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: part(F.lit("given"), "given", w, none))
    return (
        F.when(kind == "email", F.array(part(F.concat(F.lit("local|"), domain), "local", entity, none), part(F.lit("host"), "host", host, none)))
        .when((kind == "name") & (F.size(words) > 1), F.concat(F.array(given), middle, F.array(family))).when(kind == "name", F.array(family)).otherwise(F.array(part(kind, kind, entity, none)))
    )


def shaped(kind: Column, value: Column, entity: Column, new: Column) -> Column:
    """The replaced parts ``new`` written as ``value`` writes its ``entity``: separators, case, title, top domain."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    signs = F.regexp_replace(F.get(new, F.lit(0)), "^\\+", "")
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        letter = F.substring(signs, a["at"], F.lit(1))
        used = c.rlike("[\\p{L}\\p{N}]")
        put = F.when(~used, c).when((F.upper(c) == c) & (F.lower(c) != c), F.upper(letter)).otherwise(letter)
        return F.struct(F.concat(a["out"], put).alias("out"), (a["at"] + F.when(used, 1).otherwise(0)).alias("at"))

    number = F.aggregate(chars, state, step, lambda a: F.concat(a["out"], F.substring(signs, a["at"], F.length(signs))))
    title = F.regexp_extract(value, f"^{TITLE} ", 0)

    def word(a: Column, o: Column) -> Column:
        """A word by the next part; an initial by a letter of the last part; a particle stays."""
        n = F.get(new, a["at"])
        named = F.when((F.length(o) > 1) & (F.upper(o) == o), F.upper(n)).otherwise(F.initcap(n))
        kept = F.lower(o).rlike(NO_PART)
        put = F.when(~kept, named).when(o.endswith("."), F.concat(F.upper(F.substring(F.element_at(new, -1), 2, 1)), F.lit("."))).otherwise(o)
        return F.struct(F.concat(a["out"], F.array(put)).alias("out"), (a["at"] + F.when(kept, 0).otherwise(1)).alias("at"))

    nothing = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    written = F.aggregate(F.split(untitled(value), " "), nothing, word, lambda a: a["out"])
    email = F.concat(F.get(new, F.lit(0)), F.lit("@"), F.get(new, F.lit(1)), F.lit("."), F.regexp_extract(entity, "[^.]*$", 0))
    plain = F.when(kind == "email", email).otherwise(F.get(new, F.lit(0)))
    plain = F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(plain)).otherwise(plain)
    return F.when(kind.isin(*NUMBERS), number).when(kind == "name", F.concat(title, F.array_join(written, " "))).otherwise(plain)


def surrogates(parts: DataFrame, key: bytes) -> DataFrame:
    """Distinct (scope, kind, part, sex) to the same with new: no new twice in a scope, and none that is a part there, with + or without."""
    signs = F.regexp_replace("new", "^\\+", "").alias("signs")
    table = cut(parts.select("scope", "kind", "part", "sex", F.lit(0).alias("attempt")), "parts")
    own = F.when(F.col("kind") == "local", F.substring_index("part", "@", 1)).otherwise(F.col("part"))
    scopes = F.when(F.col("kind").isin("family", "given"), F.array(F.lit("family"), F.lit("given"))).otherwise(F.array("scope"))
    real = cut(table.select(F.explode(scopes).alias("scope"), own.alias("new")).select("scope", signs).distinct(), "real")
    draw = surrogate(key, F.col("kind"), F.col("part"), F.col("sex"), F.col("attempt"))
    same = ["scope", "kind", "part", "sex"]
    for _ in range(ROUNDS):
        drawn = cut(table.withColumn("new", draw).select("*", signs), "drawn")
        # the part that has waited longest keeps a replacement that several have drawn
        first = drawn.groupBy("scope", "signs").agg(F.min(F.struct(-F.col("attempt"), "part", "sex")).alias("owner"), F.count("*").alias("n"))
        clash = cut(first.where("n > 1"), "owners").join(drawn, ["scope", "signs"]).where("owner.part <> part or owner.sex <> sex").select(*same)
        clash = cut(clash.union(drawn.join(real, ["scope", "signs"], "left_semi").select(*same)).distinct(), "clashes")
        if clash.isEmpty():
            return drawn.select(*same, "new")
        again = clash.withColumn("clash", F.lit(1))
        table = cut(drawn.drop("clash").join(again, same, "left").select(*same, (F.col("attempt") + F.coalesce("clash", F.lit(0))).alias("attempt"), "new", "clash"), "parts")
    digest = hmac_hex(key, F.concat_ws("|", "kind", "part", "sex"))
    sure = F.when(F.col("kind").isin("family", "given", "host", "local"), F.translate(digest, "0123456789", "ghijklmnop")).otherwise(F.translate(digest, "abcdef", "012345"))
    return table.select(*same, F.when(F.col("clash").isNull(), F.col("new")).otherwise(F.concat("new", sure)).alias("new"))


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities of text_col replaced, and a column n_entities added last.

    Names have up to three words, initials and particles (a particle stays, as it names nobody).
    key: a secret of the caller; whoever has it can repeat the replacements, and nobody else.
    Single family names without a title, and full names that nowhere stand with one and
    whose given name is none of the common ones, are not taken for names.

    Null text: stays null, without entities. Null ids and repeated rows are treated like
    others; equal entities get equal replacements wherever they stand. Empty table: empty
    result. All columns are kept under their names; an earlier n_entities is replaced.
    """
    docs = docs.drop(*({"n_entities"} & set(docs.columns)))
    text = F.col(text_col)
    of = lambda pattern, group: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), of(ANY, 0).alias("found"), F.array_union(of(PAIR, 1), of(TRIPLE, 1)).alias("pairs"))
    rows = cut(rows.where("size(found) > 0 or size(pairs) > 0").dropDuplicates(["id", "text_hash"]), "found")
    flat = rows.select("id", "text_hash", F.explode("found").alias("value"))
    values = flat.select("value").distinct().select("value", kind_of(F.col("value")).alias("kind"))
    values = values.select("value", "kind", canonical(F.col("kind"), F.col("value")).alias("entity"), F.when(F.col("kind") == "name", gender(F.col("value"))).otherwise("n").alias("sex"))
    values = cut(values, "values")
    # a full name has the gender that its titles agree on, and stands without a title as well
    full = values.where("kind = 'name' and entity like '% %'")
    sexes = full.where("sex <> 'n'").groupBy("entity").agg(F.min("sex").alias("lo"), F.max("sex").alias("hi")).where("lo = hi").select("entity", F.col("lo").alias("known"))
    bare = full.select(untitled(F.col("value")).alias("value"), "kind", "entity")
    values = values.select("value", "kind", "entity").union(bare).distinct().join(cut(sexes, "sexes"), "entity", "left")
    values = values.select("value", "kind", "entity", F.coalesce("known", F.lit("n")).alias("sex"))
    values = cut(values.withColumn("parts", parts_of(F.col("kind"), F.col("entity"), F.col("sex"))), "values")
    flat_parts = values.select("value", "kind", "entity", F.posexplode("parts").alias("at", "p")).select("value", F.col("kind").alias("of"), "entity", "at", "p.*")
    new = surrogates(flat_parts.select("scope", "kind", "part", "sex").distinct(), key)
    written = flat_parts.join(new, ["scope", "kind", "part", "sex"]).groupBy("value", "of", "entity").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("s"))
    written = cut(written.select("value", shaped(F.col("of"), F.col("value"), F.col("entity"), F.col("s.new")).alias("new")), "written")
    known = cut(bare.select("value").distinct(), "names")
    met = cut(rows.select("id", "text_hash", F.explode("pairs").alias("value")).join(known, "value"), "met")
    inside = flat.select("id", "text_hash", "value", F.lit(None).cast("string").alias("name")).union(met.select("id", "text_hash", "value", F.col("value").alias("name")))
    inside = inside.join(written, "value").groupBy("id", "text_hash").agg(F.collect_set(F.struct("value", "new")).alias("s"), F.array_sort(F.collect_set("name")).alias("names"))
    inside = cut(inside.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.map_from_entries("s").alias("__new"), F.col("names").alias("__names")), "replacements")
    joined = docs.join(inside.hint("merge"), docs[id_col].eqNullSafe(inside["__id"]) & (F.xxhash64(docs[text_col]) == inside["__hash"]), "left")
    pattern = F.when(F.size("__names") > 0, F.concat(F.lit(f"{START}(?:"), F.array_join(F.reverse("__names"), "|"), F.lit(f"){END}|{ANY}"))).otherwise(F.lit(ANY))
    joined = joined.withColumn("__found", F.when(F.col("__new").isNotNull(), F.regexp_extract_all(docs[text_col], pattern, F.lit(0))))
    pieces = F.split(docs[text_col], pattern, -1)
    put = F.array_join(F.flatten(F.zip_with(pieces, F.col("__found"), lambda a, b: F.array(a, F.coalesce(F.try_element_at("__new", b), b, F.lit(""))))), "")
    return joined.select(
        *[F.when(F.col("__new").isNull(), docs[c]).otherwise(put).alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.coalesce(F.size("__found"), F.lit(0)).cast("long").alias("n_entities"),
    )
