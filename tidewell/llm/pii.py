"""PII surrogates: detected entities get keyed replacements of their own type, script, gender and format.

Native: regular expressions find entities, distinct ones are named once for the whole corpus (so mentions stay coreferent),
candidates that collide with each other or with a real entity are drawn again, and each text is rebuilt from its parts.
A name after an honorific makes its bare mentions in the same text entities too, whole or by the family name alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Honorifics by gender (f, m, or unknown), as they stand before a name.
HONORIFICS = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mademoiselle", "Señora", "Señorita", "Sra", "Srta", "Dra", "Mlle", "г-жа", "госпожа", "κυρία"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Mister", "господин", "г-н", "κύριος"],
    "u": ["Prof", "Professor", "Doctor", "Dr"],
}
#: Given names by script and gender; family names are composed of syllables.
GIVEN = {
    "latin f": ["Anna", "Clara", "Elena", "Emma", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Sara"],
    "latin m": ["Adam", "Bruno", "Carl", "David", "Emil", "Frank", "Hugo", "Jonas", "Martin", "Oscar", "Peter", "Simon"],
    "latin u": ["Alex", "Andrea", "Charlie", "Dominique", "Kim", "Robin", "Sam", "Sascha", "Taylor", "Toni"],
    "cyrillic f": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    "cyrillic m": ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
    "cyrillic u": ["Валя", "Женя", "Саша", "Шура"],
    "greek f": ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία"],
    "greek m": ["Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος", "Σπύρος"],
    "greek u": ["Αλέξης", "Χρύσα"],
}
SYLLABLES = {
    "latin": ["bar", "bel", "cor", "dal", "den", "fal", "gar", "hol", "kel", "lan", "mar", "nel", "por", "rin", "sel", "tor"],
    "cyrillic": ["бар", "бел", "вор", "гал", "дар", "зор", "кал", "лар", "мир", "нел", "пол", "рин", "сел", "тар", "фол", "шар"],
    "greek": ["βαρ", "γελ", "δαλ", "ζαρ", "θελ", "καρ", "λαν", "μαρ", "νελ", "παρ", "ριν", "σελ", "ταρ", "φιλ", "χαρ", "ψαρ"],
}
HONORIFIC = "(?:" + "|".join(h for hs in HONORIFICS.values() for h in hs) + r")\.? "
#: A word of a name may have inner capitals, hyphens and apostrophes (not those of a possessive), and particles before it.
WORD = r"\p{Lu}(?:[\p{L}\p{M}]{1,60}+|(?=['’]\p{Lu}))(?:-\p{L}[\p{L}\p{M}]{0,60}+|['’]\p{Lu}[\p{L}\p{M}]{0,60}+){0,4}+"
FAMILY = r"(?:(?:van|von|de|del|della|der|den|di|da|du|dos|la|le|bin|al|el) ){0,3}+" + WORD
NAME = rf"(?:\p{{Lu}}\. ?){{0,3}}+{FAMILY}(?: (?:\p{{Lu}}\. ?){{0,3}}+{FAMILY})?"
NORTH_AMERICAN = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
#: How each type looks; types are told apart in this order.
PATTERNS = {
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}+",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_/+-]{8,}+(?:[\x21-\x7e&&[^\"'<>,;(){}\[\]]]*[A-Za-z0-9_/+=-])?",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|6[0-9]{18}|4[0-9]{12}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3(?:0[0-5]|[68][0-9])[0-9][ -]?[0-9]{6}[ -]?[0-9]{4})(?![0-9])",
    "phone": rf"{NORTH_AMERICAN}|(?<![0-9+])\+(?=(?:[ .()-]{{0,2}}[0-9]){{8}})[1-9][0-9]{{0,2}}(?:[ .-]?\(?[0-9]{{1,5}}\)?){{2,5}}(?<=[0-9]{{2}})(?![0-9])|(?<![0-9.,/-])\(?0[1-9][0-9]{{1,3}}\)?[ /-][0-9]{{3,4}}[ -]?[0-9]{{3,4}}(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){HONORIFIC}{NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(F.regexp(entity, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What mentions of one entity have in common: case of an e-mail, punctuation of numbers, a name without honorific.

    North American phones are ten digits, others all their digits, after a plus if they have a country code.
    """
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(entity))
        .when((kind == "phone") & F.regexp(entity, F.lit(f"^(?:{NORTH_AMERICAN})$")), F.substring(digits, -10, 10))
        .when((kind == "phone") & entity.startswith("+"), F.concat(F.lit("+"), digits))
        .when(kind == "phone", digits)
        .when(kind == "card", digits)
        .when(kind == "secret", F.regexp_extract(entity, r"^[^=:]*[=:]\s*[\"']?(.*)$", 1))
        .when(kind == "name", bare(entity))
        .otherwise(entity)
    )


def bare(entity: Column) -> Column:
    """A name without its honorific."""
    return F.regexp_extract(entity, f"^(?:{HONORIFIC})?(.*)$", 1)


def family_of(name: Column) -> Column:
    return F.regexp_extract(name, f"({FAMILY})$", 1)


def stream(key: str, *parts: Column) -> Column:
    """256 keyed hexadecimal digits for an entity and attempt."""
    return F.concat(*[F.sha2(F.concat_ws("\n", F.lit(key), *[p.cast("string") for p in parts], F.lit(str(i))), 256) for i in range(4)])


def draw(bits: Column, i: Column, n: Column | int) -> Column:
    """A number under n from the i-th (from 0) place of a stream; places repeat after 64, shifted."""
    place = F.pmod(i * 4 + F.floor(i / 64), F.lit(252)).cast("int") + 1
    return F.pmod(F.conv(F.substr(bits, place, F.lit(4)), 16, 10).cast("long") + F.floor(i / 63) * 7, F.lit(n) if isinstance(n, int) else n)


def pick(values: list[str], bits: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(bits, F.lit(i), len(values)) + 1).cast("int"))


def like(text: Column, bits: Column, digits: str = DIGITS, keep_marks: Column | None = None) -> Column:
    """Each letter becomes a letter of its case, each digit a digit; lower-case hexadecimal text stays so; all else stays."""
    hexed = F.regexp(text, F.lit("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{16,}$"))

    def one(c: Column, i: Column) -> Column:
        of = lambda s: F.substr(F.lit(s), (draw(bits, i, len(s)) + 1).cast("int"), F.lit(1))
        return F.when(hexed, of("0123456789abcdef")).when(F.contains(F.lit(LOWER), c), of(LOWER)).when(F.contains(F.lit(UPPER), c), of(UPPER)).when(F.contains(F.lit(DIGITS), c), of(digits)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn(body: Column) -> Column:
    """The check digit of some digits."""
    each = F.transform(F.split(body, ""), lambda c, i: F.when((F.length(body) - 1 - i) % 2 == 0, c.try_cast("int") * 2).otherwise(c.try_cast("int")))
    total = F.aggregate(F.transform(each, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def script_of(name: Column) -> Column:
    return F.when(F.regexp(name, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp(name, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def propose(kind: Column, name: Column, gender: Column, attempt: Column, key: str) -> Column:
    """A candidate in canonical form."""
    bits = stream(key, kind, name, gender, attempt)
    octet = lambda i: draw(bits, F.lit(i), 254) + 1
    at = F.instr(name, "@")
    domain, host = F.substr(name, at + 1, F.length(name)), stream(key, F.substr(name, at + 1, F.length(name)))
    # The domain's name goes by the domain alone, so that colleagues stay colleagues; its last label stays.
    email = F.concat(like(F.substr(name, F.lit(1), at - 1), bits), F.lit("@"), like(F.regexp_extract(domain, r"^(.*)\.", 1), host), F.lit("."), F.regexp_extract(domain, r"([^.]*)$", 1))
    number = like(name, bits)
    size = F.length(name)
    valid = luhn(F.substr(name, F.lit(1), size - 1)) == F.substring(name, -1, 1)
    first = F.when(size == 16, 1).otherwise(2)  # other lengths go by two digits
    card = F.concat(F.substr(name, F.lit(1), first), F.substr(number, first + 1, size - 1 - first))
    card = F.concat(card, F.when(valid, luhn(card)).otherwise(F.substring(number, -1, 1)))
    area = lambda i: (draw(bits, F.lit(i), 800) + 200).cast("string")
    begin = F.when(name.startswith("+"), 4).otherwise(2)  # a country code, or a trunk zero and a digit, stays
    phone = F.when(F.regexp(name, F.lit("^[+0]")), F.concat(F.substr(name, F.lit(1), begin), F.substr(number, begin + 1, size))).otherwise(F.concat(area(0), area(1), F.substring(number, 7, 4)))
    person = F.lit(None).cast("string")
    for script, parts in SYLLABLES.items():
        family = F.initcap(F.concat(*[pick(parts, bits, i) for i in range(4)]))
        given = F.lit(None).cast("string")
        for g in HONORIFICS:
            given = F.when(gender == g, pick(GIVEN[f"{script} {g}"], bits, 5)).otherwise(given)
        person = F.when(script_of(name) == script, F.when(F.contains(name, F.lit(" ")), F.concat_ws(" ", given, family)).otherwise(family)).otherwise(person)
    return (
        F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *[octet(i).cast("string") for i in range(4)])).when(kind == "card", card)
        .when(kind == "phone", phone).when(kind == "key", F.concat(F.lit("AKIA"), like(F.substring(name, 5, 16), bits))).when(kind == "name", person).otherwise(number)
    )


def pour(entity: Column, kind: Column, name: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's format: its punctuation, country code, prefix, honorific or case; of a person, the family name alone where the mention has no more."""
    person = F.when((bare(entity) == family_of(bare(entity))) & (bare(entity) != name), F.element_at(F.split(surrogate, " "), -1)).otherwise(surrogate)
    person = F.concat(F.substr(entity, F.lit(1), F.length(entity) - F.length(bare(entity))), person)
    surrogate = F.when(kind == "name", person).when(kind == "phone", F.regexp_replace(surrogate, "[^0-9]", "")).otherwise(surrogate)
    surplus = F.length(F.regexp_replace(entity, "[^0-9]", "")) - F.length(surrogate)

    def digit(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), "[^0-9]", "")) - surplus
        return F.when(F.regexp(c, F.lit("[0-9]")) & (before >= 0), F.substr(surrogate, before + 1, F.lit(1))).otherwise(c)

    digits = F.array_join(F.transform(F.split(entity, ""), digit), "")
    cased = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(F.contains(F.lit(UPPER), c), F.upper(F.substr(surrogate, i + 1, F.lit(1)))).otherwise(F.substr(surrogate, i + 1, F.lit(1)))), "")
    head = F.substr(entity, F.lit(1), F.length(entity) - F.length(name))
    return F.when(kind.isin("card", "phone"), digits).when((kind == "email") & (F.length(entity) == F.length(surrogate)), cased).when(kind == "secret", F.concat(head, surrogate)).otherwise(surrogate)


def gender_of(entity: Column) -> Column:
    title = F.regexp_extract(entity, r"^([^ .]+)", 1)
    return F.when(title.isin(HONORIFICS["f"]), "f").when(title.isin(HONORIFICS["m"]), "m").otherwise("u")


def surrogates(entities: DataFrame, key: str, attempts: int = 40) -> DataFrame:
    """kind, name, gender, surrogate for each distinct entity: no two of a kind share one, none is a real entity or itself.

    A name seen with one gender and without keeps that gender. Each round draws for the entities still without; of several
    that drew the same the least keeps it. Raises where a format has no free form left after `attempts` rounds.
    """
    real = keep(entities.groupBy("kind", "name").agg(F.min("gender").alias("gender")), "entities")  # f < m < u
    names = real.select("kind", F.col("name").alias("surrogate"))
    open_, done = real, None
    for i in range(attempts):
        drawn = open_.withColumn("surrogate", propose(F.col("kind"), F.col("name"), F.col("gender"), F.lit(i), key))
        given = lambda c: F.split(c, " ")[0]
        drawn = drawn.where((F.col("kind") != "name") | (given("surrogate") != given("name")))
        least = drawn.groupBy("kind", "surrogate").agg(F.min("name").alias("owner"))
        free = least.join(names, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = keep(drawn.join(free, ["kind", "surrogate"]).where("owner = name").select("kind", "name", "gender", "surrogate"), "surrogates")
        done = won if done is None else done.union(won)
        open_ = keep(open_.join(won.select("kind", "name"), ["kind", "name"], "left_anti"), "open-entities")
        if open_.isEmpty():
            return done
    raise ValueError(f"no free surrogates for some entities after {attempts} draws")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, text with surrogates, n_entities (mentions), kinds (sorted distinct).

    The same key gives the same surrogates only for the same corpus, as collisions are settled in it. Null texts stay null;
    texts without entities stay as they are. Repeated rows come back repeated; other columns aren't read; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    any_ = F.lit(f"({ANY})")
    # Texts without entities, nearly all, are only searched, here and at the end; the others are kept and joined.
    marked = rows.withColumn("own", F.regexp_extract_all("text", any_, 1)).where(F.size("own") > 0)
    # Each text's names, in order, and the pattern that finds their bare mentions too.
    titled = F.filter("own", lambda m: F.regexp(m, F.lit(f"^(?:{PATTERNS['name']})$")))
    people = F.transform(titled, lambda m: F.struct(bare(m).alias("name"), family_of(bare(m)).alias("family"), gender_of(m).alias("gender")))
    marked = marked.withColumn("people", F.array_distinct(people))
    longest = lambda x, y: F.length(y) - F.length(x)
    spelled = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("people", lambda x: F.array(x["name"], x["family"])))), longest), "|")
    wide = F.concat(F.lit(f"{ANY}|(?<![\\p{{L}}\\p{{N}}])(?:"), F.replace(spelled, F.lit("."), F.lit("\\.")), F.lit(r")(?![\p{L}\p{N}])"))
    marked = marked.withColumn("pattern", F.when(F.size("people") > 0, wide))
    wider = F.regexp_extract_all("text", F.concat(F.lit("("), F.col("pattern"), F.lit(")")), F.lit(1))
    marked = marked.withColumn("own", F.when(F.col("pattern").isNotNull(), wider).otherwise(F.col("own")))
    marked = keep(marked.withColumns({"content": F.xxhash64("text"), "size": F.length("text")}), "marked-texts")
    each = marked.select("content", "size", "people", F.array_distinct("own").alias("own")).distinct().select("content", "size", "people", F.explode("own").alias("entity"))
    kind = F.coalesce(kind_of(F.col("entity")), F.when(F.regexp("entity", F.lit(f"^(?:{NAME})$")), "name"))
    each = each.withColumn("kind", kind).where("kind is not null")
    each = each.withColumns({"name": canonical(F.col("kind"), F.col("entity")), "gender": F.when(F.col("kind") == "name", gender_of(F.col("entity"))).otherwise("u")})
    # A family name alone is the text's first person of that family whose gender agrees.
    same_family = lambda x: (x["family"] == F.col("name")) & (x["name"] != F.col("name")) & ((x["gender"] == F.col("gender")) | (x["gender"] == "u") | (F.col("gender") == "u"))
    person = F.coalesce(F.get(F.filter("people", same_family), F.lit(0))["name"], F.col("name"))
    each = keep(each.withColumn("name", F.when(F.col("kind") == "name", person).otherwise(F.col("name"))).drop("people"), "mentions")
    known = keep(each.groupBy("entity", "kind", "name").agg(F.min("gender").alias("gender")), "known-entities")
    drawn = surrogates(known, key)
    poured = known.join(drawn.select("kind", "name", "surrogate"), ["kind", "name"]).select("entity", "kind", "name", pour(F.col("entity"), F.col("kind"), F.col("name"), F.col("surrogate")).alias("new"))
    poured = keep(poured, "poured")
    maps = each.select("content", "size", "entity", "name").join(poured, ["entity", "name"]).groupBy("content", "size").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("new", "kind")))).alias("changes"))
    maps = keep(maps, "changes")
    swapped = F.transform("own", lambda m: F.coalesce(F.try_element_at("changes", m)["new"], m))
    pieces = F.when(F.col("pattern").isNull(), F.split("text", ANY, -1)).otherwise(F.split("text", F.col("pattern"), F.lit(-1)))
    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(swapped, i), F.lit("")))), "")
    kinds = F.array_sort(F.array_distinct(F.transform(F.map_values("changes"), lambda x: x["kind"])))
    changed = marked.join(maps.hint("merge"), ["content", "size"], "left").select("id", rebuilt.alias("text"), F.size("own").cast("long").alias("n_entities"), F.coalesce(F.array_join(kinds, ","), F.lit("")).alias("kinds"))
    same = rows.where(~F.coalesce(F.regexp("text", any_), F.lit(False))).select("id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return same.union(changed).withColumnsRenamed({"id": id_col, "text": "text"})
