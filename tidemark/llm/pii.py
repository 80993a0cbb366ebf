"""Surrogates for personal data, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Given names by gender and script; a surrogate comes from the list of the original.
GIVEN = {
    ("female", "latin"): "Mary Anna Laura Emma Julia Sophie Claire Maria Elena Carmen Lucia Ingrid Helga Sabine Alice Sarah Linda Susan Emily Nathalie".split(),
    ("male", "latin"): "James John Robert Michael David Thomas Peter Paul Hans Klaus Stefan Pierre Jean Louis Carlos Miguel Pedro Juan Daniel William".split(),
    ("female", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("male", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
    ("female", "greek"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
    ("male", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας".split(),
}
#: Titles by the gender that they tell, and what a surrogate of an unlisted given name of a gender ends in, by script.
TITLED = {
    "female": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Doña Госпожа Κυρία".split(),
    "male": "Mr Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "": "Mx Dr Prof".split(),
}
TITLES = [t for titles in TITLED.values() for t in titles]
ENDINGS = {"female": ("a", "а", "α"), "male": ("o", "ий", "ος")}
#: A letter or digit is replaced by another of its alphabet, so script, case and vowels stay as they are.
ALPHABETS = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "ñçß", "ÑÇ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
#: For each letter in all alphabets: where its alphabet begins, from 1, and its size.
FIRST = [1 + sum(map(len, ALPHABETS[:i])) for i, letters in enumerate(ALPHABETS) for _ in letters]
SIZE = [len(letters) for letters in ALPHABETS for _ in letters]
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
EMAIL = r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
NUMBERS = (
    rf"(?<!\.){OCTET}(?:\.{OCTET}){{3}}(?![\p{{N}}]|\.[0-9])",
    r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
    r"(?<![.-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
)
NAMES = rf"(?:(?:{'|'.join(TITLES)})\.? {NAME}(?: {NAME})?|(?:{'|'.join(n for x in GIVEN.values() for n in x)}) {NAME})(?![\p{{L}}\p{{N}}])"
#: Kinds of words of names: given names of women, of men, and of neither, and family names. The first one that holds counts.
WOMAN, MAN, PERSON, FAMILY = "name1", "name2", "name3", "name4"
LISTED = [n for names in GIVEN.values() for n in names]
#: A mention begins where no letter or digit stands before; what it begins with decides which patterns are tried.
ANY = rf"(?<![\p{{L}}\p{{N}}])(?:(?=[\p{{L}}\p{{N}}._%+-]++@){EMAIL}|(?=[0-9+(])(?:{'|'.join(NUMBERS)})|(?=\p{{Lu}}){NAMES})"
#: Marks that may stand between the digits of a phone number, and a country code as the numbering plan has them.
MARKS = r"[ .()-]*"
COUNTRY = rf"\+(?:[17]|2{MARKS}[07]|3{MARKS}[0-469]|4{MARKS}[013-9]|5{MARKS}[1-8]|6{MARKS}[0-6]|8{MARKS}[1246]|9{MARKS}[0-58]|[0-9](?:{MARKS}[0-9]){{2}})"
#: Draws of a name after which it grows by a letter, as its format may be used up; and draws after which there is an error.
WIDER, DRAWS = 4, 100


def kind_of(found: Column) -> Column:
    out = F.when(found.contains("@"), F.lit("email"))
    out = out.when(found.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), F.lit("ip"))
    out = out.when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
    out = out.when(found.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), F.when(luhn(F.regexp_replace(found, "[^0-9]", "")) == 0, F.lit("card")))
    return out.when(found.rlike(r"^[+(0-9]"), F.lit("phone")).otherwise(F.lit("name"))


def luhn(digits: Column) -> Column:
    """The weighted digit sum modulo 10 of the card rule: 0 for a valid number."""
    turned = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    weighed = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x.cast("int")) % 10


def canonical(kind: Column, found: Column) -> Column:
    """What mentions of one entity share: an address in lower case, a number without its format but for a leading plus. A word
    of a name is an entity as it is."""
    return F.when(kind == "email", F.lower(found)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(found, "[^0-9+]", "")).otherwise(found)


def is_name(kind: Column) -> Column:
    return kind.startswith("name")


def title_of(mention: Column) -> Column:
    """The title of a mention with what stands between it and the name; else nothing."""
    return F.regexp_extract(mention, rf"^((?:{'|'.join(TITLES)})\.? )?", 1)


def words_of(mention: Column) -> Column:
    """The words of a name, without its title."""
    return F.split(F.substring(mention, F.length(title_of(mention)) + 1, F.length(mention)), " ")


def name_words(mention: Column) -> Column:
    """(word, kind) of the words of a name: of two the first is given, of one after a title none. Gender is that of the list, else
    that of the title."""
    title, words = title_of(mention), words_of(mention)
    listed = lambda w, gender: w.isin([n for (g, _), names in GIVEN.items() if g == gender for n in names])
    titled = lambda gender: title.rlike(rf"^(?:{'|'.join(TITLED[gender])})\b") if gender else F.lit(False)

    def one(w, i):
        kind = F.when(listed(w, "female"), WOMAN).when(listed(w, "male"), MAN).when(titled("female"), WOMAN).when(titled("male"), MAN).otherwise(PERSON)
        return F.struct(w.alias("word"), F.when((i == 0) & (F.size(words) > 1), kind).otherwise(FAMILY).alias("kind"))

    return F.transform(words, one)


def keyed(key: str, *parts: Column) -> Column:
    """44 bits that depend on the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 11), 16, 10).cast("long")


def permuted(text: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the strings of one format: each letter or digit moves within its alphabet by a number that
    depends on those before it, from the left and then from the right. It can be undone step by step, so two strings
    never become one; what is in no alphabet stays, and doesn't count."""

    def one_way(s: Column, way: str) -> Column:
        def step(acc, c):
            at = F.instr(F.lit("".join(ALPHABETS)), c)
            first, size = (F.element_at(F.expr(f"array({','.join(map(str, x))})"), at) for x in (FIRST, SIZE))
            moved = F.substring(F.lit("".join(ALPHABETS)), (first + (at - first + keyed(key, tweak, F.lit(way), acc["seen"])) % size).cast("int"), F.lit(1))
            return F.struct(F.concat(acc["out"], F.when(at > 0, moved).otherwise(c)).alias("out"), F.concat(acc["seen"], F.when(at > 0, c).otherwise(F.lit(""))).alias("seen"))

        letters = F.filter(F.split(s, ""), lambda c: c != "")
        return F.aggregate(letters, F.struct(F.lit("").alias("out"), F.lit("").alias("seen")), step, lambda acc: acc["out"])

    return F.reverse(one_way(F.reverse(one_way(text, "right")), "left"))


def surrogate_ip(found: Column, key: str, tweak: Column) -> Column:
    """As ``permuted``, on the four octets."""

    def one_way(octets, way):
        def step(acc, x):
            moved = (x.cast("long") + keyed(key, tweak, F.lit(way), F.array_join(acc["seen"], "."))) % 256
            return F.struct(F.concat(acc["out"], F.array(moved.cast("string"))).alias("out"), F.concat(acc["seen"], F.array(x)).alias("seen"))

        none = F.array().cast("array<string>")
        return F.aggregate(octets, F.struct(none.alias("out"), none.alias("seen")), step, lambda acc: acc["out"])

    return F.array_join(F.reverse(one_way(F.reverse(one_way(F.split(found, r"\."), "right")), "left")), ".")


def surrogate_card(found: Column, key: str, tweak: Column) -> Column:
    """The first digit stays, those after it are permuted, and the last is such that the card rule holds."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permuted(F.substring(digits, F.lit(2), n - 2), key, tweak))
    check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    new = F.concat(body, check.cast("string"))
    marks = F.filter(F.split(found, ""), lambda c: c != "")
    place = F.transform(marks, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, F.size(F.filter(F.slice(marks, F.lit(1), i + 1), lambda d: d.rlike("[0-9]"))), F.lit(1))).otherwise(c))
    return F.array_join(place, "")


def surrogate_word(kind: Column, word: Column, key: str, tweak: Column) -> Column:
    """A listed given name becomes another of its gender and script, by a shift of the list that is the same for all of it, so
    they stay distinct. Any other word of a name is permuted; a given name of known gender gets an ending of it."""
    ending = F.lit("")
    for gender, of in (("female", WOMAN), ("male", MAN)):
        latin, cyrillic, greek = ENDINGS[gender]
        ending = F.when(kind == of, F.when(word.rlike(r"\p{IsCyrillic}"), cyrillic).when(word.rlike(r"\p{IsGreek}"), greek).otherwise(latin)).otherwise(ending)
    new = F.concat(permuted(word, key, tweak), ending)
    for names in GIVEN.values():
        at = F.array_position(F.array(*map(F.lit, names)), word)
        turn = (at + keyed(key, F.lit("list")) % (len(names) - 1)) % len(names)
        new = F.when((kind != FAMILY) & (at > 0), F.element_at(F.array(*map(F.lit, names)), (turn + 1).cast("int"))).otherwise(new)
    return new


def surrogate(kind: Column, found: Column, key: str, attempt: Column) -> Column:
    """The replacement of one mention; mentions of one entity get replacements of one entity."""
    tweak = F.concat(kind, F.lit(":"), attempt.cast("string"))
    email = F.concat(permuted(F.lower(found), key, tweak), F.lit(".example"))
    out = F.when(kind == "email", email).when(kind == "ip", surrogate_ip(found, key, tweak))
    out = out.when(kind == "card", surrogate_card(found, key, tweak)).when(is_name(kind), surrogate_word(kind, found, key, tweak))
    # marks don't count in a permutation, so all formats of a number get the same digits
    country = F.regexp_extract(found, rf"^({COUNTRY})?", 1)
    phone = F.concat(country, permuted(F.substring(found, F.length(country) + 1, F.length(found)), key, tweak))
    return out.when(kind == "phone", phone).when(kind == "ssn", permuted(found, key, tweak)).otherwise(found)


def surrogates(found: Column, key: str) -> Column:
    """The replacements of an array of (kind, mention, attempt). Each is bound before it is used, so that it is worked out
    once; names are made wider before they are replaced."""
    wide = lambda f: F.concat(f["mention"], F.repeat(F.lower(F.right(f["mention"], F.lit(1))), F.when(is_name(f["kind"]), F.floor(f["attempt"] / WIDER).cast("int")).otherwise(0)))
    bound = F.transform(found, lambda f: F.struct(f["kind"].alias("kind"), wide(f).alias("mention"), f["attempt"].alias("attempt")))
    return F.transform(bound, lambda f: F.when(f["kind"].isNull(), f["mention"]).otherwise(surrogate(f["kind"], f["mention"], key, f["attempt"])))


def find(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text``, ``pieces``, ``found``, ``names``): the text between mentions, and the mentions as (kind, mention); a
    kind of null is a number that only looks like a card, and stays. ``names``: the words of the names, as (word, kind).

    A document in which names are found is searched once more, for their words alone too, as they are and in capitals.
    """
    rows = docs.select("doc_id", "text", F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(ANY), F.lit(0)).alias("mentions"))
    told = F.flatten(F.transform(F.filter("mentions", lambda m: kind_of(m) == "name"), name_words))
    rows = rows.withColumn("told", F.when(F.size("mentions") > 0, told))
    words = F.array_distinct(F.transform("told", lambda t: t["word"]))
    kind = lambda w: F.array_min(F.transform(F.filter("told", lambda t: t["word"] == w), lambda t: t["kind"]))
    rows = rows.withColumn("names", F.when(F.size("told") > 0, F.transform(words, lambda w: F.struct(w.alias("word"), kind(w).alias("kind")))))
    spelt = F.array_join(F.flatten(F.transform("names", lambda n: F.array(n["word"], F.upper(n["word"])))), "|")
    # the words are letters and hyphens, so they are patterns of themselves
    wider = F.concat(F.lit(ANY[:-1] + r"|(?=\p{Lu})(?:"), spelt, F.lit(r")(?![\p{L}\p{N}]))"))
    named = F.col("names").isNotNull()
    rows = rows.withColumn("wider", F.when(named, wider))
    rows = rows.withColumn("mentions", F.when(named, F.regexp_extract_all("text", F.col("wider"), F.lit(0))).otherwise(F.col("mentions")))
    pieces = F.when(named, F.split("text", F.col("wider"), -1)).when(F.size("mentions") > 0, F.split("text", ANY, -1))
    found = F.transform("mentions", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("mention")))
    return rows.select("doc_id", "text", pieces.alias("pieces"), F.when(F.size("mentions") > 0, found).otherwise(F.array().cast("array<struct<kind:string,mention:string>>")).alias("found"), "names")


def entities(found: DataFrame, *more: str) -> DataFrame:
    """(``kind``, ``entity``) of all mentions but names, and of the words of names that aren't listed; with the columns ``more``."""
    plain = F.filter("found", lambda f: f["kind"].isNotNull() & (f["kind"] != "name"))
    each = F.transform(plain, lambda f: F.struct(f["kind"].alias("kind"), canonical(f["kind"], f["mention"]).alias("entity")))
    unlisted = F.filter("names", lambda n: (n["kind"] == FAMILY) | ~n["word"].isin(LISTED))
    words = F.transform(unlisted, lambda n: F.struct(n["kind"].alias("kind"), n["word"].alias("entity")))
    all_ = F.concat(each, F.coalesce(words, F.array().cast("array<struct<kind:string,entity:string>>")))
    return found.select(*more, F.explode(all_).alias("e")).select(*more, "e.kind", "e.entity")


def overrides(found: DataFrame, key: str) -> DataFrame:
    """Entities whose first surrogate collides: (``kind``, ``entity``, ``attempt``), the first attempt that doesn't.

    All distinct entities of the corpus are gathered by a pre-aggregated group-by, each with its first surrogate. One that
    equals an entity of the corpus, or that an entity before it in order has drawn too, is drawn again, and only those:
    round by round, against all entities and all surrogates in use, until none is left. Names whose format may be used up
    grow by a letter every ``WIDER`` draws.
    """
    spark = found.sparkSession
    # as many tasks as shuffles have, however few bytes there are: it is the drawing that takes time
    seen = entities(found).distinct().repartition(shuffle_partitions(spark))
    # words of names are told apart whatever their kind, other entities within their kind
    sort = F.when(is_name(F.col("kind")), "name").otherwise(F.col("kind")).alias("sort")

    def made(rows: DataFrame) -> DataFrame:
        one = F.array(F.struct("kind", F.col("entity").alias("mention"), "attempt"))
        return rows.withColumn("made", F.transform(surrogates(one, key), lambda m: canonical(F.col("kind"), m))[0]).withColumn("sort", sort)

    drawn = made(seen.withColumn("attempt", F.lit(0)))
    # in use: entities (attempt -1), all listed names, and, from each round, the surrogates that stay
    real = seen.select("kind", "entity", F.lit(-1).alias("attempt"), F.col("entity").alias("made"), sort)
    listed = spark.createDataFrame([(PERSON, n, -1, n, "name") for n in LISTED], "kind string, entity string, attempt int, made string, sort string")
    used = cut(drawn.unionByName(real).unionByName(listed))
    first = used.groupBy("sort", "made").agg(F.min(F.struct("attempt", "entity", "kind")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = used.filter("attempt = 0").join(first, ["sort", "made"]).filter("first.attempt < 0 or first.entity <> entity or first.kind <> kind")
    open_ = cut(late.select("kind", "entity", "attempt"))
    again = open_.limit(0)
    # surrogates that were given up stay in use, so that none is drawn by another one later
    for attempt in range(1, DRAWS):
        if open_.isEmpty():
            return again
        tries = cut(made(open_.withColumn("attempt", F.lit(attempt))))
        taken = used.join(tries.select("sort", "made").distinct(), ["sort", "made"], "left_semi").select("sort", "made").distinct()
        free = tries.join(taken, ["sort", "made"], "left_anti")
        kept = cut(free.groupBy("sort", "made").agg(F.min(F.struct("kind", "entity")).alias("e")).select("e.kind", "e.entity", F.lit(attempt).alias("attempt"), "made", "sort"))
        used, again = used.unionByName(kept), again.unionByName(kept.drop("made", "sort"))
        open_ = cut(open_.join(kept, ["kind", "entity"], "left_anti"))
    if open_.isEmpty():
        return again
    raise RuntimeError(f"some surrogates collide after {DRAWS} draws")


def replace_private(docs: DataFrame, key: str = "tidemark") -> DataFrame:
    """Whole texts with surrogates for personal data: (``doc_id``, ``text``, ``n_replaced``, ``kinds``).

    Found are mail addresses, IPv4 addresses, phone numbers, social security numbers, card numbers that keep the card
    rule, names after a title or with a listed given name, and each word of such a name wherever else it stands in the
    document with a capital or in capitals. A surrogate depends on the key, the kind and the entity alone, so an entity has
    the same one everywhere (coreference); the words of a name are entities of their own, so whole names, titled family
    names and bare ones agree. It has the original's format: letters keep script and case, digits their places, octets
    their range, cards the rule; given names keep gender (of the list, else of the title) and script; mail addresses end
    in the reserved ``.example``. Surrogates are keyed permutations of their format, so distinct entities of one format
    stay distinct; what can still collide (with an entity of the corpus, or across formats) is found by ``overrides`` over
    all entities, and drawn again. Listed given names change places among each other. Documents move only if there are
    entities drawn again, by id, with what to draw again.

    Null text: stays null, nothing replaced. Null ids, repeated rows: one result each. Very long texts: whole. Empty
    table: empty result. Other columns are not read.
    """
    found = find(docs)
    again = cut(overrides(found, key))
    attempt = lambda kind, mention: F.lit(0)
    rows = find(docs)
    if not again.isEmpty():
        told = entities(found, "doc_id").join(again, ["kind", "entity"]).groupBy(F.col("doc_id").alias("told_id")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "entity"), "attempt"))).alias("again"))
        rows = rows.join(told, rows["doc_id"].eqNullSafe(told["told_id"]), "left")
        attempt = lambda kind, mention: F.coalesce(F.try_element_at(F.col("again"), F.concat_ws(":", kind, canonical(kind, mention))), F.lit(0))
    words = F.transform("names", lambda n: F.struct(n["kind"].alias("kind"), n["word"].alias("mention"), attempt(n["kind"], n["word"]).alias("attempt")))
    rows = rows.withColumn("book", F.when(F.col("names").isNotNull(), F.map_from_arrays(F.transform("names", lambda n: n["word"]), surrogates(words, key))))
    # of words that differ in case alone, the first one's surrogate stands for both in capitals
    add = lambda acc, e: F.when(F.map_contains_key(acc, F.upper(e["key"])), acc).otherwise(F.map_concat(acc, F.create_map(F.upper(e["key"]), F.upper(e["value"]))))
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("capitals", F.when(F.col("book").isNotNull(), F.aggregate(F.map_entries("book"), none, add)))
    word = lambda w: F.coalesce(F.try_element_at("book", w), F.try_element_at("capitals", w), w)
    named = F.transform("found", lambda f: F.when(f["kind"] == "name", F.concat(title_of(f["mention"]), F.array_join(F.transform(words_of(f["mention"]), word), " "))))
    drawn = F.transform("found", lambda f: F.struct(F.when(f["kind"] != "name", f["kind"]).alias("kind"), f["mention"].alias("mention"), F.when(f["kind"] != "name", attempt(f["kind"], f["mention"])).alias("attempt")))
    new = F.zip_with(named, surrogates(drawn, key), lambda a, b: F.coalesce(a, b))
    # a piece before each mention and one after the last
    joined = F.array_join(F.flatten(F.zip_with("pieces", new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    kinds = F.filter(F.transform("found", lambda f: f["kind"]), lambda k: k.isNotNull())
    out = F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(F.size("found") > 0, joined).otherwise(F.col("text"))
    return rows.select("doc_id", out.alias("text"), F.size(kinds).cast("long").alias("n_replaced"), kinds.alias("kinds"))


def op5_surrogates(spark, sf_dir):
    from .common import table

    return replace_private(table(spark, sf_dir, "documents"))
