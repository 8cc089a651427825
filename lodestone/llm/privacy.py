"""Surrogates for personal data (operator 9), in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .lines import NO_ID
from .quality import let

KEY = "lodestone-surrogate-key"
#: Titles that mark a name, by the gender they tell; the last tell none (fixed values).
MALE = ["Mr", "Mister", "Herr", "Hr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Lord", "M", "Κύριος", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Lady", "Dame", "Κυρία", "Госпожа"]
NEUTRAL = ["Dr", "Prof", "Professor", "Doctor", "Docteur", "Doktor", "Dra", "Доктор"]
TITLES = "|".join(MALE + FEMALE + NEUTRAL)
#: Words that are no names, though they may follow one with a capital (fixed values).
NO_NAMES = ["the", "a", "an", "and", "of", "in", "on", "at", "to", "for", "he", "she", "it", "they", "we", "i", "is", "was", "der", "die", "das", "und", "in", "im", "er", "sie", "es", "wir", "ich", "ein", "eine", "le", "la", "les", "et", "il", "elle", "un", "une", "el", "los", "las", "y", "en", "que"]
#: Small words inside names, and before a surname with an apostrophe (fixed values).
PARTICLES = ["von", "vom", "van", "der", "den", "zu", "zur", "de", "del", "della", "di", "da", "do", "dos", "du", "la", "le", "bin", "ibn", "al", "el"]
SMALL = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}(?:[dl]['’](?=\p{{Lu}}))?"
ELIDED = r"^[dl]['’](?=\p{Lu})"
#: A verb and the word after it that tell a question from a name (fixed values).
ASKED = "(?:Will|May|Can|Might|Must|Shall) (?:I|he|she|it|we|you|they|there|the|a|an|this|that|these|those|my|your|his|her|its|our|their|any|some|all|not)"
W = r"\p{L}\p{N}"
#: A word of a name, or an initial.
NAME = r"\p{Lu}(?:\p{L}+(?:[-'’]\p{L}{2,})*|['’]\p{L}{2,}(?:-\p{L}{2,})*|\.)"
PATTERNS = {
    "email": rf"(?<![{W}._%+-])[{W}._%+-]++@(?:[{W}-]++\.)++[{W}-]*[{W}]",
    "secret": rf"(?<![{W}])(?:[0-9a-fA-F]{{32,}}+|AKIA[0-9A-Z]{{16}}|(?:sk|pk|gh[pousr])[-_][0-9A-Za-z]{{20,}}+)(?![{W}])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ip6": rf"(?<![{W}:.])(?:(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|(?:[0-9a-fA-F]{{1,4}}:){{2,6}}(?::[0-9a-fA-F]{{1,4}}){{1,5}})(?![{W}:])",
    "iban": rf"(?<![{W}])[A-Z]{{2}}\d{{2}}(?: ?\d{{4}}){{3,7}}(?: ?\d{{1,3}})?(?![{W}])",
    "phone": rf"(?<![{W}+])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}|\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}}|0\d{{2,4}} \d{{3,4}} \d{{3,4}}(?![ -]?\d))(?!\d)",
    "card": r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,4}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "name": rf"(?<![{W}])(?=\p{{Lu}})(?:{TITLES})(?:\.? (?:{TITLES}))?\.? {SMALL}{NAME}(?: {SMALL}{NAME}){{0,2}}",
}
#: All kinds in one pattern; a card's back reference by its name, as numbers differ within the whole.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace("([ -]?)", "(?<gap>[ -]?)").replace(r"\1", r"\k<gap>")
#: The same, and any other word with a capital: in texts with names it may be one of them.
LOOSE = rf"(?:(?<![{W}'’-])|(?<=[dl]['’])(?<![{W}][dl]['’]))(?!{ASKED}(?![{W}])){NAME}"
WIDE = f"{ANY}|{LOOSE}"
#: What a text must have to hold any of them.
HINT = rf"[0-9@]|(?<![{W}])(?=\p{{Lu}})(?:{TITLES})\.? {SMALL}\p{{Lu}}|AKIA|(?:sk|pk|gh[pousr])[-_]|[a-fA-F]{{32}}"
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "ta", "ve", "ka", "lo", "mi", "pe", "ro"],
    "greek": ["βα", "δε", "φι", "γο", "λυ", "μα", "νε", "ρι", "σο", "τα", "βε", "κα", "λο", "μι", "πε", "ρο"],
    "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "та", "ве", "ка", "ло", "ми", "пе", "ро"],
}
#: How names end: given names of men, of women and of people whose title tells no gender, and surnames.
ENDINGS = {"latin": {"m": "n", "f": "na", "n": "el", "s": "ler"}, "greek": {"m": "νος", "f": "να", "n": "ης", "s": "ίδης"}, "cyrillic": {"m": "н", "f": "на", "n": "ль", "s": "ко"}}


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(entity.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def head(kind: Column, entity: Column) -> Column:
    """What stays in front: a phone's country code or leading zero, a name's title."""
    return F.when(kind == "phone", F.regexp_extract(entity, r"^(?:\+\d{1,3}?(?=[ .(-])|0(?=\d{2,4} ))", 0)).when(kind == "name", F.regexp_extract(entity, rf"^(?:{TITLES})(?:\.? (?:{TITLES}))?\.? ", 0)).when(kind == "iban", F.substring(entity, 1, 2)).otherwise("")


def tail(kind: Column, entity: Column) -> Column:
    """What stays at the end: an address's last label."""
    return F.when(kind == "email", F.regexp_extract(entity, r"\.[^.]*$", 0)).otherwise("")


def parts_of(kind: Column, head: Column, body: Column) -> Column:
    """The units that get a surrogate each: (kind, norm, at, title, lone). Names are taken word by word, so a surname alone
    refers to the same person as the full name; small words between them stay. title: the gender that the title tells;
    lone: a name of one word. Other kinds are letters and digits in lower case, whatever their separators."""
    titles = F.split(head, r"\.? ")
    female, male = (F.arrays_overlap(titles, F.array(*[F.lit(t) for t in some])) for some in (FEMALE, MALE))
    title = F.when(female, "f").when(male, "m").otherwise("n")
    script = F.when(body.rlike(r"\p{IsCyrillic}"), "cyrillic").when(body.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    words = F.split(body, " ")
    role = lambda i: F.when(i == F.size(words) - 1, "s").otherwise(title)
    lone = F.size(F.filter(words, lambda w: ~w.isin(PARTICLES))) == 1
    named = F.transform(words, lambda w, i: F.struct(F.concat(F.lit("name-"), script, F.lit("-"), role(i)).alias("kind"), F.lower(F.regexp_replace(w, ELIDED, "")).alias("norm"), i.alias("at"), title.alias("title"), lone.alias("lone")))
    solid = F.lower(F.regexp_replace(F.when(kind == "iban", F.concat(head, body)).otherwise(body), rf"[^{W}]", ""))
    other = F.array(F.struct(kind.alias("kind"), F.when(kind == "ip", body).otherwise(solid).alias("norm"), F.lit(0).alias("at"), F.lit("n").alias("title"), F.lit(False).alias("lone")))
    return F.when(kind == "name", F.filter(named, lambda u: ~F.get(words, u["at"]).isin(PARTICLES))).otherwise(other)


def digits_of(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: c.cast("int"))


def luhn(payload: Column) -> Column:
    """The check digit of a card number."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(F.reverse(digits_of(payload)), lambda d, i: F.when(i % 2 == 0, twice(d)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return ((10 - total % 10) % 10).cast("string")


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of a bank account: 98 less the remainder by 97."""
    code = lambda i: (F.ascii(F.substring(country, i, 1)) - 87).cast("string")
    left = F.aggregate(digits_of(F.concat(account, code(1), code(2), F.lit("00"))), F.lit(0), lambda a, d: (a * 10 + d) % 97)
    return F.lpad((98 - left).cast("string"), 2, "0")


def surrogate(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    """A replacement of the same kind, length and character classes, drawn by a keyed hash."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, F.lit(attempt)), 256)
    draw = lambda i, n: F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int") + 1
    pick = lambda letters, i: F.element_at(F.array(*[F.lit(c) for c in letters]), draw(i, len(letters)))
    hexes = kind.isin("secret", "ip6")

    def char(i: Column) -> Column:
        c = F.substring(norm, i, F.lit(1))
        return (
            F.when(c.rlike(r"\d"), F.when((i == 1) & ~hexes, pick("123456789", i)).otherwise(pick("0123456789", i)))
            .when(hexes & c.rlike("[a-f]"), pick("abcdef", i)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрст", i)).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστ", i))
            .when(c.rlike(r"\p{L}"), pick("àáâäèéêëíîïñóôöúûü", i)).otherwise(c))

    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm)), char), "")
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    out = F.when(kind == "ip", octets).when(kind == "card", let(F.substring(filled, F.lit(1), F.length(filled) - 1), lambda p: F.concat(p, luhn(p)))).otherwise(filled)
    account = F.substring(filled, F.lit(5), F.length(filled))
    out = F.when(kind == "iban", let(account, lambda x: F.concat(F.substring(norm, 1, 2), iban_check(F.substring(norm, 1, 2), x), x))).otherwise(out)
    for script, syllables in SYLLABLES.items():
        for role, ending in ENDINGS[script].items():
            word = F.concat(*[pick(syllables, F.lit(i)) for i in range(3 + attempt)], F.lit(ending))
            word = F.when(F.endswith(norm, F.lit(".")), F.concat(F.substring(word, 1, 1), F.lit("."))).otherwise(word)
            out = F.when(kind == f"name-{script}-{role}", word).otherwise(out)
    return out


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, sur): a surrogate for each distinct entity, no two of a kind alike and none a real one.

    Draws that collide, with an entity of the corpus, a surrogate given before or one of the same round with a smaller
    name, are drawn again. Rounds end when none is left; each leaves few, since formats have millions of values.
    Initials have few values and name no one: theirs may collide.
    """
    every = staged(entities.select("kind", "norm").distinct(), "entities")
    initial = F.endswith("norm", F.lit("."))
    real = every.where(~initial)
    open_, attempt = real, 0
    given = every.where(initial).withColumn("sur", surrogate(F.col("kind"), F.col("norm"), 0, key))
    first = True
    while True:
        drawn = open_.withColumn("sur", surrogate(F.col("kind"), F.col("norm"), attempt, key))
        free = drawn.join(real.select("kind", F.col("norm").alias("sur")), ["kind", "sur"], "left_anti")
        if not first:
            free = free.join(given.select("kind", "sur"), ["kind", "sur"], "left_anti")
        won = staged(free.groupBy("kind", "sur").agg(F.min("norm").alias("norm")).select("kind", "norm", "sur"), "surrogates")
        given, first = given.unionByName(won), False
        open_ = staged(open_.select("kind", "norm").join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "undrawn")
        if open_.isEmpty():
            return given
        attempt += 1


def cased(word: Column, like: Column) -> Column:
    """word in capitals, or with a capital, as `like` is."""
    return F.when((like == F.upper(like)) & (F.length(like) > 1) & ~F.endswith(like, F.lit(".")), F.upper(word)).otherwise(F.initcap(word))


def written(body: Column, kind: Column, subs: Column) -> Column:
    """body with its letters and digits replaced in order by those of the surrogate, in the case of the original; a name
    word by word, as subs (at, sur) say."""
    whole = F.element_at(subs, 1)["sur"]
    flat = F.when(kind == "iban", F.substring(whole, F.lit(3), F.length(whole))).otherwise(whole)
    state = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(rf"[{W}]")
        new = F.substring(flat, s["n"] + 1, F.lit(1))
        return F.struct((s["n"] + hit.cast("int")).alias("n"), F.concat(s["out"], F.when(~hit, c).when(c != F.lower(c), F.upper(new)).otherwise(new)).alias("out"))

    filled = F.aggregate(F.split(body, ""), state, step, lambda s: s["out"])

    def word(w: Column, i: Column) -> Column:
        small = F.regexp_extract(w, ELIDED, 0)
        new = F.get(F.filter(subs, lambda s: s["at"] == i), F.lit(0))["sur"]
        return F.coalesce(F.concat(small, cased(new, F.regexp_replace(w, ELIDED, ""))), w)

    names = F.array_join(F.transform(F.split(body, " "), word), " ")
    return F.when(kind == "ip", flat).when(kind == "name", names).otherwise(filled)


def found_in(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with `text` rewritten and the column n_entities (with leading underscores where docs has one) after its own.

    Found are e-mail and IP addresses of both kinds, phone, card, bank and social security numbers, keys and tokens, and names after a
    title, with small words like `von` and `d'` that stay; and wherever a word of such a name stands again in its document,
    with a capital, it is the same person's, but for a verb that begins a question. A lone word after a title is a given
    name where a longer name of the document has it as one, never as a surname, and no other gender; else a surname. An
    entity gets the same surrogate wherever it stands, keyed by `key`: of its kind, format, case, script and gender; card
    numbers and bank accounts have right check digits. Country codes, titles and an address's last label stay. Distinct
    entities get distinct surrogates, none of which is a real entity. Null texts stay null, texts without entities stay
    as they are and are not shuffled. Rows with equal id and text change alike; null ids are allowed; an empty table stays
    empty. Entities of a text are joined to their surrogates and put back by place, so time follows their number.
    """
    name = "n_entities"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ents = F.when(F.col("text").rlike(HINT), found_in(F.col("text"), ANY)).otherwise(F.array().cast("array<string>"))
    tagged = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("sub"), body, F.coalesce(ents, F.array().cast("array<string>")).alias("ents"))
    # Texts without a hint are not copied: they go straight from the scan to the result.
    hint = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    tagged = staged(tagged.where(F.coalesce(F.col("row.text").rlike(HINT), F.lit(False))), "tagged")
    plain = docs.where(~hint).select(body, F.lit(0).cast("long").alias("n"), F.col("text").alias("new"))
    plain = plain.unionByName(tagged.where(F.size("ents") == 0).select("row", F.lit(0).cast("long").alias("n"), F.col("row.text").alias("new")))
    having = tagged.where(F.size("ents") > 0)

    split = having.select("id", "sub", F.explode(F.array_distinct("ents")).alias("ent")).distinct().withColumn("kind", kind_of(F.col("ent")))
    split = split.withColumn("head", head(F.col("kind"), F.col("ent"))).withColumn("tail", tail(F.col("kind"), F.col("ent")))
    split = split.withColumn("body", F.expr("substr(ent, length(head) + 1, length(ent) - length(head) - length(tail))"))
    split = staged(split.withColumn("parts", parts_of(F.col("kind"), F.col("head"), F.col("body"))), "found")
    units = split.select("id", "sub", "ent", F.explode("parts").alias("part")).select("id", "sub", "ent", "part.*")
    # A given name after a title without gender is that of another title of the document, if there is one.
    same = Window.partitionBy("id", "sub", "norm")
    told = F.min(F.when(F.col("kind").rlike("^name-.*-[fm]$"), F.col("kind"))).over(same)
    units = units.withColumn("kind", F.when(F.col("kind").rlike("^name-.*-n$"), F.coalesce(told, "kind")).otherwise(F.col("kind")))
    surname = F.col("kind").rlike("^name-.*-s$")
    family = F.max(surname & ~F.col("lone")).over(same)
    given_name = F.min(F.when(F.col("kind").rlike("^name-.*-[fmn]$"), F.col("kind"))).over(same)
    units = units.withColumns({"family": family, "given_name": given_name})
    fits = (F.col("title") == "n") | F.endswith("given_name", F.lit("-n")) | F.endswith("given_name", F.concat(F.lit("-"), F.col("title")))
    units = units.withColumn("kind", F.when(surname & F.col("lone") & ~F.col("family") & F.col("given_name").isNotNull() & fits, F.col("given_name")).otherwise(F.col("kind")))
    units = staged(units.select("id", "sub", "ent", "at", "kind", "norm"), "units")
    known = dictionary(units, key)
    given = units.join(known, ["kind", "norm"])
    subs = given.groupBy("id", "sub", "ent").agg(F.array_sort(F.collect_set(F.struct("at", "sur"))).alias("subs"))
    whole = split.join(subs, ["id", "sub", "ent"]).select("id", "sub", F.lit(False).alias("loose"), F.col("ent").alias("key"), F.concat("head", written(F.col("body"), F.col("kind"), F.col("subs")), "tail").alias("sur"))
    # Words of the document's names, as a surname where a word is both.
    words = given.where(F.startswith("kind", F.lit("name-")) & ~F.endswith("norm", F.lit(".")) & ~F.col("norm").isin(NO_NAMES)).groupBy("id", "sub", "norm").agg(F.max_by("sur", "kind").alias("sur"))
    table = whole.unionByName(words.select("id", "sub", F.lit(True).alias("loose"), F.col("norm").alias("key"), "sur"))

    named = F.exists("ents", lambda e: e.rlike(rf"^(?:{TITLES})\.? "))
    spots = having.select("id", "sub", F.posexplode(F.when(named, found_in(F.col("row.text"), WIDE)).otherwise(F.col("ents"))).alias("at", "ent"))
    loose = F.col("ent").rlike(f"^{NAME}$") & ~F.col("ent").rlike(rf"^(?:{PATTERNS['secret']})$")
    spots = spots.withColumn("loose", loose).withColumn("key", F.when(loose, F.lower("ent")).otherwise(F.col("ent")))
    put = spots.join(table, ["id", "sub", "loose", "key"], "left")
    new_ent = F.when(F.col("sur").isNull(), F.col("ent")).when(F.col("loose"), cased(F.col("sur"), F.col("ent"))).otherwise(F.col("sur"))
    put = put.groupBy("id", "sub").agg(F.array_sort(F.collect_set(F.struct("at", new_ent.alias("new"), F.col("sur").isNotNull().alias("hit")))).alias("put"))
    joined = having.join(put, ["id", "sub"])
    pieces = F.when(named, F.split("row.text", WIDE)).otherwise(F.split("row.text", ANY))
    new = F.array_join(F.flatten(F.zip_with(pieces, "put", lambda p, e: F.array(p, F.coalesce(e["new"], F.lit(""))))), "")
    changed = joined.select("row", F.size(F.filter("put", lambda e: e["hit"])).cast("long").alias("n"), new.alias("new"))
    out = plain.unionByName(changed)
    return out.select(*[F.col("new").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], F.col("n").alias(name))
