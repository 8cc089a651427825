"""Text functions as Column expressions. Word and pattern lists are fixed values of the query semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

STOP_WORDS = ["aber", "als", "auch", "das", "der", "die", "ein", "eine", "für", "ist", "mit", "oder", "sind", "und", "von", "was", "welche", "wie", "wird", "the", "and", "what", "which"]
#: Left out of a search for media.
MEDIA_STOP_WORDS = ["aber", "auch", "das", "der", "die", "eine", "einer", "eines", "für", "ist", "mit", "oder", "sind", "und", "von", "was", "welche", "welcher", "welches", "wie", "the", "what", "which", "with", "and", "are"]
GERMAN_CUES = [" der ", " die ", " und ", " auflage ", " seite "]
ENGLISH_CUES = [" the ", " and ", " edition ", " chapter ", " page "]
NEGATIONS = ["kein", "keine", "keinem", "keinen", "keiner", "keines", "nie", "niemals", "nicht", "ohne", "no", "not", "never", "without"]
WORD = r"[\p{L}\p{N}]+(?:[-_/][\p{L}\p{N}]+)*"
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def let(value: Column, then) -> Column:
    """then(value) with value computed once: a lambda that names an outer expression would compute it for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def one_space(s: Column) -> Column:
    """White space runs become single spaces, none outside."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def folded(s: Column) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def book_text(s: Column) -> Column:
    """Letters a-z and digits of the folded text, accents dropped, all else as single spaces."""
    return F.trim(F.regexp_replace(F.translate(folded(s), *ACCENTS), "[^a-z0-9]+", " "))


def search_terms(s: Column) -> Column:
    """Distinct folded words, inner hyphens kept, of two characters or more or a single capital or digit, without stop words."""
    words = F.regexp_extract_all(one_space(s), F.lit(WORD), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) | w.rlike(r"^[\p{Lu}\p{Nd}]$"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(F.transform(kept, folded), lambda w: ~F.array_contains(stop, w)))


def term_tokens(s: Column) -> Column:
    """Words of book_text with three letters or more that are no stop words and have no digit."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(book_text(s), " "), lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]") & ~F.array_contains(stop, w))


def estimated_tokens(s: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(s) / 4)).cast("long")


def raw_tokens(s: Column) -> Column:
    """Words and single punctuation marks."""
    return F.size(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).cast("long")


def cue_count(s: Column, cues: list[str]) -> Column:
    padded = F.concat(F.lit(" "), F.lower(s), F.lit(" "))
    return sum(((F.length(padded) - F.length(F.replace(padded, F.lit(c), F.lit("")))) / len(c) for c in cues), F.lit(0)).cast("long")


def language(s: Column) -> tuple[Column, Column]:
    """Language and confidence by German and English function words; German at 0.4 without any."""
    german, english = cue_count(s, GERMAN_CUES), cue_count(s, ENGLISH_CUES)
    none = (german == 0) & (english == 0)
    return F.when(none | (german >= english), "de").otherwise("en"), F.when(none, 0.4).otherwise(0.8)


def sentences(s: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(s, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: x != "")


def isbn(s: Column) -> Column:
    """The 10 or 13 characters of a valid ISBN, else null."""
    d = F.regexp_replace(F.upper(s), "[^0-9X]", "")
    digit = lambda i: F.when(F.substring(d, i, 1) == "X", 10).otherwise(F.substring(d, i, 1).try_cast("int"))
    ten = sum(((11 - i) * digit(i) for i in range(1, 11)), F.lit(0))
    thirteen = sum(((1 if i % 2 else 3) * digit(i) for i in range(1, 13)), F.lit(0))
    return F.when((F.length(d) == 10) & (ten % 11 == 0), d).when((F.length(d) == 13) & ((10 - thirteen % 10) % 10 == digit(13)), d)


def roman(s: Column) -> Column:
    """Value of a Roman numeral: a letter counts negative before a larger one."""
    value = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p])
    values = F.transform(F.split(F.upper(s), ""), lambda c: F.element_at(value, c))
    signed = let(values, lambda v: F.transform(v, lambda x, i: F.when(x < F.coalesce(F.get(v, i + 1), F.lit(0)), -x).otherwise(x)))
    return F.aggregate(signed, F.lit(0), lambda a, x: a + x)


def page_locator(s: Column) -> Column:
    """Struct of first and last page, and the suffix, of locators such as 12, 12-15, 12f and 12ff; null for others.

    f reaches the next page, ff two pages; a range of more than 500 pages, or one that falls, is none.
    """
    # One match a locator: its groups are written between marks, and a text with a mark is no locator.
    mark, pattern = "\u0001", r"^\s*(\d+)(?:\s*[-–—]\s*(\d+))?(?:\s*(ff?)\.?)?\s*$"
    groups = F.split(F.when(~F.contains(s, F.lit(mark)), F.regexp_replace(s, pattern + r"[\s\S]*", f"$1{mark}$2{mark}$3")), mark)

    def pages(g: Column) -> Column:
        first, last, suffix = F.get(g, F.lit(0)).try_cast("int"), F.get(g, F.lit(1)), F.get(g, F.lit(2))
        last = F.when(last != "", last.try_cast("int")).otherwise(first + F.length(suffix))
        return F.struct(first.alias("first"), last.alias("last"), suffix.alias("suffix"))

    right = lambda x: (x["first"] >= 1) & (x["last"] >= x["first"]) & (x["last"] - x["first"] <= 500)
    return let(let(groups, lambda g: F.when(F.size(g) == 3, pages(g))), lambda x: F.when(right(x), x))


def index_entry(s: Column) -> Column:
    """Struct of term and locators of a subject index line: the longest list of page numbers at its end."""
    pattern = r"^(.*?\D)[, ]\s*((?:[1-9]\d*(?:-[1-9]\d*)?(?:ff?)?)(?:, ?[1-9]\d*(?:-[1-9]\d*)?(?:ff?)?)*)$"
    term, pages = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)
    term = F.rtrim(F.regexp_replace(term, r"[,\s]+$", ""))
    return F.when((pages != "") & (term != "") & (F.size(F.split(term, " ")) <= 12), F.struct(term.alias("term"), F.split(F.regexp_replace(pages, " ", ""), ",").alias("locators")))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two arrays of distinct terms."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(x, F.lit(-709.0)), F.lit(709.0))))


def prefixed_id(prefix: str, *parts: Column, size: int = 24) -> Column:
    """prefix-<hex> of the sha-256 of parts joined by NUL."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, size))


#: Signals of a question's complexity with their weights (fixed values).
SIGNALS = [
    ("comparison", 2, r"(?i)\b(?:vergleiche|vergleich|unterschied|gegenüber|versus|vs\.?|compare|difference)\b"),
    ("global", 2, r"(?i)\b(?:im gesamten (?:buch|werk)|kapitelübergreifend|über alle|gesamtüberblick|globale?|entwick(?:lung|le)|zusammenfass(?:en|ung)|fass(?:e|en).{0,40}zusammen|across (?:the )?book|overall)\b"),
    ("multi_hop", 2, r"(?i)\b(?:ursache.{0,40}wirkung|warum.{0,80}(?:dadurch|deshalb|folg)|wie.{0,60}(?:beeinflusst|führt|wirkt)|cause.{0,40}effect|how.{0,60}affect)\b"),
    ("calculation", 1, r"(?i)\b(?:berechne|ermittle|bestimme|rechne|calculate|compute|derive|herleite)\b"),
    ("direct", -1, r"(?i)^\s*(?:was (?:ist|bedeutet)|definiere|definition|wo (?:steht|finde)|welche seite|wie lautet (?:die )?(?:formel|definition)|what is|define|where is)\b"),
]
#: Question words (fixed values).
QUESTION_WORD = r"(?i)\b(?:was|wie|warum|wann|wo|welche[rmns]?|wer|wodurch|what|how|why|where|which|who)\b"
#: Where a question falls into clauses (fixed values).
CLAUSE = r"(?i)[;?]+|\b(?:sowie|außerdem|zusätzlich|and additionally)\b|\b(?:und|and)\s+(?=(?:was|wie|warum|wann|wo|welche[rmns]?|wer|wodurch|what|how|why|where|which|who)\b)"
#: Candidate cap, least and most results, facets, evidence tokens by complexity (fixed values).
BUDGETS = {"simple": (24, 1, 5, 1, 320), "standard": (40, 2, 8, 2, 1200), "complex": (72, 4, 14, 4, 2400)}


def complexity(question: Column, session: Column | None = None, entities: Column | None = None, editions: Column | None = None) -> tuple[Column, Column]:
    """Score and class (simple, standard, complex) of a question."""
    q = one_space(question)
    clauses = F.filter(F.transform(F.split(q, CLAUSE), lambda c: F.btrim(c, F.lit(" -.,:?"))), lambda c: c != "")
    asked = F.size(F.filter(clauses, lambda c: c.rlike(QUESTION_WORD)))
    score = sum((F.when(q.rlike(p) & (asked < 2 if name == "direct" else F.lit(True)), w).otherwise(0) for name, w, p in SIGNALS), F.lit(0))
    score = score + (asked >= 2).cast("int")
    for extra, least in ((session, None), (entities, 2), (editions, 2)):
        if extra is not None:
            score = score + (extra if least is None else extra >= least).cast("int")
    return score, F.when(score <= 0, "simple").when(score <= 2, "standard").otherwise("complex")


def negated(terms: Column) -> Column:
    return F.arrays_overlap(terms, F.array(*[F.lit(w) for w in NEGATIONS]))


def host_policy(url: Column) -> Column:
    """'allow', 'loopback', 'private', 'credentials', 'scheme' or 'invalid': what an egress check makes of a URL."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d+$", ""))
    private = host.rlike(r"^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)")
    loop = host.rlike(r"^(localhost|127\..*|\[::1\])$")
    return F.when(host == "", "invalid").when(~scheme.isin("http", "https"), "scheme").when(authority.contains("@"), "credentials").when(loop, "loopback").when(private, "private").otherwise("allow")


#: The interrogative frame of a question (fixed values).
FRAME = r"(?i)^\s*(?:was|wer|wen|wem|wie|wo|wohin|woher|wann|warum|weshalb|wieso|wodurch|womit|wofür|welche[rsnm]?|what|which|how|where|when|why)\b\s*(?:ist|sind|war|waren|wird|werden|bedeutet|heißt|nennt\s+man|versteht\s+man\s+unter|gibt\s+es|macht|kann|können|muss|müssen|darf|dürfen|is|are|does|do)?\s*(?:\b(?:der|die|das|den|dem|des|ein|eine|einen|einem|einer|eines|the|a|an)\b)?\s*"
#: Its end (fixed values).
FRAME_TAIL = r"(?i)\s*\b(?:gibt\s+es|gibt'?s|kennt\s+man|unterscheidet\s+man|are\s+there)\s*\??\s*$"


def retrieval_query(question: Column) -> Column:
    """A question without its interrogative frame, if three characters or more with a letter or digit remain."""
    first = F.regexp_extract(question, r"^([^\n]*)", 1)
    rest = F.substring(question, F.length(first) + 1, F.length(question))
    stripped = F.btrim(F.regexp_replace(F.regexp_replace(first, FRAME, ""), FRAME_TAIL, ""), F.lit(" \t?!.,;:"))
    return F.when((F.length(stripped) < 3) | ~stripped.rlike(r"[\p{L}\p{N}]"), question).otherwise(F.concat(stripped, rest))


def toc_entry(s: Column) -> Column:
    """Struct of title and page label of a contents line with dotted leaders, a tab or a wide gap; null for others."""
    pattern = r"^(.+?)(?:\s*(?:\.\s*){2,}|\t+|\s{2,})(\d+[a-z]?|[ivxlcdm]+)\s*$"
    title, label = F.regexp_extract(F.trim(s), pattern, 1), F.regexp_extract(F.trim(s), pattern, 2)
    return F.when(label != "", F.struct(title.alias("title"), label.alias("label")))


def numbering_depth(s: Column) -> Column:
    """Dots in the section number a title begins with; null without a number."""
    number = F.regexp_extract(s, r"^\s*(\d+(?:\.\d+)*)(?:[.):]?\s+)", 1)
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))))


#: Titles of navigation parts by role (fixed values).
ROLES = {
    "toc": ["inhaltsverzeichnis", "inhalt", "contents", "table of contents"],
    "index": ["sachwortverzeichnis", "stichwortverzeichnis", "sachregister", "subject index", "index"],
    "glossary": ["glossar", "glossary"],
    "abbreviations": ["abkurzungsverzeichnis", "abbreviations", "list of abbreviations"],
    "symbols": ["symbolverzeichnis", "nomenklatur", "nomenclature", "list of symbols"],
    "figures": ["abbildungsverzeichnis", "list of figures"],
    "tables": ["tabellenverzeichnis", "list of tables"],
    "formulas": ["formelverzeichnis", "gleichungsverzeichnis", "list of equations"],
}


def heading_role(s: Column) -> Column:
    name = book_text(s)
    out = F.lit(None).cast("string")
    for role, names in ROLES.items():
        out = F.when(name.isin(names), role).otherwise(out)
    return out


def line_kind(s: Column) -> Column:
    """table, formula, list or prose by a line's marks."""
    pipes = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    return F.when(pipes >= 2, "table").when(s.rlike(r"[=≤≥≈∑√]"), "formula").when(s.rlike(r"^\s*(?:[-*•]|\d+[.)])\s"), "list").otherwise("prose")


def facets(question: Column, most: int) -> Column:
    """Distinct clauses of a question, `most` at most, the question itself if there is none."""
    q = one_space(question)
    parts = F.filter(F.transform(F.split(q, CLAUSE), lambda c: F.btrim(c, F.lit(" \t\r\n-–—,.;:?"))), lambda c: c != "")
    return F.slice(F.when(F.size(parts) > 0, F.array_distinct(parts)).otherwise(F.array(q)), 1, most)


def verdict(s: Column) -> Column:
    """supported, refuted or unclear, by the first verdict word of a reply; null without one."""
    word = F.upper(F.regexp_extract(s, r"(?i)\b(BELEGT|WIDERLEGT|UNKLAR)\b", 1))
    return F.when(word == "BELEGT", "supported").when(word == "WIDERLEGT", "refuted").when(word == "UNKLAR", "unclear")


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(folded(s), *ACCENTS), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def authors(s: Column) -> Column:
    """Names split at semicolons, ampersands, slashes and 'and' or 'und'."""
    return F.filter(F.transform(F.split(s, r"\s*(?:;|&|/|\band\b|\bund\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def compact_count(s: Column) -> Column:
    """1.2k, 3M and the like as a number; null for others."""
    number, unit = F.regexp_extract(s, r"^\s*(\d+(?:\.\d+)?)\s*([kKmMbB]?)\s*$", 1), F.lower(F.regexp_extract(s, r"^\s*(\d+(?:\.\d+)?)\s*([kKmMbB]?)\s*$", 2))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.round(number.try_cast("double") * scale).cast("long")


def fuzzy(candidate: Column, pattern: str) -> Column:
    """Whether a pattern's letters occur in the candidate in order, case aside; the score falls with the letters between."""
    letters = [c for c in pattern.lower() if not c.isspace()]
    escaped = [("\\" + c if c in r"\.^$*+?()[]{}|" else c) for c in letters]
    span = F.regexp_extract(F.lower(candidate), "(" + ".*?".join(escaped) + ")", 1)
    return F.when(F.length(span) > 0, F.lit(float(len(letters))) / F.length(span))


#: Technical literals: standards, numbers with units and ranges, plain numbers, codes, names with an underscore, Greek
#: letters (fixed values); and the marks of evidence that are none.
LITERAL = (
    r"(?iU)"
    r"(?:\b(?:DIN|EN|ISO|IEC|VDI|ASTM)\s*[A-Z0-9][A-Z0-9 ./:+-]*\d\b)"
    r"|(?:(?<!\w)[+-]?\d+(?:[.,]\d+)?(?:e[+-]?\d+)?"
    r"(?:\s*(?:±|–|-|bis|to)\s*[+-]?\d+(?:[.,]\d+)?(?:e[+-]?\d+)?)?\s*"
    r"(?:%|‰|mm|cm|km|m|µm|nm|mg|kg|g|t|Pa|kPa|MPa|GPa|N|kN|W|kW|MW|V|A|Hz|K|°C|°)\b)"
    r"|(?:(?<!\w)[+-]?\d+(?:[.,]\d+)?(?:e[+-]?\d+)?\b)"
    r"|(?:\b[A-Z][A-Z0-9]*(?:[/.-][A-Z0-9]+)+\b)"
    r"|(?:\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9]+\b)"
    r"|(?:[α-ωΑ-Ω](?:_[A-Za-z0-9]+)?)"
)
EVIDENCE_MARK = r"(?i)\[(?:E|C)\d+\]"


def technical_literals(s: Column) -> Column:
    """Distinct literals of a text in its compatible form, in lower case without white space."""
    # Python gets nulls for plain texts: what goes there is worked out for all rows.
    plain = F.coalesce(nfkc(F.when(s.rlike(r"[^\x00-\x7f]"), s)), s)
    found = F.regexp_extract_all(F.regexp_replace(plain, EVIDENCE_MARK, ""), F.lit(LITERAL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))))


def strictly_supported(answer: Column, evidence: Column) -> Column:
    """Whether all literals of an answer stand in its evidence."""
    return F.size(F.array_except(technical_literals(answer), technical_literals(evidence))) == 0


def sentence_offsets(s: Column) -> Column:
    """Begin and end of each sentence, without outer white space, in characters of the text."""
    marked = F.split(F.regexp_replace(s, r"([.!?])(\s+)", "$1\u0001$2\u0001"), "\u0001")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x) - F.length(F.ltrim(F.regexp_replace(x, r"^\s+", "")))
        end = a["at"] + F.length(F.regexp_replace(x, r"\s+$", ""))
        span = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct((a["at"] + F.length(x)).alias("at"), F.when(F.trim(F.regexp_replace(x, r"\s+", "")) == "", a["out"]).otherwise(F.concat(a["out"], span)).alias("out"))

    return F.aggregate(marked, state, step, lambda a: a["out"])


@F.pandas_udf(StringType())
def nfkc(s):
    """Compatibility composition, which no built-in function has."""
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(s):
    """Compatibility decomposition without combining marks."""
    import unicodedata

    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def any_book_text(s: Column) -> Column:
    """book_text for any script: only texts beyond Latin letters go through Python."""
    plain = F.replace(s, F.lit("ß"), F.lit("ss"))
    decomposed = F.coalesce(without_marks(F.when(plain.rlike(r"[^\x00-\x7f]"), plain)), plain)
    return F.trim(F.regexp_replace(F.replace(F.lower(decomposed), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))
