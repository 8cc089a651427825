"""Subject indexes and contents lists from lines, whose meaning hangs on the lines before: scans in two levels."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ROLES
from ..sources.tables import staged

#: Page labels and plain ones; relations between terms (fixed values).
LABEL, PLAIN = r"(?:[a-z]{1,4}[-–]?\d+|\d+[a-z]?|[ivxlcdm]+)", r"\d+[a-z]?"
SEE = re.compile(r"^(.+?)[,;]?\s+(siehe\s+auch|see\s+also|siehe|see)\s+(.+?)\s*$", re.IGNORECASE)
CONTENTS = re.compile(rf"^(.+?)(?:\s*(?:\.\s*){{2,}}|\t+|\s{{2,}})({LABEL})\s*$", re.IGNORECASE)
NUMBERING = re.compile(r"^\s*(?:(?:chapter|kapitel|teil|part|article|artikel)\s+)?((?:\d+|[IVXLCDM]+)(?:\.\d+)*)(?:[.):]?\s+)", re.IGNORECASE)
#: A sub-entry is indented by so much; a wrapped title begins within so much of its own; a level is so wide; the deepest
#: level; the most words of an index term (fixed values).
SUB_INDENT, WRAP_INDENT, LEVEL_WIDTH, DEEPEST, MOST_WORDS = 10, 12, 15, 6, 12


def pages_of(label: str) -> re.Pattern:
    one = rf"{label}(?:\s*[-–—]\s*{label})?(?:\s*f{{1,2}}\.?)?"
    return re.compile(rf"{one}(?:\s*,\s*{one})*\s*$", re.IGNORECASE)


NO_PAGE = re.compile(r"(?<!\d)0+(?!\d)")
LISTS = [pages_of(PLAIN), pages_of(LABEL)]


def plain(text: str) -> str:
    """Letters and digits without marks in small letters, by single spaces."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", bare.casefold()).split())


@lru_cache(maxsize=1)
def headings() -> frozenset[str]:
    return frozenset(x for names in ROLES.values() for x in names)


def index_entry(text: str) -> tuple[str, str] | None:
    """(term, pages) by the longest list of pages at the end; plain numbers first, so that a code stays with its term.
    There is no page 0: a list with one is none."""
    for pages in LISTS:
        for gap in re.finditer(r"\s*,\s*|\s+", text):
            term = text[: gap.start()].strip(" ,;.")
            if any(c.isalpha() for c in term) and len(term.split()) <= MOST_WORDS and pages.match(text, gap.end()) and not NO_PAGE.search(text, gap.end()):
                return term, text[gap.end() :].strip()
    return None


def is_entry(text: str) -> bool:
    return SEE.match(text) is not None or index_entry(text) is not None


@dataclass(frozen=True)
class Line:
    at: int
    text: str
    indent: float


class Wraps:
    """Joins an open line with the one that goes on with it. State: the open line before, or None."""

    start = None

    @staticmethod
    def joined(open_line: Line | None, line: Line) -> Line | None:
        if open_line is None or not line.text[:1].islower() or plain(line.text) in headings():
            return None
        both = f"{open_line.text} {line.text}"
        return Line(open_line.at, both, open_line.indent) if is_entry(both) else None

    @staticmethod
    def alone(line: Line) -> tuple[Line | None, Line | None]:
        """(entry, open line) of a line by itself."""
        if not line.text or plain(line.text) in headings():
            return None, None
        return (line, None) if is_entry(line.text) else (None, line)

    def run(self, lines: list[Line], state: Line | None) -> tuple[list[Line], Line | None]:
        out = []
        for line in lines:
            entry, state = (whole, None) if (whole := self.joined(state, line)) else self.alone(line)
            if entry:
                out.append(entry)
        return out, state

    def summary(self, lines: list[Line]) -> tuple:
        """The first line, and the state at the end if that is taken by the line before, and if it isn't."""
        return lines[0], self.run(lines[1:], None)[1], self.run(lines, None)[1]

    def after(self, summary: tuple, state: Line | None) -> Line | None:
        return summary[1] if self.joined(state, summary[0]) else summary[2]


class Parents:
    """Gives sub-entries their main entry. State: (indent, term) of the last main entry, or None."""

    start = None

    def run(self, lines: list[Line], state: tuple[float, str] | None) -> tuple[list[tuple], tuple[float, str] | None]:
        out = []
        for line in lines:
            see = SEE.match(line.text)
            if see:
                relation = "see_also" if re.search("auch|also", see.group(2).lower()) else "see"
                out.append((line.at, see.group(1).strip(" ,;"), None, relation, see.group(3).strip(" ,;"), []))
                continue
            term, pages = index_entry(line.text)
            sub = state is not None and line.indent >= state[0] + SUB_INDENT
            if not sub:
                state = line.indent, term
            out.append((line.at, state[1], term if sub else None, None, None, re.split(r"\s*,\s*", pages)))
        return out, state

    def summary(self, lines: list[Line]) -> list[tuple[float, tuple[float, str]]]:
        """The state at the end by the first line that becomes a main entry: only a line of less indent than all before
        it can be that, whatever the state at the begin."""
        own = [x for x in lines if not SEE.match(x.text)]
        least, found = float("inf"), []
        for i, line in enumerate(own):
            if line.indent < least:
                least = line.indent
                found.append((least, self.run(own[i:], None)[1]))
        return found

    def after(self, summary: list[tuple[float, tuple[float, str]]], state: tuple[float, str] | None) -> tuple[float, str] | None:
        return next((end for indent, end in summary if state is None or indent < state[0] + SUB_INDENT), state)


class Contents:
    """Titles of a contents list, wrapped ones whole. State: the last line that may begin a title, or None."""

    start = None

    def run(self, lines: list[Line], state: Line | None) -> tuple[list[tuple], Line | None]:
        out = []
        for line in lines:
            if plain(line.text) in headings():
                continue
            match = CONTENTS.match(line.text)
            if match is None:
                if line.text and not LISTS[1].search(line.text):
                    state = line
                continue
            title = match.group(1).strip(" .")
            if state is not None and abs(state.indent - line.indent) <= WRAP_INDENT:
                title = f"{state.text} {title}"
            state = None
            number = NUMBERING.match(title)
            depth = None if number is None else number.group(1).count(".") if number.group(1)[0].isdigit() else 0
            out.append((line.at, title, match.group(2), depth, line.indent))
        return out, state

    def summary(self, lines: list[Line]) -> tuple[bool, Line | None]:
        """Whether the state at the begin is gone, and the one at the end."""
        mark = Line(-1, "\0", 0.0)
        end = self.run(lines, mark)[1]
        return end is not mark, end

    def after(self, summary: tuple[bool, Line | None], state: Line | None) -> Line | None:
        return summary[1] if summary[0] else state


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, list[Line]]]:
    """(chunk, book, lines) of rows in order."""
    key, lines = None, []
    for b in batches:
        for chunk, book, at, text, indent in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (chunk, book):
                if lines:
                    yield *key, lines
                key, lines = (chunk, book), []
            lines.append(Line(at, text, indent))
    if lines:
        yield *key, lines


def scanned(rows: DataFrame, machine, schema: str) -> DataFrame:
    """machine.run over each book's lines, columns of schema behind the book's. rows: (book, at, text, indent).

    Rows are sorted by range, so a book of any length lies in several chunks. Every chunk tells what it makes of the
    state it begins with; only the books that a chunk's border cuts need that, so the driver sees at most one such
    summary for each chunk, and merges them in order. Then each chunk runs from its own state.
    """
    kind = rows.schema["book"].dataType.simpleString()
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = staged(rows.repartitionByRange(n, "book", "at").withColumn("chunk", F.spark_partition_id()), "lines")
    chunks = chunks.select("chunk", "book", "at", "text", "indent").repartitionById(n, "chunk").sortWithinPartitions("chunk", "book", "at")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for chunk, book, lines in segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([book]), pa.array([pickle.dumps(machine.summary(lines))], pa.binary())], ["chunk", "book", "told"])

    import pickle

    told = staged(chunks.mapInArrow(tell, f"chunk int, book {kind}, told binary"), "told")
    cut = told.groupBy("book").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    begins: dict[tuple, object] = {}
    state, before = machine.start, None
    for r in told.join(cut, told["book"].eqNullSafe(cut["book"]), "left_semi").orderBy("book", "chunk").collect():
        state = state if (r["book"],) == before else machine.start
        before = (r["book"],)
        begins[r["chunk"], r["book"]] = state
        state = machine.after(pickle.loads(bytes(r["told"])), state)

    fields = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, book, lines in segments(batches):
            out = machine.run(lines, begins.get((chunk, book), machine.start))[0]
            if out:
                values = [(x.at, x.text, x.indent) if isinstance(x, Line) else x for x in out]
                yield pa.RecordBatch.from_arrays([pa.array([book] * len(out)), *(pa.array(c, k) for c, k in zip(zip(*values, strict=True), kinds, strict=True))], ["book", *fields])

    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    kinds = [arrow[x.strip().split(" ")[1]] for x in re.split(r",(?![^<]*>)", schema)]
    return chunks.mapInArrow(run, f"book {kind}, {schema}")


def lines_of(lines: DataFrame, book: str, at: str, text: str, indent: str) -> DataFrame:
    return lines.select(F.col(book).alias("book"), F.col(at).cast("long").alias("at"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.coalesce(F.col(indent).cast("double"), F.lit(0.0)).alias("indent"))


def subject_index(lines: DataFrame, book: str, at: str, text: str, indent: str) -> DataFrame:
    """(book, at, term, subterm, relation, related, pages): entries of subject indexes from their lines in order.

    A line without pages is open: if the next begins with a small letter and both together are an entry, they are one,
    which stands where the first does; else the open line is dropped. Blank lines and headings of parts close an open
    line. An entry indented by 10 or more from the last main entry is a sub-entry of that one's term. "X see Y" and
    "X siehe auch Y" have a relation and no pages. Null lines are blank, null indents 0; lines of one place come in no
    certain order.
    """
    whole = scanned(lines_of(lines, book, at, text, indent), Wraps(), "at long, text string, indent double")
    return scanned(whole, Parents(), "at long, term string, subterm string, relation string, related string, pages array<string>").withColumnRenamed("book", book)


def contents_list(lines: DataFrame, book: str, at: str, text: str, indent: str) -> DataFrame:
    """(book, at, title, label, depth): entries of contents lists (or lists of figures, tables, formulas) from lines in order.

    A line without a page, other than a heading of a part, is put before the next title if both begin at about the same
    place. Depth is the section number's, or else the indent from the list's least, 15 for a level, 6 at most.
    """
    found = scanned(lines_of(lines, book, at, text, indent), Contents(), "at long, title string, label string, number int, indent double")
    least = found.groupBy(F.col("book").alias("_book")).agg(F.min("indent").alias("_least"))
    level = F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.bround((F.col("indent") - F.col("_least")) / LEVEL_WIDTH).cast("int")))
    joined = found.join(least, F.col("book").eqNullSafe(F.col("_book")))
    return joined.select(F.col("book").alias(book), "at", "title", "label", F.coalesce("number", level).alias("depth"))
