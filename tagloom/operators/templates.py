"""The feature template language, compiled to Spark columns.

    template := kind (literal | macro)*          kind: u, b or * (either case)
    macro    := %type[offset,column]             type x: the cell
                %type[offset,column,"pattern"]   type t: true or false; type m: the match
    offset   := integer, or @integer for an absolute row (@1 first, @-1 last)

An upper-case type lower-cases A-Z in what it gives. Cells before the sequence are
_x-1 to _x-4, then _x-#; after it _x+1 to _x+4, then _x+#.

Patterns: `^` at the front anchors, a final `$` does too, `.` is any character, `*`
repeats as little as possible, `?` is optional, and a backslash makes a class (a d l p
s u w, upper case for the complement) or quotes. All else stands for itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import ascii_lower

# fixed values: the usual templates for word segmentation
DEFAULT_TEMPLATES = (
    "u00:%x[-2,0]",
    "u01:%x[-1,0]",
    "u02:%x[0,0]",
    "u03:%x[1,0]",
    "u04:%x[2,0]",
    "u05:%x[-1,0]/%x[0,0]",
    "u06:%x[0,0]/%x[1,0]",
    "u07:%x[-2,0]/%x[-1,0]",
    "u08:%x[1,0]/%x[2,0]",
    "u09:%x[-1,0]/%x[1,0]",
    "b",
)

# fixed values: character classes of patterns
_CLASSES = {"a": "A-Za-z", "d": "0-9", "l": "a-z", "p": "!-/:-@\\[-`{-~", "s": " \\t-\\r", "u": "A-Z", "w": "A-Za-z0-9"}
_MACRO = re.compile(r'%([A-Za-z])\[(@?)(-?\d+),(\d+)(?:,"((?:[^"\\]|\\.)*)")?\]')
_NEAR = 4


def to_java_pattern(pattern: str) -> str:
    """The pattern as a regular expression of the JVM."""
    return to_pattern(pattern, "\\z", lambda c: "\\Q" + c + "\\E")


def to_pattern(pattern: str, last: str = "\\Z", quoted: Callable[[str], str] = re.escape) -> str:
    """The pattern as a regular expression: of Python, or with another mark of the end and other quotes."""
    out, i, end = [], 0, len(pattern)
    if pattern.startswith("^"):
        out.append("\\A")
        i = 1
    while i < end:
        c = pattern[i]
        if c == "$" and i == end - 1:
            out.append(last)
            break
        if c == "\\" and i + 1 < end:
            i += 1
            kind = pattern[i]
            if kind.lower() in _CLASSES:
                unit = f"[{'^' if kind.isupper() else ''}{_CLASSES[kind.lower()]}]"
            else:
                unit = quoted(kind)
        elif c == ".":
            unit = "(?s:.)"
        else:
            unit = quoted(c)
        i += 1
        if i < end and pattern[i] in "*?":
            unit += "*?" if pattern[i] == "*" else "?"
            i += 1
        out.append(unit)
    return "".join(out)


@dataclass(frozen=True)
class Macro:
    type: str
    lower: bool
    absolute: bool
    offset: int
    column: int
    pattern: str | None


@dataclass(frozen=True)
class Template:
    kind: str
    items: tuple[str | Macro, ...]
    source: str

    @property
    def columns(self) -> int:
        """Columns that the template reads up to."""
        return max([m.column + 1 for m in self.items if isinstance(m, Macro)], default=0)


def parse(source: str) -> Template:
    """A template from its text; the first character, lower-cased, is the kind and starts every observation."""
    source = source.strip()
    if not source or source[0].lower() not in "ub*":
        raise ValueError(f"a template starts with u, b or *: {source!r}")
    source = source[0].lower() + source[1:]
    items: list[str | Macro] = []
    at = 0
    while at < len(source):
        if source[at] != "%":
            to = source.find("%", at)
            to = len(source) if to < 0 else to
            items.append(source[at:to])
            at = to
            continue
        m = _MACRO.match(source, at)
        if m is None or m[1].lower() not in "xtm" or (m[1].lower() == "x") != (m[5] is None):
            raise ValueError(f"not a macro at {at} of {source!r}")
        pattern = None if m[5] is None else re.sub(r"\\(.)", r"\1", m[5])
        items.append(Macro(m[1].lower(), m[1].isupper(), bool(m[2]), int(m[3]), int(m[4]), pattern))
        at = m.end()
    return Template(source[0], tuple(items), source)


def parse_file(text: str) -> list[Template]:
    """Templates of a file: one a line, from # on a comment, blank lines skipped."""
    lines = [line.split("#", 1)[0].strip() for line in text.splitlines()]
    return [parse(line) for line in lines if line]


def mark(sign: str, distance: int) -> str:
    """What stands for a cell this far outside a sequence."""
    return f"_x{sign}" + ("#" if distance > _NEAR else str(distance))


def _shifted(rows: Column, m: Macro) -> Column:
    """The cells that a macro reads, for all positions at once: the column moved by the offset, marks filling in."""
    values = F.transform(rows, lambda r: F.get(r, F.lit(m.column)))
    n = F.size(rows)
    if m.absolute:
        if m.offset == 0:
            one = F.lit(mark("-", 1))
        elif m.offset > 0:
            after = F.lit(m.offset) - n
            one = F.when(after > 0, F.concat(F.lit("_x+"), F.when(after > _NEAR, "#").otherwise(after.cast("string")))).otherwise(F.get(values, F.lit(m.offset - 1)))
        else:
            before = F.lit(-m.offset) - n
            one = F.when(before > 0, F.concat(F.lit("_x-"), F.when(before > _NEAR, "#").otherwise(before.cast("string")))).otherwise(F.get(values, n + m.offset))
        return F.array_repeat(one, n)
    if m.offset == 0:
        return values
    if m.offset < 0:
        return F.slice(F.concat(F.array(*[F.lit(mark("-", d)) for d in range(-m.offset, 0, -1)]), values), F.lit(1), n)
    return F.slice(F.concat(values, F.array(*[F.lit(mark("+", d)) for d in range(1, m.offset + 1)])), F.lit(m.offset + 1), n)


def _windows(rows: Column, templates: list[Template]) -> tuple[Column, dict]:
    """The cells that templates read, as a struct for each position, and the names of its fields.

    Every cell becomes an array of its own, so that a lambda reads its element only.
    """
    cells = sorted({(m.absolute, m.offset, m.column): m for t in templates for m in t.items if isinstance(m, Macro)}.items())
    names = {key: f"c{k}" for k, (key, _) in enumerate(cells)}
    return F.arrays_zip(F.transform(rows, lambda r: F.size(r)).alias("n"), *[_shifted(rows, m).alias(names[key]) for key, m in cells]), names


def _observation(template: Template, z: Column, names: dict) -> Column:
    parts = []
    for item in template.items:
        if isinstance(item, str):
            parts.append(F.lit(item))
            continue
        value = z[names[item.absolute, item.offset, item.column]]
        if item.type != "x":
            java = to_java_pattern(item.pattern or "")
            value = value.rlike(java).cast("string") if item.type == "t" else F.coalesce(F.regexp_extract(value, java, 0), F.lit(""))
        parts.append(ascii_lower(value) if item.lower else value)
    return F.concat(*parts)


def observations_of(rows: Column, templates: list[Template]) -> Column:
    """Observations of each position of a sequence's rows, in the order of the templates."""
    zipped, names = _windows(rows, templates)
    return F.transform(zipped, lambda z: F.array(*[_observation(t, z, names) for t in templates]))


def _checked(sequences: DataFrame, templates: list[Template]) -> DataFrame:
    wide = max((t.columns for t in templates), default=0)
    if wide <= 1:
        return sequences
    short = F.exists("cols", lambda r: F.size(r) < wide)
    return sequences.withColumn("cols", F.when(short, F.raise_error(F.lit(f"templates read {wide} columns"))).otherwise(F.col("cols")))


def distinct(sequences: DataFrame, templates: list[Template]) -> DataFrame:
    """(k, obs, n, first): observations of distinct windows, with the number of positions that have the window.

    Positions with equal cells have equal observations, so they are grouped before the
    templates are expanded. first grows with (sent_id, t, k); it is a decimal, which an
    aggregate keeps in place.
    """
    from tagloom.operators import windows

    texts = windows.texts_of(sequences)
    if texts is not None and windows.fits(templates):
        return windows.entries(texts, templates).select("k", "obs", "n", "first")
    zipped, names = _windows(F.col("cols"), templates)
    rows = _checked(sequences, templates).select(F.col("sent_id").cast("decimal(19,0)").alias("s"), F.posexplode_outer(zipped).alias("t", "z"))
    place = (F.col("s") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.col("t")).cast("decimal(30,0)")
    grouped = rows.groupBy("z").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    wide = grouped.select("n", "p", F.posexplode_outer(F.array(*[_observation(t, F.col("z"), names) for t in templates])).alias("k", "obs"))
    return wide.select("k", "obs", "n", (F.col("p") * F.lit(10_000).cast("decimal(5,0)") + F.col("k")).cast("decimal(36,0)").alias("first"))


def features(sequences: DataFrame, templates: list[Template]) -> DataFrame:
    """sequences with obs: the observations of each position in the order of the templates."""
    return _checked(sequences, templates).withColumn("obs", observations_of(F.col("cols"), templates))


def exploded(featured: DataFrame) -> DataFrame:
    """(sent_id, t, k, obs): one row for each position and template.

    The outer form keeps Spark from computing the observations once more to filter
    empty arrays, which sequences do not have.
    """
    rows = featured.select("sent_id", F.posexplode_outer("obs").alias("t", "o"))
    return rows.select("sent_id", "t", F.posexplode_outer("o").alias("k", "obs"))
