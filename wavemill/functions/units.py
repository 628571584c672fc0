"""Units of voltage in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanovolts of one unit. A count has no fixed size.
NANOVOLTS = {"uV": 1e3, "mV": 1e6, "V": 1e9, "nV": 1.0}

#: The classes a unit can take.
CLASSES = ("uV", "mV", "V", "nV", "count")

#: Patterns of the units, tried in this order (on text in lower case).
PATTERNS = (
    ("mV", r"(?:10\s*\^?\s*[-−]3\s*|thousandths? of an? )v(?:olts?)?(?![\p{L}\d])"),
    ("uV", r"(?:10\s*\^?\s*[-−]6\s*|millionths? of an? )v(?:olts?)?(?![\p{L}\d])"),
    ("nV", r"(?:10\s*\^?\s*[-−]9\s*|billionths? of an? )v(?:olts?)?(?![\p{L}\d])"),
    ("mV", r"(?<!\p{L})m(?:illi)?[- ]?v(?:olts?)?(?![\p{L}\d])"),
    ("uV", r"(?<!\p{L})(?:[uµμ]|micro|mikro)[- ]?v(?:olts?)?(?![\p{L}\d])"),
    ("nV", r"(?<!\p{L})n(?:ano)?[- ]?v(?:olts?)?(?![\p{L}\d])"),
    ("count", r"(?<!\p{L})(?:adc|counts?|digits?|lsbs?|adu)(?![\p{L}\d])"),
    ("V", r"(?<!\p{L})v(?:olts?)?(?![\p{L}\d])"),
)

#: Any unit with a size, after a number.
SIZED = r"(?:m(?:illi)?|[uµμ]|micro|mikro|n(?:ano)?)?[- ]?v(?:olts?)?(?![\p{L}\d])"

#: A number: blanks group digits, a comma or a point is the decimal mark.
NUMBER = r"[-+]?(?:\d{1,3}(?:[ \x{00a0}\x{2009}\x{202f}]\d{3})+|\d+)(?:[.,]\d+)?(?:[eE][-+]?\d+)?"

#: Pieces of a remark that state no unit: ranges, test pulses, mains, batteries.
NOISE = r"(?i)range|pulse|puls|test|mains|hum |batter|impedanc|bereich|netz|hz(?!\p{L})|ohm"

#: The size of one count: "0.195 µV per count", "250 nV each", "LSB = 0.25 µV", "one count is 0.5 µV".
SIZE_AFTER = rf"({NUMBER})\s*({SIZED})\s*(?:/|per|each|je)\s*(?:counts?|steps?|digits?|lsb|bit|adc)?"
SIZE_BEFORE = rf"(?:counts?|steps?|digits?|lsb)\s*(?:=|is|ist|:)\s*({NUMBER})\s*({SIZED})"


def _lower(c: Column) -> Column:
    return F.lower(c)


def unit_of(c: Column) -> Column:
    """The first unit in the order of ``PATTERNS`` that the text names, or null."""
    t = _lower(c)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in PATTERNS:
        out = out.when(t.rlike(pattern), name)
    return out


def number_of(c: Column) -> Column:
    """The text of a number as double."""
    t = F.regexp_replace(c, r"[ \x{00a0}\x{2009}\x{202f}]", "")
    return F.replace(t, F.lit(","), F.lit(".")).try_cast("double")


def pieces(remark: Column) -> Column:
    """The statements of a remark without those that state no unit."""
    parts = F.split(F.coalesce(remark, F.lit("")), r"\s*;\s*|\s+/\s+|\.\s+")
    return F.filter(parts, lambda p: ~p.rlike(NOISE))


def _sized(text: Column, pattern: str, number: int = 1, unit: int = 2) -> Column:
    value = number_of(F.regexp_extract(text, pattern, number))
    name = unit_of(F.regexp_extract(text, pattern, unit))
    size = F.when(name == "uV", 1e3).when(name == "mV", 1e6).when(name == "V", 1e9).when(name == "nV", 1.0)
    return value * size


def count_size(texts: Column) -> Column:
    """Nanovolts of one count that any of the statements gives, or null."""

    def one(p: Column) -> Column:
        t = _lower(p)
        return F.coalesce(_sized(t, SIZE_AFTER), _sized(t, SIZE_BEFORE))

    sizes = F.filter(F.transform(texts, one), lambda x: x.isNotNull())
    return F.get(sizes, F.lit(0))


def _is_size(p: Column) -> Column:
    t = _lower(p)
    return t.rlike(SIZE_AFTER) | t.rlike(SIZE_BEFORE)


def reading(texts: Column) -> Column:
    """The first number with a unit that isn't the size of a count: struct of value and unit, or null."""
    pattern = rf"({NUMBER})\s*({SIZED})"

    def one(p: Column) -> Column:
        t = _lower(p)
        return F.when(
            ~_is_size(p) & t.rlike(pattern),
            F.struct(
                number_of(F.regexp_extract(t, pattern, 1)).alias("value"),
                unit_of(F.regexp_extract(t, pattern, 2)).alias("unit"),
            ),
        )

    found = F.filter(F.transform(texts, one), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def stated(texts: Column) -> Column:
    """The first unit that a statement names by itself, neither after a number nor as the size of a count."""

    def one(p: Column) -> Column:
        powers = F.regexp_replace(_lower(p), r"10\s*\^\s*[-−]3\s*v", "mv")
        rest = F.regexp_replace(powers, rf"{NUMBER}\s*{SIZED}", " ")
        return F.when(~_is_size(p), unit_of(rest))

    found = F.filter(F.transform(texts, one), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def version_key(c: Column) -> Column:
    """A dotted version as an array of whole numbers (3.10 comes after 3.9)."""
    return F.transform(F.split(F.regexp_extract(c, r"\d+(?:\.\d+)*", 0), r"\."), lambda x: x.try_cast("int"))


def note_unit(note: Column, firmware: Column) -> Column:
    """The unit of a device's exports: struct of unit and count size.

    A note either names one unit, or two with the firmware at which they change ("before X a, afterwards b",
    "X and older a; from Y on b", "a up to firmware X, b after that", "from X on b, before that a").
    """
    t = F.regexp_replace(_lower(note), r"(?:test|signal|pulse)[^.;,]*?" + NUMBER + r"\s*" + SIZED, " ")
    size = F.coalesce(_sized(t, SIZE_AFTER), _sized(t, SIZE_BEFORE))
    version = F.regexp_extract(t, r"\d+\.\d+", 0)
    changes = t.rlike(r"firmware|version|(?<!\p{L})fw(?![\p{L}\d])")
    bare = F.regexp_replace(t, rf"\(?{NUMBER}\s*{SIZED}\s*(?:(?:/|per|each|je)\s*(?:counts?|steps?|digits?|lsb)?)?\)?", " ")
    clauses = F.filter(F.transform(F.split(bare, r"[;,]|\.(?!\d)"), unit_of), lambda x: x.isNotNull())
    first, last = F.get(clauses, F.lit(0)), F.element_at(clauses, -1)
    whole = unit_of(bare)
    last_two = F.when(F.size(clauses) >= 2, last)
    own, cut_at = version_key(firmware), version_key(F.regexp_extract(t, r"(?:firmware|version|fw)?\s*(\d+\.\d+)", 1))
    older = F.when(t.rlike(r"before\s+(?:firmware|version|fw)"), own < cut_at).otherwise(own <= cut_at)
    newer_first = t.rlike(r"^\s*(?:from|since|as of)\s+(?:firmware|version|fw)")
    older_of = F.when(newer_first, own < cut_at).otherwise(older)
    unit = (
        F.when(changes & last_two.isNotNull() & (F.length(version) > 0),
               F.when(older_of, F.when(newer_first, last_two).otherwise(first)).otherwise(F.when(newer_first, first).otherwise(last_two)))
        .otherwise(whole)
    )
    return F.struct(unit.alias("unit"), size.alias("size"))
