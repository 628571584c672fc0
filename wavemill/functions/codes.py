"""Canonical forms of codes, paths, digests and partition names typed by many hands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Writings that stand for "not known" (compared in lower case, without blanks around).
UNKNOWN = ("", "unknown", "n/a", "na", "none", "null", "nan", "?", "??", "-", "--", "not known", "tbd")

#: Writings of the three partitions.
PARTITIONS = {
    "train": ("train", "training", "trn"),
    "validation": ("validation", "valid", "val", "dev"),
    "test": ("test", "testing", "tst"),
}


def bare(c: Column) -> Column:
    """Text without white space or invisible characters at its ends."""
    edge = r"[\s\p{Z}\p{C}]+"
    return F.regexp_replace(c, f"^{edge}|{edge}$", "")


def known(c: Column) -> Column:
    """The bare text, or null where it is a placeholder."""
    t = bare(c)
    return F.when(~F.lower(t).isin(*UNKNOWN), t)


def subject_number(c: Column) -> Column:
    """The number of a subject code (``sub-000077``, ``S77``, ``Sub 0077`` are one subject), as long.

    Null for text without a digit; for more than 18 digits too, which no code has.
    """
    digits = F.regexp_replace(F.regexp_extract(c, r"(\p{Nd}+)\D*$", 1), "^0+(?=.)", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 18), digits.cast("long"))


def session_code(c: Column) -> Column:
    """``ses-tN`` of ``T1``, ``ses_t1``, ``SES-T1``; null without a digit."""
    n = F.regexp_replace(F.regexp_extract(c, r"(\d+)\D*$", 1), "^0+(?=.)", "")
    return F.when(F.length(n) > 0, F.concat(F.lit("ses-t"), n))


def family_number(c: Column) -> Column:
    """The household of ``fam-0000123`` and its other writings; null for placeholders (``fam-0`` among them)."""
    n = subject_number(c)
    return F.when(n > 0, n)


def digest(c: Column) -> Column:
    """A SHA-256 digest in lower case without prefix or blanks; null for placeholders."""
    return F.regexp_replace(F.lower(known(c)), r"^sha-?256\s*[:=]\s*", "")


def path(c: Column) -> Column:
    """A relative path with forward slashes: no leading ``./`` or ``/``, no doubled slash, no blanks around."""
    t = F.regexp_replace(bare(c), r"[\\/]+(\.[\\/]+)*", "/")
    return F.regexp_replace(t, r"^(\./|/)+", "")


def partition_name(c: Column) -> Column:
    """``train``, ``validation`` or ``test``, however written; null if not given."""
    t = F.lower(bare(c))
    out = F.when(t.isin(*PARTITIONS["train"]), "train")
    for name in ("validation", "test"):
        out = out.when(t.isin(*PARTITIONS[name]), name)
    return out
