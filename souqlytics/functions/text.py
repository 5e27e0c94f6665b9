"""Text folding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip()/\s see it: Unicode spaces plus the four
# ASCII separators that Java's class leaves out. Needs the (?U) flag.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
# The same characters one by one: a trim by a set looks at both ends only.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Letter fold (fixed values): the sources, then their replacements in the same order.
FOLD_FROM = "ۀكيئأإآؤ"
FOLD_TO = "هکییاااو"
ZWNJ = "\u200c"
SOFT_HYPHEN = "\u00ad"

# Signs removed from text (fixed values).
PUNCTUATION = "،؛؟«»" + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse_spaces(c: Column) -> Column:
    """T08."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def fold_letters(c: Column) -> Column:
    """Unify letter variants, delete CR/LF, turn ZWNJ and soft hyphen into blanks."""
    return F.translate(c, FOLD_FROM + ZWNJ + SOFT_HYPHEN + "\r\n", FOLD_TO + "  ")


def drop_tags(c: Column) -> Column:
    """T03."""
    return F.regexp_replace(c, r"<[^>]+>", " ")


def drop_urls(c: Column) -> Column:
    """T04."""
    return F.regexp_replace(c, rf"(?U)http{NON_SPACE}+|www{NON_SPACE}+", " ")


def drop_emails(c: Column) -> Column:
    """A word holding an inner ``@`` goes as a whole.

    Anchored at the word start with possessive runs, so a long word without
    ``@`` is read once instead of once per start position.
    """
    return F.regexp_replace(
        c, rf"(?U)(?<!{NON_SPACE}){NON_SPACE}[^@\s\x1c-\x1f]*+@{NON_SPACE}++", " "
    )


def drop_punctuation(c: Column) -> Column:
    """T06."""
    signs = "".join("\\" + s for s in PUNCTUATION)
    return F.regexp_replace(c, f"[{signs}]", " ")


def squeeze_repeats(c: Column) -> Column:
    """Three or more equal characters become one (line feeds excepted)."""
    return F.regexp_replace(c, r"(?d)(.)\1{2,}", "$1")


# Letters and digits that no step of T09 changes, listed one by one where that is faster to match.
_LATIN = "".join(chr(i) for i in range(256) if chr(i).isalnum() and chr(i) not in "\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc\u00bd\u00be")
_ARABIC = "\u0627-\u063a\u0641\u0642\u0644-\u0648\u067e\u0686\u0698\u06a9\u06af\u06cc"


def _folded(c: Column) -> Column:
    """True for texts that T09 leaves as they are; it may miss some."""
    known = c.rlike(rf"\A[{_LATIN} ]*\z") | c.rlike(rf"\A[{_LATIN}{_ARABIC} ]*\z")
    single = ~F.contains(c, F.lit("  ")) & ~F.startswith(c, F.lit(" ")) & ~F.endswith(c, F.lit(" "))
    return known & single & ~F.contains(c, F.lit("http")) & ~c.rlike(r"(.)\1\1")


def normalize(c: Column) -> Column:
    """T02 to T08, in this order.

    Most terms and stored texts are folded already; finding that out takes a fraction of the
    time of the steps.
    """
    return F.when(_folded(c), c).otherwise(_normalized(c))


def _normalized(c: Column) -> Column:
    for step in (
        fold_letters, drop_tags, drop_urls, drop_emails, drop_punctuation, squeeze_repeats,
        collapse_spaces,
    ):
        c = step(c)
    return c


def raw_text(columns: list[str], present: list[str]) -> Column:
    """The trimmed columns in one line; absent columns are skipped."""
    parts = [strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns if c in present]
    if not parts:
        return F.lit("")
    return collapse_spaces(F.concat_ws(" ", *parts))


def words(c: Column) -> Column:
    """White-space words, none for blank text."""
    text = collapse_spaces(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def aspect_term(c: Column) -> Column:
    """Trim, delete ZWNJ, single inner blanks."""
    return collapse_spaces(F.translate(strip(c), ZWNJ, ""))


def first_text_column(present: list[str], candidates=("raw_text_normalized", "raw_text")) -> Column:
    """The first text column there is, null as ''."""
    for name in candidates:
        if name in present:
            return F.coalesce(F.col(name).cast("string"), F.lit(""))
    raise ValueError(f"none of the text columns {candidates} is present")
