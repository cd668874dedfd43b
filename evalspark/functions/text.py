"""Text expressions with the string semantics that answers are read with (Unicode white space and line breaks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and the four separators that count as such.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.btrim(text, F.lit(BLANKS))


def strip_reasoning(text: Column) -> Column:
    """What follows the last closing reasoning tag, stripped."""
    return strip(F.element_at(F.split(text, "</think>", -1), -1))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def _tidy(line: Column) -> Column:
    """A line stripped, without underscores at its edges; most lines show at their two end characters that they are."""
    ends = F.concat(F.left(line, F.lit(1)), F.right(line, F.lit(1)))
    return F.when(ends.rlike(r"(?U)[\s_\x1C-\x1F]"), strip(F.regexp_replace(strip(line), r"\A_+|_+\z", ""))).otherwise(line)


def plain(text: Column) -> Column:
    """Without Markdown emphasis: * and ` anywhere, _ at the edges of a line; every line stripped."""
    bare = F.replace(F.replace(text, F.lit("*"), F.lit("")), F.lit("`"), F.lit(""))
    return F.array_join(F.transform(lines(bare), _tidy), "\n")


def casefold(text: Column) -> Column:
    """Full Unicode case folding by upper and then lower case: sharp s and ligatures are their letters, every sigma is one.

    Each step between keeps the optimizer from taking the two for one, and a letter from a wrong way back. Cherokee, whose
    folding goes the other way, folds to its small letters here.
    """
    safe = F.replace(F.replace(text, F.lit("ẞ"), F.lit("ß")), F.lit("ı"), F.lit("\ue131"))  # a private character stands for the dotless i
    return F.replace(F.lower(F.replace(F.upper(safe), F.lit("Σ"), F.lit("σ"))), F.lit("\ue131"), F.lit("ı"))


def folded(text: Column) -> Column:
    """For containment: one space for any white space, stripped, case folded; accents stay."""
    return casefold(strip(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " ")))


def fill(template: str, values: dict[str, Column]) -> Column:
    """Put columns into ``{name}`` places in a single pass: injected text is never scanned again."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), values[m[1]]]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def path_part(path: Column, back: int) -> Column:
    """The ``back``-th segment of a path from its end, null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def config_and_style(unit: Column) -> tuple[Column, Column]:
    """``config__style`` split at its last double underscore; without one the style is 'clean'."""
    has = F.contains(unit, F.lit("__"))
    config = F.when(has, F.regexp_extract(unit, r"\A(?s)(.*)__(.*)\z", 1)).otherwise(unit)
    return config, F.when(has, F.regexp_extract(unit, r"\A(?s)(.*)__(.*)\z", 2)).otherwise("clean")


def mentions(text: Column, word: str, chars: int = 2000) -> Column:
    """Whether the first ``chars`` characters of an error text mention ``word`` in any case."""
    return F.contains(F.lower(F.left(text, F.lit(chars))), F.lit(word.lower()))


def iso_seconds(stamp: Column) -> Column:
    """A timestamp in the session's zone (UTC) as ISO text of whole seconds."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_between(early: Column, late: Column) -> Column:
    return F.unix_timestamp(late) - F.unix_timestamp(early)
