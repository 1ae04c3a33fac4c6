"""Text normal forms as column expressions (JVM side, no Python in the row path).

Input is expected in NFC; ``kernels.compose`` does that once per document at the source.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from every normal form.
INVISIBLE = ["\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u00ad", "\x0c", "\x1c", "\x1d", "\x1e"]
# Characters turned into a plain space.
SPACES = ["\u00a0", "\u2002", "\u2003", "\u2004", "\u2005", "\u2006", "\u2007", "\u2008", "\u2009", "\u200a",
          "\u202f", "\u3000"]
# Soft line breaks.
BREAKS = ["\x0b", "\u2028", "\u2029"]

# Latin characters one by one, which become a table, and the others behind one range: most characters are told apart by these two.
_LATIN_SPACE = " \\x09\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x1f\\x85\\xa0"
_OTHER_SPACE = "\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
WIDE_SPACE = f"[{_LATIN_SPACE}[\\x{{1680}}-\\x{{3000}}&&[{_OTHER_SPACE}]]]+"
#: A character that no normal form drops or takes for a space.
_SHOWN = f"[^{_LATIN_SPACE}{_OTHER_SPACE}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}\\xad]"
#: Printable ASCII words with one space between them: dropping, replacing and collapsing leave such a text as it is.
_PLAIN = "\\A(?:[!-~]++(?: [!-~]++)*+)?+\\z"
WORD = "[\\p{L}\\p{N}_]+"


def _clean(s: Column, breaks_to: str) -> Column:
    """One ``translate``: soft breaks and space variants are replaced, invisible characters dropped."""
    source = "".join(BREAKS) + "".join(SPACES) + "".join(INVISIBLE)
    return F.translate(s, source, breaks_to * len(BREAKS) + " " * len(SPACES))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, WIDE_SPACE, " "))


def norm_base(s: Column, keep_breaks: bool = False) -> Column:
    br = "\n" if keep_breaks else " "
    s = _clean(F.coalesce(s, F.lit("")), br)
    s = F.regexp_replace(s, "\r\n|\r|\n", br)
    return F.translate(s, "\t", " ")


def norm_text(s: Column) -> Column:
    # one look at a plain text instead of two translations and two replacements
    return F.when(s.rlike(_PLAIN), s).otherwise(collapse(norm_base(s)))


def norm_for_signature(s: Column) -> Column:
    s = collapse(_clean(F.coalesce(s, F.lit("")), " "))
    s = F.regexp_replace(s, "\\s*([,;])\\s*(?=\\S)", "$1 ")
    s = F.regexp_replace(s, "\\s+([,;])$", "$1")
    s = F.regexp_replace(s, "\\(\\s+", "(")
    s = F.regexp_replace(s, "\\s+\\)", ")")
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def has_text(s: Column) -> Column:
    """Whether the signature form is not empty, without building it: a text is looked at up to its first shown character."""
    return F.coalesce(s.rlike(_SHOWN), F.lit(False))


def spaced_punctuation(signed: Column) -> Column:
    """Word-diff form of a text that is already in signature form."""
    return F.trim(F.regexp_replace(F.regexp_replace(signed, "\\s*([,;])\\s*", " $1 "), "\\s+", " "))


def norm_for_diff(s: Column) -> Column:
    return spaced_punctuation(norm_for_signature(s))


def norm_for_align(s: Column) -> Column:
    s = F.regexp_replace(norm_for_signature(s), "[,;]\\s*", " ")
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def raw_text(s: Column) -> Column:
    s = F.regexp_replace(F.coalesce(s, F.lit("")), "\r\n|\r", "\n")
    s = _clean(s, "\n")
    return F.regexp_replace(s, f"^{WIDE_SPACE}|{WIDE_SPACE}$", "")


def norm_for_match(s: Column) -> Column:
    """Lower case, trimmed, single spaces: the form used for pattern tests and table texts."""
    return F.lower(F.when(s.rlike(_PLAIN), s).otherwise(collapse(F.coalesce(s, F.lit("")))))


def tokenize(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)))


def detokenize(tokens: Column) -> Column:
    """Words joined by spaces; commas and semicolons stick to the word before and are set off from the next by two
    spaces, as the compared reports show them.  Tokens come from the word-diff form, where both stand alone.
    """
    glued = F.regexp_replace(F.array_join(tokens, " "), " ([,;])", "$1")
    return F.trim(F.regexp_replace(glued, "([,;]) ", "$1  "))


# Tokens that follow without a space, and the token after which none comes.
NO_SPACE_BEFORE = [",", ";", ".", "!", "?", ":", ")"]
NO_SPACE_AFTER = ["("]


def needs_space_before(last_token: Column, token: Column) -> Column:
    """Whether ``token`` is set off from the last token shown before it (null at the start)."""
    return F.coalesce(last_token.isNotNull() & ~token.isin(NO_SPACE_BEFORE) & ~last_token.isin(NO_SPACE_AFTER),
                      F.lit(False))


CHAPTER = "(?s)^(\\d+(?:\\.\\d+)*)\\s+(.*)$"


def chapter_number(normalized: Column) -> Column:
    return F.regexp_extract(normalized, CHAPTER, 1)


def heading_body(normalized: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalized), CHAPTER, "$2"))


def path_bodies(ctx: Column) -> Column:
    """Heading path with chapter numbers removed from every step."""
    parts = F.transform(F.split(F.coalesce(ctx, F.lit("")), " > "), lambda p: heading_body(norm_for_signature(p)))
    return F.array_join(parts, " > ")


def display(text: Column, text_display: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(text_display, F.lit("")), text, F.lit("")))


# Symbol-font characters with an agreed replacement.
SYMBOLS = {
    "Wingdings F0A3": "☐",
    "Wingdings F0FE": "☑",
    "Wingdings F052": "☑",
    "Wingdings F0FC": "✓",
    "Wingdings F0A1": "○",
    "Wingdings F06C": "●",
    "Symbol F0B7": "•",
}


def symbol_text(font: Column, char: Column) -> Column:
    """Replacement of a symbol-font character given as a hexadecimal code; '' if there is none."""
    known = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    hit = F.try_element_at(known, F.concat(F.coalesce(font, F.lit("")), F.lit(" "), F.upper(char)))
    code = F.conv(F.when(char.rlike("^[0-9A-Fa-f]{1,6}$"), char), 16, 10).cast("int")
    code = F.when(code >= 0xF000, code - 0xF000).otherwise(code)
    # UTF-32 bytes of the code point, decoded
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(hit, F.when(code.isNotNull() & (code > 0), plain), F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
