"""Text helpers with ECMAScript string semantics, written as Spark columns.

Rule patterns are kept in one portable spelling.  ``to_java`` turns that spelling into
``java.util.regex`` syntax whose whitespace, word boundary, dot and line-start behave
as they do in ECMAScript (Java's own ``\\s``, ``\\b``, ``.`` and ``^`` differ on
non-ASCII text); ``to_re2`` does the same for RE2, which only the SQL checks use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points ECMAScript treats as white space, and as line ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_WS_JAVA = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS_RE2 = (
    r"\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}\x{feff}"
)
_EOL_JAVA = r"\n\r\u2028\u2029"
_EOL_RE2 = r"\n\r\x{2028}\x{2029}"

# Character put in front of every match.  It is neither a word character, a space nor a
# line end, and it is swapped for another control character where a text has it already.
MARK = "\u0007"
MARK_SUBSTITUTE = "\u0001"


def _rewrite(pattern: str, flags: str, ws: str, eol: str, java: bool) -> str:
    out: list[str] = []
    in_class = False
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith(r"[\s\S]", i) and not in_class:
            # a class, not a group: Java repeats groups by recursion
            out.append(r"[\x{0}-\x{10FFFF}]")
            i += 6
            continue
        if c == "\\":
            e = pattern[i + 1]
            i += 2
            if e == "s":
                out.append(ws if in_class else f"[{ws}]")
            elif e == "S" and not in_class:
                out.append(f"[^{ws}]")
            elif e == "b" and java and not in_class:
                starts_word = i < n and (pattern[i].isalnum() or pattern[i] in "_(")
                out.append(r"(?<!\w)" if starts_word else r"(?!\w)")
            else:
                out.append(c + e)
            continue
        i += 1
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
        elif c == ".":
            out.append(f"[^{eol}]")
        elif c == "^" and "m" in flags:
            out.append(f"(?<![^{eol}])" if java else "(?m:^)")
        else:
            out.append(c)
    return ("(?i)" if "i" in flags else "") + "".join(out)


def to_java(pattern: str, flags: str = "") -> str:
    return _rewrite(pattern, flags, _WS_JAVA, _EOL_JAVA, True)


def to_re2(pattern: str, flags: str = "") -> str:
    return _rewrite(pattern, flags, _WS_RE2, _EOL_RE2, False)


def js_trim(c: Column) -> Column:
    """Strip every ECMAScript white-space character from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def line_array(c: Column) -> Column:
    """Lines of a text; a trailing empty line is kept and an empty text has one line."""
    return F.split(c, "\n")


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units.  Only characters beyond the BMP take two, so an ASCII text
    (as many bytes as characters) needs no encoding."""
    exact = (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(exact)


def utf16_prefix(c: Column, units: int) -> Column:
    """First ``units`` UTF-16 units; a character cut in half is dropped."""
    head = F.substring(c, 1, units)
    padded = F.regexp_replace(without_mark(head), r"([\x{10000}-\x{10FFFF}])", MARK + "$1")
    cut = F.translate(F.substring(padded, 1, units), MARK, "")
    return F.when(F.octet_length(head) == F.length(head), head).otherwise(with_mark(cut, head))


def without_mark(c: Column) -> Column:
    """The text with MARK swapped out, so that a marker always means a match."""
    return F.when(F.contains(c, F.lit(MARK)), F.translate(c, MARK, MARK_SUBSTITUTE)).otherwise(c)


def swapped(original: Column) -> Column:
    """Did ``without_mark`` swap characters of this text, none of which was the substitute before?"""
    return F.contains(original, F.lit(MARK)) & ~F.contains(original, F.lit(MARK_SUBSTITUTE))


def with_mark(c: Column, original: Column) -> Column:
    """Text taken from ``without_mark(original)`` with the swapped characters put back (not where the original has both)."""
    return F.when(swapped(original), F.translate(c, MARK_SUBSTITUTE, MARK)).otherwise(c)


def occurrences(c: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def valid_utf8(c: Column) -> Column:
    """Decode bytes as UTF-8; malformed sequences become U+FFFD instead of failing."""
    return F.make_valid_utf8(c.cast("string"))
