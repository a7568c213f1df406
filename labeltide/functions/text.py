"""Text cleaning as Column -> Column functions.

Every step is a built-in JVM expression (``regexp_replace``/``lower``), so a
chain of them collapses into one projection inside whole-stage codegen: one
pass over the column, no Python worker.

Regex dialect.  The specification is Python ``re`` with Unicode semantics.
Java's ``\\w``/``\\s``/``\\d`` are ASCII-only, so the classes are written out
with Unicode properties:

* word character  -> ``\\p{L}\\p{N}_``
* whitespace      -> ``WS`` below (exactly the characters ``str.isspace`` accepts)
* decimal digit   -> ``\\p{Nd}``
* ``$`` without MULTILINE in Python matches at the end or before a final
  ``\\n``; Java's ``$`` also accepts ``\\r``, U+0085, U+2028 and U+2029, so the
  IPv4 step runs in Java's UNIX_LINES mode ``(?d)`` where only ``\\n`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace() defines it, for use inside a class.
WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}"
# The same set spelled out (ASCII controls, space, NEL, and the Unicode Z
# categories), for ``btrim`` which strips a set of characters from both ends.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")

# ---------------------------------------------------------------------------
# The cleaning patterns of the reference corpora, in the order
# they are applied (emails, IPv4 addresses, http links, www links, special
# characters, symbols/emoji, "[", "]", newline, tab, runs of spaces, lower-case,
# strip, digits).  Reference spellings (Python re):
#   [a-zA-Z0-9-_.]+@[a-zA-Z0-9-_.]+
#   ((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\.|$)){4}
#   http\S+
#   www\S+
#   [#,@,&,<,>,\,/,-]
#   [^\w\s#@/:%.,_-]
#   [   ]   \n   \t   (literal)
#    {2,}
#   \d
# The same sets spelled for Java regex:
EMAIL_PATTERN = r"[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+"
IPV4_PATTERN = r"(?d)((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(\.|$)){4}"
HTTP_PATTERN = r"http[^" + WS + r"]+"
WWW_PATTERN = r"www[^" + WS + r"]+"
SPECIAL_PATTERN = r"[#,@&<>/\-]"
SYMBOL_PATTERN = r"[^\p{L}\p{N}_" + WS + r"#@/:%.,\-]"
OPEN_BRACKET_PATTERN = r"\["
CLOSE_BRACKET_PATTERN = r"\]"
NEWLINE_PATTERN = r"\n"
TAB_PATTERN = r"\t"
MULTISPACE_PATTERN = r" {2,}"
STRIP_PATTERN = r"\A[" + WS + r"]+|[" + WS + r"]+\z"
DIGIT_PATTERN = r"\p{Nd}"
# Prefix the T5 scripts put in front of every text.
TASK_PREFIX = "classification: "
# ---------------------------------------------------------------------------

# Fused forms used by clean_text.  Each fusion is exact:
#  * steps X5-X8 all delete single characters, and deleting the set A then the
#    set B equals deleting A|B; after X5 removes "#,@/-" the characters X6 keeps
#    are word characters, whitespace and ":%."; "[" and "]" are not among them.
#  * steps X9-X11 map "\n"/"\t" to a space and then fold runs of two or more
#    spaces, which is the same as folding every run of [ \n\t] into one space.
#  * deleting a run of matched characters at once equals deleting them one by
#    one, and rewriting a lone " " as " " is a no-op, so only runs of two or
#    more and lone "\n"/"\t" are rewritten.
#  * an email match always starts at the beginning of a run of address
#    characters (leftmost match) and ends at the end of one (greedy domain), so
#    trying starts only at run beginnings, without backtracking into the run,
#    finds the same matches in linear time; a text without "@" has none.
#  * each octet of an address begins with a digit, so a look at the first
#    character leaves out the other places.
_DELETE_FUSED = r"[^\p{L}\p{N}_" + WS + r":%.]+"
_SPACE_FUSED = r"[ \n\t]{2,}|[\n\t]"
_DIGIT_RUN = r"\p{Nd}+"
_IPV4_FAST = IPV4_PATTERN.replace("(?d)", "(?d)(?=[0-9])", 1)
_EMAIL_FAST = r"(?<![a-zA-Z0-9_.-])[a-zA-Z0-9_.-]++@[a-zA-Z0-9_.-]+"


def _strip(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, pattern, repl)


def remove_emails(c: Column) -> Column:
    """X1."""
    return _strip(c, EMAIL_PATTERN)


def remove_ipv4(c: Column) -> Column:
    """Four octets, the fourth followed by '.' or the end of the text."""
    return _strip(c, IPV4_PATTERN)


def remove_http(c: Column) -> Column:
    """X3: 'http' and everything up to the next whitespace (case-sensitive)."""
    return _strip(c, HTTP_PATTERN)


def remove_www(c: Column) -> Column:
    """X4: 'www' and everything up to the next whitespace."""
    return _strip(c, WWW_PATTERN)


def remove_special(c: Column) -> Column:
    """The characters # , @ & < > / - (backslash is not among them)."""
    return _strip(c, SPECIAL_PATTERN)


def remove_symbols(c: Column) -> Column:
    """Anything that is not a word character, whitespace or one of #@/:%.,_-"""
    return _strip(c, SYMBOL_PATTERN)


def remove_open_bracket(c: Column) -> Column:
    """X7."""
    return _strip(c, OPEN_BRACKET_PATTERN)


def remove_close_bracket(c: Column) -> Column:
    """X8."""
    return _strip(c, CLOSE_BRACKET_PATTERN)


def newline_to_space(c: Column) -> Column:
    """X9 (carriage returns are left alone)."""
    return _strip(c, NEWLINE_PATTERN, " ")


def tab_to_space(c: Column) -> Column:
    """X10."""
    return _strip(c, TAB_PATTERN, " ")


def collapse_spaces(c: Column) -> Column:
    """X11: runs of two or more ASCII spaces become one."""
    return _strip(c, MULTISPACE_PATTERN, " ")


def to_lower(c: Column) -> Column:
    """X12."""
    return F.lower(c)


def strip_whitespace(c: Column) -> Column:
    """Unicode strip (``F.trim`` only removes ASCII spaces)."""
    return _strip(c, STRIP_PATTERN)


def remove_digits(c: Column) -> Column:
    """Unicode decimal digits; runs last, so it can leave double spaces."""
    return _strip(c, DIGIT_PATTERN)


# The chain in reference order; clean_text_stepwise applies exactly this list.
CLEAN_STEPS = (
    remove_emails, remove_ipv4, remove_http, remove_www, remove_special,
    remove_symbols, remove_open_bracket, remove_close_bracket, newline_to_space,
    tab_to_space, collapse_spaces, to_lower, strip_whitespace, remove_digits,
)


def clean_text_stepwise(c: Column) -> Column:
    """X15 as fourteen separate expressions (kept for tests and parity)."""
    for step in CLEAN_STEPS:
        c = step(c)
    return c


def clean_text(c: Column) -> Column:
    """The whole chain in fused passes; equal to ``clean_text_stepwise``."""
    c = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, _EMAIL_FAST, "")).otherwise(c)
    c = F.regexp_replace(c, _IPV4_FAST, "")
    c = remove_http(c)
    c = remove_www(c)
    c = F.regexp_replace(c, _DELETE_FUSED, "")
    c = F.regexp_replace(c, _SPACE_FUSED, " ")
    c = F.lower(c)
    c = F.btrim(c, F.lit(WS_CHARS))
    return F.regexp_replace(c, _DIGIT_RUN, "")


def add_prefix(c: Column, prefix: str = TASK_PREFIX) -> Column:
    """NULL stays NULL."""
    return F.concat(F.lit(prefix), c)


def to_string(c: Column) -> Column:
    """Like ``.apply(str)`` except that NULL stays NULL."""
    return c.cast("string")


def tokens(c: Column) -> Column:
    """Whitespace tokens like ``str.split()``: no empty strings, Unicode whitespace."""
    return F.filter(F.split(c, "[" + WS + "]+"), lambda t: t != F.lit(""))
