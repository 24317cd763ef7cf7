"""Text expressions. All of them stay inside the JVM.

Spark's `lower` is not a full case fold; `fold` adds the one mapping that
matters for Latin-script corpora (sharp s) and is used for every comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Every character counted as white space, spelled out because the regular
# expression dialects of Java, RE2 and Python disagree about \s.
SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{1f}\x{20}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE}]+"
WORD = "[а-яёa-z0-9]+"
# characters with a meaning in full-text query syntax; each becomes a space
QUERY_SYNTAX = '+-&|!(){}[]^"~*?:\\/'
# number of normalised leading characters that define "the same fragment"
SIGNATURE_CHARS = 420
# share of Cyrillic letters above which a text counts as Russian
CYRILLIC_SHARE = 0.4
# stems: words of at least 6 letters lose 2, words of at least 4 lose 1;
# a text word may be up to 3 letters longer than the stem it starts with
STEM_LONG, STEM_LONG_CUT = 6, 2
STEM_SHORT, STEM_SHORT_CUT = 4, 1
STEM_SLACK = 3
# layout-file names used as titles by scanned journals
LAYOUT_TITLE = r"(?i)\.(qxd|indd|pmd|p65|cdr|fm)$|^[A-Za-z]{2,4}[_-]?[0-9]"
# years 1950 to 2029
YEAR = r"(19[5-9][0-9]|20[0-2][0-9])"
# unit spellings treated as equal, applied in this order; the third one
# begins with a Latin letter
UNIT_RULES = [("дм3", "л"), ("cм3", "мл"), ("%масс", "%")]
# the same with a Cyrillic first letter, off by default
UNIT_RULE_CYRILLIC = ("см3", "мл")
# -----------------------------------------------------------------------------


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it; for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(x: Column | str) -> Column:
    return F.replace(F.lower(_col(x)), F.lit("ß"), F.lit("ss"))


def fold_yo(x: Column | str) -> Column:
    """Case fold that also merges the two Russian spellings of e."""
    return F.replace(fold(x), F.lit("ё"), F.lit("е"))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_name(x: Column | str) -> Column:
    """Lookup key of a name: separators dropped, case folded."""
    return fold_yo(F.regexp_replace(_col(x), f"[{SPACE}\\-_/]+", ""))


def tokens(x: Column | str) -> Column:
    """Words of a text, folded; null for null."""
    words = F.regexp_extract_all(F.lower(_col(x)), F.lit(f"({WORD})"), F.lit(1))
    return F.transform(words, lambda w: F.replace(w, F.lit("ё"), F.lit("е")))


def folded_words(x: Column | str) -> Column:
    """The same as `tokens` without a lambda: the text is folded before its words are taken."""
    return F.regexp_extract_all(F.replace(F.lower(_col(x)), F.lit("ё"), F.lit("е")), F.lit(f"({WORD})"), F.lit(1))


def stem(word: Column | str) -> Column:
    w = _col(word)
    n = F.length(w)
    return (
        F.when(n >= STEM_LONG, F.substring(w, F.lit(1), n - STEM_LONG_CUT))
        .when(n >= STEM_SHORT, F.substring(w, F.lit(1), n - STEM_SHORT_CUT))
        .otherwise(w)
    )


def word_matches(text_word: Column, st: Column) -> Column:
    return F.startswith(text_word, st) & (F.length(text_word) <= F.length(st) + STEM_SLACK)


def contains_stems(text_words: Column, stems: Column) -> Column:
    """True when every stem starts some word of the text (and there is a stem)."""
    return (F.size(stems) > 0) & F.forall(
        stems, lambda st: F.exists(text_words, lambda w: word_matches(w, st))
    )


def stemmed_words(x: Column | str) -> Column:
    """Stems of all words of a text.

    The same as `stem` over `tokens`, but the endings are cut in the text by
    one regular expression, which spares a lambda call per word.
    """
    letter = WORD[:-1]
    folded = F.replace(F.lower(_col(x)), F.lit("ё"), F.lit("е"))
    long_word = f"(?<!{letter})({letter}{{{STEM_LONG - STEM_LONG_CUT},}}){letter}{{{STEM_LONG_CUT}}}(?!{letter})"
    short_word = (f"(?<!{letter})({letter}{{{STEM_SHORT - STEM_SHORT_CUT},{STEM_LONG - 1 - STEM_SHORT_CUT}}})"
                  f"{letter}{{{STEM_SHORT_CUT}}}(?!{letter})")
    cut = F.regexp_replace(folded, f"{long_word}|{short_word}", "$1$2")
    return F.regexp_extract_all(cut, F.lit(f"({WORD})"), F.lit(1))


def name_stems(name: Column | str) -> Column:
    return F.array_distinct(F.transform(tokens(name), stem))


def reachable_stems(text_word: Column | str) -> Column:
    """Every stem `word_matches` could accept for this word.

    A stem has to be a prefix at most STEM_SLACK letters shorter, so there are
    only a handful: this turns the fuzzy match into an equality join.
    """
    w = _col(text_word)
    n = F.length(w)
    return F.transform(
        F.sequence(F.greatest(F.lit(1), n - STEM_SLACK), n),
        lambda size: F.substring(w, F.lit(1), size),
    )


def normalize_unit(x: Column | str, cyrillic_rule: bool = False) -> Column:
    u = fold(F.coalesce(_col(x), F.lit("")))
    for old, new in [(" ", ""), ("·", "*"), ("³", "3"), *UNIT_RULES]:
        u = F.replace(u, F.lit(old), F.lit(new))
    if cyrillic_rule:
        u = F.replace(u, F.lit(UNIT_RULE_CYRILLIC[0]), F.lit(UNIT_RULE_CYRILLIC[1]))
    return u


def escape_query(x: Column | str) -> Column:
    return strip(F.translate(_col(x), QUERY_SYNTAX, " " * len(QUERY_SYNTAX)))


def signature(x: Column | str, chars: int | None = None) -> Column:
    """Equal for texts that differ in case and spacing only; empty for a blank text.

    A digest of the whole normalised text. With `chars` (SIGNATURE_CHARS is
    the customary number) it is that many leading characters instead, which
    takes texts with a common beginning for one.
    """
    flat = F.trim(fold(F.regexp_replace(F.coalesce(_col(x), F.lit("")), SPACES, " ")))
    if chars is not None:
        return F.substring(flat, 1, chars)
    return F.when(flat == "", "").otherwise(F.md5(flat))


def display_title(title: Column | str, journal: Column | str, year: Column | str) -> Column:
    title, journal, year = F.coalesce(_col(title), F.lit("")), _col(journal), _col(year)
    named = F.concat(journal, F.coalesce(F.concat(F.lit(", "), F.when(year != 0, year.cast("string"))), F.lit("")))
    return F.when((F.coalesce(journal, F.lit("")) != "") & title.rlike(LAYOUT_TITLE), named).otherwise(title)


def detect_language(x: Column | str, sample: int | None = None) -> Column:
    """`ru`, `en` or `unknown` by the share of Cyrillic letters.

    The whole text is read unless a sample size is asked for.
    """
    text = _col(x) if sample is None else F.substring(_col(x), 1, sample)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    cyrillic = F.length(F.regexp_replace(text, "[^а-яА-ЯёЁ]", ""))
    return (
        F.when(letters == 0, "unknown")
        .when(cyrillic / letters > CYRILLIC_SHARE, "ru")
        .otherwise("en")
    )


def find_year(*names: Column | str) -> Column:
    """Year in the first of the given names that holds one."""
    found = [F.nullif(F.regexp_extract(F.coalesce(_col(n), F.lit("")), YEAR, 1), F.lit("")) for n in names]
    return F.coalesce(*found).cast("int")


def clean_title(x: Column | str) -> Column:
    """Title from file properties; null when it is a template's placeholder."""
    t = strip(F.coalesce(_col(x), F.lit("")))
    t = F.regexp_replace(t, r"(?i)^microsoft (word|powerpoint) - ", "")
    t = strip(F.regexp_replace(t, r"(?i)\.(docx?|docm|pdf|pptx?)$", ""))
    junk = t.rlike(r"(?iu)^(presentation|document|слайд|титул).*$")
    return F.when((F.length(t) >= 8) & ~junk, t)


def short_label(x: Column | str, size: int = 80) -> Column:
    x = _col(x)
    cut = F.concat(F.regexp_replace(F.substring(x, 1, size), f"[{SPACE}]+$", ""), F.lit("…"))
    return F.when(F.length(x) > size, cut).otherwise(x)


def split_list(x: Column | str, sep: str = r"\|") -> Column:
    """`a|b|c` as an array: items trimmed, empty ones dropped, null as empty."""
    items = F.transform(F.split(F.coalesce(_col(x), F.lit("")), sep), strip)
    return F.filter(items, lambda item: item != "")


def fragment(position: Column, title: Column, source: Column, year: Column,
             unit_kind: Column, unit_no: Column, text: Column) -> Column:
    """One numbered citation block."""
    when = F.coalesce(F.concat(F.lit(", "), F.when(year != 0, year.cast("string"))), F.lit(""))
    return F.concat(
        F.lit("["), position.cast("string"), F.lit("] «"), title, F.lit("» ("), source, when,
        F.lit("; "), unit_kind, F.lit(" "), unit_no.cast("string"), F.lit(")\n"), text,
    )
