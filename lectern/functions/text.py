"""Column functions for cleaning, naming and analysing text.

All of them are built-in Spark expressions: no Python runs per row, and the
optimizer sees through them. Regular expressions name their character classes
where Java's and other engines' shorthand classes differ.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the clean-up's trim and ``\S`` of the service treat as white space.
SPACE = "\\x09-\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"

#: Words that the offline analyzer leaves out.
STOP_WORDS = "a an and are as at be by for from has have i in is it its of on or that the to was were will with you your we our do does can what how why when who".split()

#: The suffix rules of the offline analyzer, tried in this order.
SUFFIX_RULES = [
    (r"(at|bl|iz)(ing|ed)$", "$1e"),
    (r"([aeiou][a-z]{2,})(ing|edly|ed)$", "$1"),
    (r"(.{3,})(ment|ness|tion|ions|ance|ence)$", "$1"),
    (r"(.{3,})(ly|ility|ity|ive|ful)$", "$1"),
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Letters whose full upper case is several letters, and what each is when letters map to one letter at most: itself, unless it has one capital.
SEVERAL = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
ONE_EACH = "".join("\u1E9E" if c == "\u00DF" else c.title() if len(c.title()) == 1 else c for c in SEVERAL)


def upper_one_to_one(c: Column | str) -> Column:
    """Upper case letter by letter, so that lengths stay: a sharp s becomes its capital and not two letters."""
    apart = F.split(_col(c), f"(?<=[{SEVERAL}])|(?=[{SEVERAL}])")
    each = F.transform(apart, lambda x: F.when(x.rlike(f"[{SEVERAL}]"), F.translate(x, SEVERAL, ONE_EACH)).otherwise(F.upper(x)))
    return F.when(_col(c).rlike(f"[{SEVERAL}]"), F.array_join(each, "")).otherwise(F.upper(_col(c)))


def trim_all(c: Column | str) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def collapse_letter_spacing(c: Column | str) -> Column:
    """``W O R D`` -> ``WORD`` for runs of four or more single letters or digits: a
    space goes if it stands within such a run, whichever its place there."""
    one, edge_left, edge_right = "[A-Za-z0-9]", "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
    # the space comes first, as all other places fail there at once
    before = {n: f"(?<={edge_left}{' '.join([one] * n)} )" for n in (1, 2, 3)}
    after = {n: f"(?={' '.join([one] * n)}{edge_right})" for n in (1, 2, 3)}
    return F.regexp_replace(_col(c), f" (?:{'|'.join(before[n] + after[4 - n] for n in (1, 2, 3))})", "")


def normalize_whitespace(c: Column | str, letters: bool = True) -> Column:
    """Letter spacing collapsed (unless ``letters`` is False), line ends, spaces and blank lines evened out."""
    out = collapse_letter_spacing(c) if letters else _col(c)
    for pattern, by in (("\r\n?", "\n"), ("\u00A0", " "), ("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return trim_all(out)


def slug(c: Column | str, max_len: int = 80, strip_ext: bool = True) -> Column:
    """Lower case, words joined by dashes; may collide, see ``slug_collisions``."""
    out = F.lower(_col(c))
    if strip_ext:
        out = F.regexp_replace(out, r"\.[a-z0-9]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(out, 1, max_len)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(f"[^{SPACE}]+"))


def content_sha256(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def text_md5(c: Column | str) -> Column:
    return F.md5(_col(c).cast("binary"))


def module_of(path: Column | str) -> Column:
    """``Module N`` if a path names one, else null."""
    digit = F.regexp_extract(_col(path), r"(?i)module[ \t_]*?(\d)", 1)
    return F.when(digit != "", F.concat(F.lit("Module "), digit))


def normalize_query(c: Column | str) -> Column:
    """The key under which a repeated question is the same question."""
    out = F.regexp_replace(F.lower(_col(c)), f"[{SPACE}]+", " ")
    return F.trim(F.regexp_replace(out, "[^a-z0-9 ]", ""))


def estimate_tokens(c: Column | str) -> Column:
    return F.ceil(F.length(_col(c)) / 4).cast("int")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the value is the element of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stem(token: Column) -> Column:
    """Plural endings first, then the first suffix rule that shortens the word to three letters or more.

    Most words meet no ending, which two cheap tests find out.
    """
    ending = any_of(p.rsplit("(", 1)[1].removesuffix(")$") for p, _ in SUFFIX_RULES)

    def rules(word: Column) -> Column:
        out = word
        for pattern, by in reversed(SUFFIX_RULES):
            out = F.when(word.rlike(pattern) & (F.length(F.regexp_replace(word, pattern, by)) >= 3), F.regexp_replace(word, pattern, by)).otherwise(out)
        return F.when(word.rlike(f"(?:{ending})$"), out).otherwise(word)

    single = F.when(token.endswith("s"), F.regexp_replace(F.regexp_replace(token, "(ss|i)es$", "$1"), "([^aeious])s$", "$1")).otherwise(token)
    return F.when(F.length(token) <= 3, token).otherwise(_bound(single, rules))


def tokenize(c: Column | str) -> Column:
    """The default analyzer: array of terms, in order, repeats included."""
    raw = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[a-z0-9][a-z0-9'$,.]*"), F.lit(0))
    trimmed = F.transform(raw, lambda t: F.rtrim(t, F.lit("',.")))
    kept = F.filter(trimmed, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))
    return F.transform(kept, lambda t: F.when(t.rlike("[0-9$]"), t).otherwise(stem(t)))


def shingles(c: Column | str, n: int = 5) -> Column:
    """Distinct runs of n words of the lower-cased text; none if it has fewer words."""
    tokens = F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9']+"), F.lit(0))
    # the words are bound once, as the element of a one-element array
    runs = F.flatten(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(runs)


def format_locator(label: Column | str, start: Column | str, end: Column | str) -> Column:
    label, start, end = _col(label), _col(start), _col(end)
    one = F.concat(label, start.cast("string"))
    many = F.concat(F.when(label == "p.", F.lit("pp. ")).otherwise(F.lit("slides ")), start.cast("string"), F.lit("–"), end.cast("string"))
    return F.when(label.isNull() | start.isNull(), F.lit(None).cast("string")).when(end.isNull() | (end == start), one).otherwise(many)


def is_heading(c: Column | str) -> Column:
    """A short line in capitals that ends no sentence."""
    t = trim_all(c)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return F.length(t).between(3, 90) & ~t.rlike("[.!?]$") & (F.length(letters) >= 3) & (letters == F.upper(letters))


def any_of(patterns: Iterable[str]) -> str:
    """One pattern of several."""
    return "|".join(f"(?:{p})" for p in patterns)


def mark_terms(text: Column | str, terms: Column | str, left: str = "[", right: str = "]") -> Column:
    """Wrap each term wherever it stands in the text, whatever its case; terms are taken literally."""
    quote = lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.aggregate(_col(terms), _col(text), lambda acc, t: F.regexp_replace(acc, F.concat(F.lit("(?i)("), quote(t), F.lit(")")), F.lit(f"{left}$1{right}")))
