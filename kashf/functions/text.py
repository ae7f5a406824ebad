"""Text kernel: normalisers, sentences, junk tests, tokens, display. Column in, Column out; nulls count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TATWEEL = "\u0640"
MARKS = r"[\u0617-\u061A\u064B-\u0652\u0670\u06D6-\u06ED]"
MARKS_WIDE = r"[\u0610-\u061A\u064B-\u065F\u06D6-\u06ED]"
DIGITS_IN, DIGITS_OUT = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2
HAMZA_IN, HAMZA_OUT = "أإآى", "اااي"
SPACES = r"(?U)[\s\x1c-\x1f]+"
RLE, PDF = "\u202b", "\u202c"
HIDDEN = r"[\u200b-\u200f]"
RIGHTS = "جميع الحقوق محفوظة|التعليم المساند والإبداع العلمي"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def _folded(c, extra_in: str = "", extra_out: str = "") -> Column:
    x = F.coalesce(_c(c), F.lit(""))
    x = F.regexp_replace(F.replace(x, F.lit(TATWEEL), F.lit("")), MARKS, "")
    return F.translate(x, HAMZA_IN + extra_in + DIGITS_IN + "،٫", HAMZA_OUT + extra_out + DIGITS_OUT + ",.")


def norm_retrieval(c) -> Column:
    """Retrieval form: hamza, alef maqsura and taa marbuta folded, digits in ASCII, glyph names dropped; case is kept."""
    return squeeze(F.regexp_replace(_folded(c, "ة", "ه"), r"(?U)\buni[0-9A-Fa-f]{3,6}\b", ""))


def norm_eval(c) -> Column:
    """Evaluation form: like retrieval, but taa marbuta stays and /uniXXXX and zero-width marks go."""
    return squeeze(F.regexp_replace(F.regexp_replace(_folded(c), "/uni[0-9A-Fa-f]{4}", ""), HIDDEN, ""))


def norm_heading(c) -> Column:
    """Heading form: lower case, wide set of marks, no digits or tatweel folded."""
    x = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), MARKS_WIDE, "")
    return squeeze(F.translate(x, "إأآةى", "اااهي"))


def letter_ratio(normed) -> Column:
    """Letters over non-space characters; null for a text without any."""
    total = F.char_length(F.replace(normed, F.lit(" "), F.lit("")))
    return F.when(total > 0, F.char_length(F.regexp_replace(normed, r"[^\p{L}]", "")) / total)


def is_junk(raw, normed) -> Column:
    return (F.char_length(normed) < 6) | F.coalesce(_c(raw).rlike(RIGHTS), F.lit(False)) | (F.coalesce(letter_ratio(normed), F.lit(1.0)) < 0.5)


def split_sentences(c) -> Column:
    """Parts after . ! ? Arabic ? and comma or a newline that white space follows, trimmed, blanks dropped."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), r"(?U)(?<=[.!؟?،]|\n)[\s\x1c-\x1f]+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def strip(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_sentences(c) -> Column:
    """Sentences that aren't junk; if none is left the whole text, if that is blank none."""
    kept = F.filter(split_sentences(c), lambda s: ~bound(norm_retrieval(s), lambda n: is_junk(s, n)))
    whole = strip(F.coalesce(_c(c), F.lit("")))
    return bound(kept, lambda k: F.when(F.size(k) > 0, k).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))


def has_digit(c) -> Column:
    return _c(c).rlike(r"(?U)\d")


def any_of(c, tokens) -> Column:
    """Whether any of the literal tokens stands in the text."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(_c(c), F.lit(t))
    return out


def has_time_hint(normed) -> Column:
    return any_of(normed, ["من", "حتي", ":", "."])


def gate_tokens(normed) -> Column:
    return F.filter(F.split(normed, r"[\s|:/,;]+"), lambda x: x != "")


def query_terms(normed) -> Column:
    return F.array_distinct(F.filter(F.split(normed, " "), lambda x: F.char_length(x) >= 3))


def topic_tokens(normed) -> Column:
    return F.array_distinct(F.filter(F.split(normed, "[^ء-يa-zA-Z0-9]+"), lambda x: F.char_length(x) >= 4))


def words(normed) -> Column:
    return F.filter(F.split(F.lower(normed), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def bound(value, f) -> Column:
    """f(value) with the value worked out once a row, however often ``f`` reads it inside its own lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_ngrams(ws, low: int = 1, high: int = 2) -> Column:
    def of(w, n):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return bound(ws, lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)]))


def char_ngrams(t, low: int = 2, high: int = 5) -> Column:
    """Runs of characters; the text is split into characters once, and each run reads its own places only."""

    def of(c, n):
        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return bound(F.filter(F.split(_c(t), ""), lambda x: x != ""), lambda c: F.concat(*[of(c, n) for n in range(low, high + 1)]))


def shorten(c, most: int = 260, mark: str = "…") -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(_c(c), 1, most), F.lit(mark))).otherwise(_c(c))


def rtl_wrap(c) -> Column:
    return F.concat(F.lit(RLE), _c(c), F.lit(PDF))


def rtl_unwrap(c) -> Column:
    return F.translate(_c(c), RLE + PDF, "")


def arabic_digits(c) -> Column:
    return F.translate(_c(c), "0123456789", "٠١٢٣٤٥٦٧٨٩")


def clean_display(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "/uni[0-9A-Fa-f]{4}", ""), HIDDEN, "")


def display(c, rtl: str = "auto", digits: str = "ascii") -> Column:
    """For print: rtl is auto, off or force; digits is ascii or arabic."""
    x = clean_display(c)
    x = arabic_digits(x) if digits == "arabic" else x
    if rtl == "off":
        return rtl_unwrap(x)
    if rtl == "force":
        return F.when(x.startswith(RLE) & x.endswith(PDF), x).otherwise(rtl_wrap(x))
    return x


def jaccard(a, b) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def fingerprint(c) -> Column:
    return F.sha2(_c(c).cast("binary"), 256)


def pages_of(answer) -> Column:
    """The page numbers of the lines after "Sources:"; none for a negative page."""
    tail = F.regexp_extract(answer, r"(?s)Sources:\s*(.*)", 1)
    lines = F.split(tail, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.transform(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"page\s+(\d+)", 1)), lambda x: x != ""), lambda x: x.cast("int"))
