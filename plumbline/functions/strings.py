"""String expressions: base forms, text normalisation and text properties, all inside the JVM."""

import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Base forms of strings that stand for a missing value.
NULL_FORMS = ["none", "null", "nan", "na", "", "\x00", "\x00\x00"]
# Fixed value: the ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Frequent English words that carry no content.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so "
    "that the their them they this to was we were will with you your"
).split()

# Letters and digits of Unicode 14 and 15, by their hexadecimal numbers. SQL's patterns know them, Java 17's end with version 13.
_LATER = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 "
    "105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 "
    "12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad "
    "1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
).split()
#: For classes of Java patterns: letters and digits of any script, and white space (as in SQL, without the vertical tab). The later ones are compared beyond the first of them only.
LETTERS = r"\p{L}\p{N}[\x{870}-\x{323af}&&[" + "".join("-".join(rf"\x{{{c}}}" for c in r.split("-")) for r in _LATER) + "]]"
SPACE = r"\t\n\f\r "
#: Those and common punctuation.
UNSPECIAL = LETTERS + SPACE + r".,;:!?'\"()-"

# What counts as a URL (scheme and host) and as an e-mail address; counts depend on these patterns.
# A URL's parts are possessive, as Java would go a call deeper with each character and overflow the stack at some thousand.
URL = r"https?://(?:[-\w.]++|%[\da-fA-F]{2})++"
# An address starts where its run of characters starts, or where the last one ended: looked for from each character on, a long run takes its square.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def base_form(text: Column) -> Column:
    """Letters and digits of any script, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def base_form_or_text(text: Column) -> Column:
    """The base form, or the text itself where nothing is left."""
    form = base_form(text)
    return F.when(form == "", text).otherwise(form)


def is_only_special(text: Column) -> Column:
    return (F.length(text) > 0) & (base_form(text) == "")


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def remove_stopwords(text: Column, stopwords: list[str] | None = None) -> Column:
    words = STOPWORDS if stopwords is None else stopwords
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~F.lower(w).isin(words)), " ")


def normalize_text(text: Column, ignore_case: bool = True, punctuation: bool = True, stopwords: bool = True, whitespace: bool = False, unicode: bool = True) -> Column:
    """Lower case, then without punctuation, then composed, then without stopwords, then (if asked) without white space.

    Composing takes a Python pass, as Spark has no function for it; texts of
    ASCII only are composed as they are, and go around it.
    """
    out = F.lower(text) if ignore_case else text
    out = remove_punctuation(out) if punctuation else out
    out = F.coalesce(normalize_unicode(F.when(F.octet_length(out) != F.length(out), out)), out) if unicode else out
    out = remove_stopwords(out) if stopwords else out
    return F.regexp_replace(out, r"\s", "") if whitespace else out


def is_number(text: Column) -> Column:
    """Whether a string reads as a number: digits with sign, point and exponent, white space around allowed."""
    return F.coalesce(text.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"), F.lit(False))


#: The columns that hold a text's words, sentences and number of syllables already, while properties of one text are put together.
_at_hand: ContextVar[tuple[Column, Column, Column] | None] = ContextVar("at_hand", default=None)


@contextmanager
def at_hand(own_words: Column, own_sentences: Column, own_syllables: Column) -> Iterator[None]:
    """Properties made inside take a text's words, sentences and syllables from columns instead of finding them each for itself."""
    token = _at_hand.set((own_words, own_sentences, own_syllables))
    try:
        yield
    finally:
        _at_hand.reset(token)


def split_words(text: Column) -> Column:
    """Non-empty parts of the text between other characters than letters, digits and underscore."""
    return F.array_remove(F.split(text, f"[^{LETTERS}_]+"), "")


def words(text: Column) -> Column:
    return found[0] if (found := _at_hand.get()) else split_words(text)


def _share(text: Column, kept: Column) -> Column:
    return F.when(F.length(text) > 0, (F.length(text) - F.length(kept)) / F.length(text)).otherwise(F.lit(0.0))


def text_length(text: Column) -> Column:
    return F.length(text)


def average_word_length(text: Column) -> Column:
    w = words(text)
    return F.when(F.size(w) > 0, F.aggregate(F.transform(w, F.length), F.lit(0), lambda a, x: a + x) / F.size(w)).otherwise(F.lit(0.0))


def max_word_length(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(words(text), F.length)), F.lit(0))


def percentage_special_characters(text: Column) -> Column:
    """Share of characters that are no letters, digits, white space or common punctuation."""
    return _share(text, F.regexp_replace(text, f"[^{UNSPECIAL}]", ""))


def percentage_punctuation(text: Column) -> Column:
    return _share(text, remove_punctuation(text))


def lexical_density(text: Column) -> Column:
    w = split_words(F.lower(text))
    return F.when(F.size(w) > 0, F.bround(F.size(F.array_distinct(w)) / F.size(w), 2))


def sentences(text: Column) -> Column:
    return found[1] if (found := _at_hand.get()) else split_sentences(text)


def split_sentences(text: Column) -> Column:
    """Parts of the text between stops that white space or the text's end follows, but for those of spaces (of any script) only."""
    return F.filter(F.split(text, rf"[.!?]+(?:[{SPACE}]+|\z)"), lambda s: s.rlike(r"[^\p{Zs}]"))


def sentences_count(text: Column) -> Column:
    return F.size(sentences(text))


def average_words_per_sentence(text: Column) -> Column:
    s = sentences(text)
    return F.when(F.size(s) > 0, F.bround(F.size(words(text)) / F.size(s), 3))


def urls_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(URL))


def unique_urls_count(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0))))


def email_addresses_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EMAIL))


def unique_email_addresses_count(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))))


def reading_time(text: Column) -> Column:
    """Seconds, at 14.69 milliseconds a character that is not white space."""
    return F.bround(F.length(F.regexp_replace(text, r"\s", "")) * 14.69 / 1000, 2)


# --- syllables, by rule ------------------------------------------------------


# Fixed value: a match for each syllable of words with a space before and after each. Either a word without vowels but for a
# silent e at its end, or a group of vowels that is no silent e; an e is silent at a word's end after another letter than a vowel or l.
_VOWEL = "aeiouyAEIOUY\u0130"
SYLLABLE = rf" [^{_VOWEL} ]++(?:(?<![lL])[eE])?(?= )|[{_VOWEL}]++(?:(?=[^ ])|(?<![^{_VOWEL}lL ][eE]))"


def count_syllables(own_words: Column) -> Column:
    """Of words, groups of vowels, less a silent e at the end, at least one a word: an approximation without a lexicon, for English."""
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(own_words, " "), F.lit(" ")), F.lit(SYLLABLE))


def syllables_count(text: Column) -> Column:
    return found[2] if (found := _at_hand.get()) else count_syllables(words(text))


def _round_even(value: Column, digits: int) -> Column:
    """Half to even on the scaled double, as SQL's round_even does; ``bround`` goes by the shortest decimal and differs near ties."""
    return F.rint(value * 10.0**digits) / 10.0**digits


def readability_score(text: Column) -> Column:
    """Flesch's reading ease, with syllables by rule: higher is easier."""
    n, s = F.size(words(text)), F.size(sentences(text))
    # The factors are decimals: counts are scaled as whole numbers, so that each product is rounded once.
    per_sentence, per_word = F.lit(1015).cast("long") * n / 1000 / s, F.lit(846).cast("long") * syllables_count(text) / 10 / n
    return F.when((n > 0) & (s > 0), _round_even(206.835 - per_sentence - per_word, 3))


def unique_syllables_count(text: Column) -> Column:
    """How many distinct words the syllables are counted over."""
    return F.size(F.array_distinct(F.transform(words(text), F.lower)))


def average_syllable_length(text: Column) -> Column:
    """Syllables of a sentence on average."""
    s = F.size(sentences(text))
    return F.when(s > 0, _round_even(syllables_count(text) / s, 2))


def english_text(language: Column) -> Column:
    """Whether a language column says English."""
    return F.lower(language).isin("en", "eng", "english")


# --- more on strings ---------------------------------------------------------


@F.pandas_udf(StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def cut_string(text: Column, length: int = 200) -> Column:
    """The text up to the first space at or after ``length`` characters."""
    return F.regexp_extract(text, rf"(?s)^.{{0,{length}}}$|^.{{{length}}}[^ ]*", 0)


def first_of(text: Column, parts: list[str]) -> Column:
    """struct(at, part) of the earliest of several substrings (the first in the list of equal ones); at is 0-based, -1 if there is none."""
    found = F.array(*(F.struct((F.instr(text, p) - 1).alias("at"), F.lit(k).alias("k"), F.lit(p).alias("part")) for k, p in enumerate(parts)))
    best = F.array_min(F.filter(found, lambda x: x["at"] >= 0))
    return F.struct(F.coalesce(best["at"], F.lit(-1)).alias("at"), best["part"].alias("part"))


def split_and_keep(text: Column, separators: list[str]) -> Column:
    """The parts of a text and its separators between them, in order; nothing is lost but empty parts."""
    ordered = sorted(separators, key=len, reverse=True)
    one = "|".join(f"\\Q{s}\\E" for s in ordered)
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?s)(?:{one})|(?:(?!{one}).)+"), F.lit(0)), lambda p: p != "")


def split_by_order(text: str, separators: list[str], keep: bool = True) -> list[str]:
    """A text cut at each separator in turn, one after the other; a separator that does not follow is passed over."""
    out, rest = [], text
    for s in separators:
        before, found, after = rest.partition(s)
        if found:
            out += [p for p in (before, found if keep else "") if p]
            rest = after
    return [*out, *([rest] if rest else [])]


def break_to_lines(text: str, max_lines: int = 10, least: int = 50, most: int = 60) -> str:
    """A text in lines of ``least`` to ``most`` characters, broken at spaces where it can be, joined by <br>; "..." where lines are left out."""
    lines, rest = [], text.strip()
    while rest and len(lines) < max_lines:
        if len(rest) <= most:
            lines.append(rest)
            rest = ""
            break
        at = rest.rfind(" ", least, most + 1)
        line, rest = (rest[:at], rest[at + 1 :]) if at >= 0 else (f"{rest[: most - 1]}-", rest[most - 1 :])
        lines.append(line)
    if rest:
        lines[-1] += "..."
    return "<br>".join(lines)


def clean_iob(tags: Column) -> Column:
    """Tags without their B-, I- and O- marks."""
    return F.transform(tags, lambda t: F.regexp_replace(t, "^[BIO]-", ""))


def row_sum(values: Column) -> Column:
    """The sum of an array of numbers."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def null_name(value: Column, kind: str = "string") -> Column:
    """The name of a missing value: NULL, NaN, or of a string its base form if that stands for one."""
    if kind in ("double", "float"):
        return F.when(value.isNull(), "NULL").when(F.isnan(value), "NaN")
    if kind == "string":
        return F.when(value.isNull(), "NULL").when(base_form(value).isin(*NULL_FORMS), value)
    return F.when(value.isNull(), "NULL")


#: Built-in properties by name. Those that need a downloaded model (sentiment, toxicity, fluency, formality,
#: language, nouns) are columns that a caller adds, see ``text_properties(extra=...)``.
TEXT_PROPERTIES = {
    "text_length": text_length,
    "average_word_length": average_word_length,
    "max_word_length": max_word_length,
    "percentage_special_characters": percentage_special_characters,
    "percentage_punctuation": percentage_punctuation,
    "lexical_density": lexical_density,
    "sentences_count": sentences_count,
    "average_words_per_sentence": average_words_per_sentence,
    "urls_count": urls_count,
    "unique_urls_count": unique_urls_count,
    "email_addresses_count": email_addresses_count,
    "unique_email_addresses_count": unique_email_addresses_count,
    "reading_time": reading_time,
    "readability_score": readability_score,
    "unique_syllables_count": unique_syllables_count,
    "average_syllable_length": average_syllable_length,
}
#: Those that count syllables.
SYLLABIC = ("readability_score", "average_syllable_length")
