"""Text columns: cleaning, sentences, tokens, n-grams. All are built-in expressions and stay in the JVM, but for
Unicode normal forms, which have none."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space at a text's ends that cleaning strips.
ENDS = " \t\n\r\x0b\x0c"
SENTENCE = r"[^.!?\n]+"
WORD = r"[\p{L}]+"
#: Abbreviations whose full stops don't end a sentence (Greek judgements), and dots in the place of names.
ABBREVIATIONS = [
    "παρ.",
    "Π.Κ.",
    "Κ.Ποιν.Δ.",
    "Κ.Π.Δ.",
    "ΚΠΔ.",
    "ΚΠοινΔ.",
    "ΠΚ.",
    "αρ.",
    "αρθρ.",
    "Αρ.",
    "Αρθρ.",
    "κεφ.",
    "Κεφ.",
    "στοιχ.",
    "ν.",
    "Ν.",
    "εδ.",
    "αριθ. κατ.",
    "Μον. Πλημ.",
    "περ.",
    "υποπερ.",
    "Ολ.",
    "Ολ.ΑΠ",
    "αριθ. πρωτ.",
    "Ο.Α.Ε.Δ",
    "...",
]
#: Further ones, of this library: the first halves of those above by themselves, and the court's initials.
MORE_ABBREVIATIONS = ["ΑΠ.", "αριθ.", "κατ."]
EMAIL = r"[\p{L}\d][\p{L}\d_.+\-]*[\p{L}\d_+\-]@[\p{L}\d][\p{L}\d.\-]*\.\p{L}+"
URL = r"(?:https?://|www\.)\S+|\b[A-Za-z0-9\-]+\.(?:com|org|net|edu|gov|gr|eu|io|info)\b\S*"
#: Signs that the tokenizer sets apart; others, such as the apostrophe, go without a trace.
SIGNS = r"([.,;:¡!¿?…⋯&‹›«»\"“”\[\]()⟨⟩}{/|\\])"
#: Markers of sequence models.
SPECIAL_TOKENS = ["[SEP]", "[MASK]", "[CLS]", "[UNK]", "[PAD]"]
#: Where the reasoning of supreme-court judgements begins and ends.
SUPREME_COURT_STARTS = [
    "ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟ ΝΟΜΟ",
    "ΣΚΕΦΘΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟΝ ΝΟΜΟ",
    "ΣΚΕΦΤΗΚΕ ΣΥΜΦΩΝΑ ΜΕ ΤΟ ΝΟΜΟ",
    "Σκέφθηκε σύμφωνα με το νόμο",
    "Σκέφθηκε σύμφωνα με στείλουν νόμο",
    "Σ Κ Ε Φ Θ Η Κ Ε  Σ Υ Μ Φ Ω Ν Α  Μ Ε  Τ Ο  Ν Ο Μ Ο",
]
SUPREME_COURT_ENDS = ["Κρίθηκε και αποφασίσθηκε", "ΚΡΙΘΗΚΕ, αποφασίσθηκε", "ΚΡΙΘΗΚΕ και αποφασίσθηκε"]
#: The same for decisions of the state council.
STATE_COUNCIL_STARTS = [
    "Σκεφθέν κατά τον νόμον",
    "Α φ ο ύ\xa0μ ε λ έ τ η σ ε\xa0τ α\xa0σ χ ε τ ι κ ά\xa0έ γ γ ρ α φ α\n\nΣ κ έ φ θ η κ ε\xa0κ α τ ά\xa0τ ο ν\xa0Ν ό μ ο",
    "Α φ ο ύ μ ε λ έ τ η σ ε τ α σ χ ε τ ι κ ά έ γ γ ρ α φ α\n\nΣ κ έ φ θ η κ ε κ α τ ά τ ο ν Ν ό μ ο",
    "Α φ ο ύ μ ε λ έ τ η σ ε τ α σ χ ε τ ι κ ά έ γ γ ρ α φ α \nΣ κ έ φ θ η κ ε κ α τ ά τ ο ν ν ό μ ο \n",
]
STATE_COUNCIL_ENDS = [
    "Η διάσκεψη έγινε",
    "Η διάσκεψη   \nέγινε",
    "Κρίθηκε και αποφασίσθηκε στην Αθήνα",
    "Εκρίθη και απεφασίσθη εν Αθήναις",
    "και η απόφαση δημοσιεύθηκε σε δημόσια",
]
#: Fixed value: what becomes a space in decisions of the state council: a case number with a one-digit number between
#: hyphens, and a carriage return with its line feed. A line feed alone stays.
STATE_COUNCIL_NOISE = r"Αριθμός *\p{Nd}+/\p{Nd}+ -\p{Nd}-|\r\n"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(ENDS))


def collapse_whitespace(text: Column) -> Column:
    """Runs of one and the same character (space, line feed, tab) become one; mixed runs stay."""
    for one in (" ", "\n", "\t"):
        text = F.regexp_replace(text, f"{one}+", one)
    return text


def _pieces(text: Column, marker: str) -> Column:
    return F.split(text, "\\Q" + marker + "\\E", -1)


def cut_before_marker(text: Column, marker: str) -> Column:
    """What follows the first marker, without any marker, stripped; unchanged where there is none."""
    pieces = _pieces(text, marker)
    return F.when(F.size(pieces) > 1, strip(F.array_join(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), ""))).otherwise(text)


def cut_after_marker(text: Column, marker: str) -> Column:
    """What precedes the last marker, without any marker, stripped; unchanged where there is none."""
    pieces = _pieces(text, marker)
    return F.when(F.size(pieces) > 1, strip(F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), ""))).otherwise(text)


def cut(text: Column, markers: Iterable[str], mode: str) -> Column:
    """Cut at several markers in their order; mode: before or after."""
    if mode not in ("before", "after"):
        raise ValueError(f"mode is before or after, not {mode!r}")
    step = cut_before_marker if mode == "before" else cut_after_marker
    # an array of one text names it, so that the expression grows with the markers and not with a power of their number
    once = lambda t, marker: F.get(F.transform(F.array(t), lambda x: step(x, marker)), F.lit(0))
    return reduce(once, markers, text)


def clean_judgement(text: Column, starts: Iterable[str], ends: Iterable[str], noise: str | None = None) -> Column:
    """A noise pattern becomes one space, then start markers, then end markers cut: markers meet a text without noise."""
    text = F.regexp_replace(text, noise, " ") if noise else text
    return cut(cut(text, starts, "before"), ends, "after")


def clean_raw(text: Column, starts: Iterable[str], ends: Iterable[str], noise: str | None = None, newlines: bool = False) -> Column:
    """The whole cleaning of a raw text: line feeds go first if `newlines` (so that a marker with a line feed isn't met any
    more), then `clean_judgement`, and runs of white space collapse last."""
    return collapse_whitespace(clean_judgement(remove_newlines(text) if newlines else text, starts, ends, noise))


def clean_supreme_court(text: Column) -> Column:
    return clean_raw(text, SUPREME_COURT_STARTS, SUPREME_COURT_ENDS)


def clean_state_council(text: Column) -> Column:
    return clean_raw(text, STATE_COUNCIL_STARTS, STATE_COUNCIL_ENDS, STATE_COUNCIL_NOISE)


def remove_newlines(text: Column) -> Column:
    return F.translate(text, "\n", "")


def move_section_first(text: Column, marker: str) -> Column:
    """The marker and what follows its last place come first, then the other pieces; unchanged where there is none."""
    pieces = _pieces(text, marker)
    rest = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), " ")
    return F.when(F.size(pieces) > 1, F.concat(F.lit(marker + " "), F.element_at(pieces, -1), F.lit(" "), rest)).otherwise(text)


def sentences(text: Column) -> Column:
    """Non-empty sentences, trimmed. Any full stop ends one: see `whole_sentences`."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s, F.lit(" \t\r"))), lambda s: s != "")


def whole_sentences(text: Column) -> Column:
    """`sentences`, but the full stops of known abbreviations and of initials don't end one."""
    return F.transform(sentences(protect_abbreviations(text)), lambda s: restore_abbreviations(s))


def protect_abbreviations(text: Column, keep: str = "․") -> Column:
    """Full stops of abbreviations and of initials become another sign, for `sentences`; `restore` puts them back. Longer
    abbreviations come first; none begins inside a word or after a full stop."""
    for a in sorted([*ABBREVIATIONS, *MORE_ABBREVIATIONS], key=lambda x: -len(x)):
        text = F.regexp_replace(text, r"(?<![\p{L}.])\Q" + a + r"\E", a.replace(".", keep))
    return F.regexp_replace(text, r"(?<!\p{L})(\p{Lu})\.", "$1" + keep)


def restore_abbreviations(text: Column, keep: str = "․") -> Column:
    return F.translate(text, keep, ".")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def clean_text(text: Column) -> Column:
    """Lower case, single spaces, and only letters, numbers, hyphens and spaces; other signs go without a trace."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"[^\p{L}\p{N}\- ]", "")


def separate_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, SIGNS, " $1 ")


def contains_letters(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def contains_numbers(word: Column) -> Column:
    return word.rlike(r"\p{Nd}")


def filter_words(tokens: Column, stopwords: Iterable[str] = (), keep_numbers: bool = False) -> Column:
    stop = list(stopwords)
    fine = lambda w: (contains_letters(w) | contains_numbers(w)) if keep_numbers else (contains_letters(w) & ~contains_numbers(w))
    return F.filter(tokens, lambda w: fine(w) & ~w.isin(stop) if stop else fine(w))


def tokenize(text: Column, stopwords: Iterable[str] = (), keep_numbers=False, keep_emails=False, keep_urls=False) -> Column:
    """Words as the rule-based tokenizer cuts them; a word that holds an address is dropped or kept whole."""
    stop = list(stopwords)
    none = F.array().cast("array<string>")
    plain = lambda w: filter_words(F.split(F.trim(F.regexp_replace(clean_text(separate_punctuation(w)), " +", " ")), " "), stop, keep_numbers)
    each = lambda w: (
        F.when(w.rlike(EMAIL), F.array(F.lower(w)) if keep_emails else none)
        .when(w.rlike(URL), F.array(F.lower(w)) if keep_urls else none)
        .otherwise(plain(w))
    )
    return F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), each))


def remove_stopwords(text: Column, stopwords: Iterable[str]) -> Column:
    """Exact case, cut at single spaces."""
    stop = list(stopwords)
    return F.array_join(F.filter(F.split(text, " ", -1), lambda w: ~w.isin(stop)), " ")


def first_tokens(text: Column, n: int | Column) -> Column:
    """The first n white-space tokens with the white space before each of them, as it stands."""
    tokens = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    return F.array_join(F.slice(tokens, F.lit(1), F.lit(n) if isinstance(n, int) else n), "")


def is_special_token(token: Column) -> Column:
    return token.isin(SPECIAL_TOKENS)


def first_subwords(tokens: Column, n: int, keep_special: bool = False) -> Column:
    """The first n of given subword tokens, joined by a space; markers of sequence models don't count unless kept."""
    some = tokens if keep_special else F.filter(tokens, lambda t: ~is_special_token(t))
    return F.array_join(F.slice(some, 1, n), " ")


def token_budget(base: Column, fraction: float) -> Column:
    """Whole tokens in that share of a text; 1 where there is no text."""
    n = F.size(F.filter(F.split(base, r"\s+"), lambda w: w != ""))
    return F.coalesce(F.when(base.isNotNull(), F.floor(n * F.lit(float(fraction))).cast("int")), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens (1 to 4), joined by a space."""
    if n not in (1, 2, 3, 4):
        raise ValueError("n is 1, 2, 3 or 4")
    if n == 1:
        return tokens
    at = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def category_prefix(tags: Column, text: Column) -> Column:
    return F.concat(F.translate(tags, "_", " "), F.lit(" [SEP] "), text)


def file_index(name: Column) -> Column:
    """417 for a/417.json and 1 for 1.txt.json."""
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^([0-9]+)\.", 1).cast("int")


def parse_count(text: Column) -> Column:
    """1234 for (1 234)."""
    return F.regexp_replace(text, "[^0-9]", "").cast("int")


#: Combining marks: grave, acute and circumflex accents become the acute one; breathings and the iota below go.
_ACCENTS, _DROPPED = "\u0300\u0301\u0342", "\u0313\u0314\u0345"


def _plain_greek(letter: str) -> str:
    parts = unicodedata.normalize("NFD", letter)
    accent = "\u0301" if any(m in _ACCENTS for m in parts) else ""
    rest = "".join(m for m in parts if m not in _ACCENTS + _DROPPED)
    return unicodedata.normalize("NFC", rest + accent)


#: Small letters of the block of accented Greek, by rule.
_GREEK = {k: _plain_greek(chr(k)) for k in range(0x1F00, 0x2000) if unicodedata.category(chr(k)) == "Ll"}


@F.pandas_udf(StringType())
def fold_greek(text: pd.Series) -> pd.Series:
    """Compatibility-composed form, with small Greek vowels under any accents on their plain form or that with an acute."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate(_GREEK))


@F.pandas_udf(StringType())
def strip_acute(text: pd.Series) -> pd.Series:
    """Decomposed form without the acute accent."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t).replace("\u0301", ""))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br/>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
