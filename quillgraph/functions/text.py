"""Text functions as column expressions, all inside the JVM but NFC."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.vectorised import arrow_udf

ENTITY = "entity:"
PHRASES = (
    "adversely affect certain", "all our premium content", "consent banner", "consenting to these technologies", "cookie consent", "cookie policy", "delivered straight to your inbox",
    "editorial opportunities", "gdpr.?compliant", "join our community", "manage cookie consent", "opt.?out", "post a press release", "privacy policy", "reach our audience",
    "skip to content", "subscribe now", "view preferences", "withdrawing consent",
)
MENU = (
    "view all latest", "view all", "view preferences", "subscribe", "sign in", "see all", r"search\.\.\.", "search", "resources", "news", "newsletter", "more", "menu", "log in",
    "industries", "home", "explore more", "explore all", "explore", "events", "deny", "contact us", "click here", "categories", "applications", "accept",
)
BOILERPLATE = "(?i)(" + "|".join(PHRASES) + ")"
NAVIGATION = "(?i)^(" + "|".join(MENU) + ")$"
HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{00AD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
SENTENCES = r"\n|(?<=[.!?])\s+"


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def entity_id(c: Column) -> Column:
    return F.concat(F.lit(ENTITY), slugify(c))


def clean_line(c: Column) -> Column:
    """Without emphasis, heading, quote and bullet marks; white space runs become single spaces."""
    for pattern in (r"\*\*|__|`+", r"^\s*#{1,6}\s+", r"^\s*>+\s*", r"^[-*•▪◦\d.)\s]+"):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_boilerplate(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return (t == "") | t.rlike(BOILERPLATE) | t.rlike(NAVIGATION)


def strip_boilerplate(c: Column) -> Column:
    kept = F.filter(F.split(c, r"\r?\n"), lambda line: ~is_boilerplate(line))
    return F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")


_SPACE, _ENDS = " \t\n\x0b\f\r", "\u0085\u2028\u2029"  # white space and further line ends as the JVM has them
_PHRASE = re.compile("|".join(PHRASES).replace(".?", f"[^\n\r{_ENDS}]?"), re.I | re.A)
_MENU = re.compile(f"(?:{'|'.join(MENU)})[{_ENDS}]?\\Z", re.I | re.A)
_LONGEST = max(map(len, MENU)) + 1
#: each phrase holds one of these
_PARTS = tuple(p.split(".?")[0] for p in PHRASES)


def stripped_text(text: str) -> str:
    """strip_boilerplate() in Python: phrases are looked for line by line only where a text holds a part of one."""
    low, kept = text.lower(), []
    risky = any(p in low for p in _PARTS) and _PHRASE.search(text) is not None
    for line in re.split("\r?\n", text):
        t = line.strip(_SPACE)
        if t[-1:] in _ENDS:  # Java's $ is also before a last line end
            t = (t[:-1].rstrip(_SPACE) + t[-1:]).strip(" ")
        if t and not (len(t) <= _LONGEST and _MENU.match(t)) and not (risky and _PHRASE.search(t)):
            kept.append(line)
    return "\n".join(kept)


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCES)


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def query_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= 3))


def _folds() -> tuple[str, str]:
    """Accented Latin letters with their plain ones, then the combining marks, which have none."""
    plain = {chr(i): d[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and d[0] in "abcdefghijklmnopqrstuvwxyz"}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


ACCENTED, PLAIN = _folds()


def search_tokens(c: Column) -> Column:
    """What full-text search finds: runs of letters and digits of any script, lower-cased, without accents, in order."""
    low = F.lower(c)
    plain = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))  # only ASCII: no accents
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}\p{Co}]+)"))


def search_terms(c: Column) -> Column:
    """Terms of a full-text query: letters of any script, digits and a few signs, at least two of them ASCII."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}£$€%.\-]+)"))
    return F.filter(found, lambda t: F.length(F.regexp_replace(t, "[^a-z0-9]", "")) >= 2)


def best_passage(content: Column, terms: Column) -> Column:
    """The line with the most matched term letters (the first of equals), else the first; empty if all is boilerplate."""
    lines = F.filter(F.transform(sentences(F.trim(content)), clean_line), lambda x: ~is_boilerplate(x))
    scored = F.transform(
        lines,
        lambda line, i: F.struct(
            F.aggregate(terms, F.lit(0), lambda s, t: s + F.when(F.contains(F.lower(line), t), F.length(t)).otherwise(0)).alias("score"),
            (-i).alias("place"),
            line.alias("line"),
        ),
    )
    return F.coalesce(F.array_max(scored)["line"], F.lit(""))


def grams(c: Column, n: int) -> Column:
    """The different runs of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def stem(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "(ing|ed|es|s)$", "")


def predicate(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def predicate_matches(edge: Column, wanted: Column) -> Column:
    e = stem(edge)
    return (e == wanted) | F.contains(e, wanted) | F.contains(wanted, e)


@arrow_udf("string")
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def sanitize(c: Column, limit: int | None = None, collapse: bool = False, normal: bool = True) -> Column:
    """NFC, without invisible and control characters; null becomes empty."""
    c = F.regexp_replace(nfc(F.coalesce(c, F.lit(""))) if normal else F.coalesce(c, F.lit("")), HIDDEN, "")
    if collapse:
        c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.substring(c, 1, limit) if limit is not None else c


def label(c: Column) -> Column:
    return sanitize(c, 256, True)


def has_hidden(c: Column) -> Column:
    return c.rlike(HIDDEN)


def within_size(c: Column, most: int) -> Column:
    return F.octet_length(c) <= most


def is_binary(content: Column) -> Column:
    """Whether a zero byte is among the first 8192 bytes."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 8192)), "(..)", "$1 ")) > 0


def approx_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def datamark(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "▁")


def wrap_untrusted(content: Column, source: Column, n: Column, mark: bool = False) -> Column:
    """A recalled snippet between tags that say where it came from and that it is data."""
    safe, name = sanitize(content), sanitize(source, 120, True)
    name = F.when(name == "", "untitled").otherwise(name)
    return F.concat(F.lit('<untrusted_memory id="'), n.cast("string"), F.lit('" source="'), name, F.lit('">\n'), datamark(safe) if mark else safe, F.lit("\n</untrusted_memory>"))


def salient_terms(c: Column, n: int = 6) -> Column:
    """The n longest different words that aren't function words; ties in order of appearance."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9][a-z0-9-]{2,})")), lambda w: ~w.isin(*COMMON)))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["w"])


COMMON = tuple("across after and are but for from had has have into its more our over than that the their these they this those was were will with you your".split())


def answer_form(c: Column) -> Column:
    """An answer without quotes, punctuation and case, for comparisons."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "['’`]", ""), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


REFUSALS = "(dont know|do not know|not sure|(cannot|cant|unable to) (answer|determine)|(no|not enough|insufficient) information|not in the (provided )?context|not (available|mentioned|provided|specified|stated)|no (answer|mention)|unknown)"


def declines(c: Column) -> Column:
    t = answer_form(c)
    return (t == "") | t.rlike(REFUSALS)


CUES = r"(?i)\b(acquir|agree|approv|budget|commit|confidential|contract|critical|deadline|deal|decid|decision|fir(e|ed)|funding|hir(e|ed|ing)|important|launch|merg|must|priority|raised?|revenue|roadmap|signed?|strategy|urgent)\b"


def importance(typed: Column, entities: Column, experiences: Column, text: Column) -> Column:
    """Between 0.5 and 3: typed relations, entities, experiences and words of consequence raise it from 1."""
    raw = 1 + F.least(F.lit(0.8), 0.12 * typed) + F.least(F.lit(0.3), 0.05 * entities) + F.least(F.lit(0.5), 0.2 * experiences) + F.when(text.rlike(CUES), 0.5).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.round(raw, 3)))


def wants_breadth(c: Column) -> Column:
    return F.lower(c).rlike(r"\b(all|both|compare|comparison|each|every|everything|list|summary|versus|vs)\b")


def asks_preference(c: Column) -> Column:
    noun = r"(?i)\b(prefer(ence)?s?|interests?|hobb(y|ies)|favou?rites?|passions?|tastes?)\b"
    verb = r"(?i)\b(fond|keen|into|likes?|lov(ing|es?)|enjoy(s|ing)?|prefers?)\b"
    own = r"(?i)\b(myself|mine|my|me|i'm|im|i)\b"
    return c.rlike(noun) | (c.rlike(verb) & c.rlike(own))


def intent(c: Column) -> Column:
    """struct<subject, predicate> of simple questions (who or what, do, somebody, verb), else null."""
    found = r"\b(?:who|what)\b\s+(?:do|does|did)\s+([a-z]+)\s+([a-z]+)"
    who = F.regexp_extract(F.lower(c), found, 1)
    return F.when(who != "", F.struct(F.when(who.isin("i", "me", "my", "we", "you"), "user").otherwise(who).alias("subject"), F.regexp_extract(F.lower(c), found, 2).alias("predicate")))


def id_like(c: Column) -> Column:
    return c.rlike("(?i)^([0-9a-f]{8,}|[0-9a-f-]{32,}|\\d+)$")


def clean_source(c: Column) -> Column:
    """A readable name of a source: no path, extension, or id-like parts."""
    parts = F.split(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", ""), "[-_ :#]+")
    return F.trim(F.array_join(F.filter(parts, lambda p: ~id_like(p)), " "))
