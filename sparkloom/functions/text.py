"""Column functions for text: normalisation, hashes, tokens, spans and links."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folds() -> tuple[str, str]:
    """Small Latin letters with marks and the letters under the marks, by the decompositions of Unicode."""
    marked, plain = [], []
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(m) for m in parts[1:]):
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


ACCENTED, FOLDED = _folds()
TOKEN = r"[\p{L}\p{N}_]+"
#: Tokens of the search index, which keeps dashes and dots.
INDEX_TOKEN = r"[\p{L}\p{N}_.\-]+"


def normalize(text: Column) -> Column:
    """Line breaks as \\n, %%comments%% removed, blanks collapsed, lines and text stripped, two line breaks at most in a row."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)%%.*?%%", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    """The identity of a span within its source."""
    return F.substring(F.sha2(text, 256), 1, 16)


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, n)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), 1)


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"({INDEX_TOKEN})"), 1)


def title_of_filename(name: Column) -> Column:
    """Separators to spaces, words capitalised, short words in capitals kept."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[-_\s]+", " ")), " ")
    one = lambda w: F.when(w.rlike("^[A-Z0-9]{1,4}$"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.array_join(F.transform(words, one), " ")


def image_links(text: Column) -> Column:
    """Targets of ![[x]] and then of ![a](x), each once, in order."""
    wiki = F.regexp_extract_all(text, F.lit(r"!\[\[([^\]|#]+?\.(?:png|jpe?g|gif|webp|svg))(?:\|[^\]]*)?\]\]"), 1)
    return F.array_distinct(F.concat(wiki, F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), 1)))


def wikilinks(text: Column) -> Column:
    """Targets of [[x]], [[x#h]] and [[x|alias]], each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), 1), lambda x: F.trim(x)))


def plain_links(text: Column) -> Column:
    """Links to headings of the same page as their alias or heading."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[#[^\]|]+\|([^\]]+)\]\]", "$1"), r"\[\[#([^\]|]+)\]\]", "$1")


def lost_picture(text: Column) -> Column:
    """Width and height of a picture that the parser says it left out, or null."""
    found = F.regexp_extract(text, r"(?i)picture(?: \[(\d+) ?x ?(\d+)\])? intentionally omitted", 0)
    width, height = (F.regexp_extract(text, r"(?i)picture(?: \[(\d+) ?x ?(\d+)\])? intentionally omitted", k) for k in (1, 2))
    return F.when(found != "", F.struct(F.expr("'picture'").alias("kind"), F.when(width != "", width.cast("int")).alias("width"), F.when(height != "", height.cast("int")).alias("height")))


def chunk_tokens(text: Column) -> Column:
    """The estimate that chunks are sized by."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def budget_tokens(text: Column) -> Column:
    """The estimate that budgets are spent by."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4), F.ceil(F.octet_length(text) / 3)).cast("long")


def ascii_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.greatest(F.length(text), F.lit(1))


#: Scripts in the order in which they are tried, and their language.
SCRIPTS = [
    ("Korean", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"),
    ("Japanese", r"[\x{3040}-\x{30FF}]"),
    ("Chinese", r"[\x{4E00}-\x{9FFF}]"),
    ("Russian", r"[\x{0400}-\x{04FF}]"),
    ("Greek", r"[\x{0370}-\x{03FF}]"),
    ("Arabic", r"[\x{0600}-\x{06FF}]"),
    ("Hebrew", r"[\x{0590}-\x{05FF}]"),
    ("Hindi", r"[\x{0900}-\x{097F}]"),
    ("Thai", r"[\x{0E00}-\x{0E7F}]"),
]


def script_language(text: Column) -> Column:
    out = F.lit("English")
    for name, pattern in reversed(SCRIPTS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def strip_html(html: Column) -> Column:
    """Visible text: junk elements and comments gone, headings as # marks, blocks on lines of their own."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "footer", "aside", "form", "noscript", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}[ >].*?</{tag}>", "")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|h[1-6]|article|section|ul|ol|table|tr)>|<(br|p|li|div)[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n"), r"^[ \n]+|[ \n]+$", "")


def text_quality(text: Column) -> Column:
    """How well a text came out of its file, from 0 to 1: a sum of capped shares less penalties."""
    n = F.length(text)
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'\-]*)"), 1)
    n_words = F.size(words)
    mean = F.when(n_words > 0, F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)) / n_words).otherwise(0.0)
    share = lambda pattern, empty: F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(empty)
    lines = F.size(F.filter(F.split(text, r"\n+"), lambda x: F.trim(x) != ""))
    broken, blank = share(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]", 1.0), share(r"\s", 1.0)
    capped = lambda most, value: F.least(F.lit(most), value)
    score = capped(0.25, F.length(F.regexp_replace(text, r"\s", "")) / 1200) + capped(0.3, n_words / 240) + capped(0.15, lines / 30)
    score += capped(0.2, share(r"[\p{L}\p{N}]", 0.0) * 0.25) + capped(0.1, mean / 60) - capped(0.35, broken * 3)
    score -= F.when(blank > 0.45, capped(0.2, (blank - 0.45) * 0.8)).otherwise(0.0) + F.when((n_words > 0) & (mean < 2.2), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
