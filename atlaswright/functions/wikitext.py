"""MediaWiki pages: titles, text sections, clean text, links, categories and redirects as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlaswright.config import DEFAULTS
from atlaswright.functions.text import normal_title

# fixed values (patterns)
TITLE = r"< *title *>(.*?)< */ *title"
TEXT = r"(?s)<text xml.*?>(.*?)</text>"
TEMPLATE = r"(?s)\{\{[^{]*?}}"
TABLE = r"(?s)\{[^{]*?}"
SCRUBBED = [r"(?s)&lt;.*?&gt;", r"(=){1,3}.*\1", r"(&quot;)|(&amp;)|(nbsp;)|(wikt:)"]
LINK = r"\[\[ *(.*?) *]]"
MARKUP = r"\[\[|\{|=|&|nbsp;|wikt:"  # what any of the above needs
CATEGORY = r"\[\[[Cc]ategory *: *(.*?)(\||]])"
REDIRECT = r'<redirect\s+title\s*=\s*"(.*?)"\s*/\s*>'
DROPPED_LINES = r"^\s*(Category:|\||!|\*|#|Image:)"

_INSIDE = r"(?:(?!]])[^\[])*?"  # what may stand inside an innermost link


def page_title(raw: Column) -> Column:
    """The normalised title of a page; null if it has none."""
    return F.nullif(normal_title(F.regexp_extract(raw, TITLE, 1)), F.lit(""))


def page_text(raw: Column) -> Column:
    """The text section; empty if it is missing."""
    return F.regexp_extract(raw, TEXT, 1)


def _links_to_text(text: Column) -> Column:
    """One pass over innermost links: files vanish, two families of labels become one word, others their target."""
    text = F.regexp_replace(text, rf"(?s)\[\[(?={_INSIDE}File:)[^\[]*?]]", "")
    text = F.regexp_replace(text, rf"(?s)\[\[(?={_INSIDE}\|)(?={_INSIDE}(?i:sculpture))(?={_INSIDE}(?i:sculptor))[^\[]*?]]", "sculptor")
    text = F.regexp_replace(text, rf"(?s)\[\[(?={_INSIDE}\|)(?={_INSIDE}(?i:musical theatre))[^\[]*?]]", "musical")
    return F.regexp_replace(text, r"(?s)\[\[((?:(?!]])[^\[|])*)(?:\|[^\[]*?)?]]", "$1")


def without_dropped_lines(text: Column) -> Column:
    """Without lines that begin like list items, table rows, images or categories."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(DROPPED_LINES)), "\n")


def from_bold_title(text: Column, title: Column) -> Column:
    """From the bold title on, if that stands near the beginning; hyphens of the title may be blanks in the text."""
    plain = F.trim(F.replace(F.regexp_replace(title, r"[,(].*$", ""), F.lit("_"), F.lit(" ")))
    at = F.instr(text, F.concat(F.lit("'''"), plain))
    again = F.instr(text, F.concat(F.lit("'''"), F.trim(F.replace(plain, F.lit("-"), F.lit(" ")))))
    at = F.when(at > 0, at).otherwise(again)
    return F.when((at > 0) & (at <= DEFAULTS.clean_title_within), text.substr(at, F.length(text))).otherwise(text)


def clean_text(text: Column, title: Column) -> Column:
    """Running text of a text section: links to their targets, no templates, tables, tags, headings or list lines.

    Null text gives null, an empty one an empty string; a null title only skips the last step. Texts without any markup skip the passes over it.
    """
    bare = text
    for _ in range(3):
        bare = _links_to_text(bare)
    for pattern in [TEMPLATE] * 3 + [TABLE] * 3:
        bare = F.regexp_replace(bare, pattern, "")
    for pattern in SCRUBBED:
        bare = F.regexp_replace(bare, pattern, " ")
    text = without_dropped_lines(F.when(text.rlike(MARKUP), bare).otherwise(text))
    return F.when(title.isNull(), text).otherwise(from_bold_title(text, title))


def without_bold_title(text: Column) -> Column:
    """What follows the bold title, if it begins and ends near the start of the text."""
    start = F.instr(text, F.lit("'''"))
    rest = text.substr(start + 3, F.length(text))
    end = F.instr(rest, F.lit("'''"))
    opened = (start > 0) & (start <= DEFAULTS.bold_title_within + 1)
    closed = (end > 0) & (end <= DEFAULTS.longest_title + 1)
    return F.when(opened & closed, rest.substr(end + 3, F.length(rest))).when(opened, rest).otherwise(text)


def links(text: Column) -> Column:
    """Contents of all links without a colon: arrays of target and labels."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(LINK), 1), lambda x: ~F.contains(x, F.lit(":")) & (F.length(x) > 0)), lambda x: F.split(x, r"\|"))


def page_categories(raw: Column) -> Column:
    """Categories as found on the page: blanks as ``_``, cut at ``#``; in order, repeats kept."""
    return F.transform(F.regexp_extract_all(raw, F.lit(CATEGORY), 1), lambda c: F.replace(F.trim(F.regexp_replace(c, "(?s)#.*$", "")), F.lit(" "), F.lit("_")))


def redirect_target(raw: Column) -> Column:
    """The target a redirect page names, as written; null for other pages."""
    return F.nullif(F.regexp_extract(raw, REDIRECT, 1), F.lit(""))


def first_word_index(text: Column, name: Column) -> Column:
    """Words before the first mention of a name that does not follow `` new ``; -1 if there is none."""
    before = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?s)^(.*?)(?<! new )\Q"), name, F.lit(r"\E")), F.lit(1))
    found = F.regexp_instr(text, F.concat(F.lit(r"(?<! new )\Q"), name, F.lit(r"\E"))) > 0
    return F.when(found, F.size(F.split(F.trim(before), r"\s"))).otherwise(-1)
