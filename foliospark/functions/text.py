"""Text rules as Column builders. Regexes use explicit classes, so that Java, RE2 and Python agree on them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, inside a class and as one: what Python's str methods and \\s take for it. Digits are those of any script.
SPACE = r"\t-\r\x1C-\x20\x85\p{Z}"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WS, WORD, DIGIT = f"[{SPACE}]", f"[^{SPACE}]+", r"\p{Nd}"
# Line patterns.
PAGE_MARKER = rf"(?i)^{WS}*(?:page{WS}+{DIGIT}+|{DIGIT}+/{DIGIT}+|{DIGIT}+){WS}*$"
CHAPTER = rf"(?i)^{WS}*chapter{WS}+[ivxlcdm0-9]+(?:[^\p{{L}}\p{{N}}_]|$)"
PART = rf"(?i)^{WS}*part{WS}+[\p{{L}}\p{{N}}_]+"
SCENE_BREAK = rf"^{WS}*(?:\*{WS}*\*{WS}*\*|-{WS}*-{WS}*-|•{WS}*•{WS}*•){WS}*$"
TOC_LEADER = rf"\.{{3,}}{WS}*{DIGIT}+{WS}*$"
TOC_CHAPTER = rf"(?:^|[^\p{{L}}\p{{N}}_]){DIGIT}+{WS}*$"
#: The zeros of all scripts' decimal digits.
ZEROS = [c for c in range(0x11000) if unicodedata.decimal(chr(c), None) == 0]
# Lines that look like front matter.
FRONT_MATTER = ("contents", "table of contents", "preface", "introduction", "copyright", "title page")
# Token rates that a model runtime prints.
TPS = (r"(?i)([0-9]+(?:\.[0-9]+)?)[ \t]*(?:tok/s|tokens/s|tps)", r"(?i)eval rate:[ \t]*([0-9]+(?:\.[0-9]+)?)")


def let(value: Column, body) -> Column:
    """body(value) where the value is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends. Most texts have no runs, and looking for one is cheaper than writing a text anew."""
    return F.trim(F.when(c.rlike(rf"{WS}{{2}}|[{SPACE}&&[^ ]]"), F.regexp_replace(c, rf"{WS}+", " ")).otherwise(c))


def slug(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"[\s-]+", "_"), "_+", "_"), "^_+|_+$", "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def plain_punctuation(c: Column) -> Column:
    """Curly quotes, en dashes and no-break spaces in their plain form; em dashes stay."""
    for plain, signs in (("'", "\u2018\u2019"), ('"', "\u201c\u201d"), ("-", "\u2013"), (" ", "\u00a0")):
        for sign in signs:
            c = F.replace(c, F.lit(sign), F.lit(plain))
    return c


def plain_breaks(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def rejoin_hyphens(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("-\n")), F.regexp_replace(c, "([A-Za-z])-\n([a-z])", "$1$2")).otherwise(c)


def is_heading(line: Column) -> Column:
    """A chapter or part line, or up to 90 characters in capitals with a Latin capital among them."""
    return let(strip(line), stripped_heading)


def stripped_heading(s: Column) -> Column:
    """is_heading() of a line without white space at its ends. What is cheap and seldom true comes first."""
    capitals = (F.length(s) <= 90) & (s == F.upper(s)) & s.rlike("[A-Z]")
    return (s != "") & (capitals | s.rlike(CHAPTER) | s.rlike(PART))


def is_toc_like(c: Column) -> Column:
    return c.rlike(TOC_LEADER) | (c.rlike(CHAPTER) & c.rlike(TOC_CHAPTER))


def is_front_matter(c: Column) -> Column:
    return F.lower(strip(c)).isin(*FRONT_MATTER)


def truncate(c: Column, n: int) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))


def chunk_index(name: Column) -> Column:
    """Trailing digits plus one; null without any."""
    return F.nullif(F.regexp_extract(name, "([0-9]+)$", 1), F.lit("")).cast("bigint") + 1


def tokens_per_second(c: Column) -> Column:
    return F.coalesce(*[F.element_at(F.filter(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: x != ""), -1) for p in TPS]).try_cast("double")


def padded(n: Column, width: int) -> Column:
    """A number with leading zeros, longer ones as they are."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def natural_key(c: Column) -> Column:
    """array<struct<n, s>>: text parts in lower case (n -1) and digit runs of any length by their value (its length and digits), so that arrays compare in natural order."""
    ascii_digits = "".join(chr(z + d) for z in ZEROS for d in range(10)), "0123456789" * len(ZEROS)
    own = F.when(c.rlike(rf"[{DIGIT}&&[^0-9]]"), F.translate(c, *ascii_digits)).otherwise(c)
    parts = F.split(F.regexp_replace(own, "([0-9]+)", "\u0001$1\u0001"), "\u0001")
    number = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda v: F.struct(F.length(v).alias("n"), v.alias("s")))
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), number(p)).otherwise(F.struct(F.lit(-1).alias("n"), F.lower(p).alias("s"))))


def source_format(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def strip_tags(html: Column) -> Column:
    """Visible text of a page: comments, scripts and styles go, tags separate, five entities are decoded."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>", "\n")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return collapse(bare)


def idle_timeout(base: Column, backoff: float, failures: Column, most: float) -> Column:
    """min(most, max(1, base * backoff ** failures)), rounded half to even."""
    return F.least(F.lit(most), F.greatest(F.lit(1.0), F.rint(base * F.pow(F.lit(backoff), failures)))).cast("bigint")


def rounded(c: Column, places: int) -> Column:
    """A double rounded by its exact value, a tie to the even digit: 2.675, which lies below, gives 2.67 and 0.125 gives 0.12."""
    scale = 10.0**places

    def scaled(x):
        # The product with the scale is p + rest exactly: the value is split, so that its high half's product has no error.
        high = 134217729.0 * x["v"] - (134217729.0 * x["v"] - x["v"])
        rest = (high * scale - x["p"]) + (x["v"] - high) * scale
        low = x["p"] - F.pmod(x["p"], F.lit(1.0))
        return let(F.struct(low.alias("low"), ((x["p"] - low) - 0.5 + rest).alias("over")), chosen)

    def chosen(y):
        up = (y["over"] > 0) | ((y["over"] == 0) & (F.pmod(y["low"], F.lit(2.0)) == 1))
        return (y["low"] + F.when(up, 1.0).otherwise(0.0)) / scale

    return let(F.struct(c.alias("v"), (c * scale).alias("p")), scaled)


def file_name(name: Column, stem: str = "manuscript", ending: str = ".pdf") -> Column:
    """A safe name for an upload: the slug of its last part's stem, and the part's ending as it is; both have a default."""
    last = F.regexp_extract(name, "([^/]*)/*$", 1)
    own = F.regexp_extract(last, r"[^.].*?(\.[^.]+)$", 1)
    return F.concat(_or(slug(F.left(last, F.length(last) - F.length(own))), stem), _or(own, ending))


def archive_name(title: Column, book: Column, ending: str = "_archive.zip") -> Column:
    return F.concat(F.coalesce(F.nullif(slug(title), F.lit("")), book), F.lit(ending))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def seconds(c: Column) -> Column:
    """Seconds as shown: one decimal and the unit, a hyphen for none. What rounds up to zero keeps its sign, as -0.04, and so does a negative zero."""
    negative = F.startswith(c.cast("double").cast("string"), F.lit("-"))
    shown = let(rounded(c, 1), lambda r: F.concat(F.when(negative & (r == 0), "-0.0").otherwise(F.format_string("%.1f", r)), F.lit("s")))
    return F.when(c.isNull(), "-").otherwise(shown)


def age(ts: Column, now: Column) -> Column:
    """The time since ts as shown, never negative."""
    return seconds(F.greatest(F.lit(0.0), F.unix_micros(now.cast("timestamp")).cast("double") / 1e6 - F.unix_micros(ts.cast("timestamp")).cast("double") / 1e6))


def byte_size(c: Column) -> Column:
    n = c.cast("double")
    # Java's format would round a tie up, as 961.25 KB.
    shown = lambda per, unit: F.concat(F.format_string("%.1f", rounded(n / per, 1)), F.lit(unit))
    return F.when(n.isNull() | (n < 0), "n/a").when(n < 1024, F.concat(c.cast("bigint").cast("string"), F.lit(" B"))).when(n < 1024**2, shown(1024, " KB")).otherwise(shown(1024**2, " MB"))
