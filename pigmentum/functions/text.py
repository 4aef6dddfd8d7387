"""Text roles, plausibility, and small string formats. Word edges are those of ASCII letters, figures and _."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that make a line a date.
DATE_WORDS = (
    "jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?"
    "|mon(day)?|tue(sday)?|wed(nesday)?|thu(rsday)?|fri(day)?|sat(urday)?|sun(day)?"
)
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: A word edge whichever side the word is on.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def word(pattern: str) -> str:
    """A pattern between ASCII word edges, for Java's expressions."""
    return f"{LEFT}(?:{pattern}){RIGHT}"


def role(text: Column) -> Column:
    """score, date, statistic or name by the line's wording, else null; the first that fits."""
    t = F.trim(text)
    n = F.length(t)
    # fixed values: what a score, a date, a statistic and a name look like, and how long they are
    score = t.rlike(rf"{LEFT}[0-9]{{1,3}}\s*[-–:|]\s*[0-9]{{1,3}}{RIGHT}") & (n <= 24) & ~t.rlike("[0-9]{4}")
    date = t.rlike(f"(?i){word(DATE_WORDS)}") | t.rlike(word(r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}")) | (t.rlike(word("(19|20)[0-9]{2}")) & (n < 24))
    # the unit must end at a word edge or at the end of the line
    statistic = t.rlike(rf"(?i)[0-9]+(\.[0-9]+)?\s*(?:(?:pts|km|kg|x|k|m){RIGHT}|[%+](?:(?=[A-Za-z0-9_])|$))") | (t.rlike(r"^[^0-9]{0,10}[0-9][0-9.,]*[^0-9]{0,12}$") & (n < 16))
    name = t.rlike(r"^[A-Z][\p{Ll}'’.-]+(\s+[A-Z][\p{Ll}'’.-]+){1,2}$") & (n < 28)
    return F.when(score, "score").when(date, "date").when(statistic, "statistic").when(name, "name")


def layout_role(own: Column, size: Column, most: Column) -> Column:
    """The role of a line in its design: the largest is the headline unless it is a score, special roles stay, the rest go by size."""
    return (
        F.when((size >= most) & (F.coalesce(own, F.lit("")) != "score"), "headline").when(own.isNotNull(), own)
        .when(size >= 0.55 * most, "subheadline").when(size < 0.28 * most, "caption").otherwise("body")
    )


def plausible(text: Column, conf: Column, w: Column, h: Column, canvas_h) -> Column:
    """A recognised line that can be text: letters and figures, confidence, size and shape."""
    n = F.length(text)
    good = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    shape = w / F.greatest(F.lit(1), n) / F.greatest(F.lit(1e-6), h)
    return (n >= 2) & (good >= 0.55 * n) & (conf >= 50) & (h >= 6) & (w >= 8) & (h <= 0.3 * canvas_h) & shape.between(0.18, 2.2)


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)


def file_slug(text: Column) -> Column:
    """Name of an export; `poster` if nothing of the text is left."""
    s = F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("poster"))


def title_from_file(name: Column, fallback: str) -> Column:
    """A readable title: no ending, separators as spaces, the first letter of every word raised."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", ""), "[-_]+", " ")
    runs = F.regexp_extract_all(bare, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    raised = F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.coalesce(F.nullif(F.array_join(raised, ""), F.lit("")), F.lit(fallback))


def xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def stamp(seconds: Column, sep: str) -> Column:
    """hh:mm:ss,mmm of a time in seconds, from whole milliseconds."""
    ms = F.floor(seconds * 1000 + F.lit(0.5)).cast("bigint")
    div = lambda n: F.floor(ms / n).cast("bigint")
    return F.concat(two(div(3600000)), F.lit(":"), two(div(60000) % 60), F.lit(":"), two(div(1000) % 60), F.lit(sep), F.lpad((ms % 1000).cast("string"), 3, "0"))


def clock(seconds: Column) -> Column:
    """m:ss.s"""
    m = F.floor(seconds / 60).cast("bigint")
    tenths = F.floor((seconds - m * 60) * 10 + F.lit(0.5)).cast("bigint")
    return F.concat(m.cast("string"), F.lit(":"), F.lpad(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")), 4, "0"))


def ago(seconds: Column) -> Column:
    """How long ago in words, up to a week; null beyond, where a date is shown."""
    part = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{u} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).when(seconds < 604800, part(86400, "d"))


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters, figures and % as one space: what accuracy compares."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}%]+", " "))


def accuracy(a: Column, b: Column) -> Column:
    """Of normalised texts: one minus the edit distance over the longer length, not below 0; 1 when a is empty."""
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(F.length(a) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longer))


def approx_ratio(r: Column) -> Column:
    """The nearest known shape within 0.03, else the ratio itself."""
    best = F.array_min(F.array(*(F.struct(F.abs(F.lit(v) - r).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(RATIOS))))
    hundredths = F.floor(r * 100 + F.lit(0.5)).cast("bigint")
    shown = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), two(hundredths % 100), F.lit(":1"))
    return F.when(best["d"] < 0.03, best["n"]).otherwise(shown)


# The shapes a design can be named after.
RATIOS = [("1:1", 1.0), ("4:5", 0.8), ("3:4", 0.75), ("2:3", 0.667), ("9:16", 0.5625), ("1:1.414 (A-series)", 0.707), ("5:4", 1.25), ("4:3", 1.333), ("3:2", 1.5), ("16:9", 1.778), ("1.91:1", 1.91), ("3:1", 3.0), ("4:1", 4.0)]
