"""Text helpers, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def congress_of(year: Column) -> Column:
    """The Congress of a year; null before 1789."""
    return F.when(year >= 1789, F.floor((year - 1789) / 2).cast("int") + 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of the chunks of n words, one at least; none without words."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


# Named characters of HTML.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "sect": "§", "para": "¶", "deg": "°", "times": "×", "euro": "€", "pound": "£", "cent": "¢", "laquo": "«", "raquo": "»", "eacute": "é", "egrave": "è", "agrave": "à", "aacute": "á", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "ntilde": "ñ", "ccedil": "ç"}
CUES = r"\$[\d,]+|authorized\s+to\s+be\s+appropriated|appropriat(?:ed|ion)|such\s+sums\s+as\s+may\s+be\s+necessary|(?:not\s+to\s+exceed|up\s+to)\s+\$?|fiscal\s+year\s+20\d\d|shall\s+be\s+available|authorization\s+of\s+appropriations|effective\s+date|shall\s+take\s+effect|(?:applies|shall\s+apply)\s+to|(?:sunset|terminat)|civil\s+penalt|criminal\s+penalt|fine\s+of"
ENACTING = ["Be it enacted", "Resolved,", "RESOLUTION", "A BILL"]
SECTION = r"(?:SEC(?:TION)?\.?\s+\d+|§\s*\d+)[.\s]"
FRESH = r"today|this week|latest|breaking|just now|right now|recent"
NEW_BLOCK = r"(?i)^(?:SECTION\s+\d|SEC\.\s+\d|BE IT\s|AN ACT|A BILL\s|By:|TITLE\s+[IVX\d]|SUBTITLE\s+[A-Z]|CHAPTER\s+\d|SUBCHAPTER\s+[A-Z]|ARTICLE\s+\d|\([0-9a-zA-Z]+\)\s)"


def unescape(text: Column) -> Column:
    """Character references decoded: the named ones above, decimal and hexadecimal ones; others stay."""
    name = lambda part: F.regexp_extract(part, r"^(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);", 1)

    def decoded(part: Column) -> Column:
        code = F.when(name(part).rlike("^#[xX]"), F.conv(F.substring(name(part), 3, 9), 16, 10)).when(name(part).startswith("#"), F.substring(name(part), 2, 9)).cast("int")
        known = F.coalesce(*[F.when(name(part) == k, v) for k, v in NAMED.items()], F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.when(known.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(known, F.substring(part, F.length(name(part)) + 2, F.length(part))))

    parts = F.split(text, "&")
    whole = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), decoded), ""))
    return F.when(text.contains("&"), whole).otherwise(text)


def strip_html(html: Column) -> Column:
    """Text without scripts, styles and tags, references decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def normalized_term(term: Column) -> Column:
    """A term in lower case without quotes around it, a bracket at its end, an article before it, or end punctuation."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(term, F.lit("")))), "^[\"'`]+|[\"'`]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\([^)]*\)\s*$", ""), r"^the\s+", "")
    return F.trim(F.rtrim(F.regexp_replace(t, r"\s+", " "), F.lit(".,;: ")))


def alnum(text: Column, sign: str = " ") -> Column:
    """Runs of letters and digits in lower case, joined by a sign: words for " ", a slug for "-"."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", sign), F.lit(sign))


def identifier(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def cut_boilerplate(text: Column) -> Column:
    """The text from the first marker of the list that stands in it, but not at its start."""
    cut = [F.when(F.instr(text, m) > 1, F.substring(text, F.instr(text, m), F.length(text))) for m in ENACTING]
    body = F.coalesce(*cut, text)
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), " {2,}", " "))


def bill_text(html: Column, most: int = 60_000) -> Column:
    """The text of a page's <pre> block, else of the page, without the printer's lines at its head."""
    pre = F.regexp_extract(html, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    raw = unescape(F.regexp_replace(F.when(pre != "", pre).otherwise(html), r"(?s)<[^>]*>", F.when(pre != "", "").otherwise("\n")))
    body = F.regexp_replace(raw, r"\A(?:[^\S\n]*(?:\[[^\n]*)?\n)+", "")
    return F.left(F.btrim(F.regexp_replace(F.regexp_replace(body, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t\r")), F.lit(most))


def sections(text: Column, least: int = 50) -> Column:
    """index, number, title, body of the sections of a bill that have some length; the text before the first has no number."""
    parts = F.split(text, rf"(?i)(?={SECTION})")
    numbered = F.transform(parts, lambda s, i: F.struct(i.alias("index"), F.btrim(s, F.lit(" \n\t")).alias("body")))
    head = r"(?i)^(SEC(?:TION)?\.?\s+\d+)[.\s]+([^\n]{0,100})"
    return F.transform(
        F.filter(numbered, lambda s: F.length(s["body"]) >= least),
        lambda s: F.struct(s["index"], F.regexp_extract(s["body"], head, 1).alias("number"), F.trim(F.regexp_extract(s["body"], head, 2)).alias("title"), s["body"]),
    )


def steps(hits: Column, gaps: Column) -> Column:
    """gap and hit for each match of a pattern: the lengths of what stands before it and of itself."""
    both = F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
    return F.filter(both, lambda s: s["hit"].isNotNull())


def starts(steps: Column, which: Column) -> Column:
    """Where the matches of those numbers start, from 0."""
    before = lambda i: F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0), lambda a, s: a + s["gap"] + s["hit"])
    return F.transform(which, lambda i: before(i) + F.get(steps, i)["gap"])


def even_sample(items: Column, k: int) -> Column:
    """k of the items, evenly spread; all where there are no more."""
    n = F.size(items)
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(items, F.floor(i * n / F.lit(k)).cast("int")))
    return F.when(n > k, spread).otherwise(items)


def windows(starts: Column, reach: int, end: Column) -> Column:
    """Spans of that reach on both sides of ascending starts; spans that overlap or touch become one."""
    span = lambda p: F.struct(F.greatest(F.lit(0), p - reach).alias("s"), F.least(end, p + reach).alias("e"))

    def join(spans: Column, one: Column) -> Column:
        last = F.get(spans, F.size(spans) - 1)
        grown = F.array_append(F.slice(spans, F.lit(1), F.size(spans) - 1), F.struct(last["s"].alias("s"), F.greatest(last["e"], one["e"]).alias("e")))
        return F.when((F.size(spans) > 0) & (one["s"] <= last["e"]), grown).otherwise(F.array_append(spans, one))

    return F.aggregate(F.transform(starts, span), F.array().cast("array<struct<s:int,e:int>>"), join)


def within_budget(spans: Column, used: int, budget: int, extra: int = 20) -> Column:
    """The spans before the first that overflows the budget of characters."""
    start = F.struct(F.lit(used).alias("used"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda a, w: F.struct((a["used"] + w["e"] - w["s"] + extra).alias("used"), F.when(a["used"] + w["e"] - w["s"] + extra <= budget, F.array_append(a["out"], w)).otherwise(a["out"]).alias("out"))
    return F.aggregate(spans, start, step)["out"]


def evidence_spans(df: DataFrame, text: str, head: int = 3500, budget: int = 9000, reach: int = 320, cues: str = CUES) -> DataFrame:
    """df with spans: those behind the head of a long text around its cues, an even sample of them, merged, as far as the
    budget goes. Each step is a column of its own, so that none is computed again for every use of it."""
    cut = df.withColumn("__rest", F.substring(text, F.lit(head + 1), F.length(text)))
    cut = cut.withColumn("__steps", steps(F.regexp_extract_all("__rest", F.lit("(?i)" + cues), F.lit(0)), F.split("__rest", "(?i)" + cues))).withColumn("__end", F.length("__rest"))
    numbers = F.when(F.size("__steps") > 0, F.sequence(F.lit(0), F.size("__steps") - 1)).otherwise(F.array().cast("array<int>"))
    cut = cut.withColumn("__which", numbers).withColumn("__which", even_sample(F.col("__which"), max(1, (budget - head) // (2 * reach))))
    cut = cut.withColumn("__starts", starts(F.col("__steps"), F.col("__which")))
    cut = cut.withColumn("spans", windows(F.col("__starts"), reach, F.col("__end"))).withColumn("spans", within_budget(F.col("spans"), head, budget))
    return cut.drop("__rest", "__steps", "__which", "__starts", "__end")


def rejoined(text: Column) -> Column:
    """Lines of a wrapped bill text put together: a label alone in its line takes the next; a line goes on with the next
    unless it ends a sentence or the next begins a block; a blank line stands before each section."""
    lines = F.filter(F.transform(F.split(F.translate(text, "\u00a0\u2009\u202f", "   "), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    bare = r"(?i)^(?:\([0-9a-z]+\)|Sec\.|\d+\.\d[\d.]*\.)$"
    last = lambda a: F.get(a, F.size(a) - 1)
    put = lambda a, x: F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), x)
    nothing = F.array().cast("array<string>")
    # A label with its line is marked by a line end inside, so that it takes one line alone.
    labelled = F.aggregate(lines, nothing, lambda a, x: F.when((F.size(a) > 0) & last(a).rlike(bare), put(a, F.concat(last(a), F.lit("  \r"), x))).otherwise(F.array_append(a, x)))
    labelled = F.transform(labelled, lambda x: F.translate(x, "\r", ""))
    done = lambda x: x.rlike(r"[.;:?!]$|^[A-Z][A-Z0-9\s\-.]+[.:]$")
    joined = F.aggregate(labelled, nothing, lambda a, x: F.when((F.size(a) > 0) & ~done(last(a)) & ~x.rlike(NEW_BLOCK), put(a, F.concat(last(a), F.lit(" "), x))).otherwise(F.array_append(a, x)))
    spaced = F.transform(joined, lambda x, i: F.when((i > 0) & x.rlike(r"(?i)^SECTION\s+\d"), F.concat(F.lit("\n"), x)).otherwise(x))
    return F.array_join(spaced, "\n")


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller set of words that both have; 0 without words."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def tokens(text: Column) -> Column:
    """The distinct runs of three or more letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
