"""Text functions on columns: windows, trimming, metrics, snippets, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that are trimmed: Java's Unicode white space, and the separators U+001C to U+001F besides.
EDGE_BLANKS = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"

#: What a chapter heading looks like. A line that begins with one of these, a Markdown mark apart.
HEADING = "[ \\t\\u3000]*(?:#{1,6}[ \\t]*)?(?:第[0-9０-９零〇一二三四五六七八九十百千万两]+[章卷节回部篇]|Chapter\\s+[0-9]+|Volume\\s+[0-9]+)[^\\n]*"
HEADING_LIMIT = 40
#: A whole line that is a heading, of at most HEADING_LIMIT characters without the blanks at its ends.
HEADING_LINE = f"(?mdU)^(?=[^\\S\\n]*(?:\\S(?:[^\\n]{{0,{HEADING_LIMIT - 2}}}\\S)?)?[^\\S\\n]*$){HEADING}$"
#: A heading anywhere in a line, as the analysis of names counts chapters.
CHAPTER_MARK = "第[一二三四五六七八九十百千零0-9]+[章回节卷部]"

#: What ends a sentence, and what opens and closes quoted speech.
SENTENCE_ENDS = "[。！？!?；;\\n]+"
QUOTED = "[\"“'『「][^\"”’』」]*[\"”’』」]"
#: Where a text is cut, the best place first.
CUT_AFTER = ("。", "！", "？", "\n\n", "\n", "，", " ")
#: Expressions of time.
TIME = "(?:公元前)?[0-9]+年(?:[0-9]+月(?:[0-9]+日)?)?|公元[0-9]+年|[0-9]+世纪|太古|上古|远古|洪荒|纪元[一-龥]{1,6}|[一-龥]{1,5}年间|上古时期"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_BLANKS, "")


def ascii_strip(c: Column) -> Column:
    """Without what the SQL beside the queries trims: blanks, tabs and line ends at both ends, no other white space."""
    return F.regexp_replace(c, "^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+\\z", "")


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; what is not UTF-8 is left out, and replacement characters with it."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Offsets of windows of `size` that overlap; the last is the first that reaches the end. A bad size is 800, a bad overlap 0."""
    size = size if size > 0 else 800
    step = size - (overlap if 0 <= overlap < size else 0)
    last = (F.ceil(F.greatest(F.lit(0), length - size) / F.lit(step)) * step).cast("int")
    return F.sequence(F.lit(0), last, F.lit(step))


def windows(text: Column, size: int = 800, overlap: int = 0, trim=strip) -> Column:
    """array<struct<start,content>>: windows, trimmed, without those that are empty then."""
    size = size if size > 0 else 800
    cut = F.transform(window_starts(F.length(text), size, overlap), lambda i: F.struct(i.alias("start"), trim(F.substring(text, i + 1, F.lit(size))).alias("content")))
    return F.filter(cut, lambda x: F.length(x["content"]) > 0)


def chapter_windows(text: Column, size: int = 800, trim=strip) -> Column:
    """One chunk, unless the chapter is longer than `size` (0: 1500)."""
    size = size or 1500
    whole = trim(text)
    return F.when(F.length(whole) <= size, F.filter(F.array(F.struct(F.lit(0).alias("start"), whole.alias("content"))), lambda x: F.length(x["content"]) > 0)).otherwise(windows(text, size, 0, trim))


def snippet(text: Column, key: str, width: int = 60) -> Column:
    """A window of `width` around the first hit, case aside; line breaks are blanks, and a cut head is marked."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    at = F.instr(F.lower(flat), key.lower())
    start = F.greatest(F.lit(1), at - width // 2)
    return F.when(at == 0, F.substring(flat, 1, width)).otherwise(F.concat(F.when(start > 1, "…").otherwise(""), F.substring(flat, start, F.lit(width))))


def occurrences(text: Column, needle: Column) -> Column:
    """How often `needle` occurs, without overlaps; 0 for an empty one."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def sentence_lengths(text: Column) -> Column:
    """Characters of each sentence that are not blank; sentences without any do not count."""
    bare = F.transform(F.split(text, SENTENCE_ENDS), lambda s: F.length(F.regexp_replace(s, "(?U)[\\s\\x1c-\\x1f]+", "")))
    return F.filter(bare, lambda n: n > 0)


def variance(values: Column) -> Column:
    """Population variance of an array of numbers, 0 of fewer than two."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def dialogue_density(text: Column) -> Column:
    quoted = F.aggregate(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.coalesce(F.try_divide(quoted.cast("double"), F.length(text)), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def safe_name(name: Column, fallback: str = "untitled") -> Column:
    cleaned = F.regexp_replace(name, "[^\\p{L}\\p{N}_-]", "")
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(fallback)


def clean_title(title: Column, number: Column) -> Column:
    flat = F.substring(strip(F.regexp_replace(F.regexp_replace(title, "\\x00", ""), "[\\r\\n]+", " ")), 1, 200)
    return F.coalesce(F.when(F.length(flat) > 0, flat), F.concat(F.lit("第"), number.cast("string"), F.lit("章")))


def cut_at_sentence(text: Column, limit: int, after: tuple[str, ...] = CUT_AFTER) -> Column:
    """At most `limit` characters; cut behind the last of the first separator in `after` that lies past the half."""
    head = F.substring(text, 1, limit)
    back = lambda mark: F.locate(mark[::-1], F.reverse(head))
    place = lambda mark: F.length(head) - back(mark) - (len(mark) - 1)
    cuts = [F.when((back(m) > 0) & (place(m) > limit * 0.5), F.left(text, place(m) + 1)) for m in after]
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(*cuts, head))


def bigrams(t: Column) -> Column:
    """The set of two-character pieces of a text; of a single character, that itself."""
    n = F.length(t)
    return F.when(n < 2, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two short texts by their sets of two-character pieces; of a single character, that itself."""
    x, y = bigrams(a), bigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def split_chapters(text: Column) -> Column:
    """array<struct<title,content,char_start,char_end>> of the chapters of a text.

    A heading is a line that HEADING_LINE matches; a chapter runs to the next heading
    and goes if nothing is left of it. Text before the first heading belongs to no chapter; without any chapter the
    whole text is one, without a title. Offsets are those of the content in the text, behind its heading. Null has none.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(HEADING_LINE), F.lit(0)).alias("heads"), F.split(text, HEADING_LINE, -1).alias("pieces"))
    title = lambda head: F.substring(strip(F.regexp_replace(head, "^[ \\t\\u3000]*#{1,6}", "")), 1, 200)

    def chapters(p: Column) -> Column:
        sizes = F.zip_with(p["heads"], F.slice(p["pieces"], 2, F.size(p["heads"])), lambda h, t: F.struct(F.length(h).alias("head"), F.length(t).alias("body")))
        start = F.struct(F.length(p["pieces"][0]).alias("at"), F.array().cast("array<int>").alias("begins"))
        begins = F.aggregate(sizes, start, lambda a, x: F.struct((a["at"] + x["head"] + x["body"]).alias("at"), F.concat(a["begins"], F.array(a["at"] + x["head"])).alias("begins")), lambda a: a["begins"])
        one = lambda h, i, at: F.struct(title(h).alias("title"), strip(p["pieces"][i + 1]).alias("content"), at[i].alias("char_start"), (at[i] + F.length(p["pieces"][i + 1])).alias("char_end"))
        return bound(begins, lambda at: F.transform(p["heads"], lambda h, i: one(h, i, at)))

    alone = F.array(F.struct(F.lit(None).cast("string").alias("title"), strip(text).alias("content"), F.lit(0).alias("char_start"), F.length(text).alias("char_end")))
    kept = bound(cut, lambda p: F.filter(chapters(p), lambda c: F.length(c["content"]) > 0))
    return F.when(text.isNotNull(), bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(alone)))


def mark_chapters(text: Column) -> Column:
    """array<struct<title,content>>: a text cut at every CHAPTER_MARK, wherever it stands; text before the first is left out, and without any the whole is one."""
    marks, pieces = F.regexp_extract_all(text, F.lit(CHAPTER_MARK), F.lit(0)), F.split(text, CHAPTER_MARK, -1)
    cut = F.zip_with(marks, F.slice(pieces, 2, F.size(marks)), lambda m, t: F.struct(m.alias("title"), t.alias("content")))
    return F.when(F.size(marks) > 0, cut).otherwise(F.array(F.struct(F.lit("").alias("title"), text.alias("content"))))


def time_expressions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TIME), F.lit(0))
