"""Text functions over columns: chunks, cleaning, descriptors, names."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHUNK_SIZE, CHUNK_OVERLAP = 3072, 1024
#: Characters that mark no place of their own.
ZERO_WIDTH = "​‌‍­﻿"
#: Articles that a sort title carries at its end, by language.
ARTICLES = {"de": ["Der", "Die", "Das", "Ein", "Eine"], "en": ["The", "A", "An"]}


def chunk_step(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> int:
    """How far the next chunk starts behind the one before; 1 at least."""
    return size - min(overlap, size - 1)


def chunk_start(index: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    return F.greatest(index, F.lit(0)) * chunk_step(size, overlap)


def chunk_count(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """0 for an empty text, 1 up to size, then one more for each step begun beyond it."""
    n = F.length(text)
    more = F.ceil((n - size) / F.lit(float(chunk_step(size, overlap)))) + 1
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(more).cast("int")


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """All chunks of a text as an array."""
    n, step = chunk_count(text, size, overlap), chunk_step(size, overlap)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk_at(text: Column, index: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The chunk of an index; empty past the end."""
    return F.substring(text, chunk_start(index, size, overlap) + 1, F.lit(size))


def span_chunk(text: Column, index: Column, count: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The text from the start of one chunk to the end of the count-th from it."""
    length = F.lit(size) + chunk_step(size, overlap) * (count - 1)
    return F.when(count < 1, F.lit("")).otherwise(F.substring(text, chunk_start(index, size, overlap) + 1, length))


def sentence_chunk(text: Column, index: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The chunk widened to whole sentences: back to the last full stop after the start of the chunk
    before, on to the first one within the chunk that follows. Empty past the end of the text."""
    step = chunk_step(size, overlap)
    start = chunk_start(index, size, overlap)
    back = F.when(index > 0, step).otherwise(0)
    ahead = F.when(index < chunk_count(text, size, overlap) - 1, step).otherwise(size)
    window = F.substring(text, start - back + 1, back + ahead + size)
    before = F.substring(window, F.lit(2), back)
    behind = F.instr(F.reverse(before), ".")
    stop = F.length(before) - behind + 1
    rest = F.substring(window, stop + 1, F.length(window))
    skipped = F.length(rest) - F.length(F.regexp_replace(rest, r"^[. ]+", ""))
    begin = F.when(behind > 0, stop + skipped).otherwise(back)
    found = F.position(F.lit("."), window, back + size + 1)
    end = F.when(found > 0, found).otherwise(back + size)
    body = F.substring(window, begin + 1, F.greatest(end - begin, F.lit(0)))
    return F.when(start >= F.length(text), F.lit("")).otherwise(F.regexp_replace(body, r"^\s+|\s+$", ""))


def clean_text(text: Column) -> Column:
    """White space to single spaces, zero-width characters to nothing; the ends stay as they are."""
    return F.regexp_replace(F.regexp_replace(text, f"[{ZERO_WIDTH}]", ""), r"[\n\r\x08\t ]+", " ")


def compressed(text: Column) -> Column:
    """One line: white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\n\r\t ]+", " "))


def descriptor(source: Column, path: Column) -> Column:
    return F.concat(F.lit("{"), source, F.lit("}"), path)


def descriptor_source(value: Column) -> Column:
    return F.regexp_extract(value, r"^\{([^}]*)\}/?(.*)$", 1)


def descriptor_path(value: Column) -> Column:
    return F.regexp_extract(value, r"^\{([^}]*)\}/?(.*)$", 2)


def extension(value: Column) -> Column:
    """What follows the last dot of the last part of a path; empty without one."""
    return F.regexp_extract(value, r"\.([^./]*)$", 1)


def directory(value: Column) -> Column:
    return F.regexp_extract(value, r"^(.*)/[^/]*$", 1)


def shorten(text: Column, length: int, align: str = "middle", ellipsis: str = "⋯") -> Column:
    """Text padded or cut to a length. align: left and middle pad at the end, right at the start; a cut
    keeps the head (left), the tail with the sign behind it (right), or a third of head and the tail (middle)."""
    pad = F.lpad(text, length, " ") if align == "right" else F.rpad(text, length, " ")
    if length == 0:
        cut = F.lit("")
    elif length == 1:
        cut = F.lit(ellipsis)
    elif align == "left":
        cut = F.concat(F.substring(text, 1, length - 1), F.lit(ellipsis))
    elif align == "right":
        cut = F.concat(F.right(text, F.lit(length - 1)), F.lit(ellipsis))
    else:
        cut = F.concat(F.substring(text, 1, length // 3), F.lit(ellipsis), F.right(text, F.lit(length - length // 3 - 1)))
    return F.when(F.length(text) <= length, pad).otherwise(cut)


def between_tokens(text: Column, first: Column, last: Column) -> Column:
    """From the first place of one token to the end of the last place of another, both included and
    without case; null if either is missing or they cross."""
    low = F.lower(text)
    start = F.position(F.lower(first), low)
    behind = F.position(F.reverse(F.lower(last)), F.reverse(low))
    end = F.length(text) - behind + 1
    return F.when((start > 0) & (behind > 0) & (end >= start), F.substring(text, start, end - start + 1))


def language_base(tag: Column) -> Column:
    """de of de_DE and de-AT."""
    return F.lower(F.substring_index(F.substring_index(tag, "_", 1), "-", 1))


def safe_title(title: Column) -> Column:
    """Letters, digits, spaces and hyphens, without spaces at the end."""
    return F.rtrim(F.regexp_replace(title, r"[^\p{L}\p{N} \-]", ""))


def clean_filename(name: Column) -> Column:
    """Characters that file systems refuse become commas, and runs of what results are thinned out."""
    out = F.translate(name, '<>:"/\\|?*', "," * 9)
    for old, new in (("__", "_"), (" _ ", ", "), ("_ ", ", "), ("  ", " "), ("  ", " "), (",,", ","), (" ,", " "), ("  ", " "), ("  ", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def without_article(title: Column) -> Column:
    """A sort title without ", The" and the like at its end, once for each language in turn."""
    for articles in ARTICLES.values():
        title = F.regexp_replace(title, ", (" + "|".join(map(re.escape, articles)) + ")$", "")
    return title


def rolling_hue(name: Column) -> Column:
    """A hue from 0 to 1 by a rolling hash h = c + (h * 32 as 32 bits) - h over the characters."""
    wrapped = lambda h: F.shiftright(F.shiftleft(h * 32, 32), 32)
    # h stays below 2 ** 53: each step leaves it within 32 bits plus one more h
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: c + wrapped(h) - h)
    return F.abs(total % 360) / 360.0


def string_list(value: Column) -> Column:
    """A list of strings of one string; nothing of null."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def flat_list(values: Column) -> Column:
    """A list of lists as one list; nothing of null."""
    return F.coalesce(F.flatten(values), F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Letters and their marks as single characters (NFC), which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def is_number(word: Column) -> Column:
    """Whether a word has digits alone, or the letters of Roman numerals alone; an empty one counts."""
    bare = F.trim(word)
    return (F.translate(bare, "0123456789", "") == "") | (F.translate(bare, "IVXLCDM", "") == "")


#: A short title is cut between these lengths.
TITLE_LEAST, TITLE_MOST = 30, 70
TSHEG = "\u0f0b"


def cut_title(title: Column) -> Column:
    """A title of more than TITLE_MOST characters, cut: at the first of its signs , . - : ; from TITLE_LEAST on, if
    none of those that it has stands before that only; else at a space, behind a tsheg, or at TITLE_MOST."""
    after = lambda c: F.locate(c, title, TITLE_LEAST + 1) - 1  # noqa: E731  -1: not there
    signs = F.array_min(F.filter(F.array(*[F.when(F.contains(title, F.lit(c)), after(c)) for c in ",.-:;"]), lambda p: p.isNotNull()))
    between = lambda p, low: (p > low) & (p < TITLE_MOST)
    space, tsheg = after(" "), after(TSHEG)
    at = F.when(between(signs, TITLE_LEAST), signs).when(between(space, TITLE_LEAST - 1), space).when(between(tsheg, TITLE_LEAST - 1), tsheg + 1).otherwise(TITLE_MOST)
    return F.when(F.length(title) > TITLE_MOST, F.substring(title, F.lit(1), at)).otherwise(title)


def human_filename(title: Column, title_sort: Column, author: Column, series: Column | None = None) -> Column:
    """Short title, the number that the title ends with, and author, in the folder of a series if one is given.

    The number is the title's first word if that is one, else the last word of the sort title, else the first word
    of the title that is one."""
    words, last = F.split(title, " "), F.element_at(F.split(title_sort, " "), -1)
    first = F.get(words, F.lit(0))
    inner = F.get(F.filter(words, is_number), F.lit(0))
    number = F.coalesce(F.when(is_number(first), first).when(is_number(last), last).otherwise(inner), F.lit(""))
    short = F.trim(cut_title(clean_filename(title_sort)))
    named = F.when((number != "") & ~F.contains(short, number), F.concat_ws(" ", short, number)).otherwise(short)
    name = F.concat(F.trim(named), F.lit(" - "), clean_filename(author))
    return name if series is None else F.concat_ws("/", series, name)
