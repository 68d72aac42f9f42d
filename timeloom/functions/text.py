"""Text expressions: normalisation, tokens, captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Trimmed, upper case, white space collapsed."""
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


#: Characters that have several in upper case, stand-ins of a private plane, and the one that each becomes alone (itself if there is none).
SEVERAL = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if len(c.upper()) > 1)
STANDINS = "".join(chr(0x10FF00 + i) for i in range(len(SEVERAL)))
SINGLE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in SEVERAL)


def upper(text: Column) -> Column:
    """Upper case character by character, so that no text grows: ``ß`` becomes ``ẞ`` and not ``SS``."""
    return F.translate(F.upper(F.translate(text, SEVERAL, STANDINS)), STANDINS, SINGLE)


def detokenise(text: Column) -> Column:
    """Plain text of sentence pieces: no end marks or blanks, piece marks become blanks."""
    return F.trim(F.replace(F.replace(F.replace(text, F.lit("<eos>"), F.lit("")), F.lit(" "), F.lit("")), F.lit("▁"), F.lit(" ")))


def ids_to_text(ids: Column, names: Column) -> Column:
    """Names of ids (counted from 0) in a row; ``<space>`` becomes a blank."""
    return F.replace(F.array_join(F.transform(ids, lambda i: F.get(names, i)), ""), F.lit("<space>"), F.lit(" "))


def whole_words(text: Column) -> Column:
    """Upper-case words of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.upper(text), F.lit("[A-Z0-9']+"), F.lit(0))


def word_ids(words: Column, vocabulary: Column, unknown: int) -> Column:
    """Ids by a map column, ``unknown`` for words that it lacks."""
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(vocabulary, w), F.lit(unknown)))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of at least two letters or apostrophes."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)), lambda w: F.length(w) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements, null for two empty sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, broken at blanks as late as possible; a longer word is a line of its own."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    start = F.array().cast("array<string>")

    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(last) + 1 + F.length(word) <= width)
        kept = F.slice(lines, F.lit(1), F.greatest(F.lit(0), F.size(lines) - 1))
        return F.when(fits, F.concat(kept, F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.array_append(lines, word))

    return F.aggregate(words, start, add)


def parent_id(clip: Column) -> Column:
    """A clip id without its last ``_c_`` part."""
    return F.regexp_replace(clip, "_c_[^_]*$", "")


def clip_parts(clip: Column) -> tuple[Column, Column]:
    """Video and two-digit number of a clip id; null for other ids (see :func:`strict_clip_parts`)."""
    ok = F.rlike(clip, F.lit(r"^.+_c_\d{2}$"))
    return F.when(ok, F.regexp_extract(clip, r"^(.+)_c_(\d{2})$", 1)), F.when(ok, F.regexp_extract(clip, r"^(.+)_c_(\d{2})$", 2))


def strict_clip_parts(clip: Column) -> tuple[Column, Column]:
    """As :func:`clip_parts`, but other ids end the job with an error."""
    wrong = F.raise_error(F.concat(F.lit("no clip id: "), F.coalesce(clip, F.lit("null")))).cast("string")
    return tuple(F.coalesce(p, wrong) for p in clip_parts(clip))


def colour(number: Column, palette: list[str], fallback: str) -> Column:
    """A palette's entry, again from the start after its last; ``fallback`` for negative numbers."""
    names = F.array(*(F.lit(p) for p in palette))
    return F.when(number < 0, fallback).otherwise(F.get(names, F.pmod(number, len(palette)).cast("int")))


def in_share(key: Column, ratio: float, seed: int) -> Column:
    """Whether a key falls into a share of all keys, by the first 64 bits of the SHA-256 of ``seed|key``."""
    bound = f"{min(int(ratio * 2**64), 2**64 - 1):016x}"
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256), 1, 16) < bound


def shards(spec: str) -> list[str]:
    """Two-digit shard numbers of ``00-14`` or ``1,2,7``."""
    out: list[str] = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        out += [f"{i:02d}" for i in range(int(low), int(high or low) + 1)]
    return out


def timecode(us: Column, rounded: bool = False) -> Column:
    """``HH:MM:SS,mmm`` of microseconds; milliseconds are cut off, or rounded with carry."""
    ms = F.floor((us + (500 if rounded else 0)) / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def hundredths(us: Column) -> Column:
    """Seconds with two decimals, from whole microseconds so that halves round alike everywhere."""
    c = F.floor((us + 5000) / 10_000)
    return F.format_string("%d.%02d", F.floor(c / 100), c % 100)


def thousandths(us: Column) -> Column:
    m = F.floor((us + 500) / 1000)
    return F.format_string("%d.%03d", F.floor(m / 1000), m % 1000)


def transcript_line(text: Column) -> Column:
    """What follows ``text:`` (in any case) on the first line that starts so."""
    return F.trim(F.regexp_extract(text, r"(?im)^\s*text:(.*)$", 1))
