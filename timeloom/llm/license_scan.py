"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are windows of the text's words, each beginning half a block after the one before it, so that each run of
words half as long lies whole in one of them.  Each template is looked for in blocks two to four times
as long as itself.  A block meets a template when it holds at least the threshold's
share of the template's distinct words, and all of those that tell the template from others: without its name a short notice is
but common words.  Words are put in the order of their frequency
over all texts, rare ones first, and only these candidates are verified:

* length: a block with fewer of the templates' words than the overlap cannot meet one;
* prefix: two word sets with that overlap share a word among the first of each;
* position: where they share one, enough words must come after it in both.

Words of no template cannot add to an overlap, so blocks are cut down to the templates'
words before that, and blocks without any template's prefix word are never made.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: What parts words: ASCII other than digits and lower-case letters (a fixed value).
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Notices by which texts state a license; a block holds one if most of its words are there.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under creative commons attribution noncommercial cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
)
THRESHOLD = 0.8
#: Words that a block must hold if its template has them.
TELLING = ("mit", "apache", "gnu", "commons", "nc", "redistribution", "hereby", "2", "3")
#: Words of the smallest block.
BLOCK = 16


def words_of(text: str) -> list[str]:
    """The words of a template or phrase."""
    return [w for w in re.split(PARTS, text.translate({c: c + 32 for c in range(65, 91)})) if w]


def width_of(words: int) -> int:
    """Words of the blocks for a template of ``words`` words: ``BLOCK``, doubled until that is twice as long."""
    width = BLOCK
    while width < 2 * words:
        width *= 2
    return width


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: Column) -> Column:
    """The words, each between single blanks; one blank if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), PARTS, " ")), F.lit(" "))


def blanks(padded: Column) -> Column:
    return F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))


def word_count(padded: Column) -> Column:
    return F.when(F.length(padded) <= 2, 0).otherwise(blanks(padded) - 1).cast("bigint")


def found(padded: Column, phrase: str, reverse: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a phrase occurs; its places (all, also where they overlap); its first and last start."""
    p = f" {phrase} "
    has = F.contains(padded, F.lit(p))
    count = F.when(has, F.regexp_count(padded, F.lit(f"(?={p})"))).otherwise(0)
    first = blanks(F.left(padded, F.instr(padded, p))) - 1
    last = blanks(F.left(padded, F.length(padded) - F.instr(reverse, p[::-1]) - (len(p) - 2))) - 1
    return has, count, F.when(has, first), F.when(has, last)


def joined(labels: list[Column]) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))))


class Templates:
    """Templates with their words in the order of their frequency over a corpus."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[str, int], threshold: float, telling: Sequence[str]) -> None:
        self.labels = [label for label, _ in templates]
        self.needs = [sorted(set(words_of(t)) & set(telling)) for _, t in templates]
        self.words = [sorted(set(words_of(t)), key=lambda w: (frequency.get(w, 0), w)) for _, t in templates]
        #: Words that a block must share, from the share in integers of a millionth.
        self.overlap = [-(-len(w) * round(threshold * 10**6) // 10**6) for w in self.words]
        every = {w for ws in self.words for w in ws}
        self.order = sorted(every, key=lambda w: (frequency.get(w, 0), w))
        self.prefix = [ws[: len(ws) - a + 1] for ws, a in zip(self.words, self.overlap, strict=True)]

    def prefix_words(self) -> list[str]:
        return sorted({w for ws in self.prefix for w in ws})


def strings(words: Sequence[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def frequencies(padded: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates occurs in all texts; as many rows as the templates have words."""
    words = padded.select(F.explode(F.split("padded", " ")).alias("w")).where(F.col("w").isin(vocabulary))
    return {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}


def blocks_of(padded: Column, known: Templates, width: int) -> Column:
    """(width, block number, template words in frequency order) of the blocks that hold some template's prefix word."""
    words = F.filter(F.split(padded, " "), lambda w: w != "")
    probes, stride = known.prefix_words(), width // 2
    hit = F.rlike(padded, F.lit(f" (?:{'|'.join(probes)}) ")) if probes else F.lit(False)
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(probes), i)), lambda i: i.isNotNull())
    near = F.flatten(F.transform(places, lambda i: F.array(F.floor(i / stride).cast("int"), F.floor(i / stride).cast("int") - 1)))
    numbers = F.filter(F.array_distinct(near), lambda b: b >= 0)
    held = lambda b: F.array_intersect(strings(known.order), F.slice(words, b * stride + 1, width))
    block = lambda b: F.struct(F.lit(width).alias("width"), b.alias("block"), held(b).alias("words"))
    none = F.array().cast("array<struct<width:int,block:int,words:array<string>>>")
    return F.when(hit, F.transform(numbers, block)).otherwise(none)


def matches(blocks: DataFrame, known: Templates) -> DataFrame:
    """``uid, label, containment`` of every block and template that meet; blocks: uid, block, words."""
    spark = blocks.sparkSession
    rows = [(w, t, i, len(known.words[t]), known.overlap[t], known.labels[t], known.words[t], known.needs[t]) for t, ws in enumerate(known.prefix) for i, w in enumerate(ws)]
    index = spark.createDataFrame(rows, "word string, template int, place int, size int, overlap int, label string, template_words array<string>, needs array<string>")
    least = min(known.overlap, default=1)
    long_enough = blocks.where(F.size("words") >= least)
    # the longest prefix that any template asks for; each template's own is checked after the join
    prefix = long_enough.select("uid", "block", "words", F.posexplode(F.slice("words", F.lit(1), F.size("words") - least + 1)).alias("at", "word"))
    met = prefix.join(F.broadcast(index), "word")  # as long as the template list, a parameter
    size = F.size("words")
    met = met.where((size >= F.col("overlap")) & (F.col("at") <= size - F.col("overlap")))
    met = met.where(1 + F.least(size - F.col("at") - 1, F.col("size") - F.col("place") - 1) >= F.col("overlap"))
    shared = F.size(F.array_intersect("words", "template_words"))
    named = met.where(F.size(F.array_except("needs", "words")) == 0)
    verified = named.select("uid", "label", "overlap", "size", shared.alias("shared")).where("shared >= overlap")
    return verified.select("uid", "label", (F.col("shared") / F.col("size")).alias("containment"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, telling: Sequence[str] = TELLING) -> DataFrame:
    """Licenses that each text states, by phrases and by template containment.

    Columns ``key``, ``n_words``, ``n_base`` (places of the phrases), ``first_word`` and ``last_word`` (the
    smallest and largest start of one, else null), ``base_labels``, ``labels`` (with the templates'; both
    distinct, sorted, joined by commas, empty without any) and ``score``: 1 where a phrase stands, else the largest
    containment of a template that a block meets, else 0.  A block meets a template only with all words of ``telling`` that the template has.  A null text counts as empty;
    rows that repeat a key stay separate; other columns are ignored.  Texts of any length are scanned whole.  A template that several
    blocks or copies meet counts once; without ``templates`` only phrases count.  An empty table gives no rows.
    """
    padded = df.select(df[key].alias("key"), spaced(df[text]).alias("padded"))
    frequency = frequencies(padded, sorted({w for _, t in templates for w in words_of(t)}))
    widths = sorted({width_of(len(words_of(t))) for _, t in templates}) or [BLOCK]
    known = {x: Templates([(label, t) for label, t in templates if width_of(len(words_of(t))) == x], frequency, threshold, telling) for x in widths}
    phrases = [(label, *found(F.col("padded"), phrase, F.col("backwards"))) for label, phrase in PHRASES]
    rows = padded.withColumn("backwards", F.reverse("padded"))
    base = materialise(
        rows.select(
            F.monotonically_increasing_id().alias("uid"),
            "key",
            word_count(F.col("padded")).alias("n_words"),
            sum((n for _, _, n, _, _ in phrases), F.lit(0)).cast("bigint").alias("n_base"),
            F.least(*(a for *_, a, _ in phrases)).cast("bigint").alias("first_word"),
            F.greatest(*(b for *_, b in phrases)).cast("bigint").alias("last_word"),
            joined([F.when(has, label) for label, has, *_ in phrases]).alias("base_labels"),
            F.flatten(F.array(*(blocks_of(F.col("padded"), t, x) for x, t in known.items()))).alias("blocks"),
        ),
        "licenses",
    )
    blocks = base.where(F.size("blocks") > 0).select("uid", F.explode("blocks").alias("b")).select("uid", "b.width", "b.block", "b.words")
    met = reduce(DataFrame.unionByName, (matches(blocks.where(F.col("width") == x), t) for x, t in known.items()))  # a branch a width
    more = met.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))  # at most all labels
    base_set = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_sort(F.array_union(base_set, F.coalesce("more", F.array().cast("array<string>"))))
    out = base.join(more, "uid", "left")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", F.concat_ws(",", labels).alias("labels"), score.alias("score"))
