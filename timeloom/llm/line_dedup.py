"""Line dedup within an edit distance of one, by deletion neighbourhoods.

Two lines are within one edit if they agree after at most one character is
deleted from each, at the same place where they are equally long.  So each
line emits the hashes of itself with one character deleted, equal hashes
meet, the earliest line of those that meet wins, and the edit distance of
the two is verified on the lines themselves.

A line has as many variants as characters, too many to emit for every line of a
corpus.  Halves are deleted first: an edit lies in one half of the longer line, and
the other half of both lines agrees.  Of the lines whose half meets another line's, that
half is deleted in pieces, and only lines whose rest meets again go on, with the
variants inside that piece; nothing is lost by this.

Every distinct line has one place, its earliest.  A document keeps the lines whose place is its
own and that no earlier line is near to.  So copies of a line fold by partial aggregation, and no join
gathers them.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Pieces of a half line, and rows of two numbers that may be broadcast.
PIECES, BROADCAST_ROWS = 8, 1_000_000
#: Where keys and line numbers do not fit a long, a place is (key + 2**63) * 2**31 + line number: all fit a decimal, whose minimum needs no sort.
LINES, OFFSET = 1 << 31, Decimal(1 << 63)
BLANKS = " \t\x0b\x0c\r"
BOTH, SHORTER, LONGER = 0, 1, 2


def split_lines(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def blank(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) == ""  # trimming both ends would walk through the whole line


class Places(NamedTuple):
    """Key and line number as one number in their order: a long of ``bits`` for the line number and the key from ``low`` on, or a decimal."""

    low: int
    bits: int | None

    @classmethod
    def fitting(cls, low: int, high: int, lines: int) -> Places:
        """For keys from ``low`` to ``high`` and line numbers to ``lines``."""
        bits = lines.bit_length()
        return cls(low, bits if (high - low).bit_length() + bits <= 63 else None)

    def at(self, doc: Column, number: Column) -> Column:
        if self.bits is None:
            return ((doc.cast("decimal(20,0)") + F.lit(OFFSET)) * F.lit(Decimal(LINES)) + number.cast("decimal(10,0)")).cast("decimal(38,0)")
        return F.shiftleft(doc - F.lit(self.low).cast("bigint"), self.bits) + number

    def parts(self, at: Column) -> tuple[Column, Column]:
        """Key and line number of a place."""
        if self.bits is None:
            number = at % F.lit(Decimal(LINES))
            return (((at - number) / F.lit(Decimal(LINES))).cast("decimal(38,0)") - F.lit(OFFSET)).cast("bigint"), number.cast("int")
        return F.shiftright(at, self.bits) + F.lit(self.low).cast("bigint"), at.bitwiseAND((1 << self.bits) - 1).cast("int")


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc, i, line`` of each line that is not blank."""
    rows = docs.select("doc", F.posexplode(split_lines(F.col("text"))).alias("i", "line"))
    return rows.where(~blank(F.col("line"))).select("doc", "i", "line")


def earliest(docs: DataFrame, places: Places) -> DataFrame:
    """``at`` of each distinct line; lines are told apart by 128 bits of SHA-256."""
    rows = lines_of(docs).select(F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("key"), places.at(F.col("doc"), F.col("i")).alias("at"))
    return rows.groupBy("key").agg(F.min("at").alias("at")).select("at")


def head(n: Column | int) -> Column:
    return F.substring("line", F.lit(1), n)


def tail(n: Column | int) -> Column:
    """The last ``n`` characters of ``line``, which has ``n`` in a column of that name."""
    return F.substring("line", F.col("n") - n + 1, n)


def gate_rows(docs: DataFrame, shortest: int) -> DataFrame:
    """``h, kind, gate``: the halves that a line may share with a line one edit away, by number (see ``regions``).

    Where the longer of two lines has L characters, they share the first L // 2 or the last L - L // 2; a line of n characters is compared under L = n
    and L = n + 1, whose four halves are three.
    """
    lines = lines_of(docs).select("line", F.length("line").alias("n")).where(F.col("n") >= shortest)
    half = F.shiftright("n", 1)
    start, end = (lambda n: F.xxhash64(head(n), F.lit(0))), (lambda n: F.xxhash64(tail(n), F.lit(1)))
    gates = F.array(start(half), end(half + 1), F.when(F.col("n") % 2 == 0, end(half)).otherwise(start(half + 1)))
    rows = lines.select(F.xxhash64("line", "n").alias("h"), gates.alias("gates"))
    return rows.select("h", F.posexplode("gates").alias("kind", "gate"))


def regions() -> Column:
    """Longer line's length and the half where the edit lies, ``lo`` to ``hi`` of the longer line, for the gates of ``open``, bits by kind, of a line of ``n`` characters."""
    n, even, met = F.col("n"), F.col("n") % 2 == 0, lambda kind: F.col("open").bitwiseAND(1 << kind) > 0
    first = lambda longer: F.struct(longer.alias("longer"), F.lit(0).alias("lo"), F.shiftright(longer, 1).alias("hi"))
    second = lambda longer: F.struct(longer.alias("longer"), F.shiftright(longer, 1).alias("lo"), longer.alias("hi"))
    return F.array(
        F.when(met(0), second(n)), F.when(met(1), first(n + 1)), F.when(F.when(even, met(2)).otherwise(met(1)), first(n)), F.when(F.when(even, met(0)).otherwise(met(2)), second(n + 1))
    )


def broadcast_if_few(side: DataFrame) -> DataFrame:
    """``side``, a written table of one or two numbers a row, with a hint where it is small."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def met_lines(docs: DataFrame, shortest: int, places: Places) -> DataFrame:
    """``at, line, open`` of the lines with a half that meets another line's, and which halves do."""
    rows = gate_rows(docs, shortest)
    open_gates = rows.groupBy("gate").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("gate")
    open_gates = materialise(open_gates, "gates")
    met = rows.join(broadcast_if_few(open_gates), "gate").groupBy("h").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("open"))
    met = materialise(met, "met")
    texts = lines_of(docs).select(F.xxhash64("line", F.length("line")).alias("h"), places.at(F.col("doc"), F.col("i")).alias("at"), "line")
    found = texts.join(broadcast_if_few(met), "h").groupBy("line", "open").agg(F.min("at").alias("at"))  # copies fold before the exchange
    return materialise(found.select("at", "line", "open"), "lines")


def met_pieces(lines: DataFrame) -> DataFrame:
    """``at, line, n, longer, lo, hi``: pieces of the met halves without which a line meets another, as places in the longer line."""
    rows = lines.withColumn("n", F.length("line")).select("at", "line", "n", F.explode(regions()).alias("r")).where("r is not null").select("at", "line", "n", "r.*")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    bound = lambda k: (F.col("lo") + F.floor((F.col("hi") - F.col("lo")).cast("bigint") * k / PIECES)).cast("int")
    rows = rows.select("at", "line", "n", "longer", bound(F.col("piece")).alias("lo"), bound(F.col("piece") + 1).alias("hi")).where("lo < hi")
    keyed = rows.select("at", "longer", "lo", "hi", F.xxhash64(head(F.col("lo")), tail(F.col("longer") - F.col("hi")), "longer", "lo").alias("rest"))
    rests = keyed.groupBy("rest").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("rest")
    met = keyed.join(broadcast_if_few(materialise(rests, "rests")), "rest").select("at", "longer", "lo", "hi")
    return materialise(met.join(lines.select("at", "line", F.length("line").alias("n")), "at"), "pieces")


def variant_rows(pieces: DataFrame) -> DataFrame:
    """``k1, k2, role, at``: 128 bits of each deletion variant inside the pieces where lines met.

    Equally long lines meet with the place of the deleted character, others without: there the shorter line is its
    own variant.
    """
    keyed = lambda line, where, role: (F.xxhash64(line, where).alias("k1"), F.xxhash64(where, F.lit("variant"), line).alias("k2"), F.lit(role).alias("role"), "at")
    own = pieces.where("n = longer").select("at", "line", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("p"))
    cut = F.concat(F.substring("line", F.lit(1), F.col("p")), F.substring("line", F.col("p") + 2, F.length("line")))
    own = own.select("at", cut.alias("cut"), "p")
    no = F.lit(-1)
    same, longer = own.select(*keyed(F.col("cut"), F.col("p"), BOTH)), own.select(*keyed(F.col("cut"), no, LONGER))
    shorter = pieces.where("n < longer").select("at", "line").distinct().select(*keyed(F.col("line"), no, SHORTER))
    return same.unionByName(longer).unionByName(shorter)


def near_losers(docs: DataFrame, shortest: int, places: Places) -> DataFrame:
    """``at`` of the lines to which an earlier line is near."""
    lines = met_lines(docs, shortest, places)
    found = variant_rows(met_pieces(lines))
    first = lambda role: F.min(F.when(F.col("role") != role, F.col("at")))
    best = found.groupBy("k1", "k2").agg(first(LONGER).alias("shorter"), first(SHORTER).alias("longer"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    best = materialise(best.where("lo <> hi").drop("lo", "hi"), "variants")
    other = F.when(F.col("role") == LONGER, F.col("shorter")).otherwise(F.col("longer"))
    pairs = found.join(broadcast_if_few(best), ["k1", "k2"]).select("at", other.alias("of")).where("of < at").distinct()
    both = pairs.join(lines.select("at", "line"), "at").join(lines.select(F.col("at").alias("of"), F.col("line").alias("other")), "of")
    return both.where(F.levenshtein("line", "other", 1) >= 0).select("at").distinct()


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` with a number of its own for each row, less than ``parts * 2**33``, instead of a key that is missing or repeats."""
    order = [F.col("doc").asc_nulls_last(), F.xxhash64("text"), F.length("text")]
    numbered = docs.withColumnRenamed("doc", "own").withColumn("doc", F.col("own")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialise(numbered.withColumn("doc", F.monotonically_increasing_id()), "numbered")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), shortest: int = 0) -> DataFrame:
    """``key, n_lines, n_kept, text`` and the columns ``carry`` for each row, the text without the lines that earlier ones repeat.

    A line that is not blank goes if an earlier line equals it or, where both have at least
    ``shortest`` characters, is one edit away (a character put in, left out or replaced); the
    earlier line counts whether or not it stays itself.  Earlier lines are those of documents with
    a smaller key and those before it in its own document.  Rows that repeat a key follow each other in
    the order of a hash of their texts, rows without a key come after all others.  Lines end at line feeds; blank
    lines stay; a null or empty text has no lines and
    gives an empty one.  Columns that are not carried are ignored.
    """
    names = [f"c{i}" for i in range(len(carry))]
    docs = df.select(df[key].cast("bigint").alias("doc"), *(df[c].alias(n) for c, n in zip(carry, names, strict=True)), df[text].alias("text"))
    keys = docs.groupBy("doc").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size"))
    odd, low, high, size = keys.agg(F.coalesce(F.bool_or((F.col("n") > 1) | F.col("doc").isNull()), F.lit(False)), F.min("doc"), F.max("doc"), F.max("size")).first()
    if odd:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        docs, low, high = in_order(docs, parts), 0, parts << 33
    else:
        docs = docs.withColumn("own", F.col("doc"))
    places = Places.fitting(low or 0, high or 0, size or 0)
    near = materialise(near_losers(docs, shortest, places), "near")
    kept = earliest(docs, places).join(broadcast_if_few(near), "at", "left_anti")
    doc, number = places.parts(F.col("at"))
    kept = kept.select(doc.alias("of"), number.alias("i")).groupBy("of").agg(F.collect_list("i").alias("kept"))  # at most a document's own lines
    whole = docs.join(kept, docs["doc"] == kept["of"], "left").withColumn("lines", split_lines(F.col("text")))
    blanks = F.filter(F.transform("lines", lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
    whole = whole.withColumn("stay", F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blanks)))
    stays = F.when(F.size("stay") == F.size("lines"), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
    return whole.select(
        F.col("own").alias(key), F.size("lines").cast("bigint").alias("n_lines"), F.size("stay").cast("bigint").alias("n_kept"), stays.alias(text),
        *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)),
    )
