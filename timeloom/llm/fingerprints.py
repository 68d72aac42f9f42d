"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A term of weight S takes part in sample k with r and c from Gamma(2, 1) and b from
(0, 1), all functions of the term and k alone: t = floor(ln S / r + b), and its
value is a = c * exp(-r * (t - b + 1)).  The term of least value, with its t, is the
document's sample.  Two documents have the same one with a probability that
equals the generalised Jaccard similarity of their weights, so the share of equal
samples estimates it.

One 64-bit hash of (term, k) gives all draws: 12 bits pick r from a table of quantiles, and the larger of two
12-bit numbers picks ln c, as the larger of two uniform numbers is the root of one: the table of c is thus fine where
c is small and the minimum lies.  16 bits are b, which makes values continuous again.  Tables of this size stay in a core's
cache.  A value and its sample share one long, so that a sample is the minimum of a long.

Samples are drawn in blocks: a row of a term becomes one row a block, and each of them draws ``PER_BLOCK`` samples, for
the text and its edited form at once.  The plan thus holds a few expressions instead of one for each sample, and its generated
methods stay small enough to be compiled well; keys and buffers of the aggregations are primitive.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLES, PER_BLOCK = 64, 4
#: Entries of a table.
SIZE = 1 << 12
#: Logarithms of values lie above this, and are stored in steps of 2**-22.
FLOOR, STEP = -200.0, 2.0**22
LOW = (1 << 32) - 1
#: A row: its id (or, without one, a hash) and a hash that tells it from other rows of that id.
KEY = ("at", "text_hash")


def gamma_quantile(p: float) -> float:
    """Where the distribution Gamma(2, 1) reaches ``p``: the root of 1 - (1 + x) exp(-x) = p."""
    x = math.sqrt(2 * p) if p < 0.5 else 1.0 - math.log(1 - p)
    for _ in range(60):
        step = (1 - (1 + x) * math.exp(-x) - p) / (x * math.exp(-x))
        x = max(x - step, x / 4)
        if abs(step) < 1e-12 * x:
            break
    return x


@lru_cache(maxsize=1)
def quantiles() -> tuple[list[float], list[float]]:
    """Quantiles of r in the middle of each of ``SIZE`` shares, and of ln c at their squares."""
    middle = [(i + 0.5) / SIZE for i in range(SIZE)]
    return [gamma_quantile(u) for u in middle], [math.log(gamma_quantile(u * u)) for u in middle]


def tables(spark: SparkSession) -> list[Column]:
    """The quantiles as scalar subqueries, which a plan evaluates once."""
    rows = spark.createDataFrame([quantiles()], "r array<double>, c array<double>").coalesce(1)
    return [rows.select(c).scalar() for c in ("r", "c")]


def draws(term: Column, k: Column, r_table: Column, c_table: Column) -> tuple[Column, Column, Column]:
    """``r``, ``ln c`` and ``b`` of a term in sample ``k``."""
    x = F.xxhash64(term, k)
    part = lambda shift: F.shiftrightunsigned(x, shift).bitwiseAND(SIZE - 1).cast("int")
    b = (x.bitwiseAND(65535).cast("double") + 0.5) / 65536.0
    return F.get(r_table, part(52)), F.get(c_table, F.greatest(part(40), part(28))), b


def ranked(term: Column, log_weight: Column, r: Column, log_c: Column, b: Column) -> Column:
    """A long that orders by value and holds the sample in its low 32 bits."""
    t = F.floor(log_weight / r + b)
    value = log_c - r * (t.cast("double") - b + 1.0)
    name = term.bitwiseXOR(F.shiftleft(t, 7)).bitwiseAND(LOW)
    return F.shiftleft(((value - FLOOR) * STEP).cast("bigint"), 32).bitwiseOR(name)


def successors(docs: DataFrame) -> DataFrame:
    """``doc, next, q``: the next larger id (after the largest: the smallest) and the longest quarter of a row of that id.

    Ids are dealt out by ranges, so each range finds its own successors; only one row a range, its
    smallest id, is looked at by a single task.
    """
    ids = docs.where("doc is not null").groupBy("doc").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("q"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(ids.repartitionByRange(parts, "doc").withColumn("part", F.spark_partition_id()), "ids")
    inside = ranged.withColumn("next", F.lead("doc").over(Window.partitionBy("part").orderBy("doc")))
    starts = ranged.groupBy("part").agg(F.min("doc").alias("start"))  # one row a partition
    everyone = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = starts.select("part", F.coalesce(F.lead("start").over(everyone), F.first("start").over(whole)).alias("follow"))
    joined = inside.join(F.broadcast(follow), "part")  # at most as many rows as partitions
    return joined.select("doc", F.coalesce("next", "follow").alias("next"), "q")


def row_hash() -> Column:
    return F.xxhash64("text", F.col("doc").isNull())


def with_edit(docs: DataFrame, after: DataFrame, again: bool) -> DataFrame:
    """``at, text_hash, doc, times, text, edited``: the last quarter replaced by the start of the next document.

    The result lies by ``at``.  Both joins ask for the same columns of ``docs`` by ``at``, so the texts are dealt out once.  A row
    without an id is nobody's next document: a condition on both sides, which is not moved before the exchange, sees to that.
    """
    side = after.select(F.col("doc").alias("of"), "next", "q")
    known = F.col("q") >= F.when(docs["doc"].isNull(), (1 << 31) - 1).otherwise(0)
    heads = docs.join(side, (docs["at"] == side["next"]) & known).select("of", F.expr("left(text, q)").alias("head"))
    heads = heads.groupBy("of").agg(F.min("head").alias("head")) if again else heads
    joined = docs.join(heads, (docs["at"] == heads["of"]) & docs["doc"].isNotNull(), "left").withColumn("text_hash", row_hash())
    joined = joined if again else joined.withColumn("times", F.lit(1).cast("bigint"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.coalesce(F.expr("left(head, cast(floor(length(text) / 4) as int))"), F.lit("")))
    return joined.select(*KEY, "doc", "times", "text", edited.alias("edited"))


def repeated(docs: DataFrame) -> bool:
    """Whether some rows have one key (or none): only then are rows told apart and looked through for equal ones."""
    return not docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def sampled(edits: DataFrame, n: int) -> DataFrame:
    """``KEY, own, edit``: the samples of the text and of the edited text of each row, null without words.

    ``edits`` lies by ``at``, so counting words and taking minima need no further exchange.
    """
    words = lambda c: F.split(F.lower(c), r"\s+")
    both = F.array(*(F.struct(F.lit(i).alias("which"), words(F.col(c)).alias("words")) for i, c in enumerate(("text", "edited"))))
    rows = edits.select(*KEY, F.explode(both).alias("x")).select(*KEY, "x.which", F.explode("x.words").alias("word")).where("word <> ''")
    here = lambda i: F.sum(F.when(F.col("which") == i, 1).otherwise(0))
    counts = rows.select(*KEY, "which", F.xxhash64("word").alias("term")).groupBy(*KEY, "term").agg(here(0).alias("n0"), here(1).alias("n1"))
    # the logarithm of no occurrence is null, and so is what is drawn with it
    weighted = counts.select(*KEY, "term", *(F.log(F.col(f"n{i}").cast("double")).alias(f"w{i}") for i in (0, 1)))
    per = min(n, PER_BLOCK)
    drawn = weighted.withColumn("block", F.explode(F.array(*map(F.lit, range(-(-n // per))))))
    found = tables(edits.sparkSession)
    minima = []
    for j in range(per):
        draw = draws(F.col("term"), F.col("block") * per + j, *found)
        minima += [F.min(ranked(F.col("term"), F.col(f"w{i}"), *draw)).alias(f"m{i}_{j}") for i in (0, 1)]
    least = drawn.groupBy(*KEY, "block").agg(*minima)
    # 32 bits as an int
    low = lambda c: F.shiftright(F.shiftleft(F.col(c), 32), 32).cast("int")
    some = lambda i: F.when(F.col(f"m{i}_0").isNotNull(), F.array(*(low(f"m{i}_{j}") for j in range(per))))
    parts = least.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("block", some(0).alias("s0"), some(1).alias("s1")))).alias("parts"))  # a row a block
    whole = lambda i: F.slice(F.flatten(F.col(f"parts.s{i}")), 1, n)
    return parts.select(*KEY, whole(0).alias("own"), whole(1).alias("edit"))


def likeness(a: Column, b: Column, n: int) -> Column:
    """Share of equal samples; texts without words are like each other and unlike all others."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    none = a.isNull() | b.isNull()
    return F.when(none, F.when(a.isNull() & b.isNull(), 1.0).otherwise(0.0)).otherwise(equal.cast("double") / n)


def printed(a: Column) -> Column:
    """Eight hexadecimal digits a sample."""
    return F.coalesce(F.lower(F.array_join(F.transform(a, lambda x: F.substring(F.hex(x.cast("bigint").bitwiseAND(LOW) + (1 << 32)), 2, 8)), "")), F.lit(""))


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    Terms are the words of the text in lower case (runs of characters that are no white space), their weights how often they
    occur.  The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    of the next document by ascending key (after the last: the first).  Columns ``key``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (8 hexadecimal digits a
    sample), ``near_edited``, ``near_next``.

    A null text counts as empty; a text without words has the empty fingerprint.  Of rows that repeat a key the
    next document is the one whose start (and, for ``near_next``, fingerprint) sorts first; rows equal in key and text are
    judged once and returned as often as they stand there.  A row without a key
    has no next document: nothing replaces its last quarter, and ``near_next`` is 0.  Other columns are ignored.
    """
    docs = df.select(df[key].cast("bigint").alias("doc"), F.coalesce(df[text], F.lit("")).alias("text"))
    again = repeated(docs)
    docs = docs.groupBy("doc", "text").agg(F.count("*").alias("times")) if again else docs
    docs = docs.select(F.coalesce("doc", row_hash()).alias("at"), *docs.columns)
    after = materialise(successors(docs), "next")
    edits = with_edit(docs, after, again)
    found = sampled(edits, n).toDF("at_of", "hash_of", "own", "edit")
    facts = edits.select(*KEY, "doc", "times", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # both sides lie by at; the hash as a difference keeps the planner from dealing them out anew by both
    own = (facts["at"] == found["at_of"]) & (facts["text_hash"].bitwiseXOR(found["hash_of"]) == 0)
    rows = materialise(facts.join(found, own, "left").select("doc", "times", "n_chars", F.unhex("edited_sha256").alias("sha"), "own", "edit"), "samples")
    firsts = rows.where("doc is not null").select(F.col("doc").alias("at"), F.col("own").alias("other"))
    # only where rows repeat a key is the least of their fingerprints looked for
    firsts = firsts.groupBy("at").agg(F.min("other").alias("other")) if again else firsts
    nexts = after.join(firsts, after["next"] == firsts["at"]).select(after["doc"].alias("of"), "other")
    out = rows.join(nexts, rows["doc"] == nexts["of"], "left")
    out = out.withColumn("one", F.explode(F.expr("sequence(1L, times)"))) if again else out
    near_next = F.when(F.col("of").isNull(), 0.0).otherwise(likeness(F.col("own"), F.col("other"), n))
    return out.select(
        F.col("doc").alias(key), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"), printed(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit"), n).alias("near_edited"), near_next.alias("near_next"),
    )
