"""URL rules in a sorted array of digests.

Every rule is a host and a path prefix.  The 64-bit xxhash of its text lies in
a sorted array in a file, which each worker maps into memory, and so do the digests of the rules' hosts, each with the lengths
of its paths.  A URL's host suffixes are looked up first, by binary search over whole batches; only suffixes that are a rule's host
go on, with the path lengths that this host's rules have.  So a URL costs as many probes as its host has parts, however many paths
all rules have, and a hit counts only if the stored text is the same.

Hosts, paths and the digests of host suffixes are DataFrame expressions: Spark's xxhash64 of a string is the
xxhash of its bytes under seed 42, so both sides agree on digests.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spread

Rule = tuple[str, str]
ACTIONS = ("block", "allow")
#: The seed of Spark's hash functions (a fixed value).
SEED = 42


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, SEED)


def path_length(text: str) -> int:
    """Characters of a rule's path."""
    return len(text) - text.index("/") if "/" in text else 0


def host_of(text: str) -> str:
    return text.split("/", 1)[0]


def build(rules: Sequence[Rule], hash_text: Callable[[bytes], int] = digest) -> bytes:
    """The rule file: counts; sorted digests, text offsets and actions of rules; sorted digests of hosts, and where the lengths of each
    one's paths stand; those lengths; texts.

    A rule given twice keeps its last action.
    """
    last = {text: action for action, text in rules}
    texts = [t.encode() for t in last]
    keys = np.fromiter(map(hash_text, texts), np.uint64, len(texts))
    order = np.argsort(keys, kind="stable")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))[order]
    actions = np.fromiter(map(ACTIONS.index, last.values()), np.int64, len(texts))[order]
    lengths: dict[int, set[int]] = {}
    for t in last:
        lengths.setdefault(hash_text(host_of(t).encode()), set()).add(path_length(t))
    hosts = sorted(lengths)
    known = [sorted(lengths[h], reverse=True) for h in hosts]
    begins = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int64)
    flat = np.array([n for ns in known for n in ns], np.int64)
    parts = [np.array([len(texts), len(hosts), len(flat)], np.int64), keys[order], begins(sizes), actions, np.array(hosts, np.uint64), begins([len(x) for x in known]), flat]
    return b"".join(p.tobytes() for p in parts) + b"".join(texts[i] for i in order.tolist())


class Rules:
    """A rule file, mapped into memory."""

    def __init__(self, path: str, hash_text: Callable[[bytes], int] = digest) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n, hosts, lengths = raw[:24].view(np.int64).tolist()
        ends = np.cumsum([24, 8 * n, 8 * (n + 1), 8 * n, 8 * hosts, 8 * (hosts + 1), 8 * lengths]).tolist()
        part = lambda i, kind: raw[ends[i] : ends[i + 1]].view(kind)
        self.keys, self.offsets, self.actions = part(0, np.uint64), part(1, np.int64), part(2, np.int64)
        self.hosts, self.begins, self.lengths = part(3, np.uint64), part(4, np.int64), part(5, np.int64)
        self.texts, self.hash_text = raw[ends[6] :], hash_text
        #: Rules that were looked up.
        self.probed = 0

    def text(self, i: int) -> bytes:
        return self.texts[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def match(self, hosts: Sequence[str], paths: Sequence[str], suffixes: np.ndarray, owners: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each URL the longest rule that fits it (of equal lengths that of the longer host), or -1.

        ``suffixes`` are digests of host ``owners[i]`` from character ``starts[i]`` on.
        """
        out = np.full(len(hosts), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hosts, suffixes), max(0, len(self.hosts) - 1))
        hit = np.flatnonzero(self.hosts[at] == suffixes) if len(self.hosts) else np.zeros(0, np.int64)  # a rule's host, or a collision
        counts = self.begins[at[hit] + 1] - self.begins[at[hit]]
        who, begin, n = np.repeat(owners[hit], counts), np.repeat(starts[hit], counts), self.lengths[spread(self.begins[at[hit]], counts)]
        path_sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        host_sizes = np.fromiter(map(len, hosts), np.int64, len(hosts))
        fits = n <= path_sizes[who]
        who, begin, n = who[fits], begin[fits], n[fits]
        size = host_sizes[who] - begin
        order = np.lexsort((-size, -(size + n), who))  # of each URL the longest first
        who, begin, n = who[order], begin[order], n[order]
        texts = [(hosts[i][s:] + paths[i][:k]).encode() for i, s, k in zip(who.tolist(), begin.tolist(), n.tolist(), strict=True)]
        self.probed += len(texts)
        keys = np.fromiter(map(self.hash_text, texts), np.uint64, len(texts))
        left, right = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        for c in np.flatnonzero(right > left).tolist():
            if out[who[c]] < 0:
                out[who[c]] = next((r for r in range(int(left[c]), int(right[c])) if self.text(r) == texts[c]), -1)
        return out


@lru_cache(maxsize=8)
def opened(name: str) -> Rules:
    return Rules(SparkFiles.get(name))


def publish(spark: SparkSession, content: bytes) -> str:
    """Hand the rule file to all executors; its name, under which workers open it.

    The same rules are the same file within an application, as Spark takes a name only once.
    """
    name = f"url-rules-{hashlib.sha1(content).hexdigest()}.bin"
    folder = os.path.join(tempfile.gettempdir(), f"timeloom-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(content)
        os.replace(f.name, path)
    spark.sparkContext.addFile(path)
    return name


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def suffixes_of(host: str) -> Column:
    """``h, s``: the digest of each suffix of a column of hosts, and the character from which it begins."""
    parts = F.split(host, r"\.")
    starts = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x) + 1))
    return F.transform(starts, lambda s: F.struct(F.xxhash64(F.substring(F.col(host), s + 1, F.length(host))).alias("h"), s.alias("s")))


def judge(df: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Columns ``key``, ``host``, ``path``, ``rule`` (text or null) and ``verdict`` for each row.

    ``rules`` are (action, text) pairs with action ``block`` or ``allow`` and text ``host/path``.
    A rule fits its host and all subdomains where the path starts with the rule's; the longest
    wins.  A null URL, or one without ``://``, has empty host and path and gets ``default``, as do
    URLs that no rule fits.  Of rules of one length the one of the longer host wins.  URLs of any length are read whole; repeated
    keys stay separate rows, other columns are ignored, an empty table gives no rows.
    """
    spark = df.sparkSession
    name = publish(spark, build(rules))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(name)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            h, s = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            found = known.match(hosts, paths, h.view(np.uint64), np.repeat(np.arange(len(hosts)), counts), s.astype(np.int64)).tolist()
            texts = [known.text(i).decode() if i >= 0 else None for i in found]
            verdicts = [ACTIONS[known.actions[i]] if i >= 0 else default for i in found]
            columns = [*batch.columns[:3], *(pa.array(x, pa.string()) for x in (texts, verdicts))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "host", "path", "rule", "verdict"])

    host, path = host_and_path(df[url])
    rows = df.select(df[key].alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("suffixes", suffixes_of("host"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
