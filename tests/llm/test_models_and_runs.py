"""Language model, periodic runs and fill-in-the-middle against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from timeloom.llm import fill_in_middle, hash_store, kneser_ney, periodic_runs, queries

SCHEMA = "doc_id bigint, text string, key string, h0 int, w0 string, part int, n string, runs int, c0 int, form string"
EXTRA = ("k", 1, "w", 2, "n", 3, 4, "f")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
TEXTS = [
    (1, "Alpha beta gamma delta.\n\nAlpha beta gamma delta epsilon."),
    (1, "Alpha beta gamma delta.\n\nAlpha beta gamma delta epsilon."),
    (2, ""),
    (3, None),
    (None, "A text without an id, but with words."),
    (4, LONG),
    (5, "one"),
    (6, "   \n\t "),
    (7, "日本語 é ́ ALPHA \x0b beta \x0c don't!! "),
    (8, "a mark <S> in the text"),
    (-8, "x y " * 40),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class BruteModel:
    """Modified Kneser-Ney, from the definition, over dictionaries."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        self.tokens = Counter()
        for t in texts:
            own = [*words(lower(t or "")), "</s>"]
            self.tokens.update(own)
            own = ["<s>"] * (order - 1) + own
            self.counts[order].update(tuple(own[i : i + order]) for i in range(len(own) - order + 1))
        for k in range(order - 1, 0, -1):
            self.counts[k].update(g[1:] for g in self.counts[k + 1])
        self.discounts, self.follow = [None], [None]
        for k in range(1, order + 1):
            n = [sum(c == i for c in self.counts[k].values()) for i in range(5)]
            self.discounts.append(kneser_ney.discounts_of(*n[1:]))
            follow = defaultdict(list)
            for g, c in self.counts[k].items():
                follow[g[:-1]].append(c)
            self.follow.append(follow)

    def p(self, gram: tuple) -> float:
        if not gram:
            return 1 / (len(self.tokens) + 1)
        k = len(gram)
        lower_p = self.p(gram[1:])
        follow = self.follow[k].get(gram[:-1])
        if not follow:
            return lower_p
        d = (0, *self.discounts[k])
        c = self.counts[k].get(gram, 0)
        gamma = sum(d[min(x, 3)] for x in follow)
        return (max(c - d[min(c, 3)], 0) + gamma * lower_p) / sum(follow)

    def score(self, text: str | None) -> float:
        own = ["<s>"] * (self.order - 1) + [*words(lower(text or "")), "</s>"]
        return sum(math.log10(self.p(tuple(own[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(own)))


def corpus(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcDefgh") * rng.choice((1, 1, 2)) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_equals_the_definition(spark, order):
    texts = [*corpus(60, 1), None, "", "never seen words here a b"]
    rows = spark.createDataFrame([(i, t, i < 50) for i, t in enumerate(texts)], "doc_id bigint, text string, train boolean").repartition(5)
    model = kneser_ney.fit(rows.where("train"), order=order)
    brute = BruteModel(texts[:50], order)
    assert (model.n_tokens, model.n_words) == (sum(brute.tokens.values()), len(brute.tokens))
    assert [*sum(model.discounts, ())] == pytest.approx([*sum(brute.discounts[1:], ())])
    found = {r.doc_id: r for r in kneser_ney.score(rows, model).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        own = [*words(lower(t or "")), "</s>"]
        base = sum(math.log10((brute.tokens[w] + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1))) for w in own)
        assert found[i].score == pytest.approx(brute.score(t), rel=1e-9)
        assert found[i].base_score == pytest.approx(base, rel=1e-9)
        assert (found[i].n_tokens, found[i].n_known) == (len(own), sum(w in brute.tokens for w in own))
        assert found[i].perplexity == pytest.approx(10 ** (-brute.score(t) / len(own)), rel=1e-9)


def test_probabilities_add_up(spark):
    """After any context the words of the vocabulary and one never seen share a probability of 1."""
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in corpus(40, 2)], "text string"), order=2)
    vocabulary = sorted({w for t in corpus(40, 2) for w in words(lower(t))})
    for context in ("a", "hh", "unheard"):
        raw = [f"{context} {w}".encode() for w in [*vocabulary, "never"]] + [context.encode()]
        ids, _, at = model.tokens(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        p = 10 ** model.log10(ids, at)
        assert p[at[:-1] + 1].sum() == pytest.approx(1)  # of the last text it is the end


def test_model_is_better_than_counts_alone(spark):
    """Held-out texts of a chain of words are far likelier under the model than word by word."""
    rng = random.Random(4)
    after = {w: rng.sample(range(50), 3) for w in range(50)}

    def chain(n: int) -> str:
        w, out = rng.randrange(50), []
        for _ in range(n):
            out.append(f"w{w}")
            w = rng.choice(after[w])
        return " ".join(out)

    model = kneser_ney.fit(spark.createDataFrame([(chain(100),) for _ in range(60)], "text string"))
    rows = kneser_ney.score(spark.createDataFrame([(i, chain(100)) for i in range(20)], "doc_id bigint, text string"), model).collect()
    assert all(r.score > 0.5 * r.base_score and r.perplexity < 8 for r in rows)


def test_model_after_a_clash(spark, monkeypatch):
    """Where two words share a hash, all is counted again under another seed."""
    monkeypatch.setattr(kneser_ney, "SHARD", 1)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(30, 5))], "doc_id bigint, text string")
    model = kneser_ney.fit(rows)
    assert model.words.bits > 6
    brute = BruteModel(corpus(30, 5), 2)
    assert {r.doc_id: r.score for r in kneser_ney.score(rows, model).collect()} == pytest.approx({i: brute.score(t) for i, t in enumerate(corpus(30, 5))}, rel=1e-9)
    monkeypatch.setattr(kneser_ney, "learn_words", lambda texts, model: (_ for _ in ()).throw(kneser_ney.Clash()) if model.seed < 2 else model)
    monkeypatch.setattr(kneser_ney, "learn_grams", lambda texts, model: model)
    assert kneser_ney.fit(rows).seed == 2


def test_model_tables(odd, none, spark):
    model = kneser_ney.fit(none)
    assert (model.n_tokens, model.n_words) == (0, 0)
    rows = kneser_ney.score(odd, model).collect()
    assert len(rows) == len(TEXTS) and all(r.n_known == 0 and r.score == 0 for r in rows)
    model = kneser_ney.fit(odd, order=3)
    rows = kneser_ney.score(odd, model, carry=("n",)).collect()
    assert len(rows) == len(TEXTS) and all(r.n_known == r.n_tokens and r.n == "n" for r in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len(words(t)) + 1) for i, t in TEXTS)
    assert kneser_ney.score(none, model).count() == 0


def test_tables_of_folders_and_stores(tmp_path):
    assert hash_store.mounted("s3a://bucket/model") is None and hash_store.mounted("file:///a%20b/c") == "/a b/c"
    keys = np.array([1, 5, 2**62 - 1], np.uint64)
    for folder in (str(tmp_path / "x y"), f"file://{tmp_path}/z"):
        table = hash_store.Table(folder, 2, ("u4", "u8"))
        table.write(0, keys, (np.array([1, 2, 3]), np.array([4, 5, 6])))
        there, place, (a, b) = table.find(np.array([1, 2, 2**62 - 1, 2**63], np.uint64))
        assert there.tolist() == [True, False, True, False] and place[there].tolist() == [0, 2] and a.tolist() == [1, 0, 3, 0] and b.tolist() == [4, 0, 6, 0]


def test_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    monkeypatch.setattr(hash_store, "mounted", lambda uri: None)
    table = hash_store.Table(f"file://{tmp_path}/far", 1, ("u4",))
    table.write(1, np.array([2**63, 2**64 - 1], np.uint64), (np.array([7, 8]),))
    assert table.look_up(np.array([2**64 - 1, 3, 2**63, 2**64 - 1], np.uint64))[0].tolist() == [8, 0, 7, 8]


def test_repeated_keys(spark, tmp_path, monkeypatch):
    """Counts over tasks, with flushes inside them, of keys that come once, often and everywhere."""
    monkeypatch.setattr(hash_store, "GATHERED", 50)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    rows = [(i, int(pool[int(j)].view(np.int64))) for i, j in enumerate(np.concatenate([rng.integers(0, 400, 700), np.zeros(300, int)]))]
    df = spark.createDataFrame(rows, "i int, k bigint").repartition(7)
    table = hash_store.repeated(df, lambda batch: iter([batch.column(1).to_numpy().view(np.uint64)]), str(tmp_path / "t"), 3)
    want = Counter(np.uint64(np.int64(k).view(np.uint64)) for _, k in rows)
    found = table.look_up(hash_store.short(pool))[0]
    assert found.tolist() == [want[k] if want[k] > 1 else 0 for k in pool] and found.max() > 300 and (found == 0).any()
    assert (hash_store.unpacked(hash_store.packed(hash_store.short(pool))) == hash_store.short(pool)).all()


def brute_runs(w: list, shortest: int) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            k = i
            while k + p < n and w[k] == w[k + p]:
                k += 1
            size = k - i + p
            if size >= max(shortest, 2 * p) and all(any(w[i + t] != w[i + t + q] for t in range(size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng: random.Random, n: int, letters: int) -> list[int]:
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, n - a)
        w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        shortest = rng.choice([2, 3, 4, 5, 12, 13])
        texts = [periodic(rng, rng.randint(0, 60), rng.choice([1, 2, 2, 3, 10])) for _ in range(rng.randint(1, 6))]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = periodic_runs.find(np.array([x for t in texts for x in t], np.int64), at, shortest)
        assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t, shortest)]


def test_fibonacci_and_powers():
    """Words with many runs, and one of a single period as long as the text."""
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert [tuple(r[1:]) for r in periodic_runs.find(np.array(b), np.array([0, len(b)]), 2).tolist()] == brute_runs(b, 2)
    assert periodic_runs.find(np.resize(np.arange(7), 100_000), np.array([0, 100_000])).tolist() == [[0, 0, 100_000, 7]]


def run_digests(text: str | None, doc_id: int | None) -> tuple:
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], *digests)


def test_run_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(map(str, periodic(rng, rng.randint(0, 120), rng.choice([2, 3, 30]))))) for i in range(150)] + [(None, "a b " * 9), (151, None), (152, " \n ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(run_digests(t, i) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


def test_run_tables(odd, none):
    assert periodic_runs.runs_of(none).count() == 0
    rows = periodic_runs.runs_of(odd).collect()
    assert len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert [tuple(r) for r in by[-8].runs] == [(0, 80, 2)] and by[-8].collapsed == "x y"
    assert by[3].n_words == by[6].n_words == 0 and by[3].collapsed == by[6].collapsed == "" and by[4].collapsed == LONG and not by[None].runs


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_cut(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def spaced(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(["a", "日", "é\u0301", "<", "<P", "S>", " ", "\n\t", "word", "\x0b"]) for _ in range(n))


def test_cuts_equal_brute_force(spark, odd, none):
    rng = random.Random(2)
    texts = [(i, spaced(rng, rng.randint(0, 80))) for i in range(300)] + [(1000 + i, spaced(rng, 4000)) for i in range(6)]
    rows = spark.createDataFrame([(i, t, *EXTRA) for i, t in texts], SCHEMA)
    found = fill_in_middle.transform(rows, every=3)
    assert Counter(map(tuple, found.collect())) == Counter(brute_cut(i, t) for i, t in texts)
    back = found.select("doc_id", fill_in_middle.restored(found.output, found.form).alias("text"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(texts)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fill_in_middle.transform(odd).collect())) == Counter(brute_cut(i, t) for i, t in TEXTS)
    assert fill_in_middle.transform(none).count() == 0


@pytest.mark.parametrize(("every", "window"), [(1, 7), (4, 16), (128, 1 << 16)])
def test_checkpoints(every, window):
    """Every cut, by byte and code point, whatever the windows and checkpoints; the index stays sparse."""
    rng = random.Random(every)
    for n in (0, 1, 5, 900):
        text = spaced(rng, n)
        units = UNITS.findall(text)
        index = fill_in_middle.Index(np.frombuffer(text.encode(), np.uint8), every, window)
        assert (index.n, index.n_chars) == (len(units), len(text)) and len(index.bytes) <= len(units) // every + 1
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.after(k) == (len(head.encode()), len(head))


def test_marks_must_differ():
    for marks in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "c", "d"), ("ab", "bc", "x"), ("<P>", "x<P>", "y")):
        with pytest.raises(ValueError, match="mark"):
            fill_in_middle.check_marks(marks)
    fill_in_middle.check_marks(fill_in_middle.MARKS)
