"""Corpus operators against brute force, and on odd tables."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from timeloom.llm import bpe, fingerprints, language_id, license_scan, line_dedup, ngram_join, packing, topk, url_filter, warc

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, uid int, h1 string, words string, t0 int"
EXTRA = ("k", 1, "h", "w", 0)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, "Alpha beta gamma delta. Released under the MIT License.\n\nAlpha beta gamma delta epsilon.", "en", "a.example.org"),
    (1, "Alpha beta gamma delta. Released under the MIT License.\n\nAlpha beta gamma delta epsilon.", "en", "a.example.org"),
    (2, "", "en", None),
    (3, None, None, None),
    (None, "A text without an id, but with words enough to be one.", "de", "b"),
    (4, LONG, "en", "a.example.org"),
    (5, "one", "fr", "b"),
    (6, "   \n\t ", "fr", "b"),
    (7, "日本語 <|endoftext|> é ́ don't!!", "xx", "c"),
    (-8, "Alpha beta gamma delta. Released under the MIT License.\n\nAlpha beta gamma delta epsilon.", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, a, b, len(t or ""), *EXTRA) for i, t, a, b in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize(("kind", "path"), [("byte_level", BYTE), ("word_end", WORD)])
def test_ids_equal_the_library(kind, path):
    rng = random.Random(5)
    pool = [*"ab1 \n\t'.,-é日\u0301ß'sS<|>", "<|endoftext|>", "<|startoftext|>", "'s", "  ", "\n\n", "the", "Token"]
    texts = ["", "x" * 500 + "yz" * 300, LONG[:5000], *("".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(1500))]
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    coder = bpe.Encoder.__subclasses__()[0 if kind == "byte_level" else 1](path)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, at = coder.encode(data, offsets)
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want, t
        if kind == "byte_level":
            assert coder.vocabulary.decode(np.array(want, np.int64)).tobytes().decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize(("kind", "path"), [("byte_level", BYTE), ("word_end", WORD)])
def test_the_fragment_table_is_bounded(kind, path, monkeypatch):
    """Texts without blanks are one long fragment each, and are not kept; short ones are, up to a number of bytes."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    rng = random.Random(7)
    chinese = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(rng.choice([50, 900, 4000]))) for _ in range(12)]
    texts = [t for i in range(12) for t in (chinese[i], " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)), chinese[i])]
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    coder = bpe.Encoder.__subclasses__()[0 if kind == "byte_level" else 1](path)
    for i in range(0, len(texts), 6):
        raw = [t.encode() for t in texts[i : i + 6]]
        ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for j, t in enumerate(texts[i : i + 6]):
            assert ids[at[j] : at[j + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
        assert coder.raw_used <= 20_000 and (not len(coder.sizes) or coder.sizes.max() <= bpe.LONG_FRAGMENT)


def test_bpe_tables(odd, none):
    rows = bpe.round_trip(odd, BYTE).collect()
    assert len(rows) == len(ODD) and bpe.round_trip(none, BYTE).count() == 0
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == want
    back = bpe.decode(bpe.encode(odd, BYTE), BYTE).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t, *_ in ODD)


def brute_lines(texts: list[str]) -> list[str]:
    """The contract, line by line."""

    def near(a: str, b: str) -> bool:
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1] <= 1

    seen: list[str] = []
    out = []
    for t in texts:
        kept = []
        for line in t.split("\n") if t else []:
            if not line.strip(" \t\r\x0b\x0c"):
                kept.append(line)
                continue
            if not any(near(line, s) for s in seen):
                kept.append(line)
            seen.append(line)
        out.append("\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abc é", k=rng.randint(1, 40))) for _ in range(25)] + ["the same passage that is everywhere"]
    lines = list(base)
    for line in base * 4:
        at = rng.randrange(len(line) + 1)
        lines.append(rng.choice([line, line[:at] + rng.choice("xé") + line[at:], line[:at] + line[at + 1 :], line[:at] + "z" + line[at + 1 :], line[:at] + "zz" + line[at + 2 :]]))
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 6))) for _ in range(50)]
    found = {r.doc_id: r for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    want = brute_lines(texts)
    assert [found[i].text for i in range(len(texts))] == want
    assert all(found[i].n_lines == (len(t.split("\n")) if t else 0) for i, t in enumerate(texts))


def test_line_dedup_tables(odd, none):
    assert line_dedup.dedup(none).count() == 0
    rows = line_dedup.dedup(odd, carry=("lang", "uid")).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[-8].n_kept == by[-8].n_lines == 3 and by[1].text.strip() == ""
    assert by[2].n_lines == by[3].n_lines == 0 and by[3].text == "" and by[4].text == LONG
    assert by[None].n_kept == 1 and by[6].n_kept == 2


def language_rows(n: int, seed: int):
    rng = random.Random(seed)
    syllables = {"en": ["the", "ing", "wh", "tion", "ly"], "de": ["sch", "ung", "keit", "ü", "pf"], "fr": ["eau", "oi", "è", "ment", "que"]}
    rows = []
    for i in range(n):
        lang = list(syllables)[i % 3]
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang, f"{lang}{i % 4}.host.{lang}"))
    return rows


def test_language_held_out_accuracy(spark):
    known, held = language_rows(600, 1), language_rows(300, 2)
    rows = known + [(1000 + i, t, None, None) for i, t, *_ in held]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in language_id.identify(d).collect()}
    assert np.mean([found[1000 + i].language == lang for i, _, lang, _ in held]) > 0.98
    assert all(found[i].language == lang and found[i].accepted for i, _, lang, _ in known)


def test_language_evidence_beats_a_wrong_label(spark):
    rows = language_rows(600, 4)
    wrong = [(9000, rows[0][1], "de", rows[0][3]), (9001, "12345 !!", "en", "x"), (9002, "Привет как дела сегодня", "en", "x")]
    found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows + wrong, "doc_id bigint, text string, lang string, source string")).collect()}
    assert found[9000].language == "en" and not found[9001].accepted and not found[9002].accepted


def test_language_tables(odd, none):
    assert language_id.identify(none).count() == 0
    rows = language_id.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert all(not r.accepted and r.language == "und" for r in rows if not (r.text or "").strip())


def test_language_of_many_and_rare_ones(spark):
    """Twenty languages of a hundred rows, and one of three rows among 2003."""
    rng = random.Random(8)
    alphabets = {f"l{chr(97 + i)}": [chr(0x4E00 + 40 * i + j) for j in range(12)] for i in range(21)}
    rows = []
    for number, (lang, letters) in enumerate(alphabets.items()):
        for i in range(3 if number == 20 else 100):
            rows.append((1000 * number + i, " ".join("".join(rng.choices(letters, k=3)) for _ in range(60)), lang, "h"))
    found = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert {r.lang for r in found if r.accepted} == set(alphabets)
    assert all(r.accepted and r.language == r.lang for r in found)


def likeness(a: str, b: str) -> float:
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 1.0


def edits(texts: list[str]) -> list[str]:
    return [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]


def test_fingerprints_estimate_generalised_jaccard(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 4000}" for _ in range(rng.randint(20, 200))) for _ in range(60)]
    texts[11] = texts[10]
    rows = sorted(fingerprints.fingerprint(docs_of(spark, texts)).collect(), key=lambda r: r.doc_id)
    changed = edits(texts)
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(e.encode()).hexdigest() for e in changed]
    error = [r.near_edited - likeness(t, e) for r, t, e in zip(rows, texts, changed, strict=True)]
    error += [r.near_next - likeness(t, texts[(i + 1) % len(texts)]) for i, (r, t) in enumerate(zip(rows, texts, strict=True))]
    assert abs(np.mean(error)) < 0.04 and np.std(error) < 0.1
    assert rows[10].fingerprint == rows[11].fingerprint and rows[10].near_next == 1.0
    assert len({r.fingerprint for r in rows}) == len(rows) - 1


def test_fingerprint_tables(odd, none):
    assert fingerprints.fingerprint(none).count() == 0
    rows = fingerprints.fingerprint(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[6].fingerprint == "" and by[3].n_chars == 0
    assert by[2].near_next == 1.0 and by[None].near_next == 0.0 and by[-8].near_next == 1.0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n<p>\n\r\nWARC/1.1\r\n", b"plain", b""]
    records = [{"url": f"http://a/{i} b", "block": b, "mime": "text/html"} for i, b in enumerate(blocks)]
    data = warc.arc_file(version, records)
    back = list(warc.read_arc(data))
    assert [r.block for r in back[1:]] == blocks and {r.version for r in back} == {version}
    made = [warc.convert(r) for r in back]
    assert [m.headers["WARC-Type"] for m in made] == ["warcinfo", "response", "resource", "resource"]
    assert len({m.headers["WARC-Record-ID"] for m in made}) == 4 and made[1].headers["WARC-Date"] == "2024-01-01T00:00:00Z"
    assert [m.headers["WARC-Record-ID"] for m in made] == [warc.convert(r).headers["WARC-Record-ID"] for r in warc.read_arc(data)]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_arc(data[:-4] if blocks[-1] else data[: data.index(b"plain") + 2]))


def test_arc_dates():
    assert warc.warc_date("2024") == "2024-01-01T00:00:00Z" and warc.warc_date("202405060708") == "2024-05-06T07:08:00Z"


def test_warc_round_trip(spark):
    long = "x" * 300_000
    rows = [(1, "http://a/ b", "same"), (2, None, "same"), (5, "u", "same\r\n\r\nWARC/1.1\r\n"), (3, "u", ""), (4, "u", None), (9, "u", long), (9, "u", long), (7, "u", long), (None, "u", "same"), (None, "u", "own é")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnsRenamed({}).selectExpr("*", "1 AS sha", "2 AS payload")
    found = warc.round_trip(pages).collect()
    assert len(found) == len(rows)
    top: dict[str, int] = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -(10**9)), i)
    want = Counter()
    for i, _, h in rows:
        payload = (h or "").encode()
        of = top.get(h or "")
        later = of is not None and (i is None or i < of)
        want[i, len(payload), warc.base32_sha1(payload), "revisit" if later else "response", of if later else None] += 1
    assert Counter(tuple(r) for r in found) == want
    assert warc.round_trip(pages.where("false")).count() == 0


def brute_licenses(text: str | None):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if ord(c) > 127 or c.isascii() and (c.isdigit() or c.islower()) else " " for c in lower).split(" ")
    words = [w for w in words if w]
    starts, base = [], set()
    for label, phrase in license_scan.PHRASES:
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    more, best = set(), 0.0
    for label, template in license_scan.TEMPLATES:
        t = set(license_scan.words_of(template))
        width = license_scan.width_of(len(license_scan.words_of(template)))
        for b in range(0, len(words), width // 2):
            block = set(words[b : b + width])
            if len(block & t) * 10 >= len(t) * 8 and t & set(license_scan.TELLING) <= block:
                more.add(label)
                best = max(best, len(block & t) / len(t))
    score = 1.0 if starts else best
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9)


def test_license_scan_equals_brute_force(spark, odd, none):
    rng = random.Random(2)
    texts = ["cc by nc cc by nc, CC-BY-NC!", "Under the MIT Licenses", None, "", "under THE\nmit.license", "ünder the mit license é 5"]
    for _ in range(120):
        words = prose(rng, rng.randint(0, 70)) + ["the", "of", "license"]
        for _ in range(rng.randint(0, 2)):
            notice = license_scan.words_of(rng.choice(license_scan.TEMPLATES)[1]) if rng.random() < 0.6 else rng.choice(license_scan.PHRASES)[1].split(" ")
            notice = [w for w in notice if rng.random() < 0.93]
            at = rng.randrange(len(words))
            words[at:at] = notice
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    found = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert (*list(found[i])[1:-1], round(found[i].score, 9)) == brute_licenses(t), t
    assert license_scan.scan(none).count() == 0 and license_scan.scan(odd).count() == len(ODD)


def test_notices_need_their_own_words(spark):
    """Common words of a notice, scattered or with another name, state nothing."""
    texts = [
        "This package is released under the terms of the Apache license.",
        "The film was released last year, under the old driving license rules.",
        "Released under the MIT license, version of 2019.",
        "This work is licensed under the GNU General Public License version 2.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the Apache License, Version 1.0",
        "mit " + "filler " * 20 + "released under the license",
    ]
    found = {r.doc_id: r.labels for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert found == {0: "", 1: "", 2: "mit", 3: "", 4: "gpl-3", 5: "", 6: ""}
    other = {r.doc_id: r.labels for r in license_scan.scan(docs_of(spark, texts), telling=()).collect()}
    assert other[0] == "mit" and other[3] == "gpl-3"


def test_packing(spark, odd, none):
    assert packing.pack_documents(none, WORD).count() == 0
    rows = packing.pack_documents(odd, WORD, capacity=512).collect()
    library = Tokenizer.from_file(WORD)
    want = Counter(i for i, t, *_ in ODD for _ in range(-(-(len(library.encode(t or "", add_special_tokens=False).ids) + 1) // 512)))
    assert Counter(r.doc_id for r in rows) == want
    check_packed(rows, 512)


def check_packed(rows, capacity):
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_close_to_the_bound(spark):
    rng = random.Random(4)
    lengths = [min(999, int(rng.lognormvariate(5, 0.8)) + 1) for _ in range(1500)]
    how = packing.Evolution(shard=400)
    found = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length int"), 1000, how).collect()
    assert sorted(r.uid for r in found) == list(range(len(lengths)))
    bins: dict[int, list] = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, lengths[r.uid]))
    assert all(sum(n for _, n in b) <= 1000 for b in bins.values())
    assert len(bins) <= -(-sum(lengths) // 1000) * 1.02 + 1


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 90) for _ in range(200)]
    a = packing.fill(list(range(200)), lengths, 100)
    b = packing.fill(list(range(199, -1, -1)), lengths, 100)
    child = packing.mutate(packing.crossover(a, b, lengths, 100, rng), lengths, 100, rng)
    assert sorted(i for held in child for i in held) == list(range(200)) and all(sum(lengths[i] for i in held) <= 100 for held in child)


def shingles(text: str | None) -> set:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 90 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(6)
    texts: list[str | None] = [None, "", "one two", "One\ttwo", "one", "  "]
    for _ in range(14):
        words = prose(rng, rng.choice([3, 8, 10, 12, 20, 60, 150, 400]), 5000)
        for _ in range(rng.choice([1, 3, 12, 40])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [f"n{rng.randrange(10**6)}"][: rng.randint(0, 1)]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    want, sizes = brute_components(texts)
    found = {r.doc_id: r for r in ngram_join.join(docs_of(spark, texts)).collect()}
    assert [found[i].n_shingles for i in range(len(texts))] == sizes
    assert [found[i].component_id for i in range(len(texts))] == want


def test_ngram_join_of_a_busy_group(spark):
    """A group of near copies far larger than what is listed by pairs, most of which do not link."""
    rng = random.Random(9)
    base = prose(rng, 120, 10**6)
    texts = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(8)}" if i % 2 else f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    want, _ = brute_components(texts)
    found = {r.doc_id: r.component_id for r in ngram_join.join(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_ngram_join_tables(odd, none):
    assert ngram_join.join(none).count() == 0
    rows = ngram_join.join(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == -8 and by[2].component_id == 2 and by[3].n_shingles == 0 and by[None].component_id is None


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    like = ngram_join.Similarity()
    for size in (9, 10, 19, 20, 45, 90, 300, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            both = len(a)
            drop = rng.integers(0, max(1, both - -(-9 * both // 10)) + 1)
            grow = 0
            while 100 * (both - drop) >= 90 * (both + grow + 1):
                grow += 1
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, grow).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            owner, found = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), like)
            assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1200, 16))
    vectors[300:360] = vectors[299]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5050, [float("nan")] * 16), (5100, [1.0, None]), (5150, [float("inf")] * 16), (None, [1.0] * 16), (5200, [0.5, 0.25]), (6000, [])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = [(i, np.floor(256 * np.array(v + [0.0] * (16 - len(v)))).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in good:
        if q % 50 == 0:
            ranked = sorted(((-int(x @ y), i) for i, y in good if i != q))[:5]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)}
    assert {tuple(r) for r in topk.search(d).collect()} == want
    assert topk.search(d.where("false")).count() == 0
    blank = spark.createDataFrame([(0, []), (50, []), (3, [])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in topk.search(blank).collect()) == [(0, 1, 3, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 3, 0)]


def test_top_k_of_huge_components(spark):
    d = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1e17, 3.0])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(d).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "com"), ("allow", "a.com/x")]
    urls = [None, "no scheme", "HTTP://X.NET/", "http://net", "http://example.net/en/a?b#c", "http://a.example.NET/de/", "https://notexample.net", "x://a.com/xy", "x://b.a.com#/x", "x://acom/", "x://É.com/x?y", "x://a.com:80/x", "://net/://"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "x://net/")], "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS key")

    def brute(u):
        _, mark, rest = (u or "").partition("://")
        if not mark:
            return "", "", None, "allow"
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.split(c)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), len(r.split("/")[0]), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    found = {r.page_id: tuple(r)[1:] for r in url_filter.judge(d, rules).collect()}
    assert found == {**{i: brute(u) for i, u in enumerate(urls)}, None: brute("x://net/")}
    assert url_filter.judge(d.where("false"), rules).count() == 0


def test_url_digest_collisions(tmp_path):
    path = tmp_path / "rules"
    constant = lambda _: 7
    path.write_bytes(url_filter.build([("block", "a/"), ("allow", "b/"), ("block", "c/")], constant))
    known = url_filter.Rules(str(path), constant)
    hosts, paths = ["b", "d", "c"], ["/", "/", "/x"]
    found = known.match(hosts, paths, np.full(3, 7, np.uint64), np.arange(3), np.zeros(3, int))
    assert [known.text(i) if i >= 0 else None for i in found] == [b"b/", None, b"c/"]


def test_probes_follow_hosts_and_not_all_paths(tmp_path):
    """Rules of 300 path lengths: a URL is looked up with those of its own host's alone."""
    rules = [("block", f"h{i}.org/{'p' * (i % 300)}") for i in range(3000)] + [("allow", "h5.org/pppppp"), ("block", "org/q")]
    path = tmp_path / "rules"
    path.write_bytes(url_filter.build(rules))
    known = url_filter.Rules(str(path))
    hosts, paths = [f"www.h{i}.org" for i in (5, 6, 299, 4000)], ["/pppppppp", "/ppppp", "/" + "p" * 400, "/q"]
    suffixes = [(i, s, url_filter.digest(h[s:].encode())) for i, h in enumerate(hosts) for s in (0, 4, h.index(".org") + 1)]
    owners, starts, digests = (np.array(x, k) for x, k in zip(zip(*suffixes, strict=True), (np.int64, np.int64, np.uint64), strict=True))
    found = known.match(hosts, paths, digests, owners, starts)
    assert [known.text(i).decode() if i >= 0 else None for i in found] == ["h5.org/pppppp", None, f"h299.org/{'p' * 299}", "org/q"]
    assert known.probed <= 3 * len(hosts)


def test_url_rules_by_the_hundred_thousand(spark):
    rules = [(("block", "allow")[i % 2], f"h{i}.org/{'p' * (i % 4)}") for i in range(100_000)]
    urls = [f"http://www.h{i}.org/{'p' * (i % 5)}?q" for i in range(0, 100_000, 997)]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(d, rules).collect()}
    for k, i in enumerate(range(0, 100_000, 997)):
        fits = i % 5 >= i % 4
        assert found[k] == ((rules[i][1], rules[i][0]) if fits else (None, "allow"))


def test_digests_are_spark_s(spark):
    texts = ["", "a", "net/", "é.com/x", "y" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) AS h").collect()
    assert all(url_filter.digest(r.t.encode()) == r.h % (1 << 64) for r in rows)


def test_top_k_reads_no_more_than_it_needs():
    """Where few candidates stand out, reading stops early; the scores are those of brute force."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-9, 10, (4096, 12))
    rows[100:110] = rng.integers(900, 1000, (10, 12))
    block = topk.Block(np.arange(4096), rows)
    query = rng.integers(1, 9, (1, 12))
    _, found, scores = block.search(np.array([-1]), query, 5)
    want = sorted(((-int(s), i) for i, s in enumerate(rows @ query[0])))[:5]
    assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == want
    assert 0 < block.read <= rows.size // 16
    for _ in range(30):
        rows = rng.integers(-3, 4, (rng.integers(1, 60), 4))
        block = topk.Block(np.arange(len(rows)), rows)
        own, query = int(rng.integers(0, 70)), rng.integers(-3, 4, (1, 4))
        _, found, scores = block.search(np.array([own]), query, 5)
        want = sorted(((-int(s), i) for i, s in enumerate(rows @ query[0]) if i != own))[:5]
        assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == want


def test_unicode_normal_forms_stay_apart(spark):
    """Texts are compared as they are, in code points."""
    a, b = "é", unicodedata.normalize("NFD", "é")
    texts = [a + "x" * 30, b + "y" + "x" * 29, "abc", "abd", "abcd", "acb", "axcb"]
    found = {r.doc_id: r.n_kept for r in line_dedup.dedup(docs_of(spark, texts)).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0}


def test_full_license_texts_are_found(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and len(t) > 400)
    rng = random.Random(6)
    near = " ".join(w for w in license_scan.words_of(mit) if rng.random() > 0.05)
    half = " ".join(license_scan.words_of(mit)[:60])
    texts = [mit, " ".join(prose(rng, 333)) + " " + near + " tail", half, "nothing here"]
    rows = {r.doc_id: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert rows[0].labels == "mit" and rows[0].score == 1.0 and 0.8 <= rows[1].score < 1.0 and rows[1].labels == "mit"
    long = " ".join(f"u{i}" for i in range(170))
    one = {r.doc_id: r for r in license_scan.scan(docs_of(spark, [long, " ".join(f"u{i}" for i in range(100))]), templates=[("long", long)]).collect()}
    assert (one[0].labels, one[0].score, one[1].labels, one[1].score) == ("long", 1.0, "", 0.0)
    assert license_scan.scan(docs_of(spark, texts), templates=()).where("labels <> ''").count() == 0


def test_revisits_name_records_that_exist(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "filedesc://b", "same"), (3, "filedesc:c d", "same"), (4, None, None), (9, "http://e", ""), (5, "filedesc://x", "only")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    records = [r for f in sorted((tmp_path / "w").glob("part-*")) for r in warc.read_warc(gzip.open(f))]
    by_id = {r.headers["WARC-Record-ID"]: r for r in records if r.headers["WARC-Type"] == "response"}
    revisits = [r for r in records if r.headers["WARC-Type"] == "revisit"]
    assert len(by_id) == 3 and len(revisits) == 3
    for r in revisits:
        held = by_id[r.headers["WARC-Refers-To"]]
        assert held.headers["WARC-Target-URI"] == r.headers["WARC-Refers-To-Target-URI"]
        assert held.headers["WARC-Payload-Digest"] == r.headers["WARC-Payload-Digest"] and held.headers["WARC-Date"] == r.headers["WARC-Refers-To-Date"]
    back = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert back == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("revisit", 9), 9: ("response", None), 5: ("response", None)}


def test_chunks_are_bounded():
    parts = [b"a" * n for n in (3, 3, 3, 20, 1)]
    assert [len(c) for c in warc.chunks(parts, 7)] == [6, 3, 20, 1] and b"".join(warc.chunks(parts, 7)) == b"".join(parts)


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_that_polynomials_confuse(spark, size):
    one, two = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    d = docs_of(spark, [one, two])
    assert {r.doc_id: r.n_kept for r in line_dedup.dedup(d).collect()} == {0: 1, 1: 1}
    assert {r.doc_id: r.component_id for r in ngram_join.join(d).collect()} == {0: 0, 1: 1}
    raw = {i: t for i, t in enumerate((one, two))}
    assert {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(d, BYTE).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in raw.items()}
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    found = {}
    for r in packing.pack_documents(d, WORD).collect():
        found.setdefault(r.doc_id, {})[r.start] = (r.length, r.ids_crc32)
    for i, t in raw.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert found[i] == {s: (len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)}


def test_hash_collisions_do_not_change_ids(monkeypatch):
    """Every fragment with one hash: the bytes tell them apart."""
    monkeypatch.setattr(bpe, "range_hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    coder = bpe.ByteLevel(BYTE)
    texts = ["alpha beta alpha", "beta gamma.", "", "alpha"]
    raw = [t.encode() for t in texts]
    ids, at = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    library = Tokenizer.from_file(BYTE)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_and_digests(spark):
    texts = ["", "one", "Two words, 3 numbers\n\n x", LONG[:3000], "日本 é <|endoftext|> '"]
    library = Tokenizer.from_file(BYTE)
    library.no_truncation()
    library.no_padding()
    for r in bpe.round_trip(docs_of(spark, texts), BYTE).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_language_posterior_equals_brute_force(spark):
    """Votes, smoothed priors and the posterior, in plain Python over the model's scores."""
    rng = random.Random(12)
    rows = [(i, t, rng.choice([lang, lang, lang, "fr", None]), rng.choice([host, "plain", None, f"x.{lang}"])) for i, t, lang, host in language_rows(150, 5)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    how = language_id.Settings()
    model = language_id.fit(d, "doc_id", "text", "lang", how)
    size, suffix = len(model.languages), lambda h: h.rsplit(".", 1)[1] if h and "." in h else ""
    raw = [t.encode() for _, t, *_ in rows]
    scores = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    best = scores[:, :size].argmax(1)
    told = [x if x in model.languages else "" for _, _, x, _ in rows]
    overall = (np.bincount(best, minlength=size) + 1) / (len(rows) + size)

    def smoothed(mine, prior):
        n = np.bincount(best[mine], minlength=size)
        return (n + how.strength * prior) / (n.sum() + how.strength)

    found = {r.doc_id: r for r in language_id.identify(d, how=how).collect()}
    for k, (i, _, _, host) in enumerate(rows):
        by_suffix = smoothed([j for j, r in enumerate(rows) if suffix(r[3]) == suffix(host)], overall)
        prior = smoothed([j for j, r in enumerate(rows) if (r[3] or "") == (host or "")], by_suffix)
        heard = np.array([(sum(told[j] == told[k] and best[j] == x for j in range(len(rows))) + how.strength * 0.05 / size) / (np.sum(best == x) + how.strength * 0.05) for x in range(size)])
        n = scores[k, -1]
        log = scores[k, :size] * n * how.temper / (n + how.temper) + np.log(heard) + np.log(prior)
        sure = 1 / np.exp(log - log.max()).sum()
        assert abs(found[i].confidence - sure) < 1e-6
        if found[i].accepted:
            assert found[i].language == model.languages[log.argmax()]


def test_language_keeps_columns_of_any_name(spark):
    names = ("row", "scores", "declared", "host", "suffix", "prior", "told", "heard", "posterior", "place", "sure", "of_host", "best", "__host", "__scores")
    rows = [(*r, *[f"v{i}" for i in range(len(names))]) for r in language_rows(30, 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    found = language_id.identify(d)
    assert found.columns == [*d.columns, "language", "confidence", "accepted"]
    assert all(r[n] == f"v{i}" for r in found.collect() for i, n in enumerate(names))


def test_repeated_keys_of_lines(spark):
    rows = [(1, "a long line of text"), (1, "another line\na long line of text"), (None, "another line"), (None, "its own"), (2, "its own\na lonk line of text")]
    found = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = Counter(line for r in found for line in r.text.split("\n") if line)
    assert kept == Counter(["a long line of text", "another line", "its own"])
    assert sorted((r.doc_id or 0, r.n_lines) for r in found) == [(0, 1), (0, 1), (1, 1), (1, 2), (2, 2)]
    assert sum(r.n_kept for r in line_dedup.dedup(spark.createDataFrame([(1, "ab\nac\nabcdefghij"), (2, "abcdefghiX\nb")], "doc_id bigint, text string"), shortest=5).collect()) == 4


def test_lines_that_share_a_half_make_no_variants(spark, monkeypatch):
    """Unlike lines with one head: their other halves never meet in pieces, so no character is deleted."""
    rng = random.Random(31)
    start = "the same head " * 8
    texts = [start + "".join(rng.choices("abcdefgh", k=len(start))) for _ in range(30)]
    made, plain = [], line_dedup.variant_rows
    monkeypatch.setattr(line_dedup, "variant_rows", lambda lines: made.append(plain(lines)) or made[-1])
    assert all(r.n_kept == 1 for r in line_dedup.dedup(docs_of(spark, texts)).collect())
    assert made[0].count() == 0


@pytest.mark.parametrize("keys", [(0, 1), (2**63 - 1, -(2**63))])
def test_an_edit_at_every_place_of_a_line(spark, keys):
    """Lines of all lengths around multiples of the pieces, with either of two lines first, and keys that leave a long no room."""
    rng = random.Random(32)
    base, edited = [], []
    for n in (9, 15, 16, 17, 31, 32, 33, 50):
        for p in range(n + 1):
            for kind in range(3 if p < n else 1):
                line = "".join(rng.choices("abcdefghijklmnoprstuvwé日", k=n))
                base.append(line)
                edited.append(line[:p] + ("X", "X", "")[kind] + line[p + (0, 1, 1)[kind] :])
    for first, second in ((base, edited), (edited, base)):
        rows = [(min(keys), "\n".join(first)), (max(keys), "\n".join(second))]
        found = {r.doc_id: r.n_kept for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert found == {min(keys): len(base), max(keys): 0}
