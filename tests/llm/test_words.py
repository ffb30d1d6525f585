"""Spelling variants, packing, collocations."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from treeline.llm import collocations, packing, variants

DOCS = "doc_id long, text string, lang string"


# -- spelling variants ---------------------------------------------------------
def plain_counts(rows):
    import re

    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def plain_variants(n, ratio=10):
    out = {}
    for w, c in n.items():
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= ratio * c else None, len(near))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return sorted((w, f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in out.items())


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_variants_equal_brute_force_on_words_of_few_letters(spark):
    rng = random.Random(3)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))): int(10 ** rng.uniform(0, 5)) for _ in range(900)}
    got = found(variants.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain_variants(n)
    assert any(g[1] and g[2] != g[1] for g in got) and max(g[4] for g in got) > 10


def test_variants_of_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice([w, w, w.upper(), w + "É", w[1:]]) for w in rng.choices(words, k=200)) + rng.choice(["", "\n12-x", "…"])) for i in range(30)]
    rows += [(None, "Ünlikely× ünlikely× Ünlikely×"), (7, None), (8, ""), (0, rows[0][1])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, word int")
    assert found(variants.variants(variants.word_counts(docs))) == plain_variants(plain_counts(rows))


def test_variants_with_equal_hashes_long_words_and_none(spark):
    n = {"a" * 3000: 1, "a" * 2999: 50, "a" * 1500 + "b" + "a" * 1499: 5, "q": 1}
    assert found(variants.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)
    assert variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    rows = [(p, w, w, c) for w, c in {"abc": 3, "abd": 9, "xyz": 4, "xy": 1}.items() for p in range(-1, len(w))]
    got = Counter()
    for wid, near, *_ in variants._run_results(rows):  # all of them under one key
        got[wid] += near
    assert got == {"abc": 1, "abd": 1, "xyz": 1, "xy": 1}
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_sections_cut_between_words(spark, monkeypatch):
    text = "abcdefgh " * 40
    monkeypatch.setattr(variants, "SECTION", 10)
    import re

    assert Counter(w for s in variants._sections(text, re.compile("[^a-z]")) for w in s.split()) == {"abcdefgh": 40}


# -- packing -------------------------------------------------------------------
LIBRARY = Tokenizer.from_file(packing.DEFAULT_TOKENIZER)
LIBRARY.encode_special_tokens = True


def texts():
    rng = random.Random(1)
    odd = ["it's  a b\x1c\x1dc \x85 d  e", "<|endoftext|> x", "'s''re '", "  \n\n  lead", "trail   ", "é́ 日本語 ½Ⅷ² _x_", "\x00\x00", "\t\tword\t", "a" * 5000]
    chars = "ab'st 1½\n\t \x1c é́.,;_ΩЖ"
    return [*odd, *("".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(400)), *(" ".join(rng.choices(["word", "Other", "é", "3"], k=rng.randint(1, 3000))) for _ in range(60))]


def test_encoder_equals_the_library(monkeypatch):
    encode = packing.Encoder(packing.load())
    for size in (1 << 20, 7):
        monkeypatch.setattr(packing, "SECTION", size)
        for t in texts():
            assert np.frombuffer(encode(t), "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t


def test_packed_pieces_fill_sequences_without_gaps(spark):
    rows = [*enumerate(texts()), (1, None), (1, None), (2, ""), (None, "x")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, length int").repartition(3)
    made = packing.pieces(docs, packing.load(), size=64)
    out = [r.asDict() for r in packing.packed(made, size=64).collect()]
    by_doc = defaultdict(list)
    for r in out:
        assert 1 <= r["length"] <= 64 and len(r["ids"]) == 4 * r["length"] and (r["piece"] == 0 or r["length"] == 64)
        by_doc[r["doc_id"]].append(r)
    for i, t in enumerate(texts()[3:], 3):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts[:-1]]]).tolist()
        assert np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").tolist() == [*LIBRARY.encode(t, add_special_tokens=False).ids, 2]
    assert len(by_doc[1]) - 2 == len(by_doc[2]) - 1 == len(by_doc[None]) == 1
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 64
    assert len(filled) <= 1.02 * sum(r["length"] for r in out) / 64 + 1
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.packed(made, size=64)).collect()}
    assert {s: len(x) for s, x in whole.items()} == {s: 4 * sum(n for _, n in own) for s, own in filled.items()}
    assert packing.packed(packing.pieces(docs.limit(0), packing.load())).count() == 0


def test_plan_is_best_fit_longest_first():
    rng = random.Random(9)
    for size in (7, 50):
        for _ in range(30):
            counts = [0, *[rng.choice([0, 0, 1, 2, rng.randint(0, 40)]) for _ in range(size)]]
            left = []
            for length in range(size, 0, -1):
                for _ in range(counts[length]):
                    fits = [x for x in left if x >= length]
                    left.remove(min(fits)) if fits else None
                    left.append((min(fits) if fits else size) - length)
            slots, used, place = packing.plan(counts, size), defaultdict(int), {}
            for (length, rank, sequence, per, offset), after in zip(slots, [*slots[1:], None], strict=True):
                to = after[1] if after and after[0] == length else counts[length]
                for nth in range(to - rank):
                    used[sequence + nth // per] += length
                    place[length, rank + nth] = (sequence + nth // per, offset + nth % per * length)
            assert sorted(size - x for x in left) == sorted(used.values())
            assert len(place) == len(set(place.values())) == sum(counts)


# -- collocations --------------------------------------------------------------
def plain_collocations(rows, least, percent=80, top=2000):
    import re

    f, n = Counter(), Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    gone = {(lang, p[i : i + k]) for (lang, p), c in f.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= percent * f[lang, p[i : i + k]]}
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in gone:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def sentences():
    rng = random.Random(2)
    words = ["of", "the", "New", "York", "City", " x", "é", "a\x00b", "Z"]
    weights = [9, 9, 3, 3, 2, 1, 1, 1, 1]
    out = []
    for i in range(300):
        text = "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "; "]) for _ in range(60))
        out.append((i, text + " new york city hall" * rng.randint(0, 3), rng.choice(["en", "en", "fr", None, "und"])))
    return [*out, out[0], (1, None, "en"), (2, "", None), (3, " . ,, ", "de")]


@pytest.mark.parametrize("bits, section", [(14, 1 << 21), (20, 50)])
def test_collocations_equal_brute_force(spark, monkeypatch, bits, section):
    rows = sentences()
    monkeypatch.setattr(collocations, "SECTION", section)
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", phrase int").repartition(3)
    for least, top in ((30, 2000), (3, 40)):
        assert found(collocations.collocations(docs, least, top=top, bits=bits)) == plain_collocations(rows, least, top=top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_sections_take_the_words_before_along(monkeypatch):
    monkeypatch.setattr(collocations, "SECTION", 12)
    text = b"one two three four five. six seven eight nine ten eleven"
    seen = []
    for words, again in collocations._sections(iter([text, b"short"]), 2):
        seen += [tuple(words[i : i + 3]) for i in range(len(words) - 2) if i + 2 >= again]
    words = text.replace(b".", b" . ").split()
    assert seen == [tuple(words[i : i + 3]) for i in range(len(words) - 2)]


def test_counts_beyond_64_bits_in_products(spark):
    a = 2**62
    df = spark.createDataFrame([(a, a, a + 7)], "a long, l long, r long")
    expr = "cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    assert df.selectExpr(f"{expr} as s").first()[0] == 2_000_000 * a // (2 * a + 7)
