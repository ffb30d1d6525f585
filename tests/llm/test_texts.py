"""Line dedup, decontamination, html, token counts, url filters, SentencePiece."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import decontaminate, htmltext, linededup, spm, tokencounts, urlfilter


def test_lines_in_ten_documents_go(spark):
    rows = [(i, f"own {i}\n  Shared LINE\t\n\nshared line") for i in range(10)] + [(10, None), (11, ""), (12, "only")]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[3]["kept_text"] == "own 3\n" and (out[3]["n_lines"], out[3]["n_dropped"]) == (4, 2)
    assert [(out[i]["n_lines"], out[i]["n_dropped"]) for i in (10, 11, 12)] == [(1, 0)] * 3
    kept = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).where("kept_text like '%Shared%'").collect()
    assert [r["doc_id"] for r in kept] == [0]


def line_batch(spark, a, b):
    return spark.createDataFrame([(i, f"x\nb{i}") for i in range(a, b)], "doc_id long, text string")


KEY_X = hashlib.blake2b(b"x", digest_size=16).digest()


def test_line_runs_over_batches_and_compaction(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    dropped = [sum(r["n_dropped"] for r in runs.add(line_batch(spark, 4 * i, 4 * i + 4), min_docs=10).collect()) for i in range(4)]
    assert dropped == [0, 0, 4, 4]
    assert [level for level, _ in runs.runs()] == [2]
    assert {bytes(r["key"]): r["n"] for r in runs.counts().collect()}[KEY_X] == 16
    again = linededup.LineRuns(spark, runs.folder, fanout=2)
    assert {bytes(r["key"]): r["n"] for r in again.counts().collect()}[KEY_X] == 16


def test_runs_are_merged_and_probed_without_a_shuffle(spark):
    runs = linededup.LineRuns(spark, fanout=3)
    for i in range(2):
        runs.add(line_batch(spark, 4 * i, 4 * i + 4), 10).collect()
    plan = runs.counts()._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan


def test_a_stop_in_compaction_and_a_repeated_batch_count_once(spark, monkeypatch):
    runs = linededup.LineRuns(spark, fanout=2)
    runs.add(line_batch(spark, 0, 4), 10, batch="a").collect()

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(linededup.LineRuns, "_merged", stop)
    with pytest.raises(OSError):
        runs.add(line_batch(spark, 4, 8), 10, batch="b")
    monkeypatch.undo()
    count = lambda r: {bytes(x["key"]): x["n"] for x in r.counts().collect()}[KEY_X]
    again = linededup.LineRuns(spark, runs.folder, fanout=2)
    assert count(again) == 8
    monkeypatch.setattr(linededup.LineRuns, "_commit", stop)  # the merged run is written, but doesn't count
    with pytest.raises(OSError):
        again.compact()
    monkeypatch.undo()
    again = linededup.LineRuns(spark, runs.folder, fanout=2)
    again.add(line_batch(spark, 4, 8), 10, batch="b").collect()
    again.compact()
    assert count(again) == 8 and [level for level, _ in again.runs()] == [1]
    fs, path = again._fs()
    assert sum(s.getPath().getName().startswith("run-") for s in fs.listStatus(path(again.folder))) == 1


def test_new_lines_of_a_batch_stay_once(spark):
    runs = linededup.LineRuns(spark)
    kept = lambda df: sorted(r["doc_id"] for r in df.where("kept_text like 'x%'").collect())
    assert kept(runs.add(line_batch(spark, 0, 12), 10, keep_first=True)) == [0]
    assert kept(runs.add(line_batch(spark, 12, 15), 10, keep_first=True)) == []


def test_documents_count_once_and_very_common_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_SHARE", 2)
    rows = [(i % 9, "often") for i in range(40)] + [(i, f"very\nown {i}") for i in range(100, 160)] + [(None, "very\nnull"), (3, "other text\nvery")] + [(i, "ten") for i in range(200, 210)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["kept_text"] for r in got if r["text"] == "often"} == {"often"}
    assert not [r for r in got if r["doc_id"] in range(100, 160) and r["kept_text"] != f"own {r['doc_id']}"]
    assert {r["kept_text"] for r in got if r["doc_id"] is None} == {"null"} and {r["kept_text"] for r in got if r["text"] == "ten"} == {""}
    first = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=True).where("kept_text like '%very%' or kept_text = 'ten'")
    assert sorted(r["doc_id"] for r in first.collect()) == [3, 200]


def test_lines_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, "a\nb", 7, "q"), (1, "y" * 300_000 + "\n" + "z\n" * 50_000, 8, "r")], "doc_id long, text string, n_lines int, __row string").withColumn("key", F.lit(1)).withColumn("spots", F.lit("s"))
    out = linededup.dedup_lines(frame)
    assert out.columns == ["doc_id", "text", "__row", "key", "spots", "n_lines", "n_dropped", "kept_text"]
    assert sorted((r["__row"], r["n_lines"], r["kept_text"] == r["text"]) for r in out.collect()) == [("q", 2, True), ("r", 50_002, True)]
    assert linededup.dedup_lines(frame.limit(0)).collect() == []


def edits(a, b):
    """Least edits of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(5)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontaminate.myers(p, t, len(p))[0] == edits(p, t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdg" for b in "aeo" for c in ["n", "st", "rk"]]
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(6)] + [(50, None), (None, "bad"), (51, "...")]
    docs = []
    for d in range(40):
        text = " ".join(rng.choice(words) for _ in range(30))
        if d % 3 == 0:
            item = list(items[d % 6][1])
            for _ in range(d % 8):
                item[rng.randrange(len(item))] = "z"
            text = f"{text} {''.join(item).upper()}!\n{text}"
        docs.append((d, text))
    docs += [(90, None), (91, "")]
    want = set()
    for d, t in docs:
        for i, x in items:
            x, n = decontaminate.normalise(x), decontaminate.normalise(t)
            if i is not None and x and n and edits(x, n) <= int(0.05 * len(x)):
                want.add((d, i, edits(x, n)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 200):
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(frame, bench, block_chars=size).collect()} == want
        assert {r["doc_id"] for r in decontaminate.clean(frame, bench, block_chars=size).collect()} == {d for d, _ in docs} - {w[0] for w in want}
    assert decontaminate.leaks(frame, bench.limit(0)).collect() == []


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header>Site</header>
<nav><a href=/>Home</a></nav><div class="ad">Buy, now.</div><article><h1>Head &amp; line</h1><p>One
 <b>two</b>, three.<p>Four &lt;five&gt;<br>six.<aside>side</aside><div class="comments"><p>troll</p></div></article><footer>&copy; x</footer>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Head & line\n\nOne two, three.\n\nFour <five> six."
    assert htmltext.main_text("<body><div id=m><p>Words, and more words here. And on.</p></div><ul class=menu><li>a</ul>") == "Words, and more words here. And on."
    for odd in (None, "", "<", "<p", "<a href='x", "<!-- x", "<script>", "</p></p>", "<article></article>"):
        assert htmltext.main_text(odd) == ""
    assert len(htmltext.main_text("<article><p>" + "word " * 200_000)) == 999_999


def test_paths_are_scored_whatever_the_containers():
    text = [f"Paragraph {i} has some words, with marks, and a second clause. It ends here." for i in range(8)]
    body = "".join(f"<p>{t}</p>" for t in text)
    want = "\n\n".join(text)
    teaser = "<article class=card><h3>Other</h3><p>Read, too.</p></article>"
    assert all(t in htmltext.main_text(f"<body><div id=story>{body}</div>{teaser}</body>") for t in text)
    assert htmltext.main_text(f"<body><article>{body}</article><article><p>{text[0]}</p></article></body>") == f"{want}\n\n{text[0]}"
    for page in (f"<div class='content share'>{body}</div>", f"<article><div class='content share'>{body}</div></article>"):
        assert htmltext.main_text(f"<body>{page}<div class='share'><div class=comments><p>troll, no.</p></div></div></body>").startswith(want)
    assert htmltext.main_text(f"<body><article>{body}<div class=comments>{body}</div></article></body>") == want


def test_extract_query_keeps_every_row(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>a</p>")]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_flat_files_are_counted_across_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for f in range(3):
        tokens = rng.integers(0, 6, 200).astype("<u2")
        (tmp_path / f"f{f}.bin").write_bytes(tokens.tobytes())
        docs = np.split(tokens, np.flatnonzero(tokens == 5) + 1)
        want += [(f, i, len(d) - 1, True) for i, d in enumerate(docs[:-1])]
        want += [(f, len(docs) - 1, len(docs[-1]), False)] if len(docs[-1]) else []
    (tmp_path / "f9.bin").write_bytes(b"")
    got = tokencounts.counts(tokencounts.file_blocks(spark, f"file://{tmp_path}", 2, block, range_blocks=3), eod=5, chunk=4).collect()
    assert sorted((int(r["file"][-5]), r["document"], r["n_tokens"], r["closed"]) for r in got) == want


def test_a_file_that_is_no_tokens_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="aren't tokens"):
        tokencounts.file_blocks(spark, f"file://{tmp_path}", 2).collect()


def test_token_counts_of_odd_tables(spark):
    ranks = tokencounts.load_ranks()
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, "c", "z")], "doc_id long, text string, n_tokens string")
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in tokencounts.token_counts(df, ranks).collect()), key=str) == [(1, 2), (1, 2), (None, 1)]
    assert tokencounts.token_counts(df.limit(0), ranks).collect() == []


def test_token_counts_of_texts(spark):
    ranks = tokencounts.load_ranks()
    enc = tokencounts.encoding(ranks)
    rows = [(i, f"text {i} " * (i * 37 % 50)) for i in range(60)] + [(90, None), (91, "<|endoftext|>"), (92, "é漢" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = tokencounts.counts(tokencounts.flat_blocks(df, ranks, block_tokens=64), chunk=4).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == [(i, len(enc.encode_ordinary(t or ""))) for i, t in rows]


def test_digest_index_confirms_strings(tmp_path):
    path = str(tmp_path / "x.idx")
    urlfilter.DigestIndex.write(path, [("a.com/x", "block"), ("a.com/x", "allow"), ("b/y/", "allow")])
    index = urlfilter.DigestIndex(path)
    assert index.probe([b"a.com/x", b"b/y/", b"b/y", b""]) == ["block", "allow", None, None]
    urlfilter.DigestIndex.write(path, [])
    assert urlfilter.DigestIndex(path).probe([b"a"]) == [None]


def test_urls_are_judged(spark):
    rows = [(1, "http://A.Example.COM/en/7?x"), (2, "https://b.com/en/9#f"), (3, "ftp://xcom/en/"), (4, None), (5, "no scheme"), (6, "http://x.net/de"), (7, "http://org/es/?"), (8, "http://com")]
    out = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urlfilter.publish(spark, urlfilter.RULES)).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out} == {
        1: ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        2: ("b.com", "/en/9", "com/en/", "block"),
        3: ("xcom", "/en/", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("x.net", "/de", None, "allow"),
        7: ("org", "/es/", "org/es/", "block"),
        8: ("com", "", None, "allow"),
    }



def test_urls_are_judged_by_the_contracts_words(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://a.net/de/8", "http://www.example.net/de/81", "http://example.net/de/9", "http://org/es/x", "http://net/de/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = urlfilter.filter_urls(rows, urlfilter.publish(spark, urlfilter.RULES)).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in out] == [
        ("com/en/", "block"),
        ("example.com/en/7", "allow"),
        ("net/de/", "allow"),
        ("example.net/de/8", "block"),
        ("net/de/", "allow"),
        ("org/es/", "block"),
        ("net/de/", "allow"),
    ]


ODD = ["", "a", " ", "  a  b ", "\n\n x", "ééé 漢字 🎉", "<s> </s> <unk> <0x41>", "▁a▁▁b", "tab\tx\r\n", "\x00", "a" * 3000, "    indent", " ▁ ", "ordinary words, twice. ordinary words"]


def test_sentencepiece_parity_and_round_trip(spark):
    raw = spm.load(spm.DEFAULT_MODEL)
    assert spm.verify(raw, ODD) == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in spm.decode(spm.encode(df, raw), raw).collect()}
    assert out[99]["ids"] is None and out[99]["decoded"] is None and out[0]["ids"] == []
    # The model's marker can't be told from a space.
    assert all(out[i]["decoded"] == t.replace("▁", " ") for i, t in enumerate(ODD))
    checked = spm.encode_checked(df.withColumn("ids", df["doc_id"]), raw).collect()
    assert {r["doc_id"] for r in checked if not r["round_trip"]} == {i for i, t in enumerate(ODD) if "▁" in t}


def model_bytes(pieces, kind, byte_fallback=False, dummy=True, squeeze=False):
    """A model file's bytes, written field by field."""

    def number(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def field(at, value):
        if isinstance(value, float):
            return number(at << 3 | 5) + struct.pack("<f", value)
        if isinstance(value, int):
            return number(at << 3) + number(value)
        return number(at << 3 | 2) + number(len(value)) + value

    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    out += field(2, field(3, kind) + field(35, int(byte_fallback)))
    return out + field(3, field(1, b"identity") + field(3, int(dummy)) + field(4, int(squeeze)) + field(5, 1))


SPECIAL = [("<unk>", 0.0, spm.UNKNOWN), ("<s>", 0.0, spm.CONTROL), ("</s>", 0.0, spm.CONTROL)]
BYTES = [(f"<0x{i:02X}>", 0.0, spm.BYTE) for i in range(256)]
SMALL = ["▁", "a", "b", "c", "s", "<", ">", "0", "x", "4", "1", ".", "ab", "bc", "▁a", "▁ab", "abc", "ca", "<s", "aa", "▁▁"]


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("kind", [spm.UNIGRAM, spm.BPE])
@pytest.mark.parametrize("users", [[], ["cab", "ba"]])
def test_small_models_equal_the_library(kind, squeeze, fallback, users):
    # Unigram scores that no two ways to cut a text share.
    normal = [(p, -(5.0 + 0.37 * i - 2.0 * len(p) + 0.001 * i * i), spm.NORMAL) for i, p in enumerate(SMALL)]
    raw = model_bytes([*SPECIAL, *(BYTES if fallback else []), *((u, 0.0, spm.USER) for u in users), *normal], kind, fallback, True, squeeze)
    rng = random.Random(6)
    texts = ["", "<s>", "<0x41> <s></s>", "abcab", "  a  b ", "é", "aéé漢b", "\n\nab\n", "\U0010ffff1", "xcabx cab", "ab " * 500]
    texts += ["".join(rng.choice([*"abcs<>0x41. ", "é", "\n", "漢"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    assert [texts[i] for i in spm.verify(raw, texts)] == []


def test_documents_equal_the_library(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect()]
    raw = spm.load(spm.DEFAULT_MODEL)
    assert spm.verify(raw, texts) == []


def test_odd_ids_decode_as_the_library_does():
    import sentencepiece

    raw = spm.load(spm.DEFAULT_MODEL)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(2)
    lists = [[rng.randrange(300 if i % 2 else 32_000) for _ in range(rng.randint(0, 12))] for i in range(300)]
    assert spm.built(raw).decode([np.array(x, np.int32) for x in lists]) == [theirs.decode(x) for x in lists]


def test_caches_are_bounded_and_keep_what_is_used(monkeypatch):
    monkeypatch.setattr(spm.Codec, "CACHE", 8)
    raw = spm.load(spm.DEFAULT_MODEL)
    codec, whole = spm.Codec(raw), spm.built(raw)
    texts = [f"always word{i} and.so{i}" for i in range(60)]
    assert [codec.encode([t])[0].tolist() for t in texts] == [x.tolist() for x in whole.encode(texts)]
    assert all(len(x) <= 12 for x in [*codec.words, *codec.segments]) and "always" in codec.words[0] | codec.words[1]


def test_encoding_odd_tables(spark):
    raw = spm.load(spm.DEFAULT_MODEL)
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, "long word " * 100_000, 8)], "doc_id long, text string, n_tokens int")
    rows = spm.encode_checked(df, raw).collect()
    assert sorted((r["doc_id"], r["n_tokens"] == len(r["ids"]), r["round_trip"]) for r in rows) == [(1, True, True), (1, True, True), (2, True, True)]
    assert spm.encode_checked(df.limit(0), raw).collect() == []


def plain_scores(page):
    """The fused tag-path ratios by their definition, leaf by leaf, without sharing work."""
    nodes, _ = htmltext.leaves(page)
    here = [n for n in nodes if not n.text.isspace()]

    def ratio(count):
        of = lambda path: [count(n.text) for n in here if n.path == path]
        raw = [sum(of(n.path)) / len(of(n.path)) if of(n.path) else 0.0 for n in nodes]
        weights = lambda i: [(np.exp(-((i - j) ** 2) / 2) if abs(i - j) <= 2 else 0.0) for j in range(len(raw))]
        return np.array([np.average(raw, weights=weights(i)) for i in range(len(raw))])

    text, marks = ratio(lambda t: len(t.strip())), ratio(lambda t: sum(c in ".,;:!?…。，、；：！？¡¿" for c in t))
    return np.sqrt(text / (text.mean() or 1) * (0.1 + marks / (marks.mean() or 1)))


def test_path_scores_equal_their_definition(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(25).collect()] + [PAGE]
    for page in pages:
        assert np.allclose(htmltext.fused_ratios(htmltext.leaves(page)[0]), plain_scores(page))


def test_ratios_decide_where_no_container_does(monkeypatch):
    body = "".join(f"<p>Paragraph {i} has some words, with marks, and a second clause. It ends here, as it should.</p>" for i in range(8))
    page = f"<body><div><ul>{''.join(f'<li><a href=/x{i}>Topic {i}</a></li>' for i in range(12))}</ul></div><div>{body}</div><div><span>Top</span> <span>Next</span></div></body>"
    assert "Paragraph 3" in htmltext.main_text(page) and "Topic" not in htmltext.main_text(page) and "Next" not in htmltext.main_text(page)
    monkeypatch.setattr(htmltext, "fused_ratios", lambda nodes: [1.0] * len(nodes))
    assert "Topic 3" in htmltext.main_text(page) and "Next" in htmltext.main_text(page)


def test_pages_without_articles_keep_their_blocks(spark):
    # The same pages with article and main as div: measured in blocks against the text that the article holds.
    import re

    found = wanted = right = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = set(htmltext.main_text(r["html"]).split("\n\n"))
        got = set(htmltext.main_text(re.sub(r"(?i)<(/?)(?:article|main)\b", r"<\1div", r["html"])).split("\n\n"))
        found, wanted, right = found + len(got), wanted + len(want), right + len(got & want)
    precision, recall = right / found, right / wanted
    assert 2 * precision * recall / (precision + recall) >= 0.97


def article(extra):
    body = "".join(f"<p>Paragraph {i} has words, more words and an end of it.</p>" for i in range(12))
    text = htmltext.main_text(f"<html><body><nav><a>n</a></nav><article>{body}{extra}{body}</article></body></html>").split("\n\n")
    return [t for t in text if not t.startswith("Paragraph")]


@pytest.mark.parametrize(
    ("extra", "want"),
    [
        ("<table><tr><td>1</td><td>2</td></tr></table>", ["1", "2"]),
        ("<div class='article-header'><h1>Title</h1></div>", ["Title"]),
        ("<div class='share-price'><p>It rose.</p></div>", ["It rose."]),
        ("<p title='a hidden treasure'>Gold.</p>", ["Gold."]),
        ("<p>This is <span class='ad'>the</span> word.</p>", ["This is the word."]),
        ("<ul><li>One</li><li>Two</li></ul>", ["One", "Two"]),
        ("<div><a href=x>One</a> <a href=y>Two</a></div>", []),
        ("<div class='comments'><p>I like this a lot, really, I do.</p></div>", []),
        ("<div class='ad-box'>Buy now</div><span class='ad'>Buy now</span>", []),
        ("<p hidden>no</p><p style='color:red;display: none'>no</p><p aria-hidden=true>no</p>", []),
        ("<p>word and word and no mark at all</p>", ["word and word and no mark at all"]),
    ],
)
def test_what_stays_of_an_article(extra, want):
    assert article(extra) == want


def test_ratios_decide_outside_articles(monkeypatch):
    body = "".join(f"<p>Paragraph {i} has words, more words and an end of it.</p>" for i in range(12))
    page = f"<body><div>Buy this thing.</div><article>{body}</article></body>"
    assert "Buy" not in htmltext.main_text(page)
    monkeypatch.setattr(htmltext, "fused_ratios", lambda nodes: [1.0] * len(nodes))
    assert "Buy" in htmltext.main_text(page)


def test_many_open_elements_take_time_and_memory_in_proportion():
    import tracemalloc

    peaks = []
    for n in (8_000, 32_000):
        tracemalloc.start()
        assert len(htmltext.main_text("<b>x" * n)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 5 * peaks[0]


def plain_main_text(page):
    """What the module says, leaf by leaf, for pages whose names say nothing against them."""
    nodes, around = htmltext.leaves(page)
    score = plain_scores(page)
    seen = [i for i, n in enumerate(nodes) if not n.veto and n.text.strip()]
    weight = {i: score[i] * len(nodes[i].text.strip()) for i in seen}
    h = sum(w for i, w in weight.items() if nodes[i].home) / (sum(weight.values()) or 1)
    factor = lambda n: 1 + h * (not n.link) if n.home else 1 - h / 2
    mean = lambda path: np.mean([score[i] * factor(nodes[i]) for i in seen if nodes[i].path == path])
    content = {i for i, n in enumerate(nodes) if not n.veto and any(nodes[j].path == n.path for j in seen) and mean(n.path) >= 0.5}
    inside = lambda r, s: r == s or (r and inside(around[r], s))
    of = lambda r: [n for n in nodes if not n.veto and inside(n.region, r)]
    links = lambda r: sum(len(n.text.strip()) for n in of(r) if n.link) / (sum(len(n.text.strip()) for n in of(r)) or 1)
    kept = {nodes[i].region for i in content}
    for r in range(1, len(around)):
        if any(n.home and n.region == r for n in nodes) and around[r] in kept and links(r) < 0.5:
            kept.add(r)
    blocks = {nodes[i].block for i in content}
    parts = {}
    for i, n in enumerate(nodes):
        if not n.veto and (i in content or n.block in blocks or n.region in kept):
            parts.setdefault(n.block, []).append(n.text)
    import html

    return "\n\n".join(t for t in (" ".join(html.unescape("".join(p)).split()) for p in parts.values()) if t)


def test_main_text_equals_a_plain_version(spark):
    pages = [r["html"].replace('class="ad"', "") for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20).collect() if r["html"]]
    menu = "<section><div><a href=x>Menu one</a><a href=y>two</a></div><div><h2>Sub</h2></div></section>"
    pages += [p.replace("</h1>", f"</h1>{menu}") for p in pages[:5]]
    assert [htmltext.main_text(p) for p in pages] == [plain_main_text(p) for p in pages]
