"""Quality model, decontamination, token counts, WARC, page text and BPE on small tables."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, extract, quality_gam, token_counts, warc
from tests.llm.test_words import EDGES, clashing, prose, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# -- op 1 --------------------------------------------------------------------------------

def test_model_learns_steps_and_interactions():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert any(set(p[:2]) == {0, 1} for p in model.pairs)


def test_model_without_labels_is_constant():
    assert quality_gam.fit(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, 0), (5, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    texts = [(i, ("GOOD " if i % 2 else "bad | ") * 20 + prose(i, 40)) for i in range(100)] + EDGES
    got = quality_gam.quality_scores(clashing(table(spark, texts)), labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = labels.limit(0)
    assert {r.score for r in quality_gam.quality_scores(table(spark, texts), none).collect()} == {0.5}
    assert quality_gam.quality_scores(table(spark, []), labels).count() == 0
    assert quality_gam.keep_good(table(spark, texts), none).count() == len(texts)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_gam.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_rows_that_reach_the_driver_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y: seen.append(x))
    width, sample = len(quality_gam.FEATURES), spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, label double")
    same = [(1, [0.5] * width)] * 900 + [(2, [0.1] * width)]
    other = [(1, [float(k)] * width) for k in range(3000)]
    for rows in (same, same + other):
        measured = spark.createDataFrame(rows, "doc_id long, features array<double>")
        quality_gam.train(measured, sample, 300)
    assert len(seen[0]) == 2 and 200 < len(seen[1]) < 400


# -- op 2 --------------------------------------------------------------------------------

ITEMS = [(k, f"What is {prose(k, 14, 300)}?\nIt is {prose(100 + k, 8, 300)}.") for k in range(60)]


def test_wand_finds_what_scoring_all_items_finds():
    index = decontaminate.build_index(ITEMS)
    draw = random.Random(2)
    for trial in range(200):
        words = decontaminate.terms_of(ITEMS[trial % 60][1])
        query = sorted({index.terms[w] for w in draw.sample(words, draw.randrange(1, len(words)))}
                       | set(draw.sample(range(len(index.terms)), 10)))
        share = np.zeros(len(index.ids))
        for t in query:
            share[index.items[t]] += index.shares[t]
        for threshold in (0.05, 0.2, 0.6):
            got = decontaminate.wand(index, query, threshold)
            assert sorted(i for i, _ in got) == np.flatnonzero(share >= threshold - 1e-9).tolist()
            assert all(abs(s - share[i]) < 1e-9 for i, s in got)


@pytest.mark.parametrize("most_chars", [decontaminate.INDEX_CHARS, 1500])
def test_contaminated(spark, most_chars):
    bench = spark.createDataFrame(ITEMS + [(90, None), (91, ""), (None, "?!")], "item_id long, text string")
    texts = [(i, f"{prose(500 + i, i * 7, 300)} {ITEMS[i][1].upper()} {prose(600 + i, 50, 300)}") for i in range(40)]
    texts += [(100 + i, prose(700 + i, 400, 300)) for i in range(20)]
    texts += [(200, ITEMS[3][1].split("\n")[0]), (201, "**" + ITEMS[4][1].replace(" ", " * ")), *EDGES]
    near = ITEMS[5][1].split()
    texts.append((202, f"{prose(1, 30)} {' '.join([*near[:1], 'other', *near[2:]])}"))  # one word of 26 differs
    got = decontaminate.contaminated(clashing(table(spark, texts)), bench, most_chars=most_chars).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(40)} | {(201, 4), (202, 5)}
    kept = decontaminate.decontaminate(clashing(table(spark, texts)), bench, most_chars=most_chars)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(
        i or -1 for i, _ in texts if i not in (*range(40), 201, 202) or (i, _) in EDGES)
    assert decontaminate.contaminated(table(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0


def test_parts_change_nothing(spark):
    """Shares and rows are the same for one index and for many; copies of an item are one text with several ids."""
    copies = [*ITEMS, *[(1000 + k, ITEMS[k % 3][1]) for k in range(30)]]
    bench = spark.createDataFrame(copies, "item_id long, text string")
    texts = [(i, f"{prose(500 + i, i * 7, 300)} {ITEMS[i][1]} {prose(600 + i, 50, 300)}") for i in range(12)]
    chars = sum(len(t) for t in {t for _, t in ITEMS})
    found = [sorted(map(tuple, decontaminate.contaminated(table(spark, texts), bench, most_chars=-(-chars // parts)).collect()))
             for parts in (1, 2, 7)]
    assert found[0] == found[1] == found[2]
    assert {(i, j) for i, j, *_ in found[0]} == {(i, i) for i in range(12)} | {(k % 3, 1000 + k) for k in range(30)}


def test_prefilter_loses_nothing():
    index = decontaminate.build_index(ITEMS)
    for k, text in ITEMS:
        for before in (0, 1, 31, 32, 33, 63, 500):
            assert decontaminate.leaks(index, f"{prose(k, before, 300)} {text} {prose(k, 9, 300)}"), (k, before)


# -- op 3 --------------------------------------------------------------------------------

def greedy(word, pieces):
    n, left = 0, (*word.encode(), token_counts.END)
    while left:
        size = next((s for s in range(len(left), 0, -1) if left[:s] in pieces), 0)
        if not size:
            return n if left == (token_counts.END,) and n else 1
        n, left = n + 1, left[size:]
    return n


def test_automaton_is_greedy_longest_match():
    draw = random.Random(4)
    for _ in range(60):
        pieces = {tuple(draw.choice(b"abc") for _ in range(draw.randrange(1, 6))) for _ in range(draw.randrange(1, 14))}
        pieces |= {p + (token_counts.END,) for p in list(pieces)[:draw.randrange(5)]}
        automaton = token_counts.Automaton(list(pieces))
        for _ in range(80):
            word = "".join(draw.choice("abcd") for _ in range(draw.randrange(1, 14)))
            assert automaton.count(word.encode()) == greedy(word, pieces), (word, pieces)


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = set(token_counts.load_vocabulary(path))
    texts = EDGES + [(9, "Über don't 12 naïve x \U0001f600 " + prose(1, 50) + "ab" * 3000)]
    got = token_counts.token_counts(clashing(table(spark, texts)), path).collect()
    import regex
    for r, (i, t) in zip(got, texts):
        found = regex.findall(token_counts.WORD, (t or "").lower())
        assert (r.n_words, r.n_tokens) == (len(found), sum(greedy(w, pieces) for w in found))
    assert token_counts.token_counts(table(spark, []), path).count() == 0


# -- op 5 --------------------------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    draw = random.Random(6)
    same, noise = prose(1, 60), "".join(chr(draw.randrange(32, 0x2000)) for _ in range(20000))
    rows = [(k, f"http://x/{k}\r\nX: y", same) for k in (5, 3, 9)] + [
        (10, None, None), (11, "u", ""), (12, "u", "short"), (13, "u", "short"), (14, "u", noise), (15, "u", noise),
        (16, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + "\x1f" * 300), (None, "n", same), (17, "u", "z" * 5000),
        (17, "u", "z" * 5000)]
    warc.write_warc(clashing(pages(spark, rows)).repartition(2), f"{tmp_path}/a")
    for size in (257, 4096, warc.RANGE_BYTES):
        got = warc.read_warc(spark, f"{tmp_path}/a", size).collect()
        assert len(got) == len(rows)
        by = {r.record_id: r for r in got}
        for page_id, _, html in rows:
            r, payload = by[f"urn:x-page:{'' if page_id is None else page_id}"], (html or "").encode()
            first = {same: 3, noise: 14}.get(html)
            revisit = first is not None and page_id != first
            assert r.warc_type == ("revisit" if revisit else "response")
            assert r.refers_to == (f"urn:x-page:{first}" if revisit else None)
            assert r.payload_digest == "sha256:" + hashlib.sha256(payload).hexdigest()
            assert r.http_length == len(payload) and bytes(r.payload) == (b"" if revisit else payload)


def test_warc_ids_of_any_characters(spark, tmp_path):
    ids = ["a:b", "line\r\nX: y", "é 100%", "urn:x-page:1", "+", "plain"]
    rows = spark.createDataFrame([(i, "u", f"{i} " * 60) for i in ids] + [(None, "u", "n" * 200)], "page_id string, url string, html string")
    warc.write_warc(rows, f"{tmp_path}/a")
    got = warc.read_warc(spark, f"{tmp_path}/a").select(warc.page_of(F.col("record_id"), "string").alias("i"), "payload").collect()
    assert {r.i: bytes(r.payload).decode() for r in got} == {**{i: f"{i} " * 60 for i in ids}, None: "n" * 200}


def test_warc_of_large_and_no_records(spark, tmp_path):
    warc.write_warc(pages(spark, [(1, "u", "é" * (9 << 20)), (2, "u", "x")]).coalesce(1), f"{tmp_path}/a")
    got = {r.record_id: len(r.payload) for r in warc.read_warc(spark, f"{tmp_path}/a").collect()}
    assert got == {"urn:x-page:1": 18 << 20, "urn:x-page:2": 1}
    warc.write_warc(pages(spark, []), f"{tmp_path}/b")
    assert warc.read_warc(spark, f"{tmp_path}/b").count() == 0


def test_reader_passes_over_false_members(tmp_path):
    good = warc._member(warc.record("urn:x-page:1", "u", b"p" * 500, "d", 500, None))
    broken = bytearray(good)
    broken[-5] ^= 1
    data = warc.MAGIC * 3 + bytes(broken) + warc._member(b"no record") + good + good[:-9] + good + b"\x1f\x8b"
    (tmp_path / "x.warc.gz").write_bytes(data)
    for size in (7, 100, 1 << 20):
        found = [r for a in range(0, len(data), size) for r in warc.records_of_range(
            f"{tmp_path}/x.warc.gz", len(data), a, min(a + size, len(data)))]
        assert [r["payload"] for r in found] == [b"p" * 500] * 2


# -- op 8 --------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header><h1>Site name here</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class='ad banner'>Buy now</div>
%s<h1>Head &amp; title</h1><p>First <b>bold</b> word<br>next&nbsp;line   here.<p>Second &lt;p&gt; a < b
<aside>An aside text</aside><form><label>Mail</label><input name="x>y"></form>
<p>Third <a href="/x">with link</a> end.</p><div class="share">Share this</div><ul><li>one<li>two</ul>
<section id="comments"><p>A reader says many things about this</p></section>%s
<div id="sidebar">More to read in other places</div><footer>&copy; 2024</footer></body></html>"""
BLOCKS = ["Head & title", "First bold word next line here.", "Second <p> a < b", "Third with link end.", "one", "two"]


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main class='content'>", "</main>"), ("<div>", "</div>")])
def test_extract(around):
    for weights in (extract.DEFAULT_WEIGHTS, extract.weights_from(extract.labelled_counts(PAGE % ("<article>", "</article>")))):
        assert extract.extract(PAGE % around, weights) == "\n\n".join(BLOCKS)


def test_extract_edges(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "plain words only"), (2, "u", "<p>a<p>b"), (3, "u", "<"),
            (4, "u", "<script>x"), (5, "u", "<p " + '"' * 3000), (6, "u", "<article>" + "<p>w x y</p>" * 5000),
            (7, "u", "<!-- open"), (8, "u", "<article>cut off &amp")]
    got = {(r.page_id, r.url, r.text): r.n_chars for r in extract.extract_pages(clashing(pages(spark, rows))).collect()}
    assert got == {(i, u, t): len(t) for i, u, t in [
        (1, None, ""), (None, "u", ""), (2, "u", "plain words only"), (2, "u", "a\n\nb"), (3, "u", "<"), (4, "u", ""),
        (5, "u", ""), (6, "u", "\n\n".join(["w x y"] * 5000)), (7, "u", ""), (8, "u", "cut off &")]}
    assert extract.extract_pages(pages(spark, [])).count() == 0


def unmarked(page):
    """The page without its article marks and class names."""
    page = re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*')""", "", page)


def test_regions_of_unmarked_pages(spark, sf):
    """By the looks of blocks alone the scan finds the articles whose marks were taken away, and not the whole page."""
    every = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    weights = extract.learn_weights(every.filter("page_id % 2 = 0"))
    found = [r.html for r in every.filter("page_id % 2 = 1").collect() if r.html]
    equal = cut = 0
    for page in found:
        plain = unmarked(page)
        got = extract.extract(plain, weights)
        equal += got == extract.extract(page, weights)
        cut += len(extract.region(plain, weights)) < len(list(extract.tokens(plain)))
    assert not any("<article" in unmarked(p) for p in found)
    assert equal >= 0.9 * len(found) and cut == len(found)
    body = " ".join(f"word{i}" for i in range(180))
    page = f"<html><body><div>Site A Home World Sport Money</div><div>{body}.</div><div>Most read teaser</div></body></html>"
    assert extract.extract(page, weights) == f"{body}."
    assert extract.extract(page, extract.DEFAULT_WEIGHTS) != f"{body}."


def test_the_scan_decides(spark, sf):
    """Weights of looks turned round give other regions on the same pages."""
    every = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    pages_ = [unmarked(r.html) for r in every.collect() if r.html]
    weights = extract.learn_weights(every)
    turned = {k: -v if " " in k and not k.startswith("plain") else v for k, v in weights.items()}
    assert sum(extract.extract(p, weights) != extract.extract(p, turned) for p in pages_) > 0.9 * len(pages_)


def test_rare_names_are_counted_together(spark):
    rows = [(k, "u", f"<p>a b c<x-{k}>d</x-{k}><article><p>{'w ' * 40}<y-{k}>z</y-{k}></article>") for k in range(60)]
    weights = extract.learn_weights(pages(spark, rows), rare_share=0.002)
    assert f"<{extract.RARE}>" in weights and not any(name.startswith("<x-") for name in weights)
    assert any(name.startswith("<x-") for name in extract.learn_weights(pages(spark, rows)))


# -- op 10 -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS),
                             special_tokens={})


@pytest.mark.parametrize("most", [0, 20, bpe.FREQUENT])
def test_bpe(spark, library, most):
    draw = random.Random(9)
    odd = ["  two  spaces ", "tab\t x \n\n  y", "a  b c 　", "don't I'LL 's 12x", "\U0001f600é" * 50,
           "<|endoftext|>", "x" * 5000, " " * 300 + "end ", "\n", "é" * 3000]
    odd += ["".join(draw.choice("ab é\n\t1'.s ") for _ in range(200)) for _ in range(20)]
    texts = EDGES + list(enumerate(odd, 100))
    coded = bpe.encode(clashing(table(spark, texts)), RANKS, public_tokenizers.PATTERN, most=most)
    got = coded.select("doc_id", "ids", bpe.decode(F.col("ids"), RANKS).alias("decoded")).collect()
    assert [(r.doc_id, r.ids) for r in got] == [(i, library.encode_ordinary(t or "")) for i, t in texts]
    assert [bytes(r.decoded).decode() for r in got] == [t or "" for _, t in texts]
    assert bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_plan_does_not_print_the_ranks(spark, library):
    """The driver keeps the text of a plan and of each of its changes: the rank map stays out of it."""
    words = spark.createDataFrame([("the",), (" encyclopaedias",), ("é",)], "word string").repartition(2)
    coded = bpe.encode_words(words, bpe.Ranks(bpe.load_ranks(RANKS)))
    assert all(r.ids == library.encode_ordinary(r.word) for r in coded.collect())
    plan = coded._jdf.queryExecution()
    plan.executedPlan()
    assert len(plan.toString()) < 100_000
    assert plan.optimizedPlan().toString().count("Project") < 3  # the map is no column of the words


def test_frequent_words_are_counted_over_every_text(spark):
    """A word that stands twice in a text, and nowhere else, is found whatever the text's hash is."""
    names = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(100, 164)]
    texts = [(k, f"x {name} y {name} z  {name}!") for k, name in enumerate(names)]
    found = bpe.frequent_words(table(spark, texts), public_tokenizers.PATTERN)
    assert {f" {name}" for name in names} <= {r.word for r in found.collect()}


def test_chunks_are_counted_as_the_pattern_finds_words(monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab é\n\t1'.s  \x1c\x85　") for _ in range(60)) for _ in range(200)] + ["", " ", "a", "a b", "a b "]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None], pa.string())], names=["text"])
    cut, true = regex.compile(public_tokenizers.PATTERN), Counter()
    for text in texts:
        true.update(w for w in cut.findall(text) if len(w.encode()) <= bpe.FREQUENT_BYTES)
    for held, size in ((bpe.HELD, bpe.ROUND_BYTES), (50, 300)):
        monkeypatch.setattr(bpe, "HELD", held)
        monkeypatch.setattr(bpe, "ROUND_BYTES", size)
        found = Counter()
        for part in bpe._count_words(public_tokenizers.PATTERN)(iter([batch, batch.slice(0, 0)])):
            for row in part.to_pylist():
                found[row["word"]] += row["n"]
        assert found == true


def test_rank_file_is_read_as_given(tmp_path):
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(bytes([k])) + b" %d\n" % k for k in range(3)) + b"\n")
    assert bpe.load_ranks(f"{tmp_path}/r") == {bytes([k]): k for k in range(3)}


def test_vocabulary_without_special_tokens(tmp_path):
    data = {"added_tokens": [{"content": "<s>", "special": True}], "model": {"vocab": {"<s>": 0, "a</w>": 1, "Ġ": 2}}}
    (tmp_path / "v").write_text(json.dumps(data))
    assert token_counts.load_vocabulary(f"{tmp_path}/v") == [(97, token_counts.END), (32,)]
