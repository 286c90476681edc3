"""Each stage of the pipeline against brute force on the rows that the stage before it kept."""

from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tablewright.llm import bpe, decontaminate, quality_gam
from tests.llm.test_words import EDGES, clashing, long_line_brute, print_brute, prose, roots_brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output rows of each stage, by its name."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert sorted(after.columns) == sorted(docs.columns)
        out[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()})
        docs = after
    return out


def test_quality_stage(spark, sf, stages):
    scored = quality_gam.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"),
                                        spark.read.parquet(f"{sf}/labels.parquet")).collect()
    before, after = stages["quality"]
    assert set(after) == {r.doc_id for r in scored if r.predicted} and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_line_stage(stages):
    before, after = stages["line dedup"]
    want = {i: t for i, t, _ in long_line_brute([(r.doc_id, r.text) for r in before.values()], 50)}
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == (len(r.text) if r.text != before[i].text else before[i].n_chars) for i, r in after.items())


def test_near_copy_stage(stages):
    before, after = stages["near copies"]
    prints = {i: print_brute(r.text) for i, r in before.items()}
    root, first = roots_brute(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4), defaultdict(list)
    for i, p in prints.items():
        first[root[p]].append(i)
    assert set(after) == {min(ids) for ids in first.values()}


def test_near_copy_stage_of_repeated_ids(spark, sf):
    """Row by row: an id with two texts, equal rows, rows without an id."""
    t = {k: " ".join(f"{k}{n * n % 97}" for n in range(80)) for k in "abcdef"}
    rows = [(2, "b", 1), (5, "b", 1), (5, "a", 1), (9, "a", 1), *[(3, "c", 1)] * 5, (4, "d", 1), (4, "d", 2),
            (None, "e", 1), (None, "e", 1), (None, "f", 1), (7, "f", 1)]
    docs = spark.createDataFrame([(i, t[k], "en", "s", n) for i, k, n in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = corpus_pipeline.near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    kept = sorted(((r.text[0], r.doc_id) for r in got.collect()))
    assert kept == [("a", 5), ("b", 2), ("c", 3), ("d", 4), ("e", None), ("f", 7)]


def test_decontamination_stage(spark, sf, stages):
    before, after = stages["decontamination"]
    items = [set(decontaminate.shingles(decontaminate.terms_of(r.text)))
             for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = set()
    for i, r in before.items():
        held = decontaminate.shingles(decontaminate.terms_of(r.text))
        dirty |= {i} if any(len(s & held) >= 0.8 * len(s) for s in items if s) else set()
    assert set(after) == set(before) - dirty


def test_token_stage(stages):
    before, after = stages["token ids"]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path),
                                special_tokens={})
    assert {i: r.ids for i, r in after.items()} == {i: library.encode_ordinary(r.text) for i, r in before.items()}


def test_run_gives_the_last_stage(spark, sf, stages):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: r.ids for i, r in stages["token ids"][1].items()}


NAMED = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    texts = [*EDGES, (20, prose(1, 4000)), (21, prose(1, 4000)), (None, prose(2, 300)), (22, prose(3, 80)), (22, prose(3, 80)),
             (22, prose(4, 80)), (23, "\n".join(prose(k, 60) for k in range(4))), (24, prose(0, 60) + "\n" + prose(50, 70))]
    return clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in texts], NAMED))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, sf, name, stage):
    """NULL, empty, long and repeated texts and columns of any name: own columns come back as they were."""
    docs = odd_documents(spark)
    got = stage(spark, docs, sf)
    if name == "token ids":
        rows = got.collect()
        assert len(rows) == docs.count() and got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        assert all(r.n_tokens == len(r.ids) for r in rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
        return
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    rows = got.collect()
    kept = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert rows and all(r[c] == c for r in rows for c in kept)
    before = [(r.doc_id, r.text) for r in docs.collect()]
    after = [(r.doc_id, r.text) for r in rows]
    if name == "line dedup":
        assert sorted(map(str, after)) == sorted(str((i, t)) for i, t, _ in long_line_brute(before, 50))
    else:
        assert all(pair in before for pair in after)
    if name == "near copies":
        assert sum(t == prose(1, 4000) for _, t in after) == 1 and (22, prose(4, 80)) in after
    none = stage(spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == docs.columns


def test_lines_without_a_length_column(spark, sf):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf).collect()} == {1: "a\nb\nc", 2: ""}
