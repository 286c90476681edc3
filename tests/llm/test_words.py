"""Operators on small tables: brute force, ties, NULLs, empty and long texts, repeated rows, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import line_dedup, line_rules, simhash, substring_dedup
from tablewright.llm.common import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long"


def table(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "s", None) for i, t in texts], schema)


def prose(seed, n, vocabulary=2000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def clashing(df):
    """More columns, named as the operators name theirs."""
    return df.withColumns({c: F.lit(c) for c in (
        "line", "host", "body", "fp", "starts", "score", "ids", "at", "w1", "row", "new", "place", "of", "number", "hash",
        "_body", "_edited", "_id_of_run", "_starts_of_run", "_place", "_number", "a.b", "x`y")})


EDGES = [(None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a\x0bb\x0cc d é"), (None, None)]


def test_words(spark):
    df = spark.createDataFrame([(t,) for _, t in EDGES], "text string")
    got = df.select("text", words(F.col("text")).alias("w")).collect()
    assert all(r.w == WORD.findall(r.text or "") for r in got)


# -- op 4 --------------------------------------------------------------------------------

def base_brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_base_counts(spark):
    draw = random.Random(3)
    texts = EDGES + [(10 + i, "\n".join(prose(draw.random(), draw.randrange(9), 4) for _ in range(6))) for i in range(60)]
    texts.append((99, "a " * 30000 + "#|<"))
    got = line_rules.line_rules(clashing(table(spark, texts).withColumnRenamed("source", "src")), host_col="src").collect()
    want = Counter((i, *base_brute(t)) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_common_lines_deplete(spark):
    banner = "\n".join(f"Share {prose(k, 9)} page 123" for k in range(8))
    texts = [(i, f"{banner.replace('123', str(100 + i))}\n" + prose(i, 60)) for i in range(30)]
    texts += [(100 + i, prose(1000 + i, 80)) for i in range(30)]
    got = {r.doc_id: r for r in line_rules.line_rules(table(spark, texts)).collect()}
    assert all(not got[i].base_failed and not got[i].kept and got[i].n_common_words == 96 for i in range(30))
    assert all(got[100 + i].kept and got[100 + i].n_common_words == 0 for i in range(30))


def test_copies_count_as_documents(spark):
    """Above the limits all copies go; rows that repeat an id and a text are one document."""
    texts = [(i, prose(1, 80)) for i in range(40)] + [(100, prose(2, 80))] * 40 + [(200 + i, prose(3, 80)) for i in range(20)]
    got = {r.doc_id: r for r in line_rules.line_rules(table(spark, texts)).collect()}
    assert all(not got[i].kept and got[i].n_common_words == 80 for i in range(40))
    assert got[100].kept and all(got[200 + i].kept for i in range(20))


def test_empty_tables(spark):
    none = table(spark, [])
    assert line_rules.line_rules(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0


# -- op 6 --------------------------------------------------------------------------------

def print_brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_brute(nodes, linked):
    root = {n: n for n in nodes}
    for a in nodes:
        for b in nodes:
            if linked(a, b):
                ra, rb = root[a], root[b]
                for n in nodes:
                    if root[n] in (ra, rb):
                        root[n] = min(ra, rb)
    return root


@pytest.mark.parametrize("shard_rows,mean", [(4096, 256), (3, 256), (4096, 0)])
def test_simhash_groups(spark, shard_rows, mean):
    draw, texts = random.Random(5), list(EDGES)
    for g in range(12):
        base = prose(g, 300).split()
        for k in range(5):
            copy = list(base)
            for _ in range(k * 2):
                copy[draw.randrange(300)] = "X"
            texts.append((100 + g * 10 + k, " ".join(copy)))
    got = simhash.simhash_groups(clashing(table(spark, texts)), shard_rows=shard_rows, mean=mean).collect()
    fps = {print_brute(t) for _, t in texts}
    root = roots_brute(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    first = defaultdict(list)
    for i, t in texts:
        if i is not None:
            first[root[print_brute(t)]].append(i)
    want = Counter((i, f"{print_brute(t):016x}", min(first[root[print_brute(t)]], default=None)) for i, t in texts)
    assert Counter(tuple(r) for r in got) == want
    assert len({r.component_id for r in got}) < len(fps)


def test_bk_tree_against_all_pairs():
    draw = random.Random(1)
    values = {draw.getrandbits(64) for _ in range(50)}
    values |= {v ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for v in list(values)[:30]}
    tree = simhash.BKTree(values)
    for v in values:
        assert sorted(tree.within(v, 4)) == sorted(o for o in values if (o ^ v).bit_count() <= 4)


def test_fingerprint_hash_is_xxh64(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c é"))).first()[0] & (1 << 64) - 1
    assert got == xxhash.xxh64_intdigest("a b c é".encode(), 42)


# -- op 7 --------------------------------------------------------------------------------

def line_brute(texts, run=3):
    places, owners = {}, []
    for row, (i, t) in enumerate(texts):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if WORD.search(x)]
        for s in range(len(at) - run + 1):
            if i is not None:
                key = tuple(lines[k].strip(" ") for k in at[s:s + run])
                owners.append((key, (i, s), row, at[s:s + run]))
                places[key] = min(places.get(key, (i, s)), (i, s))
    gone = defaultdict(set)
    for key, place, row, at in owners:
        if place > places[key]:
            gone[row].update(at)
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[row]),
             len(gone[row])) for row, (i, t) in enumerate(texts)]


def test_line_dedup(spark):
    draw = random.Random(8)
    pool = [prose(k, 4) for k in range(12)] + ["", "  ", " padded "]
    texts = EDGES + [(20 + i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(12)))) for i in range(80)]
    texts += [(7, "\n".join(pool) + "\n" + "\n".join(pool)), (300, "same\n" * 500)]
    got = line_dedup.line_dedup(clashing(table(spark, texts)), least_words=None).collect()
    assert Counter((r.doc_id, r.text, r._n_removed) for r in got) == Counter(line_brute(texts))
    assert all(got[0][c] == c for c in ("line", "starts", "_body", "_edited", "_id_of_run", "row", "a.b", "x`y"))


def long_line_brute(texts, least_words, run=3):
    """Runs of `run` lines, and shorter ones of `least_words` words."""
    places, owners = {}, []
    for row, (i, t) in enumerate(texts):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if WORD.search(x)]
        for size in range(1, run + 1):
            for s in range(len(at) - size + 1):
                key = tuple(lines[k].strip(" ") for k in at[s:s + size])
                if i is not None and (size == run or sum(len(WORD.findall(x)) for x in key) >= least_words):
                    owners.append((key, (i, s), row, at[s:s + size]))
                    places[key] = min(places.get(key, (i, s)), (i, s))
    gone = defaultdict(set)
    for key, place, row, at in owners:
        gone[row] |= set(at) if place > places[key] else set()
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[row]),
             len(gone[row])) for row, (i, t) in enumerate(texts)]


def test_line_dedup_of_long_lines(spark):
    draw, one, two = random.Random(9), prose(1, 60), f"{prose(2, 30)}\n\n{prose(3, 20)}"
    texts = [*EDGES, (10, one), (11, one), (12, f"own\n{one}\nwords"), (13, two), (14, f"{two}\nend"), (15, prose(4, 49)),
             (16, prose(4, 49)), (17, f"{prose(5, 50)}\n{prose(6, 3)}"), (18, f"{prose(5, 50)}\n{prose(6, 3)}"), (None, one)]
    pool = [prose(20 + k, draw.choice((5, 24, 26, 50))) for k in range(9)] + [""]
    texts += [(30 + i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(6)))) for i in range(60)]
    got = line_dedup.line_dedup(clashing(table(spark, texts))).collect()
    assert Counter((r.doc_id, r.text, r._n_removed) for r in got) == Counter(long_line_brute(texts, 50))
    kept = {r.doc_id: r.text for r in got}
    assert (kept[10], kept[11], kept[12]) == (one, "", "own\nwords")
    assert kept[14] == "\nend" and kept[16] == prose(4, 49) and kept[18] == ""


def test_minima_are_in_every_shared_run(spark):
    """Selected lines thin out, and each run that counts holds one wherever it stands."""
    draw = random.Random(12)
    shared = "\n".join(prose(k, draw.choice((3, 60))) for k in range(40))
    texts = [(k, f"{prose(100 + k, 5)}\n" * draw.randrange(4) + shared + f"\n{prose(200 + k, 4)}" * draw.randrange(4)) for k in range(6)]
    rows = table(spark, texts).withColumn("body", F.lit(0).cast("long"))
    found = defaultdict(set)
    for r in line_dedup.fingerprints(rows, 4, None).collect():
        found[r.doc_id].add(r.fingerprint)
    lines = [r.h for r in spark.createDataFrame([(x,) for x in shared.split("\n")], "x string").select(F.xxhash64("x").alias("h")).collect()]
    common = set.intersection(*found.values())
    assert all(common & set(lines[k:k + 4]) for k in range(37)) and len(common & set(lines)) < 30


def test_count_column_gives_way(spark):
    df = table(spark, [(1, "a\nb\nc"), (2, "a\nb\nc")]).withColumn("_n_removed", F.lit("mine"))
    got = {r.doc_id: r._n_removed for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: 0, 2: 3}


# -- op 9 --------------------------------------------------------------------------------

def substring_brute(texts):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in texts]
    for i, w in split:
        for s in range(len(w) - 49):
            if i is not None:
                key = tuple(w[s:s + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {s + k for s in range(len(w) - 49) if i is not None and first[tuple(w[s:s + 50])] < i for k in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("max_cells", [substring_dedup.MAX_CELLS, 1 << 16])
def test_substring_dedup(spark, max_cells, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MIN_CELLS", 1 << 16)
    passage, other = prose(1, 60), prose(2, 50)
    texts = EDGES + [(10 + i, f"{prose(50 + i, 30)} {passage} {prose(90 + i, 40)}") for i in range(15)]
    texts += [(40, other), (41, f"x {other}"), (42, prose(2, 49)), (43, "same " * 400), (44, "same " * 300),
              (45, "same " * 49), (46, passage + "\n\t" + passage), (46, prose(7, 90)), (46, prose(7, 90)),
              (47, prose(7, 90)), (None, prose(7, 90)), (30, prose(9, 3000)), (31, prose(9, 3000))]
    got = substring_dedup.substring_dedup(clashing(table(spark, texts)), max_cells=max_cells).collect()
    assert Counter(tuple(r) for r in got) == Counter(substring_brute(texts))


def test_digest_of_kept_words(spark):
    got = substring_dedup.substring_dedup(table(spark, [(1, " a  b\n")])).select(F.sha2("kept_text", 256)).first()[0]
    assert got == hashlib.sha256(b"a b").hexdigest()
