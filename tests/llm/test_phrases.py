"""Phrases, conversation tries and Jaccard groups on small tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import bits, collocations, ngram_join, prefix_trie
from tests.llm.test_words import EDGES, WORD, prose, roots_brute, table

CLASHES = ("at", "phrase", "word", "code", "c0", "n", "total", "rank", "path", "range", "own", "end", "node", "parent",
           "turns", "head", "base", "h", "t", "s1", "s2", "sig", "first", "root", "component_id", "_id", "a.b", "x`y")


def clashing(df):
    """More columns, named as the operators name theirs, or awkwardly."""
    return df.withColumns({c: F.lit(c) for c in CLASHES if c not in df.columns})


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_bits_find_every_member(spark):
    draw = random.Random(1)
    members = [draw.getrandbits(64) - (1 << 63) for _ in range(3000)] + [0, -1, 1]
    df = spark.createDataFrame([(m,) for m in members], "h long")
    for most in (bits.MAX_BITS, 1 << 10):
        found = bits.bits_of(df, "h", most)
        import numpy as np
        assert bits.has(found, np.array(members, dtype=np.int64).view(np.uint64)).all()
    others = np.array([draw.getrandbits(64) for _ in range(20000)], dtype=np.uint64)
    assert bits.has(bits.bits_of(df, "h"), others).mean() < 0.1
    assert not bits.has(bits.bits_of(df.limit(0), "h"), others).any()


# -- op 11 -------------------------------------------------------------------------------

def phrases_brute(rows, most_words=3, min_count=10, top=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


def phrase_rows():
    draw, rows = random.Random(4), [(None, None), ("en", ""), ("de", " \t. ,;"), (None, "a b c"), ("", "x y z")]
    for k in range(300):
        words = [draw.choice(("new", "york", "city", "of", "the", "é", "Über", "a.b", "end!", "x\x0by", "q\tr")) for _ in range(30)]
        rows.append((draw.choice(("en", "de", None)), draw.choice((" ", "  ")).join(words)))
    rows += [("en", "New York City " * 40), ("fr", "same " * 5000), ("long", "one two three four. " * 3000)] + [("en", rows[9][1])] * 20
    return rows


@pytest.mark.parametrize("most_words,top", [(3, 2000), (4, 7), (2, 5)])
def test_collocations(spark, most_words, top, monkeypatch):
    rows = phrase_rows()
    docs = clashing(spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string"))
    got = collocations.collocations(docs.repartition(5), most_words=most_words, top=top).collect()
    assert Counter(tuple(r) for r in got) == phrases_brute(rows, most_words, top=top)


def test_collocations_in_small_parts(monkeypatch):
    """The same relations and counts however the rows are cut."""
    import numpy as np
    import pyarrow as pa
    rows = phrase_rows()
    batch = pa.RecordBatch.from_pydict({"lang": [x or "und" for x, _ in rows], "text": [t or "" for _, t in rows]})
    every = type("B", (), {"value": np.full(8, 255, dtype=np.uint8)})

    def counts():
        found = Counter()
        relation = list(collocations._first_relation(0, every)([batch]))
        for part in collocations._count_phrases(2)(relation):
            for c0, c1, n in zip(*[part.column(i).to_pylist() for i in range(3)]):
                found[c0, c1] += n
        return found

    whole = counts()
    monkeypatch.setattr(collocations, "CHUNK", 50)
    monkeypatch.setattr(collocations, "JOINED", 7)
    monkeypatch.setattr(collocations, "HELD", 11)
    assert counts() == whole and len(whole) > 50


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "en", ".")], none.schema)).count() == 0


def test_scores_pass_64_bits(spark):
    row = spark.range(1).select(collocations._score(F.lit(3 * 10**12), F.lit(4 * 10**12), F.lit(5 * 10**12)).alias("s")).first()
    assert row.s == 10**6 * 9 * 10**24 // (20 * 10**24)


# -- op 12 -------------------------------------------------------------------------------

def turn_id(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def trie_brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, turn_id(role, text), len(text or "")))
    own = {c: [(i, n) for *_, i, n in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100 if c >= 0 else c - -(-c % 100), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(p))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids[p],
                    sum(not kids[q] for q in below), sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations():
    draw, rows = random.Random(6), []
    for c in list(range(0, 130)) + [200, 201, 350, -5, -100, -101]:
        for t in range(draw.randrange(1, 9)):
            rows.append((c, t, draw.choice(("user", "assistant", None)), draw.choice(("hi", "hello é", "", None, "why"))))
    rows += [(7, None, "user", "no number"), (7, None, "user", "no number"), (7, 2, "user", "tie"), (7, 2, "a", "tie"),
             (None, 1, "user", "lost"), (400, 0, None, None), (401, 0, "user", "x" * 5000)]
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(40) for t in range(8)]
    return rows


@pytest.mark.parametrize("range_keys", [10_000, 3, 1])
def test_trie(spark, range_keys, monkeypatch):
    rows = conversations()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = prefix_trie.conversation_trie(df.repartition(4), range_keys=range_keys).collect()
    assert Counter(tuple(r) for r in got) == trie_brute(rows)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_turnless_conversations(spark):
    rows = [(100 + k, 0, "user", "one") for k in range(12)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(tuple(r) for r in got.collect()) == trie_brute(rows)


def test_radix_tree_layouts():
    tree, keys = prefix_trie.RadixTree(), set()
    draw = random.Random(2)
    for n in (3, 12, 40, 200):
        head = bytes([n])
        keys |= {head + bytes([b]) + bytes(draw.randrange(3) for _ in range(draw.randrange(40))) for b in draw.sample(range(256), n)}
    keys |= {b"", b"\x03", b"\x28\x01\x01", b"\xc8" * 50, b"\xc8" * 30}
    for key in sorted(keys, key=lambda k: hashlib.md5(k).digest()):
        tree.insert(key, key)
    kinds, seen, stack = Counter(), [], [(tree.root, b"")]
    while stack:
        node, path = stack.pop()
        path += node.prefix
        assert node is tree.root or node.value is not None or len(node.children.items()) > 1  # paths are compressed
        if node.value is not None:
            assert node.value == path
            seen.append(path)
        if node.children:
            kinds[type(node.children).__name__, getattr(node.children, "room", 0)] += 1
            items = node.children.items()
            assert [e for e, _ in items] == sorted(e for e, _ in items)
            stack += [(child, path + bytes([e])) for e, child in items]
    assert set(seen) == keys and len(seen) == len(keys)
    assert {k for k, _ in kinds} == {"Small", "Indexed", "Direct"} and kinds["Small", 16]


# -- op 13 -------------------------------------------------------------------------------

def shingles_brute(text, size=3):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups_brute(rows, percent=90):
    sets = {k: shingles_brute(t) for k, (_, t) in enumerate(rows)}
    distinct = set(sets.values()) - {frozenset()}
    number = {s: n for n, s in enumerate(distinct)}
    linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    of = {n: s for s, n in number.items()}
    root = roots_brute(list(of), lambda a, b: linked(of[a], of[b]))
    first = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if sets[k] and i is not None:
            first[root[number[sets[k]]]].append(i)
    return Counter((i, len(sets[k]), min(first[root[number[sets[k]]]], default=None) if sets[k] else i)
                   for k, (i, _) in enumerate(rows))


def near_rows():
    draw, rows = random.Random(11), [*EDGES, (6, "Two Words"), (7, "two words"), (8, "two words more"), (9, "a b c d e f g h i j k l"),
                                     (10, "a b c d e f g h i j k l m")]
    banner = prose(99, 40)
    for g in range(10):
        base = prose(g, draw.choice((12, 30, 80, 400))).split()
        for k in range(8):
            copy = list(base)
            for _ in range(k * len(base) // 120):
                copy[draw.randrange(len(copy))] = f"X{draw.randrange(50)}"
            rows.append((100 + g * 10 + k, " ".join(copy) + (f" {banner}" if g % 2 else "")))
    chain = prose(77, 120).split()
    for k in range(12):  # neighbours are linked, the ends are not
        chain[9 * k] = f"link{k}"
        rows.append((300 + k, " ".join(chain)))
    rows += [(400 + k, prose(5, 90)) for k in range(30)] + [(None, prose(5, 90)), (None, prose(123, 50)), (500, "w " * 4000)]
    return rows


@pytest.mark.parametrize("frequent,stars,tile,rounds,share", [
    ((2, 16, 256), 4, 1_000_000, 2, 0.2), ((1, 2, 4), 2, 500, 1, 0.0), ((1, 1, 1), 0, 3000, 1, 1.0), ((2, 2, 10**9), 1, 2000, 3, 0.1)])
def test_jaccard_groups(spark, frequent, stars, tile, rounds, share, monkeypatch):
    """Pairs, triples or single tokens; few or no rounds with leaders; one tile or many; tokens counted first or not."""
    monkeypatch.setattr(ngram_join, "CELLS", 8 if rounds == 1 else 256)
    rows = near_rows()
    got = ngram_join.jaccard_groups(clashing(table(spark, rows)).repartition(6), frequent=frequent, stars=stars, tile_tokens=tile,
                                    rounds=rounds, share=share, block_sets=max(2, tile // 500))
    found = Counter(tuple(r) for r in got.collect())
    assert found == groups_brute(rows)
    assert len({c for _, _, c in found}) < len({i for i, _ in rows}) - 60


def test_jaccard_groups_of_nothing(spark):
    assert ngram_join.jaccard_groups(table(spark, [])).count() == 0
    assert Counter(tuple(r) for r in ngram_join.jaccard_groups(table(spark, EDGES)).collect()) == groups_brute(EDGES)


def test_cells_differ_by_no_more_than_the_tokens():
    import numpy as np
    draw = np.random.default_rng(6)
    for _ in range(200):
        pool = draw.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = (np.unique(draw.choice(pool, int(draw.integers(1, 900)))) for _ in range(2))
        cells = [np.frombuffer(ngram_join.cells_of(x), dtype=np.uint8).astype(int) for x in (a, b)]
        assert np.abs(cells[0] - cells[1]).sum() <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_signature():
    """For sets of all sizes and any classes of their tokens."""
    import numpy as np
    draw = np.random.default_rng(5)
    for trial in range(1500):
        n = int(draw.choice((2, 3, 5, 7, 8, 9, 12, 20, 31, 40, 64, 130, 300, 700)))
        pool = draw.integers(0, 2**63, 2 * n + 4, dtype=np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate((a[draw.random(n) > draw.choice((0.0, 0.03, 0.06))], pool[n:n + int(n * draw.choice((0, 0.03, 0.08)))])))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both < 90 * union or len(a) == both == len(b):
            continue
        kinds = dict(zip(pool.tolist(), draw.integers(1, int(draw.integers(2, 5)), len(pool)).tolist()))
        if trial % 3 == 0:
            kinds = dict.fromkeys(pool.tolist(), 3)
        for x in np.setxor1d(a, b).tolist():  # held by one of both only: alone in a table of these two
            kinds[x] = int(draw.integers(0, 2)) if trial % 2 else 0
        sigs = [ngram_join.signatures(s, np.array([kinds[x] for x in s.tolist()], dtype=np.int64)) for s in (a, b)]
        assert np.intersect1d(*sigs).size, (n, both, union)
