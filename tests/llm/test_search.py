"""Decontamination, SimHash and line chunks against plain versions."""

import hashlib
import random
import re

import pytest
import xxhash

from lectern.llm import components, line_chunks
from lectern.llm import decontaminate as d
from lectern.llm import simhash as s

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_hits(docs, items, n=10):
    out = []
    for i, text in docs:
        words, hit, found = WORD.findall(lowered(text)), set(), set()
        for item, own in items:
            ws = WORD.findall(lowered(own))
            for k in range(max(1, len(ws) - n + 1) if ws else 0):
                w = ws[k : k + n]
                for j in range(len(words) - len(w) + 1):
                    if words[j : j + len(w)] == w:
                        hit |= set(range(j, j + len(w)))
                        found.add(str(item))
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    dice = random.Random(3)
    vocabulary = "a b c d e f g h É-x 12 z's".split()
    text = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((14, 3, 10, 11, 30, 0, 25))] + [(100, None), (8, "Only, here!"), (9, "Only, here!")]
    docs = [(k, text(dice.choice((0, 5, 40, 200)))) for k in range(40)]
    docs += [(50, "x " + items[0][1].upper() + " y"), (51, None), (52, "only -- HERE"), (52, "only -- HERE"), (None, items[4][1])]
    return docs, items


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_hits(spark, case, block):
    docs, items = case
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in d.hit_digests(d.find_hits(a, b, block_bytes=block)).collect()), key=str)
    assert got == plain_hits(docs, items)
    kept = d.remove_documents(a, b, block_bytes=block).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in a.collect() if not plain_hits([tuple(r)], items)[0][5])
    cut = {r.doc_id: r.text for r in d.remove_spans(a, b, block_bytes=block).collect()}
    assert cut[50].split()[0] == "x" and cut[52] == "" and cut[51] is None
    assert d.find_hits(a.limit(0), b).collect() == []
    assert {r.contaminated for r in d.hit_digests(d.find_hits(a, b.limit(0))).collect()} == {False}


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (id, fingerprint)"""
    fps, root = sorted({f for _, f in rows}), {}
    for f in fps:
        root[f] = f

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        least[find(f)] = min(least.get(find(f), i), i)
    return sorted((i, f"{f:016x}", least[find(f)]) for i, f in rows)


def test_simhash_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "ONE two"), (1004, "ONE two"), (1005, "ein")]
    got = sorted(tuple(r) for r in s.digests(s.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))).collect())
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t in docs])
    kept = s.drop_near_duplicates(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, fp int"), width=3, tables=1)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got}) and kept.columns == ["doc_id", "text", "fp"]
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("small", [64, 3, 1])
def test_links_find_every_neighbour(spark, small):
    dice = random.Random(small)
    fps = set()
    for _ in range(6):  # crowds around a centre, and chains
        x = dice.getrandbits(64)
        fps |= {x ^ (1 << dice.randrange(64)) ^ (1 << dice.randrange(64)) for _ in range(40)} | {x}
        for _ in range(15):
            x ^= (1 << dice.randrange(64)) | (1 << dice.randrange(64))
            fps.add(x)
    fps |= {0, 2**64 - 1, 2**63, 3, 7, 15}
    rows = list(enumerate(sorted(fps)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for _, f in rows], "fp long")
    links = s.links(df, small)
    assert all((a ^ b).bit_count() <= 2 if (a >= 0) == (b >= 0) else ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links.collect())
    roots = {r.node: r.root for r in components.connected(links).collect()}
    got = {}
    for i, f in rows:
        got.setdefault(roots.get(signed(f), signed(f)), []).append(i)
    want = {}
    for i, _, c in plain_components(rows):
        want.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 202), (200, 202)]
    roots = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(61)} == {0} and {roots[100 + k] for k in range(50)} == {100} and roots[202] == 200
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def xx(*longs):
    """Spark's hash of an array of longs: each with the one before as the seed."""
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_chunks(text, least=2):
    """Cuts behind local minima of the rolling hashes over two line hashes."""
    lines = (text or "").split("\n")
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    rolling = [signed(xx(hashes[i - 1] if i else 0, hashes[i])) for i in range(len(lines))]
    out, start = [], 0
    for end in range(1, len(lines) + 1):
        before, behind = rolling[max(0, end - least) : end - 1], rolling[end : end + least - 1]
        least_here = all(rolling[end - 1] < x for x in before) and all(rolling[end - 1] <= x for x in behind)
        if end == len(lines) or least <= end <= len(lines) - least and least_here:
            out.append(lines[start:end])
            start = end
    return out


def plain_removal(docs, least=2):
    """(doc_id, removed chunks, remaining text) of each row: the first of equal chunks of two lines or more stays."""
    hashed = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42)) if t is not None else 42
    seen, out = set(), []
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0], hashed(docs[k][1]), k)):
        kept, gone = [], 0
        for c in plain_chunks(docs[k][1], least):
            if len(c) >= least and tuple(c) in seen:
                gone += 1
            else:
                kept += c
            if len(c) >= least:
                seen.add(tuple(c))
        out.append((docs[k][0], gone, "\n".join(kept) if gone else docs[k][1]))
    return sorted(out, key=str)


def line_corpus(seed, n):
    dice = random.Random(seed)
    shared = [[f"shared {k} {j}" for j in range(14)] for k in range(3)]
    docs = []
    for i in range(n):
        lines = [f"own {i} {j}" for j in range(dice.randrange(0, 6))]
        if dice.random() < 0.6:
            block = shared[dice.randrange(3)]
            lines += block[dice.randrange(4) : 14 - dice.randrange(4)]
        docs.append((i, "\n".join([*lines, *(f"tail {i} {j}" for j in range(dice.randrange(3)))])))
    docs += [(1000, None), (1001, ""), (5, docs[5][1]), (1002, "a\n\n\na\n\n\na"), (1003, docs[7][1]), (1004, "a line"), (1005, "a line"), (5, docs[5][1]), (5, docs[6][1])]
    return docs


@pytest.mark.parametrize("least", [2, 3])
def test_line_chunks(spark, least):
    docs = line_corpus(5, 500)
    got = line_chunks.drop_repeated_chunks(spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_chunks string").repartition(3), least_lines=least)
    assert got.columns == ["doc_id", "text", "n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    rows = sorted(((r.doc_id, r.removed_chunks, r.text) for r in got.collect()), key=str)
    assert rows == plain_removal(docs, least)
    assert sum(r[1] for r in rows) > 300
    assert line_chunks.drop_repeated_chunks(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_line_chunks_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(line_chunks, "hash_of", lambda c: line_chunks.F.pmod(line_chunks.F.xxhash64(c), line_chunks.F.lit(7)))
    docs = line_corpus(6, 60)
    got = line_chunks.drop_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.removed_chunks, r.text) for r in got.collect()), key=str) == plain_removal(docs)


def test_equal_rows_of_one_text_keep_it_once(spark):
    """Thousands of equal rows, with maps and unlike columns beside them."""
    text = "one line\nand another\nand a third\nand more"
    rows = [(1, text, {"a": k % 3}, k % 2) for k in range(3000)] + [(2, text, None, 0)]
    got = line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, k int"))
    found = [(r.doc_id, tuple((r.m or {}).items()), r.k, r.text) for r in got.collect()]
    assert sorted((str(x[:3]) for x in found)) == sorted(str((a, tuple((m or {}).items()), k)) for a, _, m, k in rows)
    assert [t for *_, t in found if t] == [text] and next(x for x in found if x[3])[0] == 1


def test_line_chunks_leave_nothing_of_a_copy(spark):
    dice = random.Random(8)
    texts = ["\n".join(f"line {i} {dice.random()}" for _ in range(n)) for i, n in enumerate([1, 2, 3, 4, 5, 9, 30] * 6)]
    passage = "\n".join(f"passage {j}" for j in range(40))
    docs = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts)] + [(2000 + k, f"a {k}\n{passage}\nb {k}\nc {k}") for k in range(5)] + [(3000, None), (3001, ""), (3002, ""), (3003, "\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    queries_cut = line_chunks.drop_repeated_chunks(df)
    by = {r.doc_id: r for r in queries_cut.collect()}
    assert len(by) == len(docs)
    for i, t in enumerate(texts):
        n = t.count("\n") + 1
        assert by[i].text == t and (by[1000 + i].text, by[1000 + i].removed_lines) == (("", n) if n > 1 else (t, 0))
    assert all(by[2000 + k].removed_lines >= 30 and f"a {k}" in by[2000 + k].text for k in range(1, 5)) and by[2000].removed_lines == 0
    assert by[3000].text is None and by[3000].removed_chunks == by[3002].removed_chunks == 0
    cut = df.select("text", line_chunks.chunks_of(line_chunks.F.coalesce("text", line_chunks.F.lit(""))).alias("c")).collect()
    for r in cut:
        assert "\n".join(c.chunk for c in r.c) == (r.text or "") and sum(c.n_lines for c in r.c) == (r.text or "").count("\n") + 1
        assert len(r.c) == 1 or min(c.n_lines for c in r.c) >= 2


def test_one_row_of_every_component_stays(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    # components without any id, and two texts under one id of which one repeats a smaller id's
    docs = [(None, text(1)), (None, text(1)), (None, text(2)), (None, text(3)), (4, text(3)), (5, text(5)), (7, text(5)), (7, text(7)), (8, text(8)), (8, text(8)), (9, text(8))]
    df = spark.createDataFrame([(*d, "a") for d in docs], "doc_id long, text string, source string")
    kept = [tuple(r) for r in s.drop_near_duplicates(df).collect()]
    want = [(None, text(1)), (None, text(2)), (4, text(3)), (5, text(5)), (7, text(7)), (8, text(8))]
    assert sorted(kept, key=str) == sorted(((*w, "a") for w in want), key=str)


def test_the_stage_finds_planted_near_copies(spark):
    """Of near copies with an edit in 70 to 300 words, nine tenths go; of unlike texts, passages and frequent words in common, none."""
    dice = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    common, passage = words[:60], [dice.choice(words) for _ in range(50)]
    write = lambda n: [dice.choice(common) if dice.random() < 0.4 else dice.choice(words) for _ in range(n)]
    clean = [write(dice.randrange(40, 900)) for _ in range(300)]
    clean += [write(150) + passage for _ in range(100)]
    rows = [(i, " ".join(w)) for i, w in enumerate(clean)]
    for k in range(200):
        copy = list(clean[k])
        for _ in range(max(1, len(copy) // dice.choice([70, 100, 200, 300]))):
            copy[dice.randrange(len(copy))] = dice.choice(words)
        rows.append((10_000 + k, " ".join(copy)))
    kept = {r.doc_id for r in s.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(400)) <= kept
    assert sum(i >= 10_000 for i in kept) <= 20
