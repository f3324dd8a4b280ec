"""Matroska files and Simple-8b shards: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import matroska as m
from lectern.llm import token_ids as t

TEXTS = [(1, "Hello  World\n\tagain"), (2, None), (3, ""), (4, "x" * 20_000), (5, "Été à Köln, c'est 12.5% <|endoftext|> ok"), (1, "Hello  World\n\tagain"), (None, "no id"), (7, " \n ")]
SCHEMA = "doc_id long, text string, media string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, "clash", "clash") for a, b in TEXTS], SCHEMA)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 8, 576 * 8 + 1, 576 * 600 + 5])
def test_file_round_trip(size):
    payload = random.Random(size).randbytes(size)
    r = m.Reader(m.to_matroska(m.padded(payload)))
    assert r.error is None
    got = r.payload()
    assert len(got) % 576 == 0 and len(got) >= 576 and got[:size] == payload and set(got[size:]) <= {255}
    assert [p[1] for p in r.packets] == [72_000_000 * i for i in range(len(r.packets))]
    assert {c[2] for c in r.cues} == {p[6] for p in r.packets}


def _file(*children):
    return m.HEAD + m.element(m.SEGMENT, b"".join(children))


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACING])
def test_uneven_lacing(kind):
    frames = [b"a" * n for n in (3, 600, 254, 255, 256, 1, 0, 7)]
    block = m.number(1) + b"\x00\x05" + bytes([kind << 1]) + m.lace(frames, kind)
    r = m.Reader(_file(m.element(m.CLUSTER, m.uint(m.CLUSTER_TIME, 10) + m.element(m.SIMPLE_BLOCK, block))))
    assert r.error is None and [p[3] for p in r.packets] == [len(f) for f in frames]
    assert r.payload() == b"".join(frames) and r.packets[0][1] == 15_000_000


def test_unknown_sizes_and_faults():
    block = m.element(m.SIMPLE_BLOCK, m.number(2) + b"\x00\x00\x80" + b"abc")
    cluster = (m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + m.uint(m.CLUSTER_TIME, 1) + block) * 2
    data = m.HEAD + m.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster
    r = m.Reader(data)
    assert r.error is None and r.payload(2) == b"abcabc" and all(p[4] for p in r.packets)
    cut = m.Reader(data[:-2])
    assert cut.error and cut.payload(2) == b"abc"
    assert m.Reader(b"\x00junk").error


def test_media_digests(docs):
    rows = m.media_digests(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in TEXTS:
        raw = (text or "").encode()
        want = m.padded(raw)
        r = by[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert len({tuple(x) for x in by[i]}) == 1
    assert m.media_digests(docs.limit(0)).collect() == []


def test_packet_table(docs):
    media = m.mux(docs.where("doc_id = 4"), "text").select("doc_id", "media")
    found = m.packets(media).join(media, "doc_id").select(F.expr("substring(media, int(offset) + 1, int(size))").alias("b"), "packet").orderBy("packet").collect()
    assert b"".join(bytes(r.b) for r in found) == m.padded(b"x" * 20_000)
    assert m.cues(media).count() == 1
    broken = media.select("doc_id", F.lit(None).cast("binary").alias("media"))
    assert m.demux(broken).first().packets == []


@pytest.mark.parametrize("seed", range(12))
def test_pack_round_trip(seed):
    dice = np.random.default_rng(seed)
    n = int(dice.integers(0, 3000))
    ids = dice.integers(0, 2 ** dice.integers(0, 64, n, dtype=np.uint64), n, dtype=np.uint64) if n else np.zeros(0, np.uint64)
    if n > 300:
        ids[10:290] = 0
        ids[5] = 2**64 - 1
        ids[6] = (1 << 60) - 1
    words, offsets, escaped = t.pack(ids)
    assert (t.unpack(words, offsets, escaped, n) == ids).all() and len(words) <= max(1, n)
    # a block decodes alone
    for b in range(len(offsets) - 1):
        some = t.unpack(words[offsets[b] : offsets[b + 1]], offsets[b : b + 2] - offsets[b], np.zeros(0, np.uint64), min(t.BLOCK, n - b * t.BLOCK))
        want = np.minimum(ids[b * t.BLOCK : (b + 1) * t.BLOCK], t.ESCAPE)
        assert (some == want).all()


def test_token_digests(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path(t.TOKENIZER))
    start, want = 0, []
    for i, text in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in t.token_digests(docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert t.token_digests(docs.limit(0)).collect() == []


def test_words_match_whole_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()]
    texts += ["é ́x", "A B C", "İstanbul ΣΑΣ ΣΑΣ.", "don't we'll\x0b'LL", "<|startoftext|>a <|endoftext|>", "\x1c a\x85b"]
    tok = Tokenizer.from_file(public_tokenizers.path(t.TOKENIZER))
    ids, lengths = t.WordTokens(t.TOKENIZER).encode(texts, 1)
    at = 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*tok.encode(text, add_special_tokens=False).ids, 1]
        at += n


def test_words_match_the_tokenizer_on_random_texts():
    dice = random.Random(11)
    letters = "aAbBzZ \u00e9\u00c9\u00f1\u00fc\u0130\u0131\u011e\u03c3\u03a3\u03c2\u0416\u044f\u4e2d\u3042'.,.,!?;:-*$%&#<>|()\"0129\u00bd\u00b2\u00aa\u0338\u0301\u0307\u1e9e\u00c5\u212b\u00a0\u2003\x85\x1c\x0b\t\n\ud7a3\u0560\u1c8a_"
    words = ["B\u0130R\u0130NC\u0130.", "ANKARA \u0130L\u0130, T\u00dcRK\u0130YE", "\u0130,", "don't", "we'LL.", "x's'", "a<|endoftext|>b.", "caf\u00e9***", "\ufb01ne.", "\u01c4ungla."]
    word = lambda: dice.choice(words) if dice.random() < 0.3 else "".join(dice.choice(letters) for _ in range(dice.randrange(9)))
    texts = ["".join(word() + dice.choice([" ", "  ", "\n", "", "\u2003"]) for _ in range(dice.randrange(12))) for _ in range(12_000)] + words
    tok = Tokenizer.from_file(public_tokenizers.path(t.TOKENIZER))
    for together, remember in ((256, 600_000), (3, 50)):
        tokens, at, want = t.WordTokens(t.TOKENIZER, remember, together), 0, [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        got = [tokens.encode(texts[i : i + 1000], 1) for i in range(0, len(texts), 1000)]
        ids, lengths = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        for text, n, w in zip(texts, lengths.tolist(), want, strict=True):
            assert ids[at : at + n].tolist() == [*w, 1], repr(text)
            at += n


def test_read_ids(spark, docs):
    path = f"{t.shared_folder(spark)}/ids-{random.random()}"
    t.write_ids(docs.withColumnsRenamed({"media": "part", "ids": "before"}), path)
    tok = Tokenizer.from_file(public_tokenizers.path(t.TOKENIZER))
    got = sorted((str(r.doc_id), r.ids) for r in t.read_ids(spark, path).collect())
    assert got == sorted((str(i), [*tok.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in TEXTS)
    empty = f"{path}-empty"
    t.write_ids(docs.limit(0), empty)
    assert t.read_ids(spark, empty).collect() == []
