"""Quotation linking against a plain version, cycles and odd tables."""

import random
import re

import pytest

from lectern.llm import quotes

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
SPACE = re.compile("[\x20\x09-\x0d]+")


def norm(text):
    return SPACE.sub(" ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).strip(" ")


def marked(text):
    out = []
    for line in re.split("\r?\n", text or ""):
        m = MARKS.match(line)
        out.append((m.group(1).count(">") if m else 0, line[m.end() :] if m else line))
    return out


def passages(text):
    """(level, raw) in order, as the operator numbers them."""
    lines, out = marked(text), []
    blank = lambda x: x[0] == 0 and x[1].strip(" ") == ""
    for i, (level, words) in enumerate(lines):
        if i == 0 or level != lines[i - 1][0] or blank(lines[i]) or blank(lines[i - 1]):
            out.append([level, []])
        out[-1][1].append(words)
    return [(level, "\n".join(w)) for level, w in out if "\n".join(w).strip(" ") != ""]


def units(text):
    """(whole, paragraphs, parts): parts and paragraphs as (words, lines)."""
    lines = [norm(x) for x in re.split("\r?\n", text)]
    said = [i for i, x in enumerate(lines) if x]
    paragraphs = []
    for i in said:
        if i and lines[i - 1]:
            paragraphs[-1].append(i)
        else:
            paragraphs.append([i])
    paragraphs = [(" ".join(lines[i] for i in p), p) for p in paragraphs]
    parts = [(lines[i], [i]) for i in said] + [(f"{lines[a]} {lines[b]}", [a, b]) for a, b in zip(said, said[1:], strict=False)] + [p for p in paragraphs if len(p[1]) > 2]
    return " ".join(lines[i] for i in said), paragraphs, parts


def plain(rows):
    """(conv, turn) -> (reply, root, depth) of ``rows`` (conv, turn, text) with distinct (conv, turn)."""
    wholes, pieces = {}, {}
    for c, t, text in rows:
        own = "\n".join(w if level == 0 else "" for level, w in marked(text))
        whole, paragraphs, parts = units(own)
        for w in {whole, *(p for p, _ in paragraphs)} - {""}:
            wholes.setdefault(w, set()).add((c, t))
        for w in {p for p, _ in parts}:
            pieces.setdefault(w, set()).add((c, t))

    def met(where, words, c, t):
        said = where.get(words, set())
        here = min((x for x in said if x[0] == c), default=None)
        return here if here and here[1] < t else None, min((x for x in said if x[0] != c), default=None)

    reply = {}
    for c, t, text in rows:
        found = []
        for at, (level, raw) in enumerate(passages(text)):
            if level and norm(raw):
                here, there = met(wholes, norm(raw), c, t)
                to = here or there
                if to is None:
                    lines = {}
                    for words, covered in units(raw)[2]:
                        for x in met(pieces, words, c, t):
                            if x:
                                lines.setdefault(x, set()).update(covered)
                    to = min(lines, key=lambda x: (-len(lines[x]), x[0] != c, x), default=None)  # noqa: B023
                if to:
                    found.append((level, at, to))
        if found and min(found)[2] != (c, t):
            reply[c, t] = min(found)[2]
    out = {}
    for c, t, _ in rows:
        way = [(c, t)]
        while way[-1] in reply and reply[way[-1]] not in way:
            way.append(reply[way[-1]])
        if way[-1] in reply:  # into a cycle, which ends at its smallest message
            end = min(way[way.index(reply[way[-1]]) :])
            if end in way:
                way = way[: way.index(end) + 1]
        out[c, t] = (reply.get((c, t)), way[-1], len(way) - 1)
    return out


def got(df):
    pair = lambda a, b: None if b is None else (a, b)
    return {(r.conv_id, r.turn): (pair(r.reply_conv, r.reply_turn), (r.root_conv, r.root_turn), r.depth) for r in df.collect()}


def test_random_threads(spark):
    dice, rows = random.Random(4), []
    words = [f"word{i}" for i in range(60)] + ["The", "of"]
    line = lambda: " ".join(dice.choice(words) for _ in range(dice.randrange(1, 5)))
    for c in range(100):
        for t in range(10):
            text = []
            for _ in range(dice.randrange(3)):
                source = dice.choice(rows[-40:]) if rows and dice.random() < 0.9 else (0, 0, line())
                quoted = source[2].split("\n")
                a = dice.randrange(len(quoted))
                b = len(quoted) if dice.random() < 0.5 else a + dice.randrange(1, 5)
                text += [("> " if dice.random() < 0.8 else " >") + x.upper().replace(" ", "  ") for x in quoted[a:b]]
                text += [""] * dice.randrange(2)
            for _ in range(dice.randrange(4)):
                text.append(line())
                text += [""] * (dice.random() < 0.3)
            rows.append((c, t, ("\r\n" if dice.random() < 0.2 else "\n").join(text)))
    want = plain(rows)
    assert sum(r is not None for r, _, _ in want.values()) > 250 and max(d for _, _, d in want.values()) > 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    assert got(quotes.conversations(df)) == want
    hashes_by_shuffle = quotes.links(df, broadcast_hashes=0)
    assert sorted(hashes_by_shuffle.collect()) == sorted(quotes.links(df).collect())


@pytest.mark.parametrize("n", [2, 3, 5, 8])
def test_cycles(spark, n):
    rows = [(i, 0, f"> text {(i + 1) % n}\ntext {i}") for i in range(n)] + [(50, 0, f"> text {n - 1}\nafter"), (51, 0, "> after\nlast"), (0, 1, "apart")]
    want = plain(rows)
    assert want[0, 0] == ((1, 0), (0, 0), 0) and want[51, 0][1] == (0, 0) and want[1, 0][2] == n - 1
    assert got(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string"))) == want


def test_long_chain(spark):
    rows = [(0, 0, "start 0")] + [(0, t, f"> start {t - 1}\nstart {t}") for t in range(1, 70)]
    assert {k: d for k, (_, _, d) in got(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string"))).items()} == {(0, t): t for t in range(70)}


def test_odd_tables(spark):
    names = "me to conv no n c t h words kind lines own levels given root least moved up at level raw reply_turn depth".split()
    rows = [(1, 0, "one line"), (1, 1, "> one line\nanswer"), (1, 1, "> one line\nanswer"), (None, 0, "> one line"), (1, None, "> one line"), (2, 0, None), (2, 1, ""), (2, 2, "> > \n>"), (3, 0, "> " + "long words " * 50_000), (4, 0, "long words " * 50_000)]
    df = spark.createDataFrame([(*r, *names) for r in rows], "conv_id long, turn long, text string, " + ", ".join(f"`{x}` string" for x in names))
    out = quotes.conversations(df)
    assert out.columns == ["conv_id", "turn", "text", *(x for x in names if x not in ("reply_turn", "depth")), "n_quotes", "max_level", "reply_conv", "reply_turn", "root_conv", "root_turn", "depth", "clean"]
    found = out.collect()
    assert len(found) == len(rows) and all(r.me == "me" and r.lines == "lines" and r.given == "given" for r in found)
    replies = sorted((r.conv_id, r.turn, r.reply_conv, r.reply_turn) for r in found if r.reply_conv is not None)
    assert replies == [(1, 1, 1, 0), (1, 1, 1, 0), (3, 0, 4, 0)]
    assert quotes.conversations(df.limit(0)).collect() == []
    assert quotes.passages(df.limit(0)).collect() == [] and quotes.passages(df.where("conv_id = 1 and turn = 0")).select("words").first().words == "one line"
