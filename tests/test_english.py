"""The English stemmer on pairs from the published vocabulary, and as an analyzer."""

import pytest

from lectern.functions import english
from lectern.operators import index, retrieval

PAIRS = """consign consign
consigned consign
consigning consign
consignment consign
consist consist
consistency consist
consistent consist
consistently consist
consolation consol
consolatory consolatori
console consol
conspicuously conspicu
knack knack
knackeries knackeri
kneeling kneel
knightly knight
generously generous
generically generic
communication communic
arsenal arsenal
skies sky
dying die
hopping hop
hoping hope
hopeful hope
relational relat
ties tie
cries cri
gas gas
this this
happy happi
say say
cry cri
proceed proceed
exceeding exceed
analogies analog
employees employe
eligibility elig
grants grant
luxuriated luxuri
dogged dog"""


@pytest.mark.parametrize(("word", "want"), [tuple(x.split()) for x in PAIRS.split("\n")])
def test_stem(word, want):
    assert english.stem(word) == want


def test_lexemes():
    assert english.lexemes("The employers' GRANTS, 12.5 of them weren't it") == ["employ", "grant", "12.5", "weren"]
    assert english.lexemes(None) == []


#: A token alone, and its lexemes with their positions, as the published parser's types say.
ALONE = {
    "Grants": [("grant", 0)], "the": [], "weren't": [("weren", 0)], "o'brien": [("o", 0), ("brien", 1)], "b2b": [("b2b", 0)], "naïves": [("naïv", 0)], "12": [("12", 0)], "-5": [("-5", 0)], "+7": [("+7", 0)],
    "12.5": [("12.5", 0)], "-0.25": [("-0.25", 0)], "1.5e-3": [("1.5e-3", 0)], "10.4.2": [("10.4.2", 0)], "well-known": [("well-known", 0), ("well", 1), ("known", 2)], "up-to-date": [("up-to-d", 0), ("date", 3)],
    "covid-19": [("covid", 0), ("-19", 1)], "beta1-release": [("beta1-release", 0), ("beta1", 1), ("releas", 2)], "example.com": [("example.com", 0)], "https://example.com/a/b?x=1": [("example.com/a/b?x=1", 0), ("example.com", 1), ("/a/b?x=1", 2)],
    "someone@mail.example.org": [("someone@mail.example.org", 0)], "/usr/local/bin": [("/usr/local/bin", 0)], "and/or": [("and/or", 0)], "notes/plan.txt": [("notes/plan.txt", 0)], "<b>": [], "&amp;": [], "foo_bar": [("foo", 0), ("bar", 1)],
    "2020-21": [("2020", 0), ("-21", 1)], "...": [], "—": [], "$40": [("40", 0)], "W-2": [("w", 0), ("-2", 1)], "100%": [("100", 0)],
}
LENGTH = {"the": 1, "weren't": 2}  # positions of tokens that end in a stop word


@pytest.mark.parametrize("token", list(ALONE))
def test_token_alone(token):
    assert english.placed(token) == ALONE[token]


def test_mixed_tokens_number_positions_over_all():
    import random

    dice = random.Random(2)
    for _ in range(300):
        chosen = dice.choices(list(ALONE), k=dice.randrange(1, 15))
        want, at = [], 0
        for token in chosen:
            want += [(x, at + p) for x, p in ALONE[token]]
            at += LENGTH.get(token, max((p for _, p in ALONE[token]), default=-1) + 1)
        assert english.placed(" ".join(chosen)) == want, chosen


def test_phrases_know_where_a_stop_word_was_left_out(spark):
    rows = [("a", "the cost of living allowance"), ("b", "cost living allowance"), ("c", "visit example.com/rules for cost-of-living rules, 12.5 percent")]
    built = index.build_index(spark.createDataFrame(rows, "id string, text string"), english.english_lexemes)
    assert {(r.word, r.tf, tuple(r.gaps)) for r in built["places"].join(built["terms"], ["chunk_id", "word"]).where("chunk_id = 'c'").collect()} >= {("rule", 1, (9,)), ("12.5", 1, (10,)), ("cost", 1, (6,)), ("live", 1, (8,))}
    q = spark.createDataFrame([(1, '"living allowance"'), (2, '"cost living"'), (3, "example.com -allowance")], "query_id int, text string")
    got = {}
    for r in retrieval.all_terms_match(q, built, analyzer=english.english_lexemes).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    assert got == {1: {"a", "b"}, 2: {"b"}, 3: {"c"}}


def test_same_analyzer_on_both_sides(spark):
    chunks = spark.createDataFrame([("a", "consisting of assessments"), ("b", "other words")], "id string, text string")
    built = index.build_index(chunks, english.english_lexemes)
    q = spark.createDataFrame([(1, "consistency assessed")], "query_id int, text string")
    assert [r.chunk_id for r in retrieval.bm25(q, built, analyzer=english.english_lexemes).collect()] == ["a"]
