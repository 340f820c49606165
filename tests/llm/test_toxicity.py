import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import toxicity
from rillwork.llm.common import crc_of
from tests.llm.odd import no_docs, odd_docs

WORDS = {"idiot": 5.0, "stupid": 5.0, "worthless": 5.0, "lowei~": 4.0}


@pytest.fixture(scope="module")
def model():
    corpus = toxicity.trigram_counts(["the quick brown fox likes plain words and other words of the text"]).astype(float)
    return toxicity.Model(toxicity.letter_costs(corpus, [w.rstrip("~") for w in WORDS]), WORDS, [-5.0, 2.0, 2.0, 0.0, 0.0])


@pytest.mark.parametrize("token", ["idiot", "1d10t", "IDIOT!!", "id1ot,", "idiooot", "i.d.i.o.t", "i-diot", "stup!d", "$tup1d", "st*pid", "w0rthle$$", "***idiot***", "l0weischaft", "LOWEIUNG"])
def test_disguises_are_restored(model, token):
    assert model.weight(token) > 0
    assert model.score(f"some text {token} and more") >= 0.5


@pytest.mark.parametrize("text", ["", None, "the quick brown fox", "10 12 2024", "a b c d e", "fox*** (word) $$$ ###", "st. pidgin", "id", "i"])
def test_other_texts_stay(model, text):
    assert model.score(text) < 0.5


def test_spaced_letters(model):
    assert model.score("you are an i d i o t now") >= 0.5 and model.score("a s t u p 1 d thing") >= 0.5


def test_viterbi_finds_the_cheapest_path(model):
    """Against all paths of a small lattice."""
    from itertools import product

    token = "1d10t"
    options = [[(c, toxicity.SWAP) for c in toxicity.STANDS_FOR[x]] if x in toxicity.STANDS_FOR else [(x, 0.0)] for x in token]
    # a repeated sign may also be one letter; none is repeated here
    paths = []
    for path in product(*options):
        word, cost, a, b = "".join(c for c, _ in path), sum(x for _, x in path), 0, 0
        for ch in word:
            cost, a, b = cost + model.costs[a, b, toxicity.LOWER[ch]], b, toxicity.LOWER[ch]
        paths.append((cost + model.costs[a, b, 0], word))
    assert model.restore(token) == min(paths)[1]


def test_no_word_is_lost_to_the_quick_test(model):
    rng = np.random.default_rng(1)
    signs = {"i": "1!|", "o": "0", "s": "$5", "t": "7+", "e": "3", "l": "1|", "a": "4@"}
    for _ in range(300):
        word = str(rng.choice(["idiot", "stupid", "worthless"]))
        made = "".join(str(rng.choice([c, *signs.get(c, c), c + c, c + "."])) for c in word)
        if any(c in toxicity.LOWER for c in made) and model.look_up_restored(model.restore(made)):
            assert model.may_be(made), made


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.judge(docs, labels, F.pmod(crc_of("doc_id"), F.lit(5)) == 0).join(labels, "doc_id").filter("held_out")
    rates = dict(got.groupBy("toxic").agg(F.avg("predicted")).collect())
    assert rates[1] >= 0.85 and rates[0] <= 0.01


def test_odd_rows(spark):
    docs, held_out = odd_docs(spark), F.pmod(crc_of("doc_id"), F.lit(5)) == 0
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (4, 0, 0), (4, 0, 0), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge(docs, labels, held_out).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.judge(no_docs(spark), labels, held_out).count() == 0
    assert toxicity.judge(docs, labels.limit(0), held_out).count() == docs.count()


def test_runs_of_signs_take_no_time(model):
    for text in ("_" * 5000 + "x y" + "." * 5000 + "abc", "a " * 20_000, "*." * 5000 + "word", "i d i o t " * 2000):
        model.score(text)


@pytest.mark.parametrize("token", ["¡idiota!", "¿idiota?", "—idiota", "\U0001f92cidiota", "¡1d10ta!", "¿!diota?", "–stup!d–", "\U0001f621$tup1d\U0001f621", "日id1ot", "​idiot", "i.idiot", "id1.iot", "$tupid", "¡$tupid!"])
def test_signs_around_a_word_do_not_hide_it(token):
    words = WORDS | {"idiota": 5.0}
    own = toxicity.Model(toxicity.letter_costs(np.zeros(toxicity.N**3), list(words)), words, [-5.0, 2.0, 2.0, 0.0, 0.0])
    assert own.weight(token) > 0


def test_words_are_learnt_between_any_signs(spark):
    rows = [(f"{before} ¡idiota! y", 1) for before in "abcdefghijklmnopqrstuvwxyz"] + [(f"{before} casa y", 0) for before in "abcdefghijklmnopqrstuvwxyz"]
    assert "idiota" in toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))


def test_the_quick_test_drops_what_restoring_drops(model):
    rng = np.random.default_rng(2)
    for _ in range(500):
        word = str(rng.choice(["idiot", "stupid", "worthless"]))
        made = str(rng.choice(["", "¡", "—", "日", "\U0001f621", "."])) + "".join(str(rng.choice([c, c, c + "1" + c, c + "." + c, c + "¿"])) for c in word)
        if model.look_up_restored(model.restore(made)):
            assert model.may_be(made), made


@pytest.mark.parametrize("text", ["you i d i o t.", "i d i o t, yes", "an i d i o t! yes", 'a "i d i o t" here', "¡i d i o t!", "you i   d   i   o   t now", "y o u   i d i o t   n o w",
                                  "(1 d 1 0 t)", "i\td\ti\to\tt", "so i d i o t: you", "i d i o t ! now", "i.d.i.o.t, yes", "i   d  i   o  t"])
def test_spaced_letters_in_any_punctuation(model, text):
    assert 5.0 in model.weights(text)


@pytest.mark.parametrize("token", ["st" + "u" * 70 + "pid", "stup" + "!" * 200 + "d", "plainwords_" * 6 + "stupid", "some*" * 13 + "stup1d", "more!" * 13 + "worthless!" + "x" * 9, "words|" * 12 + "id1ot|and",
                                   "some_" * 13 + "st*pid", "wordsofatext" * 6 + "stupid" + "andmore" * 9, "wordsofatext" * 6 + "5tup1d" + "andmore" * 9, "1d10t" + "$" * 200, "abcdefghij" * 5 + "worthl3ss" + "abcdefghij" * 9])
def test_long_tokens_are_taken_apart(model, token):
    assert model.weight(token) > 0


def test_long_tokens_of_other_words_weigh_nothing(model):
    for token in ("plainwords_" * 9, "abcdefghij" * 30, "a1" * 200, "https://example.org/" + "some/path/" * 20):
        assert model.weight(token) == 0


def test_long_tokens_take_no_time(model):
    from time import process_time

    start = process_time()
    for text in ("*_" * 5000 + "word", "a_b*c!" * 3000, "x1y2" * 5000, "i\t" * 5000, "i d i o t, " * 3000, "x" + "." * 50_000 + "abc", "a" + " ." * 20_000 + "b"):
        model.score(text)
    assert process_time() - start < 30
