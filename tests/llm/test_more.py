"""More of the text operators: encodings of other scripts, deep nesting, rare abbreviations, edges of a mixture."""

import random

import pytest

from lectern.llm import encoding, sentences


@pytest.mark.parametrize(("s", "wrong"), [("Привет народам", "latin-1"), ("Привет народам", "cp1252"), ("Ελλάδα μεγάλη", "cp1252")])
def test_words_of_other_scripts(s, wrong):
    right = "cp1253" if "Ε" in s else "cp1251"
    assert encoding.repair(s.encode(right).decode(wrong))[0] == s
    assert encoding.repair(s) == (s, 0, 0)


def test_koi8():
    assert encoding.repair("Привет".encode("koi8-r").decode("cp1251"))[0] == "Привет"
    assert encoding.repair("Żółta łódź".encode().decode("cp1250"))[0] == "Żółta łódź"


def test_any_number_of_layers():
    s = "farmers’ café"
    bad = s
    for n in range(1, 9):
        bad = bad.encode().decode("latin-1")
        assert encoding.repair(bad)[:2] == (s, n)


def test_abbreviations_are_kept_however_rare(spark):
    """A hundred times more text leaves what is known of a rare abbreviation as it is."""
    rng = random.Random(2)
    words = "the council has heard that water meters and lamps are at our office since then".split()
    plain = [" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(40)]
    rare = ["We met Adj. Orrim at noon. The lamps are here."] * 6 + ["They saw Adj. Wernochum there. Our office heard."] * 6
    df = spark.createDataFrame([(t,) for t in [" ".join(rng.choices(plain, k=12)) for _ in range(4000)] + rare], "text string")
    assert "Adj" in sentences.learn(df)["en"]["abbreviations"]
    assert sentences.learn(df.limit(0)) == {}
