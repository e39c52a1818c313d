"""License scan against plain loops; automata against their wording."""
import re

import pytest

from recsmith.llm.common import read_table
from recsmith.llm.license_scan import BASE_PHRASES, compile_template, scan, scan_text, compile_all, words_of


def base(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns(spark, sf, docs, no_docs):
    for d in (read_table(spark, sf, "documents"), docs):
        texts = d.select("doc_id", "text").collect()
        got = [tuple(r) for r in scan(d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
        assert sorted(got, key=str) == sorted(((r.doc_id, *base(r.text)) for r in texts), key=str)
    assert scan(no_docs).collect() == []


@pytest.mark.parametrize("text, ok", [
    ("this is licensed under the gnu general public license version 3 now", True),
    ("licensed under the terms of the gnu general public license gpl version 3", True),
    ("licensed under the terms of the gnu general public license gpl version 2", False),
    ("licensed under the gnu lesser general public license version 3", False),
])
def test_optional_regions(text, ok):
    a = compile_template("gpl-3.0", "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>gpl<<end>> version 3")
    found = scan_text(text, [a], {})
    assert (found[5] == "gpl-3.0") is ok


def test_replaceable_regions():
    a = compile_template("x", "neither the name of <<any 1..3>> may be used <<one a|b>> end")
    hit = lambda t: scan_text(t, [a], {})[5] == "x"
    assert hit("Neither the name of ACME may be used b END.") and hit("neither the name of a b c may be used a end")
    assert not hit("neither the name of may be used a end") and not hit("neither the name of a b c d may be used a end")
    assert not hit("neither the name of a may be used c end")


def test_automata_against_regular_expressions():
    """The automaton accepts what the template, written as a regular expression, finds."""
    import random
    rng = random.Random(3)
    a = compile_template("t", "k <<opt>>o p<<end>> <<any 0..2>> m <<one x|y>> z")
    form = re.compile(r"(?<!\S)k(?: o p)?(?: \S+){0,2} m (?:x|y) z(?!\S)")
    for _ in range(3000):
        text = " ".join(rng.choices("k o p m x y z q".split(), k=rng.randint(3, 12)))
        assert (scan_text(text, [a], {})[5] == "t") is bool(form.search(text)), text


def test_markup_errors():
    for wrong in ("a <<opt>> b", "a b <<end>>", "<<opt>>a<<end>>", "a <<what>> b"):
        with pytest.raises(ValueError):
            compile_template("w", wrong)
    assert words_of("Ünï 1+2") == ["Ünï".encode(), b"1", b"2"]
    assert len(compile_all({"a": ["b c"], "d": ["e"]})) == 2
