"""Words, lines and passages on arrays against regular expressions."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumatrace.llm import text_scan

TOKEN = re.compile(r"\w+(?:['’]\w+)?")
BULLET = re.compile(r"\s*(?:[-*•+]\s|\d+[.)]\s|\s{2,}\S)")
COLUMNS = re.compile(r"\S\s{3,}\S|\t|\s\|\s")
OTHER = re.compile(r"[^\w\s]|[\d_]")
CLOSED = re.compile(r"[.!?…。][\"'”’»)\]]*$")
PIECES = st.sampled_from(["word", "Größe", "it's", "l’été", "a'b'c", " ", "  ", "   ", "\t", "\n", "\r\n", "\n\n", "- ", "* ", "12. ", "3) ", "|", " | ", ".", "!”", "?)", "...", "_", "7", "½", "漢字", "。", "\u2028", "\x85", "\U0001f600", "İ", "x" * 40, "'", "’"])
TEXT = st.lists(PIECES, max_size=60).map("".join)


def chars(text):
    """Lengths in code points of what Python's lower() leaves in one place."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_words_and_lines(texts):
    c = text_scan.Chunk(texts)
    whole = "".join(chr(x) for x in c.cp)
    assert [whole[a:b] for a, b in zip(c.word_at, c.word_end)] == [w for t in texts for w in TOKEN.findall(t)]
    lines = [x for t in texts for x in t.splitlines() if x.strip()]
    assert [whole[a:b] for a, b in zip(c.line_at, c.line_end)] == lines
    assert c.line_words.tolist() == [len(TOKEN.findall(x)) for x in lines]
    kinds = [2 if len(OTHER.findall(x)) > 0.25 * len(x) else 1 if BULLET.match(x) else 0 for x in lines]
    assert c.line_kind.tolist() == kinds
    assert c.line_listed.tolist() == [BULLET.match(x) is not None or COLUMNS.search(x) is not None for x in lines]
    assert c.line_closed.tolist() == [CLOSED.search(x.rstrip()) is not None for x in lines]
    numbers = c.word_numbers().tolist()
    by_word = {}
    for n, w in zip(numbers, [chars(w) for t in texts for w in TOKEN.findall(t)]):
        assert by_word.setdefault(w, n) == n == text_scan.word_number(w)
    assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT.map(lambda t: t * 4), min_size=1, max_size=3))
def test_counts_of_passages(texts):
    lexicon = text_scan.Lexicon.of({"en": frozenset({"word", "it's"}), "fr": frozenset({"l’été"})}, {"en": frozenset({"it's"})})
    of = text_scan.passage_counts(texts, ["fr", None, "xx"][: len(texts)], lexicon)
    assert all(len(v) == len(of["text"]) for v in of.values())
    for i, t in enumerate(texts):
        at = of["text"] == i
        words = [chars(w) for w in TOKEN.findall(t)]
        lines = [x for x in t.splitlines() if x.strip()]
        assert of["words"][at].sum() == len(words) and of["fresh"][at].sum() == len(set(words))
        assert of["letters"][at].sum() == sum(map(len, words))
        assert of["signs"][at].sum() == len(re.findall(r"[^\w\s]|_", t)) and of["digits"][at].sum() == len(re.findall(r"\d", t))
        assert of["solid"][at].sum() == len("".join(t.split()))
        assert of["own_lines"][at].sum() == len(lines) and of["own_closed"][at].sum() == sum(CLOSED.search(x.rstrip()) is not None for x in lines)
        pieces = text_scan.passages(t)
        assert "".join("".join(pieces).split()) == "".join(t.split())
        own = [[chars(w) for w in TOKEN.findall(p)] for p in pieces]
        assert of["words"][at].tolist() == [len(x) for x in own] and of["distinct"][at].tolist() == [len(set(x)) for x in own]
        hits = [(sum(w in ("word", "it's") for w in x), x.count("l’été")) for x in own]
        assert of["common"][at].tolist() == [max(h) for h in hits]
        assert of["language"][at].tolist() == [int(h[1] > h[0] or (h[0] == h[1] and i == 0)) for h in hits]


def test_no_texts_and_long_ones():
    empty = text_scan.Lexicon.of({}, {})
    assert list(text_scan.chunks([])) == [] and len(text_scan.passage_counts(["", " \n"], [None, None], empty)["text"]) == 0
    assert list(text_scan.chunks(["a" * 600_000, "b", "c"])) == [(0, 1), (1, 3)]
    assert text_scan.passages("see /a/b/c.png and more") == ["see /a/b/c.png and more"]
    one = text_scan.passage_counts(["see D:/a/b/c.png here", "=" * 5000], [None, None], empty)
    assert one["words"].tolist() == [3, 0] and one["chars"].tolist() == [21, 5000] and one["signs"].tolist() == [0, 5000]
    long = text_scan.passages("word " * 10_000)
    assert np.all([len(TOKEN.findall(p)) <= 90 for p in long]) and sum(len(TOKEN.findall(p)) for p in long) == 10_000
