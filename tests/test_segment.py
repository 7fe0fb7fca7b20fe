import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import segment


def run(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", make(F.col("t"))).orderBy("i").collect()]


def test_packed_paragraphs_by_hand(spark):
    a, b, c, d = "a" * 500, "b" * 400, "c" * 2200, "d" * 800
    cases = {
        f"{a}\n\n{b}": [f"{a}\n\n{b}"],
        f"{a}\n\n{b}\n\n{c}\n\n{d}": [f"{a}\n\n{b}", f"{c}\n\n{d}"],  # 2,200 and 800 are not over 3,000
        f"{c}c\n\n{d}": [f"{c}c"],  # 3,001 are, and a rest of 800 is too short for a chunk
        f"{a}\n\n{b}\n\n{c}\n\n{d}d": [f"{a}\n\n{b}", c, f"{d}d"],  # 2,200 and 801 are over 3,000
        f"{a}\n \n{c}c": [f"{a}\n\n{c}c"],
        "x" * 5000: ["x" * 5000],
        "": [""],
        d: [d],
    }
    assert run(spark, list(cases), segment.pack_paragraphs) == list(cases.values())


def test_packed_paragraphs_keep_order_and_size(spark):
    rng = random.Random(5)
    paras = [[c * rng.choice([1, 50, 700, 801, 1600, 3001]) for c in rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 26))] for _ in range(40)]
    for own, chunks in zip(paras, run(spark, ["\n\n".join(p) for p in paras], segment.pack_paragraphs)):
        whole = "\n\n".join(own)
        if chunks == [whole[:3000]] and len(whole) <= 3000:
            continue
        assert whole.startswith("\n\n".join(chunks)) and all(len(c) > 800 for c in chunks)
        assert len(whole) - len("\n\n".join(chunks)) <= 802  # only a short end is left out
        starts = [c[0] for c in chunks[1:]]
        for chunk, first in zip(chunks, starts):
            assert len(chunk) + len(own[[x[0] for x in own].index(first)]) > 3000  # none closes early


@pytest.mark.parametrize("n, windows", [(2000, 1), (2001, 2), (3000, 2), (3001, 3), (60000, 20)])
def test_fixed_windows(spark, n, windows):
    (got,) = run(spark, ["z" * n], segment.fixed_windows)
    assert len(got) == windows and len(got[0]) == min(n, 2000)


@pytest.mark.parametrize("n, windows", [(1, 1), (256, 1), (257, 3), (300, 3), (512, 4)])
def test_token_windows_shrink_at_the_end(spark, n, windows):
    (got,) = run(spark, [" ".join(f"w{i}" for i in range(n))], segment.token_windows)
    assert len(got) == windows


def test_sections_need_bare_header_lines(spark):
    body = "y" * 600
    (got,) = run(spark, [f"{body}\nIntroduction\n{body}\n2. Result\n{body}\nMethods\nshort"], segment.sections)
    assert len(got) == 3


def test_sentence_spans_are_code_points(spark):
    cases = [
        ("  Ab. Cd! Ef?", [(2, 5), (6, 9), (10, 13)], [(2, 5), (6, 9), (10, 13)]),
        ("Same. Same. Same.", [(0, 5), (6, 11), (12, 17)], [(0, 5), (6, 11), (12, 17)]),
        ("\U0001f600 One. two.\n\nThree\nFour go", [(0, 11), (13, 26)], [(0, 11), (13, 18), (19, 26)]),
        ("", [], []),
        ("no end", [(0, 6)], [(0, 6)]),
    ]
    for k, breaks in ((1, segment.SENTENCE_BREAK_V1), (2, segment.SENTENCE_BREAK_V2)):
        got = run(spark, [c[0] for c in cases], lambda t, b=breaks: segment.sentence_spans(t, b))
        assert [[(s.start, s.end) for s in g] for g in got] == [c[k] for c in cases]
        assert all(c[0][s.start : s.end] == s.text for c, g in zip(cases, got) for s in g)


def test_paragraph_spans_rebase_sentences(spark):
    text = "short one.\n\n" + "Long sentence here. " * 40
    (got,) = run(spark, [text], segment.paragraph_spans)
    assert len(got) == 41 and all(text[s.start : s.end] == s.text for s in got)
