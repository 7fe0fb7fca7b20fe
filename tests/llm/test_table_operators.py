import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, nearcopies, packing, queries, sentences, sharedspans, splitting, truncation

WORDS = [f"w{i:03d}x" for i in range(400)]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def gram_set(t):
    t = re.sub(r"[ \t\r\n]+", " ", t)
    return {t[i : i + 10] for i in range(len(t) - 9)}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = words(rng, 120).split()
        for c in range(rng.randint(1, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 14)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            rows.append((f"d{g:02d}-{c}", " ".join(edited)))
    rows += [("same-1", rows[0][1]), ("same-2", rows[0][1].replace(" ", "\n", 3)), ("short", "tiny"), ("empty", ""), ("none", None), (None, rows[0][1]), rows[1]]
    texts = {i: t for i, t in rows if i and t and len(t) >= 400}
    sets = {i: gram_set(t) for i, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.6}
    got = nearcopies.record_pairs(records(spark, rows).withColumn("cls", F.lit(1))).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want


def test_blocks_stream_over_batches(spark):
    rows = [(1, c) for c in range(50)] + [(2, 7), (3, 1), (3, 1), (3, 2)]
    got = {tuple(r) for r in nearcopies._references(spark.createDataFrame(rows, "key bigint, cls bigint")).collect()}
    assert {c for r, c in got if r == 0} == set(range(1, 50)) and (1, 2) in got and not any(r == c for r, c in got) and len({r for r, c in got}) <= 5


def test_unlike_members_of_a_hot_block_are_not_shuffled_as_pairs(spark, monkeypatch):
    rng = random.Random(16)
    rows = [(f"p{i:04}", words(rng, 80)) for i in range(700)]
    rows += [(f"q{i:02}", rows[i][1] + " and one more") for i in range(20)]

    def one_block(blocks):
        cls = blocks.select("cls").distinct()
        first = cls.agg(F.min("cls")).first()[0]
        return cls.where(F.col("cls") != first).select(F.lit(first).alias("ref"), "cls")

    def shuffled():
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    monkeypatch.setattr(nearcopies, "_references", one_block)
    monkeypatch.setattr(nearcopies, "MEMBERS", 200, raising=False)
    before = shuffled()
    got = [tuple(r) for r in nearcopies.record_pairs(records(spark, rows)).collect()]
    assert sorted(got) == [(f"p{i:04}", f"q{i:02}") for i in range(20)]
    assert shuffled() - before < 2_500_000  # 258,840 pairs of members


def brute_spans(texts, n):
    where = {}
    for i, t in texts.items():
        for k in range(len(t) - n + 1):
            where.setdefault(t[k : k + n], set()).add(i)
    out = set()
    for i, t in texts.items():
        hit = [k for k in range(len(t) - n + 1) if len(where[t[k : k + n]]) > 1]
        a = None
        for k in hit:
            if a is not None and k <= b:
                b = k + n
            else:
                if a is not None:
                    out.add((i, a, b))
                a, b = k, k + n
        if a is not None:
            out.add((i, a, b))
    return out


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [words(rng, 90) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(0, 200)
            parts += [p[a : a + rng.choice([120, 299, 300, 301, 400])], words(rng, rng.randint(0, 20))]
        rows.append((f"r{i}", " ".join(parts)))
    twice = words(rng, 80)
    rows += [("self", twice + "|" + twice), ("a" * 3, "z" * 1000), ("b" * 3, "y" + "z" * 700), ("none", None), ("empty", ""), rows[0], rows[3]]
    want = brute_spans({i: t for i, t in rows if t}, 300)
    got = sharedspans.shared_spans(records(spark, rows)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want
    shares = {r.rec_id: r for r in sharedspans.shared_shares(records(spark, rows)).collect()}
    assert shares["empty"].share == 0.0 and shares["self"].shared_chars == 0 and len(shares) == len({i for i, _ in rows})


def test_a_notice_on_very_many_pages(spark, monkeypatch):
    rng = random.Random(15)
    notice = words(rng, 70)
    rows = [(f"p{i:04}", f"{words(rng, 25)} {notice} {words(rng, 25)}") for i in range(300)]
    want = brute_spans(dict(rows), 300)
    monkeypatch.setattr(sharedspans, "HOT_BLOCKS", 50)
    got = sharedspans.shared_spans(records(spark, rows)).collect()
    assert {tuple(r) for r in got} == want and len(want) == 300


def test_shared_spans_of_nothing(spark):
    assert sharedspans.shared_spans(records(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharedspans.shared_spans(records(spark, []), 50)


vocab = pytest.mark.skipif(not Path(bpe.VOCAB).exists(), reason="no vocabulary here")


@vocab
def test_encoder_equals_merging_and_round_trips():
    import public_tokenizers
    import tiktoken

    entries = bpe.read_ranks()
    v = bpe.Vocabulary(entries)
    enc = bpe.Encoder(v)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(entries)}, special_tokens={})
    rng = random.Random(9)
    alphabet = "ab cdé 'sll t\n\t12　กำ日本語😀​\x00É\xa0<|endoftext|>"
    texts = ["", "<|endoftext|>", "a" * 3000, "ab" * 2000, " \n \n  x", "İ'S ǅ 𝒳"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        ids = enc.ids(t)
        assert ids == plain.encode_ordinary(t)
        assert v.decode(ids).decode() == t
    again = bpe.Vocabulary(entries, v.splits())
    assert again.encode_piece(b"mississippi") == v.encode_piece(b"mississippi")


@vocab
def test_encoded_table(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id, len(r.ids)) for r in bpe.encode(df).collect())
    assert got == [(1, 2), (2, 0), (3, 0), (3, 0)]
    assert sorted(r.n_tokens for r in bpe.count_tokens(df).collect()) == [0, 0, 0, 2]


def test_packing_keeps_all_items_whole(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice([0, 1, 5, 40, 99, 100, 101, 250])) for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "item bigint, size bigint").repartition(7)
    got = packing.pack(df, 100).collect()
    used, parts = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r["size"]
        parts.setdefault(r.item, []).append((r.part, r.start, r["size"]))
    assert max(used.values()) <= 100 and set(parts) == {i for i, _ in rows}
    for i, s in rows:
        own = sorted(parts[i])
        assert sum(x for _, _, x in own) == (s or 0) and (len(own) == 1 or (s > 100 and [a for _, a, _ in own] == [100 * p for p, _, _ in own]))
    total = sum(s or 0 for _, s in rows)
    assert len(used) <= total / 100 * 1.15 + packing.WINDOWS
    assert packing.pack(df.where("false"), 100).count() == 0


def test_cut_documents(spark):
    rng = random.Random(11)
    whole = ". ".join(words(rng, 9) for _ in range(30)) + "."
    listed = whole + "\n- an entry of a list that is long enough to be told apart from others"
    rows = [(1, whole, "a"), (2, whole[:500], "a"), (3, "", None), (4, None, "b"), (5, listed, "b"), (6, listed[:-8], "b"), (7, whole, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("verdict", F.lit("clash"))
    assert {r.doc_id for r in truncation.cut_documents(df).collect()} == {2, 6}
    shares = {r.source: (r.n_docs, r.n_cut) for r in truncation.cut_shares(df).collect()}
    assert shares == {"a": (2, 1), "b": (3, 1), None: (2, 0)}
    assert truncation.cut_documents(df.where("false")).count() == 0


def test_any_near_copy_tells_of_a_cut(spark):
    rng = random.Random(12)
    whole = ". ".join(words(rng, 9) for _ in range(30)) + ".\n- an entry of a list that is long enough to be told apart from "
    # the copy that goes on is neither the longest nor the last of any block: text 8 has the same words
    rows = [(1, whole + "others"), (2, whole + "others and more"), (8, whole + "others\nand more\n\n* * * * *"), (9, whole + "others")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in truncation.cut_documents(df).collect()} == {1, 9}
    # no other text goes on, although this one repeats its closing words
    alone = [(1, whole + "others and more\n" + whole + "others"), (2, whole + "others")]
    assert {r.doc_id for r in truncation.cut_documents(spark.createDataFrame(alone, "doc_id bigint, text string")).collect()} == {2}
    # hidden among lines that look complete, each is found by its copies only
    other = ". ".join(words(rng, 9) for _ in range(30)) + ".\n- another entry of a list that is told apart from the rest by its "
    more = spark.createDataFrame(rows + [(20, other + "end"), (21, other + "ending")], "doc_id bigint, text string")
    assert {r.doc_id for r in truncation.cut_documents(more).collect()} == {1, 9, 20}


def test_a_hot_group_of_copies_is_aligned_whole(spark):
    rng = random.Random(14)
    items = [f"- {words(rng, 12)}" for _ in range(40)]
    whole = "\n".join(items) + "\nThe end of it."
    # cut between two words of a list item: closing words say nothing, every copy may be the one that goes on
    cuts = [whole.index(items[k]) + items[k].rindex(" ") for k in range(10, 40)]
    rows = [(i, whole[:c]) for i, c in enumerate(cuts)] + [(1000 + i, whole) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in truncation.cut_documents(df).collect()} == set(range(30))


def test_near_copies_tell_of_short_lines_with_an_ellipsis(spark):
    rng = random.Random(13)
    whole = ". ".join(words(rng, 9) for _ in range(30)) + ".\nThe town replac"
    deliberate = ". ".join(words(rng, 9) for _ in range(30)) + ".\nAnd then"
    rows = [(1, whole + "..."), (2, whole + "ed its mill."), (3, deliberate + "…"), (4, deliberate + "…\nNobody came.")]
    assert {truncation.closing(rows[i][1], sentences.Model())[0] for i in (0, 2)} == {truncation.BY_LIMIT}
    assert {r.doc_id for r in truncation.cut_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1}


@pytest.mark.parametrize("name, columns", [("p1_found", "doc_id line_no"), ("p2_found", "rec_id start_char end_char"), ("p3_found", "doc_id"), ("p6_found", "qid")])
def test_queries_over_the_smallest_tables(spark, small, name, columns):
    df = queries.queries()[name](spark, small)
    assert df.columns == columns.split()
    rows = df.collect()
    assert rows and len(rows) == len(set(map(tuple, rows))) and not any(v is None for r in rows for v in r)


def counted_records(rng, n):
    """Records whose words around a mark are met once each, so that it doesn't matter which of them count."""
    made = iter(f"{a}{b}{c}{d}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvwxz" for d in "aeiou")
    out = []
    for i in range(n):
        a, b = (f"{rng.choice('kmtv')}{i:04x}".translate(str.maketrans("0123456789", "ghijklmnop")) + x for x in "qz")
        out.append((f"r{i:04}", f"The mill saw {a}. {b.title()} was there, see Zgr. {b.title()}a at it. Then\nthe {a} fell? And {b} is {next(made, a)}! So it ends.\nวันนี้ฝนตกหนัก เขาไม่มา"))
    return out


def test_sentence_model_counts_all_records(spark):
    rows = counted_records(random.Random(17), 2300)
    df = records(spark, rows + rows[:40] + [(None, "x. Y"), ("none", None)])
    got, want = sentences.counted_model(df.repartition(5)).value, sentences.fit([t for _, t in rows])
    for name in ("marks", "left_class", "left", "right_class", "right", "pair", "class_pair", "thai", "after"):
        x, y = dict(getattr(got, name)), dict(getattr(want, name))
        assert set(x) == set(y) and all(np.allclose(x[k], y[k], rtol=1e-6, atol=1e-6) for k in x), name
    assert got.left["capital4", "zgr"][0] > 2000
    again = sentences.counted_model(df.repartition(2)).value
    assert (again.left, again.right, again.marks, again.after) == (got.left, got.right, got.marks, got.after)
    assert sentences.counted_model(df.where("false")).value.marks == sentences.fit([]).marks


def taught_records():
    rng = random.Random(18)
    names = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)).title() for _ in range(400)]
    return [(f"t{i:03}", f"The {rng.choice(WORDS)} saw Zgr. {n} at the mill. {rng.choice(names)} sold the wheel.") for i, n in enumerate(names)]


def test_pieces_know_words_of_all_records(spark, monkeypatch):
    monkeypatch.setattr(sentences, "SAMPLE_RECORDS", 1, raising=False)
    rows = taught_records()
    rows.append(("long", " ".join(f"{('He and', 'It and the old wheel of')[i % 2]} Zgr. {t.split('Zgr. ')[1].split()[0]} went by the mill and the wheel of it." for i, (_, t) in enumerate(rows[:40]))))
    model = sentences.fit([t for _, t in rows])
    want = splitting.pieces(rows[-1][1], 110, 10, model)
    assert want != splitting.pieces(rows[-1][1], 110, 10)
    got = [(r.start_char, r.end_char) for r in splitting.split_records(records(spark, rows), 110, 10).where("id = 'long'").orderBy("piece_no").collect()]
    assert got == want


def test_closing_words_are_known_from_all_records(spark, monkeypatch):
    monkeypatch.setattr(sentences, "SAMPLE_RECORDS", 1, raising=False)
    rows = [(i, t) for i, (_, t) in enumerate(taught_records())] + [(9000, "The mill stood still for days. It was sold by Zgr.")]
    assert truncation.closing(rows[-1][1], sentences.Model())[0] == truncation.COMPLETE
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in truncation.cut_documents(df).collect()} == {9000}


def test_sketch_of_short_sets():
    assert nearcopies.sketch(np.zeros(0, dtype=np.uint64)).tolist() == [0] * nearcopies.SYMBOLS
    assert len(set(nearcopies.sketch(np.array([5], dtype=np.uint64)).tolist())) <= nearcopies.PERMUTATIONS
