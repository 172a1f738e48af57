import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from galewright.llm.leakage import FMIndex, Searcher, Vocabulary, align, leaked_items, leaked_spans, removal_spans, suffix_array, words_of

ITEM = (
    "Suppose the quiet turbine is given seventeen hours per mutation step; what happens to its dropout setting once the weight store has been disabled "
    "and the older parent was already extinct? Compute the expected sampling weight after the edge table is halved eight times over."
)
OTHER = "Of three hundred runs with a dense loss curve, forty ended early since a cable was loose; estimate the share that a student team would have archived by hand."
FILL = "The nightly crew wrote that the gearbox oil was warm and nobody looked at the charts before lunch. "


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(xs):
    s = np.array(xs, np.int64)
    assert list(suffix_array(s)) == sorted(range(len(xs)), key=lambda i: xs[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 4), min_size=2, max_size=2), min_size=1, max_size=8))
def test_search_and_locate(xs, phrases):
    index = FMIndex(np.array(xs, np.int64), 4)
    lo, hi = index.search(np.array(phrases, np.int64))
    for p, a, b in zip(phrases, lo, hi):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(xs) - 1) if xs[i : i + 2] == p]


def test_words():
    assert words_of("Pоwer &amp; <b>Wind</b>speed 0.62, vali-\n dated Café") == ["power", "windspeed", "0.62", "validated", "cafe"]
    v = Vocabulary([["turbine", "step", "steps"]])
    assert list(v.encode(["turbien", "turbin", "trubine", "stepz", "xyz"]) > 0) == [True, True, True, False, False]


def test_alignment():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert align(a, np.array([9, 2, 3, 4, 9])) == (3, 1, 4, 1, 4)
    assert align(a, np.array([0, 0])) == (0, 0, 0, 0, 0)


def items(spark, rows=((1, ITEM), (2, OTHER))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def found(spark, texts, rows=((1, ITEM), (2, OTHER)), **more):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    return {(r["doc_id"], r["item_id"]) for r in leaked_items(df, items(spark, rows), **more).collect()}


def test_kinds_of_leaks(spark):
    w = ITEM.split()
    look = ITEM.replace("o", "о").replace("a", "а")
    changed = " ".join("thing" if k % 11 == 5 else x for k, x in enumerate(w))
    typos = " ".join(x[:2] + x[3:] if k % 7 == 3 and len(x) > 5 else x for k, x in enumerate(w))
    texts = [
        FILL + ITEM + FILL, FILL + ITEM.upper(), FILL + " ".join(w[10:26]) + " " + FILL, look.replace(" ", " "), changed, typos,
        FILL + " ".join(w[:20]) + " " + FILL + " ".join(w[20:]), ITEM.replace("mutation", "muta-\ntion"), "<p>" + ITEM.replace("quiet", "<b>quiet</b>") + "</p>", ITEM.replace(" ", "  \n"), FILL * 300 + ITEM, OTHER,
    ]
    assert found(spark, texts) == {(k, 1) for k in range(11)} | {(11, 2)}


def test_copies_among_the_items(spark):
    rows = tuple((k, ITEM) for k in range(6)) + tuple((10 + k, ITEM.replace("eight", w)) for k, w in enumerate(("two", "three", "four", "five")))
    got = found(spark, [FILL + ITEM], rows)
    assert {(0, k) for k in range(6)} <= got and {(0, 10 + k) for k in range(4)} <= got


def test_no_leaks(spark):
    w = ITEM.split()
    assert found(spark, [FILL * 3, " ".join(w[4:16]), FILL + " ".join(w[3:14]) + FILL, "", None, "turbine", " ".join(reversed(w))]) == set()


def test_short_items_nulls_and_blocks(spark):
    rows = ((1, ITEM), (2, OTHER), (3, None), (4, ""), (None, ITEM), (5, "the older parent was already extinct"), (6, "forty ended early"), (7, "Suppose"), (8, "forty ended late"))
    want = {(0, 1), (1, 2), (0, 5), (1, 6), (0, 7)}
    assert found(spark, [ITEM, OTHER], rows) == want
    assert found(spark, [ITEM, OTHER], rows, block_chars=1, shard_words=5) == want
    assert found(spark, [ITEM], ()) == set() and found(spark, []) == set()


# An item of 24 words, and what a document may hold of it.
LONG = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray".split()


def split_at(start, first, second):
    """A passage in two pieces with other text between."""
    return " ".join([*LONG[start : start + first], FILL, *LONG[start + first : start + first + second]])


def test_two_pieces_of_fifteen_words_together(spark):
    rows = ((1, " ".join(LONG)),)
    whole = [split_at(0, 9, 9), split_at(2, 7, 13), split_at(0, 8, 8), split_at(0, 12, 8), split_at(3, 4, 11), split_at(5, 11, 4), split_at(0, 7, 8)]
    no = [split_at(0, 7, 7), split_at(0, 12, 2), " ".join([*LONG[:8], FILL, *LONG[10:18]]), " ".join(LONG[:12])]
    assert found(spark, whole + no, rows) == {(k, 1) for k in range(len(whole))}


def test_one_changed_word_in_fifteen(spark):
    rows = ((1, " ".join(LONG)),)
    change = lambda a, n, k: " ".join("zzzz" if j == k else w for j, w in enumerate(LONG[a : a + n]))
    drop = " ".join(w for j, w in enumerate(LONG[2:20]) if j != 9)
    added = " ".join([*LONG[2:10], "zzzz", *LONG[10:18]])
    assert found(spark, [FILL + change(3, 15, 7) + " " + FILL, FILL + change(2, 18, 8), drop, added, change(3, 13, 6), change(0, 12, 20)], rows) == {(k, 1) for k in range(4)}


def test_another_number_is_another_question(spark):
    w = LONG[:9] + ["42"] + LONG[9:15]
    texts = [" ".join(w), " ".join(w).replace("42", "43")]
    assert found(spark, texts, ((1, " ".join(LONG[:9] + ["42"] + LONG[9:])),)) == {(0, 1)}


def test_ways_of_asking_are_no_leak(spark):
    rows = [(k, f"Given that the {a} crew of {a} hall counts the spare parts each week compute how many of the {b} tools are left over by {b} noon") for k, (a, b) in enumerate((x, y) for x in LONG[:12] for y in LONG[12:24:3])]
    asked = "Given that the night crew of our hall counts the spare parts each week compute how many of the good tools are left"
    assert found(spark, [asked], rows) == set()


def test_pieces_of_another_leaked_item_are_its_own(spark):
    """The document holds the first item; what the second has in common with it stands there as a part of the first."""
    first = LONG[:8] + ["one", "two", "three"] + LONG[8:16]
    rows = ((1, " ".join(first)), (2, " ".join(LONG[:16] + ["four", "five"])))
    assert found(spark, [" ".join(first), split_at(0, 8, 8)], rows) == {(0, 1), (1, 2)}


def test_tags_of_any_length(spark):
    for n in (5, 260, 5_000):
        assert found(spark, [ITEM.replace(" ", f' <span title="{"x" * n}">')], ((1, ITEM),)) == {(0, 1)}


def test_spans_and_removal(spark):
    df = spark.createDataFrame([(1, FILL + ITEM + " " + OTHER), (2, FILL), (3, split_at(2, 8, 9))], "doc_id long, text string")
    spans = leaked_spans(df, items(spark, ((1, ITEM), (2, OTHER), (3, ITEM), (4, " ".join(LONG)))))
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["past_word"]) for r in spans.collect()}
    n, m, o = len(words_of(FILL)), len(words_of(ITEM)), len(words_of(OTHER))
    assert got == {(1, 1, n, n + m), (1, 3, n, n + m), (1, 2, n + m, n + m + o), (3, 4, 0, 8), (3, 4, 8 + n, 17 + n)}
    merged = {(r["doc_id"], r["first_word"], r["past_word"], r["n_items"]) for r in removal_spans(spans).collect()}
    assert merged == {(1, n, n + m + o, 3), (3, 0, 8, 1), (3, 8 + n, 17 + n, 1)}


def test_recall_against_brute_force():
    """Every passage of 15 words and more in random documents is found, whatever the shards."""
    rng = np.random.default_rng(3)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}" for i in range(300)]
    texts = [[vocabulary[i] for i in rng.integers(0, 300, 60)] for _ in range(20)]
    s = Searcher([(k, " ".join(t)) for k, t in enumerate(texts)])
    docs, want = [], set()
    for d in range(60):
        base = [vocabulary[i] for i in rng.integers(0, 300, 120)]
        if d % 2:
            k, a, n = int(rng.integers(20)), int(rng.integers(40)), int(rng.integers(15, 20))
            base[30:30] = texts[k][a : a + n]
            want.add((d, k))
        docs.append(s.vocabulary.encode(base))
    assert {(d, i) for d, i, _, _ in s.shard(docs)} == want
    assert {(d + k * 20, i) for k in range(3) for d, i, _, _ in s.shard(docs[k * 20 : k * 20 + 20])} == want
