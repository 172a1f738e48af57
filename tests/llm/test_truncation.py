import pytest

from galewright.llm.truncation import cut_share, cut_texts, judged_texts


def corpus():
    things = ["rotor", "filter", "sensor", "gearbox", "pump", "mast"]
    whole = []
    for k in range(240):
        a, b = things[k % 6], things[(k // 6) % 6]
        s = f"The {a} of unit {k % 9} was checked and the {b} showed a change of about {k % 7}.{k % 9}{k % 5} percent in the morning. We saw {k} warnings about the {a}."
        whole.append(s + ["", "\nRegards, the night crew", "\n-- sent from the tower", "\n```\nrun --unit 3\n```", "\n| step | mse |\n| 3 | 0.5 |", " (see above)"][k % 6])
    return whole


CUT = [
    "The pump of unit 3 was checked and the mast showed a chan", "The pump of unit 3 was checked and the", "The pump of unit 3 was checked and the rotor showed a change of about 3.", "We saw 7 warnings about", "We saw 9 warnings about the  \n ",
    "The pump of unit 4 was checked and the …", "The pump of unit 4 was checked and th [cut]", "We saw 3 warnings about the pump.\n```\nrun --un", "We saw 3 warnings about the pump.\nRegards, the ni",
]
WHOLE = ["We saw 3 warnings about the pump.", "We saw 3 warnings about the pump?  \n", "We saw 9 warnings about the mast.\nRegards, the night crew", 'He said "we saw 3 warnings about the pump."', "We saw 3 warnings about the pump. :-)", "We saw 3 warnings about the pump. (see above)"]


def frame(spark):
    rows = [(k, t, "s", 1) for k, t in enumerate(corpus())]
    rows += [(1000 + k, t, "cut", 1) for k, t in enumerate(CUT)] + [(2000 + k, t, "ok", 1) for k, t in enumerate(WHOLE)] + [(3000, None, "ok", 1), (3001, "", "ok", 1), (3002, " \n\t", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, gram int")


def test_cut_and_whole_texts(spark):
    assert {r["doc_id"] for r in cut_texts(frame(spark)).collect()} == {1000 + k for k in range(len(CUT))}


def test_copies_of_a_cut_text_stay_cut(spark):
    copies = spark.createDataFrame([(5000 + k, CUT[0], "cut", 1) for k in range(400)], "doc_id long, text string, source string, gram int")
    got = {r["doc_id"] for r in cut_texts(frame(spark).unionByName(copies)).collect()}
    assert got == {1000 + k for k in range(len(CUT))} | {5000 + k for k in range(400)}


def test_shares(spark):
    got = {r["source"]: (r["n_texts"], r["n_cut"]) for r in cut_share(frame(spark)).collect()}
    assert got == {"s": (240, 0), "cut": (len(CUT), len(CUT)), "ok": (len(WHOLE), 0)}


@pytest.mark.parametrize("text", ["x" * 200_000, "word " * 40_000, "é́ 🌬️", "¶ ∎ | ' \" \\ {x}", "0", "...", "." * 50_000, "." * 50_000 + "x", "a" + " " * 100_000 + "x", "a." + "!" * 50_000 + " b )", "\n" * 50_000 + "y", "(" * 50_000 + ".)"])
def test_odd_texts_come_out_once(spark, text):
    df = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    assert judged_texts(df).count() == 1
    assert judged_texts(df.where("false")).collect() == []


@pytest.mark.parametrize("size", [10, 2_600, 60_000])
def test_remarks_and_table_rows_of_any_length(spark, size):
    long = "x " * (size // 2)
    texts = {1: f"We saw 3 warnings about the pump. ({long})", 2: f"We saw 3 warnings about the pump.\n| step | {long} |", 3: f"We saw 3 warnings about the pump. [{long}] </p> :-)", 4: f"We saw 3 warnings about the ({long})"}
    df = frame(spark).unionByName(spark.createDataFrame([(7000 + k, t, "long", 1) for k, t in texts.items()], "doc_id long, text string, source string, gram int"))
    whole = {r["key"]: r["whole"] for r in judged_texts(df).where("key > 7000").collect()}
    assert whole == {7001: True, 7002: True, 7003: True, 7004: False}


def test_the_counts_decide(spark):
    """A trigram that goes on elsewhere is a cut; of unknown ones shorter grams tell; what the corpus doesn't know is no cut."""
    rows = {1: "The pump of unit 3 was checked and the", 2: "We saw a gearbox and the", 3: "The pump of unit 3 was checked and the ro", 4: "Zyx wvut srq", 5: "We saw 3 warnings about the pump.\nRegards, the night crew"}
    df = frame(spark).unionByName(spark.createDataFrame([(7000 + k, t, "x", 1) for k, t in rows.items()], "doc_id long, text string, source string, gram int"))
    got = {r["key"] - 7000: (r["is_cut"], r["level"]) for r in judged_texts(df).where("key > 7000").collect()}
    assert got == {1: (True, 3), 2: (True, 2), 3: (True, 0), 4: (False, None), 5: (False, 3)}


def test_three_different_texts_make_an_ending_usual(spark):
    """Two texts and a copy are two; the same ending in three different texts is known as one."""
    texts = lambda n: [(8000 + k, f"We saw {['rotor', 'filter', 'sensor'][k % n]} warnings about the pump.\nqqa qqb qqc", "x", 1) for k in range(3)]
    for n, level in ((2, None), (3, 3)):
        df = frame(spark).unionByName(spark.createDataFrame(texts(n), "doc_id long, text string, source string, gram int"))
        assert {(r["is_cut"], r["level"]) for r in judged_texts(df).where("key >= 8000").collect()} == {(False, level)}
