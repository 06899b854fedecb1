from cliploom.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, part int, speaker string"


def run(spark, rows, **kw):
    out = dialogues.rotate(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA), **kw).collect()
    return {(r["conv_id"], r["speaker"], r["part"]): (r["text"], [r["text"][m["start"] : m["end"]] for m in r["mask"]], r["n_turns"]) for r in out}


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hö 日"), (1, 3, "ann", None), (1, 4, "cy", "")]
    got = run(spark, rows)
    assert set(got) == {(1, s, 0) for s in ("ann", "bob", "cy")}
    o, c = dialogues.OPEN, dialogues.CLOSE
    text, own, n = got[(1, "ann", 0)]
    assert text == (f"{o}system\nBe kind.{c}{o}assistant\nHi{c}{o}user name=bob\nHö 日{c}{o}assistant\n{c}{o}user name=cy\n{c}")
    assert own == ["Hi<|im_end|>", "<|im_end|>"] and n == 5
    assert got[(1, "bob", 0)][1] == ["Hö 日<|im_end|>"]


def test_parts_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 3, None, "who"), (1, 5, "b", "y"), (1, None, "a", "last"), (None, 1, "a", "q"),
            (2, 1, "system", "only"), (3, 1, None, "none")]
    got = run(spark, rows, part_turns=2)
    assert set(got) == {(1, s, p) for s in "ab" for p in (0, 1, 2, None)} | {(None, "a", 0)}
    assert got[(1, "a", 0)][1] == ["x<|im_end|>"] * 2 and got[(1, "b", 0)][1] == []
    assert got[(1, "a", 1)][0] == f"{dialogues.OPEN}user\nwho{dialogues.CLOSE}"
    assert got[(1, "a", None)][1] == ["last<|im_end|>"]


def test_no_turns(spark):
    assert run(spark, []) == {}


def test_long_dialogue_and_marks_in_texts(spark):
    """Five thousand turns over ten parts; marks inside a text stay as they are."""
    rows = [(1, i, "ab"[i % 2], f"turn {i} <|im_end|>\n") for i in range(5000)]
    got = run(spark, rows)
    assert set(got) == {(1, s, p) for s in "ab" for p in range(10)} and sum(v[2] for v in got.values()) == 2 * 5000
    whole = "".join(got[(1, "a", p)][0] for p in range(10))
    head = {"a": "assistant\n", "b": "user name=b\n"}
    assert whole == "".join(f"{dialogues.OPEN}{head[r[2]]}{r[3]}{dialogues.CLOSE}" for r in rows)
    assert got[(1, "b", 9)][1][-1] == "turn 4999 <|im_end|>\n<|im_end|>"


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = dialogues.rotate(df)._jdf.queryExecution().executedPlan().toString()
    grouped = plan[plan.index("collect_list") :]
    before = plan[: plan.index("collect_list")]
    assert "hashpartitioning(key" not in before and grouped.count("hashpartitioning(key") >= 1
