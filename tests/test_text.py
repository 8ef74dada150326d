import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import fusion, messages, templates, text, tokens
from tessera.operators import columns, docs, samples


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ("a ```python\nx = 1\n``` b", "x = 1"),
        ("nothing here", ""),
        ("", ""),
        ("<code>\ny\n</code>", "y"),
        ("`<CODE>` <CODE>z</CODE> `</CODE>`", "z"),
        ("CODE>\nq\n</CODE>", "q"),
        ("<CODE>one</CODE> <CODE>two</CODE>", "two"),
        ("<CODE>```python\nin fence\n```</CODE> and ```python\nout\n```", "in fence"),
        ("<CODE>open only", ""),
        ("<CODE></CODE>", ""),
    ],
)
def test_code(spark, response, want):
    assert one(spark, text.last_code, response) == want


def test_blocks_and_plan(spark):
    assert one(spark, text.code_blocks, "<CODE>1</CODE><CODE> 2 </CODE>") == ["1", "2"]
    assert one(spark, lambda c: text.pick(text.code_blocks(c), 0), "<CODE>1</CODE><CODE>2</CODE>") == "1"
    assert one(spark, lambda c: text.pick(text.code_blocks(c), 5), "<CODE>1</CODE>") == ""
    assert one(spark, text.last_plan, "<plan>```text\np\n```</plan>") == "p"
    assert one(spark, text.last_plan, "```text\np\n```") == ""


@given(st.text(alphabet="ab \n\t_=()", max_size=30))
@settings(max_examples=25, deadline=None)
def test_extraction_undoes_formatting(spark, code):
    said = templates.fill(templates.PLAIN["completion"], code=F.lit(code))
    assert spark.range(1).select(text.last_code(said)).first()[0] == re.sub(r"\A[ \t\n]+|[ \t\n]+\Z", "", code)


@pytest.mark.parametrize(
    ("said", "thinking", "completion"),
    [("no token\n", "", "no token"), ("</think>at start", "", "</think>at start"), ("a</think>\nb\n", "a", "b"), ("a</think>b</think>c", "a</think>b", "c"), ("", "", "")],
)
def test_thinking(spark, said, thinking, completion):
    assert (one(spark, text.thinking, said), one(spark, text.completion, said)) == (thinking, completion)


@pytest.mark.parametrize(
    ("log", "want"),
    [("", "NONE"), ("a\nb\nc", "a\nb\nc"), ("\n".join(map(str, range(15))), "\n".join(map(str, range(5, 15)))), ("a\nb\n", "a\nb"), ("a\r\nb", "a\nb")],
)
def test_error_tail(spark, log, want):
    assert one(spark, text.error_tail, log) == want


def test_small_parsers(spark):
    assert one(spark, text.strip_ansi, "\x1b[1;31mred\x1b[0m") == "red"
    assert one(spark, text.is_blank, " \t\n") and one(spark, text.is_blank, None) and not one(spark, text.is_blank, " x ")
    assert one(spark, text.first_choice, '{"choices":[{"message":{"content":"hi"}}]}') == "hi"
    assert one(spark, text.first_choice, "{}") == "" and one(spark, text.first_choice, "not json") == ""
    assert one(spark, text.before_examples, "Does it.\n\nExamples\n>>> x") == "Does it."
    assert [one(spark, f, "a.b.c") for f in (text.dotted_head, text.dotted_rest)] == ["a", "b.c"]
    assert [one(spark, f, "abc") for f in (text.dotted_head, text.dotted_rest)] == ["abc", "abc"]
    assert re.fullmatch(r"s_[0-9a-f]{12}_\d+", spark.range(1).select(text.unique_name("s")).first()[0])


def test_templates(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    assert df.select(templates.fill("{b}-{a}-{b} {{}}", a=F.col("a"), b=F.col("b"), c=F.col("a"))).first()[0] == "y-x-y {}"
    with pytest.raises(KeyError):
        templates.fill("{gone}", a=F.col("a"))
    assert {k: templates.slots(u) for k, (_, u) in templates.TEMPLATES.items()} == {
        "plan": ["reviewed_description"],
        "code_with_plan": ["reviewed_description", "code_plan"],
        "code": ["reviewed_description"],
        "docs_feedback": ["reviewed_description", "initial_code", "api_info", "render_errors"],
        "docs": ["reviewed_description", "initial_code", "api_info"],
        "feedback": ["reviewed_description", "initial_code", "render_errors"],
    }


def test_messages(spark):
    df = spark.createDataFrame([("u", "c")], "u string, c string")
    system = F.lit("s")
    p = df.select(messages.prompt(system, F.col("u")).alias("p"), messages.prompt(system, F.col("u"), False).alias("q"), messages.completion(F.col("c")).alias("c"))
    row = p.first()
    assert [tuple(m) for m in row["p"]] == [("system", "s"), ("user", "u")] and [tuple(m) for m in row["q"]] == [("user", "s\n\nu")]
    assert p.select(messages.render(F.concat("p", "c"), "<", ">")).first()[0] == "<system\ns><user\nu><assistant\nc>"
    assert p.select(messages.render("c" and F.col("c"), "<", ">", "d", True)).first()[0] == "<system\nd><assistant\nc><assistant\n"


def test_samples(spark):
    df = spark.createDataFrame([("draw a dot", "Dot()", "test")], "`Reviewed Description ` string, Code string, Split string")
    row = samples.prepare(df).first()
    assert row["expected_code"] == "Dot()" and row["prompt"][1]["content"].endswith("\n/no_think") and "draw a dot" in row["prompt"][1]["content"]
    assert samples.prepare(df).columns == ["prompt", "completion", "expected_code"]
    assert samples.for_tuning(samples.prepare(df)).columns == ["messages"]
    with pytest.raises(ValueError, match="missing columns: nope, gone"):
        samples.prepare(df, "nope", "gone")
    plain = spark.createDataFrame([("a bb", "c dd")], "`Reviewed Description` string, Code string")
    ids, mask, labels = samples.tokenised(plain, 20).first()
    assert len(ids) == len(mask) == len(labels) == 20 and sum(mask) == len([i for i in ids if i])
    first = next(i for i, x in enumerate(labels) if x != tokens.IGNORED)
    assert labels[:first] == [tokens.IGNORED] * first and labels[first:] == ids[first:] and ids[first:][:3] == [1, 2, 4]


def test_tokens(spark):
    df = spark.createDataFrame([([5, 7, 6, 7, 8],), ([1, 2],), ([],)], "ids array<int>")
    rows = [r["s"] for r in df.select(tokens.split_last(F.col("ids"), 7).alias("s")).collect()]
    assert [(r["thinking"], r["answer"]) for r in rows] == [([5, 7, 6, 7], [8]), ([], [1, 2]), ([], [])]
    assert [r[0] for r in df.select(tokens.pad(F.col("ids"), 3)).collect()] == [[5, 7, 6], [1, 2, 0], [0, 0, 0]]
    assert [r[0] for r in df.select(tokens.without_prompt(F.col("ids"), F.lit(2))).collect()] == [[6, 7, 8], [], []]


def test_names(spark):
    assert [columns.tidy(" A B "), columns.tidy(" A B ", False)] == ["a_b", "_a_b_"]
    df = spark.createDataFrame([(1, 2)], "`A B` int, c int")
    assert columns.normalise_names(df).columns == ["a_b", "c"]
    with pytest.raises(ValueError, match="differ"):
        columns.normalise_names(df, like=["A B"])
    with pytest.raises(ValueError, match="clash"):
        columns.normalise_names(spark.createDataFrame([(1, 2)], "`a ` int, ` a` int"))
    assert columns.head(df, -1, "c").count() == 1 and columns.head(df, 1, "c").count() == 1


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    rows = columns.global_row_number(df.repartition(7), "n", "k").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1000))


def test_labels_and_checks(spark):
    assert one(spark, fusion.adapter_label, "out/m_lora_r8_x/checkpoint-632") == "r8_x_checkpoint-632"
    assert one(spark, fusion.adapter_label, "out/m_lora_r8_x") == "r8_x"
    assert one(spark, fusion.sanitised, "a/b-c.d") == "a_b_c_d"
    assert len(fusion.MODES) == 16
    with pytest.raises(ValueError):
        fusion.weighted(F.lit(1.0), F.lit(1.0), 1.5)
    with pytest.raises(Exception, match="rounds"):
        one(spark, lambda c: fusion.checked_range(c, 1, 10, "rounds"), 11, "int")
    df = spark.createDataFrame([(-1.0, 4.0), (4.0, 9.0)], "a double, b double")
    assert [r[0] for r in df.select(fusion.geometric(F.col("a"), F.col("b"))).collect()] == [0.0, 6.0]


def test_docs(spark):
    names = spark.createDataFrame([("Known",), ("Gone",)], "name string")
    dimension = spark.createDataFrame([("Known", "(x)", "Does it.\nExamples: none")], "name string, sig string, doc string")
    found = {r["name"]: (r["sig"], r["doc"]) for r in docs.look_up(names, dimension).collect()}
    assert found["Gone"] == ("()", "Nothing is documented under Gone.") and found["Known"][0] == "(x)"
    programs = spark.createDataFrame([(1, ["Known"], ["Gone"]), (2, [], [])], "k int, calls array<string>, assignments array<string>")
    got = {r["k"]: r["api_info"] for r in docs.notes(programs, dimension, "k").collect()}
    assert got[1] == "- **Gone** (property/variable) - Nothing is documented under Gone.\n\n- **Known**: signature `(x)` - Does it.\n" and got[2] == "\n"


def test_tokenised_splits_each_text_once(spark):
    rows = spark.createDataFrame([("a bb", "ccc d"), ("", "x"), ("a", None), ("w " * 30, "y")], "reviewed_description string, code string")
    found = samples.tokenised(rows, 20)
    # Inside a lambda, or once for each output, a text would be split over and over.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    got = [tuple(r) for r in found.collect()]
    assert all(len(x) == 20 for k in (0, 1, 3) for x in got[k]) and got[2][0] is got[2][2] is None
    assert got[3][2] == [-100] * 20 and got[3][1] == [1] * 20
