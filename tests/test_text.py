import pytest
from pyspark.sql import functions as F

from tracewell.functions import answers, reasoning, sentences, text

SLOT = "<answer>...the name of the disease/entity...</answer>"


@pytest.mark.parametrize(
    "response,names,want",
    [
        ("", (), ""),
        ("<answer>Gout</answer>", (), "Gout"),
        ("<answer>Gout</answer> later " + SLOT + "<answer></answer>", (), "Gout"),
        ("<answer>\n<h1>**Mercury\n poisoning**</h1>\n</answer>", (), "Mercury poisoning"),
        ("<answer>see the template</answer>", (), ""),
        ("<answer>" + "x" * 161 + "</answer>", (), ""),
        ("<answer>\xa0PTSD\xa0\n</answer>", (), "PTSD"),
        ("a</answer> PTSD </answer>", ("sandwiched",), "PTSD"),
        ("<think>x</think> It is gout. More", ("prose_after_think",), "It is gout."),
        ("<think>x</think> no end", ("prose_after_think",), "no end"),
        ("<think>x</think>**Gout** rest", ("bold_after_think",), "Gout"),
        ("</think>**a** **b** **c** **d**", ("bold_after_think",), ""),
        ("<answer>A1</answer><answer>B2 unclosed", ("last_opener",), "B2 unclosed"),
        ("<answer>A1</answer><tool_call>answer>B2</answer>", ("tool_call_answer",), "B2"),
        ("Thus the most likely diagnosis is acute gout given the knee. End", ("stated_diagnosis",), "acute gout"),
        ("Final diagnosis: often unclear", ("stated_diagnosis",), ""),
        ("Sarcoidosis is the most likely diagnosis", ("stated_diagnosis",), "Sarcoidosis"),
    ],
)
def test_answers(spark, response, names, want):
    assert answers.extract(response, names) == want
    df = spark.createDataFrame([(response,)], "r string")
    assert df.select(answers.read_answers(F.col("r"), names)).first()[0] == want


def test_unknown_reader():
    with pytest.raises(ValueError):
        answers.extract("x", ["nothing"])


def test_reasoning(spark):
    long = "reasoning " * 20
    cases = [
        ("", None, ("", "empty")),
        ("<|channel|>analysis<|message|>deep<|end|>final", None, ("deep", "harmony")),
        ("assistantanalysisdeep thoughtassistantfinalX", None, ("deep thought", "harmony")),
        (SLOT + "\n\n<think>\nwhy\n<answer>Gout</answer>", None, ("why", "answer_anchored")),
        ("<think>short</think><think>longer one</think>", None, ("longer one", "think_block")),
        ("<think>...</think>## Thinking\n" + long + "<answer>G</answer>", None, (long.strip(), "thinking_section")),
        ("[INST]<think>p[/INST][THINK]inner</think>", "bracket_think", ("inner", "bracket_think")),
        ("<|channel>thought  deep <channel|>x", "gemma_thought", ("deep", "gemma_thought")),
        ("plain text <answer>G</answer><|im_end|>", None, ("plain text", "fallback")),
        ("x</answer>\nPTSD\n</answer>", None, ("x", "fallback")),
    ]
    for response, named, want in cases:
        assert reasoning.extract(response, "", named) == want, response
    got = spark.createDataFrame([(c[0],) for c in cases[1:4]], "r string").select(reasoning.extract_column(F.col("r")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [c[2] for c in cases[1:4]]
    with pytest.raises(ValueError):
        reasoning.extract("x", named="nothing")


def test_sentences():
    body = "First line. Second (E. coli) here.\n1.\nItem **bold.** Next! Now more... and on"
    for rules in sentences.RULES:
        parts = sentences.split(body, rules)
        at = 0
        for p in parts:
            at = body.index(p, at) + len(p)
        assert "".join("".join(parts).split()) == "".join(body.split())
    assert "1.\nItem **bold.**" in sentences.split(body, "outline")
    assert sentences.first_sentence("One. Two.") == "One." and sentences.first_sentence(None) == ""


def test_spans():
    full = "PROMPT one two. three one two."
    tokens = sentences.whitespace_tokens(full)
    n = sentences.prompt_tokens(full, "PROMPT", tokens)
    found = sentences.find_strictly(full, ["one two.", "three", "one two."], tokens, 6, (n, len(tokens)))
    assert [(s["token_start"], s["token_end"]) for s in found] == [(1, 3), (3, 4), (4, 6)]
    assert sentences.find_leniently(full, ["three", "one two.", "two.", "absent"], tokens) == [(3, 4), (4, 6), (2, 3), None]
    assert sentences.token_span([(0, 0), (0, 3), (3, 3), (3, 6)], 2, 4) == (1, 4)
    assert sentences.token_span(tokens, 3, 3) is None
    with pytest.raises(sentences.BoundaryError):
        sentences.find_strictly(full, ["hree"], tokens, 6, (n, len(tokens)))
    with pytest.raises(sentences.BoundaryError):
        sentences.prompt_tokens(full, "OTHER!", tokens)
    assert sentences.prompt_tokens("on 2024-01-02 x y", "on 2025-09-09", sentences.whitespace_tokens("on 2024-01-02 x y")) == 2


def test_expressions(spark):
    df = spark.createDataFrame([("\xa0\t a  b \n", "Left-sided the Abscess, abscess"), (None, None), ("  ", "of the")], "t string, n string")
    got = df.select(text.stripped("t").alias("s"), text.is_blank(F.col("t")).alias("b"), text.content_words(F.col("n")).alias("w")).collect()
    assert [r.s for r in got] == ["a  b", None, ""] and [r.b for r in got] == [False, True, True]
    assert [r.w for r in got] == [["abscess"], [], []]
