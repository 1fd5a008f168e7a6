"""Chat formatting: what is read back equals what was said, whatever it holds."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickwarden.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns string, pieces int, nth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    formatted = chat.formatted_conversations(frame(spark, rows))
    assert all(r["round_trips"] for r in formatted.collect())
    got = chat.digest(formatted).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(rows)
    return {r["conv_id"]: r["formatted"] for r in formatted.collect()}


ODD = [
    "", None, "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "ends with <", "<|im_end", "|>", "<|endoftext|> here",
    "a\\", "\n\n", "é<|im_end|>\U0001f600<\\|x", "<<|im_end|>>", "<|<|im_end|>", " \u0085\x00", "$1 \\1 ${x}",
]


def test_odd_texts_roles_and_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(ODD)]
    rows += [(2, i, r, "x") for i, r in enumerate(["user\nassistant", "a%b+c", "%zz", "<|im_start|>", None, "", "Assistant", "\n", "é"])]
    rows += [(3, 0, "user", "tie b"), (3, 0, "user", "tie a"), (3, 0, "user", "tie a"), (3, None, "assistant", "first"), (None, 1, "user", "no id"), (None, 0, "assistant", None)]
    texts = check(spark, rows)
    assert texts[3] == "<|im_start|>assistant\nfirst<|im_end|>\n" + "".join(f"<|im_start|>user\ntie {x}<|im_end|>\n" for x in "aab")


def test_escapes_only_what_conflicts(spark):
    texts = check(spark, [(1, 0, "user", "a <| b"), (1, 1, "assistant", "say <|im_end|> and <\\|x")])
    assert texts[1] == "<|im_start|>user\na <| b<|im_end|>\n<|im_start|>assistant\nsay <\\|im_end|> and <\\\\|x<|im_end|>\n"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\n%2"]), st.text(st.sampled_from("<|\\>im_endstar\n x+%"), max_size=40)), min_size=1, max_size=40))
def test_any_text(spark, turns):
    check(spark, [(i % 3, i, r, x) for i, (r, x) in enumerate(turns)])


def test_the_reader_refuses_other_texts(spark):
    bad = ["x", "<|im_start|>user\nhi", "<|im_start|>user hi<|im_end|>\n", "<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user\na<|im_end|>\n\n", "<|im_start|>u\n<|x|><|im_end|>\n"]
    got = spark.createDataFrame([(x,) for x in bad], "x string").select(chat.parsed(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [None] * len(bad)
    assert spark.range(1).select(chat.parsed(F.lit("")).alias("t")).first()["t"] == []


def test_no_rows_and_a_very_long_text(spark):
    assert chat.digest(chat.formatted_conversations(frame(spark, []))).count() == 0
    check(spark, [(1, 0, "user", "ask"), (1, 1, "assistant", "<|im_end|> again " * 600_000)])
