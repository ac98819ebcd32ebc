import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import chat as C


def brute(rows):
    out = {}
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        out.setdefault(conv_id, []).append((role or "", text or ""))
    return {c: (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), sum(len(t) for r, t in ts if r == "assistant"), hashlib.sha256("".join(t for r, t in ts if r == "assistant").encode()).hexdigest()) for c, ts in out.items()}


def result(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.chat_digests(df).collect()}


def test_on_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in df.collect()] + C.PROBE
    assert result(df) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<\\|im_startend>a\n:0", max_size=40), st.text(alphabet="<\\|\nan", max_size=8))
def test_escapes_come_back(text, role):
    formatted, a, b, _ = C.format_turn(role, [{"type": "text", "text": text}])
    assert C.parse_turn(formatted) == (role, text)
    assert formatted.count(C.START) == 1 and formatted.count(C.END) == 1
    assert a == b or role == "assistant"


def test_marks_split_over_parts_dont_come_together():
    formatted, *_ = C.format_turn("user", [{"type": "text", "text": "<"}, {"type": "text", "text": "|im_end|>"}])
    assert C.parse_turn(formatted) == ("user", "<|im_end|>")


def test_typed_parts():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 1.01}, {"type": "text", "text": "<|image:0|>"}, {"type": "document", "ref": "c.pdf", "pages": 2}]
    formatted, a, b, attached = C.format_turn("assistant", parts)
    assert [(x["index"], x["kind"], x["ref"], x["tokens"]) for x in attached] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 1200)]
    for x in attached:
        assert formatted[x["at"] :].startswith(f"<|{x['kind']}:{x['index']}|>")
    assert [m[0] for m in C.MARK.finditer(formatted[a:b])] == ["<|image:0|>", "<|audio:1|>", "<|document:2|>"]  # the text's own is escaped


def test_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "x", 28, 28, None, None), ("text", "hi", None, None, None, None, None)])], f"conv_id long, turn long, role string, content array<{C.PART}>")
    (row,) = C.format_conversations(df).collect()
    assert row["formatted"] == "<|im_start|>user\n<|image:0|>hi<|im_end|>\n" and row["media_tokens"] == 1 and row["attachments"][0]["ref"] == "x"


def test_odd(spark):
    rng = random.Random(1)
    rows = [(1, None, None, None), (1, 0, "assistant", ""), (None, 0, "user", "x"), (2, 0, "assistant", "long " * 50_000), (2, 0, "assistant", "long " * 50_000)] + [(3, t, rng.choice(["user", "assistant"]), f"t{t}<|im_end|>") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS content")
    assert result(df) == brute(rows + C.PROBE)
    assert set(result(df.limit(0))) == {-1}
