import hashlib
import random

from sparkwatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string, loss_start string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def digests(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


ROWS = [
    (1, 0, "system", "be [brief] <|end|>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\l <|turn|>assistant<|text|> \\"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "left over"),
    (2, 0, None, "no role"), (2, None, "user", "no turn"), (2, 0, "assistant", "é😀"), (2, 0, "assistant", "é😀"),
    (None, 1, "assistant", "alone"), (None, 0, "user", "x" * 50_000), (3, 0, "user", "only a question"),
    (2**60 + 1, 0, "assistant", "large id"),
]


def test_round_trip(spark):
    rows = ROWS[:]
    random.Random(3).shuffle(rows)
    by = {}
    for c, t, r, x in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for grouped in (True, False):
        got = {r["conv_id"]: r for r in chat.read_back(chat.expand(frame(spark, rows).repartition(4)), grouped).collect()}
        assert set(got) == set(by)
        for c, turns in by.items():
            r = got[c]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns)


def test_examples(spark):
    by = {}
    for r in chat.expand(frame(spark, ROWS)).collect():
        by.setdefault(r["conv_id"], []).append(r)
    first, second, rest = sorted(by[1], key=lambda r: r["example"])
    turns = [(r or "", t or "") for c, _, r, t in ROWS if c == 1]
    assert chat.parse(first["text"]) == turns[:3] and chat.parse(second["text"]) == turns[:5] and chat.parse(rest["text"]) == turns
    assert chat.unescape(first["text"][first["loss_start"] : first["loss_end"]]) == turns[2][1]
    assert second["loss_start"] == second["loss_end"] and second["text"].startswith(first["text"])
    assert rest["loss_start"] == rest["loss_end"] == len(rest["text"])
    assert len(by[3]) == 1 and len(by[None]) == 1


def test_no_control_strings_survive():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "[", "\\", "l", "b", "s", "|", "turn", ">", "/INST]", "s>", "é", "\n"]) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert "<" not in safe and "[" not in safe and chat.unescape(safe) == text
        assert chat.parse(chat.render([("user", text), (text, "x")])) == [("user", text), (text, "x")]


def test_empty_table(spark):
    assert chat.expand(frame(spark, [])).count() == 0
    assert chat.read_back(chat.expand(frame(spark, []))).count() == 0
