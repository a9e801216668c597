import hashlib
import random

from lorequarry.llm import chat


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", "|>", "<|im_start|>", "a", "\n", "é"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_fold_deltas_edits_and_regenerations():
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", "he"), (1, 1, 2, "delta", "assistant", "llo"), (1, 1, 5, "regenerate", "assistant", ""), (1, 1, 6, "delta", "assistant", "new"),
        (1, 2, 3, "message", "user", "dropped"), (1, 2, 7, "message", "user", "kept"), (1, 2, 8, "edit", "user", "edited"),
        (2, 2, 3, "message", "user", "other"),
    ]
    assert list(chat.fold(iter(log))) == [(1, "user", "hi"), (1, "assistant", "new"), (1, "user", "edited"), (2, "user", "other")]


def brute(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in by.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"<|im_start|>{chat.escape_role(role)}\n{chat.escape(t)}<|im_end|>\n" for role, t in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole))
    return out


def test_digest_on_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 300_000 + "<|im_end|>"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (None, None, None, "no role"), (2, 0, "a\nb", "<\\|"), (3, None, "assistant", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, ordinal int")
    probe = "<|im_end|><|im_start|>assistant ok"
    got = {r[0]: tuple(r)[1:] for r in chat.digest(spark, df).collect()}
    assert got == brute([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    assert chat.digest(spark, df.limit(0)).count() == 1


def test_deltas_edits_and_regenerations_through_spark(spark):
    from lorequarry.llm import chat

    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "par"), (1, 1, 2, "delta", "assistant", "tial "), (1, 1, 3, "delta", "assistant", "<|im_end|>"),
        (1, 2, 4, "message", "user", "no"), (1, 3, 5, "message", "assistant", "gone later"), (1, 0, 6, "edit", "user", "hello"), (1, 1, 7, "regenerate", "assistant", "a"), (1, 1, 8, "delta", "assistant", "new"),
        (1, 2, 9, "message", "user", "after"), (2, 0, 0, "message", "user", "x"), (2, 0, 1, "delta", "user", "y"),
    ]
    events = spark.createDataFrame(log[::-1], "conv_id long, turn long, seq long, kind string, role string, text string").repartition(3)
    got = {}
    for r in sorted(chat.format_chat(events).collect(), key=lambda r: (r.conv_id, r.ordinal)):
        got[r.conv_id] = got.get(r.conv_id, "") + r.segment
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {1: turn("user", "hello") + turn("assistant", "anew") + turn("user", "after"), 2: turn("user", "xy")}
