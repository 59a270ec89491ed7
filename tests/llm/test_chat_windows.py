import hashlib

import pytest

from veilwork.llm import chat_windows as cw


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = (
    [(1, i, ["system", "user", "assistant"][min(i, 1 + (i + 1) % 2)], f"turn {i} " + "w " * (i % 9)) for i in range(60)]
    + [(2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "<|end|><|turn|>x<|text|>\\s \\\\l [b] \\"), (2, 2, "a<b", "é\U0001f600")]
    + [(3, None, None, None), (3, 5, "assistant", ""), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (None, 1, "assistant", "no conversation")]
    + [(4, i * 700, "assistant", "x" * 3000) for i in range(9)] + [(5, 0, "system", "only")]
)


@pytest.mark.parametrize("budget,history", [(1024, 2), (60, 2), (40, 0), (1, 1)])
def test_reads_back(spark, budget, history):
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, window string").repartition(3)
    windows = cw.format_windows(frame, budget=budget, history=history)
    got = {r.conv_id: r for r in cw.digests(windows).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == brute(ROWS)
    rows = windows.collect()
    for r in rows:
        assert sum(r.formatted.count(m) for m in ("</s>", "[INST]", "[/INST]")) == 0
        assert r.formatted.count(cw.END) == r.formatted.count(cw.TURN) + r.formatted.count(cw.SEEN)
        assert r.over_budget == (r.n_tokens > budget)
    mine = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.window)
    if budget == 60:
        assert not any(r.over_budget for r in mine) and len(mine) > 5
        assert all(r.formatted.count("system<|text|>turn 0") == 1 for r in mine)  # the system turn is retained
        assert all(r.formatted.count(cw.SEEN) == 3 for r in mine[2:])  # with two turns before the window
    assert sum(r.formatted_chars for r in got.values()) == sum(len(r.formatted) for r in rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cw.digests(cw.format_windows(frame)).count() == 0
