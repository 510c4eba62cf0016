"""Windows keep their budget: beside the system turn, more than that only for one turn alone."""

import random
import re

import pytest

from sediment.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"


def tokens(x):
    return sum(-(-len(r) // 6) for r in re.findall(r"[^\W\d_]+", x)) + len(re.findall(r"\d|[^\w\x20\x09-\x0D]|_", x))


def turns(formatted):
    """(role, cost) of each turn of a window."""
    out = []
    for x in formatted.split(c.START)[1:]:
        role, _, rest = x.partition("\n")
        text = rest[: -len(c.END) - 1]
        undo = lambda v: v.replace("<%7C", "<|").replace("%25", "%")
        out.append((role, tokens(undo(role)) + tokens(undo(text)) + c.MARKS))
    return out


@pytest.mark.parametrize("system", [None, 5, 100, 420, 600])
def test_budget(spark, system):
    rng, rows = random.Random(system or 0), []
    for conv in range(12):
        n = 0
        if system is not None:
            rows.append((conv, 0, "system", "be kind " * (system // 2)))
            n = 1
        for k in range(rng.randint(1, 40)):
            size = rng.choice([1, 8, 30, 30, 90, 200 if conv % 3 else 700])
            rows.append((conv, n + k, "user" if k % 2 else "assistant", " ".join(rng.choice(["ab", "7", "longerword", "x,y", "<|%"]) for _ in range(size))))
    df = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    for w in c.format_windows(df, budget=512, history=64).collect():
        t = turns(w.formatted)
        head = int(system is not None)
        own = [cost for i, (_, cost) in enumerate(t) if i >= w.n_repeated and not (w.window == 0 and i == 0 and head)]
        total = sum(cost for _, cost in t)
        history = sum(cost for _, cost in t[: w.n_repeated]) - (t[0][1] if head and w.window else 0)
        assert not head or t[0][0] == "system"
        assert history <= 64
        assert total <= 512 or len(own) <= 1, (w.window, t)
        if head and t[0][1] > 512 - 64 - 128:
            assert history == 0
        seen[w.conv_id] = seen.get(w.conv_id, 0) + len(own) + (head if w.window == 0 else 0)
    assert seen == {k: sum(r[0] == k for r in rows) for k in range(12)}


def test_over_full_system_turn(spark):
    """The case of a 420-word system turn and turns of 30 words."""
    rows = [(1, 0, "system", "abc " * 420)] + [(1, i, "user" if i % 2 else "assistant", "abc " * 30) for i in range(1, 40)]
    w = c.format_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(w) > 10 and all(sum(x for _, x in turns(r.formatted)) <= 512 for r in w)
