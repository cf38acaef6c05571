import random

from pyspark.sql import functions as F

from tidewatch.llm import chat_format as C

SCHEMA = "conv_id long, seq long, kind string, role string, text string, target int"
CLASHING = ["conv", "at", "n", "slot", "left", "before", "opened", "cut", "turn", "span", "body", "head", "nowhere", "pieces", "since"]


def first(value):
    return (value is not None, value if value is not None else 0)


def folded(events):
    """Each conversation's messages by a plain loop over its events."""
    logs = {}
    for e in events:
        logs.setdefault(e[0], []).append(e)
    out = {}
    for conv, log in logs.items():
        kept = []
        at_all = lambda e: (first(e[1]), (e[2] is not None, e[2] or ""), e[3] or "", e[4] or "", first(e[5] if (e[5] or 0) >= 0 else None), (e[5] or 0) < 0)
        for _, _, kind, role, text, target in sorted(log, key=at_all):
            if kind == "message":
                kept.append([role or "", text or ""])
            elif kind == "delta" and kept:
                kept[-1][1] += text or ""
            elif kind in ("edit", "regenerate"):
                number = len(kept) - 1 if target is None else target
                if 0 <= number < len(kept):
                    kept[number][1] = text or ""
                    if kind == "regenerate":
                        del kept[number + 1 :]
        out[conv] = [tuple(m) for m in kept]
    return out


def checked(df, events):
    want = folded(events)
    shown = C.render(C.messages(df))
    formatted = F.col("formatted")
    rows = shown.select("conv", "formatted", C.read_turns(formatted).alias("turns"), C.learned_text(formatted, F.col("mask")).alias("learned"))
    rows = rows.collect()
    assert {r.conv for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        assert [tuple(t) for t in r.turns] == want[r.conv]
        assert r.learned == "".join(text for role, text in want[r.conv] if role == C.LEARNED)
        assert r.formatted.count("</turn>") == len(want[r.conv])
        assert r.formatted.count("### ") == len(want[r.conv])
    return {r.conv: r.formatted for r in rows}


def test_events_by_hand(spark):
    events = [
        (1, 0, "message", "user", "hello", None),
        (1, 1, "message", "assistant", "", None),
        (1, 2, "delta", None, "go", None),
        (1, 3, "delta", None, "od", None),
        (1, 4, "regenerate", None, "", None),
        (1, 5, "delta", None, "fine", None),
        (1, 6, "message", "user", "more", None),
        (1, 7, "edit", None, "hi", 0),
        (1, 8, "message", "assistant", "no", None),
        (2, 0, "message", "user", "a", None),
        (2, 1, "message", "assistant", "b", None),
        (2, 2, "message", "user", "c", None),
        (2, 3, "regenerate", None, "B", 1),
        (2, 4, "delta", None, "!", None),
        (3, 0, "delta", None, "lost", None),
    ]
    shown = checked(spark.createDataFrame(events, SCHEMA), events)
    assert shown[1] == "### user: hi</turn>\n### assistant: fine</turn>\n### user: more</turn>\n### assistant: no</turn>\n"
    assert shown[2] == "### user: a</turn>\n### assistant: B!</turn>\n"
    assert shown[3] == ""


def test_random_events_against_a_loop(spark):
    rnd = random.Random(4)
    bits = ["\\", "### ", "</turn>", "\n", ": ", "a", "é🙂", "<", "/turn>", "#", "assistant", "\\/", "</turn>\n", "", "$1"]
    kinds = ["message", "message", "delta", "delta", "edit", "regenerate", "odd", None]
    events = []
    for conv in [None, *range(300)]:
        for seq in range(rnd.randint(1, 30)):
            text = rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))])
            role = rnd.choice(["assistant", "user", "assistant", None, ": ", "a:", "### b\\"])
            events.append((conv, rnd.choice([None, seq, seq, seq]), rnd.choice(kinds), role, text, rnd.choice([None, None, 0, 1, 2, 5, -1])))
    df = spark.createDataFrame(events, SCHEMA).withColumns({c: F.lit("extra") for c in CLASHING}).repartition(5)
    checked(df, events)
    assert C.render(C.messages(df.limit(0))).collect() == []


def test_long_conversations(spark):
    events = [(1, i, "message", "assistant" if i % 2 else "user", f"turn {i} ", None) for i in range(3000)]
    events += [(2, 0, "message", "assistant", "word </turn> " * 80_000, None)]
    events += [(3, i, "message" if i == 0 else "delta", "assistant", "piece ", None) for i in range(5000)]
    checked(spark.createDataFrame(events, SCHEMA), events)


def test_no_python_in_the_plan(spark):
    events = spark.createDataFrame([(1, 0, "message", "user", "a", None)], SCHEMA)
    shown = C.render(C.messages(events))
    out = shown.select(C.read_turns(F.col("formatted")), C.learned_text(F.col("formatted"), F.col("mask")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") <= 1
