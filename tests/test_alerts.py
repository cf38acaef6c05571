import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as C

START = datetime(2024, 1, 1)
SCHEMA = (
    "id string, anomaly_type string, severity string, score double, source string, detected_at timestamp, "
    "description string, context string, sample_lines array<string>, alerted boolean"
)


def anomaly(name, seconds, severity="high", source="app", kind="novel_pattern", template="t1", samples=("one", "two")):
    context = json.dumps({"template_id": template} if template else {"z_score": 1.0})
    at = START + timedelta(seconds=seconds)
    return (name, kind, severity, 0.92, source, at, f"about {name}", context, list(samples), False)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def channels(spark, **minimum):
    return spark.createDataFrame(list(minimum.items()), "channel_type string, min_severity string")


def test_routing(spark):
    found = table(spark, *[anomaly(s, 0, s) for s in ("low", "medium", "high", "critical")])
    routed = C.route(found, channels(spark, telegram="medium", slack="critical"))
    assert sorted((r.id, r.channel_type) for r in routed.collect()) == [
        ("critical", "slack"), ("critical", "telegram"), ("high", "telegram"), ("medium", "telegram")
    ]
    assert {r.id for r in C.routable(found, channels(spark, a="high", b="critical")).collect()} == {"high", "critical"}


def kept_by_hand(rows, minutes, running=()):
    free = dict(running)
    kept = []
    for name, kind, _, _, source, at, _, context, *_ in sorted(rows, key=lambda r: (r[5], r[0])):
        key = (source, kind, json.loads(context).get("template_id") or "")
        if key not in free or at >= free[key]:
            kept.append(name)
            free[key] = at + timedelta(minutes=minutes)
    return sorted(kept)


def test_cooldown_blocks_repeats(spark):
    rows = [anomaly("a", 0), anomaly("b", 60), anomaly("c", 1799), anomaly("d", 1800), anomaly("e", 1801, template="t2")]
    assert sorted(r.id for r in C.cooldown_kept(table(spark, *rows)).collect()) == ["a", "d", "e"]


@pytest.mark.parametrize("seed", range(4))
def test_cooldown_against_a_loop(spark, seed):
    random.seed(seed)
    span = [20_000, 400_000, 3_000_000, 300_000][seed]
    rows = [
        anomaly(f"{i:04d}", random.randint(0, span), source=random.choice(["hot", "hot", "b"]), template=random.choice(["t1", None]))
        for i in range(1500)
    ]
    got = sorted(r.id for r in C.cooldown_kept(table(spark, *rows), 30).collect())
    assert got == kept_by_hand(rows, 30)


def test_cooldown_with_a_steady_pulse(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_COOLDOWNS", 2)
    rows = [anomaly(f"{i:04d}", 7 * i) for i in range(1200)]
    assert sorted(r.id for r in C.cooldown_kept(table(spark, *rows), 1).collect()) == kept_by_hand(rows, 1)


@pytest.mark.parametrize("seed", range(3))
def test_a_long_history_takes_blocks_of_chunks(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "CHUNK_COOLDOWNS", 1)
    random.seed(seed)
    span = [40_000, 9_000, 900_000][seed]
    rows = [
        anomaly(f"{i:04d}", random.randint(0, span), source=random.choice(["hot", "hot", "b"]), template=random.choice(["t1", None]))
        for i in range(900)
    ]
    expires = START + timedelta(seconds=span // 3)
    running = spark.createDataFrame(
        [("hot", "novel_pattern", "t1", expires), ("other", "novel_pattern", "t1", expires)],
        "source string, anomaly_type string, template_key string, expires_at timestamp",
    )
    got = sorted(r.id for r in C.cooldown_kept(table(spark, *rows), 5, running, fan=3).collect())
    assert got == kept_by_hand(rows, 5, [(("hot", "novel_pattern", "t1"), expires)])


def test_composed_steps_are_those_of_the_whole():
    import numpy as np

    random.seed(1)
    for _ in range(60):
        cooldown = random.randint(1, 40)
        at = np.unique([random.randint(0, 400) for _ in range(random.randint(2, 80))])
        cuts = sorted(random.sample(range(0, 400), 3))
        parts = [p for p in np.split(at, np.searchsorted(at, cuts)) if len(p)]
        entries, ends = C._composed([(p, C._chain_ends(p, cooldown)) for p in parts], cooldown)
        assert (ends[1:] != ends[:-1]).all()
        free = np.arange(-5, 450)
        whole = C._after(at, C._chain_ends(at, cooldown), free, cooldown)
        assert (C._after(entries, ends, free, cooldown) == whole).all()


def test_running_cooldowns(spark):
    rows = [anomaly(f"{i:04d}", 600 * i) for i in range(20)]
    expires = START + timedelta(seconds=4000)
    running = spark.createDataFrame(
        [("app", "novel_pattern", "t1", expires), ("other", "novel_pattern", "t1", expires)],
        "source string, anomaly_type string, template_key string, expires_at timestamp",
    )
    kept = C.cooldown_kept(table(spark, *rows), 30, running)
    assert sorted(r.id for r in kept.collect()) == kept_by_hand(rows, 30, [(("app", "novel_pattern", "t1"), expires)])
    after = C.cooldowns(kept, 30).first()
    assert after.expires_at == max(r.detected_at for r in kept.collect()) + timedelta(minutes=30)
    assert C.active_cooldowns(C.cooldowns(kept, 30), F.lit(after.expires_at)).collect() == []


def test_only_routed_anomalies_start_a_cooldown(spark):
    rows = [anomaly("a", 0, "low"), anomaly("b", 60, "high")]
    sent = C.outbox(table(spark, *rows), channels(spark, telegram="medium")).collect()
    assert [(r.anomaly_id, r.channel_type) for r in sent] == [("b", "telegram")]


def test_no_channel_no_message(spark):
    assert C.outbox(table(spark, anomaly("a", 0, "low")), channels(spark, email="high")).collect() == []


def test_mark_alerted(spark):
    rows = table(spark, anomaly("a", 0), anomaly("b", 60))
    marked = C.mark_alerted(rows, C.cooldown_kept(rows))
    assert {r.id: r.alerted for r in marked.collect()} == {"a": True, "b": False}


def payloads(spark, row):
    sent = C.outbox(table(spark, row), channels(spark, telegram="low", slack="low", email="low", alertmanager="low", pager="low"))
    return {r.channel_type: json.loads(r.payload) for r in sent.collect()}


def test_payloads(spark):
    got = payloads(spark, anomaly("a", 5, samples=["x" * 250, "b", "c", "d", "e", "f"]))
    assert set(got) == {"telegram", "slack", "email", "alertmanager"}
    text = got["telegram"]["text"]
    assert text.startswith("\U0001f7e0 *tidewatch alert*\n\n*Type:* novel pattern\n*Severity:* high\n*Source:* app\n*Score:* 0.92\n\nabout a\n")
    assert text.endswith("\n*Sample lines:*\n```\n  " + "x" * 200 + "\n  b\n  c\n```")
    slack = got["slack"]["attachments"][0]
    assert slack["color"] == "#e67e22" and slack["blocks"][0]["text"] == {"type": "plain_text", "text": "tidewatch: novel pattern"}
    assert [f["text"] for f in slack["blocks"][1]["fields"]] == [
        "*Severity:* high", "*Source:* app", "*Score:* 0.92", "*Time:* 2024-01-01T00:00:05.000000Z"
    ]
    assert slack["blocks"][2]["text"]["text"] == "about a"
    assert got["email"]["subject"] == "[tidewatch] HIGH: novel pattern on app"
    assert got["email"]["body"].endswith("\nSample lines:\n  " + "x" * 250 + "\n  b\n  c\n  d\n  e\n")
    alert = got["alertmanager"][0]
    assert alert["labels"] == {"alertname": "tidewatch_novel_pattern", "severity": "high", "source": "app"}
    assert alert["annotations"] == {"summary": "about a", "score": "0.92"}


def test_payloads_without_samples(spark):
    got = payloads(spark, anomaly("a", 5, samples=[]))
    assert "Sample" not in got["telegram"]["text"] and "Sample" not in got["email"]["body"]
