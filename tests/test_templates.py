from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import templates as T

START = datetime(2024, 1, 1)


def logs(spark, messages, source="s"):
    rows = [(source, START + timedelta(seconds=i), i, m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "source string, timestamp timestamp, line_number long, message string")


def drain(spark, messages):
    lines = T.assign_shapes(logs(spark, messages))
    assigned = T.assign_drain(lines, T.drain_templates(lines))
    return {r.line_number: (r.template_id, r.template) for r in assigned.collect()}


@pytest.mark.parametrize(
    ("message", "shape"),
    [
        ("GET /api/users/123 took 4.5ms", "GET /api/users/<*> took <*>ms"),
        ("from 10.0.0.1:8080 and 10.0.0.2", "from <*> and <*>"),
        ("id 123e4567-e89b-12d3-a456-426614174000 at 0xDEADbeef", "id <*> at <*>"),
        ("  many   blanks\tand\nlines ", "many blanks and lines"),
    ],
)
def test_shape(spark, message, shape):
    assert spark.createDataFrame([(message,)], "m string").select(T.shape(F.col("m"))).first()[0] == shape


def test_drain_groups_similar_messages(spark):
    got = drain(
        spark,
        [
            "GET /api/users/123 200",
            "GET /api/users/456 200",
            "GET /api/users/789 404",
            "POST /api/orders 201",
            "Connection from 10.0.0.1 closed",
            "Connection from 10.0.0.2 closed",
            "",
        ],
    )
    assert got[0][0] == got[1][0] == got[2][0]
    assert got[3][0] != got[0][0]
    assert got[4] == got[5] and got[4][1] == "Connection from <*> closed"
    assert got[6][0] is None


def test_drain_generalises_words(spark):
    got = drain(
        spark,
        [
            "user logged in alice from web",
            "user logged in bob from web",
            "user logged in carol from app",
            "user logged out carol from app",
            "user was deleted by the admin",
        ],
    )
    assert {got[i][1] for i in range(4)} == {"user logged <*> <*> from <*>"}
    assert got[4][1] == "user was deleted by the admin"


def greedy_by_hand(shapes, similarity):
    clusters = []
    for shape in shapes:
        tokens = shape.split(" ")
        best, score = None, -1.0
        for cluster in clusters:
            alike = sum(a == b for a, b in zip(cluster, tokens)) / len(tokens)
            if alike > score:
                best, score = cluster, alike
        if best is not None and score >= similarity:
            best[:] = [a if a == b else "<*>" for a, b in zip(best, tokens)]
        else:
            clusters.append(list(tokens))
    return sorted(" ".join(c) for c in clusters)


def test_greedy_against_a_plain_loop():
    import random

    random.seed(4)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [" ".join(["head", "word", *random.choices(words, k=4)]) for _ in range(200)]
    rows = list(dict.fromkeys(rows))
    for similarity in (0.4, 0.7, 0.9):
        found = T._greedy([r.split(" ") for r in rows], similarity)
        assert sorted(" ".join(p) for p in found.patterns) == greedy_by_hand(rows, similarity)
        assert len(found.member) == len(rows)


def mixed_messages():
    import random

    random.seed(9)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    return [" ".join(["job", "step", *random.choices(words, k=random.randint(3, 5))]) for _ in range(292)]


def learned(spark, rows, known=None, **options):
    shapes = T.inventory(T.assign_shapes(rows)).withColumnsRenamed({"template_id": "shape_id", "template": "shape"})
    return T.learn_clusters(shapes, known, **options)


def members(clusters):
    return {(r.source, r.shape_id): r.template_id for r in clusters.members.collect()}


def test_several_runs_give_the_clusters_of_one(spark, tmp_path):
    whole = logs(spark, mixed_messages())
    once = learned(spark, whole)
    for cut in (1, 100, 250):
        first = learned(spark, whole.filter(F.col("line_number") < cut))
        first.write(str(tmp_path / str(cut)))
        known = T.read_clusters(spark, str(tmp_path / str(cut)))
        both = learned(spark, whole.filter(F.col("line_number") >= cut), known)
        assert members(both) == members(once)
        key = ["source", "template_id", "leaf", "position", "template"]
        assert sorted(map(tuple, both.patterns.select(key).collect())) == sorted(map(tuple, once.patterns.select(key).collect()))


@pytest.mark.parametrize(("words", "similarity"), [(30, 0.6), (400, 0.4)])
def test_crowded_leaves_by_many_tasks(spark, words, similarity):
    import random

    random.seed(words)
    names = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(words)]
    made = [" ".join(["a", "b", *random.choices([*names, "7"], k=5)]) for _ in range(700)]
    rows = logs(spark, made).unionByName(logs(spark, made[300:450], "t"))
    plain = learned(spark, rows, similarity=similarity)
    many = learned(spark, rows, similarity=similarity, leaf_shapes=130)
    assert members(many) == members(plain)
    key = ["source", "template_id", "leaf", "position", "template"]
    assert sorted(map(tuple, many.patterns.select(key).collect())) == sorted(map(tuple, plain.patterns.select(key).collect()))


def test_settled_rows_are_those_of_the_loop():
    import random

    import numpy as np

    for seed in range(20):
        random.seed(seed)
        words = [*"abcdefgh"[: random.randint(2, 8)], "<*>"]
        rows = list(dict.fromkeys(tuple(random.choices(words, k=4)) for _ in range(120)))
        rows = [list(r) for r in rows]
        known = [list(random.choices(words, k=4)) for _ in range(random.randint(0, 3))]
        similarity = random.choice([0.3, 0.5, 0.8])
        whole = T._greedy(rows, similarity, known)
        numbers = np.arange(1, len(rows) + 1)
        joined, changes = T._settle(rows, numbers, whole.versions, similarity)
        opened = {since for _, since, _ in whole.versions if since}
        assert {int(n) for n, c in zip(numbers, changes) if c} == opened
        quiet = ~changes
        assert (joined[quiet] == whole.member[quiet]).all()
        # replaying only the rows that change something gives the same versions
        some = [r for r, c in zip(rows, changes) if c]
        assert T._greedy(some, similarity, known, numbers[changes]).versions == whole.versions


def test_clusters_do_not_depend_on_the_partitions(spark):
    rows = logs(spark, mixed_messages())
    assert members(learned(spark, rows.repartition(7))) == members(learned(spark, rows.coalesce(1)))


def test_known_ids_stay_when_a_pattern_widens(spark):
    first = logs(spark, ["user logged in alice from web", "user logged in bob from web"])
    known = learned(spark, first)
    later = logs(spark, ["user logged in bob from web", "user logged in carol from web", "something else entirely"])
    lines = T.assign_shapes(later)
    more = learned(spark, later, known)
    ids = {r.message: r.template_id for r in T.with_templates(lines, more).collect()}
    before = {r.message: r.template_id for r in T.with_templates(T.assign_shapes(first), known).collect()}
    assert len(set(before.values())) == 1
    assert ids["user logged in carol from web"] == ids["user logged in bob from web"] == before["user logged in bob from web"]
    unknown = T.with_templates(lines, known).filter("message = 'something else entirely'").first().template_id
    assert ids["something else entirely"] == unknown


def test_depth_routes_by_leading_tokens(spark):
    rows = logs(spark, ["a x one two three", "a y one two three"])
    assert len(set(members(learned(spark, rows)).values())) == 2
    assert len(set(members(learned(spark, rows, depth=3)).values())) == 1


def test_overflow_marks_but_keeps(spark):
    lines = T.assign_shapes(logs(spark, ["one a", "two b c", "three c d e"]))
    got = T.drain_inventory(T.drain_templates(lines, max_clusters=2)).orderBy("first_line").collect()
    assert [r.overflow for r in got] == [False, False, True]


def test_inventory_and_ids(spark):
    lines = T.assign_shapes(logs(spark, ["a 1", "b 2", "a 3", "c 4"]).unionByName(logs(spark, ["z"], "t")))
    found = T.inventory(lines)
    ids = {(r.source, r.template): (r.seq_id, r["count"], r.sample_line) for r in T.sequence_ids(found).collect()}
    assert ids == {
        ("s", "a <*>"): (1, 2, "a 1"),
        ("s", "b <*>"): (2, 1, "b 2"),
        ("s", "c <*>"): (3, 1, "c 4"),
        ("t", "z"): (1, 1, "z"),
    }
    assert {r.source: r.max_id for r in T.max_ids(found).collect()} == {"s": 3, "t": 1}
    baseline = spark.createDataFrame([("s", 2)], "source string, max_id long")
    assert {r.template for r in T.novel_templates(found, baseline).collect()} == {"c <*>", "z"}
    assert {r.source: r.templates for r in T.template_count(found).collect()} == {"s": 3, "t": 1}
    assert T.templates_by_count(found).first().template == "a <*>"


def test_masked_templates_need_no_shuffle(spark):
    plan = T.assign_shapes(logs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_numbering_reads_the_templates_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = [("s", str(i), START, i) for i in range(50)]
    found = spark.createDataFrame(rows, "source string, template_id string, first_seen timestamp, first_line long")
    numbered = T.sequence_ids(found.mapInPandas(count, found.schema)).collect()
    assert sorted(r.seq_id for r in numbered) == list(range(1, 51)) and read.value == 50


def test_each_kind_of_text_is_masked_once():
    assert str(T.shape(F.col("m"))).count("regexp_replace") == 5


def test_drain_lines_mask_each_message_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    raw = logs(spark, [f"{w} done {i}" for i in range(20) for w in ("job", "task")])
    assigned = T.assign_shapes(raw)
    wanted = T.assign_drain(assigned, T.drain_templates(assigned))
    found = T.drain_lines(T.assign_shapes(raw.mapInPandas(count, raw.schema)))
    found = found.filter(F.col("template_id").isNotNull()).collect()
    assert sorted(map(str, found)) == sorted(map(str, wanted.collect()))
    assert read.value == 40
