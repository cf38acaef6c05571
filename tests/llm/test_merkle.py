import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle as M

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        run = at // 3 * 3
        yield level[run:at], level[at + 1 : run + 3]
        at //= 3


def by_hand(rows, tampered, columns=COLUMNS):
    """(id, leaf, subroot, root, hash of the proof, folded) of each row (a dict)."""
    groups = {}
    for row in rows:
        leaf, start = (
            H("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in columns))
            for r in (row, {**row, "text": tampered(row)})
        )
        groups.setdefault(row["source"], []).append((row["doc_id"], leaf, start))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels([leaf for _, leaf, _ in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for rank, g in enumerate(names):
        for at, (id_, leaf, state) in enumerate(groups[g]):
            proof = ""
            for before, after in [*siblings(trees[g], at), *siblings(top, rank)]:
                state = H(*before, state, *after)
                proof += "".join([*before, *after])
            out.append((id_, leaf, trees[g][-1][0], top[-1][0], H(proof), state))
    return sorted(out, key=str)


def proven(docs, found=None, columns=COLUMNS):
    text = lambda c: F.lower(F.hex(c))
    proofs = M.prove(M.build(docs, columns, changed={} if found is None else {"text": found}))
    rows = proofs.select("id", text("leaf"), text("subroot"), text("root"), F.sha2(text("proof"), 256), text("folded"))
    return sorted(map(tuple, rows.collect()), key=str)


def even(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


def without_breaks(row):
    return row["text"].replace("\n", "") if row["text"] is not None and even(row["doc_id"]) else row["text"]


FOUND = F.when(
    F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))
).otherwise(F.col("text"))


def some_rows(sizes):
    rnd = random.Random(3)
    rows = []
    for source, n in sizes.items():
        for i in range(n):
            text = rnd.choice([None, "", "a\nb", "é" * 50, "\n"])
            rows.append({"doc_id": rnd.choice([None, *range(5000)]), "source": source, "lang": None if i % 3 else "de", "n_chars": i, "text": text})
    return rows


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {None: 2}, {"a": 9, "b": 1}, {"a": 1, "b": 3, "é": 4, None: 28, "hot": 2300, "z": 27, "y": 82, "x": 730},
     {f"s{i}": 1 + i % 4 for i in range(95)}],
)
def test_proofs_by_hand(spark, sizes):
    rows = some_rows(sizes)
    rows += rows[:2]  # repeated rows are leaves of their own
    docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA).repartition(5)
    got = proven(docs, FOUND)
    assert got == by_hand(rows, without_breaks)
    changed = sum(without_breaks(r) != r["text"] for r in rows)
    assert sum(r[-1] != r[3] for r in got) == changed


def test_odd_rows(hard_docs, no_docs):
    columns = ["doc_id", "score", "text"]
    docs = hard_docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even"))
    rows = [r.asDict() for r in docs.collect()]
    assert proven(docs, FOUND, columns) == by_hand(rows, without_breaks, columns)
    assert proven(no_docs.withColumn("source", F.lit("x")), FOUND, columns) == []


def test_a_stored_manifest_and_the_limit_of_the_session(spark, tmp_path):
    rows = some_rows({"a": 40, "b": 3})
    docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    M.build(docs, COLUMNS).write(str(tmp_path))
    again = M.prove(M.read_manifest(spark, str(tmp_path)))
    assert again.filter("folded = root").count() == 43
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
