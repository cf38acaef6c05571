import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
CONV = F.col("conv")
TURNS = (F.crc32(CONV.cast("string").cast("binary")) % 6).cast("int")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(rows, rebuilt=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            tie = sha(f"{len(said[0].encode())}:{said[0]}{said[1]}")
            own.setdefault(conv, []).append(((turn is not None, turn or 0), tie, said))
    own = {c: [said for _, _, said in sorted(v)] for c, v in own.items()}
    lists = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        lists[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    nodes, kids = {}, {}
    for c, v in lists.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out, leaves, saved = [], {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(lists[c]) == len(k))))
        up = min(nodes[k[:-1]]) if k else None
        out.append((min(nodes[k]), len(k), up, len(nodes[k]), len(below), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=str)


def built(rows, size, rebuilt=True):
    lists = P.turn_lists(rows)
    if rebuilt:
        lists = P.with_shared_beginnings(lists, CONV - CONV % 100, TURNS, 5)
    return sorted(map(tuple, P.build_trie(lists, size).collect()), key=str)


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(-150, 450):
        kind = rnd.random()
        if kind < 0.2:
            continue
        if kind < 0.45:  # copies
            said = ["hello", "hi", "bye"]
        elif kind < 0.6:  # a common beginning
            said = ["hello"] + [rnd.choice("abc") for _ in range(rnd.randint(0, 6))]
        elif kind < 0.65:
            said = [rnd.choice([None, "", "é"]) for _ in range(40)]
        else:
            said = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 8))]
        for turn, text in enumerate(said):
            role = rnd.choice([None, "user", "assistant"]) if kind > 0.9 else "user"
            rows.append((conv, None if turn == 0 and rnd.random() < 0.2 else turn, role, text))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 1), (2, 7), (3, 60), (4, P.SHARD)])
def test_nodes_by_hand(spark, seed, size):
    rows = conversations(seed)
    got = built(spark.createDataFrame(rows, SCHEMA).repartition(5), size)
    assert got == by_hand(rows)


def test_odd_rows(spark):
    long = [(7, t, "user", "word " * 40_000) for t in range(3)] + [(8, t, "user", "x") for t in range(700)]
    rows = long + [(8, 5, "user", "x"), (None, 0, "user", "nobody's"), (9, None, None, None), (9, None, None, None), (10, 0, "us", "er:a"), (11, 0, "use", "r:a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("conv", "key", "path", "shard", "turns")})
    assert built(docs, P.SHARD, rebuilt=False) == by_hand(rows, rebuilt=False)
    assert built(docs, 1, rebuilt=False) == by_hand(rows, rebuilt=False)
    assert built(docs.limit(0), P.SHARD) == []
    assert built(docs.filter("conv_id is null"), P.SHARD) == []
    copies = [(c, 0, "user", "same") for c in range(500)]
    assert built(spark.createDataFrame(copies, SCHEMA), 16, rebuilt=False) == by_hand(copies, rebuilt=False)


def test_bits():
    for bits in (0, 1, 5, 1 << 200, (1 << 77) - 1):
        assert P.bits_of(bits) == [i for i in range(300) if bits >> i & 1]
