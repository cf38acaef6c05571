import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewatch.llm import simhash as S
from tidewatch.llm.components import connected_components
from tidewatch.llm.words import LOWER, split_words


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(LOWER)))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in parent}


def test_fingerprints_like_brute_force(hard_docs):
    texts = [r.text for r in hard_docs.collect()]
    got = S.fingerprints(split_words(pa.array(texts), LOWER)).tolist()
    assert got == [brute_print(t) for t in texts]


def near_prints(seed, n, crowded):
    """Random prints with neighbours at 1 to 3 bits; ``crowded`` vary in the bits of one or two segments only."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = set(centres.tolist())
    for c in centres.tolist():
        for bits in (1, 2, 2, 3):
            out.add(c ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    base = int(centres[0])
    out |= {base ^ int(v) << 8 * s for s in (0, 5) for v in rng.integers(0, 256, crowded)}
    out |= {base ^ int(v) << 20 for v in rng.integers(0, 2**12, crowded)}
    return sorted(out)


@pytest.mark.parametrize("seed,n,crowded", [(1, 60, 0), (2, 10, 150), (3, 1, 400)])
def test_links_give_the_components_of_all_pairs(spark, seed, n, crowded):
    prints = near_prints(seed, n, crowded)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    links = S.linked_prints(df)
    edges = links.collect()
    assert len(edges) <= 32 * len(prints)  # no pairs of all members
    mask = (1 << 64) - 1
    found = {r.node & mask: r.root & mask for r in connected_components(links).collect()}
    groups, want = {}, {}
    for p, r in roots(prints).items():
        want.setdefault(r, set()).add(p)
    for p in prints:
        groups.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (700, 700), (1000, 300)] + [(300, i) for i in range(900, 950)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and found[501] == 500
    assert {found[i] for i in (300, 1000, *range(900, 950))} == {300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, hard_docs, no_docs, texts_of):
    got = S.near_duplicates(hard_docs).collect()
    source = hard_docs.collect()
    assert len(got) == len(source)
    component = roots({brute_print(r.text) for r in source})
    least = {}
    for r in source:
        if r.doc_id is not None:
            root = component[brute_print(r.text)]
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = [(r.doc_id, f"{brute_print(r.text):016x}", least.get(component[brute_print(r.text)])) for r in source]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert S.near_duplicates(no_docs).count() == 0


def test_one_document_of_each_component_stays(spark, hard_docs, no_docs, texts_of):
    kept = S.keep_one(hard_docs)
    assert kept.columns == hard_docs.columns
    source = hard_docs.collect()
    component = roots({brute_print(r.text) for r in source})
    stay = kept.collect()
    assert sorted(component[brute_print(r.text)] for r in stay) == sorted(set(component.values()))
    smallest = {}
    for r in source:
        smallest.setdefault(component[brute_print(r.text)], []).append(-1 if r.doc_id is None else r.doc_id)
    for r in stay:
        assert (-1 if r.doc_id is None else r.doc_id) == min(smallest[component[brute_print(r.text)]])
    assert S.keep_one(no_docs).count() == 0
