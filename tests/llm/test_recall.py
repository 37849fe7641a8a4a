"""Links of ids divisible by 20 against all rows of a driver's table, by brute force over whole sets. ``RECALL_SF_DIR`` names another table."""

import collections
import os
import re

import pytest

from folianta.llm import minhash

SF = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.01")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_no_link_is_lost(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").toLocalIterator()}
    asked = [d for d in sets if d % 20 == 0 and sets[d]]
    holds = collections.defaultdict(list)
    for d in asked:
        for s in sets[d]:
            holds[s].append(d)
    links = []
    for other, own in sets.items():
        common = collections.Counter(d for s in own for d in holds.get(s, ()))
        links += [(d, other) for d, n in common.items() if d != other and 100 * n >= 75 * (len(sets[d]) + len(own) - n)]
    got = {r.doc_id: r for r in minhash.deduplicate(docs).collect()}
    assert all(got[d].n_shingles == len(s) for d, s in sets.items())
    lost = [(a, b) for a, b in links if got[a].component_id != got[b].component_id]
    print(f"{len(links)} links, {len(lost)} lost")
    assert links and not lost
