"""Near-duplicates in regions wider than one part of the forest, against exact similarities of all pairs.

The texts are one template with changes: each family changes four words of it, each member one to three more. So nearly
all rows of a table lie in the same regions, at a similarity of some 0.55 to 0.72 between families (by construction, not measured), and links are found by what
splits regions. `python tests/llm/test_forest_regions.py 20000` measures larger tables.
"""

from __future__ import annotations

import random
import sys

import numpy as np

WORDS = 200


def texts_of(rows: int, seed: int) -> tuple[list[str], list[int]]:
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(WORDS)]
    families = max(rows // 50, 2)
    changed = [{p: f"f{f}x{p}" for p in rng.sample(range(WORDS), 4)} for f in range(families)]
    texts, family = [], []
    for i in range(rows):
        f = rng.randrange(families)
        own = {**changed[f], **{p: f"m{i}x{p}" for p in rng.sample(range(WORDS), rng.randint(1, 3))}}
        texts.append(" ".join(own.get(p, w) for p, w in enumerate(template)))
        family.append(f)
    return texts, family


def exact(texts: list[str], family: list[int]) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """Component (least row) of each row by all pairs, how many links there are, and each row's linked rows behind it.
    Shingles of one family count within it, the others by one matrix product."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    homes: dict[tuple, set[int]] = {}
    for s, f in zip(sets, family):
        for x in s:
            homes.setdefault(x, set()).add(f)
    shared = {x: i for i, x in enumerate(x for x, f in homes.items() if len(f) > 1)}
    wide = np.zeros((len(texts), len(shared)), np.float32)
    for i, s in enumerate(sets):
        wide[i, [shared[x] for x in s if x in shared]] = 1
    size = np.array([len(s) for s in sets])
    member = np.array(family)
    rows_of = {f: np.flatnonzero(member == f) for f in set(family)}
    root, links, behind = np.arange(len(texts)), 0, []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(texts)):
        both = wide[i:] @ wide[i]
        own = rows_of[family[i]]
        own = own[own >= i]
        both[own - i] += [sum(len(homes[x]) == 1 for x in sets[i] & sets[j]) for j in own]
        j = i + np.flatnonzero(100 * both >= 75 * (size[i] + size[i:] - both))
        j = j[j > i]
        behind.append(j)
        links += len(j)
        for x in j.tolist():
            a, b = find(i), find(x)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(texts))]), links, behind


def measured(spark, rows: int, seed: int) -> dict:
    from sparkloom.llm import lsh_forest

    texts, family = texts_of(rows, seed)
    want, links, behind = exact(texts, family)
    got = lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    found = np.empty(rows, np.int64)
    for r in got:
        found[r["doc_id"]] = r["component_id"]
    lost = sum(int((found[j] != found[i]).sum()) for i, j in enumerate(behind))
    false = len({(a, b) for a, b in zip(found.tolist(), want.tolist())}) - len(set(found.tolist()))
    return {"rows": rows, "links": links, "lost": lost, "components": len(set(want.tolist())), "found": len(set(found.tolist())), "joined wrongly": false}


def test_few_links_are_lost_in_regions_of_many_families(spark, monkeypatch):
    """Parts are made small, so that regions are split as deep as those of a large table."""
    from sparkloom.llm import lsh_forest

    monkeypatch.setattr(lsh_forest, "REGION", 512)
    monkeypatch.setattr(lsh_forest, "ROWS", 256)
    out = measured(spark, 2500, 3)
    assert out["components"] > 20 and out["links"] > 20 * out["rows"], out
    assert out["lost"] <= 0.001 * out["links"] and out["joined wrongly"] == 0, out


if __name__ == "__main__":
    import tempfile

    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    for size in map(int, sys.argv[1:]):
        print(measured(session, size, 3), flush=True)
