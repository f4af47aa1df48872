"""The manifest against one built node by node, and its proofs."""

import os
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from turnstile.llm import merkle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    values = (None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text))
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def siblings_and_root(digests):
    """Per leaf the (left, right) siblings up to the root, and the root."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            a = i // 16 * 16
            paths[leaf].append((nodes[a:i], nodes[i + 1 : a + 16]))
            at[leaf] = i // 16
        nodes = [H(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
    return paths, nodes[0]


def manifest(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: siblings_and_root([d for _, _, d, _ in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    tops, root = siblings_and_root([trees[s][1] for s in names]) if names else ([], None)
    out = []
    for s, top in zip(names, tops):
        for (_, _, own, row), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][0]):
            steps, text = path + top, row[1]
            if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf_of(row, text)
            for left, right in steps:
                now = H(*left, now, *right)
            proof = H(*(d for left, right in steps for d in (*left, *right)))
            out.append((row[0], own, trees[s][1], root, proof, now, now == root))
    return sorted(out, key=repr)


def got(spark, rows, parts=5):
    df = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(parts))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trees_of_all_heights(spark):
    rng, rows = random.Random(1), []
    sizes = {None: 1, "a": 2, "b": 16, "c": 17, "d": 256, "e": 257, "hot": 4200, "ü": 3, "Z": 33}
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(10**6), rng.choice(["Some Text", "other", "", None, "Ünï"]), "en", source, rng.choice([None, 5])))
    assert got(spark, rows) == manifest(rows)


def test_many_sources(spark):
    rows = [(i, f"Text {i}", None, f"source{i % 300}", i) for i in range(600)]
    found = got(spark, rows)
    assert found == manifest(rows)
    assert 0 < sum(not r[-1] for r in found) < len(rows)


def test_nulls_repeats_one_row_and_nothing(spark):
    rows = [(None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (4, "B", None, "s", None), (4, "B", None, "s", None), (4, "C", None, None, 1)]
    assert got(spark, rows) == manifest(rows)
    assert got(spark, rows[-1:]) == manifest(rows[-1:])
    assert got(spark, []) == []


def test_other_columns_do_not_matter(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", i) for i in range(40)]
    wide = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("tree", "index", "nodes", "digest", "block", "_at")})
    assert sorted((tuple(r) for r in merkle.manifest(wide).collect()), key=repr) == manifest(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")
def test_driver_rows(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in merkle.manifest(table).collect()), key=repr) == manifest(rows)
