import re

import pytest

from tests.llm.data import DOCS, awkward, chain, prose
from textgate.llm import ngram_join


def brute_sets(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [brute_sets(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = set()
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(i)] = root(j)
                if x != y:
                    links.add(frozenset((x, y)))
    out = []
    for i, r in enumerate(rows):
        if sets[i]:
            ids = [rows[j][0] for j in range(len(rows)) if sets[j] and root(j) == root(i) and rows[j][0] is not None]
            out.append((r[0], len(sets[i]), min(ids, default=None)))
        else:
            out.append((r[0], 0, r[0]))
    return sorted(out, key=str), len(links)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    near = [(300 + i, prose(7, 80) + f" tail{i} tail{i % 3}", "en", "web", 1) for i in range(30)]
    return awkward() + chain(12) + near


def test_components_equal_brute_force(spark, rows):
    assert found(ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS))) == brute(rows)[0]


def test_components_with_chunked_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 2)
    assert found(ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS))) == brute(rows)[0]


def test_shuffle_join_beyond_the_broadcast_limit(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST", 0)
    docs = spark.createDataFrame(rows, DOCS)
    assert found(ngram_join.near_duplicates(docs)) == brute(rows)[0]
    kept = ngram_join.one_of_each(docs).collect()
    components = {x[2] for x in brute(rows)[0] if x[1]}
    assert len([r for r in kept if brute_sets(r.text)]) == len(components)


def test_all_links(spark, rows):
    links, _ = ngram_join.links(spark.createDataFrame(rows, DOCS))
    assert links.count() == brute(rows)[1]


def test_one_of_each_keeps_columns_and_rows_without_shingles(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", k long, token string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect() if not brute_sets(r.text)) == sorted(str(r[0]) for r in rows if not brute_sets(r[1]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert ngram_join.near_duplicates(docs).count() == 0
    assert ngram_join.one_of_each(docs).count() == 0
