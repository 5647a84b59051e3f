from tests.llm.data import DOCS, awkward, chain, prose
from tests.llm.test_exact import plain_signatures
from textgate.llm import ngram_join, spotsigs


def brute(rows):
    sets = [frozenset(plain_signatures(r[1] or "")) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.75 * len(x | sets[j]):
                parent[root(i)] = root(j)
    ids = lambda i: [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
    return sorted(((r[0], min(ids(i), default=None)) for i, r in enumerate(rows)), key=str)


def test_components_equal_brute_force(spark, monkeypatch):
    near = [(300 + i, prose(7, 80) + f" tail{i} of tail{i % 3}", "en", "web", 1) for i in range(20)]
    rows = awkward() + chain(8) + near
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], DOCS + ", k long, sigs int").repartition(3)
    got = spotsigs.similar_documents(docs).select("doc_id", "component_id")
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(a != b for a, b in want)
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 2)
    assert sorted(map(tuple, spotsigs.similar_documents(docs).select("doc_id", "component_id").collect()), key=str) == want


def test_empty_table(spark):
    assert spotsigs.similar_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_alike_sets_lie_in_adjacent_partitions(spark):
    pairs = [(a, b) for a in range(1, 400) for b in range(a, min(400, a * 4 // 3 + 1)) if a >= 0.75 * b]
    rows = spark.createDataFrame(pairs, "a int, b int")
    far = rows.filter(spotsigs.length_class(spotsigs.F.col("b")) - spotsigs.length_class(spotsigs.F.col("a")) > 1)
    assert far.count() == 0
