from textgate.llm import spotsigs
from textgate.llm.spotsigs import ANCHORS, SPAN

RARE = [f"kata{k}" for k in range(60)]  # no common word of the four languages


def sets(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = spotsigs.with_signatures(rows, "text", "sigs").select("id", "sigs", spotsigs.fingerprint(spotsigs.F.col("sigs")).alias("f"))
    return [(set(r.sigs), r.f) for r in sorted(got.collect(), key=lambda r: r.id)]


def plain(words):
    """Positions of anchors: common words, and every word of a stretch of SPAN words or more without one."""
    common = [i for i in range(len(words) + 1) if i == 0 or words[i - 1] in ANCHORS]
    rare = [i for at, then in zip(common, [*common[1:], len(words) + 1], strict=True) if then - at > SPAN for i in range(at + 1, then)]
    chains = {(words[i - 1] if i else "", *[w for w in words[i : i + SPAN] if w not in ANCHORS][:3]) for i in common + rare}
    return {c for c in chains if len(c) > 1}


def test_every_part_of_an_anchorless_text_counts(spark):
    mixed = [*RARE[:25], "the", *RARE[25:30], "of", *RARE[30:]]
    changed = [[*RARE[:k], "changed", *RARE[k + 1 :]] for k in range(60)]
    texts = [RARE, mixed, [*RARE[:40], *(f"new{k}" for k in range(20))], *changed]
    got = sets(spark, [" ".join(t) for t in texts])
    assert [len(s) for s, _ in got] == [len(plain(t)) for t in texts]
    assert len({f for _, f in got}) == len(texts)
    shared = len(got[0][0] & got[2][0]) / len(got[0][0] | got[2][0])
    assert shared == len(plain(texts[0]) & plain(texts[2])) / len(plain(texts[0]) | plain(texts[2])) < 1


def test_dense_texts_stay(spark):
    dense = "the quick brown fox of and jumps over the lazy dog".split()
    assert len(sets(spark, [" ".join(dense)])[0][0]) == len(plain(dense))
