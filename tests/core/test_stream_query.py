from textgate.plans import queries as Q


def test_stream_scores_all_conversations(spark, tmp_path):
    rows = [(c, t, role, f"{role} {c} says\n“{t}”") for c in (7, 100, 101, 102, 5000) for t, role in enumerate(("user", "assistant", "assistant"))]
    rows += [(None, 0, "user", "p"), (None, 1, "assistant", "r"), (6000, 0, "user", None), (6000, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.stream_tail_score(spark, str(tmp_path)).collect()
    want = [(f"s{'null' if c is None else c}", len((text or "").encode())) for c, _, role, text in rows if role == "assistant"]
    assert sorted((r.session, r.response_chars) for r in got) == sorted(want)
