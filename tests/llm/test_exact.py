"""Sharding, chats, HTML, decontamination, BPE, fingerprints, URLs and the pipeline against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

import corpus_pipeline
from tests.llm.data import DOCS, awkward, chain, prose
from textgate.llm import bpe, chat, decontaminate, html_text, sharding, spotsigs, url_filter


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x") for r in awkward() + chain(5)], DOCS + ", shard string").repartition(3)


def test_sharding(spark, docs):
    rows = sharding.pack_shards(docs, 4).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len(t.encode()) + 16, crc32(t.encode())) for t in texts)
    shards = defaultdict(set)
    for r in rows:
        shards[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.pack_shards(docs.limit(0), 4).count() == 0


def test_shards_have_nearly_equal_bytes(spark):
    rows = [(i, prose(i, 3 + i * i % 90)) for i in range(600)] + [(1000 + i, prose(5, 40)) for i in range(30)] + [(2000 + i, "") for i in range(50)]
    got = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert len(got) == len(rows) and sorted(sums) == list(range(5))
    assert max(sums.values()) <= 1.01 * min(sums.values())


def test_items_of_a_level_are_placed_like_single_ones():
    items = [(50, 2), (30, 5), (7, 40), (3, 11)]
    runs = sharding.place(items, 120, 10)
    one_by_one = sharding.best_fit_decreasing([s for s, c in items for _ in range(c)], 120, 10)
    counted = [[b for b, n in r for _ in range(n)] for r in runs]
    assert [sorted(x) for x in counted] == [sorted(one_by_one[:2]), sorted(one_by_one[2:7]), sorted(one_by_one[7:47]), sorted(one_by_one[47:])]


def test_best_fit_decreasing_enters_the_tightest_bin():
    assert sharding.best_fit_decreasing([6, 5, 4, 3, 2], 10, 2) == [0, 1, 0, 1, 1]
    assert sharding.best_fit_decreasing([6, 5, 5], 10, 1) is None
    sizes = sorted([(i * 7919) % 97 + 1 for i in range(300)], reverse=True)
    total = Counter()
    for s, b in zip(sizes, sharding.best_fit_decreasing(sizes, 500, 100), strict=True):
        total[b] += s
    assert max(total.values()) <= 500


def test_chats_read_back(spark):
    rows = [
        (1, 0, "user", "a <|im_end|>\n \\<|x"),
        (1, 1, "user", None),
        (1, 2, "assistant", "b\\<\\|"),
        (1, 2, "assistant", "b\\<\\|"),
        (2, None, "system", "first"),
        (2, 0, "odd\nrole<|", "é" * 1000),
        (None, 1, None, "z"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(turns).withColumn("back", chat.read_back(chat.F.col("formatted"))).collect()}
    for conv in (1, 2, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])]
        assert [(t.role, t.text) for t in out[conv].back] == want
        assert "".join(s.text for s in out[conv].segments) == out[conv].formatted
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_html(spark):
    article = "".join(f"<p>Story NR.{i} of &eacute;t&eacute; &amp; sun.</p>" for i in range(3))
    page = lambda i: (
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class='cookie'>We use</div>"
        f"<article><h1>Title {i}</h1>{article.replace('NR', str(i))}<script>var x='<p>no</p>';</script></article><div class=comments><p>Nice</p></div><footer>F</footer></body></html>"
    )
    rows = [(i, f"http://h.com/{i}", page(i)) for i in range(25)] + [(90, None, None), (91, "", ""), (92, "http://x.org", "plain < text"), (93, "http://x.org", "<p>a<p>b <b>c</b>d<br>e")]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Title 3 Story 3.0 of été & sun. Story 3.1 of été & sun. Story 3.2 of été & sun."
    assert (out[90], out[91], out[92], out[93]) == ("", "", "plain < text", "a b cd e")


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item) if item is not None else "null")
    lengths = {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= items_of
        yield (doc_id, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("few", [True, False])
def test_decontamination(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
        monkeypatch.setattr(decontaminate, "MAX_LITERAL", 0)
    item = prose(11, 40)
    items = [(1, item), (2, "short, one!"), (3, None), (4, ""), (5, prose(12, 13)), (None, prose(13, 20)), (6, item)]
    rows = [
        (1, prose(14, 50) + " " + item.upper() + " " + prose(15, 900)),
        (2, "a short one b SHORT-ONE"),
        (3, None),
        (4, ""),
        (5, " ".join(item.split()[3:30])),
        (5, " ".join(item.split()[3:30])),
        (6, " ".join(item.split()[:12])),
        (None, prose(13, 20)),
        (7, "…" + prose(12, 13) + "…" + prose(12, 13)),
    ]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id int, text string, anchor int")
    got = decontaminate.contamination(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, words int"), bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()), key=str)
    assert got == sorted(plain_contamination(rows, items), key=str)
    assert decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).filter("n_hit > 0").count() == 0
    kept = decontaminate.without_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in plain_contamination(rows, items) if not x[2]) == [3, 4, 6, 7]


def test_one_window_in_a_long_document_is_enough(spark):
    item = prose(21, 30)
    passage = " ".join(item.split()[7:20])
    rows = [(1, f"{prose(22, 1000)} {passage} {prose(23, 1000)}"), (2, f"{prose(22, 1000)} {' '.join(passage.split()[:12])} {prose(23, 1000)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    found = {r.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert found == {1: (13, False), 2: (0, False)}
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()] == [2]


def test_proximity_matches(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "alpha so beta gamma"), (2, "alpha much more then beta gamma")], "doc_id long, text string")
    near = decontaminate.matches(docs, item, slop=1).filter("item_id is not null")
    assert [r.doc_id for r in near.collect()] == [1]


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = bpe.default_vocabulary()
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [r[1] or "" for r in awkward()] + ["a" * 700, " " * 2000, "naïve café\u00a0x\u0085y", "don't I'LL 12345", "<|endoftext|>", "é" * 600]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(docs, ranks, pattern, with_ids=True).collect()}
    for i, t in [*enumerate(texts), (99, "")]:
        assert got[i].ids == plain.encode_ordinary(t)
        assert got[i].decoded_sha256 == sha(t)
        assert got[i].ids_sha256 == sha(" ".join(map(str, got[i].ids)))
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, ranks, pattern), ranks).collect()} == {**{i: t.encode() for i, t in enumerate(texts)}, 99: b""}


def plain_signatures(text):
    w, anchors, out = words_of(text), set(spotsigs.ANCHORS), set()
    common = [i for i in range(len(w) + 1) if i == 0 or w[i - 1] in anchors]
    # Every word of a stretch of SPAN words or more without a common one is an anchor too.
    rare = [i for at, then in zip(common, [*common[1:], len(w) + 1], strict=True) if then - at > spotsigs.SPAN for i in range(at + 1, then)]
    for i in range(len(w) + 1):
        if i in {*common, *rare}:
            chain_ = [x for x in w[i : i + spotsigs.SPAN] if x not in anchors][: spotsigs.CHAIN]
            if chain_:
                out.add((w[i - 1] if i else "", *chain_))
    return out or {text}


@pytest.mark.parametrize("bucket_rows", [512, 2])
def test_fingerprints(spark, tmp_path, bucket_rows, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", bucket_rows)
    rows = [r for r in awkward() if r[0] is not None and r[0] != 0] + [(0, "the quick of brown and fox", None, None, 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in spotsigs.op10_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        out = got[r[0]]
        assert (out.n_chars, out.edited_sha256) == (len(text), sha(edited))
        like = lambda a, b: len(a & b) / len(a | b)
        assert out.near_edited == pytest.approx(like(plain_signatures(text), plain_signatures(edited)))
        assert out.near_next == pytest.approx(like(plain_signatures(text), plain_signatures(following)))
    assert got[7].fingerprint == got[8].fingerprint
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert spotsigs.op10_fingerprints(spark, f"{tmp_path}/none").count() == 0


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for _, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


@pytest.mark.parametrize("literal", [256, 0])
def test_url_rules(spark, literal, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LITERAL", literal)
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?a=1#b", "http://example.com/en/a", "http://com/en", "http://notcom/", "http://a.net/es/x", "http://net/fr/", "x://b.net/de/", "http://b.org?x=/es/", "http://c.org\n/y"]
    urls += [f"https://s{i % 3}.net/{'es' if i % 2 else 'de'}/tag/{i}.html" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "block") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for r in url_filter.filter_urls(pages).collect():
        assert (r.host, r.path, r.rule) == plain_rule(urls[r.page_id])
        assert r.verdict in url_filter.VERDICTS
        if r.rule is not None:
            assert r.verdict == {rule: v for v, rule in url_filter.RULES}[r.rule]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_rules_by_index_and_by_join_agree(spark):
    rules = [url_filter.Mined(("host:a",), "block", 0.9), url_filter.Mined(("host:a", "path:p"), "allow", 0.95), url_filter.Mined(("path:q",), "allow", 0.9)]
    urls = spark.createDataFrame([("u1", ["host:a"]), ("u2", ["host:a", "path:p"]), ("u3", ["host:a", "path:q"]), ("u4", []), (None, [])], "url string, tokens array<string>")
    want = {"u1": "block", "u2": "allow", "u3": "allow", "u4": "allow", None: "allow"}
    for way in (url_filter.judged, url_filter._judged_by_join):
        assert {r.url: r.mined_verdict for r in way(urls, rules).collect()} == want


def test_pipeline_on_awkward_rows(spark, tmp_path):
    rows = awkward() + chain(6)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, chain(6)[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(r.decoded_sha256 == sha(texts[r.doc_id]) for r in out)
    assert 12 in {r.doc_id for r in out} and 13 not in {r.doc_id for r in out}


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
