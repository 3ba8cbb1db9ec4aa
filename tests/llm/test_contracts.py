"""Every registered query of the subpackage against brute force on the smallest tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from pyspark.sql import functions as F

from stratlas.llm import html_extract, license_rules, lm, oracles, quality, sharding
from stratlas.llm.queries import ORACLES, QUERIES
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, n):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    return QUERIES[name](spark, sf).collect()


def test_op1_text_is_the_article(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = rows(spark, sf, 1)
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, brute.article(pages[r.page_id].html), len(r.text))


def test_op1_held_out_accuracy():
    pages, truth = html_extract.labelled(120, 4242)
    got = html_extract.fitted().label(pages)
    right = sum(int((g == (t > 0)).sum()) for g, t in zip(got, truth, strict=True))
    assert right / sum(map(len, pages)) > 0.98


def test_op2(spark, sf, docs):
    for r in rows(spark, sf, 2):
        n, base, first, last, labels = brute.license_base(docs[r.doc_id].text, license_rules.BASE)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, base, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op3(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, rows(spark, sf, 3)), key=str) == sorted(duckdb.sql(ORACLES["op3_url_filters"]).fetchall(), key=str)


def test_op4(spark, sf, docs):
    size, slots = Counter(), defaultdict(list)
    got = rows(spark, sf, 4)
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r.size for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * largest


def test_op5(spark, sf, docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    train = [d.text for i, d in docs.items() if not held[i]]
    ids = list(docs)
    base = dict(zip(ids, brute.unigram(train, [docs[i].text for i in ids]), strict=True))
    some = ids[::9]
    scores = dict(zip(some, brute.ppm(train, [docs[i].text for i in some], lm.DEPTH), strict=True))
    for r in rows(spark, sf, 5):
        n, known, total, score = base[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        if r.doc_id in scores:
            assert r.score == pytest.approx(scores[r.doc_id], rel=1e-5)


def test_op6(spark, sf):
    said = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        said[r.conv_id].append((r.turn, r.role, r.text or ""))
    said[-7] = [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
    got = rows(spark, sf, 6)
    assert {r.conv_id for r in got} == set(said) and len(got) == len(said)
    for r in got:
        turns = sorted(said[r.conv_id])
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op7(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = list(docs)
    want = dict(zip(ids, brute.contamination([docs[i].text for i in ids], items), strict=True))
    got = rows(spark, sf, 7)
    assert len(got) == len(ids) and any(r.contaminated for r in got)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]


def test_op8(spark, sf, docs):
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(brute.spaced(d.text))
    want, taken = brute.targets(sizes), Counter()
    first = rows(spark, sf, 8)
    for r in first:
        source = docs[r.doc_id].source
        assert r.size == len(brute.spaced(docs[r.doc_id].text)) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and r.taken <= 3 * r.size and r.taken == r.size * len(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)
        taken[source] += r.taken
    for source, n in taken.items():
        longest = max(len(brute.spaced(d.text)) for d in docs.values() if d.source == source)
        assert abs(n - want[source]) <= longest / 2 + 1
    assert sorted(map(str, first)) == sorted(map(str, rows(spark, sf, 8)))


def test_op9(spark, sf, docs):
    want = brute.near_components({i: d.text for i, d in docs.items()}, 2)
    got = rows(spark, sf, 9)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_op10(spark, sf, docs):
    for r in rows(spark, sf, 10):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(docs[r.doc_id].text)
        assert not (r.base_failed and r.kept)


def test_op10_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    x = QUERIES["op10_quality_rules"](spark, sf)
    assert x.join(good, "doc_id").filter("not base_failed and not kept").count() == 0
    bad = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").select("doc_id")
    assert x.join(bad, "doc_id").filter("not base_failed and kept").count() <= 4


def test_op4_tree(spark, sf):
    """Shards are those of a tree that is cut node by node on sorted rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    rows = [(r.doc_id, r.size, r.k) for r in docs.select("doc_id", size.alias("size"), sharding.keys(docs, ["lang", "n_chars"], "doc_id", "text").alias("k")).collect()]
    spread = None

    def crossing(part, need, shift, inside):
        """The cell of 12 bits at ``shift`` in which the running sum of sizes reaches ``need``, and what it still needs there."""
        sums = Counter()
        for k, s in part:
            if inside is None or k >> shift + 12 == inside:
                sums[k >> shift] += s
        total = 0
        for cell in sorted(sums):
            if total + sums[cell] >= need:
                return cell, need - total, sums[cell]
            total += sums[cell]

    def deal(part, lo, m):
        nonlocal spread
        if m == 1:
            return {i: lo for i, _, _ in part}
        wide = [max(k[d] >> 24 for _, _, k in part) - min(k[d] >> 24 for _, _, k in part) for d in (0, 1)]
        spread = spread or [max(1, w) for w in wide]
        dim = max((0, 1), key=lambda d: (wide[d] / spread[d], -d))
        half, whole = m // 2, sum(s for _, s, _ in part)
        need = first = whole * half / m
        at, found = None, {}
        for shift in (24, 12, 0):
            at, need, b = crossing([(k[dim], s) for _, s, k in part], need, shift, at)
            found[shift] = ((at + (0 if 2 * need < b else 1)) << shift) - 1, b
        end = found[12][0] if found[12][1] * sharding.WHOLE <= first else found[0][0]
        left, right = [x for x in part if x[2][dim] <= end], [x for x in part if x[2][dim] > end]
        return deal(left, lo, half) | deal(right, lo + half, m - half)

    assert {r.doc_id: r.shard for r in QUERIES["op4_kd_tree_sharding"](spark, sf).collect()} == deal(rows, 0, 8)


@pytest.mark.parametrize("name", ["op10_quality_rules", "quality_rule_ablation", "license_base_places"])
def test_quality_sql(spark, sf, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    want = duckdb.sql(ORACLES[name])
    assert sorted(map(tuple, df.collect())) == sorted(want.select(", ".join(df.columns)).fetchall())


def test_quality_sql_on_odd_texts(spark):
    """All measurements, on lines, symbols, digits, controls and letters of many kinds."""
    r = random.Random(1)
    bits = ["a", "Ab", "É", "\u2022 x", "- y", "12. z", "\n", "\n\n", " ", "\t", "...", "\u2026", "!", "|", "***", "1234", "http://x", "{", "}", "\ufffd", "\x01", "\x7f", "x" * 45, "lorem ipsum dolor", "the", "der", "\U0001f600", "\r", "\x0b", "#", "a b c", "a b c"]
    rows = [(i, "".join(r.choice(bits) + r.choice(("", " ", "\n")) for _ in range(r.randint(0, 120)))) for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    names = ["doc_id", *quality.MEASURES, "fail_mask"]
    got = quality.ledger(documents).select("doc_id", "ledger.*").select(names)
    want = con.sql(f"{oracles._LEDGER} SELECT {', '.join(names)} FROM f")
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    kept = {i for i, d in docs.items() if not brute.quality(d.text)[-1]}
    judged = {r.doc_id for r in QUERIES["op10_quality_rules"](spark, sf).collect() if r.kept}
    assert judged <= kept
    near = brute.near_components({i: docs[i].text for i in judged}, 5)
    single = [i for i in judged if near[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [i for i, c in zip(single, brute.contamination([docs[i].text for i in single], items), strict=True) if not c[-1]]
    sizes = Counter()
    for i in clean:
        sizes[docs[i].source] += len(brute.spaced(docs[i].text))
    want = brute.targets(sizes)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= set(clean)
    assert all(r.text == docs[r.doc_id].text and r.source == docs[r.doc_id].source for r in got)
    taken, slots = Counter(), defaultdict(list)
    for r in got:
        taken[r.source] += len(brute.spaced(r.text))
        slots[r.shard].append(r.slot)
    longest = max(len(brute.spaced(docs[i].text)) for i in clean)
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
