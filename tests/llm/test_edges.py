"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""

import random
import re
import time

import duckdb
import pytest

from pyspark.sql import functions as F

from stratlas.llm import chat, decontam, html_blocks, html_extract, license, license_rules, lm, mixing, neardup, quality, sharding, urlfilter
from stratlas.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ledger string, mix int, n_words string"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, "x", 1, "y"),
    (3, LONG, "en", "a", len(LONG), None, None, None),
    (3, LONG, "en", "a", len(LONG), None, None, None),
    (4, LONG + " x", "de", None, len(LONG) + 2, None, None, None),
    (None, "one two three four five", "en", "b", 23, None, None, None),
    (5, "one two three four five", "en", "b", 23, None, None, None),
    (6, " \t\n\v\f\r", "en", "b", 6, None, None, None),
    (7, "É one", None, "\U0001f600", 5, None, None, None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(table, nothing):
    got = quality.ledger(table).collect()
    assert len(got) == len(ROWS) and got[0].asDict()["_ledger"].n_words == 0
    assert [r["_ledger"].n_words for r in got if r.doc_id == 3] == [60_000] * 2
    assert quality.quality_rules(nothing).count() == 0 and quality.quality_rules(table).columns == table.columns


def test_quality_ablation(table):
    out = quality.ledger(table)
    got = {r.rule: r for r in quality.ablation(out, F.col("_ledger")["fail_mask"]).collect()}
    assert got["short"].failed == 6 and got["repeated_windows"].failed == 3 and got["shouting"].failed_alone == 0


def test_near_duplicates(table, nothing):
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table, shingle=2).collect()]
    assert len(got) == len(ROWS)
    assert (3, 3, True) in got and (4, 3, False) in got and (None, None, True) in got and (5, 5, True) in got and (1, 1, True) in got
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.deduplicate(table, shingle=2).columns == table.columns


def test_near_duplicate_chain(spark):
    """Links between texts that aren't like the bucket's smallest id are found as well."""
    base = [f"t{i}" for i in range(100)]
    rows = [(k, " ".join(base[k * 4 :] + [f"n{j}" for j in range(k * 4)])) for k in range(12)]
    rows += [(100 + k, rows[5][1]) for k in range(50)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert set(got.values()) == {0}


def test_decontaminate(spark, table, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "three four"), (4, LONG[:400]), (5, "one two three"), (6, "one two three")], "item_id long, text string")
    out, name = decontam.find_contamination(table, items, keep=["doc_id", "n_words"])
    got = {r.doc_id: r[name] for r in out.collect()}
    assert got[5]["items"] == ["", "5", "6"] and [tuple(s) for s in got[5].spans] == [(0, 3)]
    assert got[1].n_words == 0 and got[3].spans[0].first == 0
    assert decontam.decontaminate(nothing, items).count() == 0
    assert decontam.decontaminate(table, items.limit(0)).count() == len(ROWS)


def test_decontaminate_in_blocks(spark, table, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(40)], "item_id long, text string")
    one, name = decontam.find_contamination(table, items, keep=["doc_id"])
    want = sorted(str(r) for r in one.collect())
    real = decontam.blocks
    monkeypatch.setattr(decontam, "blocks", lambda rows, window: real(rows, window, limit=7))
    many, _ = decontam.find_contamination(table, items, keep=["doc_id"])
    assert sorted(str(r) for r in many.collect()) == want


def test_mixing(table, nothing):
    out, name = mixing.mix(table, table.columns)
    got = out.collect()
    assert name == "_mix" and len(got) == len(ROWS) and all(r[name].taken <= 3 * r[name].size for r in got)
    assert mixing.curriculum(nothing).count() == 0
    assert mixing.curriculum(table).columns == table.columns


def test_sharding(table, nothing):
    out, name = sharding.shard(table, table.columns)
    got = out.collect()
    slots = sorted((r[name].shard, r[name].slot) for r in got)
    assert len(got) == len(ROWS) and len(set(slots)) == len(ROWS)
    assert sharding.shard(nothing, ["doc_id"])[0].count() == 0
    by_bytes, name = sharding.shard(table, ["doc_id"], shards=None, target_bytes=200_000)
    assert {r[name].shard for r in by_bytes.collect()} <= set(range(10))


def test_scoring(table, nothing):
    got = lm.score_documents(table, table).collect()
    assert len(got) == len(ROWS) and all(r.score <= 0 and r.base_score <= 0 and r.n_known == r.n_tokens for r in got)
    assert len({r.base_score for r in got if r.doc_id == 3}) == 1
    none = lm.score_documents(table, nothing).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert lm.score_documents(nothing, table).count() == 0


def test_licenses(spark, table, nothing):
    out, name = license.scan_licenses(table, ["doc_id", "n_words"])
    assert out.count() == len(ROWS) and license.scan_licenses(nothing, ["doc_id"])[0].count() == 0
    rows = [(1, "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: Apache-2.0"), (2, "écc by"), (3, "the GNU Lesser General Public License v2.1"), (4, "cc by cc by")]
    got = {r.doc_id: r[name] for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])[0].withColumnRenamed("licenses", name).collect()}
    assert [s.label for s in got[1].found] == ["cc-by-nc-4.0", "spdx-apache-2.0"] and not got[2].base
    assert [s.label for s in got[3].found] == ["lgpl-2.1"] and [s.label for s in got[3].base] == ["gpl"]
    assert [s.first for s in got[4].base] == [0, 2]


def test_url_filters(spark):
    urls = [None, "", "no scheme", "HTTPS://Sub.EXAMPLE.com:80/en/71?x#y", "http://example.com/en/6", "http://x.net/de/1", "http://example.net/de/81", "://", "http://notexample.com/EN/", "http://spam-farm.example.org/a", "http://spam-farm.example.org/a"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out, names = urlfilter.filter_urls(pages, pages.columns)
    got = [tuple(r[n] for n in names[:4]) for r in out.orderBy("page_id").collect()]
    assert names[0] == "_host" and got[0] == got[1] == got[2] == got[7] == ("", "", None, "allow")
    assert got[3] == ("sub.example.com:80", "/en/71", None, "allow")
    assert got[4][2:] == ("com/en/", "block") and got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("example.net/de/8", "block")
    assert got[9] == got[10] and got[9][3] == "block"
    assert urlfilter.filter_urls(pages.limit(0), ["page_id"])[0].count() == 0


def test_url_rule_bounds(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com:8080/en/7")], "page_id long, url string")
    assert urlfilter.filter_urls(pages, ["page_id"])[0].first().rule is None


#: Of each family by name, urls that its rule for a word must catch.
FORMS = {
    "host": ["{}.com/", "my-{}.net/x", "a.{}.b.org", "{}:8080/x"],
    "host label": ["{}.com", "a.{}.org/x"],
    "top domain": ["a.{}", "a.{}/x", "a.b.{}:80/x"],
    "server": ["{}.x.com/a/", "{}.x.com"],
    "folder": ["x.com/{}", "x.com/a/{}/b"],
    "file": ["x.com/{}", "x.com/a/{}"],
}
BLOCKED = [
    *["spam-farm.com/", "a.spam-farm.com/x", "casino.com/", "my-casino.net/x", "poker.com/", "my.poker.net/x", "porn.com/", "my-porn.net/x", "a.xxx/", "a.adult/"],
    *[f"{a}{b}.com/x" for a in ("", "www.") for b in ("link-farm", "linkfarm")],
    *[f"{a}.x.com/{b}/" for a in ("ad", "ads", "adserver") for b in ("ad", "ads", "banner", "click")],
    *[f"x-{a}-bank.com/{b}login/verify{c}" for a in ("secure", "verify") for b in ("", "a/b/") for c in ("", "/1", "account")],
    *["click.x.com/track/1", "x.com/warez/", "x.com/keygen/", "x.com/a/keygen/", "x.com/wp-login.php", "x.com/cart/checkout", "10.0.0.1/a/login/"],
]
ALLOWED = ["shop.org/en/A/b", "x.com/ads/", "linkfarms.com/", "ok.com/login/verifyaccount", "essex.gov.uk/casinos.html", "10.0.0.1/a/", "myclick.x.com/a"]


@pytest.mark.parametrize("common", ["", "ad banner click link farm", "ads adserver verify linkfarm login", "secure verify track wp warez"])
def test_url_index_loses_no_match(spark, common):
    """Whatever tokens are common, indexed verdicts are those of running every expression."""
    rules = [urlfilter.site_rule("shop.org/En/A/b", "block"), *urlfilter.PATTERNS]
    urls = [*BLOCKED, *ALLOWED[:6], "shop.org/En/A/bc"]
    for r in urlfilter.PATTERNS:
        kind, _, word = r.name.partition(": ")
        made = [f.format(word) for f in next((v for k, v in FORMS.items() if word and kind.endswith(k)), [])]
        assert all(re.search(r.pattern, u) for u in made)
        urls += made[:2]
    urls = list(dict.fromkeys(urls))
    wants = {u: "block" if any(re.search(r.pattern, u) for r in rules) else "allow" for u in urls}
    assert all(wants[u] == "block" for u in BLOCKED) and all(wants[u] == "allow" for u in ALLOWED[:6])
    filler = ["a.org/" + "/".join(common.split())] * 9 if common else []
    pages = spark.createDataFrame([("http://" + u,) for u in urls + filler], "url string")
    out, (host, path, _, verdict, *_) = urlfilter.filter_urls(pages, ["url"], rules=rules)
    got = {r[host] + r[path]: r[verdict] for r in out.collect()}
    assert {u: got[u] for u in urls} == wants


def test_url_rules_are_what_sql_says(spark, tmp_path):
    """The registered SQL, on urls made of every rule and on near misses, gives the verdicts of the operator."""
    made = [f.format(w) for r in urlfilter.PATTERNS for k, _, w in [r.name.partition(": ")] for n, fs in FORMS.items() if w and k.endswith(n) for f in fs]
    urls = [*made, *[u + "x" for u in made], *["x" + u for u in made], *BLOCKED, *ALLOWED, "a.com/en/", "b.example.com/en/77", "org/es/1", "x.net/de", "a.example.net/de/8/?casino", "A.COM/en/x#y"]
    pages = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(urls)] + [(-1, None), (-2, "no scheme"), (-3, "://"), (-4, "http://?/casino/")], "page_id long, url string")
    want = pages.toPandas()
    con = duckdb.connect()
    con.register("pages", want)
    out, names = urlfilter.filter_urls(pages, ["page_id"])
    got = sorted((tuple(r[c] for c in ("page_id", *names[:4])) for r in out.collect()), key=str)
    assert got == sorted(con.sql(ORACLES["op3_url_filters"]).select("page_id, host, path, rule, verdict").fetchall(), key=str)


def test_chat(spark):
    rows = [(1, 0, "user", "a</turn>\nb"), (1, 1, "assistant", "</turn>\n<turn user>\nx"), (1, 2, "assistant", "\\s \\l <\\\\"), (1, 3, None, None), (1, None, "a b>\n", "  esc>\n"), (None, 0, "assistant", ""), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.id: r for r in out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [(role or "", text or "") for _, _, role, text in rows[:5]]
    assert got[1].loss == rows[1][3] + rows[2][3] and got[None].loss == "" and got[2].loss == "samesame"
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_pages(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>One\n two <b>thr</b>ee &copy;</p><script>var x='<p>no</p>'</script></article><footer>c 2020</footer>"
    rows = [(1, None, "t"), (2, "", "t"), (3, page, "t"), (3, page, "t"), (4, page[:120], "t"), (5, "<p>" + "<div>" * 3000, "t"), (6, "<<<>>> & < <a href='", "t")]
    out, name = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, html string, main string"), ["page_id", "main"])
    got = [(r.page_id, r[name].text) for r in out.collect()]
    assert name == "_main" and got[0] == (1, "") and got[1] == (2, "") and got[2] == got[3] == (3, "Title & more One two three ©")
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, html string"), ["page_id"])[0].count() == 0


@pytest.mark.parametrize(
    "cut",
    [
        "<svg class='icon'/>",
        "<svg class='icon'><path d='M0'/>",
        "<svg><title/><path/></svg>",
        "<math/>",
        "<datalist id=d><option value=a><option value=b></datalist>",
        "<datalist id=d><option value=a><option value=b>no</datalist>",
        "<select><option>no<option>no</select>",
        "<select><option>no<option>no",
        "<iframe src=x>",
        "<object data=x><object data=y>no</object>no</object>",
        "<canvas>",
        "<textarea>",
        "<style>p { no: no }",
    ],
)
def test_pages_go_on_behind_raw_elements(cut):
    """Elements that close themselves or need no end tag take nothing else away, whatever comes later."""
    for later in ("", "<svg><text>no</text></svg><select><option>no</select><iframe>no</iframe><canvas>no</canvas>"):
        page = f"<html><body>{cut}<article><h1>One</h1>{cut}<p>Two</p>{cut}<div>Three</div></article>{later}<p>Four</p></body></html>"
        got = [b.text for b in html_blocks.blocks(page)]
        assert got == ["One", "Two", "Three", "Four"]
    for tag in ("svg", "select", "textarea", "iframe"):
        assert [b.text for b in html_blocks.blocks(f"<{tag}>" * 20_000 + "<p>One</p>")] == ["One"]


def test_articles_behind_raw_elements(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").limit(40).collect()
    forms = ["<svg class='icon'/>", "<datalist id=d><option value=a><option value=b></datalist>", "<select><option>x<option>y</select>"]
    plain, changed = [], []
    for r in rows:
        for form in forms:
            plain.append((len(plain), r.html))
            changed.append((len(changed), r.html.replace("<article>", form + "<article>" + form, 1)))
    text = lambda pages: {r.page_id: r["main"].text for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, html string"), ["page_id"])[0].toDF("page_id", "main").collect()}
    assert text(changed) == text(plain)


def test_scoring_in_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {(r.doc_id, r.score) for r in lm.score_documents(docs, docs.filter(~lm.held_out("doc_id"))).select("doc_id", F.round("score", 3).alias("score")).collect()}
    got = {(r.doc_id, r.score) for r in lm.score_documents(docs, docs.filter(~lm.held_out("doc_id")), part_rows=2_000, group_bytes=20_000).select("doc_id", F.round("score", 3).alias("score")).collect()}
    assert len(got) == len(want) and len(got - want) <= 2


_TITLE = "The old mill at the river"
_TEXT = [
    "The mill was built in the year of the great flood, when most of the houses by the river had been lost to the water.",
    "It was the work of two brothers who had come from the north with their tools and not much else, and who stayed for the rest of their lives.",
    "In the second winter the wheel broke, and for three months the people of the valley had to carry their grain over the hills to the next town.",
    "Today the building is a museum, but the wheel still turns on the first Sunday of every month for all who want to see it.",
]
_MENU = "<a href=/>Home</a> <a href=/news>News</a> <a href=/about>About</a> <a href=/contact>Contact</a>"
_LIST = f"<ul>{''.join(f'<li>{a}</a></li>' for a in _MENU.split('</a> '))}</ul>"
_FOOT = "&copy; 2020 Valley Museum. All rights reserved. Privacy policy | Terms | Imprint"
_NOTICE = "<p>We use cookies. By continuing to use this site you accept our privacy policy.</p><button>Accept</button>"
_SIDE = "<h3>Related posts</h3><ul><li><a href=/a>The bridge of the town</a></li><li><a href=/b>A walk in the hills</a></li></ul>"
_TALK = "<h3>Comments</h3><div><b>user7</b> says:<p>Thanks, great post!</p></div><div><b>guest</b> reply 2 days ago<p>I agree</p></div>"


def _body(title: str = "h1", block: str = "p") -> str:
    return f"<{title}>{_TITLE}</{title}>" + "".join(f"<{block}>{t}</{block}>" for t in _TEXT)


LAYOUTS = {
    "grid": f"<div class='container'><div class='row'><div class='col-md-12'>{_LIST}</div></div><div class='row'><div class='col-md-8'>{_body()}</div><div class='col-md-4'>{_SIDE}</div></div><div class='row'>{_FOOT}</div></div>",
    "no classes": f"<div>{_LIST}</div><div>{_NOTICE}</div><div>{_body()}</div><div>{_SIDE}</div><div>{_TALK}</div><div>{_FOOT}</div>",
    "table": f"<table><tr><td colspan=2>{_MENU}</td></tr><tr><td>{_SIDE}</td><td>{_body()}</td></tr><tr><td colspan=2>{_FOOT}</td></tr></table>",
    "blog": f"<div id='header'>{_LIST}</div><div class='entry-content'>{_body('h2')}</div><div id='comments'>{_TALK}</div><div id='sidebar'>{_SIDE}</div><div id='footer'>{_FOOT}</div>",
    "main": f"<header>{_LIST}</header><main>{_body()}</main><aside>{_SIDE}</aside><footer>{_FOOT}</footer>",
    "made-up classes": f"<div class='css-1a2b3c'>{_LIST}</div><div class='css-9f8e7d'><div class='sc-00aa11'>{_body('h1', 'div')}</div></div><div class='css-77aa00'>{_SIDE}</div><div class='css-0c0d0e'>{_FOOT}</div>",
    "unclosed": f"<div>{_LIST}<div><h1>{_TITLE}</h1>{''.join(f'<p>{t}' for t in _TEXT)}</div><div>{_FOOT}",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    """Pages written by hand, with telling names, other names or none."""
    ((text, _, _),) = html_extract.main_text(html_extract.fitted(), [f"<html><head><title>x</title></head><body>{LAYOUTS[name]}</body></html>"])
    assert text == " ".join([_TITLE, *_TEXT])


def test_open_tags_take_linear_time():
    for page in ("<div class=a>" * 100_000 + "<p>One", "<span>" * 100_000 + "<p>One</p>" * 1000, "<ul>" + "<i>" * 50_000 + "<li>One" * 5000):
        began = time.perf_counter()
        assert html_blocks.blocks(page)[0].text == "One"
        assert time.perf_counter() - began < 4


def test_repeated_notices_take_linear_time(spark):
    text = "Licensed under the Apache License, Version 2.0. See the GNU General Public License v3. " * 12_000
    out, name = license.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"])
    began = time.perf_counter()
    (row,) = out.collect()
    assert len(row[name].found) >= 24_000 and len(row[name].base) == 12_000
    assert time.perf_counter() - began < 20


def test_suppression_is_that_of_all_pairs():
    r = random.Random(5)
    for _ in range(300):
        found = []
        for order in range(r.randint(0, 60)):
            first = r.randrange(40)
            last = first + r.randrange(8)
            priority = r.randrange(4)
            found.append(((-priority, first - last, order, first), (f"l{order % 7}", first, last, priority)))
        taken = []
        for _, s in sorted(found):
            if not any(t[1] <= s[1] and s[2] <= t[2] for t in taken):
                taken.append(s)
        assert license.suppress(found) == sorted(taken, key=lambda s: (s[1], s[2], s[0]))


def test_detections_are_those_of_running_every_rule():
    """The keyword gate loses nothing: on texts made of rule words, all rules find what gated ones do."""
    r = random.Random(3)
    rules = license_rules.signatures()
    by_gate = {}
    for i, x in enumerate(rules):
        by_gate.setdefault(x.gate, []).append((i, x))
    words = sorted({w for x in rules for w in re.findall(r"[a-z0-9]+", re.sub(r"\\.", " ", x.pattern.pattern)) if len(w) > 1} | {"2", "0", "3"})
    for _ in range(60):
        tokens = [r.choice(words) for _ in range(r.randint(1, 300))]
        starts = [sum(len(t) + 1 for t in tokens[:i]) for i in range(len(tokens))]
        text = " ".join(tokens)
        gated = license.detect(text, starts, {t for t in tokens if t in by_gate}, by_gate)
        assert gated == license.detect(text, starts, set(by_gate), by_gate)


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on nulls, repeated rows, ties and an empty table; all but the last give the columns of documents."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"{a}{b}" for a in ("the", "and", "word", "line", "mill") for b in range(14)) + " the of and to."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, prose, "en", "a", 9), (3, prose, "en", "a", 9), (None, prose + " x", "de", None, 9), (4, prose + " y", None, "b", None), (5, prose[:300], "en", "b", 9)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf)
            assert got.columns[: len(docs.columns)] == docs.columns, name
            assert got.count() <= 3 * len(data), name
            if not data:
                assert got.count() == 0
        docs.write.parquet(f"{tmp_path}/{len(data)}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{len(data)}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{len(data)}").collect()
        assert {r.doc_id for r in out} <= {3, None, 4, 5} and sorted(r.slot for r in out if r.shard == 0) == list(range(sum(r.shard == 0 for r in out)))


def test_slots_follow_files(spark, tmp_path):
    rows = [(i, f"text {i * 7919 % 500} {'x' * (i % 50)}", "en", "a", i % 50) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out, name = sharding.shard(docs, ["doc_id"], order=sharding.file_order(docs))
    by = {}
    for r in out.collect():
        by.setdefault(r[name].shard, []).append((r[name].slot, r.doc_id))
    assert len(by) == 8 and all([i for _, i in sorted(v)] == sorted(i for _, i in v) for v in by.values())
    assert sharding.file_order(spark.range(3)) is None


def test_ids_that_are_not_integers(spark):
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    assert neardup.deduplicate(spark.createDataFrame([(1, "a b"), (2, "a b")], "gone long, text string"), id="gone").count() == 1


def test_ranks_are_the_range_sorted_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, name = mixing.ranked(docs, ["doc_id"])
    copies = sorted((p, k) for r in out.collect() for p, k in zip(r[name].positions, sorted(r[name].ranks), strict=True))
    assert sorted(k for _, k in copies) == list(range(len(copies)))
    places = [p for p, _ in sorted(copies, key=lambda x: x[1])]
    assert places == sorted(places)
