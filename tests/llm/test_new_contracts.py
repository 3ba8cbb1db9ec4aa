"""Exact dedup, manifest and phrases: the driver's queries against SQL, and brute force on odd input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from pyspark.sql import functions as F

from stratlas.llm import exactdedup, manifest, phrases
from stratlas.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_edges import ROWS, SCHEMA

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_merkle_manifest", "op13_phrase_collocations"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, name, size):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/{size}/documents.parquet'")
    df, want = QUERIES[name](spark, f"/root/testdata/{size}"), duckdb.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(map(tuple, df.select(*want.columns).collect()))
    assert got and got == sorted(want.fetchall())


def classes(rows):
    same = defaultdict(list)
    for r in rows:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for t, ids in same.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("hashed", [exactdedup.content_hash, lambda t: F.length(t) % 2, lambda t: F.struct((F.length(t) % 3).alias("a"), F.lit(0).alias("b"))])
def test_exact_dedup(table, nothing, hashed):
    """Also with hashes that collide."""
    out, name = exactdedup.duplicates(table, ["doc_id", "ledger", "n_words"], hashed=hashed)
    assert out.columns == ["doc_id", "ledger", "n_words", name]
    got = sorted(((r.doc_id, *r[name]) for r in out.collect()), key=str)
    assert got == classes(ROWS)
    assert exactdedup.deduplicate(nothing).count() == 0
    kept = exactdedup.deduplicate(table)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "4", "5", "6", "7"]


def test_exact_dedup_by_shuffle(table, monkeypatch):
    monkeypatch.setattr(exactdedup, "BROADCAST_HASHES", 0)
    out, name = exactdedup.duplicates(table, ["doc_id"])
    assert sorted(((r.doc_id, *r[name]) for r in out.collect()), key=str) == classes(ROWS)


def test_exact_dedup_clashing_names(spark):
    names = ["salt", "parts", "slot", "h", "t", "i", "row", "id", "keep", "size", "rows", "exact", "sha"]
    df = spark.createDataFrame([(7, "a  b", *range(13)), (3, "a\tb", *range(13))], "doc_id int, text string, " + ", ".join(f"{n} int" for n in names))
    out, name = exactdedup.duplicates(df, df.columns)
    assert out.columns == [*df.columns, name] and {r[name].keep_id for r in out.collect()} == {3}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves):
    """Digest over the leaves, and the siblings of each."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(paths):
            p += [level[k] for k in range(at[i] & ~1, min(len(level), (at[i] & ~1) + 2)) if k != at[i]]
        at = [k // 2 for k in at]
        level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 16, 21])
@pytest.mark.parametrize("height", [0, 3, 5])
def test_paths(n, height, monkeypatch):
    """Leaf by leaf, with every node made in time and few of them held."""
    leaves = [sha(str(i)) for i in range(n)]
    height = max(height, (n - 1).bit_length())
    late = []
    finish = manifest.Treehash.finish
    monkeypatch.setattr(manifest.Treehash, "finish", lambda s: (late.append(not s.done), finish(s))[1])
    walk = manifest.paths(leaves, height)
    first = next(walk)
    del late[:]
    got = [first, *walk]
    assert not any(late)
    root, want = tree(leaves)
    for i, path in enumerate(got):
        assert [s for s in path if s] == want[i]
    for _ in range(height - (n - 1).bit_length()):
        root = sha(root)
    assert manifest.fold(leaves, height) == root


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifested(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, sha("".join(entry(r[f]) for f in FIELDS)), r["doc_id"]))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    made = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in keys}
    root, over = tree([made[k][0] for k in keys])
    return sorted(((x[3], x[2], made[k][0], root, sha("".join([*p, *over[j]]))) for j, k in enumerate(keys) for x, p in zip(sorted(by[k], key=lambda x: x[:3]), made[k][1], strict=True)), key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(spark, table, levels):
    """Also with blocks of two and four leaves, which take many tiers."""
    more = [(i, f"t{i}", ["en", "fr", None, "de", "\U0001f600", "z"][i % 7 % 6], None, i, None, None, None) for i in range(100, 160)]
    df = spark.createDataFrame([*ROWS, *more, *more[:9]], SCHEMA).repartition(3)
    out, name = manifest.manifest(df, ["doc_id", "ledger"], FIELDS, levels=levels)
    m = F.col(name)
    got = out.select("doc_id", m["leaf"], m["subroot"], m["root"], manifest.proof_digest(m["proof"]), manifest.above(m["leaf"], m["proof"])).collect()
    assert all(r[3] == r[5] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == manifested([dict(zip(SCHEMA.replace(",", "").split()[::2], r, strict=True)) for r in [*ROWS, *more, *more[:9]]])


def test_manifest_of_nothing(nothing, spark):
    assert manifest.manifest(nothing, ["doc_id"], FIELDS)[0].count() == 0
    out, name = manifest.manifest(spark.createDataFrame([(1, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long"), ["doc_id"], FIELDS)
    (r,) = out.collect()
    assert r[name].leaf == r[name].subroot == r[name].root and not r[name].proof


def mined(rows, least, top, percent=100, longest=5):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    found = defaultdict(list)
    for (lang, p), a in often.items():
        if any(x == lang and inside(p, q) and 100 * c >= percent * a for (x, q), c in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, xs in found.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top], 1))


@pytest.mark.parametrize(("percent", "names"), [(100, 1_000_000), (60, 1_000_000), (100, 12), (60, 0)])
def test_phrases(spark, percent, names, monkeypatch):
    """Also with names that are joined instead of sent, from the second or the first level on."""
    monkeypatch.setattr(phrases, "NAMES", names)
    rng = random.Random(5)
    words = ["New", "york", "city", "É", "of", "the", "x-y", "\U0001f600", "it's"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", ",", "\t", "  "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(80)]
    rows += [(None, "en"), ("", None), ("...", "fr"), (" one", "en")] + [("the whole same phrase again", "en")] * 20 + [("a b a b a b a b", "fr")] * 10
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, chunk int, f int").repartition(5)
    got = sorted(map(tuple, phrases.collocations(df, top=40, least=8, percent=percent).collect()))
    assert got == mined(rows, 8, 40, percent)


def test_phrases_of_nothing(spark, table, nothing):
    assert phrases.collocations(nothing).count() == 0 and phrases.collocations(table.limit(2)).count() == 0
    got = {(r.phrase, r.a) for r in phrases.collocations(table).collect()}
    assert ("w1 w2", 122) not in got and ("w0 w1 w2 w3 w4", 122) in got
