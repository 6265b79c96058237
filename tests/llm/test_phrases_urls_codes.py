"""Collocations, url rules and vector codes against brute force, and their defined results at the edges."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcube.llm import phrases, url_filter, vector_codes
from loamcube.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import with_clashes

SF = "/root/testdata/sf0.001"

# collocations


def brute_index(text, depth):
    counts = Counter()
    for i in range(len(text)):
        for k in range(1, depth + 1):
            g = tuple(text[i : i + k])
            if len(g) == k and 0 not in g:
                counts[g] += 1
    return counts


@pytest.mark.parametrize("steps", ["lll", "rrr", "lrl", "rlr", "lr", "l"])
def test_intervals_extend_to_either_side(rng, steps):
    text = np.array([rng.choice([0, 1, 1, 2, 3, 5, 7]) for _ in range(400)] + [0])
    want = brute_index(text.tolist(), len(steps) + 1)
    index = phrases.PhraseIndex(text, len(steps) + 1, 9)
    ids, *interval = index.words()
    grams = [(int(i),) for i in ids]
    for n, side in enumerate(steps, 2):
        parent, word, *interval = index.left(*interval) if side == "l" else index.right(*interval)
        grams = [(int(w), *grams[p]) if side == "l" else (*grams[p], int(w)) for p, w in zip(parent, word, strict=True)]
        assert dict(zip(grams, interval[1].tolist(), strict=True)) == {g: c for g, c in want.items() if len(g) == n}


def test_index_of_nothing():
    index = phrases.PhraseIndex(np.empty(0, np.int64), 4, 0)
    ids, *interval = index.words()
    assert len(ids) == 0 and all(len(x) == 0 for x in index.right(*index.left(*interval)[2:]))


def test_blocks_of_a_text_give_its_words(monkeypatch):
    text = "Ab, c d. é\tf\x0bg  zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz h;;i\nj" * 5
    whole = [w for ws in phrases.pieces(text.encode()) for w in ws]
    for block in (1, 2, 7, 40):
        monkeypatch.setattr(phrases, "BLOCK", block)
        assert [w for ws in phrases.pieces(text.encode()) for w in ws] == whole
    assert list(phrases.pieces(b"")) == []


def brute_collocations(docs, least, top):
    count, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        count[lang, tuple(words[i : i + k])] += 1
    found = {g: n for g, n in count.items() if n >= least and len(g[1]) > 1}
    out = []
    for (lang, g), a in found.items():
        longer = [n for (other, h), n in found.items() if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * n >= 80 * a for n in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (count[lang, g[:k]] + count[lang, g[k:]]), k, count[lang, g[:k]], count[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, left, right, total[lang], score))
    ranked = []
    for lang in total:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


def sentences(rng, n):
    words, fixed = ["a", "b", "Le", "é", "x\u00a0y", "d", "the", "q\x1cz"], ["New  york city hall", "of the a", "the THE the the", "b\tb"]
    return " ".join(rng.choice(fixed) + rng.choice(["", ",", ". ", "\n", "!"]) if rng.random() < 0.3 else rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("shard_words", [7, 200, 1 << 21])
def test_collocations_by_brute_force(spark, rng, shard_words):
    docs = [(sentences(rng, rng.randint(0, 60)), rng.choice(["en", "fr", None, ""])) for _ in range(120)] + [(None, "en"), ("", None), ("lone " * 3000, "de"), ("same text here. " * 40, "en")] + [("same text here", "en")] * 30
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    out = phrases.collocations(with_clashes(df, "word", "number", "phrase", "n", "shard"), least=6, top=25, shard_words=shard_words)
    assert sorted(tuple(r) for r in out.collect()) == brute_collocations(docs, 6, 25)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "a")], "text string, lang string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 2**53 + 1, 2**54 + 3, 2**55 + 7
    got = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()["s"]
    assert got == 2_000_000 * a // (left + right)


# url rules


def brute_url(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


URLS = [
    None, "", "example.net/en/", "http://", "https://EXAMPLE.net/en/1?q=/de/", "http://a.example.net/en/x#y", "ftp://badexample.net/en/", "http://net", "http://net/", "http://x.net./",
    "http://a.b.example.com/de/1", "http://example.com/DE/1", "http://org/fr/", "http://www.example.org/fr/?a://b/", "http://u@h.net:80/x", "://net/x", "a://b://c.net/", "http://.net/z",
    "http://deep.a.b.c.d.e.f.net/" + "p/" * 5000, "http://example.net/en", "http://com.example/x", "http://net/\u00e9\n2", "http://x.com/aaa", "http://x.com/ab", "http://x.com/aab/c",
]
NESTED = [*url_filter.RULES, ("x.com", "/a", "block"), ("x.com", "/aa", "allow"), ("x.com", "/aab", "block"), ("com", "/aab/", "allow"), ("", "", "allow"), ("b.c.d.e.f.net", "", "allow"), ("f.net", "/p/p/", "block"), ("NET", "/z", "allow"), ("com.example", "/", "block")]


def verdicts(spark, urls, rules, parts=3):
    pages = with_clashes(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(parts), "uf_host", "uf_rule", "host", "path", "rule", "key", "verdict", "stack", "span")
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark, tuple(rules)))
    assert {"host", "path", "rule", "key", "verdict", "stack", "span"} <= set(out.columns)
    return sorted((r["page_id"], r["uf_host"], r["uf_path"], r["uf_rule"], r["uf_verdict"]) for r in out.collect())


@pytest.mark.parametrize("rules", [url_filter.RULES, NESTED])
def test_url_rules_by_brute_force(spark, rules):
    lowered = [(h.lower(), p, v) for h, p, v in rules]
    want = [(i, *brute_url(u, lowered, "allow")) for i, u in enumerate(URLS)]
    assert verdicts(spark, URLS, rules) == want


def test_many_urls_and_rules_over_many_ranges(spark, rng):
    label = lambda: rng.choice(["a", "b", "aa", "a-b", "net", "é"])
    host = lambda most: ".".join(label() for _ in range(rng.randint(1, most)))
    path = lambda most: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, most)))
    rules = list({(host(3), path(4)): rng.choice(["allow", "block"]) for _ in range(300)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host(5)}{path(8)}" for _ in range(600)] + ["http://a.a/ab"] * 300
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert verdicts(spark, urls, rules) == [(i, *brute_url(u, rules, "allow")) for i, u in enumerate(urls)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_url_tables_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    rules = url_filter.rule_table(spark)
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    (row,) = url_filter.filter_urls(pages, rules.limit(0)).collect()
    assert (row["uf_rule"], row["uf_verdict"]) == (None, "allow")
    nulls = spark.createDataFrame([("net", None, "block"), (None, "/", "block"), ("net", "/", None), ("net", "/", "allow"), ("NET", "/", "block")], "host string, path string, verdict string")
    (row,) = url_filter.filter_urls(pages, nulls).collect()
    assert (row["uf_rule"], row["uf_verdict"]) == ("net/", "block")


def test_url_plan_has_no_python(spark):
    plan = QUERIES["op12_url_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


# vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, lab, [math.floor(256 * x) if abs(x) < 1e30 else 256 * int(x) for x in v]) for i, lab, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // parts
    books = [[r[2][p * width : (p + 1) * width] for r in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        codes = [[min((square(x[p * width : (p + 1) * width], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for _, _, x in kept]
        if n == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[p * width : (p + 1) * width] for (_, _, x), c in zip(kept, codes, strict=True) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    errors = [sum(d for d, _ in c) for c in codes]
    labels = Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        labels[lab] += e
    name = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    fits = lambda e: e if e < 2**63 else None
    return sorted(((i, "".join(f"{e:02x}" for _, e in c), fits(err), fits(labels[lab])) for (i, lab, _), c, err in zip(kept, codes, errors, strict=True)), key=str), name


def codes(spark, rows, parts, entries, rounds=2, kind="double"):
    df = with_clashes(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(3), "vq_code", "vq_label", "part", "entry")
    books = vector_codes.fit(df, parts=parts, entries=entries, rounds=rounds)
    out = vector_codes.with_label_errors(vector_codes.encode(df, books))
    assert {"label", "embedding", "part", "entry"} <= set(out.columns)
    return sorted(((r["vec_id"], r["vq_code"], r["vq_error"], r["vq_label_error"]) for r in out.collect()), key=str), vector_codes.codebooks_sha256(books)


@pytest.mark.parametrize(("parts", "entries"), [(4, 16), (2, 5), (1, 1)])
def test_vector_codes_by_brute_force(spark, rng, parts, entries):
    rows = [(i, rng.choice([1, 2, None]), [round(rng.gauss(0, 0.02), rng.choice([2, 3])) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, 3, [0.0] * 8) for i in range(40)] + [(7, 1, rows[7][2]), (None, 1, rows[3][2])]
    assert codes(spark, rows, parts, entries) == brute_codes(rows, parts, entries, 2)


def test_vectors_at_the_edges(spark, rng):
    rows = [(0, 1, [float("nan")] * 4), (1, 1, [1.0, None, 1.0, 1.0]), (2, 1, [float("inf"), 0.0, 0.0, 0.0]), (3, 1, []), (4, 1, None), (5, None, [1.0] * 4), (6, None, [-1e200, 1e200, 3e37, 0.5]), (7, 2, [1.0] * 6), (8, 2, [1.0] * 5), (9, 2, [2e9, -3e9, 0.1, 0.0]), (10, 2, [1e-320] * 4)]
    assert codes(spark, rows, 2, 64) == brute_codes(rows, 2, 64, 2)
    assert codes(spark, rows[:5], 2, 64) == ([], hashlib.sha256(b"").hexdigest())
    assert codes(spark, [(1, 1, [0.1, 0.2])] * 5, 2, 3) == brute_codes([(1, 1, [0.1, 0.2])] * 5, 2, 3, 2)


def test_orchard_search_skips_and_keeps_ties(rng):
    entries = np.array([[rng.randint(-50, 50) for _ in range(3)] for _ in range(40)] + [[0, 0, 0]] * 3 + [[rng.randint(-50, 50) for _ in range(3)]])
    book = vector_codes.Codebook(entries)
    vectors = np.array([[rng.randint(-60, 60) for _ in range(3)] for _ in range(500)] + [[0, 0, 0]])
    full = ((vectors[:, None] - entries[None]) ** 2).sum(-1)
    index, d = book.nearest(vectors)
    assert (index == full.argmin(1)).all() and (d == full.min(1)).all()
    measured = []
    real = vector_codes.squared
    vector_codes.squared = lambda a, b: measured.append(len(a)) or real(a, b)
    try:
        book.nearest(vectors)
    finally:
        vector_codes.squared = real
    assert sum(measured) < 0.7 * full.size


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_url_filter", "op13_vector_codes"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in got.fetchall())
