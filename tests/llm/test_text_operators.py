"""Operators on texts against brute force, and their defined results at the edges."""

import hashlib
import json
import re
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamcube.llm import chunk_dedup, decontam, html_text, license_scan, mixing, simhash, suffix_dedup, token_count, toxicity
from loamcube.llm.chunk_dedup import Chunking
from tests.llm.conftest import with_clashes

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"
EDGE = [(1, None, None), (2, "", "a"), (None, "null id text " * 30, "a"), (3, "same " * 100, "b"), (3, "same " * 100, "b"), (4, "x" * 200_000, None), (5, "é€😀 " * 200, "b")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# suffix-array dedup


def brute_repeats(docs, length):
    count = {}
    data = [(t or "").encode() for _, t in docs]
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (d, _), b in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rng, length):
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (length // 2, length - 1, length, length + 1, 2 * length, 3 * length)]
    docs = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, length))) + (rng.choice(shared) if rng.random() < 0.6 else "")
        docs.append((i, text))
    return docs + [(60, "a" * 700), (61, None), (62, ""), (63, "ab" * 150), (64, docs[3][1]), (None, docs[5][1]), (7, docs[7][1]), (8, "other")]


def repeats_of(spark, docs, parts=3, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    out = suffix_dedup.remove_repeats(df, want_text=False, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "sd_n_bytes", "sd_n_removed", "sd_n_spans", "sd_kept_sha256").collect()), key=str)


@pytest.mark.parametrize(("length", "window"), [(200, 137), (50, 20), (60, 40)])
def test_repeats_against_brute_force(spark, rng, length, window):
    docs = passages(rng, length)
    assert repeats_of(spark, docs, length=length, window=window) == brute_repeats(docs, length)


def test_repeats_of_a_passage_in_many_contexts(spark, rng):
    # one core for all, of some 100 bytes, and passages around it that some share
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    middle, left, right = say(100), [say(80) for _ in range(6)], [say(80) for _ in range(6)]
    docs = [(i, say(rng.randint(0, 90)) + rng.choice(left)[rng.randint(0, 70) :] + middle + rng.choice(right)[: rng.randint(5, 80)] + say(rng.randint(0, 90))) for i in range(300)]
    docs += [(1000, "a line of text that stands here again and again\n" * 90), (1001, "word " * 900), (1002, "xyz" * 70), (1003, "a line of text that stands")]
    assert repeats_of(spark, docs) == brute_repeats(docs, 200)


def test_repeats_of_very_long_texts(spark, rng, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1000)
    docs = [(i, "".join(rng.choice("abcdefghij ") for _ in range(2500))) for i in range(4)]
    docs += [(10, docs[0][1][300:2100] + docs[1][1] + docs[0][1]), (11, "b" * 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").toPandas()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"rid": [str(i).encode() for i in df.doc_id], "text": df.text.tolist()})
    rows = [r for b in suffix_dedup._anchors(200, 137)(iter([batch])) for r in b.to_pylist()]
    # runs in slices cover each start of each text once
    for d, t in docs:
        starts = sorted(s for r in rows if r["rid"] == str(d).encode() for s in range(r["lo"], r["reach"] + 1))
        assert starts == list(range(len(t) - 199))
    assert sum(r["rid"] == b"11" for r in rows) < 40
    million = [(1, "a" * 1_000_000), (2, "a" * 150), (3, "ab" * 300_000 + "c" * 250)]
    got = {r[0]: r[2:4] for r in repeats_of(spark, million)}
    assert got == {1: (1_000_000, 1), 2: (0, 0), 3: (600_250, 1)}


def test_repeats_at_the_edges(spark, edge, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    out = suffix_dedup.remove_repeats(with_clashes(edge, "sd_text", "rid", "lo", "sd_n_bytes")).collect()
    assert len(out) == len(EDGE) and {r.rid for r in out} == {"old"}
    by = {r.doc_id: r for r in out}
    assert by[1].sd_n_bytes == 0 and by[1].sd_text == "" and by[3].sd_n_removed == 500 and by[4].sd_n_removed == 200_000


# chunks


def test_chunks_cover_texts_and_resist_shifts(rng):
    how = Chunking()
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    data = np.frombuffer(text, np.uint8)
    ends = chunk_dedup.chunk_ends(data, np.array([0, 5000, 5000, len(text)]), how)
    assert {5000, len(text)} <= set(ends.tolist()) and max(np.diff(np.append(0, ends))) <= how.most

    def cut(t):
        ends = chunk_dedup.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]), how).tolist()
        return {t[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    moved = text[:3000] + b"inserted" + text[3000:]
    assert len(cut(text) & cut(moved)) > 0.95 * len(cut(text))


def test_gear_hash_is_the_rolling_sum():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog", np.uint8)
    h, want = 0, []
    for b in data:
        h = (h * 2 + int(chunk_dedup.GEAR[b])) % 65536
        want.append(h)
    assert chunk_dedup.gear_hashes(data).tolist() == want


def brute_chunks(docs, how):
    places = {}
    cuts = {}
    rows = sorted({(d, t) for d, t in docs if t}, key=lambda x: (x[0] is None, x[0] or 0))
    for d, t in rows:
        b = t.encode()
        ends = chunk_dedup.chunk_ends(np.frombuffer(b, np.uint8), np.array([0, len(b)]), how).tolist()
        cuts[d, t] = list(zip([0, *ends], ends, strict=False))
        for a, e in cuts[d, t]:
            places.setdefault(b[a:e], []).append((d, t, a))
    out = {}
    for d, t in rows:
        b, runs = t.encode(), []
        for a, e in cuts[d, t]:
            if len(places[b[a:e]]) > 1:
                if runs and runs[-1][-1][1] == a:
                    runs[-1].append((a, e))
                else:
                    runs.append([(a, e)])
        long = [c for run in runs if run[-1][1] - run[0][0] >= how.stretch for c in run]
        later = [c for c in long if places[b[c[0] : c[1]]][0] != (d, t, c[0])]
        out[d, t] = (sum(e - a for a, e in long), sum(e - a for a, e in later))
    return out


def test_chunk_dedup_against_brute_force(spark, rng):
    docs = [(d, t) for d, t in passages(rng, 300) if d is not None]
    got = chunk_dedup.remove_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_chunks(docs, Chunking())
    assert {(r.doc_id, r.text): (r.cd_n_repeated, r.cd_n_removed) for r in got if r.text} == want
    assert all(len(r.cd_text.encode()) <= r.cd_n_bytes - r.cd_n_removed for r in got) and any(r.cd_n_removed for r in got)


def test_chunk_dedup_at_the_edges(spark, edge, empty):
    assert chunk_dedup.remove_repeated_chunks(empty).count() == 0
    out = chunk_dedup.remove_repeated_chunks(with_clashes(edge, "cd_text", "digest", "place")).collect()
    assert len(out) == len(EDGE) and {r.digest for r in out} == {"old"}


# simhash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    part = {i: i for i in fps}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                part[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_components_against_brute_force(spark, rng, crowd):
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))) for i in range(150)}
    texts |= {200: None, 201: "", 202: "ONE two", 203: "one  TWO", 204: "x " * 5000}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, crowd=crowd).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_links_of_crowded_lists(spark, rng, crowd):
    centre = rng.getrandbits(64)
    near = {centre}
    for _ in range(80):
        near.add(rng.choice(sorted(near)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = dict(enumerate(sorted(near)))
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in fps.items()], "fid long, fp binary")
    links = simhash.fingerprint_links(df, crowd=crowd)
    got = {r.node: r.component for r in simhash.connected_components(links).collect()}
    assert {i: got.get(i, i) for i in fps} == brute_components(fps)


def test_near_copies_go_and_clean_texts_stay(spark, rng):
    words = ["w%d" % i for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:15]):
        w = t.split()
        w[rng.randrange(300)] = "changed"
        w[rng.randrange(300)] = "also"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, base[0]), (None, base[1]), (None, "alone " * 30), (300, None), (301, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [*range(30), 300]
    assert [r.text for r in kept if r.doc_id is None] == ["alone " * 30]


def test_one_id_on_several_texts(spark):
    b, c = " ".join(f"b{i}" for i in range(100)), " ".join(f"c{i}" for i in range(100))
    rows = [(3, b), (5, "nothing like it " + c[::-1]), (5, b + " tail"), (9, c), (None, c + " x"), (None, "no id"), (None, "no  id")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in kept) == [(0, "no"), (3, "b0"), (5, "no"), (9, "c0")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scheme=simhash.NEAR).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 9), (3, 3), (5, 3), (5, 5), (9, 9)]
    same = simhash.near_duplicates(spark.createDataFrame([(4, "a b c"), (4, "d e f"), (2, "d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in same) == [(2, 2), (4, 2), (4, 4)]


def planted_at(rng, similarity, name, length=300):
    """Two texts whose 5-word shingle sets have about ``similarity``, at least; and the similarity."""
    one = [f"{name}x{rng.randrange(10**6)}" for _ in range(length)]
    two, best = list(one), 1.0
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for at in rng.sample(range(length), length):
        tried = [*two[:at], f"{name}y{at}", *two[at + 1 :]]
        now = len(sets(one) & sets(tried)) / len(sets(one) | sets(tried))
        if now >= similarity:
            two, best = tried, now
        if best < similarity + 0.004:
            break
    return " ".join(one), " ".join(two), best


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
def test_pairs_at_the_similarity_go(spark, rng, crowd):
    pairs = [planted_at(rng, 0.8 + 0.05 * (i % 2), f"p{i}") for i in range(60)]
    assert all(0.8 <= j < 0.87 for _, _, j in pairs)
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()
    assert sorted(r.doc_id for r in kept) == [2 * i for i in range(60)]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_a_family_around_the_similarity_against_brute_force(spark, rng, crowd):
    base = [f"t{i}" for i in range(150)]
    texts = [" ".join(f"d{d}w{i}" if rng.random() < share else w for i, w in enumerate(base)) for d, share in enumerate(0.12 * rng.random() for _ in range(160))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    part = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if part[a] != part[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    assert 20 < len(set(part)) < 140
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crowd=crowd).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(part))


def test_near_copies_leave_no_tables_behind(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    texts = [" ".join(f"t{t // 2}w{i}" if i != 50 or t % 2 else "other" for i in range(100)) for t in range(20)]
    before = set(folder.iterdir())
    out = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 20, 2))
    # but for the one that the result is read from
    assert [p.name.partition("-")[0] for p in set(folder.iterdir()) - before] == ["near"]


def test_fingerprints_find_what_minima_do_not(spark):
    # one of each band's minima differs, so that no list of minima holds both
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:199], "other"]), " ".join(f"v{i}" for i in range(200))]
    rows = []
    for i, t in enumerate(texts):
        found = simhash.shingle_set(t.encode(), 5)
        least = bytearray(simhash.minima(found))
        for band in range(simhash.BANDS):
            least[2 * simhash.ROWS * band : 2 * simhash.ROWS * band + 2] = bytes([i, band])
        rows.append((i, len(found), bytearray(simhash.fingerprint_of(t.encode(), simhash.NEAR)), least, i))
    classes = spark.createDataFrame(rows, "cid long, size long, fp binary, minima binary, row long")
    links = simhash.verified_links(classes, spark.createDataFrame(list(enumerate(texts)), "row long, text string"))
    assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset((0, 1))}


def test_a_family_below_the_similarity_stays(spark, rng):
    # any two share a template of four fifths of their words: similarity 0.65 or so
    template = [f"t{i}" for i in range(400)]
    texts = [" ".join([*template, *(f"d{d}w{i}" for i in range(100))]) for d in range(250)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts[:2])]
    assert 0.6 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.7
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(df).count() == len(texts)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_links_of_crowded_lists_at_many_bits(spark, rng, crowd):
    # one list for all, which share their first byte; pairs near each other only
    centres = [rng.getrandbits(56) for _ in range(30)]
    fps = [c ^ (sum(1 << b for b in rng.sample(range(56), 2)) if k else 0) for c in centres for k in range(2)]
    scheme = simhash.Scheme(3, (42,), ((0,),), 1, 4)
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "fid long, fp binary")
    links = simhash.fingerprint_links(df, scheme, crowd)
    got = {r.node: r.component for r in simhash.connected_components(links).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_simhash_at_the_edges(spark, edge, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(with_clashes(edge, "fp", "fid", "fingerprint")).count() == len(EDGE)
    assert simhash.near_duplicates(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first().component_id is None


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return path, Tokenizer.from_file(path)


def test_token_counts_equal_the_library(spark, rng, tokenizer):
    path, lib = tokenizer
    bits = ["a", "the", "'s", "'", "ll", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "中文", "🙂", "<|endoftext|>", "<|", "!", "'ve", "Don't", "\r\n", "́", "١", "_", "\x85", "​", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 60))) for _ in range(600)] + ["word " * 40_000, "z" * 3000, " " * 5000, "", "<|endoftext|>"]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        counter = token_count.TokenCounter.load(f.read())
    assert [counter.count(t) for t in texts] == want
    # chunks of any size compose to the same count
    assert [counter.count(t, chunk=29) for t in texts] == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: (r.tk_n_bytes, r.tk_n_tokens, r.tk_over_limit) for r in token_count.count_tokens(with_clashes(df, "tk_n_bytes", "tk"), path).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip([*texts, None], [*want, 0], strict=True))}


# decontamination


def brute_hits(docs, bench, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    grams = {}
    for item, t in bench:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - window + 1)) if w and item is not None else ():
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w = word.findall(low(t))
        hit, items = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    items |= grams[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        out[d] = (len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit))
    return out


def test_added_tokens_of_any_spelling(tokenizer):
    path, _ = tokenizer
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 60_000, "content": "[PAD]"})
    lib = Tokenizer.from_str(json.dumps(spec))
    counter = token_count.TokenCounter(spec)
    for text in ("a [PAD] b", "[PAD][PAD]", "[PA", "x<|endoftext|>[PAD] y", "plain"):
        assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids), text
    spec["added_tokens"][-1]["lstrip"] = True
    with pytest.raises(ValueError):
        token_count.TokenCounter(spec)


@pytest.mark.parametrize("most", [decontam.MOST_WINDOWS, 20])
def test_decontamination_against_brute_force(spark, rng, most):
    say = lambda n: " ".join(rng.choice(["the", "of", "Ça", "x1", "Red", "blue", "été", "7"]) for _ in range(n))
    bench = [(i, say(rng.randint(8, 30))) for i in range(12)] + [(50, "Tiny Item"), (51, "solo"), (52, None), (53, " ,. "), (None, "not an item at all"), (10, say(12))]
    shared = say(25)
    bench += [(100 + i, shared) for i in range(60)]
    docs = [(i, say(rng.randint(0, 40)) + (", " + (rng.choice(bench)[1] or "").upper() if rng.random() < 0.3 else "")) for i in range(80)]
    docs += [(900, None), (901, ""), (902, "a tiny-item here; SOLO"), (903, "tiny items"), (904, "of " * 30_000), (905, shared + " Solo"), (906, shared[:60])]
    docs.append(docs[-2])
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    out = decontam.scan_documents(with_clashes(d, "dc_n_hit", "gram"), b, most_windows=most).collect()
    assert len(out) == len(docs)
    assert {r.doc_id: (r.dc_n_words, r.dc_n_hit, r.dc_n_items, r.dc_items_sha256, r.dc_contaminated) for r in out} == brute_hits(docs, bench)
    kept = {r.doc_id for r in decontam.drop_contaminated(d, b, most_windows=most).collect()}
    assert kept == {i for i, x in brute_hits(docs, bench).items() if not x[4]}


def test_decontamination_of_empty_tables(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan_documents(edge, none).where("dc_contaminated").count() == 0
    assert decontam.scan_documents(empty, none).count() == 0


# licences


def test_license_rules(spark, edge, empty):
    assert all(any(c in s for c in license_scan.CLUES) for s in license_scan.SENTENCES.values())
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    bsd = "\n".join(license_scan.SENTENCES[k] + "." for k in ("BS1", "BS2", "BS3"))
    rows = [(1, "Foo. Licensed under CC BY-NC 4.0.\nAll rights reserved. bar", "CC-BY-NC-4.0,all-rights-reserved"), (2, mit, "MIT"), (3, bsd, "BSD-2-Clause"), (4, bsd + "\n" + license_scan.SENTENCES["BS4"], "BSD-3-Clause"), (5, "licence to kill", ""), (6, None, "")]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.ls_licenses for r in license_scan.scan_licenses(with_clashes(df, "ls_ids", "ls_rest")).collect()} == {r[0]: r[2] for r in rows}
    assert license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(edge).count() == len(EDGE)


LICENCES = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND""",
    "Apache-2.0": """Copyright 2020 Somebody
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-2-Clause,all-rights-reserved": """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "ISC": """Copyright (c) 2020 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def test_licence_files_as_they_are_written(spark):
    bsd2 = LICENCES["BSD-2-Clause,all-rights-reserved"]
    files = {**LICENCES, "BSD-3-Clause,all-rights-reserved": bsd2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""}
    ways = (lambda t: t, lambda t: "".join(f"# {x}\n" for x in t.split("\n")), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\ncode()", lambda t: "Words before.\n\n" + t.replace("\n", "\r\n") + "\nmore words")
    rows = [(10 * i + k, way(t), name) for i, (name, t) in enumerate(files.items()) for k, way in enumerate(ways)]
    rows += [(900, "Released under the" + " *" * 6000 + " MIT License.", "MIT"), (901, "a line\nReleased under the MIT License\nanother", "MIT"), (902, "we aren't licensed under the MIT license terms of old", ""), (903, "Our tool is released under the MIT license!", "MIT")]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.ls_licenses for r in license_scan.scan_licenses(df).collect()}
    assert got == {r[0]: r[2] for r in rows}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: r[3] for r in con.execute(license_scan.oracle_sql()).fetchall()} == got


def test_html_of_open_heads_and_layout_classes():
    article = "<p>" + "A long sentence of the article, with words. " * 8 + "</p>"
    want = " ".join(("A long sentence of the article, with words. " * 8).split())
    for page in (
        f"<html><head><title>T</title><meta charset=utf-8><body>{article}",
        f"<html><head><title>T</title>{article}",
        f"<head><script>x</script></head><body><div class='page has-sidebar no-comments'>{article}</div></body>",
    ):
        assert html_text.main_text(page) == want
    assert html_text.main_text("<head><noscript><p>no</p></noscript><title>T</title></head>") == ""


def test_license_scan_is_native(spark, edge):
    plan = license_scan.scan_licenses(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# mixing


def test_mix_meets_targets(spark, edge, empty):
    assert mixing.mix(empty).count() == 0
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 5}" if i % 7 else None) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOC).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    taken, target, size = {}, {}, {}
    for r in out:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        size[r.source] = size.get(r.source, 0) + r["size"]
        assert 0 <= r.taken <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in taken:
        assert size[s] == next(r.source_size for r in out if r.source == s) and abs(taken[s] - target[s]) < 100
    assert mixing.mix(with_clashes(edge, "place", "taken", "target", "size")).count() == len(EDGE)


def test_small_sources_beside_huge_ones_meet_their_targets(spark):
    rows = [(i, "w " * 40, "big") for i in range(4000)] + [(10_000 + i, "w " * 9, f"s{i // 60:02}") for i in range(60 * 40)]
    # a block of the whole mix would be as long as a small source
    taken, target = {}, {}
    for r in mixing.mix(spark.createDataFrame(rows, DOC), slots=300).collect():
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)


def test_targets_stop_at_three_times_a_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), ("c", 0), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 30.0, "b": 940.0, "c": 60.0, None: 0.0}


# html


def test_html_regions_and_entities(spark):
    page = "<html><body><header><h1>Site</h1></header><nav><a>menu</a></nav><div class='sidebar'><p>side</p></div><article><h1>T&eacute;st</h1><p>A &amp;  b<br>c <b>bold</b> tail<p>short<ul><li>one<li>two</ul><section class='comments'><p>no</p></section></article><aside>x</aside><form><label>q</label></form><script>var a='<p>no</p>'</script><footer>&copy;</footer></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, "just text"), (5, "<p>" * 2000 + "deep"), (6, "<div><p>cut off in the <b")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: (r.ht_text, r.ht_n_chars) for r in html_text.extract_pages(with_clashes(df, "ht_text", "ht")).collect()}
    assert got[1][0] == "Tést\nA & b c bold tail\nshort\none\ntwo" and got[1][1] == len(got[1][0])
    assert got[2] == got[3] == ("", 0) and got[4] == ("just text", 9) and got[5] == ("deep", 4) and got[6][0].startswith("cut off in the")


def test_the_threshold_finds_the_article():
    # nothing but ratios tells the article from link lists
    links = "".join(f"<div><a href=x>Link number {i}</a> <a href=y>more</a> <a href=z>and more of it</a></div>" for i in range(40))
    article = "".join(f"<p>{f'Sentence {i} of the article, which has a good many words. ' * 6}</p>" for i in range(5))
    page = f"<body><div>{links}</div><div>{article}</div><div>{links}</div></body>"
    want = "\n".join((f"Sentence {i} of the article, which has a good many words. " * 6).strip() for i in range(5))
    assert html_text.main_text(page) == want
    assert html_text.main_text(page, by_ratio=False) != want
    # a menu in the article's own element
    assert html_text.main_text(f"<body><div>{links}{article}</div></body>") == want


@pytest.mark.parametrize("name", ["post tag-news", "post type-post category-legal", "entry social-science", "content related", "search-results article-body", "story side-by-side"])
def test_names_alone_set_nothing_aside(name):
    body = "".join(f"<p>{f'Sentence {i} of the article, which has a good many words. ' * 6}</p>" for i in range(3))
    page = f"<body><nav><a>menu</a></nav><div class='{name}'>{body}<div class='comments'><p>short comment</p></div></div><footer>foot</footer></body>"
    text = html_text.main_text(page)
    assert text.count("Sentence") == 18 and "comment" not in text and "menu" not in text and "foot" not in text
    assert html_text.main_text(f"<body><form>{body}</form></body>").count("Sentence") == 18
    assert html_text.main_text(f"<body><div><noscript><p>no<svg></div>{body}</body>").count("Sentence") == 18
    sections = f"<article><section>{body * 2}</section><section>{body}</section></article>"
    assert html_text.main_text(f"<main>{sections}</main>").count("Sentence") == 54


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    began = time.time()
    for page in ("<div>" * 100_000 + "deep", "<b>" * 50_000 + "bold" + "</i>" * 50_000, "<div class=ad>" * 50_000 + "word " * 50, "<p>line<ul><li>x" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000 + "x"):
        assert html_text.main_text(page)
    assert time.time() - began < 20


def test_smoothing_and_threshold():
    flat = html_text.smoothed(np.full(9, 4.0))
    assert np.allclose(flat, 4) and html_text.threshold(np.array([1.0, 1, 9, 9])) == 5


# toxicity


def test_chain_finds_held_out_toxic_texts(spark, rng):
    say = lambda bad: " ".join([rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(60)] + ([rng.choice(["idiot", "moron", "stupid", "trash", "grolk%d" % rng.randint(0, 9)]) for _ in range(2)] if bad else []))
    docs = [(i, say(i % 5 == 0)) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "idiot " * 50_000)]
    labels = [(i, int(i % 5 == 0)) for i in range(1000)] + [(None, 1), (3, None), (1, 0), (9999, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = toxicity.fit(d, lab)
    assert [link.name for link in chain.links] == ["mode1", "mode2", "toxic"] and [len(link.earlier) for link in chain.links] == [0, 1, 2]
    out = {r.doc_id: r for r in toxicity.score(with_clashes(d, "tx_toxic", "tx"), chain).collect()}
    wrong = [i for i in range(1000, 1500) if out[i].tx_is_toxic != (i % 5 == 0)]
    assert len(wrong) <= 5 and out[5002].tx_is_toxic and not out[5000].tx_is_toxic
    assert out[5000].tx_toxic == out[5001].tx_toxic
    kept = {r.doc_id for r in toxicity.drop_toxic(d, lab).collect()}
    assert kept == {i for i, r in out.items() if not r.tx_is_toxic}


def plain_logistic(x, y, weight, penalty=1e-4):
    """Newton steps on the dense problem, over columns of equal mean square."""
    if y.min() == y.max():
        share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        return np.zeros(x.shape[1]), np.log(share / (1 - share))
    weight = weight / weight.sum()
    scale = 1 / np.sqrt(weight @ x**2 + 1e-4)
    z, w = np.column_stack([x * scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([penalty] * x.shape[1] + [0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), z.T @ (weight * (p - y)) + ridge @ w)
    return w[:-1] * scale, w[-1]


def test_chain_against_a_plain_one(rng):
    n, k = 240, 8
    held = np.array([[rng.random() < 0.3 for _ in range(k)] for _ in range(n)], float)
    noise = np.array([rng.random() for _ in range(n)])
    labels = {"one": (held[:, 0] + noise > 1.1).astype(float), "two": (held[:, 1] * held[:, 2] + 0.6 * noise > 0.9).astype(float)}
    labels["toxic"] = ((labels["one"] + labels["two"] + 0.3 * noise) > 0.8).astype(float)
    weight, folds = np.array([1.0 + (i % 3) for i in range(n)]), np.arange(n) % 3
    row, column = np.nonzero(held)
    x = toxicity.Presence(row, column, n, k, np.zeros((n, 0)))
    exact, usual = (toxicity.ToxicityChain({i: i for i in range(k)}, toxicity.fit_chain(x, labels, weight, folds, **steps)).probabilities(held) for steps in ({"rounds": 20_000, "settled": 1e-9}, {}))
    # the same by dense models: out-of-fold logits in training, the links' own in scoring
    train, at = held, held
    for name, y in labels.items():
        w, b = plain_logistic(train, y, weight)
        logit = np.clip(at @ w + b, -9, 9)
        link = list(labels).index(name)
        assert np.abs(1 / (1 + np.exp(-logit)) - exact[:, link]).max() < 0.01
        # as many steps as in use decide alike
        assert ((logit >= 0) == (usual[:, link] >= 0.5)).mean() > 0.97
        out = np.zeros(n)
        for f in range(3):
            fw, fb = plain_logistic(train[folds != f], y[folds != f], weight[folds != f])
            out[folds == f] = train[folds == f] @ fw + fb
        train, at = np.column_stack([train, np.clip(out, -9, 9)]), np.column_stack([at, logit])


def test_modes_are_clusters_of_toxic_texts(spark, rng):
    groups = np.repeat([0, 1, 1], 20)
    rows = np.array([[float(c // 5 == g and rng.random() < 0.7) for c in range(10)] for g in groups])
    rows[:, 0] += groups == 0
    rows[:, 9] += groups == 1
    assert toxicity.modes_of(rows, 2).tolist() == (1 - groups).tolist()
    docs = spark.createDataFrame([(1, "good day"), (1, "bad idiot"), (2, "bad moron"), (3, "fine")] * 2, "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, lab, categories={"insult": ("idiot", "moron")})
    assert [link.name for link in chain.links] == ["insult", "toxic"]


def test_chain_without_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(edge, none).count() == len(EDGE)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


# queries with SQL


def test_sql_of_the_queries(spark):
    from loamcube.llm.queries import ORACLE, QUERIES
    from tests.test_queries import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        assert compare(spark, con, QUERIES[name], sql) == 200


def test_every_query_covers_its_table(spark):
    from loamcube.llm.queries import QUERIES

    n = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    docs = n("documents")
    for name, fn in QUERIES.items():
        rows = fn(spark, SF)
        if name.startswith("op3"):
            assert rows.count() == n("pages")
        elif name.startswith("op2"):
            assert rows.select("query_id").distinct().count() == spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id") % 50 == 0).count()
        else:
            assert rows.count() == docs, name


# pages and texts that once ended a job


def test_broken_declarations_and_references_are_read_as_far_as_they_go():
    article = "<article><p>" + "Words of the article stand here. " * 5 + "</p></article>"
    for odd in ("<![foo[ x ]]>", "<![ x", "<![1[", "<![%foo;[", "<![CDATA[ a > b ]]>", "<!", "<!-", "<?", "<!DOCTYPE [", "&#" + "9" * 5000 + ";", "<a href='&#" + "1" * 5000 + "'>", "&#" + "0" * 5000 + "65;"):
        for page in (odd + article, article + odd, f"<p>{odd}</p>{article}"):
            html_text.main_text(page)
        assert "Words of the article" in html_text.main_text(article + odd)
    assert html_text.main_text("<p>" + "&#" + "0" * 5000 + "65; b" + "</p>") == "A b"
    assert html_text.main_text("<p>a &#" + "9" * 5000 + "; b</p>") == "a � b"


def test_mutated_pages_never_raise(rng):
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' LIMIT 40").fetchall()]
    parts = ["<![", "]]>", "<!", "<!--", "-->", "&#", "&#x", "<", ">", "</", "<a ", "'", '"', "<svg>", "<p", "\x00", "&#99999999999", "<table><tr>", "<?php", "=", "<script>", "</body>"]
    for n in range(10_000):
        page = rng.choice(pages)
        at = rng.randrange(len(page))
        page = page[max(at - 300, 0) : at + 300]
        for _ in range(rng.randint(1, 6)):
            i = rng.randrange(len(page) + 1)
            page = page[:i] + rng.choice(parts) + page[i + rng.choice([0, 0, 1, 9]) :]
        html_text.main_text(page)


def test_article_of_sibling_sections_is_whole():
    para = lambda n, k: "".join(f"<p>{c * 3} " + "some words of a paragraph " * n + "end.</p>" for c in "abcdefg"[:k])
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul>"
    for first, second in (((6, 1), (6, 1)), ((12, 3), (4, 3)), ((4, 3), (12, 3))):
        text = html_text.main_text(f"<body>{menu}<div><h2>One</h2>{para(*first)}</div><div><h2>Two</h2>{para(*second)}</div><div>(c) Us</div></body>")
        assert text.count("end.") == first[1] + second[1] and "Item" not in text and "Two" in text


def test_lines_without_words_take_no_stack(spark):
    gutters = [" *", "#", "//", "кириллица", ""]
    docs = [(i, "Released under the MIT License.\n" + (g + "\n") * 100_000 + "Licensed under the MIT License.", None) for i, g in enumerate(gutters)]
    out = license_scan.scan_licenses(spark.createDataFrame(docs, DOC)).collect()
    assert [r["ls_ids"] for r in out] == ["|MI1||MI2|"] * len(gutters)


def test_notices_of_the_gnu_family_and_machine_readable_lines(spark):
    gnu = "This {0} is free software{1} you can redistribute it and/or modify\nit under the terms of the GNU {2} as published by\nthe Free Software Foundation{3} either version {4} of the License, or\n(at your option) any later version.\n\nThis {0} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {2} for more details.\n"
    cases = {
        gnu.format("program", ";", "General Public License", ";", "2"): "GPL-2.0-or-later",
        gnu.format("program", ":", "General Public License", ",", "3"): "GPL-3.0-or-later",
        gnu.format("library", ";", "Lesser General Public License", ";", "2.1"): "LGPL-2.1-or-later",
        gnu.format("program", ":", "Lesser General Public License", ",", "3"): "LGPL-3.0-or-later",
        gnu.format("program", ":", "Affero General Public License", ",", "3"): "AGPL-3.0-or-later",
        "// SPDX-License-Identifier: MIT\nint x;": "MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later\n": "GPL-2.0-or-later",
        "/* SPDX-License-Identifier: Apache-2.0 */": "Apache-2.0",
        "Licensed under CC0 1.0.": "CC0-1.0",
        "The spdx line is MIT\n": "",
    }
    rows = list(cases)
    out = license_scan.scan_licenses(spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], DOC))
    assert {rows[r["doc_id"]]: r["ls_licenses"] for r in out.collect()} == cases
