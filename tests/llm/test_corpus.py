"""The corpus operators against brute force, round trips and edge cases."""

import base64
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestream.llm import (bottomk, bpe_codec, bwt_dedup, components, exact_dedup, hilbert_packing, language_id, minhash_forest,
                            pii_bootstrap, queries, shingles, simple8b, token_files, tokens, url_trust)

DIR = "/root/testdata/sf0.001"
#: Extra columns, one of them named as an operator's own; null id and text, an empty text, a repeated row, a long one.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [
    (3, None, "en", "s", None, "k"), (1, "", None, None, 0, None), (2, "Alpha beta gamma delta epsilon zeta", "en", "s", 35, "k"),
    (2, "Alpha beta gamma delta epsilon zeta", "en", "s", 35, "k"), (None, "no id here at all today", "en", "s", 23, "k"),
    (7, "ALPHA beta gamma delta epsilon zeta", "en", "s", 35, "k"), (9, LONG, "en", "s", len(LONG), "k"), (8, " \n\t ", "en", "s", 4, "k"),
    (11, "write to x.y@example.org or +1 (555) 010-9999; 4111 1111 1111 1111 at 10.0.0.255", "en", "s", 80, "k"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(sets):
    """Least reachable id of each id, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check_forest(spark, df):
    sets = {i: shingle_set(t) for i, t in texts(df).items()}
    want = linked(sets)
    for r in minhash_forest.near_duplicates(spark, df).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_forest_matches_all_pairs(spark, docs):
    check_forest(spark, docs)


def test_forest_in_a_crowd_of_near_copies(spark, monkeypatch):
    """A region over the limit goes deeper and is then dealt out; its links stay whole."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for at in rng.integers(0, 120, d % 3):
            w[at] = f"x{d}_{at}"
        rows.append((d, " ".join(w)))
    monkeypatch.setattr(minhash_forest.candidates, "__defaults__", (16, 4, 2, 20))
    check_forest(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_forest_in_a_crowd_below_the_threshold(spark):
    """All of a templated crowd are alike at 0.70, planted pairs at 0.76 or so; no two neighbours need be a pair."""
    rows, pairs = [], {}
    for d in range(400):
        own = [f"o{d}_{i}" for i in range(42)]
        if d % 10 == 1:
            own = [f"o{d - 1}_{i}" for i in range(10)] + own[10:]
            pairs[d] = d - 1
        rows.append((d * 7919 % 10_007, " ".join([*(f"w{i}" for i in range(200)), *own])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(spark, df).collect()}
    sets = {i: shingle_set(t) for i, t in texts(df).items()}
    assert at == linked(sets) and len(set(at.values())) == 400 - len(pairs)


def test_forest_of_pairs_and_a_group_in_boilerplate(spark):
    """2,000 pairs and a group of 150, all with one boilerplate: alike at 0.73 across, at 0.81 within."""
    rows = []
    boilerplate = [f"w{i}" for i in range(190)]
    for d in range(2_000):
        own = [f"p{d}_{i}" for i in range(36)]
        for twin in range(2):
            rows.append((2 * d + twin, " ".join([*boilerplate, *own[:20 - 8 * twin], *(f"q{d}_{twin}_{i}" for i in range(8 * twin)), *own[20:]])))
    for d in range(150):
        rows.append((10_000 + d, " ".join([*boilerplate, *(f"g{i}" for i in range(24)), *(f"h{d}_{i}" for i in range(11))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    at = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(spark, df).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert alike(0, 1) and not alike(0, 2) and alike(10_000, 10_001) and not alike(0, 10_000)
    assert all(at[i] == i - i % 2 for i in range(4_000)) and all(at[i] == 10_000 for i in range(10_000, 10_150))


def test_forest_odd_rows(spark, odd, empty):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash_forest.near_duplicates(spark, odd).collect()}
    assert got[(7, 2)] == (2, False) and got[(2, 2)] == (2, True)
    assert got[(3, 0)] == (3, True) and got[(1, 0)] == (1, True) and got[(8, 0)] == (8, True)
    assert got[(None, 2)] == (None, True)
    assert minhash_forest.near_duplicates(spark, empty).count() == 0


def test_forest_where_texts_share_an_id(spark):
    """Rows of one doc_id are one document with the links of each."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "some thing else altogether here now"), (5, b + " z"), (5, b + " z"), (None, a)]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash_forest.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (5, 1, False)]


@pytest.mark.parametrize("few", [250_000, 0])
def test_components_of_a_hub_and_a_long_path(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    edges = [(7, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 7 for i in range(1000, 1400)} | {7: 7} | {i: 2000 for i in range(2000, 2301)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_shingles_match_plain_sets():
    sample = ["", "one two", "a b c d e", "A B C D E f", " x\ty\nz  w v u t ", LONG[:500], "é à ö ü ß"]
    assert [len(s) for s in shingles.shingle_sets(sample)] == [len(shingle_set(t)) for t in sample]


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}


def test_bpe_matches_the_library(spark, docs, odd, empty):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for df in (docs, odd.where("doc_id is not null")):
        want = texts(df)
        for r in bpe_codec.encode_and_decode(spark, df, path, P.PATTERN).collect():
            ids = own.encode_ordinary(want[r["doc_id"]])
            assert (r["n_tokens"], r["ids"], bytes(r["decoded"]).decode()) == (len(ids), ",".join(map(str, ids)), want[r["doc_id"]])
    assert bpe_codec.encode_and_decode(spark, empty, path, P.PATTERN).count() == 0


def test_bpe_on_spaces_and_scripts():
    codec = bpe_codec.Codec(ranks(), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    sample = ["a  b", "a   b", " a", "  a ", "a \n b", "a \n\n  b\t c", "x\n \ny", "end  ", "it's I'll", "日本語 текст 12345 ½", " a   b", "🙂🙂 é"]
    assert codec.encode(sample) == [",".join(map(str, own.encode_ordinary(s))) for s in sample]
    assert all(codec.lookup(t) == i for t, i in list(codec.ranks.items())[::50])
    assert codec.lookup(b"certainly-not-a-token") == -1


def test_language_on_held_out_rows(spark, odd, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(spark, df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in language_id.identify(spark, odd).collect()}
    assert by[3]["lang_pred"] == by[1]["lang_pred"] == by[8]["lang_pred"] == "und" and by[2]["lang_pred"] == "en"
    assert language_id.identify(spark, empty).count() == 0


def test_language_spans_of_mixed_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(spark, df)
    some = {r["lang"]: r["text"] for r in df.where("n_chars > 2000").collect()}
    mixed = some["en"][:1500] + "\n" + some["de"][:1500]
    (_, _, spans), = model.label([mixed], True)
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[1][0] - 1500) < 120


def test_language_of_few_texts_copied_often(spark):
    """Copies change nothing: the model is that of the distinct texts, and no language goes without."""
    rng = np.random.default_rng(2)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    once = [(lang, " ".join(word(letters) for _ in range(12))) for lang, letters in (("aa", "abcdef"), ("bb", "uvwxyz")) for _ in range(5)]
    rows = [(4 * i, text, lang) for i, (lang, text) in enumerate(once * 4_000)]
    models = [language_id.fit(spark, spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, rows[:400])]
    assert (models[0].weights == models[1].weights).all() and len(np.unique(models[0].weights[:, 0])) > 1 < len(np.unique(models[0].weights[:, 1]))


def slow_path(scores):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        move = best[:, None] - language_id.SWITCH * (1 - np.eye(len(s)))
        back.append(move.argmax(0))
        best = move.max(0) + s
    return best.max()


def test_viterbi_value():
    rng = np.random.default_rng(5)
    model = language_id.Model(["a", "b", "c"], np.zeros((language_id.SLOTS, 3), np.float32), {})
    model.scores = rng.uniform(-6, 0, (60, 3)).astype(np.float32)
    model.known = {f"w{i}": i for i in range(60)}
    for _ in range(20):
        words = [f"w{i}" for i in np.repeat(rng.integers(0, 60, 12), 6)]
        path = model.path(words)
        s = model.scores[[model.known[w] for w in words]].astype(float)
        value = s[np.arange(len(words)), path].sum() - language_id.SWITCH * (np.diff(path) != 0).sum()
        assert abs(value - slow_path(s)) < 1e-6


def test_url_rules_and_ranks(spark, empty):
    pages = spark.createDataFrame([
        (1, "https://a.good.org/x?q", '<a href="http://Mid.net/1">m</a>', 0), (2, "http://mid.net/p#f", '<a href="http://leaf.net/z">z</a>', 0),
        (3, "http://leaf.net", None, 0), (4, "http://spam.com/de/1", None, 0), (5, "http://farm.net/", '<a href=http://spam.com/de/1>s</a>', 0),
        (6, None, None, 0), (7, "no-scheme", "x", 0), (8, "http://b.example.org/en/17", "", 0), (9, "http://EXAMPLE.org/en/2", "", 0), (9, "http://EXAMPLE.org/en/2", "", 0)],
        "page_id long, url string, html string, host long")
    rows = url_trust.judge(spark, pages).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 10
    assert got[1] == ("a.good.org", "/x", "org/", "allow") and got[3] == ("leaf.net", "", None, "allow")
    assert got[4] == ("spam.com", "/de/1", "com/de/", "block") and got[5][3] == "block"
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == ("org/", "allow")
    # The same ranks by a dense power iteration.
    edges = {("a.good.org", "mid.net"): 1.0, ("mid.net", "leaf.net"): 1.0}
    seeds = {"a.good.org": 1 / 3, "example.org": 2 / 3}
    rank = dict(seeds)
    for _ in range(url_trust.ROUNDS):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0) + 0.85 * w * rank.get(a, 0)
        rank = new
    by_host = {r["host"]: r["trust"] for r in rows}
    assert all(abs(by_host[h] - v) < 1e-9 for h, v in rank.items() if h in by_host)
    assert url_trust.judge(spark, pages.limit(0)).count() == 0


def test_url_links_without_scheme_and_long_chains(spark):
    """Twelve links, each without a scheme, lead to a blocked host; its distrust goes all the way back."""
    pages = [(i, f"http://h{i}.net/", f"<a href='//h{i + 1}.net/x'>n</a>") for i in range(12)] + [(12, "http://h12.net/", '<a href="http://bad.com/de/1">b</a>'), (13, "http://bad.com/de/1", "")]
    rows = {r["page_id"]: r for r in url_trust.judge(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(rows[i]["verdict"] == "block" and abs(rows[i]["distrust"] - 0.15 * 0.85 ** (13 - i)) < 1e-12 for i in range(14))


def test_fingerprints(spark, docs, odd, empty):
    want = sorted(texts(docs).items())
    got = {r["doc_id"]: r for r in bottomk.fingerprints(spark, docs).collect()}
    errors = []
    for i, (doc, text) in enumerate(want):
        after = want[(i + 1) % len(want)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        a, b = shingle_set(text), shingle_set(edited)
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.25
    odd_rows = bottomk.fingerprints(spark, odd).collect()
    assert len(odd_rows) == len(ODD) and bottomk.fingerprints(spark, empty).count() == 0
    assert {r["n_chars"] for r in odd_rows if r["doc_id"] in (1, 3)} == {0}


def test_registered_fingerprints_are_strings_and_follow_texts(spark, docs):
    """Equal texts, equal fingerprints; near_next is the share of the next document's."""
    known = sorted(texts(docs).items())
    got = {r["doc_id"]: r for r in queries.op5_bottomk(spark, DIR).collect()}
    by_text: dict[str, set] = {}
    for i, (doc, text) in enumerate(known):
        by_text.setdefault(text, set()).add(got[doc]["fingerprint"])
        a, b = got[doc]["fingerprint"], got[known[(i + 1) % len(known)][0]]["fingerprint"]
        ha, hb = ({h[j:j + 16] for j in range(0, len(h), 16)} for h in (a, b))
        signed = lambda h: int(h, 16) - (1 << 64) * (int(h, 16) >> 63)
        least = set(sorted(ha | hb, key=signed)[:bottomk.SIZE])
        assert got[doc]["near_next"] == pytest.approx(len(least & ha & hb) / len(least) if least else 1.0)
    assert all(len(prints) == 1 for prints in by_text.values())


def test_next_row_across_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101, f"t{i * 7 % 101}") for i in range(101)], "k long, v string")
    got = {r["k"]: r["next_v"] for r in bottomk.with_next(rows, "k", ["v"], rows_each=10).collect()}
    assert got == {k: f"t{(k + 1) % 101}" for k in range(101)}


def test_next_row_across_many_ranges_is_a_small_plan(spark):
    keys = [None, *range(-(2**40), 2**40, 2**33)]
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, v string")
    found = bottomk.with_next(rows, "k", ["v"], rows_each=1)
    nodes = found._jdf.queryExecution().analyzed().toJSON().count('"class"')
    assert {r["k"]: r["next_v"] for r in found.collect()} == {k: f"t{n}" for k, n in zip(keys, [*keys[1:], keys[0]])}
    assert nodes < 2_000


def test_place_among_cuts(spark):
    for cuts in ([5], [-7, 0, 2**40], list(range(0, 62, 2))):
        at = bottomk._place(F.lit(np.array(cuts)), F.col("v"), len(cuts))
        values = [-(2**50), 2**50, *cuts, *[c - 1 for c in cuts], *[c + 1 for c in cuts]]
        got = spark.createDataFrame([(v,) for v in values], "v long").select("v", at.alias("at")).collect()
        assert [r["at"] for r in got] == [sum(c <= r["v"] for c in cuts) for r in got]


def test_sketches_merge(spark):
    a, b = "a b c d e f g h i j k l", "e f g h i j k l m n o p q"
    row = spark.range(1).select(
        bottomk.sketch(F.lit(a), 4).alias("a"), bottomk.sketch(F.lit(b), 4).alias("b")).select("*", bottomk.merge(F.col("a"), F.col("b"), 4).alias("m")).first()
    assert row["m"] == sorted(set(row["a"]) | set(row["b"]))[:4]
    parts = spark.createDataFrame([("x", row["a"]), ("x", row["b"])], "g string, fingerprint array<long>")
    assert bottomk.merge_groups(parts, ["g"], k=4).first()["fingerprint"] == row["m"]


def test_directory_doubles_until_no_bucket_is_too_full(spark):
    """Buckets are ranges of keys, hold few keys each, and only full ones split."""
    keys = [(i << 50,) for i in range(900)] + [(-(i << 40),) for i in range(1, 30)]
    df = spark.createDataFrame(keys, "key long")
    slots, bits = exact_dedup.directory(df, 64)
    of = {r["slot"]: (r["bucket"], r["depth"]) for r in slots.collect()}
    held: dict[tuple, int] = {}
    for (k,) in keys:
        slot = (k % (1 << 64)) >> (64 - bits)
        bucket, depth = of[slot]
        assert bucket == slot >> (bits - depth) << (bits - depth)
        held[(bucket, depth)] = held.get((bucket, depth), 0) + 1
    assert max(held.values()) <= 64 and min(d for _, d in held) < max(d for _, d in held)


@pytest.mark.parametrize("hot_share", [1_000, 1])
def test_exact_dedup_of_a_hot_group(spark, monkeypatch, hot_share):
    rows = [(i, "The Same" if i % 3 == 0 else f"text {i // 2}") for i in range(600)] + [(None, "the same"), (599, "text 299"), (599, "text 299")]
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", hot_share)
    got = exact_dedup.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bucket_keys=16).collect()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.lower().encode()).hexdigest(), []).append(-1 if i is None else i)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == (max(groups[r["text_sha256"]]), len(groups[r["text_sha256"]]))
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_exact_dedup(spark, docs, odd, empty):
    for df in (docs, docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.upper("text")))):
        rows = df.collect()
        groups: dict[str, list[int]] = {}
        lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
        for r in rows:
            groups.setdefault(lower(r["text"]), []).append(r["doc_id"])
        want = {r["doc_id"]: (max(g := groups[lower(r["text"])]), len(g), max(g) == r["doc_id"], hashlib.sha256(lower(r["text"]).encode()).hexdigest()) for r in rows}
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(spark, df, bucket_keys=16).collect()}
        assert got == want
    rows = exact_dedup.exact_dedup(spark, odd).collect()
    assert sum(r["kept"] for r in rows if r["doc_id"] in (2, 7)) == 1 and len(rows) == len(ODD)
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 3)} == {3}
    assert exact_dedup.exact_dedup(spark, empty).count() == 0
    assert exact_dedup.keep_one(spark, spark.createDataFrame(ODD * 2, SCHEMA)).count() == exact_dedup.keep_one(spark, odd).count() == 6


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5_000).select(F.xxhash64("id").alias("key"))
    slots, top = exact_dedup.directory(keys, 100)
    held = keys.withColumn("slot", F.shiftrightunsigned("key", 64 - top)).join(slots, "slot").groupBy("bucket", "depth").count()
    assert held.agg(F.max("count")).first()[0] <= 100 and held.agg(F.sum("count")).first()[0] == 5_000


def test_pii_base(spark, docs, odd, empty):
    def plain(x):
        out = [("email", *m.span()) for m in pii_bootstrap.EMAIL.finditer(x)]
        out += [("ip", *m.span()) for m in pii_bootstrap.IP.finditer(x) if all(int(q) <= 255 for q in m[0].split("."))]
        for m in pii_bootstrap.CARD.finditer(x):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in pii_bootstrap.PHONE.finditer(x) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out, key=lambda s: (s[1], pii_bootstrap.KINDS.index(s[0])))

    assert all(pii_bootstrap.base_spans(t) == plain(t) for t in texts(docs).values())
    hard = ["a@b@c.de f.g@h.i.j", "@x.y", "a@@b.c", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "+1+23456789012", "%%%@a-b.c.d-", "a@b. c@d.e" * 3, "q" * 500 + "@r.s"]
    assert [pii_bootstrap.base_spans(t) for t in hard] == [plain(t) for t in hard]
    by = {r["doc_id"]: r for r in pii_bootstrap.digests(pii_bootstrap.extract(spark, odd)).collect()}
    assert [by[11][f"n_{k}"] for k in pii_bootstrap.KINDS] == [1, 1, 1, 1] and by[3]["spans"] == ""
    assert by[11]["base_sha256"] == hashlib.sha256(by[11]["spans"].encode()).hexdigest()
    assert pii_bootstrap.extract(spark, empty).count() == 0


def test_language_of_numerals_and_scripts(spark):
    """Numerals are no letters; a script that only some languages write narrows a word to those."""
    rows = [(4 * i + j, t, lang) for i in range(60) for j, (lang, t) in enumerate([("en", "the house and the river of stones"), ("ru", "дом и река из камня"), ("el", "το σπίτι και το ποτάμι"), ("bg", "къща и река от камък")])]
    rows += [(1_000, "½ ²", None), (1_001, "12 + 30", None), (1_002, "ποτάμι", None), (1_003, "река из дом", None), (1_004, "stones river house", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(spark, df).collect()}
    assert [got[i]["lang_pred"] for i in range(1_000, 1_005)] == ["und", "und", "el", "ru", "en"] and got[1_000]["score"] == 0
    model = language_id.fit(spark, df)
    assert model.scripts["cyrillic"].sum() == 2 and model.scripts["greek"].sum() == 1 and model.scripts["latin"].sum() == 1


def test_pii_candidates_span_words_and_handles(spark):
    found = lambda t: [t[a:b] for k, a, b in pii_bootstrap.occurrences(t, pii_bootstrap.base_spans(t)) if k is None]
    assert found("hotline 555 010 9999 now") == ["555 010 9999"] and found("ask bob@localhost, or @handle7.") == ["bob@localhost", "@handle7"]
    assert found("(743) 555-3824 a ### 12 b") == ["(743) 555-3824"] and found("a b c###") == []
    long = "x" * 5_000
    assert pii_bootstrap.contexts(f"{long} call 12345 end", 5_006, 5_011) == ["call _", f"{long} call _", "call _ end"]


def test_pii_confidence_matches_a_plain_scorer(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{rng.integers(0, 12)}", int(rng.integers(0, 90))) for _ in range(500)]
    kind = {i: ["email", "phone", None, None][i % 4] for i in range(90)}
    rows = sorted(set(rows))
    pats: dict[str, list] = {}
    for p, i in rows:
        pats.setdefault(p, []).append(i)
    conf = {p: sum(kind[i] is not None for i in v) / (len(v) + 1) for p, v in pats.items()}
    for _ in range(60):
        trust = {i: 1.0 if kind[i] else np.mean([conf[p] for p, j in rows if j == i]) for _, i in rows}
        conf = {p: sum(trust[i] for i in v) / (len(v) + 1) for p, v in pats.items()}
    count = lambda p, k: sum(kind[i] == k for i in pats[p])
    cut = float(np.median(list(conf.values())))
    want = {p: "email" if count(p, "email") >= count(p, "phone") else "phone" for p in pats if conf[p] > cut + 0.01}
    got = pii_bootstrap.learn(spark.createDataFrame([(p, i, kind[i]) for p, i in rows], "pattern string, instance long, kind string"), support=1, confident=cut + 0.01)
    assert {r["pattern"]: r["kind"] for r in got.collect()} == want


def test_pii_patterns_find_unseen(spark):
    rows = [(i, f"Please dial hotline +1 555 010 {1000 + i} today") for i in range(20)] + [(99, "Please dial hotline 5550109777x today"), (100, "The year 199912 was fine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_bootstrap.extract(spark, df).collect()}
    assert [s["kind"] for s in got[99]["added"]] == ["phone"] and not got[100]["added"]
    red = texts(pii_bootstrap.redacted(spark, df))
    assert red[99] == "Please dial hotline [PHONE] today" and red[0] == "Please dial hotline [PHONE] today" and red[100] == rows[-1][1]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(200):
        v = rng.integers(0, 1 << int(rng.integers(1, 40)), int(rng.integers(0, 900))).astype(np.uint64)
        if rng.random() < 0.3:
            v[rng.random(len(v)) < 0.95] = 0
        words, offsets, escapes = simple8b.encode(v)
        assert (simple8b.decode(words, escapes, len(v)) == v).all()
        at = np.frombuffer(offsets, "<u4")
        if len(at) > 1:
            assert (simple8b.decode(words, escapes, len(v) - int(at[1]), simple8b.STRIDE, int(at[1])) == v[at[1]:]).all()


def test_simple8b_offsets_reach_any_range():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 17, 40_000).astype(np.uint64)
    v[rng.integers(0, len(v), 50)] = 1 << 30
    words, offsets, escapes = simple8b.encode(v)
    assert (simple8b.decode_by_offsets(words, offsets, escapes, len(v), 3) == v).all()
    for a, b in [(0, 1), (39_999, 40_000), (0, 40_000), (7, 7), *np.sort(rng.integers(0, 40_000, (60, 2)), 1).tolist()]:
        assert (simple8b.decode_range(words, offsets, escapes, len(v), a, b) == v[a:b]).all()
    assert len(simple8b.decode_by_offsets(b"", b"", b"", 0)) == 0


def test_registered_queries_of_tokens_match_the_libraries(spark, docs):
    """The digests that op2 and op10 return."""
    known = texts(docs)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    for r in queries.op2_bpe_codec(spark, DIR).collect():
        ids = own.encode_ordinary(known[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(known[r["doc_id"]].encode()).hexdigest())
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in queries.op10_hilbert_packing(spark, DIR).collect():
        ids = np.array(tokenizer.encode(known[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


def test_token_files(spark, docs, odd, empty):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    start = 0
    got = {r["doc_id"]: r for r in token_files.digests(token_files.token_files(spark, docs, path)).collect()}
    for doc, text in sorted(texts(docs).items()):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = token_files.token_files(spark, odd, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 7, 8, 9, 11] and rows[1]["n_tokens"] == rows[4]["n_tokens"] == 1
    assert token_files.token_files(spark, empty, path).count() == 0


def test_chunks_encode_as_texts_do():
    from lodestream.llm.tokens import ChunkEncoder

    sample = ["a  b", "a   b", " a", "  a ", "a \n b", "a \n\n  b\t c", "x<|endoftext|>y z", "end  ", "", "it's I'll don't", "日本   x", "a\x1cb c", "Été ΣΑΣ", "<|startoftext|> q",
              "\n \n", "x\n y", "x \ny", "İstanbul ſ ǅ ª º", "one, two; 5.5 x@y.z a~b ~ ~~", "　x　 y", "cafe\u0301 \u0301 x", "𝐀𝐁 𝟘.", ". , ;", None]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = ChunkEncoder(P.path(name))
        for _ in range(2):  # the second time from the table
            ids, counts = encoder.encode(pa.array(sample, pa.string()))
            got = [one.tolist() for one in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == [encoder.tokenizer.encode(s or "", add_special_tokens=False).ids for s in sample]


def test_hilbert_curve_is_connected():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert_packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    along = cells[np.argsort(key)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def check_packing(spark, df, n_rows):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = hilbert_packing.pack(spark, df, path).collect()
    by_row: dict[int, list] = {}
    for r in rows:
        by_row.setdefault(r["row"], []).append(r)
    assert len(by_row) == n_rows
    total = 0
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]
        total += pieces[0]["doc_tokens"]
    known = texts(df.where("doc_id is not null"))
    for r in rows:
        if r["doc_id"] is not None:
            ids = tokenizer.encode(known[r["doc_id"]], add_special_tokens=False).ids + [1]
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"]:r["start"] + r["length"]]
    at = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in rows)
    assert [a for a, _ in at] == np.cumsum([0, *[n for _, n in at[:-1]]]).tolist() and sum(n for _, n in at) == total


def test_packing(spark, docs, odd, empty):
    check_packing(spark, docs, docs.count())
    check_packing(spark, odd, len(ODD))
    assert hilbert_packing.pack(spark, empty, P.path("word_bpe_49k.json")).count() == 0


def repeats_by_table(rows, length=100):
    """Repeats by a table of all strings."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            s = b[q:q + length]
            if s in seen:
                gone[q:q + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check_repeats(spark, df, **more):
    want = repeats_by_table(list(texts(df).items()), **{k: v for k, v in more.items() if k == "length"})
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bwt_dedup.digests(bwt_dedup.without_repeats(spark, df, **more)).collect()}
    assert got == want


def test_repeats(spark, docs):
    check_repeats(spark, docs)


@pytest.mark.parametrize("sizes", [{}, {"CROWDED": 3}, {"SHARD_BYTES": 300}, {"CROWDED": 3, "HELD": 5, "SHARD_BYTES": 200}, {"HELD": 4, "SHARD_BYTES": 200, "OWNED": 10}])
def test_repeats_that_overlap_and_crowd(spark, monkeypatch, sizes):
    """One shard and many, symbols with many entries dealt out by shards or by owners."""
    for name, value in sizes.items():
        monkeypatch.setattr(bwt_dedup, name, value)
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abé"), n))
    line = word(130)
    rows = [(i, word(int(rng.integers(0, 60))) + line[int(rng.integers(0, 30)):int(rng.integers(90, 131))] + word(40)) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "x" * 99), (102, "x" * 100), (103, "x" * 250), (104, "ab" * 120 + "é"), (105, ""), (106, None)]
    check_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_common_prefixes_in_every_bit():
    """Two words that part in one bit agree in the bytes before it, wherever it is."""
    for bit in range(64):
        for rest in (0, 0x6262626262626262):
            words = np.array([[rest], [rest ^ (1 << bit)]], np.uint64)
            _, common = bwt_dedup.interleave(words, np.arange(2), np.zeros(2, np.int64))
            assert common.tolist() == [0, 7 - bit // 8]


def test_repeats_of_almost_a_string(spark):
    """Letters that differ in their last bit, and passages of 99 and 100 bytes with the same letters behind the one that differs."""
    rng = np.random.default_rng(17)
    word = lambda n: "".join(rng.choice(list("bc"), n))
    rows = []
    for i in range(80):
        passage, size = word(100), 99 + i % 2
        head, end = passage[:size], word(2)
        rows += [(2 * i, word(20) + head + "b" + end), (2 * i + 1, word(30) + head + "c" + end)]
    check_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeats_odd_rows(spark, odd, empty):
    twin = spark.createDataFrame([(5, LONG, "x"), (5, LONG, "x"), (None, LONG[:5000], "x")], "doc_id long, text string, data string")
    got = sorted(((r["doc_id"] or -1), r["n_removed"]) for r in bwt_dedup.without_repeats(spark, twin).collect())
    assert got[0] == (-1, 0) and sorted(n for d, n in got if d == 5) == [5000, len(LONG)]
    assert bwt_dedup.without_repeats(spark, odd).count() == len(ODD) and bwt_dedup.without_repeats(spark, empty).count() == 0


def test_pipeline(spark, docs):
    """The stages against plain rules: equal texts, linked sets, redaction, every token once."""
    now, before = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, DIR).cache()
        if name != "packing":
            assert now.columns == docs.columns
        if name == "language":
            assert texts(now).keys() == {i for i, t in texts(before).items() if language_id.WORD.search(t)}
        if name == "exact":
            groups: dict[str, int] = {}
            for i, t in texts(before).items():
                groups[t.translate({c: c + 32 for c in range(65, 91)})] = max(i, groups.get(t.translate({c: c + 32 for c in range(65, 91)}), -1))
            assert texts(now).keys() == set(groups.values())
        if name == "near":
            assert texts(now).keys() == {i for i, c in linked({i: shingle_set(t) for i, t in texts(before).items()}).items() if i == c}
        if name == "private":
            assert all(not pii_bootstrap.base_spans(t) for t in texts(now).values()) and texts(now).keys() == texts(before).keys()
        if name == "packing":
            assert {r["doc_id"] for r in now.collect()} == texts(before).keys()


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd, empty, stage):
    """Nulls, repeated rows, a very long text, columns named as the stage's own, an empty table: all rows that should stay do."""
    run = dict(corpus_pipeline.STAGES)[stage]
    clash = odd.withColumns({c: F.lit("x") for c in ("_gone", "_gone_digest", "_digest", "_id", "_own", "row", "component_id", "kept")})
    rows = run(spark, clash, DIR).collect()
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
    assert run(spark, empty, DIR).count() == 0
    if stage == "packing":
        assert set(ids) == {-1, 1, 2, 3, 7, 8, 9, 11}
    else:
        assert run(spark, clash, DIR).columns == clash.columns
        want = {"language": [-1, 2, 2, 7, 9, 11], "exact": [-1, 3, 7, 8, 9, 11], "near": [-1, 1, 2, 2, 3, 8, 9, 11], "private": [-1, 1, 2, 2, 3, 7, 8, 9, 11]}
        assert ids == want[stage]


@pytest.mark.parametrize("text, n", [("0" * 5_000 + ".1.1.1", 1), ("7" * 2_000_000, 0), ("w" * 2_000_000 + " 1", 0), ("a" * 1_000_000 + "@" + "b" * 1_000_000, 0), ("x" * 2_000_000 + "@y.z", 1), ("1 " * 1_000_000, 0),
                                     ("a@b.cc," * 30_000, 30_000), ("+1(" + " " * 1_000_000, 0), ("1.1.1." * 300_000, 225_000)])
def test_pii_of_long_lines_in_linear_time(text, n):
    began = time.time()
    assert len(pii_bootstrap.base_spans(text)) == n
    for _, a, b in list(pii_bootstrap.occurrences(text, pii_bootstrap.base_spans(text)))[:2_000]:
        assert all(len(p) <= 3 * pii_bootstrap.REACH for p in pii_bootstrap.contexts(text, a, b))
    assert time.time() - began < 30


def test_pii_candidates_as_one_expression_finds_them():
    """The walk from mark to mark gives what one alternation over the whole text gives."""
    rng = np.random.default_rng(3)
    whole = re.compile(r"\(?[0-9][0-9()-]*(?:[ .][0-9()-]+)+(?![^\s.,;:!?])|[^\s]*[0-9@#][^\s]*")
    for _ in range(4_000):
        t = "".join(rng.choice(list("01(). ,-@#ab\n "), rng.integers(1, 30)))
        got, at = [], 0
        while mark := pii_bootstrap.MARK.search(t, at):
            first = mark.start()
            while first > at and not t[first - 1].isspace():
                first -= 1
            m = pii_bootstrap.GROUPS.match(t, first) or pii_bootstrap.RUN.match(t, first)
            got.append(m.span())
            at = m.end()
        assert got == [m.span() for m in whole.finditer(t)], repr(t)


@pytest.mark.parametrize("text", ["a@b", "1.2.3.4", "x.y@z.w"])
def test_pii_base_on_random_texts(text):
    rng = np.random.default_rng(9)
    for _ in range(3_000):
        t = "".join(rng.choice(list(text + "@.0129+ ()a-"), rng.integers(1, 25)))
        want = [("email", *m.span()) for m in pii_bootstrap.EMAIL.finditer(t)] + [("ip", *m.span()) for m in pii_bootstrap.IP.finditer(t) if all(int(q) <= 255 for q in m[0].split("."))]
        assert [s for s in pii_bootstrap.base_spans(t) if s[0] in ("email", "ip")] == sorted(want, key=lambda s: (s[1], pii_bootstrap.KINDS.index(s[0])))


def test_pii_patterns_joined_or_sent(spark, odd):
    rows = [(i, f"Please dial hotline +1 555 010 {1000 + i} today", None) for i in range(20)] + [(99, "Please dial hotline 5550109777x today and mail me@localhost", "k"), (100, None, "k"), (99, "Please dial hotline 5550109777x today and mail me@localhost", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").unionByName(odd.select("doc_id", "text", F.col("key").alias("_row")))
    for f in (pii_bootstrap.extract, pii_bootstrap.redacted):
        one, other = (sorted(map(str, f(spark, df, sent=n).collect())) for n in (1_000, 0))
        assert one == other and len(one) == df.count()
    assert "[PHONE]" in texts(pii_bootstrap.redacted(spark, df, sent=0))[99]


def test_a_letter_before_a_mark_encodes_as_in_the_text():
    """Every letter before a mark: some normalise to a base and a mark that goes with what follows."""
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(P.path(name))
        enc = tokens.ChunkEncoder(P.path(name))
        for mark in ",!" if name[0] == "w" else ".":
            words = [f"a{x}{mark} b" for x in letters]
            for i in range(0, len(words), 40_000):
                lot = words[i:i + 40_000]
                ids, n = enc.encode(pa.array(lot))
                got = np.split(ids, np.cumsum(n)[:-1])
                want = library.encode_batch_fast(lot, add_special_tokens=False)
                assert [w for w, g, e in zip(lot, got, want) if g.tolist() != e.ids] == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_characters_encode_as_in_the_library(name):
    rng = np.random.default_rng(11)
    pool = [chr(c) for c in (*range(32, 127), 0x130, 0x958, 0x9DC, 0xA33, 0x300, 0x301, 0x93C, 0xAC00, 0x1100, 0x4E00, 0x200D, 0xFE0F, 0x1F600, 0xA0, 0x2028, 9, 10, 0xDF, 0xFB01)] + list(" ,.!?  ")
    lot = ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(4_000)] + ["BELEDİYESİ, ANKARA"]
    enc, library = tokens.ChunkEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
    ids, n = enc.encode(pa.array(lot))
    got = np.split(ids, np.cumsum(n)[:-1])
    assert [t for t, g, e in zip(lot, got, library.encode_batch_fast(lot, add_special_tokens=False)) if g.tolist() != e.ids] == []


def component_table(rows):
    """Least reachable id of each id by products of matrices: as ``linked``, for thousands of texts."""
    sets = {i: shingle_set(t) for i, t in rows}
    column = {}
    for s in sets.values():
        for x in s:
            column.setdefault(x, len(column))
    ids = sorted(sets)
    m = np.zeros((len(ids), len(column)), np.float32)
    for n, i in enumerate(ids):
        m[n, [column[x] for x in sets[i]]] = 1
    size = m.sum(1)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    n_links = 0
    for low in range(0, len(ids), 500):
        both = m[low:low + 500] @ m.T
        near = 100 * both >= 75 * (size[low:low + 500, None] + size[None] - both)
        for a, b in zip(*np.nonzero(near)):
            if low + a < b and both[a, b]:
                n_links += 1
                x, y = find(low + int(a)), find(int(b))
                root[max(x, y)] = min(x, y)
    return {i: ids[find(n)] for n, i in enumerate(ids)}, n_links


def templated(n, slots, variants, passage, fixed, own, twins, change, seed):
    """Documents of fixed passages with slots between, each slot one of some passages; every ``twins``-th copies the one before but for ``change`` slots."""
    rng = np.random.default_rng(seed)
    rows, before = [], None
    for d in range(n):
        pick = rng.integers(0, variants, slots)
        if twins and d % twins == 1:
            other = rng.choice(slots, change, replace=False)
            pick[[i for i in range(slots) if i not in other]] = before[[i for i in range(slots) if i not in other]]
        before = pick
        words = [f"o{d}_{i}" for i in range(own)]
        for s in range(slots):
            words += [f"f{s}_{i}" for i in range(fixed)] + [f"v{s}_{pick[s]}_{i}" for i in range(passage)]
        rows.append((d * 7919 % 100_003, " ".join([*words, *(f"f{slots}_{i}" for i in range(fixed))])))
    return rows


@pytest.mark.parametrize("n, slots, variants, passage, fixed, own, twins, change", [
    (3_000, 10, 50, 8, 48, 0, 4, 6),  # alike at 0.68, pairs at 0.79: links hang on passages of some 60 documents each
    (2_200, 10, 2, 40, 0, 60, 0, 0),  # each passage in 1,100 documents, links where all ten agree
])
def test_forest_finds_all_links_of_templated_crowds(spark, n, slots, variants, passage, fixed, own, twins, change):
    rows = templated(n, slots, variants, passage, fixed, own, twins, change, 1)
    want, n_links = component_table(rows)
    assert n_links > 1_000 and len(set(want.values())) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(spark, df).collect()}
    assert sum(got[i] != want[i] for i in want) == 0


def test_overlaps_equal_plain_intersections():
    rng = np.random.default_rng(4)
    for n, most, split in ((40, 30, 40), (90, 400, 30), (60, 40, 60), (2, 3, 1)):
        sets = [np.unique(rng.integers(0, most, rng.integers(1, 60)).astype(np.int64)) for _ in range(n)]
        got = minhash_forest.overlaps(sets, split)
        for i in range(split):
            for j in range(split if split < n else i + 1, n):
                assert got[i, j - split if split < n else j] == len(set(sets[i]) & set(sets[j]))


def test_blocks_meet_but_for_those_of_one_component(spark):
    """A component of many blocks is compared with the others of its crowd, not within."""
    rows = [(i, 7 if i < 60 else i, 10, [1, 2] if i % 2 else [1]) for i in range(80)]
    docs = spark.createDataFrame(rows, "id long, component long, n long, places array<long>")
    got = minhash_forest.block_pairs(docs, block=100, weight=10).collect()
    met = {}
    for r in got:
        met.setdefault(r["pair"], []).append((r["side"], r["id"], r["component"]))
    pairs = set()
    for group in met.values():
        a, b = ([x for x in group if x[0] == s] for s in (0, 1))
        pairs |= {tuple(sorted((x[1], y[1]))) for x in a for y in (b or a) if x[2] != y[2]}
    assert pairs >= {(i, j) for i in range(80) for j in range(max(i + 1, 60), 80)}
    assert all(len({c for _, _, c in g}) > 1 for g in met.values())


def test_ranks_along_a_cycle_and_from_a_hub(spark, monkeypatch):
    """A cycle that mass goes round many times, and a host with most links, which is broadcast."""
    monkeypatch.setattr(url_trust, "HUB_SHARE", 3)
    links = [("a", "b"), ("b", "c"), ("c", "a"), *[("hub", f"h{i}") for i in range(30)], ("a", "hub"), ("h3", "a")]
    edges = url_trust.with_shares(spark.createDataFrame([(*e, 1.0) for e in links], "src string, dst string, weight double"))
    got = {r["host"]: r["rank"] for r in url_trust.personalised_rank(edges, spark.createDataFrame([("a", 1.0), ("h7", 3.0)], "host string, seed double"), damping=0.5).collect()}
    names = sorted({h for e in links for h in e})
    at = {h: i for i, h in enumerate(names)}
    step = np.zeros((len(names), len(names)))
    for s, d in links:
        step[at[d], at[s]] += 1 / sum(x == s for x, _ in links)
    jump = np.zeros(len(names))
    jump[at["a"]], jump[at["h7"]] = 0.25, 0.75
    want = np.linalg.solve(np.eye(len(names)) - 0.5 * step, 0.5 * jump)
    assert all(abs(got.get(h, 0.0) - want[at[h]]) < 1e-7 for h in names)


def test_a_long_page_and_hot_hosts(spark, monkeypatch):
    monkeypatch.setattr(url_trust, "HUB_SHARE", 2)
    long = "<p>" + "x" * 500_000 + "".join(f"<a href='http://t{i}.net/'>" for i in range(2_000)) + "</p>"
    rows = [(i, "http://hot.net/p", "<a href='//good.org/'>") for i in range(200)] + [(500, "http://far.net/", long), (501, None, long), (502, "http://good.org/x", ""), (503, "no host", None), (504, "http://example.org/es/1", "<a href='http://hot.net/'>")]
    got = {r["page_id"]: r["verdict"] for r in url_trust.judge(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[502] == "allow" and got[504] == "block" and got[501] == got[503] == "allow"


def test_directory_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SENT_BITS", 0)
    rows = [(i, "copy of many" if i % 3 else f"own {i}") for i in range(600)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (599, 400) if i % 3 else (i, 1) for i in range(600)}


def test_lines_encode_from_parts_as_in_the_library():
    encoder = tokens.ChunkEncoder(P.path("byte_bpe_50k.json"))
    texts = ["end.\nBegin, and", "été\nÉtat!", "a.\n\nB", "\nB c.\n", "a\u0301.\nB", "it's.\nB", "x \nB", "A.\nB.\nC", "a.\n\u0301B", "ª\nʰ"]
    ids, counts = encoder.encode(pa.array(texts))
    alone = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(i) for i in alone] and ids.tolist() == [v for i in alone for v in i]
    assert {"Begin", "État"} <= set(encoder.heads) and "end" in encoder.known  # two lines' words are known apart


def test_forest_deals_the_same_documents_of_many_crowds_once(spark):
    """Two documents that share 16 places are compared by their sets once; one that only shares the places is not dealt."""
    rng = np.random.default_rng(5)
    one, odd = rng.integers(0, 256, (2, 64), np.uint8)
    two = np.concatenate([one[:40], rng.integers(0, 256, 24, np.uint8)])
    places = list(range(16))
    docs = spark.createDataFrame([(i, i, 600, places, bytearray(s.tobytes())) for i, s in enumerate((one, two, odd))], "id long, component long, n long, places array<long>, sketch binary")
    got = minhash_forest.near_units(docs).collect()
    assert sorted((r["id"], r["side"]) for r in got) == [(0, 0), (1, 0)] and len({r["pair"] for r in got}) == 1


@pytest.mark.parametrize("n, split", [(30, 30), (30, 12), (200, 200), (200, 90)])
def test_units_hold_every_near_pair(n, split):
    rng = np.random.default_rng(n + split)
    sketches = rng.integers(0, 256, (n, 64), np.uint8)
    for i in range(n // 2):
        sketches[rng.integers(0, n), :rng.integers(20, 40)] = sketches[i, :1]
    sides, ids, components = (np.arange(n) >= split).astype(np.int32), rng.permutation(n), np.arange(n) // 2
    near = {(ids[i], ids[j]) for i in range(split) for j in range(split if split < n else 0, n) if components[i] != components[j] and (sketches[i] == sketches[j]).sum() >= 28}
    found = list(minhash_forest.units(sides, ids, components, sketches))
    together = [{*ids[rows].tolist()} for _, rows, _ in found]
    assert all(sum({*p} <= t for t in together) == 1 for p in near) and set().union(*together) == {i for p in near for i in p}
    assert all((side == sides[rows]).all() if len(rows) > minhash_forest.SMALL_UNIT else not side.any() for _, rows, side in found)


def test_workers_give_memory_back_between_batches(monkeypatch):
    from lodestream.llm import shared

    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(len(seen)))
    seen = []

    def f(batches):
        for b in batches:
            seen.append(b)
            yield b

    assert list(shared.tidily(f, seconds=-1)(iter("abc"))) == ["a", "b", "c"]
    assert calls == [1, 2, 3, 3]  # behind each batch, and at the end
