"""Source divergence, Merkle manifest and WARC archives against SQL, plain versions and odd tables."""

import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import merkle_manifest, queries, source_audit, warc_archive

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, grp string, part int"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [
    (3, None, "en", "s", None, "k", "g", 1), (1, "", None, None, 0, None, None, None), (2, "Alpha beta gamma ALPHA été-été", "en", "s", 35, "k", "g", 1),
    (2, "Alpha beta gamma ALPHA été-été", "en", "s", 35, "k", "g", 1), (None, "no id here at ALL today", "en", "", 23, "k", "g", 1), (None, "no id here at ALL today", "en", "", 23, "k", "g", 1),
    (7, "ALPHA beta gamma delta", "en", "t", 35, "k", "g", 1), (9, LONG, "en", "u", len(LONG), "k", "g", 1), (8, " \n\t ", "", "t", 4, "k", "g", 1),
    (11, "alpha\x00beta\x7fgamma 漢字 Ünï", "fr", "t", 80, "k", "g", 1), (12, "only one", "de", "t", 8, "k", "g", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_as_sql(name, df, **tables):
    con = duckdb.connect()
    for t, arrow in tables.items():
        con.register(t, arrow)
    r = con.execute(queries.SQL[name])
    names = [d[0] for d in r.description]
    assert set(names) <= set(df.columns)
    want = r.fetchall()
    got = [tuple(x) for x in df.select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return got


def audited(rows, least, ranks):
    """The same by plain loops over every pair, term and source."""
    groups, seen, total = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups[lang, source].update(terms)
        seen[lang].update(set(terms))
        total[lang].add(source)
    out = []
    for lang, sources in total.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        count = {s: {t: groups[lang, s][t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        share = {s: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()} for s, c in count.items()}
        for s in sources:
            pairs = [(sum((share[s][t] - share[o][t]) ** 2 // share[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((share[s][t] - share[None][t]) ** 2 // share[None][t], t) for t in kept if count[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= ranks]
    return sorted(out)


@pytest.mark.parametrize("sent", [source_audit.GROUPS_SENT, 1])
@pytest.mark.parametrize("least, ranks", [(3, 200), (1, 5)])
def test_audit_of_odd_rows(spark, odd, monkeypatch, sent, least, ranks):
    got = sorted(tuple(r) for r in source_audit.audit(spark, odd, least, ranks, sent).collect())
    assert got == audited(ODD, least, ranks)


def test_audit_in_small_lots(spark, monkeypatch):
    """Shards of many statements and held counts that are let go early, and a term that every source has."""
    monkeypatch.setattr(source_audit, "LOT", 8)
    monkeypatch.setattr(source_audit, "HELD", 4)
    rows = [(i, f"the The w{i % 7} w{i % 5} x{i % 11}", "en" if i % 3 else "fr", f"s{i % 9}", 1, "k", "g", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in source_audit.audit(spark, docs).collect()) == audited(rows, 3, 200)


def test_audit_matches_sql(spark, empty):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert same_as_sql("op11_source_audit", queries.op11_source_audit(spark, DIR), documents=docs.toArrow())
    assert source_audit.audit(spark, empty).collect() == []


def test_shares_of_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 7)], "n long, held long, v long")
    n, held, v = df.first()
    assert df.select(source_audit.share("n", "held", "v")).first()[0] == 1 + 10**9 * (n + 1) // (held + v)


def test_terms_at_the_edges_of_texts():
    at, terms = source_audit.terms_of(pa.array(["ab", "Cd e", "", None, "é\x80x1y", " ", "z"]).slice(0))
    assert list(zip(at.tolist(), terms.to_pylist())) == [(0, "ab"), (1, "cd"), (1, "e"), (4, "é\x80x"), (4, "y"), (6, "z")]
    at, terms = source_audit.terms_of(pa.array(["ab", "Cd e", "", "z"]).slice(1, 3))
    assert list(zip(at.tolist(), terms.to_pylist())) == [(0, "cd"), (0, "e"), (2, "z")]


@pytest.mark.parametrize("rows", [merkle_manifest.RANGE_ROWS, 1, 3])
def test_manifest_of_odd_rows(spark, odd, rows):
    got = same_as_sql("op12_merkle_manifest", merkle_manifest.manifest(spark, odd, rows), documents=odd.toArrow())
    assert len(got) == len(ODD) and not all(r[-1] for r in got)


def plain_root(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256("".join(hashes[i:i + 8]).encode()).hexdigest() for i in range(0, len(hashes), 8)]
    return hashes[0]


@pytest.mark.parametrize("n, rows", [(1, 4), (8, 3), (9, 4), (65, 7), (700, 50), (585, 64), (586, 300)])
def test_manifest_over_ragged_ranges(spark, n, rows):
    """Ranges that part runs anywhere give the tree that all leaves in one place give."""
    docs = spark.range(n).select((F.col("id") * 7 % 1009).alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.when(F.col("id") % 3 > 0, "en").when(F.col("id") % 2 > 0, "fr").alias("lang"))
    got = merkle_manifest.manifest(spark, docs, rows).collect()
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    by_lang = defaultdict(list)
    for r in sorted(got, key=lambda r: r["doc_id"]):
        by_lang[langs[r["doc_id"]]].append(r)
    subroots = {lang: plain_root([r["leaf"] for r in rs]) for lang, rs in by_lang.items()}
    root = plain_root([subroots[lang] for lang in sorted(subroots, key=lambda x: (x is not None, x or ""))])
    assert len(got) == n
    for lang, rs in by_lang.items():
        for r in rs:
            assert (r["subroot"], r["root"]) == (subroots[lang], root)
            assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0) == (r["folded_root"] == root)


def test_manifest_matches_sql_and_empty(spark, empty):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert same_as_sql("op12_merkle_manifest", queries.op12_merkle_manifest(spark, DIR), documents=docs.toArrow())
    assert merkle_manifest.manifest(spark, empty).collect() == []


def test_local_levels_stop_at_ragged_runs():
    levels = merkle_manifest.local_levels([str(i) for i in range(5, 24)], 5, 30)
    assert [(b, len(x)) for b, x in levels] == [(5, 19), (1, 2)]
    assert [(lv, j) for lv, j, _ in merkle_manifest.ragged(levels, 30)] == [(0, 5), (0, 6), (0, 7), (1, 1), (1, 2)]


PAGES = "page_id long, url string, html string, row long, chunk int"
BIG = "<p>" + "é0123456789" * 400_000 + "</p>"


def odd_pages():
    same = "x" * 100
    return [(5, "http://A.org/a b\n", same, 1, 1), (3, None, same, 1, 1), (None, "http://n/", same, 1, 1), (3, "http://again/", same, 1, 1), (9, "u", "x" * 99, 1, 1), (8, "u", "x" * 99, 1, 1),
            (1, "u", None, 1, 1), (2, "u", "", None, None), (20, "http://big/", BIG, 1, 1), (21, "http://big/2", BIG, 1, 1), (30, "ü", "\r\n\r\nWARC/1.1\r\n\r\n", 1, 1), (31, "", "é" * 60, 1, 1), (None, "", "é" * 60, 1, 1)]


@pytest.mark.parametrize("size", [1 << 16, 7_000_000])
def test_archives_of_odd_rows(spark, tmp_path, size):
    pages = spark.createDataFrame(odd_pages(), PAGES)
    manifest = warc_archive.archive(spark, pages, f"file://{tmp_path}", size=size)
    chunks = warc_archive.read_archives(spark, manifest).cache()
    same_as_sql("op13_warc_archive", warc_archive.digests(chunks), pages=pages.toArrow())
    # Payloads come back whole from their chunks; running sizes follow them.
    whole = defaultdict(bytes)
    for r in sorted(chunks.collect(), key=lambda r: (r["row"], r["chunk"])):
        whole[r["row"], r["page_id"], r["record_type"]] += bytes(r["data"])
        assert len(r["data"]) <= warc_archive.CHUNK and r["last"] == (r["payload_digest"] is not None)
        assert r["record_type"] == "revisit" or len(whole[r["row"], r["page_id"], r["record_type"]]) == r["payload_bytes"]
    responses = Counter(v for k, v in whole.items() if k[2] == "response")
    assert responses == Counter({h: 1 if len(h) >= 100 else n for h, n in Counter((r[2] or "").encode() for r in odd_pages()).items()})
    # Any reader of gzip sees the records one after another.
    raw = b"".join(gzip.open(f).read() for f in sorted(tmp_path.rglob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(odd_pages())
    assert b"WARC-Target-URI: http://A.org/a%20b%0A\r\n" in raw and b"WARC-Target-URI: %C3%BC\r\n" in raw


def test_archives_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_archive, "STRETCH_BYTES", 1_000)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.repeat(F.concat(F.lit("ab"), F.col("id") % 40), 90).alias("html"))
    manifest = warc_archive.archive(spark, pages, str(tmp_path))
    assert manifest.count() > 4
    got = same_as_sql("op13_warc_archive", warc_archive.digests(warc_archive.read_archives(spark, manifest, payload=False)), pages=pages.toArrow())
    assert sum(r[3] == "response" for r in got) == 40


def test_archives_match_sql_and_empty(spark, tmp_path):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    same_as_sql("op13_warc_archive", queries.op13_warc_archive(spark, DIR), pages=pages.toArrow())
    none = warc_archive.archive(spark, spark.createDataFrame([], PAGES), str(tmp_path))
    assert warc_archive.digests(warc_archive.read_archives(spark, none)).collect() == []


def test_a_cut_archive_is_an_error(spark, tmp_path):
    manifest = warc_archive.archive(spark, spark.createDataFrame([(1, "u", "abc" * 1000, 1, 1)], PAGES), str(tmp_path))
    r = manifest.first()
    cut = open(r["file"], "rb").read()[:-30]
    with pytest.raises(ValueError, match="ends within"):
        import io
        list(warc_archive.parsed(warc_archive.Member(io.BytesIO(cut), len(cut))))
