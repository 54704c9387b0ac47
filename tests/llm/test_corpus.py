"""The corpus operators against plain Python on small tables with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import sentencepiece

import corpus_pipeline
from tidemark.llm import attention_lm, common, components, decontaminate, jaccard_join, license_scan, piece_bpe, pii, quality_rules, sharding, textscan, url_filter, warc
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BASE = " ".join(f"word{i}" for i in range(60))
#: Nulls, empty and blank texts, ties, repeated rows, a near copy, a long word, personal data.
ROWS = [
    (0, None, "en"), (1, "", "en"), (2, " \t\n ", None), (3, "one two", "en"), (4, "One  two", "de"), (5, BASE, "en"), (6, BASE + " tail", "en"), (6, BASE + " tail", "en"),
    (7, "x" * 5000 + " " + "1" * 5000, "en"), (8, "mail a.b@c.org, b@d.e@f.g or 10.0.0.256, 1.2.3.4 call +1 (551) 555-0826 now 4111 1111 1111 1111", "en"),
    (None, BASE.replace("word1 ", "other "), "en"), (9, "café ▁ \U0001F600 ab\u0000c", "fr"), (10, "again and again " * 40, "en"), (11, "a\nb c\n\na\n", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash") for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


def words(text):
    return WORD.findall(text or "")


def empty(docs):
    return docs.where("1 = 0")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5), (None, 1), (4, 1), (20, 21), (21, 22), (22, 23), (23, 24)], "a long, b long")
    got = {(r.node, r.component) for r in components.connected_components(edges, common.Scratch(spark)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), *((k, 20) for k in range(20, 25))}
    assert components.connected_components(edges.where("a > 99"), common.Scratch(spark)).count() == 0


def test_written_tables_have_small_row_groups(spark):
    wide = F.concat(*[F.sha2(F.concat_ws(" ", F.col("id"), F.lit(k)), 256) for k in range(16)])
    saved = common.Scratch(spark).save(spark.range(0, 40000, 1, 1).select("id", wide.alias("text")))
    sizes = [(g.total_byte_size, g.num_rows) for f in saved.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(n for _, n in sizes) == saved.count() == 40000 and len(sizes) > 1
    assert max(size for size, _ in sizes) < 3 * common.ROW_GROUP


def test_url_filter(spark):
    common.ship(spark)
    link = "<html><link rel='canonical' href='{}'></html>"
    rows = [
        (1, "http://Sub.Example.com/en/1?x", None, "sub.example.com", "/en/1", "example.com/en/", "block"), (2, "https://www.example.com/en/1", "", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (3, "http://a.org/p", link.format("http://example.com/en/9"), "a.org", "/p", None, "block"), (4, "http://b.org/q#f", link.format("http://a.org/p"), "b.org", "/q", None, "block"),
        (5, "http://c.org", "<meta http-equiv=refresh content='0; url=http://www.example.com/en/1'>", "c.org", "", None, "allow"), (6, None, None, "", "", None, "allow"), (7, "nothing", link.format("/x"), "", "", None, "allow"),
        (8, "http://x.net/es/", None, "x.net", "/es/", "net/es/", "block"), (8, "http://x.net/es", None, "x.net", "/es", None, "allow"),
        (9, "http://d.org/", link.format("http://example.com/en/9"), "d.org", "/", None, "block"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert sorted(map(str, map(tuple, url_filter.judge(pages).collect()))) == sorted(str((r[0], *r[3:])) for r in rows)
    moved = spark.createDataFrame([("http://a.org/p", "http://example.org/fine"), ("http://a.org/p", "http://x.com/")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages.where("page_id in (3, 4)"), moved).collect()}
    assert got == {3: "allow", 4: "allow"}  # x.com is allowed by rule, which precedes the block


def test_url_filter_reads_every_link(spark):
    common.ship(spark)
    cases = [
        ("<link rel='alternate canonical' href='http://b.org/1'><LINK REL=canonical HREF=http://b.org/2><link rel=stylesheet href=http://b.org/no>", {"http://b.org/1", "http://b.org/2"}),
        ("<link href='http://b.org/3' rel=\"canonical\"/><meta content='5;URL=http://b.org/4' http-equiv=\"Refresh\"><meta http-equiv=refresh content='0; url=\"http://b.org/5\"'>", {"http://b.org/3", "http://b.org/4", "http://b.org/5"}),
        ("<link rel='noncanonical-x' href='http://b.org/6'><meta name=refresh content='url=http://b.org/7'>", set()), ("canonical refresh", set()), ("", set()),
    ]
    df = spark.createDataFrame([("http://a.org/", h, sorted(w)) for h, w in cases], "url string, html string, want array<string>")
    for r in df.select("want", "html", url_filter._links(F.col("url"), F.col("html")).alias("got")).collect():
        assert sorted(r.got) == r.want, r.html


def test_url_filter_against_plain_components(spark):
    common.ship(spark)
    rng, hosts = np.random.default_rng(12), ["a.org", "b.net", "c.io", "d.net", "example.com"]
    urls = [f"http://{hosts[k % 5]}/{['en', 'es', 'x'][k % 3]}/{k}" for k in range(60)]
    edges = [(urls[a], urls[b]) for a, b in rng.integers(0, 60, (28, 2)).tolist()]
    moved = spark.createDataFrame([e for e in edges[:14]] + [(None, urls[0]), (urls[1], "nothing")], "from_url string, to_url string")
    html = collections.defaultdict(str)
    for a, b in edges[14:]:
        html[a] += f"<link rel=canonical href='{b}'>"
    pages = spark.createDataFrame([(k, u, html[u], "clash") for k, u in enumerate(urls)] * 2, "page_id long, url string, html string, verdict string").repartition(3)
    own = {}
    for u in urls:
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        own[u] = max(fits)[1] if fits else None
    group = {u: u for u in urls}
    for a, b in edges:
        old, new = group[a], group[b]
        group = {u: new if g == old else g for u, g in group.items()}
    want = {}
    for k, u in enumerate(urls):
        found = {own[x] for x in urls if group[x] == group[u]} - {None}
        want[k] = own[u] or ("allow" if "allow" in found else "block" if "block" in found else "allow")
    got = url_filter.judge(pages, moved).collect()
    assert len(got) == 120 and all(want[r.page_id] == r.verdict for r in got)
    assert url_filter.judge(pages.where("1 = 0"), moved).count() == 0 and {"block", "allow"} == {r.verdict for r in got if own[urls[r.page_id]] is None}


def test_url_filter_resolves_targets(spark):
    common.ship(spark)
    link, page = "<link rel=canonical href='{}'>", "http://a.org/x/y/p?q=1#f"
    cases = [
        ("page.html", "http://a.org/x/y/page.html"), ("../z", "http://a.org/x/z"), ("./", "http://a.org/x/y/"), ("../../../..", "http://a.org/"), ("?id=1", "http://a.org/x/y/p?id=1"), ("?a=1&amp;b=2", "http://a.org/x/y/p?a=1&b=2"),
        ("/login?next=https://x.net/es/", "http://a.org/login?next=https://x.net/es/"), ("//b.org/k", "http://b.org/k"), ("HTTPS://b.org/a/../k", "HTTPS://b.org/k"), ("/a?b=../c", "http://a.org/a?b=../c"), ("#g", "http://a.org/x/y/p?q=1#g"),
        ("mailto:a@b.org", None), ("&#47;n&#x2F;&eacute;&amp;lt;&none;&", "http://a.org/n/é&lt;&none;&"),
    ]
    rows = [(page, link.format(x), want) for x, want in cases] + [("http://a.org", link.format("p"), "http://a.org/p"), (page, "<base href='/d/'>" + link.format("e"), "http://a.org/d/e"), (page, "<meta http-equiv='refresh' content='0; url=../r'>", "http://a.org/x/r")]
    df = spark.createDataFrame(rows, "url string, html string, want string")
    for r in df.select("html", "want", url_filter._links(F.col("url"), F.col("html")).alias("got")).collect():
        assert r.got == ([r.want] if r.want else []), r.html
    pages = [(1, "http://x.net/es/1?a=1&b=2", None), (2, "http://x.net/pp", link.format("es/1?a=1&amp;b=2")), (3, "http://c.org/", link.format("/login?next=https://x.net/es/"))]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii(docs):
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(list("a.@+-1 29()[at]%_b"), 40))
        assert pii.find(text)[0] == plain_pii(text)
    for _, text, _ in ROWS:
        assert pii.find(text or "")[0] == plain_pii(text or "")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert "[EMAIL]" in out[8].text and "[CARD]" in out[8].text and "[PHONE]" in out[8].text and out[8].n_chars == len(out[8].text)
    assert out[0].text is None and out[5].text == BASE and out[5].kept == "clash"
    assert pii.redact(empty(docs)).count() == 0
    # Reliable labelers outvote an unreliable one, whichever it is.
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    codes = np.zeros(len(truth), dtype=np.int64)
    for j, right in enumerate((0.95, 0.9, 0.92, 0.5, 0.88, 0.9)):
        vote = np.where(rng.random(len(truth)) < right, truth, ~truth)
        codes = 3 * codes + 2 * vote
    codes *= 4
    kinds, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    found = pii.reliabilities(kinds, counts.astype(float))[back] > 0.5
    assert (found == truth).mean() > 0.97
    weights = pii.fit(kinds, counts.astype(float))
    assert ((pii._features(codes) @ weights > 0) == truth).mean() > 0.95


def test_pii_finds_looser_forms():
    text = "write to jo.doe [at] mail (dot) example . org or jo at mail dot org, host 10 . 1 . 2 . 3 and 10[.]1[.]2[.]4 or 2001:db8::1, card 4111/1111/1111/1111, 3782.822463.10005, call (030) 123 4567, 0049 30 123 4567 or 555-123-4567"
    found = [(pii.KINDS[k], text[s:e]) for s, k, e, _ in pii.find(text)[1]]
    assert [k for k, _ in found] == ["email", "email", "ip", "ip", "ip", "card", "card", "phone", "phone", "phone"], found
    assert pii.find("version 1.2 at noon, 12:30:45, a::b and 00 is not 007 or (0) x @ y")[1] == []


def test_pii_query_against_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: pii.find(r.text or "") for r in rows}
    seen = collections.Counter(k * 4 * 3**pii.LABELERS + v for _, _, every in found.values() for k, v in every)
    yes = pii.accepted(pii.model(list(seen.items())), list(seen))
    named = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    got = {r.doc_id: r for r in QUERIES["op2_pii_weak_supervision"][0](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        plain, out = plain_pii(r.text or ""), got[r.doc_id]
        assert [out.n_email, out.n_ip, out.n_card, out.n_phone] == [sum(x[1] == k for x in plain) for k in range(4)]
        assert out.base_sha256 == hashlib.sha256(named(plain).encode()).hexdigest()
        assert out.spans == named(plain + [(s, k, e) for s, k, e, v in found[r.doc_id][1] if k * 4 * 3**pii.LABELERS + v in yes])


def plain_tiles(item, text, least):
    """Greedy string tiling without hashes."""
    a, b, tiles, covered = [True] * len(item), [True] * len(text), 0, 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and a[i + k] and b[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k >= least:
                    found.append((i, j))
        if not found:
            return tiles, covered
        for i, j in sorted(found, key=lambda x: (x[1], x[0])):
            if all(a[i : i + best]) and all(b[j : j + best]):
                a[i : i + best], b[j : j + best] = [False] * best, [False] * best
                tiles, covered = tiles + 1, covered + best


def test_tiling(docs, spark):
    rng = np.random.default_rng(3)
    for _ in range(150):
        item, text = rng.integers(0, 3, rng.integers(5, 25)).astype(np.uint64), rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64)
        assert decontaminate.tile(item, text, 4) == plain_tiles(item.tolist(), text.tolist(), 4)
    item = BASE.split()
    moved = " ".join([*item[40:], "in between", *item[:20], "more", *item[20:40]])
    bench = spark.createDataFrame([(1, BASE), (2, "a b"), (3, None), (4, "x y z u v w"), (None, BASE.upper())], "item_id long, text string")
    rows = docs.unionByName(spark.createDataFrame([(50, moved, "en", "s", 0, ""), (51, " ".join(item[:20]), "en", "s", 0, "")], docs.schema))
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(rows, bench).collect()}
    assert set(got) == {(d, i) for d in (5, 6, 50, None) for i in (1, None)} and got[50, 1] == 1.0
    kept = decontaminate.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns and kept.count() == len(ROWS) + 2 - 5
    assert decontaminate.contaminated(rows, empty(bench)).count() == 0 and decontaminate.drop_contaminated(rows, empty(bench)).count() == len(ROWS) + 2


def test_sharding(docs):
    out = sharding.shard(docs).collect()
    per = collections.Counter(r.shard for r in out)
    assert len(out) == len(ROWS) and max(per.values()) - min(per[s] for s in range(8)) <= 1
    for s in per:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    text = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == text
    assert sharding.shard(empty(docs)).count() == 0


def test_sharding_joins_copies(spark):
    common.ship(spark)
    rows = [(i, f"group {i // 3}" if i < 90 else f"single {i}") for i in range(400)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    hot = sharding.shard(spark.createDataFrame([(i, "same" if i < 150 else f"{i}") for i in range(400)], "doc_id long, text string")).collect()
    own = collections.Counter(r.shard for r in hot if r.text_crc32 == zlib.crc32(b"same"))
    assert max(own.values()) == 50  # a shard is full of the group that is larger than it


def test_sharding_joins_copies_without_unlinked_rows(spark):
    common.ship(spark)
    assert sharding._admitted({(0, 1): 5, (1, 0): 3, (1, 2): 2, (2, 0): 2}, [0] * 8) == {(0, 1): 5, (1, 0): 3, (1, 2): 2, (2, 0): 2}  # swaps and a cycle need no room
    assert sharding._admitted({(0, 1): 5, (1, 0): 3, (2, 1): 4}, [0, 1, 0, 0, 0, 0, 0, 0]) in ({(0, 1): 4, (1, 0): 3}, {(0, 1): 3, (1, 0): 3, (2, 1): 1})
    for size in (2, 5):
        out = sharding.shard(spark.createDataFrame([(i, f"group {i // size}") for i in range(2000)], "doc_id long, text string")).collect()
        by = collections.defaultdict(set)
        for r in out:
            by[r.text_crc32].add(r.shard)
        assert set(collections.Counter(r.shard for r in out).values()) == {250}
        assert sum(len(s) > 1 for s in by.values()) <= (0.02 if size == 2 else 0.25) * len(by)


def test_quality(docs, spark):
    out = quality_rules.signals(docs).select("doc_id", "text", "_tm_q.*").collect()
    for r in out:
        w = words(r.text)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, None}
    clash = docs.withColumn("stratum", F.lit(1)).withColumn("_tm_q", F.lit(2)).withColumn("cut_mean_word", F.lit(3.0)).withColumn("a.b", F.lit(4))
    assert quality_rules.keep_good(clash, labels).columns == clash.columns and quality_rules.keep_good(clash, labels).count() == kept.count()
    assert quality_rules.keep_good(empty(docs), labels).count() == 0


def test_thresholds_keep_their_promise(spark):
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    df = spark.createDataFrame([(0, 500), (3, 500), (9, 1200), (30, 400), (0, 0), (1, 51), (15, 1600), (16, 1600), (17, 1600), (5, 10**9)], "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        assert r.p == pytest.approx(0.0 if r.n > 10**6 else tail(r.k, r.n, 0.02) if r.n and r.k < 0.02 * r.n else 1.0, rel=1e-9)
    # Far more false rejections than fit a plain sum of all terms.
    large = [(79_000, 4_000_000), (79_900, 4_000_000), (19_950_000, 10**9)]
    for r in spark.createDataFrame(large, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        i = np.arange(r.k, max(-1, r.k - 200_000), -1, dtype=float)
        steps = np.concatenate([[0.0], np.cumsum(np.log(i[:-1] / (r.n - i[:-1] + 1) * 0.98 / 0.02))])
        top = math.lgamma(r.n + 1) - math.lgamma(r.k + 1) - math.lgamma(r.n - r.k + 1) + r.k * math.log(0.02) + (r.n - r.k) * math.log(0.98)
        assert r.p == pytest.approx(math.exp(top) * np.exp(steps).sum(), rel=1e-4)  # what lgamma can tell
    rng = np.random.default_rng(4)
    rows = [(i, "en" if i % 2 else "de", float(x), 0.0, 0.0, 5.0, 0.0, int(q)) for i, (q, x) in enumerate((q, rng.random() * (0.02 if q else 2)) for q in rng.random(8000) < 0.8)]
    measured = spark.createDataFrame([r[:7] for r in rows], "doc_id long, stratum string, symbols_per_word double, dup_line_share double, repeat_share double, mean_word double, bangs_per_word double")
    cuts = {r.of_stratum: r for r in quality_rules.thresholds(measured, spark.createDataFrame([(r[0], r[7]) for r in rows], "doc_id long, quality int"), common.Scratch(spark)).collect()}
    again = spark.createDataFrame([r[:7] for r in rows for _ in range(3)], measured.schema)  # rows that repeat are no more trials
    assert {r.of_stratum: r for r in quality_rules.thresholds(again, spark.createDataFrame([(r[0], r[7]) for r in rows], "doc_id long, quality int"), common.Scratch(spark)).collect()} == cuts
    for s in ("en", "de"):
        assert cuts[s].cut_symbols_per_word == 0.05 and cuts[s].cut_mean_word is None


def test_licenses(docs, spark):
    text = license_scan.TEMPLATES["mit"]
    rows = [(1, "before " + text + " after"), (2, text.replace("Software", "Program", 2)), (3, "no licence here"), (4, None), (5, "Released under the MIT License. x y z Released  under the mit license"), (5, "plain")]
    got = [(r.doc_id, r.license) for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, "mit"), (2, "mit"), (5, "mit-notice"), (5, "mit-notice")]
    assert license_scan.licenses(empty(docs)).count() == 0 and license_scan.licenses(docs).count() == 0
    a, b = "x a b c y d e".split(), "a b c z d e".split()
    assert license_scan.align(a, b) == [(1, 0), (2, 1), (3, 2), (5, 4), (6, 5)]
    clash = spark.createDataFrame([(None, text, "x", 1.0), (9, text + "\n" + text, "y", 2.0)], "doc_id long, text string, license string, coverage double")
    assert sorted(str(r.doc_id) for r in license_scan.licenses(clash).collect()) == ["9", "9", "None"]


def test_licenses_with_words_between():
    known = license_scan.Templates(license_scan.TEMPLATES)
    for name, own in zip(known.names, known.words, strict=True):
        assert [f[:3] for f in known.find(" ".join(own)) if f[0] == name] == [(name, 1.0, len(own))]
    own = known.words[known.names.index("mit")]
    for every in (1, 2, 5):
        spread = [w for k, x in enumerate(own) for w in ([x, f"between{k}"] if k % every == 0 else [x])]
        assert "mit" in [f[0] for f in known.find("lead in " + " ".join(spread) + " lead out")]
    long = " ".join([" ".join(own[:80]), "aside " * 100, " ".join(own[80:])])
    assert [f[0] for f in known.find(long) if f[0] == "mit"] == ["mit"]
    three = " ".join(own[:30] + ["changed"] + own[31:]) + " "
    assert [f[2] for f in known.find(three * 3) if f[0] == "mit"] == [len(own) - 1] * 3


def test_licenses_against_all_stretches():
    rng, names = np.random.default_rng(11), ("p", "q")
    for _ in range(150):
        texts = {n: " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for n in names}
        own = rng.choice(list("abcdefghijk"), rng.integers(0, 60)).tolist()
        known, want = license_scan.Templates(texts), []
        for n in names:
            template, every = texts[n].split(), []
            for at in range(len(own)):
                for x in license_scan.STRETCHES if own[at] in template else ():
                    same = license_scan.align(own[at : at + math.ceil(x * len(template))], template)
                    if len(same) >= 0.8 * len(template):
                        every.append((-len(same), at + same[0][0], at + same[-1][0]))
                        break
            taken = []
            for size, first, last in sorted(every):
                if all(last < f or first > e for f, e in taken):
                    taken.append((first, last))
                    want.append((n, -size / len(template), -size, first, last))
        assert known.find(" ".join(own)) == sorted(want, key=lambda x: (x[3], x[0]))


def test_piece_bpe(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    own, rng = piece_bpe.load(piece_bpe.default_path()), np.random.default_rng(5)
    texts = [t or "" for _, t, _ in ROWS] + ["".join(rng.choice(list("aaabteh e   é①ﬁ\n\t▁\u0000中\U0001F6000123.,!"), n)) for n in rng.integers(1, 60, 1500)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == library.encode(t) and (own.decode(ids) == library.decode(ids) if ids else t == "")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter((i, len(ids := library.encode(t or "")), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else "")) for i, t, _ in ROWS)
    assert collections.Counter(tuple(r) for r in piece_bpe.encode_digests(docs).collect()) == want
    out = piece_bpe.encode_column(docs.withColumn("ids", F.lit(1)), decoded="again").collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.again) for r in out) == collections.Counter((i, tuple(ids := library.encode(t or "")), library.decode(ids) if ids else "") for i, t, _ in ROWS)
    assert piece_bpe.encode_column(docs).columns == [*docs.columns, "ids"] and piece_bpe.encode_digests(empty(docs)).count() == 0


def test_language_model(docs, spark):
    out = attention_lm.scores(docs).collect()
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t, _ in ROWS if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, held(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t, _ in ROWS)
    assert collections.Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in out) == want and all(r.score < 0 for r in out)
    assert attention_lm.scores(empty(docs)).count() == 0


def subword_model():
    """A small trained model over 300 ids and the end, whose ids follow each other with two ids between."""
    rng = np.random.default_rng(6)
    rows = np.cumsum(np.ones((600, 33), dtype=np.int64), axis=1) + rng.integers(0, 250, (600, 1))
    rows = np.where(np.arange(33) % 3 > 0, rows % 300, rng.integers(0, 300, (600, 33)))
    counts = np.bincount(rows[:, 1:].ravel(), minlength=301)
    first, pairs = attention_lm.Model(counts), np.zeros((attention_lm.SLOTS, attention_lm.OWN + attention_lm.CLASSES), np.float32)
    np.add.at(pairs, (first.slot[rows[:, :-1]], first.column(rows[:, 1:])), 1)
    return attention_lm.Model(counts, np.arange(301) % 2 == 0, pairs), rows


def test_attention_learns_beyond_pairs():
    model, rows = subword_model()
    x, y, weight = model.slot[rows[:50, :-1]], model.cls[rows[:50, 1:]], np.ones((50, 32))
    before, _ = model.loss(x, y, weight)
    for _ in range(8):
        model.train(rows, np.ones(len(rows), dtype=np.int64), rate=0.02)
    assert model.loss(x, y, weight)[0] < 0.9 * before
    # The gradient is that of the loss.
    loss, g = model.loss(x, y, weight)
    rng = np.random.default_rng(7)
    for name in ("w", "o", "d"):
        way = rng.standard_normal(model.params[name].shape).astype(np.float32)
        old, step = model.params[name], np.float32(1e-2)
        ends = []
        for sign in (1, -1):
            model.params[name] = old + sign * step * way
            ends.append(model.loss(x, y, weight)[0])
        model.params[name] = old
        assert (ends[0] - ends[1]) / (2 * step) == pytest.approx(float((g[name] * way).sum()), rel=0.05, abs=2e-3)


def test_large_scores_keep_their_shares():
    model, rows = subword_model()
    model.params = {k: v * np.float32(1 if k == "d" else 12) for k, v in model.params.items()}
    model.tables()
    assert not model.calm and np.isfinite(model.score(rows[:40].ravel(), np.full(40, 33))).all()


def test_blocks_score_like_one_token_at_a_time():
    model, _ = subword_model()
    model.tables()
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 300, n).tolist() for n in (0, 1, 15, 16, 17, 33, 50, 100)]
    got = model.score(np.array([i for t in texts for i in t]), np.array([len(t) for t in texts]), block=3)
    for t, score in zip(texts, got, strict=True):
        whole, want = [300, *t, 300], 0.0
        for k in range(1, len(whole)):
            every = model.next_ids(whole[:k])
            assert sum(10.0**every) == pytest.approx(1, abs=1e-5)
            want += every[whole[k]]
        assert score == pytest.approx(want, rel=1e-5)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    rng = np.random.default_rng(1)
    model = attention_lm.Model(rng.integers(1, 1000, 301).astype(float))
    model.tables()
    texts = [rng.integers(0, 300, n) for n in rng.integers(0, 400, 300)]
    score = lambda some: model.score(np.concatenate(some), np.array([len(t) for t in some])).tolist()
    whole = score(texts)
    for cut in (1, 7, 100, 233):
        assert score(texts[:cut]) + score(texts[cut:]) == whole


def test_scores_follow_from_the_documents_alone(spark):
    docs = common.table(spark, SF, "documents")
    one, many = (sorted(map(tuple, attention_lm.scores(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many
    # Held-out documents: well above the share of each subword.
    plain = piece_bpe.load(piece_bpe.default_path())
    rows, end = docs.collect(), len(plain.pieces)
    ids = {r.doc_id: [*plain.encode([r.text or ""])[0], end] for r in rows}
    held = {r[0] for r in one if r[1]}
    counts = np.bincount([i for d, own in ids.items() if d not in held for i in own], minlength=end + 1) + 1.0
    share = np.log10(counts / counts.sum())
    assert sum(r[6] for r in one if r[1]) > 0.8 * sum(share[ids[d]].sum() for d in held)


def test_warc(spark, tmp_path):
    common.ship(spark)
    long = "WARC/1.1\r\né" * 9000
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/ c", "x" * 200), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", "short"), (7, "u", "short"), (None, "u", long), (8, "u", "y" * 150), (8, "u", "y" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write(pages, f"{tmp_path}/w", common.Scratch(spark))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in warc.read(spark, f"{tmp_path}/w").collect())
    row = lambda i, h, kind, to: (i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), kind, to, True)
    want = [row(i, h, "revisit" if i in (2, None) else "response", {2: 1, None: 5}.get(i)) for i, _, h in rows]
    assert got == collections.Counter(want)
    own = warc.records(1, 1, "u", long.encode(), hashlib.sha256(long.encode()).hexdigest(), None, None, False)
    parsed = [warc._row(warc._parse(r.removeprefix(warc.MARK).encode() + b"\r\n\r\n")) for r in own]
    assert len(own) > 2 and [p[1] for p in parsed] == list(range(1, len(own) + 1))
    assert warc.dechunked(warc.chunked(long.encode())) == long.encode()


def test_warc_without_pages_and_with_other_columns(spark, tmp_path):
    common.ship(spark)
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200, "r", 3, False), (2, "http://a/", "x" * 200, "r", 3, False)], "page_id long, url string, html string, record_type string, refers_to int, complete boolean")
    warc.write(pages, f"{tmp_path}/w", common.Scratch(spark))
    assert sorted((r.page_id, r.record_type, r.refers_to, r.complete) for r in warc.read(spark, f"{tmp_path}/w").collect()) == [(1, "response", None, True), (2, "revisit", 1, True)]
    warc.write(pages.where("1 = 0"), f"{tmp_path}/none", common.Scratch(spark))
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


def test_warc_tells_broken_segments(spark, tmp_path):
    import gzip

    common.ship(spark)
    payload = b"caf\xe9 \xff\x00" * 6000  # no UTF-8
    digest = hashlib.sha256(payload).hexdigest()
    block = warc.HTTP + b"".join(b"%x\r\n%b\r\n" % (len(payload[a : a + 999]), payload[a : a + 999]) for a in range(0, len(payload), 999)) + b"0\r\n\r\n"
    cuts = [block[a : a + 10_000] for a in range(0, len(block), 10_000)]

    def record(fields, body):
        return warc.MARK.encode() + "".join(f"{k}: {v}\r\n" for k, v in [*fields.items(), ("Content-Length", len(body))]).encode() + b"\r\n" + body + b"\r\n\r\n"

    def segments(page, total=len(block), sha=digest):
        own = [record({"WARC-Type": "response", "WARC-Record-ID": f"<{page}>", "WARC-Payload-Digest": f"sha256:{sha}", "X-Page-Id": page, "WARC-Segment-Number": 1}, cuts[0])]
        for k, body in enumerate(cuts[1:], 2):
            last = {"WARC-Segment-Total-Length": total} if k == len(cuts) else {}
            own.append(record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{page}:{k}>", "WARC-Segment-Origin-ID": f"<{page}>", "WARC-Segment-Number": k} | last, body))
        return own

    def revisit(page, to, n=len(payload), sha=digest):
        return [record({"WARC-Type": "revisit", "WARC-Record-ID": f"<{page}>", "WARC-Payload-Digest": f"sha256:{sha}", "X-Page-Id": page, "X-Refers-To-Page": to, "X-Payload-Length": n}, b"")]

    whole = segments(1)
    missing, twice = segments(2), segments(3)
    every = [*whole[::-1], *missing[:1], *missing[2:], *twice, twice[1], *segments(4)[:-1], *segments(5, total=7), *segments(6, sha="0" * 64), *segments(7)[1:], *revisit(8, 1), *revisit(9, 2), *revisit(10, 1, 5), *revisit(11, 1, sha="1" * 64)]
    (tmp_path / "w").mkdir()
    with gzip.open(tmp_path / "w/a.warc.gz", "wb") as f:
        f.write(b"".join(every))
    got = {r.page_id: r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert {k for k, r in got.items() if r.complete} == {1, 8} and set(got) == {*range(1, 7), None, *range(8, 12)}
    assert (got[1].payload_bytes, got[1].payload_digest) == (len(payload), digest)


def plain_components(rows, by_row=False):
    sets = [(lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(words((t or "").translate(LOWER))) for _, t, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    if by_row:
        return [least[g] if s else None for s, g in zip(sets, group, strict=True)]
    return collections.Counter((r[0], len(s), r[0] if not s else least[g]) for r, s, g in zip(rows, sets, group, strict=True))


@pytest.mark.parametrize("size", [jaccard_join.BIN, 300])
def test_jaccard_components(docs, spark, monkeypatch, size):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(jaccard_join, "BIN", size)  # small bins: most questions go to other bins
    rows = list(ROWS)
    for g in range(3):
        text = [f"g{g}w{k}" for k in range(80)]
        for k in range(20):
            own = list(text)
            for at in rng.choice(80, rng.integers(0, 4), replace=False):
                own[at] = f"edit{rng.integers(99)}"
            rows.append((100 + 50 * g + k, " ".join(own), "en"))
    common_line = " ".join(f"line{k}" for k in range(30))
    rows += [(400 + k, common_line + " " + " ".join(f"d{k}w{j}" for j in range(40)), "en") for k in range(30)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(df).collect())
    assert got == plain_components(rows)


def test_jaccard_keeps_one_row_of_each_component(docs, spark):
    one, two = BASE, " ".join(f"other{k}" for k in range(60))
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (None, two), (None, "quite alone here"), (4, None), (4, None), (5, " "), (6, "short text"), (6, "short text")]
    df = spark.createDataFrame([(i, t, k, 1, 2) for k, (i, t) in enumerate(rows)], "doc_id long, text string, many int, copy int, kept_id int").repartition(3)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, one), (1, two), (None, "quite alone here"), (4, None), (4, None), (5, " "), (6, "short text")]))
    assert jaccard_join.keep_one(empty(docs)).count() == 0 and jaccard_join.jaccard_components(empty(docs)).count() == 0


def _near_group(n: int, most: int) -> list[np.ndarray]:
    """Shared shingles of near copies of a text of 150 words, each with up to ``most`` words changed, which takes five shingles each."""
    r, base = np.random.default_rng(3), np.arange(1, 147, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    gone = [{int(k) for w in r.integers(0, 142, r.integers(1, most + 1)) for k in range(w, w + 5)} for _ in range(n)]
    return [np.sort(base[[k for k in range(146) if k not in g]]) for g in gone]


def _rows(sets: list[np.ndarray], first: int, role: int) -> pd.DataFrame:
    return pd.DataFrame({"cid": range(first, first + len(sets)), "n": 146, "shared": [x.tobytes() for x in sets], "label": range(first, first + len(sets)), "role": role})


@pytest.mark.parametrize("asked", [False, True])
def test_near_copies_that_cannot_link_cost_no_merge(monkeypatch, asked):
    sets, asked_sets = _near_group(150, 6), _near_group(230, 6)[150:] if asked else []
    search, calls = jaccard_join.divide_skip, []
    monkeypatch.setattr(jaccard_join, "divide_skip", lambda *a: calls.append(len(found := search(*a))) or found)
    rows = pd.concat([_rows(sets, 0, 0), *([_rows(asked_sets, 1000, 1)] if asked else [])], ignore_index=True)
    got = jaccard_join._search((0,), rows)
    links = {(a, b) for a, b in zip(got["a"], got["b"], strict=True)}
    every = dict(enumerate(sets)) | {1000 + i: x for i, x in enumerate(asked_sets)}

    def linked(a, b):
        both = len(np.intersect1d(every[a], every[b]))
        return 100 * both >= 80 * (292 - both)

    def classes(pairs):
        at = {i: i for i in every}
        for a, b in pairs:
            old, now = at[a], at[b]
            at = {i: now if c == old else c for i, c in at.items()}
        return {frozenset(i for i in every if at[i] == c) for c in set(at.values())}

    asking = range(1000, 1000 + len(asked_sets)) if asked else range(len(sets))
    assert all(linked(a, b) for a, b in links)
    assert classes(links) == classes((a, b) for a in asking for b in range(len(sets)) if a != b and linked(a, b))
    # Two sets of 146 link from 130 common shingles on.
    assert len(calls) <= sum(len(every[i]) >= 130 for i in asking) < len(asking)


def test_divide_skip_finds_what_all_pairs_find():
    rng = np.random.default_rng(10)
    for _ in range(60):
        pool = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(12)]
        for k in range(4):
            pool.append(np.unique(np.concatenate([pool[k][1:], rng.integers(0, 60, 1).astype(np.uint64)])))
        sizes, lists = np.array([len(x) for x in pool]), jaccard_join.inverted(pool)
        for i, q in enumerate(pool):
            open_ = rng.random(len(pool)) < 0.8
            want = [k for k, x in enumerate(pool) if open_[k] and 100 * len(np.intersect1d(x, q)) >= 80 * len(np.union1d(x, q))]
            assert sorted(jaccard_join.divide_skip(sizes, q, len(q), lists, open_).tolist()) == want


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and out.columns == ["doc_id", "lang", "source", "ids", "decoded_sha256"]
    assert 0 < len(rows) < spark.read.parquet(f"{SF}/documents.parquet").count() and len({r.doc_id for r in rows}) == len(rows)
    # Each stage against plain Python over all documents.
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in QUERIES["op5_risk_controlled_quality"][0](spark, SF).where("kept").collect()}
    left = [(i, docs[i].text, docs[i].lang) for i in sorted(good)]
    named = plain_components(left, by_row=True)
    left = [r for r, component in zip(left, named, strict=True) if component is None or component == r[0]]
    items = [WORD.findall((r.text or "").translate(LOWER)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code) + 1) for w in ws], dtype=np.uint64)
    items = [number(w) for w in items if len(w) >= 5]
    seeds = [{tuple(x[k : k + 5].tolist()) for k in range(len(x) - 4)} for x in items]
    clean = []
    for r in left:
        text = number(WORD.findall((r[1] or "").translate(LOWER)))
        own = {tuple(text[k : k + 5].tolist()) for k in range(len(text) - 4)}
        if not any(own & s and decontaminate.tile(x, text)[1] >= 0.5 * len(x) for x, s in zip(items, seeds, strict=True)):
            clean.append(r)
    found = {i: pii.find(t or "") for i, t, _ in clean}
    seen = collections.Counter(k * 4 * 3**pii.LABELERS + v for _, _, every in found.values() for k, v in every)
    yes = pii.accepted(pii.model(list(seen.items())), list(seen))
    want = {}
    for i, t, _ in clean:
        parts, at = [], 0
        for s, k, e in sorted(found[i][0] + [(s, k, e) for s, k, e, v in found[i][1] if k * 4 * 3**pii.LABELERS + v in yes]):
            if s >= at:
                parts += [t[at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        ids = library.encode("".join([*parts, (t or "")[at:]]))
        want[i] = (ids, hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest())
    assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in rows} == want


def test_pipeline_stages_take_odd_rows(docs, spark):
    wide = docs.withColumn("ids", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty(wide), SF).count() == 0
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns and 0 < out.count() <= wide.count()
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).count() == wide.count()
    # Each decision takes effect: the short texts go, one of two near copies stays, personal data is masked.
    texts = lambda k: [r.text for r in corpus_pipeline.STAGES[k][1](spark, docs, SF).collect()]
    assert "one two" not in texts(0) and sum(BASE in (t or "") for t in texts(1)) == 1 and any("[EMAIL]" in (t or "") for t in texts(3))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    run, sql = QUERIES[name]
    got, want = run(spark, SF).toPandas(), con.sql(sql).df()
    order = sorted(got.columns)
    text = lambda df: sorted(df[order].astype(object).where(df[order].notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) else str(v)).agg("|".join, axis=1))
    assert text(got) == text(want)


def test_scorer_reads_the_same_ids_as_the_plain_encoder():
    texts = ["", None, "a", " ", "  a  b\n\n c\n", "▁x ▁ y▁▁", "\n", " \n ", "é▁▂ ▁", "日本語 テキスト\n終", "a" * 5000 + " b ", "x\ty\rz", None, "end end"]
    plain = piece_bpe.load(piece_bpe.default_path())
    encoder = piece_bpe.Encoder(piece_bpe.default_path())
    for _ in range(2):  # unknown words first, then remembered ones
        flat, many = encoder.ids(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(flat, np.cumsum(many)[:-1])]
        assert got == plain.encode([t or "" for t in texts])
    encoder.MOST = 3  # everything is forgotten before each call
    assert (encoder.ids(pa.array(texts, pa.string()))[0] == flat).all()


def test_language_model_trains_on_every_subword():
    texts = [None, "", "end", "\n".join(f"word{k} two" for k in range(4000)), "日本語テキスト" * 900, " ".join(f"w{k}" for k in range(31)), "z " * 300, "end"]
    plain = piece_bpe.load(piece_bpe.default_path()).encode([t or "" for t in texts])
    end = len(piece_bpe.load(piece_bpe.default_path()).pieces)
    zeros = pa.array([0] * len(texts), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), zeros, zeros, zeros], ["text", "one", "two", "held"])
    encoded = attention_lm._encode(piece_bpe.default_path())([batch])
    blobs = [(k, b) for out in attention_lm._deal(6, end)(encoded) for k, b in zip(out.column("key").to_pylist(), out.column("blob").to_pylist(), strict=True) if k <= attention_lm.WINDOWS]
    assert {k for k, _ in blobs} == {attention_lm.WINDOWS - g for g in range(6)}
    rows = np.concatenate([np.frombuffer(b, dtype=attention_lm.WINDOW) for _, b in blobs])
    want = collections.Counter()
    for ids in plain:
        own = [end, *ids, end]
        for at in range(0, len(own) - 1, 32):
            want[tuple((own[at : at + 33] + [65535] * 33)[:33])] += 1
    assert {tuple(r["ids"].tolist()): int(r["n"]) for r in rows} == want and want[(end, *plain[2], end, *[65535] * (31 - len(plain[2])))] == 2
    # Windows that are alike weigh as many, and what fills up a window is not learned.
    model, rng = attention_lm.Model(np.ones(300)), np.random.default_rng(8)
    x, y = model.slot[rng.integers(0, 300, (5, 32))], model.cls[rng.integers(0, 300, (5, 32))]
    real = np.arange(32) < np.full((5, 1), 20)
    pick = lambda g: {k: v for k, v in g.items() if k != "e"}
    for a, b in (((x[:, :20], y[:, :20], np.ones((5, 20))), (x, y, real * 1.0)), ((x[[0, 0, 1]], y[[0, 0, 1]], np.ones((3, 32))), (x[:2], y[:2], np.ones((2, 32)) * [[2], [1]]))):
        short, whole = model.loss(*a), model.loss(*b)
        assert whole[0] == pytest.approx(short[0], rel=1e-5) and all(np.allclose(whole[1][k], v, atol=1e-6) for k, v in pick(short[1]).items())
        assert np.allclose(whole[1]["e"][1].sum(axis=0), short[1]["e"][1].sum(axis=0), atol=1e-6)


def test_merged_windows_are_weighed():
    rows = attention_lm._dealt(np.array([[1] * 33, [2] * 33, [1] * 33], dtype="<u2"))
    both = attention_lm._weighed(np.concatenate([rows, rows]))
    assert sorted((int(r["ids"][0]), int(r["n"])) for r in both) == [(1, 4), (2, 2)]


def test_index_of_hashes():
    rng = np.random.default_rng(9)
    index, known = textscan.Index(2), {}
    for n in (0, 1, 5, 300, 2000):
        h = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 50, n, dtype=np.uint64)]))
        h = h[[int(x) not in known for x in h]]
        index.add(h, np.arange(len(known), len(known) + len(h)))
        known.update(zip(h.tolist(), range(len(known), len(known) + len(h)), strict=True))
        ask = np.concatenate([np.array(list(known), dtype=np.uint64), rng.integers(0, 99, 200, dtype=np.uint64)])
        assert index.get(ask).tolist() == [known.get(x, -1) for x in ask.tolist()]
